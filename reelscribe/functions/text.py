"""Column functions on recognised text. Lengths and distances are in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORED, SCORE_IGNORED, TIME_LABEL, WHITE


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def normalized(text: Column) -> Column:
    """Without white space and light punctuation; what anchors compare."""
    return F.regexp_replace(text, f"[{IGNORED}]", "")


def score_normalized(text: Column) -> Column:
    """Like ``normalized``, and without curly quotes; what scoring compares."""
    return F.regexp_replace(text, f"[{SCORE_IGNORED}]", "")


def norm_of(lines: DataFrame) -> Column:
    """The column ``norm`` where an earlier stage has kept it, else ``normalized`` text."""
    return F.col("norm") if "norm" in lines.columns else normalized(F.col("text"))


def norm_length(lines: DataFrame) -> Column:
    """The length of what ``norm_of`` gives: the column ``n_norm`` where an earlier stage has kept it."""
    return F.col("n_norm") if "n_norm" in lines.columns else F.char_length(norm_of(lines))


def common_start(left: Column, right: Column) -> Column:
    """How many characters two texts begin with alike, by halves: each step compares a stretch of a power of two."""
    least = F.least(F.char_length(left), F.char_length(right))
    powers = F.reverse(F.sequence(F.lit(0), F.greatest(F.floor(F.log2(least)), F.lit(0)).cast("int")))

    def step(found: Column, power: Column) -> Column:
        size = F.pow(F.lit(2), power).cast("int")
        same = left.substr(found + 1, size) == right.substr(found + 1, size)
        return F.when((found + size <= least) & same, found + size).otherwise(found)

    return F.when(least > 0, F.aggregate(powers, F.lit(0), step)).otherwise(F.lit(0))


def first_difference(left: Column, right: Column) -> Column:
    """The first byte at which two binaries differ, by halves: -1 if they are equal, the shorter one's length if it begins the
    other; null if one is null."""
    return F.when(left == right, F.lit(-1)).when(left.isNotNull() & right.isNotNull(), common_start(left, right))


def edit_distance(lines: DataFrame, left: str, right: str, name: str, bound: str | None = None) -> DataFrame:
    """Adds ``name``, the edit distance of two columns; with ``bound``, an SQL expression, -1 beyond it.

    What the texts begin and end with alike doesn't count, so a slip in a long line costs no whole table of cells.
    """
    keep = lines.columns
    cut = lines.withColumn("_same", common_start(F.col(left), F.col(right)))
    cut = cut.withColumn("_l", F.reverse(F.expr(f"substring({left}, _same + 1)"))).withColumn("_r", F.reverse(F.expr(f"substring({right}, _same + 1)")))
    cut = cut.withColumn("_same", common_start(F.col("_l"), F.col("_r")))
    cut = cut.withColumn("_l", F.expr("substring(_l, _same + 1)")).withColumn("_r", F.expr("substring(_r, _same + 1)"))
    return cut.select(*keep, F.expr(f"levenshtein(_l, _r{f', {bound}' if bound else ''})").alias(name))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_time_label(text: Column) -> Column:
    return trimmed(text).rlike(TIME_LABEL)


def frame_file(number: Column) -> Column:
    return F.format_string("f_%04d.jpg", number)


def cache_file(name: Column) -> Column:
    """The JSON file of a frame's image; an error for any other name."""
    return F.when(
        name.rlike(r"(?i)^f_[0-9]{4}\.(jpe?g|png)$"), F.regexp_replace(name, r"(?i)\.(jpe?g|png)$", ".json")
    ).otherwise(F.raise_error(F.concat(F.lit("not a frame name: "), F.coalesce(name, F.lit("null")))))


def local_path(source: Column, provider: bool = False) -> Column:
    """The path that a source on this machine names, else null: an absolute path, or the path of a ``file:`` address.

    With ``provider``, as for videos, ``content:`` addresses come through as they are. What stands before the first colon is the
    scheme, and its case counts; a query or fragment is no part of a path, and an escape that can't be decoded has none.
    """
    head = F.when(F.instr(source, ":") > 0, F.substring_index(source, ":", 1))
    rest = F.when(head.isNull(), source).otherwise(F.regexp_replace(source, "^[^:]*:", ""))
    bare = F.regexp_extract(rest, r"^(?://[^/?#]*+)?+(/[^?#]*)", 1)
    path = F.when(bare != "", F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))))
    local = F.when(head.isNull() | (head == "file"), path)
    return F.when(head == "content", source).otherwise(local) if provider else local


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
