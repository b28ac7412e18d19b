"""Chat bubbles: alignment peaks, grouping, nicknames, sides and the tagged transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALIGN_TOLERANCE, BUBBLE_DX, BUBBLE_DY, OTHER, SELF
from ..functions.geometry import band
from ..functions.text import is_time_label
from .folds import Columns, fold, islands


def align_peaks(lines: DataFrame) -> DataFrame:
    """``recording_id, left_peak, right_peak``: the most frequent left edge in the left half and right edge in the right.

    ``lines(recording_id, seq, text, x, w)``; texts of one character don't count, of equal counts the edge seen first
    wins, and a side without any is null.
    """
    sized = lines.withColumn("right", F.col("x") + F.col("w"))
    width = sized.groupBy("recording_id").agg(F.greatest(F.max("right"), F.lit(1.0)).alias("width"))
    wide = sized.join(width, "recording_id")
    peaks = width.select("recording_id")
    for name, edge, inside in (("left_peak", "x", F.col("x") < F.col("width") / 2), ("right_peak", "right", F.col("right") > F.col("width") / 2)):
        counted = wide.where((F.char_length("text") >= 2) & inside).groupBy("recording_id", edge).agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
        top = counted.groupBy("recording_id").agg(F.max_by(edge, F.struct("n", -F.col("seen"))).alias(name))
        peaks = peaks.join(top, "recording_id", "left")
    return peaks


def hits(lines: DataFrame, peaks: DataFrame) -> DataFrame:
    """Adds ``left_hit, right_hit``: the line's edge lies at the recording's peak."""
    near = lines.join(peaks, "recording_id")
    left = F.coalesce(F.abs(F.col("x") - F.col("left_peak")) <= ALIGN_TOLERANCE, F.lit(False))
    right = F.coalesce(F.abs(F.col("x") + F.col("w") - F.col("right_peak")) <= ALIGN_TOLERANCE, F.lit(False))
    return near.withColumn("left_hit", left).withColumn("right_hit", right)


def nearest_groups(lines: Columns) -> Columns:
    """Each line joins the group that it follows most closely, of equally close ones the least shifted, then newest."""
    gy, x = lines["gy"], lines["x"]
    of: list[int] = []
    bottom: list[float] = []  # of each group: its lowest line so far, and the left edge of its newest
    left: list[float] = []
    for i in range(len(gy)):
        near = [
            (gy[i] - bottom[g], abs(x[i] - left[g]), -g)
            for g in range(len(bottom))
            if 0 <= gy[i] - bottom[g] < BUBBLE_DY and abs(x[i] - left[g]) < BUBBLE_DX
        ]
        g = -min(near)[2] if near else len(bottom)
        if g == len(bottom):
            bottom.append(gy[i])
            left.append(x[i])
        of.append(g)
        bottom[g], left[g] = max(bottom[g], gy[i]), x[i]
    order = sorted(range(len(of)), key=lambda i: (of[i], gy[i], x[i]))
    row, rows = 0, []
    for n, i in enumerate(order):
        row = row + 1 if n and of[order[n - 1]] == of[i] else 0
        rows.append(row)
    keep = ("seq", "frame_idx", "text", "x", "y", "w", "h", "gy", "left_hit", "right_hit", "left_peak")
    return {c: [lines[c][i] for i in order] for c in keep} | {"group_no": [of[i] for i in order], "row_no": rows}


BUBBLE = ["recording_id", "island", "group_no"]


def bubble_rows(lines: DataFrame) -> DataFrame:
    """Rows of bubbles; ``recording_id, island, group_no`` name a bubble and row_no its rows from the top.

    ``lines(recording_id, seq, frame_idx, text, x, y, w, h, gy)``, seq their order. Time labels and lines at neither
    peak go first; then a vertical step of a bubble's height can't be bridged, so each island is folded alone.
    """
    shown = hits(lines, align_peaks(lines)).where((F.col("left_hit") | F.col("right_hit")) & ~is_time_label(F.col("text")))
    cut = islands(shown, ["recording_id"], "gy", BUBBLE_DY, ["seq"], inclusive=False)
    schema = (
        "group_no int, row_no int, seq int, frame_idx int, text string, x double, y double, w double, h double, gy double, "
        "left_hit boolean, right_hit boolean, left_peak double"
    )
    return fold(cut, ["recording_id", "island"], ["gy", "seq"], nearest_groups, schema)


def nickname_kind(wide_body: bool = True) -> Column:
    """Whether a row and the next in its bubble look like a display name above a message; geometry alone decides."""
    w = Window.partitionBy(*BUBBLE).orderBy("row_no")

    def below(name: str) -> Column:
        return F.lead(name).over(w)

    inset, body = F.col("left_peak") - F.col("x"), below("x") - F.col("left_peak")
    dx, dy = below("x") - F.col("x"), below("gy") - F.col("gy")
    common = (
        F.col("left_hit") & ~F.col("right_hit") & below("left_hit") & inset.between(14, 30) & F.col("h").between(16, 27) & dy.between(44, 56)
    )
    plain = body.between(-2, 2) & below("h").between(26, 37) & (dx >= 14)
    wide = F.lit(wide_body) & body.between(-11, -3) & below("h").between(31, 37) & (below("h") - F.col("h") >= 5) & (dx >= 7)
    return F.when(common & plain, "separate-top-line").when(common & wide, "separate-top-line-wide-body")


def message_segments(rows: DataFrame, internal: bool = True, wide_body: bool = True) -> DataFrame:
    """``…bubble, segment_no, text, nickname, body, kind``: bubbles cut before each display name inside them.

    Nothing may be lost by a cut: a name and its body that aren't the segment's text leave it without a name, and segments
    that don't join to the bubble's text leave the bubble whole. Null texts are left out of a text, wherever it is joined.
    """
    kind = nickname_kind(wide_body)
    if not internal:
        kind = F.when(F.col("row_no") == 0, kind)
    marked = rows.withColumn("kind", kind)
    running = Window.partitionBy(*BUBBLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("kind").isNotNull() & (F.col("row_no") > 0)).cast("int")
    numbered = marked.withColumn("segment_no", F.sum(cut).over(running))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda r: r["text"])
    grouped = numbered.groupBy(*BUBBLE, "segment_no").agg(listed.alias("texts"), F.min_by("kind", "row_no").alias("kind"))
    parts = F.struct("segment_no", "texts", F.array_join("texts", "").alias("text"), "kind")
    whole = rows.groupBy(*BUBBLE).agg(F.array_join(listed, "").alias("whole"))
    bubbles = grouped.groupBy(*BUBBLE).agg(F.array_sort(F.collect_list(parts)).alias("parts")).join(whole, BUBBLE)
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    bare = F.array(F.struct(F.lit(0).cast("long").alias("segment_no"), F.array("whole").alias("texts"), F.col("whole").alias("text"), F.lit(None).cast("string").alias("kind")))
    segments = bubbles.select(*BUBBLE, F.explode(F.when(joined == F.col("whole"), F.col("parts")).otherwise(bare)).alias("p")).select(*BUBBLE, "p.*")
    body = F.array_join(F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))), "")
    named = F.col("kind").isNotNull() & (F.concat(F.element_at("texts", 1), body) == F.col("text"))
    return segments.select(
        *BUBBLE, "segment_no", "text", F.when(named, F.element_at("texts", 1)).alias("nickname"), F.when(named, body).alias("body"), F.when(named, F.col("kind")).alias("kind"),
    )


def bubble_labels(rows: DataFrame, policy: str = "pixels") -> DataFrame:
    """``…bubble, first_seq, gy, text, label, kind`` and ``sample``, the largest row of a bubble whose sides disagree.

    By ``pixels`` such a bubble waits for a colour sample. By ``geometry``, for recordings without frames, it is mine if rows at
    the right peak lie in two bands of height or more, else the other's, and has no sample. No rows give no bubbles.
    """
    if policy not in ("pixels", "geometry"):
        raise ValueError(f"unknown policy: {policy}")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda r: r["text"])
    box = F.struct("frame_idx", "x", "y", "w", "h")
    grouped = rows.groupBy(*BUBBLE).agg(
        F.min("seq").alias("first_seq"),
        F.min("gy").alias("gy"),
        F.array_join(listed, "").alias("text"),
        F.bool_or("left_hit").alias("has_left"),
        F.bool_or("right_hit").alias("has_right"),
        F.max_by(box, F.struct(F.col("w") * F.col("h"), -F.col("row_no"))).alias("sample"),
        F.size(F.collect_set(F.when(F.col("right_hit"), band(F.col("gy"))))).alias("right_bands"),
    )
    both = F.col("has_left") & F.col("has_right")
    mine, pixels = F.col("right_bands") >= 2, F.lit(policy == "pixels")
    guess = F.when(~pixels, F.when(mine, "me").otherwise("them"))
    how = F.when(pixels, "pixel-pending").when(mine, "weak-right-repeat").otherwise("double-default-left")
    return grouped.select(
        *BUBBLE,
        "first_seq",
        "gy",
        "text",
        F.when(both, guess).when(F.col("has_right"), "me").otherwise("them").alias("label"),
        F.when(both, how).when(F.col("has_right"), "definite-right").otherwise("definite-left").alias("kind"),
        F.when(both & pixels, F.col("sample")).alias("sample"),
    )


def numbered_bubbles(labels: DataFrame) -> DataFrame:
    """Adds ``bubble_no``, the bubble's place in its recording in order of creation."""
    w = Window.partitionBy("recording_id").orderBy("first_seq")
    return labels.withColumn("bubble_no", F.row_number().over(w) - 1)


def region_requests(bubbles: DataFrame, frames: DataFrame) -> DataFrame:
    """``recording_id, id, bubble_no, frame_idx, uri, x, y, width, height`` for each bubble to sample.

    ``frames(recording_id, frame_idx, uri)`` must know the frame, and the box must have an area; else it is an error.
    """
    wanted = bubbles.where("sample is not null").select("recording_id", "bubble_no", "sample.*")
    found = wanted.join(frames.select("recording_id", "frame_idx", "uri"), ["recording_id", "frame_idx"], "left")
    x, y = F.greatest(F.lit(0), F.floor("x")), F.greatest(F.lit(0), F.floor("y"))
    right, bottom = F.ceil(F.col("x") + F.col("w")), F.ceil(F.col("y") + F.col("h"))
    return found.select(
        "recording_id",
        F.concat(F.lit("bubble-"), F.col("bubble_no").cast("string")).alias("id"),
        "bubble_no",
        "frame_idx",
        F.coalesce("uri", F.raise_error(F.concat(F.lit("no frame file for frame "), F.col("frame_idx").cast("string")))).alias("uri"),
        x.alias("x"),
        y.alias("y"),
        F.when((right > x) & (bottom > y), right - x).otherwise(F.raise_error(F.lit("empty box"))).alias("width"),
        (bottom - y).alias("height"),
    )


def resolved_bubbles(bubbles: DataFrame, samples: DataFrame) -> DataFrame:
    """Labels with the samples' sides: ``label, kind, error, warned``; a bubble that stays without one is warned of.

    ``samples(recording_id, id, side, error)``, with ``decoded_pixels`` and ``sampled_pixels`` if counted; a missing sample is
    an error of its own and has no pixels.
    """
    counts = [F.col(c) if c in samples.columns else F.lit(None).cast("long").alias(c) for c in ("decoded_pixels", "sampled_pixels")]
    keyed = bubbles.withColumn("id", F.concat(F.lit("bubble-"), F.col("bubble_no").cast("string")))
    sampled = samples.select("recording_id", "id", "side", "error", F.lit(True).alias("answered"), *counts)
    joined = keyed.join(sampled, ["recording_id", "id"], "left")
    pending = F.col("kind") == "pixel-pending"
    error = F.when(pending & F.col("answered").isNull(), "E_RESULT_MISSING").when(pending, F.col("error"))
    side = F.when(pending & F.col("side").isin("me", "them"), F.col("side"))
    kind = (
        F.when(~pending, F.col("kind")).when(side.isNotNull(), "pixel-color").when(error.isNotNull(), "pixel-error").otherwise("pixel-unresolved")
    )
    return joined.select(
        *BUBBLE, "bubble_no", "first_seq", "text", F.coalesce("label", side).alias("label"), kind.alias("kind"), error.alias("error"),
        (pending & side.isNull()).alias("warned"), *(F.when(pending, F.col(c)).alias(c) for c in ("decoded_pixels", "sampled_pixels")),
    )


def chat_transcript(resolved: DataFrame, segments: DataFrame) -> DataFrame:
    """``recording_id, markdown``: a line per message; unknown sides are left out, nicknames only tag incoming ones."""
    known = resolved.where("label is not null")
    mine = known.where("label = 'me'").select("recording_id", "bubble_no", F.lit(0).cast("long").alias("segment_no"), F.concat(F.lit(f"[{SELF}] "), "text").alias("text"))
    theirs = known.where("label = 'them'").drop("text", "kind").join(segments, BUBBLE)
    tag = F.when(F.col("nickname").isNotNull(), F.concat(F.lit("["), "nickname", F.lit("] "), "body")).otherwise(F.concat(F.lit(f"[{OTHER}] "), "text"))
    theirs = theirs.select("recording_id", "bubble_no", "segment_no", tag.alias("text"))
    from .rows import document

    return document(mine.unionByName(theirs), ["bubble_no", "segment_no"])


def speaker_stats(resolved: DataFrame, segments: DataFrame) -> DataFrame:
    """Per recording of ``resolved_bubbles``: how sides were found, the pixels looked at, and what became of the display names
    in ``message_segments``: found by either rule, cut out of the inside of bubbles, and applied to incoming messages."""
    sampled = F.col("kind").startswith("pixel")
    sides = resolved.groupBy("recording_id").agg(
        F.count_if(sampled).alias("dual"),
        F.count_if(F.col("kind") == "pixel-color").alias("pixel_resolved"),
        F.count_if((F.col("kind") == "pixel-color") & (F.col("label") == "me")).alias("pixel_me"),
        F.count_if((F.col("kind") == "pixel-color") & (F.col("label") == "them")).alias("pixel_them"),
        F.count_if("warned").alias("pixel_unresolved"),
        F.count_if(F.col("error").isNotNull()).alias("pixel_errors"),
        F.sum(F.coalesce("decoded_pixels", F.lit(0).cast("long"))).alias("decoded_pixels"),
        F.sum(F.coalesce("sampled_pixels", F.lit(0).cast("long"))).alias("sampled_pixels"),
    )
    labels = resolved.select(*BUBBLE, "label")
    wide = F.col("kind") == "separate-top-line-wide-body"
    names = segments.join(labels, BUBBLE, "left").groupBy("recording_id").agg(
        F.count("nickname").alias("nickname_candidates"),
        F.count_if(F.col("nickname").isNotNull() & ~wide).alias("nickname_high_confidence"),
        F.count_if(F.col("nickname").isNotNull() & wide).alias("nickname_wide_body"),
        F.count_if(F.col("segment_no") > 0).alias("nickname_internal_splits"),
        F.count_if(F.col("nickname").isNotNull() & (F.col("label") == "them")).alias("nickname_applied"),
    )
    counts = ["nickname_candidates", "nickname_high_confidence", "nickname_wide_body", "nickname_internal_splits", "nickname_applied"]
    return sides.join(names, "recording_id", "left").fillna(0, counts)
