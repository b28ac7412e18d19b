"""Recognition results in and out: nested OCR JSON, per-frame caches, whole bundles, reports and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import finite, valid_box
from ..functions.text import cache_file, trimmed
from ..operators.folds import dealt

BOX = "struct<left: double, top: double, width: double, height: double>"
RESULT = f"array<struct<frame: {BOX}, lines: array<struct<text: string, confidence: double, frame: {BOX}>>>>"
LINE = "text string, x double, y double, w double, h double, conf double"
CACHED = "array<struct<text: string, x: double, y: double, w: double, h: double, conf: double>>"
LINES = "array<struct<text: string, x: double, y: double, w: double, h: double, conf: double>>"
#: Frames of a recording that its caches keep together.
STRETCH = 1000
BUNDLE = (
    "formatVersion int, stats struct<formatVersion: int, fps: double, sourceFrameCount: int, capturedFrameCount: int, capturesEverySourceFrame: boolean>, "
    f"frames array<struct<file: string, sourceIndex: int, timeMs: double, lines: {LINES}>>"
)


def recognised_lines(results: DataFrame) -> DataFrame:
    """``recording_id, frame_idx, line_no, text, x, y, w, h, conf`` of ``results(recording_id, frame_idx, blocks)``.

    A line without a box has its block's; blank texts and boxes without an area are left out.
    """
    block = results.select("recording_id", "frame_idx", F.posexplode("blocks").alias("block_no", "block"))
    line = block.select("recording_id", "frame_idx", "block_no", "block.frame", F.posexplode("block.lines").alias("in_block", "line"))
    box = F.coalesce("line.frame", "frame")
    flat = line.select(
        "recording_id", "frame_idx", "block_no", "in_block", trimmed(F.col("line.text")).alias("text"), box["left"].alias("x"), box["top"].alias("y"),
        box["width"].alias("w"), box["height"].alias("h"), F.when(finite(F.col("line.confidence")), F.col("line.confidence")).alias("conf"),
    )
    good = flat.where((F.char_length("text") > 0) & valid_box(*(F.col(c) for c in "xywh")))
    number = F.row_number().over(Window.partitionBy("recording_id", "frame_idx").orderBy("block_no", "in_block")) - 1
    return good.withColumn("line_no", number).select("recording_id", "frame_idx", "line_no", "text", "x", "y", "w", "h", "conf")


def valid_line(line: Column) -> Column:
    conf = line["conf"]
    ok = (F.char_length(line["text"]) > 0) & finite(line["x"]) & finite(line["y"]) & finite(line["w"]) & finite(line["h"])
    return F.coalesce(ok & (conf.isNull() | finite(conf)), F.lit(False))


def in_folder(spark: SparkSession, root: str, path: Column) -> Column:
    """A file's path below ``root``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    return F.substring(path, len(full) + 2, 1 << 30)


def frame_caches(spark: SparkSession, root: str, stride: int = 1) -> tuple[DataFrame, DataFrame]:
    """``frames(recording_id, frame_idx, file)`` and their observations, from folders with one JSON array of lines per frame.

    A recording is a folder below ``root`` (``root`` itself is ''); its files in order of name are its frames, of which every
    ``stride``-th is taken and numbered. A frame without lines is a frame. Lines without a text are left out; a file that is no
    JSON array is an error, and one of no bytes, which Spark doesn't list, no frame. Files are numbered by their names alone, per recording; no file is read
    for that.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(root)
    name = in_folder(spark, root, F.col("path"))
    file, folder = F.element_at(F.split(name, "/"), -1), F.regexp_replace(name, "/?[^/]*$", "")
    place = F.row_number().over(Window.partitionBy("recording_id").orderBy("file")) - 1
    listed = files.select("path", folder.alias("recording_id"), file.alias("file")).withColumn("i", place)
    taken = listed.where(F.col("i") % stride == 0).select("path", "recording_id", F.floor(F.col("i") / stride).cast("int").alias("frame_idx"), "file")
    content = F.decode("content", "UTF-8")
    lines = F.from_json(content, CACHED)
    lines = F.when(lines.isNull() | ~F.ltrim(content).startswith("["), F.raise_error(F.concat(F.lit("no JSON array of lines: "), "path"))).otherwise(lines)
    read = taken.join(files.select("path", lines.alias("lines")), "path")
    line = read.select("recording_id", "frame_idx", F.posexplode("lines").alias("line_no", "line"))
    seen = line.where("line.text is not null").select("recording_id", "frame_idx", "line_no", "line.*")
    return taken.select("recording_id", "frame_idx", "file"), seen


def read_frame_caches(spark: SparkSession, path: str, recording_id: str, stride: int = 1) -> DataFrame:
    """Observations of one recording's folder; see ``frame_caches``."""
    return frame_caches(spark, path, stride)[1].where("recording_id = ''").withColumn("recording_id", F.lit(recording_id))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row per bundle file at ``path`` or in folders below: ``bundle, formatVersion, stats, frames``. A bundle's name is its
    whole path, so files of one name in several folders are apart."""
    found = spark.read.schema(BUNDLE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return found.withColumn("bundle", F.col("_metadata.file_path"))


def bundle_violations(bundles: DataFrame) -> DataFrame:
    """``bundle, violations``: names of the rules that a bundle breaks, none for one that can be imported."""
    return bundles.select("bundle", broken_rules().alias("violations"))


def broken_rules() -> Column:
    """The rules that a row of ``read_bundles`` breaks."""
    frames, stats = F.col("frames"), F.col("stats")
    count = F.coalesce(F.size("frames"), F.lit(0))
    rules = {
        "format": (F.col("formatVersion") != 1) | (count <= 0),
        "completeness": (stats["formatVersion"] != 1) | ~stats["capturesEverySourceFrame"] | (stats["sourceFrameCount"] != count) | ~(stats["fps"] > 0),
        "sequence": ~F.forall(
            F.transform(frames, lambda f, i: (f["file"] == F.format_string("f_%04d.json", i + 1)) & (f["sourceIndex"] == i)), lambda ok: F.coalesce(ok, F.lit(False))
        ),
        "time": ~F.forall(
            F.transform(frames, lambda f, i: finite(f["timeMs"]) & ((i == 0) | (f["timeMs"] > F.try_element_at(frames, i)["timeMs"])) & (f["timeMs"] >= 0)), lambda ok: F.coalesce(ok, F.lit(False))
        ),
        "lines": ~F.forall(frames, lambda f: F.coalesce(F.forall(f["lines"], valid_line), F.lit(False))),
        "captured": stats["capturedFrameCount"] != count,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))


def frame_violations(frames: DataFrame) -> DataFrame:
    """``recording_id, frame_no, rule`` of ``frames(recording_id, frame_no, file, source_idx, time_ms)`` in order of
    frame_no: a file or source number out of sequence, or a time not after the one before."""
    before = F.lag("time_ms").over(Window.partitionBy("recording_id").orderBy("frame_no"))
    expected = F.format_string("f_%04d.json", F.col("frame_no") + 1)
    wrong = (F.col("file") != expected) | (F.col("source_idx") != F.col("frame_no"))
    stuck = ~finite(F.col("time_ms")) | (F.col("time_ms") <= before)
    rule = F.when(F.coalesce(wrong, F.lit(True)), "sequence").when(F.coalesce(stuck, F.lit(False)), "time")
    return frames.select("recording_id", "frame_no", rule.alias("rule")).where("rule is not null")


def sound_bundles(bundles: DataFrame) -> DataFrame:
    """The same bundles; reading one that breaks a rule is an error that names it."""
    broken = broken_rules()
    failed = F.raise_error(F.concat("bundle", F.lit(" breaks: "), F.array_join(broken, ", ")))
    return bundles.withColumn("frames", F.when(F.size(broken) == 0, F.col("frames")).otherwise(failed))


def bundle_observations(bundles: DataFrame) -> DataFrame:
    """Observations of bundles that break no rule; an error names one that does."""
    frame = sound_bundles(bundles).select(F.col("bundle").alias("recording_id"), F.posexplode("frames").alias("frame_idx", "frame"))
    return frame.select("recording_id", "frame_idx", F.posexplode("frame.lines").alias("line_no", "line")).select("recording_id", "frame_idx", "line_no", "line.*")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_caches(frames: DataFrame, path: str) -> DataFrame:
    """Writes ``frames(recording_id, file, source_idx, time_ms, lines)`` and returns ``recording_id, file, bytes`` of its frames.

    The target may be missing or empty; one that holds anything is refused before any work. Frames are rows of JSON in
    compressed files, as many as the session shuffles to and not a folder per recording, which costs more than its rows once recordings are
    many. A recording's frames stay together by the thousand, in order. Spark's committer puts files in place once all are
    written, so that a failed write leaves no part of itself to be read. A null or empty list of lines is a frame without lines. Repeated rows are written each.
    """
    spark = frames.sparkSession
    files, where = _files(spark, path)
    if files.exists(where) and len(files.listStatus(where)):
        raise ValueError(f"the target is not empty: {path}")
    lines = F.coalesce(F.col("lines"), F.from_json(F.lit("[]"), CACHED))
    rows = frames.select(F.col("recording_id").cast("string"), "file", "source_idx", F.col("time_ms").cast("double"), F.to_json(lines, {"ignoreNullFields": "false"}).alias("content"))
    together = rows.withColumn("stretch", F.floor(F.col("source_idx") / STRETCH))
    by_recording = dealt(together, "recording_id", "stretch").sortWithinPartitions("recording_id", "source_idx").drop("stretch")
    by_recording.write.mode("append").option("compression", "gzip").json(path)
    return written_caches(spark, path).select("recording_id", "file", F.octet_length("content").alias("bytes"))


def written_caches(spark: SparkSession, path: str) -> DataFrame:
    """``recording_id, file, source_idx, time_ms, content`` of what ``write_caches`` wrote; an id is a string, null included."""
    schema = "recording_id string, file string, source_idx long, time_ms double, content string"
    return spark.read.schema(schema).json(path)


def cached_observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``frames(recording_id, frame_idx, file, time_ms)`` and observations of what ``write_caches`` wrote."""
    held = written_caches(spark, path)
    line = held.select("recording_id", F.col("source_idx").cast("int").alias("frame_idx"), F.posexplode(F.from_json("content", CACHED)).alias("line_no", "line"))
    frames = held.select("recording_id", F.col("source_idx").cast("int").alias("frame_idx"), "file", "time_ms")
    return frames, line.select("recording_id", "frame_idx", "line_no", "line.*")


def import_bundles(bundles: DataFrame, path: str) -> DataFrame:
    """Writes the frames of ``read_bundles`` as caches and returns ``write_caches``' rows; one broken bundle fails them all."""
    frame = sound_bundles(bundles).select(F.col("bundle").alias("recording_id"), F.explode("frames").alias("f"))
    return write_caches(frame.select("recording_id", F.col("f.file"), F.col("f.sourceIndex").cast("long").alias("source_idx"), F.col("f.timeMs").alias("time_ms"), "f.lines"), path)


def cache_exports(frames: DataFrame) -> DataFrame:
    """``recording_id, file, content``: one JSON array per frame of ``frames(recording_id, name, source_idx, time_ms, lines)``.

    A name that is no frame's, one that repeats, or a line without text or geometry is an error.
    """
    file = cache_file(F.col("name"))
    repeat = F.count("*").over(Window.partitionBy("recording_id", F.lower("name"))) > 1
    sound = F.forall("lines", lambda l: (F.char_length(l["text"]) > 0) & finite(l["x"]) & finite(l["y"]) & finite(l["w"]) & finite(l["h"]))
    good = F.coalesce(sound, F.lit(False)) & ~repeat
    content = F.when(good, F.to_json("lines", {"ignoreNullFields": "false"})).otherwise(F.raise_error(F.concat(F.lit("bad frame "), "name")))
    return frames.select("recording_id", file.alias("file"), "source_idx", "time_ms", content.alias("content"))


def export_stats(frames: DataFrame, source_frames: DataFrame) -> DataFrame:
    """Per recording: lines, lines without confidence, captured frames, and whether they are all source frames."""
    counted = frames.groupBy("recording_id").agg(
        F.count("*").alias("captured_frames"),
        F.sum(F.size("lines")).alias("ocr_lines"),
        F.sum(F.size(F.filter("lines", lambda l: l["conf"].isNull()))).alias("null_confidence"),
    )
    joined = counted.join(source_frames, "recording_id", "left")
    label = F.when(F.col("null_confidence") > 0, "partial-or-unavailable-null").otherwise("mlkit-line-confidence")
    return joined.withColumn("confidence", label).withColumn("captures_every_source_frame", F.col("captured_frames") == F.col("source_frames"))


def report_bodies(reports: DataFrame) -> DataFrame:
    """``report_id, markdown`` between a report's marker lines; null without them."""
    body = F.regexp_extract("text", r"(?s)----- BEGIN MARKDOWN -----\n(.*?)\n?----- END MARKDOWN -----", 1)
    return reports.select("report_id", F.when(F.col("text").contains("----- BEGIN MARKDOWN -----"), body).alias("markdown"))


def report_texts(results: DataFrame) -> DataFrame:
    """``run_id, text``: a report of ``results(run_id, engine, status, timings map, stats, warnings, markdown)``."""
    timing = F.array_join(F.transform(F.map_entries("timings"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("-")), F.lit(" ms"))), "\n")
    warnings = F.when(F.size("warnings") > 0, F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "\n")).otherwise("none")
    text = F.concat_ws(
        "\n", F.concat(F.lit("engine: "), "engine"), F.concat(F.lit("status: "), "status"), F.lit(""), timing, F.lit(""), F.lit("stats:"), "stats", F.lit(""), F.lit("warnings:"), warnings,
        F.lit(""), F.lit("----- BEGIN MARKDOWN -----"), "markdown", F.lit("----- END MARKDOWN -----"),
    )
    return results.select("run_id", text.alias("text"))
