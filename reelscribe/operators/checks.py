"""Timing reconciliation, routing policies, report checks and scores against the truth."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import OTHER, SELF, VISUAL_MESSAGE
from ..functions.geometry import finite, half_up
from ..functions.text import score_normalized, trimmed
from .folds import Columns, fold


def reconcile(timings: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """``accounted_ms, unclassified_ms, threshold_ms, should_warn`` of ``timings(*keys, total_ms, parts map)``.

    A part that is missing, negative or no number is an error.
    """
    value = [F.try_element_at("parts", F.lit(p)) for p in parts]
    sound = finite(F.col("total_ms")) & (F.col("total_ms") >= 0)
    for v in value:
        sound = sound & finite(v) & (v >= 0)
    accounted = sum(value[1:], value[0])
    checked = timings.withColumn("accounted_ms", F.when(sound, accounted).otherwise(F.raise_error(F.lit("timings must be finite and non-negative"))))
    checked = checked.withColumn("unclassified_ms", F.col("total_ms") - F.col("accounted_ms"))
    checked = checked.withColumn("threshold_ms", F.greatest(F.lit(100.0), F.col("total_ms") * 0.01))
    return checked.select(
        *keys, "total_ms", "accounted_ms", "unclassified_ms", "threshold_ms", (F.abs("unclassified_ms") > F.col("threshold_ms")).alias("should_warn")
    )


def default_engine(platform: Column) -> Column:
    return F.when(platform == "android", "anchor").otherwise("stitch")


def status(warnings: Column, timing_warning: Column) -> Column:
    warned = (F.coalesce(F.size(warnings), F.lit(0)) > 0) | (F.coalesce(timing_warning, F.lit("")) != "")
    return F.when(warned, "warning").otherwise("ok")


def offers_retry(engine: Column, state: Column, unresolved: Column) -> Column:
    """Whether a run's result should be offered again on the stitching engine."""
    return F.coalesce((engine == "anchor") & ((state == "warning") | (F.coalesce(unresolved, F.lit(0)) > 0)), F.lit(False))


def empty_failure(markdown: Column, speaker_warnings: Column) -> Column:
    blank = F.char_length(trimmed(F.coalesce(markdown, F.lit("")))) == 0
    return blank & (F.coalesce(F.size(speaker_warnings), F.lit(0)) <= 0)


#: Stats that every accepted report has.
REPORT_KEYS = ["app", "durationMs", "screenAwakeRequested"]
RUN_KEYS = [
    "fps", "anchorPairCount", "anchorPassedCount", "anchorDetails", "stride", "maxAnchorGapMs", "sourceFrameCount", "extractedFrameCount", "frameCount",
    "ocrCaptureEnabled", "ocrCapturedFrameCount", "dedupeCandidateGroups", "dedupeMajorityChosen", "dedupeChangedSelection", "sampleRegionCount",
    "sampleUnresolvedCount", "decodedPixels", "frameExtractionMethod", "nativeFrameExtractMs", "nativeFrameExtractPerFrameMs", "timingDeltaMs",
    "timingThresholdMs", "cleanupAttemptCount", "remainingTempFileCount", "nativeStaleTempFileCount", "nativeStaleTempFileDeletedCount",
]
STATS = (
    "app string, durationMs double, screenAwakeRequested boolean, fps double, anchorPairCount int, anchorPassedCount int, "
    "anchorDetails array<map<string, string>>, stride int, maxAnchorGapMs double, sourceFrameCount int, extractedFrameCount int, frameCount int, "
    "ocrCaptureEnabled boolean, ocrCapturedFrameCount int, sampleRegionCount int, sampleUnresolvedCount int, frameExtractionMethod string, "
    "nativeFrameExtractMs double, nativeFrameExtractPerFrameMs double, remainingTempFileCount int, nativeStaleTempFileCount int, "
    "nativeStaleTempFileDeletedCount int"
)


def report_violations(reports: DataFrame, allow_warning: bool = False, allow_failed: bool = False, ceiling_ms: int = 40_000) -> DataFrame:
    """Adds ``violations``, the names of the acceptance rules that a run report breaks (none: accepted).

    ``reports(report_id, engine, status, mode, total_ms, timings map, stats JSON string)``, mode chat or generic.
    """
    s = F.col("s")
    keys = F.json_object_keys("stats")
    chat = F.col("mode") == "chat"
    stride = F.when(chat, 5).otherwise(3)
    done = F.col("status") != "failed"
    per_frame = half_up(s["nativeFrameExtractMs"] * 10 / s["extractedFrameCount"]) / 10
    details = F.forall(s["anchorDetails"], lambda d: F.size(F.array_intersect(F.map_keys(d), F.array(*map(F.lit, ["fuzzyCandidateVotes", "fuzzyCandidateTotal", "fuzzyCandidateVoteRatio"])))) == 3)

    def missing(wanted: list[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(keys, F.array().cast("array<string>")))) > 0

    rules = {
        "engine": F.col("engine") != "anchor",
        "status": ~F.col("status").isin("ok", "warning", "failed"),
        "failed": ~done & F.lit(not allow_failed),
        "warning": (F.col("status") == "warning") & F.lit(not allow_warning),
        "mode": ~F.col("mode").isin("chat", "generic"),
        "stats_keys": missing(REPORT_KEYS) | (done & missing(RUN_KEYS)),
        "screen_awake": done & ~s["screenAwakeRequested"],
        "extraction_method": done & (s["frameExtractionMethod"] != "MediaMetadataRetriever.OPTION_CLOSEST"),
        "sampling": done & ((s["fps"] != 4) | (s["stride"] != stride) | (s["maxAnchorGapMs"] != stride * 250)),
        "source_frames": done & ((s["durationMs"] <= 0) | (s["sourceFrameCount"] != F.greatest(F.lit(1), half_up(s["durationMs"] * s["fps"] / 1000)))),
        "frames": done & (s["frameCount"] != F.ceil(s["sourceFrameCount"] / s["stride"])),
        "capture": done & (s["ocrCaptureEnabled"] | (s["extractedFrameCount"] != s["frameCount"]) | (s["ocrCapturedFrameCount"] != s["frameCount"])),
        "per_frame_time": done & (F.abs(s["nativeFrameExtractPerFrameMs"] - per_frame) > 0.11),
        "anchor_details": done & ((F.size(s["anchorDetails"]) != s["anchorPairCount"]) | ~details),
        "anchor_pairs": done & (s["anchorPairCount"] != F.greatest(F.lit(0), s["frameCount"] - 1)),
        "anchor_passed": done & (s["anchorPassedCount"] != s["anchorPairCount"]),
        "speakers": done & chat & ((s["sampleRegionCount"] < 1) | (s["sampleUnresolvedCount"] != 0)),
        "temp_files": done & ((s["remainingTempFileCount"] != 0) | (s["nativeStaleTempFileCount"] != s["nativeStaleTempFileDeletedCount"])),
        "ceiling": done & (F.col("total_ms").isNull() | (F.col("total_ms") > ceiling_ms)),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))
    return reports.withColumn("s", F.from_json("stats", STATS)).withColumn("violations", broken).drop("s")


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def most_alike(text: str, others: list[str], free: list[int]) -> tuple[int | None, float]:
    """The first of the ``free`` others that is most like the text; cheap upper bounds come before the whole ratio."""
    for i in free:
        if others[i] == text:
            return i, 1.0  # nothing is more alike, and none before it is equal
    best, at = 0.0, None
    matcher = difflib.SequenceMatcher(None)
    matcher.set_seq1(text)
    for i in free:
        longest = len(text) + len(others[i])
        if longest and 2 * min(len(text), len(others[i])) <= best * longest:
            continue
        matcher.set_seq2(others[i])
        if matcher.quick_ratio() > best and (r := matcher.ratio()) > best:
            best, at = r, i
    return at, best


def assign(rows: Columns, least: float = 0.55) -> Columns:
    """Each true message, in order, takes the most alike unused prediction, if that is alike enough; the run's totals."""
    cut = rows["is_truth"].index(True) if True in rows["is_truth"] else len(rows["is_truth"])
    norm, who = rows["norm"], rows["who"]
    free, taken = list(range(cut)), []  # predictions lead
    for t in range(cut, len(norm)):
        at, alike = most_alike(norm[t], norm, free)
        if at is not None and alike > least:
            free.remove(at)
            taken.append((t, at, alike))
    places = [at for _, at, _ in taken]
    return {
        "n_truth": [len(norm) - cut],
        "n_predicted": [cut],
        "n_matched": [len(taken)],
        "n_exact": [sum(r >= 0.999 for _, _, r in taken)],
        "n_speaker": [sum(who[t] == who[at] for t, at, _ in taken)],
        "char_ratio": [ratio("".join(norm[cut:]), "".join(norm[i] for i in places))],
        "in_order": [places == sorted(places)],
    }


SCORE = "n_truth int, n_predicted int, n_matched int, n_exact int, n_speaker int, char_ratio double, in_order boolean"


def transcript_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores per run of ``truth`` and ``predicted``, both ``(run_id, msg_no, who, text)``.

    True messages that are one bracketed picture don't count. An assignment depends on those before it, so a run's
    messages are one fold. Null texts are left out; a run without true messages matches nothing.
    """
    columns = ["run_id", "msg_no", "who", score_normalized(F.col("text")).alias("norm")]
    real = truth.where(~F.col("text").rlike(VISUAL_MESSAGE)).select(*columns, F.lit(True).alias("is_truth"))
    said = predicted.where("text is not null").select(*columns, F.lit(False).alias("is_truth"))
    return fold(real.unionByName(said), ["run_id"], ["is_truth", "msg_no"], assign, SCORE)


def tagged_messages(lines: DataFrame) -> DataFrame:
    """``run_id, msg_no, who, text`` of the tagged lines of transcripts ``(run_id, line_no, line)``."""
    pattern = rf"^\[({SELF}|{OTHER}|me|them)\]\s*(.*)$"
    line = trimmed(F.col("line"))
    who = F.when(F.regexp_extract(line, pattern, 1).isin(SELF, "me"), "me").otherwise("them")
    return lines.where(line.rlike(pattern)).select("run_id", F.col("line_no").alias("msg_no"), who.alias("who"), F.regexp_extract(line, pattern, 2).alias("text"))


def digests(texts: DataFrame, key: str = "run_id") -> DataFrame:
    """SHA-256, lines (a trailing newline ends one) and characters of each text."""
    parts = F.split("text", "\n")
    lines = F.when(F.char_length("text") == 0, 0).otherwise(F.size(parts) - F.col("text").endswith("\n").cast("int"))
    return texts.select(key, F.sha2("text", 256).alias("sha256"), lines.alias("n_lines"), F.char_length("text").alias("n_chars"))


def capture_marks(wanted: DataFrame, captured: DataFrame) -> DataFrame:
    """``captured`` beside what was asked for, and the ``rule`` that each row breaks, null for none.

    ``wanted(recording_id, idx, time_ms)`` are the requested frames, ``captured(recording_id, idx, uri, width, height, requested_ms)``
    the delivered ones. Rules: ``count`` (a recording has more or fewer frames than wanted; at each of its rows),
    ``invalid`` (no uri or no finite size), ``time`` (it answers another time) and ``size`` (not that of its recording's frame of
    the least idx). A frame that nobody asked for, or that never came, has nulls on that side. The marks ride on the
    rows; no row is read twice for them.
    """
    both = wanted.select("recording_id", "idx", "time_ms", F.lit(1).alias("asked")).join(captured.withColumn("came", F.lit(1)), ["recording_id", "idx"], "full")
    every = Window.partitionBy("recording_id")
    first = every.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = F.count("asked").over(every) != F.count("came").over(every)
    invalid = F.col("uri").isNull() | ~finite(F.col("width")) | ~finite(F.col("height"))
    other = ~F.col("width").eqNullSafe(F.first("width", True).over(first)) | ~F.col("height").eqNullSafe(F.first("height", True).over(first))
    rule = F.when(counts, "count").when(F.coalesce(invalid, F.lit(True)), "invalid").when(~F.col("requested_ms").eqNullSafe(F.col("time_ms")), "time").when(other, "size")
    return both.withColumn("rule", rule).drop("asked", "came")


def capture_faults(wanted: DataFrame, captured: DataFrame) -> DataFrame:
    """``recording_id, rule, idx, n_faults``: the first fault of each recording that has one, and how many rows break a rule."""
    broken = capture_marks(wanted, captured).where("rule is not null")
    return broken.groupBy("recording_id").agg(F.min_by("rule", "idx").alias("rule"), F.min("idx").alias("idx"), F.count("*").alias("n_faults"))


def checked_captures(wanted: DataFrame, captured: DataFrame) -> DataFrame:
    """``captured``, if every recording is sound; reading a row that breaks a rule is an error that names it."""
    name = F.concat(F.lit("recording "), F.col("recording_id").cast("string"), F.lit(", frame "), F.col("idx").cast("string"), F.lit(": "), "rule")
    marked = capture_marks(wanted, captured)
    return marked.withColumn("uri", F.when(F.col("rule").isNull(), F.col("uri")).otherwise(F.raise_error(name))).select(*captured.columns)


def report_field(text: Column, name: str) -> Column:
    """What a report's line ``name: value`` says; null without such a line or value."""
    found = F.regexp_extract(text, rf"(?m)^\Q{name}\E: (.+)$", 1)
    return F.when(found != "", found)


def retry_requests(runs: DataFrame, fallback: str = "stitch") -> DataFrame:
    """``run_id, asset, mode, engine``: runs of ``runs(run_id, engine, status, unresolved, asset, mode)`` to offer again with the other
    engine. An anchor run is offered if it warned or left samples unresolved, and if its asset and mode are known."""
    doubtful = (F.col("engine") == "anchor") & ((F.col("status") == "warning") | (F.coalesce("unresolved", F.lit(0)) > 0))
    known = (F.coalesce("asset", F.lit("")) != "") & (F.coalesce("mode", F.lit("")) != "")
    return runs.where(F.coalesce(doubtful, F.lit(False)) & known).select("run_id", "asset", "mode", F.lit(fallback).alias("engine"))
