"""Merging repeated sightings of a line by geometry and agreement, and dropping repeated text."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DEDUPE_WINDOW, MAJORITY, REPEAT_LENGTH, REPEAT_WINDOW, SAME_BOX_OVERLAP, SPATIAL_DX, SPATIAL_DY, VARIANT_SIMILARITY,
)
from ..functions.geometry import finite
from ..functions.text import edit_distance, norm_length, normalized, trimmed, utf16_length
from .folds import Columns, dealt, fold, islands, keep_rows

CANON = ["gy", "x", "frame_idx", "line_no"]


def sightings(lines: Columns) -> Columns:
    """Groups of an island's sorted lines. A line joins the newest group whose longest line lies near it in another
    frame and shares most of its box; a strictly longer line becomes the group's longest.

    A group is known by its longest line, so the groups are an array of line numbers. Lines come from the top: groups
    whose longest line has fallen out of the window never match again, and the search starts behind the leading ones.
    """
    gy, x, w, h = (np.array(lines[c], float) for c in ("gy", "x", "w", "h"))
    frame, size = np.array(lines["frame_idx"]), np.fromiter(map(len, lines["text"]), int, len(gy))
    longest, of, count, low = np.zeros(len(gy), int), np.zeros(len(gy), int), 0, 0
    for i in range(len(gy)):
        while low < count and gy[longest[low]] < gy[i] - DEDUPE_WINDOW:
            low += 1
        top = longest[low:count]
        wide = np.minimum(x[top] + w[top], x[i] + w[i]) - np.maximum(x[top], x[i])
        high = np.minimum(gy[top] + h[top], gy[i] + h[i]) - np.maximum(gy[top], gy[i])
        least = np.minimum(w[top] * h[top], w[i] * h[i])
        share = np.divide(np.maximum(wide, 0) * np.maximum(high, 0), least, out=np.zeros(len(top)), where=least > 0)
        near = np.flatnonzero((share >= SAME_BOX_OVERLAP) & (np.abs(gy[top] - gy[i]) <= DEDUPE_WINDOW) & (frame[top] != frame[i]))
        of[i] = low + near[-1] if len(near) else count
        if not len(near):
            longest[count] = i
            count += 1
        elif size[i] > size[longest[of[i]]]:
            longest[of[i]] = i
    place = np.argsort(of, kind="stable")
    sighting = np.empty(len(of), int)
    sighting[place] = np.arange(len(of)) - np.searchsorted(of[place], of[place])
    return lines | {"group_no": of.tolist(), "is_longest": (longest[of] == np.arange(len(of))).tolist(), "sighting": sighting.tolist()}


SIGHTING = (
    "group_no int, sighting int, is_longest boolean, frame_idx int, line_no int, text string, "
    "x double, y double, w double, h double, gy double"
)


def sighting_groups(content: DataFrame) -> DataFrame:
    """Every content line with its group: ``recording_id, segment_id, island, group_no`` name it.

    ``content(recording_id, segment_id, frame_idx, line_no, text, x, y, w, h, gy)``. Only lines of one segment can
    merge, and none over a stretch of more than the window without lines, so each such island is folded alone.
    Lines without a text to compare are left out; a null recording is one of its own. Islands gather their lines,
    so the fold deals nothing again.
    """
    keyed = content.where(norm_length(content) > 0).select("recording_id", "segment_id", "frame_idx", "line_no", "text", "x", "y", "w", "h", "gy")
    cut = islands(keyed, ["recording_id", "segment_id"], "gy", DEDUPE_WINDOW, ["x", "frame_idx", "line_no"], inclusive=True)
    return fold(cut, ["recording_id", "segment_id", "island"], CANON, sightings, SIGHTING, gathered=True)


GROUP = ["recording_id", "segment_id", "island", "group_no"]


def frame_observations(groups: DataFrame) -> DataFrame:
    """One row per group and frame: parts of one frame become their joint box and their texts from left to right.

    ``longest`` is the group's longest line if it is in the frame, ``head`` its first line's place likewise.
    """
    parts = F.array_sort(F.collect_list(F.struct("x", "sighting", "text")))
    bottom = F.greatest(F.max(F.col("y") + F.col("h")) - F.min("y"), F.max(F.col("gy") + F.col("h")) - F.min("gy"))
    alone = F.struct("frame_idx", F.lit(1).cast("long").alias("n_parts"), "text", "x", "y", "w", "h", "gy")
    joined = groups.groupBy(*GROUP, "frame_idx").agg(
        parts.alias("parts"),
        F.count("*").alias("n_parts"),
        F.min("x").alias("x"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"),
        F.min("y").alias("y"),
        F.min("gy").alias("gy"),
        F.when(F.count("*") == 1, F.max("h")).otherwise(bottom).alias("h"),
        F.max(F.when(F.col("is_longest"), alone)).alias("longest"),
        F.max(F.when(F.col("sighting") == 0, F.struct(*CANON))).alias("head"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return joined.withColumn("text", text).withColumn("parts", F.transform("parts", lambda p: p["text"])).withColumn("norm", normalized(F.col("text")))


def selections(content: DataFrame, consensus: bool = True, similarity: float = VARIANT_SIMILARITY) -> DataFrame:
    """One row per group: the line that stands for it, how it was chosen, and what there was to choose from.

    With three frames or more, the text of more than half of them (three at least) is proposed, in its earliest
    frame and rather whole than joined from parts. It is refused if it is unlike the longest sighting. Groups are
    dealt once; frames, variants and choice are aggregates of that one partitioning.
    """
    if not 0 <= similarity <= 1:
        raise ValueError("similarity must be between 0 and 1")
    frames = frame_observations(dealt(sighting_groups(content), *GROUP))
    seen = F.struct("frame_idx", "n_parts", "text", "norm", "x", "y", "w", "h", "gy", "parts")
    variants = frames.groupBy(*GROUP, "norm").agg(
        F.count("*").alias("n"),
        F.min("frame_idx").alias("first_frame"),
        F.min_by(seen, F.struct(F.col("n_parts") > 1, "frame_idx")).alias("proposed"),
        F.count_if(F.col("n_parts") > 1).alias("n_composed"),
        F.sum("n_parts").alias("n_sightings"),
        F.max("longest").alias("longest"),
        F.max("head").alias("head"),
    )
    joined = variants.groupBy(*GROUP).agg(
        F.max_by(F.struct("n", "proposed"), F.struct("n", -F.col("first_frame"))).alias("best"),
        F.sum("n").alias("n_frames"),
        F.sum("n_composed").alias("n_composed"),
        F.sum("n_sightings").alias("n_sightings"),
        F.max("longest").alias("longest"),
        F.max("head").alias("group_rank"),
    )
    alone = F.struct("longest.frame_idx", "longest.n_parts", "longest.text", normalized(F.col("longest.text")).alias("norm"), *(f"longest.{c}" for c in ("x", "y", "w", "h", "gy")), F.array("longest.text").alias("parts"))
    joined = joined.withColumn("longest", alone)
    norm, other = F.col("best.proposed.norm"), F.col("longest.norm")
    eligible = F.lit(consensus) & (F.col("n_frames") >= MAJORITY)
    majority = eligible & (F.col("best.n") >= MAJORITY) & (F.col("best.n") * 2 > F.col("n_frames"))
    joined = joined.withColumn("majority", majority).withColumn("one", F.when(F.col("majority"), norm)).withColumn("two", F.when(F.col("majority"), other))
    joined = edit_distance(joined, "one", "two", "far")
    alike = 1 - F.col("far") / F.greatest(F.char_length(norm), F.char_length(other))
    kind = (
        F.when(~F.col("majority"), "longer-fallback").when((norm != other) & (alike < similarity), "unrelated-majority-rejected").otherwise("strict-majority")
    )
    chosen = joined.withColumn("kind", kind).withColumn("line", F.when(F.col("kind") == "strict-majority", F.col("best.proposed")).otherwise(F.col("longest")))
    return chosen.select(
        *GROUP,
        "group_rank",
        "kind",
        "line.*",
        "n_sightings",
        "n_frames",
        "n_composed",
        F.col("longest.text").alias("longer_text"),
        F.when(F.col("majority"), F.col("best.proposed.text")).alias("proposed_text"),
        alike.alias("variant_similarity"),
        F.col("far").alias("variant_edit_distance"),
    )


def dedupe_stats(chosen: DataFrame, *more: Column) -> DataFrame:
    """Counters of ``selections`` per recording, after ``more`` aggregates of the same pass."""
    strict = F.col("kind") == "strict-majority"
    return chosen.groupBy("recording_id").agg(
        *more,
        F.count_if(F.col("n_sightings") > 1).alias("candidate_groups"),
        F.sum("n_sightings").alias("observations"),
        F.sum("n_frames").alias("frame_observations"),
        F.count_if(F.col("n_composed") > 0).alias("composed_clusters"),
        F.count_if(F.col("n_frames") >= MAJORITY).alias("majority_eligible"),
        F.count_if(strict).alias("majority_chosen"),
        F.count_if(F.col("kind") == "unrelated-majority-rejected").alias("majority_rejected"),
        F.count_if(strict & (F.col("text") != F.col("longer_text"))).alias("changed"),
        F.count_if(strict & (normalized(F.col("text")) != normalized(F.col("longer_text")))).alias("normalized_changed"),
        F.count_if(~strict & (F.col("n_sightings") > 1)).alias("longer_fallback"),
    )


def clean_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines with text and finite x and y."""
    x, y = F.expr("try_cast(x as double)"), F.expr("try_cast(y as double)")
    return lines.withColumn("text", trimmed(F.col("text"))).withColumn("x", x).withColumn("y", y).where((F.char_length("text") > 0) & finite(F.col("x")) & finite(F.col("y")))


def nearest_kept(lines: Columns) -> Columns:
    """Slots are lines that lay near no slot; a slot shows the longest of the lines that first came near it."""
    x, y, size = lines["x"], lines["y"], [len(t) for t in lines["text"]]
    slots: list[list[int]] = []  # the line that opened it and the one that it shows
    for i in range(len(y)):
        near = (s for s in slots if abs(y[s[1]] - y[i]) < SPATIAL_DY and abs(x[s[1]] - x[i]) < SPATIAL_DX)
        slot = next(near, None)
        if slot is None:
            slots.append([i, i])
        elif size[i] > size[slot[1]]:
            slot[1] = i
    shown = {c: [lines[c][at] for _, at in slots] for c in ("line_no", "text", "x", "y", "side")}
    return shown | {"slot": [lines["line_no"][first] for first, _ in slots]}


def spatial_dedupe(lines: DataFrame) -> DataFrame:
    """Of lines within a small box of each other the longer stays, in the first one's slot.

    ``lines(recording_id, line_no, text, x, y, side)``; a vertical step as large as the box starts a new island.
    Null and blank texts and coordinates that are no numbers are left out; a null recording is one of its own.
    """
    cut = islands(clean_lines(lines), ["recording_id"], "y", SPATIAL_DY, ["x", "line_no"], inclusive=False)
    schema = "line_no int, text string, x double, y double, side string, slot int"
    return fold(cut, ["recording_id", "island"], ["y", "x", "line_no"], nearest_kept, schema).drop("island")


def repeat_test(least: int, window: int) -> Callable[[], Callable[[str, int], bool]]:
    """Tests lines in order against the last ``window`` kept ones, which are all that it holds."""

    def begin() -> Callable[[str, int], bool]:
        recent: deque[str] = deque()
        times: Counter = Counter()

        def keep(text: str, units: int) -> bool:
            if units >= least and times[text]:
                return False
            recent.append(text)
            times[text] += 1
            if len(recent) > window:
                gone = recent.popleft()
                times[gone] -= 1
                if not times[gone]:
                    del times[gone]
            return True

        return keep

    return begin


def text_dedupe(lines: DataFrame, keys: list[str], least: int = REPEAT_LENGTH, window: int = REPEAT_WINDOW, order: list[str] | None = None) -> DataFrame:
    """Drops a line of ``least`` UTF-16 units or more whose trimmed text is among the last ``window`` kept ones.

    ``lines(*keys, *order, text)``, order ``line_no`` unless given. What is kept decides what goes, so a key's lines are
    streamed in order, and only the window is held. Null texts are left out.
    """
    order = order or ["line_no"]
    ready = lines.where("text is not null").select(*keys, *order, "text", trimmed(F.col("text")).alias("trimmed"))
    ready = ready.withColumn("units", utf16_length(F.col("trimmed")))
    return keep_rows(ready, keys, order, ["trimmed", "units"], repeat_test(least, window)).select(*keys, *order, "text")


def side_dedupe(messages: DataFrame, window: int = REPEAT_WINDOW, order: list[str] | None = None) -> DataFrame:
    """``text_dedupe`` of ``messages(recording_id, *order, side, text)`` in one stream per recording; a side's letter
    leads each text, so two sides never share one, and the least length counts it."""
    order = order or ["line_no"]
    letter = F.when(F.col("side") == "self", "M").otherwise("T")
    coded = messages.select("recording_id", *order, F.concat(letter, "text").alias("text"))
    kept = text_dedupe(coded, ["recording_id"], REPEAT_LENGTH + 1, window, order)
    side = F.when(F.col("text").startswith("M"), "self").otherwise("other")
    return kept.select("recording_id", *order, side.alias("side"), F.expr("substring(text, 2)").alias("text"))
