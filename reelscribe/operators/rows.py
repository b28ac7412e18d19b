"""Visual rows, messages of one side, and plain or tagged Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BUBBLE_DX, BUBBLE_DY, OTHER, ROW_DY, SELF
from ..functions.text import is_time_label
from .dedupe import clean_lines, side_dedupe, spatial_dedupe, text_dedupe
from .folds import Columns, fold, islands


def row_texts(lines: Columns, at: str) -> Columns:
    """A line starts a row if it is a row's height or more below the row's first line; rows read from left to right."""
    first: list[int] = []
    for i, top in enumerate(lines[at]):
        if not first or top - lines[at][first[-1]] >= ROW_DY:
            first.append(i)
    cuts = list(zip(first, [*first[1:], len(lines[at])]))
    texts = [" ".join(t for _, t in sorted(zip(lines["x"][lo:hi], lines["text"][lo:hi]), key=lambda p: p[0])) for lo, hi in cuts]
    return {"row_no": list(range(len(cuts))), at: [lines[at][lo] for lo, _ in cuts], "text": texts}


def visual_rows(lines: DataFrame, at: str = "y", order: list[str | Column] | None = None) -> DataFrame:
    """``recording_id, row_no, <at>, text`` of ``lines(recording_id, text, x, <at>, ...)`` in canonical ``order``.

    A step of a row's height between lines always starts a row, so each stretch between such steps is a fold. The
    rows' order in a recording is that of (island, row_no).
    """
    order = order or ["x", "line_no"]
    cut = islands(lines, ["recording_id"], at, ROW_DY, order, inclusive=False)
    return fold(cut, ["recording_id", "island"], [at, *order], lambda rows: row_texts(rows, at), f"row_no int, {at} double, text string")


def document(rows: DataFrame, order: list[str], name: str = "markdown") -> DataFrame:
    """One text per recording: its rows' texts in order, one per line."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "text")))
    joined = rows.groupBy("recording_id").agg(listed.alias("listed"))
    return joined.select("recording_id", F.array_join(F.transform("listed", lambda r: r["text"]), "\n").alias(name))


def render_plain(lines: DataFrame) -> DataFrame:
    """The plain transcript of merged lines (see dedupe.selections); joined parts are spaced again. A recording's transcript
    is one text anyhow, so its rows are read in one fold, which is dealt nothing but what it shows."""
    shown = lines.select("recording_id", F.array_join("parts", " ").alias("text"), "x", "gy", "group_rank")
    return fold(shown, ["recording_id"], ["gy", "x", "group_rank"], lambda rows: {"markdown": ["\n".join(row_texts(rows, "gy")["text"])]}, "markdown string")


def format_plain(lines: DataFrame) -> DataFrame:
    """Spatial dedupe, rows, dedupe of repeated rows, one text per recording."""
    near = spatial_dedupe(lines)
    rows = visual_rows(near, "y", ["x", "slot"])
    return document(text_dedupe(rows, ["recording_id"], order=["island", "row_no"]), ["island", "row_no"])


def side_runs(lines: Columns) -> Columns:
    """Consecutive lines of one side merge while each is close below the last and beside the first."""
    side, x, y = lines["side"], lines["x"], lines["y"]
    first: list[int] = []
    for i in range(len(y)):
        goes_on = first and side[first[-1]] == side[i] and 0 <= y[i] - y[i - 1] < BUBBLE_DY and abs(x[i] - x[first[-1]]) < BUBBLE_DX
        if not goes_on:
            first.append(i)
    cuts = list(zip(first, [*first[1:], len(y)]))
    head = {c: [lines[c][lo] for lo, _ in cuts] for c in ("side", "x", "y")}
    return head | {"message_no": list(range(len(cuts))), "text": ["".join(lines["text"][lo:hi]) for lo, hi in cuts], "last_y": [y[hi - 1] for _, hi in cuts]}


def chat_messages(lines: DataFrame) -> DataFrame:
    """``recording_id, island, message_no, side, text, x, y, last_y`` of ``lines(recording_id, line_no, text, x, y, side)``.

    System lines and time labels go first. A step of a bubble's height always starts a message.
    """
    shown = clean_lines(lines).where((F.col("side") != "system") & ~is_time_label(F.col("text")))
    cut = islands(shown, ["recording_id"], "y", BUBBLE_DY, ["x", "line_no"], inclusive=False)
    schema = "message_no int, side string, text string, x double, y double, last_y double"
    return fold(cut, ["recording_id", "island"], ["y", "x", "line_no"], side_runs, schema)


def format_chat(lines: DataFrame) -> DataFrame:
    """Spatial dedupe, messages, dedupe per side, one tagged text per recording."""
    near = spatial_dedupe(lines).withColumn("line_no", F.col("slot"))
    messages = chat_messages(near)
    who = F.when(F.col("side") == "self", SELF).otherwise(OTHER)
    kept = side_dedupe(messages, order=["island", "message_no"])
    return document(kept.withColumn("text", F.concat(F.lit("["), who, F.lit("] "), F.col("text"))), ["island", "message_no"])
