"""Scrolled recordings derived from tables of text, and the whole anchor plan over observations.

The given tables hold no screen geometry, so it is derived with integer arithmetic that SQL can repeat: a
document's lines lie 53 pixels apart with a small jitter, frame k is scrolled by 131 k, and a line shows while it
is inside a view of 420 pixels below a fixed header. Pitch and scroll are incommensurate on purpose: evenly
matched ones put lines into the same bands in all frames, and bands are all that the fixed-band rule looks at.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_KEY_LENGTH
from ..functions.text import normalized
from ..operators import anchors, bands, dedupe, placement
from ..operators.folds import dealt
from ..operators.pixels import per_row
from ..operators.rows import render_plain
from .storage import kept_by

PITCH, SCROLL, VIEW, HEADER_Y, CONTENT_Y, TOP_SLACK = 53, 131, 420, 100, 160, 390
#: Images of the recordings: a view of a patterned page that starts at row 100.
IMAGE_WIDTH, IMAGE_HEIGHT, PAGE_START = 4, 480, 100
#: Grey preview images: their height, where what scrolls begins and ends, and where a quiet stretch in it begins.
PREVIEW_HEIGHT, MOVES, RESTS, QUIET = 200, 24, 188, 70
LINE_ARRAY = "array<struct<line_no: int, text: string, top: bigint>>"


def line_top(i: Column, recording: Column) -> Column:
    """Where a recording's line ``i`` lies on its canvas."""
    return PITCH * i + F.pmod(17 * i * i + 5 * recording, F.lit(29))


def frames_to(top: Column) -> Column:
    """How many frames it takes to see a line at ``top``, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil((top - TOP_SLACK) / F.lit(float(SCROLL))) + 1)


def document_lines(documents: DataFrame) -> DataFrame:
    """``recording_id, line_no, text, top``: a document's lines on its canvas."""
    line = F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    lines = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("recording_id"), line)
    return lines.withColumn("top", line_top(F.col("line_no").cast("long"), F.col("recording_id")))


def scroll_frames(lines: DataFrame) -> DataFrame:
    """``recording_id, n_frames, frame_idx``: as many frames as it takes to see the last line, one at least."""
    counted = lines.groupBy("recording_id").agg(frames_to(F.max("top")).alias("n_frames"))
    return counted.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), (F.col("n_frames") - 1).cast("int"))))


def scroll_observations(documents: DataFrame, misread: bool = False) -> DataFrame:
    """Observations of the scrolled documents: ``recording_id, frame_idx, line_no, text, x, y, w, h``.

    A line's frames follow from its height, so frames are generated per line and no line meets a frame that it isn't
    in. With ``misread`` a recogniser's slip replaces the third character of some sightings. Documents are dealt by their
    numbers once and lines come out of them where they lie, so that what is keyed by recording shuffles no text again.
    """
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("recording_id"), "text")
    docs = dealt(docs, "recording_id").withColumn("parts", F.split("text", "\n"))
    tops = F.transform("parts", lambda _, i: line_top(i.cast("long"), F.col("recording_id")))
    # Documents of one number are one recording with one header.
    every = Window.partitionBy("recording_id")
    docs = docs.select("recording_id", "parts", F.array_max(tops).alias("reach"))
    docs = docs.withColumn("n_frames", frames_to(F.max("reach").over(every))).withColumn("nth", F.row_number().over(every.orderBy("reach")))
    head = F.struct(F.lit(-1).alias("line_no"), F.lit("Fixed header").alias("text"), F.lit(0).cast("long").alias("top"))
    rest = F.transform("parts", lambda t, i: F.struct(i.cast("int").alias("line_no"), t.alias("text"), line_top(i.cast("long"), F.col("recording_id")).alias("top")))
    lines = docs.select("recording_id", "n_frames", F.explode(F.concat(F.when(F.col("nth") == 1, F.array(head)).otherwise(F.array().cast(LINE_ARRAY)), rest)).alias("line"))
    lines = lines.select("recording_id", "n_frames", "line.*")
    header = F.col("line_no") < 0
    low = F.when(header, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.floor((F.col("top") - VIEW) / F.lit(float(SCROLL))) + 1))
    last = F.col("n_frames") - 1
    high = F.when(header, last).otherwise(F.least(last, F.floor(F.col("top") / F.lit(float(SCROLL)))))
    seen = lines.withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).where("low <= high").withColumn("frame_idx", F.explode(F.sequence("low", "high")))
    text = F.col("text")
    if misread:
        slip = (F.col("line_no") >= 0) & (F.pmod(F.col("line_no") + F.col("frame_idx"), F.lit(7)) == 0) & (F.char_length("text") >= 12)
        text = F.when(slip, F.concat(F.substring("text", 1, 2), F.lit("~"), F.expr("substring(text, 4)"))).otherwise(text)
    y = F.when(header, F.lit(float(HEADER_Y))).otherwise((CONTENT_Y + F.col("top") - SCROLL * F.col("frame_idx")).cast("double"))
    return seen.select("recording_id", "frame_idx", "line_no", text.alias("text"), y.alias("y")).select(
        "recording_id", "frame_idx", "line_no", "text", F.lit(134.0).alias("x"), "y",
        F.least(20 * F.char_length("text"), F.lit(451)).cast("double").alias("w"), F.lit(28.0).alias("h"),
    )


def scroll_positions(documents: DataFrame) -> DataFrame:
    """``recording_id, frame_idx, position``: the page row at which each frame's view starts. It moves by -20 to 96 rows
    a frame, in steps of four, and at most one step in three goes back."""
    frames = scroll_frames(document_lines(documents)).select("recording_id", "frame_idx")
    step = F.when(F.col("frame_idx") == 0, PAGE_START).otherwise(4 * (F.pmod(7 * F.col("recording_id") + 20 * F.col("frame_idx"), F.lit(30)) - 5))
    so_far = Window.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("position", F.sum(step).over(so_far))


def page(recording: int, rows: np.ndarray, width: int) -> np.ndarray:
    """A pattern that no scroll within a view maps to itself."""
    return (7 * rows * rows + 31 * rows + 13 * recording)[:, None] % 251 + np.arange(width)


def view_pixels(recording: int, frame: int, position: int) -> tuple[bytes, int, int]:
    """RGBA pixels of a view; one frame in three has a striped pop-up over it."""
    y = np.arange(IMAGE_HEIGHT)
    v = page(recording, y + position, IMAGE_WIDTH)
    if frame % 3 == 1:
        v[y % 28 == 12] = 17 * np.arange(IMAGE_WIDTH) + 5 * frame % 200
    rgba = np.stack([v, 3 * v, 5 * v + 7, np.full_like(v, 255)], -1) % 256
    return rgba.astype(np.uint8).tobytes(), IMAGE_WIDTH, IMAGE_HEIGHT


def preview_pixels(recording: int, position: int) -> tuple[bytes, int, int]:
    """Grey pixels of a preview: what scrolls between a still head and foot, around a quiet stretch."""
    y = np.arange(PREVIEW_HEIGHT)
    still = (y < MOVES) | (y >= RESTS) | ((y >= QUIET) & (y < QUIET + recording % 60))
    v = np.where(still[:, None], page(recording, y, IMAGE_WIDTH), page(recording, y + position, IMAGE_WIDTH))
    return v.astype(np.uint8).tobytes(), IMAGE_WIDTH, PREVIEW_HEIGHT


IMAGE = "data binary, width int, height int"
#: Full screens: their size, where what scrolls begins and ends, and how far a page jump goes.
SCREEN_WIDTH, SCREEN_HEIGHT, SCREEN_TOP, SCREEN_BOTTOM, JUMP = 8, 1040, 40, 1000, 2400


def screen_positions(documents: DataFrame) -> DataFrame:
    """``recording_id, frame_idx, position``: a frame for every two lines. It moves by -120 to 576 rows a frame, in steps of 24;
    now and then a third of the recordings jump to where nothing of the frame before shows."""
    counted = document_lines(documents).groupBy("recording_id").agg(F.count("*").alias("n"))
    frames = counted.select("recording_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int"))).alias("frame_idx"))
    step = 24 * (F.pmod(7 * F.col("recording_id") + 20 * F.col("frame_idx"), F.lit(30)) - 5)
    leaps = (F.pmod("recording_id", F.lit(3)) == 0) & (F.pmod("frame_idx", F.lit(7)) == 5)
    moved = F.when(F.col("frame_idx") == 0, 400).when(leaps, JUMP).otherwise(step)
    so_far = Window.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("position", F.sum(moved).over(so_far))


def screen_page(recording: int, rows: np.ndarray) -> np.ndarray:
    """A pattern whose stretches of 251 rows differ, so that no scroll maps it to itself."""
    return ((7 + rows // 251) * rows * rows + 31 * rows + 13 * recording)[:, None] % 251 + np.arange(SCREEN_WIDTH)


def screen_pixels(recording: int, position: int) -> tuple[bytes, int, int]:
    """RGBA pixels of a screen: what scrolls between a still head and foot."""
    y = np.arange(SCREEN_HEIGHT)
    v = screen_page(recording, np.where((y < SCREEN_TOP) | (y >= SCREEN_BOTTOM), y, y + position))
    rgba = np.stack([v, 3 * v, 5 * v + 7, np.full_like(v, 255)], -1) % 256
    return rgba.astype(np.uint8).tobytes(), SCREEN_WIDTH, SCREEN_HEIGHT


def screen_data(recording: int, position: int) -> bytes:
    return screen_pixels(recording, position)[0]


def screen_sources(documents: DataFrame) -> DataFrame:
    """``recording_id, frame_idx, position, octets, width, height``: what ``screen_data`` makes the full screens from, and their sizes."""
    sizes = {"octets": 4 * SCREEN_WIDTH * SCREEN_HEIGHT, "width": SCREEN_WIDTH, "height": SCREEN_HEIGHT}
    return screen_positions(documents).withColumns({name: F.lit(size) for name, size in sizes.items()})


def screens(documents: DataFrame) -> DataFrame:
    """``recording_id, frame_idx, data, width, height``: full screens of the scrolled documents."""
    made = per_row(screen_pixels, IMAGE, "recording_id", "position")
    return screen_positions(documents).select("recording_id", "frame_idx", made.alias("image")).select("recording_id", "frame_idx", "image.*")



def scroll_images(documents: DataFrame) -> DataFrame:
    """``recording_id, frame_idx, data, width, height``: RGBA views of the scrolled documents."""
    made = per_row(view_pixels, IMAGE, "recording_id", "frame_idx", "position")
    return scroll_positions(documents).select("recording_id", "frame_idx", made.alias("image")).select("recording_id", "frame_idx", "image.*")


def preview_images(documents: DataFrame) -> DataFrame:
    """``recording_id, frame_idx, data, width, height``: grey previews of the scrolled documents."""
    made = per_row(preview_pixels, IMAGE, "recording_id", "position")
    return scroll_positions(documents).select("recording_id", "frame_idx", made.alias("image")).select("recording_id", "frame_idx", "image.*")


MARKS = ["recording_id", "frame_idx", "line_no", "y", "n_norm", "key_no"]


def numbered(observations: DataFrame) -> DataFrame:
    """With ``n_norm``, the length of the text that is compared, and ``key_no``, its number: equal texts of a recording have the same."""
    norm = observations.withColumn("norm", normalized(F.col("text")))
    found = norm.withColumn("key_no", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("norm")))
    return found.withColumn("n_norm", F.char_length("norm")).drop("norm")


class Analysis:
    """The stages of the anchor plan, keyed by recording, from ``observations(recording_id, frame_idx, line_no, text, x,
    y, w, h)`` and ``frames(recording_id, frame_idx)``.

    Nothing is computed before it is asked for. Stages that several later ones read are written once to the shared
    folder when they are first asked for, which also keeps the plans small. All of these lie in buckets of recordings, so that what
    follows groups and joins them where they are. A recording's texts are numbered once, and only numbers go on: texts are
    looked up for the few pairs that may be alike, and stay with the observations that are merged. A recording of one
    frame has no pairs; its lines stay where they are.
    """

    def __init__(self, observations: DataFrame, frames: DataFrame, fuzzy: bool = True):
        self.given, self.given_frames, self.with_fuzzy = observations, frames, fuzzy

    @cached_property
    def observations(self) -> DataFrame:
        """In buckets of recordings, with the columns of ``numbered``."""
        return kept_by(numbered(self.given), "observations", "recording_id", "zstd")

    @cached_property
    def marks(self) -> DataFrame:
        """Observations without their texts."""
        if self.with_fuzzy:
            return self.observations.select(*MARKS)
        return kept_by(numbered(self.given).select(*MARKS), "marks", "recording_id")

    @cached_property
    def frames(self) -> DataFrame:
        return kept_by(self.given_frames, "frames", "recording_id")

    @cached_property
    def fixed(self) -> DataFrame:
        return kept_by(bands.fixed_bands(self.marks, self.frames), "fixed_bands", "recording_id")

    @cached_property
    def lines(self) -> DataFrame:
        return kept_by(anchors.anchor_lines(self.marks, self.fixed), "anchor_lines", "recording_id")

    @cached_property
    def exact(self) -> DataFrame:
        return kept_by(anchors.exact_anchors(self.lines), "exact_anchors", "recording_id")

    @cached_property
    def fuzzy(self) -> DataFrame:
        if not self.with_fuzzy:
            return self.exact.where("false")
        keys = self.observations.where(F.col("n_norm") >= MIN_KEY_LENGTH).groupBy("recording_id", F.col("key_no").alias("key")).agg(F.first("text").alias("text"))
        texts = keys.select("recording_id", "key", normalized(F.col("text")).alias("norm"))
        return kept_by(anchors.fuzzy_anchors(self.lines, self.exact, texts=texts), "fuzzy_anchors", "recording_id")

    @cached_property
    def shifts(self) -> DataFrame:
        return anchors.shifts(self.frames, self.exact, self.fuzzy)

    @cached_property
    def kept_shifts(self) -> DataFrame:
        return kept_by(self.shifts, "shifts", "recording_id")

    @cached_property
    def placed(self) -> DataFrame:
        return placement.placed_lines(self.observations, self.kept_shifts)

    @cached_property
    def content(self) -> DataFrame:
        return kept_by(bands.content_lines(self.placed, self.fixed), "content", "recording_id", "zstd")

    @cached_property
    def content_marks(self) -> DataFrame:
        """``content`` without texts and boxes."""
        return bands.content_lines(placement.placed_lines(self.marks, self.kept_shifts), self.fixed)

    @cached_property
    def warnings(self) -> DataFrame:
        return placement.anchor_warnings(self.kept_shifts)


def analyse(observations: DataFrame, frames: DataFrame, fuzzy: bool = True) -> Analysis:
    return Analysis(observations, frames, fuzzy)


def plain_transcripts(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """``recording_id, markdown`` of recordings in plain mode."""
    return render_plain(dedupe.selections(analyse(observations, frames).content))


def run_stats(found: Analysis, chosen: DataFrame) -> DataFrame:
    """Counts of a run per recording, from all its stages."""
    key = "recording_id"
    frames = found.frames.groupBy(key).agg(F.countDistinct("frame_idx").alias("frame_count"))
    fixed = found.fixed.groupBy(key).agg(F.count("*").alias("fixed_band_count"))
    pairs = found.kept_shifts.groupBy(key).agg(F.count("*").alias("anchor_pairs"), F.sum("shift").alias("cumulative_shift"))
    warned = found.warnings.groupBy(key).agg(F.count("*").alias("warnings"))
    seen = found.marks.groupBy(key).agg(F.count("*").alias("ocr_lines"))
    content = found.content_marks.groupBy(key).agg(F.count("*").alias("content_lines"))
    merged = dedupe.dedupe_stats(chosen, F.count("*").alias("unique_lines"))
    out = frames
    for part in (fixed, pairs, warned, seen, content, merged):
        out = out.join(part, key, "left")
    out = out.fillna(0).withColumn("anchor_passed", F.col("anchor_pairs") - F.col("warnings"))
    return out.withColumn("status", F.when(F.col("warnings") > 0, "warning").otherwise("ok"))
