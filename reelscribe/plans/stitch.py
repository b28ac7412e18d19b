"""The stitch plan: from the frames of recordings to one long image each, in stages of which only the small ones are written.

Frames stay where they are; stages hand each other their keys ``(recording_id, frame_idx)`` and only what the next one looks at:
every fourth column of a few preview frames to find what scrolls, one pixel in sixteen of each frame to find the
scroll between neighbours, the grey rows of key frames to place them. The long image is written in bands, one per placed
frame, so no task holds a recording: the largest group is that of the preview frames, whose number is fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import pixels
from ..operators.folds import Columns, fold, scan_rows
from .storage import kept

KEY = ["recording_id", "frame_idx"]
#: Frames that are compared one after another in one task.
STRETCH = 256


class StitchPlan:
    """Stages over ``frames(recording_id, frame_idx, data, width, height)``, RGBA pixels numbered from 0 without gaps.

    ``pre_scan`` frames, evenly spaced, tell which rows scroll. A recording of frames of several sizes, or of pixels that
    don't fill their size, is ``mixed_sizes``; one with frames missing or repeated ``gaps``; one in which less than 3/10 of the
    height scrolls, one of a single frame among them, ``no_region``. None of these is stitched, and none stops the others.

    Frames needn't carry their pixels: with ``load``, a function of the columns ``source``, they have ``octets`` instead of ``data``,
    and each stage has a frame's pixels only in the task that looks at them, so that none are written or shuffled.
    """

    def __init__(self, frames: DataFrame, pre_scan: int = 24, overlap: float = 0.6, load: Callable[..., bytes] | None = None, source: Sequence[str] = ()):
        self.frames, self.pre_scan, self.overlap, self.load, self.source = frames, pre_scan, overlap, load, list(source)

    @cached_property
    def sizes(self) -> DataFrame:
        """``recording_id, n_frames, width, height, fault``: the guards, aggregates of one pass that reads no pixels but their number."""
        octets = F.octet_length("data") if self.load is None else F.col("octets")
        area = octets != 4 * F.col("width") * F.col("height")
        found = self.frames.groupBy("recording_id").agg(
            F.count("*").alias("n_frames"), F.min("width").alias("width"), F.min("height").alias("height"),
            (F.min("width") < F.max("width")).alias("wide"), (F.min("height") < F.max("height")).alias("high"), F.bool_or(F.coalesce(area, F.lit(True))).alias("odd"),
            (F.coalesce((F.min("frame_idx") != 0) | (F.max("frame_idx") + 1 != F.count("*")) | (F.count_distinct("frame_idx") != F.count("*")), F.lit(True))).alias("gaps"),
        )
        mixed = F.coalesce(F.col("wide") | F.col("high") | F.col("odd"), F.lit(True))
        return found.select("recording_id", "n_frames", "width", "height", F.when(mixed, "mixed_sizes").when(F.col("gaps"), "gaps").alias("fault"))

    def lens(self, frames: DataFrame, look: Callable[..., np.ndarray], *more: str) -> tuple[DataFrame, list[str], Callable[..., np.ndarray]]:
        """What a stage sees of each frame, ``look(image, *more)``: rows, the columns to hand on, and a function from their values to it.

        Pixels that come with the frames are looked at before the rows are dealt; those that ``load`` gives, after it.
        """
        load, n = self.load, len(self.source)
        if load is not None:
            return frames, [*self.source, "width", "height", *more], lambda *row: look(pixels.rgba(load(*row[:n]), *row[n : n + 2]), *row[n + 2 :])

        def run(data: bytes, width: int, height: int, *rest):
            found = look(pixels.rgba(data, width, height), *rest)
            return found.tobytes(), found.shape[1]

        made, rest = pixels.per_row(run, "seen binary, columns int", "data", "width", "height", *more), [c for c in frames.columns if c != "data"]
        seen = frames.select(*rest, made.alias("s")).select(*rest, "s.*")
        return seen, ["seen", "columns"], lambda seen, columns: np.frombuffer(seen, np.uint8).reshape(-1, columns)

    @cached_property
    def regions(self) -> DataFrame:
        """``recording_id, top, bottom, ok``: the rows that scroll, of recordings without a fault."""
        last = F.col("n_frames") - 1
        at = F.transform(F.sequence(F.lit(0), F.lit(self.pre_scan - 1)), lambda i: F.floor(i * last / (self.pre_scan - 1) + 0.5).cast("int"))
        picks = self.sizes.where("fault is null").select("recording_id", F.explode(at).alias("frame_idx")).groupBy(*KEY).agg(F.count("*").cast("int").alias("times"))
        shown, columns, view = self.lens(self.frames.join(picks, KEY), lambda image: pixels.grey(image[:, ::4]))

        def run(rows: Columns) -> Columns:
            greys = [x for row, n in zip(zip(*(rows[c] for c in columns)), rows["times"]) for x in [view(*row)] * n]
            found = pixels.scroll_region_of(pixels.spread_of(np.stack(greys)))
            return {name: [found[name]] for name in ("top", "bottom", "ok")}

        return kept(fold(shown.select(*dict.fromkeys([*KEY, "times", *columns])), ["recording_id"], ["frame_idx"], run, "top int, bottom int, ok boolean"), "regions")

    @cached_property
    def views(self) -> DataFrame:
        """``recording_id, top, bottom`` of what can be stitched."""
        return self.regions.where("ok").select("recording_id", "top", "bottom")

    @cached_property
    def shifts(self) -> DataFrame:
        """``recording_id, pair_idx, dy, conf`` between neighbours. Stretches of a recording stream by, each led in by the frame before
        it; what is held is the last frame's coarse image."""
        k = F.col("frame_idx")
        own = F.floor(k / STRETCH)
        stretch = F.explode(F.when(F.pmod(k, F.lit(STRETCH)) == STRETCH - 1, F.array(own, own + 1)).otherwise(F.array(own)))
        shown, columns, view = self.lens(self.frames.join(self.views, "recording_id"), lambda image, top, bottom: pixels.coarse(image[top:bottom]), "top", "bottom")

        def begin():
            last: list[np.ndarray] = []

            def step(*row) -> tuple[int | None, float | None]:
                image = view(*row)
                found = pixels.coarse_shift(last[0], image) if last else (None, None)
                last[:] = [image]
                return found

            return step

        moved = scan_rows(shown.withColumn("stretch", stretch), ["recording_id", "stretch"], ["frame_idx"], columns, begin, "dy int, conf double")
        return moved.where("dy is not null").select("recording_id", F.col("frame_idx").alias("pair_idx"), "dy", "conf")

    @cached_property
    def keys(self) -> DataFrame:
        """``recording_id, keep, dropped, too_far``: the frames to place; one fold of integers a recording."""
        steps = self.shifts.select("recording_id", "pair_idx", "dy").join(self.views.select("recording_id", (F.col("bottom") - F.col("top")).alias("view")), "recording_id")

        overlap = self.overlap

        def run(rows: Columns) -> Columns:
            keep, dropped, wide = pixels.key_frames_of(rows["dy"], rows["view"][0], overlap)
            return {"keep": [keep], "dropped": [dropped], "too_far": [wide]}

        return kept(fold(steps, ["recording_id"], ["pair_idx"], run, "keep array<int>, dropped int, too_far int"), "keys")

    @cached_property
    def placed(self) -> DataFrame:
        """``recording_id, frame_idx, offset, move, sure``: each key frame's row on the long image; one that shows nothing new
        has move 0 and no place of its own. A recording streams by; what is held of it is the last frame placed."""
        keep = self.keys.select("recording_id", F.explode("keep").alias("frame_idx"))
        rows, columns, view = self.lens(self.frames.join(keep, KEY).join(self.views, "recording_id"), lambda image, top, bottom: pixels.grey(image[top:bottom]), "top", "bottom")

        def begin():
            last: list[np.ndarray] = []

            def step(*row) -> tuple[int, bool]:
                image = view(*row)
                move, sure = pixels.advance(last[0], image) if last else (0, True)
                if move or not last:
                    last[:] = [image]
                return move, sure

            return step

        moved = scan_rows(rows, ["recording_id"], ["frame_idx"], columns, begin, "move int, sure boolean")
        so_far = Window.partitionBy("recording_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
        return moved.withColumn("offset", F.sum("move").over(so_far)).select(*KEY, "offset", "move", "sure")

    def bands(self, placed: DataFrame) -> DataFrame:
        """``recording_id, frame_idx, offset, width, rows, data``: the long image as RGBA bands in order of offset. A frame shows
        down to the next one's first row, which covers it."""
        cut = self.cuts(placed)
        part, load, n = F.expr("substring(data, 4 * width * top + 1, 4 * width * rows)"), self.load, len(self.source)
        if load is not None:
            part = pixels.per_row(lambda *row: (slice_of(load(*row[:n]), *row[n:]),), "data binary", *self.source, "width", "top", "rows")["data"]
        return cut.select(*KEY, "offset", "width", "rows", part.alias("data"))

    def checksums(self, placed: DataFrame) -> DataFrame:
        """``band_sums`` of the bands. Pixels that ``load`` gives are summed as soon as they are there, one frame at a time."""
        load, n = self.load, len(self.source)
        if load is None:
            return band_sums(self.bands(placed))
        each = pixels.per_row(lambda *row: (band_sum(slice_of(load(*row[:n]), *row[n : n + 3]), row[n], row[n + 2], row[n + 3]),), "s bigint", *self.source, "width", "top", "rows", "offset")
        return self.cuts(placed).select("recording_id", each.alias("b")).groupBy("recording_id").agg(F.sum("b.s").alias("checksum"))

    def cuts(self, placed: DataFrame) -> DataFrame:
        """Frames that show on the long image, with ``offset, top, rows``."""
        shown = placed.where("move > 0 or frame_idx = 0")
        below = F.lead("offset").over(Window.partitionBy("recording_id").orderBy("offset"))
        shown = shown.select(*KEY, "offset", below.alias("below")).join(self.views, "recording_id")
        size = F.coalesce(F.least(F.col("below") - F.col("offset"), F.col("bottom") - F.col("top")), F.col("bottom") - F.col("top"))
        cut = shown.select(*KEY, "offset", "top", size.cast("int").alias("rows"))
        return self.frames.join(cut, KEY)

    def summary(self, placed: DataFrame) -> DataFrame:
        """A row per recording: its fault or ``ok``, region, counts, and the long image's height."""
        counts = placed.groupBy("recording_id").agg(
            F.count("*").cast("int").alias("n_key"), F.count_if((F.col("move") > 0) | (F.col("frame_idx") == 0)).cast("int").alias("n_placed"),
            F.count_if(~F.col("sure")).cast("int").alias("n_unsure"), F.max("offset").alias("reach"),
        )
        found = self.sizes.join(self.regions, "recording_id", "left").join(self.keys.select("recording_id", "dropped", "too_far"), "recording_id", "left").join(counts, "recording_id", "left")
        status = F.coalesce("fault", F.when(F.col("ok"), "ok").otherwise("no_region"))
        return found.select(
            "recording_id", status.alias("status"), F.col("n_frames").cast("int"), "top", "bottom", "n_key", "dropped", "too_far", "n_placed", "n_unsure",
            (F.col("reach") + F.col("bottom") - F.col("top")).alias("height"),
        )


def slice_of(data: bytes, width: int, top: int, rows: int) -> bytes:
    return data[4 * width * top : 4 * width * (top + rows)]


def band_sum(data: bytes, width: int, rows: int, offset: int) -> int:
    light = pixels.rgba(data, width, rows).astype(np.int64) @ np.array([1, 2, 3, 0])
    return int((light.sum(1) * ((offset + np.arange(rows)) % 97 + 1)).sum())


def band_sums(bands: DataFrame) -> DataFrame:
    """``recording_id, checksum``: every pixel of the long image, weighted by its row, as a sum over bands."""

    each = pixels.per_row(lambda *row: (band_sum(*row),), "s bigint", "data", "width", "rows", "offset")
    return bands.select("recording_id", each.alias("b")).groupBy("recording_id").agg(F.sum("b.s").alias("checksum"))
