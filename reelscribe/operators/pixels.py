"""Pixel kernels of the stitching engine, run on Arrow batches; images are RGBA or grey bytes with their sizes.

Decoding pictures is outside: rows come with raw pixels. Every kernel works on one image or one pair of images, so
Spark deals rows freely; only key frames and stitching follow a recording's order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import REFINE, SUBSAMPLE, TEMPLATE_HEIGHT, TEMPLATE_TOP
from ..functions.geometry import bubble_colour
from .folds import Columns, fold


#: Cells that are compared at once.
CELLS = 1 << 18


def rgba(data: bytes, width: int, height: int) -> np.ndarray:
    if width <= 0 or height <= 0 or len(data) != 4 * width * height:
        raise ValueError("pixels do not match the image's size")
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def grey(pixels: np.ndarray) -> np.ndarray:
    return ((pixels[..., :3].astype(np.uint32) * np.array([77, 150, 29], np.uint32)).sum(-1) >> 8).astype(np.uint8)


def coarse(pixels: np.ndarray) -> np.ndarray:
    """Every fourth pixel of every fourth row of an image that is already cropped, in grey."""
    height, width = (n // SUBSAMPLE * SUBSAMPLE for n in pixels.shape[:2])
    return grey(pixels[:height:SUBSAMPLE, :width:SUBSAMPLE])


def differences(old: np.ndarray, template: np.ndarray, tops: range) -> np.ndarray:
    """Sums of absolute differences of the template against the old image at each top."""
    wanted = template.astype(np.int16).T
    places = np.lib.stride_tricks.sliding_window_view(old.astype(np.int16), len(template), axis=0)
    step = max(1, CELLS // wanted.size)
    return np.concatenate([np.abs(places[t : min(t + step, tops.stop)] - wanted).sum((1, 2), dtype=np.int64) for t in tops[::step]])


def confidence(best: int, width: int, rows: int) -> float:
    return 1 - min(1.0, best / (width * rows * 64))


def coarse_shift(old: np.ndarray, new: np.ndarray) -> tuple[int, float]:
    """Scroll between two coarse images, to four pixels, and how well they match."""
    top, rows = TEMPLATE_TOP // SUBSAMPLE, TEMPLATE_HEIGHT // SUBSAMPLE
    if old.shape != new.shape or len(old) < top + rows:
        raise ValueError("coarse images must be of one size and hold the template")
    sums = differences(old, new[top : top + rows], range(len(old) - rows + 1))
    at = int(sums.argmin())
    return at * SUBSAMPLE - TEMPLATE_TOP, confidence(int(sums[at]), old.shape[1], rows)


def full_shift(old: np.ndarray, new: np.ndarray) -> tuple[int, float]:
    """Scroll between two grey images: a coarse search, then every row near its best."""
    step = [x[: len(x) // SUBSAMPLE * SUBSAMPLE : SUBSAMPLE, : x.shape[1] // SUBSAMPLE * SUBSAMPLE : SUBSAMPLE] for x in (old, new)]
    middle = coarse_shift(*step)[0] + TEMPLATE_TOP
    tops = range(max(0, middle - REFINE), min(len(old) - TEMPLATE_HEIGHT, middle + REFINE) + 1)
    sums = differences(old, new[TEMPLATE_TOP : TEMPLATE_TOP + TEMPLATE_HEIGHT], tops)
    at = int(sums.argmin())
    return tops[at] - TEMPLATE_TOP, confidence(int(sums[at]), old.shape[1], TEMPLATE_HEIGHT)


def per_row(fn: Callable, schema: str, *columns: str):
    """A column from a small function of each row's values, computed in Arrow batches."""

    @F.pandas_udf(schema)
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fn(*row) for row in frame.itertuples(index=False, name=None)], columns=[x.split()[0] for x in schema.split(", ")])

    return run(F.struct(*columns))


def coarse_images(frames: DataFrame, top: int, bottom: int) -> DataFrame:
    """``recording_id, frame_idx, coarse(data, width, height)`` of ``frames(recording_id, frame_idx, data, width, height)``
    cropped to the scrolled rows; the crop comes first, so that rows are counted from its top."""

    def run(data: bytes, width: int, height: int):
        if not 0 <= top < bottom <= height:
            raise ValueError("rows outside the image")
        small = coarse(rgba(data, width, height)[top:bottom])
        return small.tobytes(), small.shape[1], small.shape[0]

    return frames.select("recording_id", "frame_idx", per_row(run, "data binary, width int, height int", "data", "width", "height").alias("coarse"))


def adjacent_shifts(images: DataFrame) -> DataFrame:
    """``recording_id, pair_idx, dy, conf`` between each coarse image and the one before it."""
    before = F.lag("coarse").over(Window.partitionBy("recording_id").orderBy("frame_idx"))
    pairs = images.withColumn("before", before).where("before is not null")
    pairs = pairs.select("recording_id", F.col("frame_idx").alias("pair_idx"), F.col("before.data").alias("old"), F.col("coarse.*"))

    def run(old: bytes, data: bytes, width: int, height: int):
        a, b = (np.frombuffer(x, np.uint8).reshape(height, width) for x in (old, data))
        return coarse_shift(a, b)

    return pairs.select("recording_id", "pair_idx", per_row(run, "dy int, conf double", "old", "data", "width", "height").alias("s")).select("recording_id", "pair_idx", "s.*")


def key_frames_of(steps: list[int], view: int, overlap: float = 0.6) -> tuple[list[int], int, int]:
    """Frames to keep so that neighbours overlap; frames that bounced back are never kept. Also counts bounced frames
    and gaps of a whole view.

    ``at`` is each frame's place (a bounced one has its forerunner's), ``solid`` the last frame up to it that hasn't
    bounced. Both ascend, so the next crossing of the limit and the next solid frame are binary searches.
    """
    moved = np.concatenate([[0], np.asarray(steps, np.int64)])
    at = np.cumsum(np.maximum(moved, 0))
    solid = np.maximum.accumulate(np.where(moved < 0, 0, np.arange(len(moved))))
    keep, crossing = [0], 0
    while True:
        last = keep[-1]
        crossing = max(crossing + 1, int(np.searchsorted(at, at[last] + view * overlap, side="right")))
        after = int(np.searchsorted(solid, last, side="right"))
        if max(crossing, after) >= len(at):
            break
        keep.append(int(solid[crossing - 1]) if after < crossing else after)
        crossing = max(crossing, keep[-1])
    if solid[-1] > keep[-1]:
        wide = int(np.count_nonzero(np.diff(at[keep]) >= view))
        return [*keep, int(solid[-1])], int(np.count_nonzero(moved < 0)), wide
    return keep, int(np.count_nonzero(moved < 0)), int(np.count_nonzero(np.diff(at[keep]) >= view))


def key_frames(shifts: DataFrame, view: int, overlap: float = 0.6) -> DataFrame:
    """``recording_id, keep, dropped, too_far`` of ``shifts(recording_id, pair_idx, dy)``; what is kept depends on what
    was, so a recording is one fold, of integers only."""

    def run(rows: Columns) -> Columns:
        keep, dropped, wide = key_frames_of(rows["dy"], view, overlap)
        return {"keep": [keep], "dropped": [dropped], "too_far": [wide]}

    return fold(shifts.select("recording_id", "pair_idx", "dy"), ["recording_id"], ["pair_idx"], run, "keep array<int>, dropped int, too_far int")


def advance(last: np.ndarray, image: np.ndarray) -> tuple[int, bool]:
    """How far an image lies below the last one placed (0: it shows nothing new), and whether that is sure. A poor
    match says nothing of the direction, so it is judged first and stands for most of a view."""
    dy, conf = full_shift(last, image)
    if conf < 0.5:
        return int(np.floor(len(image) * 0.95 + 0.5)), False
    return max(dy, 0), True


def stitch(images: list[np.ndarray]) -> dict:
    """One canvas of a recording's images; each is matched with the last one placed."""
    last, tops, unsure = grey(images[0]), {0: 0}, []
    for i, image in enumerate(images[1:], 1):
        light = grey(image)
        move, sure = advance(last, light)
        if move:
            tops[i] = max(tops.values()) + move
            last = light
        unsure += [] if sure else [i]
    canvas = np.zeros((max(tops.values()) + len(images[0]), *images[0].shape[1:]), np.uint8)
    for i, top in tops.items():
        canvas[top : top + len(images[i])] = images[i]
    return {
        "data": canvas.tobytes(), "width": canvas.shape[1], "height": len(canvas), "offsets": list(tops.values()), "skipped": len(images) - len(tops), "unsure": unsure,
    }


def stitched(frames: DataFrame) -> DataFrame:
    """``recording_id, data, width, height, offsets, skipped, unsure`` of key frames ``(recording_id, frame_idx, data, width, height)``."""

    def run(rows: Columns) -> Columns:
        made = stitch([rgba(d, w, h) for d, w, h in zip(rows["data"], rows["width"], rows["height"])])
        return {name: [value] for name, value in made.items()}

    return fold(frames, ["recording_id"], ["frame_idx"], run, "data binary, width int, height int, offsets array<int>, skipped int, unsure array<int>")


def row_spread(greys: np.ndarray) -> np.ndarray:
    """Per row, the mean over every fourth column of the spread across the last three fifths of the frames."""
    return spread_of(greys[:, :, ::4])


def spread_of(columns: np.ndarray) -> np.ndarray:
    """``row_spread`` of frames that hold those columns only."""
    late = columns[int(len(columns) * 0.4) :].astype(np.float64)
    return np.sqrt(np.maximum(0, (late**2).mean(0) - late.mean(0) ** 2)).mean(1)


def reach(spread: np.ndarray, start: int, low: float, gap: int) -> int:
    """Rows that the region goes on from ``start``, over quiet stretches shorter than ``gap``."""
    loud = np.flatnonzero(spread[start:] >= low)
    if not len(loud):
        return 0
    quiet = np.diff(np.concatenate([[-1], loud])) - 1
    stop = np.flatnonzero(quiet >= gap)
    loud = loud[: stop[0]] if len(stop) else loud
    return int(loud[-1]) + 1 if len(loud) else 0


def scroll_region(greys: np.ndarray, high: float = 0.70, low: float = 0.28, gap: int = 40) -> dict:
    """The rows that scroll: the longest run over a high threshold, grown over a low one; ok if it is 3/10 of the height."""
    return scroll_region_of(row_spread(greys), high, low, gap)


def scroll_region_of(spread: np.ndarray, high: float = 0.70, low: float = 0.28, gap: int = 40) -> dict:
    """``scroll_region`` from the rows' spread."""
    height = len(spread)
    p85 = np.sort(spread)[int(height * 0.85)]
    seed_at, grow_at = max(10, p85 * high), max(4, p85 * low)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (spread >= seed_at).astype(np.int8), [0]])))
    if not len(edges):
        return {"top": 0, "bottom": height, "threshold": float(seed_at), "ok": False}
    begin, end = edges[::2], edges[1::2]
    i = int((end - begin).argmax())
    top = int(begin[i]) - reach(spread[::-1], height - int(begin[i]), grow_at, gap)
    bottom = int(end[i]) + reach(spread, int(end[i]), grow_at, gap)
    return {"top": top, "bottom": bottom, "threshold": float(seed_at), "ok": bottom - top >= height * 0.3}


def scroll_regions(frames: DataFrame) -> DataFrame:
    """``recording_id, top, bottom, threshold, ok`` of a few grey preview frames ``(recording_id, frame_idx, data, width, height)``."""

    def run(rows: Columns) -> Columns:
        greys = [np.frombuffer(d, np.uint8).reshape(h, w) for d, w, h in zip(rows["data"], rows["width"], rows["height"])]
        return {name: [value] for name, value in scroll_region(np.stack(greys)).items()}

    return fold(frames, ["recording_id"], ["frame_idx"], run, "top int, bottom int, threshold double, ok boolean")


def bright_median(pixels: np.ndarray, threshold: float = 150, least: int = 20) -> tuple[list[float] | None, int]:
    """Median of the pixels brighter than the threshold, or of all if there are fewer than ``least``; the bright ones."""
    flat = pixels.reshape(-1, 4)[:, :3].astype(np.int64)
    bright = flat[flat.sum(1) > threshold * 3]
    chosen = bright if len(bright) >= least else flat
    return (np.median(chosen, axis=0).tolist() if len(chosen) else None), len(bright)


def region_sample(image: np.ndarray | None, x: int, y: int, w: int, h: int) -> tuple[list[float] | None, int, int, str | None]:
    """Bright median, bright pixels, decoded pixels and error of one region; a null image could not be decoded."""
    if w is None or h is None or w <= 0 or h <= 0:
        return None, 0, 0, "E_RECT"
    if image is None:
        return None, 0, 0, "E_DECODE"
    height, width = image.shape[:2]
    left, top, right, bottom = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
    if right <= left or bottom <= top:
        return None, 0, 0, "E_RECT"
    if (left, top, right, bottom) == (0, 0, width, height):
        return None, 0, 0, "E_FULL_FRAME_FORBIDDEN"
    rgb, bright = bright_median(image[top:bottom, left:right])
    return rgb, bright, (bottom - top) * (right - left), None


def region_samples(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """``recording_id, id, rgb, bright_pixels, decoded_pixels, side, error`` for each requested region.

    ``requests(recording_id, id, frame_idx, x, y, width, height)``. An empty box or one outside is E_RECT, a whole frame
    E_FULL_FRAME_FORBIDDEN, an unknown frame E_FRAME, bytes that are no RGBA image of the stated size E_DECODE (of whole
    pixels but another number of channels E_CONFIG); each is an error of its own row. Requests are grouped by frame, so
    an image travels to them once, and images that nobody asks for don't travel.
    """
    key = ["recording_id", "frame_idx"]
    asked = requests.select(*key, "id", "x", "y", "width", "height")
    images = frames.join(asked.select(*key).distinct(), key, "left_semi").select(*key, "data", "width", "height")

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        image, missing = None, None
        if found.num_rows:
            data, width, height = (found[c][0].as_py() for c in ("data", "width", "height"))
            try:
                image = rgba(data, width, height)
            except (TypeError, ValueError):
                missing = "E_CONFIG" if data and width and height and len(data) % (width * height) == 0 else None
        else:
            missing = "E_FRAME"
        boxes = zip(*(rows[c].to_pylist() for c in ("x", "y", "width", "height")))
        samples = [region_sample(image, *box) for box in boxes]
        rgb, bright, decoded, error = map(list, zip(*samples)) if samples else ([], [], [], [])
        error = [missing if e == "E_DECODE" and missing else e for e in error]
        return pa.table(
            {"recording_id": rows["recording_id"], "id": rows["id"], "rgb": pa.array(rgb, pa.list_(pa.float64())), "bright_pixels": pa.array(bright, pa.int32()),
             "decoded_pixels": pa.array(decoded, pa.int32()), "error": pa.array(error, pa.string())}
        )

    schema = T.StructType([asked.schema["recording_id"], asked.schema["id"]] + T._parse_datatype_string("rgb array<double>, bright_pixels int, decoded_pixels int, error string").fields)
    sampled = asked.groupBy(*key).cogroup(images.groupBy(*key)).applyInArrow(run, schema)
    colour = bubble_colour(*(F.col("rgb")[i] for i in range(3)))
    side = F.when(colour == "self", "me").when(colour == "other", "them")
    return sampled.select("recording_id", "id", "rgb", "bright_pixels", "decoded_pixels", side.alias("side"), "error")


def bitmap(pixels: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP file."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, (24 * width + 31) // 32 * 4), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, 2::-1].reshape(height, -1)
    size = rows.size
    head = np.array([54 + size, 0, 54, 40, width, height], "<u4").tobytes() + np.array([1, 24], "<u2").tobytes()
    return b"BM" + head + np.array([0, size, 0, 0, 0, 0], "<u4").tobytes() + rows.tobytes()


def bitmaps(images: DataFrame) -> DataFrame:
    """``recording_id, bmp`` of ``images(recording_id, data, width, height)``."""
    run = per_row(lambda d, w, h: (bitmap(rgba(d, w, h)),), "bmp binary", "data", "width", "height")
    return images.select("recording_id", run.alias("b")).select("recording_id", "b.bmp")


def segment_lines(lines: DataFrame, images: DataFrame) -> DataFrame:
    """``recording_id, line_no, text, x, y, rgb`` of ``lines(recording_id, line_no, text, x, y, w, h, segment_top)`` on the
    long image; colours are medians of bright pixels behind each box, clipped to the image. An image meets all its
    lines in one group; lines without an image are left out."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        image = rgba(*(found[c][0].as_py() for c in ("data", "width", "height"))) if found.num_rows else None
        rows = rows if found.num_rows else rows.slice(0, 0)
        rgb = []
        for x, y, w, h, top in zip(*(rows[c].to_pylist() for c in ("x", "y", "w", "h", "segment_top"))):
            left, right = max(0, int(np.floor(x))), min(image.shape[1], int(np.ceil(x + w)))
            upper, lower = max(0, int(np.floor(y + top))), min(image.shape[0], int(np.ceil(y + top + h)))
            rgb.append(bright_median(image[upper:lower, left:right])[0] if left < right and upper < lower else None)
        below = [y + top for y, top in zip(rows["y"].to_pylist(), rows["segment_top"].to_pylist())]
        return pa.table({c: rows[c] for c in ("recording_id", "line_no", "text", "x")} | {"y": pa.array(below, pa.float64()), "rgb": pa.array(rgb, pa.list_(pa.float64()))})

    boxes = lines.select("recording_id", "line_no", "text", *(F.col(c).cast("double") for c in ("x", "y", "w", "h", "segment_top")))
    schema = T.StructType(boxes.schema.fields[:4] + T._parse_datatype_string("y double, rgb array<double>").fields)
    return boxes.groupBy("recording_id").cogroup(images.groupBy("recording_id")).applyInArrow(run, schema)


def parse_ppm(data: bytes) -> tuple[bytes, int, int]:
    """RGBA bytes and size of a binary PPM (P6, 8 bits a channel); comments may stand between the header's fields."""
    head = re.match(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not head or int(head[3]) != 255:
        raise ValueError("not a binary PPM of 8 bits a channel")
    width, height = int(head[1]), int(head[2])
    rgb = np.frombuffer(data, np.uint8, 3 * width * height, head.end()).reshape(height, width, 3)
    return np.dstack([rgb, np.full((height, width), 255, np.uint8)]).tobytes(), width, height


def ppm_images(files: DataFrame) -> DataFrame:
    """``path, data, width, height`` of ``files(path, content)``, as Spark's binaryFile source gives them."""
    return files.select("path", per_row(parse_ppm, "data binary, width int, height int", "content").alias("i")).select("path", "i.*")
