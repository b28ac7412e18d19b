"""Which frames to read and how to cut a long image, as rows generated by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FRAMES_PER_SECOND, OCR_HEIGHT, OCR_OVERLAP, PRESETS, THUMBNAIL_QUALITY
from ..functions.geometry import finite, half_up


def checked(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def uniform_times(duration: Column, count: Column) -> Column:
    """``count`` times from 0 to the last millisecond, evenly spread."""
    last = F.greatest(F.lit(0.0), duration - 1)
    steps = F.transform(F.sequence(F.lit(0), count - 1), lambda i: half_up(i * last / (count - 1)).cast("double"))
    times = F.when(count == 1, F.array(F.lit(0.0))).otherwise(steps)
    return checked((duration > 0) & (count >= 1), times, "duration and count must be positive")


def fps_times(duration: Column, fps: Column) -> Column:
    """One time per frame of a video of that rate, none past the last millisecond."""
    step = F.lit(1000.0) / fps
    count = F.greatest(F.lit(1), half_up(duration / step).cast("int"))
    times = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.least(duration - 1, half_up(i * step).cast("double"))
    )
    return checked((duration > 0) & (fps > 0), times, "duration and fps must be positive")


def frame_plan(recordings: DataFrame, fps: float = FRAMES_PER_SECOND, stride: int = 5, capture_all: bool = False) -> DataFrame:
    """``recording_id, source_idx, time_ms, selected, extracted`` for ``recordings(recording_id, duration_ms)``."""
    if stride < 1:
        raise ValueError("stride must be a positive integer")
    times = F.posexplode(fps_times(F.col("duration_ms").cast("double"), F.lit(float(fps)))).alias("source_idx", "time_ms")
    planned = recordings.select("recording_id", times)
    selected = F.col("source_idx") % stride == 0
    return planned.withColumn("selected", selected).withColumn("extracted", F.lit(True) if capture_all else selected)


def stride_for_gap(fps: Column, gap_ms: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(fps * gap_ms / 1000).cast("int"))


def with_presets(recordings: DataFrame) -> DataFrame:
    """Adds ``pre_scan, mode, stride`` of each recording's ``preset``; an unknown or null preset is an error. Extra columns stay."""
    names = ("pre_scan", "mode", "stride")
    known = F.create_map(*(x for name, values in PRESETS.items() for x in (F.lit(name), F.struct(*(F.lit(values[n]).alias(n) for n in names)))))
    found = F.try_element_at(known, F.coalesce("preset", F.lit("")))
    unknown = F.raise_error(F.concat(F.lit("unknown preset: "), F.coalesce("preset", F.lit("null"))))
    return recordings.withColumns({n: F.when(found.isNotNull(), found[n]).otherwise(unknown) for n in names})


def thumbnail_requests(times: DataFrame) -> DataFrame:
    """Adds ``quality`` to ``times(…, purpose, time_ms)``; an unknown or null purpose, or a time below 0, is an error."""
    known = F.create_map(*(F.lit(x) for pair in THUMBNAIL_QUALITY.items() for x in pair))
    quality = F.try_element_at(known, F.coalesce("purpose", F.lit("")))
    at = F.coalesce(F.col("time_ms").cast("double"), F.lit(-1.0))
    wrong = F.raise_error(F.concat(F.lit("unknown purpose, or no time: "), F.coalesce("purpose", F.lit("null"))))
    return times.withColumn("quality", F.when(quality.isNotNull() & finite(at) & (at >= 0), quality).otherwise(wrong.cast("double")))


def preset_requests(recordings: DataFrame, fps: float = FRAMES_PER_SECOND) -> DataFrame:
    """``recording_id, mode, purpose, idx, time_ms, quality`` for ``recordings(recording_id, duration_ms, preset)``: the preview
    frames, spread evenly, and then every frame of the preset's stride at its own quality. No rows give none."""
    planned = with_presets(recordings.withColumn("duration_ms", F.col("duration_ms").cast("double")))
    preview = planned.select("recording_id", "mode", F.lit("prescan").alias("purpose"), F.posexplode(uniform_times(F.col("duration_ms"), F.col("pre_scan"))).alias("idx", "time_ms"))
    every = planned.select("recording_id", "mode", "stride", F.posexplode(fps_times(F.col("duration_ms"), F.lit(float(fps)))).alias("idx", "time_ms"))
    frames = every.where("idx % stride = 0").select("recording_id", "mode", F.lit("keyframe").alias("purpose"), "idx", "time_ms")
    return thumbnail_requests(preview.unionByName(frames))


def ocr_segments(images: DataFrame, height: int = OCR_HEIGHT, overlap: int = OCR_OVERLAP) -> DataFrame:
    """``image_id, segment, top, height``: overlapping cuts of ``images(image_id, total_height)``."""
    if not 0 <= overlap < height:
        raise ValueError("overlap must be below the segment height")
    total = F.col("total_height").cast("long")
    tops = F.posexplode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(height - overlap).cast("long")))
    cut = images.where("total_height >= 1").select("image_id", total.alias("total"), tops.alias("segment", "top"))
    return cut.select("image_id", "segment", "top", F.least(F.lit(height).cast("long"), F.col("total") - F.col("top")).alias("height"))
