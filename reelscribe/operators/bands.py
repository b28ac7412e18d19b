"""Fixed interface bands: stretches of the screen that text occupies in nearly all frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FIXED_RATIO
from ..functions.geometry import band
from ..functions.text import norm_length


def fixed_bands(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """``recording_id, band, hits, frames``: bands found in at least 4/5 of a recording's ``frames``.

    ``frames(recording_id, frame_idx)`` lists empty frames too; they count in the share. A recording of one frame has
    nothing to compare and so no fixed band; a null recording is left out, as are observations without a height.
    """
    hits = observations.where("y is not null").groupBy("recording_id", band(F.col("y")).alias("band")).agg(F.countDistinct("frame_idx").alias("hits"))
    total = frames.groupBy("recording_id").agg(F.countDistinct("frame_idx").alias("frames")).where("frames > 1")
    return hits.join(total, "recording_id").where(F.col("hits") / F.col("frames") >= FIXED_RATIO)


def content_lines(observations: DataFrame, fixed: DataFrame) -> DataFrame:
    """Observations outside fixed bands with any text to compare."""
    kept = observations.withColumn("band", band(F.col("y"))).join(fixed.select("recording_id", "band"), ["recording_id", "band"], "left_anti")
    return kept.where(norm_length(observations) > 0).select(*observations.columns)
