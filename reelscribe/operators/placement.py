"""Placing frames on one long canvas and checking how far the placement can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_ANCHORS, MIN_VOTE


def recording():
    return Window.partitionBy("recording_id").orderBy("pair_idx").rowsBetween(Window.unboundedPreceding, 0)


def ratio() -> Column:
    return F.when(F.col("total") > 0, F.col("votes") / F.col("total")).otherwise(F.lit(0.0))


def reliable() -> Column:
    return (F.col("total") >= MIN_ANCHORS) & (ratio() >= MIN_VOTE)


def cumulative(shifts: DataFrame) -> DataFrame:
    """Adds ``cumulative_shift`` (unreliable pairs move on too) and ``segment_id``, which grows at each unreliable pair.

    Two frames have the same segment exactly if every pair between them is reliable.
    """
    broken = F.when(reliable(), 0).otherwise(1)
    return shifts.withColumn("cumulative_shift", F.sum("shift").over(recording())).withColumn("segment_id", F.sum(broken).over(recording()))


def placed_lines(observations: DataFrame, shifts: DataFrame) -> DataFrame:
    """Observations with their canvas height ``gy`` and ``segment_id``; a recording's first frame stays where it is."""
    moved = cumulative(shifts).select("recording_id", F.col("pair_idx").alias("frame_idx"), "cumulative_shift", "segment_id")
    joined = observations.join(moved, ["recording_id", "frame_idx"], "left")
    return (
        joined.withColumn("gy", F.col("y") + F.coalesce("cumulative_shift", F.lit(0.0)))
        .withColumn("segment_id", F.coalesce("segment_id", F.lit(0)).cast("long"))
        .drop("cumulative_shift")
    )


def anchor_warnings(shifts: DataFrame) -> DataFrame:
    """``recording_id, pair_idx, reason``: pairs without common text (with or without fuzzy candidates), with too few
    anchors, or with scattered votes."""
    reason = (
        F.when((F.col("total") == 0) & (F.col("candidate_total") > 0), "only_unaccepted_fuzzy")
        .when(F.col("total") == 0, "no_common_text")
        .when(F.col("total") < MIN_ANCHORS, "few_anchors")
        .when(ratio() < MIN_VOTE, "scattered_votes")
    )
    return shifts.select("recording_id", "pair_idx", reason.alias("reason"), "votes", "total", "candidate_votes", "candidate_total").where("reason is not null")
