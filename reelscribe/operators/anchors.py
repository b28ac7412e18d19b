"""Text anchors between neighbouring frames and the scroll offset that they vote for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FUZZY_SIMILARITY, MIN_ANCHORS, MIN_KEY_LENGTH, MIN_VOTE, RESCUE_VOTE, SHIFT_TOLERANCE
from ..functions.geometry import band
from ..functions.text import edit_distance, norm_length, norm_of
from .folds import dealt

PAIR = ["recording_id", "pair_idx"]


def anchor_lines(observations: DataFrame, fixed: DataFrame) -> DataFrame:
    """Lines that can anchor: outside fixed bands, with a key of four characters or more. Null texts can't. Where an earlier
    stage has numbered a recording's keys (``key_no``), the numbers stand for them."""
    key = F.col("key_no") if "key_no" in observations.columns else norm_of(observations)
    keyed = observations.select("recording_id", "frame_idx", "line_no", "y", key.alias("key"), norm_length(observations).alias("size"), band(F.col("y")).alias("band"))
    return (
        keyed.where(F.col("size") >= MIN_KEY_LENGTH)
        .join(fixed.select("recording_id", "band"), ["recording_id", "band"], "left_anti")
        .drop("band")
    )


def sides(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines as the earlier and as the later frame of a pair; a pair has its later frame's number."""
    before = lines.select("recording_id", (F.col("frame_idx") + 1).alias("pair_idx"), F.col("line_no").alias("prev_line"), F.col("y").alias("prev_y"), "key", F.col("size").alias("prev_size"))
    after = lines.select("recording_id", F.col("frame_idx").alias("pair_idx"), F.col("line_no").alias("cur_line"), F.col("y").alias("cur_y"), "key", F.col("size").alias("cur_size"))
    return before, after


def exact_anchors(lines: DataFrame) -> DataFrame:
    """Equal keys; the earlier frame's must be the only one of its frame, the later frame's may repeat."""
    before, after = sides(lines)
    alone = before.withColumn("n", F.count("*").over(Window.partitionBy(*PAIR, "key"))).where("n = 1").drop("n")
    return alone.join(after, [*PAIR, "key"]).select(
        *PAIR, "prev_line", "cur_line", "prev_y", "cur_y", F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind")
    )


def fuzzy_anchors(lines: DataFrame, exact: DataFrame, least: float = FUZZY_SIMILARITY, texts: DataFrame | None = None) -> DataFrame:
    """Alike keys of lines without an exact anchor, where each is the other's one best partner.

    Lengths that differ by more than the allowed share are pruned before any distance is computed, and the distance is
    a bounded one: it gives up on a pair that is too far, and what it returns for the others is all that is needed.
    Where keys are numbers, ``texts(recording_id, key, norm)`` has what they stand for; it meets only the pairs that are left.
    """
    before, after = sides(lines)
    before = before.join(exact.select(*PAIR, "prev_line"), [*PAIR, "prev_line"], "left_anti").withColumnRenamed("key", "prev_key")
    after = after.join(exact.select(*PAIR, "cur_line"), [*PAIR, "cur_line"], "left_anti").withColumnRenamed("key", "cur_key")
    long_, short = (f("prev_size", "cur_size") for f in (F.greatest, F.least))
    if texts is None:
        before, after = dealt(before, *PAIR), dealt(after, *PAIR)
    near = before.join(after, PAIR).where(short >= long_ * F.lit(least) - F.lit(1e-9)).withColumn("longest", long_).drop("prev_size", "cur_size")
    if texts is not None:
        for key in ("prev_key", "cur_key"):
            named = texts.select("recording_id", F.col("key").alias(key), F.col("norm").alias(f"{key}_norm"))
            near = near.join(named, ["recording_id", key]).drop(key).withColumnRenamed(f"{key}_norm", key)
    # The windows below stand between the distance and the filter on it, so that it is computed once.
    near = edit_distance(near, "prev_key", "cur_key", "far", f"cast(ceil((1 - {float(least)}D) * longest) as int)").drop("prev_key", "cur_key")
    far = F.when(F.col("far") >= 0, 1 - F.col("far") / F.col("longest")).otherwise(F.lit(-1.0))
    near = near.withColumn("similarity", F.when(far >= least, far).otherwise(F.lit(-1.0)))
    for side in ("prev_line", "cur_line"):
        best = Window.partitionBy(*PAIR, side).orderBy(F.desc("similarity"))
        rest = F.lead("similarity").over(best)
        near = near.withColumn(f"best_{side}", (F.row_number().over(best) == 1) & (rest.isNull() | (rest < F.col("similarity"))))
    chosen = near.where("best_prev_line and best_cur_line and similarity >= 0")
    return chosen.select(*PAIR, "prev_line", "cur_line", "prev_y", "cur_y", "similarity", F.lit("fuzzy").alias("kind"))


def votes(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, total, runner_up, best(votes, members)`` of ``diffs(*keys, diff)``.

    Sorted values whose steps are at most the tolerance are a cluster; the largest wins, of equal ones the lowest.
    ``runner_up`` is the size of the next one, null without any. Equal values are counted first, so that no order is left open.
    """
    diffs = diffs.groupBy(*keys, "diff").agg(F.count("*").alias("n"))
    by_value = Window.partitionBy(*keys).orderBy("diff")
    step = F.col("diff") - F.lag("diff").over(by_value)
    cut = diffs.withColumn("cut", F.when(step > SHIFT_TOLERANCE, 1).otherwise(0))
    chained = cut.withColumn("cluster", F.sum("cut").over(by_value.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.sort_array(F.collect_list(F.when(F.col("diff").isNotNull(), F.struct("diff", F.col("n").cast("int").alias("n")))))
    clusters = chained.groupBy(*keys, "cluster").agg(F.sum("n").alias("votes"), F.min("diff").alias("first"), listed.alias("values"))
    clusters = clusters.withColumn("members", F.flatten(F.transform("values", lambda v: F.array_repeat(v["diff"], v["n"]))))
    return clusters.groupBy(*keys).agg(
        F.sum("votes").alias("total"),
        F.try_element_at(F.sort_array(F.collect_list("votes"), asc=False), F.lit(2)).alias("runner_up"),
        F.max_by(F.struct("votes", "members"), F.struct("votes", -F.col("first"))).alias("best"),
    )


def upper_median(members: Column) -> Column:
    return F.try_element_at(members, (F.floor(F.size(members) / 2) + 1).cast("int"))


def shifts(frames: DataFrame, exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """One row per pair of neighbouring ``frames(recording_id, frame_idx)``: its shift and the evidence for it.

    Reliable exact anchors set the shift; agreeing fuzzy ones only add votes. Otherwise all anchors together may
    rescue a pair by a clear, large majority. Otherwise the exact vote stands, which may be none. A recording of one
    frame has no pairs.
    """
    every = exact.unionByName(fuzzy).select(*PAIR, "kind", (F.col("prev_y") - F.col("cur_y")).alias("diff"))
    ballots = F.when(F.col("kind") == "exact", F.array(F.lit("own"), F.lit("joint"))).otherwise(F.array(F.lit("joint")))
    counted = votes(every.withColumn("ballot", F.explode(ballots)), [*PAIR, "ballot"])
    counted = counted.withColumn("v", F.struct("total", "runner_up", "best.votes", "best.members"))
    state = counted.groupBy(*PAIR).agg(*(F.max(F.when(F.col("ballot") == b, F.col("v"))).alias(b) for b in ("own", "joint")))
    none = F.array().cast("array<double>")
    each = every.groupBy(*PAIR).agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("diff"))).alias(k) for k in ("exact", "fuzzy")))
    state = state.join(each, PAIR)

    def count(ballot: str, field: str) -> Column:
        return F.coalesce(F.col(ballot)[field], F.lit(0).cast("long"))

    own_share, joint_share = (count(b, "votes") / F.greatest(count(b, "total"), F.lit(1)) for b in ("own", "joint"))
    sure = (count("own", "total") >= MIN_ANCHORS) & (own_share >= MIN_VOTE)
    clear = F.col("joint")["runner_up"].isNull() | (count("joint", "votes") > count("joint", "runner_up"))
    rescue = (count("joint", "votes") >= MIN_ANCHORS) & (joint_share >= RESCUE_VOTE) & clear
    state = state.withColumn("sure", sure).withColumn("rescue", ~F.col("sure") & rescue)
    near = F.when(F.col("sure"), F.col("own.members")).when(F.col("rescue"), F.col("joint.members")).otherwise(none)
    state = state.withColumn("near", near)
    state = state.withColumn("taken", F.filter("fuzzy", lambda d: F.exists("near", lambda v: F.abs(v - d) <= SHIFT_TOLERANCE)))
    # Fuzzy anchors taken beside a reliable exact vote may join its cluster to others: those few pairs are counted anew.
    wide = state.where(F.col("sure") & (F.size("taken") > 0)).select(*PAIR, F.explode(F.concat("exact", "taken")).alias("diff"))
    widened = votes(wide, PAIR).select(*PAIR, F.col("best.votes").alias("wide_votes"), F.col("total").alias("wide_total"))
    pairs = frames.where("frame_idx > 0").select("recording_id", F.col("frame_idx").alias("pair_idx")).distinct()
    state = pairs.join(state.join(widened, PAIR, "left"), PAIR, "left")
    zero = F.lit(0).cast("long")
    sure, rescued = F.coalesce("sure", F.lit(False)), F.coalesce("rescue", F.lit(False))
    shift = upper_median(F.when(rescued, F.col("joint.members")).otherwise(F.col("own.members")))
    found, accepted = (F.greatest(F.size(F.coalesce(c, none)), F.lit(0)).cast("long") for c in ("fuzzy", "taken"))
    return state.select(
        *PAIR,
        F.coalesce(shift, F.lit(0.0)).alias("shift"),
        F.coalesce("wide_votes", F.when(rescued, count("joint", "votes")).otherwise(count("own", "votes"))).alias("votes"),
        F.coalesce("wide_total", F.when(rescued, count("joint", "total")).otherwise(count("own", "total"))).alias("total"),
        count("own", "total").alias("exact_total"),
        found.alias("fuzzy_candidates"),
        accepted.alias("fuzzy_accepted"),
        (found - accepted).alias("fuzzy_rejected"),
        rescued.alias("fuzzy_rescue"),
        F.when(sure, zero).otherwise(count("joint", "votes")).alias("candidate_votes"),
        F.when(sure, zero).otherwise(count("joint", "total")).alias("candidate_total"),
    )
