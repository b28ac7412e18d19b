"""Many or large recordings: what is written and shuffled follows the rows, not the number of recordings or what they say."""

import os

from pyspark.sql import functions as F

from reelscribe.sources import bundles


def test_caches_of_many_recordings_are_few_files(spark, tmp_path):
    lines = F.array(F.struct(F.lit("t").alias("text"), *(F.lit(1.0).alias(c) for c in "xywh"), F.lit(None).cast("double").alias("conf")))
    i = F.col("id") % 3
    frames = spark.range(900).select((F.col("id") / 3).cast("long").alias("recording_id"), F.format_string("f_%04d.json", i + 1).alias("file"), i.alias("source_idx"), (i * 250.0).alias("time_ms"), lines.alias("lines"))
    assert bundles.write_caches(frames, str(tmp_path / "out")).count() == 900
    written = [f for _, _, names in os.walk(tmp_path / "out") for f in names if f.startswith("part-")]
    assert len(written) <= 8
    back, seen = bundles.cached_observations(spark, str(tmp_path / "out"))
    assert seen.count() == 900 and {tuple(r) for r in back.groupBy("recording_id").count().select("count").distinct().collect()} == {(3,)}


def test_anchors_keep_numbers_and_no_texts(spark):
    import random

    from reelscribe.plans import scroll

    texts = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=4000)) for i in range(60)]
    seen = [(r, k, i, texts[i], 0.0, 200.0 + 100 * i - 37 * k, 100.0, 30.0) for r in range(3) for k in range(2) for i in range(60)]
    obs = spark.createDataFrame(seen, "recording_id long, frame_idx int, line_no int, text string, x double, y double, w double, h double")
    found = scroll.analyse(obs, obs.select("recording_id", "frame_idx").distinct(), fuzzy=False)
    assert {tuple(r) for r in found.shifts.select("shift", "votes", "total").distinct().collect()} == {(37.0, 60, 60)}

    def size(table):
        folder = table.kept_path.removeprefix("file:")
        return sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))

    assert size(found.lines) + size(found.exact) < sum(map(len, texts)) / 2


def test_a_transcript_is_dealt_once(spark):
    from reelscribe.operators import rows

    data = [(1, ["late", "part"], 5.0, 40.0, (40.0, 5.0, 0, 1)), (1, ["first"], 9.0, 10.0, (10.0, 9.0, 0, 0)), (None, ["lost"], 0.0, 0.0, (0.0, 0.0, 0, 0)), (1, ["left"], 1.0, 20.0, (20.0, 1.0, 0, 2))]
    lines = spark.createDataFrame(data, "recording_id long, parts array<string>, x double, gy double, group_rank struct<gy: double, x: double, frame_idx: int, line_no: int>")
    got = rows.render_plain(lines)
    assert {tuple(r) for r in got.collect()} == {(1, "left first\nlate part"), (None, "lost")}
    assert got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("Initial Plan")[0].count("Exchange") <= 2


def test_a_stitch_plan_loads_pixels_where_they_are_looked_at(spark):
    from reelscribe.plans import scroll
    from reelscribe.plans.stitch import StitchPlan, band_sums

    at = [(r, i, 400 + (240 + 24 * r) * i + (2400 if i > 300 else 0)) for r, n in ((1, 270), (2, 6), (3, 1)) for i in range(n)]
    rows = [(r, i, *scroll.screen_pixels(r, p)) for r, i, p in at]
    held = StitchPlan(spark.createDataFrame(rows, "recording_id long, frame_idx int, data binary, width int, height int"))
    asked = spark.createDataFrame([(r, i, p, 4 * 8 * 1040, 8, 1040) for r, i, p in at], "recording_id long, frame_idx int, position long, octets int, width int, height int")
    light = StitchPlan(asked, load=scroll.screen_data, source=["recording_id", "position"])
    found = []
    for plan in (held, light):
        assert plan.shifts.count() == 269 + 5
        placed = plan.placed
        found.append(sorted(map(str, plan.summary(placed).join(band_sums(plan.bands(placed)), "recording_id", "left").collect())))
        assert sorted(plan.checksums(placed).collect()) == sorted(band_sums(plan.bands(placed)).collect())
    assert found[0] == found[1] and len(found[0]) == 3
