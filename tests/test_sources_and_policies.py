"""Known cases of colour channels, local sources, the label policy without frames, and presets."""

import pytest
from pyspark.sql import functions as F

from reelscribe.functions.geometry import bubble_colour, rgb_channels
from reelscribe.functions.text import local_path
from reelscribe.operators import bubbles, planning

from .test_layout_rules import BASE, bubble


def channels(spark, rows, kind):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(rows)], f"i int, colour {kind}")
    found = rgb_channels(F.col("colour"), df.schema["colour"].dataType)
    return [tuple(r[1:]) for r in df.select("i", *(c.alias(n) for n, c in zip("rgb", found))).orderBy("i").collect()]


def test_channels_of_every_form(spark):
    assert channels(spark, [[1.0, 2.0, 3.0, 9.0], [1.0], [None, 2.0, 3.0], None, []], "array<double>") == [
        (1, 2, 3), (1, None, None), (None, 2, 3), (None, None, None), (None, None, None),
    ]
    assert channels(spark, [{"r": 1, "g": 2, "b": 3}, {"r": 1, "x": 5}, None], "map<string, int>") == [(1, 2, 3), (1, None, None), (None, None, None)]
    assert channels(spark, [(3.0, 1.0), None], "struct<b: double, r: double>") == [(1, None, 3), (None, None, None)]
    texts = ["[1, 2.5, 3]", '{"b":3,"g":2,"r":1}', '{"r":"dark","g":"7"}', "[", "", None]
    assert channels(spark, texts, "string") == [(1, 2.5, 3), (1, 2, 3), (None, 7, None)] + [(None, None, None)] * 3
    with pytest.raises(TypeError, match="no colour"):
        rgb_channels(F.col("x"), spark.range(1).schema["id"].dataType)


def test_a_colour_without_a_channel_is_of_no_side(spark):
    df = spark.createDataFrame([([0.0, 90.0, 20.0],), ([0.0, 90.0],), (None,)], "colour array<double>")
    assert [r.s for r in df.select(bubble_colour(*rgb_channels(F.col("colour"), df.schema["colour"].dataType)).alias("s")).collect()] == ["self", "system", "system"]


SOURCES = {
    "/a/b.mp4": ("/a/b.mp4", "/a/b.mp4"), "a/b": (None, None), "": (None, None), "file:///a%20b+c": ("/a b+c", "/a b+c"), "file:/a": ("/a", "/a"), "file:a": (None, None),
    "file://host": (None, None), "file://host/a?q#f": ("/a", "/a"), "content://m/1": ("content://m/1", None), "content:x": ("content:x", None), "https://h/a": (None, None),
    "FILE:///a": (None, None), "/a:b": (None, None), "/a#b": ("/a", "/a"), ":/a": (None, None), "file:///a%zz": (None, None), None: (None, None),
}


def test_local_sources(spark):
    df = spark.createDataFrame([(s,) for s in SOURCES], "s string")
    got = {r.s: (r.v, r.i) for r in df.select("s", local_path(F.col("s"), provider=True).alias("v"), local_path(F.col("s")).alias("i")).collect()}
    assert got == SOURCES
    long = "/" + "x" * 300_000
    assert spark.createDataFrame([(long,)], "s string").select(local_path(F.col("s"))).first()[0] == long


def test_geometry_policy(spark):
    wide = [("one row", 134, 400, 451, 40), ("row 1", 134, 600, 451, 30), ("row 2", 134, 630, 451, 30), ("same band 1", 134, 800, 451, 30), ("same band 2", 134, 805, 451, 30)]
    rows = bubbles.bubble_rows(bubble(spark, BASE + wide))
    found = {r.text: (r.label, r.kind, r.sample) for r in bubbles.bubble_labels(rows, "geometry").collect()}
    assert found["one row"] == ("them", "double-default-left", None) and found["row 1row 2"] == ("me", "weak-right-repeat", None)
    assert found["same band 1same band 2"] == ("them", "double-default-left", None)
    assert found["left a"] == ("them", "definite-left", None) and found["right a"] == ("me", "definite-right", None)
    none = spark.createDataFrame([], "recording_id long, id string, side string, error string")
    stats = bubbles.speaker_stats(bubbles.resolved_bubbles(bubbles.numbered_bubbles(bubbles.bubble_labels(rows, "geometry")), none), bubbles.message_segments(rows)).first()
    assert (stats.dual, stats.pixel_unresolved, stats.pixel_errors) == (0, 0, 0)
    assert bubbles.bubble_labels(rows.where("false"), "geometry").count() == 0
    with pytest.raises(ValueError, match="unknown policy"):
        bubbles.bubble_labels(rows, "guess")


def test_presets_and_thumbnails(spark):
    runs = spark.createDataFrame([(1, 2000.0, "chat"), (2, 1.0, "generic")], "recording_id long, duration_ms double, preset string")
    made = planning.preset_requests(runs).collect()
    frames = [(r.idx, r.time_ms, r.quality) for r in made if r.recording_id == 1 and r.purpose == "keyframe"]
    assert frames == [(0, 0.0, 1.0), (5, 1250.0, 1.0)]
    assert sorted(r.time_ms for r in made if r.recording_id == 1 and r.purpose == "prescan")[-1] == 1999.0
    assert [sum(r.recording_id == i and r.purpose == "prescan" for r in made) for i in (1, 2)] == [12, 24]
    assert {r.mode for r in made if r.recording_id == 2} == {"plain"}
    assert planning.preset_requests(runs.where("false")).count() == 0
    for preset in ("none", None):
        with pytest.raises(Exception, match="unknown preset"):
            planning.with_presets(spark.createDataFrame([(1, preset)], "recording_id long, preset string")).collect()
    for purpose, time in (("print", 1.0), (None, 1.0), ("shift", -1.0), ("shift", None), ("shift", float("nan"))):
        with pytest.raises(Exception, match="unknown purpose, or no time"):
            planning.thumbnail_requests(spark.createDataFrame([(purpose, time)], "purpose string, time_ms double")).collect()
