"""Known cases of text layout, chat bubbles, planning, checks and bundles."""

import json

import pytest
from pyspark.sql import functions as F

from reelscribe.constants import ANCHOR_PARTS, SHIFT_PARTS
from reelscribe.functions.geometry import band, bubble_colour, containment
from reelscribe.functions.text import cache_file, edit_distance, normalized, score_normalized, utf16_length
from reelscribe.operators import bubbles, checks, dedupe, planning, rows
from reelscribe.sources import bundles

LINES = "recording_id long, line_no int, text string, x double, y double, side string"


def lines(spark, rows_):
    return spark.createDataFrame([(1, i, t, float(x), float(y), s) for i, (t, x, y, s) in enumerate(rows_)], LINES)


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_scalars(spark):
    lit = F.lit
    assert one(spark, normalized(lit("a，b 。c　d…\"'“"))) == "abcd“" and one(spark, score_normalized(lit("“a”"))) == "a"
    pairs = [("", "", 0), ("牛a", "羊a", 1), ("abcdef", "abxdef", 1), ("aaaa", "aa", 2), ("kitten", "sitting", 3), ("x" * 40_000, "x" * 20_000 + "y" + "x" * 19_999, 1), ("ab", "", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, wanted int")
    assert [r.far for r in edit_distance(df, "a", "b", "far").collect()] == [n for *_, n in pairs]
    assert [r.far for r in edit_distance(df, "a", "b", "far", "1").collect()] == [n if n <= 1 else -1 for *_, n in pairs]
    assert (one(spark, utf16_length(lit("A牛😀"))), one(spark, F.octet_length(lit("A牛😀")))) == (4, 8)
    assert [one(spark, band(lit(y))) for y in (-50.0, 9.9, 10.0, 101.0)] == [-2, 0, 1, 5]
    assert one(spark, cache_file(lit("f_0001.JPEG"))) == "f_0001.json"
    with pytest.raises(Exception, match="not a frame name"):
        one(spark, cache_file(lit("frame.jpg")))
    box = spark.sql("SELECT struct(0D AS x, 0D AS gy, 10D AS w, 10D AS h) a, struct(5D AS x, 0D AS gy, 10D AS w, 10D AS h) b, struct(1D AS x, 1D AS gy, 0D AS w, 5D AS h) c")
    assert tuple(box.select(containment("a", "b"), containment("a", "c")).first()) == (0.5, 0.0)


def test_bubble_colour(spark):
    cases = [(100, 200, 100), (240, 240, 240), (250, 250, 250), (245, 250, 250), (100, 140, 100), (None, 1, 1)]
    df = spark.createDataFrame(cases, "r int, g int, b int")
    got = [r.s for r in df.select(bubble_colour(*(F.col(c).cast("double") for c in "rgb")).alias("s")).collect()]
    assert got == ["self", "system", "other", "system", "system", "system"]


def test_spatial_dedupe_bounds(spark):
    def texts(dx, dy):
        return [r.text for r in dedupe.spatial_dedupe(lines(spark, [("ab", 0, 0, "self"), ("abc", dx, dy, "self")])).collect()]

    assert texts(39, 19) == ["abc"] and len(texts(0, 20)) == 2 and len(texts(40, 0)) == 2


def test_repeated_lines_within_the_window(spark):
    said = ["a long line", "short", "other line one", "other line two", "a long line", "short", "other line two"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "recording_id long, line_no int, text string")
    got = [r.line_no for r in dedupe.text_dedupe(df, ["recording_id"], 8, 2).orderBy("line_no").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6]
    assert [r.line_no for r in dedupe.text_dedupe(df, ["recording_id"]).orderBy("line_no").collect()] == [0, 1, 2, 3, 5]


def messages(spark, rows_):
    got = rows.chat_messages(lines(spark, rows_)).orderBy("island", "message_no").collect()
    return [(r.side, r.text) for r in got]


def test_chat_messages(spark):
    assert messages(spark, [("a", 0, 0, "self"), ("b", 59, 61, "self"), ("x", 0, 70, "system"), ("12:30", 0, 90, "other"), ("c", 0, 100, "other")]) == [("self", "ab"), ("other", "c")]
    assert messages(spark, [("a", 400, 0, "self"), ("b", 450, 30, "self"), ("c", 500, 60, "self")]) == [("self", "ab"), ("self", "c")]
    assert len(messages(spark, [("a", 0, 0, "self"), ("b", 0, 62, "self"), ("c", 60, 100, "self")])) == 3


def test_both_sides_may_say_the_same(spark):
    text = "the same long sentence"
    out = rows.format_chat(lines(spark, [(text, 0, 0, "self"), (text, 0, 100, "other"), (text, 0, 200, "self")])).first().markdown
    assert out == f"[我] {text}\n[对方] {text}"


def test_format_plain(spark):
    out = rows.format_plain(lines(spark, [("right", 90, 5, "self"), ("left", 0, 0, "self"), ("next row here", 0, 40, "self"), ("next row here", 0, 80, "self")])).first().markdown
    assert out == "left right\nnext row here"


BUBBLE = "recording_id long, seq int, frame_idx int, text string, x double, y double, w double, h double, gy double"


def bubble(spark, rows_):
    data = [(1, i, 1, t, float(x), float(gy % 1000), float(w), float(h), float(gy)) for i, (t, x, gy, w, h) in enumerate(rows_)]
    return spark.createDataFrame(data, BUBBLE)


BASE = [("left a", 134, 0, 200, 30), ("left b", 134, 100, 210, 30), ("right a", 385, 200, 200, 30), ("right b", 335, 300, 250, 30)]


def test_peaks_ignore_the_middle_and_single_characters(spark):
    single = [("x", 50, 500 + i, 10, 30) for i in range(5)]
    middle = [("middle", 300, 600 + i, 20, 30) for i in range(3)]  # begins right of the middle and ends there once less
    r = bubbles.align_peaks(bubble(spark, BASE[2:] * 2 + BASE + single + middle)).first()
    assert (r.left_peak, r.right_peak) == (134.0, 585.0)
    assert bubbles.align_peaks(bubble(spark, [("a", 1, 1, 1, 1)])).first().left_peak is None


def test_sides_samples_and_requests(spark):
    df = bubble(spark, BASE + [("both", 134, 400, 451, 40)])
    found = bubbles.bubble_rows(df)
    labels = bubbles.numbered_bubbles(bubbles.bubble_labels(found))
    got = {r.text: (r.label, r.kind) for r in labels.collect()}
    assert got == {"left a": ("them", "definite-left"), "left b": ("them", "definite-left"), "right a": ("me", "definite-right"), "right b": ("me", "definite-right"), "both": (None, "pixel-pending")}
    frames = spark.createDataFrame([(1, 1, "f.jpg")], "recording_id long, frame_idx int, uri string")
    (r,) = bubbles.region_requests(labels, frames).collect()
    assert (r.id, r.uri, r.x, r.y, r.width, r.height) == ("bubble-4", "f.jpg", 134, 400, 451, 40)
    with pytest.raises(Exception, match="no frame file"):
        bubbles.region_requests(labels, frames.where("false")).collect()
    none = spark.createDataFrame([], "recording_id long, id string, side string, error string")
    missing = {r.text: r for r in bubbles.resolved_bubbles(labels, none).collect()}["both"]
    assert (missing.label, missing.error, missing.warned) == (None, "E_RESULT_MISSING", True)
    said = spark.createDataFrame([(1, "bubble-4", "me", None)], "recording_id long, id string, side string, error string")
    resolved = bubbles.resolved_bubbles(labels, said)
    text = bubbles.chat_transcript(resolved, bubbles.message_segments(found)).first().markdown
    assert text == "[对方] left a\n[对方] left b\n[我] right a\n[我] right b\n[我] both"
    stats = bubbles.speaker_stats(resolved, bubbles.message_segments(found)).first()
    assert (stats.dual, stats.pixel_resolved, stats.pixel_me, stats.pixel_unresolved) == (1, 1, 1, 0)


def test_nicknames(spark):
    named = BASE + [("Ann", 114, 1000, 60, 20), ("hello there", 134, 1046, 180, 30), ("Bob", 114, 1100, 60, 20), ("wide text", 124, 1146, 180, 34)]
    found = bubbles.bubble_rows(bubble(spark, named))
    got = [(r.nickname, r.body, r.kind) for r in bubbles.message_segments(found).where("nickname is not null").orderBy("segment_no").collect()]
    assert got == [("Ann", "hello there", "separate-top-line"), ("Bob", "wide text", "separate-top-line-wide-body")]
    assert bubbles.message_segments(found, wide_body=False).where("nickname is not null").count() == 1
    assert bubbles.message_segments(found, internal=False).where("nickname is not null").count() == 1
    labels = bubbles.numbered_bubbles(bubbles.bubble_labels(found))
    none = spark.createDataFrame([], "recording_id long, id string, side string, error string")
    text = bubbles.chat_transcript(bubbles.resolved_bubbles(labels, none), bubbles.message_segments(found)).first().markdown
    assert "[Ann] hello there\n[Bob] wide text" in text


def test_plans(spark):
    df = spark.createDataFrame([(1, 26980.356), (2, 32030.989)], "recording_id long, duration_ms double")
    for stride, counts in ((1, (108, 128)), (7, (16, 19)), (5, (22, 26)), (3, (36, 43))):
        got = planning.frame_plan(df, 4, stride).where("selected").groupBy("recording_id").count().orderBy("recording_id").collect()
        assert tuple(r["count"] for r in got) == counts
    assert planning.frame_plan(df, 4, 5, capture_all=True).where("extracted").count() == 236
    assert one(spark, planning.uniform_times(F.lit(1001.0), F.lit(3))) == [0, 500, 1000] and one(spark, planning.uniform_times(F.lit(1001.0), F.lit(1))) == [0]
    images = spark.createDataFrame([("a", 5107), ("b", 13558)], "image_id string, total_height int")
    got = {(r.image_id, r.segment): (r.top, r.height) for r in planning.ocr_segments(images).collect()}
    assert len(got) == 17 and got["a", 4] == (4800, 307) and got["b", 11] == (13200, 358)
    assert one(spark, planning.stride_for_gap(F.lit(4.0), F.lit(1250.0))) == 5


def test_reconciliation(spark):
    def warn(total, parts, names):
        df = spark.createDataFrame([(1, float(total), dict(zip(names, map(float, parts))))], "id int, total_ms double, parts map<string,double>")
        return checks.reconcile(df, ["id"], names).first()

    assert warn(1000, [850, 0, 0, 0, 0, 0], SHIFT_PARTS).should_warn
    assert not warn(20000, [19800, 0, 0, 0, 0, 0, 0], ANCHOR_PARTS).should_warn
    with pytest.raises(Exception, match="non-negative"):
        warn(1000, [-1, 0, 0, 0, 0, 0], SHIFT_PARTS)


def test_policies(spark):
    lit, arr = F.lit, lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [one(spark, checks.default_engine(lit(p))) for p in ("android", "ios")] == ["anchor", "stitch"]
    assert one(spark, checks.status(arr("w"), lit(None))) == "warning" and one(spark, checks.status(arr(), lit(None))) == "ok"
    assert one(spark, checks.offers_retry(lit("anchor"), lit("ok"), lit(2))) and not one(spark, checks.offers_retry(lit("stitch"), lit("warning"), lit(2)))
    assert one(spark, checks.empty_failure(lit(" \n"), arr())) and not one(spark, checks.empty_failure(lit(""), arr("w")))


def report(**changes):
    stats = {
        "app": "chat", "durationMs": 26980, "screenAwakeRequested": True, "fps": 4, "anchorPairCount": 21, "anchorPassedCount": 21, "stride": 5, "maxAnchorGapMs": 1250,
        "anchorDetails": [{"fuzzyCandidateVotes": 0, "fuzzyCandidateTotal": 0, "fuzzyCandidateVoteRatio": None}] * 21, "sourceFrameCount": 108, "extractedFrameCount": 22,
        "frameCount": 22, "ocrCaptureEnabled": False, "ocrCapturedFrameCount": 22, "dedupeCandidateGroups": 50, "dedupeMajorityChosen": 20, "dedupeChangedSelection": 4,
        "sampleRegionCount": 13, "sampleUnresolvedCount": 0, "decodedPixels": 200000, "frameExtractionMethod": "MediaMetadataRetriever.OPTION_CLOSEST", "nativeFrameExtractMs": 100,
        "nativeFrameExtractPerFrameMs": 4.5, "timingDeltaMs": 2, "timingThresholdMs": 100, "cleanupAttemptCount": 1, "remainingTempFileCount": 0, "nativeStaleTempFileCount": 0,
        "nativeStaleTempFileDeletedCount": 0,
    }
    row = {"report_id": 1, "engine": "anchor", "status": "ok", "mode": "chat", "total_ms": 9000} | {k: v for k, v in changes.items() if k not in stats}
    return row | {"stats": json.dumps(stats | {k: v for k, v in changes.items() if k in stats})}


@pytest.mark.parametrize(
    "changes, broken",
    [
        ({}, []), ({"engine": "stitch"}, ["engine"]), ({"status": "warning"}, ["warning"]), ({"status": "failed"}, ["failed"]), ({"total_ms": 40001}, ["ceiling"]),
        ({"anchorPassedCount": 20}, ["anchor_passed"]), ({"sourceFrameCount": 107}, ["source_frames"]), ({"ocrCaptureEnabled": True}, ["capture"]),
        ({"sampleUnresolvedCount": 1}, ["speakers"]), ({"remainingTempFileCount": 1}, ["temp_files"]), ({"nativeFrameExtractPerFrameMs": 9.0}, ["per_frame_time"]),
    ],
)
def test_reports(spark, changes, broken):
    schema = "report_id int, engine string, status string, mode string, total_ms int, stats string"
    got = checks.report_violations(spark.createDataFrame([report(**changes)], schema)).first().violations
    assert got == broken


def test_scores(spark):
    schema = "run_id long, msg_no int, who string, text string"
    truth = spark.createDataFrame([(1, 0, "me", "hello there"), (1, 1, "them", "good morning"), (1, 2, "me", "[图片]"), (1, 3, "me", "[图片][图片]")], schema)
    said = spark.createDataFrame([(1, 0, "them", "good morning"), (1, 1, "me", "hello, there")], schema)
    r = checks.transcript_scores(truth, said).first()
    assert (r.n_truth, r.n_matched, r.n_exact, r.n_speaker, r.in_order) == (3, 2, 2, 2, False)
    raw = spark.createDataFrame([(1, 0, "[我] hi"), (1, 1, "noise"), (1, 2, " [them]  yo ")], "run_id long, line_no int, line string")
    assert [(r.who, r.text) for r in checks.tagged_messages(raw).orderBy("msg_no").collect()] == [("me", "hi"), ("them", "yo")]


def frame(i, **changes):
    line = {"text": "t", "x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0, "conf": None}
    return {"file": f"f_{i + 1:04d}.json", "sourceIndex": i, "timeMs": 250.0 * i, "lines": [line]} | changes


def test_bundles(spark, tmp_path):
    def write(name, frames, **stats):
        base = {"formatVersion": 1, "fps": 4, "sourceFrameCount": 2, "capturedFrameCount": 2, "capturesEverySourceFrame": True}
        (tmp_path / f"{name}.json").write_text(json.dumps({"formatVersion": 1, "stats": base | stats, "frames": frames}))

    write("good", [frame(0), frame(1)])
    write("short", [frame(0)])
    write("order", [frame(0), frame(1, file="f_0003.json")])
    write("time", [frame(0), frame(1, timeMs=0.0)])
    write("lines", [frame(0), frame(1, lines=[{"text": "", "x": 1, "y": 1, "w": 1, "h": 1}])])
    df = bundles.read_bundles(spark, str(tmp_path))
    got = {r.bundle.split('/')[-1][:-5]: r.violations for r in bundles.bundle_violations(df).collect()}
    assert got == {"good": [], "short": ["completeness", "captured"], "order": ["sequence"], "time": ["time"], "lines": ["lines"]}
    assert bundles.bundle_observations(df.where("bundle like '%/good.json'")).count() == 2
    with pytest.raises(Exception, match="breaks: time"):
        bundles.bundle_observations(df.where("bundle like '%/time.json'")).collect()


def test_recognised_lines_and_caches(spark, tmp_path):
    box = (1.0, 2.0, 30.0, 4.0)
    blocks = [(box, [("  padded ", None, None), ("", 0.5, box), ("own", 0.5, (5.0, 6.0, 7.0, 8.0)), ("flat", 0.5, (1.0, 1.0, 0.0, 1.0))])]
    df = spark.createDataFrame([(1, 0, blocks)], f"recording_id long, frame_idx int, blocks {bundles.RESULT}")
    got = [tuple(r)[2:] for r in bundles.recognised_lines(df).orderBy("line_no").collect()]
    assert got == [(0, "padded", 1.0, 2.0, 30.0, 4.0, None), (1, "own", 5.0, 6.0, 7.0, 8.0, 0.5)]
    frames = spark.createDataFrame([(1, "f_0001.jpg", 0, 0.0, [("t", 1.0, 2.0, 3.0, 4.0, None)]), (1, "f_0002.png", 1, 250.0, [])], f"recording_id long, name string, source_idx int, time_ms double, lines {bundles.LINES}")
    out = bundles.cache_exports(frames).orderBy("file").collect()
    assert [r.file for r in out] == ["f_0001.json", "f_0002.json"] and json.loads(out[0].content)[0]["conf"] is None
    for r in out:
        (tmp_path / r.file).write_text(r.content)
    back = bundles.read_frame_caches(spark, str(tmp_path), "r").collect()
    assert [(r.frame_idx, r.line_no, r.text) for r in back] == [(0, 0, "t")]
    twice = frames.withColumn("name", F.lit("f_0001.jpg"))
    with pytest.raises(Exception, match="bad frame"):
        bundles.cache_exports(twice).collect()
    stats = bundles.export_stats(frames, spark.createDataFrame([(1, 2)], "recording_id long, source_frames int")).first()
    assert (stats.captured_frames, stats.ocr_lines, stats.null_confidence, stats.captures_every_source_frame) == (2, 1, 1, True)


def test_frames_without_lines_are_frames(spark, tmp_path):
    from reelscribe.operators import bands

    head = '[{"text": "head", "x": 1, "y": 100, "w": 9, "h": 9, "conf": null}]'
    for folder in ("one", "deep/one"):
        (tmp_path / folder).mkdir(parents=True)
        for i in range(6):
            (tmp_path / folder / f"f_{i:04d}.json").write_text(["[]", " [ ]\\n"][i // 2 % 2] if i in (1, 3) else head)
    frames, seen = bundles.frame_caches(spark, str(tmp_path))
    assert sorted(tuple(r) for r in frames.groupBy("recording_id").count().collect()) == [("deep/one", 6), ("one", 6)]
    assert seen.count() == 8 and bands.fixed_bands(seen, frames).count() == 0
    frames, seen = bundles.frame_caches(spark, str(tmp_path), stride=2)
    assert [r.frame_idx for r in frames.where("recording_id = 'one'").orderBy("file").collect()] == [0, 1, 2]
    assert {tuple(r) for r in bands.fixed_bands(seen, frames).select("hits", "frames").collect()} == {(3, 3)}
    (tmp_path / "one" / "f_0009.json").write_text("{}")
    with pytest.raises(Exception, match="no JSON array"):
        bundles.frame_caches(spark, str(tmp_path))[1].collect()


def test_caches_come_back_and_a_filled_target_is_refused(spark, tmp_path):
    rows = [(1, "f_0001.json", 0, 0.0, [("a\n\"b", 1.0, 2.5, 3.0, 4.0, None)]), (1, "f_0002.json", 1, 250.0, []), (2, "f_0001.json", 0, 0.0, None), (None, "f_0001.json", 0, 0.0, [("é", 0.0, 0.0, 1.0, 1.0, 0.5)])]
    frames = spark.createDataFrame(rows, f"recording_id long, file string, source_idx long, time_ms double, lines {bundles.LINES}")
    (tmp_path / "out").mkdir()
    sizes = {(r.recording_id, r.file): r.bytes for r in bundles.write_caches(frames, str(tmp_path / "out")).collect()}
    assert sizes[("1", "f_0002.json")] == sizes[("2", "f_0001.json")] == 2 and len(sizes) == 4
    back, lines = bundles.cached_observations(spark, str(tmp_path / "out"))
    assert back.count() == 4
    got = {(r.recording_id, r.frame_idx, r.text, r.y, r.conf) for r in lines.collect()}
    assert got == {("1", 0, 'a\n"b', 2.5, None), (None, 0, "é", 0.0, 0.5)}
    with pytest.raises(ValueError, match="not empty"):
        bundles.write_caches(frames, str(tmp_path / "out"))
    assert bundles.written_caches(spark, str(tmp_path / "out")).count() == 4


def test_bundles_are_imported_whole_or_not_at_all(spark, tmp_path):
    def bundle(folder, times):
        lines = [{"text": "t", "x": 1, "y": 2, "w": 3, "h": 4, "conf": None}]
        frames = [{"file": f"f_{i + 1:04d}.json", "sourceIndex": i, "timeMs": t, "lines": lines if i else []} for i, t in enumerate(times)]
        stats = {"formatVersion": 1, "fps": 4, "sourceFrameCount": len(times), "capturedFrameCount": len(times), "capturesEverySourceFrame": True}
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "b.json").write_text(json.dumps({"formatVersion": 1, "stats": stats, "frames": frames}))

    import json

    bundle("a", [0, 250])
    bundle("c", [0, 250, 500])
    read = bundles.read_bundles(spark, str(tmp_path / "in"))
    found = bundles.import_bundles(read, str(tmp_path / "out"))
    assert found.groupBy("recording_id").count().count() == 2 and found.count() == 5
    bundle("bad", [0, 0])
    with pytest.raises(Exception, match="breaks: time"):
        bundles.import_bundles(bundles.read_bundles(spark, str(tmp_path / "in")), str(tmp_path / "other"))
    assert not list((tmp_path / "other").rglob("part-*")) if (tmp_path / "other").exists() else True


def test_capture_guards_name_the_first_fault(spark):
    wanted = spark.createDataFrame([(r, i, 250.0 * i) for r in range(5) for i in range(3)], "recording_id int, idx int, time_ms double")
    rows = [(r, i, f"f{i}", 720.0, 1600.0, 250.0 * i) for r in range(5) for i in range(3) if (r, i) != (1, 2)] + [(9, 0, "f0", 1.0, 1.0, 0.0)]
    rows[rows.index((2, 1, "f1", 720.0, 1600.0, 250.0))] = (2, 1, None, 720.0, 1600.0, 250.0)
    rows[rows.index((3, 2, "f2", 720.0, 1600.0, 500.0))] = (3, 2, "f2", 721.0, 1600.0, 500.0)
    rows[rows.index((4, 0, "f0", 720.0, 1600.0, 0.0))] = (4, 0, "f0", 720.0, float("nan"), 0.0)
    schema = "recording_id int, idx int, uri string, width double, height double, requested_ms double"
    captured = spark.createDataFrame(rows, schema)
    got = {r.recording_id: (r.rule, r.idx) for r in checks.capture_faults(wanted, captured).collect()}
    assert got == {1: ("count", 0), 2: ("invalid", 1), 3: ("size", 2), 4: ("invalid", 0), 9: ("count", 0)}
    assert checks.checked_captures(wanted.where("recording_id = 0"), captured.where("recording_id = 0")).count() == 3
    with pytest.raises(Exception, match="recording 3, frame 2: size"):
        checks.checked_captures(wanted.where("recording_id = 3"), captured.where("recording_id = 3")).collect()
    assert checks.capture_faults(wanted, captured.where("false")).count() == 5


@pytest.mark.parametrize("left,right,at", [(b"", b"", -1), (b"abc", b"abc", -1), (b"abc", b"abd", 2), (b"abc", b"ab", 2), (b"", b"x", 0), (None, b"x", None), (b"\xff" * 999 + b"a", b"\xff" * 999 + b"b", 999)])
def test_first_difference(spark, left, right, at):
    from pyspark.sql import functions as F

    from reelscribe.functions.text import first_difference

    assert spark.createDataFrame([(left, right)], "a binary, b binary").select(first_difference(F.col("a"), F.col("b"))).first()[0] == at


def test_a_cut_that_would_lose_text_is_not_made(spark):
    rows = [(1, 0, 0, 0, 0, 0, "Ann", 114.0, 0.0, 40.0, 20.0, 0.0, True, False, 134.0), (1, 0, 0, 1, 1, 0, "hello", 134.0, 50.0, 100.0, 30.0, 50.0, True, False, 134.0)]
    names = "recording_id int, island int, group_no int, row_no int, seq int, frame_idx int, text string, x double, y double, w double, h double, gy double, left_hit boolean, right_hit boolean, left_peak double"
    whole = bubbles.message_segments(spark.createDataFrame(rows, names)).collect()
    assert [(r.text, r.nickname, r.body) for r in whole] == [("Annhello", "Ann", "hello")]
    lost = [(*rows[0][:6], None, *rows[0][7:]), rows[1]]
    assert [(r.text, r.nickname) for r in bubbles.message_segments(spark.createDataFrame(lost, names)).collect()] == [("hello", None)]
