"""Known cases of the anchor rules: bands, votes, fuzzy anchors, self-check, merging and plain rows."""

import random

import pytest
from pyspark.sql import functions as F

from reelscribe.operators import anchors, bands, dedupe, placement, rows
from reelscribe.plans import scroll

OBS = "recording_id long, frame_idx int, line_no int, text string, x double, y double, w double, h double"


def observations(spark, frames, x=0.0, w=100.0, h=30.0):
    out = []
    for k, lines in enumerate(frames):
        for n, line in enumerate(lines):
            text, y, *rest = line
            out.append((1, k, n, text, float(rest[0] if rest else x), float(y), float(rest[1] if len(rest) > 1 else w), h))
    return spark.createDataFrame(out, OBS), spark.createDataFrame([(1, k) for k in range(len(frames))], "recording_id long, frame_idx int")


def shift_of(spark, before, after, fuzzy=True):
    obs, frames = observations(spark, [before, after])
    lines = anchors.anchor_lines(obs, spark.createDataFrame([], "recording_id long, band long"))
    exact = anchors.exact_anchors(lines)
    near = anchors.fuzzy_anchors(lines, exact) if fuzzy else exact.where("false")
    return anchors.shifts(frames, exact, near).first()


def test_four_of_five_frames_fix_a_band(spark):
    frames = [[("a", 101)], [("b", 102)], [], [("c", 103)], [("d", 104)]]
    obs, every = observations(spark, frames)
    assert [(r.band, r.hits, r.frames) for r in bands.fixed_bands(obs, every).collect()] == [(5, 4, 5)]
    assert bands.fixed_bands(*observations(spark, frames[:3] + [[], []])).count() == 0


def test_vote_takes_the_upper_median_of_the_largest_cluster(spark):
    lists = [[20.0, 26.0, 23.0, 100.0], [5.0, 50.0], [1.0, 2.0, 3.0, 4.0]]
    df = spark.createDataFrame([(i, d) for i, ds in enumerate(lists) for d in ds], "k int, diff double")
    got = anchors.votes(df, ["k"]).select("k", anchors.upper_median(F.col("best.members")), "best.votes", "total", "runner_up").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(0, 23.0, 3, 4, 1), (1, 5.0, 1, 2, 1), (2, 3.0, 4, 4, None)]


LONG = "the quick brown fox number "


def test_fuzzy_anchors_add_votes_but_do_not_move_exact_ones(spark):
    before = [("exact one", 500), ("exact two", 540), ("exact three", 580), (LONG + "aaaa", 620), (LONG[::-1] + "bbbb", 700)]
    after = [("exact one", 400), ("exact two", 440), ("exact three", 480), (LONG + "aaax", 521), (LONG[::-1] + "bbbx", 300)]
    r = shift_of(spark, before, after)
    assert (r["shift"], r.exact_total, r.fuzzy_candidates, r.fuzzy_accepted, r.fuzzy_rejected, r.votes, r.total) == (100.0, 3, 2, 1, 1, 4, 4)
    assert not r.fuzzy_rescue and r.candidate_total == 0


def distinct(n):
    return ["".join(random.Random(i).choices("abcdefghij", k=24)) for i in range(n)]


@pytest.mark.parametrize("agree, stray, shift, votes, total", [(3, 0, 120.0, 3, 3), (2, 0, 0.0, 0, 0), (3, 1, 120.0, 3, 4), (3, 3, 0.0, 0, 0)])
def test_fuzzy_rescue_needs_three_and_a_clear_share(spark, agree, stray, shift, votes, total):
    texts = distinct(agree + stray)
    before = [(t, 200 + 40 * i) for i, t in enumerate(texts)]
    after = [(t[:-1] + "x", 200 + 40 * i - (120 if i < agree else 500)) for i, t in enumerate(texts)]
    r = shift_of(spark, before, after)
    assert (r["shift"], r.votes, r.total, r.fuzzy_rescue) == (shift, votes, total, shift > 0)
    assert shift_of(spark, before, after, fuzzy=False).total == 0


def test_a_repeated_earlier_line_anchors_nothing(spark):
    r = shift_of(spark, [("same text", 300), ("same text", 400)], [("same text", 200)])
    assert (r.exact_total, r.fuzzy_candidates) == (0, 0)  # two equally good partners cancel each other
    assert shift_of(spark, [("same text", 300)], [("same text", 200), ("same text", 250)]).exact_total == 2


def test_self_check(spark):
    rows_ = [(0, 0, 0, 0), (1, 2, 0, 0), (1, 5, 0, 0), (2, 5, 0, 0), (0, 0, 1, 2)]
    df = spark.createDataFrame([(1, i, 0.0, *r) for i, r in enumerate(rows_)], "recording_id long, pair_idx int, shift double, votes long, total long, candidate_votes long, candidate_total long")
    assert [(r.pair_idx, r.reason) for r in placement.anchor_warnings(df).orderBy("pair_idx").collect()] == [
        (0, "no_common_text"), (1, "few_anchors"), (2, "scattered_votes"), (4, "only_unaccepted_fuzzy")
    ]
    segments = placement.cumulative(df).orderBy("pair_idx").select("segment_id").collect()
    assert [r.segment_id for r in segments] == [1, 2, 3, 3, 4]


PLACED = "recording_id long, segment_id long, frame_idx int, line_no int, text string, x double, y double, w double, h double, gy double"


def select(spark, texts, segment=lambda i: 0, x=lambda i: 0.0, frame=lambda i: i, **kw):
    data = [(1, segment(i), frame(i), i, t, x(i), 100.0, 100.0, 30.0, 100.0) for i, t in enumerate(texts)]
    return dedupe.selections(spark.createDataFrame(data, PLACED), **kw).orderBy("group_rank").collect()


def test_sightings_merge_only_on_a_reliable_path(spark):
    assert [r.text for r in select(spark, ["short", "longer text"])] == ["longer text"]
    assert len(select(spark, ["short", "longer text"], segment=lambda i: i)) == 2


def test_majority_wins_over_a_related_longer_text(spark):
    texts = ["common message"] * 3 + ["commons message"]
    r = select(spark, texts)[0]
    assert (r.kind, r.text, r.variant_edit_distance) == ("strict-majority", "common message", 1) and r.variant_similarity > 0.8
    assert select(spark, texts, consensus=False)[0].text == "commons message"


def test_unrelated_and_thin_majorities_are_refused(spark):
    r = select(spark, ["abc", "abc", "abc", "zzzzzzzz"])[0]
    assert (r.kind, r.text, r.variant_similarity) == ("unrelated-majority-rejected", "zzzzzzzz", 0.0)
    assert select(spark, ["abcd", "abcd", "abcde"])[0].text == "abcde"
    r = select(spark, ["a", "b", "b", "b"])[0]
    assert (r.kind, r.text) == ("unrelated-majority-rejected", "a")


def test_fragments_of_a_frame_are_joined(spark):
    data = [(1, 0, k, 0, "hello world", 0.0, 100.0, 200.0, 30.0, 100.0) for k in range(3)]
    data += [(1, 0, 3, 0, "hello ", 0.0, 100.0, 90.0, 30.0, 100.0), (1, 0, 3, 1, "world", 95.0, 100.0, 100.0, 30.0, 100.0)]
    (r,) = dedupe.selections(spark.createDataFrame(data, PLACED)).collect()
    assert (r.n_frames, r.n_composed, r.kind, r.text) == (4, 1, "strict-majority", "hello world")
    stats = dedupe.dedupe_stats(dedupe.selections(spark.createDataFrame(data, PLACED))).first()
    assert (stats.candidate_groups, stats.observations, stats.frame_observations, stats.composed_clusters, stats.majority_chosen) == (1, 5, 4, 1, 1)


def test_whole_analysis(spark):
    before = [("header", 100), ("first line", 300), ("second line", 410), ("third line", 530)]
    after = [("header", 100), ("first line", 200), ("second line", 310), ("third line", 430)]
    obs, frames = observations(spark, [before, after])
    found = scroll.analyse(obs, frames)
    chosen = dedupe.selections(found.content)
    assert found.shifts.first()["shift"] == 100.0 and found.warnings.count() == 0 and chosen.count() == 3
    assert rows.render_plain(chosen).first().markdown == "first line\nsecond line\nthird line"
    assert scroll.run_stats(found, chosen).first().status == "ok"


def test_plain_rows_break_at_a_row_height(spark):
    data = [(1, i, t, x, gy) for i, (t, x, gy) in enumerate([("后", 50.0, 100.0), ("先", 10.0, 117.0), ("新行", 10.0, 118.0)])]
    out = rows.visual_rows(spark.createDataFrame(data, "recording_id long, line_no int, text string, x double, gy double"), "gy")
    assert rows.document(out, ["island", "row_no"]).first().markdown == "先 后\n新行"


def share(a, b):
    wide, high = (max(0, min(a[p] + a[s], b[p] + b[s]) - max(a[p], b[p])) for p, s in (("x", "w"), ("gy", "h")))
    return wide * high / min(a["w"] * a["h"], b["w"] * b["h"])


def brute_sightings(lines):
    """The rule over all earlier groups of all lines, without windows or islands."""
    groups, out = {}, []
    for r in lines:
        near = [g for g, t in groups.items() if abs(t["gy"] - r["gy"]) <= 90 and t["frame_idx"] != r["frame_idx"] and share(t, r) >= 0.6]
        g = max(near) if near else len(groups)
        groups[g] = max(groups.get(g, r), r, key=lambda t: len(t["text"]))
        out.append((r["frame_idx"], r["line_no"], g))
    return out


def test_islands_fold_like_one_fold(spark):
    rng = random.Random(4)
    for _ in range(3):
        lines = [
            {"recording_id": 1, "segment_id": 0, "frame_idx": rng.randrange(6), "line_no": i, "text": "t" * rng.randrange(1, 9), "x": float(rng.choice([0, 20, 200])), "y": 0.0,
             "w": 100.0, "h": 30.0, "gy": float(rng.randrange(2500))}
            for i in range(150)
        ]
        ordered = sorted(lines, key=lambda r: (r["gy"], r["x"], r["frame_idx"], r["line_no"]))
        whole = {}
        for f, n, g in brute_sightings(ordered):
            whole.setdefault(g, set()).add((f, n))
        got = {}
        for r in dedupe.sighting_groups(spark.createDataFrame(lines, PLACED)).collect():
            got.setdefault((r.island, r.group_no), set()).add((r.frame_idx, r.line_no))
        assert sorted(map(sorted, whole.values())) == sorted(map(sorted, got.values()))


def test_one_frame_has_no_fixed_bands_and_no_pairs(spark):
    obs, frames = observations(spark, [[("only line", 200), ("and another", 260)]])
    found = scroll.analyse(obs, frames)
    assert found.fixed.count() == 0 and found.kept_shifts.count() == 0
    assert [r.markdown for r in scroll.plain_transcripts(obs, frames).collect()] == ["only line\nand another"]


def test_null_texts_ids_and_empty_tables(spark):
    obs, frames = observations(spark, [[("line one", 200), ("line two", 260)], [("line one", 150), ("line two", 210)]])
    odd = obs.unionByName(spark.createDataFrame([(1, 1, 9, None, 0.0, 300.0, 10.0, 10.0), (None, 0, 0, "lost", 0.0, 10.0, 10.0, 10.0)], OBS))
    found = scroll.analyse(odd, frames)
    assert {r.text for r in found.content.where("recording_id = 1").collect()} == {"line one", "line two"}
    assert found.kept_shifts.first()["shift"] == 50.0
    none = scroll.analyse(obs.where("false"), frames.where("false"))
    assert none.kept_shifts.count() == 0 and dedupe.selections(none.content).count() == 0
    assert rows.format_plain(obs.where("false").select("recording_id", "line_no", "text", "x", "y", F.lit("self").alias("side"))).count() == 0


def test_a_recording_of_thirty_thousand_lines(spark):
    lines = spark.range(30_000).select(
        F.lit(7).cast("long").alias("recording_id"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("line number "), F.col("id").cast("string")).alias("text"),
        F.lit(0.0).alias("x"), (F.col("id") * 30).cast("double").alias("y"), F.when(F.col("id") % 2 == 0, "self").otherwise("other").alias("side"),
    )
    plain = rows.format_plain(lines).first().markdown.split("\n")
    assert plain == [f"line number {i}" for i in range(30_000)]
    chat = rows.format_chat(lines).first().markdown.split("\n")
    assert len(chat) == 30_000 and chat[29_999].endswith("line number 29999")
