import numpy as np
import pyarrow as pa
import pytest

from reelscribe.llm import toxicity
from reelscribe.llm.toxicity import State, distinct_features, fit, learn, occurrences, op11_ftrl_toxicity, score, scores_of, weights_of

DATA = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string, `a.b` int, TEXT string", "doc_id long, quality int, toxic int"


def test_updates_equal_the_rule_written_out():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 30, 8)) for _ in range(200)]
    labels = draw.integers(0, 2, 200)
    state = State(np.arange(30), np.zeros(31), np.zeros(31))
    learn(state, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]), labels)
    z, n, a, b, l1, l2 = [0.0] * 31, [0.0] * 31, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    for row, label in zip(rows, labels):
        w = {}
        for i in [*row.tolist(), 30]:
            cut = 0 if i == 30 else l1
            w[i] = 0 if abs(z[i]) <= cut else -(z[i] - np.sign(z[i]) * cut) / ((b + n[i] ** 0.5) / a + l2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
            n[i] += g * g
    assert np.allclose(state.z, z) and np.allclose(state.n, n)
    assert (weights_of(state.z, state.n, l1) == 0).any()


def test_features_are_words_pairs_and_skips_within_a_text():
    def size(*texts):
        return np.diff(distinct_features(pa.array(texts))[1]).tolist()

    assert size("a b c", "d", "", None, "12 --") == [3 + 2 + 1, 1, 0, 0, 0]
    same = [distinct_features(pa.array([t]))[0].tolist() for t in ("You, FOOL! now", "you fool 7 now")]
    assert same[0] == same[1]
    assert len(occurrences(pa.array(["x x x"]))[0]) == 6 and size("x x x") == [3]
    assert not set(distinct_features(pa.array(["a b"]))[0]) - set(distinct_features(pa.array(["q a b q"]))[0])


@pytest.fixture(scope="module")
def found(spark):
    return op11_ftrl_toxicity(spark, DATA).toPandas()


def test_held_out_documents_are_told_apart(spark, found):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    rows = found[found.held_out].merge(labels, on="doc_id")
    toxic = rows.toxic == 1
    rank = rows.score.rank()
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.98
    assert rows.predicted[~toxic].mean() < 0.005
    assert rows.predicted[toxic].mean() > 0.7


def test_every_document_has_one_score(spark, found):
    assert len(found) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()


def rows(count: int) -> tuple[list[tuple], list[tuple]]:
    docs = [(i, ("plain words here and more " * (1 + i % 3)) + ("you fool" if i % 2 else "thank you"), 1, "z") for i in range(count)]
    return docs, [(i, 1, i % 2) for i in range(count)]


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs, labels = rows(400)
    each = []
    for parts in (1, 9):
        d, l = spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(labels, LABELS).repartition(parts)
        each.append({r.doc_id: r.score for r in score(d, fit(d, l)).collect()})
    assert each[0] == each[1]
    assert all((s >= 0.5) == (i % 2 == 1) for i, s in each[0].items())


def test_nulls_repeats_long_texts_and_conflicting_labels(spark):
    docs, labels = rows(200)
    odd = [(None, "you fool", 1, "z"), (1000, None, 1, "z"), (1001, "", 1, "z"), (1002, "plain " * 200_000 + "fool", 1, "z"), docs[1], docs[1]]
    labels += [(None, 1, 1), (1000, 1, 0), (5, 1, 0), (7, 1, None)]
    d, l = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels, LABELS)
    model = fit(d, l)
    got = score(d, model).collect()
    assert len(got) == 206
    by_id = {r.doc_id: r for r in got}
    empty = scores_of(pa.array([""]), model)[0]
    assert by_id[1000].score == by_id[1001].score == empty and by_id[None].predicted == 1 and by_id[1002].predicted == 1
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_no_rows_and_no_labels(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1, "z")], DOCS)
    model = fit(none, spark.createDataFrame([], LABELS))
    assert score(none, model).count() == 0
    assert [r.score for r in score(some, model).collect()] == [0.5]


def test_the_sample_is_bounded(spark):
    docs, labels = rows(3000)
    d, l = spark.createDataFrame(docs * 2, DOCS), spark.createDataFrame(labels, LABELS)
    assert 200 < toxicity.sample(d, l, 300)[0].count() < 400
