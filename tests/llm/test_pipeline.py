"""The pipeline's stages, each on its own input, and the whole run."""

from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from reelscribe.llm import jaccard, language_id, quality, substrings

from .fixtures import documents, empty

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from reelscribe.plans.storage import kept

    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(kept(stage(spark, docs[-1], SF), name))
    return docs


def test_stages_keep_the_columns(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5
    assert stages[0].count() >= stages[1].count() >= stages[2].count() >= stages[3].count() == stages[4].count() > 0


def test_decisions_take_effect(stages):
    first, second, third, fourth, fifth, pieces = stages
    model = language_id.fit(first)
    known = {r.doc_id for r in language_id.identify(first, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r.doc_id for r in second.collect()} == known
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in quality.judge(second).where("kept").collect()}
    assert {r.doc_id for r in fourth.collect()} == {r.component_id for r in jaccard.components(third).collect()}
    left = {r.doc_id: r.left_text for r in substrings.remove_repeats(fourth).collect()}
    assert {r.doc_id: r.text for r in fifth.collect()} == left
    assert all(r.n_chars == len(r.text) for r in fifth.collect())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = defaultdict(bytes)
    for p in sorted(pieces.collect(), key=lambda p: (p.doc_id, p.start)):
        own[p.doc_id] += bytes(p.ids)
    assert {d: len(x) // 4 for d, x in own.items()} == {
        d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in left.items()
    }


def test_awkward_and_empty_input(spark):
    docs, none = documents(spark), empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, SF), stage(spark, none, SF)
        assert docs.columns == documents(spark).columns and none.count() == 0
    assert docs.count() > 0


def test_one_of_equal_rows_stays(spark):
    docs = documents(spark)
    rows = jaccard.keep_one(docs).collect()
    groups = {(r.root, r.n_shingles > 0, r.row_key if not r.n_shingles else 0) for r in jaccard.grouped(docs).collect()}
    wordless = [r for r in rows if not (r.text or "").encode().split()]
    assert len(rows) - len(wordless) == len({g[0] for g in groups if g[1]})


def test_the_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() > 0
