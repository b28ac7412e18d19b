"""Wording rules, reports' fields and retry requests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from reelscribe.operators import checks, terms
from reelscribe.operators.terms import Rule

LINES = "recording_id int, line_no int, label string, text string"


def test_terms_outside_their_contexts(spark):
    rows = [(1, 0, "a", "old way, old way"), (1, 1, "a", "old way, withdrawn"), (1, 2, None, "oldway"), (2, 0, "sealed.md", "new old way"), (3, 0, None, None), (3, 1, "a", "")]
    rules = [Rule("old way", "withdrawn"), Rule("old", None, r"\.md$"), Rule("way"), Rule("old way", "new")]
    got = sorted(tuple(r) for r in terms.term_hits(spark.createDataFrame(rows, LINES), rules).collect())
    plain = sorted(
        (r, n, i, rule.term)
        for r, n, label, text in rows
        for i, rule in enumerate(rules)
        if rule.term in (text or "") and not (rule.allow and rule.allow in text) and not (rule.allow_label and label == "sealed.md")
    )
    assert got == plain and len(got) == 11
    assert terms.term_hits(spark.createDataFrame(rows, LINES), []).count() == 0
    with pytest.raises(ValueError):
        terms.term_hits(spark.createDataFrame(rows, LINES), [Rule("")])


def test_facts_and_frozen_sections(spark):
    text = "head\n## A\nbody é\n## B\ntail"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    facts = spark.createDataFrame([(1, "body"), (1, "none"), (2, "body"), (3, "body")], "doc_id int, fact string")
    assert sorted(tuple(r) for r in terms.missing_facts(docs, facts).collect()) == [(1, "none"), (2, "body"), (3, "body")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    frozen = [(1, "## A", "## B", sha("## A\nbody é\n")), (1, "## A", "tail", sha("other")), (1, "## B", "## A", sha("")), (2, "x", "y", sha(""))]
    got = terms.changed_sections(docs, spark.createDataFrame(frozen, "doc_id int, start string, end string, sha256 string"))
    assert [tuple(r) for r in got.collect()] == [(1, "## A")]
    marks = spark.createDataFrame([("## sealed",), ("x" * 2000 + "## sealed",), (None,)], "text string").select(terms.sealed(F.col("text"), "## sealed"))
    assert [r[0] for r in marks.collect()] == [True, False, False]


def test_report_fields_and_retry_requests(spark):
    text = "status: ok\nmode (x): chat\nempty: \n"
    row = spark.createDataFrame([(text,)], "t string").select(*(checks.report_field(F.col("t"), n).alias("f") for n in ("status", "mode (x)", "empty", "none"))).first()
    assert list(row) == ["ok", "chat", None, None]
    rows = [(1, "anchor", "warning", 0, "v", "chat"), (2, "anchor", "ok", 2, "v", "chat"), (3, "anchor", "ok", None, "v", "chat"), (4, "stitch", "warning", 1, "v", "chat"), (5, "anchor", "warning", 1, None, "chat"), (6, None, None, 1, "v", "chat")]
    runs = spark.createDataFrame(rows, "run_id int, engine string, status string, unresolved int, asset string, mode string")
    assert sorted(tuple(r) for r in checks.retry_requests(runs).collect()) == [(1, "v", "chat", "stitch"), (2, "v", "chat", "stitch")]
