"""Rules on the wording of documents: terms that may stand only in some contexts, facts that must be stated, sections that stay
as they are. All rules are looked for in one pass over the lines."""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that one pass takes at most; they travel to every task, so that their size is bounded.
MOST_RULES = 10_000


class Rule(NamedTuple):
    """``term`` may stand in a line only if ``allow`` is found in the line too, or ``allow_label`` in its document's label."""

    term: str
    allow: str | None = None
    allow_label: str | None = None


def term_hits(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """``recording_id, line_no, rule_no, term``: terms of ``lines(recording_id, line_no, label, text)`` outside their contexts.

    An automaton of all terms reads each line once; a rule is looked at only where its term was found. A line breaks
    a rule once, however often its term stands there; rules of one term are judged each. Null texts and empty ones break
    nothing; a null label allows nothing. An empty term is an error, as is a longer list than MOST_RULES.
    """
    if len(rules) > MOST_RULES or not all(rule.term for rule in rules):
        raise ValueError(f"rules need a term each, and at most {MOST_RULES} go in a pass")

    def find(batches):
        import ahocorasick

        automaton, of_term = ahocorasick.Automaton(), {}
        for number, rule in enumerate(rules):
            of_term.setdefault(rule.term, []).append((number, *(x and re.compile(x) for x in rule[1:])))
        for term, own in of_term.items():
            automaton.add_word(term, (term, own))
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, (text, label) in enumerate(zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())):
                for term, own in sorted({t: o for _, (t, o) in automaton.iter(text)}.items()) if text and of_term else ():
                    for number, allow, allow_label in own:
                        if not (allow and allow.search(text)) and not (allow_label and label is not None and allow_label.search(label)):
                            at.append(i)
                            found.append((number, term))
            keys = batch.select(["recording_id", "line_no"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], ["recording_id", "line_no", "rule_no", "term"])

    keys = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("recording_id", "line_no"))
    return lines.select("recording_id", "line_no", "label", "text").mapInArrow(find, f"{keys}, rule_no int, term string")


def sealed(text: Column, mark: str, within: int = 2000) -> Column:
    """Whether a text says in its first characters that it is a record of its time, which no rule looks at."""
    return F.coalesce(F.substring(text, 1, within).rlike(mark), F.lit(False))


def missing_facts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """``doc_id, fact`` of ``facts(doc_id, fact)`` that ``docs(doc_id, text)`` doesn't state; a document that is missing, or without
    a text, states nothing. Only texts that have facts to state are joined."""
    found = facts.join(docs.select("doc_id", "text"), "doc_id", "left")
    return found.where(~F.coalesce(F.contains("text", "fact"), F.lit(False))).select("doc_id", "fact")


def changed_sections(docs: DataFrame, frozen: DataFrame) -> DataFrame:
    """``doc_id, start`` of ``frozen(doc_id, start, end, sha256)`` whose section in ``docs(doc_id, text)`` has another digest."""
    found = frozen.join(docs.select("doc_id", "text"), "doc_id", "left")
    low = F.expr("instr(text, start)")
    high = F.expr("locate(end, text, instr(text, start) + char_length(start))")
    part = F.when((low > 0) & (high > 0), F.col("text").substr(low, high - low)).otherwise("")
    return found.where(F.coalesce(F.sha2(part, 256) != F.col("sha256"), F.lit(True))).select("doc_id", "start")
