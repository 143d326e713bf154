"""Notes-sets against the rules of their shape, by path."""

import json

import pytest

from marginalia.operators import shape

GOOD = {"schema_version": 1, "source": {"document": "d", "page_index": 1}, "evidence": [{"id": "e-x", "excerpt": "y", "source": "body"}], "statements": [{"id": "s-x", "type": "claim", "text": "y", "evidence": ["e-x"]}]}


def changed(**more):
    return {**GOOD, **more}


def quote(**more):
    return changed(evidence=[{**GOOD["evidence"][0], **more}])


def without(x, *names):
    return {k: v for k, v in x.items() if k not in names}


CASES = [
    (GOOD, []),
    (changed(source={"document": "d", "scope": "page", "page_index": 1}), []),
    (changed(source={"document": "d", "scope": "page"}), [("required", "source", "page_index")]),
    (changed(source={"document": "d", "scope": "chapter", "page_range": [1, 5]}), []),
    (changed(source={"document": "d", "scope": "chapter", "chapter_id": "ch1"}), [("required", "source", "page_range")]),
    (changed(source={"document": "d", "scope": None, "page_index": 0}), [("enum", "source/scope", "null"), ("type", "source/scope", "null")]),
    (changed(source={"page_index": 1.5}), [("required", "source", "document"), ("type", "source/page_index", "number")]),
    (changed(source="d"), [("type", "source", "string")]),
    (changed(schema_version=1.0), []),
    (changed(schema_version=True), [("const", "schema_version", "true"), ("type", "schema_version", "boolean")]),
    (without(GOOD, "evidence", "statements"), [("required", "<root>", "evidence"), ("required", "<root>", "statements")]),
    (quote(script="egyptian-transliteration", excerpt_translation="z"), []),
    (quote(source="margin"), [("enum", "evidence/0/source", "margin")]),
    (quote(kind="figure", bbox=[1, 2.5, 3, 4]), []),
    (changed(evidence=[{"id": "e-x", "kind": "figure"}]), []),
    (changed(evidence=[{"id": "e-x", "kind": "text"}]), [("required", "evidence/0", "excerpt"), ("required", "evidence/0", "source")]),
    (changed(evidence=[{"id": "e-x"}]), [("required", "evidence/0", "excerpt"), ("required", "evidence/0", "source")]),
    (changed(evidence={}), [("type", "evidence", "object")]),
    (changed(terms=[{"id": "t-x", "label": "x"}], statements=[{**GOOD["statements"][0], "evidence": ["t-x"]}]), [("pattern", "statements/0/evidence/0", "t-x")]),
    (changed(relations=[{"from": "s-x", "to": "anything", "type": "defines"}, {"from": "s-x", "to": "A", "type": "is"}]), [("enum", "relations/1/type", "is"), ("pattern", "relations/1/to", "A")]),
    ([], [("type", "<root>", "list")]),
    (7, [("type", "<root>", "number")]),
]


def test_violations_of_each_kind(spark):
    rows = [("b", i, json.dumps(x)) for i, (x, _) in enumerate(CASES)] + [("b", 100, "{no json"), ("b", 101, None)]
    got = {}
    for r in shape.notes_problems(spark.createDataFrame(rows, "book_id string, page_index long, notes string")).collect():
        got.setdefault(r["page_index"], []).append((r["rule"], r["item"], r["detail"]))
    for i, (_, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(want), CASES[i]
    assert not {100, 101} & set(got)


@pytest.mark.parametrize("name", ["evidence_id", "statement_id", "term_id"])
def test_flat_patterns_are_those_of_the_rules(name):
    from marginalia.operators import validate

    assert getattr(validate, name.upper()) == {"evidence_id": shape.EVIDENCE, "statement_id": shape.STATEMENT, "term_id": shape.TERM}[name].pattern
