"""Columns whose names clash with those that an operator makes or uses inside, in any case."""

import json

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat, decontam, quality, queries, secrets, spm, urls

TEXT = "the password = abcdefgh1234 stands here and the quick brown fox jumps over it"
MADE = {
    "quality": (["SCORE", "Predicted", "__text", "__TEXT_"], ["score", "predicted"]),
    "spm": (["Exact", "N_Tokens", "TOKEN_IDS", "__text"], ["token_ids", "n_tokens", "exact"]),
    "secrets": (["Oversized", "BASE_spans", "__Text"], ["base_spans", "added_spans", "oversized"]),
    "decontam": (["Hits", "__text", "__ROW"], ["hits"]),
}


def made(name, docs, spark):
    if name == "quality":
        labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
        return quality.score(docs, quality.fit(docs, labels, F.lit(True)))
    if name == "spm":
        return spm.encode(docs, queries.model_bytes())
    if name == "secrets":
        return secrets.scan(docs)
    return decontam.scan(docs, spark.createDataFrame([(7, TEXT)], "item_id long, text string"))


@pytest.mark.parametrize("name", MADE)
@pytest.mark.parametrize("passes", [False, True])
def test_clashing_names(spark, monkeypatch, name, passes):
    """Those of new columns are replaced, others stay with their values."""
    if passes:
        monkeypatch.setattr(decontam, "MOST_BYTES", 1)
    held, new = MADE[name]
    docs = spark.createDataFrame([(i, TEXT, *[f"{c} {i}" for c in held]) for i in (1, 2)], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in held)}")
    got = made(name, docs, spark)
    stays = [c for c in held if c.lower() not in new]
    assert got.columns == ["doc_id", "text", *stays, *new]
    assert sorted((r.doc_id, *[r[c] for c in stays]) for r in got.collect()) == [(i, *[f"{c} {i}" for c in stays]) for i in (1, 2)]


def test_clashing_names_of_pages(spark):
    held = ["HOST", "__url", "__fit", "__node", "__says", "__h", "__kept"]
    pages = spark.createDataFrame([(1, "http://a.example.net/x", None, *held), (2, None, "", *held)], f"page_id long, url string, html string, {', '.join(f'`{c}` string' for c in held)}")
    for rules in (queries.RULES, spark.createDataFrame(queries.RULES, "verdict string, host string, path string")):
        got = urls.judge(pages, rules)
        assert got.columns == ["page_id", "url", "html", *held[1:], "host", "path", "rule", "verdict"]
        assert [(r.page_id, r.__getitem__("__node"), r.rule, r.verdict) for r in got.orderBy("page_id").collect()] == [(1, "__node", "net/", "block"), (2, "__node", None, "allow")]


def test_deep_arguments_are_valid(spark):
    """JSON that nests some thousand levels is a sound call, and comes out as it went in."""
    deep = json.loads("[" * 3_000 + '"$ref:b"' + "]" * 3_000)
    text = "".join(f"<tool_call>{chat.canonical(c)}</tool_call>" for c in ({"id": "a", "name": "f", "arguments": {"x": deep}}, {"id": "b", "name": "f", "arguments": {}}))
    r = chat.link(spark.createDataFrame([(1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")).first()
    calls = {c["id"]: c for c in json.loads(r.message)["tool_calls"]}
    assert (r.n_calls, r.n_faults, calls["a"]["depth"], calls["a"]["arguments"]) == (2, 0, 1, {"x": deep})
