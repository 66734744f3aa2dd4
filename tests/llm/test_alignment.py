"""Two tokenizers' tokens side by side, against the libraries and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import alignment, queries

A_FILE, B_MODEL = queries.model_bytes(queries.OTHER_TOKENIZER), queries.model_bytes()
ODD = ["", None, " ", "  a  b \n c ", "▁ x y", "a  b", "<|endoftext|> <s> x", "\x1c a \x1f b", "日本語 テキスト 😀😀 é", "a\tb c\n\nd", "'s don't I'll", " lead", "trail ", "\x00 \x85 q", "a", "one two one two", "one two one two"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(A_FILE.decode())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_proto=B_MODEL)


def brute(libraries, text):
    """(A ids, B ids, groups as (A ids, B ids)) of one text, token by token."""
    a, b = libraries
    both = alignment.aligner(A_FILE, B_MODEL)
    x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    xs, ys = [both.a.spelt[i] for i in x], [both.b.spelt[i] for i in y]
    if not text or not b"".join(xs) == b"".join(ys) == (" " + text).encode():
        return [], [], []
    groups, i, j, at, to, mine, yours = [], 0, 0, 0, 0, [], []
    while i < len(x) or j < len(y):
        if at <= to:
            mine.append(x[i])
            at += len(xs[i])
            i += 1
        else:
            yours.append(y[j])
            to += len(ys[j])
            j += 1
        if at == to:
            groups.append((mine, yours))
            mine, yours = [], []
    return x, y, groups


def corpus_rows(libraries, docs):
    made = [(i, *brute(libraries, t)) for i, t in docs]
    links = [Counter((p, q) for m, y in g for p in m for q in y) for *_, g in made]
    count = Counter(pair for c in links for pair in c)
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    listed = lambda g: ";".join(f"{','.join(map(str, m))}|{','.join(map(str, y))}" for m, y in g)
    return [
        (i, len(x), len(y), len(g), sum(c.values()), hashlib.sha256(listed(g).encode()).hexdigest() if x else "", sum(n for k, n in c.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in c.items()))
        for (i, x, y, g), c in zip(made, links, strict=True)
    ]


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
by_row = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=20), st.lists(st.integers(1, 4), max_size=20))
def test_owners(a, b):
    n = min(sum(a), sum(b))  # the same number of bytes on both sides
    fit = lambda x: [min(k, n - s) for k, s in zip(x, np.cumsum([0, *x]).tolist(), strict=False) if s < n]
    a, b = fit(a), fit(b)
    a_group, b_group, over = alignment.owners(np.array(a, int), np.array(b, int))
    spans = lambda x: [(sum(x[:i]), sum(x[: i + 1])) for i in range(len(x))]
    assert over.tolist() == sorted([i, j] for i, (s, e) in enumerate(spans(a)) for j, (u, v) in enumerate(spans(b)) if s < v and u < e)
    cuts = sorted({e for _, e in spans(a)} & {e for _, e in spans(b)})
    assert [a_group.tolist(), b_group.tolist()] == [[sum(c <= s for c in cuts) for s, _ in spans(x)] for x in (a, b)]


def test_query_equals_plain_loops(spark, data, libraries):
    got = queries.op11_tokenizer_alignment(spark, data).select(COLS).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(corpus_rows(libraries, docs))


def test_odd_rows_and_rare_pairs(spark, libraries, monkeypatch):
    """Pieces of tokens, white space, marks, repeats; names that clash; pairs too many to broadcast; a cache that overflows; links dealt in steps."""
    rng = random.Random(4)
    tokens = [t.decode("utf-8", "ignore") for t in alignment.aligner(A_FILE, B_MODEL).a.spelt.values()]
    texts = ODD + ["".join(rng.choice(tokens) for _ in range(30)) for _ in range(60)] + [" ".join(rng.choice(tokens) for _ in range(30)) for _ in range(30)]
    docs = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 0.0, "x") for i, t in docs], "doc_id long, text string, N_A double, `__row` string")
    want = by_row(corpus_rows(libraries, docs))
    got = alignment.count_links(df, A_FILE, B_MODEL)
    assert got.columns == ["doc_id", "text", "__row", *COLS[1:]]
    assert by_row(map(tuple, got.select(COLS).collect())) == want
    few = alignment.count_links(df, A_FILE, B_MODEL, keep=["doc_id"], most=5)
    assert by_row(map(tuple, few.select(COLS).collect())) == want
    assert alignment.count_links(df.limit(0), A_FILE, B_MODEL).count() == 0
    small = alignment.Aligner(A_FILE, B_MODEL)
    small.MOST = 20
    for t in texts:
        if t:
            a, b, groups = brute(libraries, t)
            row = [c.to_pylist()[0] for c in alignment._measured(small, [t])]
            assert row[:3] == [len(a), len(b), len(groups)] and len(small.listed) <= 21 + len(t)


def test_arrays_of_one_text(spark, libraries):
    text = "naïve 日本 text"
    a, b, groups = brute(libraries, text)
    r = alignment.align(spark.createDataFrame([(1, text, 2), (2, None, 3)], "doc_id long, text string, A_IDS int"), A_FILE, B_MODEL).orderBy("doc_id").collect()
    assert (r[0].a_ids, r[0].b_ids) == (a, b)
    assert [([i for i, g in zip(a, r[0].a_groups, strict=True) if g == n], [i for i, g in zip(b, r[0].b_groups, strict=True) if g == n]) for n in range(len(groups))] == groups
    assert len(r[0].overlaps) >= max(len(a), len(b)) and r[1].a_ids == r[1].overlaps == []


def test_long_texts():
    """A million blanks, which the faster library's pattern refuses, a long word, and a long text of few parts."""
    both = alignment.Aligner(A_FILE, B_MODEL)
    n_a, n_b, n_groups, n_links = (c.to_pylist() for c in alignment._measured(both, [" " * 300_000, "x" * 300_000, "ab " * 200_000])[:4])
    assert all(x > 0 for x in n_a + n_b + n_groups) and n_links[2] >= 200_000
    with pytest.raises(ValueError, match="byte-level"):
        alignment.ByteLevel(b'{"model": {"type": "WordPiece"}, "pre_tokenizer": null, "normalizer": null}')
