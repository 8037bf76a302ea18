"""Byte-level BPE: merges against plain rank order, a memo that rolls over, long runs."""

import random
import time

import pytest

from capturelab.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    r = random.Random(2)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 700:
        a, b = r.choice(list(ranks)), r.choice(list(ranks))
        if all(97 <= x < 103 for x in a + b) and len(a + b) < 9:
            ranks.setdefault(a + b, len(ranks))
    return bpe.Vocabulary(ranks, r"\s?\S+|\s+"), ranks


def plain(piece, ranks):
    """The lowest-ranked pair of neighbours, the first of them, is merged until none is a token."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([x]) for x in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_merges_by_brute_force(vocabulary, monkeypatch):
    v, ranks = vocabulary
    monkeypatch.setattr(bpe, "MEMO", 50)  # rolls over again and again
    r = random.Random(5)
    for _ in range(600):
        words = ["".join(r.choice("abcdefé") for _ in range(r.randint(1, 90))) for _ in range(r.randint(1, 12))]
        text = " ".join(words)
        want = [x for k, w in enumerate(words) for x in plain((" " * (k > 0) + w).encode(), ranks)]
        ids = v.encode(text)
        assert ids.tolist() == want and v.decode(ids) == text.encode()
        assert max(map(len, (v.memo, v.older, v.pieces, v.older_pieces))) <= 50 + 14
    assert all(len(k) <= bpe.LONGEST for k in (*v.memo, *v.pieces))


def test_long_run(vocabulary):
    began = time.time()
    text = "abcdef" * 50_000
    assert vocabulary[0].decode(vocabulary[0].encode(text)) == text.encode() and time.time() - began < 20


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x"), (1, "a b", 3, "x"), (None, None, None, None)], "doc_id long, text string, n_tokens int, ids string")
    got = bpe.token_digests(docs, bpe.vocabulary(spark)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2, 2]
