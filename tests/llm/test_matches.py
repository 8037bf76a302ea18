"""Decontamination against brute force on small vocabularies, where passages are shared by many items."""

import random

import pyarrow as pa
import pytest

from capturelab.llm import decontaminate as d
from capturelab.llm.common import ALNUM, word_chunks


def brute(doc, items):
    """Hit words, items, and the longest match with any item from each word."""
    hit, ids, best = set(), set(), {}
    for i, v in items:
        n = min(d.WINDOW, len(v))
        windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
        for p in range(len(doc) - n + 1):
            if tuple(doc[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                ids.add(i)
                for s in range(len(v) - n + 1):
                    k = 0
                    while s + k < len(v) and p + k < len(doc) and v[s + k] == doc[p + k]:
                        k += 1
                    if k >= n:
                        best[p] = max(best.get(p, 0), k)
    return hit, ids, best


@pytest.mark.parametrize("seed", range(25))
def test_matches_by_brute_force(seed, monkeypatch):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(r.choice([1, 2, 3, 40]))]
    passage = [r.choice(vocabulary) for _ in range(25)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i % 7, some(r.randint(0, 6)) + (passage[r.randint(0, 8) :] if i % 2 else []) + some(r.randint(0, 12))) for i in range(12)]
    docs = [some(r.randint(0, 15)) + (passage if r.random() < 0.6 else []) + some(r.randint(0, 30)) + ["other"] * r.randint(0, 1) + some(r.randint(0, 20)) for _ in range(8)] + [[], ["other"]]
    block = d.Block([(i, 0, " ".join(v)) for i, v in items])
    column = pa.array([" ".join(x) for x in docs])
    for w in word_chunks(column, ALNUM, size=200):
        (row, suffix, start, length), (of, which) = d.matches(w, block)
        for j in range(w.lo, w.hi):
            hit, ids, best = brute(docs[j], items)
            own = [(s, n, block.item[k], block.start[k]) for i, k, s, n in zip(row, suffix, start, length, strict=True) if i == j - w.lo]
            assert {p for s, n, _, _ in own for p in range(s, s + n)} == hit
            assert {x for i, k in zip(of, which, strict=True) if i == j - w.lo for x in block.lists[k].tolist()} == ids
            assert len(own) <= 10 * len(docs[j])
            for s, n, item, at in own:
                assert any(i == item and v[at : at + n] == docs[j][s : s + n] for i, v in items)
                assert n < d.WINDOW or n == best[s]


def test_shared_passage_is_no_pair_of_items(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    bench = spark.createDataFrame([(i, passage + f" own{i}") for i in range(500)], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"a {passage} own7 b {passage}", 5, "x")], "doc_id long, text string, n_words int, found string")
    r = d.longest_matches(docs, bench, keep=["doc_id"]).first()
    assert [(x.item, x.item_start, x.start, x.length) for x in r.found][0] == (7, 0, 1, 31) and len(r.found) == 2 and r.found[1].length == 30 and r["items"] == list(range(500))
    left = d.longest_matches(docs, bench, keep=docs.columns, names=("a", "b", "c"))
    assert left.columns == ["doc_id", "text", "n_words", "found", "a", "b", "c"]


def test_long_items_are_cut_with_overlap(spark, monkeypatch):
    words = [f"u{i}" for i in range(200)]
    bench = spark.createDataFrame([(9, " ".join(words)), (8, "u5 u6")], "item_id long, text string")
    docs = spark.createDataFrame([(i, "x " + " ".join(words[i : i + 12])) for i in range(0, 188, 3)] + [(999, "u5 u6")], "doc_id long, text string")
    monkeypatch.setattr(d, "BLOCK_BYTES", 150)
    got = {r.doc_id: r for r in d.longest_matches(docs, bench).collect()}
    assert all({p for x in r.found for p in range(x.start, x.start + x.length)} == set(range(1, 13)) for i, r in got.items() if i != 999)
    assert all(words[x.item_start] == f"u{i + x.start - 1}" for i, r in got.items() if i != 999 for x in r.found if x.item == 9)
    assert got[999]["items"] == [8] and 8 in got[3]["items"] and 9 in got[3]["items"]
