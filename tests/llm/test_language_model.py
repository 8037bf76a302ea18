"""The deleted interpolation model against brute force, and the two exchanges against each other."""

import math
import re
import zlib
from collections import Counter

import pytest

from capturelab.llm import language_model as lm

WORDS = ["the", "a", "cat", "dog", "sat", "ran", "on", "mat", "und", "der"]


def rows(n=140):
    import random

    r = random.Random(4)
    out = [(i, " ".join(r.choice(WORDS[: 3 + i % 8]) for _ in range(r.randint(0, 40)))) for i in range(n)]
    return out + [(5, "the cat sat"), (5, "the cat sat"), (None, "the dog"), (900, None), (901, ""), (902, "unseen words here"), (903, "The CAT " * 300)]


def brute(data):
    """Scores by dictionaries, token by token."""
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + ["</>"]) for i, t in data]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7

    def counts(keep):
        one, two = Counter(), Counter()
        for i, w in toks:
            if i is not None and keep(fold(i)):
                one.update(w)
                two.update(zip(["<s>", *w[:-1]], w, strict=True))
        return one, two, sum(one.values())

    def parts(w, one, two, total):
        for u, x in zip(["<s>", *w[:-1]], w, strict=True):
            context = one["</>"] if u == "<s>" else one[u]
            yield min(int(math.log2(context + 1)), lm.BUCKETS - 1), one[x] / max(total, 1), two[u, x] / max(context, 1), x

    one, two, total = counts(lambda f: f != lm.HELD_OUT)
    uniform = 1 / (len(one) + 1)
    kept = counts(lambda f: f not in (lm.HELD_OUT, lm.DELETED))
    level = lambda p: 0 if p <= 0 else int(1 + max(0, math.floor(lm.PER_OCTAVE * math.log2(p / uniform)) + 64))
    cells = {}
    for i, w in toks:
        if i is not None and fold(i) == lm.DELETED:
            for b, p1, p2, _ in parts(w, *kept):
                c = cells.setdefault((b << 40) | (level(p1) << 20) | level(p2), [0, 0.0, 0.0])
                c[0], c[1], c[2] = c[0] + 1, c[1] + p1, c[2] + p2
    weights = lm.interpolation_weights(sorted((c, float(n), p1, p2) for c, (n, p1, p2) in cells.items()), uniform)
    out = []
    for i, w in toks:
        score = sum(math.log10(weights[b][0] * p2 + weights[b][1] * p1 + weights[b][2] * uniform) for b, p1, p2, _ in parts(w, one, two, total))
        out.append((-1 if i is None else i, len(w), sum(one[x] > 0 for x in w), total, round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("coarse", [lm.COARSE, 5])
def test_scores_by_brute_force(spark, monkeypatch, coarse):
    monkeypatch.setattr(lm, "COARSE", coarse)  # five coarse ranges of seven fine ones, and groups of two blocks
    monkeypatch.setattr(lm, "GROUP", 2)
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, role int, block string").repartition(4)
    got = lm.scored(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in got) == brute(data)


def test_packed_arrays_come_back():
    import numpy as np

    for x in ([], [3], [5, 0, 2**31 - 1, 70000]):
        assert lm.unpack_index(lm.pack_index(np.array(x, np.int32))).tolist() == x
