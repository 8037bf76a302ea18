"""The classifier's weights and scores against plain Python: dictionaries of features and follow-the-regularised-leader one coordinate at a time."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from capturelab.llm import quality_model as q
from capturelab.llm.common import MIXED, pair_hash, word_chunks

TEXTS = ["Good good text, Text!", "bad  bad\nspam...", "", None, "été ÉTÉ x1 -- x1 --", "one", "... !!!", "good spam good spam good"]


def plain_features(text):
    words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^\sA-Za-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [int(next(word_chunks(pa.array([w]), MIXED)).hash[0]) for w in words]
    pairs = [int(pair_hash(np.array([a], np.uint64), np.array([b], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
    count = {}
    for h in [*hashes, *pairs]:
        count[h >> (64 - q.BITS)] = count.get(h >> (64 - q.BITS), 0) + 1
    length = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values()))
    return {f: math.log1p(c) / length for f, c in count.items()}


def plain_ftrl(rows):
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= q.L1 else (math.copysign(q.L1, a) - a) / ((q.BETA + math.sqrt(n.get(i, 0.0))) / q.ALPHA + q.L2)

    for _ in range(q.PASSES):
        for label, x in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - label
            for i, v in x.items():
                old = n.get(i, 0.0)
                n[i] = old + (g * v) ** 2
                z[i] = z.get(i, 0.0) + g * v - (math.sqrt(n[i]) - math.sqrt(old)) / q.ALPHA * w[i]
    return {i: weight(i) for i in z}


def test_weights_and_scores_by_plain_python(spark):
    r = random.Random(4)
    texts = [*TEXTS, *(" ".join(r.choice(["good", "fine", "bad", "spam", "x1", "--", "été"]) for _ in range(r.randint(1, 30))) for _ in range(60))]
    labels = [int("good" in (t or "")) for t in texts]
    known = [plain_features(t) for t in texts]
    rows = [(y, np.array(sorted(x), np.int64), np.array([x[f] for f in sorted(x)])) for y, x in zip(labels, known, strict=True)]
    weights, want = q.ftrl(rows), plain_ftrl([(y, {**x, 1 << q.BITS: 1.0}) for y, x in zip(labels, known, strict=True)])
    assert np.count_nonzero(weights) == sum(w != 0 for w in want.values()) and all(weights[i] == pytest.approx(w, rel=1e-5, abs=1e-7) for i, w in want.items())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.score for x in q.scores(docs, weights).collect()}
    for i, x in enumerate(known):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(float(weights[f]) * v for f, v in {**x, 1 << q.BITS: 1.0}.items()))), rel=1e-6)
