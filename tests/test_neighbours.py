"""Neighbours: the screen in single precision against doubles, ties, copies, and what is computed once."""

import numpy as np
import pytest

from capturelab.operators import certified, neighbors, quantiles, reports


def _brute(v, ids, k, metric):
    out = []
    for i in range(len(v)):
        s = neighbors._similar(np.broadcast_to(v[i], v.shape), v, metric)
        others = np.flatnonzero(ids != ids[i])
        out += [(ids[i], ids[j], s[j]) for j in others[np.lexsort((ids[others], -s[others]))][:k]]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "rms"])
@pytest.mark.parametrize("far", [0, 1000.0])
def test_screen_in_single_precision(metric, far):
    rng = np.random.default_rng(12)
    v = np.round(rng.normal(size=(1500, 16)), 1) + far
    v[100:300], v[400:420] = v[5], 0
    if metric == "cosine":
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    ids = rng.permutation(len(v))
    for k in (1, 7):
        assert sorted(zip(*(c.tolist() for c in neighbors._near(v, v, ids, ids, k, metric)), strict=True)) == _brute(v, ids, k, metric)
    assert [len(c) for c in neighbors._near(v[:0], v, ids[:0], ids, 3, metric)] == [len(c) for c in neighbors._near(v, v[:0], ids, ids[:0], 3, metric)] == [0, 0, 0]


def test_copies_far_from_the_origin_are_at_no_distance(spark):
    rng = np.random.default_rng(13)
    v = 1000 + rng.normal(size=(40, 64))
    x = spark.createDataFrame([(i, v[i // 2].tolist()) for i in range(80)], "id long, v array<double>").repartition(3)
    near = neighbors.nearest(x, 1, block_rows=30, metric="rms").collect()
    assert {(r.id, r.neighbour, r.similarity) for r in near} == {(i, i ^ 1, 0.0) for i in range(80)}


def test_blocks_stay_few():
    assert [neighbors._block_rows(n, 2048) for n in (0, 2000, 32768, 100_000, 600_000, 10**8)] == [2048, 2048, 2048, 6250, 32768, 32768]


def test_categories_search_once(spark, monkeypatch):
    """Fences, join and the sort of the report all need the neighbours; they are searched for once, also where a label has many rows."""
    monkeypatch.setattr(quantiles, "SMALL", 0)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i, (i + p) % 30, 1 - p / 10 - i / 1000, p) for i in range(30) for p in (1, 2, 3)]
    near = spark.createDataFrame(rows, neighbors.FOUND + ", place int").mapInArrow(count, neighbors.FOUND + ", place int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "id long, label int")
    got = reports.review_order(neighbors.categories(near, labels)).collect()
    assert len(got) == 30 and seen.value == 90


@pytest.mark.parametrize("metric", ["cosine", "rms"])
def test_endless_numbers_have_no_neighbours(spark, metric):
    """A vector that isn't finite neither is a neighbour nor spoils a cell, in any of the three searches."""
    rng = np.random.default_rng(14)
    v = rng.normal(size=(300, 8)).tolist() + [[float("nan")] * 8, [float("inf")] + [1.0] * 7] * 2 + [None]
    x = spark.createDataFrame(list(enumerate(v)), "id long, v array<float>").repartition(3)
    found = [neighbors.nearest(x, 3, 40, metric), neighbors.probed(x, 3, probes=10, cells=10, block_rows=40, metric=metric), certified.certified(x, 3, metric, cells=10, block_rows=40)]
    rows = [sorted((r.id, r.place, r.neighbour) for r in f.collect()) for f in found]
    assert len(rows[0]) == 900 and rows[0] == rows[1] == rows[2]


def test_cells_in_blocks():
    first, parts, blocks = neighbors._packed(np.array([30, 0, 60, 250, 5, 5]), 100)
    assert (first.tolist(), parts.tolist(), blocks) == ([0, 0, 0, 1, 4, 4], [1, 0, 1, 3, 1, 1], 5)


def test_a_vector_goes_once_to_a_block(spark):
    """However many cells are asked, a vector is copied to a block at most once."""
    rng = np.random.default_rng(15)
    x = neighbors.sound(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(400, 8)))], "id long, v array<float>"))
    c = neighbors.centres(x, 20)
    lying, lies, _ = neighbors.in_blocks(x, c, "cosine", 100, 20)
    found = neighbors.searched(lying, c, lies, lambda d, home, off, bound, cells: np.ones(d.shape, bool), 2, "cosine")
    assert lies.shape[1] <= 8 and found.count() == 400 * lies.shape[1] * 2 and found.agg({"compared": "sum"}).first()[0] == 400 * 400
