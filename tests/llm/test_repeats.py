"""Near-duplicates and stages: ids with several texts, hot buckets, clashing columns, nulls, empty tables."""

import pytest

from capturelab.llm import near_dup

WORDS = [f"w{i:03d}" for i in range(400)]


def run(start, n=60):
    return " ".join(WORDS[(start * 7 + i * (start % 5 + 1)) % 400] for i in range(n))


def components(sets, rows):
    """Smallest reachable id by brute force: rows are (id, set)."""
    ids = {i for i, _ in rows if i is not None}
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if i is not None and j is not None and (i == j or (a and b and 100 * len(a & b) >= 75 * len(a | b))) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize(
    "rows",
    [
        [(5, run(1)), (5, run(2)), (3, run(2)), (6, run(1))],
        [(5, run(1)), (5, run(2)), (5, None), (9, run(1) + " x"), (2, run(2) + " y"), (1, "")],
        [(7, run(1)), (7, run(2)), (8, run(3)), (8, run(2)), (9, run(3)), (4, run(4)), (4, run(4)), (None, run(1))],
    ],
)
def test_an_id_with_several_texts_is_one_node(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = components(None, [(i, shingles(t)) for i, t in rows])
    got = near_dup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == sorted((-1 if i is None else i, len(shingles(t)), -1 if i is None else want[i], i is None or want[i] == i) for i, t in rows)


def test_pieces_of_a_bucket_find_the_same_links(spark, monkeypatch):
    """A template's variants, far and near: many share buckets, few are alike."""
    base = run(3, 40)
    rows = [(i, base + " " + " ".join(f"v{i // 2}q{k}" for k in range(9)) + f" {i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(None, [(i, shingles(t)) for i, t in rows])
    for size in (near_dup.BUCKET_ROWS, 5):
        monkeypatch.setattr(near_dup, "BUCKET_ROWS", size)
        assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()} == want
    assert 1 < len(set(want.values()))
