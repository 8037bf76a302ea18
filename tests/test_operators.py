import os

import pytest
from pyspark.sql import functions as F

from capturelab.functions import labels as L
from capturelab.operators import audit, index, metrics, neighbors, reports, splits
from capturelab.plans.queries import ORACLES, QUERIES


def test_split_counts(spark):
    want = {0: (0, 0, 0), 1: (1, 0, 0), 2: (2, 0, 0), 3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 6: (4, 1, 1), 8: (6, 1, 1), 9: (6, 2, 1), 10: (7, 2, 1), 11: (8, 2, 1), 13: (9, 2, 2), 17: (12, 3, 2), 20: (14, 3, 3), 33: (23, 5, 5), 50: (35, 8, 7), 100: (70, 15, 15), 101: (71, 15, 15), 2000: (1400, 300, 300)}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", splits.split_counts(F.col("n")).alias("c")).collect()
    assert {r.n: tuple(r.c) for r in rows} == want


def test_split_ignores_partitioning(spark):
    rows = spark.range(300).select(F.col("id").alias("file"), (F.col("id") % 3).cast("string").alias("g"))
    one, seven = (sorted(map(tuple, splits.stratified_split(rows.repartition(k), "file", ["g"]).collect())) for k in (1, 7))
    assert one == seven and len(one) == 300


def test_signal_stats(spark):
    x = spark.createDataFrame([("a", "g", "c", [-80.0, -79.0, -60.0, -61.0])], "file string, group string, condition_path string, signal array<double>")
    r = audit.signal_stats(x).first()
    got = [r.n, r.max_jump, r.jump_count, r.mean_db, r.median_db, r.std_db, r.p01_db, r.p05_db, r.p95_db, r.p99_db, r.diff_p95, r.diff_p99, r.jump_ratio, r.boundary_ratio]
    assert got == pytest.approx([4, 19, 1, -70, -70, 9.5131, -79.97, -79.85, -60.15, -60.03, 17.2, 18.64, 0.3333, 0.25])


def test_labels(spark):
    names = ["source_1_source_3_source_5_mix", "unknown_x", "motor", "source_1", "source_1_source_3", "source_10"]
    x = spark.createDataFrame([(n,) for n in names], "g string")
    got = [(r.l, r.e is None) for r in x.select(L.parse_group(F.col("g"), ["source_1", "source_3", "source_5"]).alias("p")).select(F.col("p.label").alias("l"), F.col("p.error").alias("e")).collect()]
    assert got == [([1, 1, 1], True), ([0, 0, 0], True), (None, False), ([1, 0, 0], True), (None, False), (None, False)]


def test_metrics(spark):
    x = spark.createDataFrame([("a", "g", [0.9, 0.8, 0.7], [1, 1, 1]), ("b", "g", [0.9, 0.7, 0.6], [1, 1, 0])], "file string, group string, prob array<double>, target array<int>")
    r = metrics.overall_metrics(metrics.decided(x)).first()
    assert (r.exact_match, r.over_rate, r.under_rate) == (0.5, 0.5, 0.0)


def test_neighbours_do_not_depend_on_blocks(spark):
    v = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("v"))
    one, many = (sorted(map(tuple, neighbors.nearest(v, 3, b).select("id", "neighbour", "place").collect())) for b in (100, 7))
    assert one == many and len(one) == 180


def test_probed_neighbours(spark):
    v = spark.range(300).select("id", F.when(F.col("id") < 299, F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i).cast("float"))).alias("v"))
    for metric in ("cosine", "rms"):
        exact, whole, some = (set(map(tuple, x.select("id", "neighbour", "place").collect())) for x in (neighbors.nearest(v, 3, metric=metric), neighbors.probed(v, 3, probes=17, block_rows=9, metric=metric), neighbors.probed(v, 3, metric=metric)))
        assert exact == whole and len(exact) == 897
        assert len({t[:2] for t in exact} & {t[:2] for t in some}) >= 0.9 * len(exact)
    assert neighbors.probed(v.limit(0), 3).count() == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_probed_query_finds_the_neighbours(spark):
    exact, some = ({(r.id, r.neighbour) for r in QUERIES[q](spark, "/root/testdata/sf0.01").collect()} for q in ("nearest_neighbours", "probed_neighbours"))
    assert len(exact & some) >= 0.9 * len(exact)


#: Held by tests of their parts against numpy, by conditions of the optimum or by their recall.
WITHOUT_SQL = {"pca_dimensions", "template_features", "augmented_spectra", "probed_neighbours", "template_classifier"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and not set(ORACLES) - set(QUERIES)


@pytest.fixture(scope="module")
def tables():
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cell = lambda v: repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    want = tables.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})")
    assert got == sorted(tuple(map(cell, r)) for r in want.fetchall())


def test_issue_table_by_hand(spark):
    rows = [("a", "s1", "p", "[1,0]"), ("b", "s2", "p", "[0,1]"), ("c", "s2", "p", "[0,1]"), ("d", "s2", "p", "[0,1]"), ("e", "s3", "", "[1,1]")]
    parsed = [("a", [-80.0, -78.0, -76.0, -79.0], 1, None), ("b", [-80.0, -78.0, -76.0, -79.0], 0, None), ("c", [-95.0] * 4, 0, None), ("d", [], 0, "line 1: not numeric"), ("e", [-80.0, -60.0, 3.0], 0, None)]
    x = audit.issue_table(spark.createDataFrame(rows, "file string, group string, condition_path string, label string"), spark.createDataFrame(parsed, "file string, signal array<float>, discarded_nonfinite_count int, parse_error string"), -90.0, 4)
    assert sorted((r.severity, r.type, r.file) for r in x.collect()) == [
        ("error", "duplicate_across_labels", "a"), ("error", "duplicate_across_labels", "b"), ("error", "flat_or_nearly_flat", "c"), ("error", "length_mismatch", "e"), ("error", "nonfinite_values", "a"), ("error", "nonnegative_db_values", "e"), ("error", "parse_failure", "d"),
        ("review", "large_db_jump", "e"), ("review", "possible_clipping", "a"), ("review", "possible_clipping", "b"), ("review", "possible_clipping", "e"), ("review", "possible_no_signal", "c"),
    ]


def test_holdout_counts(spark):
    want = {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (1, 1), 10: (2, 2), 30: (4, 4), 50: (8, 8), 2000: (300, 300)}
    rows = spark.createDataFrame([(n,) for n in want], "n long").select("n", *(c.alias(a) for a, c in zip("vt", splits.holdout_counts(F.col("n"), 0.15, 0.15), strict=True))).collect()
    assert {r.n: (r.v, r.t) for r in rows} == want
    x = spark.createDataFrame([(2,), (3,), (5,)], "n long").select(*(c.alias(a) for a, c in zip("vt", splits.holdout_counts(F.col("n"), 0.5, 0.49), strict=True))).collect()
    assert [(r.v, r.t) for r in x] == [(0, 1), (1, 1), (2, 2)]


def test_subsets_are_nested(spark):
    x = splits.nested_subsets(spark.range(80).select(F.col("id").alias("file"), (F.col("id") % 2).alias("g")), "file", "g", [30, 5, 12])
    rows = x.collect()
    assert sum(r.split != "train" for r in rows) == 24 and {r.smallest for r in rows if r.split != "train"} == {None}
    assert [sum(r.smallest is not None and r.smallest <= s for r in rows if r.g == 0) for s in (5, 12, 30)] == [5, 12, 28]


def test_reports_refuse_what_does_not_fit(spark):
    p = spark.createDataFrame([(1, True), (2, False)], "id long, exact boolean")
    c = spark.createDataFrame([(1, "typical"), (2, "boundary")], "id long, category string")
    assert reports.expected_errors(900, 0.9933) == 6 and {r.category: r.errors for r in reports.error_locations(p, c, 1).collect()} == {"typical": 0, "boundary": 1}
    with pytest.raises(ValueError):
        reports.error_locations(p, c, 2)
    rows = spark.createDataFrame([("train", "[1,0]", " TRUE "), ("train", "[1, 1]", "no"), ("val", "[0,1]", "no")], "split string, label string, selected_for_train string")
    assert sorted(r.label_vec for r in index.training_rows(rows, 2).collect()) == [[0, 1], [1, 0]]
    with pytest.raises(Exception, match="another length"):
        index.training_rows(rows, 3).collect()
