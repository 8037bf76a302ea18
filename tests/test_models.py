import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelab.functions import waveforms as W
from capturelab.operators import decoding, mixtures, redundancy, templates
from capturelab.sources import feature_store


def one(spark, values, column):
    return spark.createDataFrame([(values,)], "x array<double>").select(column(F.col("x")).alias("y")).first().y


def test_structured_decoding(spark):
    combos = [-10.0] * 7
    combos[5] = 10.0
    x = spark.createDataFrame([([0.0] * 3, combos, [-10.0, 10.0, -10.0])], "labels array<double>, combos array<double>, counts array<double>")
    r = decoding.diagnosed(decoding.structured(x, 3), 3, empty=False).first()
    assert r.pred == [1, 1, 0] and sum(r.combo_prob) == pytest.approx(1) and r.margin == pytest.approx(r.confidence - r.second_confidence)
    assert all(0 <= p <= 1 for p in r.prob)


def test_combination_order():
    assert ["".join(map(str, b)) for b in decoding.combinations(3)] == ["001", "010", "011", "100", "101", "110", "111"]


def test_blend_search(spark):
    one_hot = lambda k, p: [p if i == k else (1 - p) / 6 for i in range(7)]
    x = spark.createDataFrame([(one_hot(6, 0.94), one_hot(y, 0.94), y) for y in (0, 3, 5)], "a array<double>, b array<double>, y int")
    r = decoding.blend_search(x, 0.25).first()
    assert r.alpha >= 0.5 and r.accuracy == 1.0


def test_reports_of_nothing(spark):
    x = spark.createDataFrame([], "file string, folder string, prob array<double>, pred array<int>, combo_prob array<double>, confidence double, margin double, entropy double")
    r = decoding.confidence_report(x).first()
    assert (r.n, r.warn_low_confidence, r.warn_dominant) == (0, False, False)
    assert decoding.combination_report(x, ["a", "b"]).count() == 0
    assert decoding.unknown_rejection(x).first().asDict() == {"n": 0, "rejected": 0, "rejection_rate": 0.0, "mean_top": 0.0, "max_top": 0.0}


def test_lengths(spark):
    assert one(spark, [-93.0, -77.0, -67.0], lambda c: W.fix_trace(c, 6)) == [-93, -77, -67, -77, -77, -77]
    assert one(spark, [float(i) for i in range(10)], lambda c: W.fix_length(c, 4)) == [3, 4, 5, 6]
    assert one(spark, [1.0, 2.0, 6.0], lambda c: W.head(c, 5)) == [1, 2, 6, 2, 2]
    assert one(spark, [1.0, 2.0, 6.0], lambda c: W.head(c, 2)) == [1, 2]


def test_standardize(spark):
    assert one(spark, [3.0] * 4, W.standardized) == [0] * 4
    y = one(spark, [1.0, float("nan"), float("inf"), -float("inf")], W.standardized)
    assert np.isfinite(y).all() and np.std(y) == pytest.approx(1)


def test_stft(spark):
    x = [0.0, 2.0, 0.0, -2.0] * 2
    flat, log = (one(spark, x, lambda c, s=s: W.stft(c, 4, 0, 3, 2, s))[0] for s in ("absolute", "log1p"))
    assert max(flat) > max(log)
    assert flat == pytest.approx(W.magnitudes(np.array(x), 4, 0).ravel(), abs=1e-6)
    two = one(spark, x, lambda c: W.stft(c, 4, 0, 3, 2, representation="absolute_relative"))
    ten = one(spark, [10 * v for v in x], lambda c: W.stft(c, 4, 0, 3, 2, representation="absolute_relative"))
    assert two[1] == pytest.approx(ten[1], abs=1e-5) and max(ten[0]) == pytest.approx(10 * max(two[0]), rel=1e-5)
    assert one(spark, [], lambda c: W.stft(c, 4, 0, 3, 2)) is None


def test_feature_shapes(spark):
    x = [float(np.sin(i / 3)) for i in range(300)]
    assert len(one(spark, x, W.audit_feature)) == 616
    shape = one(spark, x, W.shape_feature)
    assert len(shape) == 256 and np.linalg.norm(shape[:128]) == pytest.approx(1, abs=1e-5)
    assert len(one(spark, x, W.spectral_signature)) == 128
    assert one(spark, [], W.audit_feature) is None


def test_dimensions(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 6)) * [9, 5, 3, 1, 0.5, 0.1] + 100
    x = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>").repartition(5)
    s = np.linalg.svd(v - v.mean(0), compute_uv=False) ** 2
    assert redundancy.dimensions(x, 6) == [int(np.searchsorted(np.cumsum(s) / s.sum(), q) + 1) for q in (0.9, 0.95, 0.99)]
    assert redundancy.dimensions(x.limit(1), 6) == redundancy.dimensions(x.limit(0), 6) == [0, 0, 0]


def test_numbered(spark):
    x = spark.range(50).withColumnRenamed("id", "k")
    small, large = ({r.k: r.place for r in redundancy.numbered(x, "k", 7, n).collect()} for n in (50, 10**6))
    assert small == large and sorted(small.values()) == list(range(50))


def test_nonnegative_fit():
    """The conditions of an optimum: no negative coefficient, no gradient where positive, none that would lower the cost where zero."""
    rng = np.random.default_rng(2)
    a, b = rng.random((12, 4)), rng.normal(size=(40, 12))
    c = templates.nonnegative_fit(a, b)
    g = (c @ a.T - b) @ a
    assert (c >= 0).all() and (g > -1e-8).all() and np.abs(g * c).max() < 1e-8


def test_template_features(spark):
    t = np.array([[0.7, 0.2, 0.1, 0], [0, 0.1, 0.2, 0.7], [0.1, 0.2, 0.6, 0.1]])
    x = spark.createDataFrame([((0.8 * t[0] + 0.2 * t[2]).tolist(),), (None,)], "power array<double>")
    got = [r.features for r in templates.mixture_features(x, t).collect()]
    f = next(v for v in got if v)
    assert None in got and len(f) == 11 and f[0] > f[2] and f[1] < 1e-5


def test_combination_model(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.normal(size=4) + 6 * np.eye(4)[i % 3]).tolist()) for i in range(90)]
    x = spark.createDataFrame(rows, "file long, y int, features array<double>")
    got = templates.combination_model(x, 20).transform(templates.with_vectors(x))
    assert got.where("prediction = y").count() >= 88


def test_mixtures(spark):
    names = ["a", "b"]
    captures = spark.createDataFrame([(c, f, f"{c}{f}{i}", [float((i + j) % 5) for j in range(9)]) for c in names for f in ("x", "y") for i in range(3)], "class string, frequency string, file string, signal array<double>")
    plan = mixtures.plan(spark, 31, names, 1)
    counts = [r["count"] for r in plan.groupBy("label").count().collect()]
    assert max(counts) - min(counts) <= 1 and {r.split: r["count"] for r in plan.groupBy("split").count().collect()} == {"train": 24, "val": 3, "test": 4}
    x = mixtures.mixed(mixtures.slots(plan, captures, names, 1, 8, flip=True), captures, 8)
    again = mixtures.mixed(mixtures.slots(plan, captures.repartition(7), names, 1, 8, flip=True), captures, 8)
    assert sorted(map(str, x.collect())) == sorted(map(str, again.collect())) and x.count() == 31
    clean = {r.sample_id: np.array(r.signal) for r in x.collect()}
    for r in mixtures.with_noise(x, 1, (20.0, 20.0)).collect():
        noise = np.array(r.signal) - clean[r.sample_id]
        assert noise.any() == (np.mean(clean[r.sample_id] ** 2) >= 1e-12)
    assert mixtures.with_background(x, captures, 1, 8).count() == 31
    assert mixtures.with_background(x, captures.limit(0), 1, 8) is x


def test_feature_store(spark, tmp_path):
    x = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "file string, x double")
    seen = []

    def compute(rows):
        seen.append(sorted(r.file for r in rows.select("file").collect()))
        return rows.select("file", "key", (F.col("x") * 2).alias("y"))

    path = str(tmp_path / "store")
    assert feature_store.update(x.limit(2), path, {"n": 1}, compute).count() == 2
    assert feature_store.update(x, path, {"n": 1}, compute).count() == 3
    assert feature_store.update(x, path, {"n": 2}, compute).count() == 3
    feature_store.update(x, path, {"n": 1}, compute, rebuild=True)
    assert [len(s) for s in seen] == [2, 1, 3, 3]


def test_features_of_batches(spark):
    """Rows of several lengths in one batch have the features that numpy gives each alone."""
    rng = np.random.default_rng(5)
    rows = [rng.normal(size=n).tolist() for n in (1, 2, 7, 300, 7, 300)] + [[], None]
    x = spark.createDataFrame(list(enumerate(rows)), "id int, x array<double>").coalesce(1)
    got = x.select("id", W.audit_feature(F.col("x")).alias("a"), W.spectral_signature(F.col("x")).alias("s"), W.stft(F.col("x"), 4, 2, 3, 5, "log1p", "absolute_relative", "double").alias("m")).collect()
    for r in got:
        if not rows[r.id]:
            assert (r.a, r.s, r.m) == (None, None, None)
            continue
        v = np.array(rows[r.id])
        spread = lambda y, n: np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(y)), y) if len(y) > 1 else np.full(n, y[0])
        level = spread(v, 256)
        spectrum = np.log1p(np.abs(np.fft.rfft(v - v.mean())))
        edges = np.linspace(0, len(spectrum), min(128, len(spectrum)) + 1).astype(int)
        assert r.a[:256] == pytest.approx(level, abs=1e-5) and r.a[512:608] == pytest.approx(spread(np.log1p(np.abs(np.fft.rfft(level - level.mean()))), 96), abs=1e-4)
        assert r.a[608:] == pytest.approx([level.mean(), level.std(), level.min(), level.max(), np.ptp(level), *np.percentile(level, [5, 50, 95])], abs=1e-5)
        assert r.s == pytest.approx([spectrum[a:b].mean() for a, b in zip(edges, edges[1:], strict=False)])
        m = np.log1p(W.boxed(W.magnitudes(v, 4, 2), 3, 5))
        assert r.m[0] == pytest.approx(m.ravel()) and r.m[1] == pytest.approx(np.log1p(m / max(np.sqrt(np.mean(m * m)), 1e-12)).ravel())
