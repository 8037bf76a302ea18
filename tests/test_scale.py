"""Jobs that must hold at any size: selection, certified neighbours, many dimensions, many templates, grids, mixtures from an inventory, the store, the classifier."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelab.operators import audit, certified, classifier, metrics, mixtures, neighbors, quantiles, redundancy, templates
from capturelab.sources import feature_store


def test_selection_equals_percentile(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = [*rng.normal(size=400), *(10.0 ** rng.uniform(-300, 300, 100)), *(-(10.0 ** rng.uniform(-300, 300, 100))), *[0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf")], *[1.0, np.nextafter(1, 2), np.nextafter(1, 0)] * 9, *[7.0] * 50]
    rows = [("a", float(v)) for v in values] + [(None, float(v)) for v in rng.normal(size=30)] + [("b", 2.5), ("c", None), ("d", 1.0), ("d", float("nan"))]
    x = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    direct = {r.g: (r.q, r.n) for r in quantiles.quantiles(x, ["g"], F.col("v"), shares, F.count("*").alias("n")).collect()}
    monkeypatch.setattr(quantiles, "SMALL", 0)
    got = {r.g: (r.q, r.n) for r in quantiles.quantiles(x, ["g"], F.col("v"), shares, F.count("*").alias("n")).collect()}
    assert str(got) == str({g: direct[g] for g in got}) and set(got) == set(direct) and got["c"] == (None, 1)
    monkeypatch.setattr(quantiles, "BROADCAST_BRACKETS", 0)
    assert str(quantiles.quantiles(x.where("g = 'a'"), [], F.col("v"), shares).first().q) == str(direct["a"][0])
    assert quantiles.quantiles(x.limit(0), ["g"], F.col("v"), shares).count() == 0


def test_selection_among_ten_million(spark):
    """Ten million different values in one group: no task holds more than counts by bucket."""
    n = 10_000_000
    x = spark.range(n, numPartitions=8).select(((F.col("id") * 7_368_787 % n) / 8.0).alias("v"))
    got = quantiles.quantiles(x, [], F.col("v"), [0.05, 0.5, 0.95], most=n).first().q
    assert got == [p * (n - 1) / 8 for p in (0.05, 0.5, 0.95)]


def test_medians_by_counts(spark):
    """Medians equal percentile's, of groups with null keys, ties, one value, and values of all sizes."""
    rng = np.random.default_rng(5)
    values = [*rng.normal(size=801), *(10.0 ** rng.uniform(-300, 300, 100)), *(-(10.0 ** rng.uniform(-300, 300, 99))), 0.0, -0.0, float("inf"), float("-inf"), *[7.0] * 50]
    rows = [("a", 0, float(v)) for v in values] + [(None, 1, float(round(v, 1))) for v in rng.normal(size=30)] + [("b", 0, 2.5), ("d", 1, 1.0), ("d", 1, float("nan")), ("e", 0, -3.0), ("e", 0, 4.0)]
    x = spark.createDataFrame(rows, "g string, m int, v double").repartition(5).select(F.struct("g", F.lit(0).alias("_")).alias("k"), "m", "v")
    got = quantiles.medians(x, ["k", "m"]).select("k", "m", "size", "median").collect()
    want = x.groupBy("k", "m").agg(F.count("v").alias("size"), F.percentile("v", F.lit(0.5)).alias("median")).collect()
    assert len(got) == 5 and sorted(map(str, got)) == sorted(map(str, want))
    assert quantiles.medians(x.limit(0), ["k", "m"]).count() == 0


def test_issues_are_found_in_two_scans(spark):
    """One scan of the stored statistics for the issues of each file and one for duplicates; files are not joined or sorted again."""
    n = 4000
    rows = spark.range(n).select(F.col("id").cast("string").alias("file"), (F.col("id") % 3).cast("string").alias("group"), F.when(F.col("id") % 2 == 0, "p").alias("condition_path"), F.when(F.col("id") % 5 > 0, (F.col("id") % 4).cast("string")).alias("label"))
    level = lambda i: -60 - F.col("id") % 97 / 50 - F.when(F.col("id") % 1001 == 0, 40).otherwise(0) - i
    parsed = spark.range(n).select(F.col("id").cast("string").alias("file"), F.array(*(level(i).cast("float") for i in (0, 1, 3))).alias("signal"), F.lit(0).alias("discarded_nonfinite_count"), F.lit(None).cast("string").alias("parse_error"))
    x = audit.issue_table(rows, parsed, -200.0)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 4 and "ExistingRDD" not in plan and "Sort" not in plan, plan
    got = x.collect()
    far = [r for r in got if r.type == "condition_outlier"]
    assert {r.file for r in far} == {"0", "1001", "2002", "3003"} and {r.detail.split(" ")[0] for r in far} == {"mean_db", "median_db"}
    assert sum(r.type == "possible_clipping" for r in got) == n and len(got) == 2 * n - 4 + len(far)
    # 97 signals, each with more than one label; an outlier's signal is that of its value alone
    assert {r.file for r in got if r.type == "duplicate_across_labels"}.isdisjoint({"0", "1001", "2002", "3003"}) and sum(r.type == "duplicate_across_labels" for r in got) == n - 4


def test_places_in_an_order(spark):
    x = spark.createDataFrame([(i, i * 7 % 30) for i in range(100)], "i long, v long").repartition(6)
    got = [(r.v, r.i) for r in quantiles.placed(x, F.desc("v"), "i").orderBy("place").collect()]
    assert got == sorted(((i * 7 % 30, i) for i in range(100)), key=lambda t: (-t[0], t[1]))
    assert sorted(r.place for r in quantiles.placed(x, "v").collect()) == list(range(1, 101)) and quantiles.placed(x.limit(0), "v").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "rms"])
def test_certified_neighbours(spark, metric):
    rng = np.random.default_rng(8)
    tops = rng.normal(size=(40, 12)) * 4
    v = [(tops[i % 40] + rng.normal(size=12) * 0.05).tolist() for i in range(1200)] + [tops[0].tolist()] * 15 + [[0.0] * 12] * 3 + [None]
    x = spark.createDataFrame(list(enumerate(v)), "id long, v array<float>").repartition(4)
    want = {(r.id, r.place): (r.neighbour, r.similarity) for r in neighbors.nearest(x, 5, metric=metric).collect()}
    found = certified.certified(x, 5, metric, cells=48, block_rows=100).collect()
    assert {(r.id, r.place): (r.neighbour, pytest.approx(r.similarity, abs=2e-9)) for r in found} == want
    pairs = sum({r.id: r.compared for r in found}.values())
    assert pairs < 0.1 * 1218**2
    few = certified.certified(x.where("id < 4"), 5, metric).collect()
    assert sorted((r.id, r.place) for r in few) == [(i, p) for i in range(4) for p in (1, 2, 3)]
    assert certified.certified(x.limit(0), 5, metric).count() == 0
    # a vector that most rows have is compared once
    copies = spark.createDataFrame([(i, [1.0, 2.0] if i % 10 else [float(i), 1.0]) for i in range(3000)], "id long, v array<float>").repartition(4)
    rows = certified.certified(copies, 3, metric).collect()
    assert len(rows) == 9000 and max(r.compared for r in rows) <= 400
    want = {(r.id, r.place): r.neighbour for r in neighbors.nearest(copies, 3, metric="cosine").collect()} if metric == "cosine" else {}
    assert all(want[r.id, r.place] == r.neighbour for r in rows if metric == "cosine")
    assert {r.id: r.neighbour for r in rows if r.place == 3 and r.id % 10 and r.id > 3} == {i: 3 for i in range(4, 3000) if i % 10}


def test_many_dimensions(spark):
    rng = np.random.default_rng(9)
    d, n = 4096, 260
    v = (rng.normal(size=(n, 90)) * 0.93 ** np.arange(90)) @ rng.normal(size=(90, d)) + 3
    x = spark.createDataFrame([(r.tolist(),) for r in v], "v array<float>").repartition(4)
    v = v.astype(np.float32).astype(float)
    s = np.linalg.svd(v - v.mean(0), compute_uv=False) ** 2
    assert redundancy.dimensions(x, d) == [int(np.searchsorted(np.cumsum(s) / s.sum(), q) + 1) for q in (0.9, 0.95, 0.99)]
    assert redundancy.dimensions(x.limit(1), d) == [0, 0, 0]


def test_fit_of_forty_templates(spark):
    rng = np.random.default_rng(10)
    for k, bins in ((40, 60), (12, 300), (1, 5)):
        a, b = rng.random((bins, k)), rng.normal(size=(50, bins)) + rng.random((50, k)) @ rng.random((k, bins))
        b[0] = 0
        c = templates.nonnegative_fit(a, b)
        g = (c @ a.T - b) @ a
        assert (c >= 0).all() and (g > -1e-7 * np.abs(b @ a).max()).all() and np.abs(g * c).max() < 1e-6 * max(1, np.abs(c).max()) * np.abs(b @ a).max()
    same = np.column_stack([a, a])  # columns that repeat have no single optimum, but the same fit
    assert templates.nonnegative_fit(same, b).sum(1) == pytest.approx(c.sum(1))
    t = rng.random((40, 64))
    x = spark.createDataFrame([((t[3] + 2 * t[17]).tolist(),)], "power array<double>")
    f = templates.mixture_features(x, t).first().features
    assert len(f) == 122 and f[3] == pytest.approx(1 / 3, abs=1e-6) and f[17] == pytest.approx(2 / 3, abs=1e-6) and f[120] < 1e-9


def test_grid_of_five_classes(spark):
    rng = np.random.default_rng(11)
    rows = [(rng.random(5).round(3).tolist(), [int(b) for b in rng.integers(0, 2, 5)]) for _ in range(60)]
    x = spark.createDataFrame(rows, "prob array<double>, target array<int>")
    got = metrics.threshold_search(x, 5, 0.05, 0.95, 0.05)
    some = {tuple(r)[:5]: (r.exact_match, r.micro_f1) for r in got.where("pmod(hash(t0, t1, t2, t3, t4), 4001) = 0").collect()}
    assert got.count() == 19**5 and len(some) > 200
    p, y = np.array([r[0] for r in rows], np.float32), np.array([r[1] for r in rows])
    for t, (exact, f1) in some.items():
        pred = p >= np.array(t, np.float32)
        assert exact == pytest.approx((pred == y).all(1).mean(), abs=1e-8) and f1 == pytest.approx(2 * (pred & (y == 1)).sum() / (pred.sum() + y.sum()), abs=1e-8)
    assert metrics.threshold_search(x.limit(0), 2, 0.2, 0.8, 0.1).count() == 0
    best = metrics.ranked(metrics.threshold_search(x, 2, 0.1, 0.9, 0.1), "exact_match", 2)
    assert [r.place for r in best.orderBy("place").collect()] == list(range(1, 82)) and best.orderBy("place").first().exact_match == max(r.exact_match for r in best.collect())


def test_mixtures_from_an_uneven_inventory(spark):
    stock = {("a", "x"): 7, ("a", "y"): 1, ("b", "x"): 2, ("b", "z"): 3}
    captures = spark.createDataFrame([(c, f, f"{c}{f}{i}") for (c, f), n in stock.items() for i in range(n)], "class string, frequency string, file string").repartition(3)
    plan = mixtures.inventory_plan(mixtures.inventory(captures), {"train": 50, "val": 7, "test": 0}, ["a", "b", "c"], 3)
    rows = plan.collect()
    for split, n in (("train", 50), ("val", 7)):
        counts = {b: sum(r.split == split and tuple(r.label) == b for r in rows) for b in ((1, 0, 0), (0, 1, 0), (1, 1, 0))}
        assert sum(counts.values()) == n and max(counts.values()) - min(counts.values()) <= 1
    slots = mixtures.inventory_slots(plan, captures, ["a", "b", "c"], 3).collect()
    assert sorted((r.sample_id, r.k) for r in slots) == sorted((r.sample_id, k) for r in rows for k, bit in enumerate(r.label) if bit)
    for c in "ab":
        mine = [r for r in slots if r["class"] == c]
        have = {f: n for (d, f), n in stock.items() if d == c}
        for f, n in have.items():
            taken = sum(r.frequency == f for r in mine)
            assert abs(taken - len(mine) * n / sum(have.values())) < 1
            each = [sum(r.file == f"{c}{f}{i}" for r in mine) for i in range(n)]
            assert max(each) - min(each) <= 1
    again = mixtures.inventory_slots(plan.repartition(5), captures.repartition(2), ["a", "b", "c"], 3)
    assert sorted(map(str, again.collect())) == sorted(map(str, slots))
    assert mixtures.inventory_plan(mixtures.inventory(captures.limit(0)), {"train": 5}, ["a"], 3).count() == 0


def test_stored_mixtures_have_a_record(spark, tmp_path):
    import json

    source = "struct<k:int,class:string,frequency:string,file:string,gain:double,polarity:double,shift:bigint>"
    x = spark.createDataFrame([(i, [(0, "a", "x", "f", 1.0, -1.0, 3)], [0.5]) for i in range(4)], f"sample_id long, sources array<{source}>, signal array<double>")
    plan = spark.createDataFrame([(i, [1, 0], "train" if i else "val") for i in range(3)], "sample_id long, label array<int>, split string")
    mixtures.store(x, plan, f"{tmp_path}/m", ["a", "b"], {"mix": "rms"})
    got = mixtures.stored(spark, f"{tmp_path}/m", "train").collect()
    assert sorted(r.sample_id for r in got) == [1, 2] and mixtures.classes(spark, f"{tmp_path}/m") == ["a", "b"]
    record = json.loads(got[0].record)
    assert record["sources"][0]["file"] == "f" and record["label"] == [1, 0] and json.loads(record["augmentations"]) == {"mix": "rms"}


def test_store_after_a_killed_job_and_two_writers(spark, tmp_path, monkeypatch):
    x = spark.createDataFrame([(f"f{i}", float(i)) for i in range(6)], "file string, x double")
    compute = lambda rows: rows.select("file", "key", (F.col("x") * 2).alias("y"))
    path, settings = str(tmp_path / "store"), {"n": 1}
    with pytest.raises(FileNotFoundError):
        feature_store.features(spark, path, settings)
    with monkeypatch.context() as m:
        m.setattr(feature_store._Folder, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            feature_store.update(x, path, settings, compute)
    with pytest.raises(FileNotFoundError):  # the part is there, but no manifest lists it
        feature_store.features(spark, path, settings)
    gate = threading.Barrier(2, timeout=120)

    def slow(rows):
        out = compute(rows).collect()
        gate.wait()  # both have read the same manifest before either commits
        return spark.createDataFrame(out, "file string, key string, y double")

    failed = []

    def writer(some):
        try:
            feature_store.update(some, path, settings, slow)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(x.where(c),)) for c in ("x < 4", "x >= 2")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(r.file for r in feature_store.features(spark, path, settings).collect()) == [f"f{i}" for i in range(6)]


def test_classifier_equals_a_dense_fit(spark):
    rng = np.random.default_rng(12)
    y = rng.choice(4, 300, p=[0.6, 0.2, 0.15, 0.05]) * 2
    x = rng.normal(size=(300, 5)) * [1, 10, 0.1, 1, 0] + np.eye(5)[y // 2] * [1.5, 10, 0.1, 1, 0] + 7
    rows = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))] + [(900, None, [0.0] * 5), (901, 2, None)], "file long, y int, features array<double>").repartition(5)
    model = classifier.softmax_classifier(rows)
    assert model.classes == [0, 2, 4, 6] and model.gradient < 1e-8
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    z1, t = np.hstack([z, np.ones((300, 1))]), np.eye(4)[y // 2]
    weight = 300 / (4 * t.sum(0))[y // 2]
    w = np.zeros((4, 6))
    for _ in range(20000):  # plain gradient descent on the same cost
        p = np.exp(z1 @ w.T)
        p /= p.sum(1, keepdims=True)
        w -= 0.002 * (((p - t) * weight[:, None]).T @ z1 + w * [1, 1, 1, 1, 1, 0])
    got = {r.file: r for r in model.transform(rows).collect()}
    assert np.array([got[i].class_prob for i in range(300)]) == pytest.approx(p, abs=1e-6)
    assert all(got[i].prediction == 2 * int(np.argmax(got[i].class_prob)) for i in range(300)) and got[901].class_prob is None and got[901].prediction is None
    few = classifier.softmax_classifier(rows, most=10)
    assert few.classes == model.classes and few.gradient < 1e-8
    with pytest.raises(ValueError):
        classifier.softmax_classifier(rows.limit(0))


def test_saturation_of_merged_bands(spark):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(90, 6))
    x = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    got = {r.size: r for r in redundancy.saturation(x, 5, (7, 20, 60, 500), 3).collect()}
    assert set(got) == {7, 20, 60}
    import hashlib

    scale = max(np.ptp(v.mean(0)), np.median(np.ptp(v, axis=1)))
    for k, r in got.items():
        off, dev = [], []
        for repeat in range(3):
            order = sorted(range(90), key=lambda i: (hashlib.md5(f"5|{repeat}|{i}".encode()).hexdigest(), i))[:k]
            off.append(np.sqrt(((v[order].mean(0) - v.mean(0)) ** 2).mean()) / scale)
            dev.append(np.abs(v[order].std(0) - v.std(0)).mean() / scale)
        assert r.mean_wave_nrmse == pytest.approx(np.mean(off), abs=1e-6) and r.point_std_error == pytest.approx(np.mean(dev), abs=1e-6)




def test_duplicate_signals_differ_by_the_sign_of_zero(spark, monkeypatch):
    from capturelab.operators import results

    rows = [("a", "g", [0.0, 1.0]), ("b", "h", [-0.0, 1.0]), ("c", "h", [0.0, 1.0]), ("d", "g", [5.0]), ("e", "g", [5.0]), ("f", "h", None), ("i", "k", []), ("j", "l", [])] + [(f"z{i}", "gh"[i % 2], [7.5] * 3) for i in range(50)]
    x = spark.createDataFrame(rows, "file string, group string, signal array<double>").repartition(4)
    got = {r.file: (r.copies, r.labels) for r in results.duplicate_signals(x).collect()}
    assert got == {"a": (2, 2), "c": (2, 2), "i": (2, 2), "j": (2, 2), **{f"z{i}": (50, 2) for i in range(50)}}
    # signals whose fingerprints are made equal are told apart by their bytes
    monkeypatch.setattr(results, "fingerprints", lambda c: c.withColumn("fingerprint", F.lit("same")))
    assert {r.file for r in results.duplicate_signals(x).collect()} == {"a", "c"}
    assert results.duplicate_signals(x.limit(0)).count() == 0


def test_results_of_a_mode(spark):
    from capturelab.operators import results

    x = spark.createDataFrame([("f", [0.9, 0.2], [1, 0], [0.1, 0.7, 0.2])], "file string, prob array<double>, pred array<int>, combo_prob array<double>")
    a = results.prediction_results(x, ["u", "v"], "structured", [0.5, 0.5]).first()
    assert a.sources == ["u"] and a.combinations == ["01", "10", "11"] and a.combination == "10" and not a.thresholds_apply and a.percentages == [90.0, 20.0]
    b = results.prediction_results(x.drop("combo_prob"), ["u", "v"], "multilabel", [0.5, 0.5]).first()
    assert b.combination_probabilities is None and b.combinations == [] and b.thresholds_apply
    with pytest.raises(ValueError):
        results.prediction_results(x, ["u", "v"], "other", [0.5, 0.5])


def test_ranks_of_small_and_large_strata_agree(spark, monkeypatch):
    from capturelab.operators import splits

    x = spark.createDataFrame([(i, "ab"[i % 3 % 2] if i % 7 else None) for i in range(300)], "k long, g string").repartition(4)
    small = {r.k: (r._rank, r._size) for r in splits.stratum_rank(x, "k", ["g"]).collect()}
    monkeypatch.setattr(splits, "ALONE", 0)
    assert {r.k: (r._rank, r._size) for r in splits.stratum_rank(x, "k", ["g"]).collect()} == small


def test_template_classifier_query(spark):
    """The query's probabilities are those of plain gradient descent on its features."""
    from capturelab.plans import model_queries
    from capturelab.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    p = model_queries._powers(spark, d)
    t = np.array([r.template for r in templates.build(p, 1000, model_queries.SEED).orderBy("class").collect()])
    rows = templates.mixture_features(p, t).select("file", "y", "features").collect()
    x, y = np.array([r.features for r in rows]), np.array([r.y for r in rows])
    z = np.hstack([(x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), np.ones((len(x), 1))])
    target, n = np.eye(3)[y], len(y)
    weight, w = n / (3 * target.sum(0))[y], np.zeros((3, z.shape[1]))
    for _ in range(30000):
        q = np.exp(z @ w.T)
        q /= q.sum(1, keepdims=True)
        w -= 0.002 * (((q - target) * weight[:, None]).T @ z + w * np.r_[np.ones(z.shape[1] - 1), 0])
    got = {r.file: r for r in QUERIES["template_classifier"](spark, d).collect()}
    assert [got[r.file].p for r in rows] == pytest.approx(q.max(1), abs=2e-4) and np.mean([got[r.file].prediction == k for r, k in zip(rows, q.argmax(1), strict=True)]) > 0.99
