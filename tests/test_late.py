import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelab.functions import waveforms as W
from capturelab.operators import distribution, mixtures, preparation, scoring, splits
from capturelab.sources import captures


def test_warnings(spark):
    rows = [("a", [1, 1, 1])] * 9 + [("a", [1, 0, 1])] * 4 + [("a", [1, 1, 0])] + [("a", None)]
    x = spark.createDataFrame(rows, "scope string, y array<int>")
    got = {(r.scope, r.rule, r.subject) for r in distribution.warnings(x, "scope", "y", ["a", "b"]).collect()}
    assert got == {("a", "high_positive_ratio", "0"), ("a", "high_positive_ratio", "2"), ("a", "high_triple_ratio", "111"), ("a", "low_double", "110"), *(("a", "missing_combination", c) for c in ("100", "010", "001", "011")), ("b", "no_samples", "")}


def test_weighted_resample(spark):
    x = spark.createDataFrame([(k, w) for k, w in enumerate([0.0, None, 1.0, 3.0, 500.0])], "k long, w double")
    got = {r.k: r.copies for r in splits.weighted_resample(x, "k", "w", 5040).collect()}
    assert sum(got.values()) == 5040 and not {0, 1} & set(got)
    assert got == {r.k: r.copies for r in splits.weighted_resample(x.repartition(3), "k", "w", 5040).collect()}
    assert got[4] == pytest.approx(5000, rel=0.01) and got[3] > got.get(2, 0)
    assert splits.weighted_resample(x.where("k < 2"), "k", "w", 10).count() == 0


def test_prepared_split(spark, tmp_path):
    x = spark.range(40).select(F.col("id").alias("file"), F.lit("g").alias("group"))
    path, calls = str(tmp_path / "split"), []
    made = lambda: calls.append(1) or x
    first = splits.prepared_split(spark, path, made, "file", ["group"], limits={"g": 10}).collect()
    assert len(first) == 10 and sorted(splits.prepared_split(spark, path, made, "file", ["group"]).collect()) == sorted(first) and calls == [1]


def test_db_trace_channels(spark):
    x = spark.createDataFrame([([-80.0, -78.0, float("nan"), -82.0, -80.0, -79.0],), ([],), (None,), ([float("inf")],)], "x array<double>")
    a, *rest = [r.c for r in x.select(W.db_trace_channels(F.col("x"), 4, 2, 3, 2).alias("c")).collect()]
    y = np.array([0.0, 2.0, 0.0, -2.0, 0.0, 1.0])
    assert rest == [None] * 3 and len(a) == 4 and a[0] == pytest.approx(W.magnitudes(y, 4, 2).ravel(), abs=1e-6)
    assert a[2] == pytest.approx([0.5] * 6) and a[3] == pytest.approx([y.std() / 15] * 6)


def test_augmented(spark):
    x = spark.createDataFrame([("f", [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]]), ("g", None)], "k string, c array<array<float>>")
    still = {"gain": (2.0, 2.0), "snr_db": (200.0, 200.0), "frequency_shift": 0, "time_shift": 0, "frequency_mask": (0.0, 4), "time_mask": (0.0, 6)}
    made = lambda kind="single", **s: [r.y for r in x.select(W.augmented(F.col("k"), F.col("c"), 3, 2, kind, settings=s).alias("y")).collect()]
    assert made(**still)[0][0] == pytest.approx([2, 4, 6, 8, 10, 12], abs=1e-4) and made(**still)[1] is None
    assert made() == made() and min(made("absolute_relative")[0][0]) >= 0 and len(made("absolute_relative")[0]) == 2
    assert made(**still | {"frequency_mask": (1.0, 1)})[0][0].count(0) == 2
    with pytest.raises(ValueError):
        made("db_trace")


def test_scored(spark):
    def load():
        def predict(signals):
            if any(x[0] < 0 for x in signals):
                raise ValueError("negative")
            return np.array([[x[0], 0.0] for x in signals])

        return predict

    x = spark.createDataFrame([("a", [0.0]), ("b", [-1.0]), ("c", None), ("d", [])], "file string, signal array<double>").coalesce(1)
    y = scoring.scored(x, load, 2)
    got = {r.file: (r.prob, r.error) for r in y.collect()}
    assert got == {"a": ([0.5, 0.5], None), "b": (None, "ValueError: negative"), "c": (None, "no signal"), "d": (None, "no signal")}
    assert sorted(r.file for r in scoring.failures(y).collect()) == ["b", "c", "d"]


def test_model_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, nan, 3.0, inf, 5.0, 6.0, 7.0], 1), ("b", [4.0, 2.0], 2), ("c", [nan], 3), ("d", [], 4), ("e", None, 5)]
    x = spark.createDataFrame(rows, "file string, signal array<double>, error int")
    got = {r.file: r for r in preparation.model_input(x, 4, 4, 2, 3, 1).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": None, "c": "no finite values", "d": "no signal", "e": "no signal"}
    assert all((got[k].feature, got[k].record) == (None, None) for k in "cde")
    a, b = got["a"].record, got["b"].record
    assert (a.method, a.crop_start, a.crop_end, a.pad_value, a.nan_count, a.positive_inf_count, a.negative_inf_count) == ("cropped", 1, 5, None, 1, 1, 0)
    assert (a.raw_min, a.raw_max, a.fixed_min, a.fixed_max, a.centre) == (1, 7, 3, 5, 2)
    assert (b.method, b.crop_start, b.pad_value, b.fixed_min, b.centre) == ("padded", None, 0.0, 0.0, 1.5)
    y = np.array([4.0, 2.0, 0.0, 0.0])
    assert got["b"].feature[0] == pytest.approx(np.log1p(W.magnitudes((y - y.mean()) / y.std(), 4, 2)).ravel(), abs=1e-6)
    trace = {r.file: r for r in preparation.model_input(x, 4, 4, 2, 3, 1, "db_trace").collect()}
    assert len(trace["a"].feature) == 4 and (trace["b"].record.pad_value, trace["b"].record.centre, trace["b"].record.deviation) == (3.0, 3.0, None)
    assert preparation.model_input(x.limit(0), 4, 4, 2, 3, 1).count() == 0


def test_training_set(spark):
    rows = lambda n, split: spark.range(n).select(F.col("id").alias("file"), F.lit(split).alias("split"), F.lit(n).alias(f"c{n}"))
    made, real = rows(4, "train").unionByName(rows(4, "test")), rows(5, "train")
    both = preparation.training_set(made, real, "hybrid").groupBy("domain").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("w")).collect()
    assert sorted(map(tuple, both)) == [("real", 5, 0.7), ("synthetic", 4, 0.3)]
    alone = lambda *a: {r.domain for r in preparation.training_set(*a).collect()}
    assert alone(made, None, "hybrid") == alone(made, real.limit(0), "hybrid") == alone(made, real, "hybrid", "test") == alone(made, real) == {"synthetic"} and alone(None, real, "hybrid") == alone(made, real, "real_only") == {"real"}
    for bad in ((made, real, "real_only", "val"), (None, None, "hybrid"), (made, real, "all"), (made, real, "hybrid", "train", (-1, 1))):
        with pytest.raises(ValueError):
            preparation.training_set(*bad)


def test_random_crop(spark):
    x = spark.createDataFrame([(str(k), [float(i) for i in range(9)]) for k in range(200)] + [("s", [1.0]), ("n", None)], "k string, x array<double>")
    made = lambda rows, epoch: {r.k: r.y for r in rows.select("k", W.random_crop(F.col("x"), 4, F.col("k"), 7, epoch).alias("y")).collect()}
    got = made(x, 0)
    assert got == made(x.repartition(5), 0) != made(x, 1) and got.pop("s") == [1, 0, 0, 0] and got.pop("n") is None
    assert {y[0] for y in got.values()} == set(range(6)) and all(np.diff(y).tolist() == [1, 1, 1] for y in got.values())


def test_stored_mixtures_and_backgrounds(spark, tmp_path):
    plan = spark.createDataFrame([(0, [1, 0], "train"), (1, [1, 1], "val")], "sample_id long, label array<int>, split string")
    mixtures.store(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "sample_id long, signal array<double>"), plan, str(tmp_path / "mixed"))
    assert [(r.sample_id, r.signal, r.label) for r in mixtures.stored(spark, str(tmp_path / "mixed"), "val").collect()] == [(1, [2.0], [1, 1])]
    folder = tmp_path / "noise" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("DATA\n0,1\n1,2\n")
    (folder / "a.txt").write_text("DATA\n0,1\n")
    assert [r.signal for r in captures.backgrounds(spark, str(tmp_path / "noise")).collect()] == [[1.0, 2.0]]
    assert captures.backgrounds(spark, str(tmp_path / "noise"), False).count() == captures.backgrounds(spark, str(tmp_path / "none")).count() == 0
