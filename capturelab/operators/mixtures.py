"""Labelled mixtures of single-source captures, planned and drawn by hashes, so that a mixture depends on its seed and number alone."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import waveforms as W
from ..functions.arrays import draw
from .decoding import combinations
from .quantiles import placed
from .redundancy import numbered
from .splits import stratum_rank


def plan(spark, samples: int, names: list[str], seed: int, ratios=(0.8, 0.1)) -> DataFrame:
    """(sample_id, label, split): combinations whose counts differ by at most 1; shares are cut to whole numbers, the rest is test."""
    combos = combinations(len(names))
    bits = F.array(*(F.array(*map(F.lit, b)) for b in combos))
    train, val = int(samples * ratios[0]), int(samples * ratios[1])
    x = numbered(spark.range(samples).withColumnRenamed("id", "k"), "k", seed, samples).withColumnRenamed("place", "sample_id")
    split = F.when(F.col("sample_id") < train, "train").when(F.col("sample_id") < train + val, "val").otherwise("test")
    return x.select("sample_id", F.get(bits, (F.col("k") % len(combos)).cast("int")).alias("label"), split.alias("split"))


def uniform(seed: int, name: str, key: Column, low: float, high: float) -> Column:
    return low + draw(seed, name, key) / F.lit(2.0**32) * (high - low)


def _ordinals(captures: DataFrame) -> DataFrame:
    """(class, frequency, file, ordinal): each file's place from 0 within its frequency, counted within ranges of the files' names and over them."""
    x = placed(captures.select("class", "frequency", "file"), "class", "frequency", "file", name="_place")
    first = x.groupBy("class", "frequency").agg(F.min("_place").alias("_first"))
    return x.join(first, ["class", "frequency"]).select("class", "frequency", "file", (F.col("_place") - F.col("_first")).cast("long").alias("ordinal"))


def slots(planned: DataFrame, captures: DataFrame, names: list[str], seed: int, length: int, gain=(0.8, 1.2), flip: bool = False, shift: bool = True) -> DataFrame:
    """For each source of each mixture: the capture drawn for it (first a frequency of its class, then a file there), and its gain, polarity and shift.

    captures: class, frequency, file.
    """
    x = planned.select("sample_id", F.posexplode("label").alias("k", "bit")).where("bit = 1")
    name = F.get(F.array(*map(F.lit, names)), F.col("k"))
    key = F.concat_ws("|", "sample_id", "k")
    files = _ordinals(captures)
    sizes = captures.groupBy("class", "frequency").agg(F.count("*").alias("files")).withColumn("f", (F.row_number().over(Window.partitionBy("class").orderBy("frequency")) - 1).cast("long"))
    per_class = sizes.groupBy("class").agg(F.count("*").alias("frequencies"))
    x = x.select("sample_id", "k", name.alias("class"), key.alias("key")).join(per_class, "class")
    x = x.withColumn("f", draw(seed, "frequency", F.col("key")) % F.col("frequencies")).join(sizes, ["class", "f"])
    x = x.withColumn("ordinal", draw(seed, "file", F.col("key")) % F.col("files")).join(files, ["class", "frequency", "ordinal"])
    polarity = F.when(draw(seed, "flip", F.col("key")) < 2**31, -1.0).otherwise(1.0) if flip else F.lit(1.0)
    roll = draw(seed, "shift", F.col("key")) % length if shift else F.lit(0).cast("long")
    return x.select("sample_id", "k", "class", "frequency", "file", uniform(seed, "gain", F.col("key"), *gain).alias("gain"), polarity.alias("polarity"), roll.alias("shift"))


def inventory(captures: DataFrame) -> DataFrame:
    """(class, frequency, files) of captures (class, frequency, file)."""
    return captures.groupBy("class", "frequency").agg(F.count("*").alias("files"))


def inventory_plan(stock: DataFrame, samples: dict[str, int], names: list[str], seed: int, most_sources: int | None = None) -> DataFrame:
    """(sample_id, split, label): for each split, so many mixtures over the combinations of the classes that the inventory has, in counts that differ by at most 1, in seeded order. Combinations have at most so many sources."""
    spark, have = stock.sparkSession, {r["class"] for r in stock.where("files > 0").select("class").distinct().collect()}  # a row for each class
    usable = [b for b in combinations(len(names)) if all(name in have or not bit for name, bit in zip(names, b, strict=True)) and sum(b) <= (most_sources or len(names))]
    bits, first, parts = F.array(*(F.array(*map(F.lit, b)) for b in usable)), 0, []
    if not usable:
        return spark.createDataFrame([], "sample_id long, split string, label array<int>")
    for split, n in samples.items():
        order = numbered(spark.range(n).select(F.concat_ws("|", F.lit(split), F.col("id").cast("string")).alias("k"), "id"), "k", seed, n)
        parts.append(order.select((F.col("place") + first).alias("sample_id"), F.lit(split).alias("split"), F.get(bits, (F.col("id") % len(usable)).cast("int")).alias("label")))
        first += n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_out(stock: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, frequency, files, quota, before): the slots a class wants (class, slots) over its frequencies in proportion to their files, by largest remainder, of equals the first frequency; before sums the quotas of earlier ones."""
    w = Window.partitionBy("class")  # a row for each frequency of a class
    x = stock.where("files > 0").join(wanted, "class").withColumn("all", F.sum("files").over(w))
    x = x.withColumn("floor", F.expr("slots * files div all")).withColumn("rest", F.expr("slots * files % all"))
    left = F.col("slots") - F.sum("floor").over(w)
    x = x.withColumn("left", left).withColumn("place", F.row_number().over(w.orderBy(F.desc("rest"), "frequency")))
    x = x.withColumn("quota", F.col("floor") + (F.col("place") <= F.col("left")).cast("long"))
    return x.select("class", "frequency", "files", "quota", (F.sum("quota").over(w.orderBy("frequency")) - F.col("quota")).alias("before"))


def inventory_slots(planned: DataFrame, captures: DataFrame, names: list[str], seed: int) -> DataFrame:
    """(sample_id, split, k, class, frequency, file): the capture of each source of each planned mixture. A class's slots are shared out over its frequencies by their files, and within a frequency every file is taken equally often, to one more or less.

    Slots and files have places in a seeded order within their class or frequency, by ranges of the order, so that no task holds a whole class or frequency.
    """
    x = planned.select("sample_id", "split", F.posexplode("label").alias("k", "bit")).where("bit = 1")
    x = x.select("sample_id", "split", "k", F.get(F.array(*map(F.lit, names)), F.col("k")).alias("class"), F.concat_ws("|", "sample_id", "k").alias("_key"))
    quotas = shared_out(inventory(captures), x.groupBy("class").agg(F.count("*").alias("slots")))
    ranked = stratum_rank(x, "_key", ["class"], seed).withColumn("_slot", F.col("_rank") - 1).drop("_rank", "_size")
    mine = ranked.join(F.broadcast(quotas.withColumnRenamed("class", "_class")), (F.col("class") == F.col("_class")) & (F.col("_slot") >= F.col("before")) & (F.col("_slot") < F.col("before") + F.col("quota")))  # a row for each class and frequency
    files = stratum_rank(captures.select("class", "frequency", "file"), "file", ["class", "frequency"], seed).select("class", "frequency", "file", (F.col("_rank") - 1).alias("_ordinal"))
    mine = mine.withColumn("_ordinal", (F.col("_slot") - F.col("before")) % F.col("files"))
    return mine.join(files, ["class", "frequency", "_ordinal"]).select("sample_id", "split", "k", "class", "frequency", "file")


def rolled(x: Column, by: Column) -> Column:
    """x turned right by so many places."""
    by = by.cast("int")
    return F.when(by == 0, x).otherwise(F.concat(F.slice(x, F.size(x) - by + 1, by), F.slice(x, 1, F.size(x) - by)))


def mixed(slot_rows: DataFrame, captures: DataFrame, length: int, normalize: str = "none") -> DataFrame:
    """(sample_id, sources, signal): the sum of each mixture's captures, standardized, scaled, flipped and turned. captures: file, signal."""
    x = slot_rows.join(captures.select("file", "signal"), "file")
    part = F.transform(W.standardized(W.fix_length(F.col("signal"), length)), lambda v: v * F.col("gain") * F.col("polarity"))
    x = x.select("sample_id", "k", F.struct("k", "class", "frequency", "file", "gain", "polarity", "shift").alias("source"), rolled(part, F.col("shift")).alias("part"))
    # a mixture has at most as many parts as there are classes
    g = x.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("k", "source", "part"))).alias("g"))
    zero = F.array_repeat(F.lit(0.0), length)
    summed = F.aggregate("g", zero, lambda a, r: F.zip_with(a, r["part"], lambda p, q: p + q))
    y = g.select("sample_id", F.transform("g", lambda r: r["source"]).alias("sources"), summed.alias("signal"))
    if normalize == "none":
        return y
    if normalize not in ("zscore", "rms"):
        raise ValueError(f"unknown normalization: {normalize}")
    return y.withColumn("signal", (W.standardized if normalize == "zscore" else W.unit_rms)(F.col("signal")))


def store(mixtures: DataFrame, planned: DataFrame, path: str, names: list[str] | None = None, augmentations: dict | None = None) -> None:
    """Writes mixtures with their labels, sources and record, a folder for each split; a mixture that is not planned is left out. The record is JSON: the sample, its sources, its label and the settings it was augmented by. The list of classes is a file of its own."""
    x = mixtures.join(planned.select("sample_id", "label", "split"), "sample_id")
    record = F.to_json(F.struct(*(c for c in ("sample_id", "sources", "label") if c in x.columns), F.lit(json.dumps(augmentations or {}, sort_keys=True)).alias("augmentations")))
    x.withColumn("record", record).write.partitionBy("split").parquet(path)
    if names is not None:
        listed = mixtures.sparkSession.createDataFrame(list(enumerate(names)), "place int, name string")
        listed.coalesce(1).write.json(f"{path}/_classes")  # readers of the mixtures pass over names that begin with an underscore


def stored(spark, path: str, split: str) -> DataFrame:
    """The mixtures of a split, as store() wrote them; only that split's folder is read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def classes(spark, path: str) -> list[str]:
    """The list of classes that store() wrote beside the mixtures."""
    return [r.name for r in spark.read.schema("place int, name string").json(f"{path}/_classes").orderBy("place").collect()]


def with_background(mixtures: DataFrame, backgrounds: DataFrame, seed: int, length: int, scale=(0.05, 0.2)) -> DataFrame:
    """Mixtures plus a scaled, standardized background capture each; unchanged if there is none. backgrounds: file, signal."""
    n = backgrounds.count()
    if n == 0:
        return mixtures
    noise = numbered(backgrounds, "file", seed, n).select(F.col("place").alias("_b"), W.standardized(W.fix_length(F.col("signal"), length)).alias("_s"))
    x = mixtures.withColumn("_b", draw(seed, "background", F.col("sample_id")) % n).join(noise, "_b")
    x = x.withColumn("_k", uniform(seed, "scale", F.col("sample_id"), *scale))
    return x.withColumn("signal", F.zip_with("signal", "_s", lambda a, b: a + b * F.col("_k"))).drop("_b", "_s", "_k")


def with_noise(mixtures: DataFrame, seed: int, snr_db=(10.0, 30.0), offset=(0.0, 0.0)) -> DataFrame:
    """Mixtures with a constant offset and Gaussian noise at a drawn signal-to-noise ratio; silent ones get no noise."""

    @F.pandas_udf("array<double>")
    def made(ids: pd.Series, signals: pd.Series) -> pd.Series:
        def one(i, s):
            rng = np.random.default_rng([seed, int(i)])
            x = np.asarray(s, np.float64) + rng.uniform(*offset)
            power = float(np.mean(x * x)) if len(x) else 0.0
            return x if power < 1e-12 else x + rng.normal(0, np.sqrt(power / 10 ** (rng.uniform(*snr_db) / 10)), len(x))

        return pd.Series([None if s is None else one(i, s) for i, s in zip(ids, signals, strict=True)])

    return mixtures.withColumn("signal", made("sample_id", "signal"))
