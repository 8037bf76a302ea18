"""Seeded splits. Order within a stratum is that of md5(seed|key), so a split does not depend on partitioning."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let


#: A stratum of so many rows at most is ordered by one task.
ALONE = 1 << 20


def order_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def stratum_rank(rows: DataFrame, key: str, strata: list[str], seed: int = 42) -> DataFrame:
    """rows with _rank, the place in the seeded order of their stratum, and _size, its rows. If a stratum has more than ALONE rows, ranks are those within 4,096 ranges of the order, after the counts of the ranges before, so that a large stratum is no single task."""
    largest = rows.groupBy(*strata).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= ALONE:
        w = Window.partitionBy(*strata)
        return rows.withColumns({"_rank": F.row_number().over(w.orderBy(order_key(seed, F.col(key)), key)).cast("long"), "_size": F.count("*").over(w)})
    placed = rows.withColumn("_order", order_key(seed, F.col(key))).withColumn("_range", F.substring("_order", 1, 3))
    sizes = placed.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*strata)
    before = sizes.select(*(F.col(c).alias(f"_by_{c}") for c in strata), F.col("_range").alias("_part"), (F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_size"))
    within = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_order", key))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in strata]
    joined = placed.withColumn("_within", within).join(before, [F.col("_range") == F.col("_part"), *same])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_within")).alias("_rank"), "_size")


def split_counts(n: Column, ratios=(0.7, 0.15, 0.15)) -> Column:
    """An array: largest-remainder counts of train, val and test; ties go to the earlier. With n >= 3 an empty split takes one from the largest."""
    floors = [F.floor(n * r + 1e-9) for r in ratios]
    rest = [n * r - f for r, f in zip(ratios, floors, strict=True)]
    left = n - sum(floors[1:], floors[0])
    ahead = [sum(((rest[j] > rest[i] + 1e-9) if j > i else (rest[j] >= rest[i] - 1e-9)).cast("int") for j in range(3) if j != i) for i in range(3)]
    counts = F.array(*(f + (a < left).cast("int") for f, a in zip(floors, ahead, strict=True)))
    for i in range(3):
        if ratios[i] > 0:
            counts = let(counts, _filled(n, i))
    return counts


def _filled(n: Column, i: int):
    return lambda c: F.when((n >= 3) & (F.get(c, i) == 0) & (F.array_max(c) > 1), _moved(c, i)).otherwise(c)


def _moved(c: Column, i: int) -> Column:
    """c with one more in place i, taken from the first of the largest."""
    donor = F.array_position(c, F.array_max(c)) - 1
    return F.transform(c, lambda v, j: v + (j == i).cast("long") - (j == donor).cast("long"))


def stratified_split(rows: DataFrame, key: str, strata: list[str], ratios=(0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """rows with a column split."""
    ranked = stratum_rank(rows, key, strata, seed).withColumn("_c", split_counts(F.col("_size"), ratios))
    ranked = ranked.withColumns({"_train": F.get("_c", 0), "_val": F.get("_c", 0) + F.get("_c", 1)})
    split = F.when(F.col("_rank") <= F.col("_train"), "train").when(F.col("_rank") <= F.col("_val"), "val").otherwise("test")
    return ranked.select(*rows.columns, split.alias("split"))


def quota(rows: DataFrame, key: str, by: str, limits: dict[str, int], default: int, seed: int = 42) -> DataFrame:
    """rows with selected: the first so many of each group in seeded order."""
    most = F.lit(default)
    for k, n in limits.items():
        most = F.when(F.col(by) == k, n).otherwise(most)
    return stratum_rank(rows, key, [by], seed).withColumn("selected", F.col("_rank") <= most).select(*rows.columns, "selected")


def holdout_counts(n: Column, val: float, test: float) -> tuple[Column, Column]:
    """How many of n rows are held out for val and test: shares rounded half to even, at least one each of three rows or more, and less while nothing is left to train on (val first if it is not smaller)."""
    v, t = F.bround(n * F.lit(val)).cast("long"), F.bround(n * F.lit(test)).cast("long")
    v, t = F.when(n >= 3, F.greatest(v, F.lit(1))).otherwise(v), F.when(n >= 3, F.greatest(t, F.lit(1))).otherwise(t)
    pair = F.struct(v.alias("v"), t.alias("t"))
    for _ in range(3):  # val + test < 1, so rounding up leaves at most two too many, and a floor of one one more
        pair = let(pair, lambda p: F.when(p["v"] + p["t"] < n, p).when(p["v"] + p["t"] == 0, p).when((p["v"] >= p["t"]) & (p["v"] > 0), F.struct((p["v"] - 1).alias("v"), p["t"].alias("t"))).otherwise(F.struct(p["v"].alias("v"), (p["t"] - 1).alias("t"))))
    return pair["v"], pair["t"]


def nested_subsets(rows: DataFrame, key: str, by: str, sizes: list[int], val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with split (val, test or train, cut in seeded order in each group) and smallest: the smallest of the sizes whose training subset takes the row, null beyond all. A larger subset thus contains the smaller ones, and val and test are the same for all."""
    v, t = holdout_counts(F.col("_size"), val, test)
    ranked = stratum_rank(rows, key, [by], seed).withColumns({"_val": v, "_test": t})
    rank = F.col("_rank")
    split = F.when(rank <= F.col("_val"), "val").when(rank <= F.col("_val") + F.col("_test"), "test").otherwise("train")
    smallest = F.lit(None).cast("int")
    for s in sorted(sizes, reverse=True):
        smallest = F.when(rank - F.col("_val") - F.col("_test") <= s, s).otherwise(smallest)
    return ranked.withColumn("split", split).select(*rows.columns, "split", F.when(F.col("split") == "train", smallest).alias("smallest"))


def subset_manifest(subsets: DataFrame, by: str, sizes: list[int]) -> DataFrame:
    """For each group and size: all rows, those to train on, how many the size takes, and whether it is limited by what there is."""
    groups = subsets.groupBy(by).agg(F.count("*").alias("total"), F.count(F.when(F.col("split") == "train", 1)).alias("available"))
    return groups.select(by, "total", "available", F.explode(F.array(*map(F.lit, sizes))).alias("requested")).select("*", F.least("available", "requested").alias("actual"), (F.col("available") < F.col("requested")).alias("limited"))


def first_per_group(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")


def combo_weights(rows: DataFrame, by: str) -> DataFrame:
    """Sampling weights of combinations: one over the count."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(1 / F.count("*"), 9).alias("weight"))


def weighted_resample(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """rows with copies: how often n draws with replacement took each; rows that none took go. Keys are unique.

    Weights become whole numbers of 2**24 parts of the largest (null and less than half a part: never drawn), laid end to end over
    4096 buckets of md5(key) by a running sum in each and one over their totals. Draws are even positions of md5(seed|draw); draws and
    rows meet in cells of equal length, over several of which a heavy row may reach, so no task holds all of either."""
    top = rows.agg(F.max(weight)).first()[0]
    if not top or top <= 0:
        return rows.limit(0).withColumn("copies", F.lit(0).cast("long"))
    parts = F.greatest(F.coalesce(F.round(F.col(weight) / F.lit(float(top)) * 2**24).cast("long"), F.lit(0)), F.lit(0).cast("long"))
    bucket = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 3)
    cut = rows.select(F.col(key).alias("_key"), parts.alias("_w"), bucket.alias("_bucket")).where("_w > 0")
    sizes = cut.groupBy("_bucket").agg(F.sum("_w").alias("_size"), F.count("*").alias("_rows"))
    offsets = sizes.select("_bucket", (F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")).alias("_offset"))
    total, count = sizes.agg(F.sum("_size"), F.sum("_rows")).first()
    cell = max(1, total // count)
    end = F.col("_offset") + F.sum("_w").over(Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    laid = cut.join(F.broadcast(offsets), "_bucket").select("_key", "_w", end.alias("_end"))
    reach = F.sequence(F.floor((F.col("_end") - F.col("_w")) / cell).cast("long"), F.floor((F.col("_end") - 1) / cell).cast("long"))
    spans = laid.select("_key", (F.col("_end") - F.col("_w")).alias("_start"), "_end", F.explode(reach).alias("_cell"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    draws = rows.sparkSession.range(n).select(F.pmod(draw, F.lit(total)).alias("_at")).withColumn("_cell", F.floor(F.col("_at") / cell).cast("long"))
    taken = draws.join(spans, "_cell").where("_at >= _start AND _at < _end").groupBy("_key").agg(F.count("*").alias("copies"))
    return rows.join(taken, F.col(key) == F.col("_key")).drop("_key")


def prepared_split(spark, path: str, index, key: str, strata: list[str], ratios=(0.7, 0.15, 0.15), seed: int = 42, limits: dict[str, int] | None = None, by: str = "group") -> DataFrame:
    """The split at path; where there is none, that of the rows of index(), after a quota by group if limits are given, is written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    split = stratified_split(index(), key, strata, ratios, seed)
    if limits is not None:
        split = quota(split, key, by, limits, 2**31 - 1, seed).where("selected").drop("selected")
    split.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
