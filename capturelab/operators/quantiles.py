"""Exact quantiles of groups of any size, by selection in rounds, and places in a total order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept, stored

#: A group of so many rows at most may have its distinct values in one buffer.
SMALL = 1 << 16
#: Parts an octave is cut into in the first round, and a bracket in those after it.
PARTS, BINS = 64, 4096
#: So many brackets are sent to all tasks; more are joined by a shuffle.
BROADCAST_BRACKETS = 100_000


def quantiles(rows: DataFrame, by: list[str], value: Column, shares: list[float], *also: Column, most: int | None = None) -> DataFrame:
    """(by, q, also): for each group, its quantiles by linear interpolation between the two values around them, and further aggregates. Null values don't count; q is null where there are no others.

    most: how many rows a group has at most, if that is known. Groups within SMALL are aggregated at once. Larger ones are never
    brought together: `selected` finds the two values around each quantile from counts by bucket.
    """
    if most is None or most > SMALL:
        rows = kept(rows)
        most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= SMALL:
        return rows.groupBy(*by).agg(F.percentile(value.cast("double"), F.array(*map(F.lit, shares))).alias("q"), *also)
    x = rows.select(F.struct(*(F.col(c) for c in by), F.lit(0).alias("_")).alias("_g"), value.cast("double").alias("_v")).where("_v is not null")
    # where a group's row count is known, so are the ranks around its quantiles
    n = kept(x.groupBy("_g").agg(F.count("*").alias("_n")))
    at = F.transform(F.array(*(F.lit(float(s)) for s in shares)), lambda s: s * (F.col("_n") - 1))
    wanted = n.select("_g", F.explode(F.flatten(F.transform(at, lambda p: F.array(F.floor(p), F.ceil(p))))).alias("rank")).distinct()
    found = selected(x, wanted).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))  # two entries a share

    def between(p: Column) -> Column:
        low, high = F.col("_m")[F.floor(p)], F.col("_m")[F.ceil(p)]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    made = n.join(found, "_g").select("_g", F.transform(at, between).alias("q"))
    every = rows.groupBy(*by).agg(*also) if also else rows.select(*by).distinct() if by else rows.agg(F.lit(0).alias("_none")).drop("_none")
    key = F.struct(*(F.col(c) for c in by), F.lit(0).alias("_"))
    return every.withColumn("_k", key).join(made, F.col("_k") == F.col("_g"), "left").drop("_k", "_g")


def _octave(v: Column) -> Column:
    """A whole number that never falls as v grows: the sign and the logarithm in parts of an octave."""
    size = F.when(F.abs(v) == float("inf"), 1 << 40).otherwise(F.floor(F.log2(F.abs(v)) * PARTS).cast("long") + 1100 * PARTS)
    return F.when(F.isnan(v), 1 << 50).when(v == 0, 0).otherwise(F.when(v > 0, size).otherwise(-size))


def selected(x: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_g, rank, value): the values of some ranks, from 0, among each group's. x: _g (not null), _v double; wanted: _g, rank, each once.

    A round counts the rows of each open bracket by bucket, in the first round by octave, then by equal parts between the bracket's
    least and greatest value. A rank's bucket is its next bracket, until that holds one value. Tasks hold a count for each bucket, whatever the
    rows; a bracket of values within one part of an octave is narrowed BINS times by each round, so five rounds reach neighbouring doubles.
    """
    zero = F.lit(0.0)
    todo, done, first = wanted.select("_g", "rank", zero.alias("lo"), zero.alias("hi"), F.col("rank").alias("left")), None, True
    while True:
        todo = kept(todo)
        if done is not None and todo.isEmpty():
            return done.select("_g", "rank", F.col("lo").alias("value"))
        brackets = todo.select(F.col("_g").alias("_b"), "lo", "hi").distinct()
        if todo.count() <= BROADCAST_BRACKETS:
            brackets = F.broadcast(brackets)
        inside = F.col("_g") == F.col("_b")
        bucket = _octave(F.col("_v"))
        if not first:
            inside = inside & F.col("_v").between(F.col("lo"), F.col("hi"))
            bucket = F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
        cells = x.join(brackets, inside).groupBy("_b", F.col("lo").alias("_lo"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_b", "_lo").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = cells.withColumn("before", before)
        met = todo.join(counted, (F.col("_g") == F.col("_b")) & (F.col("lo") == F.col("_lo")) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        narrowed = kept(met.select("_g", "rank", F.col("least").alias("lo"), F.col("greatest").alias("hi"), (F.col("left") - F.col("before")).alias("left")))
        alone = narrowed.where("lo = hi")
        done, todo, first = alone if done is None else done.unionByName(alone), narrowed.where("lo <> hi"), False


def medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, size, median) of the values v of rows (by, v), where neither is null. `by` and v are read twice.

    First the rows are counted by parts of an octave, then by value within the parts that hold the middle ranks. So little is shuffled and tasks hold counts only,
    if values are rounded: a part has then few different ones.
    """
    part, least, most = _octave(F.col("v")), F.shiftright(F.col("size") - 1, 1), F.shiftright("size", 1)
    group, c = Window.partitionBy(*by), F.col("c")
    middle = (F.col("until") > least) & (F.col("until") - c <= most)
    cells = rows.groupBy(*by, part.alias("part")).agg(F.count("*").alias("c"))
    cells = cells.select("*", F.sum("c").over(group.orderBy("part")).alias("until"), F.sum("c").over(group).alias("size")).where(middle)
    near = stored(cells.select(*by, "part", (F.col("until") - c).alias("before"), "size"))
    values = rows.withColumn("part", part).join(near, [*by, "part"]).groupBy(*by, "part", "before", "size", "v").agg(F.count("*").alias("c"))
    until = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "part").orderBy("v"))
    low, high = F.min("v"), F.max("v")
    return values.withColumn("until", until).where(middle).groupBy(*by, "size").agg(F.when(low == high, low).otherwise(0.5 * low + 0.5 * high).alias("median"))


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their places from 1 in an order. Rows are sorted over all tasks, and only the tasks' row counts come together."""
    x = kept(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = x.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each task
    return x.withColumn("_p", part).join(F.broadcast(before), F.col("_p") == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_p", "_part", "_before")

