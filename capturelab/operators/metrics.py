"""Multi-label decoding and evaluation.

scores: file, group, prob array<double>, target array<int>, K classes.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import combo
from ..sources.shared import kept
from .quantiles import placed


def decided(scores: DataFrame, threshold: float | list[float] = 0.5) -> DataFrame:
    """scores with pred and the flags exact, over and under; probabilities are compared with one threshold or one for each class as 32-bit floats."""
    several = F.array(*(F.lit(t).cast("float") for t in (threshold if isinstance(threshold, list) else [threshold])))
    of = (lambda i: F.get(several, i)) if isinstance(threshold, list) else (lambda i: F.get(several, 0))
    pred = F.transform("prob", lambda p, i: (p.cast("float") >= of(i)).cast("int"))
    x = scores.withColumn("pred", pred)
    over = F.exists(F.zip_with("pred", "target", lambda p, y: p > y), lambda v: v)
    under = F.exists(F.zip_with("pred", "target", lambda p, y: p < y), lambda v: v)
    return x.withColumns({"exact": F.col("pred") == F.col("target"), "over": over, "under": under})


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def class_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, precision, recall and F1 of each class."""
    long = rows.select(*by, F.posexplode(F.arrays_zip("pred", "target")).alias("class_id", "x")).select(*by, "class_id", "x.pred", "x.target")
    n = lambda p, t: F.sum(((F.col("pred") == p) & (F.col("target") == t)).cast("long"))
    c = long.groupBy(*by, "class_id").agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 0).alias("tn"), n(0, 1).alias("fn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    made = {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp)}
    return c.select(*by, "class_id", "tp", "fp", "tn", "fn", (tp + fn).alias("support"), *(F.round(v, 9).alias(k) for k, v in made.items()))


def overall_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Exact match, over and under rates, and micro, macro and sample F1."""
    both = F.aggregate(F.zip_with("pred", "target", lambda p, y: p * y), F.lit(0), lambda a, v: a + v)
    ones = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)
    sample = _ratio(2.0 * both, ones("pred") + ones("target"))
    row = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("exact").cast("int")).alias("exact_match"), F.avg(F.col("over").cast("int")).alias("over_rate"), F.avg(F.col("under").cast("int")).alias("under_rate"), F.avg(sample).alias("sample_f1"))
    c = class_metrics(rows, *by)
    micro = c.groupBy(*by).agg(_ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"), F.avg(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))
    out = row.join(micro, list(by)) if by else row.crossJoin(micro)
    return out.select(*by, "n", *(F.round(m, 9).alias(m) for m in ("exact_match", "over_rate", "under_rate", "sample_f1", "micro_f1", "macro_f1")))


def at_thresholds(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """overall_metrics for each of a few thresholds."""
    several = scores.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    pred = F.transform("prob", lambda p: (p.cast("float") >= F.col("threshold").cast("float")).cast("int"))
    x = several.withColumn("pred", pred)
    flags = {"exact": F.col("pred") == F.col("target"), "over": F.exists(F.zip_with("pred", "target", lambda p, y: p > y), lambda v: v), "under": F.exists(F.zip_with("pred", "target", lambda p, y: p < y), lambda v: v)}
    return overall_metrics(x.withColumns(flags), "threshold")


def confusion(rows: DataFrame) -> DataFrame:
    """Combination confusion in long form, with the rate within the true combination."""
    n = rows.groupBy(combo(F.col("target")).alias("true_combo"), combo(F.col("pred")).alias("pred_combo")).agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("true_combo")), 9))


def accuracy_by(rows: DataFrame, by: str, expected: list[str]) -> DataFrame:
    """Exact-match accuracy of each key; expected keys without rows count 0."""
    keys = rows.sparkSession.createDataFrame([(k,) for k in expected], f"{by} string")
    got = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("exact").cast("long")).alias("correct"))
    return got.join(F.broadcast(keys), by, "full").select(by, F.coalesce("n", F.lit(0)).alias("n"), F.round(_ratio(F.coalesce("correct", F.lit(0)), F.coalesce("n", F.lit(0))), 9).alias("accuracy"))


def threshold_search(scores: DataFrame, classes: int, start: float, end: float, step: float) -> DataFrame:
    """Exact match and micro F1 of every combination of per-class thresholds.

    Rows are first counted by the bins that decide them. A row is an exact match in a box of the grid: for a class that is there below its bin, for another from its bin on.
    So it adds its weight at the box's lower corner and takes it back where the box ends, 2 corners a class that is there, and sums along one class after another give the count at each
    point. True and predicted positives add up over classes, so they come from one table of bins a class. The work grows with the bins and with the points, not with both at once.
    """
    n = int(round((end - start) / step)) + 1
    grid = [round(start + i * step, 10) for i in range(n)]
    steps = F.array(*(F.lit(g).cast("float") for g in grid))
    bins = kept(scores.select(F.transform("prob", lambda p: F.size(F.filter(steps, lambda g: p.cast("float") >= g))).alias("bin"), "target").groupBy("bin", "target").agg(F.count("*").alias("w")))
    axes = range(classes)
    there = lambda k: F.get("target", F.lit(k)) == 1
    bin_ = lambda k: F.get("bin", F.lit(k)).cast("long")
    corners = bins.select(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("w").alias("w"))).alias("x"), "bin", "target")
    for k in axes:
        size = n ** (classes - 1 - k)
        moved = lambda x, by, sign: F.struct((x["at"] + by).alias("at"), (sign * x["w"]).alias("w"))
        lower = F.transform("x", lambda x: moved(x, F.when(there(k), 0).otherwise(bin_(k) * size), 1))
        upper = F.when(there(k) & (bin_(k) < n), F.transform("x", lambda x: moved(x, bin_(k) * size, -1)))
        # a box that begins behind the last point has none
        corners = corners.where(there(k) | (bin_(k) < n)).withColumn("x", F.concat(lower, F.coalesce(upper, F.array().cast("array<struct<at:bigint,w:bigint>>"))))
    deltas = corners.select(F.explode("x").alias("x")).groupBy("x.at").agg(F.sum("x.w").alias("exact"))
    points = scores.sparkSession.range(n**classes).withColumnRenamed("id", "at").join(deltas, "at", "left").withColumn("exact", F.coalesce("exact", F.lit(0)))
    points = points.select("at", "exact", *((F.floor(F.col("at") / n ** (classes - 1 - k)) % n).cast("int").alias(f"g{k}") for k in axes))
    for k in axes:
        others = [f"g{j}" for j in axes if j != k]
        points = points.withColumn("exact", F.sum("exact").over(Window.partitionBy(*others).orderBy(f"g{k}")))
    long = bins.select("w", F.posexplode(F.arrays_zip("bin", "target")).alias("k", "x")).select("k", "x.bin", (F.col("x.target") == 1).cast("long").alias("y"), "w")
    by_bin = long.groupBy("k", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("t")).collect()  # a row for each class and bin
    total = bins.agg(F.sum("w")).first()[0] or 0
    if not total:
        points = points.limit(0)
    past = lambda k, i, c: sum(r[c] for r in by_bin if r.k == k and r.bin > i)
    table = lambda c: [F.get(F.array(*(F.lit(past(k, i, c)).cast("long") for i in range(n))), F.col(f"g{k}")) for k in axes]
    tp, predicted = sum(table("t")[1:], table("t")[0]), sum(table("w")[1:], table("w")[0])
    both = predicted + F.lit(sum(r.t for r in by_bin))
    value = lambda k: F.element_at(F.array(*map(F.lit, grid)), F.col(f"g{k}") + 1).alias(f"t{k}")
    return points.select(*(value(k) for k in axes), F.round(F.col("exact") / F.lit(total), 9).alias("exact_match"), F.round(_ratio(2 * tp, both), 9).alias("micro_f1"))


def ranked(search: DataFrame, metric: str, classes: int, most: int | None = None) -> DataFrame:
    """The grid points of a search by a metric, the best first and equals in the grid's order, with place; the first `most` if given."""
    order = [F.desc(metric), *(f"t{k}" for k in range(classes))]
    if most is None:
        return placed(search, *order).withColumn("place", F.col("place").cast("int"))
    return search.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def source_counts(rows: DataFrame) -> DataFrame:
    """decided rows with the numbers of true and predicted classes."""
    ones = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)
    return rows.withColumns({"true_sources": ones("target"), "pred_sources": ones("pred")})


def open_set(scores: DataFrame, threshold: float, unknown: float) -> DataFrame:
    """known, uncertain (nothing over the threshold) or unknown (not even over the lower one)."""
    top = F.array_max("prob")
    return scores.select("file", F.when(top < unknown, "unknown").when(top < threshold, "uncertain").otherwise("known").alias("status"), F.round(top, 6).alias("top"))


def presence(scores: DataFrame) -> DataFrame:
    """Each class's status, most probable first."""
    long = scores.select("file", F.posexplode("prob").alias("class_id", "p"))
    status = F.when(F.col("p") >= 0.7, "present").when(F.col("p") >= 0.4, "suspected").otherwise("absent")
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("p"), "class_id"))
    return long.select("file", "class_id", F.round("p", 6).alias("p"), status.alias("status"), rank.alias("place"))
