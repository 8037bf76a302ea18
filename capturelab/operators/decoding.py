"""From logits or probabilities to combinations, and reports on what was predicted. K classes; all of it built-in functions.

A row's arrays have K, 2^K - 1 or 2^K entries, whatever the corpus; combinations stand in binary order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, total
from .quantiles import quantiles

#: Weights of the combination, label and count heads: fixed values.
HEADS = (1.0, 0.3, 0.2)


def combinations(classes: int, empty: bool = False) -> list[list[int]]:
    return [[c >> (classes - 1 - k) & 1 for k in range(classes)] for c in range(0 if empty else 1, 2**classes)]


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    return let(top + F.log(total(F.transform(x, lambda v: F.exp(v - top)))), lambda z: F.transform(x, lambda v: v - z))


def softmax(x: Column) -> Column:
    return F.transform(log_softmax(x), F.exp)


def _log_sigmoid(v: Column) -> Column:
    return -(F.greatest(-v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))))


def _literal(rows: list[list[int]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def structured(logits: DataFrame, classes: int) -> DataFrame:
    """logits (labels[K], combos[2^K-1], counts[K]) with combo_prob, prob (the classes' marginals) and pred (the best combination)."""
    combos = combinations(classes)
    x = logits.withColumns({"_c": log_softmax(F.col("combos")), "_n": log_softmax(F.col("counts"))})
    on = [_log_sigmoid(F.get("labels", k)) for k in range(classes)]
    off = [_log_sigmoid(-F.get("labels", k)) for k in range(classes)]

    def score(i: int, bits: list[int]) -> Column:
        label = sum((on[k] if b else off[k] for k, b in enumerate(bits)), F.lit(0.0)) / classes
        return HEADS[0] * F.get("_c", i) + HEADS[1] * label + HEADS[2] * F.get("_n", sum(bits) - 1)

    scored = x.withColumn("_s", F.array(*(score(i, b) for i, b in enumerate(combos)))).withColumn("combo_prob", softmax(F.col("_s")))
    marginal = F.array(*(sum((F.get("combo_prob", i) for i, b in enumerate(combos) if b[k]), F.lit(0.0)) for k in range(classes)))
    best = F.get(_literal(combos), (F.array_position("_s", F.array_max("_s")) - 1).cast("int"))
    return scored.withColumns({"prob": marginal, "pred": best}).drop("_c", "_n", "_s")


def independent(scores: DataFrame, classes: int, threshold: float = 0.5) -> DataFrame:
    """scores (prob[K]) with combo_prob over all 2^K combinations, the empty one first, and pred by threshold."""
    low = [F.log(F.greatest(F.least(F.get("prob", k), F.lit(1 - 1e-7)), F.lit(1e-7))) for k in range(classes)]
    high = [F.log(F.greatest(F.least(1 - F.get("prob", k), F.lit(1.0)), F.lit(1e-7))) for k in range(classes)]
    joint = F.array(*(sum((low[k] if b else high[k] for k, b in enumerate(bits)), F.lit(0.0)) for bits in combinations(classes, empty=True)))
    return scores.withColumn("combo_prob", softmax(joint)).withColumn("pred", F.transform("prob", lambda p: (p.cast("float") >= F.lit(threshold).cast("float")).cast("int")))


def diagnosed(rows: DataFrame, classes: int, empty: bool, low: float = 0.6) -> DataFrame:
    """rows with confidence (of pred), second (combination), second_confidence, margin, entropy (0 to 1) and status."""
    combos = _literal(combinations(classes, empty))
    at = F.conv(F.array_join("pred", ""), 2, 10).cast("int") - (0 if empty else 1)
    ranked = F.array_sort(F.transform("combo_prob", lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    x = rows.withColumns({"confidence": F.get("combo_prob", at), "_second": F.get(ranked, 1)})
    size = 2**classes - (0 if empty else 1)
    entropy = -total(F.transform("combo_prob", lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0))) / F.log(F.lit(float(size)))
    made = {"second": F.get(combos, F.col("_second.i")), "second_confidence": -F.col("_second.p"), "margin": F.col("confidence") + F.col("_second.p"), "entropy": entropy, "status": F.when(F.col("confidence") < low, "low_confidence").otherwise("accepted")}
    return x.withColumns(made).drop("_second")


def sources(label: Column, names: list[str]) -> Column:
    """a+b for the classes that are set, or none."""
    got = F.array_compact(F.array(*(F.when(F.get(label, k) == 1, F.lit(c)) for k, c in enumerate(names))))
    return F.when(F.size(got) == 0, "none").otherwise(F.array_join(got, "+"))


def combination_report(rows: DataFrame, names: list[str]) -> DataFrame:
    """Counts and rates of predicted combinations, overall and by folder; combinations that don't occur count 0."""
    made = rows.select("folder", sources(F.col("pred"), names).alias("combination"))
    n = made.groupingSets([["folder", "combination"], ["combination"]], "folder", "combination").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    n = n.select(F.when(F.col("_g") == 0, "folder").otherwise("overall").alias("scope"), F.when(F.col("_g") == 0, F.col("folder")).alias("folder"), "combination", "n")
    totals = n.groupBy("scope", "folder").agg(F.sum("n").alias("_n"))
    all_names = F.array(*(sources(F.array(*map(F.lit, b)), names) for b in combinations(len(names))))
    want = totals.select("scope", "folder", F.explode(all_names).alias("combination"))
    full = n.unionByName(want.withColumn("n", F.lit(0).cast("long"))).groupBy("scope", "folder", "combination").agg(F.sum("n").alias("n"))
    joined = full.alias("f").join(totals.alias("t"), (F.col("f.scope") == F.col("t.scope")) & F.col("f.folder").eqNullSafe(F.col("t.folder")))
    return joined.select("f.scope", F.col("f.folder").alias("folder"), "f.combination", "f.n", F.round(F.col("f.n") / F.col("_n"), 9).alias("rate"))


def class_report(rows: DataFrame) -> DataFrame:
    """How often each class is present and its mean probability."""
    long = rows.select(F.posexplode(F.arrays_zip("pred", "prob")).alias("class_id", "x"))
    return long.groupBy("class_id").agg(F.sum(F.col("x.pred").cast("long")).alias("present"), F.round(F.avg("x.pred"), 9).alias("present_rate"), F.round(F.avg("x.prob"), 6).alias("mean_prob"))


def confidence_report(rows: DataFrame, low: float = 0.6, failures: int = 0) -> DataFrame:
    """One row: totals, five numbers and mean of confidence, margin and entropy, and which warnings hold."""
    totals = rows.agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < low).alias("low_confidence"))
    metrics = ("confidence", "margin", "entropy")
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in metrics))).alias("x")).select("x.*")
    five = quantiles(long, ["metric"], F.col("v"), [0.05, 0.5, 0.95], F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    parts = {"min": F.col("min"), "p05": F.get("q", F.lit(0)), "median": F.get("q", F.lit(1)), "p95": F.get("q", F.lit(2)), "max": F.col("max"), "mean": F.col("mean")}
    cells = five.agg(*(F.round(F.max(F.when(F.col("metric") == c, v)), 6).alias(f"{c}_{p}") for c in metrics for p, v in parts.items()))
    dominant = rows.groupBy(F.array_join("pred", "").alias("combo")).agg(F.count("*").alias("c")).agg(F.max("c").alias("dominant"))
    one = totals.crossJoin(cells).crossJoin(dominant)  # one row each
    n = F.col("n")
    return one.select(*[c for c in one.columns if c != "dominant"], F.lit(failures > 0).alias("warn_failures"), ((n > 0) & (F.col("low_confidence") >= 0.10 * n)).alias("warn_low_confidence"), F.coalesce((n > 0) & (F.col("dominant") >= 0.80 * n), F.lit(False)).alias("warn_dominant"))


def unknown_rejection(rows: DataFrame) -> DataFrame:
    """One row over captures of unknown groups: how many are fully rejected, and their highest probabilities; zeros if there are none. `false_accepts` has the others by class."""
    top = F.array_max("prob")
    zero = F.forall("pred", lambda v: v == 0)
    out = rows.agg(F.count("*").alias("n"), F.count_if(zero).alias("rejected"), F.avg(top).alias("m"), F.max(top).alias("x"))
    return out.select("n", "rejected", F.round(F.when(F.col("n") > 0, F.col("rejected") / F.col("n")).otherwise(0.0), 9).alias("rejection_rate"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_top"), F.round(F.coalesce("x", F.lit(0.0)), 6).alias("max_top"))


def false_accepts(rows: DataFrame) -> DataFrame:
    """(class_id, n, accepted, rate) over captures of unknown groups: how often each class was said to be present, though none is."""
    x = rows.select(F.posexplode("pred").alias("class_id", "p")).groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("p") == 1).alias("accepted"))
    return x.withColumn("rate", F.round(F.col("accepted") / F.col("n"), 9))


def blend_search(rows: DataFrame, step: float) -> DataFrame:
    """(alpha, accuracy) of (1 - alpha) a + alpha b against the index y, best first; of equals, the smaller alpha. rows: a, b array<double>, y int."""
    if not 0 < step <= 1:
        raise ValueError("step must be in (0, 1]")
    alphas = [round(i * step, 10) for i in range(int(1 / step + 0.5) + 1)]

    def hit(alpha: float) -> Column:
        mixed = F.zip_with("a", "b", lambda p, q: (1 - alpha) * p + alpha * q)
        return let(mixed, lambda m: (F.array_position(m, F.array_max(m)) - 1 == F.col("y")).cast("int"))

    one = rows.agg(*(F.avg(hit(a)).alias(f"h{i}") for i, a in enumerate(alphas)))
    cells = F.array(*(F.struct(F.lit(a).alias("alpha"), F.round(f"h{i}", 9).alias("accuracy")) for i, a in enumerate(alphas)))
    return one.select(F.inline(cells)).orderBy(F.desc("accuracy"), "alpha")


def source_weights(rows: DataFrame, key: str, classes: int) -> DataFrame:
    """Sampling weight of each row (label array<int>): the mean over classes of N by the count of rows that agree in it."""
    bit = lambda k: F.get("label", k)
    counts = rows.agg(F.count("*").alias("_n"), *(F.sum(bit(k)).alias(f"_p{k}") for k in range(classes)))
    x = rows.crossJoin(F.broadcast(counts))  # one row of counts
    agree = [F.when(bit(k) == 1, F.greatest(F.col(f"_p{k}"), F.lit(1))).otherwise(F.greatest(F.col("_n") - F.col(f"_p{k}"), F.lit(1))) for k in range(classes)]
    return x.select(key, F.round(sum((F.col("_n") / a for a in agree), F.lit(0.0)) / classes, 9).alias("weight"))


def positive_weights(rows: DataFrame) -> DataFrame:
    """Of each class, negatives by positives (at least 1)."""
    long = rows.select(F.posexplode("label").alias("class_id", "y"))
    return long.groupBy("class_id").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).withColumn("pos_weight", F.round(F.col("neg") / F.greatest("pos", F.lit(1)), 9))
