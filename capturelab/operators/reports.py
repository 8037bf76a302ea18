"""Reports on indexes, splits and predictions, in long form where their keys vary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.shared import kept
from .audit import fingerprint
from .decoding import combinations
from .index import bucket
from .metrics import class_metrics
from .quantiles import quantiles


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _cell(section: str, key: Column, count: Column, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), key.alias("key"), count.cast("long").alias("count"), value.alias("value"))


def _ones(label) -> Column:
    return F.aggregate(label, F.lit(0), lambda a, v: a + v)


def distribution(rows: DataFrame, classes: list[str], groups: list[str], ratios: list[str], splits: list[str]) -> DataFrame:
    """(split, section, key, count, value) of rows (split, group, ratio, label_vec): samples, labels, groups and ratios (expected ones without rows count 0), each class's positives and negatives with the positives' share, sources a sample, the largest count over the smallest of expected labels and groups (null if that is 0), and the gap between the classes' shares. Every split and `overall`."""
    spark = rows.sparkSession
    keys = {"samples": F.lit(""), "label": L.label_text(F.col("label_vec")), "group": F.col("group"), "ratio": F.col("ratio")}
    cells = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in keys.items())))
    x = rows.select("split", "label_vec", cells.alias("k")).select("split", "k.*", "label_vec").where("section = 'samples' or (key is not null and key <> '')")
    x = x.withColumn("split", F.explode(F.array("split", F.lit("overall"))))
    sums = [F.sum(_ones("label_vec")).cast("long").alias("sources"), *(F.sum(F.get("label_vec", i)).cast("long").alias(f"c{i}") for i in range(len(classes)))]
    # a row for each split and key, from which all else is made
    small = kept(x.groupBy("split", "section", "key").agg(F.count("*").alias("count"), *sums))
    expected = {"label": ["[" + ",".join(map(str, c)) + "]" for c in combinations(len(classes))], "group": groups, "ratio": ratios}
    every = spark.createDataFrame([(p, s, k) for p in (*splits, "overall") for s, ks in expected.items() for k in ks], "split string, section string, key string").withColumn("wanted", F.lit(True))
    counted = small.where("section <> 'samples'").select("split", "section", "key", "count").join(F.broadcast(every), ["split", "section", "key"], "full").withColumn("count", F.coalesce("count", F.lit(0)))
    none = F.lit(None).cast("double")
    out = counted.select("split", "section", "key", "count", none.alias("value"))
    extremes = counted.where("wanted and section <> 'ratio'").groupBy("split", "section").agg(F.max("count").alias("most"), F.min("count").alias("least"))
    out = out.unionByName(extremes.select("split", F.concat(F.col("section"), F.lit("_imbalance")).alias("section"), F.lit("").alias("key"), F.col("most").alias("count"), F.when(F.col("least") > 0, F.round(F.col("most") / F.col("least"), 9)).alias("value")))
    totals = small.where("section = 'samples'").withColumnRenamed("count", "n")
    n, share = F.col("n"), [F.col(f"c{i}") / F.col("n") for i in range(len(classes))]
    blank = F.lit("")
    made = [_cell("samples", blank, n, none), _cell("sources_per_sample", blank, F.col("sources"), F.round(F.col("sources") / n, 9))]
    for i, c in enumerate(classes):
        made += [_cell("positive", F.lit(c), F.col(f"c{i}"), F.round(share[i], 9)), _cell("negative", F.lit(c), n - F.col(f"c{i}"), F.round(1 - share[i], 9))]
    made.append(_cell("positive_ratio_gap", blank, n, F.round(F.greatest(*share) - F.least(*share), 9)))
    return out.unionByName(totals.select("split", F.explode(F.array(*made)).alias("x")).select("split", "x.*"))


def restricted(long: DataFrame, section: str, keys: list[str]) -> DataFrame:
    """(split, key, count, fraction): a section's expected keys, and what share of the key's overall count each split has."""
    x = long.where((F.col("section") == section) & F.col("key").isin(keys)).select("split", "key", "count")
    whole = x.where("split = 'overall'").select("key", F.col("count").alias("whole"))
    return x.where("split <> 'overall'").join(F.broadcast(whole), "key").select("split", "key", "count", F.round(_share(F.col("count"), F.col("whole")), 9).alias("fraction"))


def before_after(rows: DataFrame, classes: list[str]) -> DataFrame:
    """(section, key, before, after) of rows (label_vec, selected): combinations, and each class's share of positives, in all rows and in the selected ones."""
    combos = rows.groupBy(L.combo(F.col("label_vec")).alias("key")).agg(F.count("*").cast("double").alias("before"), F.count(F.when(F.col("selected"), 1)).cast("double").alias("after"))
    chosen = F.sum(F.col("selected").cast("int"))
    each = [F.struct(F.lit(c).alias("key"), F.avg(F.get("label_vec", i)).alias("before"), _share(F.sum(F.when(F.col("selected"), F.get("label_vec", i)).otherwise(0)), chosen).alias("after")) for i, c in enumerate(classes)]
    shares = rows.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return combos.select(F.lit("combo").alias("section"), "*").unionByName(shares.select(F.lit("positive_ratio").alias("section"), "key", F.round("before", 9).alias("before"), F.round("after", 9).alias("after")))


def counts_by_split(rows: DataFrame, key: str) -> DataFrame:
    """(split, key, n) of rows with a split, and a split `overall`."""
    both = rows.groupingSets([["split", key], [key]], "split", key).agg(F.count("*").alias("n"))
    return both.select(F.coalesce("split", F.lit("overall")).alias("split"), key, "n")


def split_counts(rows: DataFrame) -> DataFrame:
    """(group, train, val, test, total) of rows (group, split), and a row `(all)`."""
    of = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(s)
    x = rows.groupingSets([["group"], []], "group").agg(of("train"), of("val"), of("test"), F.count("*").alias("total"), F.grouping_id().alias("g"))
    return x.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("group")).alias("group"), "train", "val", "test", "total")


def group_means(rows: DataFrame, by: str, metrics: list[str], deviations: list[str] = ()) -> DataFrame:
    """The mean of each metric by group, and the sample deviation of some (0 for one row)."""
    means = [F.round(F.avg(m), 6).alias(f"{m}_mean") for m in metrics]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *means, *(F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 6).alias(f"{m}_std") for m in deviations))


def domain_differences(rows: DataFrame, by: str, metrics: list[str], real: str = "real") -> DataFrame:
    """(group, metric, real, synthetic, difference, ratio) of rows (domain, group, metrics): each real group's mean against the mean of all synthetic rows; a mean of nothing is 0, and over 0 the ratio is null."""
    long = rows.select("domain", by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x")).select("domain", by, "x.*")
    own = long.where(F.col("domain") == real).groupBy(by, "metric").agg(F.avg("v").alias("r"))
    other = long.where(F.col("domain") != real).groupBy("metric").agg(F.avg("v").alias("s"))
    x = own.join(F.broadcast(other), "metric", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return x.select(by, "metric", F.round("r", 6).alias("real"), F.round("s", 6).alias("synthetic"), F.round(F.col("r") - F.col("s"), 6).alias("difference"), F.round(F.when(F.abs("s") > 1e-12, F.col("r") / F.col("s")), 6).alias("ratio"))


# --- predictions: file, group, condition_path, prob, target, pred, exact


def extra_rates(rows: DataFrame, focus: int) -> DataFrame:
    """Over all rows: how often two true sources are taken for three, and how often the focus class is predicted where it is not; 0 without such rows."""
    double, without = _ones("target") == 2, F.get("target", focus) == 0
    rate = lambda given, hit: F.round(_share(F.count(F.when(given & hit, 1)), F.count(F.when(given, 1))), 9)
    return rows.agg(rate(double, _ones("pred") == 3).alias("double_as_triple_rate"), rate(without, F.get("pred", focus) == 1).alias("focus_over_rate"))


def accuracies(rows: DataFrame, groups: list[str], classes: int) -> DataFrame:
    """(section, key, n, accuracy): exact matches by group and by label (expected ones without rows count 0) and by observed ratio."""
    keys = {"group": F.col("group"), "label": L.label_text(F.col("target")), "ratio": L.ratio(F.col("condition_path"))}
    long = rows.select("exact", F.explode(F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in keys.items()))).alias("k")).select("exact", "k.*").where("key is not null")
    got = long.groupBy("section", "key").agg(F.count("*").alias("n"), F.sum(F.col("exact").cast("long")).alias("hits"))
    every = [("group", g) for g in groups] + [("label", "[" + ",".join(map(str, c)) + "]") for c in combinations(classes)]
    expected = rows.sparkSession.createDataFrame(every, "section string, key string")
    x = got.join(F.broadcast(expected), ["section", "key"], "full")
    n = F.coalesce("n", F.lit(0))
    return x.select("section", "key", n.alias("n"), F.round(_share(F.coalesce("hits", F.lit(0)), n), 9).alias("accuracy"))


def focused_errors(rows: DataFrame, true: list[int], wrong: list[list[int]]) -> DataFrame:
    """(pred_label, n, rate) among rows of one true label: that label itself and each of some wrong ones, 0 if none."""
    text = lambda c: "[" + ",".join(map(str, c)) + "]"
    x = rows.where(L.label_text(F.col("target")) == text(true)).select(L.label_text(F.col("pred")).alias("pred_label"))
    asked = rows.sparkSession.createDataFrame([(text(c),) for c in (true, *wrong)], "pred_label string")
    total = x.agg(F.count("*").alias("total"))
    got = asked.join(x.groupBy("pred_label").agg(F.count("*").alias("n")), "pred_label", "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("n", F.lit(0))
    return got.select("pred_label", n.alias("n"), F.round(_share(n, F.col("total")), 9).alias("rate"))


def confusions_of(rows: DataFrame, true: list[int], pred: list[int], focus: int, threshold: float) -> DataFrame:
    """The rows of one true label that were taken for another, with the focus class's probability and its margin over the threshold."""
    text = lambda c: "[" + ",".join(map(str, c)) + "]"
    x = rows.where((L.label_text(F.col("target")) == text(true)) & (L.label_text(F.col("pred")) == text(pred)))
    p = F.get("prob", focus)
    return x.select("file", "group", F.round(p, 6).alias("prob"), F.round(p - threshold, 6).alias("margin"))


def margin_summary(confusions: DataFrame) -> DataFrame:
    """Count, mean, median, 90th percentile, least and greatest of prob and margin; 0 without rows."""
    long = confusions.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("prob", "margin")))).alias("x")).select("x.*")
    q = quantiles(long, ["metric"], F.col("v"), [0.5, 0.9], F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    parts = {"mean": F.col("mean"), "median": F.get("q", F.lit(0)), "p90": F.get("q", F.lit(1)), "min": F.col("min"), "max": F.col("max")}
    cells = [F.round(F.coalesce(F.max(F.when(F.col("metric") == c, v)), F.lit(0.0)), 6).alias(f"{c}_{p}") for c in ("prob", "margin") for p, v in parts.items()]
    return q.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("count"), *cells)


def folder_evaluation(rows: DataFrame, classes: list[str]) -> DataFrame:
    """(section, key, n, value) of a folder's predictions: exact match, each group's accuracy and mean probabilities, and how often each bucket (classes and mix) was taken for each label."""
    exact = F.col("exact").cast("int")
    none = F.lit(None).cast("double")
    whole = rows.agg(F.count("*").alias("n"), F.round(F.avg(exact), 9).alias("value")).select(F.lit("exact_match").alias("section"), F.lit("").alias("key"), "n", "value")
    by = rows.groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg(exact), 9).alias("a"), *(F.round(F.avg(F.get("prob", i)), 6).alias(f"p{i}") for i in range(len(classes))))
    made = [_cell("group_accuracy", F.col("group"), F.col("n"), F.col("a")), *(_cell(f"{c}_prob_mean", F.col("group"), F.col("n"), F.col(f"p{i}")) for i, c in enumerate(classes))]
    groups = by.select(F.explode(F.array(*made)).alias("x")).select("x.section", "x.key", F.col("x.count").alias("n"), "x.value")
    b = bucket(F.col("group"), classes)
    taken = rows.where(b.isin([*classes, "mix"])).groupBy(F.concat_ws(" | ", b, L.label_text(F.col("pred"))).alias("key")).agg(F.count("*").alias("n"))
    return whole.unionByName(groups).unionByName(taken.select(F.lit("predicted").alias("section"), "key", "n", none.alias("value")))


def folder_report(rows: DataFrame, classes: list[str]) -> DataFrame:
    """`folder_evaluation` with each class's precision, recall, F1 and support."""
    c = class_metrics(rows)
    name = F.get(F.array(*map(F.lit, classes)), F.col("class_id"))
    made = F.array(*(_cell(m, name, F.col("support"), F.col(m)) for m in ("precision", "recall", "f1")))
    scores = c.select(F.explode(made).alias("x")).select("x.section", "x.key", F.col("x.count").alias("n"), "x.value")
    return folder_evaluation(rows, classes).unionByName(scores)


def from_indices(rows: DataFrame, classes: int) -> DataFrame:
    """rows (true_index, pred_index) of combinations, with target and pred as bits and the flags of decided rows."""
    bits = F.array(*(F.array(*map(F.lit, c)) for c in combinations(classes)))
    x = rows.withColumns({"target": F.get(bits, F.col("true_index")), "pred": F.get(bits, F.col("pred_index"))})
    over, under = (F.exists(F.zip_with("pred", "target", test), lambda v: v) for test in (lambda p, y: p > y, lambda p, y: p < y))
    return x.withColumns({"exact": F.col("true_index") == F.col("pred_index"), "over": over, "under": under})


def index_counts(rows: DataFrame, classes: int) -> DataFrame:
    """(index, n, accuracy, predicted): for each combination, rows that are of it (0 if none), their accuracy, and how often it was predicted."""
    every = rows.sparkSession.range(2**classes - 1).select(F.col("id").cast("int").alias("index"))
    true = rows.groupBy(F.col("true_index").alias("index")).agg(F.count("*").alias("n"), F.sum(F.col("exact").cast("long")).alias("hits"))
    said = rows.groupBy(F.col("pred_index").alias("index")).agg(F.count("*").alias("predicted"))
    x = every.join(true, "index", "left").join(said, "index", "left")
    n = F.coalesce("n", F.lit(0))
    return x.select("index", n.alias("n"), F.round(_share(F.coalesce("hits", F.lit(0)), n), 9).alias("accuracy"), F.coalesce("predicted", F.lit(0)).alias("predicted"))


# --- neighbourhoods and duplicates

#: The order of review: fixed values.
REVIEW = ("isolated", "other_dominated", "boundary", "typical")


def review_order(categories: DataFrame) -> DataFrame:
    """Categories of vectors, the ones to look at first on top: by category, then by the share of own neighbours."""
    place = F.array_position(F.array(*map(F.lit, REVIEW)), F.col("category"))
    return categories.orderBy(place, "own_fraction", "id")


def category_counts(categories: DataFrame) -> DataFrame:
    """(label, and a count for each category)."""
    return categories.groupBy("label").agg(*(F.count(F.when(F.col("category") == c, 1)).alias(c) for c in REVIEW))


def error_locations(predictions: DataFrame, categories: DataFrame, official: int | None = None) -> DataFrame:
    """(category, n, errors): where wrong predictions (id, exact) lie. If the official report's number of errors is given and differs, that is an error."""
    x = predictions.select("id", "exact").join(categories.select("id", "category"), "id")
    if official is not None and (found := x.where("not exact").count()) != official:
        raise ValueError(f"{found} errors, but the report has {official}")
    return x.groupBy("category").agg(F.count("*").alias("n"), F.count(F.when(~F.col("exact"), 1)).alias("errors"))


def duplicate_groups(captures: DataFrame) -> DataFrame:
    """(copies, groups, extra): how many groups of equal signals there are of each size above 1, and the captures beyond the first in them. Only hashes are shuffled."""
    sizes = captures.select(fingerprint(F.col("signal")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("copies")).where("copies > 1")
    return sizes.groupBy("copies").agg(F.count("*").alias("groups"), F.sum(F.col("copies") - 1).alias("extra"))


def expected_errors(samples: int, exact_match: float) -> int:
    """The number of errors that an exact match rate over so many samples means."""
    return round(samples * (1 - exact_match))
