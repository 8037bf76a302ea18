"""Warnings about a distribution of label combinations, from one small count table per scope."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import combo

HIGH_POSITIVE, LOW_COMBO, HIGH_TRIPLE, LOW_DOUBLE = 0.75, 0.25, 0.25, 0.5
COMBOS = ["100", "010", "001", "110", "101", "011", "111"]


def _warning(rule: str, subject: Column, value: Column, reference: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), subject.alias("subject"), value.cast("double").alias("value"), reference.cast("double").alias("reference"))


def warnings(rows: DataFrame, scope: str, target: str, scopes: list[str] | None = None) -> DataFrame:
    """scope, rule, subject, value, reference. rows have three target bits. Rules: a class is positive in 0.75 of the rows or more; a
    combination has no rows, or under a quarter of the median of those that have some; 111 has a quarter of the rows or more; 110 has under
    half of the rarer of the other pairs. Of the named scopes, those without rows get no_samples. Rows without a target don't count."""
    counts = rows.where(F.col(target).isNotNull()).groupBy(scope, combo(F.col(target)).alias("_combo")).agg(F.count("*").alias("_n"))
    pair = F.struct("_combo", "_n")
    by_scope = counts.groupBy(scope).agg(F.map_from_entries(F.collect_list(pair)).alias("_m"), F.sum("_n").alias("_total"), F.percentile("_n", F.lit(0.5)).alias("_median"))
    if scopes is not None:
        named = rows.sparkSession.createDataFrame([(s,) for s in scopes], f"{scope} string")
        by_scope = named.join(by_scope, scope, "left")
    n = lambda c: F.coalesce(F.try_element_at("_m", F.lit(c) if isinstance(c, str) else c), F.lit(0))
    total, median = F.col("_total"), F.col("_median")
    shares = [sum(n(c) for c in COMBOS if c[i] == "1") / total for i in range(3)]
    found = [F.when(total.isNull(), _warning("no_samples", F.lit(""), F.lit(0), F.lit(0)))]
    found += [F.when(s >= HIGH_POSITIVE, _warning("high_positive_ratio", F.lit(str(i)), s, F.lit(HIGH_POSITIVE))) for i, s in enumerate(shares)]
    for c in COMBOS:
        found.append(F.when(total.isNotNull() & (n(c) == 0), _warning("missing_combination", F.lit(c), F.lit(0), median)))
        found.append(F.when((n(c) > 0) & (n(c) < LOW_COMBO * median), _warning("rare_combination", F.lit(c), n(c), median)))
    found.append(F.when(n("111") / total >= HIGH_TRIPLE, _warning("high_triple_ratio", F.lit("111"), n("111") / total, F.lit(HIGH_TRIPLE))))
    rarer = F.array_min(F.filter(F.array(n("101"), n("011")), lambda x: x > 0))
    found.append(F.when(n("110") < LOW_DOUBLE * rarer, _warning("low_double", F.lit("110"), n("110"), rarer)))
    return by_scope.select(scope, F.inline(F.array_compact(F.array(*found))))
