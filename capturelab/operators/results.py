"""What is handed out about single predictions and captures: result rows, captures to look at, and signals that occur twice."""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit
from .decoding import combinations, sources
from .quantiles import quantiles

#: Copies of a rare signal's row, over which the rows of a frequent one are dealt.
SALTS = 32


def prediction_results(rows: DataFrame, names: list[str], mode: str, thresholds: list[float]) -> DataFrame:
    """rows (file, prob, pred; combo_prob in mode `structured`) as result rows: the names, thresholds and whether they apply (in mode `multilabel`), the combinations and their probabilities (null without), the classes' marginals and percentages, and the decoded vector as bits, text and list of names."""
    if mode not in ("structured", "multilabel"):
        raise ValueError(f"unknown mode: {mode}")
    whole = mode == "structured"
    bits = ["".join(map(str, b)) for b in combinations(len(names))] if whole else []
    known = F.array(*map(F.lit, names))
    made = {
        "mode": F.lit(mode), "labels": known, "thresholds": F.array(*(F.lit(float(t)) for t in thresholds)), "thresholds_apply": F.lit(not whole),
        "combinations": F.array(*map(F.lit, bits)) if whole else F.array().cast("array<string>"), "combination_probabilities": F.col("combo_prob") if whole else F.lit(None).cast("array<double>"),
        "probabilities": F.col("prob"), "percentages": F.transform("prob", lambda p: p * 100), "decoded": F.col("pred"), "combination": F.array_join("pred", ""),
        "sources": F.array_compact(F.zip_with(known, "pred", lambda n, b: F.when(b == 1, n))),
    }
    return rows.select("file", *(v.alias(k) for k, v in made.items()))


def to_review(rows: DataFrame, names: list[str], low: float = 0.6) -> DataFrame:
    """Diagnosed rows whose confidence is below this: file, predicted sources, confidence, the second prediction, margin and entropy."""
    x = rows.where(F.col("confidence") < low)
    return x.select("file", sources(F.col("pred"), names).alias("predicted"), "confidence", sources(F.col("second"), names).alias("second"), "margin", "entropy")


def recommended_settings(stats: DataFrame) -> DataFrame:
    """One row of settings for model input from the captures' statistics: the modal length (of equals that of the first file), the level's range and the scale of variation; no row without captures."""
    mode = audit.mode_of_lengths(stats).select(F.col("mode").alias("signal_length"))
    return mode.crossJoin(audit.recommended(stats))  # one row each


def float_bits(signal: Column) -> Column:
    """The signal's values as 32-bit floats, byte by byte: -0.0 is not 0.0, and equal bytes are equal signals."""

    @F.pandas_udf("binary")
    def made(s: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in s], dtype=object)

    return made(signal)


def fingerprints(captures: DataFrame) -> DataFrame:
    """captures with fingerprint, the SHA-1 of the bytes of their signal's 32-bit floats."""

    @F.pandas_udf("string")
    def made(s: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if v is None else hashlib.sha1(np.asarray(v, "<f4").tobytes()).hexdigest() for v in s], dtype=object)

    return captures.withColumn("fingerprint", made("signal"))


def duplicate_signals(captures: DataFrame) -> DataFrame:
    """(file, group, fingerprint, copies, labels) of captures (file, group, signal) whose very signal also occurs under another group.

    Fingerprints alone are shuffled to find them. Each capture of such a fingerprint is then compared, byte by byte, with the one of the smallest file that has
    it, so that a row stands for equal signals and not for equal hashes; the rows of a frequent signal are dealt over SALTS tasks, which each get that one signal. Null signals are left out.
    """
    marked = fingerprints(captures.where("signal is not null").select("file", "group", "signal"))
    counted = marked.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.count_distinct("group").alias("labels"), F.min("file").alias("first")).where("copies > 1 and labels > 1")
    first = marked.select("file", "fingerprint", "signal").join(counted.select("fingerprint", F.col("first").alias("file")), ["fingerprint", "file"]).groupBy("fingerprint").agg(F.min(float_bits(F.col("signal"))).alias("bits"))
    table = counted.drop("first").join(first, "fingerprint").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = marked.select("file", "group", "fingerprint", float_bits(F.col("signal")).alias("own"), F.pmod(F.xxhash64("file"), F.lit(SALTS)).cast("int").alias("_salt"))
    met = dealt.join(table, ["fingerprint", "_salt"])
    return met.where("own = bits").select("file", "group", "fingerprint", "copies", "labels")


def group_quantiles(stats: DataFrame, by: list[str], metric: str, shares: list[float]) -> DataFrame:
    """(by, share, value): exact quantiles of a metric in each group, of groups of any size."""
    x = quantiles(stats, by, F.col(metric), shares)
    return x.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("q").alias("value"))).alias("x")).select(*by, "x.share", "x.value")
