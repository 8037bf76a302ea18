"""From raw captures to model input: one entry with a record of what it did, statistics that show the gap between domains, and training sets of both domains."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import waveforms as W

MODES = ("synthetic_only", "hybrid", "real_only")


def _finite(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _times(x: Column, test) -> Column:
    return A.matching(x, test).cast("long")


def model_input(captures: DataFrame, length: int, segment: int, overlap: int, rows: int, columns: int, representation: str = "single", scale: str = "log1p", normalize: bool = True, kind: str = "float") -> DataFrame:
    """captures with feature (flat channels), record and error in place of signal.

    representation: single and absolute_relative transform the fixed and, if normalize, standardized signal; db_trace stays in dB, is padded
    with its median and has four channels. record: the lengths, how the one became the other (kept, padded with pad_value, or cropped from
    crop_start to crop_end), the ranges of the finite values before, at the fixed length and after normalization, centre and deviation
    that were used (db_trace: the median and null), and how many values were NaN or endless. A null or empty signal, and one without a
    finite value, has an error and neither feature nor record. Values that are not finite count as 0, in db_trace as the median.
    """
    if representation not in ("single", "absolute_relative", "db_trace"):
        raise ValueError(f"unknown representation: {representation}")
    trace = representation == "db_trace"
    raw, n = F.col("_raw"), F.size("_raw")
    x = captures.withColumn("_raw", F.col("signal").cast("array<double>")).withColumn("_sound", _finite(raw))
    error = F.when(raw.isNull() | (n == 0), "no signal").when(F.size("_sound") == 0, "no finite values")
    x = x.withColumn("error", error).withColumn("_fixed", F.when(F.col("error").isNull(), W.fix_trace(raw, length) if trace else W.fix_length(raw, length)))
    x = x.withColumn("_normal", W.standardized(F.col("_fixed")) if normalize and not trace else F.col("_fixed"))
    feature = W.db_trace_channels(F.col("_normal"), segment, overlap, rows, columns) if trace else W.stft(F.col("_normal"), segment, overlap, rows, columns, scale, representation, kind)
    clean = W.finite(F.col("_fixed"))
    start = F.floor((n - length) / 2).cast("long")
    median = lambda c: A.quantile(F.sort_array(_finite(c)), 0.5)
    none = F.lit(None).cast("double")
    parts = {
        "original_length": n.cast("long"), "target_length": F.lit(length).cast("long"), "method": F.when(n < length, "padded").when(n > length, "cropped").otherwise("kept"),
        "crop_start": F.when(n > length, start), "crop_end": F.when(n > length, start + length), "pad_value": F.when(n < length, median(raw) if trace else F.lit(0.0)),
        **{f"{name}_{end}": f(_finite(F.col(c))) for name, c in (("raw", "_raw"), ("fixed", "_fixed"), ("normal", "_normal")) for end, f in (("min", F.array_min), ("max", F.array_max))},
        "centre": median(F.col("_fixed")) if trace else A.mean(clean) if normalize else none, "deviation": A.std(clean) if normalize and not trace else none,
        "nan_count": _times(raw, F.isnan), "positive_inf_count": _times(raw, lambda v: v == float("inf")), "negative_inf_count": _times(raw, lambda v: v == float("-inf")),
    }
    record = F.when(F.col("error").isNull(), F.struct(*(v.alias(k) for k, v in parts.items())))
    keep = [c for c in captures.columns if c not in ("signal", "error")]
    return x.select(*keep, feature.alias("feature"), record.alias("record"), "error")


def gap_statistics(captures: DataFrame, length: int, segment: int, overlap: int, rows: int, columns: int) -> DataFrame:
    """captures with the statistics that domains are compared by in place of signal, cut or padded to one length. Null for a null signal."""
    made = W.gap_statistics(W.fix_length(F.col("signal").cast("array<double>"), length), segment, overlap, rows, columns)
    keep = [c for c in captures.columns if c != "signal"]
    return captures.select(*keep, made.alias("_gap")).select(*keep, "_gap.*")


def training_set(synthetic: DataFrame | None, real: DataFrame | None, mode: str = "synthetic_only", split: str = "train", ratios: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Rows (split, and the columns that both have) of one split, with domain and weight, for splits.weighted_resample.

    hybrid takes both domains for train and val, and synthetic rows alone for other splits. If a domain has no rows of the split, the
    other one stands alone. Where both do, ratios are what synthetic and real rows weigh in all, spread evenly over each domain's rows;
    otherwise, and outside of train, all rows weigh the same. Without any row that the mode can take, an error.
    """
    if mode not in MODES or min(ratios) < 0:
        raise ValueError(f"unknown mode or negative ratio: {mode}, {ratios}")
    wanted = {"synthetic_only": ["synthetic"], "real_only": ["real"]}.get(mode, ["synthetic", "real"] if split in ("train", "val") else ["synthetic"])
    given = {"synthetic": synthetic, "real": real}
    parts = {k: given[k].where(F.col("split") == split) for k in wanted if given[k] is not None}
    sizes = {k: p.count() for k, p in parts.items()}
    parts = {k: p for k, p in parts.items() if sizes[k]}
    if not parts:
        raise ValueError(f"{mode} has no rows of {split}")
    weighed = len(parts) == 2 and split == "train"
    share = dict(zip(("synthetic", "real"), ratios, strict=True))
    columns = [c for c in next(iter(parts.values())).columns if all(c in p.columns for p in parts.values())]
    out = [p.select(*columns, F.lit(k).alias("domain"), F.lit(share[k] / sizes[k] if weighed else 1.0).alias("weight")) for k, p in parts.items()]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])
