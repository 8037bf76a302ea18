"""Signal audit: statistics of each capture, issue rules, and group summaries.

captures: file, group, condition_path, ratio, label, signal (array<double>).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import labels as L
from ..sources.shared import stored
from .quantiles import medians, quantiles

FIELDS = ("min_db", "p01_db", "p05_db", "mean_db", "median_db", "p95_db", "p99_db", "max_db", "std_db", "p2p_db", "diff_p95", "diff_p99", "max_jump", "jump_ratio", "nonnegative_ratio", "boundary_ratio")
ROBUST = ("mean_db", "median_db", "std_db", "p2p_db", "diff_p95")


def signal_stats(captures: DataFrame, jump: float = 12.0) -> DataFrame:
    """The captures without their signals, with 19 statistics rounded to 4 places; those of an empty signal are null or 0."""
    x = captures.withColumn("_s", F.sort_array("signal")).withColumn("_d", A.steps(F.col("signal"))).withColumn("_e", F.sort_array("_d"))
    s, d, e, n = F.col("_s"), F.col("_d"), F.col("_e"), F.size("signal")
    low, high = F.get(s, 0), F.get(s, n - 1)
    jumps = A.matching(d, lambda v: v >= jump)
    made = {
        "min_db": low, "p01_db": A.quantile(s, 0.01), "p05_db": A.quantile(s, 0.05), "mean_db": A.mean(s), "median_db": A.quantile(s, 0.5), "p95_db": A.quantile(s, 0.95), "p99_db": A.quantile(s, 0.99), "max_db": high,
        "std_db": A.std(s), "p2p_db": high - low, "diff_p95": F.coalesce(A.quantile(e, 0.95), F.lit(0.0)), "diff_p99": F.coalesce(A.quantile(e, 0.99), F.lit(0.0)), "max_jump": F.coalesce(F.get(e, n - 2), F.lit(0.0)),
        "jump_ratio": F.when(n > 1, jumps / (n - 1)).otherwise(0.0), "nonnegative_ratio": F.try_divide(A.matching(s, lambda v: v >= 0), n), "boundary_ratio": F.try_divide(F.greatest(A.matching(s, lambda v: v == low), A.matching(s, lambda v: v == high)), n),
    }
    counts = [n.cast("long").alias("n"), jumps.cast("long").alias("jump_count"), F.size(F.array_distinct("signal")).cast("long").alias("unique_values")]
    return x.select(*[c for c in captures.columns if c != "signal"], *counts, *(F.round(v, 4).alias(k) for k, v in made.items()))


def issues(stats: DataFrame, no_signal_db: float | None = None, jump: float = 12.0) -> DataFrame:
    """One row for each rule that a capture breaks; rules compare the rounded statistics."""
    return _exploded(stats, _broken(no_signal_db, jump))


def _issue(test, severity: str, kind: str, *detail):
    """An issue of the row if the test holds, else null."""
    return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.concat(*detail).alias("detail")))


def _broken(no_signal_db: float | None, jump: float = 12.0) -> list:
    c = F.col
    rules = [
        ("error", "flat_or_nearly_flat", (c("std_db") <= 0.05) | (c("p2p_db") <= 0.5), "std_db"),
        ("error", "implausible_db_range", (c("min_db") < -160) | (c("max_db") > 10), "min_db"),
        ("error", "nonnegative_db_values", c("nonnegative_ratio") > 0, "nonnegative_ratio"),
        ("review", "possible_clipping", (c("boundary_ratio") >= 0.10) & (c("unique_values") > 1), "boundary_ratio"),
        ("review", "large_db_jump", c("max_jump") >= jump, "max_jump"),
    ]
    if no_signal_db is not None:
        rules.append(("review", "possible_no_signal", c("p95_db") <= no_signal_db, "p95_db"))
    return [_issue(test, s, t, F.lit(f"{d}="), c(d).cast("string")) for s, t, test, d in rules]


def _exploded(rows: DataFrame, found: list) -> DataFrame:
    return _found(rows, found).select("i.severity", "i.type", "file", "group", "condition_path", "i.detail")


def _found(rows: DataFrame, found: list) -> DataFrame:
    """file, group, condition_path and i, for each of the expressions that isn't null."""
    return rows.select("file", "group", "condition_path", F.explode(F.array(*found)).alias("i")).where("i is not null")


def issue_table(rows: DataFrame, parsed: DataFrame, no_signal_db: float | None = None, expected_length: int | None = None, z: float = 5.0) -> DataFrame:
    """Every issue of an index (file, group, condition_path, label) and its parsed captures, of one file or of the corpus: severity, type, file, group, condition_path, detail. The statistics, without signals, are written to the shared folder once. What the corpus has to say (usual length, spread of each condition, repeated fingerprints) comes from a few columns of them; then one pass names the issues of each file, and one its duplicates."""
    x = rows.select("file", "group", "condition_path", "label").join(parsed.select("file", "signal", "discarded_nonfinite_count", "parse_error"), "file")
    marked = x.withColumn("fingerprint", F.unhex(fingerprint(F.col("signal")))).withColumn("signal", F.transform("signal", lambda v: v.cast("double")))
    x = stored(signal_stats(marked).drop("jump_count", "jump_ratio", "p01_db", "p05_db", "p99_db", "diff_p99"))
    read = F.col("parse_error").isNull()
    good = x.where(read)
    mode = F.lit(_usual_length(good) if expected_length is None else expected_length)
    found = [_issue(~read, "error", "parse_failure", F.col("parse_error"))]
    of_good = [
        *_broken(no_signal_db),
        _issue(F.col("discarded_nonfinite_count") > 0, "error", "nonfinite_values", F.lit("discarded_nonfinite_count="), F.col("discarded_nonfinite_count")),
        _issue(F.col("n") != mode, "error", "length_mismatch", F.lit("num_samples="), F.col("n"), F.lit(", expected="), mode),
        *(_issue(s >= z, "review", "condition_outlier", F.lit(f"{m} robust_z="), F.round(s, 6)) for m, s in _scores().items()),
    ]
    out = _exploded(_with_spread(x, _spread(good), "left"), found + [F.when(read, i) for i in of_good])
    # a hash of the label tells whether there are several, without sorting
    label = F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    twice = stored(good.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select("fingerprint", "copies"))
    return out.unionByName(_exploded(good.select("file", "group", "condition_path", "fingerprint").join(twice, "fingerprint"), [_issue(F.lit(True), "error", "duplicate_across_labels", F.lit("duplicate_count="), F.col("copies"))]))


def counts(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(section, key, n) of an index and its parsed captures: files, parsed, failed, source roots, groups, labels, ratios, conditions, groups by ratio, lengths and layouts."""
    x = rows.select("file", "source_root", "group", "label", "condition_path").join(parsed.select("file", F.size("signal").alias("size"), "has_data_marker", "parse_error"), "file", "left")
    ratio, good = L.ratio(F.col("condition_path")), F.col("has_data_marker").isNotNull() & F.col("parse_error").isNull()
    place = F.when(F.col("condition_path") == "", "(none)").otherwise(F.col("condition_path"))
    keys = {
        "discovered_files": F.lit(""), "parsed_files": F.when(good, ""), "parse_failed_files": F.when(~good, ""), "source_root": F.col("source_root"), "group": F.col("group"), "label": F.col("label"), "ratio": ratio,
        "condition": F.concat_ws(" | ", "group", place), "group_ratio": F.concat_ws(" | ", F.col("group"), F.coalesce(ratio, F.lit("(none)"))), "length": F.when(good, F.col("size").cast("string")),
        "layout": F.when(good, F.when(F.col("has_data_marker"), "with_DATA_marker").otherwise("legacy_without_DATA_marker")),
    }
    long = x.select(F.explode(F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in keys.items()))).alias("x")).select("x.*").where("key is not null")
    return long.groupBy("section", "key").agg(F.count("*").alias("n"))


def issue_counts(issue_rows: DataFrame) -> DataFrame:
    return issue_rows.groupBy("severity", "type").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def summary_by(stats: DataFrame, metrics=("mean_db", "std_db", "p2p_db", "max_jump")) -> DataFrame:
    """Five numbers and the mean of each metric: overall, by group and by ratio."""
    long = stats.select("group", F.coalesce("ratio", F.lit("(none)")).alias("ratio"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("x")).select("group", "ratio", "x.metric", "x.v")
    of = lambda scope, key: F.struct(F.lit(scope).alias("scope"), F.coalesce(key, F.lit("all")).alias("key"))
    sets = long.select(F.explode(F.array(of("overall", F.lit("all")), of("group", F.col("group")), of("ratio", F.col("ratio")))).alias("s"), "metric", "v").select("s.*", "metric", "v")
    out = quantiles(sets, ["scope", "key", "metric"], F.col("v"), [0.05, 0.5, 0.95], F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    scope, key = F.col("scope"), F.col("key")
    rounded = [F.round(v, 6).alias(k) for k, v in (("min_value", F.col("min")), ("p05", F.col("q")[0]), ("median", F.col("q")[1]), ("p95", F.col("q")[2]), ("max_value", F.col("max")), ("mean", F.col("mean")))]
    return out.select(scope.alias("scope"), key.alias("key"), "metric", "n", *rounded)


def mode_of_lengths(stats: DataFrame) -> DataFrame:
    """One row with mode, the most frequent length; of equals the one whose first file comes first."""
    return stats.groupBy("n").agg(F.count("*").alias("c"), F.min("file").alias("first")).orderBy(F.desc("c"), "first").limit(1).select(F.col("n").alias("mode"))


def _usual_length(stats: DataFrame) -> int | None:
    """The mode of mode_of_lengths; files are compared only if two lengths are equally frequent."""
    top = stats.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("c")).limit(2).collect()
    return mode_of_lengths(stats).first().mode if len(top) > 1 and top[0].c == top[1].c else top[0].n if top else None


def modal_length(stats: DataFrame) -> DataFrame:
    """The most frequent length, of equals the one whose first file comes first, and captures that differ from it."""
    return stats.crossJoin(F.broadcast(mode_of_lengths(stats))).where("n <> mode").select("file", "n", "mode")


def recommended(stats: DataFrame) -> DataFrame:
    """Clip range and deviation floor from the corpus."""
    long = stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("median_db", "std_db")))).alias("x")).select("x.*")
    q = quantiles(long, ["metric"], F.col("v"), [0.01, 0.99])
    of = lambda c, i: F.max(F.when(F.col("metric") == c, F.get("q", F.lit(i))))
    return q.agg(F.floor(of("median_db", 0) - 5).cast("long").alias("clip_low"), F.ceil(of("median_db", 1) + 5).cast("long").alias("clip_high"), F.greatest(F.lit(1), F.ceil(of("std_db", 1))).cast("long").alias("variation_max"))


def condition_outliers(stats: DataFrame, z: float = 5.0, least: int = 8) -> DataFrame:
    """Captures far from their (group, condition) by median and MAD, in any of five metrics. The metrics are written to the shared folder once."""
    x = stored(stats.select("file", "group", "condition_path", *ROBUST))
    far = [F.when(s >= z, F.struct(F.lit(m).alias("metric"), F.round(s, 6).alias("robust_z"))) for m, s in _scores().items()]
    return _found(_with_spread(x, _spread(x, least)), far).select("file", "group", "condition_path", "i.*")


def _key():
    """Group and condition, never null as a whole; null equals null."""
    return F.struct("group", "condition_path", F.lit(0).alias("_")).alias("_key")


def _spread(stats: DataFrame, least: int = 8) -> DataFrame:
    """(_key, and of each robust metric the centre and MAD) of the conditions with so many captures; null where the MAD is 0."""
    by = ["_key", "metric"]
    long = stats.select(_key(), F.posexplode(F.array(*ROBUST)).alias("metric", "v")).where("v is not null")
    centre = stored(medians(long, by).where(F.col("size") >= least).select(*by, F.col("median").alias("centre")))
    off = long.join(centre, by).select(*by, F.abs(F.col("v") - F.col("centre")).alias("v"))
    mad = medians(off, by).where("median >= 1e-8").select(*by, F.col("median").alias("mad"))
    of = lambda i, c: F.max(F.when(F.col("metric") == i, F.col(c)))
    return stored(centre.join(mad, by).groupBy("_key").agg(*(of(i, c).alias(f"_{c}_{m}") for i, m in enumerate(ROBUST) for c in ("centre", "mad"))))


def _with_spread(rows: DataFrame, spread: DataFrame, how: str = "inner") -> DataFrame:
    return rows.withColumn("_key", _key()).join(spread, "_key", how)


def _scores() -> dict:
    """The robust score of each metric, of rows with their condition's spread."""
    return {m: 0.6744897501960817 * F.abs(F.col(m) - F.col(f"_centre_{m}")) / F.col(f"_mad_{m}") for m in ROBUST}


def fingerprint(signal):
    """A hash of a signal's values."""
    return F.sha1(F.concat_ws(",", F.transform(signal, lambda v: v.cast("string"))).cast("binary"))


def repeated_across(marked: DataFrame) -> DataFrame:
    """(file, group, copies, labels) of rows (file, group, fingerprint) whose fingerprint also occurs in another group."""
    twice = marked.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.count_distinct("group").alias("labels")).where("copies > 1 and labels > 1")
    return marked.join(twice, "fingerprint").select("file", "group", "copies", "labels")


def duplicates_across_labels(captures: DataFrame) -> DataFrame:
    """Captures whose very signal also occurs under another label; only hashes are shuffled."""
    return repeated_across(captures.select("file", "group", fingerprint(F.col("signal")).alias("fingerprint")))
