"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document gets its rule counts in one pass, without a shuffle of text. Rule failures
are counted by host (`source`). The hosts' true failure rates are taken to follow a beta
prior, fitted by moments: its mean is the pooled rate, and its variance is that of the hosts'
rates, weighted by their documents, less the part that sampling explains. The prior weighs
1 to MOST_WEIGHT documents, so that a large host's own rate counts whatever the fit. A host is
strict if its rate's posterior lies above the pooled rate by SURE standard deviations (the 90 %
point): its documents go if they fail any rule. On other hosts a document goes if it fails two.
A document that fails no rule stays whatever its host. Documents that fail the base rule always go.

Null text has no words and fails the base rule. A null source is a host of its own; an empty
table has no host and no row. A host just at the cut is strict. Repeated rows count as often as
they occur and are judged alike. A very long text is one row of work. Columns besides doc_id, text
and source play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, checkpoint, read

SURE, MOST_WEIGHT = 1.2816, 50.0
#: So many strict hosts are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
SPACE = r"[ \t-\r]+"
RULES = ("base_failed", "f_symbols", "f_lines", "f_shout")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column, n: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more."""

    def positions(w: Column) -> Column:
        gram = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        twice = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return _let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram)), twice)

    def hashes(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    covered = lambda w: F.size(F.array_distinct(F.flatten(F.transform(positions(w), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    repeats = lambda w: _let(hashes(w), lambda s: F.size(F.array_distinct(s)) < F.size(s))
    return F.when(n < 4, F.lit(0)).otherwise(_let(words, lambda w: F.when(repeats(w), covered(w)).otherwise(F.lit(0))))


def rule_counts(docs: DataFrame, *carried: str) -> DataFrame:
    """docs' doc_id, source and carried columns with rule counts and failures, one row for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    split = docs.select("doc_id", "source", *carried, text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"), lines.alias("lines"))
    n = F.size("words")
    counted = split.select(
        "doc_id",
        "source",
        *carried,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), n).cast("long").alias("n_repeat_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    return counted.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (100 * F.col("n_symbols") > 20 * F.col("n_words")).alias("f_symbols"),
        (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")).alias("f_lines"),
        (100 * F.col("n_capitals") > 30 * F.col("word_chars")).alias("f_shout"),
    )


def host_verdicts(counts: DataFrame) -> DataFrame:
    """(host, n, host_rate, strict): every host's documents, its failure rate shrunk by the empirical beta prior, and the verdict."""
    failed = F.col("base_failed") | F.col("f_symbols") | F.col("f_lines") | F.col("f_shout")
    hosts = counts.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("failed"))
    total, bad, squares, several = hosts.agg(F.sum("n"), F.sum("failed"), F.sum(F.col("failed") * F.col("failed") / F.col("n")), F.count("*")).first()
    m, weight = (bad / total if total else 0.0), MOST_WEIGHT
    between = squares / total - m * m - m * (1 - m) * several / total if total else 0.0
    if between > 0:
        weight = min(MOST_WEIGHT, max(1.0, m * (1 - m) / between - 1))
    size = F.col("n") + F.lit(weight)
    rate = (F.col("failed") + F.lit(m * weight)) / size
    return hosts.select("host", "n", rate.alias("host_rate"), (rate - F.lit(m) >= SURE * F.sqrt(rate * (1 - rate) / (size + 1))).alias("_sure")).select("host", "n", "host_rate", (F.col("_sure") & (F.col("host_rate") > m)).alias("strict"))


def judged(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, rule counts, base_failed, strict, kept and carried columns for every row of docs (doc_id, text, source)."""
    counts = checkpoint(rule_counts(docs.select("doc_id", "text", "source", *carried), *carried))
    hosts = checkpoint(host_verdicts(counts).where("strict").select("host", F.lit(True).alias("found")))
    rows = attached(counts, hosts, F.col("source").eqNullSafe(F.col("host")), BROADCAST_HOSTS, "doc_id")
    strict = F.coalesce("found", F.lit(False))
    soft = sum((F.col(c).cast("int") for c in RULES[1:]), F.lit(0))
    kept = ~F.col("base_failed") & (soft < F.when(strict, 1).otherwise(2))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), strict.alias("strict"), *carried)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Each row is judged on its own, whatever its doc_id, and is carried along to its verdict."""
    return judged(docs.withColumn("_row", F.struct(*docs.columns)), "_row").where("kept").select("_row.*")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text,'') AS text, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS w,
  [x FOR x IN string_split(coalesce(text,''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l, row_number() OVER () AS r FROM documents),
g AS (SELECT r, unnest(range(1,len(w)-1)) AS i, unnest([w[j:j+2] FOR j IN range(1,len(w)-1)]) AS k FROM t WHERE len(w)>=3),
rep AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest(range(i,i+3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r,k) AS n FROM g) WHERE n>1) GROUP BY r),
c AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w,'')) AS BIGINT) AS word_chars,
  CAST(length(text)-length(regexp_replace(text,'[#*$%&|<>]','','g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l)-len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.c,0) AS BIGINT) AS n_repeat_words,
  length(text)-length(regexp_replace(text,'[A-Z]','','g')) AS n_capitals FROM t LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words AS base_failed, 100*n_symbols>20*n_words AS f1, 100*n_dup_lines>50*n_lines AS f2, 100*n_capitals>30*word_chars AS f3 FROM c),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed OR f1 OR f2 OR f3 AS BIGINT)) AS failed FROM f GROUP BY 1),
p AS (SELECT CAST(sum(failed) AS DOUBLE)/sum(n) AS m, sum(n) AS t, sum(CAST(failed*failed AS DOUBLE)/n) AS sq, count(*) AS hs FROM h),
v AS (SELECT m, sq/t - m*m - m*(1-m)*hs/t AS tau FROM p),
q AS (SELECT m, CASE WHEN tau>0 THEN least(greatest(m*(1-m)/tau-1, 1e0), 5e1) ELSE 5e1 END AS wt FROM v),
z AS (SELECT source, n, m, wt, (failed+m*wt)/(n+wt) AS rate FROM h, q),
s AS (SELECT source, rate>m AND rate-m >= 12816e-4*sqrt(rate*(1-rate)/(n+wt+1)) AS strict FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CAST(f1 AS INT)+CAST(f2 AS INT)+CAST(f3 AS INT) < CASE WHEN strict THEN 1 ELSE 2 END AS kept, strict
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""
