"""Queries on indexes, whole audits, distributions, evaluation reports and neighbourhoods over the driver's tables, and the same in DuckDB's SQL."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import audit, index, metrics, neighbors, reports, splits
from ..sources import captures
from ..sources.shared import kept
from . import views

CLASSES = ["source_1", "source_3", "source_5"]
SINGLE, COMBO = "/w/single", "/w/mix"
GROUPS = ["source_1", "source_3", "source_5", "source_1_source_3_mix", "source_3_source_5_mix", "source_1_source_3_source_5_mix"]
RATIOS = ["ratio_0", "ratio_1", "ratio_2", "ratio_9"]
SIZES = [100, 1000, 3000]


def _files(s, d):
    """Paths of capture files in class folders and mixed folders, made of orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (by % len(names)).cast("int"))
    name = F.concat(k.cast("string"), F.lit(".csv"))
    single = F.concat_ws("/", F.lit(SINGLE), pick(["source_1", "source_3", "source_5", "source_9"], c), F.when(k % 7 > 0, F.concat(F.lit("f"), k % 5)), F.when(k % 7 == 1, "x"), name)
    combo = F.concat_ws("/", F.lit(COMBO), pick(["source_1_source_3_mix", "source_3_source_5_mix", "source_1_source_9_mix", "motor", "unknown_a"], c), F.concat(F.lit("radio_"), k % 3), F.lit("600MHz"), name)
    return views.table(s, d, "orders").select(F.when(k % 3 == 0, combo).otherwise(single).alias("file"))


def _index(s, d):
    return index.index(_files(s, d), SINGLE, COMBO, CLASSES)


def _texts(s, d):
    """Capture files (file, content), one for each order, with its lines as rows: some without marker, with bad, endless or missing numbers, in another encoding, or with no rows at all."""
    x = views.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("x"))
    k = F.col("l_orderkey")
    level = lambda r: (-r["l_extendedprice"] / 1000).cast("decimal(14,5)").cast("string")
    cell = lambda r: F.when((k % 13 == 0) & (r["l_linenumber"] == 2), "bad").when((k % 11 == 0) & (r["l_linenumber"] == 3), "inf").when((k % 17 == 0) & (r["l_linenumber"] == 1), "").otherwise(level(r))
    rows = F.array_join(F.transform("x", lambda r: F.concat(r["l_linenumber"].cast("string"), F.when(k % 2 == 0, ",").otherwise("\t"), cell(r))), "\n")
    head = F.when(k % 5 == 0, "").when(k % 7 == 0, "note\nDATA\n\n").otherwise("a,b\nc\ndata\n")
    text = F.concat(head, F.when(k % 19 == 0, "").otherwise(rows), F.lit("\n"))
    content = F.when(k % 23 == 0, F.concat(F.unhex(F.lit("B5C4")), text.cast("binary"))).otherwise(text.cast("binary"))
    return x.select(k.cast("string").alias("file"), content.alias("content"))


def _parsed(policy):
    def run(s, d):
        x = captures.parsed(_texts(s, d), **policy)
        total = F.round(F.aggregate("signal", F.lit(0.0), lambda a, v: a + v), 2)
        return x.select("file", F.size("signal").alias("n"), total.alias("total"), "has_data_marker", "data_marker_line", "parser_mode", "encoding", "delimiter", "numeric_value_count", "discarded_nonfinite_count", "skipped_empty_rows", "skipped_invalid_rows", "parse_error")

    return run


def _audited(s, d):
    """An index and its parsed captures: orders as files, grouped by priority, with labels by status."""
    o = views.table(s, d, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.cast("string").alias("file"), F.when(k % 3 == 0, "real_dataset").otherwise("single").alias("source_root"), F.col("o_orderpriority").alias("group"), F.concat(F.lit("[1,"), F.when(F.col("o_orderstatus") == "O", "1").otherwise("0"), F.lit("]")).alias("label"), F.concat(F.lit("radio_"), k % 4, F.lit("/600MHz")).alias("condition_path"))
    return rows, captures.parsed(_texts(s, d), need_marker=False, skip_invalid=True)


def _issue_table(s, d):
    rows, parsed = _audited(s, d)
    return audit.issue_table(rows, parsed, -55.0, z=3.5).select("severity", "type", "file", "group", "condition_path")


def _split_rows(s, d):
    """Index rows with label_vec and ratio, split. The index is written once, as it would be before it is split."""
    x = kept(index.training_rows(_index(s, d), 3).withColumn("ratio", L.ratio(F.col("condition_path"))))
    return splits.stratified_split(x, "file", ["group"])


def _distribution(s, d):
    return reports.distribution(_split_rows(s, d), CLASSES, GROUPS, RATIOS, ["train", "val", "test"])


def _predictions(s, d):
    x = views.scores(s, d).withColumn("condition_path", F.concat(F.lit("radio_"), F.col("file") % 4, F.lit("/f")))
    return metrics.decided(x, [0.5, 0.45, 0.6])


def _folder_rows(s, d):
    g = F.get(F.array(*map(F.lit, ["source_1", "source_3", "a_mix", "b_mix", "other"])), (F.col("file") % 5).cast("int"))
    return _predictions(s, d).withColumn("group", g)


def _folder(s, d):
    return reports.folder_evaluation(_folder_rows(s, d), CLASSES)


def _indices(s, d):
    e = views.table(s, d, "embeddings")
    x = e.select((F.col("label") % 7).alias("true_index"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + F.col("vec_id")) % 7).otherwise(F.col("label") % 7).cast("int").alias("pred_index"))
    return reports.from_indices(x, 3)


def _vectors(s, d):
    return views.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _labels(s, d):
    return views.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def _categories(s, d):
    return neighbors.categories(neighbors.nearest(_vectors(s, d), 10, metric="rms"), _labels(s, d), 0.0)


def _metrics_rows(s, d):
    """Orders as rows of two domains."""
    return views.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "synthetic").otherwise("real").alias("domain"), F.col("o_orderpriority").alias("group"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_custkey") % 100).cast("double").alias("age"))


def _subsets(s, d):
    return splits.nested_subsets(views.index(s, d), "file", "group", SIZES)


def _selected(s, d):
    x = splits.quota(_split_rows(s, d), "file", "group", {"source_1": 50}, 100)
    return reports.before_after(x, CLASSES)


QUERIES = {
    "class_discovery": lambda s, d: index.class_names(_files(s, d), SINGLE),
    "files_by_frequency": lambda s, d: index.by_frequency(_files(s, d), SINGLE).groupBy("class", "frequency").agg(F.count("*").alias("n"), F.min("file").alias("first")),
    "group_discovery": lambda s, d: index.grouped(_files(s, d), SINGLE).unionByName(index.grouped(_files(s, d), f"{SINGLE}/source_1/f1/x")).groupBy("group").agg(F.count("*").alias("n")),
    "capture_index": _index,
    "skipped_groups": lambda s, d: index.skipped(_files(s, d), SINGLE, COMBO, CLASSES),
    "not_indexed": lambda s, d: index.not_indexed(_files(s, d), _index(s, d), SINGLE, COMBO),
    "missing_labels": lambda s, d: index.missing_labels(_index(s, d), 3),
    "group_map_differences": lambda s, d: index.map_differences(_index(s, d), {"source_1": 0, "source_3": 1, "source_7": 2}),
    "single_source_rows": lambda s, d: index.single_source(index.training_rows(_index(s, d), 3)).groupBy("group", index.bucket(F.col("group"), CLASSES[:2]).alias("bucket")).agg(F.count("*").alias("n")),
    "strict_captures": _parsed({}),
    "lenient_captures": _parsed({"need_marker": False, "skip_invalid": True}),
    "mixed_policy_captures": _parsed({"need_marker": False}),
    "capture_cells": lambda s, d: captures.parsed_cells(_texts(s, d)).select("file", F.size("signal").alias("n"), F.round(F.aggregate("signal", F.lit(0.0), lambda a, v: a + v), 2).alias("total"), "parse_error"),
    "capture_points": lambda s, d: captures.parsed_points(_texts(s, d)).select("file", F.size("points").alias("n"), F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["t"] * p["v"]), 5).alias("total"), "parse_error"),
    "issue_table": _issue_table,
    "audit_counts": lambda s, d: audit.counts(*_audited(s, d)),
    "distribution_report": _distribution,
    "restricted_distribution": lambda s, d: reports.restricted(_distribution(s, d), "group", GROUPS[:4]),
    "balanced_before_after": _selected,
    "split_summary": lambda s, d: reports.split_counts(_split_rows(s, d)),
    "group_means": lambda s, d: reports.group_means(_metrics_rows(s, d), "group", ["price", "age"], ["price"]),
    "domain_differences": lambda s, d: reports.domain_differences(_metrics_rows(s, d), "group", ["price", "age"]),
    "nested_subsets": _subsets,
    "subset_manifest": lambda s, d: splits.subset_manifest(_subsets(s, d), "group", SIZES),
    "extra_rates": lambda s, d: reports.extra_rates(_predictions(s, d), 2),
    "accuracies": lambda s, d: reports.accuracies(_predictions(s, d), ["1", "2", "99"], 3),
    "focused_errors": lambda s, d: reports.focused_errors(_predictions(s, d), [1, 1, 0], [[1, 1, 1], [0, 1, 1], [1, 0, 1], [0, 1, 0], [1, 0, 0]]),
    "focused_confusions": lambda s, d: reports.confusions_of(_predictions(s, d), [1, 1, 0], [1, 1, 1], 2, 0.6),
    "focused_margins": lambda s, d: reports.margin_summary(reports.confusions_of(_predictions(s, d), [1, 1, 0], [1, 1, 1], 2, 0.6)),
    "folder_evaluation": _folder,
    "metrics_on_indices": lambda s, d: metrics.overall_metrics(_indices(s, d)),
    "index_accuracy": lambda s, d: reports.index_counts(_indices(s, d), 3),
    "ranked_thresholds": lambda s, d: metrics.ranked(metrics.threshold_search(views.scores(s, d), 3, 0.2, 0.8, 0.1), "exact_match", 3, 20),
    "source_counts": lambda s, d: metrics.source_counts(_predictions(s, d)).groupBy("true_sources", "pred_sources").agg(F.count("*").alias("n"), F.count(F.when(F.col("exact"), 1)).alias("exact")),
    "rms_neighbours": lambda s, d: neighbors.nearest(_vectors(s, d), 5, metric="rms").select("id", "neighbour", "place", F.round(-F.col("similarity"), 5).alias("distance")),
    "review_order": lambda s, d: reports.review_order(_categories(s, d)),
    "category_counts": lambda s, d: reports.category_counts(_categories(s, d)),
    "error_locations": lambda s, d: reports.error_locations(_predictions(s, d).select(F.col("file").alias("id"), "exact"), _categories(s, d)),
    "duplicate_groups": lambda s, d: reports.duplicate_groups(views.table(s, d, "documents").select(F.split("text", "").alias("signal"))),
}

_F = """WITH paths AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey%3=0 THEN '/w/mix/' || ['source_1_source_3_mix','source_3_source_5_mix','source_1_source_9_mix','motor','unknown_a'][o_custkey%5+1] || '/radio_' || (o_orderkey%3) || '/600MHz/' || o_orderkey || '.csv'
  ELSE '/w/single/' || ['source_1','source_3','source_5','source_9'][o_custkey%4+1] || CASE WHEN o_orderkey%7>0 THEN '/f' || (o_orderkey%5) ELSE '' END || CASE WHEN o_orderkey%7=1 THEN '/x' ELSE '' END || '/' || o_orderkey || '.csv' END AS file FROM orders),
p AS (SELECT k, file, string_split(file,'/') AS q FROM paths), i0 AS (SELECT *, q[3]='single' AS single, q[4] AS "group", array_to_string(q[5:len(q)-1],'/') AS condition_path FROM p),
i AS (SELECT file, CASE WHEN single THEN 'single' ELSE 'real_dataset' END AS source_root, "group", condition_path, CASE "group" WHEN 'source_1' THEN '[1,0,0]' WHEN 'source_3' THEN '[0,1,0]' WHEN 'source_5' THEN '[0,0,1]' WHEN 'source_1_source_3_mix' THEN '[1,1,0]' WHEN 'source_3_source_5_mix' THEN '[0,1,1]' WHEN 'unknown_a' THEN '[0,0,0]' END AS label FROM i0
  WHERE "group" IN ('source_1','source_3','source_5','source_1_source_3_mix','source_3_source_5_mix') OR "group"='unknown_a')
"""
_T = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(round(-l_extendedprice/1000,5) AS DECIMAL(14,5)) AS v FROM lineitem WHERE l_orderkey%19<>0),
c AS (SELECT *, CASE WHEN k%13=0 AND n=2 THEN 'bad' WHEN k%11=0 AND n=3 THEN 'inf' WHEN k%17=0 AND n=1 THEN 'none' ELSE 'ok' END AS kind, row_number() OVER (PARTITION BY k ORDER BY n, v DESC) AS r FROM l),
o AS (SELECT DISTINCT l_orderkey AS k, l_orderkey%5=0 AS legacy, CASE WHEN l_orderkey%5=0 THEN 0 WHEN l_orderkey%7=0 THEN 2 ELSE 3 END AS marker, CASE WHEN l_orderkey%5<>0 AND l_orderkey%7=0 THEN 1 ELSE 0 END AS blank, l_orderkey%23=0 AS zh FROM lineitem),
"""
#: A missing second field leaves one field: an error after a marker, and the line's number as its last field without one. The odd first character joins the first line; the line is then no marker or no number.
_S = _T + """w AS (SELECT c.*, legacy, marker, blank, zh, CASE WHEN kind='none' AND legacy THEN 'num' WHEN kind='none' THEN 'short' ELSE kind END AS k2 FROM c JOIN o USING (k)),
w2 AS (SELECT *, CASE WHEN zh AND legacy AND r=1 AND k2='num' THEN 'bad' ELSE k2 END AS k3 FROM w),
s AS (SELECT k, count(*) FILTER (k3 IN ('ok','num')) AS good, count(*) FILTER (k3='inf') AS endless, count(*) FILTER (k3 IN ('bad','short')) AS invalid,
  sum(CAST(CAST(CASE WHEN k3='ok' THEN CAST(v AS DOUBLE) WHEN k3='num' THEN n END AS FLOAT) AS DOUBLE)) AS total, min(CASE WHEN k3 IN ('bad','short','inf') THEN r END) AS first FROM w2 GROUP BY k),
e AS (SELECT o.k, o.legacy, o.marker, o.blank, o.zh, coalesce(good,0) AS good, coalesce(endless,0) AS endless, coalesce(invalid,0) AS invalid, total, first, (SELECT k3 FROM w2 WHERE w2.k=o.k AND w2.r=s.first) AS why FROM o LEFT JOIN s ON s.k=o.k),
g AS (SELECT *, CASE WHEN legacy AND {need} THEN 'no DATA section' WHEN NOT legacy AND {strict} AND first IS NOT NULL THEN 'line ' || (marker+blank+first) || ': ' || CASE why WHEN 'bad' THEN 'not numeric' WHEN 'short' THEN 'column 1 required' ELSE 'not finite' END WHEN good=0 THEN 'no numeric values' END AS parse_error FROM e)
SELECT CAST(k AS VARCHAR) AS file, CAST(CASE WHEN parse_error IS NULL THEN good ELSE 0 END AS INT) AS n, round(CASE WHEN parse_error IS NULL THEN total ELSE 0e0 END, 2) AS total, NOT legacy AS has_data_marker, CASE WHEN legacy THEN NULL ELSE CAST(marker AS INT) END AS data_marker_line,
 CASE WHEN legacy THEN 'legacy_last_column' ELSE 'data_section' END AS parser_mode, CASE WHEN zh THEN 'gb18030' ELSE 'utf-8-sig' END AS encoding,
 CASE WHEN k%19=0 THEN CASE WHEN zh AND legacy THEN 'whitespace' ELSE 'unknown' END WHEN k%2=0 THEN 'comma' ELSE 'tab' END AS delimiter,
 CAST(good AS INT) AS numeric_value_count, CAST(endless AS INT) AS discarded_nonfinite_count, CAST(blank + CASE WHEN k%19=0 AND NOT (zh AND legacy) THEN 1 ELSE 0 END AS INT) AS skipped_empty_rows, CAST(invalid + CASE WHEN k%19=0 AND zh AND legacy THEN 1 ELSE 0 END AS INT) AS skipped_invalid_rows, parse_error FROM g"""
_P = """WITH s AS (SELECT vec_id AS file, CAST(label % 7 + 1 AS VARCHAR) AS "group", label % 7 + 1 AS y, [1/(1+exp(-8*CAST(embedding[i] AS DOUBLE))) FOR i IN [1,2,3]] AS prob FROM embeddings),
k AS (SELECT *, [CAST((y >> (3-i)) & 1 AS INT) FOR i IN [1,2,3]] AS target FROM s),
r AS (SELECT *, [CAST(CAST(prob[1] AS FLOAT)>=CAST(5e-1 AS FLOAT) AS INT), CAST(CAST(prob[2] AS FLOAT)>=CAST(45e-2 AS FLOAT) AS INT), CAST(CAST(prob[3] AS FLOAT)>=CAST(6e-1 AS FLOAT) AS INT)] AS pred FROM k),
d AS (SELECT *, pred=target AS exact, '[' || array_to_string(target,',') || ']' AS tl, '[' || array_to_string(pred,',') || ']' AS pl FROM r)
"""
_RMS = """WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.id, a.label, b.id AS neighbour, b.label AS other, round(list_distance(a.v,b.v)/8,9) AS dist FROM e a JOIN e b ON a.id<>b.id),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS place FROM s)
"""
_CAT = _RMS + """, c AS (SELECT id, label, avg(CAST(label=other AS INT)) AS own, max(dist) AS radius FROM w WHERE place<=10 GROUP BY ALL), q AS (SELECT label, quantile_cont(radius,75e-2) AS h, quantile_cont(radius,25e-2) AS l FROM c GROUP BY label),
  g AS (SELECT id, c.label, round(own,6) AS own_fraction, round(radius,6) AS radius, CASE WHEN radius>h+3*(h-l) THEN 'isolated' WHEN own>=8e-1 THEN 'typical' WHEN own>=5e-1 THEN 'boundary' ELSE 'other_dominated' END AS category FROM c JOIN q ON c.label=q.label)
"""
_IDX = """WITH x AS (SELECT o_orderkey AS file, o_orderpriority AS "group", 'ratio_' || o_orderstatus AS ratio FROM orders)"""
_SUB = _IDX + """, c AS (SELECT *, count(*) OVER (PARTITION BY "group") AS n, row_number() OVER (PARTITION BY "group" ORDER BY md5('42|' || CAST(file AS VARCHAR)), file) AS rk FROM x),
a AS (SELECT *, round_even(n*15e-2, 0) AS h0 FROM c), b AS (SELECT *, CASE WHEN n>=3 THEN greatest(h0,1) ELSE h0 END AS h FROM a),
z AS (SELECT file, "group", ratio, CASE WHEN rk<=h THEN 'val' WHEN rk<=2*h THEN 'test' ELSE 'train' END AS split, CASE WHEN rk<=2*h THEN NULL WHEN rk-2*h<=100 THEN 100 WHEN rk-2*h<=1000 THEN 1000 WHEN rk-2*h<=3000 THEN 3000 END AS smallest FROM b)
"""


def _split_sql() -> str:
    from .queries import _SPLIT

    return _F + ", x AS (SELECT * FROM i), " + _SPLIT.format(by='"group"', key="file")


_DIST = """, y AS (SELECT unnest([split,'overall']) AS split, "group", regexp_replace(regexp_extract(condition_path,'(ratio_|radio_)[^/]*'),'^radio_','ratio_') AS ratio, label FROM z),
kk AS (SELECT split, 'label' AS section, label AS key FROM y UNION ALL SELECT split, 'group', "group" FROM y UNION ALL SELECT split, 'ratio', ratio FROM y WHERE ratio<>''),
ex AS (SELECT sp AS split, section, key FROM (SELECT unnest(['train','val','test','overall']) AS sp), (SELECT 'label' AS section, unnest(['[0,0,1]','[0,1,0]','[0,1,1]','[1,0,0]','[1,0,1]','[1,1,0]','[1,1,1]']) AS key UNION ALL SELECT 'group', unnest(['source_1','source_3','source_5','source_1_source_3_mix','source_3_source_5_mix','source_1_source_3_source_5_mix']) UNION ALL SELECT 'ratio', unnest(['ratio_0','ratio_1','ratio_2','ratio_9']))),
ct AS (SELECT split, section, key, count(*) AS n FROM kk GROUP BY ALL), al AS (SELECT split, section, key, coalesce(n,0) AS count, ex.split IS NOT NULL AS wanted FROM ct FULL JOIN ex USING (split, section, key)),
al2 AS (SELECT al.split, al.section, al.key, al.count, ex.key IS NOT NULL AS wanted FROM al LEFT JOIN ex ON ex.split=al.split AND ex.section=al.section AND ex.key=al.key),
tt AS (SELECT split, count(*) AS n, sum(CAST(label[2] AS INT)) AS a, sum(CAST(label[4] AS INT)) AS b, sum(CAST(label[6] AS INT)) AS c FROM y GROUP BY split),
sr AS (SELECT split, n, unnest(['source_1','source_3','source_5']) AS key, unnest([a,b,c]) AS pos FROM tt),
rep AS (SELECT split, section, key, count, CAST(NULL AS DOUBLE) AS value FROM al2
 UNION ALL SELECT split, section || '_imbalance', '', max(count), CASE WHEN min(count)>0 THEN round(CAST(max(count) AS DOUBLE)/min(count),9) END FROM al2 WHERE wanted AND section<>'ratio' GROUP BY split, section
 UNION ALL SELECT split, 'samples', '', n, NULL FROM tt UNION ALL SELECT split, 'sources_per_sample', '', CAST(a+b+c AS BIGINT), round(CAST(a+b+c AS DOUBLE)/n,9) FROM tt
 UNION ALL SELECT split, 'positive', key, CAST(pos AS BIGINT), round(CAST(pos AS DOUBLE)/n,9) FROM sr UNION ALL SELECT split, 'negative', key, CAST(n-pos AS BIGINT), round(1-CAST(pos AS DOUBLE)/n,9) FROM sr
 UNION ALL SELECT split, 'positive_ratio_gap', '', n, round(CAST(greatest(a,b,c)-least(a,b,c) AS DOUBLE)/n,9) FROM tt)
"""

_ALL_LABELS = "['[0,0,1]','[0,1,0]','[0,1,1]','[1,0,0]','[1,0,1]','[1,1,0]','[1,1,1]']"


#: The values of the lenient policy by file, as signals of _audited.
_V = _S.split("s AS (SELECT k, count(*)")[0].rstrip().removesuffix(",") + """ SELECT CAST(k AS VARCHAR) AS file, o_orderpriority AS "group", 'radio_' || (k%4) AS ratio, CAST(CAST(CASE WHEN k3='ok' THEN CAST(v AS DOUBLE) ELSE n END AS FLOAT) AS DOUBLE) AS x, r AS i FROM w2 JOIN orders ON o_orderkey=k WHERE k3 IN ('ok','num')"""


def _issues_sql() -> str:
    from .queries import _CAP, _ISS, ORACLES

    outliers = ORACLES["condition_outliers"][len(_CAP) :]
    made, chosen = outliers.split("\n  SELECT file")
    rest = _CAP.split("\nd AS", 1)[1]
    return f"""WITH v AS (SELECT * FROM ({_V})),
d AS{rest}{_ISS[len(_CAP) :].replace("<= -40", "<= -55")}{made}, pr AS (SELECT * FROM ({_S.format(need="false", strict="false")})), ix AS (SELECT CAST(o_orderkey AS VARCHAR) AS file, o_orderpriority AS "group", 'radio_' || (o_orderkey%4) || '/600MHz' AS condition_path, o_orderstatus='O' AS label FROM orders),
md AS (SELECT n AS mode FROM st GROUP BY n ORDER BY count(*) DESC, min(file) LIMIT 1), sg AS (SELECT file, list(x ORDER BY i) AS sig FROM v GROUP BY file), du AS (SELECT sig FROM sg JOIN ix USING (file) GROUP BY sig HAVING count(*)>1 AND count(DISTINCT label)>1)
SELECT severity, type, file, "group", condition_path FROM iss UNION ALL SELECT 'error', 'parse_failure', file, "group", condition_path FROM ix JOIN pr USING (file) WHERE parse_error IS NOT NULL
UNION ALL SELECT 'error', 'nonfinite_values', file, "group", condition_path FROM ix JOIN pr USING (file) WHERE parse_error IS NULL AND discarded_nonfinite_count>0
UNION ALL SELECT 'error', 'length_mismatch', file, "group", condition_path FROM st, md WHERE n<>mode
UNION ALL SELECT 'error', 'duplicate_across_labels', file, "group", condition_path FROM sg JOIN du USING (sig) JOIN ix USING (file)
UNION ALL SELECT 'review', 'condition_outlier', file, "group", condition_path FROM (SELECT file{chosen})"""


def oracles() -> dict[str, str]:
    split, lenient = _split_sql(), _S.format(need="false", strict="false")
    return {
        "issue_table": _issues_sql(),
        "capture_points": _T + """p AS (SELECT k, count(*) AS n, sum(n*CAST(v AS DOUBLE)) AS t FROM c WHERE kind='ok' GROUP BY k)
  SELECT CAST(o.k AS VARCHAR) AS file, CAST(CASE WHEN legacy THEN 0 ELSE coalesce(n,0) END AS INT) AS n, round(CASE WHEN legacy THEN 0e0 ELSE coalesce(t,0e0) END,5) AS total, CASE WHEN legacy THEN 'no DATA section' WHEN n IS NULL THEN 'no numeric values' END AS parse_error FROM o LEFT JOIN p ON p.k=o.k""",
        "capture_cells": _T + """w AS (SELECT c.k, CASE WHEN c.k%2=0 AND kind='ok' THEN CAST(v AS DOUBLE) WHEN zh AND legacy AND r=1 THEN NULL WHEN c.k%2=0 AND legacy THEN n WHEN c.k%2=1 AND kind='none' THEN n END AS x FROM c JOIN o USING (k)),
  p AS (SELECT k, count(x) AS n, sum(CAST(CAST(x AS FLOAT) AS DOUBLE)) AS t FROM w GROUP BY k) SELECT CAST(o.k AS VARCHAR) AS file, CAST(coalesce(n,0) AS INT) AS n, round(coalesce(t,0e0),2) AS total, CASE WHEN coalesce(n,0)=0 THEN 'no numeric values' END AS parse_error FROM o LEFT JOIN p ON p.k=o.k""",
        "audit_counts": f"""WITH pr AS (SELECT * FROM ({lenient})), x AS (SELECT o_orderkey AS k, o_orderpriority AS g, CASE WHEN o_orderstatus='O' THEN '[1,1]' ELSE '[1,0]' END AS label, 'ratio_' || (o_orderkey%4) AS r, 'radio_' || (o_orderkey%4) || '/600MHz' AS cp, pr.* FROM orders LEFT JOIN pr ON pr.file=CAST(o_orderkey AS VARCHAR)),
  y AS (SELECT *, file IS NOT NULL AND parse_error IS NULL AS good FROM x), z AS (SELECT unnest(['discovered_files','parsed_files','parse_failed_files','source_root','group','label','ratio','condition','group_ratio','length','layout']) AS section,
  unnest(['', CASE WHEN good THEN '' END, CASE WHEN NOT good THEN '' END, CASE WHEN k%3=0 THEN 'real_dataset' ELSE 'single' END, g, label, r, g || ' | ' || cp, g || ' | ' || r, CASE WHEN good THEN CAST(n AS VARCHAR) END, CASE WHEN good THEN CASE WHEN has_data_marker THEN 'with_DATA_marker' ELSE 'legacy_without_DATA_marker' END END]) AS key FROM y)
  SELECT section, key, count(*) AS n FROM z WHERE key IS NOT NULL GROUP BY ALL""",
        "class_discovery": _F + "SELECT DISTINCT \"group\" AS class FROM i0 WHERE single",
        "files_by_frequency": _F + "SELECT \"group\" AS class, CASE WHEN len(q)=5 THEN 'default' ELSE q[5] END AS frequency, count(*) AS n, min(file) AS first FROM i0 WHERE single AND len(q)<=6 GROUP BY ALL",
        "group_discovery": _F + "SELECT \"group\", count(*) AS n FROM i0 WHERE single GROUP BY ALL UNION ALL SELECT 'x', count(*) FROM i0 WHERE single AND file LIKE '/w/single/source_1/f1/x/%' HAVING count(*)>0",
        "capture_index": _F + "SELECT *, CAST(label[2] AS INT) AS source_1, CAST(label[4] AS INT) AS source_3, CAST(label[6] AS INT) AS source_5 FROM i",
        "skipped_groups": _F + "SELECT 'single' AS source_root, \"group\", 'no class' AS reason, count(*) AS files FROM i0 WHERE single AND \"group\"='source_9' GROUP BY ALL UNION ALL SELECT 'real_dataset', \"group\", CASE WHEN \"group\"='motor' THEN 'no source in the name' ELSE 'unknown sources: source_9' END, count(*) FROM i0 WHERE NOT single AND \"group\" IN ('motor','source_1_source_9_mix') GROUP BY ALL",
        "not_indexed": _F + "SELECT file FROM paths WHERE file NOT IN (SELECT file FROM i)",
        "missing_labels": _F + f"SELECT label FROM (SELECT unnest({_ALL_LABELS}) AS label) WHERE label NOT IN (SELECT label FROM i)",
        "group_map_differences": _F + "SELECT DISTINCT \"group\", 'missing' AS problem FROM i WHERE \"group\" NOT IN ('source_1','source_3','source_7') UNION ALL SELECT g, 'extra' FROM (SELECT unnest(['source_1','source_3','source_7']) AS g) WHERE g NOT IN (SELECT \"group\" FROM i)",
        "single_source_rows": _F + "SELECT \"group\", \"group\" AS bucket, count(*) AS n FROM i WHERE label IN ('[1,0,0]','[0,1,0]','[0,0,1]') GROUP BY ALL",
        "strict_captures": _S.format(need="true", strict="true"),
        "lenient_captures": _S.format(need="false", strict="false"),
        "mixed_policy_captures": _S.format(need="false", strict="true"),
        "distribution_report": split + _DIST + "SELECT * FROM rep",
        "restricted_distribution": split + _DIST + "SELECT r.split, r.key, r.count, round(CASE WHEN w.count>0 THEN CAST(r.count AS DOUBLE)/w.count ELSE 0e0 END,9) AS fraction FROM rep r JOIN rep w ON w.section='group' AND w.split='overall' AND w.key=r.key WHERE r.section='group' AND r.split<>'overall' AND r.key IN ('source_1','source_3','source_5','source_1_source_3_mix')",
        "balanced_before_after": _F + """, c AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY md5('42|' || file), file) <= CASE "group" WHEN 'source_1' THEN 50 ELSE 100 END AS sel FROM i), pr AS (SELECT unnest(['source_1','source_3','source_5']) AS key, unnest([CAST(label[2] AS INT),CAST(label[4] AS INT),CAST(label[6] AS INT)]) AS b, sel FROM c)
  SELECT 'combo' AS section, label[2]||label[4]||label[6] AS key, CAST(count(*) AS DOUBLE) AS before, CAST(count(*) FILTER (sel) AS DOUBLE) AS after FROM c GROUP BY ALL UNION ALL SELECT 'positive_ratio', key, round(avg(b),9), round(avg(b) FILTER (sel),9) FROM pr GROUP BY key""",
        "split_summary": split + """SELECT coalesce("group",'(all)') AS "group", count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val, count(*) FILTER (split='test') AS test, count(*) AS total FROM z GROUP BY GROUPING SETS (("group"),())""",
        "group_means": "SELECT o_orderpriority AS \"group\", count(*) AS n, round(avg(o_totalprice/1000),6) AS price_mean, round(avg(o_custkey%100),6) AS age_mean, round(coalesce(stddev_samp(o_totalprice/1000),0),6) AS price_std FROM orders GROUP BY 1",
        "domain_differences": """WITH m AS (SELECT o_orderkey%3<>0 AS own, o_orderpriority AS "group", unnest(['price','age']) AS metric, unnest([o_totalprice/1000, CAST(o_custkey%100 AS DOUBLE)]) AS v FROM orders), r AS (SELECT "group", metric, avg(v) AS r FROM m WHERE own GROUP BY ALL), s AS (SELECT metric, avg(v) AS s FROM m WHERE NOT own GROUP BY ALL)
  SELECT "group", metric, round(r,6) AS real, round(s,6) AS synthetic, round(r-s,6) AS difference, round(r/s,6) AS ratio FROM r JOIN s USING (metric)""",
        "nested_subsets": _SUB + "SELECT * REPLACE (CAST(smallest AS INT) AS smallest) FROM z",
        "subset_manifest": _SUB + """, c2 AS (SELECT "group", count(*) AS total, count(*) FILTER (split='train') AS available FROM z GROUP BY 1) SELECT *, CAST(s AS INT) AS requested, least(available,s) AS actual, available<s AS limited FROM (SELECT "group", total, available, unnest([100,1000,3000]) AS s FROM c2)""".replace("SELECT *, CAST(s AS INT)", 'SELECT "group", total, available, CAST(s AS INT)'),
        "extra_rates": _P + "SELECT round(coalesce(avg(CAST(list_sum(pred)=3 AS INT)) FILTER (list_sum(target)=2),0),9) AS double_as_triple_rate, round(coalesce(avg(pred[3]) FILTER (target[3]=0),0),9) AS focus_over_rate FROM d",
        "accuracies": _P + f""", l AS (SELECT exact, unnest(['group','label','ratio']) AS section, unnest(["group", tl, 'ratio_' || (file%4)]) AS key FROM d), ex AS (SELECT 'group' AS section, unnest(['1','2','99']) AS key UNION ALL SELECT 'label', unnest({_ALL_LABELS}))
  SELECT section, key, count(exact) AS n, round(coalesce(avg(CAST(exact AS INT)),0),9) AS accuracy FROM l FULL JOIN ex USING (section, key) GROUP BY ALL""",
        "focused_errors": _P + "SELECT q AS pred_label, count(pl) AS n, round(CASE WHEN (SELECT count(*) FROM d WHERE tl='[1,1,0]')>0 THEN CAST(count(pl) AS DOUBLE)/(SELECT count(*) FROM d WHERE tl='[1,1,0]') ELSE 0 END,9) AS rate FROM (SELECT unnest(['[1,1,0]','[1,1,1]','[0,1,1]','[1,0,1]','[0,1,0]','[1,0,0]']) AS q) LEFT JOIN d ON pl=q AND tl='[1,1,0]' GROUP BY q",
        "focused_confusions": _P + "SELECT file, \"group\", round(prob[3],6) AS prob, round(prob[3]-6e-1,6) AS margin FROM d WHERE tl='[1,1,0]' AND pl='[1,1,1]'",
        "focused_margins": _P + ", c AS (SELECT round(prob[3],6) AS p, round(prob[3]-6e-1,6) AS m FROM d WHERE tl='[1,1,0]' AND pl='[1,1,1]') SELECT count(*) AS count, " + ", ".join(f"round(coalesce({f.format(v)},0),6) AS {n}_{k}" for v, n in (("p", "prob"), ("m", "margin")) for k, f in (("mean", "avg({0})"), ("median", "quantile_cont({0},5e-1)"), ("p90", "quantile_cont({0},9e-1)"), ("min", "min({0})"), ("max", "max({0})"))) + " FROM c",
        "folder_evaluation": _P + """, g AS (SELECT * REPLACE (['source_1','source_3','a_mix','b_mix','other'][file%5+1] AS "group") FROM d), b AS (SELECT *, CASE WHEN "group" LIKE '%_mix' THEN 'mix' ELSE "group" END AS bk FROM g)
  SELECT 'exact_match' AS section, '' AS key, count(*) AS n, round(avg(CAST(exact AS INT)),9) AS value FROM g UNION ALL SELECT 'group_accuracy', "group", count(*), round(avg(CAST(exact AS INT)),9) FROM g GROUP BY "group"
  UNION ALL SELECT ['source_1','source_3','source_5'][j] || '_prob_mean', "group", count(*), round(avg(prob[j]),6) FROM g, (SELECT unnest([1,2,3]) AS j) GROUP BY j, "group" UNION ALL SELECT 'predicted', bk || ' | ' || pl, count(*), NULL FROM b WHERE bk<>'other' GROUP BY bk, pl""",
        "metrics_on_indices": """WITH e AS (SELECT label%7+1 AS y, CASE WHEN vec_id%3=0 THEN (label+vec_id)%7 ELSE label%7 END + 1 AS p FROM embeddings), k AS (SELECT y=p AS exact, [CAST((y >> (3-i)) & 1 AS INT) FOR i IN [1,2,3]] AS target, [CAST((p >> (3-i)) & 1 AS INT) FOR i IN [1,2,3]] AS pred FROM e),
  r AS (SELECT *, pred[1]>target[1] OR pred[2]>target[2] OR pred[3]>target[3] AS over, pred[1]<target[1] OR pred[2]<target[2] OR pred[3]<target[3] AS under FROM k) SELECT {metrics} FROM r""",
        "index_accuracy": """WITH e AS (SELECT label%7 AS y, CASE WHEN vec_id%3=0 THEN (label+vec_id)%7 ELSE label%7 END AS p FROM embeddings) SELECT CAST(j AS INT) AS index, (SELECT count(*) FROM e WHERE y=j) AS n, round(coalesce((SELECT avg(CAST(p=y AS INT)) FROM e WHERE y=j),0),9) AS accuracy, (SELECT count(*) FROM e WHERE p=j) AS predicted FROM (SELECT unnest(range(0,7)) AS j)""",
        "source_counts": _P + "SELECT CAST(list_sum(target) AS INT) AS true_sources, CAST(list_sum(pred) AS INT) AS pred_sources, count(*) AS n, count(*) FILTER (exact) AS exact FROM d GROUP BY 1,2",
        "rms_neighbours": _RMS + "SELECT id, neighbour, CAST(place AS INT) AS place, round(dist,5) AS distance FROM w WHERE place<=5",
        "review_order": _CAT + "SELECT * FROM g",
        "category_counts": _CAT + "SELECT label, count(*) FILTER (category='isolated') AS isolated, count(*) FILTER (category='other_dominated') AS other_dominated, count(*) FILTER (category='boundary') AS boundary, count(*) FILTER (category='typical') AS typical FROM g GROUP BY label",
        "error_locations": _CAT + ", " + _P.removeprefix("WITH ").replace("s AS (", "s9 AS (", 1).replace("FROM s)", "FROM s9)").replace(" k AS", " k9 AS").replace("\nk AS", "\nk9 AS").replace("FROM k)", "FROM k9)") + "SELECT category, count(*) AS n, count(*) FILTER (NOT exact) AS errors FROM g JOIN d ON d.file=g.id GROUP BY category",
        "duplicate_groups": "WITH c AS (SELECT count(*) AS copies FROM documents GROUP BY text HAVING count(*)>1) SELECT copies, count(*) AS groups, CAST(sum(copies-1) AS BIGINT) AS extra FROM c GROUP BY copies",
    }
