"""Queries over the driver's tables, and the same in DuckDB's SQL."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import audit, index, metrics, neighbors, reports, splits
from ..sources.captures import parsed
from . import file_queries, index_queries, late_queries, model_queries, preparation_queries, report_queries, views

CLASSES = ["source_1", "source_3", "source_5"]
GROUPS = ["1", "2", "3", "4", "5", "6", "7", "8"]


def _stats(s, d):
    return audit.signal_stats(views.captures(s, d))


def _decided(s, d):
    return metrics.decided(views.scores(s, d))


def _vectors(s, d):
    return views.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _labels(s, d):
    return views.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label")


def _parsed_text(s, d):
    """Captures written as instrument text and parsed back."""
    e = views.table(s, d, "events")
    x = e.groupBy("event_type", "user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    lines = F.transform("x", lambda r: F.concat_ws(",", r["event_id"].cast("string"), r["value"].cast("string")))
    text = F.concat(F.lit("instrument,model-x\nDATA\n"), F.array_join(lines, "\n"))
    out = parsed(x.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("file"), text.cast("binary").alias("content")))
    return out.select("file", "has_data_marker", "data_marker_line", F.col("numeric_value_count").cast("long").alias("n"), F.round(F.aggregate("signal", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), "parse_error")


def _group_labels(s, d):
    """Group names made of nation and source ids, parsed to labels."""
    docs = views.table(s, d, "documents").select("doc_id", F.col("doc_id").cast("long").alias("k"))
    tok = lambda m: F.concat(F.lit("source_"), (F.col("k") % m).cast("string"))
    group = F.when(F.col("k") % 11 == 0, F.lit("unknown_x")).when(F.col("k") % 3 == 0, tok(6)).otherwise(F.concat_ws("_", tok(6), tok(4), F.lit("mix")))
    x = docs.select("doc_id", group.alias("group"))
    p = L.parse_group(F.col("group"), CLASSES)
    return x.select("doc_id", "group", L.label_text(p["label"]).alias("label"), p["error"].isNotNull().alias("rejected"))


def _paths(s, d):
    path = F.regexp_replace("url", "^https?://", "")
    return views.table(s, d, "pages").select("page_id", L.top_folder(path).alias("top"), L.ratio(F.concat(F.lit("radio_"), F.col("page_id") % 5, F.lit("/x")), "(none)").alias("ratio"))


def _distribution(s, d):
    """Counts of the two labels in each split and over all."""
    lab = views.table(s, d, "labels")
    split = splits.stratified_split(lab.withColumn("combo", F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string"))), "doc_id", ["combo"])
    return reports.counts_by_split(split, "combo")


QUERIES = {
    "signal_stats": _stats,
    "signal_stats_by_group": lambda s, d: audit.summary_by(_stats(s, d)),
    "signal_issues": lambda s, d: audit.issues(_stats(s, d), no_signal_db=-40.0).drop("detail"),
    "issue_counts": lambda s, d: audit.issue_counts(audit.issues(_stats(s, d), no_signal_db=-40.0)),
    "length_mismatch": lambda s, d: audit.modal_length(_stats(s, d)),
    "recommended_preprocessing": lambda s, d: audit.recommended(_stats(s, d)),
    "condition_outliers": lambda s, d: audit.condition_outliers(_stats(s, d), z=3.5),
    "duplicates_across_labels": lambda s, d: audit.duplicates_across_labels(views.table(s, d, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("group"), F.split("text", "").alias("signal"))),
    "parse_captures": _parsed_text,
    "group_labels": _group_labels,
    "path_parts": _paths,
    "index_summary": lambda s, d: index.summary(views.index(s, d)),
    "stratified_split": lambda s, d: splits.stratified_split(views.index(s, d), "file", ["group", "ratio"]).select("file", "group", "ratio", "split"),
    "quota_selection": lambda s, d: splits.quota(views.index(s, d), "file", "group", {"1-URGENT": 100, "5-LOW": 50}, 80),
    "first_per_group": lambda s, d: splits.first_per_group(views.index(s, d), "group", "file", 7),
    "combo_weights": lambda s, d: splits.combo_weights(views.table(s, d, "labels").select(F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("combo")), "combo"),
    "label_distribution": _distribution,
    "decision_flags": lambda s, d: _decided(s, d).select("file", L.combo(F.col("pred")).alias("pred"), L.combo_index(F.col("target")).alias("target_index"), "exact", "over", "under"),
    "class_metrics": lambda s, d: metrics.class_metrics(_decided(s, d)),
    "overall_metrics": lambda s, d: metrics.overall_metrics(_decided(s, d)),
    "metrics_at_thresholds": lambda s, d: metrics.at_thresholds(views.scores(s, d), [0.3, 0.4, 0.5, 0.6, 0.7]),
    "combo_confusion": lambda s, d: metrics.confusion(_decided(s, d)),
    "group_accuracy": lambda s, d: metrics.accuracy_by(_decided(s, d), "group", GROUPS),
    "threshold_search": lambda s, d: metrics.threshold_search(views.scores(s, d), 3, 0.2, 0.8, 0.1),
    "open_set": lambda s, d: metrics.open_set(views.scores(s, d), 0.8, 0.55),
    "presence_status": lambda s, d: metrics.presence(views.scores(s, d)),
    "nearest_neighbours": lambda s, d: neighbors.nearest(_vectors(s, d), 5).select("id", "neighbour", "place", F.round("similarity", 6).alias("similarity")),
    "probed_neighbours": lambda s, d: neighbors.probed(_vectors(s, d), 5).select("id", "neighbour", "place", F.round("similarity", 6).alias("similarity")),
    "neighbour_categories": lambda s, d: neighbors.categories(neighbors.nearest(_vectors(s, d), 10), _labels(s, d)),
    "point_statistics": lambda s, d: neighbors.point_statistics(_vectors(s, d)),
}

_CAP = """WITH v AS (SELECT event_type || '/' || user_id AS file, event_type AS "group", 'ratio_' || (user_id % 4) AS ratio, CAST(CAST(-value/5 AS FLOAT) AS DOUBLE) AS x,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS i FROM events),
d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY file ORDER BY i)) AS j FROM v),
e AS (SELECT *, min(x) OVER (PARTITION BY file) AS lo, max(x) OVER (PARTITION BY file) AS hi FROM d),
st AS (SELECT file, any_value("group") AS "group", any_value(ratio) || '/600MHz' AS condition_path, any_value(ratio) AS ratio, count(*) AS n, CAST(count(*) FILTER (j >= 12) AS BIGINT) AS jump_count, count(DISTINCT x) AS unique_values,
  round(min(x),4) AS min_db, round(quantile_cont(x,1e-2),4) AS p01_db, round(quantile_cont(x,5e-2),4) AS p05_db, round(sum(x)/count(*),4) AS mean_db, round(quantile_cont(x,5e-1),4) AS median_db,
  round(quantile_cont(x,95e-2),4) AS p95_db, round(quantile_cont(x,99e-2),4) AS p99_db, round(max(x),4) AS max_db, round(stddev_pop(x),4) AS std_db, round(max(x)-min(x),4) AS p2p_db,
  round(coalesce(quantile_cont(j,95e-2),0e0),4) AS diff_p95, round(coalesce(quantile_cont(j,99e-2),0e0),4) AS diff_p99, round(coalesce(max(j),0e0),4) AS max_jump,
  CASE WHEN count(*)>1 THEN round(CAST(count(*) FILTER (j >= 12) AS DOUBLE)/(count(*)-1),4) ELSE 0e0 END AS jump_ratio, round(CAST(count(*) FILTER (x>=0) AS DOUBLE)/count(*),4) AS nonnegative_ratio,
  round(CAST(greatest(count(*) FILTER (x=lo), count(*) FILTER (x=hi)) AS DOUBLE)/count(*),4) AS boundary_ratio FROM e GROUP BY file)
"""
_ISS = _CAP + """, iss AS (SELECT * FROM (
  SELECT 'error' AS severity, 'flat_or_nearly_flat' AS type, file, "group", condition_path FROM st WHERE std_db<=5e-2 OR p2p_db<=5e-1
  UNION ALL SELECT 'error','implausible_db_range',file,"group",condition_path FROM st WHERE min_db < -160 OR max_db > 10
  UNION ALL SELECT 'error','nonnegative_db_values',file,"group",condition_path FROM st WHERE nonnegative_ratio>0
  UNION ALL SELECT 'review','possible_clipping',file,"group",condition_path FROM st WHERE boundary_ratio>=1e-1 AND unique_values>1
  UNION ALL SELECT 'review','large_db_jump',file,"group",condition_path FROM st WHERE max_jump>=12
  UNION ALL SELECT 'review','possible_no_signal',file,"group",condition_path FROM st WHERE p95_db <= -40))
"""
_SC = """WITH s AS (SELECT vec_id AS file, CAST(label % 7 + 1 AS VARCHAR) AS "group", label % 7 + 1 AS y, [1/(1+exp(-8*CAST(embedding[i] AS DOUBLE))) FOR i IN [1,2,3]] AS prob FROM embeddings),
k AS (SELECT *, [CAST((y >> (3-i)) & 1 AS INT) FOR i IN [1,2,3]] AS target FROM s)
"""
_DEC = _SC + """, p AS (SELECT *, [CAST(CAST(prob[i] AS FLOAT) >= CAST(0.5 AS FLOAT) AS INT) FOR i IN [1,2,3]] AS pred FROM k),
r AS (SELECT *, pred = target AS exact, pred[1]>target[1] OR pred[2]>target[2] OR pred[3]>target[3] AS over, pred[1]<target[1] OR pred[2]<target[2] OR pred[3]<target[3] AS under FROM p)
"""
_MET = """ count(*) AS n, round(avg(CAST(exact AS INT)),9) AS exact_match, round(avg(CAST(over AS INT)),9) AS over_rate, round(avg(CAST(under AS INT)),9) AS under_rate,
 round(avg(CASE WHEN list_sum(pred)+list_sum(target)>0 THEN 2e0*(pred[1]*target[1]+pred[2]*target[2]+pred[3]*target[3])/(list_sum(pred)+list_sum(target)) ELSE 0e0 END),9) AS sample_f1,
 round(CASE WHEN sum(list_sum(pred)+list_sum(target))>0 THEN 2e0*sum(pred[1]*target[1]+pred[2]*target[2]+pred[3]*target[3])/sum(list_sum(pred)+list_sum(target)) ELSE 0e0 END,9) AS micro_f1,
 round((""" + "+".join(f"CASE WHEN sum(pred[{i}]+target[{i}])>0 THEN 2e0*sum(pred[{i}]*target[{i}])/sum(pred[{i}]+target[{i}]) ELSE 0e0 END" for i in (1, 2, 3)) + """)/3,9) AS macro_f1 """
_IDX = """WITH x AS (SELECT o_orderkey AS file, o_orderpriority AS "group", 'ratio_' || o_orderstatus AS ratio FROM orders)"""
_KNN = """WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.id, a.label, b.id AS neighbour, b.label AS other, round(list_cosine_similarity(a.v,b.v),9) AS sim FROM e a JOIN e b ON a.id<>b.id),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS place FROM s)
"""
#: Splits of a stratum of n, by largest remainder, for 0.7, 0.15 and 0.15.
_SPLIT = """c AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY md5('42|' || CAST({key} AS VARCHAR)), {key}) AS rk FROM x),
f AS (SELECT *, CAST(floor(n*7e-1+1e-9) AS BIGINT) AS a, CAST(floor(n*15e-2+1e-9) AS BIGINT) AS b FROM c),
l AS (SELECT *, n-a-2*b AS lft, n*7e-1-a AS ra, n*15e-2-b AS rb FROM f),
g AS (SELECT *, a + CASE WHEN (CASE WHEN rb > ra+1e-9 THEN 2 ELSE 0 END) < lft THEN 1 ELSE 0 END AS tr, b + CASE WHEN (CASE WHEN ra >= rb-1e-9 THEN 1 ELSE 0 END) < lft THEN 1 ELSE 0 END AS va FROM l),
h AS (SELECT *, n-tr-va AS te FROM g),
k AS (SELECT *, CASE WHEN n>=3 AND va=0 THEN 1 ELSE 0 END AS dv, CASE WHEN n>=3 AND te=0 THEN 1 ELSE 0 END AS dt FROM h),
z AS (SELECT *, CASE WHEN rk <= tr-dv-dt THEN 'train' WHEN rk <= tr-dt+va THEN 'val' ELSE 'test' END AS split FROM k)"""

ORACLES = {
    "signal_stats": _CAP + "SELECT * FROM st",
    "signal_stats_by_group": _CAP + """, m AS (UNPIVOT (SELECT "group", ratio, mean_db, std_db, p2p_db, max_jump FROM st) ON mean_db, std_db, p2p_db, max_jump INTO NAME metric VALUE v),
  q AS (SELECT 'overall' AS scope, 'all' AS key, * FROM m UNION ALL SELECT 'group', "group", * FROM m UNION ALL SELECT 'ratio', ratio, * FROM m)
  SELECT scope, key, metric, count(*) AS n, round(min(v),6) AS min_value, round(quantile_cont(v,5e-2),6) AS p05, round(quantile_cont(v,5e-1),6) AS median, round(quantile_cont(v,95e-2),6) AS p95, round(max(v),6) AS max_value, round(avg(v),6) AS mean FROM q GROUP BY ALL""",
    "signal_issues": _ISS + "SELECT * FROM iss",
    "issue_counts": _ISS + "SELECT severity, type, count(*) AS n, count(DISTINCT file) AS files FROM iss GROUP BY ALL",
    "length_mismatch": _CAP + ", m AS (SELECT n AS mode FROM st GROUP BY n ORDER BY count(*) DESC, min(file) LIMIT 1) SELECT file, n, mode FROM st, m WHERE n<>mode",
    "recommended_preprocessing": _CAP + "SELECT CAST(floor(quantile_cont(median_db,1e-2)-5) AS BIGINT) AS clip_low, CAST(ceil(quantile_cont(median_db,99e-2)+5) AS BIGINT) AS clip_high, greatest(1, CAST(ceil(quantile_cont(std_db,99e-2)) AS BIGINT)) AS variation_max FROM st",
    "condition_outliers": _CAP + """, m AS (UNPIVOT (SELECT file, "group", condition_path, mean_db, median_db, std_db, p2p_db, diff_p95 FROM st) ON mean_db, median_db, std_db, p2p_db, diff_p95 INTO NAME metric VALUE v),
  c AS (SELECT "group", condition_path, metric, quantile_cont(v,5e-1) AS ce, count(*) AS sz FROM m GROUP BY ALL),
  o AS (SELECT m.*, ce, sz, abs(v-ce) AS off FROM m JOIN c USING ("group", condition_path, metric)),
  a AS (SELECT "group", condition_path, metric, quantile_cont(off,5e-1) AS mad FROM o GROUP BY ALL)
  SELECT file, "group", condition_path, metric, round(6744897501960817e-16*off/mad,6) AS robust_z FROM o JOIN a USING ("group", condition_path, metric) WHERE sz>=8 AND mad>=1e-8 AND 6744897501960817e-16*off/mad >= 35e-1""",
    "duplicates_across_labels": "WITH x AS (SELECT doc_id AS file, source AS \"group\", text AS k FROM documents), t AS (SELECT k, count(*) AS copies, count(DISTINCT \"group\") AS labels FROM x GROUP BY k HAVING count(*)>1 AND count(DISTINCT \"group\")>1) SELECT file, \"group\", copies, labels FROM x JOIN t USING (k)",
    "parse_captures": "SELECT event_type || '/' || user_id AS file, true AS has_data_marker, CAST(2 AS INT) AS data_marker_line, count(*) AS n, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE) ORDER BY ts, event_id),3) AS total, CAST(NULL AS VARCHAR) AS parse_error FROM events GROUP BY event_type, user_id",
    "group_labels": """WITH x AS (SELECT doc_id, CASE WHEN doc_id%11=0 THEN 'unknown_x' WHEN doc_id%3=0 THEN 'source_'||(doc_id%6) ELSE 'source_'||(doc_id%6)||'_source_'||(doc_id%4)||'_mix' END AS "group" FROM documents),
  t AS (SELECT *, regexp_extract_all("group", 'source_\\d+') AS tk FROM x),
  u AS (SELECT *, "group" LIKE 'unknown%' AS unk, len([z FOR z IN tk IF z NOT IN ('source_1','source_3','source_5')])>0 AS bad FROM t)
  SELECT doc_id, "group", CASE WHEN unk THEN '[0,0,0]' WHEN NOT bad THEN '[' || array_to_string([CAST(list_contains(tk,c) AS INT) FOR c IN ['source_1','source_3','source_5']], ',') || ']' END AS label, NOT unk AND bad AS rejected FROM u""",
    "path_parts": "SELECT page_id, CASE WHEN len(string_split(p,'/'))>1 THEN string_split(p,'/')[1] ELSE '(root)' END AS top, 'ratio_' || (page_id % 5) AS ratio FROM (SELECT page_id, regexp_replace(url,'^https?://','') AS p FROM pages)",
    "index_summary": _IDX + """SELECT 1 AS level, "group", '*' AS ratio, count(*) AS n FROM x GROUP BY "group" UNION ALL SELECT 2, '*', ratio, count(*) FROM x GROUP BY ratio UNION ALL SELECT 0, "group", ratio, count(*) FROM x GROUP BY "group", ratio UNION ALL SELECT 3, '*', '*', count(*) FROM x""",
    "stratified_split": _IDX + ", " + _SPLIT.format(by='"group", ratio', key="file") + ' SELECT file, "group", ratio, split FROM z',
    "quota_selection": _IDX + """SELECT file, "group", ratio, row_number() OVER (PARTITION BY "group" ORDER BY md5('42|' || CAST(file AS VARCHAR)), file) <= CASE "group" WHEN '1-URGENT' THEN 100 WHEN '5-LOW' THEN 50 ELSE 80 END AS selected FROM x""",
    "first_per_group": _IDX + """SELECT file, "group", ratio FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY file) AS r FROM x) WHERE r<=7""",
    "combo_weights": "SELECT CAST(quality AS VARCHAR)||CAST(toxic AS VARCHAR) AS combo, count(*) AS n, round(1e0/count(*),9) AS weight FROM labels GROUP BY 1",
    "label_distribution": "WITH x AS (SELECT *, CAST(quality AS VARCHAR)||CAST(toxic AS VARCHAR) AS combo FROM labels), " + _SPLIT.format(by="combo", key="doc_id") + " SELECT split, combo, count(*) AS n FROM z GROUP BY ALL UNION ALL SELECT 'overall', combo, count(*) FROM z GROUP BY combo",
    "decision_flags": _DEC + "SELECT file, array_to_string(pred,'') AS pred, CAST(y-1 AS INT) AS target_index, exact, over, under FROM r",
    "class_metrics": _DEC + """, c AS (SELECT CAST(i-1 AS INT) AS class_id, CAST(sum(CAST(pred[i]=1 AND target[i]=1 AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(pred[i]=1 AND target[i]=0 AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(pred[i]=0 AND target[i]=0 AS INT)) AS BIGINT) AS tn, CAST(sum(CAST(pred[i]=0 AND target[i]=1 AS INT)) AS BIGINT) AS fn FROM r, (SELECT unnest([1,2,3]) AS i) GROUP BY i)
  SELECT *, tp+fn AS support, round(CASE WHEN tp+fp>0 THEN CAST(tp AS DOUBLE)/(tp+fp) ELSE 0e0 END,9) AS precision, round(CASE WHEN tp+fn>0 THEN CAST(tp AS DOUBLE)/(tp+fn) ELSE 0e0 END,9) AS recall, round(CASE WHEN 2*tp+fp+fn>0 THEN 2e0*tp/(2*tp+fp+fn) ELSE 0e0 END,9) AS f1, round(CASE WHEN fp+tn>0 THEN CAST(fp AS DOUBLE)/(fp+tn) ELSE 0e0 END,9) AS fpr, round(CASE WHEN fn+tp>0 THEN CAST(fn AS DOUBLE)/(fn+tp) ELSE 0e0 END,9) AS fnr FROM c""",
    "overall_metrics": _DEC + "SELECT " + _MET + " FROM r",
    "metrics_at_thresholds": _SC + """, p AS (SELECT k.*, t AS threshold, [CAST(CAST(prob[i] AS FLOAT) >= CAST(t AS FLOAT) AS INT) FOR i IN [1,2,3]] AS pred FROM k, (SELECT unnest([3e-1,4e-1,5e-1,6e-1,7e-1]) AS t)),
r AS (SELECT *, pred = target AS exact, pred[1]>target[1] OR pred[2]>target[2] OR pred[3]>target[3] AS over, pred[1]<target[1] OR pred[2]<target[2] OR pred[3]<target[3] AS under FROM p) SELECT threshold, """ + _MET + " FROM r GROUP BY threshold",
    "combo_confusion": _DEC + ", c AS (SELECT array_to_string(target,'') AS true_combo, array_to_string(pred,'') AS pred_combo, count(*) AS n FROM r GROUP BY ALL) SELECT *, round(CAST(n AS DOUBLE)/sum(n) OVER (PARTITION BY true_combo),9) AS rate FROM c",
    "group_accuracy": _DEC + """SELECT g AS "group", count(exact) AS n, round(coalesce(avg(CAST(exact AS INT)),0e0),9) AS accuracy FROM (SELECT CAST(unnest(range(1,9)) AS VARCHAR) AS g) LEFT JOIN r ON r."group"=g GROUP BY g""",
    "threshold_search": _SC + """, t AS (SELECT round(2e-1+i*1e-1,10) AS t FROM range(0,7) u(i)), g AS (SELECT a.t AS t0, b.t AS t1, c.t AS t2 FROM t a, t b, t c),
  p AS (SELECT t0,t1,t2,target,[CAST(CAST(prob[1] AS FLOAT)>=CAST(t0 AS FLOAT) AS INT),CAST(CAST(prob[2] AS FLOAT)>=CAST(t1 AS FLOAT) AS INT),CAST(CAST(prob[3] AS FLOAT)>=CAST(t2 AS FLOAT) AS INT)] AS pred FROM k, g)
  SELECT t0,t1,t2, round(avg(CAST(pred=target AS INT)),9) AS exact_match, round(CASE WHEN sum(list_sum(pred)+list_sum(target))>0 THEN 2e0*sum(pred[1]*target[1]+pred[2]*target[2]+pred[3]*target[3])/sum(list_sum(pred)+list_sum(target)) ELSE 0e0 END,9) AS micro_f1 FROM p GROUP BY ALL""",
    "open_set": _SC + "SELECT file, CASE WHEN list_max(prob)<55e-2 THEN 'unknown' WHEN list_max(prob)<8e-1 THEN 'uncertain' ELSE 'known' END AS status, round(list_max(prob),6) AS top FROM k",
    "presence_status": _SC + ", l AS (SELECT file, CAST(i-1 AS INT) AS class_id, prob[i] AS p FROM k, (SELECT unnest([1,2,3]) AS i)) SELECT file, class_id, round(p,6) AS p, CASE WHEN p>=7e-1 THEN 'present' WHEN p>=4e-1 THEN 'suspected' ELSE 'absent' END AS status, CAST(row_number() OVER (PARTITION BY file ORDER BY p DESC, class_id) AS INT) AS place FROM l",
    "nearest_neighbours": _KNN + "SELECT id, neighbour, CAST(place AS INT) AS place, round(sim,6) AS similarity FROM w WHERE place<=5",
    "neighbour_categories": _KNN + """, c AS (SELECT id, label, avg(CAST(label=other AS INT)) AS own, max(1-sim) AS radius FROM w WHERE place<=10 GROUP BY ALL), q AS (SELECT label, quantile_cont(radius,75e-2) AS h, quantile_cont(radius,25e-2) AS l FROM c GROUP BY label)
  SELECT id, c.label, round(own,6) AS own_fraction, round(radius,6) AS radius, CASE WHEN radius>h+3*(h-l) THEN 'isolated' WHEN own>=8e-1 THEN 'typical' WHEN own>=5e-1 THEN 'boundary' ELSE 'other_dominated' END AS category FROM c JOIN q ON c.label=q.label""",
    "point_statistics": "WITH x AS (SELECT CAST(i-1 AS INT) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1,65) u(i)) SELECT pos, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS std, round(quantile_cont(x,5e-2),6) AS p05, round(quantile_cont(x,95e-2),6) AS p95 FROM x GROUP BY pos",
}

QUERIES |= model_queries.QUERIES | late_queries.QUERIES | index_queries.QUERIES | preparation_queries.QUERIES | report_queries.QUERIES | file_queries.QUERIES
ORACLES |= model_queries.ORACLES | late_queries.ORACLES | index_queries.oracles() | preparation_queries.oracles(_SPLIT)
ORACLES |= file_queries.oracles(_SPLIT)
ORACLES |= report_queries.oracles(ORACLES["recommended_preprocessing"], ORACLES["nearest_neighbours"], ORACLES["folder_evaluation"])
ORACLES["metrics_on_indices"] = ORACLES["metrics_on_indices"].format(metrics=_MET)
ORACLES["ranked_thresholds"] = f"SELECT *, CAST(row_number() OVER (ORDER BY exact_match DESC, t0, t1, t2) AS INT) AS place FROM ({ORACLES['threshold_search']}) ORDER BY place LIMIT 20"
