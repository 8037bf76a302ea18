"""Queries on result rows, reports, features, inventories and certified neighbours over the driver's tables, and the same in DuckDB's SQL."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import waveforms as W
from ..operators import audit, certified, decoding, mixtures, reports, results, templates
from . import index_queries, model_queries, views
from .model_queries import _CAP, _FIXED, _IND, _LOG, _SLOT, LENGTH, NAMES, SEED

SAMPLES = {"train": 400, "val": 50, "test": 50}


def _long(rows, column, *keep, places=6):
    return rows.select(*keep, F.posexplode(column).alias("pos", "x")).select(*keep, "pos", F.round("x", places).alias("x"))


def _result_rows(rows):
    listed = F.array_join("sources", "+")
    each = lambda c: [F.round(F.get(c, F.lit(k)), 6).alias(f"{c[0]}{k}") for k in range(3)]
    return rows.select("file", "mode", F.array_join("labels", "+").alias("labels"), F.array_join("thresholds", ",").alias("thresholds"), "thresholds_apply", F.array_join("combinations", ",").alias("combinations"), F.round(F.array_max("combination_probabilities"), 6).alias("best"), *each("probabilities"), F.round(F.get("percentages", F.lit(0)), 4).alias("percent"), "combination", listed.alias("sources"))


def _structured_results(s, d):
    return _result_rows(results.prediction_results(decoding.structured(model_queries._logits(s, d), 3), NAMES, "structured", [0.5] * 3))


def _multilabel_results(s, d):
    return _result_rows(results.prediction_results(decoding.independent(views.scores(s, d), 3), NAMES, "multilabel", [0.5] * 3))


def _review(s, d):
    x = results.to_review(model_queries._structured(s, d), NAMES)
    return x.select("file", "predicted", F.round("confidence", 6).alias("confidence"), "second", F.round("margin", 6).alias("margin"), F.round("entropy", 6).alias("entropy"))


def _fallback(s, d):
    """Orders as index rows whose label is given as text, blank or missing."""
    k = F.col("o_orderkey")
    bit = lambda m: (k % m == 0).cast("int")
    text = F.concat(F.lit("["), bit(2), F.lit(", "), bit(3), F.lit(",1]"))
    label = F.when(k % 5 == 0, "  ").when(k % 5 == 1, F.lit(None)).otherwise(text)
    classes = [F.when(k % 7 == 0, "").otherwise(bit(4).cast("string")), F.concat(bit(6).cast("string"), F.lit(".0")), F.lit(None).cast("string")]
    x = views.table(s, d, "orders").select(F.col("o_orderstatus").alias("split"), L.label_or_classes(label, classes).alias("label"))
    return x.groupBy("split", L.label_text(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


def _normalized_mixtures(s, d):
    slots, captures = model_queries._slots(s, d), model_queries._captures(s, d)
    made = lambda mode: _long(mixtures.mixed(slots, captures, LENGTH, mode).withColumn("mode", F.lit(mode)), "signal", "sample_id", "mode", places=5)
    return made("zscore").unionByName(made("rms"))


def _levels(s, d):
    """Captures' first three values in coarse steps, so that signals recur; 0 comes with its sign."""
    step = F.transform(F.slice("signal", 1, 3), lambda v: F.rint(v / 15))
    return views.captures(s, d).select("file", "group", step.alias("signal"))


def _duplicate_signals(s, d):
    return results.duplicate_signals(_levels(s, d)).select("file", "group", "copies", "labels")


def _inventory_slots(s, d):
    captures = model_queries._captures(s, d).select("class", "frequency", "file")
    return mixtures.inventory_slots(mixtures.inventory_plan(mixtures.inventory(captures), SAMPLES, NAMES, SEED), captures, NAMES, SEED)


def _classified(s, d):
    p = model_queries._powers(s, d)
    t = np.array([r.template for r in templates.build(p, 1000, SEED).orderBy("class").collect()])  # one row for each class
    x = templates.mixture_features(p, t)
    return templates.combination_model(x, None, SEED).transform(x).select("file", "y", "prediction", F.round(F.array_max("class_prob"), 5).alias("p"))


def _channels(s, d):
    m = W.stft(F.col("signal"), 8, 4, 5, 3, "absolute", "absolute_relative", "double")
    x = views.captures(s, d).select("file", m.alias("c")).select("file", F.posexplode("c").alias("channel", "m"))
    return _long(x, "m", "file", "channel", places=5)


def _trace_channels(s, d):
    x = views.captures(s, d).select("file", W.db_trace_channels(F.col("signal"), 8, 4, 5, 3, kind="double").alias("c")).select("file", F.posexplode("c").alias("channel", "m"))
    return _long(x, "m", "file", "channel", places=5)


QUERIES = {
    "structured_results": _structured_results,
    "multilabel_results": _multilabel_results,
    "to_review": _review,
    "folder_report": lambda s, d: reports.folder_report(index_queries._folder_rows(s, d), index_queries.CLASSES),
    "label_fallback": _fallback,
    "recommended_settings": lambda s, d: results.recommended_settings(audit.signal_stats(views.captures(s, d))),
    "normalized_mixtures": _normalized_mixtures,
    "duplicate_signals": _duplicate_signals,
    "inventory_slots": _inventory_slots,
    "template_classifier": _classified,
    "certified_neighbours": lambda s, d: certified.certified(model_queries._vectors(s, d), 5).select("id", "neighbour", "place", F.round("similarity", 6).alias("similarity")),
    "group_quantiles": lambda s, d: results.group_quantiles(audit.signal_stats(views.captures(s, d)), ["group"], "mean_db", [0.1, 0.5, 0.9]).select("group", "share", F.round("value", 6).alias("value")),
    "head_signals": lambda s, d: _long(views.captures(s, d), W.head(F.col("signal"), LENGTH), "file"),
    "resampled_signals": lambda s, d: _long(views.captures(s, d).select("file", W.resample(F.col("signal"), 20).alias("r")), "r", "file"),
    "audit_features": lambda s, d: _long(views.captures(s, d).select("file", W.audit_feature(F.col("signal"), "double").alias("f")), "f", "file", places=4).withColumn("x", F.col("x") + 0.0),  # no -0.0
    "shape_features": lambda s, d: _long(views.captures(s, d).select("file", W.shape_feature(F.col("signal"), kind="double").alias("f")), "f", "file", places=5),
    "stft_channels": _channels,
    "db_trace_spectra": _trace_channels,
}

_RESULT = """SELECT file, '{mode}' AS mode, 's1+s3+s5' AS labels, '0.5,0.5,0.5' AS thresholds, {apply} AS thresholds_apply, '{combos}' AS combinations, {best} AS best, round(prob[1],6) AS p0, round(prob[2],6) AS p1, round(prob[3],6) AS p2,
 round(100*prob[1],4) AS percent, right(format('{{:03b}}', {w}), 3) AS combination, array_to_string(list_filter(['s1','s3','s5'], lambda n, i: (({w}) >> (3-i)) & 1 = 1), '+') AS sources FROM dg"""
_NAMED = "array_to_string(list_filter(['s1','s3','s5'], lambda n, i: ({0} >> (3-i)) & 1 = 1), '+')"
#: Places and values of a capture: n, and a list of its values in order.
_LIST = _CAP + ", ls AS (SELECT file, frequency AS \"group\", list(x ORDER BY i) AS v, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL)"
_AT = "v[CAST(floor({at}) AS BIGINT)+1] + CASE WHEN n>1 THEN (v[CAST(least(floor({at})+1,n-1) AS BIGINT)+1]-v[CAST(floor({at}) AS BIGINT)+1])*({at}-floor({at})) ELSE 0 END"
_STFT = """, sg AS (SELECT file, n, v, {centre} AS c, least(8,n) AS g, least(8,n)-least(4,least(8,n)-1) AS h FROM ls),
wf AS (SELECT file, g, fr, m, (v[fr*h+m+1]-c)*w AS x, sum(w) OVER (PARTITION BY file, fr) AS ws FROM sg, LATERAL (SELECT unnest(range(0,(n-g)//h+1)) AS fr), LATERAL (SELECT unnest(range(0,g)) AS m), LATERAL (SELECT CASE WHEN g=1 THEN 1e0 ELSE 5e-1-5e-1*cos(2*pi()*m/g) END AS w)),
wk AS (SELECT file, fr, k, sqrt(power(sum(x*cos(2*pi()*k*m/g)),2)+power(sum(x*sin(2*pi()*k*m/g)),2))/max(ws) AS a FROM wf, (SELECT unnest(range(0,5)) AS k) WHERE k <= g//2 AND fr < 3 GROUP BY ALL),
bx AS (SELECT f.file, r.k*3+c.fr AS pos, coalesce(wk.a,0e0) AS a FROM (SELECT file FROM ls) f CROSS JOIN (SELECT unnest(range(0,5)) AS k) r CROSS JOIN (SELECT unnest(range(0,3)) AS fr) c LEFT JOIN wk ON wk.file=f.file AND wk.k=r.k AND wk.fr=c.fr),
rl AS (SELECT *, ln(1+a/greatest(sqrt(avg(a*a) OVER (PARTITION BY file)),1e-12)) AS r FROM bx)
"""


def oracles(recommended: str, nearest: str, folder: str) -> dict[str, str]:
    spectrum = "ln(1+sqrt(power(sum({x}*cos(2*pi()*k*i/{n})),2)+power(sum({x}*sin(2*pi()*k*i/{n})),2)))"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS key, CAST(sum(CAST(pred[{i}]=1 AND target[{i}]=1 AS INT)) AS DOUBLE) AS tp, sum(pred[{i}]) AS p, sum(target[{i}]) AS t FROM g" for i, c in enumerate(index_queries.CLASSES, 1))
    return {
        "structured_results": _LOG + _RESULT.format(mode="structured", apply="false", combos="001,010,011,100,101,110,111", best="round(confidence,6)", w="w"),
        "multilabel_results": _IND.rstrip(",\n") + " " + _RESULT.format(mode="multilabel", apply="true", combos="", best="CAST(NULL AS DOUBLE)", w="w-1"),
        "to_review": _LOG + f"SELECT file, {_NAMED.format('w')} AS predicted, round(confidence,6) AS confidence, {_NAMED.format('w2')} AS second, round(confidence-sc2,6) AS margin, round(entropy,6) AS entropy FROM dg WHERE confidence < 6e-1",
        "folder_report": folder + f" UNION ALL SELECT m, key, CAST(t AS BIGINT), round(CASE m WHEN 'precision' THEN CASE WHEN p>0 THEN tp/p ELSE 0 END WHEN 'recall' THEN CASE WHEN t>0 THEN tp/t ELSE 0 END ELSE CASE WHEN p+t>0 THEN 2*tp/(p+t) ELSE 0 END END,9) FROM ({rows}) z, (SELECT unnest(['precision','recall','f1']) AS m)",
        "label_fallback": """WITH x AS (SELECT o_orderstatus AS split, CASE WHEN o_orderkey%5 IN (0,1) THEN '[' || CASE WHEN o_orderkey%7<>0 AND o_orderkey%4=0 THEN 1 ELSE 0 END || ',' || CASE WHEN o_orderkey%6=0 THEN 1 ELSE 0 END || ',0]'
  ELSE '[' || CASE WHEN o_orderkey%2=0 THEN 1 ELSE 0 END || ',' || CASE WHEN o_orderkey%3=0 THEN 1 ELSE 0 END || ',1]' END AS label FROM orders) SELECT split, label, count(*) AS n FROM x GROUP BY ALL""",
        "recommended_settings": recommended.replace("SELECT CAST(floor(", "SELECT (SELECT n FROM st GROUP BY n ORDER BY count(*) DESC, min(file) LIMIT 1) AS signal_length, CAST(floor("),
        "normalized_mixtures": _SLOT + _FIXED.format(pad="0e0") + """, mx AS (SELECT sample_id, CAST((pos+shift)%12 AS INT) AS pos, sum(z*gain*polarity) AS x FROM s2 JOIN z USING (file) GROUP BY ALL),
  mm AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd, sqrt(avg(x*x) OVER w) AS r FROM mx WINDOW w AS (PARTITION BY sample_id))
  SELECT sample_id, mode, pos, round(CASE mode WHEN 'zscore' THEN (x-m)/CASE WHEN sd<1e-8 THEN 1 ELSE sd END ELSE x/CASE WHEN r<1e-8 THEN 1 ELSE r END END,5) AS x FROM mm, (SELECT unnest(['zscore','rms']) AS mode)""",
        "duplicate_signals": _LIST + """, q AS (SELECT file, "group", [round_even(x/15,0) FOR x IN v[1:3]] AS s FROM ls), t AS (SELECT s, count(*) AS copies, count(DISTINCT "group") AS labels FROM q GROUP BY s HAVING count(*)>1 AND count(DISTINCT "group")>1)
  SELECT file, "group", copies, labels FROM q JOIN t USING (s)""",
        "inventory_slots": _CAP + f""", fl AS (SELECT ['s1','s3','s5'][user_id%3+1] AS class, frequency, file FROM v WHERE i=0), iv AS (SELECT class, frequency, count(*) AS files FROM fl GROUP BY ALL),
  sp AS (SELECT unnest({list(SAMPLES)}) AS split, unnest({list(SAMPLES.values())}) AS n, unnest({[sum(list(SAMPLES.values())[:k]) for k in range(3)]}) AS first),
  ix AS (SELECT split, first, unnest(range(0,n)) AS id FROM sp), pl AS (SELECT split, first + row_number() OVER (PARTITION BY split ORDER BY md5('42|' || split || '|' || id), split || '|' || id) - 1 AS sample_id, id % 7 + 1 AS label FROM ix),
  s0 AS (SELECT sample_id, split, CAST(k AS INT) AS k, ['s1','s3','s5'][k+1] AS class, sample_id || '|' || k AS key FROM pl, (SELECT unnest(range(0,3)) AS k) WHERE (label >> (2-k)) & 1 = 1),
  s1 AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || key), key) - 1 AS slot, count(*) OVER (PARTITION BY class) AS slots FROM s0),
  q0 AS (SELECT iv.*, slots, sum(files) OVER (PARTITION BY class) AS total FROM iv JOIN (SELECT DISTINCT class, slots FROM s1) USING (class)), q1 AS (SELECT *, slots*files//total AS fl, slots*files%total AS rest FROM q0),
  q2 AS (SELECT *, fl + CASE WHEN row_number() OVER (PARTITION BY class ORDER BY rest DESC, frequency) <= slots - sum(fl) OVER (PARTITION BY class) THEN 1 ELSE 0 END AS quota FROM q1),
  q3 AS (SELECT *, sum(quota) OVER (PARTITION BY class ORDER BY frequency) - quota AS before FROM q2),
  fo AS (SELECT *, row_number() OVER (PARTITION BY class, frequency ORDER BY md5('42|' || file), file) - 1 AS ordinal FROM fl)
  SELECT sample_id, split, k, class, frequency, file FROM s1 JOIN q3 USING (class) JOIN fo USING (class, frequency) WHERE slot >= before AND slot < before + quota AND ordinal = (slot-before) % files""",
        "certified_neighbours": nearest,
        "group_quantiles": recommended[: recommended.rindex("SELECT CAST(floor(")] + 'SELECT "group", share, round(CASE share WHEN 1e-1 THEN a WHEN 5e-1 THEN b ELSE c END,6) AS value FROM (SELECT "group", quantile_cont(mean_db,1e-1) AS a, quantile_cont(mean_db,5e-1) AS b, quantile_cont(mean_db,9e-1) AS c FROM st GROUP BY 1), (SELECT unnest([1e-1,5e-1,9e-1]) AS share)',
        "head_signals": _LIST + ", md AS (SELECT file, median(x) AS med FROM v GROUP BY file) SELECT file, CAST(p AS INT) AS pos, round(coalesce(v[p+1],med),6) AS x FROM ls JOIN md USING (file), (SELECT unnest(range(0,12)) AS p)",
        "resampled_signals": _LIST + f", g AS (SELECT *, (n-1)*CAST(p AS DOUBLE)/19 AS u FROM ls, (SELECT unnest(range(0,20)) AS p)) SELECT file, CAST(p AS INT) AS pos, round({_AT.format(at='u')},6) AS x FROM g",
        "audit_features": _LIST + f""", g AS (SELECT *, (n-1)*CAST(p AS DOUBLE)/255 AS u FROM ls, (SELECT unnest(range(0,256)) AS p)), y AS (SELECT file, p AS i, {_AT.format(at='u')} AS x FROM g),
  st AS (SELECT file, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, quantile_cont(x,5e-2) AS a, quantile_cont(x,5e-1) AS b, quantile_cont(x,95e-2) AS c FROM y GROUP BY file),
  sp AS (SELECT file, k, {spectrum.format(x='(x-m)', n=256)} AS l FROM y JOIN st USING (file), (SELECT unnest(range(0,129)) AS k) GROUP BY ALL), sl AS (SELECT file, list(l ORDER BY k) AS v, 129 AS n FROM sp GROUP BY file),
  sr AS (SELECT *, 128*CAST(p AS DOUBLE)/95 AS u FROM sl, (SELECT unnest(range(0,96)) AS p)),
  o AS (SELECT file, i AS pos, x FROM y UNION ALL SELECT file, 256+i, (x-m)/greatest(hi-lo,1e-6) FROM y JOIN st USING (file) UNION ALL SELECT file, 512+p, {_AT.format(at='u')} FROM sr UNION ALL SELECT file, 608+j, [m,sd,lo,hi,hi-lo,a,b,c][j+1] FROM st, (SELECT unnest(range(0,8)) AS j))
  SELECT file, CAST(pos AS INT) AS pos, round(x,4)+0e0 AS x FROM o""",
        "shape_features": _LIST + f""", st AS (SELECT file, avg(x) AS m, stddev_pop(x) AS sd FROM v GROUP BY file), y AS (SELECT v.file, v.i, v.n, (x-m)/CASE WHEN sd>=1e-12 THEN sd ELSE 1 END AS x FROM v JOIN st USING (file)),
  b AS (SELECT ls.file, p, n*p//128 AS lo, n*(p+1)//128 AS hi FROM ls, (SELECT unnest(range(0,128)) AS p)), bm AS (SELECT b.file, p, coalesce(avg(x),0e0) AS a FROM b LEFT JOIN y ON y.file=b.file AND y.i>=lo AND y.i<hi GROUP BY ALL),
  ym AS (SELECT file, avg(x) AS m FROM y GROUP BY file), sp AS (SELECT y.file, k, {spectrum.format(x='(x-m)', n='n')} AS a FROM y JOIN ym USING (file), (SELECT unnest(range(0,128)) AS k) WHERE k <= n//2 GROUP BY ALL),
  u AS (SELECT file, p AS pos, a/(sqrt(sum(a*a) OVER (PARTITION BY file))+1e-12) AS x FROM bm UNION ALL SELECT file, 128+k, a/(sqrt(sum(a*a) OVER (PARTITION BY file))+1e-12) FROM sp) SELECT file, CAST(pos AS INT) AS pos, round(x,5) AS x FROM u""",
        "stft_channels": _LIST + _STFT.format(centre="0e0") + "SELECT file, CAST(ch AS INT) AS channel, CAST(pos AS INT) AS pos, round(CASE ch WHEN 0 THEN a ELSE r END,5) AS x FROM rl, (SELECT unnest([0,1]) AS ch)",
        "db_trace_spectra": _LIST + _STFT.format(centre="list_aggregate(v,'median')") + """, cs AS (SELECT file, median(x) AS md, stddev_pop(x) AS sd FROM v GROUP BY file)
  SELECT file, CAST(ch AS INT) AS channel, CAST(pos AS INT) AS pos, round(CASE ch WHEN 0 THEN a WHEN 1 THEN r WHEN 2 THEN least(greatest((md+110)/60,0e0),1e0) ELSE least(sd/15,1e0) END,5) AS x FROM rl JOIN cs USING (file), (SELECT unnest([0,1,2,3]) AS ch)""",
    }
