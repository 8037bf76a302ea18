"""Queries on decoding, reports, waveforms, redundancy, mixtures and templates over the driver's tables, and the same in DuckDB's SQL."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import waveforms as W
from ..functions.labels import combo
from ..operators import decoding, mixtures, neighbors, redundancy, templates
from . import views

NAMES = ["s1", "s3", "s5"]
LENGTH, SEED = 12, 42


def _logits(s, d):
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: 8 * v.cast("double"))
    e = views.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("file"), F.col("label"), F.concat(F.lit("g"), F.col("label") % 3).alias("folder"), part(1, 3).alias("labels"), part(4, 7).alias("combos"), part(11, 3).alias("counts"), part(14, 7).alias("other"))


def _structured(s, d):
    return decoding.diagnosed(decoding.structured(_logits(s, d), 3), 3, empty=False)


def _shown(rows):
    return rows.select("file", combo(F.col("pred")).alias("pred"), combo(F.col("second")).alias("second"), "status", *(F.round(c, 6).alias(c) for c in ("confidence", "second_confidence", "margin", "entropy")), *(F.round(F.col("prob")[k], 6).alias(f"p{k}") for k in range(3)))


def _unknown(s, d):
    x = decoding.independent(views.scores(s, d), 3, 0.6)
    return x.where(F.col("group").cast("int") <= 2)


def _blend(s, d):
    x = decoding.structured(_logits(s, d), 3)
    return decoding.blend_search(x.select(F.col("combo_prob").alias("a"), decoding.softmax(F.col("other")).alias("b"), (F.col("label") % 7).alias("y")), 0.25)


def _label_rows(s, d):
    return views.table(s, d, "labels").select("doc_id", F.array(F.col("quality").cast("int"), F.col("toxic").cast("int")).alias("label"))


def _vectors(s, d):
    return views.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _spectral(s, d):
    x = views.captures(s, d).select("file", W.spectral_stats(F.col("signal"), 1000.0, 8, 4).alias("s"))
    return x.select("file", *(F.round(F.col("s")[k], 4).alias(k) for k in W.STATS))


def _normalized(s, d):
    x = views.captures(s, d).select("file", F.posexplode(W.standardized(W.fix_trace(F.col("signal"), LENGTH))).alias("pos", "x"))
    return x.select("file", "pos", F.round("x", 6).alias("x"))


def _dimensions(s, d):
    v = _vectors(s, d)
    width = v.agg(F.max(F.size("v"))).first()[0] or 0
    got = redundancy.dimensions(v, width)
    return s.createDataFrame([tuple(got)], "pca_dim_90 int, pca_dim_95 int, pca_dim_99 int")


def _robust(s, d):
    x = redundancy.robust_columns(_vectors(s, d)).select("id", F.posexplode("z").alias("pos", "z"))
    return x.select("id", "pos", F.round("z", 5).alias("z"))


def _plan(s, d):
    return mixtures.plan(s, views.table(s, d, "embeddings").count(), NAMES, SEED)


def _captures(s, d):
    """Captures by class (user modulo 3) and frequency (event type)."""
    user = F.element_at(F.split("file", "/"), -1).cast("int")
    return views.captures(s, d).select(F.get(F.array(*map(F.lit, NAMES)), user % 3).alias("class"), F.col("group").alias("frequency"), "file", "signal")


def _slots(s, d):
    return mixtures.slots(_plan(s, d), _captures(s, d), NAMES, SEED, LENGTH, flip=True)


def _mixtures(s, d):
    x = mixtures.mixed(_slots(s, d), _captures(s, d), LENGTH)
    return x.select("sample_id", F.size("sources").alias("sources"), F.posexplode("signal").alias("pos", "x")).select("sample_id", "sources", "pos", F.round("x", 6).alias("x"))


def _powers(s, d):
    e = views.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("file"), F.concat(F.lit("c"), F.col("label") % 3).alias("class"), (F.col("label") % 3).alias("y"), templates.power_spectrum(F.col("embedding"), 16, 4).alias("power"))


def _templates(s, d):
    x = templates.build(_powers(s, d), 1000, SEED).select("class", F.posexplode("template").alias("bin", "p"))
    return x.select("class", "bin", F.round("p", 9).alias("p"))


def _features(s, d):
    p = _powers(s, d)
    t = np.array([r.template for r in templates.build(p, 1000, SEED).orderBy("class").collect()])  # one row for each class
    return templates.mixture_features(p, t).select("file", F.posexplode("features").alias("pos", "x")).select("file", "pos", F.round("x", 6).alias("x"))


def _rounded(df, *keep):
    return df.select(*(c if c in keep else F.round(c, 6).alias(c) for c in df.columns))


QUERIES = {
    "structured_decoding": lambda s, d: _shown(_structured(s, d)),
    "independent_decoding": lambda s, d: _shown(decoding.diagnosed(decoding.independent(views.scores(s, d), 3), 3, empty=True)),
    "combination_report": lambda s, d: decoding.combination_report(_structured(s, d), NAMES),
    "class_report": lambda s, d: decoding.class_report(_structured(s, d)),
    "confidence_report": lambda s, d: decoding.confidence_report(_structured(s, d)),
    "unknown_rejection": lambda s, d: decoding.unknown_rejection(_unknown(s, d)),
    "false_accepts": lambda s, d: decoding.false_accepts(_unknown(s, d)),
    "blend_search": _blend,
    "source_weights": lambda s, d: decoding.source_weights(_label_rows(s, d), "doc_id", 2),
    "positive_weights": lambda s, d: decoding.positive_weights(_label_rows(s, d)),
    "spectral_stats": _spectral,
    "normalized_signals": _normalized,
    "pair_metrics": lambda s, d: redundancy.pair_summary(_vectors(s, d), SEED, 20000),
    "population_variation": lambda s, d: redundancy.population(neighbors.point_statistics(_vectors(s, d))),
    "pca_dimensions": _dimensions,
    "coverage_curve": lambda s, d: redundancy.coverage(_vectors(s, d), SEED),
    "distribution_saturation": lambda s, d: redundancy.saturation(_vectors(s, d), SEED),
    "robust_columns": _robust,
    "mixture_plan": lambda s, d: _plan(s, d).select("sample_id", combo(F.col("label")).alias("label"), "split"),
    "mixture_slots": lambda s, d: _rounded(_slots(s, d), "sample_id", "k", "class", "frequency", "file", "shift"),
    "mixtures": _mixtures,
    "spectral_templates": _templates,
    "template_features": _features,
}

_BITS = [[j >> 2 & 1, j >> 1 & 1, j & 1] for j in range(8)]


def _score(j):
    label = "+".join(f"-ln(1+exp({'-' if b else ''}l[{k + 1}]))" for k, b in enumerate(_BITS[j]))
    return f"c[{j}]-zc+3e-1*({label})/3+2e-1*(n[{sum(_BITS[j])}]-zn)"


_LSE = "ln(list_sum([exp(v) FOR v IN {0}]))"
_LOG = f"""WITH e AS (SELECT vec_id AS file, label, 'g' || (label % 3) AS folder, [8*CAST(v AS DOUBLE) FOR v IN embedding] AS x FROM embeddings),
l0 AS (SELECT file, label, folder, x[1:3] AS l, x[4:10] AS c, x[11:13] AS n, x[14:20] AS o FROM e),
l1 AS (SELECT *, {_LSE.format("c")} AS zc, {_LSE.format("n")} AS zn FROM l0),
l2 AS (SELECT *, [{", ".join(map(_score, range(1, 8)))}] AS sc FROM l1),
st AS (SELECT file, label, folder, o, [exp(v)/list_sum([exp(u) FOR u IN sc]) FOR v IN sc] AS cp FROM l2),
sb AS (SELECT *, [cp[4]+cp[5]+cp[6]+cp[7], cp[2]+cp[3]+cp[6]+cp[7], cp[1]+cp[3]+cp[5]+cp[7]] AS prob, list_position(cp, list_max(cp)) AS w FROM st),
dg AS (SELECT *, cp[w] AS confidence, list_sort(cp,'DESC')[2] AS sc2, list_position(cp, list_sort(cp,'DESC')[2]) AS w2, -list_sum([v*ln(v) FOR v IN cp])/ln(7e0) AS entropy FROM sb)
"""
_SHOW = "SELECT file, right(format('{{:03b}}', {0}), 3) AS pred, right(format('{{:03b}}', {1}), 3) AS second, CASE WHEN confidence < 6e-1 THEN 'low_confidence' ELSE 'accepted' END AS status, round(confidence,6) AS confidence, round(sc2,6) AS second_confidence, round(confidence-sc2,6) AS margin, round(entropy,6) AS entropy, round(prob[1],6) AS p0, round(prob[2],6) AS p1, round(prob[3],6) AS p2 FROM dg"
_IND = f"""WITH s AS (SELECT vec_id AS file, label % 7 + 1 AS g, [1/(1+exp(-8*CAST(embedding[i] AS DOUBLE))) FOR i IN [1,2,3]] AS prob FROM embeddings),
j AS (SELECT *, [{", ".join("*".join((f"greatest(least(prob[{k + 1}],1-1e-7),1e-7)" if b else f"greatest(1-prob[{k + 1}],1e-7)") for k, b in enumerate(bits)) for bits in _BITS)}] AS q FROM s),
m AS (SELECT *, [v/list_sum(q) FOR v IN q] AS cp FROM j),
dw AS (SELECT *, CAST(CAST(prob[1] AS FLOAT)>=CAST(0.5 AS FLOAT) AS INT)*4+CAST(CAST(prob[2] AS FLOAT)>=CAST(0.5 AS FLOAT) AS INT)*2+CAST(CAST(prob[3] AS FLOAT)>=CAST(0.5 AS FLOAT) AS INT)+1 AS w FROM m),
dg AS (SELECT *, cp[w] AS confidence, list_sort(cp,'DESC')[2] AS sc2, list_position(cp, list_sort(cp,'DESC')[2]) AS w2, -list_sum([v*ln(v) FOR v IN cp])/ln(8e0) AS entropy FROM dw),
"""
_COMBO = f"""nm AS (SELECT unnest({["+".join(n for n, b in zip(NAMES, bits, strict=True) if b) for bits in _BITS[1:]]}) AS combination, unnest(range(1,8)) AS w),
k AS (SELECT 'folder' AS scope, folder, w FROM dg UNION ALL SELECT 'overall', NULL, w FROM dg), t AS (SELECT scope, folder, count(*) AS n FROM k GROUP BY ALL),
c AS (SELECT scope, folder, w, count(*) AS n FROM k GROUP BY ALL)
SELECT t.scope, t.folder, combination, coalesce(c.n,0) AS n, round(CAST(coalesce(c.n,0) AS DOUBLE)/t.n,9) AS rate FROM t CROSS JOIN nm LEFT JOIN c ON c.scope=t.scope AND c.folder IS NOT DISTINCT FROM t.folder AND c.w=nm.w"""


def _five(c):
    q = ", ".join(f"round(quantile_cont({c[0]},{p}),6) AS {c[1]}_{n}" for p, n in (("5e-2", "p05"), ("5e-1", "median"), ("95e-2", "p95")))
    return f"round(min({c[0]}),6) AS {c[1]}_min, {q}, round(max({c[0]}),6) AS {c[1]}_max, round(avg({c[0]}),6) AS {c[1]}_mean"


_CONF = f"""SELECT count(*) AS n, count(*) FILTER (confidence < 6e-1) AS low_confidence, {", ".join(map(_five, (("confidence", "confidence"), ("confidence-sc2", "margin"), ("entropy", "entropy"))))},
 false AS warn_failures, count(*) FILTER (confidence < 6e-1) >= 1e-1*count(*) AS warn_low_confidence, (SELECT max(c) FROM (SELECT count(*) AS c FROM dg GROUP BY w)) >= 8e-1*count(*) AS warn_dominant FROM dg"""
_CAP = "WITH v AS (SELECT event_type || '/' || user_id AS file, event_type AS frequency, user_id, CAST(CAST(-value/5 AS FLOAT) AS DOUBLE) AS x, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events)"
_FFT = _CAP + """, fk AS (SELECT file, n, k, sum(x*cos(2*pi()*k*i/n)) AS re, sum(x*sin(2*pi()*k*i/n)) AS im FROM v, (SELECT unnest(range(0,1000)) AS k) WHERE k <= n//2 GROUP BY ALL),
fa AS (SELECT file, k, k*1e3/n AS f, sqrt(re*re+im*im) AS a FROM fk), fp AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(a,9) DESC, k) AS r FROM fa),
fc AS (SELECT file, sum(a*a) AS fft_energy, max(CASE WHEN r=1 THEN f END) AS peak_freq, max(CASE WHEN r=1 THEN a END) AS peak_amp, sum(f*a)/sum(a) AS centroid FROM fp GROUP BY file),
fb AS (SELECT file, sqrt(sum((f-centroid)*(f-centroid)*a)/sum(a)) AS bandwidth FROM fa JOIN fc USING (file) GROUP BY file),
sg AS (SELECT file, n, least(8,n) AS g, least(8,n)-least(4,least(8,n)-1) AS h FROM v WHERE i=0),
wf AS (SELECT sg.file, g, fr, m, x*w AS x, sum(w) OVER (PARTITION BY sg.file, fr) AS ws FROM sg, LATERAL (SELECT unnest(range(0,(n-g)//h+1)) AS fr), LATERAL (SELECT unnest(range(0,g)) AS m), LATERAL (SELECT CASE WHEN g=1 THEN 1e0 ELSE 5e-1-5e-1*cos(2*pi()*m/g) END AS w) JOIN v ON v.file=sg.file AND v.i=fr*h+m),
wk AS (SELECT file, fr, k, sqrt(power(sum(x*cos(2*pi()*k*m/g)),2)+power(sum(x*sin(2*pi()*k*m/g)),2))/max(ws) AS a FROM wf, (SELECT unnest(range(0,5)) AS k) WHERE k <= g//2 GROUP BY ALL),
ws AS (SELECT file, avg(a) AS stft_mean, stddev_pop(a) AS stft_std, max(a) AS stft_max, sum(a*a) AS stft_energy FROM wk GROUP BY file),
sv AS (SELECT file, avg(x) AS mean, stddev_pop(x) AS std, sqrt(avg(x*x)) AS rms, max(abs(x)) AS peak, max(x)-min(x) AS p2p, sum(x*x) AS energy FROM v GROUP BY file)
SELECT file, """ + ", ".join(f"round({k},4) AS {k}" for k in W.STATS) + " FROM sv JOIN fc USING (file) JOIN fb USING (file) JOIN ws USING (file)"
#: A capture cut to its middle, or padded with {pad}, and standardized: (file, pos, z).
_FIXED = """, md AS (SELECT file, frequency, user_id, n, median(x) AS med FROM v GROUP BY ALL), fx AS (SELECT md.file, md.frequency, md.user_id, p AS pos, coalesce(x, {pad}) AS x FROM md CROSS JOIN (SELECT unnest(range(0,12)) AS p) LEFT JOIN v ON v.file=md.file AND v.i = p + CASE WHEN md.n>12 THEN (md.n-12)//2 ELSE 0 END),
ms AS (SELECT file, avg(x) AS m, stddev_pop(x) AS sd FROM fx GROUP BY file), z AS (SELECT fx.file, frequency, user_id, pos, (x-m)/CASE WHEN sd<1e-8 THEN 1 ELSE sd END AS z FROM fx JOIN ms USING (file))
"""
_DRAW = "CAST('0x' || substr(md5('42|{0}|' || {1}),1,8) AS BIGINT)"
_PLAN = """pl AS (SELECT row_number() OVER (ORDER BY md5('42|' || i), i) - 1 AS sample_id, i % 7 + 1 AS label, (SELECT count(*) FROM embeddings) AS n FROM (SELECT unnest(range(0,(SELECT count(*) FROM embeddings))) AS i)),
sp AS (SELECT *, CASE WHEN sample_id < floor(n*8e-1) THEN 'train' WHEN sample_id < floor(n*8e-1)+floor(n*1e-1) THEN 'val' ELSE 'test' END AS split FROM pl)"""
_SLOT = _CAP + ", " + _PLAN + f""", fl AS (SELECT ['s1','s3','s5'][user_id%3+1] AS class, frequency, file FROM v WHERE i=0),
fo AS (SELECT *, row_number() OVER (PARTITION BY class, frequency ORDER BY file)-1 AS ordinal, count(*) OVER (PARTITION BY class, frequency) AS files, dense_rank() OVER (PARTITION BY class ORDER BY frequency)-1 AS f FROM fl),
fq AS (SELECT class, count(DISTINCT frequency) AS fs FROM fl GROUP BY class),
s0 AS (SELECT sample_id, CAST(k AS INT) AS k, ['s1','s3','s5'][k+1] AS class, sample_id || '|' || k AS key FROM pl, (SELECT unnest(range(0,3)) AS k) WHERE (label >> (2-k)) & 1 = 1),
s1 AS (SELECT s0.*, {_DRAW.format("frequency", "key")} % fs AS f FROM s0 JOIN fq USING (class)),
s2 AS (SELECT sample_id, k, s1.class, frequency, file, 8e-1+{_DRAW.format("gain", "key")}/4294967296e0*(12e-1-8e-1) AS gain, CASE WHEN {_DRAW.format("flip", "key")} < 2147483648 THEN -1e0 ELSE 1e0 END AS polarity, {_DRAW.format("shift", "key")} % 12 AS shift FROM s1 JOIN fo ON fo.class=s1.class AND fo.f=s1.f AND fo.ordinal = {_DRAW.format("file", "key")} % files)
"""
_VEC = "WITH e AS (SELECT vec_id AS id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS v FROM embeddings), c AS (SELECT count(*) AS n FROM e), o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS place FROM e)"
_PT = "x AS (SELECT id, i-1 AS pos, v[i] AS x FROM e, (SELECT unnest(range(1,65)) AS i))"
_SAT = _VEC + ", " + _PT + """, f AS (SELECT pos, avg(x) AS fm, stddev_pop(x) AS fs FROM x GROUP BY pos), sc AS (SELECT greatest((SELECT max(fm)-min(fm) FROM f),(SELECT median(list_max(v)-list_min(v)) FROM e),1e-12) AS s),
r AS (SELECT id, rp, row_number() OVER (PARTITION BY rp ORDER BY md5('42|' || rp || '|' || id), id) AS k FROM e, (SELECT unnest(range(0,5)) AS rp)),
w AS (SELECT rp, size, pos, avg(x) AS m, stddev_pop(x) AS sd FROM r JOIN (SELECT unnest([100,200,500,1000,1500,2000]) AS size) ON k<=size JOIN x USING (id), c WHERE size < c.n GROUP BY ALL),
er AS (SELECT rp, size, sqrt(avg((m-fm)*(m-fm))) AS a, avg(abs(sd-fs)) AS b FROM w JOIN f USING (pos) GROUP BY ALL),
dm AS (SELECT id, pos, x-avg(x) OVER (PARTITION BY id) AS x FROM x), sx AS (SELECT id, k, ln(1+sqrt(power(sum(x*cos(2*pi()*k*pos/64)),2)+power(sum(x*sin(2*pi()*k*pos/64)),2))) AS l FROM dm, (SELECT unnest(range(0,33)) AS k) GROUP BY ALL),
fl AS (SELECT k, avg(l) AS m FROM sx GROUP BY k), ln AS (SELECT greatest(sqrt(sum(m*m)),1e-12) AS len FROM fl),
su AS (SELECT rp, size, sx.k, avg(l) AS l FROM r JOIN (SELECT unnest([100,200,500,1000,1500,2000]) AS size) ON r.k<=size JOIN sx USING (id), c WHERE size < c.n GROUP BY ALL),
se AS (SELECT rp, size, sqrt(sum((l-m)*(l-m))) AS q FROM su JOIN fl USING (k) GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS size, round(avg(a/s),6) AS mean_wave_nrmse, round(avg(b/s),6) AS point_std_error, round(avg(q/len),6) AS spectrum_relative_error FROM er JOIN se USING (rp, size), sc, ln GROUP BY size"""

ORACLES = {
    "structured_decoding": _LOG + _SHOW.format("w", "w2"),
    "independent_decoding": _IND.rstrip(",\n") + " " + _SHOW.format("w-1", "w2-1"),
    "combination_report": _LOG + ", " + _COMBO,
    "class_report": _LOG + "SELECT CAST(i-1 AS INT) AS class_id, CAST(sum((w >> (3-i)) & 1) AS BIGINT) AS present, round(avg((w >> (3-i)) & 1),9) AS present_rate, round(avg(prob[i]),6) AS mean_prob FROM dg, (SELECT unnest([1,2,3]) AS i) GROUP BY i",
    "confidence_report": _LOG + _CONF,
    "unknown_rejection": _IND + "u AS (SELECT list_max(prob) AS t, NOT list_bool_or([CAST(v AS FLOAT)>=CAST(0.6 AS FLOAT) FOR v IN prob]) AS z FROM s WHERE g<=2) SELECT count(*) AS n, count(*) FILTER (z) AS rejected, round(coalesce(avg(CAST(z AS INT)),0e0),9) AS rejection_rate, round(coalesce(avg(t),0e0),6) AS mean_top, round(coalesce(max(t),0e0),6) AS max_top FROM u",
    "false_accepts": _IND + "u AS (SELECT CAST(i-1 AS INT) AS class_id, CAST(prob[i] AS FLOAT)>=CAST(0.6 AS FLOAT) AS z FROM s, (SELECT unnest([1,2,3]) AS i) WHERE g<=2) SELECT class_id, count(*) AS n, count(*) FILTER (z) AS accepted, round(avg(CAST(z AS INT)),9) AS rate FROM u GROUP BY class_id",
    "blend_search": _LOG + """, b AS (SELECT label % 7 AS y, cp, [exp(v)/list_sum([exp(u) FOR u IN o]) FOR v IN o] AS q FROM st), h AS (SELECT alpha, y, [(1-alpha)*cp[i]+alpha*q[i] FOR i IN range(1,8)] AS m FROM b, (SELECT unnest([0e0,25e-2,5e-1,75e-2,1e0]) AS alpha))
  SELECT alpha, round(avg(CAST(list_position(m,list_max(m))-1=y AS INT)),9) AS accuracy FROM h GROUP BY alpha""",
    "source_weights": "WITH c AS (SELECT count(*) AS n, sum(quality) AS a, sum(toxic) AS b FROM labels) SELECT doc_id, round((CAST(n AS DOUBLE)/greatest(CASE WHEN quality=1 THEN a ELSE n-a END,1)+CAST(n AS DOUBLE)/greatest(CASE WHEN toxic=1 THEN b ELSE n-b END,1))/2,9) AS weight FROM labels, c",
    "positive_weights": "WITH x AS (SELECT CAST(0 AS INT) AS class_id, quality AS y FROM labels UNION ALL SELECT 1, toxic FROM labels) SELECT class_id, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1-y) AS BIGINT) AS neg, round(CAST(sum(1-y) AS DOUBLE)/greatest(sum(y),1),9) AS pos_weight FROM x GROUP BY class_id",
    "spectral_stats": _FFT,
    "normalized_signals": _CAP + _FIXED.format(pad="med") + "SELECT file, CAST(pos AS INT) AS pos, round(z,6) AS x FROM z",
    "pair_metrics": _VEC + f""", d AS (SELECT {_DRAW.format("a", "i")} % n AS a, {_DRAW.format("b", "i")} % n AS b FROM (SELECT unnest(range(0,(SELECT least(20000,n*(n-1)//2) FROM c))) AS i), c),
  p AS (SELECT oa.v AS x, ob.v AS y FROM d JOIN o oa ON oa.place=d.a JOIN o ob ON ob.place=d.b WHERE d.a<>d.b),
  m AS (SELECT sqrt(list_avg([(x[i]-y[i])*(x[i]-y[i]) FOR i IN range(1,65)])) AS rmse, list_avg([abs(x[i]-y[i]) FOR i IN range(1,65)]) AS mae, [u-list_avg(x) FOR u IN x] AS xc, [u-list_avg(y) FOR u IN y] AS yc FROM p),
  r AS (SELECT rmse, mae, list_cosine_similarity(xc,yc) AS corr FROM m), s AS (SELECT greatest(quantile_cont(CAST(list_max(embedding)-list_min(embedding) AS DOUBLE),5e-1),1e-12) AS sc FROM embeddings)
  SELECT count(*) AS pairs, round(avg(corr),6) AS corr_mean, round(quantile_cont(corr,5e-2),6) AS corr_p05, round(avg(rmse),6) AS rmse_mean, round(quantile_cont(rmse,95e-2),6) AS rmse_p95, round(avg(mae),6) AS mae_mean, round(avg(rmse)/any_value(sc),6) AS nrmse_mean, round(any_value(sc),6) AS dynamic_range FROM r, s""",
    "population_variation": _VEC + ", " + _PT + """, p AS (SELECT round(avg(x),6) AS m, round(stddev_pop(x),6) AS s, round(quantile_cont(x,5e-2),6) AS a, round(quantile_cont(x,95e-2),6) AS b FROM x GROUP BY pos)
  SELECT round(avg(s),6) AS point_std_mean, round(quantile_cont(s,95e-2),6) AS point_std_p95, round(avg(b-a),6) AS band_mean, round(avg(b-a)/greatest(max(m)-min(m),1e-12),6) AS band_to_range, round(greatest(max(m)-min(m),1e-12),6) AS mean_wave_range FROM p""",
    "coverage_curve": _VEC + """, g AS (SELECT unnest([100,200,500,1000,1500,2000]) AS size), b AS (SELECT size, a.id, max(list_cosine_similarity(a.v,o.v)) AS s FROM e a, g, o, c WHERE o.place<size AND size<c.n GROUP BY ALL)
  SELECT CAST(size AS BIGINT) AS size, round(avg(s),6) AS coverage FROM b GROUP BY size UNION ALL SELECT n, 1e0 FROM c WHERE n>=2""",
    "distribution_saturation": _SAT,
    "robust_columns": _VEC + ", " + _PT + """, m AS (SELECT pos, median(x) AS med, stddev_pop(x) AS sd FROM x GROUP BY pos), a AS (SELECT pos, median(abs(x-med)) AS mad FROM x JOIN m USING (pos) GROUP BY pos)
  SELECT id, CAST(pos AS INT) AS pos, round(greatest(least((x-med)/CASE WHEN mad>1e-6 THEN 14826e-4*mad ELSE sd+1e-6 END,8e0),-8e0),5) AS z FROM x JOIN m USING (pos) JOIN a USING (pos)""",
    "mixture_plan": "WITH " + _PLAN + " SELECT sample_id, right(format('{:03b}', label), 3) AS label, split FROM sp",
    "mixture_slots": _SLOT + "SELECT sample_id, k, class, frequency, file, round(gain,6) AS gain, polarity, shift FROM s2",
    "mixtures": _SLOT + _FIXED.format(pad="0e0") + "SELECT sample_id, CAST(count(*) AS INT) AS sources, CAST((pos+shift)%12 AS INT) AS pos, round(sum(z*gain*polarity),6) AS x FROM s2 JOIN z USING (file) GROUP BY sample_id, (pos+shift)%12",
    "spectral_templates": _VEC + """, r AS (SELECT *, 'c' || (label%3) AS class, row_number() OVER (PARTITION BY label%3 ORDER BY md5('42|' || id), id) AS k FROM e),
  q AS (SELECT id, class, i AS bin, (v[4*i+1]**2+v[4*i+2]**2+v[4*i+3]**2+v[4*i+4]**2)/4 AS p FROM r, (SELECT unnest(range(0,16)) AS i) WHERE k<=1000), n AS (SELECT class, bin, p/sum(p) OVER (PARTITION BY id) AS p FROM q),
  t AS (SELECT class, bin, median(p) AS p FROM n GROUP BY ALL) SELECT class, CAST(bin AS INT) AS bin, round(p/sum(p) OVER (PARTITION BY class),9) AS p FROM t""",
}
