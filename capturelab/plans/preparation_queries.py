"""Queries on model input, random crops, domain gaps and mixed training sets over the driver's tables, and the same in DuckDB's SQL."""

from pyspark.sql import functions as F

from ..functions import waveforms as W
from ..operators import preparation, reports, splits
from . import views
from .model_queries import _CAP, _DRAW, _FIXED, LENGTH, SEED

RECORD = ("original_length", "method", "crop_start", "crop_end", "pad_value", "raw_min", "raw_max", "fixed_min", "fixed_max", "normal_min", "normal_max", "centre", "deviation", "nan_count", "positive_inf_count", "negative_inf_count")


def _user():
    return F.element_at(F.split("file", "/"), -1).cast("int")


def _broken(s, d):
    """Captures of which some have a NaN in the second place or a negative infinity in the first."""
    bad = lambda v, i: F.when((_user() % 10 == 3) & (i == 1), float("nan")).when((_user() % 10 == 4) & (i == 0), float("-inf")).otherwise(v)
    return views.captures(s, d).select("file", F.transform("signal", bad).alias("signal"))


def _input(s, d):
    x = preparation.model_input(_broken(s, d), LENGTH, 8, 4, 5, 2, scale="absolute", kind="double")
    m = F.get("feature", 0)
    total = F.aggregate(m, F.lit(0.0), lambda a, v: a + v)
    shown = lambda c: F.col(f"record.{c}") if c == "method" or c.startswith(("crop", "original")) or c.endswith("count") else F.round(f"record.{c}", 6)
    return x.select("file", *(shown(c).alias(c) for c in RECORD), F.round(F.array_max(m), 6).alias("top"), F.round(total, 6).alias("total"), "error")


def _crops(s, d):
    x = views.captures(s, d).select("file", F.posexplode(W.random_crop(F.col("signal"), LENGTH, F.col("file"), SEED)).alias("pos", "x"))
    return x.select("file", "pos", F.round("x", 6).alias("x"))


def _gap(s, d):
    x = views.captures(s, d).select("file", "group", F.when(_user() % 2 == 0, "real").otherwise("synthetic").alias("domain"), "signal")
    return reports.domain_differences(preparation.gap_statistics(x, LENGTH, 8, 4, 5, 2), "group", list(W.GAP))


def _training(s, d):
    x = splits.stratified_split(views.index(s, d), "file", ["group"])
    made = F.col("file") % 4 == 0
    y = preparation.training_set(x.where(made), x.where(~made), "hybrid")
    return y.select("file", "group", "domain", F.round("weight", 12).alias("weight"))


QUERIES = {"model_input": _input, "random_crops": _crops, "domain_gap": _gap, "hybrid_training_set": _training}

#: Magnitudes of two frames of eight under a Hann window that sums to 4, of (file, pos, z).
_FRAMES = """, sf AS (SELECT file, fr, m, z*(5e-1-5e-1*cos(2*pi()*m/8)) AS x FROM z, (SELECT unnest([0,1]) AS fr), (SELECT unnest(range(0,8)) AS m) WHERE pos = fr*4+m),
sm AS (SELECT file, fr, k, sqrt(power(sum(x*cos(2*pi()*k*m/8)),2)+power(sum(x*sin(2*pi()*k*m/8)),2))/4 AS a FROM sf, (SELECT unnest(range(0,5)) AS k) GROUP BY ALL)
"""


def oracles(split_sql: str) -> dict[str, str]:
    """split_sql: the common table expressions of a stratified split, from {by} and {key}."""
    none = "CASE WHEN g.raw_min IS NOT NULL THEN {} END AS {}"
    counts = {"original_length": "n", "method": "CASE WHEN n<12 THEN 'padded' WHEN n>12 THEN 'cropped' ELSE 'kept' END", "crop_start": "CASE WHEN n>12 THEN (n-12)//2 END", "crop_end": "CASE WHEN n>12 THEN (n-12)//2+12 END", "pad_value": "CASE WHEN n<12 THEN 0e0 END", "nan_count": "nans", "positive_inf_count": "CAST(0 AS BIGINT)", "negative_inf_count": "low"}
    ranges = ", ".join(f"round({c},6) AS {c}" for c in ("raw_min", "raw_max", "fixed_min", "fixed_max", "normal_min", "normal_max", "centre", "deviation", "top", "total"))
    return {
        "model_input": _CAP + f""", b AS (SELECT *, CASE WHEN user_id%10=3 AND i=1 THEN 'nan' WHEN user_id%10=4 AND i=0 THEN 'low' END AS bad FROM v),
  g AS (SELECT file, n, min(x) FILTER (bad IS NULL) AS raw_min, max(x) FILTER (bad IS NULL) AS raw_max, count(*) FILTER (bad='nan') AS nans, count(*) FILTER (bad='low') AS low FROM b GROUP BY file, n),
  f AS (SELECT g.file, p AS pos, bad, CASE WHEN bad IS NULL THEN coalesce(x, 0e0) ELSE 0e0 END AS x FROM g CROSS JOIN (SELECT unnest(range(0,12)) AS p) LEFT JOIN b ON b.file=g.file AND b.i = p + CASE WHEN g.n>12 THEN (g.n-12)//2 ELSE 0 END WHERE raw_min IS NOT NULL),
  s AS (SELECT file, min(x) FILTER (bad IS NULL) AS fixed_min, max(x) FILTER (bad IS NULL) AS fixed_max, avg(x) AS centre, stddev_pop(x) AS deviation FROM f GROUP BY file),
  z AS (SELECT file, pos, (x-centre)/CASE WHEN deviation<1e-8 THEN 1 ELSE deviation END AS z FROM f JOIN s USING (file)){_FRAMES},
  t AS (SELECT file, max(a) AS top, sum(a) AS total FROM sm GROUP BY file), r AS (SELECT file, min(z) AS normal_min, max(z) AS normal_max FROM z GROUP BY file)
  SELECT g.file, {", ".join(none.format(v, k) for k, v in counts.items())}, {ranges}, CASE WHEN g.raw_min IS NULL THEN 'no finite values' END AS error FROM g LEFT JOIN s USING (file) LEFT JOIN t USING (file) LEFT JOIN r USING (file)""",
        "random_crops": _CAP + f", c AS (SELECT file, {_DRAW.format('crop|0', 'file')} % greatest(n-11, 1) AS st FROM v WHERE i=0) SELECT c.file, CAST(p AS INT) AS pos, round(coalesce(x, 0e0),6) AS x FROM c CROSS JOIN (SELECT unnest(range(0,12)) AS p) LEFT JOIN v ON v.file=c.file AND v.i=st+p",
        "domain_gap": _CAP + _FIXED.format(pad="0e0") + _FRAMES + f""", a AS (SELECT file, frequency AS "group", user_id%2=0 AS own, avg(x) AS signal_mean, stddev_pop(x) AS signal_std, sqrt(avg(x*x)) AS signal_rms, max(x)-min(x) AS signal_p2p FROM fx GROUP BY ALL),
  l AS (SELECT file, avg(ln(1+a)) AS stft_mean, stddev_pop(ln(1+a)) AS stft_std, max(ln(1+a)) AS stft_max, avg(power(ln(1+a),2)) AS stft_energy FROM sm GROUP BY file),
  m AS (UNPIVOT (SELECT * FROM a JOIN l USING (file)) ON {", ".join(W.GAP)} INTO NAME metric VALUE v),
  o AS (SELECT "group", metric, avg(v) AS r FROM m WHERE own GROUP BY ALL), s AS (SELECT metric, avg(v) AS s FROM m WHERE NOT own GROUP BY metric)
  SELECT "group", o.metric, round(r,6) AS real, round(coalesce(s,0e0),6) AS synthetic, round(r-coalesce(s,0e0),6) AS difference, round(CASE WHEN abs(s)>1e-12 THEN r/s END,6) AS ratio FROM o LEFT JOIN s ON s.metric=o.metric""",
        "hybrid_training_set": 'WITH x AS (SELECT o_orderkey AS file, o_orderpriority AS "group" FROM orders), ' + split_sql.format(by='"group"', key="file") + """, t AS (SELECT file, "group", CASE WHEN file%4=0 THEN 'synthetic' ELSE 'real' END AS domain FROM z WHERE split='train')
  SELECT file, "group", domain, round(CASE WHEN domain='real' THEN 7e-1 ELSE 3e-1 END/count(*) OVER (PARTITION BY domain),12) AS weight FROM t""",
    }
