"""Queries on warnings, resampling, trace channels, augmentation and scoring, and the same in DuckDB's SQL."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import waveforms as W
from ..operators import distribution, scoring, splits
from . import views


def _warnings(s, d):
    x = views.scores(s, d).withColumn("scope", F.concat(F.lit("s"), F.col("file") % 3))
    w = distribution.warnings(x, "scope", "target", ["s0", "s1", "s2", "s3"])
    return w.select("scope", "rule", "subject", F.round("value", 9).alias("value"), F.round("reference", 9).alias("reference"))


def _resampled(s, d):
    x = views.table(s, d, "labels").withColumn("combo", F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")))
    weighted = x.join(F.broadcast(splits.combo_weights(x, "combo").select("combo", "weight")), "combo")
    return splits.weighted_resample(weighted.select("doc_id", "combo", "weight"), "doc_id", "weight", x.count()).select("doc_id", "combo", "copies")


def _trace(s, d):
    x = views.captures(s, d).select("file", W.db_trace_channels(F.col("signal"), 16, 8, 9, 8).alias("c"))
    return x.select("file", F.size("c").alias("channels"), *(F.round(F.get(F.get("c", k), 0).cast("double"), 4).alias(n) for k, n in ((2, "level"), (3, "variation"))))


def _augmented(s, d):
    x = views.captures(s, d).select("file", W.stft(F.col("signal"), 16, 8, 9, 8, representation="absolute_relative").alias("c"))
    return x.select("file", W.augmented(F.col("file"), F.col("c"), 9, 8, "absolute_relative").alias("c")).select("file", F.posexplode("c").alias("channel", "x")).select("file", "channel", F.round(F.array_max("x").cast("double"), 4).alias("top"))


def _mean_model():
    return lambda signals: np.array([[x.mean() / 20 + k for k in (0.0, 1.0, 2.0)] for x in signals])


def _scored(s, d):
    x = scoring.scored(views.captures(s, d), _mean_model, 3)
    return x.select("file", *(F.round(F.get("prob", k), 6).alias(f"p{k}") for k in range(3)), "error")


QUERIES = {"distribution_warnings": _warnings, "weighted_resample": _resampled, "db_trace_channels": _trace, "augmented_spectra": _augmented, "scored_captures": _scored}

_SIGNAL = "WITH v AS (SELECT event_type || '/' || user_id AS file, CAST(CAST(-value/5 AS FLOAT) AS DOUBLE) AS x FROM events), g AS (SELECT file, median(x) AS md, stddev_pop(x) AS sd, avg(x) AS mean FROM v GROUP BY file) "
ORACLES = {
    "distribution_warnings": """WITH x AS (SELECT 's' || (vec_id % 3) AS scope, label % 7 + 1 AS y FROM embeddings), c AS (SELECT scope, y, count(*) AS n FROM x GROUP BY ALL),
  t AS (SELECT scope, CAST(sum(n) AS BIGINT) AS total, quantile_cont(n, 5e-1) AS med FROM c GROUP BY scope),
  e AS (SELECT t.scope, b.y, lpad(bin(b.y), 3, '0') AS combo, coalesce(c.n, 0) AS n, total, med FROM t CROSS JOIN (SELECT unnest(range(1,8)) AS y) b LEFT JOIN c ON c.scope = t.scope AND c.y = b.y),
  w AS (SELECT scope, max(CASE WHEN y=6 THEN n END) AS a, min(CASE WHEN y IN (3,5) AND n>0 THEN n END) AS o FROM e GROUP BY scope),
  p AS (SELECT scope, i, sum(CASE WHEN (y >> (2-i)) & 1 = 1 THEN n ELSE 0 END) / any_value(CAST(total AS DOUBLE)) AS r FROM e, (SELECT unnest([0,1,2]) AS i) GROUP BY ALL),
  z AS (SELECT s AS scope, 'no_samples' AS rule, '' AS subject, 0e0 AS value, 0e0 AS reference FROM (SELECT unnest(['s0','s1','s2','s3']) AS s) WHERE s NOT IN (SELECT scope FROM t)
  UNION ALL SELECT scope, 'high_positive_ratio', CAST(i AS VARCHAR), r, 75e-2 FROM p WHERE r >= 75e-2
  UNION ALL SELECT scope, 'missing_combination', combo, 0e0, med FROM e WHERE n = 0
  UNION ALL SELECT scope, 'rare_combination', combo, n, med FROM e WHERE n > 0 AND n < 25e-2*med
  UNION ALL SELECT scope, 'high_triple_ratio', combo, CAST(n AS DOUBLE)/total, 25e-2 FROM e WHERE y=7 AND CAST(n AS DOUBLE)/total >= 25e-2
  UNION ALL SELECT scope, 'low_double', '110', a, o FROM w WHERE a < 5e-1*o)
  SELECT scope, rule, subject, round(value,9) AS value, round(reference,9) AS reference FROM z""",
    "weighted_resample": """WITH x AS (SELECT doc_id, CAST(quality AS VARCHAR)||CAST(toxic AS VARCHAR) AS combo FROM labels), g AS (SELECT combo, round(1e0/count(*),9) AS w FROM x GROUP BY combo),
  p AS (SELECT doc_id, combo, CAST(round(w/(SELECT max(w) FROM g)*16777216) AS BIGINT) AS w FROM x JOIN g USING (combo)),
  l AS (SELECT *, CAST(sum(w) OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)),1,3), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM p WHERE w > 0),
  u AS (SELECT CAST('0x'||substr(md5('42|'||i),1,15) AS BIGINT) % (SELECT CAST(sum(w) AS BIGINT) FROM l) AS a FROM range(0, (SELECT count(*) FROM x)) r(i))
  SELECT doc_id, combo, count(*) AS copies FROM u JOIN l ON a >= e - w AND a < e GROUP BY ALL""",
    "db_trace_channels": _SIGNAL + "SELECT file, CAST(4 AS INT) AS channels, round(least(greatest((md+110)/60,0e0),1e0),4) AS level, round(least(sd/15,1e0),4) AS variation FROM g",
    "scored_captures": _SIGNAL + "SELECT file, " + ", ".join(f"round(1/(1+exp(-(mean/20+{k}))),6) AS p{k}" for k in range(3)) + ", CAST(NULL AS VARCHAR) AS error FROM g",
}
