"""Queries whose jobs write files into the shared folder and read them back, over the driver's tables, and the same in DuckDB's SQL."""

import uuid

from pyspark.sql import functions as F

from ..functions.labels import combo
from ..operators import mixtures, splits
from ..sources import captures, feature_store
from ..sources.shared import shared_dir
from . import model_queries, views
from .model_queries import _CAP, _FIXED, _SLOT, LENGTH, NAMES


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _stored_mixtures(s, d):
    """Mixtures stored with their records, and every split read back."""
    path, plan = _folder(s, "mixtures"), model_queries._plan(s, d)
    mixtures.store(mixtures.mixed(model_queries._slots(s, d), model_queries._captures(s, d), LENGTH), plan, path, NAMES, {"normalize": "none"})
    names = "+".join(mixtures.classes(s, path))
    out = None
    for split in ("train", "val", "test"):
        x = mixtures.stored(s, path, split)
        out = x if out is None else out.unionByName(x)
    record = F.from_json("record", "sample_id long, sources array<struct<file:string>>, label array<int>, augmentations string")
    files = F.array_join(F.transform("r.sources", lambda x: x["file"]), ",")
    x = out.select("sample_id", "split", F.col("label").alias("own"), F.aggregate("signal", F.lit(0.0), lambda a, v: a + v * v).alias("power"), record.alias("r"))
    return x.select("sample_id", "split", combo(F.col("own")).alias("label"), (F.col("r.label") == F.col("own")).alias("same"), files.alias("files"), F.lit(names).alias("classes"), F.round("power", 4).alias("power"))


def _stored_features(s, d):
    """Features of some captures first, then of all: the second update computes what the first has not."""
    path, settings, seen = _folder(s, "features"), {"bins": 1}, []

    def compute(rows):
        seen.append(len(seen))
        total = F.aggregate("signal", F.lit(0.0), lambda a, v: a + v)
        return rows.select("file", "key", F.round(total, 4).alias("total"), F.lit(seen[-1]).alias("part"))

    x = views.captures(s, d)
    feature_store.update(x.where("group in ('click', 'error')"), path, settings, compute)
    return feature_store.update(x, path, settings, compute).select("file", "key", "total", "part")


def _prepared(s, d):
    """A split that is made and written where there is none, and read where there is."""
    path, index = _folder(s, "split"), lambda: views.index(s, d)
    splits.prepared_split(s, path, index, "file", ["group"], limits={"1-URGENT": 100})
    return splits.prepared_split(s, path, lambda: None, "file", ["group"]).select("file", "group", "split")


def _capture_files(s, d, folder: str, of):
    """A *.csv file for each event type and part of the users, of the events that `of` takes, in folders by both, with the values as rows behind a DATA line."""
    e = views.table(s, d, "events").where(of).select("event_type", (F.col("user_id") % 20).alias("part"), "event_id", F.col("value").cast("float").cast("double").alias("v"))
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("v").cast("string"))
    marker = e.select("event_type", "part").distinct().select("event_type", "part", F.lit(-1).cast("long").alias("event_id"), F.lit("DATA").alias("value"))
    rows = marker.unionByName(e.select("event_type", "part", "event_id", line.alias("value")))
    path = _folder(s, folder)
    ordered = rows.repartition("event_type", "part").sortWithinPartitions("event_type", "part", "event_id").select("event_type", "part", "value")
    ordered.write.partitionBy("event_type", "part").option("sep", "\u0001").csv(path)
    return path


def _folder_captures(s, d):
    path = _capture_files(s, d, "captures", F.lit(True))
    place = F.regexp_extract("file", "(event_type=[a-z_]+/part=[0-9]+)/", 1)
    x = captures.read_folder(s, path)
    return x.select(place.alias("place"), F.size("signal").cast("long").alias("n"), F.round(F.aggregate("signal", F.lit(0.0), lambda a, v: a + v), 1).alias("total"), "parse_error")


def _background_captures(s, d):
    """Background captures of a folder, of a folder that isn't there, and with backgrounds off: (kind, files, values)."""
    path = _capture_files(s, d, "background", F.col("event_type") == "error")
    of = lambda kind, x: x.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("signal")), F.lit(0)).alias("n")).select(F.lit(kind).alias("kind"), "files", "n")
    return of("there", captures.backgrounds(s, path)).unionByName(of("missing", captures.backgrounds(s, f"{path}-missing"))).unionByName(of("off", captures.backgrounds(s, path, enabled=False)))


QUERIES = {"stored_mixtures": _stored_mixtures, "stored_features": _stored_features, "prepared_split": _prepared, "folder_captures": _folder_captures, "background_captures": _background_captures}


def oracles(split: str) -> dict[str, str]:
    settings = feature_store.settings_hash({"bins": 1})
    return {
        "stored_mixtures": _SLOT + _FIXED.format(pad="0e0") + """, mx AS (SELECT sample_id, (pos+shift)%12 AS pos, sum(z*gain*polarity) AS x FROM s2 JOIN z USING (file) GROUP BY ALL), pw AS (SELECT sample_id, sum(x*x) AS power FROM mx GROUP BY 1),
  fs AS (SELECT sample_id, string_agg(file, ',' ORDER BY k) AS files FROM s2 GROUP BY 1) SELECT sample_id, split, right(format('{:03b}', label), 3) AS label, true AS same, files, 's1+s3+s5' AS classes, round(power,4) AS power FROM sp JOIN pw USING (sample_id) JOIN fs USING (sample_id)""",
        "stored_features": _CAP + f""" SELECT file, sha1(file || '|{settings}') AS key, round(sum(x),4) AS total, CAST(CASE WHEN frequency IN ('click','error') THEN 0 ELSE 1 END AS INT) AS part FROM v GROUP BY file, frequency""",
        "prepared_split": 'WITH x AS (SELECT o_orderkey AS file, o_orderpriority AS "group" FROM orders), ' + split.format(by='"group"', key="file") + """, o AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY md5('42|' || CAST(file AS VARCHAR)), file) AS place FROM z) SELECT file, "group", split FROM o WHERE "group" <> '1-URGENT' OR place <= 100""",
        "folder_captures": "SELECT 'event_type=' || event_type || '/part=' || (user_id % 20) AS place, count(*) AS n, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)),1) AS total, CAST(NULL AS VARCHAR) AS parse_error FROM events GROUP BY event_type, user_id % 20",
        "background_captures": "SELECT 'there' AS kind, count(DISTINCT user_id % 20) AS files, count(*) AS n FROM events WHERE event_type='error' UNION ALL SELECT 'missing', 0, 0 UNION ALL SELECT 'off', 0, 0",
    }
