"""Exact nearest neighbours without meeting every pair: cells around pivots, and bounds that prove where no neighbour can be."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .neighbors import FOUND, _apart, _matrix, _near, centres, in_blocks, searched, sound

#: What rounding similarities to nine places and computing in doubles can move a distance by.
SLACK = 1e-6


def _reach(similarity: np.ndarray, width: int, metric: str) -> np.ndarray:
    """The greatest distance that a pair of at least this similarity can have; a missing similarity allows any."""
    lowest = similarity - 2e-9
    far = np.sqrt(np.maximum(2 - 2 * lowest, 0)) if metric == "cosine" else -lowest * np.sqrt(width)
    return np.where(np.isnan(similarity), np.inf, far * (1 + SLACK) + SLACK)


#: Copies of a frequent vector's row, over which its rows are dealt.
SALTS = 32


def certified(vectors: DataFrame, k: int, metric: str = "cosine", cells: int | None = None, block_rows: int = 2048, seed: int = 42) -> DataFrame:
    """(id, neighbour, similarity, place, compared): what `nearest` returns, and with how many different vectors each was compared.

    Equal vectors are one: it stands for the k + 1 smallest ids that have it, which are all that can be among the k nearest of anything. So
    copies are never compared with one another, however many there are.

    Every vector lies in the cell of its nearest pivot; pivots are fitted to a bounded sample, about sqrt(rows) and at most 4,096. Its k
    best within its cell bound how far a neighbour can be. By the triangle inequality a cell holds none if its pivot is farther away than that
    bound and the cell's radius together, or if the bisecting plane of the two pivots is farther away than the bound; in a cell that is asked, only
    vectors whose distance to the pivot differs from the askers' by no more than the bound are compared. So what is left out is proved to be farther. Cells lie in blocks
    of bounded size, a crowded one in several, and a vector goes once to each block that has a cell it asks. On vectors without clusters the bounds exclude little and the work is that of `nearest`. Null vectors and those with endless numbers are left out.
    """
    vectors = sound(vectors)
    first = vectors.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)  # k + 1 rows a task and vector are shuffled
    groups = kept(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("id"), "v", "ids"))
    found = _between(groups.select("id", "v"), k, metric, cells, block_rows, seed)
    copied = groups.where(F.size("ids") > 1)
    if copied.isEmpty():
        return found
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = F.pow(F.least(norm / 1e-12, F.lit(1.0)), 2) if metric == "cosine" else F.lit(0.0)
    near = found.select("id", "neighbour", "similarity", F.when(F.col("place") == 1, F.col("compared")).otherwise(0).alias("compared")).unionByName(groups.select("id", F.col("id").alias("neighbour"), own.alias("similarity"), F.lit(0).cast("long").alias("compared")))
    others = near.join(groups.select(F.col("id").alias("neighbour"), F.col("ids").alias("_ids")), "neighbour").select("id", "similarity", "compared", F.explode("_ids").alias("other"), F.col("neighbour"))
    # a vector has k + 1 neighbours with k + 1 ids each at most
    listed = others.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("far"), F.col("other").alias("neighbour")))), 1, k + 1).alias("near"))
    listed = listed.join(near.groupBy("id").agg(F.sum("compared").alias("compared")), "id")
    single = groups.where(F.size("ids") == 1).select("id").join(listed, "id")
    salted = copied.select("id", "v").join(listed, "id").drop("id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    many = vectors.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["v", "_salt"]).select("id", "near", "compared")
    rest = F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("id")), 1, k)
    out = single.unionByName(many).select("id", "compared", F.posexplode(rest).alias("_p", "n"))
    return out.select("id", "n.neighbour", (-F.col("n.far")).alias("similarity"), (F.col("_p") + 1).alias("place"), "compared")


def _between(vectors: DataFrame, k: int, metric: str, cells: int | None, block_rows: int, seed: int) -> DataFrame:
    """`certified` for vectors (id, v) that are all different."""
    spark = vectors.sparkSession
    cells = cells or min(4096, max(1, round(vectors.count() ** 0.5)))
    pivots = centres(vectors, cells, metric, seed=seed)
    if not len(pivots):
        return spark.createDataFrame([], FOUND + ", place int, compared long")
    width = pivots.shape[1]
    lying, lies, radius = in_blocks(vectors, pivots, metric, block_rows)
    sent = spark.sparkContext.broadcast((pivots, radius))  # at most 4,096

    def at_home(t: pa.Table) -> pa.Table:
        """A block's rows, each with how far its k best can be, by its k-th best in its own cell."""
        ids, cell = np.asarray(t["id"]), np.asarray(t["cell"])
        v = _matrix(t["v"], len(ids), metric)
        similarity, sound = np.full(len(ids), np.nan), np.isfinite(v).all(axis=1)
        order = np.flatnonzero(sound)
        order = order[np.argsort(cell[order], kind="stable")]
        _, starts = np.unique(cell[order], return_index=True)
        for part in np.split(order, starts[1:]):
            found, _, value = _near(v[part], v[part], ids[part], ids[part], k, metric)
            last = np.flatnonzero(np.r_[found[1:] != found[:-1], True][: len(found)])
            whole = last[np.diff(np.r_[-1, last]) == k]
            place = np.argsort(ids[part], kind="stable")
            similarity[part[place[np.searchsorted(ids[part][place], found[whole])]]] = value[whole]
        return t.set_column(t.column_names.index("bound"), "bound", pa.array(_reach(similarity, width, metric)))

    def asks(d, home, off, bound, cells):
        pivots, radius = sent.value
        between = _apart(pivots[home], pivots[cells])
        plane = (d * d - (off * off)[:, None]) / np.maximum(2 * between, 1e-300)
        plane[between <= SLACK] = 0  # pivots that coincide have no plane between them
        near = (np.maximum(d - radius[cells][None, :], plane) <= bound[:, None] + SLACK) & np.isfinite(radius[cells])[None, :]
        return near | (home[:, None] == cells[None, :])

    bounded = kept(lying.groupBy("block").applyInArrow(at_home, lying.schema))
    found = searched(bounded, pivots, lies, asks, k, metric, narrow=True)
    w = Window.partitionBy("id")
    placed = found.withColumn("place", F.row_number().over(w.orderBy(F.desc("similarity"), "neighbour"))).withColumn("compared", F.sum("compared").over(w))
    return placed.where(F.col("place") <= k).select("id", "neighbour", "similarity", "place", "compared")
