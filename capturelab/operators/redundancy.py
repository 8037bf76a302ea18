"""How much a collection of equal-length vectors repeats itself: pairs, dimensions, coverage and saturation.

vectors: id, v array<float or double>, all of one length d. Samples named here are the features themselves (so many
pairs, reference sets of such sizes); everything else is computed over all rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import waveforms as W
from ..functions.arrays import draw
from ..sources.shared import kept
from .quantiles import SMALL, quantiles
from .splits import order_key, stratum_rank

#: Sizes of reference sets and subsets: fixed values.
SIZES = (100, 200, 500, 1000, 1500, 2000)


def numbered(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """rows with place, 0 to n - 1, in md5 order. Prefixes of the hash share the work; only their counts meet in one task."""
    digits = max(1, math.ceil(math.log(max(n / 4096, 1), 16)))
    x = rows.withColumn("_h", order_key(seed, F.col(key))).withColumn("_p", F.substring("_h", 1, digits))
    counts = x.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_s"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    return x.withColumn("_w", within).join(starts, "_p").select(*rows.columns, (F.col("_s") + F.col("_w") - 1).alias("place"))


def _doubles(c: str) -> Column:
    return F.transform(c, lambda v: v.cast("double"))


def pairs(vectors: DataFrame, seed: int, most: int = 20000) -> DataFrame:
    """(pair, a, b, rmse, mae, corr) of randomly drawn pairs of different rows."""
    n = vectors.count()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "pair long, a long, b long, rmse double, mae double, corr double")
    x = numbered(vectors.select("id", _doubles("v").alias("v")), "id", seed, n)
    drawn = vectors.sparkSession.range(min(most, n * (n - 1) // 2)).select(F.col("id").alias("pair"), *((draw(seed, k, F.col("id")) % n).alias(f"p{k}") for k in "ab")).where("pa <> pb")
    side = lambda k: x.select(F.col("place").alias(f"p{k}"), F.col("id").alias(k), F.col("v").alias(f"v{k}"))
    both = drawn.join(side("a"), "pa").join(side("b"), "pb")
    d = F.zip_with("va", "vb", lambda p, q: p - q)
    centred = lambda c: A.let(A.mean(F.col(c)), lambda m: F.transform(c, lambda v: v - m))
    dot = lambda p, q: A.total(F.zip_with(p, q, lambda u, w: u * w))
    x = both.select("pair", "a", "b", d.alias("d"), centred("va").alias("ca"), centred("vb").alias("cb"))
    corr = dot("ca", "cb") / F.greatest(F.sqrt(dot("ca", "ca")) * F.sqrt(dot("cb", "cb")), F.lit(1e-12))
    return x.select("pair", "a", "b", F.sqrt(dot("d", "d") / F.size("d")).alias("rmse"), A.mean(F.transform("d", F.abs)).alias("mae"), corr.alias("corr"))


def _range(vectors: DataFrame, n: int) -> DataFrame:
    """One row with scale: the median range of a vector of n."""
    ranges = vectors.select((F.array_max("v") - F.array_min("v")).cast("double").alias("r"))
    return quantiles(ranges, [], F.col("r"), [0.5], most=n).select(F.greatest(F.get("q", F.lit(0)), F.lit(1e-12)).alias("scale"))


def pair_summary(vectors: DataFrame, seed: int, most: int = 20000) -> DataFrame:
    """One row: mean and tail of the pairs' correlation, RMSE and MAE, and RMSE by the median dynamic range."""
    span = _range(vectors, vectors.count())
    drawn = pairs(vectors, seed, most)
    if most <= SMALL:
        p = drawn.agg(F.count("*").alias("pairs"), F.avg("corr").alias("corr_mean"), F.percentile("corr", F.lit(0.05)).alias("corr_p05"), F.avg("rmse").alias("rmse_mean"), F.percentile("rmse", F.lit(0.95)).alias("rmse_p95"), F.avg("mae").alias("mae_mean"))
    else:
        drawn = kept(drawn)
        tail = quantiles(drawn, [], F.col("rmse"), [0.95]).select(F.get("q", F.lit(0)).alias("rmse_p95"))
        p = quantiles(drawn, [], F.col("corr"), [0.05], F.count("*").alias("pairs"), F.avg("corr").alias("corr_mean"), F.avg("rmse").alias("rmse_mean"), F.avg("mae").alias("mae_mean")).withColumn("corr_p05", F.get("q", F.lit(0))).crossJoin(tail)
    one = p.crossJoin(span)  # all have one row
    return one.select("pairs", *(F.round(c, 6).alias(c) for c in ("corr_mean", "corr_p05", "rmse_mean", "rmse_p95", "mae_mean")), F.round(F.col("rmse_mean") / F.col("scale"), 6).alias("nrmse_mean"), F.round("scale", 6).alias("dynamic_range"))


def population(points: DataFrame) -> DataFrame:
    """One row from point statistics (pos, mean, std, p05, p95): spread of the points and the 5 to 95 % band against the mean wave's range."""
    band, span = F.avg(F.col("p95") - F.col("p05")), F.greatest(F.max("mean") - F.min("mean"), F.lit(1e-12))
    made = {"point_std_mean": F.avg("std"), "point_std_p95": F.percentile("std", F.lit(0.95)), "band_mean": band, "band_to_range": band / span, "mean_wave_range": span}
    return points.agg(*(F.round(v, 6).alias(k) for k, v in made.items()))


#: Vectors up to this long have their d x d sums at the driver; longer ones are met by a subspace only.
WHOLE_WIDTH = 1024


def summed(vectors: DataFrame, part, shape: tuple[int, int], block: int = 256) -> np.ndarray:
    """The sum over all rows of part(x), a matrix of this shape for a batch x of rows of v. Tasks send their sums in blocks of rows, and blocks are added up in parallel."""

    def sums(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).astype(np.float64).reshape(b.num_rows, -1)
                total = part(x) if total is None else total + part(x)
        if total is not None:
            at = range(0, shape[0], block)
            yield pa.RecordBatch.from_arrays([pa.array(list(at)), pa.array([total[i : i + block].ravel() for i in at], pa.list_(pa.float64()))], names=["i", "g"])

    def added(t: pa.Table) -> pa.Table:
        g = np.asarray(t["g"].combine_chunks().flatten()).reshape(t.num_rows, -1).sum(0)
        return pa.Table.from_arrays([pa.array([t["i"][0].as_py()]), pa.array([g], pa.list_(pa.float64()))], names=["i", "g"])

    schema, out = "i long, g array<double>", np.zeros(shape)
    for r in vectors.where("v is not null").select("v").mapInArrow(sums, schema).groupBy("i").applyInArrow(added, schema).toLocalIterator():
        out[r.i : r.i + block] = np.array(r.g).reshape(-1, shape[1])
    return out


def dimensions(vectors: DataFrame, d: int, shares=(0.90, 0.95, 0.99)) -> list[int]:
    """Principal components that explain these shares of the variance; zeros for fewer than 2 rows or no variance.

    Up to WHOLE_WIDTH the driver gets d x d sums, whatever the rows. Beyond it, `leading_variances` finds as many components as the
    largest share takes, by a subspace that is widened until it has them.
    """
    moments = summed(vectors, lambda x: np.vstack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], float(len(x)))]), (3, d))
    n = moments[2, 0] if d else 0
    if n < 2:
        return [0] * len(shares)
    mean = moments[0] / n
    if d > WHOLE_WIDTH:
        return leading_variances(vectors, mean, int(n), shares)
    centred = summed(vectors, lambda x: (x - mean).T @ (x - mean), (d, d))
    variance = np.maximum(np.linalg.eigvalsh(centred)[::-1], 0)
    if variance.sum() <= 1e-20:
        return [0] * len(shares)
    return [int(np.searchsorted(np.cumsum(variance) / variance.sum(), s) + 1) for s in shares]


def leading_variances(vectors: DataFrame, mean: np.ndarray, n: int, shares, start: int = 64, rounds: int = 60, seed: int = 42) -> list[int]:
    """How many components explain each share, for vectors too long for a d x d matrix.

    Subspace iteration: an orthonormal basis of r directions is multiplied by the covariance, one pass over the rows each, and Rayleigh and Ritz's values are taken in it.
    Ritz values never exceed the variances, so a share that r of them reach is reached in truth. By the second-order estimate, with the residuals R = C Q - Q T, the
    first m variances sum to the first m Ritz values and |R|^2 over the gap behind them at most. A count is taken
    when the values reach the share with m and fall short with m - 1 by more than that. Until then the pass is repeated, and the basis is doubled if its values don't reach the largest
    share. The driver holds d x r numbers; r comes near d only where the variance is spread evenly.
    """
    d, rng = len(mean), np.random.default_rng(seed)
    sent = vectors.sparkSession.sparkContext.broadcast(mean)
    total = float(summed(vectors, lambda x: ((x - sent.value) ** 2).sum(0)[None, :], (1, d)).sum())
    if total <= 1e-20:
        return [0] * len(shares)
    most = min(d, n - 1)
    r = min(start, most)
    q = np.linalg.qr(rng.normal(size=(d, r)))[0]
    while True:
        for k in range(rounds):
            basis = vectors.sparkSession.sparkContext.broadcast(q)

            def times(x, basis=basis):
                y = x - sent.value
                return y.T @ (y @ basis.value)

            cq = summed(vectors, times, q.shape)
            values, turn = np.linalg.eigh(q.T @ cq)
            values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
            residual = np.linalg.norm(cq @ turn - (q @ turn) * values, axis=0)
            sums = np.cumsum(values) / total
            counts = [int(np.searchsorted(sums, s - 1e-12) + 1) for s in shares]
            if (r == most and k) or (counts[-1] <= r and _certain(values, residual, counts, shares, total)):
                return counts
            basis.unpersist()
            q = np.linalg.qr(cq)[0]
            if counts[-1] > r and k >= 3:
                break
        r = min(2 * r, most)
        q = np.linalg.qr(np.hstack([q, rng.normal(size=(d, r - q.shape[1]))]))[0]


def _certain(values: np.ndarray, residual: np.ndarray, counts: list[int], shares, total: float) -> bool:
    """Whether one component fewer than each count falls short of its share by more than the residuals allow."""
    for m, s in zip(counts, shares, strict=True):
        short = s * total - values[: m - 1].sum()
        if m == 1:
            continue
        # what is outside the first m - 1 of the basis has at most the next value and its residual
        gap = values[m - 2] - values[m - 1]
        norm = float((residual[: m - 1] ** 2).sum())
        if norm > 1e-24 * total * total and (gap <= 0 or norm / gap >= short):
            return False
    return True


def coverage(vectors: DataFrame, seed: int, sizes=SIZES) -> DataFrame:
    """(size, coverage): the mean over all rows of the best cosine with the first so many rows in seeded order.

    The reference set is at most max(sizes) rows and is sent to all tasks.
    """
    n = vectors.count()
    sizes = sorted(k for k in sizes if k < n)
    spark = vectors.sparkSession
    if n < 2:
        return spark.createDataFrame([], "size long, coverage double")
    whole = spark.createDataFrame([(n, 1.0)], "size long, coverage double")  # each row is its own best
    if not sizes:
        return whole
    first = vectors.orderBy(order_key(seed, F.col("id")), "id").limit(sizes[-1]).select("v").toArrow()
    ref = np.array(first["v"].to_pylist(), np.float64)
    ref = spark.sparkContext.broadcast(ref / (np.linalg.norm(ref, axis=1, keepdims=True) + 1e-12))

    def best(batches):
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, -1)
            if not len(x):
                continue
            s = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)) @ ref.value.T
            cells = [s[:, :k].max(axis=1).sum() for k in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(cells), pa.array([len(x)] * len(sizes), pa.int64())], names=["size", "s", "n"])

    part = vectors.select("v").mapInArrow(best, "size long, s double, n long").groupBy("size").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("coverage"))
    return part.unionByName(whole)


def _grown(moments: DataFrame, sizes: list[int]) -> DataFrame:
    """(repeat, size, pos, m, s): mean and deviation of each nested subset, from the moments (n, mean m, variance v) of the bands of rows that each size adds to the one before."""
    bands = moments.groupBy("repeat", "pos").agg(F.collect_list(F.struct("band", "n", "m", "v")).alias("b"))  # as many entries as sizes
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def joined(a: Column, b: Column) -> Column:
        """Count, mean and sum of squares about it, of two disjoint sets."""
        n, apart = a["n"] + b["n"], b["m"] - a["m"]
        return F.struct(n.alias("n"), (a["m"] + apart * b["n"] / n).alias("m"), (a["q"] + b["n"] * b["v"] + apart * apart * a["n"] * b["n"] / n).alias("q"))

    upto = lambda k: F.aggregate(F.filter("b", lambda b: b["band"] <= k), zero, joined)
    rows = bands.select("repeat", "pos", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("size"), upto(k).alias("a")) for k in sizes))).alias("x"))
    return rows.select("repeat", "x.size", "pos", F.col("x.a.m").alias("m"), F.sqrt(F.col("x.a.q") / F.col("x.a.n")).alias("s"))


def saturation(vectors: DataFrame, seed: int, sizes=SIZES, repeats: int = 5) -> DataFrame:
    """(size, mean_wave_nrmse, point_std_error, spectrum_relative_error): how far random subsets are from the whole, averaged over repeats; each repeat's subsets are nested, so each row is read once a repeat, in the band of the smallest subset it is in. The spectrum is the mean signature in 128 bands."""
    n = vectors.count()
    sizes = [k for k in sizes if k < n]
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "size long, mean_wave_nrmse double, point_std_error double, spectrum_relative_error double")
    x = vectors.select("id", F.col("v").cast("array<double>").alias("v")).withColumn("spectrum", W.spectral_signature(F.col("v")))
    ids = x.select("id", F.explode(F.array(*map(F.lit, range(repeats)))).alias("repeat")).withColumn("_key", F.concat_ws("|", F.col("repeat").cast("string"), F.col("id").cast("string")))
    chosen = stratum_rank(ids, "_key", ["repeat"], seed).where(F.col("_rank") <= max(sizes))
    band = F.array_min(F.filter(F.array(*(F.lit(k).cast("long") for k in sizes)), lambda k: k >= F.col("_rank")))
    taken = kept(chosen.select("id", "repeat", band.alias("band")).join(x, "id"))
    wave = lambda rows, c, *by: rows.select(*by, F.posexplode(c).alias("pos", "x")).groupBy(*by, "pos").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    full = {c: wave(x, c).select("pos", F.col("m").alias("fm"), F.sqrt("v").alias("fs")) for c in ("v", "spectrum")}
    both = {c: _grown(wave(taken, c, "repeat", "band"), sizes).join(F.broadcast(full[c]), "pos").groupBy("repeat", "size") for c in full}  # full has one row for each place
    scale = full["v"].agg((F.max("fm") - F.min("fm")).alias("a")).crossJoin(_range(x, n)).select(F.greatest("a", "scale", F.lit(1e-12)).alias("scale"))
    length = full["spectrum"].agg(F.greatest(F.sqrt(F.sum(F.col("fm") ** 2)), F.lit(1e-12)).alias("length"))
    off = (F.col("m") - F.col("fm")) ** 2
    errors = both["v"].agg(F.sqrt(F.avg(off)).alias("e"), F.avg(F.abs(F.col("s") - F.col("fs"))).alias("d")).join(both["spectrum"].agg(F.sqrt(F.sum(off)).alias("f")), ["repeat", "size"])
    out = errors.crossJoin(F.broadcast(scale)).crossJoin(F.broadcast(length)).groupBy("size")  # one row each
    made = {"mean_wave_nrmse": F.col("e") / F.col("scale"), "point_std_error": F.col("d") / F.col("scale"), "spectrum_relative_error": F.col("f") / F.col("length")}
    return out.agg(*(F.round(F.avg(v), 6).alias(k) for k, v in made.items()))


def robust_columns(vectors: DataFrame) -> DataFrame:
    """vectors with z: each place by its median and 1.4826 MAD (the deviation if the MAD is at most 1e-6), within -8 and 8."""
    long = vectors.select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", F.col("x").cast("double").alias("x"))
    n, half = vectors.count(), F.get("q", F.lit(0))
    centre = quantiles(long, ["pos"], F.col("x"), [0.5], F.stddev_pop("x").alias("sd"), most=n).select("pos", half.alias("med"), "sd")
    near = long.join(F.broadcast(centre), "pos")  # one row for each place
    mad = quantiles(near, ["pos"], F.abs(F.col("x") - F.col("med")), [0.5], most=n).select("pos", half.alias("mad"))
    scale = F.when(F.col("mad") > 1e-6, 1.4826 * F.col("mad")).otherwise(F.col("sd") + 1e-6)
    z = centre.join(mad, "pos").select("pos", "med", scale.alias("scale"))
    rows = z.agg(F.sort_array(F.collect_list(F.struct("pos", "med", "scale"))).alias("_z"))  # d entries
    out = vectors.crossJoin(F.broadcast(rows))
    return out.select(*vectors.columns, F.zip_with("v", "_z", lambda v, c: F.greatest(F.least((v.cast("double") - c["med"]) / c["scale"], F.lit(8.0)), F.lit(-8.0))).alias("z"))
