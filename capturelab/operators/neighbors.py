"""Nearest neighbours, exact by blocks or searched in cells, and what they say about each vector."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .quantiles import quantiles
from .splits import order_key

FOUND = "id long, neighbour long, similarity double"


#: Rows of a block at most once there are 16 blocks; rows of a cell's questions that are compared together; products that are held at once; pairs compared in doubles at once.
WIDEST, RUN, TILE, PAIRS = 1 << 15, 128, 1 << 21, 1 << 15


def _similar(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The similarity of each row of a to the same row of b."""
    if metric == "cosine":
        return np.round(np.einsum("ij,ij->i", a, b), 9)
    apart = a - b
    return -np.round(np.sqrt(np.einsum("ij,ij->i", apart, apart) / max(a.shape[1], 1)), 9)


def _singles(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, slack) in single precision: x @ y.T orders the rows of b for each of a as similarity does, but for differences up to slack, which covers rounding."""
    width = a.shape[1]
    if metric == "cosine":
        return a.astype(np.float32), b.astype(np.float32), np.full(len(a), (width + 8) * 2.0**-23 + 4e-9)
    middle = b.mean(0) if len(b) else 0
    a, b = a - middle, b - middle
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    scale = 2.0 ** -np.ceil(np.log2(top)) if top > 0 else 1.0
    a, b = a * scale, b * scale
    size, half = np.linalg.norm(a, axis=1), (b * b).sum(1) / 2
    most = np.sqrt(2 * half.max(initial=0))
    slack = (width + 8) * 2.0**-23 * most * (size + most) + 4e-9 * scale * math.sqrt(width) * (size + most) + width * 1e-17 * scale * scale
    return np.column_stack([a, np.ones(len(a))]).astype(np.float32), np.column_stack([b, -half]).astype(np.float32), slack


def _near(a: np.ndarray, b: np.ndarray, mine: np.ndarray, others: np.ndarray, k: int, metric: str, singles: tuple | None = None) -> list[np.ndarray]:
    """(id, neighbour, similarity) of the k best rows of b for each row of a, by similarity, then by id, without the row of the same id. All rows are finite.

    Products in single precision are reduced to maxima by segment; the (k + 1)-th greatest of these bounds what can be among the best. The few pairs above that
    bound, less what rounding can move, are compared in doubles.
    """
    x, y, slack = singles or _singles(a, b, metric)
    m, found = len(b), [[], [], []]
    wide = max(4 * (k + 1), 512)
    deep = m // wide if m >= 2 * wide else 1
    if deep == 1:
        wide = m
    whole = wide * deep
    step = max(1, TILE // max(m, 1))
    for lo in range(0, len(a) if m else 0, step):
        part = x[lo : lo + step]
        s, rest = (part @ y[:whole].T).reshape(len(part), deep, wide), part @ y[whole:].T
        seg = np.concatenate([s.max(axis=1), rest], axis=1)
        last = max(seg.shape[1] - k - 1, 0)
        bound = np.partition(seg, last, axis=1)[:, last] - slack[lo : lo + step]
        row, at = np.nonzero(seg >= bound[:, None])
        deeper = at < wide
        r, g = row[deeper], at[deeper]
        hit, level = np.nonzero(s[r, :, g] >= bound[r][:, None])
        row, col = np.concatenate([r[hit], row[~deeper]]), np.concatenate([level * wide + g[hit], at[~deeper] - wide + whole])
        own = mine[lo + row] == others[col]
        row, col = lo + row[~own], col[~own]
        value = np.concatenate([np.zeros(0), *(_similar(a[row[i : i + PAIRS]], b[col[i : i + PAIRS]], metric) for i in range(0, len(row), PAIRS))])
        order = np.lexsort((others[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        best = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
        for c, part in zip(found, (mine[row[best]], others[col[best]], value[best]), strict=True):
            c.append(part)
    return [np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(found, (np.int64, np.int64, np.float64), strict=True)]


def _block_rows(n: int, least: int) -> int:
    """Rows of a block: `least` up to 16 blocks, then a sixteenth of all up to WIDEST. So blocks stay few and bounded."""
    return max(least, min(WIDEST, -(-n // 16)))


def _matrix(v, rows: int, metric: str) -> np.ndarray:
    """The vectors of an Arrow column, of length 1 for cosine."""
    v = np.asarray((v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).flatten()).astype(np.float64).reshape(rows, -1 if rows else 0)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v


def _placed(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def nearest(vectors: DataFrame, k: int, block_rows: int = 2048, metric: str = "cosine") -> DataFrame:
    """(id, neighbour, similarity, place): the k most similar other vectors of every vector by cosine, or by metric `rms` (the negated root mean square of differences); of equals, the smaller id. Null vectors are left out.

    vectors: id long, v array<float>. Rows are dealt to blocks by a hash of the id; every two blocks meet once, in one
    task, which keeps k candidates a row of both, and the candidates of a row are then merged. Blocks have block_rows rows in a small collection and WIDEST at most. The work is quadratic, in products of single precision; only pairs that these can't rule out are compared in doubles. `probed` is for large collections.
    """
    vectors = vectors.where("v is not null")
    n = vectors.count()
    blocks = max(1, -(-n // _block_rows(n, block_rows)))
    dealt = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    other = dealt.select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    met = other.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("side"), "id", "v")

    def best(t: pa.Table) -> pa.Table:
        ids, side = np.asarray(t["id"]), np.asarray(t["side"])
        v = _matrix(t["v"], len(ids), metric)
        sound = np.isfinite(v).all(axis=1)
        a, b = np.flatnonzero(sound & ~side), np.flatnonzero(sound & side)
        ways = [(a, a)] if t["i"][0] == t["j"][0] else [(a, b), (b, a)]
        found = [_near(v[x], v[y], ids[x], ids[y], k, metric) for x, y in ways]
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["id", "neighbour", "similarity"])

    return _placed(met.groupBy("i", "j").applyInArrow(best, FOUND), k)


#: Rows whose distances to all centres are held at once.
STEP = 1024


def _apart(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (v @ c.T), 0))


def _home(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each vector, its nearest centre."""
    return np.concatenate([np.zeros(0, np.int64), *(_apart(v[i : i + STEP], c).argmin(1) for i in range(0, len(v), STEP))])


def sound(vectors: DataFrame) -> DataFrame:
    """(id long, v array<float>) of the vectors that can have neighbours: not null, and of finite numbers."""
    endless = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).where(F.col("v").isNotNull() & ~endless)


def centres(vectors: DataFrame, cells: int, metric: str = "cosine", sample: int = 65536, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """So many centres, by rounds of k-means on the driver over a bounded sample: the first rows in seeded order, at most `sample` and 64 for a cell."""
    t = vectors.where("v is not null").orderBy(order_key(seed, F.col("id")), "id").limit(min(sample, 64 * cells)).select("v").toArrow()
    x = _matrix(t["v"], t.num_rows, metric)
    c = x[:cells].copy()
    for _ in range(rounds if len(x) else 0):
        home = _home(x, c)
        sums, n = np.zeros_like(c), np.bincount(home, minlength=len(c))
        np.add.at(sums, home, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fewest_probes(vectors: DataFrame, c: np.ndarray, k: int, recall: float, metric: str = "cosine", questions: int = 256, seed: int = 42) -> int:
    """In how many cells a vector must ask to find this share of its k neighbours: measured on the exact neighbours, among all rows, of the first so many rows in seeded order."""
    t = vectors.orderBy(order_key(seed + 1, F.col("id")), "id").limit(questions).select("id", "v").toArrow()
    if not t.num_rows:
        return 1
    sent = vectors.sparkSession.sparkContext.broadcast((np.asarray(t["id"]), _matrix(t["v"], t.num_rows, metric), c))  # of bounded size

    def best(batches):
        names, q, c = sent.value
        for b in batches:
            ids, v = np.asarray(b.column(0)), _matrix(b.column(1), b.num_rows, metric)
            found = _near(q, v, names, ids, k, metric)
            order = np.argsort(ids, kind="stable")
            at = order[np.searchsorted(ids[order], found[1])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(_home(v, c)[at].astype(np.int32))], names=["id", "neighbour", "similarity", "cell"])

    rows = _placed(vectors.select("id", "v").mapInArrow(best, FOUND + ", cell int"), k).select("id", "cell").collect()  # questions x k rows
    place = {i: np.argsort(np.argsort(d, kind="stable")) for i, d in zip(sent.value[0].tolist(), _apart(sent.value[1], c), strict=True)}
    asked = sorted(int(place[r.id][r.cell]) for r in rows)
    return asked[math.ceil(recall * len(asked)) - 1] + 1 if asked else 1


def _packed(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block of each cell, in how many it lies, blocks): cells that fit share a block, a crowded one is dealt to several."""
    most = _block_rows(int(sizes.sum()), block_rows)
    first, parts, block, held = np.zeros(len(sizes), np.int64), -(-sizes // most), -1, most
    for c in np.flatnonzero(sizes).tolist():
        if held + sizes[c] > most:
            block, held = block + 1, 0
        first[c], held = block, held + sizes[c]
        if parts[c] > 1:
            block, held = block + int(parts[c]) - 1, most
    return first, parts, block + 1


def in_blocks(vectors: DataFrame, c: np.ndarray, metric: str, block_rows: int, probes: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The vectors, written, with cell, off (the distance to its centre), bound (the distance of the `probes`-th nearest centre, if asked for) and block; whether cells lie in blocks (cells x blocks); the greatest `off` by cell."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(c)  # at most 4,096 centres

    def dealt(batches):
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                d = _apart(_matrix(part.column(1), part.num_rows, metric), sent.value)
                home = d.argmin(1)
                bound = np.partition(d, probes - 1, axis=1)[:, probes - 1] if probes else np.zeros(len(d))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home]), pa.array(bound)], names=["id", "v", "cell", "off", "bound"])

    x = kept(vectors.mapInArrow(dealt, "id long, v array<float>, cell int, off double, bound double"))
    n, radius = np.zeros(len(c), np.int64), np.full(len(c), -np.inf)
    for r in x.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect():  # at most 4,096 rows
        n[r.cell], radius[r.cell] = r.n, r.radius
    first, parts, blocks = _packed(n, block_rows)
    lies = np.zeros((len(c), blocks), np.float32)
    for cell in np.flatnonzero(n).tolist():
        lies[cell, first[cell] : first[cell] + parts[cell]] = 1
    place = spark.createDataFrame(list(zip(range(len(c)), first.tolist(), parts.tolist(), strict=True)), "cell int, first long, parts long")
    block = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    return x.join(F.broadcast(place), "cell").select("id", "v", "cell", "off", "bound", block.alias("block")), lies, radius


def searched(lying: DataFrame, c: np.ndarray, lies: np.ndarray, asks, k: int, metric: str, narrow: bool = False) -> DataFrame:
    """(id, neighbour, similarity, compared) by block: the k best of each vector in the cells that it asks, with how many rows it was compared there.

    asks(d, home, off, bound, cells): which of these cells (d: the distances to their centres) each vector asks. A vector goes once to each block that has such a cell. There
    the vectors of one home, some at a time, are compared with all cells that any of them asks; if `narrow`, with rows only whose distance to the centre is within a bound of an asker's.
    """
    sent = lying.sparkSession.sparkContext.broadcast((c, lies))

    def routed(vectors: bool):
        def route(batches):
            c, lies = sent.value
            for b in batches:
                for lo in range(0, b.num_rows, STEP):
                    part = b.slice(lo, STEP)
                    home, off, bound, block = (np.asarray(part.column(x)) for x in ("cell", "off", "bound", "block"))
                    d = _apart(_matrix(part.column("v"), part.num_rows, metric), c)
                    row, to = np.nonzero(asks(d, home, off, bound, np.arange(len(c))).astype(np.float32) @ lies > 0)
                    if vectors:
                        row, to = pa.array(row), pa.array(to.astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(block).take(row), to, *(part.column(x).take(row) for x in ("id", "v", "cell", "off", "bound"))], names=["i", "j", "id", "v", "cell", "off", "bound"])
                    else:
                        pairs = np.unique(np.column_stack([block[row], to]).astype(np.int32), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["i", "j"])

        return route

    pairs = kept(lying.mapInArrow(routed(False), "i int, j int").distinct())  # blocks x blocks rows
    asking = lying.mapInArrow(routed(True), "i int, j int, id long, v array<float>, cell int, off double, bound double").withColumn("asks", F.lit(True))
    there = lying.join(F.broadcast(pairs), F.col("block") == F.col("j")).select("i", "j", "id", "v", "cell", "off", "bound", F.lit(False).alias("asks"))

    def best(t: pa.Table) -> pa.Table:
        c = sent.value[0]
        ids, asking, cell, off, bound = (np.asarray(t[x]) for x in ("id", "asks", "cell", "off", "bound"))
        v = _matrix(t["v"], len(ids), metric)
        sound = np.isfinite(v).all(axis=1)
        a, b = np.flatnonzero(sound & asking), np.flatnonzero(sound & ~asking)
        a, b = a[np.lexsort((ids[a], off[a], cell[a]))], b[np.lexsort((ids[b], off[b], cell[b]))]
        there = v[b]
        x, y, slack = _singles(v[a], there, metric)
        cells, starts = np.unique(cell[b], return_index=True)
        ends = np.r_[starts[1:], len(b)]
        found = [[], [], [], []]
        homes, begin = np.unique(cell[a], return_index=True)
        for h, until in zip(begin.tolist(), np.r_[begin[1:], len(a)].tolist(), strict=True):
            for lo in range(h, until, RUN):
                run = slice(lo, min(lo + RUN, until))
                q = a[run]
                d = _apart(v[q], c[cells])
                wanted = asks(d, cell[q], off[q], bound[q], cells)
                spans = []
                for n in np.flatnonzero(wanted.any(axis=0)).tolist():
                    low, high = int(starts[n]), int(ends[n])
                    if narrow:
                        w = wanted[:, n]
                        inside = off[b[low:high]]
                        low, high = low + int(np.searchsorted(inside, (d[w, n] - bound[q][w]).min())), low + int(np.searchsorted(inside, (d[w, n] + bound[q][w]).max(), "right"))
                    if high > low:
                        spans.append(np.arange(low, high))
                if not spans:
                    continue
                at = np.concatenate(spans)
                every = len(at) == len(b)
                near = _near(v[q], there if every else there[at], ids[q], ids[b if every else b[at]], k, metric, (x[run], y if every else y[at], slack[run]))
                once = np.r_[True, near[0][1:] != near[0][:-1]][: len(near[0])]
                for to, part in zip(found, (*near, np.where(once, len(at), 0)), strict=True):
                    to.append(part)
        kinds = (np.int64, np.int64, np.float64, np.int64)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind)) for x, kind in zip(found, kinds, strict=True)], names=["id", "neighbour", "similarity", "compared"])

    return asking.unionByName(there).groupBy("i", "j").applyInArrow(best, FOUND + ", compared long")


def probed(vectors: DataFrame, k: int, probes: int | None = None, recall: float = 0.95, cells: int | None = None, block_rows: int = 2048, metric: str = "cosine", seed: int = 42) -> DataFrame:
    """`nearest`, searched for only in the cells of the `probes` nearest centres, so some neighbours may be missing. Unless given, probes are the fewest that find this share of the neighbours of 256 rows; as many as cells find all.

    There are about sqrt(rows) cells, at most 4,096. Every vector lies in one cell and asks in several; those of one home that are asked together share their
    answers' cells. Cells lie in blocks of bounded size, a crowded one in several, and a vector goes once to a block, however many of its cells it asks.
    """
    vectors = sound(vectors)
    if cells is None:
        cells = min(4096, max(1, round(math.sqrt(vectors.count()))))
    c = centres(vectors, cells, metric, seed=seed)
    probes = min(probes or fewest_probes(vectors, c, k, recall, metric, seed=seed), len(c))
    if not probes:
        return vectors.sparkSession.createDataFrame([], FOUND + ", place int")
    lying, lies, _ = in_blocks(vectors, c, metric, block_rows, probes)

    def asks(d, home, off, bound, cells):
        return (d <= bound[:, None] + 1e-9 * (1 + bound[:, None])) | (home[:, None] == cells[None, :])

    return _placed(searched(lying, c, lies, asks, k, metric).drop("compared"), k)


def profiles(near: DataFrame) -> DataFrame:
    """(id, nearest, radius): the distances of the first and of the last neighbour of `nearest` by rms."""
    return near.groupBy("id").agg(F.round(F.min(-F.col("similarity")), 6).alias("nearest"), F.round(F.max(-F.col("similarity")), 6).alias("radius"))


def categories(near: DataFrame, labels: DataFrame, one: float = 1.0) -> DataFrame:
    """Each vector's share of neighbours with its own label and its category. isolated (the k-th distance beyond Q3 + 3 IQR of its label) wins over typical, boundary and other-dominated. A distance is `one` less the similarity: 1 for cosine, 0 for rms."""
    mine, other = labels.select("id", "label"), labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    x = near.join(mine, "id").join(other, "neighbour")
    # written once: fences, join and any sort read it from there
    rows = kept(x.groupBy("id", "label").agg(F.avg((F.col("label") == F.col("other")).cast("int")).alias("own"), F.max(F.lit(one) - F.col("similarity")).alias("radius")))
    high, low = F.get("q", F.lit(1)), F.get("q", F.lit(0))
    fences = quantiles(rows, ["label"], F.col("radius"), [0.25, 0.75], most=labels.count()).select(F.col("label").alias("_label"), (high + 3 * (high - low)).alias("fence"))
    fenced = rows.join(fences, F.col("label").eqNullSafe(F.col("_label")))
    kind = F.when(F.col("radius") > F.col("fence"), "isolated").when(F.col("own") >= 0.8, "typical").when(F.col("own") >= 0.5, "boundary").otherwise("other_dominated")
    return fenced.select("id", "label", F.round("own", 6).alias("own_fraction"), F.round("radius", 6).alias("radius"), kind.alias("category"))


def point_statistics(signals: DataFrame) -> DataFrame:
    """Mean, deviation and quantiles of all signals at each place."""
    signals = signals.where("v is not null")
    long = signals.select(F.posexplode("v").alias("pos", "x")).select("pos", F.col("x").cast("double").alias("x"))
    made = quantiles(long, ["pos"], F.col("x"), [0.05, 0.95], F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), most=signals.count())
    return made.select("pos", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), F.round(F.get("q", F.lit(0)), 6).alias("p05"), F.round(F.get("q", F.lit(1)), 6).alias("p95"))
