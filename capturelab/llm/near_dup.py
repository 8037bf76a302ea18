"""Near-duplicate documents: MinHash, banding, verification on full sets, connected components.

1. One pass over the text makes each document's set of 5-word shingles (64-bit hashes),
   a digest of the set, and 128 minima under random universal hash functions, folded to
   32 band keys of 4 minima and a 128-bit sketch (a bit of each minimum).
2. Documents with the same set form a class; from here on only classes count, so copies are
   never compared with each other.
3. In each band bucket every class is compared with the bucket's smallest class, after a
   check of sizes and sketches; links are confirmed on the full sets.
4. Components by alternating large-star and small-star.
5. A bucket that still holds several components has its remaining cross-component pairs
   compared: everyone against the members outside the bucket's main component. Documents of
   such buckets get a sketch of 1,024 bits, which rules out nearly all pairs that are
   merely alike, and a pair is taken up in the first bucket that it shares only. After
   that, no pair that shares a bucket is left untested, unless already connected.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75^4)^32 = 5e-6.
No text means no set, linked with nothing. A null doc_id takes part in nothing; its
component is null and it is kept. Rows that repeat a doc_id are one node, linked by any of its
texts: each row has its own set's size and the node's component. A text of any length is one
row of work; an empty table has no rows. Columns besides doc_id and text play no part, whatever
their names. A bucket's pairs are dealt over one task for every BUCKET_ROWS of its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, U, checkpoint, fresh, mix, pair_hash, ragged, read, word_chunks

WIDTH, ALIKE = 5, 75  # words in a shingle; percent of similarity that links
BANDS, ROWS = 32, 4
BROADCAST_PAIRS = 1_000_000  # 16 bytes each
BUCKET_ROWS = 1000
#: Two sketches of a pair at 0.75 agree in 112 of 128 bits on average, deviation 3.7; fewer than 90 is 5.9 deviations off.
AGREE = 90

#: Of the finer sketch's 1,024 bits 896 agree on average, deviation 10.6; fewer than 848 is 4.5 deviations off.
FINE, FINE_AGREE = 1024, 848


def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n universal hash functions a * x + b."""
    r = np.random.RandomState(seed)
    return (r.randint(0, 2**63 - 1, n, dtype=np.int64).astype(U) << U(1)) | U(1), r.randint(0, 2**63 - 1, n, dtype=np.int64).astype(U)


def shingle_sets(words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, one row after another; n + 1 offsets."""
    h, count, first = words.hash, words.count, words.first
    n = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    at = ragged(first[:-1], n)
    row = np.repeat(np.arange(len(count)), n)
    length = np.minimum(count, WIDTH)[row]
    key = np.zeros(len(at), U)
    for k in range(WIDTH):
        live = k < length
        step = pair_hash(key, h[np.minimum(at + k, max(len(h) - 1, 0))]) if len(at) else key
        key = np.where(live, step, key)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[keep], row[keep]
    return key, np.searchsorted(row, np.arange(len(count) + 1))


def minima(key: np.ndarray, edges: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper halves of the minima of a * x + b over each row's 32-bit shingle keys; empty rows get all ones."""
    out = np.full((len(edges) - 1, len(hashes[0])), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        x, starts = key >> U(32), edges[:-1][full]
        for j, (a, b) in enumerate(zip(*hashes, strict=True)):
            out[full, j] = (np.minimum.reduceat(x * a + b, starts) >> U(32)).astype(np.uint32)
    return out


def _bits(low: np.ndarray) -> np.ndarray:
    """A bit of each minimum, 64 to an integer."""
    return np.packbits((mix(low.astype(U)) & U(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)


def _sketches(batches):
    hashes = _hashes(BANDS * ROWS, 7)
    for b in batches:
        ids = b.column(0)
        for w in word_chunks(b.column(1), SPACED):
            key, edges = shingle_sets(w)
            low = minima(key, edges, hashes)
            raw = key.tobytes()
            digest = [hashlib.blake2b(raw[s * 8 : e * 8], digest_size=16).digest() if e > s else None for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            band = np.zeros((len(low), BANDS), U) + np.arange(BANDS, dtype=U)
            for k in range(ROWS):
                band = pair_hash(band, low[:, k::ROWS].astype(U))
            bits = _bits(low)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(w.lo, w.hi - w.lo),
                    pa.array(digest, pa.binary()),
                    pa.array(np.diff(edges).astype(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, band.size + 1, BANDS, dtype=np.int32), band.reshape(-1).view(np.int64)),
                    pa.array(bits[:, 0]),
                    pa.array(bits[:, 1]),
                ],
                names=["doc_id", "digest", "n", "bands", "s1", "s2"],
            )


def _fine_sketches(batches):
    hashes = _hashes(FINE, 8)
    for b in batches:
        for w in word_chunks(b.column(1), SPACED):
            bits = _bits(minima(*shingle_sets(w), hashes))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(w.lo, w.hi - w.lo), *(pa.array(x) for x in bits.T.copy())], names=["rep", *(f"f{i}" for i in range(bits.shape[1]))])


def _sets(keep: int):
    """A mapInArrow function: `keep` ids and a text become the ids and the text's set."""

    def run(batches):
        for b in batches:
            for w in word_chunks(b.column(keep), SPACED):
                key, edges = shingle_sets(w)
                ids = [b.column(i).slice(w.lo, w.hi - w.lo) for i in range(keep)]
                yield pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(edges.astype(np.int32), key.view(np.int64))], names=[*b.schema.names[:keep], "set"])

    return run


def _alike(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. Sets are made from the text again, for documents in pairs only; up to BROADCAST_PAIRS pairs go to the text, which then isn't shuffled."""
    near = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda x: x)
    right = docs.join(near(pairs), docs["doc_id"] == F.col("b")).select("a", "b", "text").mapInArrow(_sets(2), "a long, b long, set array<long>")
    left = docs.join(near(pairs.select("a").distinct()), docs["doc_id"] == F.col("a"), "left_semi").select(F.col("doc_id").alias("a"), "text").mapInArrow(_sets(1), "a long, set array<long>")
    both = right.withColumnRenamed("set", "set_b").join(left.withColumnRenamed("set", "set_a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return sized.where(100 * F.col("common") >= ALIKE * (F.col("total") - F.col("common"))).select("a", "b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    stars = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stars.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b); component is the smallest id that can be reached."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = checkpoint(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _sizes(x: str, y: str):
    """The set sizes of rows x and y allow a similarity of 0.75."""
    return F.least(f"{x}.n", f"{y}.n") * 100 >= ALIKE * F.greatest(f"{x}.n", f"{y}.n")


def _close(x: str, y: str):
    """Sizes and sketches of rows x and y allow a similarity of 0.75."""
    differ = F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1"))) + F.bit_count(F.col(f"{x}.s2").bitwiseXOR(F.col(f"{y}.s2")))
    return _sizes(x, y) & (differ <= 128 - AGREE)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    base = checkpoint(docs.mapInArrow(_sketches, "doc_id long, digest binary, n long, bands array<long>, s1 long, s2 long"))
    classes = checkpoint(base.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "bands", "s1", "s2"))))
    # a bucket of one class links nothing; only then do sizes and sketches join the rows
    buckets = classes.select(F.explode("bands").alias("bucket"), "rep")
    several = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    shared = checkpoint(buckets.join(several, "bucket", "left_semi").join(classes.select("rep", "n", "s1", "s2"), "rep"))
    head = shared.groupBy("bucket").agg(F.min(F.struct("rep", "n", "s1", "s2")).alias("head")).select("bucket", "head.*")
    x, y = shared.alias("x"), head.alias("y")
    tried = checkpoint(x.join(y, F.col("x.bucket") == F.col("y.bucket")).where((F.col("x.rep") > F.col("y.rep")) & _close("x", "y")).select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).distinct())
    # the classes of an id with several texts are one node
    texts = base.where("doc_id is not null").select("doc_id", F.coalesce("digest", F.lit(b"")).alias("d"))
    several_texts = checkpoint(texts.groupBy("doc_id").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high").select(F.col("doc_id").alias("id")))
    split = not several_texts.isEmpty()
    links = _alike(docs, tried)
    if split:
        reps = several_texts.join(base, F.col("id") == F.col("doc_id")).select("id", "digest").distinct().join(classes.select("digest", "rep"), "digest").select("id", "rep")
        links = links.unionByName(reps.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")))
    links = checkpoint(links)
    found = components(links)

    # pairs of a bucket that lie in different components and have not been tried
    placed = shared.join(found, F.col("rep") == F.col("id"), "left").select("bucket", "rep", "n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("bucket").agg(F.count("*").alias("several"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("top")).where("several > 1").select("bucket", F.col("top.component").alias("main"), F.ceil(F.col("all") / BUCKET_ROWS).alias("pieces"))
    mixed = checkpoint(placed.join(main, "bucket").select("bucket", "rep", "n", "component", "main", "pieces"))
    members = checkpoint(mixed.select(F.col("rep").alias("_rep")).distinct())
    near = F.broadcast if members.count() <= BROADCAST_PAIRS else (lambda d: d)
    words = [f"f{i}" for i in range(FINE // 64)]
    fine = docs.join(near(members), docs["doc_id"] == F.col("_rep"), "left_semi").select("doc_id", "text").mapInArrow(_fine_sketches, "rep long, " + ", ".join(f"{c} long" for c in words))
    mixed = mixed.join(fine, "rep").join(classes.select("rep", "bands"), "rep")
    x = mixed.withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces"))).alias("x")
    y = mixed.where("component <> main").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).alias("y")
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in words), F.lit(0))
    first = F.get(F.filter(F.col("x.bands"), lambda v, i: v == F.get(F.col("y.bands"), i)), 0)
    new = (F.col("x.component") != F.col("y.component")) & ((F.col("x.component") == F.col("x.main")) | (F.col("x.rep") < F.col("y.rep")))
    cross = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.piece") == F.col("y.piece")) & new & _sizes("x", "y") & (differ <= FINE - FINE_AGREE) & (first == F.col("x.bucket")))
    pairs = cross.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    more = checkpoint(_alike(docs, checkpoint(pairs.join(tried, ["a", "b"], "left_anti"))))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    known = classes.select("digest", "rep").join(found, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    rows = base.select("doc_id", "digest", "n").join(known, "digest", "left")
    if split:
        nodes = several_texts.join(found.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("whole"))
        rows = rows.join(nodes, F.col("doc_id") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(*(["whole"] if split else []), "component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; of rows with the same doc_id and text, one stays. Rows without doc_id stay. Rows of one doc_id with different texts are one node: they go or stay together. Columns besides doc_id and text are carried along, whatever their names."""
    (name,) = fresh(docs, "gone")
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    named = docs.where("doc_id is not null").join(gone, F.col("doc_id") == F.col(name), "left_anti").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))


#: DuckDB: every pair that shares a shingle, and reachability by repeated joins; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws)=0 THEN [] WHEN len(ws)<5 THEN [array_to_string(ws,' ')]
  ELSE list_distinct([array_to_string(ws[i:i+4],' ') FOR i IN range(1,len(ws)-3)]) END AS sh FROM w),
c AS (SELECT list_sort(sh) AS k, min(doc_id) AS rep FROM s WHERE len(sh)>0 GROUP BY 1),
e AS (SELECT rep, len(k) AS n, unnest(k) AS g FROM c),
rare AS (SELECT g FROM e GROUP BY g HAVING count(*)>1),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.g=b.g AND a.rep<b.rep JOIN rare r ON r.g=a.g GROUP BY ALL),
l AS (SELECT a,b FROM p WHERE 100*i >= 75*(na+nb-i)),
both_ways AS (SELECT a,b FROM l UNION ALL SELECT b,a FROM l),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b=t.a),
comp AS (SELECT a AS rep, min(b) AS comp FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id, coalesce(m.comp, s.doc_id)=s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.sh)=c.k LEFT JOIN comp m ON m.rep=c.rep
"""
