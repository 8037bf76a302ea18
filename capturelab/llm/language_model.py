"""A bigram language model by deleted interpolation, and the scores of every text.

P(w | u) = a_b P2(w | u) + b_b P1(w) + c_b / (V + 1), where P2 and P1 are maximum-likelihood
estimates and the three weights depend on the bucket b of u's frequency (by powers of two).
The weights are learned by expectation-maximisation on counts that the estimates leave
out: the fold DELETED of the training documents. Scoring then uses counts of all training
documents with those weights.

Counting works on blocks, about BLOCK_TOKENS tokens of documents of one role (estimation,
deleted fold, scored only). A block's distinct n-grams go, with their counts, to the task
that owns their hash range; it adds the counts of all blocks and sends each block the
totals of its own n-grams. A frequent n-gram is therefore one entry a block, never a row a
token, and no task or driver holds the table. The number of ranges follows the corpus. Beyond
COARSE of them the exchange has two levels: the blocks of a group first add up their counts in
coarse ranges, and only the groups' sums go to the fine ranges within, so that rows never
shrink to a few keys and their number grows with the tokens, not with their square. For EM the deleted fold's tokens are counted in cells of bucket and estimates (four to an
octave, with means), a table of bounded size.

Null text is empty text, one end token. A row without doc_id is scored but not learned from,
and is not held out. With nothing to learn from, every token has the uniform share. Repeated rows
count and are scored as often as they occur; an empty table has no rows. A text of any length is
scored whole. Columns besides doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, U, checkpoint, crc_bucket, pair_hash, read, word_chunks

FOLDS, HELD_OUT, DELETED = 7, 2, 3
BLOCK_TOKENS, RANGE_KEYS, LEAST_RANGES = 2_000_000, 2_000_000, 32
#: The most ranges that one block's n-grams are dealt to, and the blocks of a group where there are more ranges.
COARSE, GROUP = 1024, 512
#: A bigram's key has this many bits more than the number of tokens, so that at any size one key in two million shares its counts with another. Words have 64 bits.
SPARE_BITS = 21
BUCKETS, PER_OCTAVE, ROUNDS = 24, 4, 40
END, START = U(0x0123456789ABCDEF), U(0xFEDCBA9876543210)
ESTIMATE, FOLD, SCORE = 0, 1, 2  # roles


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_index(x: np.ndarray) -> bytes:
    """Small int32 values, their first bytes together, then their second bytes, and so on."""
    return pack(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T))


def unpack_index(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).reshape(-1).view(np.int32)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences, their first bytes together, then their second bytes, and so on."""
    step = np.diff(x, prepend=U(0))
    return pack(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(U), dtype=U)


def _block(block: int, role: int, ids: list, counts: list, hashes: list) -> pa.RecordBatch:
    n = np.concatenate(counts)
    token = np.full(int(n.sum()) + len(n), END)
    keep = np.ones(len(token), bool)
    keep[np.cumsum(n + 1) - 1] = False
    token[keep] = np.concatenate(hashes)
    vocabulary, index = np.unique(token, return_inverse=True)
    columns = [pa.array([block]), pa.array([role], pa.int32()), pa.array([len(token)]), pa.array([[x for part in ids for x in part.to_pylist()]], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in (pack((n + 1).astype(np.int32)), pack_sorted(vocabulary), pack_index(index.astype(np.int32))))], names=["block", "role", "tokens", "ids", "lengths", "vocabulary", "index"])


def _blocks(batches):
    made, open_ = TaskContext.get().partitionId() << 32, {r: ([], [], []) for r in (ESTIMATE, FOLD, SCORE)}
    for b in batches:
        roles = np.asarray(b.column(2))
        for w in word_chunks(b.column(1), SPACED):
            role, ids = roles[w.lo : w.hi], b.column(0).slice(w.lo, w.hi - w.lo)
            by_word = np.repeat(role, w.count)
            for r, (own_ids, counts, hashes) in open_.items():
                if (mine := role == r).any():
                    own_ids.append(ids.filter(pa.array(mine)))
                    counts.append(w.count[mine])
                    hashes.append(w.hash[by_word == r])
                    if sum(map(len, hashes)) + sum(map(len, counts)) >= BLOCK_TOKENS:
                        yield _block(made, r, own_ids, counts, hashes)
                        made, open_[r] = made + 1, ([], [], [])
    for r, (own_ids, counts, hashes) in open_.items():
        if counts:
            yield _block(made, r, own_ids, counts, hashes)
            made += 1


class Tokens:
    """A block's tokens and bigrams: the sorted distinct keys, and each token's place among them."""

    def __init__(self, bits: int, lengths: bytes, vocabulary: bytes, index: bytes):
        self.lengths = unpack(lengths, np.int32).astype(np.int64)
        self.one, self.word = unpack_sorted(vocabulary), unpack_index(index)
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.empty(len(self.word), np.int64)
        before[1:] = self.word[:-1]
        self.end = int(np.searchsorted(self.one, END))
        before[self.first] = self.end  # as often as a text ends, one starts
        self.before = before
        left = self.one[before]
        left[self.first] = START
        self.two, self.pair = np.unique(pair_hash(left, self.one[self.word]) >> U(64 - bits), return_inverse=True)


def _part(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Ranges of keys of so many bits, in their order."""
    return ((keys >> U(bits - 32)) * U(parts) >> U(32)).astype(np.int64)


def _requests(parts: int, bits: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, role, _, _, *blobs = (c[i].as_py() for c in b.columns)
                t = Tokens(bits, *blobs)
                sides = []
                for keys, places, wide in ((t.one, t.word, 64), (t.two, t.pair, bits)):
                    sides.append((keys, np.bincount(places, minlength=len(keys)).astype(np.uint32), np.searchsorted(_part(keys, wide, parts), np.arange(parts + 1))))
                live = [p for p in range(parts) if any(e[p + 1] > e[p] for _, _, e in sides)]
                columns = [pa.array([how(x[e[p] : e[p + 1]]) for p in live], pa.binary()) for k, n, e in sides for how, x in ((pack_sorted, k), (pack, n))]
                yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([block] * len(live), pa.int64()), pa.array([role] * len(live), pa.int32()), *columns], names=["part", "block", "role", "one", "n_one", "two", "n_two"])

    return run


class Sums:
    """The distinct keys of some rows of a range, each row's places among them, and their counts in all training rows and in those of estimation."""

    def __init__(self, keys: list[np.ndarray], every: list[np.ndarray], kept: list[np.ndarray]):
        self.edges = np.cumsum([0, *map(len, keys)])
        self.keys, self.place = np.unique(np.concatenate(keys), return_inverse=True)
        self.every, self.kept = (np.bincount(self.place, np.concatenate(n), len(self.keys)) for n in (every, kept))

    @classmethod
    def of_blocks(cls, table: pa.Table, name: str) -> Sums:
        role, keys = table["role"].to_pylist(), [unpack_sorted(x) for x in table[name].to_pylist()]
        n = [unpack(x, np.uint32).astype(np.float64) for x in table[f"n_{name}"].to_pylist()]
        return cls(keys, [x * (r != SCORE) for x, r in zip(n, role, strict=True)], [x * (r == ESTIMATE) for x, r in zip(n, role, strict=True)])

    def own(self, i: int) -> np.ndarray:
        return self.place[self.edges[i] : self.edges[i + 1]]


def _answers(table: pa.Table, sums: dict[str, tuple[Sums, np.ndarray, np.ndarray]], vocabulary: int) -> pa.Table:
    """A row for every block that asked, aligned with its keys; the fold also gets what estimation alone counts."""
    role, out = table["role"].to_pylist(), []
    for s, every, kept in sums.values():
        out.append(pa.array([pack(every[s.own(i)].astype(np.uint32)) for i in range(len(role))], pa.binary()))
        out.append(pa.array([pack(kept[s.own(i)].astype(np.uint32)) if r == FOLD else b"" for i, r in enumerate(role)], pa.binary()))
    known = np.zeros(len(role), np.int64)
    known[:1] = vocabulary
    return pa.Table.from_arrays([table["block"], table["part"], table["role"], *out, pa.array(known)], names=["block", "part", "role", "one", "one_kept", "two", "two_kept", "vocabulary"])


def _totals(table: pa.Table) -> pa.Table:
    """Adds up a range's counts."""
    sums = {k: Sums.of_blocks(table, k) for k in ("one", "two")}
    return _answers(table, {k: (s, s.every, s.kept) for k, s in sums.items()}, int((sums["one"].every > 0).sum()))


ANSWER = "block long, part int, role int, one binary, one_kept binary, two binary, two_kept binary, vocabulary long"
FINE = "fine long, part int, crowd long, " + ", ".join(f"{k} binary, {k}_every binary, {k}_kept binary" for k in ("one", "two"))


def _group_sums(fine: int, coarse: int, bits: int):
    """A group's sums in a coarse range, dealt to its fine ranges."""

    def run(table: pa.Table) -> pa.Table:
        part, columns = table["part"][0].as_py(), []
        for name, wide in (("one", 64), ("two", bits)):
            s = Sums.of_blocks(table, name)
            edge = np.searchsorted(_part(s.keys, wide, coarse * fine), part * fine + np.arange(fine + 1))
            columns += [pa.array([how(x[edge[f] : edge[f + 1]]) for f in range(fine)], pa.binary()) for how, x in ((pack_sorted, s.keys), (pack, s.every.astype(np.uint64)), (pack, s.kept.astype(np.uint64)))]
        same = lambda x, kind: pa.array([x] * fine, kind)
        return pa.Table.from_arrays([pa.array(part * fine + np.arange(fine)), same(part, pa.int32()), same(table["crowd"][0].as_py(), pa.int64()), *columns], names=[x.split()[0] for x in FINE.split(", ")])

    return run


TOTAL = "fine long, part int, crowd long, one_every binary, one_kept binary, two_every binary, two_kept binary, vocabulary long"


def _fine_totals(table: pa.Table) -> pa.Table:
    """Adds up a fine range's sums over all groups; a row for every group that asked."""
    n, out, known = table.num_rows, [], 0
    for name in ("one", "two"):
        every, kept = ([unpack(x, np.uint64).astype(np.float64) for x in table[f"{name}_{k}"].to_pylist()] for k in ("every", "kept"))
        s = Sums([unpack_sorted(x) for x in table[name].to_pylist()], every, kept)
        known = int((s.every > 0).sum()) if name == "one" else known
        out += [pa.array([pack(x[s.own(i)].astype(np.uint64)) for i in range(n)], pa.binary()) for x in (s.every, s.kept)]
    vocabulary = np.zeros(n, np.int64)
    vocabulary[:1] = known
    return pa.Table.from_arrays([table["fine"], table["part"], table["crowd"], *out, pa.array(vocabulary)], names=[x.split()[0] for x in TOTAL.split(", ")])


def _group_answers(asked: pa.Table, totals: pa.Table) -> pa.Table:
    """A group's totals in a coarse range, sent to its blocks."""
    if not asked.num_rows or not totals.num_rows:
        return _answers(asked.slice(0, 0), {k: (Sums([np.zeros(0, U)], [np.zeros(0)], [np.zeros(0)]), np.zeros(0), np.zeros(0)) for k in ("one", "two")}, 0)
    order, sums = np.argsort(np.asarray(totals["fine"])), {}
    for name in ("one", "two"):
        every, kept = (np.concatenate([unpack(x, np.uint64) for x in totals[f"{name}_{k}"].take(order).to_pylist()]) for k in ("every", "kept"))
        sums[name] = Sums.of_blocks(asked, name), every, kept
    return _answers(asked, sums, sum(totals["vocabulary"].to_pylist()))


def totals(blocks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """The training counts of every block's n-grams."""
    coarse = min(ranges, COARSE)
    fine = math.ceil(ranges / coarse)
    asked = blocks.mapInArrow(_requests(coarse, bits), "part int, block long, role int, one binary, n_one binary, two binary, n_two binary")
    if fine == 1:
        return asked.groupBy("part").applyInArrow(_totals, ANSWER)
    crowds = math.ceil(blocks.count() / GROUP)
    asked = checkpoint(asked.withColumn("crowd", F.pmod(F.xxhash64("block"), F.lit(crowds))))
    sums = asked.groupBy("crowd", "part").applyInArrow(_group_sums(fine, coarse, bits), FINE)
    added = checkpoint(sums.groupBy("fine").applyInArrow(_fine_totals, TOTAL))
    return asked.groupBy("crowd", "part").cogroup(added.groupBy("crowd", "part")).applyInArrow(_group_answers, ANSWER)


def _joined(answers: pa.Table, suffix: str) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(np.asarray(answers["part"]))
    return tuple(np.concatenate([unpack(x, np.uint32) for x in answers[f"{k}{suffix}"].take(order).to_pylist()]).astype(np.float64) for k in ("one", "two"))


def _estimates(t: Tokens, one: np.ndarray, two: np.ndarray, total: int):
    """Bucket of the context, P1 and P2 of every token."""
    context = one[t.before]
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return bucket, one[t.word] / max(total, 1), two[t.pair] / np.maximum(context, 1)


def _cells(bits: int, total: int, uniform: float):
    """Counts the deleted fold's tokens by bucket and estimates."""

    def level(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 1 + np.maximum(0, np.floor(PER_OCTAVE * np.log2(np.maximum(p, 1e-300) / uniform)) + 64), 0).astype(np.int64)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [np.zeros(0)] * 4
        if block.num_rows and answers.num_rows:
            t = Tokens(bits, *(block[c][0].as_py() for c in ("lengths", "vocabulary", "index")))
            bucket, p1, p2 = _estimates(t, *_joined(answers, "_kept"), total)
            cell, place = np.unique((bucket << 40) | (level(p1) << 20) | level(p2), return_inverse=True)
            rows = [cell, *(np.bincount(place, x, len(cell)) for x in (np.ones(len(place)), p1, p2))]
        return pa.Table.from_arrays([pa.array(rows[0].astype(np.int64)), *(pa.array(x.astype(np.float64)) for x in rows[1:])], names=["cell", "n", "p1", "p2"])

    return run


def interpolation_weights(cells: list[tuple[int, float, float, float]], uniform: float) -> np.ndarray:
    """Weights (P2, P1, uniform) of each bucket by EM; a bucket with few held-out tokens is drawn to the pooled weights."""
    bucket = np.array([c >> 40 for c, *_ in cells], np.int64)
    n = np.array([x[1] for x in cells])
    p = np.array([[p2 / k, p1 / k, uniform] for _, k, p1, p2 in cells]).reshape(-1, 3)

    def fit(n, p, prior, strength):
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p * w
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            w = (share * n[:, None]).sum(0) + prior * strength
            w /= w.sum()
        return w

    pooled = fit(n, p, np.full(3, 1 / 3), 1.0) if len(n) else np.full(3, 1 / 3)
    out = np.array([fit(n[bucket == b], p[bucket == b], pooled, 20.0) for b in range(BUCKETS)])
    out[0] = [0, out[0, 1], out[0, 2]]  # an unseen context has no P2
    return np.maximum(out, 1e-9 * (np.arange(3) == 2)) / np.maximum(out, 1e-9 * (np.arange(3) == 2)).sum(1, keepdims=True)


def _scores(bits: int, total: int, vocabulary: int, weights: np.ndarray):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, columns = pa.array([], pa.int64()), [np.zeros(0)] * 4
        if block.num_rows and answers.num_rows:
            t = Tokens(bits, *(block[c][0].as_py() for c in ("lengths", "vocabulary", "index")))
            one, two = _joined(answers, "")
            bucket, p1, p2 = _estimates(t, one, two, total)
            w = weights[bucket] if total else np.array([[0.0, 0.0, 1.0]])
            score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1))
            base = np.log10((one[t.word] + 1) / (total + vocabulary + 1))
            ids = block["ids"].combine_chunks().flatten()
            columns = [t.lengths, *(np.add.reduceat(x, t.first) for x in ((one[t.word] > 0).astype(np.int64), base, score))]
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.Table.from_arrays([ids, *(pa.array(x.astype(k)) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    fold = crc_bucket("doc_id", FOLDS)
    role = F.when(fold == DELETED, FOLD).when(fold != HELD_OUT, ESTIMATE).otherwise(SCORE)
    blocks = checkpoint(docs.select("doc_id", "text", role.alias("role")).mapInArrow(_blocks, "block long, role int, tokens long, ids array<long>, lengths binary, vocabulary binary, index binary"))
    tokens = dict(blocks.groupBy("role").agg(F.sum("tokens")).collect())
    total = tokens.get(ESTIMATE, 0) + tokens.get(FOLD, 0)
    bits = min(64, max(40, sum(tokens.values()).bit_length() + SPARE_BITS))
    parts = max(LEAST_RANGES, math.ceil(sum(tokens.values()) / RANGE_KEYS))
    answers = checkpoint(totals(blocks, parts, bits))
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    uniform = 1 / (vocabulary + 1)
    fold_blocks, fold_answers = blocks.where(F.col("role") == FOLD), answers.where(F.col("role") == FOLD)
    cells = fold_blocks.groupBy("block").cogroup(fold_answers.groupBy("block")).applyInArrow(_cells(bits, tokens.get(ESTIMATE, 0), uniform), "cell long, n double, p1 double, p2 double")
    sums = cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p1", "p2"))).collect()
    weights = interpolation_weights(sorted(map(tuple, sums)), uniform)
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(bits, total, vocabulary, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held_out = F.coalesce(fold == HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
