"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern. Each piece is looked up in two tiers: a minimal
perfect hash over the vocabulary resolves pieces that are tokens themselves; for any other
piece a heap of (rank, place) over a linked list of its bytes applies merges from the
lowest rank up. A bounded memo of two
generations keeps the ids of text between spaces that a worker has seen: a full one
becomes the older, out of which what is asked for again moves to the younger.

The vocabulary's size is fixed by its file, which is a parameter; it is sent to the tasks
once as a broadcast. Null text is empty text: no ids, and the hash of no bytes. A long unbroken run
costs its length times the logarithm of it and is kept in no memo. Repeated rows are each given their
ids; an empty table has no rows. Columns besides doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Runs of text between spaces, and pieces, of a generation of the memo; longer ones than LONGEST characters are not kept, so that its bytes are bounded too.
MEMO, LONGEST = 240_000, 64
#: A text is first cut where white space begins, which no match of the pattern crosses but for one space before other characters.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class PerfectHash:
    """A minimal perfect hash: keys fall in buckets, and each bucket has a seed that sends its keys to free places."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = n // 2 + 1
        self.seed = [0] * self.buckets
        self.key: list[bytes | None] = [None] * n
        members: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k in keys:
            members[xxh3_64_intdigest(k) % self.buckets].append(k)
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) == 1:  # any place that is left will do, and is named itself
                free = free or iter([p for p in range(n) if self.key[p] is None])
                p = next(free)
                self.key[p], self.seed[b] = members[b][0], -p - 1
                continue
            seed = 1
            while members[b]:
                places = [xxh3_64_intdigest(k, seed) % n for k in members[b]]
                if len(set(places)) == len(places) and all(self.key[p] is None for p in places):
                    for k, p in zip(members[b], places, strict=True):
                        self.key[p] = k
                    self.seed[b] = seed
                    break
                seed += 1

    def place(self, key: bytes) -> int:
        """The key's place, or -1 if it is not one of the keys."""
        seed = self.seed[xxh3_64_intdigest(key) % self.buckets]
        p = -seed - 1 if seed < 0 else xxh3_64_intdigest(key, seed) % self.n
        return p if self.key[p] == key else -1


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.hash = pattern, PerfectHash(list(ranks))
        self.rank = [ranks[k] if k is not None else -1 for k in self.hash.key]
        self.bytes: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.bytes[r] = k
        # the rank of two neighbouring parts' union, by the parts' ids
        self.union = {(ranks[k[:i]] << 32) | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.byte = [ranks[bytes([i])] if bytes([i]) in ranks else None for i in range(256)]
        self.ready = False

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def prepare(self) -> None:
        """What a worker makes for itself."""
        self.cut, self.memo, self.older, self.pieces, self.older_pieces, self.ready = regex.compile(self.pattern), {}, {}, {}, {}, True
        self.flat, self.size = np.frombuffer(b"".join(self.bytes), np.uint8), np.array([len(x) for x in self.bytes], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def find(self, piece: bytes) -> int | None:
        p = self.hash.place(piece)
        return None if p < 0 else self.rank[p]

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token itself."""
        union, part, n = self.union.get, [self.byte[x] for x in piece], len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the rank of each part's union with the next one; a heap entry whose rank is not its part's any more is stale
        rank = [union((x << 32) | y, -1) for x, y in zip(part, part[1:])]
        rank.append(-1)
        heap = [(r << 32) | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if rank[i] != r:
                continue
            j = after[i]
            part[i], part[j], rank[j] = r, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank[i] = x = union((r << 32) | part[k], -1)
                if x >= 0:
                    heappush(heap, (x << 32) | i)
            else:
                rank[i] = -1
            if (h := before[i]) >= 0:
                rank[h] = x = union((part[h] << 32) | r, -1)
                if x >= 0:
                    heappush(heap, (x << 32) | h)
        return [x for x in part if x >= 0]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not self.ready:
            self.prepare()
        memo, runs = self.memo, _RUNS.findall(text)
        try:
            packed = b"".join([memo[p] for p in runs])
        except KeyError:
            if len(memo) > MEMO:
                self.older, self.memo = memo, (memo := {})
            older, long = self.older, {}
            for run in set(runs).difference(memo):
                (memo if len(run) <= LONGEST else long)[run] = older[run] if run in older else b"".join([self.piece(p) for p in self.cut.findall(run)])
            packed = b"".join([memo[p] if p in memo else long[p] for p in runs] if long else [memo[p] for p in runs])
        return np.frombuffer(packed, "<u4")

    def piece(self, piece: str) -> bytes:
        if (packed := self.pieces.get(piece)) is not None:
            return packed
        if len(self.pieces) > MEMO:
            self.older_pieces, self.pieces = self.pieces, {}
        if (packed := self.older_pieces.get(piece)) is None:
            raw = piece.encode("utf-8", "replace")
            r = self.find(raw)
            ids = [r] if r is not None else self.merged(raw)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            self.pieces[piece] = packed
        return packed

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: each token's are taken from where they lie among all tokens'."""
        if not self.ready:
            self.prepare()
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(self.first[ids] - (end - size), size)].tobytes()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cut", "memo", "older", "pieces", "older_pieces", "flat", "size", "first")} | {"ready": False}


def vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """A broadcast vocabulary; by default the public one that the queries use."""
    if path is None:
        import public_tokenizers

        path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return spark.sparkContext.broadcast(Vocabulary.load(path, pattern))


def encoded(docs: DataFrame, words, text: str = "text") -> DataFrame:
    """docs (doc_id, text) with `ids`, an array of ids for every text."""

    def run(batches):
        for b in batches:
            ids = [words.value.encode(t.as_py() or "") for t in b.column(1)]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, words) -> DataFrame:
    """rows (doc_id, ids) with `bytes`, the bytes of the ids."""

    def run(batches):
        for b in batches:
            out = [words.value.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def token_digests(docs: DataFrame, words) -> DataFrame:
    """doc_id, n_tokens, the hash of the ids and of the bytes that they decode to; encoded and decoded in one pass."""

    def run(batches):
        v = words.value
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):  # one text at a time as a Python string
                ids = v.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"), vocabulary(spark))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: token counts and hashes of every document that is left."""
    return token_digests(docs, vocabulary(spark))
