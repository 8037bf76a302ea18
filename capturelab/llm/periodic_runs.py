"""Stretches of words that repeat with a period, found by a run-length grammar of each text.

The words of some texts, with a bar of its own before each text, are compressed level by level: a block step
gives each stretch of one symbol a symbol (letter, length), and a pair step splits the symbols into left and
right ones by a bit of their hash and gives each left symbol with a right one behind it a symbol (left, right).
Symbols are named by 64-bit hashes of their rules, so equal symbols have equal words below. It ends
when every text is one symbol. A level has three quarters of the symbols of the one below it on average.

How far two places agree, forward or backward, is answered from the levels: where both places are at the
near ends of their parents, the question moves up; if not, at most one symbol or the rest of one block is read
first. Where symbols differ the question moves down again, reading at most one symbol or block a level.

A run of period p and of at least 2 p words has two neighbouring multiples of p in it, so its first word's
multiples are asked for all p: places k p and (k + 1) p with one word are extended both ways, some n log n places for n words. A
stretch found for several periods has the least of them.

Null and empty texts have no words and no runs. Words are told apart by 64-bit hashes. Ties don't occur: runs of one start differ in period. Repeated rows and rows without an id are
rows of their own. An empty table has no row. Texts are taken CHUNK_BYTES at a time, whole; a longer one is a step of its own, with memory in proportion to it and
places asked SLAB at a time. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, U, mix, pair_hash, ragged, read, texts, word_chunks
from .quality_rules import SPACE, _let

LEAST = 12
#: Pairs of places that are compared in one step.
SLAB = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Levels of symbols. first[k] has, for each symbol of level k + 1, its first child in level k, and the number of symbols of level k at the end; parent[k] leads up."""

    def __init__(self, symbols: np.ndarray, bar: np.ndarray):
        self.symbols, self.first, self.parent, self.blocks = [symbols], [], [], []
        turn = 0
        while True:
            s = self.symbols[-1]
            same = s[1:] == s[:-1]
            if same.any():
                at = np.flatnonzero(np.r_[True, ~same])
                n = np.diff(np.r_[at, len(s)])
                bar = self._up(at, np.where(n > 1, pair_hash(~s[at], n.astype(U)), s[at]), bar, True)
                s = self.symbols[-1]
            if not (~bar[1:] & ~bar[:-1]).any():
                break
            turn += 1
            left = (mix(s ^ U(turn * 0x9E3779B97F4A7C15 & 2**64 - 1)) & U(1)).astype(bool)
            second = np.r_[False, left[:-1] & ~left[1:] & ~bar[:-1] & ~bar[1:]]
            if second.any():
                at = np.flatnonzero(~second)
                paired = np.r_[second[1:], False][at]
                names = s[at]
                names[paired] = pair_hash(names[paired], s[at[paired] + 1])
                bar = self._up(at, names, bar, False)

    def _up(self, at: np.ndarray, names: np.ndarray, bar: np.ndarray, block: bool) -> np.ndarray:
        m = len(self.symbols[-1])
        up = np.zeros(m, np.int32)
        up[at] = 1
        self.parent.append(np.cumsum(up, dtype=np.int32) - 1)
        self.first.append(np.r_[at, m].astype(np.int32))
        self.symbols.append(names)
        self.blocks.append(block)
        return bar[at]

    def agree(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many symbols from x on equal those from y on, forward (step 1) or backward (-1); x and y differ."""

        def near(first: np.ndarray, k: np.ndarray) -> np.ndarray:
            return first[k] if step > 0 else first[k + 1] - 1

        who, begun, stopped = np.arange(len(x)), x, []
        for k, s in enumerate(self.symbols):
            go = s[x] == s[y]
            out = [(who[~go], x[~go], y[~go])]
            who, x, y = who[go], x[go], y[go]
            stopped.append(out)
            if not len(who):
                break
            first, up = self.first[k], self.parent[k]
            px, py = up[x], up[y]
            enter = (near(first, px) == x) & (near(first, py) == y)
            if self.blocks[k]:
                rx, ry = (first[px + 1] - x, first[py + 1] - y) if step > 0 else (x - first[px] + 1, y - first[py] + 1)
                n = np.where(enter, 0, np.minimum(rx, ry))
                x, y = x + step * n, y + step * n
                ends = ~enter & (rx != ry)
                if ends.any():
                    out.append((who[ends], x[ends], y[ends]))
                    who, x, y = who[~ends], x[~ends], y[~ends]
            else:
                x, y = x + step * ~enter, y + step * ~enter
            x, y = up[x], up[y]
        who, x, y = who[:0], x[:0], y[:0]
        for k in range(len(stopped) - 1, -1, -1):
            if len(who):
                first, s = self.first[k], self.symbols[k]
                cx, cy = near(first, x), near(first, y)
                n = (s[cx] == s[cy]).astype(np.int64)
                if self.blocks[k]:
                    n *= np.minimum(first[x + 1] - first[x], first[y + 1] - first[y])
                x, y = cx + step * n, cy + step * n
            parts = [(who, x, y), *stopped[k]]
            who, x, y = (np.concatenate([p[c] for p in parts]) for c in range(3))
        out = np.empty(len(begun), np.int64)
        out[who] = np.abs(x - begun[who])
        return out


def runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run, by text, start and period. words: the hashes of all texts' words; counts: how many each text has."""
    texts_, total = np.arange(len(counts)), int(counts.sum())
    base = np.cumsum(counts) - counts + texts_ + 1
    bar = np.zeros(total + len(counts) + 1, bool)
    bar[base - 1] = bar[-1] = True
    symbols = np.empty(len(bar), U)
    symbols[~bar] = words
    symbols[bar] = mix(np.flatnonzero(bar).astype(U) * U(0xD1342543DE82EF95) + U(1))
    grammar = Grammar(symbols, bar)
    half = counts // 2
    owner, period = np.repeat(texts_, half), ragged(np.ones(len(half), np.int64), half)
    places = (counts[owner] - 1) // np.maximum(period, 1)
    ends, lo, found = np.cumsum(places), 0, []
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLAB, "right")))
        n, p = places[lo:hi], period[lo:hi]
        entry = np.repeat(np.arange(lo, hi), n)
        i = base[owner[entry]] + ragged(np.zeros(len(n), np.int64), n) * np.repeat(p, n)
        hit = np.flatnonzero(symbols[i] == symbols[i + period[entry]])
        i, entry = i[hit], entry[hit]
        p = period[entry]
        start, end = i - grammar.agree(i - 1, i + p - 1, -1), i + p + grammar.agree(i, i + p, 1)
        long = end - start >= np.maximum(LEAST, 2 * p)
        found.append(_least(owner[entry][long], start[long], end[long], p[long]))
        lo = hi
    t, start, end, p = _least(*(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4)))
    return t, start - base[t], end - start, p


def _least(t: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each stretch once, with its least period, by text, start and period."""
    order = np.lexsort((p, end, start))
    start_, end_ = start[order], end[order]
    order = order[np.r_[True, (start_[1:] != start_[:-1]) | (end_[1:] != end_[:-1])][: len(order)]]
    order = order[np.lexsort((p[order], start[order]))]
    return t[order], start[order], end[order], p[order]


def _found(schema_of_id: pa.DataType):
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = texts(b.column(1))
            raw = memoryview(data)
            for w in word_chunks(b.column(1), SPACED, lower=False):
                t, start, length, period = runs(w.hash, w.count)
                change = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(change, w.first[t] + start + period, 1)
                np.add.at(change, w.first[t] + start + length, -1)
                stays = np.cumsum(change[:-1]) == 0
                has, kept = np.bincount(t, minlength=w.hi - w.lo) > 0, []
                for k in range(w.hi - w.lo):
                    words = bytes(raw[at[w.lo + k] : at[w.lo + k + 1]]).split()
                    kept.append(b" ".join(compress(words, stays[w.first[k] : w.first[k + 1]]) if has[k] else words))
                offsets = np.searchsorted(t, np.arange(w.hi - w.lo + 1)).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(RUN))
                columns = [b.column(0).slice(w.lo, w.hi - w.lo).cast(schema_of_id), pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs (doc_id, text): its runs of LEAST words or more as (start, length, period), and its words without those that a run repeats."""
    from pyspark.sql.pandas.types import to_arrow_type

    x = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = x.schema["doc_id"].dataType
    return x.mapInArrow(_found(to_arrow_type(kind)), FOUND.format(kind.simpleString()))


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where every tenth text, by the crc32 of its id, goes on from one of its words with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i))), " ")).otherwise("")

    words = F.array_remove(F.split("text", SPACE), "")
    return docs.select("doc_id", F.when(h % 10 == 0, _let(words, repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    x = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("x.length"), -F.col("x.period")
    return x.select("doc_id", "n_runs", (-F.col("x.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
