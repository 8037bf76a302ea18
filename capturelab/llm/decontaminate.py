"""Benchmark decontamination with suffix arrays over the training text.

About SHARD_BYTES of different texts are a shard. Its words become numbers in the order of their hashes, with a
separator before and behind every text, and all its suffixes are sorted, by ranks over 1, 3, 9, ... words of those whose order is still open.
The shards' words, suffix arrays and texts' keys are stored in the checkpoint folder, once, whatever the benchmark's size.

Every suffix of the benchmark whose first WINDOW words a shard knows is binary-searched in its array: the range of suffixes that open with
it is narrowed until none goes on with its next word; where the range's first and last suffix agree with it for more
words, all between do. That gives its longest match with the shard, the places of that match, and where it would stand in the array. The
range at WINDOW words holds all places of its window. They are laid out once for each place in the texts, however many
items hold the window.

Matches cover the places from left to right: at a text's first word that opens a
window, the longest verbatim match with any item is that with one of the two suffixes of the benchmark that stand next to the
place in the array; the next match starts at the next window that the match does not contain. All
items of the windows found are listed as well; windows with the same items share one list.

The benchmark is sent to the tasks in blocks of about BLOCK_BYTES of text (a longer item is cut into
pieces that overlap by WINDOW - 1 words, at which matches are cut too), CHAIN of them in one pass over
the shards, so that its size is no limit. What is found is joined to the documents by the key of their text, by broadcast up to
BROADCAST_TEXTS texts and else by a shuffle in which a frequent text's rows are dealt. Items without an id or text are left out, items without
words have no window, and items of fewer words than a window are one window. Null texts of documents
have no words; a text of any length is one row of work; repeated rows are each given their result. Columns besides
doc_id and text are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, attached, checkpoint, fresh, ragged, read, word_chunks

WINDOW = 10
BLOCK_BYTES = 4 << 20
CHAIN = 4
SHARD_BYTES = 2 << 20
FOUND = "array<struct<item:long,item_start:long,start:long,length:long>>"


class Block:
    """A block of the benchmark: its vocabulary, its words as ids with a 0 after every item, its suffixes in order, and their distinct windows."""

    def __init__(self, items: list[tuple[int, int, str]]):
        items = sorted(items)
        ids, offset = (np.array([x[k] for x in items], np.int64) for k in (0, 1))
        found = list(word_chunks(pa.array([t for _, _, t in items], pa.string()), ALNUM, size=1 << 40))
        words = found[0].hash if found else np.zeros(0, np.uint64)
        count = found[0].count if found else np.zeros(0, np.int64)
        self.vocabulary, word = np.unique(words, return_inverse=True)
        first = np.cumsum(count + 1) - (count + 1)
        self.words = np.zeros(int((count + 1).sum()) + WINDOW, np.int32)
        self.words[np.arange(len(words)) + np.repeat(np.arange(len(count)), count)] = word + 1
        windows = np.where(count >= WINDOW, count - WINDOW + 1, np.minimum(count, 1))
        row = np.repeat(np.arange(len(count)), windows)
        start = ragged(np.zeros(len(windows), np.int64), windows)
        at, length = first[row] + start, np.minimum(count, WINDOW)[row]
        rank = self._ranks()
        order = np.lexsort((rank[at], length < WINDOW))  # whole windows first, in the order of their suffixes
        at, length, row, start = at[order], length[order], row[order], start[order]
        opening = self.words[at[:, None] + np.arange(WINDOW)] if len(at) else np.zeros((0, WINDOW), np.int32)
        opening[np.arange(WINDOW)[None, :] >= length[:, None]] = -1
        new = np.ones(len(at), bool)
        new[1:] = (opening[1:] != opening[:-1]).any(1)
        #: The distinct windows, and the range of suffixes that open with each.
        self.window, self.length = opening[new], length[new]
        self.edges = np.append(np.flatnonzero(new), len(at))
        self.at, self.item, self.start = at.astype(np.int32), ids[row], (offset[row] + start).astype(np.int64)
        self.shortest = int(length.min()) if len(at) else WINDOW
        # windows with the same items share one list
        lists: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.list_of = np.zeros(len(self.window), np.int64)
        for k, (lo, hi) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)):
            own = np.unique(self.item[lo:hi])
            key = own.tobytes()
            if key not in lists:
                lists[key] = len(self.lists)
                self.lists.append(own)
            self.list_of[k] = lists[key]

    def _ranks(self) -> np.ndarray:
        """The rank of every suffix of the words, by doubling."""
        rank, step = np.unique(self.words, return_inverse=True)[1].astype(np.int64), 1
        while len(rank):
            after = np.full(len(rank), -1)
            after[: max(0, len(rank) - step)] = rank[step:]
            key = (rank << 32) | (after + 1)
            distinct, rank = np.unique(key, return_inverse=True)
            step *= 2
            if len(distinct) == len(rank) or step > len(rank):
                break
        return rank


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of text's words (numbers above 0) in the order of what follows them up to the next separator (0); the last place is one. Suffixes that are equal up to there are in the order of their places."""
    n, words, ends = len(text), np.flatnonzero(text), np.flatnonzero(text == 0)
    counts = np.bincount(text[words]) if len(words) else np.zeros(1, np.int64)
    rank = np.empty(n, np.int64)
    rank[ends] = np.arange(len(ends))  # each separator is a sign of its own, below all words
    rank[words] = len(ends) + (np.cumsum(counts) - counts)[text[words]]
    open_, step = words[counts[text[words]] > 1], 1
    narrow = n < 1 << 21
    while len(open_):
        after = rank[np.minimum(open_ + step, n - 1)]
        key = (rank[open_] << 42) | (after << 21) | rank[np.minimum(open_ + 2 * step, n - 1)] if narrow else (rank[open_] << 31) | after
        order = np.argsort(key)
        at, key = open_[order], key[order]
        old, index = rank[at], np.arange(len(at))
        apart = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], index, 0))
        rank[at] = old + np.maximum.accumulate(np.where(apart, index, 0)) - group
        open_ = at[~(apart & np.r_[apart[1:], True])]
        step *= 3 if narrow else 2
    out = np.empty(len(words), np.int64)
    out[rank[words] - len(ends)] = words
    return out


def _agree(text: np.ndarray, at: np.ndarray, other: np.ndarray, to: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How many words text[at...] and other[to...] have in common, given how many they have at least. Both end with signs that the other has not."""
    out, open_, width = known.copy(), np.arange(len(at)), 8
    while len(open_):
        step = out[open_][:, None] + np.arange(width)
        apart = text[np.minimum(at[open_][:, None] + step, len(text) - 1)] != other[np.minimum(to[open_][:, None] + step, len(other) - 1)]
        whole = ~apart.any(1)
        out[open_] += np.where(whole, width, apart.argmax(1))
        open_, width = open_[whole], min(2 * width, 256)
    return out


class Shard:
    """The texts of a shard: the hashes of their words in order, the words as places in it from 1 with a 0 before and behind every text, and the suffixes in order."""

    def __init__(self, vocabulary: np.ndarray, text: np.ndarray, suffixes: np.ndarray):
        self.vocabulary, self.text, self.suffixes = vocabulary, text, suffixes
        #: Where suffixes that begin with each word begin.
        self.first = np.searchsorted(text[suffixes], np.arange(len(vocabulary) + 2))
        self.base = np.flatnonzero(text == 0)[:-1] + 1

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray) -> "Shard":
        vocabulary, number = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + len(counts) + 1, np.int32)
        text[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts) + 1] = number + 1
        return cls(vocabulary, text, suffix_array(text))

    def bound(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The first place in each range of suffixes from which on their words at this depth are not below a word."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.text[self.suffixes[mid] + depth[open_]] < word[open_]
            lo[open_[below]], hi[open_[~below]] = mid[below] + 1, mid[~below]
        return lo

    def searched(self, block: Block) -> tuple[np.ndarray, ...]:
        """The suffixes of the block whose window occurs: (suffix, first and end of the range of its window, its place in the array, the length of its longest match, first and end of that match's range), in the block's order."""
        place = np.searchsorted(self.vocabulary, block.vocabulary)
        there = self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == block.vocabulary
        word, known = np.r_[0, place + 1][block.words], np.r_[False, there][block.words]
        seen = np.r_[0, np.cumsum(known)]
        need = np.repeat(block.length, np.diff(block.edges)).astype(np.int64)
        suffix = np.flatnonzero(seen[block.at + need] - seen[block.at] == need)
        at, need = block.at[suffix].astype(np.int64), need[suffix]
        signs = np.where(known, word, np.where(block.words > 0, -1, -2))
        lo, hi, depth = self.first[word[at]], self.first[word[at] + 1], np.ones(len(at), np.int64)
        low, high, stands, length = np.full(len(at), -1), np.full(len(at), -1), lo.copy(), depth.copy()
        open_ = np.arange(len(at))
        while len(open_):
            a, x, y = at[open_], lo[open_], hi[open_]
            k = np.minimum(_agree(self.text, self.suffixes[x], signs, a, depth[open_]), _agree(self.text, self.suffixes[y - 1], signs, a, depth[open_]))
            new = (low[open_] < 0) & (k >= need[open_])
            low[open_[new]], high[open_[new]], length[open_] = x[new], y[new], k
            w, has = word[a + k], known[a + k]
            begin = self.bound(x, y, k, w)
            stands[open_] = begin
            end = np.where(has, self.bound(begin, y, k, w + 1), begin)
            on = end > begin
            lo[open_[on]], hi[open_[on]], depth[open_[on]] = begin[on], end[on], k[on] + 1
            open_ = open_[on]
        ok = low >= 0
        return tuple(v[ok] for v in (suffix, low, high, stands, length, lo, hi))


def matches(words, block: Block) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """`found_in` for the words of some rows."""
    return found_in(Shard.of(words.hash, words.count), block)


def found_in(shard: Shard, block: Block) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """In a shard, the matches (row, suffix of the benchmark, first word in the row, length) by row and word; and (row, list of items)."""
    none = (np.zeros(0, np.int64),) * 4, (np.zeros(0, np.int64),) * 2
    if not len(block.window) or not len(shard.suffixes):
        return none
    suffix, low, high, stands, *_ = shard.searched(block)
    if not len(suffix):
        return none
    of_window = np.searchsorted(block.edges, suffix, "right") - 1
    first = np.flatnonzero(np.r_[True, of_window[1:] != of_window[:-1]])
    n = (high - low)[first]
    window, place = np.repeat(of_window[first], n), ragged(low[first], n)
    at = shard.suffixes[place]
    of = np.searchsorted(shard.base, at, "right") - 1
    lists = np.unique((of << 32) | block.list_of[window])

    text, whole = shard.text, block.length[window] == WINDOW
    opens, order = np.full(len(text), -1, np.int64), np.zeros(len(text), np.int64)
    opens[at[whole]], order[at[whole]] = window[whole], place[whole]
    starts = np.flatnonzero((opens >= 0) & (np.append(-1, opens[:-1]) < 0))
    out = [(at[~whole], block.edges[window[~whole]], block.length[window[~whole]].astype(np.int64))]
    # the block's words as the shard's, and the places of its suffixes, by window
    word = np.r_[-2, np.where(np.isin(block.vocabulary, shard.vocabulary), np.searchsorted(shard.vocabulary, block.vocabulary) + 1, -1)][block.words]
    size = len(shard.suffixes) + 2
    places = of_window * size + stands
    while len(starts):
        own = opens[starts]
        behind = np.searchsorted(places, own * size + order[starts], "right")
        best, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for beside in (behind - 1, behind):
            ok = (beside >= 0) & (beside < len(places))
            ok[ok] = of_window[beside[ok]] == own[ok]
            k = _agree(text, starts[ok], word, block.at[suffix[beside[ok]]].astype(np.int64), np.full(int(ok.sum()), WINDOW))
            better = np.flatnonzero(ok)[k > length[ok]]
            best[better], length[better] = suffix[beside[better]], k[k > length[ok]]
        out.append((starts, best, length))
        starts = starts + length - WINDOW + 1  # the first window that is not inside the match
        starts = starts[opens[starts] >= 0]
    at, suffix, length = (np.concatenate([x[k] for x in out]) for k in range(3))
    row = np.searchsorted(shard.base, at, "right") - 1
    order = np.lexsort((length, at))
    return (row[order], suffix[order], (at - shard.base[row])[order], length[order]), (lists >> 32, lists & 0xFFFFFFFF)


def _pieces(benchmark: DataFrame) -> DataFrame:
    """(item_id, offset, text, size) of the benchmark's items; those above BLOCK_BYTES are cut into pieces, the words before each of which are its offset."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.octet_length("text").alias("size"))
    short = items.where(F.col("size") <= BLOCK_BYTES).select("item_id", F.lit(0).cast("long").alias("offset"), "text", "size")
    words = F.array_remove(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    long = items.where(F.col("size") > BLOCK_BYTES).select("item_id", words.alias("words"), (F.ceil(F.col("size") / BLOCK_BYTES)).alias("parts"))
    step = F.greatest(F.ceil(F.size("words") / F.col("parts")), F.lit(WINDOW))
    long = long.select("item_id", "words", step.alias("step"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - (WINDOW - 1)) / step) - 1, F.lit(0)))).alias("k"))
    cut = F.array_join(F.slice("words", (F.col("k") * F.col("step") + 1).cast("int"), (F.col("step") + WINDOW - 1).cast("int")), " ")
    return short.unionByName(long.select("item_id", (F.col("k") * F.col("step")).cast("long").alias("offset"), cut.alias("text"), F.octet_length(cut).alias("size")))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in three bytes each, or in four if three don't do; the first byte says which."""
    wide = len(x) and int(x.max()) >= 1 << 24
    return (b"\4" + x.astype("<u4").tobytes()) if wide else b"\3" + x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1)
    if data[0] == 4:
        return raw.view("<u4").astype(np.int64)
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = raw.reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int64)


SHARDS = "keys binary, vocabulary binary, words binary, suffixes binary"
#: What is found in so many texts is broadcast.
BROADCAST_TEXTS = 20_000


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def shards(docs: DataFrame, text: str = "text") -> DataFrame:
    """The suffix arrays of the texts of docs, one row a shard, stored. A text that occurs twice in what a shard is made of is taken once."""

    def built(batches):
        for b in batches:
            first = list({k: i for i, k in reversed(list(enumerate(b.column(0).to_pylist())))}.values())
            keys, column = (c.take(pa.array(sorted(first), pa.int64())) for c in b.columns)
            for w in word_chunks(column, ALNUM, size=SHARD_BYTES):
                s = Shard.of(w.hash, w.count)
                row = [b"".join(keys.slice(w.lo, w.hi - w.lo).to_pylist()), s.vocabulary.tobytes(), _packed(s.text), _packed(s.suffixes)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["keys", "vocabulary", "words", "suffixes"])

    return checkpoint(docs.select(_key(text).alias("key"), text).mapInArrow(built, SHARDS))


def _searcher(blocks: list):
    """For each shard, the texts with a match: their keys, matches and items."""

    def search(batches):
        for b in batches:
            for keys, vocabulary, words, suffixes in zip(*(c.to_pylist() for c in b.columns)):
                shard = Shard(np.frombuffer(vocabulary, np.uint64), _unpacked(words), _unpacked(suffixes))
                n, spans, lists = len(keys) // 16, [], []
                for block in blocks:
                    (row, suffix, start, length), (of, which) = found_in(shard, block.value)
                    spans.append((row, [block.value.item[suffix], block.value.start[suffix], start, length]))
                    own = [block.value.lists[i] for i in which.tolist()]
                    lists.append((np.repeat(of, [len(x) for x in own]) if own else of, [np.concatenate(own) if own else of]))
                at, values = _merged(n, spans)
                found = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in values], names=["item", "item_start", "start", "length"]))
                at, (ids,) = _merged(n, lists)
                of = np.repeat(np.arange(n), np.diff(at))
                order = np.lexsort((ids, of))
                of, ids = of[order], ids[order]
                new = np.ones(len(ids), bool)
                new[1:] = (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])
                items = pa.ListArray.from_arrays(np.searchsorted(of[new], np.arange(n + 1)).astype(np.int32), pa.array(ids[new], pa.int64()))
                hit = pa.array(np.flatnonzero(np.diff(at)))
                yield pa.RecordBatch.from_arrays([pa.array([keys[16 * i : 16 * i + 16] for i in hit.to_pylist()], pa.binary()), found.take(hit), items.take(hit)], names=["key", "found", "items"])

    return search


def matched_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(key, found, items) for every text of docs with a match; see longest_matches."""
    spark, items = docs.sparkSession, checkpoint(_pieces(benchmark))
    blocks = -(-(items.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES) or 1
    stored, parts = shards(docs, text), []
    for k in range(0, blocks, CHAIN):
        of_block = F.pmod(F.xxhash64("item_id", "offset"), F.lit(blocks))
        own = [Block([tuple(r) for r in (items.where(of_block == i) if blocks > 1 else items).select("item_id", "offset", "text").collect()]) for i in range(k, min(blocks, k + CHAIN))]
        rows = stored.mapInArrow(_searcher([spark.sparkContext.broadcast(b) for b in own]), f"key binary, found {FOUND}, items array<long>")
        parts.append(checkpoint(rows.groupBy("key").agg(F.first("found").alias("found"), F.first("items").alias("items"))))  # equal texts of several shards
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("found")), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["length"] - a["length"]).cast("int"))).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("n_words", "found", "items")) -> DataFrame:
    """The columns `keep` (doc_id) of docs with n_words, found (longest verbatim matches of at least a window, or of a whole shorter item, that cover all windows found: item, its first word there, the document's first word, and the number of words) and items (all items with a window in the document)."""
    keep = ["doc_id"] if keep is None else keep
    n_words, found, listed = names
    of_docs = docs.select(*keep).withColumns({n: F.lit(0) for n in names})
    carried, key, deal, of_key, of_found, of_items = fresh(of_docs, "text", "key", "deal", "of_key", "of_found", "of_items")

    def counted(batches):
        for b in batches:
            column = b.column(b.num_columns - 1)
            n = np.concatenate([np.zeros(0, np.int64), *(w.count for w in word_chunks(column, ALNUM))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n.astype(np.int64))], names=[*b.schema.names[:-1], n_words])

    rows = docs.select(*keep, _key(text).alias(key), F.monotonically_increasing_id().alias(deal), F.col(text).alias(carried))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(n_words, T.LongType())])
    table = matched_texts(docs, benchmark, text).toDF(of_key, of_found, of_items)
    joined = attached(rows.mapInArrow(counted, schema), table, F.col(key) == F.col(of_key), BROADCAST_TEXTS, deal)
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(table.dtypes)[c]))
    return joined.select(*keep, n_words, none(of_found).alias(found), none(of_items).alias(listed))


def _merged(n: int, parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows and their values of several parts, by row."""
    row = np.concatenate([r for r, _ in parts])
    order = np.argsort(row, kind="stable")
    return np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32), [np.concatenate(v)[order] for v in zip(*(v for _, v in parts), strict=True)]


_NONE = hashlib.sha256(b"").hexdigest()


def _digest(batches):
    """(doc_id, n_words, found, items) as the query's digests."""
    for b in batches:
        found, items = b.column(2), b.column(3)
        n_hit, n_items, sha = np.zeros(len(found), np.int64), np.asarray(items.value_lengths()).astype(np.int64), [_NONE] * len(found)
        for i in np.flatnonzero(np.asarray(found.value_lengths())).tolist():
            reach, spans = 0, found[i].values
            start, length = np.asarray(spans.field("start")), np.asarray(spans.field("length"))
            for s, e in sorted(zip(start.tolist(), (start + length).tolist(), strict=True)):
                n_hit[i] += max(0, e - max(s, reach))
                reach = max(reach, e)
            sha[i] = hashlib.sha256(",".join(sorted(map(str, items[i].as_py()))).encode()).hexdigest()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(n_hit > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).mapInArrow(_digest, DIGEST)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; each row is judged by its own text."""
    key, deal, of_key, of_hit = fresh(docs, "key", "deal", "of_key", "of_hit")
    hit = matched_texts(docs, read(spark, sf_dir, "benchmark")).select(F.col("key").alias(of_key), F.lit(True).alias(of_hit))
    rows = docs.withColumns({key: _key("text"), deal: F.monotonically_increasing_id()})
    return attached(rows, hit, F.col(key) == F.col(of_key), BROADCAST_TEXTS, deal).where(F.col(of_hit).isNull()).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(ws),10) AS n, unnest([array_to_string(ws[i:i+least(len(ws),10)-1],' ') FOR i IN range(1,greatest(len(ws)-8,2))]) AS g FROM b WHERE len(ws)>0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1,len(ws)-n+2)) AS i, unnest([array_to_string(ws[j:j+n-1],' ') FOR j IN range(1,len(ws)-n+2)]) AS g FROM d, lens WHERE len(ws)>=n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n=bw.n AND dw.g=bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i,i+n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,0) AS BIGINT) AS n_items, sha256(coalesce(l,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
