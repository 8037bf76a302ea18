"""Spans of several kinds in a text: (kind, start, end), code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa

#: Nothing found, the hash of an empty list.
EMPTY = hashlib.sha256(b"").hexdigest()


def joined(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the order of kinds."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else EMPTY


class Cover:
    """The union of spans (kind, start, end), asked by binary search."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


def digest_batches(find, base_kinds: tuple[str, ...], kinds: tuple[str, ...]):
    """A mapInArrow function over (doc_id, text): counts of base kinds, the hash of base spans, all spans, and counts of the kinds added. find(texts) gives (base spans, added spans) for each text."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = find(texts)
            counts = {k: [0] * len(texts) for k in kinds}
            for i, (base, added) in enumerate(found):
                for k, _, _ in (*base, *added):
                    counts[k][i] += 1
            sha = [sha256(joined(base, kinds)) if base else EMPTY for base, _ in found]
            spans = [joined([*base, *added], kinds) if base or added else "" for base, added in found]
            columns = [b.column(0), *(pa.array(counts[k], pa.int64()) for k in kinds), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"])

    return run, "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"
