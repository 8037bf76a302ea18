"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

Base kinds are patterns with checks (parts of an address, Luhn's sum, digit counts). The
network is trained in numpy, by the CRF's likelihood, on windows of a bounded sample of
the documents (SAMPLE_DOCS), labelled by the base spans, and on WRITTEN windows of the same
sample with written-in examples: other notations (an address with "[at]", a number without
its country code, a card number with dots) and things that only look alike (versions,
dates, amounts, hashes). Its gates bend by v / (1 + |v|) in place of tanh.

The whole text lies in windows of WINDOW characters that overlap by WINDOW - STEP. All windows are
decoded by Viterbi; where no run of labels can outweigh its transitions, the path is known to be
empty beforehand. Spans cut by a window's edge are joined with what the next windows have
found, so length is no limit. Spans are then reconciled over
the whole text: of the spans found, the non-overlapping set with the greatest total weight
stays, where agreement adds up and spans cut by a window's edge weigh half. What
overlaps no base span and passes its kind's plain check is added as `lstm_<kind>`. The
check knows @, at in brackets, and a plain "at" if the dots are spelled out too.

Null text is empty text and has no spans. Repeated rows are each given their spans; with no
text to learn from, the network learns from written-in examples alone. Time and memory are
linear in a text's length. Columns besides doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .spans import Cover, digest_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"lstm_{k}" for k in BASE))
SAMPLE_DOCS, SAMPLE_WINDOWS, WRITTEN = 1500, 900, 8000
#: How often a written number has another beside it.
BESIDE = 0.5
WINDOW, STEP, SHORT, HIDDEN, LABELS = 256, 224, 64, 12, 1 + 2 * len(BASE)  # label 0: nothing; 1 + 2k: first character of kind k; 2 + 2k: a further one

#: An address from its @ on; what stands before is found from there. As patterns of whole addresses, these would try every character of a long run as a start.
_LOCAL, _HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Signs of personal data, by which training windows are chosen; and an address in other notation.
_SIGN = re.compile(r"(?i)[0-9@]|[(\[{<]\s?(?:at|dot)\s?[)\]}>]")
_AT, _DOT = r"[(\[{<]\s?at\s?[)\]}>]", r"[(\[{<]\s?dot\s?[)\]}>]"
_SPELLED = re.compile(rf"(?i)(?<![\w.%+-])[\w.%+-]++(?:\s?(?:@|{_AT})\s?[\w-]+(?:(?:\s?(?:\.|{_DOT})\s?|\s+dot\s+)[\w-]+)+|\s+at\s+[\w-]+(?:(?:\s?{_DOT}\s?|\s+dot\s+)[\w-]+)+)")


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(number: str) -> bool:
    twice = [int(c) * 2 for c in number[-2::-2]]
    return (sum(map(int, number[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    return 12 <= len(d := digits(s)) <= 19 and luhn(d)


def emails(text: str) -> list[tuple[str, int, int]]:
    out, reach = [], 0
    for m in _HOST.finditer(text):
        start = m.start()
        while start > reach and text[start - 1] in _LOCAL:
            start -= 1
        reach = m.start() + 1
        if start < m.start():
            reach = m.end()
            out.append(("email", start, reach))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = emails(text) if "@" in text else []
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


# --- the network


def codes(text: str) -> np.ndarray:
    """A class for each character: ASCII ones have their own."""
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0x250)]


CLASSES = 98  # 0 is padding
_CLASS = np.array([max(c, 32) - 31 if c < 127 else 96 if c < 0x250 else 97 for c in range(0x251)], np.int32)


def _act(v: np.ndarray) -> np.ndarray:
    """v / (1 + |v|), which bends like tanh and costs numpy a fifth of it; a gate is (1 + _act(v)) / 2. The slope is (1 - |_act(v)|)^2."""
    return v / (1 + np.abs(v))


#: So many rows at once are multiplied by one thread: BLAS takes up others above 2^18 products, which costs more than it gives.
ALONE = 2**18 // (4 * HIDDEN * HIDDEN)


class Tagger:
    """Emissions of a bidirectional LSTM and CRF transitions; both directions run as one batch."""

    def __init__(self, seed: int = 5):
        r = np.random.RandomState(seed)
        h = HIDDEN
        self.p = {
            "x": r.normal(0, 0.3, (2, CLASSES, 4 * h)), "h": r.normal(0, 0.25, (2, h, 4 * h)), "b": np.zeros((2, 1, 4 * h)),
            "o": r.normal(0, 0.3, (2, h, LABELS)), "e": np.zeros(LABELS), "t": r.normal(0, 0.1, (LABELS, LABELS)), "s": np.zeros(LABELS),
        }
        self.p["b"][:, :, h : 2 * h] = 1
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, x: np.ndarray, keep: bool = False):
        """Emissions (batch, time, label) of x (batch, time); with keep also what the gradient needs."""
        p, h, (n, steps) = self.p, HIDDEN, x.shape
        both = np.stack([x, x[:, ::-1]])
        state, cell, saved, out = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32), [], np.zeros((steps, 2, n, h), np.float32)
        side = np.arange(2)[:, None]
        for t in range(steps):
            a = _act(p["x"][side, both[:, :, t]] + p["b"] + state @ p["h"])
            gate, z = (1 + a[:, :, : 3 * h]) / 2, a[:, :, 3 * h :]
            i, f, o = gate[:, :, :h], gate[:, :, h : 2 * h], gate[:, :, 2 * h :]
            old, cell = cell, f * cell + i * z
            tc = _act(cell)
            if keep:
                saved.append((state, old, gate, z, tc))
            state = o * tc
            out[t] = state
        emit = out[:, 0] @ p["o"][0] + out[::-1, 1] @ p["o"][1] + p["e"]
        return (emit.transpose(1, 0, 2), both, out, saved) if keep else emit.transpose(1, 0, 2)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """As run, without what the gradient needs."""
        return self.by_step(x).transpose(2, 0, 1)

    def by_step(self, x: np.ndarray) -> np.ndarray:
        """Emissions (time, label, batch): in place, and with the gates' halves taken into the weights of what follows."""
        p, h, (n, steps) = self.p, HIDDEN, x.shape
        at = np.ascontiguousarray(x.T)
        emit = np.empty((steps, LABELS, n), np.float32)
        emit[:] = p["e"][:, None]
        g, size, of_state = (np.empty((n, 4 * h), np.float32) for _ in range(3))
        of_label = np.empty((LABELS, n), np.float32)
        fresh, room = np.empty((n, h), np.float32), np.empty((n, h), np.float32)
        gates, i, f, o, z = g[:, : 3 * h], g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
        for side in range(2):
            table, into, out = p["x"][side] + p["b"][side], p["h"][side] / 2, np.ascontiguousarray(p["o"][side].T) / 2
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                np.take(table, at[t], axis=0, out=g, mode="clip")
                for k in range(0, n, ALONE):
                    np.matmul(state[k : k + ALONE], into, out=of_state[k : k + ALONE])
                g += of_state
                np.abs(g, out=size)
                size += 1
                g /= size
                gates += 1
                cell *= f
                np.multiply(i, z, out=fresh)
                cell += fresh
                cell *= 0.5
                np.abs(cell, out=room)
                room += 1
                np.divide(cell, room, out=state)
                state *= o
                np.matmul(out, state.T, out=of_label)
                emit[t] += of_label
        return emit

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The Viterbi paths of x. Where no run of other labels wins over label 0, the path is 0 without a search: `gains` bounds what a run can win."""
        emit = self.by_step(x)
        hard = np.flatnonzero(self.gains(emit) >= -1e-2)
        path = np.zeros(x.shape, np.int64)
        if len(hard):
            path[hard] = self.viterbi(np.ascontiguousarray(emit[:, :, hard]))
        return path

    def gains(self, emit: np.ndarray) -> np.ndarray:
        """The most that a run of labels other than 0 can win over label 0 in each window, where a kind's two labels may stand for one another as the label before."""
        t, s = self.p["t"], self.p["s"]
        kinds = np.arange(1, LABELS, 2)
        over = t - t[0, 0]
        first, further = emit[:, 1::2] - emit[:, :1], emit[:, 2::2] - emit[:, :1]
        enter, leave = over[0, kinds][:, None], np.maximum(over[kinds, 0], over[kinds + 1, 0])[:, None]
        stay = np.maximum(over[kinds, kinds + 1], over[kinds + 1, kinds + 1])[:, None]
        into, inside = over[1:][:, kinds].max(0)[:, None], [np.delete(over[1:, k + 1], [k - 1, k]).max() for k in kinds]
        inside, amiss = np.array(inside, np.float32)[:, None], over[0, kinds + 1][:, None]  # a further character of a kind after another kind, or after none
        run = np.maximum(first[0] + (s[kinds] - s[0])[:, None], further[0] + (s[kinds + 1] - s[0])[:, None])
        most = run + leave
        for k in range(1, len(emit)):
            top = run.max(0)
            begun = np.maximum(top + into, enter)
            begun += first[k]
            run += stay
            np.maximum(run, top + inside, out=run)
            np.maximum(run, amiss, out=run)
            run += further[k]
            np.maximum(run, begun, out=run)
            np.maximum(most, run + leave, out=most)
        return np.maximum(most, run).max(0)

    def viterbi(self, emit: np.ndarray) -> np.ndarray:
        """The best paths of emissions (time, label, batch). Going back, the best label before is found anew, so none is kept."""
        steps, _, n = emit.shape
        t = self.p["t"]
        best = np.empty_like(emit)
        best[0] = emit[0] + self.p["s"][:, None]
        score = np.empty((LABELS, LABELS, n), np.float32)
        for k in range(1, steps):
            np.add(best[k - 1][:, None], t[:, :, None], out=score)
            np.max(score, axis=0, out=best[k])
            best[k] += emit[k]
        path = np.zeros((steps, n), np.int64)
        path[-1] = best[-1].argmax(0)
        for k in range(steps - 1, 0, -1):
            path[k - 1] = (best[k - 1] + t[:, path[k]]).argmax(0)
        return path.T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of labels y and its gradient."""
        p, h, (n, steps) = self.p, HIDDEN, x.shape
        emit, both, out, saved = self.run(x, keep=True)
        # forward and backward sums, scaled to 1 at every step
        top = emit.max(2, keepdims=True)
        step, move = np.exp(emit - top).transpose(1, 0, 2).copy(), np.exp(p["t"])
        ahead, behind, size = np.empty_like(step), np.ones_like(step), np.empty_like(step[:, :, :1])
        for t in range(steps):
            ahead[t] = (ahead[t - 1] @ move if t else np.exp(p["s"])) * step[t]
            size[t] = ahead[t].sum(1, keepdims=True)
            ahead[t] /= size[t]
        step /= size
        for t in range(steps - 2, -1, -1):
            behind[t] = (behind[t + 1] * step[t + 1]) @ move.T
        total = np.log(size).sum((0, 2)) + top.sum((1, 2))
        d = {k: np.zeros_like(v) for k, v in p.items()}
        de = (ahead * behind).transpose(1, 0, 2).copy()
        at, when = np.arange(n)[:, None], np.arange(steps)[None, :]
        gold = emit[at, when, y].sum(1) + p["s"][y[:, 0]] + p["t"][y[:, :-1], y[:, 1:]].sum(1)
        d["s"] = de[:, 0].sum(0)
        np.subtract.at(d["s"], y[:, 0], 1)
        d["t"] = move * (ahead[:-1].transpose(0, 2, 1) @ (behind[1:] * step[1:])).sum(0)
        np.subtract.at(d["t"], (y[:, :-1], y[:, 1:]), 1)
        de[at, when, y] -= 1
        d["e"] = de.sum((0, 1))
        by_time = de.transpose(1, 0, 2)
        d["o"] = np.stack([np.tensordot(out[:, 0], by_time, ((0, 1), (0, 1))), np.tensordot(out[::-1, 1], by_time, ((0, 1), (0, 1)))])
        into = np.stack([by_time @ p["o"][0].T, by_time[::-1] @ p["o"][1].T], 1)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        every = np.zeros((2, steps, n, 4 * h), dh.dtype)
        for t in range(steps - 1, -1, -1):
            state, old, gate, z, tc = saved[t]
            i, f, o = gate[:, :, :h], gate[:, :, h : 2 * h], gate[:, :, 2 * h :]
            dh = dh + into[t]
            dc = dc + dh * o * (1 - np.abs(tc)) ** 2
            slope = (1 - np.abs(2 * gate - 1)) ** 2 / 2
            dg = np.concatenate([dc * z * slope[:, :, :h], dc * old * slope[:, :, h : 2 * h], dh * tc * slope[:, :, 2 * h :], dc * i * (1 - np.abs(z)) ** 2], 2)
            every[:, t] = dg
            d["h"] += state.transpose(0, 2, 1) @ dg
            d["b"] += dg.sum(1, keepdims=True)
            dh, dc = dg @ p["h"].transpose(0, 2, 1), dc * f
        for k in range(2):
            order = np.argsort(both[k].T.reshape(-1), kind="stable")
            seen, first = np.unique(both[k].T.reshape(-1)[order], return_index=True)
            d["x"][k][seen] = np.add.reduceat(every[k].reshape(-1, 4 * h)[order], first, axis=0)
        return float((total - gold).mean()), {k: v / n for k, v in d.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 7, batch: int = 128, rate: float = 0.03) -> Tagger:
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        r = np.random.RandomState(3)
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), batch):
                own = order[lo : lo + batch]
                _, d = self.gradient(x[own], y[own])
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in d.values()))
                for k, g in d.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (rate * 0.7**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


# --- windows


def regions(text: str) -> list[tuple[int, int]]:
    """Where training windows lie: half a training window around every sign of personal data, merged."""
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        lo, hi = max(0, m.start() - SHORT // 2), min(len(text), m.end() + SHORT // 2)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def window_starts(text: str) -> list[int]:
    """Windows over the whole text, each of which overlaps the one before by WINDOW - STEP."""
    return list(range(0, max(1, len(text) - (WINDOW - STEP)), STEP)) if text else []


def signed_starts(text: str) -> list[int]:
    """Windows around the signs of personal data."""
    return [s for lo, hi in regions(text) for s in range(lo, max(lo + 1, hi - SHORT // 2), SHORT // 2)]


def _labels(spans, start: int) -> np.ndarray:
    y = np.zeros(SHORT, np.int64)
    for kind, s, e in spans:
        k = BASE.index(kind)
        lo, hi = max(0, s - start), min(SHORT, e - start)
        if lo < hi:
            y[lo:hi] = 2 + 2 * k
            if s >= start:
                y[lo] = 1 + 2 * k
    return y


def path_spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a label path."""
    out, at = [], 0
    while at < len(path):
        if path[at]:
            k, end = (int(path[at]) - 1) // 2, at + 1
            while end < len(path) and path[end] == 2 + 2 * k:
                end += 1
            out.append((k, at, end))
            at = end
        else:
            at += 1
    return out


def reconcile(spans: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """The non-overlapping spans (kind, start, end) of greatest total weight."""
    order = sorted(spans, key=lambda x: (x[2], x[1], x[0]))
    ends = [x[2] for x in order]
    best = [0.0]
    for i, x in enumerate(order):
        best.append(max(best[-1], best[bisect_right(ends, x[1], 0, i)] + spans[x]))
    out, i = [], len(order)
    while i:
        if best[i] == best[i - 1]:
            i -= 1
        else:
            out.append(order[i - 1])
            i = bisect_right(ends, order[i - 1][1], 0, i - 1)
    return out[::-1]


def _plausible(kind: str, s: str) -> bool:
    if kind == "email":
        return bool(_SPELLED.fullmatch(s))
    if kind == "ip":
        return s.count(".") == 3 and bool(re.fullmatch("[0-9.]+", s)) and all(p for p in s.split(".")) and _is_ip(s)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9][0-9 .-]+[0-9]", s)) and _is_card(s)
    return bool(re.fullmatch(r"[(+]?[0-9][0-9 ().-]+[0-9]", s)) and 9 <= len(digits(s)) <= 15 and bool(re.search("[ ().-]", s))


def chained(cut: list[tuple[int, int, int, bool, bool]]) -> list[tuple[int, int, int, int]]:
    """Joins spans (kind, start, end, cut at the start, cut at the end) that go on over windows' edges: (kind, start, end, characters found)."""
    out = []
    for k, a, b, left, right in sorted(cut):
        if out and out[-1][0] == k and out[-1][4] and left and a <= out[-1][2]:
            last = out[-1]
            out[-1] = (k, last[1], max(b, last[2]), last[3] + b - a, right if b >= last[2] else last[4])
        else:
            out.append((k, a, b, b - a, right))
    return [x[:4] for x in out]


def tagged(texts: list[str], model: Tagger, batch: int = 4 * ALONE) -> list[list[tuple[str, int, int]]]:
    """The network's reconciled spans of each text."""
    found: list[dict[tuple[int, int, int], float]] = [{} for _ in texts]
    cuts: list[list[tuple[int, int, int, bool, bool]]] = [[] for _ in texts]
    size = [len(t) for t in texts]

    def decode(x: np.ndarray, of: np.ndarray, starts: np.ndarray) -> None:
        paths = model.decode(x)
        for j in np.flatnonzero(paths.any(1)).tolist():
            i, s = int(of[j]), int(starts[j])
            for k, a, b in path_spans(paths[j]):
                left, right, end = a == 0 and s > 0, b == WINDOW and s + b < size[i], min(s + b, size[i])
                if end <= s + a:
                    continue
                key = (k, s + a, end)
                found[i][key] = found[i].get(key, 0) + (b - a) * (0.5 if left or right else 1)
                if left or right:
                    cuts[i].append((*key, left, right))

    held, n = [], 0
    for i, t in enumerate(texts):
        starts = np.array(window_starts(t), np.int64)
        if not len(starts):
            continue
        padded = np.zeros(starts[-1] + WINDOW, np.int32)
        padded[: size[i]] = codes(t)
        windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
        at = 0
        while at < len(starts):
            own = slice(at, min(len(starts), at + batch - n))
            held.append((windows[own], np.full(own.stop - own.start, i), starts[own]))
            n, at = n + own.stop - own.start, own.stop
            if n == batch:
                decode(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        decode(*map(np.concatenate, zip(*held, strict=True)))
    for f, c in zip(found, cuts, strict=True):
        for k, a, b, weight in chained(c):
            f[k, a, b] = max(f.get((k, a, b), 0), 0.5 * weight)
    return [[(BASE[k], s, e) for k, s, e in reconcile(f)] if f else [] for f in found]


def _examples(windows: list[str], seed: int = 11) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Windows with something written in: personal data with its span, or a look-alike without."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def name(w: str) -> str:
        own = [x for x in w.split() if x.isalpha() and len(x) < 16]
        return r.choice(own).lower() if own and r.random() < 0.6 else word()

    def notation() -> tuple[str, str]:
        way, pad = r.choice([str, str, str.upper]), r.choice([" ", " ", ""])
        left, right = r.choice(["[]", "()", "{}", "<>", "  ", "  ", "  "])
        if left == " ":
            return f" {way('at')} ", f" {way('dot')} "
        return f"{pad}{left}{way('at')}{right}{pad}", r.choice([f"{pad}{left}{way('dot')}{right}{pad}"] * 2 + ["."])

    def email(w: str) -> str:
        at, dot = r.choice([("@", "."), ("@", "."), ("@", "."), *(notation() for _ in range(9))])
        local = r.choice([name(w), name(w), f"{name(w)}.{name(w)}", f"{name(w)}.{num(2)}", name(w) + num(2), f"{name(w)}-{word()}"])
        return local + at + r.choice([word(), name(w), f"{word()}-{num(1)}"]) + r.choice(["", "", num(1), num(2)]) + dot + r.choice([word()[:3], word(), r.choice(["org", "com", "net", "de"]), "example" + dot + "com"])

    phone = lambda: r.choice(["+%s (%s) %s-%s", "+%s %s %s %s", "+%s-%s-%s-%s"]) % (num(r.randint(1, 2)), num(3), num(3), num(4)) if r.random() < 0.6 else r.choice(["(%s) %s-%s", "%s-%s-%s", "%s.%s.%s"]) % (num(3), num(3), num(4))
    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    odd = lambda: r.choice(["", "", f"{word()} at {word()}", f"({word()}) {word()} [{word()}]", f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(2)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)},{num(3)}.{num(2)}", "".join(r.choice("0123456789abcdef") for _ in range(r.randint(8, 40))), num(r.randint(1, 6)), f"@{word()}", f"{num(2)}:{num(2)}", f"1{num(2)}-1{num(2)}", f"{word()}{num(3)}"])
    texts, spans = [], []
    for w in windows:
        kind = r.choice([*BASE, *BASE[2:], *["email"] * 6, *[None] * 4])
        make = {"email": lambda: email(w), "ip": ip, "card": card, "phone": phone, None: odd}[kind]  # noqa: B023
        written = [make()]
        while kind in ("card", "phone") and r.random() < BESIDE and len(written) < 3 and sum(map(len, written)) < SHORT - 24:
            written.append(r.choice([written[0], make()]))
        beside = r.choice([" ", " ", " ", ", ", "; ", "\n"])
        s = beside.join(written)
        at = r.randint(0, max(0, SHORT - len(s) - 2))
        left = w[:at] + r.choice(["", " ", " "]) + (f"{odd()} " if kind and len(s) < SHORT // 2 and r.random() < 0.3 else "")
        texts.append((left + s + r.choice([" ", " ", ". ", ", "]) + w[at:])[:SHORT])
        begin, own = len(left), []
        for x in written:
            if begin + len(x) <= SHORT:
                own.append((kind, begin, begin + len(x)))
            begin += len(x) + len(beside)
        spans.append(own if kind else [])
    return texts, spans


def train(docs: DataFrame) -> Tagger:
    """A tagger fitted to a bounded sample of docs (doc_id, text), chosen by a hash of id and text."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")

    def cut(batches):
        for b in batches:
            text, start, kind, at, end = [], [], [], [], []
            for t in b.column(0).to_pylist():
                spans = base_spans(t or "")
                starts = signed_starts(t or "")
                for s in starts[:: max(1, len(starts) // 8)] + [max(0, len(t or "") // 2 - SHORT)]:
                    own = [x for x in spans if x[1] < s + SHORT and x[2] > s]
                    text.append((t or "")[s : s + SHORT])
                    start.append(s)
                    kind.append([x[0] for x in own])
                    at.append([x[1] for x in own])
                    end.append([x[2] for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(start, pa.int64()), pa.array(kind, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int64())), pa.array(end, pa.list_(pa.int64()))], names=["text", "start", "kind", "at", "end"])

    windows = sample.mapInArrow(cut, "text string, start long, kind array<string>, at array<long>, end array<long>").distinct()
    rows = sorted((tuple(map(str, r)), r) for r in windows.orderBy(F.xxhash64("text", "start"), "text", "start", "kind", "at", "end").limit(20 * SAMPLE_WINDOWS).collect())
    rows = [r for _, r in rows]
    random.Random(2).shuffle(rows)
    # an address in other notation has no base span, so its window would teach that it is none
    marked = [r for r in rows if _SIGN.search(r.text) and all("@" in m[0] for m in _SPELLED.finditer(r.text))][:SAMPLE_WINDOWS]
    plain = [r.text for r in rows if not _SIGN.search(r.text)][:SAMPLE_WINDOWS] or [""]
    plain = (plain * (WRITTEN // len(plain) + 1))[:WRITTEN]
    texts, spans = _examples(plain)
    x, y = np.zeros((len(marked) + len(texts), SHORT), np.int64), np.zeros((len(marked) + len(texts), SHORT), np.int64)
    for i, r in enumerate(marked):
        x[i, : len(r.text)] = codes(r.text)
        y[i] = _labels(list(zip(r.kind, r.at, r.end, strict=True)), r.start)
    for i, (t, s) in enumerate(zip(texts, spans, strict=True), len(marked)):
        x[i, : len(t)] = codes(t)
        y[i] = _labels(s, 0)
    return Tagger().fit(x, y)


def added(text: str, base: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the network adds to base spans: its plausible spans. One that only touches an address in other notation is widened to it."""
    out, known, spelled, ends = [], Cover(base), None, []
    for k, s, e in spans:
        if known.meets(s, e):
            continue
        if k == "email" and not _plausible(k, text[s:e]):
            if spelled is None:
                spelled = [m.span() for m in _SPELLED.finditer(text)]
                ends = [b for _, b in spelled]
            i = bisect_right(ends, s)
            while i < len(spelled) and spelled[i][0] < e:
                if not known.meets(*spelled[i]):
                    out.append((f"lstm_{k}", *spelled[i]))
                i += 1
        elif _plausible(k, text[s:e]):
            out.append((f"lstm_{k}", s, e))
    return list(dict.fromkeys(out))


def finder(model):
    """find(texts) for a broadcast tagger: base spans, and what the network adds."""

    def find(texts: list[str]):
        out = []
        for t, spans in zip(texts, tagged(texts, model.value), strict=True):
            base = base_spans(t)
            out.append((base, added(t, base, spans)))
        return out

    return find


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each kind, the hash of base spans and all spans, for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    run, schema = digest_batches(finder(docs.sparkSession.sparkContext.broadcast(train(docs))), BASE, KINDS)
    return docs.mapInArrow(run, schema)


def op4_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind in capitals."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k.removeprefix('lstm_').upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is that of the new text. All documents stay."""
    find = finder(spark.sparkContext.broadcast(train(docs.select("doc_id", "text"))))
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def redact(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            found = find([t or "" for t in texts])
            new = [t if t is None or not (x or y) else redacted(t, [*x, *y]) for t, (x, y) in zip(texts, found, strict=True)]
            columns = b.columns
            columns[at] = pa.array(new, pa.string())
            if n_at >= 0:
                changed = [n if t is u else len(u) for n, t, u in zip(columns[n_at].to_pylist(), texts, new, strict=True)]
                columns[n_at] = pa.array(changed, b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(redact, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
