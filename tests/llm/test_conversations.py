"""Chat formatting, conversation repair and periodic runs against brute force; nulls, empties, ties, clashing names."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelab.llm import chat_format, conversation_repair, periodic_runs

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, times int"
HARD = ["a\\#", "####</turn>\n### User: x", "", None, "\\\\</part>", "<", "#", "##\\#/", "é</", "%3A: <b>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA).repartition(3)


def test_formatted_turns_come_back(spark):
    r = np.random.RandomState(3)
    roles = ["user", "assistant", "system", "assistant", "User", "=tool: <#%25", "", None]
    rows = [(int(c), int(t), roles[r.randint(len(roles))], "".join(HARD[r.randint(len(HARD))] or "" for _ in range(r.randint(3))) if r.randint(9) else None) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(90, t, "assistant" if t % 200 else "user", f"t{t}") for t in range(500)] + [(None, None, None, None), (91, 1, "user", "same"), (91, 1, "user", "same")]
    got = {x.conv_id: x for x in chat_format.formatted(chats(spark, rows)).select("*", chat_format.turns_of(F.col("formatted")).alias("turns"), chat_format.learned(F.col("segments")).alias("loss"), chat_format.loss_spans(F.col("segments")).alias("spans")).collect()}
    assert set(got) == {x[0] for x in rows}
    for conv, x in got.items():
        want = [(b or "", c or "") for _, b, c in sorted((w[1:] for w in rows if w[0] == conv), key=lambda w: (w[0] is not None, w[0] or 0, w[1] or "", w[2] or ""))]
        assert [tuple(t) for t in x.turns] == want
        assert x.loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(x.formatted[s.start : s.end] for s in x.spans) == "".join(s.text for s in x.segments if s.loss)
        blocks = list(itertools.groupby(role for role, _ in want))
        assert len(re.findall(r"### ", x.formatted)) == x.formatted.count("</turn>") == len(blocks)


def test_formatting_of_the_planted_turns(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None)]
    for name, data in (("some", rows), ("none", [])):
        chats(spark, data).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = {x.conv_id: x for x in chat_format.op11_chat_format(spark, f"{tmp_path}/some").collect()}
    hard = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].turns_sha256 == sha(f"user\n{hard}\nassistant\n{hard}\n") and got[-7].loss_sha256 == sha(hard) and got[-7].loss_chars == len(hard)
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\nassistant\n\n") and got[1].loss_sha256 == sha("b") and got[1].formatted_chars == len("### User: a</turn>\n### Assistant: b</part></turn>\n")
    assert [x.conv_id for x in chat_format.op11_chat_format(spark, f"{tmp_path}/none").collect()] == [-7]


def every_edit(initials, must, cut):
    """The least (cost, audit) of all edits, with no more insertions than can help."""
    n, best, seen = len(initials), (4 * len(initials) + 1, ""), []

    def go(i, roles, cost, audit):
        if cost > best_cost[0]:
            return
        if i == n and re.fullmatch("(s?(ua)+)?", roles):
            seen.append((cost, audit))
            best_cost[0] = min(best_cost[0], cost)
        for role in "ua":
            if not re.fullmatch("s?(ua)*u?", roles + role):
                continue
            go(i, roles + role, cost + 3, audit + "I")
            if i < n and not must[i]:
                go(i + 1, roles + role, cost + 3 + cut[i], audit + "R")
        if i < n:
            go(i + 1, roles, cost + 4, audit + "D")
            if not must[i] and re.fullmatch("s?(ua)*u?", roles + initials[i]) and initials[i] in "sua":
                go(i + 1, roles + initials[i], cost + cut[i], audit + "K")

    best_cost = [best[0]]
    go(0, "", 0, "")
    return min(seen)


def test_search_finds_the_cheapest_edits():
    r = np.random.RandomState(5)
    cases = [list(c) for n in range(4) for c in itertools.product("suax", repeat=n)] + [["suax"[k] for k in r.randint(0, 4, n)] for n in (4, 5, 6) for _ in range(60)]
    for initials in cases:
        must = [bool(x) for x in r.rand(len(initials)) < 0.2]
        cut = [0 if m or r.rand() < 0.6 else 3 for m in must]
        assert conversation_repair.cheapest(initials, must, cut)[:2] == every_edit(initials, must, cut), (initials, must, cut)


@pytest.mark.parametrize("make", [lambda n, r: ["s"] * n, lambda n, r: ["suax"[k] for k in r.randint(0, 4, n)], lambda n, r: ["u", "a"] * (n // 2), lambda n, r: ["a"] * n])
def test_search_is_linear(make):
    r = np.random.RandomState(1)
    for n in (1000, 20000):
        initials = make(n, r)
        assert conversation_repair.cheapest(initials, [False] * n, [3 * int(x) for x in r.randint(0, 2, n)])[2] <= 12 * n + 20


def test_repaired_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 4, "user", "Hi"), (2, 4, "user", "Hi"), (2, 9, "assistant", " \t"), (3, None, None, None), (4, None, "system", "S."), (4, 0, "assistant", "A!"), (None, 1, "user", "x?")]
    got = {x.conv_id: x for x in conversation_repair.repaired(chats(spark, rows)).collect()}
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (0, "KK", sha("user:Hi.\nassistant:Yes."))
    assert (got[2].gaps, got[2].blank, got[2].duplicate, got[2].truncated, got[2].illegal) == (4, 1, 1, 1, 1)
    assert (got[2].cost, got[2].audit) == (12, "DDD")
    assert (got[3].gaps, got[3].blank, got[3].cost, got[3].audit, got[3].repaired_sha256) == (0, 1, 4, "D", sha(""))
    assert (got[4].audit, got[4].cost, [tuple(x) for x in got[4].repaired]) == ("KIK", 3, [("system", "S."), ("user", ""), ("assistant", "A!")])
    assert (got[None].cost, got[None].audit) == (3, "KI")
    assert conversation_repair.repaired(chats(spark, [])).count() == 0
    gone = conversation_repair.repaired(chats(spark, rows[:1]).withColumn("times", F.lit(0))).drop("repaired", "nodes").first()
    assert tuple(gone) == (1, 0, 0, 0, 0, 0, 0, "", sha(""))


def test_damage_by_the_key(spark):
    rows = [(c, t, "assistant", "a.b!") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    for x in conversation_repair.damaged(chats(spark, rows)).collect():
        key = ":".join(" " if v is None else str(v) for v in (x.conv_id, x.turn))
        kind, role, text = zlib.crc32(key.encode()) % 20, "assistant" if x.conv_id is not None else " ", "a.b!" if x.conv_id is not None else " "
        assert x.times == {0: 0, 3: 2}.get(kind, 1) and x.role == ("user" if kind == 4 else role)
        if kind:
            assert x.text == {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)


def every_run(words):
    out, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, n, p) for (s, n), p in out.items())


def words_of_kind(r, k):
    n = int(r.randint(1, 160))
    if k == 0:
        return ["ab"[x] for x in r.randint(0, 2, n)]
    if k == 1:
        base = [f"w{x}" for x in r.randint(0, 3, r.randint(1, 9))]
        return (base * n)[:n] + ["z"] + base * 3
    if k == 2:
        a, b = ["x"], ["x", "y"]
        while len(b) < n:
            a, b = b, b + a
        return b
    if k == 3:
        return ["x"] * n + ["y"] + ["x"] * n
    return [f"w{x}" for x in r.randint(0, 50, n)] * int(r.randint(1, 4))


def test_runs_are_those_of_brute_force(spark):
    r = np.random.RandomState(11)
    docs = [(i, " \n".join(words_of_kind(r, i % 5))) for i in range(250)] + [(-1, None), (-2, ""), (-3, " \t"), (None, "a " * 40), (7, "a " * 40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, runs string").repartition(3)
    got = sorted(((x.doc_id is None, x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic_runs.periodic_runs(df).collect()), key=repr)
    want = []
    for i, t in docs:
        w = (t or "").split()
        found = every_run(w)
        drop = {k for s, n, p in found for k in range(s + p, s + n)}
        want.append((i is None, i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in drop)))
    assert got == sorted(want, key=repr)


def test_agreement_of_places():
    r = np.random.RandomState(2)
    for k in range(5):
        counts = np.array([len(words_of_kind(r, k)) for _ in range(6)])
        words = r.randint(1, 3, counts.sum()).astype(np.uint64)
        bar = np.zeros(len(words) + len(counts) + 1, bool)
        bar[np.cumsum(counts) - counts + np.arange(len(counts))] = bar[-1] = True
        s = np.zeros(len(bar), np.uint64)
        s[~bar] = words
        s[bar] = np.arange(bar.sum()) + 100
        g = periodic_runs.Grammar(s, bar)
        x, y = r.randint(1, len(s) - 1, 300), r.randint(1, len(s) - 1, 300)
        x, y = x[x != y], y[x != y]
        for step in (1, -1):
            for a, b, n in zip(x, y, g.agree(x, y, step)):
                m = 0
                while s[a + step * m] == s[b + step * m]:
                    m += 1
                assert n == m


def test_periodic_runs_query(spark, tmp_path):
    texts = {i: " ".join(f"w{(i * k) % 97}" for k in range(3 + i % 70)) for i in range(200)} | {500: None, 501: ""}
    spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, n_runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = every_run(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        drop = {k for s, m, p in found for k in range(s + p, s + m)}
        want = (i, len(found), *best, found and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))
        assert tuple(got[i]) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic_runs.op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0
