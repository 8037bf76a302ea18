"""Conversations repaired by the cheapest edits that give the roles `(s?(ua)+)?`.

A row may be kept, be given the role user or assistant, or be deleted, and empty turns of these two roles
may be put anywhere. Blank and repeated rows must go; a row that breaks off costs more where it stays. `cheapest`
searches depth first over (rows read, place in the pattern), with a stack of its own:

* lower bounds of each suffix come from the pattern without its opening system turn, over the rows from the end; a
  system turn still to come saves one deletion at most;
* the first incumbent comes from following what the rest costs without an opening system turn, so it is a deletion and an opening away from the optimum at most; after that branches are taken in the order of their
  letters, so of edits of equal cost the least is found first, and a prefix is left as soon as its cost and bound can't beat the incumbent;
* the dominance table holds each node's least cost: a prefix that comes later and isn't cheaper is worse, since its letters are later too.

The search ends when the stack is empty, which proves the optimum. In the pattern's places after the first turn the
bounds are exact, so a conversation of n rows takes some n nodes.

A null in conv_id or turn is written as a space in the key that damage is dealt by; a null role or text is a space, so such a text
is blank. Null turns come first; rows of one turn are in the order of role and text. A null conv_id is a conversation. Repeated rows are repeated turns. An empty table has no row. Columns
besides conv_id, turn, role, text and, for `repaired`, times (null: 1) play no part. Rows are sorted by Spark and read as a stream; one conversation at a time is held by a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: Places in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
SPACE = " \t\n\v\f\r"
#: Characters of repaired texts in a batch, and one conversation's more.
BATCH_CHARS = 1 << 22
#: What `repair` returns, after conv_id.
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<struct<role:string,text:string>>, nodes long"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows damaged by the hash of their key; times is how often each occurs, 0 if it is dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.pmod(F.crc32(key.cast("binary")), F.lit(20)), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _bounds(initials: list[str], must: list[bool], cut: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix, what the rest costs at least where a user or an assistant turn is due."""
    n = len(initials)
    user, assistant = [0] * (n + 1), [INSERT] * (n + 1)
    for i in range(n - 1, -1, -1):
        u, a = DELETE + user[i + 1], DELETE + assistant[i + 1]
        if not must[i]:
            u = min(u, cut[i] + assistant[i + 1] + (0 if initials[i] == "u" else REROLE))
            a = min(a, cut[i] + user[i + 1] + (0 if initials[i] == "a" else REROLE))
        user[i], assistant[i] = min(u, INSERT + a), min(a, INSERT + u)
    return user, assistant


def cheapest(initials: list[str], must: list[bool], cut: list[int]) -> tuple[int, str, int]:
    """(cost, audit, nodes): the cheapest edits of rows with these first letters of roles. must: rows that have to go; cut: what a row costs where it stays."""
    n = len(initials)
    user, assistant = _bounds(initials, must, cut)

    def likely(i: int, place: int) -> int:
        """What the rest costs if no system turn opens it."""
        return assistant[i] if place == USER else user[i]

    def least(i: int, place: int) -> int:
        return likely(i, place) if place != START else max(0, user[i] - DELETE)

    def branches(i: int, place: int, cost: int, before) -> list[tuple]:
        """Children in the order of their letters."""
        due, after = ("a", ASSISTANT) if place == USER else ("u", USER)
        out = [(i, after, cost + INSERT, (before, "I"))]
        if i < n:
            out.insert(0, (i + 1, place, cost + DELETE, (before, "D")))
            if not must[i]:
                if initials[i] == due:
                    out.append((i + 1, after, cost + cut[i], (before, "K")))
                else:
                    if initials[i] == "s" and place == START:
                        out.append((i + 1, SYSTEM, cost + cut[i], (before, "K")))
                    out.append((i + 1, after, cost + cut[i] + REROLE, (before, "R")))
        return out

    done = lambda i, place: i == n and place in (START, ASSISTANT)
    node = root = (0, START, 0, None)
    while not done(*node[:2]):
        node = min(branches(*node), key=lambda x: x[2] + likely(x[0], x[1]))
    best, letters, found = node[2], node[3], False
    stack, table, nodes = [root], [float("inf")] * (4 * n + 4), 0
    while stack:
        i, place, cost, before = node = stack.pop()
        bound = cost + least(i, place)
        if bound > best or (found and bound == best) or table[4 * i + place] <= cost:
            continue
        table[4 * i + place], nodes = cost, nodes + 1
        if done(i, place):
            best, letters, found = cost, before, True
        else:
            stack += reversed(branches(*node))
    audit = []
    while letters:
        letters, letter = letters
        audit.append(letter)
    return best, "".join(reversed(audit)), nodes


def _rewritten(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    out, at, turn = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if not (letter == "K" and role[:1] == "s"):
            role = role if letter == "K" else ("user", "assistant")[turn % 2]
            turn += 1
        out.append((role, text))
    return out


def repair(turns: list, rows: list[tuple[str, str]]) -> tuple:
    """What a conversation's row has after its conv_id: turns, and (role, text) in order."""
    seen, must, cut, faults = set(), [], [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for row in rows:
        last = row[1].rstrip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if row in seen else "truncated" if last not in ".!?" else None
        seen.add(row)
        if fault:
            faults[fault] += 1
        must.append(fault in ("blank", "duplicate"))
        cut.append(CUT if fault == "truncated" else 0)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit, nodes = cheapest(initials, must, cut)
    after = _rewritten(rows, audit)
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in after).encode()).hexdigest()
    return gaps, *faults.values(), illegal, cost, audit, digest, [{"role": r, "text": t} for r, t in after], nodes


def _repaired(schema: pa.Schema):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turns, rows, out, size = (), [], [], [], 0
        for b in batches:
            for conv, turn, role, text, times in zip(*(c.to_pylist() for c in b.columns)):
                if at != (conv,):
                    if at:
                        out.append((*at, *repair(turns, rows)))
                        size += sum(len(t) for _, t in rows)
                    if size > BATCH_CHARS or len(out) == 4096:
                        yield batch(out)
                        out, size = [], 0
                    at, turns, rows = (conv,), [], []
                turns += [turn] * times
                rows += [(role, text)] * times
        if at:
            yield batch([*out, (*at, *repair(turns, rows))])

    return run


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text; times: how often a row occurs, 1 if there's no such column): faults, the cheapest edits, and the repaired turns."""
    times = F.coalesce(F.col("times").cast("int"), F.lit(1)) if "times" in rows.columns else F.lit(1)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), times.alias("times"))
    schema = T.StructType([T.StructField("conv_id", x.schema["conv_id"].dataType), *T._parse_datatype_string(RESULT)])
    return x.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repaired(to_arrow_schema(schema)), schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(read(spark, sf_dir, "conversations"))).drop("repaired", "nodes")


def _sql() -> str:
    """The same by dynamic programming: for each row the least (cost, audit) of each place, as text whose order is that of cost, then audit."""
    add = lambda s, k, letter: f"lpad(CAST(CAST(substr({s},1,9) AS INT)+{k} AS VARCHAR),9,'0')||substr({s},10)||'{letter}'"
    put = lambda s: add(s, INSERT, "I")
    gone = lambda s: add(s, DELETE, "D")
    to = lambda s, c: f"CASE WHEN NOT must THEN CASE WHEN c='{c}' THEN {add(s, 'cut', 'K')} ELSE {add(s, f'cut+{REROLE}', 'R')} END END"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, xor(4294967295, list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN
  string_split(coalesce(CAST(conv_id AS VARCHAR),' ')||':'||coalesce(CAST(turn AS VARCHAR),' '),'')], lambda c, b: list_reduce([xor(c,b),1,2,3,4,5,6,7,8], lambda z, i: xor(z >> 1, 3988292384*(z & 1))))) % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h=4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text,'[.!?]','','g') ELSE text END AS text,
  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS z FROM k),
ids AS (SELECT conv_id, row_number() OVER () AS q FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT q, turn, role, text, row_number() OVER w AS i,
  left(role,1) AS c, lead(left(role,1)) OVER w AS nextc, regexp_extract(text,'([^ 	-
])[ 	-
]*$',1) AS last
  FROM d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id WINDOW w AS (PARTITION BY q ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, last='' AS blank, last<>'' AND nth>1 AS dup, last<>'' AND nth=1 AND last NOT IN ('.','!','?') AS trunc FROM (SELECT *, row_number() OVER (PARTITION BY q, role, text ORDER BY i) AS nth FROM o)),
r AS (SELECT *, blank OR dup AS must, CASE WHEN trunc THEN {CUT} ELSE 0 END AS cut FROM f),
n AS (SELECT q, count(*) AS n, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn),0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (nextc IS NOT NULL AND c||nextc NOT IN ('su','ua','au')) AS illegal FROM r GROUP BY q),
s AS (SELECT q, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000003I' AS s2, '000000006II' AS s3 FROM ids
  UNION ALL SELECT q, i, b0, b1, least(b2, {put("b0")}, {put("b1")}, {put("b3")}), least(b3, {add(put("b0"), INSERT, "I")}, {add(put("b1"), INSERT, "I")}, {put("b2")}) FROM (
    SELECT s.q, r.i, {gone("s0")} AS b0, least({gone("s1")}, CASE WHEN NOT must AND c='s' THEN {add("s0", "cut", "K")} END) AS b1,
      least({gone("s2")}, {to("s0", "u")}, {to("s1", "u")}, {to("s3", "u")}) AS b2, least({gone("s3")}, {to("s2", "a")}) AS b3
    FROM s JOIN r ON s.q=r.q AND r.i=s.i+1)),
e AS (SELECT s.q, CAST(substr(least(s0,s3),1,9) AS BIGINT) AS cost, substr(least(s0,s3),10) AS audit FROM s LEFT JOIN n ON s.q=n.q WHERE s.i=coalesce(n.n,0)),
a AS (SELECT q, unnest(range(1,length(audit)+1)) AS k, unnest(string_split(audit,'')) AS l FROM e WHERE audit<>''),
p AS (SELECT *, sum(CAST(l<>'I' AS INT)) OVER w AS i, sum(CAST(l<>'D' AS INT)) OVER w AS t FROM a WINDOW w AS (PARTITION BY q ORDER BY k)),
u AS (SELECT p.q, p.k, p.l, p.t, CASE WHEN p.l='I' THEN '' ELSE r.text END AS text, r.role, p.l='K' AND r.c='s' AS sys FROM p LEFT JOIN r ON p.q=r.q AND p.i=r.i WHERE p.l<>'D'),
v AS (SELECT *, max(CAST(sys AS INT)) OVER (PARTITION BY q) AS opens FROM u),
g AS (SELECT q, sha256(string_agg(CASE WHEN l='K' THEN role WHEN (t-opens) % 2 = 1 THEN 'user' ELSE 'assistant' END||':'||text, chr(10) ORDER BY k)) AS digest FROM v GROUP BY q)
SELECT conv_id, coalesce(gaps,0) AS gaps, coalesce(blank,0) AS blank, coalesce(duplicate,0) AS duplicate, coalesce(truncated,0) AS truncated, coalesce(illegal,0) AS illegal, cost, audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids JOIN e ON ids.q=e.q LEFT JOIN n ON ids.q=n.q LEFT JOIN g ON ids.q=g.q
"""


ORACLE_SQL = _sql()
