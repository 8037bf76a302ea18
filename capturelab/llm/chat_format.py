"""Conversations as one text each, by a template that can be read back, in Spark expressions only.

A conversation's turns are collected as structs and sorted by turn (nulls first, ties by role and
text). Adjacent turns of one role are merged: a block opens with `### Role: `, holds the texts of its
turns with PART between them, and closes with END. Inside a text, a backslash is doubled, `</` becomes
`<\\/`, and three number signs in a row get a backslash before the third, so no control string occurs in
an escaped text and each text comes back exactly. The loss mask covers the texts of assistant turns, not the
headers, PART or END: a conversation's segments are (text, loss) pairs whose texts joined are the formatted text.

A null text or role is empty; an empty text is a turn like others. Roles besides the three known ones
are written after an equals sign, with `%`, `:`, `#` and `<` as their codes. Rows that are repeated are turns of their own. A
null conv_id is a conversation. An empty table has no row. A very long text takes time in proportion. Columns
besides conv_id, turn, role and text play no part. A conversation is one row, so it is held by one task; merging runs in
chunks of CHUNK turns, so that arrays that grow turn by turn stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .quality_rules import _let

PART, END = "</part>", "</turn>\n"
KNOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
CODES = {"%": "%25", ":": "%3A", "#": "%23", "<": "%3C"}
#: Turns that are merged one by one; chunks are then merged with one another.
CHUNK = 64
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "##(?=#)", r"##\\"), F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def _header(role: Column) -> Column:
    coded = role
    for sign, code in CODES.items():
        coded = F.replace(coded, F.lit(sign), F.lit(code))
    name = F.concat(F.lit("="), coded)
    for known, shown in KNOWN.items():
        name = F.when(role == known, shown).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(": "))


def _role(header: Column) -> Column:
    coded = F.substring(header, 2, 2**31 - 1)
    for sign, code in reversed(CODES.items()):
        coded = F.replace(coded, F.lit(code), F.lit(sign))
    for known, shown in KNOWN.items():
        coded = F.when(header == shown, known).otherwise(coded)
    return coded


def _merged(turns: Column) -> Column:
    """(role, texts) of each stretch of turns of one role."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def joined(done: Column, more: Column) -> Column:
        """Two arrays of stretches; the last of one and the first of the other are one if their roles are."""
        last, first = F.get(done, F.size(done) - 1), F.get(more, 0)
        one = F.struct(first["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
        whole = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(one), F.slice(more, 2, F.greatest(F.size(more) - 1, F.lit(0))))
        return F.when(last["role"] == first["role"], whole).otherwise(F.concat(done, more))

    def chunk(k: Column) -> Column:
        one = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
        return F.aggregate(F.slice(turns, k * CHUNK + 1, CHUNK), none, lambda done, t: joined(done, one(t)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / CHUNK).cast("int")), chunk)
    return F.aggregate(chunks, none, joined)


def _segments(merged: Column) -> Column:
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def block(m: Column) -> Column:
        loss = m["role"] == "assistant"
        part = lambda t, k: F.array(segment(F.when(k == 0, _header(m["role"])).otherwise(PART), F.lit(False)), segment(escaped(t), loss))
        return F.concat(F.flatten(F.transform(m["texts"], part)), F.array(segment(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(merged, block))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments): each conversation's text, and its pieces as (text, loss)."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text"))))
    pieces = conversations.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", _let(F.col("turns"), lambda t: _let(_merged(t), _segments)).alias("segments"))
    return pieces.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def loss_spans(segments: Column) -> Column:
    """(start, end) in code points of each segment under the loss mask. Offsets are summed in chunks and over them."""
    size = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    none = F.array().cast("array<bigint>")

    def shifted(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        add = lambda done, n: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + n))
        within = lambda k: F.aggregate(F.slice(xs, k * CHUNK + 1, CHUNK), none, lambda done, x: add(done, F.length(x["text"]).cast("long")))
        before = F.aggregate(F.transform(chunks, lambda k: size(F.slice(xs, k * CHUNK + 1, CHUNK))), none, add)
        ends = _let(before, lambda b: F.flatten(F.transform(chunks, lambda k: F.transform(within(k), lambda n: n + F.coalesce(F.get(b, k - 1), F.lit(0))))))
        spans = F.zip_with(xs, ends, lambda x, end: F.struct((end - F.length(x["text"])).alias("start"), end.alias("end"), x["loss"].alias("loss")))
        return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"]))

    return _let(segments, shifted)


def turns_of(text: Column) -> Column:
    """The (role, text) turns that a formatted text holds."""

    def block(b: Column) -> Column:
        name = F.substring_index(b, ": ", 1)
        body = F.substr(b, F.length(name) + 3)
        return F.transform(F.split(body, PART), lambda t: F.struct(_role(F.substr(name, F.lit(5))).alias("role"), unescaped(t).alias("text")))

    return _let(F.split(text, END), lambda bs: F.flatten(F.transform(F.slice(bs, 1, F.size(bs) - 1), block)))


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, table.schema)
    back = formatted(table.union(added)).select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), learned(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next, length(text) + length(text)-length(replace(text,'\','')) + (length(text)-length(replace(text,'</','')))//2
  + coalesce(list_sum([(length(x)-1)//2 FOR x IN regexp_extract_all(text,'#+')]),0) AS shown,
  CASE WHEN role IN ('system','user','assistant') THEN 6+length(role) ELSE 7+length(role)+2*(length(role)-length(regexp_replace(role,'[%:#<]','','g'))) END AS head
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role='assistant'),0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role='assistant'),'')) AS loss_sha256,
  CAST(sum(shown + CASE WHEN prev=role THEN 7 ELSE head END + CASE WHEN next=role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
