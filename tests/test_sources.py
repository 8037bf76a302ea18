import math
import re

import pytest
from pyspark.sql import functions as F

from capturelab.sources import captures as C


def one(spark, content, **policy):
    return C.parsed(spark.createDataFrame([("f", content)], "file string, content binary"), **policy).first()


HEAD = b"maker,acme\nrange;7\n"


@pytest.mark.parametrize(
    "content, signal, line, empty, error",
    [
        (HEAD + b" daTA \r\n3,-61.5\r\n4,-62\r\n", [-61.5, -62], 3, 0, None),
        (b"DATA\n7,1.5\n \n8\t2.5\n", [1.5, 2.5], 1, 1, None),
        (b"DATA\n9,,4e1,5\n", [40], 1, 0, None),
        (b"DATA\n1,1_0\n2,+.5\n", [10, 0.5], 1, 0, None),
        (HEAD + b"1,2\n", [], None, 0, "no DATA section"),
        (HEAD + b"DATA\n1,5\n2,five\n3,nan\n", [], 3, 0, "line 5: not numeric"),
        (b"DATA\n1,5\n\n2,-Infinity\n", [], 1, 1, "line 4: not finite"),
        (b"DATA\n1,5\n6\n", [], 1, 0, "line 3: column 1 required"),
        (b"DATA\n1,1d\n", [], 1, 0, "line 2: not numeric"),
        (b"DATA\n\n", [], 1, 1, "no numeric values"),
        (b"DATA", [], 1, 0, "no numeric values"),
        (b"", [], None, 0, "no DATA section"),
        (None, [], None, 0, "no DATA section"),
        (b"\xff\xff\xff", [], None, 0, "neither utf-8 nor gb18030"),
    ],
)
def test_strict(spark, content, signal, line, empty, error):
    r = one(spark, content)
    assert (r.signal, r.data_marker_line, r.skipped_empty_rows, r.parse_error) == (signal, line, empty, error)


def test_policies(spark):
    text = b"note\nDATA\n1,5\n2,x\n3\n4,inf\n5,6\n"
    r = one(spark, text, skip_invalid=True)
    assert (r.signal, r.numeric_value_count, r.discarded_nonfinite_count, r.skipped_invalid_rows) == ([5, 6], 2, 1, 2)
    assert one(spark, text, need_marker=False).parse_error == "line 4: not numeric"  # a marker that is not needed still makes rows strict
    r = one(spark, "﻿x level\n0 5\n1 nan\n\n2 6.5\nend".encode(), need_marker=False)
    assert (r.signal, r.parser_mode, r.encoding, r.delimiter) == ([5, 6.5], "legacy_last_column", "utf-8-sig", "whitespace")
    assert (r.skipped_invalid_rows, r.discarded_nonfinite_count, r.skipped_empty_rows, r.data_marker_line) == (2, 1, 1, None)
    r = one(spark, "仪器,一\nDATA\n0\t-7\n".encode("gb18030"))
    assert (r.signal, r.encoding, r.delimiter) == ([-7], "gb18030", "tab")


def test_numbers_are_those_of_python(spark):
    import random

    r = random.Random(1)
    fields = {"".join(r.choice("0123.eE+-_naifd") for _ in range(r.randint(1, 6))) for _ in range(4000)} | {"nan", "-NaN", "Infinity", "+inf", "1e400", "5.", ".5", ".", "1e", "infinit"}

    def want(s):
        try:
            return float(s)
        except ValueError:
            return None

    got = {x.s: x.v for x in spark.createDataFrame([(s,) for s in fields], "s string").select("s", C.number(F.col("s")).alias("v")).collect()}
    for s in fields:
        w = want(s)
        assert got[s] == w or (w is not None and math.isnan(w) and math.isnan(got[s])), s


def test_cells_and_points(spark):
    rows = [("a", b'q\n"t",DATA,u\n1,-3,9\n2,,8\n\n3,inf,7\n4\n'), ("b", b"1,2,x\n,5,\nz\n"), ("c", b"k\n"), ("d", b"\xff\xff\xff")]
    got = {r.file: r for r in C.parsed_cells(spark.createDataFrame(rows, "file string, content binary")).collect()}
    assert got["a"].signal == [-3, 4] and got["b"].signal == [2, 5] and got["c"].parse_error == "no numeric values" and got["d"].parse_error
    rows = [("a", b"h\nDATA\n1,2\n3,x\n4\n5 6 7\nnan,8\n"), ("b", b"1,2\n"), ("c", b"DATA\nx,y\n"), ("d", b"\xffz\nDATA\n1,2\n")]
    got = {r.file: r for r in C.parsed_points(spark.createDataFrame(rows, "file string, content binary")).collect()}
    assert [tuple(p) for p in got["a"].points] == [(1, 2), (5, 6)] and got["b"].parse_error == "no DATA section" and got["c"].parse_error == "no numeric values" and len(got["d"].points) == 1


def test_folder(spark, tmp_path):
    for name, text in (("s_1/f/a.csv", "DATA\n0,1\n"), ("s_1/b.csv", "DATA\n0,x\n"), ("s_2/c.txt", "DATA\n0,1\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.file.split("/")[-1]: r.parse_error for r in C.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": None, "b.csv": "line 2: not numeric"}


def test_fields_of_odd_lines(spark):
    lines = ["", " ", ",", "a", ",a,,b ", "a\tb\u00a0c\u3000d\u2003e", "\u200b x\ufeff", "-1,,é 5", " , a"]
    want = [[f for f in re.split(r"[,\s]+", x) if f] for x in lines]
    x = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    assert [r.f for r in x.select("i", C.fields_of(F.col("line")).alias("f")).orderBy("i").collect()] == want
    assert [one(spark, text, need_marker=False).signal for text in ("\ufeff1\n".encode(), "\ufeff\ufeff1\n".encode(), "1\ufeff\n2".encode())] == [[1], [], [2]]
