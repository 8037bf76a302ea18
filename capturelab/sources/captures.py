"""Reading capture files: text with free metadata, a line DATA, then rows of numbers.

All of it is column expressions over a file's content; only text that is not UTF-8 goes through a helper. A file
that can't be read is a row with parse_error; null content is an empty file. Lines end as in most editors, and
fields are set apart by commas or white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The names of encodings and of parser modes.
UTF8, CHINESE = "utf-8-sig", "gb18030"
WITH_MARKER, WITHOUT_MARKER = "data_section", "legacy_last_column"
_LINE_END, _FIELD = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", r"(?U)[^,\s]+"
_NUMBER, _ENDLESS = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?$", r"(?i)^[+-]?inf(?:inity)?$"


@F.pandas_udf(StringType())
def _gb18030(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(content: bytes | None) -> str | None:
        try:
            return None if content is None else content.decode(CHINESE)
        except UnicodeDecodeError:
            return None

    for content in parts:
        yield content.map(one)


def text_of(content: Column) -> tuple[Column, Column]:
    """The text of a binary column, without a byte order mark, and its encoding; both are null for neither encoding."""
    plain = content.cast("string")
    valid = F.is_valid_utf8(plain)
    text = F.when(valid, F.when(plain.startswith("\ufeff"), F.substr(plain, F.lit(2))).otherwise(plain)).otherwise(_gb18030(F.when(~valid, content)))
    return text, F.when(valid, UTF8).when(text.isNotNull(), CHINESE)


def lines_of(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no line."""
    lines = F.split(text, _LINE_END)
    return F.when(F.try_element_at(lines, F.lit(-1)) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def fields_of(line: Column) -> Column:
    """The fields of a line that are not empty."""
    return F.regexp_extract_all(line, F.lit(_FIELD), F.lit(0))


def number(field: Column) -> Column:
    """A field as a double, NaN and infinities included; null if it is no number."""
    endless = F.when(field.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(field.rlike(_NUMBER), F.replace(field, F.lit("_"), F.lit("")).try_cast("double")).when(field.rlike(_ENDLESS), endless).when(field.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def marker_line(lines: Column) -> Column:
    """The number of the first line that says DATA and nothing else; 0 if none does."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(r"(?iU)^\s*data\s*$")), True).cast("int")


def delimiter(lines: Column) -> Column:
    """How the first line that is not blank is cut: comma, tab, whitespace, or unknown if all are blank."""
    first = F.get(F.filter(lines, lambda x: x.rlike(r"(?U)\S")), 0)
    return F.when(first.contains(","), "comma").when(first.contains("\t"), "tab").when(first.isNotNull(), "whitespace").otherwise("unknown")


def _read(files: DataFrame) -> DataFrame:
    """files (file, content) with text, encoding, lines and the marker's line."""
    text, encoding = text_of(F.coalesce("content", F.lit(b"")))
    x = files.select("file", text.alias("text"), encoding.alias("encoding"))
    x = x.withColumn("lines", lines_of(F.col("text")))
    return x.withColumn("marker", marker_line(F.col("lines")))


def parsed(files: DataFrame, need_marker: bool = True, skip_invalid: bool = False) -> DataFrame:
    """files (file string, content binary) as captures. After a marker, the second field of each row; without one (if allowed), the last field of lines that end in a number. Bad rows after a marker are errors unless skipped; the first is named."""
    x, marked = _read(files), F.col("marker") > 0
    x = x.withColumn("body", F.when(marked, F.slice("lines", F.col("marker") + 1, F.size("lines"))).otherwise(F.col("lines")))
    fields = F.transform("body", fields_of)
    cell = lambda f: F.when(marked, F.get(f, 1)).otherwise(F.try_element_at(f, F.lit(-1)))
    rows = F.transform(fields, lambda f: F.struct(F.size(f).alias("n"), F.when(F.size(f) > 0, number(cell(f))).alias("v")))
    x = x.withColumn("delimiter", delimiter(F.col("body"))).withColumn("rows", rows)
    kind = F.transform("rows", lambda r: F.when(r["n"] == 0, "empty").when(marked & (r["n"] < 2), "column 1 required").when(r["v"].isNull(), "not numeric").when(~finite(r["v"]), "not finite").otherwise("value"))
    x = x.withColumn("kinds", kind)
    count = lambda *of: F.size(F.filter("kinds", lambda k: k.isin(*of)))
    bad = F.get(F.filter(F.transform("kinds", lambda k, i: F.struct(i.alias("i"), k.alias("k"))), lambda b: ~b["k"].isin("empty", "value")), 0)
    x = x.withColumns({"values": count("value"), "endless": count("not finite"), "empty": count("empty"), "invalid": count("column 1 required", "not numeric"), "bad": bad})
    error = F.when(F.col("text").isNull(), "neither utf-8 nor gb18030").when(~marked & F.lit(need_marker), "no DATA section")
    error = error.when(marked & F.col("bad").isNotNull() & F.lit(not skip_invalid), F.concat(F.lit("line "), F.col("bad.i") + F.col("marker") + 1, F.lit(": "), F.col("bad.k"))).when(F.col("values") == 0, "no numeric values")
    x = x.withColumn("parse_error", error)
    good = F.transform(F.filter("rows", lambda r: finite(r["v"])), lambda r: r["v"].cast("float"))
    return x.select(
        "file",
        F.when(F.col("parse_error").isNull(), good).otherwise(F.array().cast("array<float>")).alias("signal"),
        F.coalesce(marked, F.lit(False)).alias("has_data_marker"),
        F.when(marked, F.col("marker")).alias("data_marker_line"),
        F.when(marked, WITH_MARKER).otherwise(WITHOUT_MARKER).alias("parser_mode"),
        "encoding",
        F.coalesce("delimiter", F.lit("unknown")).alias("delimiter"),
        *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("values", "numeric_value_count"), ("endless", "discarded_nonfinite_count"), ("empty", "skipped_empty_rows"), ("invalid", "skipped_invalid_rows"))),
        "parse_error",
    )


def parsed_cells(files: DataFrame) -> DataFrame:
    """(file, signal, parse_error) of comma-separated cells. DATA in any cell ends the metadata; after it the second cell of a row counts, and otherwise the rightmost finite one. Blank cells keep their places, and rows without a value are passed over."""
    x = _read(files)
    cells = F.transform("lines", lambda x: F.transform(F.split(x, ","), lambda c: F.regexp_replace(F.regexp_replace(c, r'(?U)^\s+|\s+$', ""), r'^"(.*)"$', "$1")))
    x = x.withColumn("cells", cells)
    at = F.array_position(F.transform("cells", lambda r: F.exists(r, lambda c: F.upper(c) == "DATA")), True)
    x = x.withColumn("at", F.coalesce(at, F.lit(0)).cast("int"))
    value = lambda r: F.when((F.col("at") > 0) & (F.size(r) >= 2), number(F.get(r, 1))).otherwise(F.try_element_at(F.filter(F.transform(r, number), finite), F.lit(-1)))
    values = F.filter(F.transform(F.slice("cells", F.col("at") + 1, F.size("cells")), value), finite)
    x = x.select("file", "text", F.coalesce(F.transform(values, lambda v: v.cast("float")), F.array().cast("array<float>")).alias("signal"))
    return x.select("file", "signal", F.when(F.col("text").isNull(), "neither utf-8 nor gb18030").when(F.size("signal") == 0, "no numeric values").alias("parse_error"))


def parsed_points(files: DataFrame) -> DataFrame:
    """(file, points, parse_error): time and value of each row after the marker in which both are finite. Bytes that are not UTF-8 are replaced."""
    text = F.regexp_replace(F.make_valid_utf8(F.coalesce("content", F.lit(b"")).cast("string")), r"^\x{FEFF}", "")
    x = files.select("file", lines_of(text).alias("lines")).withColumn("marker", marker_line(F.col("lines")))
    rows = F.transform(F.slice("lines", F.col("marker") + 1, F.size("lines")), fields_of)
    points = F.transform(F.filter(rows, lambda f: F.size(f) >= 2), lambda f: F.struct(number(F.get(f, 0)).alias("t"), number(F.get(f, 1)).alias("v")))
    x = x.withColumn("points", F.when(F.col("marker") > 0, F.filter(points, lambda p: finite(p["t"]) & finite(p["v"]))))
    error = F.when(F.col("points").isNull(), "no DATA section").when(F.size("points") == 0, "no numeric values")
    return x.select("file", F.coalesce("points", F.array().cast("array<struct<t:double,v:double>>")).alias("points"), error.alias("parse_error"))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of all *.csv files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    return files.select(F.col("path").alias("file"), "content")


def read_folder(spark: SparkSession, folder: str, **policy) -> DataFrame:
    """All *.csv files below a folder, parsed."""
    return parsed(listed(spark, folder), **policy)


def backgrounds(spark: SparkSession, folder: str, enabled: bool = True, **policy) -> DataFrame:
    """The captures below a folder of background noise, parsed; none if it is not enabled or there is no such folder."""
    nothing = parsed(spark.createDataFrame([], "file string, content binary"), **policy)
    if not enabled:
        return nothing
    try:
        return read_folder(spark, folder, **policy)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return nothing
