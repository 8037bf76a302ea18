"""Labels, combinations and paths, from built-in functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_text(label: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(label, ","), F.lit("]"))


def combo(label: Column) -> Column:
    return F.array_join(label, "")


def combo_index(label: Column) -> Column:
    """Place among the non-empty combinations, in binary order."""
    return F.conv(combo(label), 2, 10).cast("int") - 1


def is_unknown(group: Column) -> Column:
    return group.startswith("unknown") | group.startswith("background")


def parse_group(group: Column, classes: list[str]) -> Column:
    """struct(label, error): the multi-hot label of a group's name. A name is a class or ends in _mix; its source_N tokens must be classes; unknown and background groups are all zeros."""
    tokens = F.array_distinct(F.regexp_extract_all(group, F.lit(r"(source_\d+)"), 1))
    known = F.array(*map(F.lit, classes))
    bad = F.array_except(tokens, known)
    label = F.transform(known, lambda c: F.array_contains(tokens, c).cast("int"))
    zeros = F.array(*[F.lit(0)] * len(classes))
    error = (
        F.when(is_unknown(group), F.lit(None))
        .when(F.size(tokens) == 0, F.lit("no source in the name"))
        .when(F.size(bad) > 0, F.concat(F.lit("unknown sources: "), F.array_join(bad, ",")))
        .when(~(group.isin(classes) | group.endswith("_mix")), F.lit("neither a class nor a mix"))
    )
    return F.struct(F.when(is_unknown(group), zeros).when(error.isNull(), label).alias("label"), error.alias("error"))


def ratio(condition: Column, missing: str | None = None) -> Column:
    """The first path part that starts with ratio_, or radio_, which means the same."""
    part = F.get(F.filter(F.split(condition, "/"), lambda p: p.startswith("ratio_") | p.startswith("radio_")), 0)
    return F.coalesce(F.regexp_replace(part, "^radio_", "ratio_"), F.lit(missing))


def top_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise(F.lit("(root)"))


def label_or_classes(label: Column, classes: list[Column]) -> Column:
    """The label a row's text says ([1,0,1]); where that is null or blank, the one its class columns say (numbers as text; blank counts as 0)."""
    said = F.transform(F.split(F.regexp_replace(label, r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double").cast("int"))
    own = F.array(*(F.coalesce(c.try_cast("double").cast("int"), F.lit(0)) for c in classes))
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", own).otherwise(said)
