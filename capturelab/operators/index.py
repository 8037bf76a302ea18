"""From the paths of capture files to an index: classes, groups, conditions and labels.

files: file string, a path below a root. Paths are cut at "/"; a root is named without its last "/".
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

COLUMNS = ("file", "source_root", "group", "condition_path", "label")


def below(files: DataFrame, root: str) -> DataFrame:
    """The files below root, with `parts`, the path from there on."""
    head = f"{root.rstrip('/')}/"
    return files.where(F.col("file").startswith(head)).withColumn("parts", F.split(F.substring(F.col("file"), len(head) + 1, 2**31 - 1), "/"))


def class_names(files: DataFrame, root: str) -> DataFrame:
    """(class): the distinct folders right below root, in order."""
    return below(files, root).where(F.size("parts") > 1).select(F.get("parts", 0).alias("class")).distinct().orderBy("class")


def by_frequency(files: DataFrame, root: str) -> DataFrame:
    """(class, frequency, file): files one folder below a class are of that frequency, those right in a class of `default`; deeper ones are left out."""
    x = below(files, root).where(F.size("parts").isin(2, 3))
    return x.select(F.get("parts", 0).alias("class"), F.when(F.size("parts") == 3, F.get("parts", 1)).otherwise("default").alias("frequency"), "file")


def grouped(files: DataFrame, root: str) -> DataFrame:
    """(group, file): files by the folder right below root; if no folder has any, all are of one group named as the root. Files beside such folders belong to none."""
    x = below(files, root)
    deep = x.agg(F.coalesce(F.max(F.size("parts") > 1), F.lit(False)).alias("nested"))
    x = x.crossJoin(F.broadcast(deep)).where((F.size("parts") > 1) | ~F.col("nested"))  # one row
    return x.select(F.when(F.col("nested"), F.get("parts", 0)).otherwise(root.rstrip("/").split("/")[-1]).alias("group"), "file")


def _placed(files: DataFrame, root: str) -> DataFrame:
    """Files in folders below root, with their group and condition path: what lies between group and file."""
    x = below(files, root).where(F.size("parts") > 1)
    return x.select("file", F.get("parts", 0).alias("group"), F.array_join(F.slice("parts", 2, F.greatest(F.size("parts") - 2, F.lit(0))), "/").alias("condition_path"))


def single_rows(files: DataFrame, root: str, classes: list[str]) -> DataFrame:
    """Index rows of groups that are classes, with one-hot labels."""
    hot = F.array(*((F.col("group") == c).cast("int") for c in classes))
    return _placed(files, root).where(F.col("group").isin(classes)).select("file", F.lit("single").alias("source_root"), "group", "condition_path", hot.alias("label"))


def combo_rows(files: DataFrame, root: str, classes: list[str]) -> DataFrame:
    """Index rows of groups whose name says which classes are mixed; the others are left out."""
    x = _placed(files, root).withColumn("p", L.parse_group(F.col("group"), classes))
    return x.where(F.col("p.error").isNull()).select("file", F.lit("real_dataset").alias("source_root"), "group", "condition_path", F.col("p.label").alias("label"))


def skipped(files: DataFrame, single: str | None, combo: str | None, classes: list[str]) -> DataFrame:
    """(source_root, group, reason, files): groups without index rows."""
    out = []
    if single is not None:
        out.append(_placed(files, single).where(~F.col("group").isin(classes)).select(F.lit("single").alias("source_root"), "group", F.lit("no class").alias("reason")))
    if combo is not None:
        x = _placed(files, combo).withColumn("reason", L.parse_group(F.col("group"), classes)["error"])
        out.append(x.where(F.col("reason").isNotNull()).select(F.lit("real_dataset").alias("source_root"), "group", "reason"))
    both = out[0].unionByName(out[1]) if len(out) > 1 else out[0]
    return both.groupBy("source_root", "group", "reason").agg(F.count("*").alias("files"))


def index(files: DataFrame, single: str | None, combo: str | None, classes: list[str]) -> DataFrame:
    """The index of either root or both, in the order of source root, group, condition and file; labels as text and as a column for each class."""
    sides = [make(files, root, classes) for make, root in ((single_rows, single), (combo_rows, combo)) if root is not None]
    rows = sides[0].unionByName(sides[1]) if len(sides) > 1 else sides[0]
    one = [F.get("label", i).alias(c) for i, c in enumerate(classes)]
    return rows.select("file", "source_root", "group", "condition_path", L.label_text(F.col("label")).alias("label"), *one).orderBy("source_root", "group", "condition_path", "file")


def bucket(group: Column, classes: list[str]) -> Column:
    """A class's group is itself, a mixed one is `mix`, and any other is itself."""
    return F.when(~group.isin(classes) & group.endswith("_mix"), "mix").otherwise(group)


def not_indexed(files: DataFrame, rows: DataFrame, *roots: str) -> DataFrame:
    """(file): files below the roots that the index does not have."""
    every = below(files, roots[0]).select("file")
    for root in roots[1:]:
        every = every.unionByName(below(files, root).select("file"))
    return every.join(rows.select("file"), "file", "left_anti")


def missing_labels(rows: DataFrame, classes: int) -> DataFrame:
    """(label): the label texts of non-empty combinations that no row has."""
    spark = rows.sparkSession
    bits = [F.shiftright("id", classes - 1 - k).bitwiseAND(F.lit(1)).cast("int") for k in range(classes)]
    every = spark.range(1, 2**classes).select(L.label_text(F.array(*bits)).alias("label"))
    return every.join(rows.select("label").distinct(), "label", "left_anti")


def map_differences(rows: DataFrame, given: dict[str, int]) -> DataFrame:
    """(group, problem): groups that the map lacks (missing) and groups of the map without rows (extra); none if both agree."""
    known = rows.sparkSession.createDataFrame([(g, i) for g, i in given.items()], "group string, place int")
    found = rows.select("group").distinct()
    return found.join(F.broadcast(known), "group", "left_anti").select("group", F.lit("missing").alias("problem")).unionByName(known.join(found, "group", "left_anti").select("group", F.lit("extra").alias("problem")))


def training_rows(rows: DataFrame, classes: int, split: str | None = None) -> DataFrame:
    """The rows of a split that are selected for training (those that don't say so are); a label of another length than `classes` is an error."""
    x = rows if split is None else rows.where(F.col("split") == split)
    if "selected_for_train" in rows.columns:
        chosen = F.lower(F.trim(F.coalesce(F.col("selected_for_train").cast("string"), F.lit("true"))))
        x = x.where((F.col("split") != "train") | chosen.isin("", "1", "true", "yes", "y"))
    bits = F.filter(F.split(F.regexp_replace("label", r"[\[\]\s]", ""), ","), lambda t: t != "")
    ok = F.size(bits) == classes
    x = x.withColumn("label_vec", F.when(ok, F.transform(bits, lambda t: t.cast("double").cast("int"))).otherwise(F.raise_error(F.concat(F.lit("a label of another length: "), F.col("label")))))
    return x


def single_source(rows: DataFrame) -> DataFrame:
    """Rows whose label_vec has exactly one class."""
    return rows.where(F.aggregate("label_vec", F.lit(0), lambda a, v: a + v) == 1)


def summary(rows: DataFrame) -> DataFrame:
    """(level, group, ratio, n) of index rows: counts by group and ratio (level 0), by group (1), by ratio (2) and of all (3); `*` where a level has no key."""
    g = rows.groupingSets([["group"], ["ratio"], ["group", "ratio"], []], "group", "ratio").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return g.select(F.col("gid").cast("int").alias("level"), F.coalesce("group", F.lit("*")).alias("group"), F.coalesce("ratio", F.lit("*")).alias("ratio"), "n")
