"""A table of features that is only ever added to: what is there under the same file and settings is not computed again.

Under a folder for the settings, features lie in parts that are never changed, and numbered manifests list the parts that count. An update writes its part
first and then commits a manifest with the next number, which only one of several writers can create. So a reader, who takes the highest manifest, sees all
of an update or nothing of it; a part without a manifest is a leftover of a job that failed.
"""

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settings_hash(settings: dict) -> str:
    return hashlib.sha1(json.dumps(settings, sort_keys=True).encode()).hexdigest()


class _Folder:
    """The manifests of a folder, through the file system that Spark has for it."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.gateway, self.path = jvm, spark.sparkContext._gateway, path
        self.at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self.files = self.at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> tuple[int, list[str]]:
        """The highest manifest's number and its parts; 0 and none without one."""
        if not self.files.exists(self.at("manifests")):
            return 0, []
        numbers = [int(s.getPath().getName()) for s in self.files.listStatus(self.at("manifests")) if s.getPath().getName().isdigit()]
        if not numbers:
            return 0, []
        with_number = f"manifests/{max(numbers):010d}"
        stream = self.files.open(self.at(with_number))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def commit(self, number: int, parts: list[str]) -> bool:
        """Creates the manifest of this number; False if another writer has."""
        self.files.mkdirs(self.at("manifests"))
        draft, final = self.at(f"drafts/{uuid.uuid4().hex}"), self.at(f"manifests/{number:010d}")
        stream = self.files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(parts).encode()))
        finally:
            stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            self.context.rename(self.context.makeQualified(draft), self.context.makeQualified(final), self.gateway.new_array(kind, 0))
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.files.delete(draft, False)
            return False


def _read(spark: SparkSession, folder: str, parts: list[str]) -> DataFrame | None:
    return spark.read.parquet(*(f"{folder}/parts/{p}" for p in parts)) if parts else None


def update(captures: DataFrame, path: str, settings: dict, compute: Callable[[DataFrame], DataFrame], rebuild: bool = False) -> DataFrame:
    """Features of captures (file, ...) from the store at path. Missing ones are computed (compute keeps file and key) and committed as a part; rebuild computes all and commits a manifest with that part alone.

    Of two updates at once the later to commit starts from the other's manifest: it keeps of its part what the other has not.
    """
    spark, folder = captures.sparkSession, f"{path}/settings={settings_hash(settings)}"
    keyed = captures.withColumn("key", F.sha1(F.concat_ws("|", "file", F.lit(settings_hash(settings))).cast("binary")))
    store = _Folder(spark, folder)
    number, parts = store.latest()
    there = None if rebuild else _read(spark, folder, parts)
    part = uuid.uuid4().hex
    compute(keyed if there is None else keyed.join(there.select("key"), "key", "left_anti")).write.parquet(f"{folder}/parts/{part}")
    while not store.commit(number + 1, [part] if rebuild else [*parts, part]):
        seen = set(parts)
        number, parts = store.latest()
        others = _read(spark, folder, [p for p in parts if p not in seen])
        if others is not None and not rebuild:
            fresh = uuid.uuid4().hex
            spark.read.parquet(f"{folder}/parts/{part}").join(others.select("key"), "key", "left_anti").write.parquet(f"{folder}/parts/{fresh}")
            part = fresh
    return features(spark, path, settings).join(keyed.select("key"), "key", "left_semi")


def features(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """All that the store has under these settings, by the manifest that is the latest now."""
    folder = f"{path}/settings={settings_hash(settings)}"
    found = _read(spark, folder, _Folder(spark, folder).latest()[1])
    if found is None:
        raise FileNotFoundError(folder)
    return found
