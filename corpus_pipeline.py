"""From raw documents to token counts: five stages, each over what the one before has kept."""

from pyspark.sql import DataFrame, SparkSession

from capturelab.llm import bpe, decontaminate, near_dup, pii, quality_rules
from capturelab.llm.common import read, shared_dir

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("minhash_near_dup", near_dup.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("byte_bpe", bpe.stage),
]

#: The tagger of personal data is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; each stage's rows are written and read again by the next."""
    import uuid

    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
