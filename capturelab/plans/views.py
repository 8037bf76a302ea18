"""The driver's tables as captures, index rows and scores."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture for each (event_type, user_id): its values in time order, as levels in dB."""
    e = table(spark, sf_dir, "events")
    value = (-F.col("value") / 5).cast("float").cast("double")
    grouped = e.groupBy("event_type", "user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", value.alias("v")))).alias("x"))
    ratio = F.concat(F.lit("ratio_"), F.col("user_id") % 4)
    return grouped.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("group"), F.concat(ratio, F.lit("/600MHz")).alias("condition_path"), ratio.alias("ratio"), F.transform("x", lambda r: r["v"]).alias("signal"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("group"), F.concat(F.lit("ratio_"), F.col("o_orderstatus")).alias("ratio"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three probabilities and three target bits for each embedding."""
    e = table(spark, sf_dir, "embeddings")
    prob = F.transform(F.slice("embedding", 1, 3), lambda v: 1 / (1 + F.exp(-8 * v.cast("double"))))
    bits = F.array(*(F.shiftright(F.col("label") % 7 + 1, k).bitwiseAND(F.lit(1)).cast("int") for k in (2, 1, 0)))
    return e.select(F.col("vec_id").alias("file"), (F.col("label") % 7 + 1).cast("string").alias("group"), prob.alias("prob"), bits.alias("target"))
