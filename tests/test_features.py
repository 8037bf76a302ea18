"""Features of captures are made for a bounded number of rows at a time."""

from pyspark.sql import functions as F

from capturelab.functions import waveforms


def test_features_by_bounded_parts(spark):
    def work(x):
        assert len(x) <= 512
        return x * 2

    x = spark.range(2000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.array(F.col("id").cast("double"), F.lit(1.0))).alias("v"))
    got = {r.id: r.y for r in x.select("id", waveforms._made("array<double>", work)("v").alias("y")).collect()}
    assert got == {i: [2.0 * i, 2.0] if i % 7 else None for i in range(2000)}
