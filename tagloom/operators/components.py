"""Connected components of an edge table, by rounds of least labels written to checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clusters(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node and cluster (the least node of its component). Edges hook to the least node in sight until they are stars."""
    spark = edges.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tagloom-"))
    at = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    while True:
        ends = at.select("u", F.lit(1).alias("up")).unionByName(at.select(F.col("v").alias("u"), F.lit(0).alias("up"))).groupBy("u").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        if ends.where("up > 1 OR (up = 1 AND n > 1)").isEmpty():
            break
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small, "u")
        at = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hooked.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
    return at.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct())
