"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each round is a grouped minimum and a join back, so a vertex with very many edges is aggregated before the shuffle and
its join is one that Spark can split. Rounds are cut off by tables in the shared folder and old ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.runtime import drop_path, scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge (a, b: long; loops and nulls are ignored)."""
    spark = edges.sparkSession
    schema = "a long, b long"
    path = scratch(spark, "edges")
    edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a is not null and b is not null and a > b").distinct().write.parquet(path)
    last = None
    while True:
        now = spark.read.schema(schema).parquet(path)
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.hash("b").cast("long")).alias("s")).first()
        if state == last or state["n"] == 0:
            break
        last = state
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: the smaller neighbours of u and u itself point to the smallest
        small_m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_m.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        nxt = scratch(spark, "edges")
        small.write.parquet(nxt)
        drop_path(spark, path)
        path = nxt
    stars = spark.read.schema(schema).parquet(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b")).distinct()
