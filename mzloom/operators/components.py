"""Connected components of edge tables, and greedy selections within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mzloom.storage import discard, materialise

__all__ = ["connected_components", "dealt", "discard", "materialise"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b) of any orderable type; the component is its smallest node.

    Large-star and small-star rounds until nothing changes; nothing is collected but a checksum per round, and
    every round's table is deleted once the next one is written.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), e)
        now = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first())
        if mark == now or not now[0]:
            break
        mark = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def dealt(df: DataFrame, component: str = "component", rows: int = 20_000) -> DataFrame:
    """Adds _bucket, which keeps components whole and holds about ``rows`` rows.

    Greedy selections don't interact between components, so a bucket of them can be decided at once;
    that saves the cost of one Python call per component.
    """
    n = max(1, df.count() // rows)
    return df.withColumn("_bucket", F.pmod(F.xxhash64(component), F.lit(n)))
