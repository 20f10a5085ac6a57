"""Components and small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import fresh_path, shared_dir, stored

__all__ = ["SPACE", "components", "fresh_path", "path_of", "remove", "remove_table", "shared_dir", "stored"]

#: Runs of the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through Spark's own file system."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_of(df: DataFrame) -> str:
    """The folder of a table that stored() returned."""
    return df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else ""


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the least node.

    Alternates two contractions, one towards the least neighbour of each node and one among
    the smaller neighbours. Both use a minimum per node (combined before the shuffle), which is
    written, and a join of two stored tables: no aggregate stands between the join and its exchange,
    so adaptive execution can split the rows of a hub over tasks. Nodes without edges do not occur in
    the result. Null ends are ignored.
    """
    spark = edges.sparkSession
    links = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large, "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = [links, low, large, least]
        links = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        for table in before:
            remove_table(table)
        # done where each node has one link, and those linked to have none
        ends = links.select("a", F.lit(1).alias("n"), F.lit(False).alias("root")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("n"), F.lit(True).alias("root")))
        if ends.groupBy("a").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where("n > 1 or n = 1 and root").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def remove_table(df: DataFrame) -> None:
    where = path_of(df)
    if where:
        remove(df.sparkSession, where)
