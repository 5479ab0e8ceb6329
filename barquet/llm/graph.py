"""Connected components of a graph that is a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquet.session import scratch


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the cluster's shared folder, read again.

    Like a checkpoint this cuts the lineage, but it also makes the size known. A checkpoint keeps the size that was
    estimated for its plan; a join's estimate is the product of its sides', so in a loop of joins the estimates'
    numbers of digits multiply each round until they fill the driver's memory.
    """
    spark = frame.sparkSession
    path = scratch(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges (``a, b``, both long): nodes are connected if their roots are equal.

    Rounds of contraction: each node merges into its smallest neighbour (or itself) by an order that a hash draws
    anew for each round, and the edges between what they merged into go on to the next round until none is left. A
    round keeps a fixed share of the nodes at most, on average, so there are about as many rounds as the logarithm
    of the largest component, whatever its shape. A node's edges are reduced to their minimum before they are
    shuffled. Roots are then handed back from the last round to the first; since rounds shrink, all of them together
    move a few times the nodes of the first. Each round is written to the shared folder.
    """
    left = written(edges.where("a <> b").select("a", "b").distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("x"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(rank("b")), rank("node"))["x"].alias("into")))
        to = lambda end: step.select(F.col("node").alias(end), F.col("into").alias(f"{end}_into"))  # noqa: B023, E731
        left = written(left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_into").alias("a"), F.col("b_into").alias("b")).where("a <> b").distinct())
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps[-1].withColumnRenamed("into", "root")
    for step in reversed(steps[:-1]):
        later = labels.withColumnRenamed("node", "into")
        labels = written(step.join(later, "into", "left").select("node", F.coalesce("root", "into").alias("root")))
    return labels
