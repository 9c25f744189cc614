"""Connected components of an edge table by contraction, and what rounds of an algorithm share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which a cluster names in spark.checkpoint.dir. Where that is
    unset, a local session gets a fresh folder under /tmp, set for later calls; on a cluster this is an error,
    since executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs no recomputation of earlier rounds.
    A checkpoint would keep the plan's estimated size, which every join multiplies: after some rounds of joins it
    has thousands of digits. A written table has its real size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (src, dst), component being the smallest node reachable.

    Each round contracts: a node points to its neighbour that comes first in an order by hash, and moves to the first
    of that one and the one it points to; edges are drawn between where their ends have moved. Two nodes that point
    to each other so move to one, the leaves of a star all to one, and of a chain, whatever its ids' order, some
    third remains. Edges within one node fall away, repeated ones become one, and nodes without edges are settled, so
    the edge list shrinks by a factor each round. At the end the rounds are followed backwards, and every component
    is named by its smallest node.
    """
    left = cut_lineage(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct())
    rounds: list[DataFrame] = []
    for step in range(max_rounds):
        if left.isEmpty():
            break
        named = lambda node, to: left.select(F.col(node).alias("node"), F.struct(F.xxhash64(F.lit(step), to).alias("h"), F.col(to).alias("n")).alias("to"))  # noqa: E731, B023
        points = named("src", "dst").unionByName(named("dst", "src")).groupBy("node").agg(F.min("to").alias("to"))
        onward = points.select(F.col("node").alias("over"), F.col("to").alias("next"))
        hops = points.withColumn("over", F.col("to.n")).join(onward.hint("merge"), "over")
        hops = cut_lineage(hops.select("node", F.least("to", "next").getField("n").alias("root")))
        rounds.append(hops)
        a, b = hops.select(F.col("node").alias("src"), F.col("root").alias("a")), hops.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        moved = left.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").filter("a <> b")
        left = cut_lineage(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not rounds:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = rounds[-1]
    for hops in reversed(rounds[:-1]):
        known = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = hops.join(known.hint("merge"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    found = cut_lineage(found)
    names = found.groupBy("root").agg(F.min("node").alias("component"))
    return cut_lineage(found.join(names.hint("merge"), "root").select("node", "component"))


def exact_ranks(rows: DataFrame, *order: Column, name: str = "rank") -> tuple[DataFrame, DataFrame]:
    """(rows with `name`, their number from 1 on in the given order, and `part`; (part, n) for each part). The order
    must tell rows apart. Rows are dealt out by ranges of sampled quantiles and sorted inside, so a part is a range
    of ranks; what a part adds to its rows' own numbers is the sum of the sizes before it, a table of a row a
    part."""
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    written = cut_lineage(numbered).withColumn("part", F.shiftright("__at", 33).cast("int"))
    sizes = written.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(sizes.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    ranked = written.join(F.broadcast(offsets.select("part", "before")), "part")
    return ranked.withColumn(name, F.col("before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "before"), offsets.select("part", "n")
