"""Operators that repeat a step until nothing moves: trees of any depth, by pointer doubling.

Each round is written by a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names, so plans don't grow with the rounds and a lost
executor costs one round at most.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where none is set, one of our own in local mode; on a cluster ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpuslink-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder; Spark's cleaner deletes it with its DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def tree_sums(nodes: DataFrame, counts: DataFrame, node: str, parent: str, label: str, n: str = "n") -> DataFrame:
    """(node, path, depth, n): labels from the root as an array, levels above, and own counts with those of all nodes below.

    Round k knows, for each node, its ancestor 2**k levels up, the labels in between, and the sum over the nodes fewer than
    2**k levels below it. A round is two equal joins and one aggregation over a row per node; a tree of depth d takes log2(d) rounds.

    Defined results: a node whose parent is null or no node is a root; null labels are left out of paths; counts of no node are ignored, nodes without
    counts have 0; a node on a cycle, or below one, has null path, depth and n; repeated nodes are one, the one of the least parent and label.
    """
    own = counts.groupBy(F.col(node).alias("id")).agg(F.sum(n).alias("s"))
    each = nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(F.struct(F.col(parent).alias("up"), F.col(label).alias("label"))).alias("x"))
    known = each.select("id", "x.up", "x.label")
    known = known.join(known.select(F.col("id").alias("up"), F.lit(True).alias("is_node")), "up", "left")
    at = known.select("id", F.when(F.col("is_node"), F.col("up")).alias("up"), F.array_compact(F.array("label")).alias("path"), F.lit(0).alias("depth")).join(own, "id", "left")
    at = settled(at.select("id", "up", "path", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"), F.coalesce("s", F.lit(0)).cast("long").alias("s")))
    total, span = at.count(), 1
    while span <= total and not at.filter("up is not null").isEmpty():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        below = at.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("s").alias("_s"))
        moved = at.join(above, "up", "left").join(below, "id", "left")
        at = settled(moved.select(
            "id", F.col("_up").alias("up"), F.when(F.col("_path").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path")).alias("path"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("s") + F.coalesce("_s", F.lit(0))).alias("s"),
        ))
        span *= 2
    done = F.col("up").isNull()
    return at.select(F.col("id").alias(node), F.when(done, F.col("path")).alias("path"), F.when(done, F.col("depth")).alias("depth"), F.when(done, F.col("s")).alias("n"))
