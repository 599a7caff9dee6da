"""Connected components and the representatives that equality axioms give."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows in the folder that spark.checkpoint.dir names; a local session without
    that setting gets a temporary folder.

    The rows go to a table there. DataFrame.checkpoint() would keep the plan's estimate of the size; the
    estimate of a join is the product of its sides', so in a loop the number of its digits doubles every
    round, until planning takes longer than the work. A table has the size that it has.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{context.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, by: str, rows: int = 100_000) -> DataFrame:
    """``df``, dealt by a column to as many partitions as keep them near ``rows`` rows.

    Spark sizes the partitions of files and shuffles by their packed bytes, so rows that pack well would come to
    a task by millions.
    """
    return df.repartition(1 + df.count() // rows, by)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of edges (a, b): component is the smallest node that is reachable.

    Loops give a node of its own; edges with a null end are left out. Nodes are joined by 64-bit hashes
    of their names, which Spark moves and sorts faster; if any two names share a hash, by the names.
    """
    ends = edges.where("a is not null and b is not null").select(F.array("a", "b").alias("e"))  # of one type
    names = checkpoint(ends.select(F.explode("e").alias("node")).distinct().select(F.xxhash64("node").alias("id"), "node"))
    if not clear(names):
        return stars(ends.select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b")), most_rounds)
    found = stars(ends.select(F.xxhash64(F.col("e")[0]).alias("a"), F.xxhash64(F.col("e")[1]).alias("b")), most_rounds)
    named = names.join(found.withColumnRenamed("node", "id"), "id").select("node", F.col("component").alias("id"))
    return named.join(named.groupBy("id").agg(F.min("node").alias("component")), "id").select("node", "component")


def clear(names: DataFrame) -> bool:
    """Whether no two of the distinct names (id, node) share an id."""
    return names.groupBy("id").count().where("count > 1").isEmpty()


def stars(pairs: DataFrame, most_rounds: int) -> DataFrame:
    """(node, component) of edges (a, b) without nulls: component is the smallest node that is reachable.

    Alternates large-star and small-star rounds: every component shrinks to a star around
    its smallest node in about log(n) rounds, and edges get fewer, so hubs do not stay hot.
    """
    lone = pairs.where("a = b").select(F.col("a").alias("node"))
    now = checkpoint(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(most_rounds if seen[0] else 0):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = checkpoint(pairs.select("x.u", "x.v").where("u <> v").distinct())
        if seen == (seen := mark(now)):
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v"))
    return found.union(lone.select("node", "node")).groupBy("node").agg(F.min("component").alias("component"))


def representatives(individuals: DataFrame, same: DataFrame) -> DataFrame:
    """(x, rep): each individual with the smallest one that equality (a, b) makes it equal to."""
    found = components(same)
    return individuals.select("x").join(found, F.col("x") == F.col("node"), "left").select("x", F.coalesce("component", "x").alias("rep"))
