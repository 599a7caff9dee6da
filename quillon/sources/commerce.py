"""Driver tables as assertions: rows become individuals, foreign keys edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


#: Role: table, subject letter and key, object letter and key.
ROLES = {
    "inRegion": ("nation", "n", "n_nationkey", "r", "n_regionkey"),
    "inNation": ("customer", "c", "c_custkey", "n", "c_nationkey"),
    "basedIn": ("supplier", "s", "s_suppkey", "n", "s_nationkey"),
    "placed": ("orders", "c", "o_custkey", "o", "o_orderkey"),
    "contains": ("lineitem", "o", "l_orderkey", "p", "l_partkey"),
    "suppliedBy": ("lineitem", "o", "l_orderkey", "s", "l_suppkey"),
}


def edges(spark: SparkSession, sf_dir: str, *roles: str) -> DataFrame:
    """(x, r, y) of the roles; lineitem has no key, so edges are sets."""
    found = None
    for role in roles:
        name, a, left, b, right = ROLES[role]
        rows = table(spark, sf_dir, name).select(named(a, left).alias("x"), F.lit(role).alias("r"), named(b, right).alias("y")).distinct()
        found = rows if found is None else found.union(rows)
    return found


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, c): parts in the class of their type."""
    return table(spark, sf_dir, "part").select(named("p", "p_partkey").alias("x"), F.col("p_type").alias("c"))
