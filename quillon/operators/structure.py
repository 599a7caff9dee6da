"""Axioms as sets: keys of structural equality, distinct axioms, and differences.

Axioms are rows (kind, members): ``members`` is an array of strings, whose order does
not count, except in kinds that are ordered (chains).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import checkpoint, spread
from quillon.operators.constraints import with_least

#: Kinds of axioms whose members have an order.
ORDERED = ["ObjectPropertyChain", "SubClassOf", "SubDataPropertyOf", "SubObjectPropertyOf"]


def axiom_key(kind: Column, members: Column) -> Column:
    """Equal for axioms that are structurally equal: members as a set, or in order for ordered kinds."""
    unordered = F.array_sort(F.array_distinct(members))
    return F.sha2(F.to_json(F.struct(kind.alias("kind"), F.when(kind.isin(ORDERED), members).otherwise(unordered).alias("members"))), 256)


def distinct_axioms(axioms: DataFrame) -> DataFrame:
    """``axioms`` (pos, kind, members) without those that equal an earlier one."""
    keyed = axioms.withColumn("_key", axiom_key(F.col("kind"), F.col("members")))
    first = keyed.groupBy("_key").agg(F.min(F.struct("pos", *[c for c in axioms.columns if c != "pos"])).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) for c in axioms.columns])


def expression_keys(expressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, key): equal for nested expressions that are structurally equal, whatever their nodes are called; and
    the nodes (node) on circles, which have none.

    expressions: (node, kind, role, pos, part). ``part`` is another node or a name; parts of a role count as
    a set if ``pos`` is null, and in their order else. Keys are made from the leaves up, one round for each
    level of nesting, and a node's key is a hash of its kind and its parts' keys.
    """
    rows = checkpoint(spread(expressions.select("node", "kind", "role", "pos", "part"), "node").distinct())
    inner = checkpoint(rows.select("node").distinct())
    leaf = rows.select("part").distinct().join(inner.withColumnRenamed("node", "part"), "part", "left_anti")
    keys = checkpoint(leaf.select(F.col("part").alias("node"), F.concat(F.lit("name "), "part").alias("key")))
    made = keys.limit(0)
    while True:
        ready = rows.join(keys.withColumnRenamed("node", "part"), "part", "left").groupBy("node", "kind").agg(
            F.count_if(F.col("key").isNull()).alias("open"), F.collect_list(F.struct("role", "pos", "key")).alias("parts")
        )
        ordered = F.array_sort(F.filter("parts", lambda x: x["pos"].isNotNull()))
        loose = F.array_sort(F.array_distinct(F.filter("parts", lambda x: x["pos"].isNull())))
        key = F.sha2(F.to_json(F.struct("kind", ordered.alias("ordered"), loose.alias("loose"))), 256)
        new = checkpoint(ready.where("open = 0").select("node", key.alias("key")).join(made, "node", "left_anti"))
        if new.isEmpty():
            return made, inner.join(made, "node", "left_anti")
        made, keys = checkpoint(made.union(new)), checkpoint(keys.union(new))


def distinct_expressions(expressions: DataFrame) -> DataFrame:
    """(node, same): each expression with the least node of those that are structurally equal to it."""
    keys, _ = expression_keys(expressions)
    return with_least(keys, "key", "node", "same").select("node", "same")


def difference(axioms: DataFrame, others: DataFrame) -> DataFrame:
    """Axioms that equal none of the others."""
    keyed = lambda df: df.withColumn("_key", axiom_key(F.col("kind"), F.col("members")))
    return keyed(axioms).join(keyed(others).select("_key"), "_key", "left_anti").drop("_key")


def same_axioms(axioms: DataFrame, others: DataFrame) -> bool:
    """Whether both have the same axioms, structurally."""
    return difference(axioms, others).isEmpty() and difference(others, axioms).isEmpty()
