"""Counting, equality and clash operators over facts.

Facts are DataFrames: types (x, c), edges (x, r, y) and values (x, p, value_key). Names
are not assumed to be different: operators that count take the individuals that are
declared different from each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import checkpoint, components


def with_least(rows: DataFrame, keys: str | list[str], of: str, name: str) -> DataFrame:
    """``rows`` with the least value of the column ``of`` among those with the same keys, as column ``name``.

    The join merges: rows with few keys are small when shuffled, being well compressed, and Spark would
    collect them on the driver to broadcast them.
    """
    return rows.hint("merge").join(rows.groupBy(keys).agg(F.min(of).alias(name)), keys)


def functional_violations(values: DataFrame) -> DataFrame:
    """(x, n): individuals with several values of a functional data property (x, value_key)."""
    return values.groupBy("x").agg(F.count_distinct("value_key").alias("n")).where("n > 1")


def functional_same(edges: DataFrame, functional: DataFrame) -> DataFrame:
    """(a, b): targets that a functional role (r) makes equal; the least target stands for all."""
    held = edges.join(functional, "r")
    return with_least(held, ["x", "r"], "y", "a").where("y <> a").select("a", F.col("y").alias("b")).distinct()


def inverse_functional_same(edges: DataFrame, functional: DataFrame) -> DataFrame:
    """(a, b): sources that an inverse functional role (r) makes equal."""
    return functional_same(edges.select(F.col("y").alias("x"), "r", F.col("x").alias("y")), functional)


def key_same(named: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): named individuals (x) that agree on all key columns; the least stands for all."""
    full = named.na.drop(subset=keys)
    return with_least(full, keys, "x", "a").where("x <> a").select("a", F.col("x").alias("b")).distinct()


def keys_same(types: DataFrame, values: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): members of a key's class that share a value of each of its properties.

    keys: (k, c, n, pos, p), one row for each of the n properties; values: (x, p, value_key),
    targets of object properties too. One join for each property of the longest key; members
    that have equal values are compared with the least of them, never pair by pair.
    """
    members = types.join(keys.where("pos = 0").select("k", "c", "n"), "c").select("k", "x", "n").distinct()
    most = keys.agg(F.max("n")).first()[0] or 0
    state = members.withColumn("mark", F.lit(""))
    for pos in range(most):
        own = keys.where(F.col("pos") == pos).select("k", "p")
        held = own.join(values, "p").select("k", "x", "value_key").distinct()
        open_, done = state.where(F.col("n") > pos), state.where(F.col("n") <= pos)
        state = open_.join(held, ["k", "x"]).select("k", "x", "n", F.sha2(F.concat_ws("\x00", "mark", "value_key"), 256).alias("mark")).union(done)
    return with_least(state.where("n > 0"), ["k", "mark"], "x", "a").where("x <> a").select("a", F.col("x").alias("b")).distinct()


def at_least(edges: DataFrame, n: int, different: DataFrame | None = None) -> DataFrame:
    """(x, n): individuals with n targets or more that are declared different from each other."""
    held = edges if different is None else edges.join(different.select(F.col("x").alias("y")), "y", "left_semi")
    return held.groupBy("x").agg(F.count_distinct("y").alias("n")).where(F.col("n") >= n)


def exactly(edges: DataFrame, n: int, different: DataFrame | None = None) -> DataFrame:
    """(x, n): individuals with n targets that are declared different, all of them known."""
    return at_least(edges, n, different).where(F.col("n") == n)


def only(edges: DataFrame, members: DataFrame, individuals: DataFrame) -> DataFrame:
    """(x): individuals all of whose known targets are members (x): a universal restriction under closed world."""
    outside = edges.join(members.select(F.col("x").alias("y")), "y", "left_anti").select("x")
    return individuals.select("x").distinct().join(outside, "x", "left_anti")


def complement(individuals: DataFrame, members: DataFrame) -> DataFrame:
    """(x): individuals that are not known to be members: a complement under closed world."""
    return individuals.select("x").distinct().join(members, "x", "left_anti")


def one_of(individuals: DataFrame, names: DataFrame) -> DataFrame:
    """(x): individuals that an enumeration (x) names."""
    return individuals.select("x").distinct().join(names.select("x"), "x", "left_semi")


def disjoint_members(types: DataFrame, first: str, second: str) -> DataFrame:
    """(x): individuals of two disjoint classes."""
    return types.where(F.col("c").isin(first, second)).groupBy("x").agg(F.count_distinct("c").alias("n")).where("n = 2").select("x")


def group_clashes(types: DataFrame, groups: DataFrame) -> DataFrame:
    """(x, g): individuals of two classes or more of a disjoint group (g, pos, c)."""
    return types.join(groups, "c").groupBy("x", "g").agg(F.count_distinct("pos").alias("n")).where("n > 1").select("x", "g")


def role_group_clashes(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(x, y, g): pairs that two properties or more of a disjoint group (g, pos, r) connect."""
    return edges.join(groups, "r").groupBy("x", "y", "g").agg(F.count_distinct("pos").alias("n")).where("n > 1").select("x", "y", "g")


def same_and_different(different: DataFrame, reps: DataFrame) -> DataFrame:
    """(g, rep): groups (g, pos, x) of different individuals two of which are equal by (x, rep)."""
    held = different.join(reps, "x", "left").select("g", "pos", F.coalesce("rep", "x").alias("rep"))
    return held.groupBy("g", "rep").agg(F.count_distinct("pos").alias("n")).where("n > 1").select("g", "rep")


def denied_edges(edges: DataFrame, denied: DataFrame) -> DataFrame:
    """Edges that a negative assertion (x, y) denies."""
    return edges.join(denied, ["x", "y"], "left_semi").distinct()


def repeated_edges(edges: DataFrame) -> DataFrame:
    """(x, n): individuals whose list of targets names one of them twice."""
    lists = edges.groupBy("x", "y").count().where("count > 1")
    return lists.groupBy("x").agg(F.count("*").alias("n"))


def loops(edges: DataFrame) -> DataFrame:
    """(x, r): edges from an individual to itself; clashes of irreflexive roles, members of self restrictions."""
    return edges.where("x = y").select("x", "r").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(x, y): edges with their reverse; clashes of asymmetric roles."""
    back = edges.select(F.col("x").alias("y"), F.col("y").alias("x"), "r")
    return edges.join(back, ["x", "y", "r"], "left_semi").select("x", "y").distinct()


def some_value(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """(x, e): holders of a value (x, p, number) within one of the ranges (p, low, high, e); null bounds
    are open ends. Properties are joined by equality, bounds by comparison."""
    inside = (F.col("low").isNull() | (F.col("number") >= F.col("low"))) & (F.col("high").isNull() | (F.col("number") <= F.col("high")))
    return values.join(ranges, "p").where(inside).select("x", "e").distinct()


def outside_kind(values: DataFrame, kinds: DataFrame) -> DataFrame:
    """(x, p, value_key): values whose kind (kind) is not the one that their property's range (p, kind) asks for."""
    return values.join(kinds.select("p", F.col("kind").alias("wanted")), "p").where("kind <> wanted").select("x", "p", "value_key").distinct()


def splittable(nominals: bool, keys: DataFrame, objects: DataFrame, roles: DataFrame, top: str) -> bool:
    """Whether the axioms let assertions be judged component by component: no nominals, no universal
    property among the roles (r) in use, and in each key (k, p) one of the object properties (r)."""
    if nominals or not roles.where(F.col("r") == top).isEmpty():
        return False
    with_object = keys.join(objects.select(F.col("r").alias("p")), "p", "left_semi").select("k")
    return keys.select("k").distinct().join(with_object, "k", "left_anti").isEmpty()


def by_parts(individuals: DataFrame, edges: DataFrame, clashes: DataFrame) -> DataFrame:
    """(component, size, consistent): parts of the assertions (a, b) that share no individual (x),
    and whether none of their individuals clashes (x)."""
    found = components(edges.select("a", "b").union(individuals.select(F.col("x").alias("a"), F.col("x").alias("b"))))
    bad = clashes.select(F.col("x").alias("node")).distinct().withColumn("bad", F.lit(1))
    parts = found.join(bad, "node", "left").groupBy("component").agg(F.count("*").alias("size"), (F.count("bad") == 0).alias("consistent"))
    return checkpoint(parts)
