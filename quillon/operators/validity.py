"""OWL 2 DL restrictions as filters, joins and fixpoints that return what violates them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import checkpoint, components

#: Pairs of kinds that one IRI may not have together.
FORBIDDEN = [
    ("AnnotationProperty", "DataProperty"),
    ("AnnotationProperty", "ObjectProperty"),
    ("Class", "Datatype"),
    ("DataProperty", "ObjectProperty"),
]
#: Reserved namespaces.
RESERVED = [
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "http://www.w3.org/2000/01/rdf-schema#",
    "http://www.w3.org/2001/XMLSchema#",
    "http://www.w3.org/2002/07/owl#",
]


def conflicting_declarations(entities: DataFrame) -> DataFrame:
    """(iri, first, second): IRIs (iri, kind) that are declared as two kinds that exclude each other."""
    spark = entities.sparkSession
    pairs = spark.createDataFrame(FORBIDDEN, "first string, second string")
    kinds = entities.select("iri", "kind").distinct()
    one = kinds.join(pairs, F.col("kind") == F.col("first")).select("iri", "first", "second")
    return one.join(kinds.withColumnRenamed("kind", "second"), ["iri", "second"], "left_semi").select("iri", "first", "second")


def missing_declarations(uses: DataFrame, entities: DataFrame) -> DataFrame:
    """(iri, kind) that are used but not declared."""
    return uses.select("iri", "kind").distinct().join(entities, ["iri", "kind"], "left_anti")


def reserved(entities: DataFrame) -> DataFrame:
    """Entities whose IRI lies in a reserved namespace."""
    inside = F.lit(False)
    for space in RESERVED:
        inside = inside | F.col("iri").startswith(space)
    return entities.where(inside)


def repeated_members(axioms: DataFrame) -> DataFrame:
    """Axioms (axiom, members) with fewer than two members or with one member twice."""
    return axioms.where((F.size("members") < 2) | (F.size(F.array_distinct("members")) < F.size("members")))


def empty_keys(keys: DataFrame) -> DataFrame:
    """Keys (axiom, members) without any property."""
    return keys.where(F.size("members") == 0)


def closure(pairs: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Transitive closure of (a, b); each round doubles the length of paths."""
    state = checkpoint(pairs.select("a", "b").distinct())
    new = state
    for _ in range(most_rounds):
        right = state.select(F.col("a").alias("mid"), F.col("b").alias("end"))
        ahead = new.join(right, F.col("b") == F.col("mid")).select("a", F.col("end").alias("b"))
        left = state.select(F.col("a").alias("start"), F.col("b").alias("mid"))
        behind = left.join(new, F.col("mid") == F.col("a")).select(F.col("start").alias("a"), "b")
        new = checkpoint(ahead.union(behind).distinct().join(state, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return state
        state = state.union(new)
    raise RuntimeError(f"closure did not end in {most_rounds} rounds")


def non_simple_roles(composite: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(r): roles that are composite (r: transitive, or above a chain), or above such a role (a below b)."""
    above = closure(hierarchy).join(composite, F.col("a") == F.col("r"), "left_semi").select(F.col("b").alias("r"))
    return composite.select("r").union(above).distinct()


def non_simple_uses(required: DataFrame, composite: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Roles (r) that must be simple, as they are counted or restricted, and are not."""
    return required.distinct().join(non_simple_roles(composite, hierarchy), "r", "left_semi")


def irregular(order: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(a, b): a must come before b by the chains, and b is below a in the hierarchy, or a is before itself."""
    before = closure(order)
    below = closure(hierarchy).select(F.col("b").alias("a"), F.col("a").alias("b")) if not hierarchy.isEmpty() else before.limit(0)
    return before.join(below, ["a", "b"], "left_semi").union(before.where("a = b")).distinct()


def cyclic_definitions(uses: DataFrame) -> DataFrame:
    """(name): defined datatypes whose definition (a uses b) comes back to them."""
    return closure(uses).where("a = b").select(F.col("a").alias("name"))


def anonymous_cycles(edges: DataFrame) -> DataFrame:
    """(component): groups of anonymous individuals whose edges (a, b) are no forest."""
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = components(links)
    nodes = found.groupBy("component").agg(F.count("*").alias("nodes"))
    lines = links.join(found, F.col("a") == F.col("node")).groupBy("component").agg(F.count("*").alias("lines"))
    return nodes.join(lines, "component").where("lines >= nodes").select("component")


def twice_related(edges: DataFrame) -> DataFrame:
    """(a, b): pairs of anonymous individuals with more than one edge between them."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count().where("count > 1").select("a", "b")
