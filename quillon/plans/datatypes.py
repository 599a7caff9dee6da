"""Data ranges and restrictions of data properties, from a graph to rules.

Ranges are resolved to stretches of the lines of values (``functions.values``), definitions
of datatypes among them. Restrictions are rows (node, p, filler, op, n): at least n values
of p in the filler (``min``; one for existentials and values), at most (``max``), just so
many (``exact``), or all (``all``).

On the left of axioms ``min`` is a rule over asserted values. On the right, what asserted
values break is a clash, and what a class asks for (``needs``) is judged on classes alone:
a need whose range has too few values makes its class empty, and it implies every ``min``
whose range has all of its range. Values of a functional property, and values of one with
``all``, satisfy two such demands at once, so these also meet in pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import terms
from quillon.functions import values as V
from quillon.operators import ranges
from quillon.operators.components import checkpoint
from quillon.operators.saturation import NOTHING, above

if TYPE_CHECKING:
    from quillon.plans.ontology import _Graph

RDF, RDFS, OWL, XSD = (terms.PREFIXES[k] for k in ("rdf", "rdfs", "owl", "xsd"))
LITERAL = RDFS + "Literal"
#: Predicates of cardinalities, with and without a filler.
COUNTS = {"min": ["minCardinality", "minQualifiedCardinality"], "max": ["maxCardinality", "maxQualifiedCardinality"], "exact": ["cardinality", "qualifiedCardinality"]}
FACETS = {(RDF if f == "langRange" else XSD) + f: f for f in V.FACETS}
_RESTRICTION = "node string, p string, filler string, op string, n int"


@dataclass
class DataRules:
    """pieces (node, line, low, high); restrictions (node, p, filler, op, n); ranges (p, node); below (p, q): reflexive
    and transitive; told (c, d) and conj (a, b, e): what needs imply; domains (p, e); nodes (node): all data ranges;
    open (node, what)."""

    pieces: DataFrame
    restrictions: DataFrame
    ranges: DataFrame
    below: DataFrame
    told: DataFrame
    conj: DataFrame
    domains: DataFrame
    nodes: DataFrame
    open: DataFrame
    empty: bool = False


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nothing(g: _Graph) -> DataRules:
    """The rules of a graph without data properties and datatypes."""
    rows = lambda schema: g.empty(schema)
    return DataRules(
        rows("node string, line string, low string, high string"), rows(_RESTRICTION), rows("p string, node string"), rows("p string, q string"), rows("c string, d string"),
        rows("a string, b string, e string"), rows("p string, e string"), rows("node string"), rows("node string, what string"), empty=True,
    )


def _restrictions(g: _Graph, on: DataFrame) -> DataFrame:
    """(node, p, filler, op, n) of the restrictions (node, r) of data properties."""
    here = lambda name, o: on.join(g.own(OWL + name, "node", o), "node")
    row = lambda df, filler, op, n: df.select("node", F.col("r").alias("p"), filler.alias("filler"), F.lit(op).alias("op"), n.cast("int").alias("n"))
    found = [row(here("someValuesFrom", "f"), F.col("f"), "min", F.lit(1)), row(here("allValuesFrom", "f"), F.col("f"), "all", F.lit(0))]
    found.append(row(here("hasValue", "v"), F.concat(F.lit("value:"), "node"), "min", F.lit(1)))
    qualified = g.own(OWL + "onDataRange", "node", "f")
    for op, names in COUNTS.items():
        for name in names:
            if OWL + name in g.predicates:
                found.append(row(here(name, "n").join(qualified, "node", "left"), F.coalesce("f", F.lit(LITERAL)), op, F.col("n").try_cast("int")))
    return _union(found)


def _range_nodes(g: _Graph, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): ranges that are reachable from seeds (node) along edges (node, part)."""
    state = new = checkpoint(seeds.distinct())
    while True:
        new = checkpoint(new.join(edges, "node").select(F.col("part").alias("node")).distinct().join(state, "node", "left_anti"))
        if new.isEmpty():
            return state
        state = state.union(new)


def _expressions(g: _Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, way, pos, part) of everything that may be a compound range, the stretches of facets and enumerations
    with the nodes that they define (those of ``known``)."""
    compound = [g.lists(OWL + name).where("o_kind <> 'literal'").select("node", F.lit(way).alias("way"), "pos", F.col("member").alias("part")) for name, way in (("intersectionOf", "all"), ("unionOf", "any"))]
    compound.append(g.own(OWL + "datatypeComplementOf", "node", "part").select("node", F.lit("none").alias("way"), F.lit(0).alias("pos"), "part"))
    defined = g.typed_as(RDFS + "Datatype", "node").where(F.col("node").contains(":"))
    compound.append(defined.join(g.own(OWL + "equivalentClass", "node", "part"), "node").select("node", F.lit("any").alias("way"), F.lit(0).alias("pos"), "part"))
    stretches, known = [], []
    if OWL + "withRestrictions" in g.predicates:
        cells = g.lists(OWL + "withRestrictions").select("node", "member")
        facet = g.t.where((F.col("o_kind") == "literal") & F.col("p").isin(*FACETS)).select(F.col("s").alias("member"), F.col("p").alias("facet"), F.col("o").alias("bound"), "datatype")
        name = F.concat_ws(" ", F.lit("facet"), "member", "facet", "bound")
        facets = checkpoint(cells.join(facet, "member").select("node", name.alias("part"), F.substring_index("facet", "#", -1).alias("facet"), "bound", "datatype"))
        compound.append(facets.select("node", F.lit("all").alias("way"), F.lit(1).alias("pos"), "part").distinct())
        compound.append(g.own(OWL + "onDatatype", "node", "part").select("node", F.lit("all").alias("way"), F.lit(0).alias("pos"), "part"))
        stretches.append(V.facet_pieces(facets.select(F.col("part").alias("node"), "facet", "bound", "datatype")))
        known.append(facets.select(F.col("part").alias("node")))
    points = []
    if OWL + "oneOf" in g.predicates:
        listed = g.lists(OWL + "oneOf").where("o_kind = 'literal'").select("node", V.place(F.col("datatype"), F.col("member"), F.col("lang")).alias("at"))
        points.append(checkpoint(listed).where("at is not null").select("node", "at.line", "at.key"))
    if OWL + "hasValue" in g.predicates:
        held = g.literals.where((F.col("p") == OWL + "hasValue") & F.col("line").isNotNull())
        points.append(held.select(F.concat(F.lit("value:"), "s").alias("node"), "line", "key"))
    if points:
        stretches.append(V.point_pieces(_union(points)))
        known.append(_union(points).select("node"))
    standard = V.datatype_pieces(g.spark)
    return _union(compound), _union([standard, *stretches]), _union([standard.select("node"), *known])


def data_rules(g: _Graph, data: DataFrame, below: DataFrame, traits: dict[str, DataFrame], disjoint: DataFrame) -> DataRules:
    """Rules of the data properties (r) of a graph; below (r, s): told pairs of data properties; disjoint (r)."""
    on = g.own(OWL + "onProperty", "node", "r").join(data, "r", "left_semi")
    restrictions = checkpoint(_restrictions(g, on).distinct())
    of_property = checkpoint(g.own(RDFS + "range", "r", "node").join(data, "r", "left_semi").select(F.col("r").alias("p"), "node").distinct())
    own = data.select(F.col("r").alias("p"), F.col("r").alias("q"))
    below = checkpoint(below)
    higher = checkpoint(above(below).select(F.col("r").alias("p"), F.col("s").alias("q")).union(own).distinct()) if not below.isEmpty() else checkpoint(own.distinct())
    domains = g.own(RDFS + "domain", "r", "e").join(data, "r", "left_semi").select(F.col("r").alias("p"), "e").distinct()

    expressions, pieces, known = _expressions(g)
    seeds = restrictions.select(F.col("filler").alias("node")).union(of_property.select("node")).union(g.typed_as(RDFS + "Datatype", "node"))
    expressions = checkpoint(expressions)
    nodes = _range_nodes(g, seeds, expressions.select("node", "part"))
    expressions = expressions.join(nodes, "node", "left_semi")
    pieces, known = checkpoint(pieces), checkpoint(known.distinct())

    # what classes need, within the ranges of the property; a pair for a functional property, or an "all" on it or above it
    needs = checkpoint(restrictions.where("op in ('min', 'exact') and n > 0"))
    need = needs.select(F.concat_ws(" ", F.lit("need"), "node").alias("whole"), "node", "p", "filler", "n")
    over = higher.join(of_property.select(F.col("p").alias("q"), F.col("node").alias("part")), "q").select("p", "part")
    parts = need.select(F.col("whole").alias("node"), F.col("filler").alias("part")).union(need.join(over, "p").select("whole", "part"))
    functional = traits["FunctionalProperty"].select(F.col("r").alias("q"))
    one_value = higher.join(functional, "q", "left_semi").select("p", F.col("q").alias("group"))
    lone = need.join(one_value, "p").select("node", F.col("group").alias("p"), "filler", F.lit("one").alias("op"), F.lit(0).alias("n")).distinct()
    grouped = need.join(one_value, "p").select("group", "node", "whole", "n")
    left, right = (grouped.select("group", F.col("node").alias(a), F.col("whole").alias(b), F.col("n").alias(c)) for a, b, c in (("a", "x", "na"), ("b", "y", "nb")))
    pairs = left.join(right, "group").where("a < b").select("a", "b", "x", "y", F.greatest("na", "nb").alias("n"))
    every = restrictions.where("op = 'all'").select(F.col("node").alias("b"), F.col("p").alias("q"), F.col("filler").alias("y"))
    pairs = pairs.union(need.join(higher, "p").join(every, "q").select(F.col("node").alias("a"), "b", F.col("whole").alias("x"), "y", "n"))
    pairs = checkpoint(pairs.distinct().withColumn("pair", F.concat_ws(" ", F.lit("pair"), "a", "b")))
    both = pairs.select(F.col("pair").alias("node"), F.explode(F.array("x", "y")).alias("part"))
    added = parts.union(both).select("node", F.lit("all").alias("way"), F.lit(0).alias("pos"), "part").distinct()
    pieces, unknown = ranges.resolved(pieces, known, expressions.union(added))
    unknown = checkpoint(unknown.distinct())

    # what needs imply: emptiness, and every "min" whose range has all of theirs
    demands = need.select(F.col("whole").alias("inner"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "p", "n")
    demands = demands.union(pairs.join(need.select(F.col("node").alias("a"), "p"), "a").select(F.col("pair"), "a", "b", "p", "n"))
    counted = ranges.amounts(pieces, demands.select(F.col("inner").alias("node"))).withColumnRenamed("node", "inner")
    none = demands.join(counted, "inner").where("amount < n").select("a", "b", F.lit(NOTHING).alias("e"))
    asked = restrictions.where("op = 'min'").select(F.col("p").alias("q"), F.col("filler").alias("outer"), F.col("node").alias("e"), F.col("n").alias("m"))
    may = checkpoint(demands.join(higher, "p").join(asked, "q").where("m <= n and e <> a").select("inner", "a", "b", "outer", "e").distinct())
    inside = ranges.within(pieces, may.select("inner", "outer").distinct())
    implied = may.join(inside, ["inner", "outer"]).select("a", "b", "e")
    found = checkpoint(none.union(implied).union(need.join(higher, "p").join(domains.select(F.col("p").alias("q"), "e"), "q").select("node", F.lit(None).cast("string"), "e")).distinct())
    told = found.where("b is null").select(F.col("a").alias("c"), F.col("e").alias("d"))
    conj = found.where("b is not null").select("a", "b", "e")

    # what is not decided: sets that overlap others without lying in them may be covered by several together, …
    partly = may.join(inside, ["inner", "outer"], "left_anti").join(pieces.select(F.col("node").alias("inner"), "line", "low", "high"), "inner")
    partly = partly.join(pieces.select(F.col("node").alias("outer"), "line", F.col("low").alias("from"), F.col("high").alias("to")), ["outer", "line"]).where("from < high and low < to")
    several = partly.groupBy("inner", "a").agg(F.count_distinct("outer").alias("n")).where("n > 1").select(F.col("a").alias("node"))
    # … needs of several values may exceed a limit, three demands on one value may exclude each other, and disjoint properties part values
    limits = restrictions.where("op in ('max', 'exact')").select(F.col("p").alias("q"), F.col("node").alias("limit"))
    limited = need.join(higher, "p").join(limits, "q").where("node <> limit").select("node")
    limited = limited.union(need.where("n > 1").join(one_value.select("p"), "p", "left_semi").select("node"))
    ragged = pieces.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select(F.col("node").alias("whole"))
    crowded = pairs.select(F.explode(F.array("a", "b")).alias("node"), "pair").groupBy("node").count().where("count > 1").select("node")
    crowded = crowded.join(need.join(ragged, "whole", "left_semi").select("node").union(every.join(ragged.withColumnRenamed("whole", "y"), "y", "left_semi").select("b")), "node", "left_semi")
    alone = need.join(disjoint.select(F.col("r").alias("p")), "p", "left_semi").select("node")
    undecided = _union([several, limited, crowded, alone]).distinct().select("node", F.lit("data restriction").alias("what"))
    shown = unknown.where(~F.col("node").startswith("need ") & ~F.col("node").startswith("pair ")).select("node", F.lit("data range").alias("what"))
    fillers = restrictions.select("node", F.col("filler").alias("part")).union(of_property.select(F.col("p").alias("node"), F.col("node").alias("part")))
    without = fillers.join(pieces.select(F.col("node").alias("part")).union(known.select(F.col("node").alias("part"))).union(expressions.select(F.col("node").alias("part"))).distinct(), "part", "left_anti").select("node", F.lit("data range").alias("what"))
    bad = restrictions.where("op <> 'all' and n is null").select("node", F.lit("cardinality").alias("what"))
    return DataRules(pieces, checkpoint(restrictions.union(lone)), of_property, higher, told, conj, checkpoint(domains), nodes, checkpoint(_union([undecided, shown, without, bad]).distinct()))


def outside(name: str) -> Column:
    return F.concat(F.lit("outside:"), F.col(name))


def data_types(rules: DataRules, values: DataFrame) -> DataFrame:
    """(x, c): classes that values (x, p, line, key) give: those of restrictions that they satisfy, those of domains,
    and, for restrictions that they break, the class of what lies outside."""
    row = rules.restrictions
    held = ranges.members(values, row.select("p", F.col("filler").alias("node")), rules.pieces).withColumnRenamed("node", "filler")
    held = checkpoint(held.select("x", "p", "filler", "line", "key").distinct())
    counts = held.groupBy("x", "p", "filler").agg(F.count("*").alias("have")).join(row, ["p", "filler"])
    found = [values.join(rules.domains, "p").select("x", F.col("e").alias("c")), counts.where("op = 'min' and have >= n").select("x", F.col("node").alias("c"))]
    found.append(counts.where("op in ('max', 'exact') and have > n").select("x", outside("node").alias("c")))
    whole = row.where("op in ('all', 'one')")
    met = values.select("x", "p", "line", "key").join(whole, "p").join(held, ["x", "p", "filler", "line", "key"], "left_anti")
    found.append(met.select("x", outside("node").alias("c")))
    return reduce(DataFrame.union, found).distinct()


def outside_range(rules: DataRules, values: DataFrame) -> DataFrame:
    """(x): holders of values that lie outside a range of their property."""
    held = ranges.members(values, rules.ranges, rules.pieces)
    asked = values.join(rules.ranges, "p")
    return asked.join(held.select("x", "p", "line", "key", "node"), ["x", "p", "line", "key", "node"], "left_anti").select("x").distinct()


def excluded(rules: DataRules) -> DataFrame:
    """(a, b, e): who is in a restriction on the right and outside of it, is in no world."""
    return rules.restrictions.select(F.col("node").alias("a"), outside("node").alias("b"), F.lit(NOTHING).alias("e")).distinct()

