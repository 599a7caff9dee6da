"""From RDF triples to rule tables: OWL's RDF mapping as joins.

A node of the graph stands for its class expression. Blank nodes with restrictions,
intersections, unions and lists give rule rows under their own label, so nested
expressions need no recursion. Every triple is accounted for: what no rule, fact or
check takes up is listed in ``unsupported``, and answers that could depend on it
become unknown. An expression counts as taken up only where its polarity allows it:
unions and enumerations on the left of axioms, complements and universals on the right.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import terms
from quillon.functions import values as V
from quillon.operators import ranges
from quillon.operators.components import checkpoint
from quillon.operators.saturation import NOTHING, SMALL, TOP
from quillon.plans import datatypes

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: Types that declare an entity or head an axiom, and characteristics of properties.
KINDS = ["AnnotationProperty", "Class", "DatatypeProperty", "NamedIndividual", "ObjectProperty"]
GROUPS = ["AllDifferent", "AllDisjointClasses", "AllDisjointProperties"]
TRAITS = ["AsymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty", "ReflexiveProperty", "SymmetricProperty", "TransitiveProperty"]
#: Predicates of lists.
LISTS = ["disjointUnionOf", "distinctMembers", "hasKey", "intersectionOf", "members", "oneOf", "propertyChainAxiom", "unionOf", "withRestrictions"]
#: The reserved predicates and types that are read.
PREDICATES = [RDF + x for x in ("first", "rest", "type")] + [RDFS + x for x in ("domain", "range", "subClassOf", "subPropertyOf")] + [OWL + x for x in LISTS]
PREDICATES += [OWL + x for x in """allValuesFrom assertionProperty cardinality complementOf datatypeComplementOf differentFrom disjointWith equivalentClass equivalentProperty hasSelf hasValue inverseOf
maxCardinality maxQualifiedCardinality minCardinality minQualifiedCardinality onClass onDataRange onDatatype onProperty propertyDisjointWith qualifiedCardinality sameAs someValuesFrom
sourceIndividual targetIndividual targetValue versionIRI""".split()]
TYPES = [OWL + x for x in [*KINDS, *GROUPS, *TRAITS, "NegativePropertyAssertion", "Ontology"]] + [RDFS + "Datatype"]
#: Roles that hold of all individuals, or of none, and the data properties alike.
EXTREME = [OWL + x for x in ("topObjectProperty", "bottomObjectProperty", "topDataProperty", "bottomDataProperty")]
NONE = [x for x in EXTREME if "#bottom" in x]
#: Annotation properties that need no declaration.
NOTES = [RDFS + "comment", RDFS + "isDefinedBy", RDFS + "label", RDFS + "seeAlso"]
NOTES += [OWL + x for x in ("backwardCompatibleWith", "deprecated", "incompatibleWith", "priorVersion", "versionInfo")]


@dataclass
class Ontology:
    """Rule tables and facts; ``unsupported`` holds the nodes (node, what) left out."""

    rules: dict[str, DataFrame]
    types: DataFrame
    links: DataFrame
    values: DataFrame
    same: DataFrame
    #: (g, pos, x): individuals of a group are different from each other, position by position.
    different: DataFrame
    #: Roles (r) with a trait, by its name.
    traits: dict[str, DataFrame]
    #: (g, pos, r) of disjoint properties, object and data; (x, r, y) and (x, p, value_key) that are denied.
    disjoint_roles: DataFrame
    denied: DataFrame
    denied_values: DataFrame
    #: (k, c, n, pos, p): key of n properties p of class c.
    keys: DataFrame
    data: datatypes.DataRules
    entities: DataFrame
    unsupported: DataFrame
    triples: DataFrame
    nominals: bool = False


def list_members(triples: DataFrame, heads: DataFrame, *more: str) -> DataFrame:
    """(head, pos, member) of the RDF lists that begin at ``heads`` (head), and ``more`` columns of the members.

    Known cells of a list and the jumps between cells double every round, so a list of n
    members takes log2(n) rounds. Lists that run in a circle raise ValueError.
    """
    first = triples.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("member"), *more)
    cells = checkpoint(first.distinct())
    jumps = checkpoint(triples.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select(F.col("s").alias("cell"), F.col("o").alias("next")).distinct())
    most = jumps.count() + 1
    found = checkpoint(heads.select("head", F.col("head").alias("cell"), F.lit(0).cast("long").alias("pos")).distinct())
    step = 1
    while True:
        ahead = checkpoint(found.join(jumps, "cell").select("head", F.col("next").alias("cell"), (F.col("pos") + step).alias("pos")))
        if ahead.isEmpty():
            break
        if step > 2 * most:
            raise ValueError("an RDF list runs in a circle")
        found = found.union(ahead)
        jumps = checkpoint(jumps.join(jumps.select(F.col("cell").alias("next"), F.col("next").alias("far")), "next").select("cell", F.col("far").alias("next")))
        step *= 2
    return found.join(cells, "cell").select("head", F.col("pos").cast("int").alias("pos"), "member", *more)


def _binary(lists: DataFrame, a: str, b: str, e: str) -> DataFrame:
    """Rows (a, b, e) that combine a list's members one by one; the last gives the head."""
    last = lists.groupBy("head").agg(F.max("pos").alias("last"))
    name = lambda pos: F.concat(F.lit("part:"), F.col("head"), F.lit("/"), pos.cast("string"))
    firsts = lists.where("pos = 0").select("head", F.col("member").alias("m0"))
    rows = lists.where("pos > 0").join(last, "head").join(firsts, "head")
    return rows.select(
        F.when(F.col("pos") == 1, F.col("m0")).otherwise(name(F.col("pos") - 1)).alias(a),
        F.col("member").alias(b),
        F.when(F.col("pos") == F.col("last"), F.col("head")).otherwise(name(F.col("pos"))).alias(e),
    )


def _polarity(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, plus): the sides on which nodes occur, from ``roots`` down ``edges`` (node, part, flip)."""
    state = checkpoint(roots.select("node", "plus").distinct())
    new = state
    while True:
        down = new.join(edges, "node").select(F.col("part").alias("node"), (F.col("plus") != F.col("flip")).alias("plus")).distinct()
        new = checkpoint(down.join(state, ["node", "plus"], "left_anti"))
        if new.isEmpty():
            return state
        state = state.union(new)


class _Graph:
    """Selections of a graph; those of predicates and types that do not occur are known to be empty."""

    def __init__(self, triples: DataFrame) -> None:
        have = set(triples.columns)
        extra = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("datatype", "lang")]
        node = lambda c: F.when(F.col(c) == OWL + "Thing", TOP).when(F.col(c) == OWL + "Nothing", NOTHING).otherwise(F.col(c)).alias(c)
        self.t = checkpoint(triples.select(node("s"), "p", node("o"), "o_kind", *extra).distinct())
        self.spark = self.t.sparkSession
        kind = F.when((F.col("p") == RDF + "type") & F.col("o").isin(TYPES), F.col("o"))
        # as many rows as the two lists have names
        self.present = {(r.p, r.kind) for r in self.t.where(F.col("p").isin(PREDICATES)).select("p", kind.alias("kind")).distinct().collect()}
        self.predicates = {p for p, _ in self.present}
        self.classes = {k for p, k in self.present if p == RDF + "type"}

    def empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def own(self, p: str, s: str, o: str) -> DataFrame:
        if p not in self.predicates:
            return self.empty(f"{s} string, {o} string")
        return self.t.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))

    def typed(self, kind: str, name: str = "r") -> DataFrame:
        return self.typed_as(OWL + kind, name)

    def typed_as(self, iri: str, name: str) -> DataFrame:
        if iri not in self.classes:
            return self.empty(f"{name} string")
        return self.t.where((F.col("p") == RDF + "type") & (F.col("o") == iri)).select(F.col("s").alias(name)).distinct()

    @cached_property
    def literals(self) -> DataFrame:
        """(s, p, o, datatype, line, key, value_key): triples with literals, and where their values lie (null: nowhere)."""
        at = V.place(F.col("datatype"), F.col("o"), F.col("lang"))
        rows = checkpoint(self.t.where("o_kind = 'literal'").select("s", "p", "o", "datatype", at.alias("at")))
        return rows.select("s", "p", "o", "datatype", "at.line", "at.key", F.concat_ws(" ", "at.line", "at.key").alias("value_key"))

    @cached_property
    def _lists(self) -> DataFrame:
        heads = self.t.where(F.col("p").isin([OWL + x for x in LISTS])).select("p", F.col("s").alias("node"), F.col("o").alias("head"))
        return checkpoint(heads.join(list_members(self.t, heads.select("head"), "o_kind", "datatype", "lang"), "head").select("p", "node", "pos", "member", "o_kind", "datatype", "lang"))

    def lists(self, p: str) -> DataFrame:
        """(node, pos, member, o_kind, datatype, lang) of the lists that a predicate leads to."""
        if p not in self.predicates:
            return self.empty("node string, pos int, member string, o_kind string, datatype string, lang string")
        return self._lists.where(F.col("p") == p).drop("p")

    def members(self, p: str) -> DataFrame:
        """(node, pos, member) of these lists."""
        return self.lists(p).select("node", "pos", "member")


def _pairs(pairs: DataFrame, kind: str) -> DataFrame:
    """(g, pos, member) of pairs (a, b) that make a group of two."""
    g = F.concat(F.lit(kind + " "), "a", F.lit(" "), "b")
    return pairs.select(g.alias("g"), F.posexplode(F.array("a", "b")).alias("pos", "member"))


def _stored(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables, of three columns at most, written together in one job, and their numbers of rows."""
    def tagged(name: str, df: DataFrame) -> DataFrame:
        columns = [F.col(c).cast("string") for c in df.columns] + [F.lit(None).cast("string")] * (3 - len(df.columns))
        return df.select(F.lit(name).alias("table"), *[c.alias(x) for c, x in zip(columns, "abc", strict=True)])

    all_ = checkpoint(_any([tagged(k, v) for k, v in tables.items()]).distinct())
    counts = {r.table: r["count"] for r in all_.groupBy("table").count().collect()}
    own = lambda k, v: all_.where(F.col("table") == k).select(*[F.col(x).cast(t).alias(c) for x, (c, t) in zip("abc", v.dtypes, strict=False)])
    return {k: own(k, v) for k, v in tables.items()}, counts


def _any(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _grouped(g: _Graph, kind: str) -> DataFrame:
    """(g, pos, member) of axioms that list their members."""
    members = g.members(OWL + "members").union(g.members(OWL + "distinctMembers"))
    return members.join(g.typed(kind, "node"), "node", "left_semi").select(F.col("node").alias("g"), "pos", "member")


def mapped(triples: DataFrame) -> Ontology:
    """Rule tables of an OWL graph (s, p, o, o_kind and, for literals, datatype, lang)."""
    g = _Graph(triples)
    t, own, typed = g.t, g.own, g.typed
    objects = typed("ObjectProperty").union(typed("TransitiveProperty")).union(typed("SymmetricProperty")).union(typed("InverseFunctionalProperty")).union(typed("ReflexiveProperty"))
    objects = objects.union(typed("IrreflexiveProperty")).union(typed("AsymmetricProperty"))
    turned = own(OWL + "inverseOf", "r", "s")
    objects = checkpoint(objects.union(turned.select("r")).union(turned.select("s")).distinct())
    data = checkpoint(typed("DatatypeProperty").distinct())

    on = own(OWL + "onProperty", "node", "r")
    here = lambda p, o: on.join(own(OWL + p, "node", o), "node")
    on_object, on_data = (lambda df: df.join(objects, "r", "left_semi")), (lambda df: df.join(data, "r", "left_semi"))
    some = on_object(here("someValuesFrom", "c"))
    one_of = g.lists(OWL + "oneOf").where("o_kind <> 'literal'").select("node", "pos", "member")
    value = on_object(here("hasValue", "y"))
    every = on_object(here("allValuesFrom", "e"))
    itself = on_object(here("hasSelf", "yes")).where(F.lower("yes").isin("true", "1"))
    counted = on_object(here("minCardinality", "n").union(here("minQualifiedCardinality", "n")))
    single = counted.where("n = '1'").join(own(OWL + "onClass", "node", "c"), "node", "left").select("node", "r", F.coalesce("c", F.lit(TOP)).alias("c"))
    some = some.select("node", "r", "c").union(single)
    alike = own(OWL + "equivalentProperty", "r", "s")
    disjoint = _pairs(own(OWL + "propertyDisjointWith", "a", "b"), "roles").union(_grouped(g, "AllDisjointProperties")).select("g", "pos", F.col("member").alias("r"))
    has_data = OWL + "DatatypeProperty" in g.classes or RDFS + "Datatype" in g.classes
    values_of = datatypes.data_rules(g, data, on_data(own(RDFS + "subPropertyOf", "r", "s").union(alike).union(alike.select("s", "r"))), {k: typed(k) for k in TRAITS}, disjoint.select("r")) if has_data else datatypes.nothing(g)
    own_class = (lambda df: df.join(values_of.nodes, "node", "left_anti")) if has_data else (lambda df: df)
    both, either = own_class(g.members(OWL + "intersectionOf")), own_class(g.members(OWL + "unionOf"))
    apart_from = own(OWL + "complementOf", "node", "c")
    split = g.members(OWL + "disjointUnionOf")

    told = own(RDFS + "subClassOf", "c", "d")
    same = own(OWL + "equivalentClass", "c", "d")
    if has_data:
        same = same.join(values_of.nodes.withColumnRenamed("node", "c"), "c", "left_anti")
    equal = told.union(same).union(same.select("d", "c"))
    made = [both.select(F.col("node").alias("c"), F.col("member").alias("d")), either.select(F.col("member").alias("c"), F.col("node").alias("d")), split.select("member", "node")]
    alone = lambda lists: lists.join(lists.groupBy("node").agg(F.max("pos").alias("last")).where("last = 0"), "node", "left_semi").select("node", "member")
    made += [alone(both).select("member", "node"), alone(either)]
    members = g.members(OWL + "members").union(g.members(OWL + "distinctMembers"))
    group = lambda kind: _grouped(g, kind)
    apart = _pairs(own(OWL + "disjointWith", "a", "b"), "class").union(group("AllDisjointClasses")).union(split.select("node", "pos", "member"))
    apart = apart.union(_pairs(apart_from.select(F.col("node").alias("a"), F.col("c").alias("b")), "not"))

    role = own(RDFS + "subPropertyOf", "r", "s")
    role = role.union(alike).union(alike.select("s", "r"))
    chains = own(OWL + "propertyChainAxiom", "s", "node")
    chain_lists = g.members(OWL + "propertyChainAxiom").withColumnRenamed("node", "s")
    chain = _binary(chain_lists.select(F.concat(F.lit("chain:"), "s").alias("head"), "pos", "member"), "r1", "r2", "head") if chains.columns and OWL + "propertyChainAxiom" in g.predicates else g.empty("r1 string, r2 string, head string")
    chain = chain.select("r1", "r2", F.when(F.col("head").startswith("chain:"), F.substring("head", 7, 1 << 30)).otherwise(F.col("head")).alias("s"))
    role = role.union(chain_lists.groupBy("s").agg(F.max("pos").alias("last"), F.min("member").alias("r")).where("last = 0").select("r", "s"))
    chain = chain.union(typed("TransitiveProperty").select("r", "r", "r"))
    turned = turned.union(turned.select("s", "r")).union(typed("SymmetricProperty").select("r", "r"))
    domain, range_ = own(RDFS + "domain", "r", "e"), own(RDFS + "range", "r", "e")
    # a domain is the inverse's range; so contexts need no inverse links for either
    ranges = on_object(range_).union(on_object(domain).join(turned, "r").select(F.col("s").alias("r"), "e"))
    domains = on_object(domain).union(on_object(range_).join(turned, "r").select(F.col("s").alias("r"), "e"))
    value_class = value.select("node", "r", "y", F.concat(F.lit("one:"), "y").alias("one"))

    rules = {
        "told": _any([equal, *made, values_of.told]), "conj": _any([_binary(both.withColumnRenamed("node", "head"), "a", "b", "e"), values_of.conj, datatypes.excluded(values_of)]),
        "apart": apart.select("g", "pos", F.col("member").alias("c")),
        "some": some.select("r", "c", F.col("node").alias("e")).union(value_class.select("r", "one", "node")),
        "give": some.select(F.col("node").alias("c"), "r", F.col("c").alias("d")),
        "value": value.select(F.col("node").alias("c"), "r", "y"),
        "role": on_object(role), "chain": chain, "inverse": turned, "domain": domains, "range": ranges,
        "all": every.select(F.col("node").alias("c"), "r", "e"),
        "loop": itself.select(F.col("node").alias("c"), "r").union(typed("ReflexiveProperty").select(F.lit(TOP), "r")),
        "self": itself.select("r", F.col("node").alias("e")), "single": typed("FunctionalProperty").join(objects, "r", "left_semi"),
    }
    rules, counts = _stored(rules)
    rules = {k: F.broadcast(v) if counts[k] <= SMALL else v for k, v in rules.items() if k in counts}
    rules["top"] = rules["bottom"] = g.spark.createDataFrame([(1,)], "n int")

    # facts
    system = F.col("o").startswith(OWL) | F.col("o").startswith(RDFS) | F.col("o").startswith(RDF)
    types = t.where((F.col("p") == RDF + "type") & ~system).select(F.col("s").alias("x"), F.col("o").alias("c"))
    types = types.union(value_class.select("y", "one")).union(one_of.select("member", "node"))
    links = t.where(F.col("o_kind") != "literal").join(objects, F.col("p") == F.col("r"), "left_semi").select(F.col("s").alias("x"), F.col("p").alias("r"), F.col("o").alias("y"))
    values = g.empty("x string, p string, line string, key string, value_key string")
    if has_data:
        values = g.literals.where("line is not null").join(data, F.col("p") == F.col("r"), "left_semi").select(F.col("s").alias("x"), "p", "line", "key", "value_key")
    source, via, target = own(OWL + "sourceIndividual", "node", "x"), own(OWL + "assertionProperty", "node", "r"), own(OWL + "targetIndividual", "node", "y")
    denied = source.join(via, "node").join(target, "node").select("x", "r", "y")
    number = g.literals.where(F.col("p") == OWL + "targetValue").select(F.col("s").alias("node"), "value_key") if OWL + "targetValue" in g.predicates else g.empty("node string, value_key string")
    denied_values = source.join(via, "node").join(number, "node").select("x", F.col("r").alias("p"), "value_key")
    different = _pairs(own(OWL + "differentFrom", "a", "b"), "pair").union(group("AllDifferent")).select("g", "pos", F.col("member").alias("x"))
    key = g.members(OWL + "hasKey")
    key = key.join(key.groupBy("node").agg(F.count("*").cast("int").alias("n")), "node").select(F.col("node").alias("k"), F.col("node").alias("c"), "n", "pos", F.col("member").alias("p"))

    traits = {k: typed(k) for k in TRAITS}
    entities = t.where((F.col("p") == RDF + "type") & (F.col("o").isin([OWL + k for k in KINDS] + [RDFS + "Datatype"]))).select(F.col("s").alias("iri"), F.substring_index("o", "#", -1).alias("kind"))

    # which nodes occur on which side of axioms
    edges = [both.select("node", F.col("member").alias("part"), F.lit(False).alias("flip")), either.select("node", "member", F.lit(False)), apart_from.select("node", "c", F.lit(True))]
    edges += [some.select("node", "c", F.lit(False)), every.select("node", "e", F.lit(False))]
    right = [told.select(F.col("d").alias("node")), same.select("c"), same.select("d"), domain.select("e"), range_.select("e"), types.select("c"), split.select("node")]
    left = [told.select("c"), same.select("c"), same.select("d"), members.select("member"), key.select("c"), split.select("member"), split.select("node"), own(OWL + "disjointWith", "a", "b").select("a"), own(OWL + "disjointWith", "a", "b").select("b")]
    odd = _any([either.select("node", F.lit("unionOf").alias("what")), one_of.select("node", F.lit("oneOf")), split.select("node", F.lit("disjointUnionOf")), values_of.open.where("what = 'data restriction'")]).distinct()
    flipped = _any([apart_from.select("node", F.lit("complementOf").alias("what")), every.select("node", F.lit("allValuesFrom")), values_of.restrictions.where("op in ('all', 'max', 'exact')").select("node", F.lit("data restriction"))]).distinct()
    kept = [x for x in ("unionOf", "oneOf", "disjointUnionOf", "complementOf", "allValuesFrom", "DatatypeProperty") if OWL + x in g.predicates | g.classes]
    beyond = [g.empty("node string, what string")]
    if kept:
        sides = _polarity(_any(edges), _any([x.select(F.col(x.columns[0]).alias("node"), F.lit(True).alias("plus")) for x in right] + [x.select(F.col(x.columns[0]).alias("node"), F.lit(False).alias("plus")) for x in left]))
        bad = lambda df, plus: df.join(sides.where(F.col("plus") == F.lit(plus)), "node", "left_semi")
        beyond += [bad(odd, True), bad(flipped, False)]
    beyond.append(values_of.open.where("what <> 'data restriction'"))
    beyond.append(_leftover(g, objects, data, [some.select("node"), value.select("node"), every.select("node"), itself.select("node"), values_of.restrictions.select("node")], source.join(via, "node").select("node")))
    unsupported = checkpoint(_any(beyond).distinct())
    values = checkpoint(values.distinct())
    facts, _ = _stored({"types": types, "links": links, "same": own(OWL + "sameAs", "a", "b"), "different": different, "disjoint": disjoint, "denied": denied, "denied_values": denied_values, "entities": entities} | {k: v for k, v in traits.items()})
    return Ontology(
        rules, facts["types"], facts["links"], values, facts["same"], facts["different"], {k: facts[k] for k in traits}, facts["disjoint"],
        facts["denied"], facts["denied_values"], key, values_of, facts["entities"], unsupported, t, OWL + "hasValue" in g.predicates or OWL + "oneOf" in g.predicates,
    )


def _leftover(g: _Graph, objects: DataFrame, data: DataFrame, taken: list[DataFrame], denied_nodes: DataFrame) -> DataFrame:
    """(node, what) of the triples that nothing above takes up."""
    t = g.t
    structure = ["complementOf", "differentFrom", "disjointUnionOf", "disjointWith", "distinctMembers", "equivalentClass", "equivalentProperty", "hasKey", "intersectionOf", "inverseOf", "members"]
    structure += ["datatypeComplementOf", "onDataRange", "onDatatype", "onProperty", "oneOf", "propertyChainAxiom", "propertyDisjointWith", "sameAs", "unionOf", "versionIRI", "withRestrictions", "annotatedSource", "annotatedProperty", "annotatedTarget"]
    fine = [OWL + x for x in structure] + [RDFS + x for x in ("domain", "range", "subClassOf", "subPropertyOf")] + [RDF + "first", RDF + "rest"] + NOTES
    heads = [OWL + x for x in [*KINDS, *GROUPS, *TRAITS, "Axiom", "Annotation", "Ontology", "Restriction", "NegativePropertyAssertion"]] + [RDFS + "Datatype"]
    facets = list(datatypes.FACETS)
    fine += facets
    inside = [OWL + x for x in ("someValuesFrom", "allValuesFrom", "hasValue", "hasSelf", "onClass", *sum(datatypes.COUNTS.values(), []))]
    shapes = [OWL + x for x in ("sourceIndividual", "assertionProperty", "targetIndividual", "targetValue")]
    p, o = F.col("p"), F.col("o")
    plain = NOTES + [OWL + x for x in ("hasSelf", *sum(datatypes.COUNTS.values(), []))] + facets
    reserved = o.startswith(OWL) | o.startswith(RDFS) | o.startswith(RDF)
    typing = (p == RDF + "type") & (o.isin(heads) | ~reserved)
    rest = t.where(~(typing | p.isin(fine + NONE)))
    shaped = _any(taken).distinct().select(F.col("node").alias("s"))
    own = rest.where(p.isin(inside))
    left = [own.join(shaped, "s", "left_anti").select(F.col("s").alias("node"), F.substring_index("p", "#", -1).alias("what"))]
    left.append(t.where(p == OWL + "onProperty").join(shaped, "s", "left_anti").select("s", F.lit("restriction")))
    left.append(rest.where(p.isin(shapes)).join(denied_nodes.select(F.col("node").alias("s")), "s", "left_anti").select("s", F.lit("NegativePropertyAssertion")))
    rest = rest.where(~p.isin(inside + shapes))
    notes = g.typed("AnnotationProperty", "p")
    rest = rest.join(notes, "p", "left_anti")
    links = objects.select(F.col("r").alias("p"))
    stated = rest.where("o_kind <> 'literal'").join(links, "p", "left_anti").union(rest.where("o_kind = 'literal'").join(data.select(F.col("r").alias("p")), "p", "left_anti"))
    left.append(stated.select("s", F.concat(F.lit("triple of "), "p")))
    other = t.where(p.startswith(XSD) & ~p.isin(facets)).select("s", F.lit("facet"))
    # literals outside the lexical space of their datatype, or beyond its bounds
    literals = g.literals.where(~p.isin(plain)).select("s", F.coalesce("datatype", F.lit(terms.PREFIXES["xsd"] + "string")).alias("p"), "line", "key")
    fits = literals.select("p", "line", "key").distinct()
    fits = ranges.members(fits, fits.select("p", F.col("p").alias("node")), V.datatype_pieces(g.spark))
    left += [other, literals.join(fits.select("p", "line", "key"), ["p", "line", "key"], "left_anti").select("s", F.lit("literal"))]
    ends = t.where((p.isin(EXTREME) & ~p.isin(NONE)) | o.isin(EXTREME) | F.col("s").isin(EXTREME)).where(~((p == RDF + "type") & o.isin(heads)))
    left.append(ends.select("s", F.lit("top or bottom property")))
    # functional properties, domains and ranges of properties that are neither object nor data properties
    either = objects.union(data)
    used = _any([t.where(p.isin(RDFS + "domain", RDFS + "range", RDFS + "subPropertyOf")).select(F.col("s").alias("r")), g.typed("FunctionalProperty")]).distinct()
    left.append(used.join(either, "r", "left_anti").join(notes.withColumnRenamed("p", "r"), "r", "left_anti").select("r", F.lit("undeclared property")))
    return _any(left)
