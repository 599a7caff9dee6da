"""The 21 checks of OWL 2 DL over a graph's triples: (check_no, check_name, evidence)."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.terms import DATATYPES, PREFIXES
from quillon.operators import validity
from quillon.operators.components import checkpoint, components

if TYPE_CHECKING:
    from quillon.plans.ontology import Ontology

RDF, RDFS, OWL = PREFIXES["rdf"], PREFIXES["rdfs"], PREFIXES["owl"]
#: Names of the checks, in their order.
CHECKS = [
    "empty key", "arity or repeated members", "reserved ontology IRI", "reserved version IRI", "reserved entity IRI", "conflicting declarations", "missing declaration",
    "position of the top data property", "undefined datatype", "redefined standard datatype", "datatype defined twice", "cyclic datatype definitions",
    "defined datatype under facets", "defined datatype of a literal", "composite property where a simple one is due", "irregular property hierarchy",
    "anonymous individual in a forbidden place", "anonymous self-loop", "anonymous cycle", "two assertions on one anonymous pair", "no boundary root",
]
#: Predicates whose lists need two members or more, and predicates that need simple properties.
PAIRED = ["disjointUnionOf", "distinctMembers", "intersectionOf", "members", "propertyChainAxiom", "unionOf"]
COUNTED = ["cardinality", "hasSelf", "maxCardinality", "maxQualifiedCardinality", "minCardinality", "minQualifiedCardinality", "qualifiedCardinality"]
SIMPLE = ["AsymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty"]


def _any(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _reserved(iri: Column) -> Column:
    found = F.lit(False)
    for space in validity.RESERVED:
        found = found | iri.startswith(space)
    return found


def _blank(name: Column) -> Column:
    """Blank nodes have labels without a colon; IRIs have a scheme."""
    return ~name.contains(":") & ~name.startswith("owl")


def _is_class(o: Column) -> Column:
    return ~_blank(o) & ~_reserved(o) & ~o.isin("owl:Thing", "owl:Nothing")


def violations(o: Ontology) -> DataFrame:
    """All rows that break a check, in the order of the checks and then of the evidence."""
    from quillon.plans.ontology import list_members

    t = o.triples
    own = lambda p: t.where(F.col("p") == p)
    pair = lambda p, a, b: own(p).select(F.col("s").alias(a), F.col("o").alias(b))
    typed = lambda k: t.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + k)).select(F.col("s").alias("r"))
    kind = F.when(F.col("kind") == "DatatypeProperty", "DataProperty").otherwise(F.col("kind"))
    entities = checkpoint(o.entities.select("iri", kind.alias("kind")).distinct())
    found: dict[int, DataFrame] = {}

    found[1] = own(OWL + "hasKey").where(F.col("o") == RDF + "nil").select("s")
    lists = t.where(F.col("p").isin([OWL + x for x in PAIRED])).select(F.col("s").alias("axiom"), F.col("o").alias("head"), "p").distinct()
    members = checkpoint(lists.join(list_members(t, lists.select("head")), "head"))
    sizes = lists.join(members.groupBy("head").agg(F.count("*").alias("n"), F.count_distinct("member").alias("d")), "head", "left").na.fill(0, ["n", "d"])
    found[2] = sizes.where((F.col("n") < 2) | ((F.col("d") < F.col("n")) & (F.col("p") != OWL + "propertyChainAxiom"))).select("axiom")
    heads = typed("Ontology")
    found[3] = heads.where(_reserved(F.col("r")))
    found[4] = pair(OWL + "versionIRI", "a", "b").where(_reserved(F.col("b"))).select("b")
    builtin = [PREFIXES[x.split(":")[0]] + x.split(":")[1] for v in DATATYPES.values() for x in v]
    builtin += [OWL + x for x in ("Thing", "Nothing", "topObjectProperty", "bottomObjectProperty", "topDataProperty", "bottomDataProperty")] + [RDFS + "Literal"]
    found[5] = validity.reserved(entities.where(~F.col("iri").isin(builtin))).where(F.col("kind") != "NamedIndividual").select("iri")
    found[6] = validity.conflicting_declarations(entities).select("iri")

    # declarations: classes by position, properties as predicates and after onProperty
    datatypes = checkpoint(entities.where("kind = 'Datatype'").select(F.col("iri").alias("name")).distinct())
    subject = t.where(F.col("p").isin(RDFS + "subClassOf", OWL + "equivalentClass", OWL + "disjointWith")).select(F.explode(F.array("s", "o")).alias("iri"))
    uses = subject.union(t.where(F.col("p") == RDF + "type").select("o")).where(_is_class(F.col("iri")))
    uses = uses.join(datatypes.withColumnRenamed("name", "iri"), "iri", "left_anti").select("iri", F.lit("Class").alias("kind"))
    missing = validity.missing_declarations(uses, entities).select("iri")
    properties = t.where(~_reserved(F.col("p")) & (F.col("p") != RDF + "type")).select(F.col("p").alias("iri")).union(own(OWL + "onProperty").where(~_blank(F.col("o")) & ~_reserved(F.col("o"))).select("o"))
    known = entities.where(F.col("kind").endswith("Property")).select("iri")
    found[7] = missing.union(properties.distinct().join(known, "iri", "left_anti"))
    top = OWL + "topDataProperty"
    found[8] = t.where((F.col("s") == top) | (F.col("p") == top) | ((F.col("o") == top) & (F.col("p") != RDFS + "subPropertyOf"))).select("s")

    # datatype definitions
    defined = checkpoint(pair(OWL + "equivalentClass", "name", "range").join(datatypes.union(t.sparkSession.createDataFrame([(x,) for x in builtin if not x.startswith(OWL)], "name string")).distinct(), "name", "left_semi"))
    custom = datatypes.where(~F.col("name").isin(builtin) & ~_blank(F.col("name")))
    found[9] = custom.join(defined, "name", "left_anti").select("name")
    found[10] = defined.where(F.col("name").isin(builtin)).select("name")
    found[11] = defined.groupBy("name").agg(F.count_distinct("range").alias("n")).where("n > 1").select("name")
    parts = _any([pair(OWL + "onDatatype", "a", "b"), pair(OWL + "datatypeComplementOf", "a", "b"), members.where(F.col("p").isin(OWL + "unionOf", OWL + "intersectionOf")).select("axiom", "member"), defined.select("name", "range")])
    reach = parts.where("a is not null and b is not null").distinct()
    found[12] = validity.cyclic_definitions(reach).join(datatypes, "name", "left_semi").select("name")
    found[13] = pair(OWL + "onDatatype", "a", "name").join(defined.where(~F.col("name").isin(builtin)), "name", "left_semi").select("name")
    found[14] = t.where("o_kind = 'literal'").select(F.col("datatype").alias("name")).distinct().join(defined.where(~F.col("name").isin(builtin)), "name", "left_semi").select("name")

    # composite properties and their order
    turned = pair(OWL + "inverseOf", "a", "b")
    turned = turned.union(turned.select("b", "a"))
    below = pair(RDFS + "subPropertyOf", "a", "b")
    equal = pair(OWL + "equivalentProperty", "a", "b")
    below = below.union(equal).union(equal.select("b", "a")).union(turned)
    chains = members.where(F.col("p") == OWL + "propertyChainAxiom").select(F.col("axiom").alias("s"), "head", "pos", "member")
    composite = _any([chains.select("s"), typed("TransitiveProperty"), t.sparkSession.createDataFrame([(OWL + "topObjectProperty",), (OWL + "bottomObjectProperty",)], "r string")])
    composite = composite.select(F.col(composite.columns[0]).alias("r")).distinct()
    counted = t.where(F.col("p").isin([OWL + x for x in COUNTED])).select("s").join(own(OWL + "onProperty").select("s", F.col("o").alias("r")), "s").select("r")
    apart = own(OWL + "propertyDisjointWith").select(F.explode(F.array("s", "o")).alias("r"))
    apart = apart.union(members.where(F.col("p") == OWL + "members").join(typed("AllDisjointProperties").withColumnRenamed("r", "axiom"), "axiom", "left_semi").select("member"))
    required = _any([counted, apart, *[typed(k) for k in SIMPLE]])
    found[15] = validity.non_simple_uses(required, composite, below).select("r")
    last = chains.groupBy("s", "head").agg(F.max("pos").alias("last"), F.min(F.when(F.col("pos") == 0, F.col("member"))).alias("first"))
    rows = chains.join(last, ["s", "head"])
    itself = F.col("member") == F.col("s")
    leads = F.col("first") == F.col("s")
    order = rows.where((leads & (F.col("pos") > 0)) | (~leads & ~((F.col("pos") == F.col("last")) & itself)))
    whole = chains.groupBy("s", "head").agg(F.min(itself.cast("int")).alias("all_own")).where("all_own = 1")
    order = order.join(whole, ["s", "head"], "left_anti")
    found[16] = validity.irregular(order.select(F.col("member").alias("a"), F.col("s").alias("b")), below).select("a")

    # anonymous individuals
    individual = o.links.select("x", "r", "y")
    barred = _any([
        own(OWL + "sameAs").select(F.explode(F.array("s", "o")).alias("x")), own(OWL + "differentFrom").select(F.explode(F.array("s", "o"))),
        own(OWL + "sourceIndividual").select("o"), own(OWL + "targetIndividual").select("o"), own(OWL + "hasValue").where("o_kind <> 'literal'").select("o"),
        members.where(F.col("p").isin(OWL + "members", OWL + "distinctMembers")).join(typed("AllDifferent").withColumnRenamed("r", "axiom"), "axiom", "left_semi").select("member"),
    ])
    found[17] = barred.where(_blank(F.col("x"))).select("x")
    edges = checkpoint(individual.where(_blank(F.col("x")) & _blank(F.col("y"))).select("r", F.col("x").alias("a"), F.col("y").alias("b")))
    found[18] = edges.where("a = b").select("a")
    apart_edges = edges.where("a <> b")
    found[19] = validity.anonymous_cycles(apart_edges).select("component")
    found[20] = validity.twice_related(apart_edges).select("a")
    touched = _any([individual.where(_blank(F.col("x")) & ~_blank(F.col("y"))).select(F.col("x").alias("node")), individual.where(~_blank(F.col("x")) & _blank(F.col("y"))).select("y")]).distinct()
    found[21] = components(apart_edges.select("a", "b")).join(touched, "node", "left_semi").groupBy("component").count().where("count > 1").select("component")

    rows = [df.select(F.lit(k).alias("check_no"), F.lit(CHECKS[k - 1]).alias("check_name"), F.col(df.columns[0]).alias("evidence")).distinct() for k, df in sorted(found.items())]
    return _any(rows).orderBy("check_no", "evidence")


def first_violation(found: DataFrame) -> DataFrame:
    """The row that counts: the first check that fails, and its first evidence; no rows if all pass."""
    best = found.agg(F.min(F.struct("check_no", "evidence", "check_name")).alias("v")).where("v is not null")
    return best.select("v.check_no", "v.check_name", "v.evidence")
