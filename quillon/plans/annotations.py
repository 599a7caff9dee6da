"""Annotations as rows: of entities, and of axioms that a graph reifies.

A reified axiom is a node of type owl:Axiom that names the subject, predicate and object of the
triple which states the axiom; its other triples are the annotations. Annotations say nothing
about the world, so no rule reads them. Below an annotation property lie those that
rdfs:subPropertyOf puts there: an annotation by one is an annotation by all above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.terms import PREFIXES
from quillon.operators.components import checkpoint, spread
from quillon.operators.saturation import above
from quillon.plans.ontology import NOTES

RDF, RDFS, OWL = PREFIXES["rdf"], PREFIXES["rdfs"], PREFIXES["owl"]
#: What a reified axiom names, in the order of the columns s, p and o.
PARTS = {"s": OWL + "annotatedSource", "p": OWL + "annotatedProperty", "o": OWL + "annotatedTarget"}


def properties(triples: DataFrame) -> DataFrame:
    """(note): declared annotation properties, and those that need no declaration."""
    declared = triples.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "AnnotationProperty")).select(F.col("s").alias("note"))
    return declared.union(triples.sparkSession.createDataFrame([(x,) for x in NOTES], "note string")).distinct()


def _values(triples: DataFrame) -> DataFrame:
    """(s, note, value, kind, datatype, lang): annotations, by their own property and by those above it."""
    have = set(triples.columns)
    more = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("datatype", "lang")]
    notes = checkpoint(properties(triples))
    told = triples.where(F.col("p") == RDFS + "subPropertyOf").join(notes, F.col("s") == F.col("note"), "left_semi").select(F.col("s").alias("r"), F.col("o").alias("s"))
    higher = above(told.union(notes.select("note", F.col("note"))))
    rows = triples.join(higher, F.col("p") == F.col("r")).select(triples["s"], higher["s"].alias("note"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), *more)
    return rows.distinct()


def of_entities(triples: DataFrame) -> DataFrame:
    """(s, note, value, kind, datatype, lang): annotations of entities; those of reified axioms are left out."""
    reified = triples.where(F.col("p") == PARTS["s"]).select("s")
    return _values(triples).join(reified, "s", "left_anti")


def of_axioms(triples: DataFrame) -> DataFrame:
    """(s, p, o, stated, note, value, kind, datatype, lang): annotations of the triples that reified axioms name, and
    whether the graph states the triple itself. A node that lacks one of the three names gives no row."""
    triples = spread(triples, "s")
    named = triples.where(F.col("p").isin(*PARTS.values()))
    pick = lambda iri: F.min(F.when(F.col("p") == iri, F.col("o")))
    axioms = named.groupBy(F.col("s").alias("node")).agg(*[pick(iri).alias(c) for c, iri in PARTS.items()]).na.drop()
    stated = triples.select("s", "p", "o", F.lit(True).alias("stated")).distinct()
    axioms = checkpoint(axioms.join(stated, ["s", "p", "o"], "left").withColumn("stated", F.coalesce("stated", F.lit(False))))
    notes = _values(triples).withColumnRenamed("s", "node")
    return axioms.join(notes, "node").drop("node").distinct()
