"""Documents that import each other, and the graphs of a dataset.

documents (doc, ontology_iri, version_iri), imports (doc, iri): an import names a document
by either of its IRIs. Texts (doc, content) are the bytes of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import checkpoint


def targets(documents: DataFrame, imports: DataFrame) -> DataFrame:
    """(doc, iri, matches, target): the documents that imports name; target is null unless there is exactly one."""
    names = documents.select(F.col("doc").alias("found"), F.explode(F.array_distinct(F.array_compact(F.array("ontology_iri", "version_iri")))).alias("iri"))
    rows = imports.select("doc", "iri").distinct().join(names, "iri", "left")
    met = rows.groupBy("doc", "iri").agg(F.count_distinct("found").alias("matches"), F.min("found").alias("target"))
    return met.withColumn("target", F.when(F.col("matches") == 1, F.col("target")))


def closure(documents: DataFrame, imports: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, doc) that are reachable from the roots (doc), themselves included, and the faults
    (doc, iri, fault) among the imports of reachable documents: missing or ambiguous ones."""
    found = checkpoint(targets(documents, imports))
    steps = checkpoint(found.where("target is not null").select(F.col("doc").alias("at"), F.col("target").alias("next")).distinct())
    # jumps double: after k rounds all documents within 2 ** k imports are known, and jumps lead as far
    state = checkpoint(roots.select(F.col("doc").alias("root"), "doc").distinct())
    jumps = steps.select("at", "next")
    while True:
        ahead = state.join(jumps, F.col("doc") == F.col("at")).select("root", F.col("next").alias("doc")).distinct()
        new = checkpoint(ahead.join(state, ["root", "doc"], "left_anti"))
        if new.isEmpty():
            break
        state = checkpoint(state.union(new))
        far = jumps.join(jumps.select(F.col("at").alias("next"), F.col("next").alias("far")), "next").select("at", F.col("far").alias("next"))
        jumps = checkpoint(jumps.union(far).distinct())
    fault = F.when(F.col("matches") == 0, "missing").when(F.col("matches") > 1, "ambiguous")
    faults = found.where("matches <> 1").join(state.select("doc").distinct(), "doc", "left_semi").select("doc", "iri", fault.alias("fault"))
    return state, faults


def assembled(axioms: DataFrame, reached: DataFrame) -> DataFrame:
    """``axioms`` (doc, …) of all documents that each root reaches, with the column root."""
    return reached.select("root", "doc").join(axioms, "doc")


def apart(triples: DataFrame) -> DataFrame:
    """Triples (doc, s_kind, s, p, o_kind, o, …) whose blank nodes carry their document in their label: equal
    labels of two documents are two individuals. The document is written in hexadecimal, so labels stay labels
    and no two pairs of document and label agree."""
    label = lambda c: F.concat(F.lit("d"), F.hex(F.col("doc").cast("string")), F.lit("x"), F.col(c))
    node = lambda c: F.when(F.col(c + "_kind") == "node", label(c)).otherwise(F.col(c))
    return triples.withColumns({"s": node("s"), "o": node("o")})


def union_of_imports(triples: DataFrame, reached: DataFrame) -> DataFrame:
    """(root, …): for each root the triples of all documents that it reaches, once each, blank nodes kept apart."""
    return assembled(apart(triples), reached).drop("doc").distinct()


def undecodable(texts: DataFrame, reached: DataFrame) -> DataFrame:
    """(doc): reachable documents whose content is no UTF-8."""
    return texts.join(reached.select("doc").distinct(), "doc", "left_semi").where(~F.is_valid_utf8(F.col("content"))).select("doc")


def selected_graph(quads: DataFrame, name: str | None = None) -> DataFrame:
    """Triples of the default graph (g is null) or of a named one."""
    return quads.where(F.col("g").isNull() if name is None else F.col("g") == name).drop("g")


def repeated_graphs(graphs: DataFrame) -> DataFrame:
    """(g, n): names that several graphs (g) of a dataset have."""
    return graphs.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
