"""Nested expressions, taxonomies, scopes of blank nodes, positions of errors, questions on parts."""

import random
import re

from quillon.operators import structure, taxonomy
from quillon.plans import annotations
from quillon.plans.reasoner import Reasoner
from quillon.sources import documents, ntriples
from test_reasoner import PREFIX, e, graph


def test_nested_expressions_are_compared_by_structure(spark):
    draw = random.Random(4)
    rows, want, made = [], {}, {}

    def build(depth):
        """A random expression; its node, and a text that is equal for equal ones."""
        if depth == 0 or draw.random() < 0.3:
            name = draw.choice("ABC")
            return name, name
        kind = draw.choice(["And", "Or", "Chain"])
        parts = [build(depth - 1) for _ in range(draw.choice([1, 2, 2, 3]))]
        node = f"_{len(want)}"
        texts = [t for _, t in parts] if kind == "Chain" else sorted({t for _, t in parts})
        want[node] = f"{kind}({','.join(texts)})"
        rows.extend((node, kind, "of", k if kind == "Chain" else None, p) for k, (p, _) in enumerate(parts))
        made.setdefault(want[node], []).append(node)
        return node, want[node]

    for _ in range(120):
        build(3)
    rows += [("c1", "And", "of", None, "c2"), ("c2", "And", "of", None, "c1")]
    table = spark.createDataFrame(rows, "node string, kind string, role string, pos int, part string")
    keys, left = structure.expression_keys(table)
    assert {r.node for r in left.collect()} == {"c1", "c2"}
    assert {r.node: r.same for r in structure.distinct_expressions(table).collect()} == {n: min(made[t]) for n, t in want.items()}
    assert keys.count() == len(want)


def test_taxonomy(spark):
    """Random hierarchies with equivalent classes against a search of all pairs."""
    draw = random.Random(9)
    names = [f"C{k:02}" for k in range(16)]
    reach = {(a, b) for a, b in ((draw.choice(names), draw.choice(names)) for _ in range(26)) if a != b}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c and a != d} - reach:
        reach |= more
    rep = {n: min([n, *(b for a, b in reach if a == n and (b, n) in reach)]) for n in {x for p in reach for x in p}}
    strict = {(rep[a], rep[b]) for a, b in reach if rep[a] != rep[b]}
    direct = {(a, b) for a, b in strict if not any((a, c) in strict and (c, b) in strict for c in names)}
    pairs = spark.createDataFrame(sorted(reach), "sub string, sup string")
    assert {tuple(r) for r in taxonomy.equivalents(pairs).collect()} == set(rep.items())
    got = taxonomy.direct_parents(pairs)
    assert {tuple(r) for r in got.collect()} == direct
    depth = lambda n: max((depth(b) + 1 for a, b in direct if a == n), default=0)
    assert {tuple(r) for r in taxonomy.depths(got).collect()} == {(n, depth(n)) for p in direct for n in p}


def test_blank_nodes_of_documents_stay_apart(spark):
    rows = [("a", "node", "b1", "p", "node", "b2"), ("b", "node", "b1", "p", "iri", "http://e/x"), ("c", "node", "b1", "p", "iri", "http://e/x")]
    triples = spark.createDataFrame(rows, "doc string, s_kind string, s string, p string, o_kind string, o string")
    names = lambda xs: spark.createDataFrame(xs, "doc string, ontology_iri string, version_iri string")
    reached, faults = documents.closure(names([(x, "http://e/" + x, None) for x in "abc"]), spark.createDataFrame([("a", "http://e/b")], "doc string, iri string"), spark.createDataFrame([("a",), ("c",)], "doc string"))
    got = documents.union_of_imports(triples, reached).collect()
    assert faults.isEmpty() and {r.root: len({x.s for x in got if x.root == r.root}) for r in got} == {"a": 2, "c": 1}
    assert len({r.s for r in got}) == 3 and all(re.fullmatch(r"d[0-9A-F]+xb1", r.s) for r in got)


def test_import_chains_are_walked_by_doubling(spark):
    n = 40
    docs = spark.createDataFrame([(f"{k}", f"http://e/{k}", None) for k in range(n)], "doc string, ontology_iri string, version_iri string")
    links = spark.createDataFrame([(f"{k}", f"http://e/{(k + 1) % n}") for k in range(n)], "doc string, iri string")
    reached, _ = documents.closure(docs, links, spark.createDataFrame([("3",)], "doc string"))
    assert reached.count() == n


def test_errors_of_ntriples_have_their_byte(spark, tmp_path):
    good = ["<http://e/a> <http://e/p> <http://e/é> .", '_:b <http://e/p> "x\\n"@en . # note', "", "# nothing", "<http://e/a><http://e/p>_:c."]
    bad = [("é", 0, "subject"), ("<http://e/é> x", 14, "predicate"), ("<http://e/a> <http://e/p> 12 .", 26, "object"), ('<http://e/a> <http://e/p> "é"', 30, "full stop"), ("  <http://e/a> <http://e/p> _:c . x", 34, "end of line")]
    draw = random.Random(3)
    want, at, data = {}, 0, b""
    for number in range(400):
        line, where, kind = draw.choice(bad) if draw.random() < 0.1 else (draw.choice(good), None, None)
        if kind:
            want[number] = (at + where, kind)
        data += line.encode() + b"\n"
        at = len(data)
    want[400] = (at, "encoding")
    (tmp_path / "a.nt").write_bytes(data + b"<http://e/\xff> .\n")
    (tmp_path / "b.nt").write_bytes(b"\n".join(x.encode() for x in good))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert {r.number: (r.offset, r.kind) for r in ntriples.errors(spark, str(tmp_path)).collect()} == want
        first = ntriples.first_errors(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.number, r.offset, r.kind) for r in first] == [(min(want), *want[min(want)])]


def test_questions_on_a_part(spark):
    """Prescriptions in many parts; the asked one alone gives the same answers."""
    lines = [":D rdf:type owl:Class", ":E rdf:type owl:Class", ":r rdf:type owl:ObjectProperty", "_:s owl:onProperty :r", "_:s owl:someValuesFrom :D", "_:s rdfs:subClassOf :E"]
    lines += [x for k in range(40) for x in (f":x{k} :r :y{k}", *([f":y{k} rdf:type :D"] if k % 3 == 0 else []))]
    r = Reasoner.from_triples(graph(spark, "\n".join(lines)))
    assert [r.instance_of(e(f"x{k}"), e("E"), by_part=True) for k in (3, 4)] == [r.instance_of(e(f"x{k}"), e("E")) for k in (3, 4)] == [True, False]
    part = r.part_of(e("x3"))
    assert {x.x for x in part.individuals.collect()} == {e("x3"), e("y3")} and PREFIX["owl"]


def test_annotations_of_entities_and_axioms(spark):
    lines = """:note rdf:type owl:AnnotationProperty
:remark rdf:type owl:AnnotationProperty
:note rdfs:subPropertyOf :remark
:A rdfs:subClassOf :B
:A rdfs:label :text
:A :r :text
_:a rdf:type owl:Axiom
_:a owl:annotatedSource :A
_:a owl:annotatedProperty rdfs:subClassOf
_:a owl:annotatedTarget :B
_:a :note :why
_:b rdf:type owl:Axiom
_:b owl:annotatedSource :A
_:b owl:annotatedProperty rdfs:subClassOf
_:b owl:annotatedTarget :C
_:b :remark :why
_:c owl:annotatedSource :A
_:c :note :why"""
    g = graph(spark, lines)
    axioms = {(r.s[-1], r.o[-1], r.stated, r.note.rpartition("/")[2]) for r in annotations.of_axioms(g).collect()}
    assert axioms == {("A", "B", True, "note"), ("A", "B", True, "remark"), ("A", "C", False, "remark")}
    assert {(r.s[-1], r.note, r.value) for r in annotations.of_entities(g).collect()} == {("A", PREFIX["rdfs"] + "label", e("text"))}
