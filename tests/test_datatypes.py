"""Values of data in questions: datatypes, facets, nested ranges, definitions, cardinalities."""

import math
import random
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillon.functions import values as V
from quillon.operators import ranges
from quillon.plans.reasoner import Reasoner

RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
SPACES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "": "http://e/"}
SCHEMA = "s string, p string, o string, o_kind string, datatype string, lang string"
DECLARED = [*(f":{c} rdf:type owl:Class" for c in "ABCDE"), ":r rdf:type owl:ObjectProperty", *(f":{p} rdf:type owl:DatatypeProperty" for p in "pqn")]


def iri(name):
    space, _, local = name.partition(":")
    return local if space == "_" else SPACES[space] + local


def graph(spark, *lines):
    """Triples ``s p o``; an object ``text^type`` or ``text@lang`` is a literal. ``s p [a b c]`` makes a list."""
    rows, cells = [], 0
    for line in [*DECLARED, *lines]:
        s, p, o = line.split(" ", 2)
        if o.startswith("["):
            members = o[1:-1].split()
            names = [f"list{len(rows)}x{k}" for k in range(len(members))] + [None]
            rows.append((iri(s), iri(p), names[0] or RDF + "nil", "iri", None, None))
            for k, m in enumerate(members):
                rows += [(names[k], RDF + "first", *term(m)), (names[k], RDF + "rest", names[k + 1] or RDF + "nil", "iri", None, None)]
            continue
        rows.append((iri(s), iri(p), *term(o)))
    return spark.createDataFrame(rows, SCHEMA)


def term(o):
    if "^" in o:
        text, _, kind = o.rpartition("^")
        return text, "literal", iri(kind), None
    if "@" in o:
        text, _, lang = o.rpartition("@")
        return text, "literal", RDF + "langString", lang
    return iri(o), "iri", None, None


def some(filler, below=":D", p=":p", node="_:s"):
    return [f"{node} owl:onProperty {p}", f"{node} owl:someValuesFrom {filler}", f"{node} rdfs:subClassOf {below}"]


def asks(filler, above=":A", p=":p", node="_:t", op="someValuesFrom"):
    return [f"{node} owl:onProperty {p}", f"{node} owl:{op} {filler}", f"{above} rdfs:subClassOf {node}"]


def restricted(base, *facets, node="_:f"):
    rows = [f"{node} rdf:type rdfs:Datatype", f"{node} owl:onDatatype {base}", f"{node} owl:withRestrictions [{' '.join(f'{node}{k}' for k in range(len(facets)))}]"]
    return rows + [f"{node}{k} {f}" for k, f in enumerate(facets)]


def members(r, *classes):
    return {c: {x.x[-1] for x in r.instances(iri(":" + c)).collect()} for c in classes}


def case_members_by_value(spark):
    """Integers and decimals, any literal, doubles, many digits, definitions of definitions, counts, lengths and languages."""
    lines = [*(f":{c} rdf:type owl:Class" for c in "FGHIJKL"), *(f":p{k} rdf:type owl:DatatypeProperty" for k in range(1, 10))]
    lines += [*some("xsd:integer", ":A", ":p1", "_:s1"), *some("rdfs:Literal", ":B", ":p2", "_:s2"), *some("_:d", ":C", ":p3", "_:s3"), *restricted("xsd:double", "xsd:minInclusive 10^xsd:double", node="_:d")]
    lines += [*some("_:e", ":D", ":p4", "_:s4"), *restricted("xsd:decimal", "xsd:minExclusive 0^xsd:integer", node="_:e")]
    lines += [":Age rdf:type rdfs:Datatype", ":Minor rdf:type rdfs:Datatype", ":Minor owl:equivalentClass _:m", "_:m owl:intersectionOf [:Age _:f]", "_:m rdf:type rdfs:Datatype"]
    lines += [":Age owl:equivalentClass xsd:nonNegativeInteger", *restricted("xsd:integer", "xsd:maxExclusive 18^xsd:integer"), *some(":Minor", ":E", ":p5", "_:s5")]
    lines += ["_:s6 owl:onProperty :p6", "_:s6 owl:minQualifiedCardinality 2^xsd:nonNegativeInteger", "_:s6 owl:onDataRange xsd:integer", "_:s6 rdfs:subClassOf :F", ":q rdfs:subPropertyOf :p6"]
    lines += [*restricted("xsd:string", "xsd:minLength 3^xsd:integer", "xsd:maxLength 4^xsd:integer", node="_:g"), *some("_:g", ":G", ":p7", "_:s7"), *some("xsd:NCName", ":H", ":p7", "_:s8")]
    lines += [*restricted("rdf:PlainLiteral", "rdf:langRange de^xsd:string", node="_:l"), *some("_:l", ":I", ":p7", "_:s9")]
    # 1, 2, 3 or a decimal over 10, but no integer from 15 on
    lines += ["_:u rdf:type rdfs:Datatype", "_:u owl:intersectionOf [_:o _:c]", "_:o rdf:type rdfs:Datatype", "_:o owl:unionOf [_:n _:h]", "_:n rdf:type rdfs:Datatype", "_:n owl:oneOf [1^xsd:integer 2.0^xsd:decimal 3^xsd:byte]"]
    lines += [*restricted("xsd:decimal", "xsd:minExclusive 10^xsd:integer", node="_:h"), "_:c rdf:type rdfs:Datatype", "_:c owl:datatypeComplementOf _:i", *restricted("xsd:integer", "xsd:minInclusive 15^xsd:integer", node="_:i"), *some("_:u", ":J", ":p8", "_:s10")]
    lines += ["_:v owl:onProperty :p9", "_:v owl:hasValue 05.0^xsd:decimal", "_:v rdfs:subClassOf :K", ":p9 rdfs:domain :L"]
    given = """a p1 1.5^xsd:decimal;b p1 2.0^xsd:decimal;a p2 v^xsd:string;a p3 1e3^xsd:double;b p3 1000^xsd:decimal;b p3 NaN^xsd:double;a p4 0.0000000001^xsd:decimal;a p5 17^xsd:integer;b p5 -1^xsd:integer
a p6 1^xsd:integer;a q 2^xsd:integer;b p6 1^xsd:integer;b q 1.0^xsd:decimal;b p6 3.5^xsd:decimal;a p7 abc^xsd:string;b p7 abcde^xsd:string;c p7 a:b^xsd:string;d p7 x@de-CH;e p7 x@den;f p7 9abc^xsd:token
a p8 2^xsd:integer;b p8 2.5^xsd:decimal;c p8 15^xsd:integer;d p8 15.5^xsd:decimal;e p8 14^xsd:short;f p8 10^xsd:integer;g p8 31/2^owl:rational;h p8 32/2^owl:rational;i p8 1/3^owl:rational
a p9 5^xsd:integer;b p9 6^xsd:integer""".replace("\n", ";").split(";")
    r = Reasoner.from_triples(graph(spark, *lines, *[":{} :{} {}".format(*x.split()) for x in given]))
    assert r.ontology.unsupported.collect() == []
    want = {"A": "b", "B": "a", "C": "a", "D": "a", "E": "a", "F": "a", "G": "acf", "H": "ab", "I": "d", "J": "adeg", "K": "a", "L": "ab"}
    assert members(r, *want) == {c: set(x) for c, x in want.items()}
    assert r.instance_of(iri(":a"), iri(":A")) is False and r.entails_value(iri(":b"), iri(":p1"), "2", XSD + "integer") is True


def case_clashes_of_values(spark):
    """Ranges, universals and limits on the right, and a functional property that a class asks for otherwise."""
    lines = [*(f":p{k} rdf:type owl:DatatypeProperty" for k in range(1, 6)), ":p1 rdfs:range xsd:integer", ":a :p1 1.5^xsd:decimal", ":b :p1 1.0^xsd:decimal", *asks("xsd:integer", ":A", ":p2", "_:t1", "allValuesFrom")]
    lines += [":c rdf:type :A", ":c :p2 1.5^xsd:decimal", ":d rdf:type :A", ":d :p2 7^xsd:decimal", ":e :p2 1.5^xsd:decimal"]
    lines += [*asks("1^xsd:nonNegativeInteger", ":B", ":p3", "_:t2", "maxQualifiedCardinality"), "_:t2 owl:onDataRange xsd:integer", ":f rdf:type :B", ":f :p3 1^xsd:integer", ":f :p3 1.0^xsd:decimal", ":f :p3 2.5^xsd:decimal"]
    lines += [":g rdf:type :B", ":g :p3 1^xsd:integer", ":g :p3 2^xsd:integer", ":p4 rdf:type owl:FunctionalProperty", *restricted("xsd:integer", "xsd:minInclusive 18^xsd:integer"), *asks("_:f", ":C", ":p4", "_:t3")]
    lines += [":h rdf:type :C", ":h :p4 20^xsd:integer", ":i rdf:type :C", ":i :p5 7^xsd:integer", ":p5 rdfs:subPropertyOf :p4"]
    r = Reasoner.from_triples(graph(spark, *lines))
    assert {(x.what, x.x[-1]) for x in r.clashes.collect()} == {("data range", "a"), ("empty class", "c"), ("empty class", "g"), ("empty class", "i")}
    assert r.consistent() is False


def case_needs_of_classes(spark):
    """At least 3 integers from 1 to 2 can't be; what a class asks for implies wider ranges and domains; values of a functional property meet."""
    lines = [*(f":{c} rdf:type owl:Class" for c in "FGHI"), *(f":p{k} rdf:type owl:DatatypeProperty" for k in range(1, 4))]
    count = lambda n, c, t: [f"{t} owl:onProperty :p1", f"{t} owl:minQualifiedCardinality {n}^xsd:nonNegativeInteger", f"{t} owl:onDataRange _:f", f"{c} rdfs:subClassOf {t}"]
    lines += [*restricted("xsd:integer", "xsd:minInclusive 1^xsd:integer", "xsd:maxInclusive 2^xsd:integer"), *count(3, ":A", "_:t1"), *count(2, ":B", "_:t2"), *some("xsd:positiveInteger", ":D", ":p1"), ":p1 rdfs:domain :E"]
    lines += [":p2 rdf:type owl:FunctionalProperty", *restricted("xsd:integer", "xsd:minInclusive 18^xsd:integer", node="_:g"), *restricted("xsd:integer", "xsd:maxExclusive 18^xsd:integer", node="_:h")]
    lines += [*asks("_:g", ":F", ":p2", "_:t3"), *asks("_:h", ":G", ":p2", "_:t4"), ":H rdfs:subClassOf :F", ":H rdfs:subClassOf :G", ":x rdf:type :F", ":x :p2 20^xsd:integer"]
    r = Reasoner.from_triples(graph(spark, *lines))
    assert r.ontology.unsupported.collect() == []
    assert [r.satisfiable(iri(":" + c)) for c in "ABFGH"] == [False, True, True, True, False]
    assert [r.subsumed(iri(":B"), iri(":" + c)) for c in "DEC"] == [True, True, False] and r.consistent() is True


def case_open_ranges(spark):
    """A circle of definitions, a literal beyond its datatype, and a range that several others cover together."""
    low, high = restricted("xsd:integer", "xsd:maxInclusive 5^xsd:integer"), restricted("xsd:integer", "xsd:minExclusive 5^xsd:integer", node="_:g")
    lines = [":U rdf:type rdfs:Datatype", ":V rdf:type rdfs:Datatype", ":U owl:equivalentClass :V", ":V owl:equivalentClass :U", *some(":U", ":E", ":q", "_:z"), ":x :q 1^xsd:integer", ":x :n 300^xsd:byte"]
    r = Reasoner.from_triples(graph(spark, *lines, *low, *high, *asks("xsd:integer"), *some("_:f"), *some("_:g", node="_:w")))
    assert {u.what for u in r.ontology.unsupported.collect()} == {"data range", "literal", "data restriction"}
    assert r.subsumed(iri(":A"), iri(":D")) is None and r.instance_of(iri(":x"), iri(":E")) is None and r.consistent() is None


CASES = {k[5:]: f for k, f in globals().items() if k.startswith("case_")}


@pytest.fixture(scope="module")
def outcomes(spark):
    def run(case):
        try:
            case(spark)
        except BaseException as error:  # noqa: BLE001
            return error
        return None

    with ThreadPoolExecutor(8) as pool:
        return dict(zip(CASES, pool.map(run, CASES.values()), strict=True))


@pytest.mark.parametrize("name", CASES)
def test_case(outcomes, name):
    if outcomes[name] is not None:
        raise outcomes[name]


def numbers(draw):
    fixed = ["0", "-0", "0.0", "01", "1.0", "-9", "0.12", "0.123", "-0.12", "-0.123", "1/3", "-1/3", "2/6", "0.3333333333", "0.3333333334", "1/1024", "0.0009765625", "123456789012345678901234567890", "0.0000000001", ".5", "5.", "7/7"]
    return fixed + [f"{draw.randrange(-50, 50)}.{draw.randrange(1000):03}" for _ in range(40)] + [f"{draw.randrange(-50, 50)}/{draw.randrange(1, 30)}" for _ in range(40)]


def test_keys_have_the_order_of_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in [*numbers(random.Random(1)), "1/0", "x", "", "."]], "t string").select("t", V.number_place(F.col("t")).alias("p")).select("t", "p.line", "p.key", V.integer_of(F.col("p.key")).alias("n")).collect()
    assert {r.t for r in rows if r.key is None} == {"1/0", "x", "", "."}
    known = [(Fraction(r.t), r) for r in rows if r.key is not None]
    for a, x in known:
        assert x.n == math.trunc(a) and (x.line == "integer") == (a.denominator == 1)
        assert all((a < b) == (x.key < y.key) and (a == b) == (x.key == y.key) for b, y in known)


def test_random_ranges_agree_with_brute_force(spark):
    """Nested unions, intersections and complements of numeric facets, over integers, decimals and fractions."""
    draw = random.Random(7)
    texts = sorted({*numbers(draw), *map(str, range(-12, 13)), *(f"{k}.5" for k in range(-12, 13))})
    atoms, tests = [], {}
    for k in range(14):
        facet, bound = draw.choice(V.ORDER), draw.choice(["-3", "2.5", "0", "7", "1/3", "-4.25", "10"])
        atoms.append((f"a{k}", facet, bound, OWL + "rational"))
        tests[f"a{k}"] = {"minInclusive": lambda v, b: v >= b, "minExclusive": lambda v, b: v > b, "maxInclusive": lambda v, b: v <= b, "maxExclusive": lambda v, b: v < b}[facet], Fraction(bound)
    want = {a: {t for t in texts if f(Fraction(t), b)} for a, (f, b) in tests.items()}
    want[XSD + "integer"] = {t for t in texts if Fraction(t).denominator == 1}
    names, expressions = list(want), []
    for k in range(40):
        way, parts = draw.choice(ranges.WAYS), draw.sample(names, draw.choice([1, 2, 3]))
        parts = parts[:1] if way == "none" else parts
        expressions += [(f"e{k}", way, i, x) for i, x in enumerate(parts)]
        sets = [want[x] for x in parts]
        want[f"e{k}"] = set(texts) - sets[0] if way == "none" else set.intersection(*sets) if way == "all" else set.union(*sets)
        names.append(f"e{k}")
    pieces = V.facet_pieces(spark.createDataFrame(atoms, "node string, facet string, bound string, datatype string")).union(V.datatype_pieces(spark).where(F.col("node") == XSD + "integer"))
    known = spark.createDataFrame([(a[0],) for a in atoms] + [(XSD + "integer",)], "node string")
    found, left = ranges.resolved(pieces, known, spark.createDataFrame(expressions, "node string, way string, pos int, part string"))
    assert left.collect() == []
    values = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lit("p").alias("p"), "t", V.number_place(F.col("t")).alias("at")).select("p", "t", "at.line", "at.key")
    asked = spark.createDataFrame([("p", n) for n in want], "p string, node string")
    got = {n: set() for n in want}
    for r in ranges.members(values, asked, found).collect():
        assert r.t not in got[r.node]
        got[r.node].add(r.t)
    assert got == want


def test_amounts(spark):
    facets = [("a", "minInclusive", "1", XSD + "integer"), ("b", "maxExclusive", "4.5", XSD + "decimal"), ("c", "minExclusive", "4.5", XSD + "decimal")]
    pieces = V.facet_pieces(spark.createDataFrame(facets, "node string, facet string, bound string, datatype string")).union(V.datatype_pieces(spark))
    rows = [("few", "all", k, x) for k, x in enumerate(["a", "b", XSD + "integer"])] + [("void", "all", k, x) for k, x in enumerate(["b", "c"])] + [("many", "all", 0, "a"), ("bytes", "any", 0, XSD + "byte"), ("bytes", "any", 1, XSD + "boolean")]
    expressions = spark.createDataFrame(rows, "node string, way string, pos int, part string")
    found, _ = ranges.resolved(pieces, pieces.select("node").distinct(), expressions)
    got = {r.node: r.amount for r in ranges.amounts(found, expressions.select("node")).collect()}
    assert got == {"few": 4, "void": 0, "many": None, "bytes": 258}
