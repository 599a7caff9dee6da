from concurrent.futures import ThreadPoolExecutor

import pytest

from quillon.functions import terms
from quillon.operators import saturation, structure, validity
from quillon.operators.components import components
from quillon.plans import reasoner
from quillon.plans.ontology import list_members, mapped
from quillon.plans.reasoner import Reasoner
from quillon.plans.validity import first_violation
from quillon.sources import ntriples

PREFIX = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "": "http://e/"}

XSD = "http://www.w3.org/2001/XMLSchema#"


def graph(spark, text):
    """Triples written as ``s p o`` with prefixes; ``_:`` marks blank nodes."""
    rows = []
    for line in filter(None, text.splitlines()):
        terms = []
        for t in line.split():
            space, _, local = t.partition(":")
            terms.append(t[2:] if space == "_" else PREFIX[space] + local)
        rows.append((terms[0], terms[1], terms[2], "iri"))
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string")


PUMPS = """
:Pump rdf:type owl:Class
:Machine rdf:type owl:Class
:Faulty rdf:type owl:Class
:Inspect rdf:type owl:Class
:Void rdf:type owl:Class
:hasPart rdf:type owl:ObjectProperty
:hasPart rdf:type owl:TransitiveProperty
:hasComponent rdf:type owl:ObjectProperty
:hasComponent rdfs:subPropertyOf :hasPart
:Pump rdfs:subClassOf :Machine
_:a rdf:type owl:Restriction
_:a owl:onProperty :hasPart
_:a owl:someValuesFrom :Faulty
_:b owl:intersectionOf _:l1
_:l1 rdf:first :Machine
_:l1 rdf:rest _:l2
_:l2 rdf:first _:a
_:l2 rdf:rest rdf:nil
_:b rdfs:subClassOf :Inspect
:Void rdfs:subClassOf :Pump
:Void rdfs:subClassOf :Faulty
:Pump owl:disjointWith :Faulty
:p1 rdf:type :Pump
:p1 :hasComponent :m1
:m1 :hasComponent :b1
:b1 rdf:type :Faulty
:p2 rdf:type :Pump
"""


def e(name):
    return "http://e/" + name


def case_instances_and_taxonomy(spark):
    pumps = Reasoner.from_triples(graph(spark, PUMPS))
    assert pumps.consistent() is True
    assert pumps.instance_of(e("p1"), e("Inspect")) is True
    assert pumps.instance_of(e("p2"), e("Inspect")) is False
    assert [r.x for r in pumps.instances(e("Machine")).collect()] == [e("p1"), e("p2")]
    assert pumps.entails_link(e("p1"), e("hasPart"), e("b1")) is True
    assert pumps.subsumed(e("Pump"), e("Machine")) is True and pumps.subsumed(e("Machine"), e("Pump")) is False
    assert pumps.satisfiable(e("Void")) is False and pumps.satisfiable(e("Pump")) is True
    assert pumps.subsumed(e("Void"), e("Inspect")) is True


def case_clash_and_unknown(spark):
    assert Reasoner.from_triples(graph(spark, PUMPS + ":p1 rdf:type :Faulty")).consistent() is False
    more = Reasoner.from_triples(graph(spark, PUMPS + "_:x owl:unionOf _:y\n_:y rdf:first :Pump\n_:y rdf:rest _:z\n_:z rdf:first :Void\n_:z rdf:rest rdf:nil\n:Faulty rdfs:subClassOf _:x"))
    assert more.consistent() is None and more.instance_of(e("p2"), e("Inspect")) is None
    assert more.instance_of(e("p1"), e("Inspect")) is True


DECLARED = "\n".join([*(f":{c} rdf:type owl:Class" for c in "ABCDEKM"), *(f":{r} rdf:type owl:ObjectProperty" for r in "rqstuvwf")])
DATA = "\n:p rdf:type owl:DatatypeProperty\n:n rdf:type owl:DatatypeProperty"
SOME = """
_:x owl:onProperty :r
_:x owl:someValuesFrom :B
:A rdfs:subClassOf _:x
"""


def case_contexts_are_shared(spark):
    """What one class's successors are is not told of all members of the filler."""
    text = DECLARED + SOME + """
:r rdfs:range :C
_:w owl:onProperty :r
_:w owl:someValuesFrom :C
_:w rdfs:subClassOf :D
_:t owl:onProperty :s
_:t owl:someValuesFrom owl:Thing
_:t rdfs:subClassOf :E
:x :s :y
:f rdf:type owl:InverseFunctionalProperty
:g :f :h
:i :f :h
"""
    r = Reasoner.from_triples(graph(spark, text))
    assert r.subsumed(e("B"), e("C")) is False and r.subsumed(e("A"), e("D")) is True
    assert r.instance_of(e("x"), e("E")) is True and r.instance_of(e("y"), e("E")) is False
    assert r.instance_of(e("y"), PREFIX["owl"] + "Thing") is True and r.entails_same(e("g"), e("i")) is True
    assert r.still_open().isEmpty() and [x.consistent for x in r.consistent_by_parts().collect()] == [True, True]
    assert {tuple(x) for x in r.answers([("?a", e("s"), "?b"), ("?a", e("E"))]).collect()} == {(e("x"), e("y"))}


def case_open_rules_are_unknown(spark):
    text = DECLARED + SOME + """
_:y owl:onProperty :r
_:y owl:allValuesFrom :C
:A rdfs:subClassOf _:y
:s owl:inverseOf :q
_:v owl:onProperty :s
_:v owl:someValuesFrom :K
:M rdfs:subClassOf _:v
_:z owl:onProperty :q
_:z owl:someValuesFrom :M
_:z rdfs:subClassOf :D
"""
    text += """
:old owl:inverseOf :f
:f rdf:type owl:FunctionalProperty
_:o owl:onProperty :f
_:o owl:someValuesFrom :B
:E rdfs:subClassOf _:o
:old rdf:type owl:TransitiveProperty
"""
    r = Reasoner.from_triples(graph(spark, text))
    # the universal tells a context of its own, and an existential over an inverse is a universal: both are decided; a chain over an inverse is not
    assert {x.what for x in _open(r).collect()} == {"inverseOf"} and r.subsumed(e("B"), e("C")) is None


def _open(r):
    o = r.ontology
    return reasoner.open_ends(*r._contexts, o.rules, o.traits["FunctionalProperty"], o.traits["InverseFunctionalProperty"], o.traits["IrreflexiveProperty"])


def case_universals_and_inverses_reach_successors(spark):
    """A has an r-successor in B and C, so it is in D; M has a successor whose inverse leads back; functional successors are one."""
    text = DECLARED + SOME + """
_:y owl:onProperty :r
_:y owl:allValuesFrom :C
:A rdfs:subClassOf _:y
_:z owl:onProperty :r
_:z owl:someValuesFrom _:bc
_:bc owl:intersectionOf _:l1
_:l1 rdf:first :B
_:l1 rdf:rest _:l2
_:l2 rdf:first :C
_:l2 rdf:rest rdf:nil
_:z rdfs:subClassOf :D
:s owl:inverseOf :q
_:v owl:onProperty :s
_:v owl:someValuesFrom :K
:M rdfs:subClassOf _:v
_:w owl:onProperty :q
_:w owl:someValuesFrom :M
_:w rdfs:subClassOf :E
_:u owl:onProperty :s
_:u owl:someValuesFrom :E
_:u rdfs:subClassOf :D
:f rdf:type owl:FunctionalProperty
_:f1 owl:onProperty :f
_:f1 owl:someValuesFrom :B
:K rdfs:subClassOf _:f1
_:f2 owl:onProperty :f
_:f2 owl:someValuesFrom :C
:K rdfs:subClassOf _:f2
_:f3 owl:onProperty :f
_:f3 owl:someValuesFrom _:bc
_:f3 rdfs:subClassOf :E
"""
    r = Reasoner.from_triples(graph(spark, text))
    assert r.ontology.unsupported.collect() == []
    assert r.subsumed(e("A"), e("D")) is True and r.subsumed(e("M"), e("D")) is True and r.subsumed(e("K"), e("E")) is True
    assert r.subsumed(e("B"), e("C")) is False and r.subsumed(e("A"), e("E")) is False and r.satisfiable(e("A")) is True


def case_loops_values_and_extremes(spark):
    """A reflexive role's range holds of everything; a value's range may empty a class; nothing is related by the bottom role."""
    loops = Reasoner.from_triples(graph(spark, DECLARED + "\n:r rdf:type owl:ReflexiveProperty\n:r rdfs:range :C"))
    assert loops.subsumed(e("B"), e("C")) is True
    text = DECLARED + "\n_:v owl:onProperty :r\n_:v owl:hasValue :y\n:A rdfs:subClassOf _:v\n:r rdfs:range :C\n:y rdf:type :D\n:C owl:disjointWith :D\n"
    value = Reasoner.from_triples(graph(spark, text))
    assert value.satisfiable(e("A")) is False and value.satisfiable(e("B")) is True
    ends = DECLARED + "\nowl:bottomObjectProperty rdf:type owl:ObjectProperty\n:x owl:bottomObjectProperty :y"
    assert Reasoner.from_triples(graph(spark, ends)).consistent() is False
    top = DECLARED + "\nowl:topObjectProperty rdf:type owl:ObjectProperty\n_:t owl:onProperty owl:topObjectProperty\n_:t owl:someValuesFrom :B\n_:t rdfs:subClassOf :D\n:b rdf:type :B\n:x rdf:type :A"
    assert Reasoner.from_triples(graph(spark, top)).instance_of(e("x"), e("D")) is None


def case_every_kind_of_clash(spark):
    text = DECLARED + DATA + """
:r rdf:type owl:IrreflexiveProperty
:a1 :r :a1
:q rdf:type owl:AsymmetricProperty
:b1 :q :b2
:b2 :q :b1
_:d rdf:type owl:AllDifferent
_:d owl:distinctMembers _:l
_:l rdf:first :c1
_:l rdf:rest _:m
_:m rdf:first :c2
_:m rdf:rest _:m2
_:m2 rdf:first :c3
_:m2 rdf:rest rdf:nil
:c1 owl:sameAs :c3
_:n rdf:type owl:NegativePropertyAssertion
_:n owl:sourceIndividual :d1
_:n owl:assertionProperty :s
_:n owl:targetIndividual :d2
:u rdfs:subPropertyOf :s
:d1 :u :d2
:t owl:propertyDisjointWith :v
:e1 :t :e2
:e1 :v :e2
_:k rdf:type owl:AllDisjointClasses
_:k owl:members _:k1
_:k1 rdf:first :A
_:k1 rdf:rest _:k2
_:k2 rdf:first :B
_:k2 rdf:rest _:k3
_:k3 rdf:first :C
_:k3 rdf:rest rdf:nil
:f1 rdf:type :A
:f1 rdf:type :C
:p rdf:type owl:FunctionalProperty
:K owl:hasKey _:h
_:h rdf:first :n
_:h rdf:rest _:h2
_:h2 rdf:first :w
_:h2 rdf:rest rdf:nil
:h1 rdf:type :K
:h2 rdf:type :K
:h1 :w :hh
:h2 :w :hh
:h1 owl:differentFrom :h2
"""
    more = [("g1", "p", "1", "integer"), ("g1", "p", "2", "integer"), ("h1", "n", "7", "integer"), ("h2", "n", "07.0", "decimal"), ("i1", "n", "x", "string")]
    base = graph(spark, text + ":n rdfs:range :xsd").where("o <> 'http://e/xsd'").selectExpr("*", "cast(null as string) datatype")
    values = spark.createDataFrame([(e(x), e(p), v, "literal", XSD + t) for x, p, v, t in more] + [(e("n"), PREFIX["rdfs"] + "range", XSD + "decimal", "iri", None)], base.schema)
    r = Reasoner.from_triples(base.union(values))
    found = {(x.what, x.x.split(" ")[-1].rpartition("/")[2]) for x in r.clashes.collect()}
    assert {w for w, _ in found} == {"irreflexive", "asymmetric", "different individuals", "negative assertion", "disjoint properties", "empty class", "functional data", "data range"}
    assert {("different individuals", "h1"), ("different individuals", "c1"), ("empty class", "f1"), ("functional data", "g1"), ("data range", "i1")} <= found
    assert r.consistent() is False


def case_data_restrictions(spark):
    """Doses over 4000 and children make an alert; a domain types holders of values."""
    text = DECLARED + DATA + """
_:r owl:onProperty :p
_:r owl:someValuesFrom _:d
_:d rdf:type rdfs:Datatype
_:d owl:withRestrictions _:l
_:l rdf:first _:m
_:l rdf:rest rdf:nil
_:r rdfs:subClassOf :A
:n rdfs:domain :B
"""
    base = graph(spark, text).selectExpr("*", "cast(null as string) datatype")
    rows = [("_d", PREFIX["owl"] + "onDatatype", XSD + "decimal", "iri", None), ("_m", XSD + "minExclusive", "4000", "literal", XSD + "integer")]
    rows = [(s[1:], *x) for s, *x in rows]
    rows += [(e(x), e("p"), v, "literal", t) for x, v, t in [("rx1", "3000", XSD + "integer"), ("rx2", "4000.5", XSD + "decimal"), ("rx3", "8001/2", PREFIX["owl"] + "rational")]]
    rows.append((e("rx1"), e("n"), "5", "literal", XSD + "integer"))
    r = Reasoner.from_triples(base.union(spark.createDataFrame(rows, base.schema)))
    assert r.ontology.unsupported.collect() == []
    assert [x.x for x in r.instances(e("A")).collect()] == [e("rx2"), e("rx3")] and [x.x for x in r.instances(e("B")).collect()] == [e("rx1")]
    assert r.consistent() is True and r.instance_of(e("rx1"), e("A")) is False
    assert r.entails_value(e("rx1"), e("p"), "03000.0", XSD + "decimal") is True


def case_left_over_triples_are_listed(spark):
    o = mapped(graph(spark, ":A rdf:type owl:Class\n:x :undeclared :y\n_:b owl:onProperty :r\n:c owl:maxCardinality :d"))
    assert {x.what for x in o.unsupported.collect()} == {"triple of http://e/undeclared", "restriction", "maxCardinality"}


def case_equality(spark):
    text = """
:f rdf:type owl:ObjectProperty
:f rdf:type owl:FunctionalProperty
:C rdf:type owl:Class
:a :f :b
:a :f :c
:b rdf:type :C
"""
    r = Reasoner.from_triples(graph(spark, text))
    assert r.entails_same(e("b"), e("c")) is True and r.instance_of(e("c"), e("C")) is True
    assert Reasoner.from_triples(graph(spark, text + ":b owl:differentFrom :c")).consistent() is False


def case_universal_chain_and_value(spark):
    text = """
:up rdf:type owl:ObjectProperty
:old rdf:type owl:ObjectProperty
:aunt rdf:type owl:ObjectProperty
:sis rdf:type owl:ObjectProperty
:A rdf:type owl:Class
:B rdf:type owl:Class
:V rdf:type owl:Class
:A rdfs:subClassOf _:u
_:u owl:onProperty :up
_:u owl:allValuesFrom :B
_:v owl:onProperty :up
_:v owl:hasValue :y
_:v rdfs:subClassOf :V
:aunt owl:propertyChainAxiom _:l
_:l rdf:first :up
_:l rdf:rest _:m
_:m rdf:first :sis
_:m rdf:rest rdf:nil
:x rdf:type :A
:x :up :y
:y :sis :z
:old owl:inverseOf :up
"""
    r = Reasoner.from_triples(graph(spark, text))
    assert r.instance_of(e("y"), e("B")) is True and r.instance_of(e("x"), e("V")) is True
    assert r.entails_link(e("x"), e("aunt"), e("z")) is True and r.entails_link(e("y"), e("old"), e("x")) is True
    assert r.instance_of(e("z"), e("B")) is False


def case_violations(spark):
    text = """
:A rdf:type owl:Class
:A rdf:type rdfs:Datatype
:A rdfs:subClassOf :Missing
:r rdf:type owl:ObjectProperty
:r rdf:type owl:TransitiveProperty
:r rdf:type owl:FunctionalProperty
:q rdf:type owl:ObjectProperty
:B rdf:type owl:Class
:B owl:hasKey rdf:nil
_:d rdf:type owl:AllDisjointClasses
_:d owl:members _:l
_:l rdf:first :B
_:l rdf:rest rdf:nil
:D rdf:type rdfs:Datatype
:D owl:equivalentClass :E
:E rdf:type rdfs:Datatype
:E owl:equivalentClass :D
_:x :q _:x
_:y :q _:z
_:z :q _:w
_:w :q _:y
:r owl:propertyChainAxiom _:c
_:c rdf:first :q
_:c rdf:rest _:c2
_:c2 rdf:first :r
_:c2 rdf:rest _:c3
_:c3 rdf:first :q
_:c3 rdf:rest rdf:nil
:q rdfs:subPropertyOf :r
:n1 :q _:v
:n2 :q _:u
_:v :q _:u
_:u :q _:v
_:v owl:sameAs :n1
owl:topDataProperty rdfs:subPropertyOf :s
owl:Odd rdf:type owl:Class
"""
    found = Reasoner.from_triples(graph(spark, text)).violations()
    got = {(r.check_no, r.evidence.rpartition("/")[2]) for r in found.collect()}
    assert {(1, "B"), (2, "d"), (6, "A"), (7, "Missing"), (12, "D"), (12, "E"), (15, "r"), (16, "r"), (17, "v"), (18, "x"), (19, "w"), (20, "u"), (21, "u")} <= got
    assert {k for k, _ in got} == {1, 2, 5, 6, 7, 8, 9, 12, 15, 16, 17, 18, 19, 20, 21}
    assert [tuple(r)[0] for r in first_violation(found).collect()] == [1]


def test_lists_and_axiom_sets(spark):
    n = 300
    cells = [(f"l{k}", PREFIX["rdf"] + "first", f"m{k}") for k in range(n)] + [(f"l{k}", PREFIX["rdf"] + "rest", f"l{k + 1}" if k + 1 < n else PREFIX["rdf"] + "nil") for k in range(n)]
    t = spark.createDataFrame(cells, "s string, p string, o string")
    heads = spark.createDataFrame([("l0",), ("l7",)], "head string")
    got = {(r.head, r.pos, r.member) for r in list_members(t, heads).collect()}
    assert got == {("l0", k, f"m{k}") for k in range(n)} | {("l7", k - 7, f"m{k}") for k in range(7, n)}
    round_ = spark.createDataFrame([("a", PREFIX["rdf"] + "first", "x"), ("a", PREFIX["rdf"] + "rest", "a")], "s string, p string, o string")
    with pytest.raises(ValueError, match="circle"):
        list_members(round_, spark.createDataFrame([("a",)], "head string"))
    axioms = lambda rows: spark.createDataFrame(rows, "pos int, kind string, members array<string>")
    one, other = axioms([(1, "DisjointClasses", ["a", "b"]), (2, "SubClassOf", ["a", "b"])]), axioms([(1, "SubClassOf", ["a", "b"]), (2, "DisjointClasses", ["b", "a"]), (3, "DisjointClasses", ["a", "b"])])
    assert structure.same_axioms(one, other) and [r.pos for r in structure.distinct_axioms(other).orderBy("pos").collect()] == [1, 2]
    assert not structure.same_axioms(one, axioms([(1, "SubClassOf", ["b", "a"])]))


#: Examples of RFC 3986, 5.4, against http://a/b/c/d;p?q.
RESOLVED = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
            "#s": "http://a/b/c/d;p?q#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../../g": "http://a/g", "/./g": "http://a/g",
            "/../g": "http://a/g", "g.": "http://a/b/c/g.", "./../g": "http://a/b/g", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x"}


def test_terms(spark):
    from pyspark.sql import functions as F

    def each(f, values):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
        return [r.x for r in rows.orderBy("k").select(f(F.col("v")).alias("x")).collect()]

    assert each(lambda v: terms.resolved(v, F.lit("http://a/b/c/d;p?q")), RESOLVED) == list(RESOLVED.values())
    tags = {"en": True, "de-CH-1996": True, "zh-cmn-Hans-CN": True, "x-a": True, "i-klingon": True, "en-a-bbb-x-y": True, "e": False, "en-": False, "de-419-DE": False, "abcdefghi": False, "en-x": False}
    assert each(terms.is_language_tag, tags) == list(tags.values())
    iris = {"http://a/b": True, "http://a:80/": True, "http://a:x/": False, "http://[::1]/": True, "http://[::1/": False, "a": False, "urn:x": True, "http://a/%4": False, "http://a/[": False}
    assert each(terms.is_iri, iris) == list(iris.values())
    at = each(lambda v: terms.moment(v)["at"], ["1970-01-01T00:00:00Z", "1970-01-01T24:00:00", "1970-01-01T01:00:00.5+01:00", "1970-02-30T00:00:00", "x"])
    assert at == [0, 86400 * 10**6, 500000, None, None]
    key = lambda t: lambda v: terms.literal_key(F.lit(t), v, F.lit("EN"))
    assert each(key(PREFIX["owl"] + "rational"), ["1/2", "2/6", "4/2", "1/0"]) == ["decimal 0.5", "ratio 1/3", "decimal 2", None]
    assert each(key(XSD + "double"), ["1", "1e0", "-0", "0", "NaN", "INF", "x"]) == ["double 1.0", "double 1.0", "double -0.0", "double 0.0", "double NaN", "double Infinity", None]
    assert each(key(PREFIX["rdf"] + "langString"), ["x"]) == ["string x@en"] and each(key(XSD + "integer"), ["007", "1x"]) == ["decimal 7", None]
    assert each(lambda v: terms.matches_pattern(v, "a$[b^]+|c\\."), ["a$b^", "c.", "ab", "xc."]) == [True, True, False, False]
    with pytest.raises(ValueError, match="escape"):
        terms.xsd_pattern("\\d")
    assert each(terms.is_xml_text, ["a\tb", "a\x01"]) == [True, False] and each(terms.is_prefix_name, ["ex:", ":", "1:", "a.b:", "a.:"]) == [True, True, False, True, False]
    assert each(lambda v: terms.integers_between(v.cast("double"), F.lit(5.0), high_open=True), ["1.5", "5", "9"]) == [3, 0, 0]


def random_rules(draw):
    names, roles = [f"C{k}" for k in range(6)], ["r", "s"]
    pick = lambda x: draw.choice(x)
    rules = {"told": {(pick(names), pick(names)) for _ in range(4)}, "conj": {(pick(names), pick(names), pick(names)) for _ in range(2)}, "some": {(pick(roles), pick(names), pick(names)) for _ in range(3)}}
    return rules | {"give": {(pick(names), pick(roles), pick(names)) for _ in range(3)}, "role": {("r", "s")}, "chain": {("r", "s", "s")}, "range": {("s", pick(names))}, "domain": {("r", pick(names))}}


def brute(names, rules):
    """The same rules, one fact at a time."""
    ctx = saturation.CONTEXT
    sub, link = {(n, n) for n in names}, set()
    higher = {"r": {"r", "s"}, "s": {"s"}}
    while True:
        more_sub = {(x, d) for x, c in sub for a, d in rules["told"] if a == c} | {(x, z) for x, c in sub for a, b, z in rules["conj"] if a == c and (x, b) in sub}
        more_sub |= {(x, z) for x, r, y in link for q, c, z in rules["some"] if q == r and (y, c) in sub} | {(x, z) for x, r, _ in link for q, z in rules["domain"] if q == r}
        more_link = {(x, "s", y) for x, r, y in link if r == "r"} | {(x, "s", z) for x, r, y in link if r == "r" for w, q, z in link if w == y and q == "s"}
        for x, c in sub:
            for a, r, d in rules["give"]:
                if a == c:
                    y = f"{ctx}{r}{saturation.SEP}{d}"
                    more_link.add((x, r, y))
                    more_sub |= {(y, d)} | {(y, z) for q, z in rules["range"] if q in higher[r]}
        if more_sub <= sub and more_link <= link:
            return sub, link
        sub, link = sub | more_sub, link | more_link


def test_saturation_agrees_with_brute_force(spark):
    """Many random rule sets at once: names and roles of each carry its number."""
    import random

    draw = random.Random(11)
    shape = {"told": "c d", "conj": "a b e", "some": "r c e", "give": "c r d", "role": "r s", "chain": "r1 r2 s", "range": "r e", "domain": "r e"}
    rows, names, want_sub, want_link = {k: set() for k in shape}, [], set(), set()
    for k in range(60):
        rules = random_rules(draw)
        own = {n: [tuple(f"{x}#{k}" for x in row) for row in v] for n, v in rules.items()}
        for n, v in own.items():
            rows[n] |= set(v)
        sub, link = brute([f"C{i}" for i in range(6)], rules)
        mark = lambda x: saturation.SEP.join(f"{p}#{k}" for p in x.split(saturation.SEP))  # noqa: E731, B023
        want_sub |= {tuple(map(mark, x)) for x in sub}
        want_link |= {tuple(map(mark, x)) for x in link}
        names += [f"C{i}#{k}" for i in range(6)]
    tables = {k: spark.createDataFrame(sorted(v), ", ".join(f"{c} string" for c in shape[k].split())) for k, v in rows.items()}
    start = spark.createDataFrame([(n, n) for n in names], "x string, c string")
    sub, link = saturation.saturate(start, spark.createDataFrame([], "x string, r string, y string"), tables)
    assert {tuple(x) for x in sub.collect()} == want_sub and {tuple(x) for x in link.collect()} == want_link


def search_types(names, rules):
    """(a, b): subsumptions and, with b = NOTHING, empty classes, by type elimination: sets of classes that no
    axiom excludes stay as long as what they ask for can be met by others that stay. Role s is the inverse of r, q is above r."""
    from itertools import product

    steps = {"r": {("r", 0), ("q", 0), ("s", 1)}, "s": {("s", 0), ("r", 1), ("q", 1)}, "q": {("q", 0)}}

    def closed(t):
        return all(d in t for c, d in rules["told"] if c in t) and all(z in t for a, b, z in rules["conj"] if a in t and b in t)

    def allowed(t, u, role):
        for name, back in steps[role]:
            x, y = (u, t) if back else (t, u)
            if any(c in x and z not in y for c, n, z in rules["all"] if n == name) or any(c in y and z not in x for n, c, z in rules["some"] if n == name):
                return False
        return True

    left = {t for bits in product([0, 1], repeat=len(names)) if closed(t := frozenset(n for n, b in zip(names, bits, strict=True) if b)) and saturation.NOTHING not in t}
    while bad := {t for t in left for c, role, d in rules["give"] if c in t and not any(d in u and allowed(t, u, role) for u in left)}:
        left -= bad
    found = set()
    for a in names:
        own = [t for t in left if a in t]
        found |= {(a, saturation.NOTHING)} if not own else {(a, b) for b in names if all(b in t for t in own)}
    return found


def test_contexts_agree_with_a_search_of_types(spark):
    """Universals, inverse roles and a role hierarchy over successors that have no name: 25 random ontologies at once."""
    import random

    draw = random.Random(21)
    names, roles = [f"C{k}" for k in range(5)], ["r", "s", "q"]
    pick = lambda x: draw.choice(x)
    shape = {"told": "c d", "conj": "a b e", "some": "r c e", "give": "c r d", "all": "c r e", "role": "r s", "inverse": "r s"}
    rows, want, classes = {k: set() for k in shape}, set(), []
    for k in range(25):
        rules = {"told": {(pick(names), pick(names)) for _ in range(2)}, "conj": {(pick(names), pick(names), pick([*names, saturation.NOTHING])) for _ in range(2)}, "some": {(pick(roles), pick(names), pick(names)) for _ in range(2)}}
        rules |= {"give": {(pick(names), pick(roles), pick(names)) for _ in range(3)}, "all": {(pick(names), pick(roles), pick(names)) for _ in range(2)}}
        mark = lambda x: x if x == saturation.NOTHING else f"{x}#{k}"  # noqa: E731, B023
        for n, v in rules.items():
            rows[n] |= {tuple(map(mark, row)) for row in v}
        rows["role"].add((f"r#{k}", f"q#{k}"))
        rows["inverse"] |= {(f"r#{k}", f"s#{k}"), (f"s#{k}", f"r#{k}")}
        want |= {(mark(a), mark(b)) for a, b in search_types(names, rules)}
        classes += [f"{n}#{k}" for n in names]
    tables = {k: spark.createDataFrame(sorted(v), ", ".join(f"{c} string" for c in shape[k].split())) for k, v in rows.items()}
    tables["bottom"] = spark.createDataFrame([(1,)], "n int")
    start = spark.createDataFrame([(saturation.CONTEXT + c, c) for c in classes], "x string, c string")
    sub, _ = saturation.saturate(start, spark.createDataFrame([], "x string, r string, y string"), tables)
    got = {(r.x[1:], r.c) for r in sub.collect() if saturation.SEP not in r.x}
    empty = {a for a, b in got if b == saturation.NOTHING}
    assert empty == {a for a, b in want if b == saturation.NOTHING} and 2 < len(empty) < 100
    assert {(a, b) for a, b in got if a not in empty} == {(a, b) for a, b in want if a not in empty}


def test_long_chains_of_told_classes_and_containers(spark):
    """A hierarchy of 260 steps; 1,200 members of a container leave the rules as they are."""
    n = 260
    told = spark.createDataFrame([(f"C{k:03}", f"C{k + 1:03}") for k in range(n)], "c string, d string")
    start = spark.createDataFrame([(saturation.CONTEXT + f"C{k:03}", f"C{k:03}") for k in range(n + 1)], "x string, c string")
    sub, _ = saturation.saturate(start, spark.createDataFrame([], "x string, r string, y string"), {"told": told})
    assert sub.count() == (n + 1) * (n + 2) // 2
    lines = ":A rdf:type owl:Class\n:B rdf:type owl:Class\n:A rdfs:subClassOf :B\n:x rdf:type :A\n" + "\n".join(f":bag rdf:_{k} :x" for k in range(1200))
    assert {(r.c, r.d) for r in mapped(graph(spark, lines)).rules["told"].collect()} == {(e("A"), e("B"))}


def test_ntriples(spark, tmp_path):
    lines = ['<http://e/a> <http://e/p> "x\\"\\u00e9\\U0001F600\\\\n\\n"@EN . # end', "_:b1 <http://e/p> <http://e/c> .", '<http://e/a> <http://e/p> "1"^^<http://e/int>.', "# nothing", "", "no triple ."]
    (tmp_path / "in.nt").write_text("\n".join(lines))
    triples, wrong = ntriples.read(spark, str(tmp_path / "in.nt"))
    got = {(r.s_kind, r.s, r.o_kind, r.o, r.datatype, r.lang) for r in triples.collect()}
    assert got == {("iri", "http://e/a", "literal", 'x"é😀\\n\n', ntriples.TAGGED, "en"), ("node", "b1", "iri", "http://e/c", None, None), ("iri", "http://e/a", "literal", "1", "http://e/int", None)}
    assert [r.line for r in wrong.collect()] == ["no triple ."]
    ntriples.write(triples, str(tmp_path / "out"))
    again, wrong = ntriples.read(spark, str(tmp_path / "out"))
    assert {(r.s_kind, r.s, r.o_kind, r.o, r.datatype, r.lang) for r in again.collect()} == got and wrong.isEmpty()


def test_graph_checks(spark):
    pairs = lambda x: spark.createDataFrame(x, "a string, b string")
    assert {(r.node, r.component) for r in components(pairs([("d", "c"), ("c", "b"), ("x", "y"), ("b", "a")])).collect()} == {(n, "a") for n in "abcd"} | {("x", "x"), ("y", "x")}
    assert [r.component for r in validity.anonymous_cycles(pairs([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")])).collect()] == ["a"]
    assert validity.twice_related(pairs([("a", "b"), ("b", "a"), ("c", "d")])).count() == 1
    assert {(r.a, r.b) for r in validity.irregular(pairs([("r", "s"), ("s", "r")]), pairs([])).collect()} == {("r", "r"), ("s", "s")}
    line = pairs([(f"{k:02}", f"{k + 1:02}") for k in range(40)])
    assert validity.closure(line).count() == 40 * 41 // 2


CASES = {k[5:]: f for k, f in globals().items() if k.startswith("case_")}


@pytest.fixture(scope="module")
def outcomes(spark):
    """What each case raised. A question takes many small jobs, so cases run side by side."""

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
