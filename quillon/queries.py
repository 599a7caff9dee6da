"""One query for each operator over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import terms
from quillon.functions import values as V
from quillon.operators import constraints, ranges, structure, taxonomy, validity
from quillon.operators.components import checkpoint, components, representatives
from quillon.operators.saturation import NOTHING, context, not_closed, saturate
from quillon.plans import annotations
from quillon.plans import validity as validity_plan
from quillon.plans.ontology import RDF, list_members, mapped
from quillon.sources import documents, ntriples
from quillon.sources.commerce import edges, named, part_types, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _rules(spark: SparkSession, **rows: list[tuple]) -> dict[str, DataFrame]:
    shape = {"told": "c string, d string", "conj": "a string, b string, e string", "some": "r string, c string, e string", "all": "c string, r string, e string", "self": "r string, e string", "role": "r string, s string", "chain": "r1 string, r2 string, s string", "inverse": "r string, s string", "domain": "r string, e string", "range": "r string, e string"}
    # a DataFrame of Python rows has no known size: unless marked, facts would be shuffled by their few roles or classes
    return {k: F.broadcast(spark.createDataFrame(v, shape[k])) for k, v in rows.items()}


def _no_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "x string, c string")


@query("""SELECT DISTINCT 'c' || o_custkey AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'""")
def el_instance_some_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """some placed (some contains Economy) below EconomyBuyer."""
    rules = _rules(spark, some=[("contains", "ECONOMY", "EconomyOrder"), ("placed", "EconomyOrder", "EconomyBuyer")])
    sub, _ = saturate(part_types(spark, sf_dir), edges(spark, sf_dir, "placed", "contains"), rules)
    return sub.where("c = 'EconomyBuyer'").select("x")


_PLACES = """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS x, 'r' || n_regionkey AS y FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
p AS (SELECT x, y FROM e UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x)"""


@query(_PLACES + " SELECT x, y FROM p")
def role_transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locatedIn is transitive and above inRegion, inNation and basedIn."""
    rules = _rules(spark, role=[(r, "locatedIn") for r in ("inRegion", "inNation", "basedIn")], chain=[("locatedIn", "locatedIn", "locatedIn")])
    _, link = saturate(_no_types(spark), edges(spark, sf_dir, "inRegion", "inNation", "basedIn"), rules)
    return link.where("r = 'locatedIn'").select("x", "y")


@query("SELECT DISTINCT 'c' || o_custkey AS x, 'p' || l_partkey AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def role_chain_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed then contains is below bought."""
    _, link = saturate(_no_types(spark), edges(spark, sf_dir, "placed", "contains"), _rules(spark, chain=[("placed", "contains", "bought")]))
    return link.where("r = 'bought'").select("x", "y")


@query("""WITH RECURSIVE t AS (SELECT DISTINCT p_type || '|' || p_brand AS a, p_type AS b FROM part UNION SELECT DISTINCT p_type || '|' || p_brand, p_brand FROM part
UNION SELECT DISTINCT p_type, 'Product' FROM part UNION SELECT DISTINCT p_brand, 'Product' FROM part UNION SELECT 'Product', 'Thing'),
c AS (SELECT a, b FROM t UNION SELECT c.a, t.b FROM c JOIN t ON c.b = t.a) SELECT a AS sub, b AS sup FROM c""")
def el_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification of the classes that types and brands of parts generate."""
    part = table(spark, sf_dir, "part")
    both = F.concat_ws("|", "p_type", "p_brand")
    pairs = F.array(*[F.struct(c.alias("c"), d.alias("d")) for c, d in ((both, F.col("p_type")), (both, F.col("p_brand")), (F.col("p_type"), F.lit("Product")), (F.col("p_brand"), F.lit("Product")), (F.lit("Product"), F.lit("Thing")))])
    told = part.select(F.explode(pairs).alias("t")).select("t.c", "t.d").distinct()
    names = told.select(F.col("c").alias("x"), "c").distinct()
    sub, _ = saturate(names, edges(spark, sf_dir, "inRegion").limit(0), {"told": told})
    return sub.where("x <> c").select(F.col("x").alias("sub"), F.col("c").alias("sup"))


@query("SELECT DISTINCT a.p_brand AS c FROM part a JOIN part b ON a.p_brand = b.p_brand WHERE a.p_type = 'PROMO' AND b.p_type = 'ECONOMY'")
def el_unsatisfiable_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands below two disjoint types are empty."""
    told = table(spark, sf_dir, "part").select(F.col("p_brand").alias("c"), F.col("p_type").alias("d")).distinct()
    rules = {"told": told} | _rules(spark, conj=[("PROMO", "ECONOMY", NOTHING)])
    sub, _ = saturate(told.select(F.col("c").alias("x"), "c").distinct(), edges(spark, sf_dir, "inRegion").limit(0), rules)
    return sub.where(F.col("c") == NOTHING).select(F.col("x").alias("c"))


@query("SELECT DISTINCT 'c' || o_custkey AS x, 'Customer' AS c FROM orders UNION SELECT 'o' || o_orderkey, 'Order' FROM orders")
def domain_range_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub, _ = saturate(_no_types(spark), edges(spark, sf_dir, "placed"), _rules(spark, domain=[("placed", "Customer")], range=[("placed", "Order")]))
    return sub


@query("SELECT DISTINCT 'c' || c_custkey AS x, 'inNation' AS r, 'n' || c_nationkey AS y FROM customer UNION SELECT 'n' || c_nationkey, 'hasResident', 'c' || c_custkey FROM customer")
def inverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, link = saturate(_no_types(spark), edges(spark, sf_dir, "inNation"), _rules(spark, inverse=[("inNation", "hasResident"), ("hasResident", "inNation")]))
    return link


@query("""WITH e AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5)
SELECT 'n' || x AS x, 'n' || y AS y FROM e UNION SELECT 'n' || y, 'n' || x FROM e""")
def symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region whose keys are 5 apart are neighbours of each other."""
    n = table(spark, sf_dir, "nation")
    link = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey and b.n_nationkey = a.n_nationkey + 5"))
    link = link.select(F.concat(F.lit("n"), F.col("a.n_nationkey").cast("string")).alias("x"), F.lit("near").alias("r"), F.concat(F.lit("n"), F.col("b.n_nationkey").cast("string")).alias("y"))
    _, link = saturate(_no_types(spark), link, _rules(spark, inverse=[("near", "near")]))
    return link.select("x", "y")


@query("SELECT p_name AS x, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def functional_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").select(F.col("p_name").alias("x"), terms.value_key("string", F.col("p_brand")).alias("value_key"))
    return constraints.functional_violations(values)


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS a, doc_id AS b FROM documents QUALIFY min(doc_id) OVER (PARTITION BY text) <> doc_id")
def has_key_same_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HasKey(Document () (text)): named documents with one text are equal."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("x"), F.sha2("text", 256).alias("text"))
    return constraints.key_same(docs, ["text"])


@query("SELECT doc_id AS x, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents")
def same_individual_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("x"), F.sha2("text", 256).alias("text"))
    return representatives(docs, constraints.key_same(docs, ["text"]))


@query("""SELECT user_id AS x FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'""")
def disjoint_class_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "events").select(F.col("user_id").alias("x"), F.col("event_type").alias("c"))
    return constraints.disjoint_members(types, "purchase", "error")


@query("SELECT DISTINCT 'o' || l_orderkey AS x, 's' || l_suppkey AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0")
def negative_assertion_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are denied suppliers with a debt: the denied edges that are asserted."""
    held = edges(spark, sf_dir, "suppliedBy")
    debtors = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(named("s", "s_suppkey").alias("y"))
    denied = held.join(debtors, "y", "left_semi").select("x", "y")
    return constraints.denied_edges(held.select("x", "y"), denied)


@query("SELECT 'o' || l_orderkey AS x, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) >= 5")
def min_cardinality_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.at_least(edges(spark, sf_dir, "contains"), 5)


@query("SELECT 'o' || l_orderkey AS x, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 3")
def max_cardinality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 suppliers, who are all different."""
    suppliers = table(spark, sf_dir, "supplier").select(named("s", "s_suppkey").alias("x"))
    return constraints.at_least(edges(spark, sf_dir, "suppliedBy"), 4, suppliers)


@query("SELECT 'o' || l_orderkey AS x, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 3")
def exact_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.exactly(edges(spark, sf_dir, "suppliedBy"), 3)


def _ranges(spark: SparkSession, facets: list[tuple], points: list[tuple] = (), expressions: list[tuple] = ()) -> DataFrame:
    """Stretches of ranges: facets (node, facet, bound, datatype), values (node, text, datatype), expressions (node, way, pos, part)."""
    name = lambda t: V.full(t)
    pieces = V.datatype_pieces(spark)
    atoms = spark.createDataFrame([(n, f, b, name(t)) for n, f, b, t in facets], "node string, facet string, bound string, datatype string")
    values = spark.createDataFrame([(n, v, name(t)) for n, v, t in points], "node string, v string, datatype string")
    placed = checkpoint(values.select("node", V.place(F.col("datatype"), F.col("v"), F.lit(None).cast("string")).alias("at"))).select("node", "at.line", "at.key")
    pieces = checkpoint(pieces.union(V.facet_pieces(atoms)).union(V.point_pieces(placed)))
    known = pieces.select("node").union(atoms.select("node"))
    found, _ = ranges.resolved(pieces, known, spark.createDataFrame([(n, w, k, p) for n, w, k, p in expressions], "node string, way string, pos int, part string"))
    return found


def _held(values: DataFrame, datatype: str, asked: list[tuple[str, str]], pieces: DataFrame) -> DataFrame:
    """Values (p, lexical, …) of a datatype within the ranges (p, node) that are asked of their property."""
    placed = values.withColumn("at", V.place_of(datatype, F.col("lexical"))).withColumns({"line": F.col("at.line"), "key": F.col("at.key")}).drop("at", "lexical")
    return ranges.members(placed, values.sparkSession.createDataFrame(asked, "p string, node string"), pieces)


def _text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity >= 5 AND l_quantity < 10")
def facet_numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return rows.where(terms.facet(q, "minInclusive", 5.0) & terms.facet(q, "maxExclusive", 10.0)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def facet_datetime_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dateTime values of a year, as literals."""
    pieces = _ranges(spark, [("from", "minInclusive", "1995-01-01T00:00:00", "xsd:dateTime"), ("to", "maxExclusive", "1996-01-01T00:00:00", "xsd:dateTime")], expressions=[("year", "all", 0, "from"), ("year", "all", 1, "to")])
    values = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("ordered").alias("p"), _text(F.col("o_orderdate")).alias("lexical"))
    return _held(values, "xsd:dateTime", [("ordered", "year")], pieces).select("o_orderkey")


@query("""SELECT event_id, 'Odd' AS node FROM events WHERE (value < 5 OR value >= 95 OR value = 50) AND NOT (value >= 97 AND value < 98) UNION ALL SELECT event_id, 'Middle' FROM events WHERE value >= 40 AND value <= 60
UNION ALL SELECT event_id, 'Beyond' FROM events WHERE NOT (value >= 40 AND value <= 60)""")
def nested_ranges_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions, intersections, complements and an enumeration over doubles."""
    d = "xsd:double"
    facets = [("low", "maxExclusive", "5", d), ("high", "minInclusive", "95.0", d), ("a", "minInclusive", "9.7E1", d), ("b", "maxExclusive", "98", d), ("c", "minInclusive", "40", d), ("e", "maxInclusive", "60", d)]
    rows = [("u", "any", 0, "low"), ("u", "any", 1, "high"), ("u", "any", 2, "fifty"), ("ab", "all", 0, "a"), ("ab", "all", 1, "b"), ("not ab", "none", 0, "ab"), ("Odd", "all", 0, "u"), ("Odd", "all", 1, "not ab")]
    rows += [("Middle", "all", 0, "c"), ("Middle", "all", 1, "e"), ("Beyond", "none", 0, "Middle")]
    pieces = _ranges(spark, facets, [("fifty", "5e1", d)], rows)
    values = table(spark, sf_dir, "events").select("event_id", F.lit("value").alias("p"), F.col("value").cast("string").alias("lexical"))
    return _held(values, d, [("value", x) for x in ("Odd", "Middle", "Beyond")], pieces).select("event_id", "node")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Whole' AS node FROM lineitem WHERE l_extendedprice = floor(l_extendedprice) UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Cheap' FROM lineitem WHERE l_extendedprice <= 1000 AND l_extendedprice <> floor(l_extendedprice) UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Byte' FROM lineitem WHERE l_quantity BETWEEN -128 AND 127 AND l_quantity NOT IN (1, 2, 50)""")
def nested_ranges_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers among decimals, decimals that are none, and a bounded integer type without an enumeration."""
    rows = [("no integer", "none", 0, V.full("xsd:integer")), ("Cheap", "all", 0, "most"), ("Cheap", "all", 1, "no integer"), ("Cheap", "all", 2, V.full("xsd:decimal")), ("Whole", "any", 0, V.full("xsd:integer"))]
    rows += [("others", "none", 0, "few"), ("Byte", "all", 0, V.full("xsd:byte")), ("Byte", "all", 1, "others")]
    pieces = _ranges(spark, [("most", "maxInclusive", "1000", "xsd:integer")], [("few", "1", "xsd:integer"), ("few", "2.0", "xsd:decimal"), ("few", "100/2", "owl:rational")], rows)
    both = F.explode(F.array(F.struct(F.lit("price").alias("p"), F.col("l_extendedprice").alias("n")), F.struct(F.lit("quantity").alias("p"), F.col("l_quantity").alias("n"))))
    values = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", both.alias("v"))
    values = values.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v.p", F.col("v.n").cast("decimal(20,4)").cast("string").alias("lexical"))
    return _held(values, "xsd:decimal", [("price", "Whole"), ("price", "Cheap"), ("quantity", "Byte")], pieces).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "node")


@query("SELECT 'o' || l_orderkey AS x, count(DISTINCT l_quantity) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY l_orderkey HAVING count(DISTINCT l_quantity) >= 2")
def data_min_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least 2 different quantities from 10 to 20: values told apart by their place."""
    pieces = _ranges(spark, [("a", "minInclusive", "10", "xsd:integer"), ("b", "maxInclusive", "20", "xsd:integer")], expressions=[("some", "all", 0, "a"), ("some", "all", 1, "b")])
    values = table(spark, sf_dir, "lineitem").select(named("o", "l_orderkey").alias("x"), F.lit("quantity").alias("p"), F.col("l_quantity").cast("string").alias("lexical"))
    held = _held(values, "xsd:decimal", [("quantity", "some")], pieces)
    return constraints.at_least(held.select("x", F.concat_ws(" ", "line", "key").alias("y")), 2)


@query("SELECT 'n' || n_nationkey AS node, (2 * n_nationkey + 1)::BIGINT AS amount FROM nation")
def amounts_of_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers from minus to plus a nation's key: the size of a range for each nation."""
    nation = table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("node"), "n_nationkey")
    bound = F.explode(F.array(F.struct(F.lit("minInclusive").alias("facet"), (-F.col("n_nationkey")).cast("string").alias("bound")), F.struct(F.lit("maxInclusive").alias("facet"), F.col("n_nationkey").cast("string").alias("bound"))))
    rows = nation.select("node", bound.alias("b")).select("node", "b.facet", "b.bound")
    name = F.concat_ws(" ", "node", "facet")
    pieces = V.facet_pieces(rows.select(name.alias("node"), "facet", "bound", F.lit(V.full("xsd:integer")).alias("datatype")))
    parts = rows.select("node", F.lit("all").alias("way"), F.lit(0).alias("pos"), name.alias("part")).union(nation.select("node", F.lit("all"), F.lit(1), F.lit(V.full("xsd:integer"))))
    found, _ = ranges.resolved(pieces.union(V.datatype_pieces(spark)), rows.select(name.alias("node")).union(V.datatype_pieces(spark).select("node")), parts)
    return ranges.amounts(found, nation.select("node")).select("node", F.col("amount").cast("long").alias("amount"))


@query("SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_type, p_brand, p_size) AS same FROM part")
def nested_expression_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as the expression type and (brand or size), its members in one order or the other."""
    part = table(spark, sf_dir, "part")
    outer, inner, size = named("p", "p_partkey"), named("u", "p_partkey"), named("size ", "p_size")
    row = lambda node, kind, p: F.struct(node.alias("node"), F.lit(kind).alias("kind"), p.alias("part"))
    rows = part.select(F.explode(F.array(row(outer, "And", F.col("p_type")), row(outer, "And", inner), row(inner, "Or", F.col("p_brand")), row(inner, "Or", size))).alias("r"))
    table_ = rows.select("r.node", "r.kind", F.lit("of").alias("role"), F.lit(None).cast("int").alias("pos"), "r.part")
    keys, _ = structure.expression_keys(table_)
    keys = keys.where("node like 'p%'").select(F.substring("node", 2, 20).cast("long").alias("node"), "key")
    return constraints.with_least(keys, "key", "node", "same").select("node", "same")


@query("SELECT DISTINCT p_type || '|' || p_brand AS sub, p_type AS sup, 3 AS depth FROM part UNION SELECT p_type || '|' || p_brand, p_brand, 3 FROM part UNION SELECT p_type, 'Product', 2 FROM part UNION SELECT p_brand, 'Product', 2 FROM part UNION SELECT 'Product', 'Thing', 1")
def taxonomy_direct_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct parents and depths of the classes of types and brands; what follows is left out again."""
    direct = taxonomy.direct_parents(el_taxonomy(spark, sf_dir))
    return direct.join(taxonomy.depths(direct), F.col("sub") == F.col("c")).select("sub", "sup", "depth")


@query("SELECT conv_id::VARCHAR || '/0' AS root, count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id HAVING min(turn) = 0 AND max(turn) = count(DISTINCT turn) - 1")
def scopes_of_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a document with a blank node "b" and imports the next: nodes of a conversation's union."""
    docs, imports, roots = _turns(spark, sf_dir)
    reached, _ = documents.closure(docs, imports, roots)
    node = docs.select("doc", F.lit("node").alias("s_kind"), F.lit("b").alias("s"), F.lit("http://t/says").alias("p"), F.lit("iri").alias("o_kind"), F.lit("http://t/x").alias("o"))
    whole = imports.groupBy(F.substring_index("doc", "/", 1).alias("c")).agg(F.count_distinct("doc").alias("n"), F.max(F.substring_index("doc", "/", -1).cast("int")).alias("last")).where("last = n - 1").select("c")
    united = documents.union_of_imports(node, reached).groupBy("root").agg(F.count_distinct("s").alias("n"))
    return united.join(whole, F.substring_index("root", "/", 1) == F.col("c"), "left_semi").select("root", "n")


@query("SELECT doc_id FROM documents WHERE length(text) >= 1000 AND length(text) <= 5000")
def facet_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").where(terms.length_facet(text, "minLength", 1000) & terms.length_facet(text, "maxLength", 5000)).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) = 'en' OR lower(lang) LIKE 'en-%'")
def lang_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(terms.in_language_range(F.col("lang"), "EN")).select("doc_id", "lang")


@query("SELECT p_partkey FROM part WHERE (p_size IN (1, 5, 9) OR p_size > 30) AND NOT p_size > 40")
def data_range_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, complement, intersection and enumeration of data ranges."""
    rows = [("u", "any", 0, "few"), ("u", "any", 1, "large"), ("no", "none", 0, "huge"), ("all", "all", 0, "u"), ("all", "all", 1, "no")]
    pieces = _ranges(spark, [("large", "minExclusive", "30", "xsd:integer"), ("huge", "minExclusive", "40", "xsd:integer")], [("few", x, "xsd:integer") for x in ("1", "5", "9")], rows)
    values = table(spark, sf_dir, "part").select("p_partkey", F.lit("size").alias("p"), F.col("p_size").cast("string").alias("lexical"))
    return _held(values, "xsd:integer", [("size", "all")], pieces).select("p_partkey")


@query("SELECT o_orderkey, o_orderkey BETWEEN -128 AND 127 AS is_byte, o_orderkey BETWEEN -32768 AND 32767 AS is_short, o_orderkey BETWEEN 0 AND 65535 AS is_unsigned_short, o_orderkey > 0 AS is_positive FROM orders")
def integer_subtype_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda t: terms.in_integer_type(F.col("o_orderkey"), "xsd:" + t)
    return table(spark, sf_dir, "orders").select("o_orderkey", held("byte").alias("is_byte"), held("short").alias("is_short"), held("unsignedShort").alias("is_unsigned_short"), held("positiveInteger").alias("is_positive"))


@query("""SELECT event_id, 'decimal ' || CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS value_key FROM events""")
def value_identity_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of one number (069.0 and 69) have one key."""
    number = F.regexp_extract("props", '"k": *([0-9]+)', 1)
    spelt = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("+0"), number, F.lit(".0"))).otherwise(number)
    return table(spark, sf_dir, "events").select("event_id", terms.value_key("decimal", spelt).alias("value_key"))


@query(r"""SELECT page_id, regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$', 2) AS scheme, regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$', 4) AS authority,
regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$', 5) AS path, regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$', 7) AS query, regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$', 9) AS fragment FROM pages""")
def iri_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[terms.reference_part(F.col("url"), p).alias(p) for p in terms.PARTS])


@query(r"""SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>"{}|\\^`]*$') AND NOT regexp_matches(url, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') AS valid FROM pages""")
def iri_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", terms.is_iri(F.col("url")).alias("valid"))


@query("SELECT 'd' || doc_id AS iri, 'NamedIndividual' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are declared; the others are used without."""
    kind = F.lit("NamedIndividual").alias("kind")
    uses = table(spark, sf_dir, "documents").select(named("d", "doc_id").alias("iri"), kind)
    return validity.missing_declarations(uses, table(spark, sf_dir, "labels").select(named("d", "doc_id").alias("iri"), kind))


@query("""SELECT 'u' || user_id AS iri, 'Class' AS first, 'Datatype' AS second FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view')""")
def conflicting_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Class").when(F.col("event_type") == "view", "Datatype").otherwise("NamedIndividual")
    return validity.conflicting_declarations(table(spark, sf_dir, "events").select(named("u", "user_id").alias("iri"), kind.alias("kind")))


@query("""SELECT DISTINCT 'o' || l_orderkey AS x FROM (SELECT l_orderkey, count(*) AS c, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_orderkey) WHERE c < 2 OR d < c""")
def arity_repeated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's line numbers as members of one axiom: too few, or one twice."""
    axioms = table(spark, sf_dir, "lineitem").groupBy(named("o", "l_orderkey").alias("axiom")).agg(F.collect_list("l_linenumber").alias("members"))
    return validity.repeated_members(axioms).select(F.col("axiom").alias("x"))


@query("""WITH RECURSIVE h AS (SELECT DISTINCT 'n' || c_nationkey AS a, 'r' || n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'r' || n_regionkey, 'top' FROM nation),
c AS (SELECT DISTINCT 'n' || s_nationkey AS r FROM supplier WHERE s_acctbal < 0), u AS (SELECT r FROM c UNION SELECT h.b FROM u JOIN h ON u.r = h.a) SELECT r FROM u""")
def non_simple_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles named after nations are below those of their regions; some of them are composite."""
    nation = table(spark, sf_dir, "nation")
    used = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    hierarchy = nation.join(used, "n_nationkey").select(named("n", "n_nationkey").alias("a"), named("r", "n_regionkey").alias("b"))
    hierarchy = hierarchy.union(nation.select(named("r", "n_regionkey").alias("a"), F.lit("top").alias("b")).distinct())
    composite = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(named("n", "s_nationkey").alias("r")).distinct()
    return validity.non_simple_roles(composite, hierarchy)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, (n_nationkey % 7 % 5)::INT AS b FROM nation WHERE n_regionkey <> n_nationkey % 7 % 5),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS name FROM c WHERE a = b""")
def cyclic_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("a"), (F.col("n_nationkey") % 7 % 5).cast("int").alias("b")).where("a <> b").distinct()
    return validity.cyclic_definitions(uses)


@query()
def assertion_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of suppliers and parts that deliveries connect."""
    rows = table(spark, sf_dir, "lineitem")
    return components(rows.select(named("s", "l_suppkey").alias("a"), named("p", "l_partkey").alias("b")))


@query("""SELECT 'http://example.org/n' || n_nationkey AS s, 'http://example.org/name' AS p, n_name || chr(10) || '"é\\' AS o, 'en' AS lang FROM nation""")
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are written as N-Triples lines and read again."""
    rows = table(spark, sf_dir, "nation").select(
        F.lit("iri").alias("s_kind"), F.concat(F.lit("http://example.org/"), named("n", "n_nationkey")).alias("s"), F.lit("http://example.org/name").alias("p"),
        F.lit("literal").alias("o_kind"), F.concat(F.col("n_name"), F.lit('\n"é\\')).alias("o"), F.lit(ntriples.TAGGED).alias("datatype"), F.lit("en").alias("lang"),
    )
    return ntriples.parsed(rows.select(ntriples.formatted(rows).alias("line"))).select("s", "p", "o", "lang")


def _number_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, r, y): suppliers and parts, by their keys modulo 50, that deliveries connect."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("x"), F.lit("near").alias("r"), (F.col("l_partkey") % 50).alias("y"))
    return rows.distinct()


@query("SELECT DISTINCT l_suppkey % 50 AS x, 'near' AS r FROM lineitem WHERE l_suppkey % 50 = l_partkey % 50")
def irreflexive_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.loops(_number_edges(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS x, l_partkey AS y FROM lineitem) SELECT a.x, a.y FROM e a JOIN e b ON a.x = b.y AND a.y = b.x")
def asymmetric_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts, by their numbers, that deliveries connect both ways."""
    rows = table(spark, sf_dir, "lineitem")
    return constraints.both_ways(rows.select(F.col("l_suppkey").alias("x"), F.lit("near").alias("r"), F.col("l_partkey").alias("y")).distinct())


@query("""SELECT user_id AS x, floor(value)::BIGINT AS y, 'clicks and views' AS g FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL HAVING count(DISTINCT event_type) > 1""")
def disjoint_property_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose clicks and views, two disjoint properties, have a whole value in common."""
    links = table(spark, sf_dir, "events").select(F.col("user_id").alias("x"), F.col("event_type").alias("r"), F.floor("value").alias("y"))
    return constraints.role_group_clashes(links, spark.createDataFrame([("clicks and views", 0, "click"), ("clicks and views", 1, "view")], "g string, pos int, r string"))


@query("""WITH r AS (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents) SELECT source AS g, rep FROM r GROUP BY ALL HAVING count(*) > 1""")
def all_different_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source are all different, those with one text are equal."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select(F.col("doc_id").alias("x"), F.sha2("text", 256).alias("text"))
    reps = representatives(keyed, constraints.key_same(keyed, ["text"]))
    return constraints.same_and_different(docs.select(F.col("source").alias("g"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("x")), reps)


@query("SELECT min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS a, p_partkey AS b FROM part QUALIFY min(p_partkey) OVER (PARTITION BY p_name, p_brand) <> p_partkey")
def inverse_functional_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with one label (name and brand) are equal, as the label is inverse functional."""
    links = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.lit("label").alias("r"), F.sha2(F.concat_ws("\x00", "p_name", "p_brand"), 256).alias("y"))
    return constraints.inverse_functional_same(links, F.broadcast(spark.createDataFrame([("label",)], "r string")))


@query("""SELECT 'o' || o_orderkey AS x, 's' || (o_orderkey % 10 + 1) AS y FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = o_orderkey % 10 + 1""")
def denied_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is denied one supplier by its number, delivered or not: the denied edges that are asserted."""
    denied = table(spark, sf_dir, "orders").select(named("o", "o_orderkey").alias("x"), F.concat(F.lit("s"), (F.col("o_orderkey") % 10 + 1).cast("string")).alias("y"))
    return constraints.denied_edges(edges(spark, sf_dir, "suppliedBy").select("x", "y"), denied)


@query("""SELECT user_id AS x, 'Action' AS g FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def disjoint_union_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action is the disjoint union of click, purchase and view."""
    types = table(spark, sf_dir, "events").select(F.col("user_id").alias("x"), F.col("event_type").alias("c")).distinct()
    return constraints.group_clashes(types, F.broadcast(spark.createDataFrame([("Action", k, c) for k, c in enumerate(("click", "purchase", "view"))], "g string, pos int, c string")))


@query("SELECT DISTINCT 'o' || l_orderkey AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'ECONOMY')")
def union_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """some contains (Promo or Economy) below Cheap."""
    rules = _rules(spark, told=[("PROMO", "either"), ("ECONOMY", "either")], some=[("contains", "either", "Cheap")])
    sub, _ = saturate(part_types(spark, sf_dir), edges(spark, sf_dir, "contains"), rules)
    return sub.where("c = 'Cheap'").select("x")


@query("SELECT DISTINCT 's' || s_suppkey AS x FROM supplier WHERE s_nationkey = 7")
def has_value_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basedIn value n7 below Local: an existential over the class of one individual."""
    types = spark.createDataFrame([("n7", "one:n7")], "x string, c string")
    sub, _ = saturate(types, edges(spark, sf_dir, "basedIn"), _rules(spark, some=[("basedIn", "one:n7", "Local")]))
    return sub.where("c = 'Local'").select("x")


@query("SELECT DISTINCT 'k' || (l_suppkey % 50) AS x FROM lineitem WHERE l_suppkey % 50 = l_partkey % 50")
def has_self_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near Self below OwnPart."""
    link = _number_edges(spark, sf_dir).select(F.concat(F.lit("k"), F.col("x").cast("string")).alias("x"), "r", F.concat(F.lit("k"), F.col("y").cast("string")).alias("y"))
    sub, _ = saturate(_no_types(spark), link, _rules(spark, self=[("near", "OwnPart")]))
    return sub.where("c = 'OwnPart'").select("x")


@query("SELECT DISTINCT 'p' || l_partkey AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def all_values_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished below all contains Shipped: what orders contain that are finished."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(named("o", "o_orderkey").alias("x"), F.lit("Finished").alias("c"))
    sub, _ = saturate(orders, edges(spark, sf_dir, "contains"), _rules(spark, all=[("Finished", "contains", "Shipped")]))
    return sub.where("c = 'Shipped'").select("x")


@query("""WITH t AS (SELECT DISTINCT p_brand AS c, 'Brand ' || regexp_extract(p_brand, '[0-9]+$') AS d FROM part) SELECT c AS a, d AS b FROM t UNION SELECT d, c FROM t""")
def equivalent_classes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of a brand are equivalent: pairs that subsume each other."""
    told = table(spark, sf_dir, "part").select(F.col("p_brand").alias("c"), F.concat(F.lit("Brand "), F.regexp_extract("p_brand", "[0-9]+$", 0)).alias("d")).distinct()
    both = told.union(told.select("d", "c"))
    sub, _ = saturate(both.select(F.col("c").alias("x"), "c"), edges(spark, sf_dir, "inRegion").limit(0), {"told": both})
    back = sub.select(F.col("x").alias("c"), F.col("c").alias("x"))
    return sub.where("x <> c").join(back, ["x", "c"], "left_semi").select(F.col("x").alias("a"), F.col("c").alias("b"))


@query("SELECT p_partkey AS sub, p_partkey >> k AS sup FROM part, range(1, 40) u(k) WHERE p_partkey >> k > 0")
def el_taxonomy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification of the parts' classes, each below the one of half its number."""
    keys = table(spark, sf_dir, "part").select("p_partkey")
    told = keys.where("p_partkey > 1").select(F.col("p_partkey").cast("string").alias("c"), F.floor(F.col("p_partkey") / 2).cast("string").alias("d"))
    own = keys.select(context(F.col("p_partkey").cast("string")).alias("x"), F.col("p_partkey").cast("string").alias("c"))
    sub, _ = saturate(own, edges(spark, sf_dir, "inRegion").limit(0), {"told": told})
    rows = sub.select(F.substring("x", 2, 40).alias("sub"), F.col("c").alias("sup")).where("sub <> sup")
    return rows.select(F.col("sub").cast("long").alias("sub"), F.col("sup").cast("long").alias("sup"))


@query("SELECT c_custkey AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def one_of_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two segments that an enumeration, the buyers of large orders, names."""
    customers = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("x"))
    return constraints.one_of(customers, table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("x")))


@query("SELECT p_partkey AS x FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)")
def complement_closed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are not known to be sold at a discount of more than five percent."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"))
    return constraints.complement(parts, table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_partkey").alias("x")))


@query("SELECT l_orderkey AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING max(p_size) <= 40")
def universal_closed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that contain nothing but parts of size 40 or less."""
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y")).distinct()
    fits = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("x"))
    return constraints.only(held, fits, held.select("x"))


_BANDS = [("click", None, 10.0, "Low"), ("click", 40.0, 60.0, "Middle"), ("purchase", 90.0, None, "High"), ("view", 40.0, 60.0, "Middle")]


@query("""WITH b(p, low, high, e) AS (VALUES ('click', NULL, 10.0, 'Low'), ('click', 40.0, 60.0, 'Middle'), ('purchase', 90.0, NULL, 'High'), ('view', 40.0, 60.0, 'Middle'))
SELECT DISTINCT user_id AS x, e FROM events JOIN b ON event_type = p AND (low IS NULL OR value >= low) AND (high IS NULL OR value <= high)""")
def data_some_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existential restrictions over ranges of values: a join by property and by comparison."""
    values = table(spark, sf_dir, "events").select(F.col("user_id").alias("x"), F.col("event_type").alias("p"), F.col("value").alias("number"))
    return constraints.some_value(values, spark.createDataFrame(_BANDS, "p string, low double, high double, e string"))


@query("SELECT p_partkey AS x FROM part WHERE p_size = 5")
def data_has_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """size value "05.0": the literal stands for the number 5."""
    pieces = _ranges(spark, [], [("five", "05.0", "xsd:decimal")])
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.lit("size").alias("p"), F.col("p_size").cast("string").alias("lexical"))
    return _held(values, "xsd:integer", [("size", "five")], pieces).select("x")


@query("SELECT p_name AS x, count(DISTINCT p_size) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_size) >= 3")
def data_min_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with three sizes or more; values of data are told apart by their keys."""
    values = table(spark, sf_dir, "part").select(F.col("p_name").alias("x"), terms.value_key("decimal", F.col("p_size").cast("string")).alias("y"))
    return constraints.at_least(values, 3)


@query("""SELECT DISTINCT user_id AS x, event_type AS p, CASE WHEN event_type = 'error' THEN 'string ' ELSE 'decimal ' END || CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS value_key FROM events WHERE event_type = 'error'""")
def data_range_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all events are to be numbers; those of errors are strings."""
    kind = F.when(F.col("event_type") == "error", "string").otherwise("decimal")
    text = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long").cast("string")
    values = table(spark, sf_dir, "events").select(F.col("user_id").alias("x"), F.col("event_type").alias("p"), kind.alias("kind"), F.concat(kind, F.lit(" "), text).alias("value_key"))
    return constraints.outside_kind(values, values.select("p").distinct().select("p", F.lit("decimal").alias("kind")))


@query("""SELECT min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS a, p_partkey AS b FROM part WHERE p_type = 'PROMO' QUALIFY min(p_partkey) OVER (PARTITION BY p_brand, p_size) <> p_partkey""")
def has_key_two_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HasKey(Promo () (brand size)): one row for each property, values in one table."""
    part = table(spark, sf_dir, "part")
    types = part.select(F.col("p_partkey").alias("x"), F.col("p_type").alias("c"))
    values = part.select(F.col("p_partkey").alias("x"), F.posexplode(F.array(F.col("p_brand"), F.col("p_size").cast("string"))).alias("i", "value_key"))
    values = values.select("x", F.when(F.col("i") == 0, "brand").otherwise("size").alias("p"), "value_key")
    keys = spark.createDataFrame([("k", "PROMO", 2, 0, "brand"), ("k", "PROMO", 2, 1, "size")], "k string, c string, n int, pos int, p string")
    return constraints.keys_same(types, values, keys)


_TURNS = """WITH RECURSIVE e AS (SELECT conv_id || '/' || turn AS doc, conv_id || '/' || (turn + 1) AS next FROM conversations), s AS (
SELECT e.doc, e.next FROM e WHERE e.next IN (SELECT doc FROM e)),"""


@query(_TURNS + " r AS (SELECT doc AS root, doc FROM e WHERE doc LIKE '%/0' UNION SELECT r.root, s.next FROM r JOIN s ON r.doc = s.doc) SELECT root, doc FROM r")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation imports the next one: what first turns reach."""
    return documents.closure(*_turns(spark, sf_dir))[0]


@query(_TURNS + " r AS (SELECT doc AS root, doc FROM e WHERE doc LIKE '%/0' UNION SELECT r.root, s.next FROM r JOIN s ON r.doc = s.doc) SELECT DISTINCT e.doc, 'http://t/' || e.next AS iri, 'missing' AS fault FROM e JOIN r ON e.doc = r.doc WHERE e.next NOT IN (SELECT doc FROM e)")
def import_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last turns import a turn that is missing."""
    return documents.closure(*_turns(spark, sf_dir))[1]


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations")
    doc = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    after = F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"))
    docs = rows.select(doc.alias("doc"), F.concat(F.lit("http://t/"), doc).alias("ontology_iri"), F.lit(None).cast("string").alias("version_iri")).distinct()
    return docs, rows.select(doc.alias("doc"), F.concat(F.lit("http://t/"), after).alias("iri")), rows.where("turn = 0").select(doc.alias("doc"))


@query("SELECT doc_id AS s, text AS o FROM documents WHERE source = 'src1'")
def named_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a dataset with a graph for each source: one named graph."""
    quads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s"), F.col("text").alias("o"), F.col("source").alias("g"))
    return documents.selected_graph(quads, "src1")


@query("SELECT lang AS g, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 1")
def repeated_graph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.repeated_graphs(table(spark, sf_dir, "documents").select(F.col("lang").alias("g")))


@query("""SELECT min(l_linenumber::BIGINT * 1000000000 + l_orderkey) AS pos FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'SubClassOf' ELSE 'DisjointClasses' END AS kind, l_suppkey % 7 AS a, l_partkey % 7 AS b FROM lineitem)
GROUP BY kind, CASE WHEN kind = 'SubClassOf' THEN a ELSE least(a, b) END, CASE WHEN kind = 'SubClassOf' THEN b ELSE greatest(a, b) END""")
def axiom_set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries as axioms about two classes: the first of each set of structurally equal ones."""
    kind = F.when(F.col("l_linenumber") == 1, "SubClassOf").otherwise("DisjointClasses")
    members = F.array((F.col("l_suppkey") % 7).cast("string"), (F.col("l_partkey") % 7).cast("string"))
    axioms = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_orderkey")).alias("pos"), kind.alias("kind"), members.alias("members"))
    return structure.distinct_axioms(axioms.dropDuplicates(["pos", "kind", "members"])).select("pos")


@query("""SELECT c_custkey AS pos FROM customer WHERE (least(c_nationkey, c_custkey % 25), greatest(c_nationkey, c_custkey % 25)) NOT IN (SELECT (least(s_nationkey, s_suppkey % 25), greatest(s_nationkey, s_suppkey % 25)) FROM supplier)""")
def axiom_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjointness axioms from customers that none from suppliers equals."""
    axioms = lambda name, key, nation: table(spark, sf_dir, name).select(F.col(key).alias("pos"), F.lit("DisjointClasses").alias("kind"), F.array(F.col(nation).cast("string"), (F.col(key) % 25).cast("string")).alias("members"))
    return structure.difference(axioms("customer", "c_custkey", "c_nationkey"), axioms("supplier", "s_suppkey", "s_nationkey")).select("pos")


@query("SELECT min('c' || c_custkey) AS component, count(*) + 1 AS size, min(c_acctbal) >= -900 AS consistent FROM customer GROUP BY c_nationkey")
def consistency_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation are one part; a large debt is a clash."""
    customers = table(spark, sf_dir, "customer")
    links = customers.select(named("c", "c_custkey").alias("a"), named("n", "c_nationkey").alias("b"))
    return constraints.by_parts(links.select(F.col("a").alias("x")), links, customers.where("c_acctbal < -900").select(named("c", "c_custkey").alias("x")))


@query("SELECT DISTINCT 'c' || o_custkey AS x, NULL::VARCHAR AS r, 'Buyer' AS y FROM orders UNION ALL SELECT DISTINCT 'o' || o_orderkey, 'placedBy', 'c' || o_custkey FROM orders")
def fixpoint_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules still give from asserted edges alone."""
    rules = _rules(spark, domain=[("placed", "Buyer")], inverse=[("placed", "placedBy")])
    return not_closed(_no_types(spark), edges(spark, sf_dir, "placed"), rules)


@query("""SELECT DISTINCT 'c' || o_custkey AS who, 'p' || l_partkey AS what FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey WHERE p_type = 'PROMO' AND c_nationkey = 3""")
def conjunctive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed(who, order), contains(order, what), Promo(what), inNation(who, n3)."""
    placed, held, nation = (edges(spark, sf_dir, r) for r in ("placed", "contains", "inNation"))
    who = nation.where("y = 'n3'").select(F.col("x").alias("who"))
    rows = placed.select(F.col("x").alias("who"), F.col("y").alias("order")).join(who, "who", "left_semi")
    rows = rows.join(held.select(F.col("x").alias("order"), F.col("y").alias("what")), "order")
    return rows.join(part_types(spark, sf_dir).where("c = 'PROMO'").select(F.col("x").alias("what")), "what", "left_semi").select("who", "what").distinct()


@query("SELECT 'c' || conv_id AS head, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, text AS member FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)")
def rdf_list_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as RDF lists of their turns, walked by doubling."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("pos", F.row_number().over(by) - 1).withColumn("last", F.lead("turn").over(by).isNull())
    cell = lambda k: F.when(F.col("pos") + k == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).otherwise(F.concat_ws("/", "conv_id", (F.col("pos") + k).cast("string")))
    first = rows.select(cell(0).alias("s"), F.lit(RDF + "first").alias("p"), F.col("text").alias("o"))
    rest = rows.select(cell(0), F.lit(RDF + "rest"), F.when(F.col("last"), RDF + "nil").otherwise(cell(1)))
    return list_members(first.union(rest), rows.where("pos = 0").select(cell(0).alias("head")))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?q=1' AS query, regexp_extract(url, '^[^:]+:', 0) || '//other/x' AS network, regexp_replace(url, '#.*$', '') || '#top' AS fragment, regexp_extract(url, '^[^:]+://[^/?#]*', 0) || '/b/d' AS path FROM pages")
def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    at = lambda ref: terms.resolved(F.lit(ref), url)
    return table(spark, sf_dir, "pages").select("page_id", at("?q=1").alias("query"), at("//other/x").alias("network"), at("#top").alias("fragment"), at("/a/../b/./c/../d").alias("path"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'http://e/part#' || p_partkey WHEN p_size % 3 = 1 THEN 'http://www.w3.org/2002/07/owl#' || p_partkey END AS iri FROM part")
def prefix_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a declared, a standard and an unknown prefix; a standard one keeps its namespace."""
    prefix = F.when(F.col("p_size") % 3 == 0, "e").when(F.col("p_size") % 3 == 1, "owl").otherwise("unknown")
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", prefix, F.col("p_partkey").cast("string")).alias("name"))
    return terms.expanded(names, spark.createDataFrame([("e", "http://e/part#"), ("owl", "http://wrong/")], "prefix string, space string")).select("p_partkey", "iri")


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z_0-9]([A-Za-z_0-9.-]*[A-Za-z_0-9-])?$') AS local_name, true AS node_id, regexp_matches(p_brand, '^Brand#[0-9]{1,2}$') AS pattern, length(p_name) AS octets FROM part")
def names_and_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their grammar, an xsd:pattern, and octets of a hexBinary value."""
    name = F.col("p_name")
    node = terms.is_node_id(F.concat(F.lit("_:b"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", terms.is_local_name(name).alias("local_name"), node.alias("node_id"), terms.matches_pattern(F.col("p_brand"), "Brand#[0-9]{1,2}").alias("pattern"), terms.octets("hexBinary", F.hex(name)).cast("long").alias("octets"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) - 19800000000 AS at, o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AS same_line, epoch_us(o_orderdate) > epoch_us(TIMESTAMP '1995-06-01 00:00:00') + 50400000000 AS other_line FROM orders")
def moment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dateTime literals with an offset, and order across zoned and local time (14 hours apart)."""
    local = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zoned, bound = F.concat(local, F.lit("+05:30")), F.lit("1995-06-01T00:00:00")
    return table(spark, sf_dir, "orders").select("o_orderkey", terms.moment(zoned)["at"].alias("at"), terms.moment_facet(local, "minInclusive", bound).alias("same_line"), terms.moment_facet(F.concat(local, F.lit("Z")), "minInclusive", bound).alias("other_line"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(floor(l_extendedprice) - ceil(l_quantity) + 1, 0)::BIGINT AS n FROM lineitem")
def integers_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers from the quantity to the price of a delivery."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", terms.integers_between(F.col("l_quantity"), F.col("l_extendedprice")).alias("n"))


@query("SELECT doc_id, true AS tag, lang = 'en' AS regional FROM documents")
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed tags: languages with a region, and German with a subtag of nine letters."""
    lang = F.col("lang")
    odd = F.when(lang == "en", F.concat(lang, F.lit("-Latn-GB-x-a1"))).otherwise(F.concat(lang, F.lit("-ninechars")))
    return table(spark, sf_dir, "documents").select("doc_id", terms.is_language_tag(lang).alias("tag"), terms.is_language_tag(odd).alias("regional"))


@query("""SELECT o_orderkey, 'double ' || CASE WHEN o_orderkey % 2 = 0 THEN '1000.0' ELSE 'Infinity' END AS number, 'boolean ' || (o_orderkey % 2 = 0) AS truth,
CASE WHEN o_orderkey % 3 = 0 THEN 'decimal ' || (o_orderkey // 3) ELSE 'ratio ' || o_orderkey || '/3' END AS ratio FROM orders""")
def literal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of doubles, booleans and rationals, by their datatypes and in several spellings."""
    even, none = F.col("o_orderkey") % 2 == 0, F.lit(None).cast("string")
    key = lambda name, text: terms.literal_key(F.lit(terms.PREFIXES[name.split(":")[0]] + name.split(":")[1]), text, none)
    ratio = F.concat((F.col("o_orderkey") * 2).cast("string"), F.lit("/6"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key("xsd:double", F.when(even, "1E3").otherwise("INF")).alias("number"), key("xsd:boolean", F.when(even, "1").otherwise("false")).alias("truth"), key("owl:rational", ratio).alias("ratio"))


@query("SELECT 7 AS check_no, 'missing declaration' AS check_name, min('http://e/lang/' || lang) AS evidence FROM documents WHERE lang <> 'en'")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents typed by their language; only one class is declared. The first verdict of all 21 checks."""
    docs = table(spark, sf_dir, "documents")
    iri = lambda kind, c: F.concat(F.lit(f"http://e/{kind}/"), F.col(c).cast("string"))
    typed = docs.select(iri("doc", "doc_id").alias("s"), F.lit(RDF + "type").alias("p"), iri("lang", "lang").alias("o"), F.lit("iri").alias("o_kind"))
    declared = spark.createDataFrame([("http://e/lang/en", RDF + "type", "http://www.w3.org/2002/07/owl#Class", "iri")], typed.schema)
    return validity_plan.first_violation(validity_plan.violations(mapped(typed.union(declared))))


@query("""SELECT 'http://e/c' || c_custkey AS s, 'http://e/n' || c_nationkey AS o, c_custkey % 2 = 0 AS stated, 'http://e/' || note AS note, c_mktsegment AS value FROM customer, (VALUES ('segment'), ('remark')) t(note)""")
def annotated_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as reified axioms, every second one stated as well, annotated with the segment, which is a remark."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("http://e/"), named("c", "c_custkey")).alias("c"), F.concat(F.lit("http://e/"), named("n", "c_nationkey")).alias("n"), "c_mktsegment", "c_custkey")
    triple = lambda s, p, o, kind="iri": F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    node, role, owl = F.col("node"), "http://e/inNation", terms.PREFIXES["owl"]
    made = [triple(node, RDF + "type", F.lit(owl + "Axiom")), triple(node, owl + "annotatedSource", F.col("c")), triple(node, owl + "annotatedProperty", F.lit(role)), triple(node, owl + "annotatedTarget", F.col("n")), triple(node, "http://e/segment", F.col("c_mktsegment"), "literal")]
    facts = rows.select(F.explode(F.array(*made)).alias("t")).select("t.*").union(rows.where("c_custkey % 2 = 0").select(triple(F.col("c"), role, F.col("n")).alias("t")).select("t.*"))
    declared = [(f"http://e/{x}", RDF + "type", owl + "AnnotationProperty", "iri") for x in ("segment", "remark")] + [("http://e/segment", terms.PREFIXES["rdfs"] + "subPropertyOf", "http://e/remark", "iri")]
    found = annotations.of_axioms(facts.union(spark.createDataFrame(declared, "s string, p string, o string, o_kind string")))
    return found.select("s", "o", "stated", "note", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
