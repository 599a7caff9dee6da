"""Values of literals as places on lines, and data ranges as sets of stretches of these lines.

Every value lies on one line, at a key whose text order is the order of the values. So
numbers of any number of digits are compared exactly, and all of a range (bounds, lengths,
languages, enumerations, subtypes) is stretches from one cut to another:

===============  ====================================================================
integer          integers
finite           other numbers with a finite decimal expansion
ratio            other rationals
double, float    floating point; ``double nan`` and ``float nan`` hold one value each
moment z, l      dateTime values with an offset, and without
boolean          false, true
string 0 .. 6    strings by the narrowest of the string datatypes that they are in, then
                 by length
text             strings with a language, by language
uri, xml         by length
hexBinary, base64Binary   by octets
===============  ====================================================================

A cut lies before (``key 0``) or after (``key 2``) a value (``key 1``), or at an end of the
line. On the integer line all cuts lie before an integer, so equal sets have equal stretches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import terms
from quillon.functions.terms import INTEGERS, PREFIXES
from quillon.operators.components import checkpoint

#: The string datatypes; each one's values are among those of the one before.
STRINGS = ["xsd:string", "xsd:normalizedString", "xsd:token", "xsd:NMTOKEN", "xsd:Name", "xsd:NCName", "xsd:language"]
NUMBERS, MOMENTS = ["integer", "finite", "ratio"], ["moment z", "moment l"]
TEXTS = [f"string {k}" for k in range(len(STRINGS))]
LINES = [*NUMBERS, "double", "double nan", "float", "float nan", *MOMENTS, "boolean", *TEXTS, "text", "uri", "xml", "hexBinary", "base64Binary"]
#: Lines whose keys begin with a length.
MEASURED = [*TEXTS, "uri", "hexBinary", "base64Binary"]
LOW, HIGH = "", "~~"
ORDER = terms.ORDER_FACETS
LENGTHS = ("length", "minLength", "maxLength")
FACETS = (*ORDER, *LENGTHS, "langRange")
#: The lines of the datatypes that are whole lines.
WHOLE = {
    "owl:rational": NUMBERS, "owl:real": NUMBERS, "xsd:decimal": ["integer", "finite"], "xsd:integer": ["integer"], "xsd:double": ["double", "double nan"], "xsd:float": ["float", "float nan"],
    "xsd:dateTime": MOMENTS, "xsd:dateTimeStamp": ["moment z"], "xsd:boolean": ["boolean"], "rdf:PlainLiteral": [*TEXTS, "text"], "rdf:langString": ["text"], "xsd:anyURI": ["uri"],
    "rdf:XMLLiteral": ["xml"], "xsd:hexBinary": ["hexBinary"], "xsd:base64Binary": ["base64Binary"], "rdfs:Literal": LINES,
} | {name: TEXTS[k:] for k, name in enumerate(STRINGS)}
_NUMBER = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?$"
_LEVELS = [
    r"[\t\n\r]", r"(?:^ | $|  )",  # not in normalizedString, token
    rf"^[{terms._MORE}.:]+$", rf"^[{terms._START}_:][{terms._MORE}.:]*$", rf"^[{terms._START}_][{terms._MORE}.]*$", r"^[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*$",
]


def full(name: str) -> str:
    space, local = name.split(":")
    return PREFIXES[space] + local


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def order_key(text: Column) -> Column:
    """Text in the order of the numbers that decimals, with or without an exponent, stand for; equal for equal
    numbers. Null for other texts."""
    group = lambda k: F.regexp_extract(text, _NUMBER, k)
    parts = F.struct(group(2).alias("whole"), group(3).alias("part"), F.coalesce(F.nullif(group(4), F.lit("")).try_cast("int"), F.lit(0)).alias("power"), text.startswith("-").alias("minus"))
    return F.when(text.rlike(_NUMBER), let(parts, lambda x: let(F.ltrim(F.concat(x["whole"], x["part"]), F.lit("0")), lambda led: _key(x, led))))


def _key(x: Column, led: Column) -> Column:
    digits, size = F.rtrim(led, F.lit("0")), F.length(led) - F.length(x["part"]) + x["power"]
    above = F.concat(F.lit("p"), F.lpad((size + 500_000_000).cast("string"), 9, "0"), digits)
    below = F.concat(F.lit("n"), F.lpad((499_999_999 - size).cast("string"), 9, "0"), F.translate(digits, "0123456789", "9876543210"), F.lit("~"))
    return F.when(F.length(x["whole"]) + F.length(x["part"]) == 0, F.lit(None)).when(digits == "", "o").when(x["minus"], below).otherwise(above)


def integer_of(key: Column) -> Column:
    """The number of a key without its decimal places, rounded towards zero; null over 38 digits."""
    exponent = F.substring(key, 2, 9).cast("int")
    digits = F.rtrim(F.substring(key, 11, 1 << 30), F.lit("~"))
    parts = F.struct(
        key.startswith("n").alias("minus"), F.when(key.startswith("n"), F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"),
        F.greatest(F.when(key.startswith("n"), 499_999_999 - exponent).otherwise(exponent - 500_000_000), F.lit(0)).alias("places"),
    )
    zero = F.lit(0).cast("decimal(38,0)")
    number = lambda x: F.when(x["places"] == 0, zero).when(x["places"] <= 38, F.rpad(F.left(x["digits"], x["places"]), x["places"], "0").try_cast("decimal(38,0)"))
    signed = lambda x: let(number(x), lambda n: F.when(x["minus"], -n).otherwise(n))
    return F.when(key.startswith("o"), zero).otherwise(let(parts, signed))


def _expanded(text: Column) -> Column:
    """(number, endless) of a fraction of up to 19 digits each: 72 decimal places, and whether more follow."""
    sign, over, under = (F.regexp_extract(text, r"^([+-]?)([0-9]{1,19})/0*([1-9][0-9]{0,18})$", k) for k in (1, 2, 3))
    parts = F.struct(sign.alias("sign"), over.try_cast("decimal(19,0)").alias("n"), under.try_cast("decimal(19,0)").alias("q"))
    return let(parts, lambda x: let(_divided_far(x), lambda y: F.struct(F.concat(F.when(x["sign"] == "-", "-").otherwise(""), y["number"], F.when(y["rest"] > 0, "5").otherwise("")).alias("number"), (y["rest"] > 0).alias("endless"))))


def _divided_far(x: Column) -> Column:
    step = lambda s, _: let((s["rest"] * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)"), lambda n: _divided(n, x["q"], s["number"]))
    start = F.struct(F.concat(((x["n"] - x["n"] % x["q"]) / x["q"]).cast("decimal(19,0)").cast("string"), F.lit(".")).alias("number"), (x["n"] % x["q"]).cast("decimal(19,0)").alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step)


def _divided(n: Column, q: Column, text: Column) -> Column:
    digits = F.lpad(((n - n % q) / q).cast("decimal(19,0)").cast("string"), 18, "0")
    return F.struct(F.concat(text, digits).alias("number"), (n % q).cast("decimal(19,0)").alias("rest"))


def _at(line: Column | str, key: Column) -> Column:
    made = lambda k: F.when(k.isNotNull(), F.struct((F.lit(line) if isinstance(line, str) else line).alias("line"), k.alias("key")))
    return let(key, made)


def number_place(text: Column) -> Column:
    """(line, key) of a decimal or a fraction."""
    plain = F.struct(F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text).alias("number"), F.lit(False).alias("endless"))
    return let(F.when(text.contains("/"), _expanded(text)).otherwise(plain), lambda x: let(order_key(x["number"]), lambda key: _number_at(key, x["endless"])))


def _number_at(key: Column, endless: Column) -> Column:
    # digits beyond the point are left if there are more of them than the number has places before it
    exponent = F.substring(key, 2, 9).cast("int")
    whole = F.when(key.startswith("n"), F.length(key) - 11 <= 499_999_999 - exponent).otherwise(F.length(key) - 10 <= exponent - 500_000_000)
    line = F.when(F.coalesce(endless, F.lit(False)), "ratio").when((key == "o") | whole, "integer").otherwise("finite")
    return F.when(key.isNotNull(), F.struct(line.alias("line"), key.alias("key")))


def _float_place(kind: str, text: Column) -> Column:
    fine = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    key = lambda shown: F.when(shown.isin("-Infinity", "-INF"), "m").when(shown.isin("Infinity", "INF", "+INF"), "q").when(shown == "-0.0", "o0").when(shown == "0.0", "o1").otherwise(order_key(shown))
    shown = F.when(fine, text.try_cast(kind).cast("string")).when(text.isin("INF", "+INF", "-INF"), text)
    return F.when(text == "NaN", _at(f"{kind} nan", F.lit("nan"))).otherwise(_at(kind, let(shown, key)))


def _measured(n: Column, text: Column) -> Column:
    return F.concat(F.lpad(n.cast("string"), 10, "0"), F.lit(" "), text)


def string_level(text: Column) -> Column:
    """Number of the narrowest of STRINGS that has the text."""
    found = F.lit(0)
    held = [~text.rlike(_LEVELS[0]), ~text.rlike(_LEVELS[1]), *[text.rlike(p) for p in _LEVELS[2:]]]
    for level in range(len(held), 0, -1):
        reached = held[level - 1]
        for lower in held[: level - 1] if level <= 2 else ():
            reached = reached & lower
        found = F.when(reached, level) if level == len(held) else found.when(reached, level)
    return found.otherwise(0)


def place(datatype: Column, lexical: Column, lang: Column) -> Column:
    """(line, key) of a literal; null outside the lexical space of its datatype's kind, or for unknown datatypes."""
    given = F.struct(terms.datatype_kind(datatype).alias("kind"), lexical.alias("raw"), F.lower(F.coalesce(lang, F.lit(""))).alias("tag"))

    def by_kind(x: Column) -> Column:
        found = F.when(x["kind"].isNull(), F.lit(None))
        for kind in terms.DATATYPES:
            found = found.when(x["kind"] == kind, _placed(kind, x["raw"], x["tag"]))
        return found

    return let(given, by_kind)


def place_of(datatype: str, lexical: Column) -> Column:
    """(line, key) of literals that all have one standard datatype."""
    kind = next(k for k, names in terms.DATATYPES.items() if datatype in names)
    return let(lexical, lambda raw: _placed(kind, raw, F.lit("")))


def _placed(kind: str, raw: Column, tag: Column) -> Column:
    text = F.trim(raw)
    if kind == "decimal":
        return number_place(text)
    if kind in ("double", "float"):
        return _float_place(kind, text)
    if kind == "boolean":
        return _at("boolean", F.when(text.isin("true", "1"), "true").when(text.isin("false", "0"), "false"))
    if kind == "moment":
        return let(terms.moment(text), lambda at: _at(F.when(at["zoned"], "moment z").otherwise("moment l"), order_key(at["at"].cast("string"))))
    if kind == "hexBinary":
        return _at("hexBinary", F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), _measured((F.length(text) / 2).cast("int"), F.upper(text))))
    if kind == "base64Binary":
        return let(F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("base64")), lambda b: _at("base64Binary", _measured(F.octet_length(b), F.hex(b))))
    length = _measured(F.char_length(raw), raw)
    plain = _at(F.concat(F.lit("string "), string_level(raw).cast("string")), length)
    if kind == "text":
        return F.when(tag == "", plain).otherwise(_at("text", F.concat(tag, F.lit("\x01"), raw)))
    return plain if kind == "string" else _at(kind, length)


@cache
def datatype_pieces(spark: SparkSession) -> DataFrame:
    """(node, line, low, high) of the standard datatypes: a fixed table of some hundred rows, made once in a session."""
    whole = [(full(name), line, None, None) for name, lines in WHOLE.items() for line in lines]
    bounded = [(full(name), "integer", least, None if most is None else most + 1) for name, (least, most) in INTEGERS.items()]
    rows = spark.createDataFrame([(n, line, None if a is None else str(a), None if z is None else str(z)) for n, line, a, z in whole + bounded], "node string, line string, a string, z string")
    cut = lambda c, end: F.coalesce(F.concat(order_key(F.col(c)), F.lit(" 0")), F.lit(end))
    return checkpoint(rows.select("node", "line", cut("a", LOW).alias("low"), cut("z", HIGH).alias("high")))


def _before_integer(n: Column) -> Column:
    return F.concat(order_key(n.cast("decimal(38,0)").cast("string")), F.lit(" 0"))


def point_pieces(points: DataFrame) -> DataFrame:
    """(node, line, low, high) of single values (node, line, key)."""
    whole, key = F.col("line") == "integer", F.col("key")
    after = F.when(whole, _before_integer(integer_of(key) + 1)).otherwise(F.concat(key, F.lit(" 2")))
    return points.select("node", "line", F.concat(key, F.lit(" 0")).alias("low"), after.alias("high")).distinct()


def facet_pieces(facets: DataFrame) -> DataFrame:
    """(node, line, low, high) of facets (node, facet, bound, datatype): what each alone allows.

    A bound on numbers holds on all their lines; one on a moment holds on the other line beyond 14
    hours. NaN as a bound allows nothing.
    """
    rows = facets.where(F.col("facet").isin(*ORDER)).withColumn("at", place(F.col("datatype"), F.col("bound"), F.lit(None).cast("string"))).where("at is not null")
    rows = checkpoint(rows.select("node", "facet", "at.line", "at.key"))
    line, key, facet = F.col("line"), F.col("key"), F.col("facet")
    number, moment = line.isin(NUMBERS), line.isin(MOMENTS)
    lines = F.when(number, F.array(*map(F.lit, NUMBERS))).when(moment, F.array(*map(F.lit, MOMENTS))).when(~line.endswith("nan"), F.array(line))
    rows = rows.withColumn("to", F.explode(lines))
    least = facet.startswith("min")
    after = facet.isin("minExclusive", "maxInclusive")
    to, other = F.col("to"), F.col("to") != line
    # both zeros of floating point are equal to a bound
    zero = F.when(key.isin("o0", "o1") & line.isin("double", "float"), F.when(after, "o1 2").otherwise("o0 0"))
    floor = integer_of(key) - F.when((line != "integer") & key.startswith("n"), 1).otherwise(0)
    whole = _before_integer(F.when((line == "integer") & ~after, floor).otherwise(floor + 1))
    apart = (integer_of(key) + F.when(least, 1).otherwise(-1) * F.lit(14 * 3600 * 1_000_000)).cast("decimal(38,0)").cast("string")
    beyond = F.concat(order_key(apart), F.when(least, " 2").otherwise(" 0"))
    cut = F.coalesce(zero, F.when(number & (to == "integer"), whole).when(moment & other, beyond).otherwise(F.concat(key, F.when(after, " 2").otherwise(" 0"))))
    ordered = rows.select("node", to.alias("line"), F.when(least, cut).otherwise(LOW).alias("low"), F.when(least, F.lit(HIGH)).otherwise(cut).alias("high"))

    n = F.trim("bound").try_cast("int")
    rows = facets.where(F.col("facet").isin(*LENGTHS) & (n >= 0)).select("node", "facet", n.alias("n"), F.explode(F.array(*map(F.lit, MEASURED))).alias("line"))
    size = lambda k: F.lpad((F.col("n") + k).cast("string"), 10, "0")
    low, high = F.when(F.col("facet") == "maxLength", LOW).otherwise(size(0)), F.when(F.col("facet") == "minLength", HIGH).otherwise(size(1))
    measured = rows.select("node", "line", low.alias("low"), high.alias("high"))

    tag = F.lower(F.col("bound"))
    spans = F.when(tag == "*", F.array(F.struct(F.lit(LOW).alias("low"), F.lit(HIGH).alias("high")))).otherwise(
        F.array(F.struct(F.concat(tag, F.lit("\x01")).alias("low"), F.concat(tag, F.lit("\x02")).alias("high")), F.struct(F.concat(tag, F.lit("-")).alias("low"), F.concat(tag, F.lit(".")).alias("high")))
    )
    tagged = facets.where(F.col("facet") == "langRange").select("node", F.lit("text").alias("line"), F.explode(spans).alias("x")).select("node", "line", "x.low", "x.high")
    return ordered.union(measured).union(tagged).where("low < high")


def amount(line: Column, low: Column, high: Column) -> Column:
    """How many values a stretch has; null if there is no end to them, or more than are counted."""
    key = lambda c: F.substring(c, 1, F.length(c) - 2)
    integers = F.when((low != LOW) & (high != HIGH), integer_of(key(high)) - integer_of(key(low)))
    point = low.endswith(" 0") & high.endswith(" 2") & (key(low) == key(high))
    truth = F.when((low < "false 1") & (high > "false 1"), 1).otherwise(0) + F.when((low < "true 1") & (high > "true 1"), 1).otherwise(0)
    return F.when(line == "integer", integers).when(line == "boolean", truth).when(line.endswith(" nan") | point, 1).cast("decimal(38,0)")
