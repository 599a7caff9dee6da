"""IRIs, language tags, literals and facets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value, RFC 3986, appendix B: scheme, authority, path, query and fragment of a reference.
REFERENCE = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARTS = ("scheme", "authority", "path", "query", "fragment")
#: Least and greatest value of the integer datatypes (null: none).
INTEGERS = {
    "xsd:byte": (-128, 127),
    "xsd:int": (-2147483648, 2147483647),
    "xsd:long": (-9223372036854775808, 9223372036854775807),
    "xsd:negativeInteger": (None, -1),
    "xsd:nonNegativeInteger": (0, None),
    "xsd:nonPositiveInteger": (None, 0),
    "xsd:positiveInteger": (1, None),
    "xsd:short": (-32768, 32767),
    "xsd:unsignedByte": (0, 255),
    "xsd:unsignedInt": (0, 4294967295),
    "xsd:unsignedLong": (0, 18446744073709551615),
    "xsd:unsignedShort": (0, 65535),
}


#: Kinds of values, and the datatypes whose values are of the kind.
DATATYPES = {
    "base64Binary": ["xsd:base64Binary"],
    "boolean": ["xsd:boolean"],
    "decimal": [*INTEGERS, "owl:rational", "owl:real", "xsd:decimal", "xsd:integer"],
    "double": ["xsd:double"],
    "float": ["xsd:float"],
    "hexBinary": ["xsd:hexBinary"],
    "moment": ["xsd:dateTime", "xsd:dateTimeStamp"],
    "string": ["xsd:NCName", "xsd:NMTOKEN", "xsd:Name", "xsd:language", "xsd:normalizedString", "xsd:string", "xsd:token"],
    "text": ["rdf:PlainLiteral", "rdf:langString"],
    "uri": ["xsd:anyURI"],
    "xml": ["rdf:XMLLiteral"],
}
#: Standard prefixes.
PREFIXES = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
ORDER_FACETS = ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive")
#: Lexical form of a dateTime: date, time, and offset if there is one.
MOMENT = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
#: Irregular and regular grandfathered tags of RFC 5646.
GRANDFATHERED = """art-lojban cel-gaulish en-gb-oed i-ami i-bnn i-default i-enochian i-hak i-klingon i-lux i-mingo i-navajo i-pwn i-tao i-tay i-tsu
no-bok no-nyn sgn-be-fr sgn-be-nl sgn-ch-de zh-guoyu zh-hakka zh-min zh-min-nan zh-xiang""".split()
#: Names, by the grammar of prefixed names: first character, and those that may follow.
_START = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
_MORE = _START + r"_\-0-9\x{B7}\x{300}-\x{36F}\x{203F}-\x{2040}"


def reference_part(iri: Column, part: str) -> Column:
    """A component of an IRI reference; empty if it is absent."""
    return F.regexp_extract(iri, REFERENCE, PARTS.index(part) + 1)


def is_iri(iri: Column) -> Column:
    """Absolute IRI: a scheme, no forbidden characters, whole percent escapes, and an authority
    with a numeric port and brackets around IPv6 addresses only."""
    fine = iri.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\x00-\x20<>\"{}|\\^`]*$") & ~iri.rlike(r"%(?![0-9A-Fa-f]{2})")
    authority = reference_part(iri, "authority")
    host = authority.rlike(r"^([^@\[\]]*@)?(\[[0-9A-Fa-f:.]+\]|\[[vV][0-9A-Fa-f]+\.[^\[\]@/]+\]|[^:@\[\]]*)(:[0-9]*)?$")
    return fine & host & ~F.regexp_replace(iri, r"^[^/?#]*//[^/?#]*", "").rlike(r"[\[\]]")


def is_reference(iri: Column) -> Column:
    """IRI, or a relative reference: its first segment has no colon."""
    relative = iri.rlike(r"^[^\x00-\x20<>\"{}|\\^`]*$") & ~iri.rlike(r"%(?![0-9A-Fa-f]{2})") & ~iri.rlike(r"^[^/?#]*:")
    return is_iri(iri) | relative


def without_dots(path: Column) -> Column:
    """Remove the segments . and .. of a path, as RFC 3986, 5.2.4, has it."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) - 1
    rooted = path.startswith("/")
    numbered = F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def step(kept: Column, at: Column) -> Column:
        end = at["i"] == last
        popped = F.when(F.size(kept) > F.when(rooted, 1).otherwise(0), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        back = F.when(end, F.array_append(popped, F.lit(""))).otherwise(popped)
        stay = F.when(end, F.array_append(kept, F.lit(""))).otherwise(kept)
        return F.when(at["x"] == "..", back).when(at["x"] == ".", stay).otherwise(F.array_append(kept, at["x"]))

    return F.array_join(F.aggregate(numbered, F.array().cast("array<string>"), step), "/")


def resolved(reference: Column, base: Column) -> Column:
    """Reference resolution of RFC 3986, 5.2.2, strict and without normalisation."""
    has = lambda iri, pattern: iri.rlike(pattern)
    part = reference_part
    scheme, authority, path, query = (has(reference, x) for x in (r"^[^:/?#]+:", r"^([^:/?#]+:)?//", r"^([^:/?#]+:)?(//[^/?#]*)?[^?#]", r"^[^?#]*\?"))
    dir_ = F.regexp_replace(part(base, "path"), r"[^/]*$", "")
    merged = F.when(has(base, r"^([^:/?#]+:)?//") & (part(base, "path") == ""), F.concat(F.lit("/"), part(reference, "path"))).otherwise(F.concat(dir_, part(reference, "path")))
    own = without_dots(part(reference, "path"))
    new_path = F.when(scheme | authority, own).when(~path, part(base, "path")).when(part(reference, "path").startswith("/"), own).otherwise(without_dots(merged))
    text = lambda on, lead, value: F.when(on, F.concat(F.lit(lead), value)).otherwise("")
    new_query = F.when(scheme | authority | path | query, text(query, "?", part(reference, "query"))).otherwise(text(has(base, r"^[^?#]*\?"), "?", part(base, "query")))
    new_authority = F.when(scheme | authority, text(authority, "//", part(reference, "authority"))).otherwise(text(has(base, r"^([^:/?#]+:)?//"), "//", part(base, "authority")))
    new_scheme = F.when(scheme, part(reference, "scheme")).otherwise(part(base, "scheme"))
    return F.concat(new_scheme, F.lit(":"), new_authority, new_path, new_query, text(has(reference, "#"), "#", part(reference, "fragment")))


def is_prefix_name(name: Column) -> Column:
    """Prefix of an abbreviated IRI with its colon; the empty prefix too."""
    return name.rlike(rf"^([{_START}]([{_MORE}.]*[{_MORE}])?)?:$")


def is_local_name(name: Column) -> Column:
    return name.rlike(rf"^[{_START}_0-9]([{_MORE}.]*[{_MORE}])?$")


def is_node_id(name: Column) -> Column:
    return name.rlike(rf"^_:[{_START}_0-9]([{_MORE}.]*[{_MORE}])?$")


def is_xml_text(text: Column) -> Column:
    """Whether all characters are those that XML 1.0 allows."""
    return ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]")


def expanded(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``names`` (name) with the column iri: a prefixed name's namespace, from (prefix, space), and local
    part; null if the prefix is unknown. Standard prefixes keep their own namespace."""
    spark = names.sparkSession
    standard = spark.createDataFrame(sorted(PREFIXES.items()), "prefix string, space string")
    known = standard.union(prefixes.select("prefix", "space").join(standard, "prefix", "left_anti"))
    prefix = F.substring_index("name", ":", 1)
    rows = names.withColumn("prefix", F.when(F.col("name").contains(":"), prefix)).join(known, "prefix", "left")
    return rows.withColumn("iri", F.concat("space", F.substring(F.col("name"), F.length("prefix") + 2, F.length("name")))).drop("prefix", "space")


def xsd_pattern(pattern: str) -> str:
    """The Java pattern of an xsd:pattern: anchored, with ^ and $ as plain characters. Escapes
    for classes of characters (\\d, \\w, \\p and their complements, \\i, \\c) raise ValueError."""
    made, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1 : at + 2] in ("", *"dDwWpPiIcC"):
                raise ValueError(f"unsupported escape in {pattern!r}")
            made.append(pattern[at : at + 2])
            at += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        made.append("\\" + c if c in "^$" and not inside else c)
        at += 1
    return "^(?:" + "".join(made) + ")$"


def matches_pattern(text: Column, pattern: str) -> Column:
    return text.rlike("(?s)" + xsd_pattern(pattern))


def is_language_tag(tag: Column) -> Column:
    """Well-formed by RFC 5646: language, script, region, variants, extensions and private use."""
    low = F.lower(tag)
    language = r"([a-z]{2,3}(-[a-z]{3}){0,3}|[a-z]{4}|[a-z]{5,8})(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?"
    rest = r"(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(-[a-wy-z0-9](-[a-z0-9]{2,8})+)*(-x(-[a-z0-9]{1,8})+)?"
    return low.rlike(rf"^({language}{rest}|x(-[a-z0-9]{{1,8}})+)$") | low.isin(GRANDFATHERED)


def in_language_range(tag: Column, wanted: str) -> Column:
    """Basic filtering: the tag is the range, or continues it after a hyphen."""
    low = wanted.lower()
    return F.lit(True) if low == "*" else (F.lower(tag) == low) | F.lower(tag).startswith(low + "-")


def decimal_value(lexical: Column) -> Column:
    """Exact value of a decimal's lexical form, null if it has none (or over 38 digits)."""
    text = F.trim(lexical)
    return F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), text.try_cast("decimal(38,9)"))


def in_integer_type(value: Column, name: str) -> Column:
    """Whether an integer value belongs to one of the bounded integer datatypes."""
    least, most = INTEGERS[name]
    held = value.isNotNull()
    if least is not None:
        held = held & (value >= F.lit(least).cast("decimal(38,0)"))
    if most is not None:
        held = held & (value <= F.lit(most).cast("decimal(38,0)"))
    return held


def facet(value: Column, name: str, bound: object) -> Column:
    """minInclusive, minExclusive, maxInclusive, maxExclusive; NaN satisfies none of them."""
    limit = bound if isinstance(bound, Column) else F.lit(bound)
    held = {"minInclusive": value >= limit, "minExclusive": value > limit, "maxInclusive": value <= limit, "maxExclusive": value < limit}[name]
    return held & ~F.coalesce(value.cast("string") == "NaN", F.lit(False))


def integers_between(low: Column, high: Column, low_open: bool = False, high_open: bool = False) -> Column:
    """Number of integers between two bounds; 0 if there are none, null if a bound is missing."""
    least = F.when(F.lit(low_open), F.floor(low) + 1).otherwise(F.ceil(low))
    most = F.when(F.lit(high_open), F.ceil(high) - 1).otherwise(F.floor(high))
    return F.when(low.isNotNull() & high.isNotNull(), F.greatest(most - least + 1, F.lit(0)).cast("long"))


def moment(lexical: Column) -> Column:
    """(at, zoned) of a dateTime: microseconds, in UTC if it has an offset and local otherwise; null if
    it is none. 24:00:00 is the next day's start. Years have four digits.

    One pattern decides; as its parts then stand at fixed places, they are cut out there.
    """
    two = lambda text, k: F.substring(text, k, 2).try_cast("long")
    day = F.try_to_date(F.substring(lexical, 1, 10), "yyyy-MM-dd")
    hour, minute, second = (two(lexical, k) for k in (12, 15, 18))
    rest = F.substring(lexical, 20, 1 << 30)
    shift = F.substring(rest, -6, 1).isin("+", "-")
    zone = F.when(rest.endswith("Z"), 1).when(shift, 6).otherwise(0)
    micro = F.rpad(F.left(F.substring(rest, F.lit(2), F.greatest(F.length(rest) - zone - 1, F.lit(0))), F.lit(6)), 6, "0").try_cast("long")
    away = two(rest, -5) * 60 + two(rest, -2)
    offset = F.when(~shift, 0).when(F.substring(rest, -6, 1) == "-", -away).otherwise(away)
    in_day = ((hour < 24) | ((hour == 24) & (minute == 0) & (second == 0) & (micro == 0))) & (minute < 60) & (second < 60) & (F.abs(offset) <= 840)
    at = (F.unix_date(day).cast("long") * 86400 + hour * 3600 + minute * 60 + second - offset * 60) * 1000000 + micro
    return F.when(lexical.rlike(MOMENT) & day.isNotNull() & in_day, F.struct(at.alias("at"), (zone > 0).alias("zoned")))


def moment_facet(lexical: Column, name: str, bound: Column) -> Column:
    """Order of moments: on one line (both zoned, or both local) as the facet says; a moment of
    the other line has to be more than 14 hours beyond the bound."""
    day = 14 * 3600 * 1000000

    def held(pair: Column) -> Column:
        v, b = pair["v"], pair["b"]
        apart = v["at"] - b["at"]
        same = {"minInclusive": apart >= 0, "minExclusive": apart > 0, "maxInclusive": apart <= 0, "maxExclusive": apart < 0}[name]
        other = apart > day if name.startswith("min") else apart < -day
        return F.when(v["zoned"] == b["zoned"], same).otherwise(other)

    return F.get(F.transform(F.array(F.struct(moment(lexical).alias("v"), moment(bound).alias("b"))), held), F.lit(0))


def datatype_kind(datatype: Column) -> Column:
    """Kind of the values of a datatype IRI; null literals' datatypes count as string, unknown ones have none."""
    full = {k: [PREFIXES[x.split(":")[0]] + x.split(":")[1] for x in v] for k, v in DATATYPES.items()}
    found = F.when(datatype.isNull(), "string")
    for kind, names in full.items():
        found = found.when(datatype.isin(names), kind)
    return found


def number(lexical: Column) -> Column:
    """Value of a decimal or rational for comparisons: 38 digits, nine of them after the point."""
    over = F.regexp_extract(F.trim(lexical), r"^([+-]?[0-9]+)/([0-9]+)$", 1)
    under = F.regexp_extract(F.trim(lexical), r"^([+-]?[0-9]+)/([0-9]+)$", 2)
    ratio = (over.try_cast("decimal(28,0)") / F.nullif(under.try_cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))).cast("decimal(38,9)")
    return F.coalesce(decimal_value(lexical), ratio)


def _ratio_key(text: Column) -> Column:
    """Key of a rational of 64-bit parts: that of an equal decimal if it has nine fraction digits or
    less, else the reduced fraction."""
    over, under = (F.split(text, "/")[k].try_cast("long") for k in (0, 1))
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(over).alias("a"), under.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))
    g = pair["a"]
    value = number(text)
    finite = (over.cast("decimal(19,0)") * F.lit(10**9).cast("decimal(10,0)")) % F.nullif(under, F.lit(0).cast("long")).cast("decimal(19,0)") == 0
    shown = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,9)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(finite, F.concat(F.lit("decimal "), shown)).otherwise(F.concat(F.lit("ratio "), (over / g).cast("long").cast("string"), F.lit("/"), (under / g).cast("long").cast("string")))


def literal_key(datatype: Column, lexical: Column, lang: Column) -> Column:
    """``value_key`` by the literal's own datatype; null outside its lexical space or for unknown datatypes."""
    kind = datatype_kind(datatype)
    text = F.trim(lexical)
    ratio = text.rlike(r"^[+-]?[0-9]+/0*[1-9][0-9]*$")
    whole = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    special = F.regexp_replace(text, "INF", "Infinity")
    real = text.rlike(r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN)$")
    at = moment(text)
    return (
        F.when((kind == "decimal") & whole, value_key("decimal", text))
        .when((kind == "decimal") & ratio, _ratio_key(text))
        .when((kind == "double") & real, F.concat(F.lit("double "), special.try_cast("double").cast("string")))
        .when((kind == "float") & real, F.concat(F.lit("float "), special.try_cast("float").cast("string")))
        .when(kind == "boolean", value_key("boolean", text))
        .when(kind == "moment", F.concat(F.lit("moment "), at["at"].cast("string"), F.when(at["zoned"], " z").otherwise("")))
        .when((kind == "hexBinary") & text.rlike("^([0-9A-Fa-f]{2})*$"), F.concat(F.lit("hexBinary "), F.upper(text)))
        .when(kind == "base64Binary", F.concat(F.lit("base64Binary "), F.regexp_replace(text, r"\s", "")))
        .when(kind == "text", F.concat(F.lit("string "), lexical, F.when(F.coalesce(lang, F.lit("")) == "", "").otherwise(F.concat(F.lit("@"), F.lower(lang)))))
        .when(kind.isin("string", "uri", "xml"), F.concat(kind, F.lit(" "), lexical))
    )


def octets(kind: str, lexical: Column) -> Column:
    """Number of octets of a binary value."""
    text = F.regexp_replace(lexical, r"\s", "")
    return F.length(text) / 2 if kind == "hexBinary" else F.octet_length(F.try_to_binary(text, F.lit("base64")))


def length_facet(text: Column, name: str, bound: int) -> Column:
    """length, minLength, maxLength, in code points."""
    n = F.char_length(text)
    return {"length": n == bound, "minLength": n >= bound, "maxLength": n <= bound}[name]


def value_key(kind: str, lexical: Column) -> Column:
    """Text that is equal for equal values of one kind: numbers lose signs of plus and zeros
    that do not count, language tags their case; zero keeps its sign in floating point."""
    if kind == "decimal":
        number = F.regexp_replace(F.trim(lexical), r"^\+", "")
        number = F.when(number.contains("."), F.regexp_replace(F.regexp_replace(number, "0+$", ""), r"\.$", "")).otherwise(number)
        number = F.regexp_replace(number, r"^(-?)0+(?=[0-9])", "$1")
        number = F.regexp_replace(number, r"^(-?)(?=\.)", "${1}0")
        return F.concat(F.lit("decimal "), F.when(number.isin("-0", ""), F.lit("0")).otherwise(number))
    if kind == "double":
        return F.concat(F.lit("double "), lexical.try_cast("double").cast("string"))
    if kind == "boolean":
        return F.concat(F.lit("boolean "), F.when(lexical.isin("true", "1"), "true").when(lexical.isin("false", "0"), "false"))
    return F.concat(F.lit(kind + " "), lexical)
