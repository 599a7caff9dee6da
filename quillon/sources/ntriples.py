"""N-Triples as rows: a scan of text files, its rejected lines, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_IRI = r"<([^\x00-\x20<>\"{}|^`\\]*)>"
_NODE = r"_:([A-Za-z0-9_][A-Za-z0-9_.\-]*)"
_TEXT = r'"((?:[^"\\\n\r]|\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*)"'
#: Groups: subject IRI, subject node, predicate, object IRI, object node, text, datatype, language.
LINE = rf"^[ \t]*(?:{_IRI}|{_NODE})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_NODE}|{_TEXT}(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)[ \t]*\.[ \t]*(?:#.*)?$"
STRING = "http://www.w3.org/2001/XMLSchema#string"
TAGGED = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
#: Escapes of one character.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'"}


def unescaped(text: Column) -> Column:
    """The text that a quoted string stands for."""
    safe = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for name, value in ESCAPES.items():
        safe = F.replace(safe, F.lit("\\" + name), F.lit(value))
    parts = F.split(safe, r"(?=\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})", -1)

    def decoded(part: Column) -> Column:
        short, long = part.startswith("\\u"), part.startswith("\\U")
        code = F.conv(F.when(short, F.substring(part, 3, 4)).otherwise(F.substring(part, 3, 8)), 16, 10).cast("int")
        low, high = F.pmod(code, F.lit(0x400)), F.floor((code - 0x10000) / 0x400)
        units = F.when(code < 0x10000, F.array(code)).otherwise(F.array(F.lit(0xD800) + high, F.lit(0xDC00) + low).cast("array<int>"))
        raw = F.aggregate(units, F.lit(""), lambda s, u: F.concat(s, F.lpad(F.hex(u), 4, "0")))
        char = F.decode(F.unhex(raw), "UTF-16BE")
        return F.when(short, F.concat(char, F.substring(part, 7, 1 << 30))).when(long, F.concat(char, F.substring(part, 11, 1 << 30))).otherwise(part)

    joined = F.when(safe.contains("\\"), F.array_join(F.transform(parts, decoded), "")).otherwise(safe)
    return F.replace(joined, F.lit("\x00"), F.lit("\\"))


def parsed(lines: DataFrame) -> DataFrame:
    """(line, s_kind, s, p, o_kind, o, datatype, lang) of a column ``line``; s is null for malformed lines."""
    g = lambda k: F.nullif(F.regexp_extract("line", LINE, k), F.lit(""))
    iri, node, text = g(4), g(5), F.regexp_extract("line", LINE, 6)
    quoted = iri.isNull() & node.isNull() & g(3).isNotNull()
    return lines.select(
        "line",
        F.when(g(1).isNotNull(), "iri").when(g(2).isNotNull(), "node").alias("s_kind"),
        F.coalesce(g(1), g(2)).alias("s"),
        g(3).alias("p"),
        F.when(iri.isNotNull(), "iri").when(node.isNotNull(), "node").when(quoted, "literal").alias("o_kind"),
        F.coalesce(iri, node, F.when(quoted, unescaped(text))).alias("o"),
        F.when(quoted, F.when(g(8).isNotNull(), TAGGED).otherwise(F.coalesce(g(7), F.lit(STRING)))).alias("datatype"),
        F.lower(g(8)).alias("lang"),
    )


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples of N-Triples files, and the lines that are none. Blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(~F.col("line").rlike(r"^[ \t]*(#.*)?$"))
    rows = parsed(lines)
    return rows.where("s is not null").drop("line"), rows.where("s is null").select("line")


#: What a line is read as, part by part: a line is wrong at the first part that it does not go on with.
_PARTS = [
    ("subject", rf"^[ \t]*(?:{_IRI}|{_NODE})"),
    ("predicate", rf"[ \t]*{_IRI}"),
    ("object", rf"[ \t]*(?:{_IRI}|{_NODE}|{_TEXT}(?:\^\^{_IRI}|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?)"),
    ("full stop", r"[ \t]*\."),
    ("end of line", r"[ \t]*(?:#.*)?\r?$"),
]


def lines_at(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, offset, number): every line of the files with the byte that it begins at and its number, from 0.

    A file's blocks are read apart; a block's lines are numbered in the order of the scan, and the
    sums of the blocks before it give where a block's first line stands. Lines end at line feeds.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    size = F.octet_length("line") + 1
    sums = rows.groupBy("file", "block").agg(F.sum(size).alias("bytes"), F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("bytes", "lines")])
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"ahead": F.coalesce(F.sum(size).over(own), F.lit(0)), "place": F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1})
    return rows.join(starts, ["file", "block"]).select("file", "line", (F.col("bytes") + F.col("ahead")).alias("offset"), (F.col("lines") + F.col("place")).alias("number"))


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, offset, kind): the lines that are no triples, the byte of the file at which each goes wrong,
    and what had to follow there; ``encoding`` (at the line's start) for lines that are no UTF-8."""
    rows = lines_at(spark, path).where(~F.col("line").rlike(r"^[ \t]*(#.*)?\r?$") | ~F.is_valid_utf8("line"))
    kind, length, pattern = F.when(~F.is_valid_utf8("line"), "encoding"), F.when(~F.is_valid_utf8("line"), 0), ""
    for name, part in _PARTS:
        done = F.regexp_extract("line", f"({pattern}[ \\t]*)" if pattern else r"(^[ \t]*)", 1)
        kind, length = kind.when(~F.col("line").rlike(pattern + part), name), length.when(~F.col("line").rlike(pattern + part), F.octet_length(done))
        pattern += part
    return rows.select("file", "number", (F.col("offset") + length).alias("offset"), kind.alias("kind")).where("kind is not null")


def first_errors(spark: SparkSession, path: str) -> DataFrame:
    """The first error of each file."""
    best = errors(spark, path).groupBy("file").agg(F.min(F.struct("offset", "number", "kind")).alias("e"))
    return best.select("file", "e.number", "e.offset", "e.kind")


def formatted(triples: DataFrame) -> Column:
    """The line of a triple."""
    def term(kind: Column, value: Column) -> Column:
        return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(F.concat(F.lit("_:"), value))

    text = F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\"))
    for name, value in ESCAPES.items():
        if name != "'":
            text = F.replace(text, F.lit(value), F.lit("\\" + name))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).otherwise(F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">")))
    literal = F.concat(F.lit('"'), text, F.lit('"'), tail)
    last = F.when(F.col("o_kind") == "literal", literal).otherwise(term(F.col("o_kind"), F.col("o")))
    return F.concat(term(F.col("s_kind"), F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), last, F.lit(" ."))


def write(triples: DataFrame, path: str) -> None:
    """One canonical line for each triple."""
    triples.select(formatted(triples).alias("value")).write.mode("overwrite").text(path)
