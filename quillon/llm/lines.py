"""Line dedup with a log-template tree, in DataFrame functions only.

A line's words with a digit are variable fields. The tree's levels are the number of
words and the leading words; a leaf holds the lines that agree in both.

A leaf's lines share the words that five of them or more have at one position. Other
positions are variable, as long as half of a line's words or more are shared, one of
them after the leading ones: then what is shared is the line's template, else the
masked line is.

Every template that DOCS different texts hold is dropped, wherever it stands in them.
Copies of documents are left to near-duplicate removal: equal texts count as one, and
so do texts of which more than half recurs and whose rarest recurring template is the
same. Lines, words and templates are told apart by 60 bits of MD5, which SQL has too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpoint, fresh

#: Leading words of a leaf, words of the shortest template, documents from which it recurs.
DEPTH, SHORTEST, DOCS = 3, 3, 5
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
SPACE = r"[\x20\x09-\x0D]+"
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def masked(line: Column) -> Column:
    """The line's words, those with a digit as <*>, joined by one space."""
    plain = F.regexp_replace(F.regexp_replace(line, _EDGE, ""), SPACE, " ")
    odd = line.startswith(" ") | line.endswith(" ")
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):  # searches for plain strings are far cheaper than patterns
        odd = odd | line.contains(x)
    plain = F.when(odd, plain).otherwise(line)
    return F.when(F.greatest(*[line.contains(str(d)) for d in range(10)]), F.regexp_replace(plain, FIELD, "<*>")).otherwise(plain)


def number(text: Column) -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _leaf(line: Column, n: Column, depth: int) -> Column:
    return F.xxhash64(n, F.substring_index(line, " ", depth))


def _patterns(lines: DataFrame, rows: DataFrame, depth: int, least: int) -> DataFrame:
    """(leaf, t, pattern): masked lines, by hash, with the pattern of the words that they share.

    A word is fixed if ``least`` different lines of its leaf have it at its position, so strangers
    in a leaf change nothing; other positions are variable. A pattern needs half of its words
    fixed, one of them after the leading words, which agree by construction.
    """
    kinds = rows.select("leaf", "t").distinct()
    leaves = kinds.groupBy("leaf").count().where(F.col("count") >= least).select("leaf")
    kinds = lines.select(F.explode("lines").alias("line")).withColumn("n", _words(F.col("line"))).where(F.col("n") > depth)
    kinds = kinds.select("line", "n", _leaf(F.col("line"), F.col("n"), depth).alias("leaf")).join(leaves, "leaf", "left_semi")
    words = F.transform(F.split("line", " "), lambda x: F.when(x != "<*>", number(x)))
    kinds = kinds.dropDuplicates(["line"])
    place = number(F.concat_ws(" ", "n", F.substring_index("line", " ", depth)))
    kinds = checkpoint(kinds.select("leaf", "n", place.alias("place"), number(F.col("line")).alias("t"), words.alias("words")))
    words = kinds.select("leaf", "place", "t", "n", F.posexplode("words").alias("at", "word")).where("word is not null")
    fixed = words.groupBy("leaf", "at", "word").count().where(F.col("count") >= least).drop("count")
    words = words.join(fixed, ["leaf", "at", "word"], "left_semi")
    mixed = F.bit_xor(number(F.concat_ws(" ", "at", "word")))
    shared = words.groupBy("leaf", "place", "t", "n").agg(mixed.alias("mixed"), F.count("*").alias("fixed"), F.max("at").alias("last"))
    shared = shared.where((2 * F.col("fixed") >= F.col("n")) & (F.col("last") >= depth))
    return shared.select("leaf", "t", number(F.concat_ws(" ", F.lit("pattern"), "place", "mixed")).alias("pattern"))


def recurring(docs: DataFrame, depth: int = DEPTH, shortest: int = SHORTEST, least: int = DOCS) -> DataFrame:
    """(key, dropped): for each text with lines to drop their positions, from 0: lines of all templates
    that ``least`` texts hold which are no copies. Keys tell texts apart."""
    lines = docs.select("key", F.transform(F.split("text", "\n", -1), masked).alias("lines"))
    each = F.transform("lines", lambda x: F.struct(_words(x).alias("n"), number(x).alias("t"), _leaf(x, _words(x), depth).alias("leaf")))
    total = F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + F.when(x["n"] >= shortest, x["n"]).otherwise(0))
    rows = lines.select("key", each.alias("each")).withColumn("total", total).select("key", "total", F.posexplode("each").alias("pos", "x"))
    rows = checkpoint(rows.where(F.col("x.n") >= shortest).select("key", "pos", "total", "x.*"))
    rows = rows.join(_patterns(lines, rows, depth, least), ["leaf", "t"], "left")
    rows = rows.select("key", "pos", "total", "n", F.coalesce("pattern", "t").alias("template"))
    texts = rows.groupBy("template", "key").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    rows = checkpoint(rows.join(texts, "template"))
    # rows of equal texts repeat; a text that mostly recurs is known by its rarest template, which its copies share; any other text by itself
    alike = rows.groupBy("key").agg((2 * F.sum("n") * F.size(F.collect_set("pos")) > F.first("total") * F.count("*")).alias("mostly"), F.min(F.struct("texts", "template")).alias("rarest"))
    alike = alike.select("key", F.when(F.col("mostly"), F.xxhash64("rarest.template", F.lit("copies"))).otherwise(F.col("key")).alias("source"))
    held = rows.select("template", "key").distinct().join(alike, "key").groupBy("template", "source").agg(F.lit(1).alias("one"))
    often = held.groupBy("template").agg(F.count("*").alias("sources")).where(F.col("sources") >= least).select("template")
    return rows.select("key", "pos", "template").join(often, "template", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("dropped"))


def kept_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines at the positions ``dropped`` (null: all stay)."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(dropped, i)), "\n")
    return F.when(dropped.isNull(), text).otherwise(kept)


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 (null for a null text).

    Lines end at line feeds. Lines of less than SHORTEST words are always kept. A null
    text has no lines, an empty one has one. Equal texts count as one, and each row gives
    a row; null ids are kept. Ties between rarest templates go to the smaller number. An
    empty table gives no rows.
    """
    rows = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    done = rows.join(recurring(rows.where("text is not null").select("key", "text")), "key", "left")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return done.select("doc_id", lines.alias("n_lines"), F.when(F.col("dropped").isNull(), F.lit(0).cast("long")).otherwise(n_dropped).alias("n_dropped"), F.sha2(kept_lines(F.col("text"), F.col("dropped")), 256).alias("kept_sha256"))


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that are left when recurring templates are dropped.

    Every row stays, with all its other columns, whatever they are called. A null text stays null, an
    empty one empty; equal texts and repeated rows lose the same lines and count as one text. Ties
    are those of ``line_dedup``. An empty table gives no rows.
    """
    key, at, dropped = fresh(docs, "key", "at", "dropped")
    found = recurring(docs.where("text is not null").select(F.xxhash64("text").alias("key"), "text")).toDF(at, dropped)
    own = docs.withColumn(key, F.xxhash64("text"))
    done = own.join(found, own[key] == found[at], "left")
    return done.select(*[kept_lines(own["text"], found[dropped]).alias("text") if c == "text" else own[c] for c in docs.columns])


SQL = r"""
WITH k AS (SELECT row_number() OVER () AS key, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT key, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM k),
r AS (SELECT key, i, regexp_replace(regexp_replace(regexp_replace(ln, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS m FROM l),
q AS (
  SELECT *, ('0x' || md5(n || ' ' || array_to_string(string_split(m, ' ')[1:3], ' '))[1:15])::BIGINT AS leaf, ('0x' || md5(m)[1:15])::BIGINT AS t
  FROM (SELECT *, len(string_split(m, ' ')) AS n FROM r WHERE m <> '') WHERE n >= 3),
kinds AS (SELECT DISTINCT leaf, t, n, m FROM q),
busy AS (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) >= 5),
w AS (
  SELECT leaf, t, n, ('0x' || md5(word)[1:15])::BIGINT AS word, pos FROM (
    SELECT leaf, t, n, unnest(string_split(m, ' ')) AS word, generate_subscripts(string_split(m, ' '), 1) - 1 AS pos FROM kinds WHERE n > 3 AND leaf IN (SELECT leaf FROM busy))
  WHERE word <> '<*>'),
f AS (SELECT leaf, pos, word FROM w GROUP BY ALL HAVING count(*) >= 5),
s AS (
  SELECT leaf, t, ('0x' || md5('pattern ' || leaf || ' ' || bit_xor(('0x' || md5(pos || ' ' || word)[1:15])::BIGINT))[1:15])::BIGINT AS pattern
  FROM w SEMI JOIN f USING (leaf, pos, word) GROUP BY leaf, t, n HAVING 2 * count(*) >= n AND max(pos) >= 3),
a AS (SELECT q.key, q.i, q.n, sum(q.n) OVER (PARTITION BY q.key) AS total, coalesce(s.pattern, q.t) AS template FROM q LEFT JOIN s ON q.leaf = s.leaf AND q.t = s.t),
c AS (SELECT template, count(DISTINCT key) AS texts FROM a GROUP BY template HAVING count(DISTINCT key) >= 5),
b AS (SELECT a.*, c.texts FROM a JOIN c USING (template)),
o AS (SELECT key, CASE WHEN 2 * sum(n) > any_value(total) THEN 'copies ' || min({'texts': texts, 'template': template}).template ELSE 'text ' || key END AS source FROM b GROUP BY key),
d AS (SELECT template FROM b JOIN o USING (key) GROUP BY template HAVING count(DISTINCT source) >= 5),
x AS (SELECT key, i FROM b WHERE template IN (SELECT template FROM d)),
y AS (SELECT l.key, string_agg(CASE WHEN x.i IS NULL THEN ln END, chr(10) ORDER BY l.i) AS kept, count(x.i) AS c FROM l LEFT JOIN x ON l.key = x.key AND l.i = x.i GROUP BY l.key)
SELECT e.doc_id, CASE WHEN e.text IS NULL THEN 0 ELSE len(string_split(e.text, chr(10))) END AS n_lines, coalesce(y.c, 0) AS n_dropped,
  CASE WHEN e.text IS NULL THEN NULL ELSE sha256(coalesce(y.kept, '')) END AS kept_sha256
FROM documents e LEFT JOIN k ON e.text = k.text LEFT JOIN y ON k.key = y.key
"""
