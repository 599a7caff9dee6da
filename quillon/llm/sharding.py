"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows are numbered in the order of (doc_id, size, checksum). A keyed permutation of the
numbers 0 to n - 1 then says where each row goes: the permuted number's remainder by the
number of shards is its shard, the quotient its slot. So shards' rows differ by one at
most, slots have no gaps, and both can be computed from a row's number alone, as the
number can from shard and slot (``row_at``), without any table.

The permutation is a Feistel network over pairs of digits to the base ``side``, the least
whole number whose square is n or more. Numbers from n up to that square are walked
through: the network is applied until the result is below n. Their share is 2 / sqrt(n)
at most, and ``longest_walk`` finds how many steps the longest walk takes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import numbered, utf8

SHARDS, ROUNDS, SEED = 24, 6, "shards"
#: Bytes that a document counts for besides its text.
HEADER = 8


def side_of(n: int) -> int:
    return math.isqrt(n - 1) + 1 if n else 0


def _keyed(key: Column, half: Column, side: int) -> Column:
    """A number below ``side`` from 60 bits of MD5, which SQL has too."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", key, half)), 1, 15), 16, 10).cast("long") % side


def _network(x: Column, side: int, seed: str, rounds: int, back: bool) -> Column:
    keys = F.array(*[F.lit(f"{seed} {k}") for k in (reversed(range(rounds)) if back else range(rounds))])
    pair = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    ahead = lambda s, k: pair(s["b"], (s["a"] + _keyed(k, s["b"], side)) % side)
    behind = lambda s, k: pair(F.pmod(s["b"] - _keyed(k, s["a"], side), F.lit(side)), s["a"])
    start = pair((x - x % side) / side, x % side)  # exact for numbers below 2 ** 53
    return F.aggregate(keys, start, behind if back else ahead, lambda s: s["a"] * side + s["b"])


def permuted(x: Column, n: int, walk: int, seed: str = SEED, rounds: int = ROUNDS, back: bool = False) -> Column:
    """Where the permutation of 0 to n - 1 takes the number ``x``, or, with ``back``, what it takes there."""
    side = side_of(n)
    step = lambda y, k: F.when((k > 0) & (y < n), y).otherwise(_network(y, side, seed, rounds, back))
    return F.aggregate(F.sequence(F.lit(0), F.lit(walk)), x.cast("long"), step)


def longest_walk(spark: SparkSession, n: int, seed: str = SEED, rounds: int = ROUNDS) -> int:
    """Steps beyond the first after which every number that the network takes to n or more is back below n.

    Follows all numbers from n to the square. Each step at least one of those that ever leave
    leaves; those that go in a circle never come from below n.
    """
    side, steps = side_of(n), 0
    now = spark.range(n, side * side).select(F.col("id").alias("x"))
    left = side * side - n
    while left:
        now = now.select(_network(F.col("x"), side, seed, rounds, False).alias("x")).where(F.col("x") >= n)
        steps, before, left = steps + 1, left, now.count()
        if left == before:
            return steps - 1
    return steps


def place(row: Column, n: int, shards: int, walk: int, seed: str = SEED) -> tuple[Column, Column]:
    """(shard, slot) of a row by its number."""
    at = permuted(row, n, walk, seed)
    return (at % shards).cast("int"), ((at - at % shards) / shards).cast("long")


def row_at(shard: Column, slot: Column, n: int, shards: int, walk: int, seed: str = SEED) -> Column:
    """Number of the row that lies in a slot of a shard."""
    return permuted(slot.cast("long") * shards + shard, n, walk, seed, back=True)


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the
    law is ``rows``, whose shards all change with their number), row (its number).

    A null text has no bytes, like an empty one. Null ids come first and, like repeated
    ids, are told apart by size and checksum; rows that agree in all three are
    interchangeable in the result. Equal texts are dealt out like any other rows: a law of
    equal counts cannot keep a group of a third of all rows in one of 24 shards. Columns
    other than doc_id and text are not read. An empty table gives no rows.
    """
    text = utf8(F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"], "row")
    walk = longest_walk(docs.sparkSession, n, seed)
    if n:
        rows = rows.withColumn("at", permuted(F.col("row"), n, walk, seed))
    else:
        rows = rows.withColumn("at", F.col("row"))
    at = F.col("at")
    slot = ((at - at % shards) / shards).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (at % shards).cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")


#: DuckDB's SQL of the query. Its crc32 works through a text's bytes with the table of the polynomial.
CRC = """
bits AS (SELECT n, n AS c, 0 AS k FROM range(256) r(n) UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)
"""


def crc_sql(text: str, table: str = "t") -> str:
    """SQL of an unsigned crc32 of a text; ``table`` is the column with the table of the polynomial."""
    hexes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {hexes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))"


SQL = f"""
WITH RECURSIVE {CRC},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row FROM d),
n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS side FROM d),
f AS (SELECT row, row // side AS a, row % side AS b, 0 AS k FROM r, n UNION ALL
  SELECT row, CASE WHEN k = {ROUNDS} THEN a ELSE b END, CASE WHEN k = {ROUNDS} THEN b ELSE (a + ('0x' || md5('{SEED} ' || k || ' ' || b)[1:15])::BIGINT % side) % side END,
    CASE WHEN k = {ROUNDS} THEN 0 ELSE k + 1 END
  FROM f, n WHERE k < {ROUNDS} OR a * side + b >= n),
p AS (SELECT row, a * side + b AS place FROM f, n WHERE k = {ROUNDS} AND a * side + b < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {SHARDS})::INT AS shard, place // {SHARDS} AS slot, NULL::INT AS grown_shard, row
FROM r JOIN p USING (row)
"""
