"""Importance resampling towards a target: a draw of documents that are worded like a target set.

Features are runs of 1 to ``longest`` consecutive words, counted in buckets by CRC-32. A
bucket's gain is the logarithm of its smoothed share in the target over that in the
corpus; a document's weight is its features' mean gain. Gumbel noise, keyed by the id,
on top of the weights makes the highest scores a draw in proportion to the weights.

A byte automaton finds features in the bytes of an Arrow column as they are: a lookup
table sorts bytes into those of words and others, differences of that mask are the
words' bounds, and the CRCs of all features advance together, byte by byte, through the
checksum's own table. Few features are longer than FAR bytes; the rest of these follows
feature by feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import numbered
from quillon.llm.sharding import CRC, crc_sql

BUCKETS, LONGEST, SCALE, SEED = 10_000, 1, 1000, 2024
#: Words of the shortest document that can be drawn, and percent of those that are.
SHORTEST, PERCENT = 20, 10
#: Bytes of a feature that all features' checksums advance through together.
FAR = 64
#: Bytes of text in a block.
BLOCK = 4_000_000


def lower_table() -> np.ndarray:
    """Each byte as it counts in a word: A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_table() -> np.ndarray:
    """Whether a byte belongs to words: digits, letters, and every byte of characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


LOWER, WORDS, TABLE = lower_table(), word_table(), crc_table()


def word_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; none crosses a position in ``cuts``."""
    word = WORDS[data]
    fresh = word.copy()
    fresh[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    fresh[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(fresh), np.flatnonzero(last) + 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, far: int = FAR) -> np.ndarray:
    """CRC-32 of each stretch of ``data``, all of them one byte ahead at a time, the longest first."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, far).astype(np.int16), kind="stable")
    at = starts[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    reach = len(sizes) - np.cumsum(np.bincount(np.minimum(sizes, far), minlength=far + 1))
    for k in range(far):
        m = reach[k]  # stretches of more than k bytes
        if not m:
            break
        own = state[:m]
        state[:m] = TABLE[(own ^ data[at[:m] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    found = np.empty_like(state)
    found[order] = ~state
    for i in np.flatnonzero(sizes > far):
        found[i] = zlib.crc32(data[starts[i] + far : ends[i]].tobytes(), int(found[i]))
    return found


def features(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and the text and the checksum of each feature.

    Texts lie in ``data`` between ``offsets``. Words of a longer feature are joined by one space.
    """
    starts, ends = word_bounds(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(owner, minlength=len(offsets) - 1)
    low = LOWER[data]
    texts, sums = [owner], [checksums(low, starts, ends)]
    if longest > 1:  # the words alone, each with a space after it
        sizes = ends - starts
        to = np.concatenate([[0], np.cumsum(sizes + 1)])
        plain = np.full(to[-1], 32, np.uint8)
        plain[np.repeat(to[:-1] - starts, sizes) + np.flatnonzero(WORDS[data])] = low[WORDS[data]]
        for n in range(2, longest + 1):
            held = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
            texts.append(owner[held])
            sums.append(checksums(plain, to[held], to[held + n] - 1))
    return words, np.concatenate(texts), np.concatenate(sums)


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of stretches of a text column of about ``most`` bytes."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts; each task sums its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                total += np.bincount(features(data, offsets, longest)[2] % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Gain of every bucket, in thousandths: ``buckets`` numbers, whatever the corpus' size."""
    own, other = (bucket_counts(x, buckets, longest).toPandas() for x in (corpus, target))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, found in ((s, own), (t, other)):
        counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document; without features it weighs 0."""
    table = docs.sparkSession.sparkContext.broadcast(gain)
    ids = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", ids), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                words, texts, sums = features(data, offsets, longest)
                n = np.bincount(texts, minlength=last - first)
                total = np.bincount(texts, gain[sums % np.uint32(len(gain))], minlength=last - first).astype(np.int64)
                held = [pa.array(x, pa.int64()) for x in (words, n, np.where(n > 0, total // np.maximum(n, 1), 0))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *held], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, shortest: int = SHORTEST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (of those drawn, from 1, else null).

    ``percent`` of the documents with at least ``shortest`` words are drawn, rounded down, by the highest
    scores; ties go to the smaller id (null ids first), then to the row with fewer features, and rows
    that agree in these are interchangeable. A null text has no words, like an empty one; its weight is
    0. A null id draws its noise as an empty text would. Columns other than doc_id and text are not
    read. An empty table gives no rows; an empty target leaves a corpus' rare buckets with the highest
    gains.
    """
    scored = weights(docs, gains(docs, target, buckets, longest), longest)
    scored = scored.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    # those that can be drawn come first, and their number is known from the same pass
    rows = scored.withColumns({"_short": F.col("n_words") < shortest, "_down": -F.col("score")})
    rows, _ = numbered(rows, ["_short", "_down", "doc_id", "n_features"], "row")
    drawn = rows.where(~F.col("_short")).count() * percent // 100
    rank = F.when(F.col("row") < drawn, F.col("row") + 1)
    return rows.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


SQL = f"""
WITH RECURSIVE {CRC},
w AS MATERIALIZED (SELECT id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT -1, NULL, text FROM benchmark)),
k AS MATERIALIZED (SELECT word, {crc_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM w), crc),
f AS MATERIALIZED (SELECT id, bucket FROM w JOIN k USING (word)),
c AS (SELECT bucket, count(*) FILTER (id > 0) AS s, count(*) FILTER (id < 0) AS t FROM f GROUP BY bucket),
n AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
g AS (SELECT bucket, floor({SCALE} * ln((c.t + 1)::DOUBLE * (n.s + {BUCKETS})::DOUBLE / ((c.s + 1)::DOUBLE * (n.t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM c, n),
v AS (SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE id > 0 GROUP BY id),
d AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM (SELECT row_number() OVER () AS id, doc_id FROM documents) d LEFT JOIN v USING (id)),
e AS (SELECT *, weight + floor(-{SCALE} * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {SHORTEST} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) FILTER (n_features >= {SHORTEST}) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {SHORTEST} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM r
"""
