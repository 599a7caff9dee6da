"""Periodic runs of words, by counting matches at every lag.

A run of period q and length m has m - q words in a row that equal the word q places
further on. So a lag with fewer matches than the shortest run of that period needs has no
run, and only lags with enough matches are looked at. Matches are counted exactly: for a
document's frequent words by the autocorrelation of their places (FFT), for the others by
the differences of all pairs of places.

At a lag with enough matches, an island scan finds the stretches of matches. Every
stretch that is long enough covers several places in a row of a coarse grid, so the scan
compares on the grid first and word by word around its hits only. A run of period q also
matches at multiples of q; these matches are taken off the counts, so a text that
repeats one phrase is scanned once and not for every multiple.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import WORD, row_blocks

#: Words of the shortest run.
LEAST = 12
#: A word of a document counts as frequent from f places on where f * f is over this times n * log2(n): then one
#: transform costs less than its pairs.
DENSE = 1.25
#: Pairs that are counted at a time.
PAIRS = 4_000_000


def need(lag: np.ndarray | int, least: int = LEAST) -> np.ndarray:
    """Matches in a row that the shortest run of a period has."""
    return np.maximum(least - lag, lag)


def _transform_size(n: int) -> int:
    """Least size of the form 2^a or 3 * 2^a that is n or more."""
    power = 1 << (n - 1).bit_length()
    return power * 3 // 4 if power * 3 // 4 >= n else power


def autocorrelation(places: list[np.ndarray], n: int) -> np.ndarray:
    """Matches at each lag up to n // 2 of words with the given places, for all these words together."""
    size = _transform_size(n + n // 2 + 1)
    power = np.zeros(size // 2 + 1)
    for at in places:
        shown = np.zeros(size)
        shown[at] = 1
        found = np.fft.rfft(shown)
        power += found.real**2 + found.imag**2
    return np.rint(np.fft.irfft(power, size)[: n // 2 + 1]).astype(np.int64)


def lag_counts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of each document at each lag, and where a document's lags begin.

    ``ids`` are the numbers of the words of all documents, one after the other, ``counts`` their words.
    Lags run from 0 to half of a document's words.
    """
    base = np.concatenate([[0], np.cumsum(counts // 2 + 1)])
    found = np.zeros(base[-1], np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.lexsort((ids, doc))  # stable: places stay in order
    key_doc, key_id, at = doc[order], ids[order], at[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (key_doc[1:] != key_doc[:-1]) | (key_id[1:] != key_id[:-1])
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(ids)))
    n = counts[key_doc[first]].astype(float)
    dense = sizes.astype(float) ** 2 > DENSE * n * np.log2(np.maximum(n, 2)) + 1000
    frequent = defaultdict(list)
    for k in np.flatnonzero(dense):
        frequent[int(key_doc[first[k]])].append(at[first[k] : first[k] + sizes[k]])
    for d, places in frequent.items():
        found[base[d] : base[d + 1]] += autocorrelation(places, int(counts[d]))
    # pairs of the same word's places, by how many of them lie between: 1, 2, ...
    rare = np.repeat(~dense & (sizes > 1), sizes)
    at, own, left = at[rare], key_doc[rare], np.repeat(sizes, sizes)[rare]
    rank = np.arange(len(at)) - np.repeat(np.cumsum(s := sizes[~dense & (sizes > 1)]) - s, s)
    left = left - rank  # places of the word from this one on
    half, slot = counts[own] // 2, base[own]
    live, held, many = np.arange(len(at)), [], 0
    step = 1
    while len(live := live[left[live] > step]):
        lag = at[live + step] - at[live]
        near = lag <= half[live]
        live = live[near]  # later places are farther still
        held.append(slot[live] + lag[near])
        many += len(live)
        if many > PAIRS:
            np.add(found, np.bincount(np.concatenate(held), minlength=len(found)), out=found)
            held, many = [], 0
        step += 1
    if held:
        found += np.bincount(np.concatenate(held), minlength=len(found))
    return found, base


def _stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of ``least`` true values or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of ``least`` or more places whose word stands again ``lag`` places on."""
    n, grid = len(ids) - lag, max(1, least // 8)
    hits = ids[:n:grid] == ids[lag::grid]
    if grid == 1:
        return _stretches(hits, least)
    found = []
    for a, z in _stretches(hits, least // grid):
        low, high = max(0, (a - 1) * grid + 1), min(n, z * grid)
        found += [(low + s, low + e) for s, e in _stretches(ids[low:high] == ids[low + lag : high + lag], least)]
    return found


def runs_of(ids: np.ndarray, counts: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of a document's runs, by start and period; ``counts``: its matches at each lag, which change."""
    lags = np.arange(len(counts))
    wanted = need(lags, least)
    wanted[0] = len(ids) + 1
    found = {}
    for q in np.flatnonzero(counts >= wanted).tolist():
        if counts[q] < wanted[q]:  # what is left once matches of runs of a divisor are off
            continue
        for start, end in islands(ids, q, int(wanted[q])):
            length = end - start + q
            if (start, length) in found:
                continue
            found[start, length] = q
            many = np.arange(2 * q, min(length // 2, len(counts) - 1) + 1, q)
            counts[many] -= length - many
    return sorted((start, length, q) for (start, length), q in found.items())


def without_runs(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places that no run covers beyond its first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.flatnonzero(np.cumsum(cover)[:n] == 0)


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (array of start, length, period, by start and period) and
    kept, the words that no run covers beyond its first period, joined by one space.

    A run is a stretch of consecutive words whose smallest period q, in words, fits in it twice, of at
    least ``least`` words, that no neighbouring word continues. Words are told apart by their bytes.
    Texts are read whole, each in one task; a null text has no words. Rows repeat and ids may be null,
    as given. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("runs", T.ArrayType(_RUN)), T.StructField("kept", T.StringType())])
    kinds = [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return
        batches, id_kind = itertools.chain([head], batches), head.column(0).type
        for doc_ids, texts in row_blocks(batches, 1):
            number = defaultdict(itertools.count().__next__)
            split = [(t or b"").split() for t in texts]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
            lags, base = lag_counts(ids, counts)
            runs, kept = [], []
            for d, (words, end) in enumerate(zip(split, np.cumsum(counts).tolist(), strict=True)):
                own = runs_of(ids[end - len(words) : end], lags[base[d] : base[d + 1]], least)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                kept.append(b" ".join([words[i] for i in without_runs(len(words), own).tolist()] if own else words).decode())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, id_kind), pa.array(runs, kinds[0]), pa.array(kept, kinds[1])], ["doc_id", "runs", "kept"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(find, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents, and in those whose id's crc32 ends in 0 a phrase repeated up to the end.

    With h the crc32 and g = h // 10, the phrase begins at word g % n and has 1 + (n - it) // (3 + g % 8)
    words. A null id counts as empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), ((h - h % 10) / 10).cast("long").alias("g")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    edited = F.transform("words", lambda _, i: F.element_at("words", (source(i) + 1).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and checksums of all runs and of what is kept."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000L * best.length div -best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def repetitions(docs: DataFrame) -> DataFrame:
    """The runs of ``docs`` with planted ones (see ``with_planted_runs``), as ``digests``; a document without runs has nulls for the longest."""
    return digests(periodic_runs(with_planted_runs(docs)))
