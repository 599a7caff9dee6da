"""Substring dedup by level-wise doubling: repeated windows of words are removed.

Levels are lengths that double up to the window: 9, 18 and 35 words. At each level the
windows that are still candidates are looked at through their anchor, the part of the
level's length in them with the smallest hash. Equal windows have equal anchors, so a window
whose anchor does not recur is done, and the others go on to the next level. The first
levels only count anchors. At the last one before the whole, windows that share an anchor in
a document lie side by side; if all occurrences of an anchor have the same words around
them, all of these windows recur. Only where the surroundings differ are the windows of the
full length counted one by one. Rows that come back to a document carry hashes, not
positions, so equal texts and repeated rows need no care.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WordHashes, checkpoint, row_blocks, stored, utf8

WINDOW = 35
#: Words of the shortest level.
FIRST = 9
#: Bytes of text handled at a time.
SLICE = 1_500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK2 = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
#: An anchor is hot if it has more than one in so many of all recurring occurrences.
HOT = 2000
_ANCHORS = pa.schema([("uid", pa.int64()), ("h", pa.int64()), ("v", pa.int64())])
_WINDOWS = pa.schema([("uid", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _mixed(x: np.ndarray, by: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    if n:
        found[0] = 1
    return np.multiply.accumulate(found)


class Spans:
    """Windows of several texts, whose words lie one after the other, and their anchors."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, window: int, lengths: Sequence[int], alive: list[list] = ()) -> None:
        """Anchors at the level after those of ``alive``: lists of anchors, one for each text, that candidates have."""
        n, self.window, self.counts = len(hashes), window, counts
        self.hashes = hashes
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
        self.back = _powers(_BACK, n + 1)
        half = lengths[len(alive)]
        ends = np.cumsum(counts)
        room = np.repeat(ends, counts) - np.arange(n)
        self.at = np.flatnonzero(room >= window)
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.h = self.v = np.zeros(0, np.uint64)
        for length, lists in zip(lengths, alive, strict=False):
            if len(self.at):
                short, low = self._lowest(length)
                self.at = self.at[_among(short[low[self.at]], _owner(counts, self.at), lists)]
        if not len(self.at):
            return
        short, low = self._lowest(half)
        anchors = low[self.at]
        starts = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(self.at, prepend=-2) != 1))
        self.first = self.at[starts]  # of the windows that have an anchor
        self.last = self.at[np.append(starts[1:], len(self.at)) - 1]
        self.anchor = anchors[starts]
        self.h = short[self.anchor]
        extent = (self.anchor - self.first) * window + (self.last - self.first)
        self.v = _mixed(self.key(self.first, self.last + window - self.first) + extent.astype(np.uint64))

    def _lowest(self, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all parts of a length, and for each word the place of the smallest of them, the leftmost of
        equal ones, in the window from there on."""
        short = self.key(np.arange(len(self.hashes) - half + 1), half)
        low, size, most = np.arange(len(short)), 1, self.window - half + 1

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(short[a] <= short[b], a, b)

        while size * 2 <= most:
            low = least(low[: len(low) - size], low[size:])
            size *= 2
        if size < most:
            low = least(low[: len(low) - (most - size)], low[most - size :])
        return short, low

    def key(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hash of so many words from each start on."""
        return _mixed((self.sums[start + length] - self.sums[start]) * self.back[start])

    def second(self, start: np.ndarray) -> np.ndarray:
        """Another hash of the whole windows: other word hashes and another base."""
        n = len(self.hashes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(self.hashes, 0xFF51AFD7ED558CCD) * _powers(_BASE2, n), dtype=np.uint64)])
        return _mixed((sums[start + self.window] - sums[start]) * _powers(_BACK2, n + 1)[start])

    def windows(self, which: np.ndarray, second: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of the whole windows of the chosen anchors."""
        n = self.last[which] - self.first[which] + 1
        start = np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return start, self.key(start, self.window), self.second(start) if second else start


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _owner(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which text a word lies in."""
    return np.searchsorted(np.cumsum(counts), at, side="right")


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths before the whole window, each half of the next, rounded up."""
    found = [(window + 1) // 2]
    while found[0] > first:
        found.insert(0, (found[0] + 1) // 2)
    return found


def _anchors(batches: Iterator[pa.RecordBatch], window: int, lengths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """(uid, h, v): anchors of the candidates at a level; batches carry uid, text and the lists of the levels before."""
    words = WordHashes()
    for uid, text, *alive in row_blocks(batches, 1, SLICE):
        _, hashes, counts = words.of(text)
        spans = Spans(hashes, counts, window, lengths, alive)
        own = np.array(uid, np.int64)[_owner(counts, spans.anchor)]
        yield pa.RecordBatch.from_arrays([pa.array(own), _signed(spans.h), _signed(spans.v)], schema=_ANCHORS)


def _among(x: np.ndarray, owner: np.ndarray, lists: list) -> np.ndarray:
    """Whether each hash is in the list that came back to its text."""
    known = [np.array(k or [], np.int64) for k in lists]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.concatenate(known) if known else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(known)), sizes)
    pairs = np.empty(len(flat), [("o", np.int64), ("k", np.int64)])
    pairs["o"], pairs["k"] = at, flat
    asked = np.empty(len(x), pairs.dtype)
    asked["o"], asked["k"] = owner, x.view(np.int64)
    both = np.concatenate([pairs, asked])
    order = np.lexsort((np.arange(len(both)) >= len(pairs), both["k"], both["o"]))
    same = np.zeros(len(both), bool)
    o, k, mine = both["o"][order], both["k"][order], order < len(pairs)
    group = np.cumsum(np.append(True, (o[1:] != o[:-1]) | (k[1:] != k[:-1]))) if len(both) else np.zeros(0, np.int64)
    has = np.zeros(int(group[-1]) + 1 if len(group) else 1, bool)
    has[group[mine]] = True
    same[order] = has[group]
    return same[len(pairs) :]


def _resolve(batches: Iterator[pa.RecordBatch], window: int, lengths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for uid, text, mixed, *alive in row_blocks(batches, 1, SLICE):
        _, hashes, counts = words.of(text)
        spans = Spans(hashes, counts, window, lengths, alive)
        start, k1, k2 = spans.windows(np.flatnonzero(_among(spans.h, _owner(counts, spans.anchor), mixed)))
        own = np.array(uid, np.int64)[_owner(counts, start)]
        yield pa.RecordBatch.from_arrays([pa.array(own), _signed(k1), _signed(k2)], schema=_WINDOWS)


def _remove(batches: Iterator[pa.RecordBatch], window: int, lengths: Sequence[int], texts: bool) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for doc_id, text, whole, mixed, found, *alive in row_blocks(batches, 1, SLICE):
        split, hashes, counts = words.of(text)
        spans = Spans(hashes, counts, window, lengths, alive)
        owner = _owner(counts, spans.anchor)
        edge = np.zeros(len(hashes) + 1, np.int64)
        sure = np.flatnonzero(_among(spans.h, owner, whole))
        np.add.at(edge, spans.first[sure], 1)
        np.add.at(edge, spans.last[sure] + window, -1)
        start, k1, _ = spans.windows(np.flatnonzero(_among(spans.h, owner, mixed)), second=False)
        again = start[_among(k1, _owner(counts, start), found)]
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        ends = np.cumsum(counts)
        rows = []
        for own, a, z in zip(split, (ends - counts).tolist(), ends.tolist(), strict=True):
            left = keep[a:z]
            kept = b" ".join(own if left.all() else [w for w, k in zip(own, left.tolist(), strict=True) if k])
            rows.append((z - a, z - a - int(left.sum()), kept))
        n, removed, kept = zip(*rows, strict=True)
        last = [k.decode("utf-8", "replace") for k in kept] if texts else [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string())], schema=_RESULT)


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (uid, keys) with the value of their key in ``known`` (keys, n: rows that have it, value).

    A key that more than one in HOT of the rows with known keys have, of which there are HOT at
    most, is looked up in a broadcast, and its rows are spread by uid; others by a join.
    """
    known = checkpoint(known)
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = known.where(F.col("n") * HOT > total)
    asked = rows.join(F.broadcast(hot.select(*keys, F.col("value").alias("_hot"))), keys, "left")
    asked = asked.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*keys, "uid")))
    rest = known.where(F.col("n") * HOT <= total).select(F.col(keys[0]).alias("_key"), *keys[1:], F.col("value").alias("_own"))
    found = asked.join(rest, ["_key", *keys[1:]], "left").withColumn("value", F.coalesce("_hot", "_own"))
    return found.where("value is not null").select(*rows.columns, "value")


def repeated(docs: DataFrame, window: int, lengths: Sequence[int]) -> DataFrame:
    """(uid, whole, mixed, found, alive_0, …): for each text with repeats the hashes of the anchors whose
    windows all recur, of those with different surroundings, and of their windows that recur; and the
    anchors that its candidates have at each level before."""
    alive: list[str] = []
    texts = docs
    own = functools.partial(functools.partial, window=window, lengths=lengths)
    for level in range(len(lengths) - 1):
        anchors = stored(texts.mapInArrow(own(_anchors), "uid long, h long, v long").select("uid", "h"))
        often = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").withColumn("value", F.lit(True))
        name = f"alive_{level}"
        held = looked_up(anchors, often, ["h"]).groupBy("uid").agg(F.collect_set("h").alias(name))
        # a text that a level leaves without candidates is done; the others bring their anchors along from here on
        texts = stored(texts.join(held, "uid").select("uid", "text", *alive, name))
        alive.append(name)
    anchors = texts.mapInArrow(own(_anchors), "uid long, h long, v long")
    often = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 1")
    often = often.select("h", "n", (F.col("low") == F.col("high")).alias("value"))
    met = looked_up(anchors.select("uid", "h"), often, ["h"]).withColumnRenamed("value", "same").groupBy("uid").agg(
        F.collect_set(F.when(F.col("same"), F.col("h"))).alias("whole"), F.collect_set(F.when(~F.col("same"), F.col("h"))).alias("mixed")
    )
    met = stored(met)
    open_ = texts.join(met.where(F.size("mixed") > 0).select("uid", "mixed"), "uid").select("uid", "text", "mixed", *alive)
    single = open_.mapInArrow(own(_resolve), "uid long, k1 long, k2 long")
    twice = single.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").withColumn("value", F.lit(True))
    back = looked_up(single, twice, ["k1", "k2"]).groupBy("uid").agg(F.collect_set("k1").alias("found"))
    met = met.join(back, "uid", "left")
    if alive:
        met = met.join(texts.select("uid", *alive).dropDuplicates(["uid"]), "uid")
    return met.select("uid", "whole", "mixed", "found", *alive)


def without_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False, first: int = FIRST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (or, with
    ``texts``, the kept words joined by one space as ``text``). ``first``: words of the shortest level.

    Words are runs of anything but ASCII white space. Each word is removed that a
    window covers whose words also start anywhere else, the same document and repeated
    rows included. Null and empty texts have no words; texts shorter than a window keep
    all. Null ids are kept as they are. An empty table gives no rows. Words are told apart by
    64-bit hashes, windows by two polynomial hashes of 64 bits with different bases and different
    word hashes, anchors' surroundings by 64 bits beside their own 64.
    """
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text")).withColumn("uid", F.xxhash64("text"))
    lengths = levels(window, first)
    found = repeated(rows.select("uid", "text"), window, lengths)
    all_ = rows.join(found, "uid", "left").select("doc_id", "text", *found.columns[1:])
    name = "text" if texts else "kept_sha256"
    done = all_.mapInArrow(functools.partial(_remove, window=window, lengths=lengths, texts=texts), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return done.withColumnRenamed("kept_sha256", name)
