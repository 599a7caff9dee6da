"""Lexical retrieval packing: documents that share rare words fill a window together.

Documents are dealt into shards of bounded size, near copies together: the shard
key is the smallest hash of a text's long words, and a key that holds many rows
is split over several shards. Each shard builds a BM25 inverted index. A seed
document takes the start of a window; the index returns its nearest unused
documents, which fill the window in that order. The document that does not fit is
cut, and its rest seeds the next window. What is left at a shard's end is cut into
sequences whose lengths are powers of two, so no position is padded.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import Encoder

WINDOW = 2048
#: Appended to every document's ids.
END = 1
#: Characters of text in a shard, about.
SHARD = 5_000_000
K1, B = 1.2, 0.75
#: Terms of more than one in so many documents of a shard are kept as whole rows; neighbours that are sorted first.
DENSE, FIRST = 16, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class Index:
    """BM25 inverted index of a shard.

    A term's weight is log((n - df + 0.5) / (df + 0.5)), not below zero: terms of one document
    find no other, and those of half of the documents or more weigh nothing; neither is kept.
    """

    def __init__(self, terms: np.ndarray, counts: np.ndarray, n_terms: int) -> None:
        """terms: those of all documents, one after the other; counts: per document."""
        self.n = len(counts)
        doc = np.repeat(np.arange(self.n), counts)
        keys, tf = np.unique(terms * self.n + doc, return_counts=True)
        term, doc = keys // self.n, keys % self.n
        df = np.bincount(term, minlength=n_terms)
        idf = np.maximum(np.log((self.n - df + 0.5) / (df + 0.5)), 0)
        size = K1 * (1 - B + B * counts / max(counts.mean(), 1e-9))
        keep = (df[term] > 1) & (idf[term] > 0)
        term, doc, tf = term[keep], doc[keep], tf[keep]
        weight = idf[term] * tf * (K1 + 1) / (tf + size[doc])
        by_doc = np.lexsort((term, doc))
        self.term_of = term[by_doc]
        self.doc_first = np.searchsorted(doc[by_doc], np.arange(self.n + 1))
        # terms of many documents as rows with a place for each, others as postings
        many = np.flatnonzero((df > max(self.n // DENSE, 1)) & (idf > 0))
        self.row = np.full(n_terms, -1)
        self.row[many] = np.arange(len(many))
        rows = self.row[term]
        self.dense = np.zeros((len(many), self.n))
        self.dense[rows[rows >= 0], doc[rows >= 0]] = weight[rows >= 0]
        thin = rows < 0
        self.doc, self.weight = doc[thin], weight[thin]
        self.first = np.searchsorted(term[thin], np.arange(n_terms + 1))

    def nearest(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; each of its terms asks once."""
        query = self.term_of[self.doc_first[seed] : self.doc_first[seed + 1]]
        if not len(query):
            return
        rows = self.row[query]
        scores = self.dense[rows[rows >= 0]].sum(0)
        query = query[rows < 0]
        if len(query):
            first, sizes = self.first[query], self.first[query + 1] - self.first[query]
            at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            scores += np.bincount(self.doc[at], self.weight[at], self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        if len(found) > FIRST:  # a window is mostly full after a few
            own = scores[found]
            least = np.partition(own, len(own) - FIRST)[len(own) - FIRST]
            head, found = found[own >= least], found[own < least]
            yield from head[np.argsort(-scores[head], kind="stable")].tolist()
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()


def windows(lengths: np.ndarray, index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); every position of every document once."""
    used = np.zeros(len(lengths), bool)
    sizes = lengths.tolist()
    made: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    space, pointer = window, 0

    def place(doc: int, start: int) -> int:
        """Put what fits; the start of the rest, or 0."""
        nonlocal space, now
        used[doc] = True
        take = min(space, sizes[doc] - start)
        now.append((doc, start, take))
        space -= take
        if not space:
            made.append(now)
            now, space = [], window
        return start + take if start + take < sizes[doc] else 0

    seed, rest = -1, 0
    while True:
        if seed < 0:
            while pointer < len(sizes) and used[pointer]:
                pointer += 1
            if pointer == len(sizes):
                break
            seed, rest = pointer, 0
        rest = place(seed, rest)
        if rest:
            continue
        if not now:
            seed = -1
            continue
        after = -1
        for doc in index.nearest(seed, used):
            rest = place(doc, 0)
            if not now or rest:
                after = doc if rest else -1
                break
        seed = after
    while now:
        take, part = 1 << (window - space).bit_length() - 1, []
        space += take
        while take:
            doc, start, n = now.pop(0)
            part.append((doc, start, min(n, take)))
            if n > take:
                now.insert(0, (doc, start + take, n - take))
            take -= min(n, take)
        made.append(part)
    return made


def _shard(encoder: Encoder, ids: list, texts: list[str], first: int, window: int) -> tuple[pa.RecordBatch, int]:
    numbers, counts = encoder.number(texts)
    tokens = [np.append(x, END).astype("<u4") for x in encoder.gather(texts, numbers, counts)]
    seen = np.zeros(len(encoder.words), bool)
    seen[numbers] = True
    words, place = np.flatnonzero(seen), (np.cumsum(seen) - 1)[numbers]
    names = [encoder.names[w].strip(_EDGE).lower() for w in words.tolist()]
    terms = {t: k for k, t in enumerate(dict.fromkeys(names))}
    term_of = np.fromiter(map(terms.__getitem__, names), np.int64, len(names))
    index = Index(term_of[place], counts, len(terms))
    made = windows(np.fromiter(map(len, tokens), np.int64, len(tokens)), index, window)
    rows = [
        (ids[doc], start, n, zlib.crc32(tokens[doc][start : start + n].tobytes()), len(tokens[doc]), first + k, offset)
        for k, sequence in enumerate(made)
        for (doc, start, n), offset in zip(sequence, np.cumsum([0, *(x[2] for x in sequence[:-1])]).tolist(), strict=True)
    ]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names), first + len(made)


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, shard: int, window: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    first = TaskContext.get().partitionId() << 32
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text or "")
            size += len(texts[-1]) + 100
            if size >= shard:
                made, first = _shard(encoder, ids, texts, first, window)
                yield made
                ids, texts, size = [], [], 0
    if ids:
        yield _shard(encoder, ids, texts, first, window)[0]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: empty) and END. Each id lies in
    exactly one piece. Repeated rows and rows with a null doc_id are packed like any
    other. Ties between neighbours go to the shard's order (key, doc_id, text). An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    long_words = F.regexp_extract_all(F.lower("text"), F.lit(r"\w{9,}"), F.lit(0))
    key = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    dealt = docs.select("doc_id", "text", key.alias("key")).hint("rebalance", F.col("key"))
    rows = dealt.sortWithinPartitions("key", "doc_id", "text").select("doc_id", "text")
    return rows.mapInArrow(functools.partial(_pack, path=path, shard=shard, window=window), SCHEMA)
