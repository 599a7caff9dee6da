"""LM scoring: a causal self-attention model on subword ids scores whole texts.

P(word | before) = P(class of its first subword | before) * P(first subword | class) *
P(word | first subword). The first factor comes from the attention model; the others
from counts over all training texts, where words that never occurred are spelt with
subwords. Work is dealt in blocks of documents, whose words are numbered and written once.
A block sends every distinct word once, by hash, to the bucket that adds its count over all
blocks, and gets the sum back. Every window of every training text trains the model, in one
of the rounds; replicas of the model train where their blocks lie and are averaged after each round.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import ClassVar

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import attention as A
from quillon.llm.bpe import RANKS, cut, encoded, loaded
from quillon.llm.common import checkpoint, remainder, row_blocks, utf8

#: Bytes of text in a block of documents, and blocks whose windows one replica of the model sees, about.
BLOCK, SHARE = 12_000_000, 4
#: Each training window is seen in one of the rounds, whose learning rates these are.
ROUNDS = (0.01, 0.01, 0.005, 0.002)
PIECES = 50257
#: Groups of rarer first subwords.
GROUPS = 64
CHUNK = 4096
#: Classes, by id, of neighbouring subwords in a word; the last is the word's end. Weight of the unconditional share.
NEAR, PRIOR = 1021, 10.0
_SENT = "kind int, key long, block long, a binary, b binary"
_CHUNKS = "chunk int, weight double, a binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


class Vocabulary:
    """Classes, slots and counts of subwords; all of them bounded by the tokenizer."""

    def __init__(self, first: np.ndarray, rest: np.ndarray, kinds: np.ndarray, after: np.ndarray, words: int, texts: int) -> None:
        """first: how often each subword starts a word; kinds: distinct words that start with
        it; texts: how many there are, in training texts. rest, after, words: how often each
        subword continues a word, one class of subwords follows another, and words end, where
        each block's training texts count a word once."""
        order = np.lexsort((np.arange(PIECES), -(first + rest)))
        self.slot = 1 + A.FREQUENT + np.arange(PIECES) % (A.SLOTS - 1 - A.FREQUENT)
        self.slot[order[: A.FREQUENT]] = 1 + np.arange(A.FREQUENT)
        # single classes for the most frequent first subwords, groups of equal weight for the others in order of id
        single = np.lexsort((np.arange(PIECES), -first))[: A.CLASSES - 1 - GROUPS]
        self.cls = np.full(PIECES, -1, np.int64)
        self.cls[single] = 1 + np.arange(len(single))
        others = np.flatnonzero(self.cls < 0)
        mass = np.cumsum(first[others] + 0.1)
        self.cls[others] = 1 + len(single) + np.minimum((mass / mass[-1] * GROUPS).astype(np.int64), GROUPS - 1)
        smooth = first + 0.1
        weight = np.bincount(self.cls, smooth, A.CLASSES)
        self.in_class = np.log(smooth / weight[self.cls])
        weight[0] = texts + 0.1
        self.bias = np.log(np.maximum(weight, 0.1) / weight.sum())
        self.first, self.kinds = first.astype(float), kinds.astype(float)
        near = np.bincount(np.arange(PIECES) % NEAR, rest + 0.1, NEAR + 1)
        near[NEAR] = words + 0.1
        after = after.reshape(NEAR + 1, NEAR + 1) + PRIOR * near / near.sum()
        self.after = np.log(after / after.sum(1, keepdims=True)).astype(np.float32)
        self.in_near = np.log((rest + 0.1) / near[np.arange(PIECES) % NEAR])

    def spelt(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First subword of each word, and the log-probability of the other subwords and the word's end."""
        if not len(sizes):
            return ids, np.zeros(0)
        starts = np.cumsum(sizes) - sizes
        here = ids % NEAR
        then = np.append(here[1:], NEAR)
        then[starts[1:] - 1] = NEAR
        own = self.in_near[ids]
        own[starts] = 0
        return ids[starts], np.add.reduceat(self.after[here, then] + own, starts)

    def given_first(self, count: np.ndarray, first: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """log P(word | first subword): its count, and its spelling by the share of new words."""
        kinds = self.kinds[first] + 0.5
        return np.log((count + kinds * np.exp(spelling)) / (self.first[first] + kinds))


class Words:
    """Distinct words of blocks, numbered, with hashes and subword ids."""

    def __init__(self, path: str | None) -> None:
        self.bpe, self.bytes_of = loaded(path or public_tokenizers.path(RANKS))

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Number of each word, words per text, hash per number, and the words."""
        # Arrow lowers A-Z and splits at the same characters as bytes.split(), which leaves no empty words
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
        ends, words = split.offsets.to_numpy(), split.flatten()
        real = pc.greater(pc.binary_length(words), 0)
        before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
        coded = words.filter(real).dictionary_encode()
        names = coded.dictionary.view(pa.binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        return coded.indices.to_numpy().astype(np.int64), np.diff(before[ends]), hashes, names

    def subwords(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the words, one word after the other, and how many each has."""
        if not names:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = b" ".join(names).decode("utf-8", "replace").split(" ")
        odd = [k for k, w in enumerate(words) if w.strip() != w]  # the pattern cuts them at other white space
        alone = {k: encoded(self.bpe, " " + words[k]) for k in odd}
        plain = [w for k, w in enumerate(words) if k not in alone] if odd else words
        ids, some = cut(self.bpe, self.bytes_of, plain) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if not odd:
            return ids.astype(np.int64), some
        sizes = np.zeros(len(words), np.int64)
        sizes[np.setdiff1d(np.arange(len(words)), odd)] = some
        begin = np.cumsum(sizes)[odd]  # where they go among the others
        sizes[odd] = [len(alone[k]) for k in odd]
        return np.insert(ids, np.repeat(begin, sizes[odd]), np.concatenate([alone[k] for k in odd])).astype(np.int64), sizes


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _sparse(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of what is not zero."""
    some = np.flatnonzero(counts)
    return packed([some.astype("<i8")]), packed([counts[some].astype("<i8")])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(x, ["<i8"])[0]) for x in (a, b)], names=["k", "n"])


def _totals(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of all rows' counts, added up by Spark place by place; the tokenizer bounds ``size``."""
    sums = rows.select("a", "b").mapInArrow(_unpacked, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(size, np.int64)
    found[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    return found


def _buckets(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the distinct words by bucket and hash, and the bounds of the buckets."""
    bucket = (hashes >> np.uint64(40)) % np.uint64(n)
    order = np.lexsort((hashes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers as compressed bytes, those of equal weight together."""
    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays)
    head = np.array([len(raw), *(len(x) for x in arrays)], "<i8").tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    """What ``packed`` made of arrays of these kinds."""
    size, *lengths = np.frombuffer(data, "<i8", len(kinds) + 1).tolist()
    raw = np.frombuffer(pa.decompress(data[8 * len(kinds) + 8 :], size, codec="zstd", asbytes=True), np.uint8)
    found, at = [], 0
    for n, kind in zip(lengths, map(np.dtype, kinds), strict=True):
        part = raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n)
        found.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return found


@dataclass
class Block:
    """Documents of a block: their words by number and, of each distinct word, its subwords and
    its place among the words that were sent out to buckets."""

    ids: np.ndarray
    no_id: np.ndarray
    train: np.ndarray
    uid: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray
    order: np.ndarray

    KINDS: ClassVar[list[str]] = ["<i8", "u1", "u1", "<u8", "<u4", "<u4", "<u4", "<u2", "<u4"]

    def write(self) -> bytes:
        return packed([np.asarray(getattr(self, f.name)).astype(k) for f, k in zip(fields(self), self.KINDS, strict=True)])

    @classmethod
    def read(cls, data: bytes) -> Block:
        return cls(*(x if k == "<u8" else x.astype(np.int64) for x, k in zip(unpacked(data, cls.KINDS), cls.KINDS, strict=True)))


#: Hashes (differences in order), counts and first subwords of a block's words in a bucket.
_ENTRIES = ["<u8", "<u4", "<u2"]


def _block(number_of: int, columns: list[list], path: str | None, buckets: int) -> pa.RecordBatch:
    """What a block sends: kind 0, its distinct words with counts and first subwords, by
    bucket; 1, histograms of subwords; 2, its documents."""
    ids, texts, train, uids = columns
    train = np.array(train, bool)
    words = Words(path)
    number, counts, hashes, names = words.split(texts)
    flat, sizes = words.subwords(names)
    begin = np.cumsum(sizes) - sizes
    c = np.bincount(number[np.repeat(train, counts)], minlength=len(names))
    order, bounds = _buckets(hashes, buckets)
    h, n, f = hashes[order], c[order], flat[begin][order]
    spans = [(b, slice(x, y)) for b, (x, y) in enumerate(itertools.pairwise(bounds.tolist())) if x < y]
    rows = [(0, b, number_of, packed([np.diff(h[at], prepend=np.uint64(0)), n[at].astype("<u4"), f[at].astype("<u2")]), None) for b, at in spans]
    first = np.bincount(flat[begin], c, PIECES) if len(names) else np.zeros(PIECES)
    once = np.repeat(np.minimum(c, 1), sizes)  # new words look like distinct words, not like frequent ones
    rest = np.bincount(flat, once, PIECES) - (np.bincount(flat[begin], np.minimum(c, 1), PIECES) if len(names) else 0)
    then = np.append(flat[1:] % NEAR, NEAR)
    then[begin[1:] - 1] = NEAR
    after = np.bincount((flat % NEAR) * (NEAR + 1) + then, once, (NEAR + 1) ** 2) if len(names) else np.zeros((NEAR + 1) ** 2)
    rows.append((1, -1, number_of, *_sparse(np.concatenate([first, rest, [c.sum(), train.sum(), np.minimum(c, 1).sum()], after]))))
    no_id = np.array([d is None for d in ids], np.uint8)
    own = Block(np.array([d or 0 for d in ids], np.int64), no_id, train, np.array(uids, np.int64).view(np.uint64), counts, number, sizes, flat, order)
    rows.append((2, -1, number_of, own.write(), None))
    return _batch(rows, _SENT)


def _gather(batches: Iterator[pa.RecordBatch], path: str | None, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's rows (doc_id, text, train, uid); their numbers begin with the partition's."""
    first = TaskContext.get().partitionId() << 32
    for k, columns in enumerate(row_blocks(batches, 1, BLOCK)):
        yield _block(first + k, columns, path, buckets)


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of a bucket's words, back to the blocks (kind 0), and what is to know of all (kind 1)."""
    parts = [unpacked(x, _ENTRIES) for x in table.column("a").to_pylist()]
    _, c, f = (np.concatenate(x) for x in zip(*parts, strict=True))
    h, place = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts]), return_inverse=True)
    total = np.zeros(len(h), np.uint64)
    np.add.at(total, place, c.astype(np.uint64))
    first = np.zeros(len(h), np.int64)
    first[place] = f
    known = total > 0
    kinds = np.bincount(first[known], minlength=PIECES)
    cuts = np.cumsum([len(x[0]) for x in parts])[:-1]
    b = key[0].as_py()
    rows = [(0, b, block, packed([t.astype("<u8")]), None) for block, t in zip(table.column("block").to_pylist(), np.split(total[place], cuts), strict=True)]
    rows.append((1, -1, b, *_sparse(np.append(kinds, known.sum()))))
    return pa.Table.from_batches([_batch(rows, _SENT)])


def _windows(vocabulary: Vocabulary, own: Block, turn: int) -> A.Windows:
    """Windows of a block's training texts that are dealt to a round by a hash of text and place."""
    n = own.counts + 2  # a start, the words, an end
    first = np.cumsum(n) - n
    many = np.where(own.train > 0, 1 + -(-np.maximum(own.counts + 1 - A.WIDTH, 0) // A.STRIDE), 0)
    doc = np.repeat(np.arange(len(n)), many)
    start = A.STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
    drawn = (own.uid[doc] * np.uint64(0x9E3779B97F4A7C15) + (start + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
    doc, start = (x[drawn % np.uint64(len(ROUNDS)) == turn] for x in (doc, start))
    # a word's number; then what leads to the first word, the end, and what is after it
    words = len(own.sizes)
    line = np.full(int(n.sum()) + A.WIDTH + 1, words + 2, np.int64)
    inner = np.ones(int(n.sum()), bool)
    inner[first], inner[first + n - 1] = False, False
    line[np.flatnonzero(inner)] = own.number
    line[first], line[first + n - 1] = words, words + 1
    where = (first[doc] + start)[:, None] + np.arange(A.WIDTH + 1)
    inside = where < (first + n)[doc][:, None]
    line = np.where(inside, line[where], words + 2)
    begin = np.cumsum(own.sizes) - own.sizes
    lead = np.append(vocabulary.cls[own.flat[begin]] if words else np.zeros(0, np.int64), [0, 0, 0])
    weight = (inside[:, 1:] & (np.arange(A.WIDTH) >= np.where(start > 0, A.WIDTH - A.STRIDE, 0)[:, None])).astype(np.float32)
    # inputs: all but the last position; a start has one slot, the end none
    slots = np.append(vocabulary.slot[own.flat], A.BOS)
    begin, sizes = np.append(begin, [len(own.flat)] * 3), np.append(own.sizes, [1, 0, 0])
    given = line[:, :-1].ravel()
    size = sizes[given]
    at = np.repeat(begin[given] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return A.Windows(slots[at], size, lead[line[:, 1:]], weight)


def _replica(batches: Iterator[pa.RecordBatch], state: bytes, vocabulary: Vocabulary, rate: float, turn: int) -> Iterator[pa.RecordBatch]:
    """Parameters times the weight of the windows that a partition's blocks train them with, block after block."""
    weight = 0.0

    def parts() -> Iterator[A.Windows]:
        nonlocal weight
        for batch in batches:
            for data in batch.column(0):
                made = _windows(vocabulary, Block.read(data.as_py()), turn)
                weight += float(made.weight.sum(dtype=np.float64))
                yield made

    made = A.flat(A.train(A.unflat(np.frombuffer(state, np.float32), A.fresh(vocabulary.bias)), parts(), turn, rate))
    if weight:
        sums = (made * weight).astype("<f4")
        yield _batch([(k, weight, sums[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in range(-(-len(sums) // CHUNK))], _CHUNKS)


def _average(key: tuple, table: pa.Table) -> pa.Table:
    weight = sum(table.column("weight").to_pylist())
    total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("a").to_pylist())
    return pa.Table.from_batches([_batch([(key[0].as_py(), weight, (total / max(weight, 1e-9)).astype("<f4").tobytes())], _CHUNKS)])


def fit(blocks: DataFrame, vocabulary: Vocabulary) -> bytes:
    """Parameters after all rounds. Each round's replicas, one for each partition of ``blocks``
    (a), train from the same state; the driver gets their average only, whose size is fixed."""
    state = A.flat(A.fresh(vocabulary.bias)).astype("<f4").tobytes()
    for turn, rate in enumerate(ROUNDS):
        step = functools.partial(_replica, state=state, vocabulary=vocabulary, rate=rate, turn=turn)
        made = blocks.mapInArrow(step, _CHUNKS)
        mean = made.groupBy("chunk").applyInArrow(_average, _CHUNKS).orderBy("chunk").collect()
        if mean and mean[0].weight > 0:
            state = b"".join(bytes(r.a) for r in mean)
    return state


def _score(key: tuple, own: pa.Table, sums: pa.Table, state: bytes, vocabulary: Vocabulary) -> pa.Table:
    own = Block.read(own.column("a")[0].as_py())
    params = A.unflat(np.frombuffer(state, np.float32), A.fresh(vocabulary.bias))
    total = {b: unpacked(x, ["<u8"])[0].astype(np.int64) for b, x in zip(sums.column("key").to_pylist(), sums.column("a").to_pylist(), strict=True)}
    number, counts, flat, sizes = own.number, own.counts, own.flat, own.sizes
    c = np.empty(len(sizes), np.int64)
    c[own.order] = np.concatenate([total[b] for b in sorted(total)]) if total else 0
    first, spelling = vocabulary.spelt(flat, sizes)
    fixed = vocabulary.in_class[first] + vocabulary.given_first(c, first, spelling)
    cls = vocabulary.cls[first]
    x = A.embed(params["E"], vocabulary.slot[flat], sizes)
    x = np.concatenate([x, params["E"][A.BOS][None]])  # the last row comes before a text's first word
    known, base = c > 0, np.log10(c + 0.1)
    doc_ids = [None if no else d for d, no in zip(own.ids.tolist(), own.no_id.tolist(), strict=True)]
    train = own.train.astype(bool).tolist()
    rows, ends = [], np.cumsum(counts)
    size, a = 0, 0
    for k, n in enumerate(counts.tolist()):
        size += n + 1
        if size < 60_000 and k + 1 < len(counts):
            continue
        here = number[ends[a - 1] if a else 0 : ends[k]]
        some = counts[a : k + 1]
        stops = np.cumsum(some)  # where an end is put after the words, a start before them
        places = np.insert(here, stops - some, len(x) - 1)
        targets = np.insert(cls[here], stops, 0)
        lp = A.score(params, x, places, targets, some + 1) + np.insert(fixed[here], stops, 0.0)
        cuts = np.cumsum(some + 1) - (some + 1)
        score = np.add.reduceat(lp, cuts) / math.log(10)
        first_word = stops - some
        both = [np.append(0, np.cumsum(v)) for v in (base[here], known[here])]
        for j in range(len(some)):
            p, q = first_word[j], stops[j]
            rows.append((doc_ids[a + j], not train[a + j], int(some[j]) + 1, int(both[1][q] - both[1][p]), float(both[0][q] - both[0][p]), float(score[j])))
        a, size = k + 1, 0
    return pa.Table.from_batches([_batch(rows, _SCORED)])


def lm_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (both log10).

    A-Z are lower-cased; a text's tokens are its words and one end. Null texts count as
    empty: their only token is the end. A null id counts as the empty string for the
    remainder that holds texts out. Repeated rows count, and are scored, each. Without
    any training text, N and V are 0 and the model is its smoothing. Words are told apart
    by 64-bit hashes. An empty table gives no rows.
    """
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"), (remainder(F.col("doc_id"), 10) != 0).alias("train"))
    rows = rows.withColumn("uid", F.xxhash64("text", "doc_id"))
    size, n_train = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    blocks = size // BLOCK + 1
    buckets, parts = max(1, blocks // 2) * 4, int(blocks // SHARE) + 1
    # every later step reads what the blocks send, not the texts
    dealt = rows.repartitionById(parts, F.pmod("uid", F.lit(parts)).cast("int")).select("doc_id", "text", "train", "uid")
    sent = checkpoint(dealt.mapInArrow(functools.partial(_gather, path=path, buckets=buckets), _SENT))
    back = checkpoint(sent.where("kind = 0").groupBy("key").applyInArrow(_add, _SENT))
    every = _totals(sent.where("kind = 1"), 2 * PIECES + 3 + (NEAR + 1) ** 2)
    counts, after = every[: 2 * PIECES + 3], every[2 * PIECES + 3 :].astype(float)
    *kinds, distinct = _totals(back.where("kind = 1"), PIECES + 1).tolist()
    kinds = np.array(kinds, np.int64)
    first, rest, (n_words, n_texts, n_once) = counts[:PIECES], counts[PIECES : 2 * PIECES], counts[2 * PIECES :]
    vocabulary = Vocabulary(first, rest, kinds, after, int(n_once), int(n_texts))
    own = sent.where("kind = 2")
    state = fit(own.select("a"), vocabulary)
    n, v = int(n_words + n_texts), distinct + (n_texts > 0)
    score = functools.partial(_score, state=state, vocabulary=vocabulary)
    replies = back.where("kind = 0").select("key", "block", "a")
    scored = own.select("block", "a").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda key, own, sums: score(key, own, sums), _SCORED)
    norm = math.log10(n + 0.1 * (v + 1))
    end = math.log10(n_texts + 0.1)
    known = F.col("n_known") + F.lit(int(n_texts > 0))
    base = F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(norm)
    return scored.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

