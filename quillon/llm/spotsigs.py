"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word (anchor) of a text starts a chain of the next two words that are
not common. The set of hashed chains is the text's fingerprint. Fingerprints are
compared by Jaccard likeness; where only likenesses from a threshold on count, sets
whose sizes already rule it out are not intersected.

``near_duplicates`` matches all documents: fingerprints are dealt to partitions by
set length, so wide that similar ones lie in one or in two that follow each other.
Within a partition fingerprints meet under the least of their signatures, as many as
must hold a common one; those that meet are compared by pruned likeness.
"""

from __future__ import annotations

import base64
import functools
import math
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.bpe import slices
from quillon.llm.common import checkpoint, connected_components, stored
from quillon.llm.simhash import meetings, prefix_pairs, verified
from quillon.llm.toxicity import _FOLD

#: Common words of English, French, German and Spanish, with which chains begin.
ANCHORS = """a an and are as at be been but by can did do does for from had has have he her his how i if in into is it its
may more no not of on or our out said she so some than that the their them then there these they this to up was we were what when
where which who will with would you your
au aux avec ce ces cette comme dans de des donc du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas plus
pour qu que qui sa se ses son sont sur tout un une vous y
aber als am an auch auf aus bei bin bis da das dass dem den der des die dies durch ein eine einem einen einer er es für hat ich ihr
im in ist ja man mit nach nicht noch nur ob oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wird zu zum zur
al como con cual del desde donde e el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy nos o para pero por
porque que se ser si sin sobre son su sus también todo un una uno y ya""".split()

LINKS = 2
#: Bytes of text in a part of the documents, on average.
PART = 8_000_000
#: Characters of text handled at a time.
SLICE = 2_000_000
#: Likeness from which ``near_duplicates`` links fingerprints.
LIKENESS = 0.8
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Chains:
    """Fingerprints of texts as sorted arrays of 32-bit hashes."""

    def __init__(self, most: int = 300_000) -> None:
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.common = np.zeros(0, bool)
        self._add([x.encode() for x in ANCHORS])

    def _add(self, words: Iterable[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.numbers]
        common = not self.numbers
        for w in new:
            self.numbers[w] = len(self.numbers)
        self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64)])
        self.common = np.concatenate([self.common, np.full(len(new), common)])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.most:
            self._clear()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        split = [t.translate(_FOLD).split() for t in raw]
        self._add(w for words in split for w in words if w not in self.numbers)
        found = []
        for text, words in zip(raw, split, strict=True):
            if not words:
                found.append(np.array([xxhash.xxh32_intdigest(text)] if text else [], np.uint32))
                continue
            at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            common = self.common[at]
            content = np.flatnonzero(~common)
            starts = np.flatnonzero(common)
            after = np.searchsorted(content, starts)
            starts, after = starts[after < len(content)], after[after < len(content)]
            if not len(starts):  # no chain: every word starts one
                content = np.arange(len(words))
                starts, after = content, content + 1
            hashes = np.append(self.hashes[at], np.zeros(1, np.uint64))
            content = np.append(content, np.full(LINKS, len(words)))
            mixed = hashes[starts]
            for k in range(LINKS):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[content[np.minimum(after + k, len(content) - 1)]]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            found.append(np.unique((mixed >> np.uint64(32)).astype(np.uint32)))
        return found


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two fingerprints; 0 without intersecting them if their sizes keep it under ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def write(print_: np.ndarray) -> str:
    return base64.b64encode(print_.astype("<u4").tobytes()).decode()


class _Row:
    __slots__ = ("id", "print", "text")

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.id, self.text, self.print = doc_id, text or "", None


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Row, _Row]]:
    """Each document with the next one. Rows come by part, then a part's own rows in order,
    then copies of the row that follows the part."""
    part = first = last = None
    for batch in batches:
        for p, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if last is not None:
                    yield last, first
                part = p
                first = last = None
                closed = False
            if closed:
                continue
            row = _Row(doc_id, text)
            if last is not None:
                yield last, row
            last, closed = (None, True) if tail else (row, False)
            first = first or row
    if last is not None:
        yield last, first


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chains = Chains()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def done(pairs: list[tuple[_Row, _Row]]) -> pa.RecordBatch:
        edited = []
        for own, after in pairs:
            cut = len(own.text) // 4
            edited.append(own.text[: len(own.text) - cut] + after.text[:cut])
        missing = list({id(r): r for pair in pairs for r in pair if r.print is None}.values())
        prints = chains.of([r.text for r in missing] + edited)
        for row, found in zip(missing, prints, strict=False):
            row.print = found
        rows = [
            (own.id, len(own.text), hashlib.sha256(text.encode()).hexdigest(), write(own.print), write(x), jaccard(own.print, x), jaccard(own.print, after.print))
            for (own, after), text, x in zip(pairs, edited, prints[len(missing) :], strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    now: list[tuple[_Row, _Row]] = []
    size = 0
    for pair in _pairs(batches):
        now.append(pair)
        size += len(pair[0].text) + 100
        if size > SLICE:
            yield done(now)
            now, size = [], 0
    if now:
        yield done(now)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): base64 of the sorted 32-bit hashes; a null text counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()
        for batch in batches:
            for a, z in slices(pc.utf8_length(batch.column(1)).fill_null(0).to_pylist(), SLICE):
                prints = chains.of([t or "" for t in batch.column(1)[a:z].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array([write(x) for x in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, fingerprint string")


def with_edited(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, compared with its edited text and the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document by (doc_id, text); the first follows the
    last, and rows without an id follow those with one. Texts without any word have
    the hash of the text as fingerprint, empty and null texts an empty one, which is
    like another empty one only. An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 100), F.lit(0))).first()[0]
    n = int(size // PART) + 1
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(n)], max(10_000, 20 * n)).alias("x"), F.min("doc_id").alias("least")).first()
    bounds = np.array(sorted({found.least, *found.x}) if found.x else [], np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def deal(ids):
        """The part of a row, and the part that it follows if it is the first of its own."""
        made = []
        for x in ids:
            if x != x or not len(bounds):
                made.append([max(len(bounds) - 1, 0)])
                continue
            p = int(np.searchsorted(bounds, int(x), "right")) - 1
            made.append([p, (p - 1) % len(bounds)] if int(x) == bounds[p] else [p])
        import pandas as pd

        return pd.Series(made)

    dealt = docs.select("doc_id", "text", F.posexplode(deal("doc_id")).alias("tail", "part"))
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(_compare, SCHEMA)


def read(print_: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(print_), "<u4")


def size_partition(n: int, least: float) -> int:
    """Number of the partition of sets of n; sets as like as ``least`` are in one or in neighbours."""
    return int(math.log(n) / -math.log(least) + 1e-9)


def _keys(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(uid, key, n): each fingerprint of n signatures under its least ones, in its own and in the next partition."""
    for batch in batches:
        uids, keys, sizes = [], [], []
        for uid, print_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = read(print_)
            n = len(found)
            if n:
                prefix = np.sort(found)[: n - math.ceil(least * n - 1e-9) + 1].astype(np.uint64)
                p = size_partition(n, least)
                own = np.concatenate([(prefix + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q) * np.uint64(0xD6E8FEB86659FD93) for q in (p, p + 1)])
                keys.append(own.view(np.int64))
                uids.append(np.full(len(own), uid, np.int64))
                sizes.append(np.full(len(own), n, np.int64))
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (uids, keys, sizes)], names=["uid", "key", "n"])


def classes(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(uid, class_id) of every fingerprint, by the hash of its text: the smallest doc_id that links of ``least``
    likeness or more reach.

    Fingerprints are dealt to partitions by size and meet under their least signatures; pairs that
    meet are compared by pruned Jaccard. Groups of more than simhash.SMALL fingerprints that meet are
    compared with one representative; those of a group that are not like it are compared with all of its
    members by their rarest signatures (``simhash.prefix_pairs``), so no link between two classes is lost.
    Empty fingerprints are like each other only. A class without any id has a null class_id.
    """
    own = fingerprints(docs).withColumn("uid", F.xxhash64("fingerprint"))
    own = stored(own.groupBy("uid").agg(F.min("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least")))
    met = meetings(own.select("uid", "fingerprint").mapInArrow(functools.partial(_keys, least=least), "uid long, key long, n long"))
    sets = own.select("uid", F.unbase64("fingerprint").alias("shingles"))

    @F.pandas_udf("boolean")
    def like(a, b):
        import pandas as pd

        return pd.Series([jaccard(read(x), read(y), least) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    left, right = own.select(F.col("uid").alias("u"), F.col("fingerprint").alias("x")), own.select(F.col("uid").alias("v"), F.col("fingerprint").alias("y"))
    linked = verified(
        met,
        lambda pairs: pairs.join(left, "u").join(right, "v").where(like("x", "y")).select("u", "v"),
        lambda stay, members: prefix_pairs(sets, stay, members, least),
        least,
    )
    linked = functools.reduce(DataFrame.union, linked, docs.sparkSession.createDataFrame([], "u long, v long"))
    roots = connected_components(linked, "u", "v")
    named = own.join(roots, own.uid == roots.node, "left").select("uid", "least", F.coalesce("root", "uid").alias("root"))
    return checkpoint(named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("uid", "class_id"))


def near_duplicates(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (see ``classes``). Repeated rows each give a row, null ids too.
    An empty table gives no rows."""
    rows = fingerprints(docs).select("doc_id", F.xxhash64("fingerprint").alias("uid"))
    return rows.join(classes(docs, least), "uid").select("doc_id", "class_id")


def with_classes(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """The rows of ``with_edited`` with the column class_id, the class of the document's own fingerprint."""
    rows = with_edited(docs).withColumn("_uid", F.xxhash64("fingerprint"))
    return rows.join(classes(docs, least).withColumnRenamed("uid", "_uid"), "_uid").drop("_uid")
