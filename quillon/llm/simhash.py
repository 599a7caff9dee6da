"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2 bits apart share a value that is at most 1 bit from
both. Every distinct fingerprint therefore emits itself and its 64 one-bit
variants; equal variants meet in one shuffle, and neighbours in a variant's
group (in order) are verified and linked. A group holds 65 fingerprints at most,
as its members are one-bit variants of one value. The chain of neighbours has
the same components as all pairs of the group, so no pairs are enumerated.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import checkpoint, connected_components, fresh, utf8

#: Seed of XXH64, and bits that the radius of 2 is halved to.
SEED = 42
#: Copies of texts: words of a shingle and least likeness; fingerprints of a text and their bits;
#: bands of least hashes of a text, and hashes of a band. Texts of likeness x meet in a band with
#: probability 1 - (1 - x ** DEEP) ** BANDS, whatever the edits: 0.9998 at 0.8.
WORDS, LIKENESS = 5, 0.8
TABLES, BITS = 4, 32
BANDS, DEEP = 16, 4
#: Texts of a group whose pairs are all compared; growth of the representatives from round to round.
SMALL, GROWTH = 16, 8


def simhash(text: bytes, shingle: int = 3) -> int:
    """Majority of the XXH64 values of all shingles, repeats included, as an unsigned number.

    A-Z are lower-cased. Fewer words than a shingle: the whole sequence; no word: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:z], SEED) for a, z in spans], np.dtype("<u8"))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    ones = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(ones.view(np.dtype("<u8"))[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long; a null text counts as empty."""

    @F.pandas_udf(T.LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.select("doc_id", of(utf8(F.col("text"))).alias("fp"))


def ball(bits: int) -> Column:
    """A fingerprint and its one-bit variants."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array("fp"), flips)


def links(distinct: DataFrame, bits: int = 64) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints (column fp) at most 2 bits apart."""
    near = distinct.select("fp", F.explode(ball(bits)).alias("near"))
    met = near.select(F.col("fp").alias("b"), F.lag("fp").over(Window.partitionBy("near").orderBy("fp")).alias("a"))
    met = met.where("a is not null").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most 2 bits.
    Texts without words have fingerprint zero and are linked like any other. Rows
    with a null doc_id are fingerprinted and linked; a component whose ids are all
    null has a null component_id. Repeated rows each give a row. An empty table
    gives no rows.
    """
    prints = checkpoint(fingerprints(docs, shingle))
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(own.select("fp")), "a", "b")
    named = own.join(roots, own.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select(F.col("fp").alias("key"), "component_id")
    found = prints.join(classes, prints.fp == classes.key)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 values of all shingles; the whole sequence, if there are fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The set of shingles that likeness is taken of, by 32 bits of their hashes."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4"))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """TABLES fingerprints of BITS bits: majorities of the bits of hashes mixed in as many ways."""
    counts = np.zeros((TABLES // 2, 64), np.int64)
    for k in range(0, len(hashes), 65536):
        for t in range(TABLES // 2):
            x = hashes[k : k + 65536]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * t)
            x ^= x >> np.uint64(29)
            counts[t] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<u4").ravel()


def _bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the least of the hashes, mixed in DEEP ways."""
    draw = np.random.Generator(np.random.PCG64(SEED + DEEP))
    flips, factors = draw.integers(0, 2**64, (2, BANDS * DEEP, 1), np.uint64)
    least = np.full(BANDS * DEEP, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1024):
        x = (hashes[k : k + 1024] ^ flips) * (factors | np.uint64(1))
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, DEEP))], np.uint64).view(np.int64)


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(uid, prints, bands, n) of each text: its hash, TABLES fingerprints that carry their table's
    number above the bits, and the keys of BANDS bands and the number of its shingles of ``words`` words."""

    @F.pandas_udf("struct<prints: array<bigint>, bands: array<bigint>, n: bigint>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                split = text.lower().split()
                prints = _majority(_shingles(split, 3)).astype(np.int64) + (np.arange(TABLES, dtype=np.int64) << BITS)
                own = _shingles(split, words)
                rows.append((prints.tolist(), _bands(own).tolist(), len(_distinct(own))))
            yield pd.DataFrame(rows, columns=["prints", "bands", "n"])

    text = utf8(F.col("text"))
    return docs.select(F.xxhash64(text).alias("uid"), of(text).alias("p")).select("uid", "p.*")


def shingle_sets(docs: DataFrame, uids: DataFrame, words: int = WORDS) -> DataFrame:
    """(uid, shingles): the hashes of all shingles of the texts that ``uids`` names."""

    @F.pandas_udf("binary")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_distinct(_shingles(t.lower().split(), words)).tobytes() for t in batch])

    text = utf8(F.col("text"))
    found = docs.select(F.xxhash64(text).alias("uid"), text.alias("text")).join(uids, "uid", "left_semi").dropDuplicates(["uid"])
    return found.select("uid", of("text").alias("shingles"))


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard likeness of two texts' sets of shingles."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def meetings(each: DataFrame) -> DataFrame:
    """Texts (uid, key, other columns) that meet others under a key, how many these are (size), and a
    hash of their set (same), by which keys with the same texts are told."""
    group = Window.partitionBy("key")
    own = each.withColumns({"size": F.count("*").over(group), "same": F.bit_xor(F.xxhash64("uid")).over(group)})
    return checkpoint(own.where("size > 1"))


def verified(
    met: DataFrame,
    alike: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    least: float = 0.0,
    small: int = SMALL,
) -> list[DataFrame]:
    """Links (u, v) among texts that meet; ``alike`` keeps the pairs (u, v) that are copies.

    All pairs of a small group are compared, once for all keys with the same texts. Those of a larger one are compared with its
    representatives, texts that meet most others; those that are copies of one leave the group,
    the others stay for the next round, which has GROWTH times as many representatives, until no
    group is left. Texts that are both linked to a third are not compared, and a group of such
    texts is done. No pair is compared twice, nor one whose sets' sizes (column n of ``met``, if
    any) rule out a likeness of ``least``.

    Instead, ``rest`` can give the pairs to compare after the first round, from those that stay
    (uid) and all members of their groups (uid, root: the component so far). A group in one
    component is done. Links of the first round are then given by their components.
    """
    if "n" not in met.columns:
        met = met.withColumn("n", F.lit(1))
    links, turn, named, central, before = [], 0, None, None, []
    fits = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    pair = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")

    def compared(asked: DataFrame) -> DataFrame:
        if before:
            asked = asked.join(functools.reduce(DataFrame.union, before), ["u", "v"], "left_anti")
        if named is not None:
            for end in "uv":
                asked = asked.join(named.select(F.col("uid").alias(end), F.col("root").alias("of_" + end)), end, "left")
            asked = asked.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v")
        before.append(checkpoint(asked))
        return checkpoint(alike(before[-1]))

    while not met.isEmpty():
        few, many = met.where(F.col("size") <= small), met.where(F.col("size") > small)
        if central is None:
            central = checkpoint(many.groupBy("uid").agg(F.sum("size").alias("weight")))
        few = few.join(few.groupBy("size", "same").agg(F.min("key").alias("key")), ["size", "same", "key"], "left_semi")
        pairs = few.select("key", F.col("uid").alias("u"), "n").join(few.select("key", F.col("uid").alias("v"), F.col("n").alias("m")), "key")
        pairs = pairs.where("u < v").where(fits).select("u", "v")
        best = F.min(F.struct((-F.col("weight")).alias("w"), "uid", "n"))
        part = F.pmod(F.xxhash64("uid"), F.lit(GROWTH**turn)).alias("part")
        first = many.join(central, "uid").groupBy("key", part).agg(best.alias("b")).select("key", F.col("b.uid").alias("u"), F.col("b.n").alias("m"))
        across = many.select("key", F.col("uid").alias("v"), "n").join(first, "key").where("u <> v")
        across = checkpoint(across.withColumn("fits", fits).select("key", "u", "v", "fits"))
        links.append(compared(pairs.union(across.where("fits").select(*pair)).distinct()))
        if across.isEmpty():
            break
        ends = functools.reduce(DataFrame.union, links)
        if rest is None:
            both = ends.union(ends.select("v", "u")).toDF("uid", "other")
            named = checkpoint(both.groupBy("uid").agg(F.least("uid", F.min("other")).alias("root")))
        else:
            named = connected_components(ends, "u", "v").toDF("uid", "root")
        gone = across.select("key", "v", *pair[:1], pair[1].alias("w")).join(ends.select("u", F.col("v").alias("w")), ["u", "w"], "left_semi").select("key", F.col("v").alias("uid"))
        gone = gone.union(across.select("key", "u"))
        left = many.select("key", "uid", "n").join(gone.distinct(), ["key", "uid"], "left_anti")
        own = (left if rest is None else many).join(named, "uid", "left").select("key", "uid", "n", F.coalesce("root", "uid").alias("root"))
        several = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        if rest is not None:
            left = checkpoint(left.join(several, "key", "left_semi").select("key", "uid"))
            members = own.join(left.select("key").distinct(), "key", "left_semi").select("uid", "root").distinct()
            return [named.select(F.col("root").alias("u"), F.col("uid").alias("v")).where("u <> v"), compared(rest(left.select("uid").distinct(), members))]
        met, turn = meetings(own.join(several, "key", "left_semi").select("key", "uid", "n")), turn + 1
    return links


def prefix_pairs(sets: DataFrame, left: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """All pairs (u, v), u < v, of a text of ``left`` (uid, all of them members) and one of ``members`` (uid,
    root) of another root whose sets (uid, shingles) can have a likeness of ``least`` or more; some have less.

    Two such sets of n and m numbers share least / (1 + least) * (n + m) of them. So in any common order
    the first one that they share has as many behind it in both, itself included, and is among the first
    n - ceil(least * n) + 1 of each. Here the numbers that the fewest members have come first, so what a whole
    group has in common makes few pairs; numbers of one member alone fill the first places without a row.
    Empty sets give no pairs.
    """

    @F.pandas_udf("array<bigint>")
    def numbers(shingles: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<u4").astype(np.int64).tolist() for x in shingles])

    n = F.octet_length("shingles") / 4
    each = checkpoint(sets.join(members, "uid", "left_semi").select("uid", n.cast("long").alias("n"), F.explode(numbers("shingles")).alias("number")))
    often = checkpoint(each.groupBy("number").agg(F.count("*").alias("texts")).where("texts > 1"))
    held = each.join(often, "number").groupBy("uid", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "number"))).alias("held"))
    held = held.withColumn("first", (F.size("held") + 1 - F.ceil(least * F.col("n") - 1e-9)).cast("int"))
    firsts = held.where("first > 0").select("uid", "n", F.size("held").alias("size"), F.posexplode(F.slice("held", F.lit(1), F.col("first"))).alias("at", "x"))
    firsts = checkpoint(firsts.select("uid", "n", (F.col("size") - F.col("at")).alias("behind"), F.col("x.number").alias("number")).join(members, "uid"))
    own = firsts.join(left, "uid", "left_semi").toDF("v", "n", "behind", "number", "root")
    other = firsts.toDF("u", "m", "its_behind", "number", "its_root")
    alike = F.least("behind", "its_behind") >= least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9
    met = own.join(other, "number").where("root <> its_root").where(alike)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def copies(docs: DataFrame, words: int = WORDS, least: float = LIKENESS) -> DataFrame:
    """(node, root): texts, by hash, that have copies, and the least text of their group.

    Texts meet under the bands of their shingles and under the one-bit variants of their
    short fingerprints, as in ``links``. Pairs that meet are linked if their whole sets of
    shingles are alike enough. Those of a large group that are no copies of its representative
    are compared with all members that can be copies by their rarest shingles.
    """
    own = checkpoint(profiles(docs, words).dropDuplicates(["uid"]))
    balls = own.select("uid", "n", F.explode("prints").alias("fp")).select("uid", "n", F.explode(ball(BITS)).alias("key"))
    met = meetings(balls.union(own.select("uid", "n", F.explode("bands"))))
    sets = checkpoint(shingle_sets(docs, met.select("uid").distinct(), words))

    @F.pandas_udf("boolean")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    left, right = sets.select(F.col("uid").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("uid").alias("v"), F.col("shingles").alias("y"))
    linked = verified(
        met,
        lambda pairs: pairs.join(left, "u").join(right, "v").where(like("x", "y")).select("u", "v"),
        lambda stay, members: prefix_pairs(sets, stay, members, least),
        least,
    )
    linked = functools.reduce(DataFrame.union, linked, docs.sparkSession.createDataFrame([], "u long, v long"))
    return connected_components(linked, "u", "v")


def keep_one(docs: DataFrame, words: int = WORDS, least: float = LIKENESS) -> DataFrame:
    """``docs`` without the rows that another row of their group of near copies stands for.

    The row with the group's smallest doc_id stays, of several the one with the smallest
    hash of its text; null ids come last. Repeated rows with one id and text leave one row.
    Texts without words are copies of each other. Other columns stay, whatever they are called.
    An empty table gives no rows.
    """
    roots = copies(docs.select("text"), words, least)
    rows = docs.select("doc_id", F.xxhash64(utf8(F.col("text"))).alias("uid")).groupBy("doc_id", "uid").agg(F.count("*").alias("n"))
    rows = rows.join(roots, F.col("uid") == F.col("node"), "left").withColumn("group", F.coalesce("root", "uid"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "n")).alias("best")
    own, id_, uid, n, rank = fresh(docs, "own", "id", "uid", "n", "rank")
    chosen = rows.groupBy("group").agg(best).select(F.col("best.doc_id").alias(id_), F.col("best.uid").alias(uid), F.col("best.n").alias(n))
    chosen = checkpoint(chosen)
    keyed = docs.withColumn(own, F.xxhash64(utf8(F.col("text"))))
    at = (keyed[own] == F.col(uid)) & keyed["doc_id"].eqNullSafe(F.col(id_))
    kept = keyed.join(chosen.where(F.col(n) == 1), at, "left_semi").select(*docs.columns)
    again = chosen.where(F.col(n) > 1)
    if again.isEmpty():
        return kept
    more = keyed.join(again, at, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", own).orderBy(own)))
    return kept.unionByName(more.where(F.col(rank) == 1).select(*docs.columns))
