"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket spans a few percent of length, and is cut
into parts of bounded size. The longest vectors give every query a first lower bound
for its k-th score. Buckets follow in waves, the longest first, each wave with as many
vectors as all before it; after a wave a query's bound is its k-th score so far. A query
goes to those buckets only whose greatest length can beat its bound. There, the bound
divided by both lengths is the bucket's local cosine threshold: low thresholds prune by
length, high ones by the query's largest coordinates; what is left is verified by exact
products.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import checkpoint

K = 5
EVERY = 50
#: Vectors in a part of a bucket, queries in a block, and vectors that give the first bounds.
PART, BLOCK, SEEDS = 4096, 512, 1024
#: A block of queries is sent to groups of parts: to so many in all, or to more where a group would hold more parts than that.
GROUPS, GROUP = 64, 8
#: A bucket's greatest length is this many times its least.
STEP = 1.1
#: Coordinates that prune, and vectors of a part on which their worth is judged.
FOCUS, TRIED = 3, 64
#: Scores beyond 64 bits are shown as the nearest long; they are ranked exactly.
LEAST, MOST = -(2**63), 2**63 - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part: floor(256 * x) of each component, as doubles,
    which hold them exactly however large they are."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    big = lambda y: F.abs(y) >= float(2**52)  # noqa: E731  (such doubles are whole)
    v = F.transform("embedding", lambda x: F.when(big(256 * x.cast("double")), 256 * x.cast("double")).otherwise(F.floor(256 * x.cast("double")).cast("double")))
    rows = good.select("vec_id", v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat, wide = lists.flatten().to_numpy(zero_copy_only=False).astype(float), int(lengths.max(initial=0))
    if (lengths == wide).all():
        return flat.reshape(len(lists), wide)
    rows = np.zeros((len(lists), wide))
    rows[np.arange(wide) < lengths[:, None]] = flat
    return rows


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(wide, 1)
    if largest < 2**53:  # sums of doubles are exact below that
        return (a @ b.T).astype(np.int64)
    if largest < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)  # exact, of any size
    return whole(a) @ whole(b).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = (np.sort if scores.dtype == object else lambda x: np.partition(x, len(x) - k))(scores)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def candidates(q: np.ndarray, length: float, bound: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places of a part's vectors, longest first, that may reach the query's bound."""
    if bound <= 0 or not length:
        return np.arange(len(norms))
    n = int(np.searchsorted(-norms, -(bound / length) * (1 - 1e-9), side="right"))  # length pruning
    cosine = bound / length / norms[0] * (1 - 1e-9) if n else 1.0
    if not n:
        return np.arange(n)
    direction = q / length

    def fits(rows: np.ndarray) -> np.ndarray:
        kept = np.ones(len(rows), bool)
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            x = float(direction[f])
            room = math.sqrt(max(1 - cosine * cosine, 0) * max(1 - x * x, 0)) + 1e-9
            kept &= rows[:, f] >= cosine * x - room if x >= 0 else rows[:, f] <= cosine * x + room
        return kept

    # the local threshold decides: coordinates are worth their cost if they drop a share of the products
    tried = unit[: n : max(1, n // TRIED)]
    if fits(tried).mean() > 1 - FOCUS / max(unit.shape[1], FOCUS + 1):
        return np.arange(n)
    return np.flatnonzero(fits(unit[:n]))


def _clipped(scores: list) -> list[int]:
    return [min(max(int(x), LEAST), MOST) for x in scores]


def _bounds(batches: Iterator[pa.RecordBatch], seeds: bytes, k: int) -> Iterator[pa.RecordBatch]:
    """Each query with the k-th best of its scores among the seeds."""
    (known,) = pa.ipc.open_stream(seeds).read_all().combine_chunks().to_batches() or [None]
    ids, vectors = known.column(0).to_numpy(zero_copy_only=False), matrix(known.column(1))
    for batch in batches:
        own, found = batch.column(0).to_numpy(zero_copy_only=False), []
        for a in range(0, len(own), BLOCK):
            scores = products(matrix(batch.column(1).slice(a, BLOCK)), vectors)
            for q, row in zip(own[a : a + BLOCK], scores, strict=True):
                row = row[ids != q]
                found.append(float(np.sort(row)[-k]) if len(row) >= k else -math.inf)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["vec_id", "v", "norm", "bound"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a part for each query of a block. Queries are few and members bounded, so a row is too."""
    for batch in batches:
        for row in range(batch.num_rows):
            queries, part = (batch.column(c).slice(row, 1).flatten() for c in (0, 1))
            ids, norms = (part.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "norm"))
            order = np.lexsort((ids, -norms))
            ids, norms, vectors = ids[order], norms[order], matrix(part.field("v"))[order]
            unit = vectors / np.maximum(norms, 1e-30)[:, None]
            asked = matrix(queries.field("v"))
            rows: list = []
            asks = list(zip(*(queries.field(c).to_pylist() for c in ("vec_id", "norm", "bound")), strict=True))
            found = [candidates(q[: vectors.shape[1]], length, bound, unit, norms) for (_, length, bound), q in zip(asks, asked, strict=True)]
            # queries that keep the whole part share one product
            whole = [n for n, at in enumerate(found) if len(at) == len(ids)]
            shared = dict(zip(whole, products(asked[whole], vectors), strict=True)) if whole else {}
            for n, ((own, _, _), at) in enumerate(zip(asks, found, strict=True)):
                scores = shared[n] if n in shared else products(asked[n][None], vectors[at])[0]
                others = ids[at] != own
                scores, at = scores[others], at[others]
                top = best(scores, ids[at], k)
                rows += [(own, i, s, str(x)) for i, s, x in zip(ids[at][top].tolist(), _clipped(scores[top]), scores[top].tolist(), strict=True)]
            if rows:
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query_id", "vec_id", "score", "exact"])


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but
    those with the query's vec_id. Ties go to smaller vec_ids; all candidates, if fewer.
    Vectors that are null or have null or non-finite components, and null ids, take no
    part; shorter vectors count as ending in zeros. Repeated rows are candidates of
    their own, and repeated queries are answered once. Components of any finite size are exact;
    scores beyond 64 bits are ranked exactly and shown as the nearest long. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    rows = integers(vectors)
    rows = checkpoint(rows.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log(F.least("norm", F.lit(1e308))) / math.log(STEP))).otherwise(-1)))
    # as many buckets as powers of STEP between the least and the greatest length: 15,000 at most
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    seeds = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    if not buckets:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, seeds.schema) as stream:
        stream.write_table(seeds)
    seeds = sink.getvalue().to_pybytes()
    parts = {r.bucket: -(-r.n // PART) for r in buckets}
    share = min(max(GROUPS / sum(parts.values()), 1 / GROUP), 1)
    sizes = spark.createDataFrame([(r.bucket, parts[r.bucket], math.ceil(parts[r.bucket] * share), float(r.longest)) for r in buckets], "b long, parts long, groups long, longest double")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "norm")
    n_blocks = -(-asked.count() // BLOCK) or 1
    asked = asked.mapInArrow(functools.partial(_bounds, seeds=seeds, k=k), "vec_id long, v array<double>, norm double, bound double")
    asked = checkpoint(asked)
    dealt = rows.join(F.broadcast(sizes.drop("longest")), F.col("bucket") == F.col("b")).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    parts = dealt.groupBy("b", (F.col("part") % F.col("groups")).alias("group"), "part").agg(F.collect_list(F.struct("vec_id", "v", "norm")).alias("members"))
    parts = checkpoint(parts)
    found, waves = None, list(_waves(buckets))
    for turn, wave in enumerate(waves):
        own = sizes.where(F.col("b").isin(wave))
        routed = asked.join(F.broadcast(own), F.col("norm") * F.col("longest") >= F.col("bound") * (1 - 1e-9))
        routed = routed.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block"), "b", "groups", F.struct("vec_id", "v", "norm", "bound").alias("q"))
        blocks = routed.groupBy("b", "block", "groups").agg(F.collect_list("q").alias("queries"))
        blocks = blocks.select("queries", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
        # Spark judges blocks by their size before they are sent to each group, and would broadcast them through the driver
        pairs = blocks.join(parts.where(F.col("b").isin(wave)).hint("merge"), ["b", "group"]).select("queries", "members")
        new = pairs.mapInArrow(functools.partial(_search, k=k), "query_id long, vec_id long, score long, exact string")
        found = _highest(new if found is None else found.unionByName(new), k)
        if turn + 1 < len(waves):
            found = checkpoint(found)
            # clipped scores lie on the safe side only while they fit; others leave the bound as it was
            kth = found.where((F.col("rank") == k) & (F.col("score") < MOST) & (F.col("score") > LEAST)).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("kth"))
            raised = F.greatest("bound", F.coalesce("kth", F.col("bound")))
            asked = checkpoint(asked.join(kth.hint("merge"), F.col("vec_id") == F.col("of"), "left").withColumn("bound", raised).select("vec_id", "v", "norm", "bound"))
            found = found.drop("rank")
    return found.select("query_id", "rank", "vec_id", "score")


def _waves(buckets: list) -> Iterator[list[int]]:
    """Buckets from the greatest length down, in waves of about as many vectors as all waves before have."""
    wave, held, before = [], 0, 0
    for r in sorted(buckets, key=lambda r: -r.longest):
        wave.append(r.bucket)
        held += r.n
        if held >= before:
            yield wave
            wave, before, held = [], before + held, 0
    if wave:
        yield wave


def _highest(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank. Beyond 64 bits the exact score, by sign, number of digits and
    digits, decides before the clipped one."""
    minus, digits = F.col("exact").startswith("-"), F.lpad(F.replace(F.col("exact"), F.lit("-"), F.lit("")), 90, "0")
    above = F.when((F.col("score") == MOST) & ~minus, digits).otherwise("")
    below = F.when((F.col("score") == LEAST) & minus, digits).otherwise("")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), above.desc(), below.asc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
