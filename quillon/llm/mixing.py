"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target of words, a multiple r of its size. Every document is
taken floor(r) times, and once more with probability r - floor(r). The extra
copies are drawn by the cube method, balanced on the number of words and of
documents of the source: the flight phase moves the probabilities of three
documents at a time along the null space of both constraints until one of them
is settled. It runs in blocks of bounded size; the two documents at most that a
block leaves go on to blocks of the next level, until one block per source is
left. A dozen documents of that block, of all sizes, and those its flight leaves
are landed: of all their subsets, the one nearest to the promised words is taken.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import checkpoint, fresh, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Documents in a block of the flight phase, on average.
BLOCK = 2048
#: Documents of a source that wait for its landing.
RESERVE = 12


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share``
    times all sizes; no target exceeds ``most`` times its source's size, the excess
    goes to the others by weight. With sources in order of cap / weight, those at
    their cap come first, so the level of the others follows from prefix sums.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int")))
    sources = sources.withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumns({"low": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "rest": F.sum("weight").over(after), "all": share * F.sum("source_size").over(whole)})
    full = F.col("cap") / F.col("weight") * F.col("rest") + F.col("low") <= F.col("all")
    level = F.first(F.when(~full, (F.col("all") - F.col("low")) / F.col("rest")), ignorenulls=True).over(whole)
    return sources.withColumn("target", F.when(full, F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def flight(sizes: np.ndarray, chances: np.ndarray, draw: Callable[[], float]) -> np.ndarray:
    """Chances after the flight phase: all but two at most are 0 or 1, and the sums of
    the chances and of chances * sizes are kept."""
    left = chances.copy()
    z = sizes.astype(float)

    def move(who: list[int], u: list[float]) -> None:
        up = min((1 - left[k]) / x if x > 0 else left[k] / -x for k, x in zip(who, u, strict=True) if x)
        down = min(left[k] / x if x > 0 else (1 - left[k]) / -x for k, x in zip(who, u, strict=True) if x)
        step = up if draw() * (up + down) < down else -down
        for k, x in zip(who, u, strict=True):
            left[k] += step * x
            if left[k] < 1e-9:
                left[k] = 0.0
            elif left[k] > 1 - 1e-9:
                left[k] = 1.0

    active: list[int] = []
    for k in range(len(left)):
        if 0 < left[k] < 1:
            active.append(k)
        while len(active) == 3 or (len(active) == 2 and z[active[0]] == z[active[1]]):
            if len(active) == 2:
                u = [1.0, -1.0]
            else:
                a, b, c = (z[x] for x in active)
                u = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]
                most = max(map(abs, u))
                u = [x / most for x in u]
            move(active, u)
            active = [x for x in active if 0 < left[x] < 1]
    return left


def land(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Settles a few documents: of all subsets, the one whose words, and then whose
    number of documents, come nearest to what the chances promise."""
    n = len(sizes)
    if not n:
        return chances
    subsets = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
    words = np.abs(subsets @ sizes.astype(float) - float(sizes @ chances))
    best = np.flatnonzero(words <= words.min() + 1e-6)
    count = np.abs(subsets[best].sum(1) - chances.sum())
    return subsets[best[int(np.argmin(count))]].astype(float)


def settle(sizes: np.ndarray, chances: np.ndarray, draw: Callable[[], float]) -> np.ndarray:
    """Flight phase and landing. Up to RESERVE documents, evenly over the sizes, wait
    for the landing, where they make up for what is left of the flight."""
    left = chances.copy()
    loose = np.flatnonzero((left > 0) & (left < 1))
    by_size = loose[np.argsort(sizes[loose], kind="stable")]
    spare = np.unique(np.linspace(0, len(by_size) - 1, min(RESERVE, len(by_size))).astype(int))
    fly = np.ones(len(left), bool)
    fly[by_size[spare]] = False
    left[fly] = flight(sizes[fly], left[fly], draw)
    rest = np.flatnonzero((left > 0) & (left < 1))
    left[rest] = land(sizes[rest], left[rest])
    return left


def _fly(rows: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    rows = rows.sort_values(["order", "doc_id", "size"], kind="stable", na_position="first").reset_index(drop=True)
    source = rows["source"].iloc[0]
    key = f"{level} {int(rows['block'].iloc[0])} {'' if source is None else 's' + source}"
    draw = np.random.default_rng(xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))).random
    rows["chance"] = (settle if last else flight)(rows["size"].to_numpy(), rows["chance"].to_numpy(float), draw)
    return rows.drop(columns="block")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, copies.

    size: words of the text (null: 0). taken = copies * size. A null source is a
    source of its own, ordered last. Documents without words have copies drawn like
    the others and taken 0; in a source without words no document is copied. Rows with
    null or repeated ids count as rows of their own. The same rows give the same
    result. An empty table gives no rows.
    """
    sized = checkpoint(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = checkpoint(targets(sized, weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    rows = sized.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("chance", ratio - F.col("whole"))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "size", F.lit("order")))
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "chance", "order"]
    n = sources.agg(F.max("n_docs")).first()[0] or 0
    left, done, level = rows, [], 0
    share_of_level = F.lit(1.0)
    while True:
        last = n <= BLOCK
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") * share_of_level / BLOCK))
        now = left.withColumn("block", F.lit(0).cast("long") if last else F.pmod(F.xxhash64("order", F.lit(level)), blocks))
        flown = now.select(*columns, "n_docs", "block").groupBy("source", "block").applyInPandas(
            functools.partial(_fly, level=level, last=last), left.select(*columns, "n_docs").schema
        )
        if last:
            done.append(flown)
            break
        flown = checkpoint(flown)
        done.append(flown.where("chance = 0 or chance = 1"))
        left = flown.where("chance > 0 and chance < 1")
        n, level = 2 * (n // BLOCK + 1), level + 1
        share_of_level = share_of_level * (2.0 / BLOCK)
    found = functools.reduce(DataFrame.union, done)
    copies = (F.col("whole") + F.col("chance")).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, other columns as they are.

    Rows of one id, source and size are interchangeable in the mix, so the one with the smaller hash of
    its text is taken as often as the smaller number says or more often. Null texts, ids and sources
    count as in ``mix``; repeated rows are rows of their own. An empty table gives no rows.
    """
    size, turn, text, d, s, z, t, copies = fresh(docs, "size", "turn", "text_hash", "d", "s", "z", "t", "copies")
    plan = mix(docs.select("doc_id", "source", "text")).select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("copies").alias(copies))
    plan = plan.withColumn(t, F.row_number().over(Window.partitionBy(d, s, z).orderBy(copies)))
    own = docs.withColumn(size, word_count(F.col("text"))).withColumn(text, F.xxhash64("text"))
    # the texts themselves stay out of the numbering: only rows that share id, source and size are numbered by hash
    shared = own.groupBy("doc_id", "source", size).count().where("count > 1").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col(size).alias(z))
    same = own["doc_id"].eqNullSafe(F.col(d)) & own["source"].eqNullSafe(F.col(s)) & (own[size] == F.col(z))
    single = own.join(shared, same, "left_anti").withColumn(turn, F.lit(1))
    several = own.join(shared, same, "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(text)))
    both = single.unionByName(several)
    keys = both["doc_id"].eqNullSafe(F.col(d)) & both["source"].eqNullSafe(F.col(s)) & (both[size] == F.col(z)) & (both[turn] == F.col(t))
    kept = both.join(plan.where(F.col(copies) > 0), keys)
    return kept.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
