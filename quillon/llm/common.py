"""Helpers that the training-data operators share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII space, tab, line feed, vertical tab, form feed and return.
#: ``bytes.split()`` without arguments splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words in a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(by)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; only a local
    session (tests) without that setting gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage there."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read them from there: as ``checkpoint``, but
    columns are packed, which counts where rows hold texts or many numbers."""
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with their position, from 0, in the order of the columns ``order``, as column ``name``, and
    their number. Ties fall as rows come.

    Rows are dealt by ranges and written sorted; the ranges' numbers of rows, one for each partition,
    give their offsets. A row's place among its scan's rows is the last key, so that ranges can split
    rows that agree in all others.
    """
    tie = F.monotonically_increasing_id()
    dealt = rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    dealt = checkpoint(dealt).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = checkpoint(dealt.groupBy("_part").agg(F.count("*").alias("_n")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
    return found, sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, root).

    Alternates large-star and small-star rounds, which keep the components and
    shrink every component to a star around its smallest node in about log(n)
    rounds. Each round is cut by a checkpoint. Nodes without edges do not appear.
    """
    link = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = checkpoint(edges.where(F.col(a) != F.col(b)).select(*link).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        now = checkpoint(pairs.select("x.u", "x.v").where("u != v").distinct())
        if seen == (seen := mark(now)):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


class WordHashes(dict):
    """64-bit hash of each word; forgets all words once more than ``most`` are known."""

    def __init__(self, most: int = 300_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Words of each text, hashes of all words one after the other, and words per text."""
        if len(self) > self.most:
            self.clear()
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        hashes = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(split)), np.uint64, int(counts.sum()))
        return split, hashes, counts


def row_blocks(batches: Iterator[pa.RecordBatch], text: int, most: int = 2_000_000) -> Iterator[list[list]]:
    """Rows of Arrow batches as lists of columns, with about ``most`` bytes in the column ``text``."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[text] or b"") + 64
            if size >= most:
                yield [list(c) for c in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]
