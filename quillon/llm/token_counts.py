"""Token counts for every context limit from an exact length histogram.

Documents are counted by encoded length; prefix and suffix sums over the
histogram then give, for every limit that is some document's length, the
documents and tokens within it, the truncated total and the quantile. Limits
between two lengths follow from the next lower row: the total truncated at c is
tokens_at_most + c * n_longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.bpe import Encoder, slices
from quillon.llm.common import checkpoint

#: Lengths in a block of the two-level prefix sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens): number of ids of each whole text; a null text has none."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for batch in texts:
            given = batch.fillna("").tolist()
            parts = slices([len(t) for t in given], 4_000_000)
            yield pd.Series([n for a, z in parts for n in encoder.lengths(given[a:z]).tolist()], dtype="int64")

    return docs.select("doc_id", count("text").alias("tokens"))


def histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with the sums up to it and beyond it.

    length, n_docs; n_at_most, tokens_at_most: documents of at most this length and
    their tokens; n_longer; truncated_total: tokens if each document is cut to this
    length; quantile: share of documents of at most this length; total_tokens and
    total_docs: over all. Documents with empty or null text count at length 0. An
    empty table gives no rows.
    """
    counts = lengths.groupBy(F.col("tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    counts = checkpoint(counts)  # else the texts are encoded for the blocks and again for the rows
    counts = counts.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block").alias("of"),
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bn").over(whole).alias("total_docs"),
        F.sum("bt").over(whole).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumns({"n1": F.sum("n_docs").over(own), "t1": F.sum("tokens").over(own)})
    rows = rows.join(blocks, F.col("block") == F.col("of")).withColumns({"n_at_most": F.col("n0") + F.col("n1"), "tokens_at_most": F.col("t0") + F.col("t1")})
    rows = rows.withColumn("n_longer", F.col("total_docs") - F.col("n_at_most"))
    return rows.select(
        "length", "n_docs", "n_at_most", "tokens_at_most", "n_longer",
        (F.col("tokens_at_most") + F.col("length") * F.col("n_longer")).alias("truncated_total"),
        (F.col("n_at_most") / F.col("total_docs")).alias("quantile"),
        "total_docs", "total_tokens",
    )


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The histogram of ``docs`` (see ``histogram``)."""
    return histogram(token_lengths(docs, path))
