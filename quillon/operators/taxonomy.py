"""A taxonomy from its subsumptions: equivalent classes, direct parents and depths.

Subsumptions are rows (sub, sup) of a transitive relation, as ``Reasoner.taxonomy`` has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import checkpoint


def equivalents(pairs: DataFrame) -> DataFrame:
    """(c, rep): classes that subsume each other, with the least of them; others with themselves."""
    own = pairs.select(F.col("sub").alias("c")).union(pairs.select("sup")).distinct()
    both = pairs.join(pairs.select(F.col("sup").alias("sub"), F.col("sub").alias("sup")), ["sub", "sup"], "left_semi")
    least = both.groupBy(F.col("sub").alias("c")).agg(F.min("sup").alias("other"))
    return own.join(least, "c", "left").select("c", F.least("c", F.coalesce("other", "c")).alias("rep"))


def direct_parents(pairs: DataFrame) -> DataFrame:
    """(sub, sup) between representatives, without the pairs that another class lies between."""
    reps = checkpoint(equivalents(pairs))
    at = lambda c: reps.select(F.col("c").alias(c), F.col("rep").alias("_" + c))
    strict = pairs.join(at("sub"), "sub").join(at("sup"), "sup").where("_sub <> _sup").select(F.col("_sub").alias("sub"), F.col("_sup").alias("sup")).distinct()
    strict = checkpoint(strict)
    through = strict.select("sub", F.col("sup").alias("mid")).join(strict.select(F.col("sub").alias("mid"), "sup"), "mid").select("sub", "sup")
    return strict.join(through, ["sub", "sup"], "left_anti")


def depths(direct: DataFrame) -> DataFrame:
    """(c, depth): edges on the longest way up; layer by layer, those go whose parents have gone."""
    direct = checkpoint(direct.select("sub", "sup").distinct())
    left = checkpoint(direct.select(F.col("sub").alias("c")).union(direct.select("sup")).distinct())
    found, depth = left.select("c", F.lit(0).alias("depth")).limit(0), 0
    while not left.isEmpty():
        held = direct.join(left.withColumnRenamed("c", "sup"), "sup", "left_semi").select(F.col("sub").alias("c")).distinct()
        now = checkpoint(left.join(held, "c", "left_anti").select("c", F.lit(depth).alias("depth")))
        if now.isEmpty():
            raise ValueError("direct parents run in a circle")
        found, depth = found.union(now), depth + 1
        left = checkpoint(left.join(now, "c", "left_anti"))
    return found
