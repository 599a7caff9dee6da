"""Data ranges as disjoint stretches of the lines of values, and values within them.

A range is rows (node, line, low, high): its stretches, in a normal form that equal sets
share. Expressions are resolved bottom up, so a datatype that is defined by others is
taken apart first; sets are combined by one sweep over the cuts of their parts.

Values are joined to ranges through the segments that the ranges' cuts make of a line:
a search in the sorted cuts gives a value's segment, and every stretch is cut into dyadic
blocks of segments, so the join is one of equal keys and no value meets a range in vain.
Where all stretches have few segments, these are joined themselves, one row for each value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import values as V
from quillon.operators.components import checkpoint
from quillon.operators.saturation import SMALL, small

#: Ways to combine the parts of an expression: "all", "any", "none" (a complement).
WAYS = ("all", "any", "none")


def swept(parts: DataFrame) -> DataFrame:
    """(node, line, low, high) of expressions whose parts are rows (node, way, n, line, low, high).

    n is the number of an expression's parts; each part's own stretches are disjoint. A
    complement needs a row on every line, which ``_everywhere`` adds. Cuts are added up along
    each line: a set holds where the count of parts is n, is one or more, or is nothing.
    """
    ends = F.explode(F.array(F.struct(F.col("low").alias("cut"), F.lit(1).alias("step")), F.struct(F.col("high").alias("cut"), F.lit(-1).alias("step"))))
    events = parts.where("low is not null").select("node", "way", "n", "line", ends.alias("e")).union(_everywhere(parts))
    events = events.groupBy("node", "way", "n", "line", F.col("e.cut").alias("cut")).agg(F.sum("e.step").alias("step"))
    along = Window.partitionBy("node", "line").orderBy("cut")
    depth = F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(F.col("way") == "all", depth == F.col("n")).when(F.col("way") == "any", depth > 0).otherwise(depth == 0) & (F.col("cut") != V.HIGH)
    rows = events.withColumn("held", held)
    rows = rows.withColumn("before", F.coalesce(F.lag("held").over(along), F.lit(False))).where("held <> before")
    rows = rows.withColumn("high", F.coalesce(F.lead("cut").over(along), F.lit(V.HIGH))).where("held")
    return rows.select("node", "line", F.col("cut").alias("low"), "high")


def _everywhere(parts: DataFrame) -> DataFrame:
    lines = F.explode(F.array(*map(F.lit, V.LINES))).alias("line")
    ends = F.explode(F.array(F.struct(F.lit(V.LOW).alias("cut"), F.lit(0).alias("step")), F.struct(F.lit(V.HIGH).alias("cut"), F.lit(0).alias("step")))).alias("e")
    return parts.where("way = 'none'").select("node", "way", "n").distinct().select("node", "way", "n", lines).select("node", "way", "n", "line", ends)


def resolved(pieces: DataFrame, known: DataFrame, expressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, line, low, high) of all ranges, and the nodes that stay open: they stand on a circle of
    definitions, or on parts that nothing defines.

    pieces: stretches of the ranges that are known from the start (node); expressions: (node, way,
    pos, part). One round for each level of nesting.
    """
    sizes = expressions.groupBy("node").agg(F.count("*").cast("int").alias("n"))
    todo = checkpoint(expressions.join(sizes, "node").select("node", "way", "n", "part").withColumn("at", F.monotonically_increasing_id()))
    done, pieces = checkpoint(known.select("node").distinct()), checkpoint(pieces.distinct())
    while True:
        waiting = todo.join(done.withColumnRenamed("node", "part"), "part", "left_anti").select("node").distinct()
        ready = checkpoint(todo.join(waiting, "node", "left_anti").join(done, "node", "left_anti"))
        if ready.isEmpty():
            return pieces, todo.select("node").distinct().join(done, "node", "left_anti")
        parts = ready.join(pieces.withColumnRenamed("node", "part"), "part", "left").select("node", "way", "n", "line", "low", "high")
        pieces = checkpoint(pieces.union(swept(parts)))
        done = checkpoint(done.union(ready.select("node").distinct()))


def amounts(pieces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, amount): how many values each range has; null if there is no end to them."""
    n = V.amount(F.col("line"), F.col("low"), F.col("high"))
    counted = pieces.groupBy("node").agg(F.sum(n).alias("amount"), F.count_if(n.isNull()).alias("endless"))
    amount = F.when(F.col("endless").isNull(), F.lit(0)).when(F.col("endless") == 0, F.col("amount"))
    return nodes.select("node").distinct().join(counted, "node", "left").select("node", amount.cast("decimal(38,0)").alias("amount"))


def within(pieces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of which the first range lies within the second: each of its stretches within one stretch."""
    inner = pieces.select(F.col("node").alias("inner"), "line", "low", "high")
    outer = pieces.select(F.col("node").alias("outer"), "line", F.col("low").alias("from"), F.col("high").alias("to"))
    held = pairs.join(inner, "inner").join(outer, ["outer", "line"]).where("from <= low and high <= to").groupBy("inner", "outer").count()
    sizes = inner.groupBy("inner").agg(F.count("*").alias("n"))
    rows = pairs.join(sizes, "inner", "left").join(held, ["inner", "outer"], "left")
    return rows.where("coalesce(n, 0) = coalesce(count, 0)").select("inner", "outer")


def _search(cuts: Column, at: Column) -> Column:
    """How many of the sorted cuts lie before a place, by halving."""
    step = lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(_halved(s, cuts, at))
    start = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + F.lit(1))).cast("int"))
    return F.aggregate(rounds, start, step, lambda s: s["low"])


def _halved(s: Column, cuts: Column, at: Column) -> Column:
    middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
    before = F.element_at(cuts, middle + 1) < at
    return F.struct(F.when(before, middle + 1).otherwise(s["low"]).alias("low"), F.when(before, s["high"]).otherwise(middle).alias("high"))


def _blocks(start: Column, end: Column, levels: int) -> Column:
    """The dyadic blocks (level, block) that make up the segments from start to before end."""
    level = lambda k: _level(F.ceil(start / F.pow(F.lit(2), k)).cast("long"), F.floor(end / F.pow(F.lit(2), k)).cast("long"), k)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), level))


def _level(first: Column, last: Column, k: Column) -> Column:
    """Blocks of one level, from ``first`` to before ``last``, that lie in no larger block of the same stretch."""
    edge = lambda x: F.struct(k.cast("int").alias("level"), x.alias("block"))
    left, right = first % 2 == 1, last % 2 == 1
    some = first < last
    head = F.when(some & left, F.array(edge(first))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    tail = F.when(some & right & ((last - 1 > first) | ~left), F.array(edge(last - 1))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    return F.concat(head, tail)


def members(values: DataFrame, asked: DataFrame, pieces: DataFrame) -> DataFrame:
    """``values`` (p, line, key, …) with the column node: one row for each range (p, node) that is asked of its
    property and has the value."""
    bands = asked.select("p", "node").distinct().join(pieces, "node")
    at = lambda c: F.concat("line", F.lit("\x00"), c)
    bands = bands.select("p", "node", at("low").alias("low"), at("high").alias("high"))
    cuts = bands.select("p", F.explode(F.array("low", "high")).alias("cut")).groupBy("p").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    cuts = small(checkpoint(cuts))
    levels = max(1, (cuts.agg(F.max(F.size("cuts"))).first()[0] or 1).bit_length())
    bands = checkpoint(bands.join(cuts, "p").select("p", "node", (F.array_position("cuts", F.col("low"))).alias("start"), (F.array_position("cuts", F.col("high"))).alias("end")))
    spot = F.concat("line", F.lit("\x00"), "key", F.lit(" 1"))
    # never null, or Spark would search a second time to leave out null keys before the join
    rows = values.join(cuts, "p").withColumn("_at", F.coalesce(V.let(spot, lambda at: _search(F.col("cuts"), at)), F.lit(0)).cast("bigint")).drop("cuts")
    if (bands.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0) <= SMALL:
        segments = bands.select("p", "node", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("_at"))
        return rows.join(F.broadcast(segments), ["p", "_at"]).drop("_at")
    bands = small(checkpoint(bands.select("p", "node", F.explode(_blocks(F.col("start"), F.col("end"), levels)).alias("b")).select("p", "node", "b.level", "b.block")))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", F.expr("shiftright(_at, level)")).drop("_at")
    return rows.join(bands, ["p", "level", "block"]).drop("level", "block")
