"""Steps whose tasks must not grow with one role, class or label."""

import random

import pytest

from quillon import queries
from quillon.operators import constraints, ranges


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rule", ["some", "told", "domain", "chain", "all", "self"])
def test_rules_of_queries_are_broadcast(spark, rule):
    row = {"some": ("r", "C", "E"), "told": ("C", "D"), "domain": ("r", "E"), "chain": ("r", "r", "s"), "all": ("C", "r", "E"), "self": ("r", "E")}[rule]
    rules = queries._rules(spark, **{rule: [row]})[rule]
    first = rules.columns[0]
    facts = spark.range(10**9).selectExpr("cast(id as string) as x", f"concat('r', id) as {first}")
    assert "BroadcastHashJoin" in plan(facts.join(rules, first)) and "SortMergeJoin" not in plan(facts.join(rules, first))


def test_rows_with_few_labels_are_not_broadcast(spark):
    links = spark.range(40).selectExpr("id as x", "concat('r', id % 2) as r", "concat('l', id % 3) as y")
    got = constraints.inverse_functional_same(links, spark.createDataFrame([("r0",), ("r1",)], "r string"))
    assert sorted(map(tuple, got.collect())) == sorted((min(k for k in range(40) if k % 6 == x % 6), x) for x in range(6, 40))
    keyed = constraints.key_same(links.selectExpr("x", "y as key"), ["key"])
    assert "SortMergeJoin" in plan(keyed) and "BroadcastHashJoin" not in plan(keyed)


def test_values_meet_few_segments_once_each(spark, monkeypatch):
    values = spark.range(60).selectExpr("id", "'p' as p", "'integer' as line", "concat('k', lpad(cast(id as string), 2, '0')) as key")
    pieces = spark.createDataFrame([("a", "integer", "k10 0", "k20 2"), ("a", "integer", "k40 0", "k50 2"), ("b", "integer", "k15 0", "k45 2")], "node string, line string, low string, high string")
    asked = spark.createDataFrame([("p", "a"), ("p", "b")], "p string, node string")
    want = sorted([(k, "a") for k in [*range(10, 21), *range(40, 51)]] + [(k, "b") for k in range(15, 46)])
    few = ranges.members(values, asked, pieces)
    assert sorted(map(tuple, few.select("id", "node").collect())) == want
    assert "level" not in plan(few)
    monkeypatch.setattr(ranges, "SMALL", 0)
    assert sorted(map(tuple, ranges.members(values, asked, pieces).select("id", "node").collect())) == want


def test_tasks_get_a_bounded_number_of_rows(spark):
    from quillon.operators.components import spread

    rows = spark.range(1000).selectExpr("concat('n', id) as node")
    dealt = spread(rows, "node", 100)
    assert dealt.rdd.getNumPartitions() == 11 and dealt.distinct().count() == 1000
    assert spread(rows.limit(0), "node").rdd.getNumPartitions() == 1


def test_components_by_hashes_or_names(spark, monkeypatch):
    """Rounds join 64-bit numbers, not names; names that share a number are joined as they are."""
    from quillon.operators import components as own

    draw, types = random.Random(5), []
    made = [(f"n{draw.randrange(60)}", f"m{draw.randrange(60)}") for _ in range(50)] + [("lone", "lone"), (None, "x"), ("x", None)]
    root = {n: n for p in made if None not in p for n in p}
    for _ in root:
        for a, b in (p for p in made if None not in p):
            root[a] = root[b] = min(root[a], root[b])
    stars = own.stars
    monkeypatch.setattr(own, "stars", lambda pairs, most: types.append(dict(pairs.dtypes)["a"]) or stars(pairs, most))
    for clear in (own.clear, lambda names: False):
        monkeypatch.setattr(own, "clear", clear)
        found = own.components(spark.createDataFrame(made, "a string, b string")).collect()
        assert len(found) == len(root) and {r.node: r.component for r in found} == root
    assert types == ["bigint", "string"]
    assert not own.components(spark.createDataFrame([(None, "x")], "a string, b string")).collect()
    monkeypatch.undo()
    same = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, node string")
    assert not own.clear(same) and own.clear(same.where("node <> 'b'"))


def test_told_paths_double_without_repeats(spark, monkeypatch):
    """Paths of a taxonomy are made of the last round's, not of all: what rules make stays near what is new."""
    from quillon.operators import saturation

    draw, made = random.Random(6), []
    tree = [(k, k // 2) for k in range(2, 400)]
    dag = [(f"{k}", f"{j}") for k in range(40) for j in {k + 1, min(40, k + draw.randrange(1, 6)), draw.choice([k + 1, 0])}]  # with cycles
    subs = saturation._subs
    monkeypatch.setattr(saturation, "_subs", lambda *a: [made.append(p.count()) or p for p in subs(*a)])
    for pairs in (tree, dag):
        made.clear()
        pairs = [tuple(map(str, p)) for p in pairs]
        above = {n: {n} for p in pairs for n in p}
        for _ in above:
            for c, d in pairs:
                above[c] |= above[d]
        names = list(above)
        own = spark.createDataFrame([(saturation.CONTEXT + n, n) for n in names] + [("someone", "7"), ("someone", "9")], "x string, c string")
        none = spark.createDataFrame([], "x string, r string, y string")
        got, _ = saturation.saturate(own, none, {"told": spark.createDataFrame(pairs, "c string, d string")})
        want = {(saturation.CONTEXT + n, c) for n in names for c in above[n]} | {("someone", c) for c in above["7"] | above["9"]}
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
        if pairs[0][0] == "2":
            assert sum(made) < 2 * len(want), (sum(made), len(want))
