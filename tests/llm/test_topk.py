import random

import numpy as np

from quillon.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k):
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for q, v in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
            found |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return sorted(found)


def check(spark, rows, every=5, k=5):
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), every, k).collect()
    assert sorted(map(tuple, got)) == brute(rows, every, k)


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 64)
    monkeypatch.setattr(topk, "SEEDS", 16)
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 1) * 1.5 ** draw.randrange(4) for _ in range(8)], 0) for i in range(700)]
    rows += [(700 + i, [1.0] * 8, 0) for i in range(200)]
    check(spark, rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (5, [0.0, 0.0], 0), (1, None, 0), (2, [None, 1.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (6, [-1.0, 0.5], 0), (7, [3.0], 0)]
    check(spark, rows)
    check(spark, [(0, [1.0], 0)])
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_huge_components(spark):
    """Beyond 64 bits scores are ranked exactly and shown as the nearest long."""
    draw = random.Random(3)
    rows = [(i, [draw.choice([1e30, -1e30, 3e20, 2.0, -1.5]), draw.choice([1e30, 1.0])], 0) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v], z) for i, v, z in rows]
    clip = lambda s: min(max(s, topk.LEAST), topk.MOST)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), 5, 5).collect()
    assert sorted(map(tuple, got)) == [(q, r, i, clip(s)) for q, r, i, s in brute(rows, 5, 5)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_repeated_rows_are_candidates(spark):
    rows = [(0, [1.0], 0), (1, [2.0], 0), (1, [2.0], 0), (2, [1.0], 0)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), 5, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 512)]


def test_blocks_stay_off_the_driver(spark, monkeypatch):
    """Blocks are sent to groups of parts by a shuffle: a broadcast of them grew with the square of the table."""
    monkeypatch.setattr(topk, "PART", 16)
    monkeypatch.setattr(topk, "SEEDS", 8)
    monkeypatch.setattr(topk, "GROUPS", 2, raising=False)
    monkeypatch.setattr(topk, "GROUP", 3, raising=False)
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(300, 6))
    rows = [(i, [float(np.float32(x)) for x in 100 * v / np.linalg.norm(v)], 0) for i, v in enumerate(rows)]  # of one length: one wave
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), 5, 5)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 5)
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" not in final and "SortMergeJoin" in final, final
