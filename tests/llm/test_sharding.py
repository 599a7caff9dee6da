"""Sharding: laws, round trip and the SQL."""

import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot string, row long, at long, _tie long, _part long"


def rows():
    draw = random.Random(6)
    made = [(d, "word é " * draw.randrange(40)) for d in range(300)]
    return [*made, (None, None), (None, "a"), (5, None), (5, ""), (5, ""), (6, "x" * 200_000), *[(400 + k, "copy") for k in range(150)], *[(9, "same")] * 200]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "x", 1, 1, 1, 1) for r in rows()], SCHEMA)


def test_rows_law_and_values(docs):
    got = sharding.shard(docs).collect()
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_reruns_agree(docs):
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, sharding.shard(docs).collect())) == sorted(map(key, sharding.shard(docs.repartition(5)).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 1000, 4096])
def test_permutation_and_its_inverse(spark, n):
    walk = sharding.longest_walk(spark, n)
    shard, slot = sharding.place(F.col("id"), n, 24, walk)
    placed = spark.range(n).select("id", shard.alias("shard"), slot.alias("slot"))
    got = placed.withColumn("back", sharding.row_at(F.col("shard"), F.col("slot"), n, 24, walk)).collect()
    assert all(r.id == r.back for r in got)
    assert sorted(24 * r.slot + r.shard for r in got) == list(range(n))


def test_agrees_with_sql(docs, tmp_path):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r for r in rows() if len(r[1] or "") < 1000])
    want = con.sql(sharding.SQL)
    columns = sorted(want.columns)
    got = sharding.shard(docs.where("coalesce(length(text), 0) < 1000"))
    assert sorted(got.columns) == columns
    fetched = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, fetched))


def test_empty_and_single(spark, docs):
    assert sharding.shard(docs.limit(0)).collect() == []
    assert [(r.shard, r.slot) for r in sharding.shard(docs.where("doc_id = 17")).collect()] == [(0, 0)]
