"""Importance resampling: the byte automaton against a word-by-word reading, results against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import resampling

SCHEMA = "doc_id long, text string, rank string, score string, row long, _short string, _down long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows():
    draw = random.Random(8)
    some = ["The", "ÜBER", "straße", "x1", "日本", "don't", "a-b", "__", "B" * 90, "é" * 70, "zebra"]
    made = [(d, draw.choice([" ", "\n", ". ", ""]).join(draw.choice(some) for _ in range(draw.choice([0, 1, 19, 20, 21, 60, 300])))) for d in range(250)]
    return [*made, (None, None), (None, "word " * 25), (7, None), (8, ""), (8, ""), (9, "the " * 30), (9, "the " * 30), (9, "the " * 60), (10, "q" * 100_000), (11, "long " * 30_000), (12, "?!")]


TARGET = ["zebra and the straße", "x1 x1 zebra", None, "", "日本"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_agree_with_reading_word_by_word(longest):
    texts = [t for _, t in rows()]
    column = pa.array(["unseen", *texts])[1:]
    for kind in (pa.string(), pa.large_string()):
        found, counts = Counter(), []
        for first, _, data, offsets in resampling.blocks(column.cast(kind), most=20_000):
            words, owner, sums = resampling.features(data, offsets, longest)
            counts += words.tolist()
            found.update(zip((first + owner).tolist(), sums.tolist(), strict=True))
        want = Counter()
        for k, t in enumerate(texts):
            words = WORD.findall(lower(t))
            assert counts[k] == len(words)
            want.update((k, zlib.crc32(" ".join(words[i : i + n]).encode())) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
        assert found == want


def test_tables_follow_the_rule():
    assert resampling.TABLE[1] == 0x77073096 and resampling.TABLE[255] == 0x2D02EF8D
    data = np.frombuffer(b"ab 123456789", np.uint8)
    assert resampling.checksums(data, np.array([0, 3]), np.array([2, 12]), far=4).tolist() == [zlib.crc32(b"ab"), 0xCBF43926]


def test_agrees_with_sql(spark):
    docs, target = spark.createDataFrame([(*r, "x", "x", 1, "x", 1) for r in rows()], SCHEMA), spark.createDataFrame([(t,) for t in TARGET], "text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows())
    con.executemany("insert into benchmark values (1, ?)", [(t,) for t in TARGET])
    want = con.sql(resampling.SQL)
    columns = sorted(want.columns)
    got = resampling.resample(docs, target)
    assert sorted(got.columns) == columns
    got = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
    ranks = sorted(r[columns.index("rank")] for r in got if r[columns.index("rank")])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(len(WORD.findall(lower(t))) >= 20 for _, t in rows()) // 10
    again = resampling.resample(docs.repartition(3), target).select(*columns).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, got))


def test_longer_features_and_empty_tables(spark):
    docs, target = spark.createDataFrame([(*r, "x", "x", 1, "x", 1) for r in rows()], SCHEMA), spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = {(r.doc_id, r.n_features) for r in resampling.resample(docs, target, longest=2).collect()}
    assert {(9, 59), (9, 119), (7, 0)} <= found
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert len(resampling.resample(docs, target.limit(0)).collect()) == len(rows())
