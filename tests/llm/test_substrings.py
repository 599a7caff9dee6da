import hashlib
import random
from collections import Counter

import pytest

from quillon.llm import substrings

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, window):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in split for p in range(len(w) - window + 1))
    found = []
    for d, words in split:
        gone = set()
        for p in range(len(words) - window + 1):
            if seen[tuple(words[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        found.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def check(spark, rows, window, first=substrings.FIRST):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = substrings.without_repeats(docs, window, first=first).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_levels_double_up_to_the_window():
    assert substrings.levels(35) == [9, 18] and substrings.levels(35, 2) == [2, 3, 5, 9, 18] and substrings.levels(5) == [3]


@pytest.mark.parametrize(("window", "first"), [(5, 9), (8, 9), (35, 9), (8, 2), (35, 2)])
def test_random_texts(spark, window, first):
    draw = random.Random(window)
    pool = [[draw.choice("abcdefgh") + str(draw.randrange(9)) for _ in range(draw.randrange(20, 90))] for _ in range(12)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(draw.randrange(0, 5)):
            part = draw.choice(pool)
            a = draw.randrange(len(part))
            words += part[a : a + draw.randrange(1, 80)] + [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(0, 12))]
        rows.append((d, draw.choice([" ", "\n", "\t "]).join(words)))
    check(spark, rows, window, first)


def test_repeats_within_a_text_and_ties(spark):
    check(spark, [(1, "a " * 50), (2, "a b " * 30), (3, "a b c"), (4, "b " + "a " * 9)], 6, 2)


def test_edge_cases(spark):
    long = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
    rows = [(None, None), (1, None), (2, ""), (3, "a b"), (3, "a b"), (None, long), (4, long + " end"), (4, long + " end"), (5, "   ü")]
    check(spark, rows, 35)


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y", ""), (2, "a b c d e", "")], SCHEMA)
    got = {r.doc_id: r.text for r in substrings.without_repeats(docs, 5, texts=True).collect()}
    assert got == {1: "x y", 2: ""}
