"""Periodic runs against a brute-force search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillon.llm import repetitions

SCHEMA = "doc_id long, text string, runs string, kept string, n long, a string"


def brute_runs(words):
    """Every maximal stretch of every period, those of a smaller period left out."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(12, 2 * q):
                found.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def brute(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts():
    draw = random.Random(3)
    made = []
    for d in range(160):
        words = [draw.choice("abcdefgh"[: draw.randrange(1, 9)]) + draw.choice(["", "é"]) for _ in range(draw.choice([0, 1, 11, 12, 13, 40, 200, 500]))]
        for _ in range(draw.randrange(3)):
            phrase = [f"p{draw.randrange(9)}" for _ in range(draw.choice([1, 2, 3, 7, 12, 30]))]
            at = draw.randrange(len(words) + 1)
            words[at:at] = (phrase * draw.randrange(1, 9))[: draw.randrange(1, 200)]
        made.append((d, draw.choice([" ", "\n", " \t ", "\x0b"]).join(words)))
    return [*made, (None, None), (None, "x " * 30), (7, None), (8, ""), (8, ""), (9, " \n "), (10, "same " * 700), (11, "u v " * 300 + "u u " + "u v " * 300), (10, "same " * 700)]


def test_agrees_with_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "x", "x", 1, "x") for r in rows], SCHEMA)
    got = sorted(map(repr, map(tuple, repetitions.repetitions(docs).collect())))
    assert got == sorted(repr(brute(*r)) for r in rows)


@pytest.mark.parametrize("dense", [0.0, 1e9])
def test_lag_counts_by_either_way(monkeypatch, dense):
    """All words by transforms, then all by pairs."""
    monkeypatch.setattr(repetitions, "DENSE", dense)
    monkeypatch.setattr(repetitions, "PAIRS", 500)
    draw = np.random.default_rng(2)
    parts = [draw.integers(0, k, n) for k, n in ((3, 150), (1, 90), (40, 300), (5, 0), (2, 1), (2, 2))]
    counts = np.array([len(p) for p in parts])
    found, base = repetitions.lag_counts(np.concatenate(parts), counts)
    for d, p in enumerate(parts):
        want = [int((p[q:] == p[: len(p) - q]).sum()) for q in range(1, len(p) // 2 + 1)]
        assert found[base[d] + 1 : base[d + 1]].tolist() == want


def test_long_runs_on_the_grid():
    draw = np.random.default_rng(5)
    for n, q in ((4000, 900), (3000, 17), (5000, 1), (4000, 1999)):
        ids = draw.integers(0, 4, n)
        at = int(draw.integers(0, n - 2 * q))
        ids[at:] = ids[at + np.arange(n - at) % q]
        found, base = repetitions.lag_counts(ids, np.array([n]))
        assert repetitions.runs_of(ids, found) == brute_runs(ids.tolist())


def test_general_operator_returns_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "in the end in the end in the end in the end it stops")], "doc_id int, text string")
    row = repetitions.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 12, 3)] and row.kept == "in the end it stops"


def test_empty_table(spark):
    assert repetitions.repetitions(spark.createDataFrame([], SCHEMA)).collect() == []
