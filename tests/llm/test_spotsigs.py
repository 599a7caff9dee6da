"""Fingerprints, their likeness, and the matcher against brute force."""

import base64
import random

import numpy as np
import pytest

from quillon.llm import spotsigs

SCHEMA = "doc_id long, text string, fingerprint string"
FOLD = str.maketrans({c: " " for c in map(chr, range(33, 127)) if not c.isalnum()})


def chains(text):
    """Chains of a text as tuples: an anchor and the next two words that are none; else words and what follows."""
    words = "".join(c.lower() if c.isascii() else c for c in text).translate(FOLD).split()
    content = [w for w in words if w not in spotsigs.ANCHORS]
    made, seen = set(), 0
    for w in words:
        if w in spotsigs.ANCHORS:
            if seen < len(content):
                made.add((w, *(content[seen : seen + 2] + [None, None])[:2]))
        else:
            seen += 1
    if not made:
        made = {(w, *(words[k + 1 : k + 3] + [None, None])[:2]) for k, w in enumerate(words)}
    return made


def like(a, b):
    return float(not a and not b) if not a or not b else len(a & b) / len(a | b)


def texts(n=90):
    draw = random.Random(9)
    rows = []
    for d in range(n):
        if rows and draw.random() < 0.6:
            words = draw.choice(rows)[1].split()
            for _ in range(draw.randrange(6)):
                words[draw.randrange(len(words))] = f"new{draw.randrange(999)}"
            rows.append((d, " ".join(words)))
        else:
            rows.append((d, " ".join(draw.choice(["the", "of", "und", "la", f"w{draw.randrange(200)}", f"v{draw.randrange(200)}", "Über,"]) for _ in range(draw.randrange(30, 200)))))
    return rows


def test_fingerprints_and_likeness_are_those_of_chains(spark):
    rows = [*texts(), (200, "x y z"), (201, "x y z"), (202, "the")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = spotsigs.with_edited(docs).orderBy("doc_id").collect()
    text = dict(rows)
    order = sorted(text)
    for r, after in zip(got, order[1:] + order[:1], strict=True):
        own, other = chains(text[r.doc_id]), chains(text[after])
        cut = len(text[r.doc_id]) // 4
        edited = chains(text[r.doc_id][: len(text[r.doc_id]) - cut] + text[after][:cut])
        assert len(np.frombuffer(base64.b64decode(r.fingerprint), "<u4")) == len(own) and len(base64.b64decode(r.edited_fingerprint)) == 4 * len(edited)
        assert r.near_edited == pytest.approx(like(own, edited)) and r.near_next == pytest.approx(like(own, other))
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[200] == prints[201] != prints[202]


def test_matcher_agrees_with_brute_force(spark):
    rows = [*texts(), (200, ""), (201, None), (None, "x y z"), (202, "x y z"), (202, "x y z")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    sets, root = [chains(t or "") for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if like(sets[a], sets[b]) >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    want = sorted([(d, least.get(find(k))) for k, (d, _) in enumerate(rows)], key=repr)
    assert 20 < len({c for _, c in want}) < 85
    assert sorted(map(tuple, spotsigs.near_duplicates(docs).collect()), key=repr) == want
    assert spotsigs.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    both = spotsigs.with_classes(docs)
    assert sorted(((r.doc_id, r.class_id) for r in both.collect()), key=repr) == want
    assert sorted(map(repr, both.drop("class_id").collect())) == sorted(map(repr, spotsigs.with_edited(docs).collect()))


def test_links_in_large_groups_to_texts_that_are_like_a_representative_are_kept(spark):
    # all texts hold the 30 least signatures, under which they meet; each is like its neighbours only
    made = [f"the a{k} b{k}" for k in range(1000)]
    order = sorted(made, key=lambda x: int(spotsigs.Chains().of([x])[0][0]))
    rows = [(d, " ".join(order[:30] + order[30 + 10 * d : 100 + 10 * d])) for d in range(40)]
    sets = [chains(t) for _, t in rows]
    assert all((like(sets[a], sets[b]) >= 0.8) == (a - b < 2) for a in range(40) for b in range(a))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    assert {tuple(r) for r in spotsigs.near_duplicates(docs).collect()} == {(d, 0) for d in range(40)}


def test_similar_sets_lie_in_neighbouring_partitions():
    for n in range(1, 3000):
        for m in range(-(-4 * n // 5), n + 1):
            assert 0 <= spotsigs.size_partition(n, 0.8) - spotsigs.size_partition(max(m, 1), 0.8) <= 1
