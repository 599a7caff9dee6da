"""Packing, token counts, toxicity, mixing and fingerprints against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import mixing, packing, spotsigs, token_counts, toxicity

SCHEMA = "doc_id long, text string, source string, length string"


def rows(n=150):
    draw = random.Random(4)
    made = []
    for d in range(n):
        words = [draw.choice(["the", "of", "Ünder", "qx7", "straße", "hello", "a,b", "<|endoftext|>", "x" * 30]) + str(draw.randrange(60)) for _ in range(draw.choice([0, 1, 20, 400, 3000]))]
        made.append((d, draw.choice([" ", "\n", "  ", "\t"]).join(words), draw.choice(["a", "b", "c", None]), "x"))
    return [*made, (None, None, None, "x"), (7, None, "a", "x"), (8, "", "é", "x"), (8, "", "é", "x"), (500, "long " * 20_000, "a", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def encoded():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([r[1] or "" for r in rows()], add_special_tokens=False)]


def test_packing_is_an_exact_round_trip(spark, docs, encoded):
    got = packing.pack(docs, shard=100_000).collect()
    want = Counter((r[0], len(ids) + 1) for r, ids in zip(rows(), encoded, strict=True))
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    ids = {(r[0], len(x) + 1): np.append(x, packing.END).astype("<u4") for r, x in zip(rows(), encoded, strict=True)}
    for r in got:
        assert zlib.crc32(ids[r.doc_id, r.doc_tokens][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in encoded)


def test_neighbours_agree_with_brute_force():
    """BM25 over all terms of the seed, with idf log((n - df + 0.5) / (df + 0.5)) and not below zero."""
    draw = np.random.default_rng(5)
    docs = [draw.zipf(1.3, draw.integers(1, 120)) % 400 for _ in range(200)]
    counts = np.array([len(d) for d in docs])
    index = packing.Index(np.concatenate(docs), counts, 400)
    n, mean = len(docs), counts.mean()
    df = Counter(t for d in docs for t in set(d.tolist()))
    used = draw.random(n) < 0.3
    for seed in range(0, n, 7):
        want = {}
        for k, d in enumerate(docs):
            tf = Counter(d.tolist())
            score = sum(max(np.log((n - df[t] + 0.5) / (df[t] + 0.5)), 0) * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) for t in set(docs[seed].tolist()) if tf[t] and df[t] > 1)
            if score > 0 and not used[k]:
                want[k] = score
        got = list(index.nearest(seed, used))
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_token_counts(docs, encoded):
    lengths = [len(x) for x in encoded]
    for r in token_counts.token_counts(docs).collect():
        assert r.n_docs == lengths.count(r.length) and r.n_at_most == sum(n <= r.length for n in lengths)
        assert r.truncated_total == sum(min(n, r.length) for n in lengths) and r.total_tokens == sum(lengths)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (repr(r.doc_id), r.size, repr(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows()) and all(r.taken <= 2 * r.size for r in got)
    sizes = Counter()
    for r in rows():
        sizes[r[2]] += len((r[1] or "").encode().split())
    left, targets = 1.5 * sum(sizes.values()), {}
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1) * 9, strict=False))
    todo = set(sizes)
    while todo:
        level = left / sum(weights[s] for s in todo)
        full = {s for s in todo if level * weights[s] >= 2 * sizes[s]}
        for s in full or todo:
            targets[s] = 2 * sizes[s] if full else level * weights[s]
        left -= sum(targets[s] for s in full)
        todo = todo - full if full else set()
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(targets[s]) and r.source_size == sizes[s] for r in own)
    copies = {(d, t, s): 0 for d, t, s, _ in rows()}
    for r in mixing.mixed_documents(docs).collect():
        copies[r.doc_id, r.text, r.source] += 1
    assert sum(len((t or "").split()) * n for (_, t, _), n in copies.items()) == sum(r.taken for r in got)


def test_fingerprints(docs):
    got = spotsigs.with_edited(docs).collect()
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = Counter()
    for own, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = own[1] or "", after[1] or ""
        cut = len(text) // 4
        want[own[0], len(text), hashlib.sha256((text[: len(text) - cut] + other[:cut]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_toxicity(spark):
    draw = random.Random(1)
    common, bad = [f"word{k}" for k in range(300)], [f"vile{k}" for k in range(12)]
    made, labels = [], []
    for d in range(900):
        toxic = int(draw.random() < 0.2)
        words = [draw.choice(common) for _ in range(draw.randrange(30, 200))]
        if toxic:
            at = draw.randrange(len(words))
            words[at:at] = [draw.choice(bad) for _ in range(8)]
        made.append((d, " ".join(words), "s", "x"))
        labels.append((d, 1, toxic))
    made += [(None, None, None, "x"), (2000, "", "s", "x"), (2001, None, "s", "x")]
    docs, known = spark.createDataFrame(made, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {d: t for d, _, t in labels}
    got = toxicity.toxicity(docs, known).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(made)
    assert len({r.score for r in got if r.doc_id in (None, 2000, 2001)}) == 1


def test_segments():
    draw = random.Random(0)
    for _ in range(200):
        scores = [draw.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(draw.randrange(0, 30))]

        def brute(a, z):
            best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, z) for j in range(i + 1, z + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return [*brute(a, best[2]), best[0], *brute(best[3], z)]

        assert sorted(toxicity.segments(scores)) == pytest.approx(sorted(brute(0, len(scores))))


def test_empty_tables(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for found in (packing.pack(empty), token_counts.token_counts(empty), mixing.mix(empty), mixing.mixed_documents(empty), spotsigs.with_edited(empty), toxicity.toxicity(empty, labels)):
        assert found.collect() == []


def test_toxicity_counts_mild_words_and_all_segments(spark):
    made, labels = [], []
    for d in range(1000):
        toxic, k = int(d % 2 == 0), d // 2 % 50
        words = [f"plain{d}", *["calm"] * 60, *(["mild"] if k < (30 if toxic else 20) else []), *([*["awful"] * 8, *["calm"] * 600] * (90 + d % 7) if d % 50 == 6 else [])]
        made.append((d, " ".join([*words, *(["awful"] if toxic and k % 3 else [])]), "x"))
        labels.append((d, 1, toxic))
    docs, known = spark.createDataFrame(made, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert model.lexicon["=mild"][1] > 0 and "=calm" not in model.lexicon
    used = {r.doc_id for r in known.where(toxicity.remainder(toxicity.F.col("doc_id"), 5) != 0).collect()}
    seen = sorted((y, model.evidence(*model.raw(t.encode(), model.scores()))) for (d, t, _), (_, _, y) in zip(made, labels, strict=True) if d in used)
    weights = model.weights
    assert max(np.expm1(x[1]) for _, x in seen) > 64
    model.weigh([x for _, x in seen], np.array([y for y, _ in seen], float))
    assert model.weights == pytest.approx(weights)


def test_segments_in_linear_time():
    step = [1.0, -1.5]  # every candidate starts lower than all before it
    began = time.process_time()
    assert toxicity.segments(step * 30_000) == [1.0] * 30_000
    assert toxicity.segments([0.5, -0.4, -0.2] * 20_000 + [9.0]) == pytest.approx([0.5] * 20_000 + [9.0])
    assert time.process_time() - began < 5


def test_toxicity_of_the_language_of_most_toxic_texts(spark):
    # a little more of the toxic texts are in one language, so all its words are mildly toxic; few words are truly so
    draw = random.Random(3)
    words = [[f"{x}{k}" for k in range(60)] for x in ("uno", "due")]
    made, labels = [], []
    for d in range(3000):
        toxic, long = int(d % 10 == 0), int(draw.random() < (0.7 if d % 10 == 0 else 0.5))
        text = [draw.choice(words[1 - long]) for _ in range(draw.randrange(200, 400))]
        for _ in range(3 if toxic else 0):
            text[draw.randrange(len(text))] = f"vile{draw.randrange(9)}"
        made.append((d, " ".join(text)))
        labels.append((d, toxic))
    got = toxicity.toxicity(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [(r.doc_id % 10 == 0, r.predicted) for r in got.where("held_out").collect()]
    caught, left = [p for y, p in held if y], [1 - p for y, p in held if not y]
    assert np.mean(caught) >= 0.95 and np.mean(left) >= 0.98


def test_words_encoded_in_one_pass_have_their_own_ids():
    from quillon.llm.bpe import ADDED, Encoder

    encoder = Encoder()
    texts = ["", " ", "a  b", "é x ü", f"x{ADDED}y {ADDED}", "one\ttwo \nthree", "\U0001f600 \U0001f600ab  ", "ends  ", "a b c a"]
    for _ in range(2):  # the second time all words are known
        assert [x.tolist() for x in encoder.encode(texts)] == [encoder.whole(t) for t in texts]
    assert encoder.encode(texts[::-1] + ["new words é  twice"])[-1].tolist() == encoder.whole("new words é  twice")
    assert encoder.lengths(texts).tolist() == [len(encoder.whole(t)) for t in texts]
