import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quillon.llm import attention as A
from quillon.llm import lm

SCHEMA = "doc_id long, text string, score string"


def texts(n=240):
    draw = random.Random(3)
    tongues = [[a + b for a in x for b in x] for x in (["ba", "to", "ri", "nel"], ["öz", "üm", "kla", "ver"])]
    return [(k, " ".join(draw.choice(tongues[k % 2]).capitalize() for _ in range(draw.randrange(20, 120)))) for k in range(n)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [*texts(), (500, None), (501, ""), (None, "ba to"), (7, "Zq Zq"), (7, "Zq Zq"), (502, "x" * 3000 + " y z   " + " ".join(f"w{k % 977}" for k in range(20_000)))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    return rows, lm.lm_scores(docs).toPandas()


def low(text):
    return (text or "").encode().lower().split()


def test_base_score(scored):
    rows, got = scored
    train = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0
    c = Counter()
    for d, t in rows:
        if train(d):
            c.update(low(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        tokens = [*low(t), None]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        want.append((-1 if d is None else d, not train(d), len(tokens), sum(c[x] > 0 for x in tokens), n, round(base, 4)))
    got = got.fillna({"doc_id": -1})
    have = [(int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.itertuples()]
    assert [x[:5] for x in sorted(have)] == [x[:5] for x in sorted(want)]
    assert np.allclose([x[5] for x in sorted(have)], [x[5] for x in sorted(want)], rtol=1e-6, atol=1e-3)


def test_held_out_texts_gain(scored):
    _, got = scored
    held = got[got.held_out & (got.n_tokens > 10)]
    assert len(held) and held.score.sum() > held.base_score.sum()
    assert (got.score < 0).all() and np.isfinite(got.score).all()


def test_equal_texts_score_alike(scored):
    _, got = scored
    same = got[(got.doc_id == 7) & (got.n_tokens == 3)].score
    assert len(same) == 2 and same.nunique() == 1


def test_empty_table(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gradient():
    draw = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in A.fresh(np.zeros(A.CLASSES)).items()}
    p["r"] = draw.normal(size=A.WIDTH)
    x = draw.normal(size=(2, A.WIDTH, A.D))
    target, weight = draw.integers(0, A.CLASSES, (2, A.WIDTH)), (draw.random((2, A.WIDTH)) < 0.7).astype(float)

    def loss(p, x):
        (h,) = A.attend(p, x)
        return -(A.log_probs(p, h, target.ravel()) * weight.ravel()).sum() / weight.sum()

    grads, gx = A.gradient(p, None, x, target, weight)
    for name, at in [("Q", (1, 2)), ("K", (3, 4)), ("V", (0, 5)), ("W", (2, 3)), ("O", (4, 9)), ("b", (7,)), ("r", (3,)), ("w", (5,))]:
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert grads[name][at] == pytest.approx((loss(up, x) - loss(down, x)) / 2e-4, rel=2e-2, abs=1e-6)
    up, down = x.copy(), x.copy()
    up[1, 5, 3] += 1e-4
    down[1, 5, 3] -= 1e-4
    assert gx[1, 5, 3] == pytest.approx((loss(p, up) - loss(p, down)) / 2e-4, rel=2e-2, abs=1e-6)


def test_the_future_is_masked_and_windows_tile():
    p = A.fresh(np.zeros(A.CLASSES))
    x = np.random.default_rng(1).normal(size=(1, A.WIDTH, A.D)).astype(np.float32)
    y = x.copy()
    y[0, 40:] = 9
    a, b = (A.attend(p, v)[0].reshape(A.WIDTH, -1) for v in (x, y))
    assert np.allclose(a[:40], b[:40]) and not np.allclose(a[40:], b[40:])
    for n in (1, 63, 64, 65, 112, 113, 500, 4000):
        scored = [s + k for s in A.starts(n) for k in range(A.WIDTH - A.STRIDE if s else 0, A.WIDTH) if s + k < n]
        assert sorted(scored) == list(range(n))


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(2)
    first, rest = draw.integers(0, 50, lm.PIECES), draw.integers(0, 9, lm.PIECES)
    v = lm.Vocabulary(first, rest, (first > 0).astype(int), draw.integers(0, 3, (lm.NEAR + 1) ** 2).astype(float), 100, 10)
    assert np.bincount(v.cls, np.exp(v.in_class), A.CLASSES)[1:].round(6).tolist() == [1.0] * (A.CLASSES - 1)
    assert np.exp(v.after).sum(1) == pytest.approx(1, abs=1e-4)
    assert np.bincount(np.arange(lm.PIECES) % lm.NEAR, np.exp(v.in_near)) == pytest.approx(1)


def test_blocks_write_less_than_their_texts(spark):
    # what is checkpointed must stay under the texts: windows of all training texts were more than that
    from quillon.llm.common import set_checkpoint_dir

    set_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    used = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    draw = random.Random(5)
    words = ["".join(draw.choice(["ka", "lo", "mer", "st", "ing", "ab"]) for _ in range(draw.randrange(1, 5))) for _ in range(900)]
    rows = [(k, " ".join(draw.choice(words) for _ in range(400)), "x") for k in range(1500)]
    before = used()
    assert lm.lm_scores(spark.createDataFrame(rows, SCHEMA)).count() == 1500
    assert used() - before < 0.4 * sum(len(t) for _, t, _ in rows)


def test_blocks_are_read_as_written():
    texts = [b"Ka lo\x0bMER \xc2\xa0st", b"", "x  lo ka ".encode(), b" the  end "]
    made = lm._block(5, [[3, None, 1, 2], texts, [True, True, False, True], [1, -2, 3, 4]], None, 4)
    rows = {k: x for k, x in zip(made.column(0).to_pylist(), made.column(3).to_pylist(), strict=True)}
    own = lm.Block.read(rows[2])
    words = lm.Words(None)
    number, counts, hashes, names = words.split(texts)
    assert [names[k] for k in number] == [w for t in texts for w in t.lower().split()] and counts.tolist() == [4, 0, 3, 2]
    assert own.number.tolist() == number.tolist() and own.counts.tolist() == counts.tolist() and own.no_id.tolist() == [0, 1, 0, 0]
    cuts = np.split(own.flat, np.cumsum(own.sizes)[:-1])
    assert [c.tolist() for c in cuts] == [words.bpe.encode_ordinary(" " + n.decode()) for n in names]
    every = [a for v in (lm._windows(lm.Vocabulary(*[np.ones(lm.PIECES)] * 3, np.ones((lm.NEAR + 1) ** 2), 1, 1), own, t) for t in range(len(lm.ROUNDS))) for a in v.weight.sum(1).tolist()]
    assert sorted(every) == [1, 3, 5]  # each training text's words and end, once
