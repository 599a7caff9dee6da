"""A one-layer causal self-attention model in numpy, forward and backward.

Positions are words, given as the ids of their subwords: a position's input is the
mean of its subwords' vectors. Each position attends to itself and to those before it
in its window (content and distance decide), and predicts the class of the first
subword of the next word. Classes are frequent subwords, groups of rarer ones and the
end of the text; their log frequencies start the output's bias. The output is in two
steps, a branch of classes of neighbouring ranks and the class within it, each with a
softmax of its own, so a position costs the branches and one branch's classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

D, HIDDEN, CLASSES, WIDTH, STRIDE = 16, 32, 256, 64, 48
#: Inputs: BOS, then the most frequent subwords, then the rest shared by id.
SLOTS, FREQUENT = 4096, 3584
BOS = 0
#: Branches of classes, of equal numbers of them.
BRANCHES = 16
BATCH = 32
#: Longest gradient of a step.
CLIP = 1.0
_NEG = np.float32(-1e9)
#: Subwords of a word that are added place by place.
FEW = 4


def fresh(bias: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    f = lambda *s, scale: (draw.normal(0, scale, s)).astype(np.float32)
    mass = np.exp(bias - bias.max()).reshape(BRANCHES, -1).sum(1)
    return {
        "E": f(SLOTS, D, scale=0.3), "Q": f(D, D, scale=0.2), "K": f(D, D, scale=0.2), "V": f(D, D, scale=0.3),
        "r": np.zeros(WIDTH, np.float32), "W": f(2 * D, HIDDEN, scale=0.25), "w": np.zeros(HIDDEN, np.float32),
        "O": f(HIDDEN, CLASSES, scale=0.05), "b": bias.astype(np.float32),
        "B": f(HIDDEN, BRANCHES, scale=0.05), "c": np.log(mass / mass.sum()).astype(np.float32),
    }


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        found[k] = values[at : at + n].astype(np.float32).reshape(like[k].shape)
        at += n
    return found


_LAG = np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :]
_MASK = np.where(_LAG >= 0, np.float32(0), _NEG)


def _distance(r: np.ndarray) -> np.ndarray:
    return (r[np.maximum(_LAG, 0)] + _MASK).astype(np.float32)


def attend(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False) -> tuple:
    """Hidden states of windows of inputs (n, WIDTH, D), under a causal mask. To keep: the scaled queries, the keys,
    values with a column of ones, weights of the positions before division by their totals, the totals, inputs with contexts."""
    to = np.zeros((D + 1, 3 * D + 1), x.dtype)
    to[:D, : 3 * D] = np.concatenate([p["Q"] * np.float32(D**-0.5), p["K"], p["V"]], 1)
    to[D, 3 * D] = 1
    qkv = np.concatenate([x, np.ones_like(x[..., :1])], -1).reshape(-1, D + 1) @ to
    qkv = qkv.reshape(*x.shape[:2], 3 * D + 1)
    q, k, v = qkv[..., :D], qkv[..., D : 2 * D], qkv[..., 2 * D :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += _distance(p["r"])
    if a.max(initial=0) > 60:  # trained models stay far below; this keeps the sum finite
        np.minimum(a, 60, out=a)
    np.exp(a, out=a)
    c = np.matmul(a, v)
    total = c[..., D:] + np.float32(1e-20)
    xc = np.concatenate([x, c[..., :D] / total], -1)
    h = xc.reshape(-1, 2 * D) @ p["W"]
    h += p["w"]
    np.maximum(h, 0, out=h)
    return (h, q, k, v, a, total, xc) if keep else (h,)


def _shares(z: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of each row, in place, and the natural logarithm of the share of each row's own column."""
    if not np.abs(z).max(initial=0) < 40:  # powers that single precision can add up are taken as they are
        z -= z.max(1, keepdims=True, initial=-np.inf)
    chosen = z[np.arange(len(z)), own]
    np.exp(z, out=z)
    sums = z @ np.ones(z.shape[1], z.dtype)
    z /= sums[:, None]
    return z, chosen - np.log(sums)


def _output(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> tuple:
    """Shares of the branches and of the classes of each row's branch, and the log-probability of its target. Rows, with
    a last column of ones, come in the order of their branches; ``spans`` are those of each."""
    per = CLASSES // BRANCHES
    spans = np.searchsorted(target // per, np.arange(BRANCHES + 1)).tolist()
    first, low = _shares(h @ np.concatenate([p["B"], p["c"][None]]), target // per)
    out = np.concatenate([p["O"], p["b"][None]])
    z = np.empty((len(h), per), np.result_type(h, out))
    for k in range(BRANCHES):
        np.matmul(h[spans[k] : spans[k + 1]], out[:, k * per : (k + 1) * per], out=z[spans[k] : spans[k + 1]])
    second, high = _shares(z, target % per)
    return first, second, low + high, spans


def _with_ones(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones_like(h[:, :1])], 1)


def _by_branch(target: np.ndarray) -> np.ndarray:
    return np.argsort((target // (CLASSES // BRANCHES)).astype(np.uint8), kind="stable")


def log_probs(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log-probability of each row's target class."""
    order = _by_branch(target)
    found = np.empty(len(order), h.dtype)
    found[order] = _output(p, _with_ones(h.take(order, 0)), target[order])[2]
    return found


def gradient(p: dict[str, np.ndarray], mean: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean loss, and of the inputs. target, weight: (n, WIDTH). Positions without a weight
    are no part of the loss and only give context."""
    h, q, k, v, a, total, xc = attend(p, x, keep=True)
    some = np.flatnonzero(weight)
    some = some[_by_branch(target.ravel()[some])]
    t, w = target.ravel()[some], (weight.ravel()[some] / max(float(weight.sum()), 1.0)).astype(h.dtype)
    h, ends = h.take(some, 0), xc.reshape(-1, 2 * D).take(some, 0)
    more = _with_ones(h)
    first, second, _, spans = _output(p, more, t)
    per, rows = CLASSES // BRANCHES, np.arange(len(t))
    first[rows, t // per] -= 1
    second[rows, t % per] -= 1
    first *= w[:, None]
    second *= w[:, None]
    branch, out = more.T @ first, np.empty((HIDDEN + 1, CLASSES), h.dtype)
    gh = first @ p["B"].T
    for b in range(BRANCHES):
        at, own = slice(spans[b], spans[b + 1]), slice(b * per, (b + 1) * per)
        out[:, own] = more[at].T @ second[at]
        gh[at] += second[at] @ p["O"][:, own].T
    gh *= h > 0
    grads = {"B": branch[:-1], "c": branch[-1], "O": out[:-1], "b": out[-1]}
    grads["W"], grads["w"] = ends.T @ gh, gh.sum(0)
    gxc = np.zeros((x.shape[0] * WIDTH, 2 * D), gh.dtype)
    gxc[some] = gh @ p["W"].T
    gxc = gxc.reshape(xc.shape)
    gx, gc = gxc[..., :D].copy(), gxc[..., D:]
    even = gc / total
    gv = np.matmul(a.transpose(0, 2, 1), even)
    gs = np.matmul(even, np.ascontiguousarray(v[..., :D].transpose(0, 2, 1)))
    gs -= np.einsum("nid,nid->ni", even, xc[..., D:])[..., None]  # a row's mean is its context's
    gs *= a
    grads["r"] = np.bincount((_LAG % WIDTH).ravel(), np.tril(gs.sum(0)).ravel(), WIDTH).astype(np.float32)
    gqkv = np.concatenate([np.matmul(gs, k) * np.float32(D**-0.5), np.matmul(gs.transpose(0, 2, 1), q), gv], -1).reshape(-1, 3 * D)
    grads["Q"], grads["K"], grads["V"] = np.split(x.reshape(-1, D).T @ gqkv, 3, axis=1)
    gx += (gqkv @ np.concatenate([p["Q"], p["K"], p["V"]], 1).T).reshape(x.shape)
    return grads, gx


@dataclass
class Windows:
    """Training windows: slots of all positions' subwords one after the other, subwords per
    position, class to predict, and its weight (0 where another window scores it)."""

    slots: np.ndarray
    sizes: np.ndarray
    target: np.ndarray
    weight: np.ndarray


def embed(table: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of each position's vectors; positions without subwords are zero."""
    sums = np.zeros((len(sizes), table.shape[1]), np.float32)
    starts = np.cumsum(sizes) - sizes
    for k in range(FEW):  # most words have few subwords
        more = np.flatnonzero(sizes > k)
        if not len(more):
            return sums / np.maximum(sizes, 1)[:, None].astype(np.float32)
        sums[more] += table.take(slots[starts[more] + k], 0)
    long = np.flatnonzero(sizes > FEW)
    if len(long):
        n = sizes[long] - FEW
        ends = np.cumsum(n)
        at = np.repeat(starts[long] + FEW - (ends - n), n) + np.arange(int(ends[-1]))
        sums[long] += np.add.reduceat(table.take(slots[at], 0), ends - n, axis=0)
    return sums / np.maximum(sizes, 1)[:, None].astype(np.float32)


def train(p: dict[str, np.ndarray], parts: Iterable[Windows], seed: int, rate: float) -> dict[str, np.ndarray]:
    """One pass of Adam over the windows of all parts, each part's in an order drawn from ``seed``."""
    draw, step = np.random.default_rng(seed), 0
    now = flat(p).astype(np.float32)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    at = 0
    for k in sorted(p):
        p[k], at = now[at : at + p[k].size].reshape(p[k].shape), at + p[k].size
    cells = np.arange(SLOTS * D).reshape(SLOTS, D)
    m, s, more = np.zeros_like(now), np.zeros_like(now), np.empty_like(now)
    for data in parts:
        n = len(data.target)
        sizes = data.sizes.reshape(n, WIDTH)
        ends = np.cumsum(data.sizes)
        first = (ends - data.sizes).reshape(n, WIDTH)[:, 0] if n else np.zeros(0, np.int64)
        last = ends.reshape(n, WIDTH)[:, -1] if n else first
        order = draw.permutation(n)
        for a in range(0, n, BATCH):
            step += 1
            who = order[a : a + BATCH]
            slots = np.concatenate([data.slots[x:y] for x, y in zip(first[who].tolist(), last[who].tolist(), strict=True)])
            per = sizes[who].ravel()
            x = embed(p["E"], slots, per).reshape(len(who), WIDTH, D)
            grads, gx = gradient(p, None, x, data.target[who], data.weight[who])
            own = (gx.reshape(-1, D) / np.maximum(per, 1)[:, None].astype(np.float32)).take(np.repeat(np.arange(len(per)), per), 0)
            grads["E"] = np.bincount(cells.take(slots, 0).ravel(), own.ravel(), SLOTS * D)
            g = np.concatenate([grads[k].ravel() for k in sorted(grads)], dtype=np.float32, casting="same_kind")
            length = math.sqrt(float(g @ g))
            if length > CLIP:
                g *= np.float32(CLIP / length)
            m *= np.float32(0.9)
            m += np.multiply(g, np.float32(0.1), out=more)
            s *= np.float32(0.98)
            g *= g
            s += np.multiply(g, np.float32(0.02), out=g)
            np.sqrt(s, out=more)
            more *= np.float32((1 - 0.98**step) ** -0.5)
            more += np.float32(1e-7)
            np.divide(m, more, out=more)
            more *= np.float32(rate / (1 - 0.9**step))
            now -= more
    return p


def starts(n: int) -> list[int]:
    """Where the windows over n positions start."""
    return [0, *range(STRIDE, n - (WIDTH - STRIDE), STRIDE)] if n > WIDTH else [0]


def score(p: dict[str, np.ndarray], table: np.ndarray, places: np.ndarray, targets: np.ndarray, counts: np.ndarray, batch: int = 32) -> np.ndarray:
    """Natural log-probability of each target; texts' positions lie one after the other.

    table: (n, D) inputs, of which ``places`` picks one for each position. Each position is
    scored once, with WIDTH - STRIDE positions or more before it in its window, or all that
    there are."""
    out = np.empty(len(targets), np.float64)
    first = np.cumsum(counts) - counts
    begin = [(int(a) + s, int(a + n), s > 0) for a, n in zip(first.tolist(), counts.tolist(), strict=True) for s in starts(n)]
    at = np.array([b[0] for b in begin], np.int64)
    end = np.array([b[1] for b in begin], np.int64)
    skip = np.array([(WIDTH - STRIDE) * b[2] for b in begin], np.int64)
    padded = np.concatenate([places, np.zeros(WIDTH, np.int64)])
    span = np.arange(WIDTH)
    for k in range(0, len(at), batch):
        where = at[k : k + batch, None] + span
        (h,) = attend(p, table[padded[where]])
        use = (where < end[k : k + batch, None]) & (span >= skip[k : k + batch, None])
        chosen = where[use]
        out[chosen] = log_probs(p, h[use.ravel()], targets[chosen])
    return out
