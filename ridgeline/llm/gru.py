"""A gated recurrent language model in numpy, with a class-factored output.

Ids 0 up to ``classes * members`` fall into classes of equal size in order.
The probability of an id is that of its class times that of its place in the
class, each a softmax of the state, so a token costs classes + members
exponentials rather than one for each id.

The three gates are kept apart, so every array of a step is contiguous.
"""

from __future__ import annotations

import numpy as np

HIDDEN, EMBED, CLASSES, MEMBERS = 24, 16, 48, 48
IDS = CLASSES * MEMBERS
#: Steps that gradients flow back through, and that states are computed for at a time.
WINDOW = 16
#: Tokens whose output is computed at a time in scoring.
TOGETHER = 16_384
_SHAPES = {"emb": (IDS, EMBED), "wx": (EMBED, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (CLASSES, HIDDEN), "bc": (CLASSES,), "ww": (CLASSES, MEMBERS, HIDDEN), "bw": (CLASSES, MEMBERS)}

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray, seed: int = 3) -> Params:
    """Random weights; output biases at the ids' log frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.normal(0, 0.3 if k == "emb" else 1 / np.sqrt(s[-2] if k not in ("wc", "ww") else s[-1]), s) if len(s) > 1 and k != "bw" else np.zeros(s)) for k, s in _SHAPES.items()}
    p["wc"], p["ww"] = p["wc"] * 0.1, p["ww"] * 0.1
    mass = (np.asarray(counts, np.float64) + 0.1).reshape(CLASSES, MEMBERS)
    p["bc"], p["bw"] = np.log(mass.sum(axis=1) / mass.sum()), np.log(mass / mass.sum(axis=1, keepdims=True))
    return {k: v.astype(np.float32) for k, v in p.items()}


def pack(p: Params) -> bytes:
    return np.concatenate([p[k].ravel() for k in _SHAPES]).astype(np.float32).tobytes()


def unpack(data: bytes) -> Params:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


def input_table(p: Params) -> np.ndarray:
    """What each id as input adds to the gates, as states() takes it: a table (ids by HIDDEN) for each of the three, the first two negated and the last doubled and negated."""
    x = p["emb"] @ p["wx"]
    x += p["b"]
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2)) * np.array([-1, -1, -2], x.dtype)[:, None, None]


def _logistic(x: np.ndarray) -> None:
    """x becomes 1 / (1 + exp(x))."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


@np.errstate(over="ignore")
def states(p: Params, table: np.ndarray, ids: np.ndarray, h: np.ndarray, keep: bool = False, fresh: np.ndarray | None = None):
    """The states (steps by texts by HIDDEN) after each step of ids (steps by texts), from h on, or from zero at a step where fresh; and with keep, what backward needs as well."""
    hid = HIDDEN
    ur, uz, un = (np.ascontiguousarray(p["u"][:, k * hid : (k + 1) * hid]) * p["u"].dtype.type(by) for k, by in enumerate((-1, -1, -2)))
    rs, zs, ns = (t.take(ids, axis=0) for t in table)
    out = np.empty_like(ns)
    before = np.empty_like(ns) if keep else None
    for t in range(len(ids)):
        if fresh is not None and fresh[t].any():
            h = h * ~fresh[t][:, None]
        r, z, n = rs[t], zs[t], ns[t]
        r += h @ ur
        _logistic(r)
        z += h @ uz
        _logistic(z)
        n += (r * h) @ un
        _logistic(n)
        n *= 2
        n -= 1
        if keep:
            before[t] = h
        new = np.subtract(h, n, out=out[t])
        new *= z
        new += n
        h = new
    return (out, h, (before, rs, zs, ns)) if keep else (out, h)


def log_probs(p: Params, x: np.ndarray, ids: np.ndarray, grads: Params | None = None):
    """Natural log of the probability of each id given its state (rows of x); with grads, adds to them and returns the states' gradient as well.  The loss is the mean."""
    n = len(ids)
    cls, member = (ids // MEMBERS).astype(np.uint8), ids % MEMBERS
    order = np.argsort(cls, kind="stable")  # by radix, as one byte is
    x, cls, member = x.take(order, axis=0), cls[order], member[order]
    at = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    every = np.arange(n)
    e = x @ p["wc"].T
    e += p["bc"]
    picked = e[every, cls]
    np.exp(e, out=e)
    total = e.sum(axis=1)
    found = picked - np.log(total)
    dx = None
    if grads is not None:
        share = e.dtype.type(1 / n)
        e *= (share / total)[:, None]
        e[every, cls] -= share
        dx = e @ p["wc"]
        grads["wc"] += e.T @ x
        grads["bc"] += e.sum(axis=0)
    for c in range(CLASSES):
        a, b = at[c], at[c + 1]
        if a == b:
            continue
        part, weights = x[a:b], p["ww"][c]
        e = part @ weights.T
        e += p["bw"][c]
        own, place = member[a:b], every[: b - a]
        picked = e[place, own]
        np.exp(e, out=e)
        total = e.sum(axis=1)
        found[a:b] += picked - np.log(total)
        if grads is not None:
            e *= (share / total)[:, None]
            e[place, own] -= share
            dx[a:b] += e @ weights
            grads["ww"][c] = e.T @ part
            grads["bw"][c] = e.sum(axis=0)
    out = np.empty_like(found)
    out[order] = found
    if grads is None:
        return out
    back = np.empty_like(dx)
    back[order] = dx
    return out, back


def gradients(p: Params, ids_in: np.ndarray, ids_out: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, there: np.ndarray | None = None) -> tuple[float, Params, np.ndarray]:
    """Loss and gradients of one window by truncated backpropagation, and the state after it (carried on, without gradient).

    A step where fresh begins a text, from a zero state; only steps that are there count.
    """
    hid, (steps, lanes) = HIDDEN, ids_in.shape
    out, last, (h0, r, z, n) = states(p, input_table(p), ids_in, h, keep=True, fresh=fresh)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    flat, target = out.reshape(-1, hid), ids_out.ravel()
    if there is None or there.all():
        probs, dx = log_probs(p, flat, target, grads)
    else:
        counted = there.ravel()
        probs, found = log_probs(p, flat[counted], target[counted], grads)
        dx = np.zeros_like(flat)
        dx[counted] = found
    dx = dx.reshape(steps, lanes, hid)
    to_n = (1 - z) * (1 - n * n)
    rh = r * h0
    to_r = rh * (1 - r)
    to_z = (h0 - n) * z * (1 - z)
    ur, uz, un = (np.ascontiguousarray(p["u"][:, k * hid : (k + 1) * hid].T) for k in range(3))
    dr, dz, dn = np.empty_like(dx), np.empty_like(dx), np.empty_like(dx)
    back = np.zeros_like(h)
    for t in range(steps - 1, -1, -1):
        d = dx[t]
        d += back
        drh = np.multiply(d, to_n[t], out=dn[t]) @ un
        back = np.multiply(drh, to_r[t], out=dr[t]) @ ur
        back += np.multiply(d, to_z[t], out=dz[t]) @ uz
        drh *= r[t]
        back += drh
        d *= z[t]
        back += d
        if fresh is not None and fresh[t].any():
            back *= ~fresh[t][:, None]
    da = [x.reshape(-1, hid) for x in (dr, dz, dn)]
    before = (h0.reshape(-1, hid), h0.reshape(-1, hid), rh.reshape(-1, hid))
    ids = ids_in.ravel()
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    found, first = np.unique(ids[order], return_index=True)
    inputs = p["emb"][found]
    for k in range(3):
        part = slice(k * hid, (k + 1) * hid)
        grads["u"][:, part] = before[k].T @ da[k]
        by_id = np.add.reduceat(da[k].take(order, axis=0), first, axis=0)
        grads["b"][part] = by_id.sum(axis=0)
        grads["wx"][:, part] = inputs.T @ by_id
        grads["emb"][found] += by_id @ p["wx"][:, part].T
    return float(-probs.mean()), grads, last


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: Params) -> None:
        self.n += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        first, second = np.float32(self.rate / (1 - 0.9**self.n)), np.float32(1 / (1 - 0.99**self.n))
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            g *= clip
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            v *= np.float32(0.99)
            v += g
            np.multiply(v, second, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= first
            self.p[k] -= g


def text_log_probs(p: Params, ids: np.ndarray, at: np.ndarray, begin: int) -> np.ndarray:
    """Log probability of every token of texts ids[at[i]:at[i + 1]]; each text starts from the state after begin and carries its state through all its windows."""
    table = input_table(p)
    lengths = np.diff(at)
    out = np.zeros(len(ids))
    texts = np.argsort(-lengths, kind="stable")
    texts = texts[lengths[texts] > 0]
    _, first = states(p, table, np.full((1, 1), begin), np.zeros((1, HIDDEN), np.float32))
    h = np.repeat(first, len(texts), axis=0)
    start, held, where = 0, [], []

    def score() -> None:
        x, places = np.concatenate(held), np.concatenate(where)
        for a in range(0, len(places), TOGETHER):
            out[places[a : a + TOGETHER]] = log_probs(p, x[a : a + TOGETHER], ids[places[a : a + TOGETHER]])
        held.clear()
        where.clear()

    while len(texts):
        size = min(WINDOW, int(lengths[texts[0]]) - start)
        step = start + np.arange(size)[:, None]
        there = step < lengths[texts][None, :]
        place = np.minimum(at[texts][None, :] + step, len(ids) - 1)
        after, last = states(p, table, ids[place], h)
        # The outputs of few texts wait for those of later windows.
        held.append(np.concatenate([h[None], after[:-1]])[there])
        where.append(place[there])
        if sum(map(len, where)) >= TOGETHER:
            score()
        start += size
        still = int((lengths[texts] > start).sum())  # texts are sorted by length
        texts, h = texts[:still], last[:still]
    if where:
        score()
    return out
