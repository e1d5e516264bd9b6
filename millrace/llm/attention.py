"""A small causal self-attention model in numpy: forward pass, gradients, training.

Inputs are windows of LENGTH slots; the last STRIDE of them predict their next slot.
The prediction is a two-level softmax: the class of the next slot, then the slot in
its class. Both levels start from the logs of the corpus' smoothed slot-pair counts
(fixed tables, by the slot before); one attention head and one hidden layer learn
what the wider context adds to them.
"""

from __future__ import annotations

import contextlib

import numpy as np

SLOTS, CLASS_SIZE = 1024, 32
CLASSES = SLOTS // CLASS_SIZE
WIDTH, HIDDEN = 16, 16
LENGTH, STRIDE = 32, 24
#: The slot that ends a text, and stands before it.
END = 0
#: Weight of the slot frequencies in a slot's pair counts.
PULL = 5.0
_SKIP = LENGTH - STRIDE
_NEVER = np.float32(-1e9)
#: Attention scores and logits are held within this, so that no exponential overflows and no sum vanishes.
_MOST = np.float32(60)


def keep_memory() -> None:
    """Has the C library keep freed arrays for the next ones, instead of mapping fresh pages each time."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 26)
        libc.mallopt(-1, 1 << 27)


def release_memory() -> None:
    """Gives the memory that this process holds free back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shapes() -> dict[str, tuple[int, ...]]:
    """The weights that are learnt."""
    d = WIDTH
    return {
        "embed": (SLOTS, d), "place": (LENGTH, d), "q": (d, d), "kv": (d, 2 * d), "o": (d, d), "up": (d, HIDDEN), "up_bias": (HIDDEN,),
        "down": (HIDDEN, d), "group": (d, CLASSES), "member": (CLASSES, d, CLASS_SIZE),
    }


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights, which hardly move the predictions of the pair tables."""
    rng = np.random.default_rng(seed)
    w = {n: (rng.standard_normal(s) * 0.15).astype(np.float32) for n, s in shapes().items()}
    w["up_bias"][:] = 0
    for n in ("group", "member"):
        w[n] *= np.float32(0.2)
    return w


def pair_tables(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Log shares of each class after each slot, and of each member of a class, from counts (slot before, slot)."""
    u = pairs.sum(axis=0) + 0.5
    share = (pairs + PULL * u / u.sum()) / (pairs.sum(axis=1, keepdims=True) + PULL)
    by_class = share.reshape(SLOTS, CLASSES, CLASS_SIZE)
    group = by_class.sum(axis=2)
    member = np.log(by_class / group[:, :, None]).reshape(-1, CLASS_SIZE)
    return {"pair_group": np.log(group).astype(np.float32), "pair_member": member.astype(np.float32)}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in shapes()])


def views(values: np.ndarray) -> dict[str, np.ndarray]:
    """The weights that lie in one row of numbers, in place."""
    out, at = {}, 0
    for n, s in shapes().items():
        size = int(np.prod(s))
        out[n] = values[at : at + size].reshape(s)
        at += size
    return out


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    return views(values.astype(np.float32))


def windows(slots: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, hidden inputs, targets, their document; -1 none) for texts laid end to end.

    slots holds for each text its slots and END; bounds are the texts' ends from 0.
    Windows overlap by LENGTH - STRIDE inputs, so every slot is a target once, with at
    least that much context where the text has it.
    """
    sizes = np.diff(bounds)
    per = -(-sizes // STRIDE)
    doc = np.repeat(np.arange(len(sizes)), per)
    # Texts laid apart: _SKIP hidden places, END and the slots but the last, up to the last window's end.
    laid = np.full(int(per.sum()) * STRIDE + len(sizes) * _SKIP, END, dtype=slots.dtype)
    away = np.ones(len(laid), dtype=bool)
    targets = np.full(int(per.sum()) * STRIDE, END, dtype=slots.dtype)
    real = np.zeros(len(targets), dtype=bool)
    ends = np.cumsum(per) * STRIDE
    for k, (i, j, to) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), (ends - per * STRIDE).tolist(), strict=True)):
        if i == j:
            continue
        at = to + (k + 1) * _SKIP
        laid[at + 1 : at + j - i] = slots[i : j - 1]
        away[at : at + j - i] = False
        targets[to : to + j - i] = slots[i:j]
        real[to : to + j - i] = True
    if not len(doc):
        return tuple(x.reshape(0, w) for x, w in ((laid[:0], LENGTH), (away[:0], LENGTH), (targets, STRIDE), (doc, STRIDE)))
    start = np.arange(len(doc)) * STRIDE + doc * _SKIP
    rows = np.lib.stride_tricks.sliding_window_view
    real = real.reshape(-1, STRIDE)
    return rows(laid, LENGTH)[start], rows(away, LENGTH)[start], targets.reshape(-1, STRIDE), np.where(real, doc[:, None], -1)


_CAUSAL = np.where(np.arange(LENGTH)[None, :] <= np.arange(_SKIP, LENGTH)[:, None], np.float32(0), _NEVER)


def _row_sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a matrix product."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(a.shape[:-1])


def _row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each row of a with its row of b."""
    return np.einsum("ij,ij->i", a, b)


def _forward(w: dict[str, np.ndarray], inputs: np.ndarray, hidden: np.ndarray) -> tuple:
    """The state of each target, last, and what the gradients need of the way there.

    A head as wide as its input needs no keys or values of its own: queries go through the
    product of both sides' weights to the inputs themselves, and so do outputs. Attention
    is left unnormalised; its sums divide what it mixes.
    """
    n, d = len(inputs), WIDTH
    x = w["embed"].take(inputs.ravel(), axis=0).reshape(n, LENGTH, d)
    x += w["place"]
    recent = x[:, _SKIP:].reshape(-1, d)
    asked = (recent @ ((w["q"] @ w["kv"][:, :d].T) * x.dtype.type(d**-0.5))).reshape(n, STRIDE, d)
    a = asked @ x.transpose(0, 2, 1)
    np.clip(a, -_MOST, _MOST, out=a)
    a += _CAUSAL
    at = np.flatnonzero(hidden.any(axis=1))
    if len(at):
        a[at] += np.where(hidden[at], _NEVER, np.float32(0))[:, None, :]
    np.exp(a, out=a)
    share = 1 / _row_sums(a).reshape(-1, 1)
    mixed = (a @ x).reshape(-1, d)
    mixed *= share
    h1 = mixed @ (w["kv"][:, d:] @ w["o"])
    h1 += recent
    up = h1 @ w["up"]
    up += w["up_bias"]
    np.maximum(up, 0, out=up)
    h = up @ w["down"]
    h += h1
    return x, recent, asked, a, share, mixed, h1, up, h


def _levels(w: dict[str, np.ndarray], h: np.ndarray, before: np.ndarray, t: np.ndarray):
    """For each target, in the order of classes: logits of classes and of members of its own."""
    order = np.argsort((t // CLASS_SIZE).astype(np.int16), kind="stable")
    t = t.take(order)
    group, member = t // CLASS_SIZE, t % CLASS_SIZE
    cut = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
    runs = [(c, cut[c], cut[c + 1]) for c in range(CLASSES) if cut[c] < cut[c + 1]]
    h, before = h.take(order, axis=0), before.take(order)
    z = h @ w["group"]
    z += w["pair_group"].take(before, axis=0)
    np.clip(z, -_MOST, _MOST, out=z)
    m = np.empty((len(h), CLASS_SIZE), h.dtype)
    for c, i, j in runs:
        np.matmul(h[i:j], w["member"][c], out=m[i:j])
    m += w["pair_member"].take(before * CLASSES + group, axis=0)
    np.clip(m, -_MOST, _MOST, out=m)
    cells = np.arange(len(h)) * CLASS_SIZE
    return order, h, runs, z, m, cells // CLASS_SIZE * CLASSES + group, cells + member


def log_probabilities(w: dict[str, np.ndarray], inputs: np.ndarray, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target, in the shape of targets."""
    h = _forward(w, inputs, hidden)[-1]
    order, _, _, z, m, at_z, at_m = _levels(w, h, inputs[:, _SKIP:].ravel(), targets.ravel())
    found = z.ravel().take(at_z) + m.ravel().take(at_m)
    found -= np.log(_row_sums(np.exp(z, out=z))) + np.log(_row_sums(np.exp(m, out=m)))
    out = np.empty_like(found)
    out[order] = found
    return out.reshape(targets.shape)


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, hidden: np.ndarray, targets: np.ndarray, real: np.ndarray, loss: bool = True) -> tuple[float | None, dict[str, np.ndarray]]:
    """Mean loss over the real targets (None if not asked for) and its gradient by the learnt weights."""
    n, d = len(inputs), WIDTH
    x, recent, asked, a, share, mixed, h1, up, h = _forward(w, inputs, hidden)
    order, hs, runs, z, m, at_z, at_m = _levels(w, h, inputs[:, _SKIP:].ravel(), targets.ravel())
    weight = (real.ravel() / max(1, int(real.sum()))).astype(h.dtype).take(order)
    chosen = z.ravel().take(at_z) + m.ravel().take(at_m) if loss else None
    e, em = np.exp(z, out=z), np.exp(m, out=m)
    total, total_m = _row_sums(e), _row_sums(em)
    mean = -float(((chosen - np.log(total) - np.log(total_m)) * weight).sum()) if loss else None
    g = {}
    e *= (weight / total)[:, None]
    e.reshape(-1)[at_z] -= weight
    em *= (weight / total_m)[:, None]
    em.reshape(-1)[at_m] -= weight
    g["group"] = hs.T @ e
    g["member"], back = np.zeros_like(w["member"]), np.empty_like(hs)
    for c, i, j in runs:
        np.matmul(hs[i:j].T, em[i:j], out=g["member"][c])
        np.matmul(em[i:j], w["member"][c].T, out=back[i:j])
    back += e @ w["group"].T
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    dh = back.take(place, axis=0)
    du = dh @ w["down"].T
    du *= up > 0
    g["down"], g["up"], g["up_bias"] = up.T @ dh, h1.T @ du, np.ones(len(du), du.dtype) @ du
    dh += du @ w["up"].T
    key, value, scale = w["kv"][:, :d], w["kv"][:, d:], x.dtype.type(d**-0.5)
    by_out = mixed.T @ dh
    g["o"] = value.T @ by_out
    dm = dh @ (value @ w["o"]).T
    dm *= share
    rest = _row_dots(mixed, dm).reshape(n, STRIDE, 1)
    dm = dm.reshape(n, STRIDE, d)
    ds = dm @ x.transpose(0, 2, 1)
    ds -= rest
    ds *= a
    d_asked = (ds @ x).reshape(-1, d)
    by_asked = (recent.T @ d_asked) * scale
    g["q"] = by_asked @ key
    g["kv"] = np.concatenate((by_asked.T @ w["q"], by_out @ w["o"].T), axis=1)
    dx = a.transpose(0, 2, 1) @ dm
    dx += ds.transpose(0, 2, 1) @ asked
    dh += d_asked @ ((w["q"] @ key.T).T * scale)
    dx[:, _SKIP:] += dh.reshape(n, STRIDE, d)
    g["place"] = (np.ones(n, dx.dtype) @ dx.reshape(n, -1)).reshape(LENGTH, d)
    at = inputs.ravel()
    by = np.argsort(at.astype(np.int16), kind="stable")
    at = at.take(by)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][at[first]] = np.add.reduceat(dx.reshape(-1, d).take(by, axis=0), first, axis=0)
    return mean, g


def learn(w: dict[str, np.ndarray], batches, rate: float = 0.01) -> tuple[dict[str, np.ndarray], int]:
    """Adam over batches of (inputs, hidden, targets, real); the weights after them and how many windows were seen."""
    own = flat(w)
    fixed, m, s, part = {n: v for n, v in w.items() if n not in shapes()}, np.zeros_like(own), np.zeros_like(own), np.empty_like(own)
    w = views(own) | fixed
    seen = 0
    for i, batch in enumerate(batches, 1):
        g = flat(gradients(w, *batch, loss=False)[1])
        seen += len(batch[0])
        # m += 0.1 (g - m), s += 0.01 (g g - s), own -= rate (m / (1 - 0.9^i)) / (sqrt(s / (1 - 0.99^i)) + 1e-8)
        np.subtract(g, m, out=part)
        part *= np.float32(0.1)
        m += part
        g *= g
        g -= s
        g *= np.float32(0.01)
        s += g
        np.multiply(s, np.float32(1 / (1 - 0.99**i)), out=part)
        np.sqrt(part, out=part)
        part += np.float32(1e-8)
        np.divide(m, part, out=part)
        part *= np.float32(rate / (1 - 0.9**i))
        own -= part
    return w, seen
