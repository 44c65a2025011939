"""A causal self-attention model over subword ids, in numpy.

A window's tokens look back at each other through one masked attention layer; what comes out,
with a bias by the kind of the last token, weighs EXPERTS distributions over the next id. Those are
counted, not trained: expert k is how ids follow tokens of kind k in the whole training corpus.
Windows overlap, so that a position that isn't near a text's start has OVERLAP tokens before it at least, and every token is
scored once."""

from __future__ import annotations

import numpy as np

WIDTH, WINDOW, OVERLAP, EXPERTS = 8, 32, 4, 24
OWN_ROWS, SHARED_ROWS = 2048, 256
BLOCK = 128  # windows at a time, so that a block's numbers stay near the core
SUM = np.ones((WINDOW, 1), np.float32)  # by a product: faster than sums of short rows
SUM_EXPERTS = np.ones((EXPERTS, 1), np.float32)
MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
    return {
        "tokens": small(OWN_ROWS + SHARED_ROWS, WIDTH, by=0.3),
        "places": small(WINDOW, WIDTH),
        "look": small(WIDTH, WIDTH),
        "take": small(WIDTH, WIDTH),
        "out": small(WIDTH, EXPERTS),
        "kinds": (5 * np.eye(EXPERTS)).astype(np.float32),
    }


def windows(lengths: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of these lengths, laid end to end: the places in each window, which of them are
    there, and which are scored in it."""
    step = WINDOW - overlap
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    text = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(lengths) - lengths)[text]
    inner = ((nth * step)[:, None] + np.arange(WINDOW)).astype(np.int32)
    there = inner < lengths[text][:, None]
    scored = there & ((nth == 0)[:, None] | (np.arange(WINDOW) >= overlap))
    return np.where(there, begin.astype(np.int32)[:, None] + inner, np.int32(0)), there, scored


def weights(p: dict[str, np.ndarray], rows: np.ndarray, kinds: np.ndarray):
    """Unnormalised weights of the experts after every token, and what the gradient needs."""
    h = p["tokens"].take(rows, axis=0)
    h += p["places"]
    flat = h.reshape(-1, WIDTH)
    q = (flat @ p["look"]).reshape(h.shape)
    a = q @ np.ascontiguousarray(h.transpose(0, 2, 1))
    np.minimum(a, 40, out=a)
    np.exp(a, out=a)
    a *= MASK
    a /= a @ SUM
    u = (flat @ p["take"]).reshape(h.shape)
    z = a @ u
    z += h
    logits = z.reshape(-1, WIDTH) @ p["out"]
    logits += p["kinds"].take(kinds.reshape(-1), axis=0)
    np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    return logits, (h, q, a, u, z)


def log10_probabilities(p: dict[str, np.ndarray], inputs: tuple[np.ndarray, np.ndarray], targets: np.ndarray, experts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each target given the inputs (embedding rows and kinds) up to its place."""
    out = np.empty(len(targets), np.float64)
    places, _, scored = windows(lengths)
    for at in range(0, len(places), BLOCK):
        own, mask = places[at : at + BLOCK], scored[at : at + BLOCK]
        e, _ = weights(p, inputs[0][own], inputs[1][own])
        mask = mask.reshape(-1)
        e, own = e[mask], own.reshape(-1)[mask]
        out[own] = np.log10(((e * experts.take(targets[own], axis=0)) @ SUM_EXPERTS / (e @ SUM_EXPERTS))[:, 0])
    return out


def summed_rows(size: int, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per number below size, the sum of the rows that have it."""
    width = rows.shape[1]
    if size <= EXPERTS:  # few: a product
        return (which[:, None] == np.arange(size, dtype=which.dtype)).astype(np.float32).T @ rows
    cells = which[:, None] * np.int64(width) + np.arange(width)
    return np.bincount(cells.reshape(-1), rows.reshape(-1), size * width).reshape(size, width).astype(np.float32)


def gradients(p: dict[str, np.ndarray], rows: np.ndarray, kinds: np.ndarray, x: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood; x: the experts' probabilities of the targets (overwritten)."""
    e, (h, q, a, u, z) = weights(p, rows, kinds)
    x *= e
    mask = there.reshape(-1, 1).astype(np.float32)
    mask /= max(1.0, float(mask.sum()))
    like, total = x @ SUM_EXPERTS, e @ SUM_EXPERTS
    e *= mask / total
    x *= mask / like
    e -= x
    d, flat_z = e, z.reshape(-1, WIDTH)
    g = {"out": flat_z.T @ d, "kinds": summed_rows(len(p["kinds"]), kinds.reshape(-1), d)}
    dz = (d @ p["out"].T).reshape(z.shape)
    du = a.transpose(0, 2, 1) @ dz
    ds = dz @ np.ascontiguousarray(u.transpose(0, 2, 1))
    ds *= a
    ds -= a * (ds @ SUM)
    dq = (ds @ h).reshape(-1, WIDTH)
    flat, du = h.reshape(-1, WIDTH), du.reshape(-1, WIDTH)
    dh = ds.transpose(0, 2, 1) @ q
    dh += dz
    dh = dh.reshape(-1, WIDTH)
    dh += dq @ p["look"].T
    dh += du @ p["take"].T
    g["look"], g["take"] = flat.T @ dq, flat.T @ du
    g["places"] = dh.reshape(h.shape).sum(0)
    g["tokens"] = summed_rows(len(p["tokens"]), rows.reshape(-1), dh)
    return g


def trained(p: dict[str, np.ndarray], rows: np.ndarray, kinds: np.ndarray, targets: np.ndarray, experts: np.ndarray, lengths: np.ndarray, rate: float, batch: int = 128, seed: int = 0) -> dict[str, np.ndarray]:
    """One pass of Adam over all windows of some texts, in seeded order; the rate falls to zero in a straight line."""
    p = {k: v.copy() for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    places, there, _ = windows(lengths, 0)  # every token is in one window
    order = np.random.default_rng(seed).permutation(len(places))
    steps = -(-len(order) // batch)
    for step in range(steps):
        chosen = order[step * batch : (step + 1) * batch]
        own = places[chosen]
        g = gradients(p, rows[own], kinds[own], experts.take(targets[own].reshape(-1), axis=0), there[chosen])
        now = np.float32(rate * (1 - step / steps))
        for k in p:
            m, v = first[k], second[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g[k]
            v *= np.float32(0.99)
            v += np.float32(0.01) * np.square(g[k])
            p[k] -= now / np.float32(1 - 0.9 ** (step + 1)) * m / (np.sqrt(v / np.float32(1 - 0.99 ** (step + 1))) + np.float32(1e-8))
    return p
