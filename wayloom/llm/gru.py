"""A gated recurrent language model in numpy, with a class-factored output.

Symbols are numbered so that classes are ranges: the frequent words and the end of a document,
in classes of equal mass, then the hashed symbols of all other words, in classes of equal size. The
probability of a symbol is that of its class times its own within the class. Documents stand one
after another in lanes; the state is set back where a document begins and is carried from one
window to the next otherwise, so windows bound the memory and not the context.

Edge cases: every document has at least its end, so none is empty; a symbol alone in its class has
the class's probability; no documents give no scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EMBED, HIDDEN = 12, 20
LANES, TRAIN_LANES, STEPS = 256, 256, 32
#: AdaGrad's rate, the squares that its sums start from, and their share that a later round goes on with.
RATE, START, KEPT = 0.2, 1e-6, 0.3


@dataclass
class Symbols:
    """Sizes of the classes, and which symbol is the end of a document."""

    size: np.ndarray
    end: int

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)


def initial(symbols: Symbols, mass: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights whose output is the unigram distribution of the given mass."""
    random = np.random.default_rng(seed)
    n, c = len(mass), len(symbols.size)
    p = np.maximum(mass, 0.5)
    of_class = np.add.reduceat(p, symbols.bounds[:-1])
    draw = lambda *s: random.normal(0, 0.15, s).astype(np.float32)
    return {
        "emb": draw(n, EMBED), "wx": draw(EMBED, 3 * HIDDEN), "u": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "wc": np.zeros((HIDDEN, c), np.float32), "bc": np.log(of_class / p.sum()).astype(np.float32),
        "ww": np.zeros((n, HIDDEN), np.float32), "bw": np.log(p / of_class[symbols.of]).astype(np.float32),
    }


def _with_ones(x: np.ndarray) -> np.ndarray:
    """x with a last column of ones, so that a product with weights over a bias adds it."""
    out = np.ones((*x.shape[:-1], x.shape[-1] + 1), x.dtype)
    out[..., :-1] = x
    return out


def run(w: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States after each step of symbols x (steps, lanes); fresh: where a document begins.

    ``keep`` gets what the gradient needs of all steps: inputs (e), states before (h), gates over hn (u) and candidates (n).
    Within a step a feature's lanes lie together, so gates are whole blocks.
    """
    kind = np.result_type(w["u"], np.float32)
    n_steps, n_lanes = x.shape
    out = np.empty((n_steps, HIDDEN, n_lanes), kind)
    sign = np.repeat(np.array([-1, 1], kind), [2 * HIDDEN, HIDDEN])[:, None]  # the logistic gates are 1 / (1 + exp(-x))
    u, wx = sign * w["u"].T, sign * np.vstack([w["wx"], w["b"]]).T
    e, began, given = _with_ones(w["emb"])[x], fresh.any(1), np.empty((3 * HIDDEN, n_lanes), kind)
    rows = n_steps if keep is not None else 1
    us, ns = np.empty((rows, 3 * HIDDEN, n_lanes), kind), np.empty((rows, HIDDEN, n_lanes), kind)
    if keep is not None:
        keep |= {"e": e, "h": np.empty_like(out), "u": us, "n": ns}
    h = np.ascontiguousarray(h.T, kind)
    for t in range(n_steps):
        if began[t]:
            h = h * ~fresh[t]
        if keep is not None:
            keep["h"][t] = h
        np.matmul(wx, e[t].T, out=given)
        both, n = us[t % rows], ns[t % rows]
        np.matmul(u, h, out=both)
        zr = both[: 2 * HIDDEN]
        zr += given[: 2 * HIDDEN]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[HIDDEN:], both[2 * HIDDEN :], out=n)
        n += given[2 * HIDDEN :]
        np.tanh(n, out=n)
        h = np.subtract(h, n, out=out[t])
        h *= zr[:HIDDEN]
        h += n
    return out.transpose(0, 2, 1)


#: Rows of states whose class probabilities are held at once.
ROWS = 2048


def _bound(weights: np.ndarray) -> float:
    """No logit of a state, which lies within -1 and 1, is larger in size."""
    return float(np.abs(weights).sum(1).max())


def _softmax(h: np.ndarray, weights: np.ndarray, y: np.ndarray, most: float, grad: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of y, sums of exponentials, and, for the gradient, probabilities less one at y; ``most`` bounds the logits' size."""
    e = h @ weights.T
    if most > 60:  # some may be too large for exp
        e -= e.max(1, keepdims=True)
    at = (np.arange(len(y)), y)
    own = e[at]
    np.exp(e, out=e)
    total = e @ np.ones(e.shape[1], e.dtype)
    if grad:
        e *= (1 / total)[:, None]
        e[at] -= 1
    return own, total, e


def log_p(w: dict, symbols: Symbols, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> np.ndarray:
    """Natural log-probability of each y after each state h; grad gets the gradient of their negative sum."""
    h, learns = _with_ones(h), grad is not None
    of_class, of_symbol = np.vstack([w["wc"], w["bc"]]).T.copy(), np.column_stack([w["ww"], w["bw"]])
    c = symbols.of[y].astype(np.int16)  # sixteen bits sort by radix
    own, total = np.empty((2, len(y)), h.dtype)
    most = _bound(of_class)
    if learns:
        g_class, g_symbol, dh = np.zeros_like(of_class), np.zeros_like(of_symbol), np.empty((len(y), HIDDEN), h.dtype)
    for a in range(0, len(y), ROWS):
        part = slice(a, a + ROWS)
        own[part], total[part], p = _softmax(h[part], of_class, c[part], most, learns)
        if learns:
            g_class += p.T @ h[part]
            np.matmul(p, of_class[:, :-1], out=dh[part])
    out = own - np.log(total)
    order = np.argsort(c, kind="stable")
    cuts = np.searchsorted(c[order], np.arange(len(symbols.size) + 1))
    h, y = h[order], y[order]  # each class is one slice
    own[:], total[:] = 0, 1
    most = _bound(of_symbol)
    if learns:
        dh_symbol = np.zeros_like(dh)
    for k, (a, b) in enumerate(zip(symbols.bounds, symbols.bounds[1:])):
        part = slice(cuts[k], cuts[k + 1])
        if b - a == 1 or cuts[k + 1] == cuts[k]:
            continue
        own[part], total[part], p = _softmax(h[part], of_symbol[a:b], y[part] - a, most, learns)
        if learns:
            np.matmul(p.T, h[part], out=g_symbol[a:b])
            np.matmul(p, of_symbol[a:b, :-1], out=dh_symbol[part])
    out[order] += own - np.log(total)
    if learns:
        dh[order] += dh_symbol
        grad |= {"wc": g_class[:, :-1].T, "bc": g_class[:, -1], "ww": g_symbol[:, :-1], "bw": g_symbol[:, -1], "h": dh}
    return out


def gradient(w: dict, symbols: Symbols, x: np.ndarray, fresh: np.ndarray, h0: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradient over one window (truncated at its begin), the last state, and the loss."""
    keep: dict = {}
    states = run(w, x, fresh, h0, keep)
    g: dict = {}
    if real.all():
        loss = -log_p(w, symbols, states.reshape(-1, HIDDEN), y.ravel(), g).sum()
        dh_out = g.pop("h").reshape(states.shape)
    else:
        t, b = np.nonzero(real)
        loss = -log_p(w, symbols, states[t, b], y[t, b], g).sum()
        dh_out = np.zeros(states.shape, states.dtype)
        dh_out[t, b] = g.pop("h")
    e, h, n, z, r, hn = keep["e"], keep["h"], keep["n"], *(keep["u"][:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
    dgate, dhu = np.empty((2, 3 * HIDDEN, x.shape[1]), h.dtype)
    demb, began = np.empty((*x.shape, EMBED), h.dtype), fresh.any(1)
    du, dwx, dh = np.zeros_like(w["u"]), np.zeros((EMBED + 1, 3 * HIDDEN), h.dtype), np.zeros(h.shape[1:], h.dtype)
    back, dh_out = np.ascontiguousarray(w["wx"].T), np.ascontiguousarray(dh_out.transpose(0, 2, 1))
    for k in range(len(x) - 1, -1, -1):
        dh += dh_out[k]
        dn = np.multiply(dh, (1 - z[k]) * (1 - n[k] * n[k]), out=dgate[2 * HIDDEN :])
        np.multiply(dh, (h[k] - n[k]) * z[k] * (1 - z[k]), out=dhu[:HIDDEN])
        np.multiply(dn, hn[k] * r[k] * (1 - r[k]), out=dhu[HIDDEN : 2 * HIDDEN])
        np.multiply(dn, r[k], out=dhu[2 * HIDDEN :])
        dgate[: 2 * HIDDEN] = dhu[: 2 * HIDDEN]
        du += h[k] @ dhu.T
        dwx += e[k].T @ dgate.T
        np.matmul(dgate.T, back, out=demb[k])
        dh *= z[k]
        dh += w["u"] @ dhu
        if began[k]:
            dh *= ~fresh[k]
    ids, demb = x.ravel(), demb.reshape(-1, EMBED)
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) > 0))
    g["emb"] = np.zeros_like(w["emb"])
    g["emb"][ids[order][first]] = np.add.reduceat(demb[order], first)
    return g | {"wx": dwx[:-1], "u": du, "b": dwx[-1]}, states[-1], float(loss)


def lanes(lengths: np.ndarray, most: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """The lane of each document and its first step there; the longest first, to the shortest lane."""
    import heapq

    heap = [(0, k) for k in range(max(1, min(most, len(lengths))))]
    lane, step = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        lane[d], step[d] = k, used
        heapq.heappush(heap, (used + int(lengths[d]), k))
    return lane, step


def laid(tokens: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, documents' begins, targets and the document (-1: none) at each step of each lane."""
    lane, step = lanes(lengths)
    n, b = int((step + lengths).max()), int(lane.max()) + 1
    doc = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    t, k = step[doc] + within, lane[doc]
    y, who = np.full((n, b), end, np.int32), np.full((n, b), -1, np.int32)
    y[t, k], who[t, k] = tokens, doc
    x = np.full((n, b), end, np.int32)
    x[1:] = y[:-1]
    fresh = np.zeros((n, b), bool)
    fresh[step, lane] = True
    return x, fresh, y, who


def scored(w: dict, symbols: Symbols, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document."""
    x, fresh, y, who = laid(tokens, lengths, symbols.end)
    out, h = np.zeros(len(lengths)), np.zeros((x.shape[1], HIDDEN), np.float32)
    window = 4 * STEPS
    for a in range(0, len(x), window):
        live = np.flatnonzero((who[a:] >= 0).any(0)) if a else np.arange(x.shape[1])
        if len(live) < x.shape[1]:
            x, fresh, y, who, h = x[:, live], fresh[:, live], y[:, live], who[:, live], h[live]
        states = run(w, x[a : a + window], fresh[a : a + window], h)
        h = states[-1]
        t, b = np.nonzero(who[a : a + window] >= 0)
        out += np.bincount(who[a : a + window][t, b], weights=log_p(w, symbols, states[t, b], y[a : a + window][t, b]), minlength=len(lengths))
    return out


def streams(tokens: np.ndarray, lengths: np.ndarray, end: int, most: int = TRAIN_LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, documents' begins, targets and which are real, for training: equal lanes that may cut a document."""
    b = int(min(most, max(1, len(tokens) // (64 * STEPS))))
    n = -(-len(tokens) // b)
    begins = np.zeros(n * b, bool)
    begins[np.cumsum(lengths) - lengths] = True
    begins[::n] = True
    y = np.full(n * b, end, np.int64)
    y[: len(tokens)] = tokens
    x = np.append(end, y[:-1])
    x[::n] = end
    real = np.arange(n * b) < len(tokens)
    return tuple(v.reshape(b, n).T for v in (x, begins, y, real))


def fitted(w: dict, seen: dict, symbols: Symbols, tokens: np.ndarray, lengths: np.ndarray, rate: float = RATE) -> tuple[dict, dict]:
    """Weights and sums of squares after AdaGrad over all windows of one chunk."""
    w, seen = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in seen.items()}
    x, fresh, y, real = streams(tokens, lengths, symbols.end)
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    for a in range(0, len(x), STEPS):
        part = slice(a, a + STEPS)
        g, h, _ = gradient(w, symbols, x[part], fresh[part], h, y[part], real[part])
        for k, v in g.items():
            v = v / (STEPS * x.shape[1])
            seen[k] += v * v
            w[k] -= (rate * v / np.sqrt(seen[k])).astype(np.float32)
    return w, seen
