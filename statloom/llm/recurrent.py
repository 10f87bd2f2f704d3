"""A gated recurrent language model over a bounded vocabulary, in numpy.

Symbols are grouped into classes of about equal frequency; the output is factored into the class and
the symbol within its class. Documents are laid end to end on parallel lanes and read in windows; the
state is carried from window to window and set to zero where a document begins, so a long document is
read whole while gradients are cut at the window.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 20
WINDOW = 24
LANES = 128
RATE = 0.006


def lanes(sizes: np.ndarray, most: int = LANES) -> tuple[np.ndarray, np.ndarray, int]:
    """The lane and first step of each document, and the steps: longest documents first, to the shortest lane."""
    width = int(np.clip(sizes.sum() // max(int(sizes.max(initial=1)), 1), 1, most))
    lane, start, filled = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(width, np.int64)
    for d in np.argsort(-sizes, kind="stable"):
        k = int(filled.argmin())
        lane[d], start[d] = k, filled[k]
        filled[k] += sizes[d]
    return lane, start, int(filled.max(initial=0))


def grid(documents: list[np.ndarray], most: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets (steps x lanes, -1 where empty), the symbol before each, and the document of each cell."""
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    lane, start, steps = lanes(sizes, most)
    target = np.full((steps, int(lane.max(initial=0)) + 1), -1, dtype=np.int64)
    before, owner = np.full_like(target, -1), np.full_like(target, -1)
    for d, symbols in enumerate(documents):
        rows = slice(start[d], start[d] + sizes[d])
        target[rows, lane[d]], owner[rows, lane[d]] = symbols, d
        before[start[d] + 1 : start[d] + sizes[d], lane[d]] = symbols[:-1]
    return target, before, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_total(logits: np.ndarray) -> np.ndarray:
    """log of the sum of exp over each row; the logits are used up."""
    most = logits.max(initial=0)
    logits -= most  # one maximum for all rows is enough while they are alike
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return np.log(np.maximum(total, np.float32(1e-37))) + most


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(logits) else logits
    return e / e.sum(axis=1, keepdims=True)


class GatedModel:
    """``counts``: how often each symbol occurs in training; it sets classes and first biases."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7):
        random, n = np.random.default_rng(seed), len(counts)
        mass = (np.asarray(counts, dtype=float) + 1) / (np.sum(counts) + n)
        order = np.argsort(-mass, kind="stable")
        n_classes = max(1, round(np.sqrt(n)))
        # equal shares of the square roots of mass: classes neither too heavy nor too long
        roots = np.cumsum(np.sqrt(mass[order]))
        self.class_of = np.zeros(n, dtype=np.int64)
        self.class_of[order] = np.minimum((roots / roots[-1] * n_classes).astype(np.int64), n_classes - 1)
        self.class_of = np.unique(self.class_of, return_inverse=True)[1]
        self.symbols = [np.flatnonzero(self.class_of == c) for c in range(self.class_of.max() + 1)]
        self.place = np.zeros(n, dtype=np.int64)
        for s in self.symbols:
            self.place[s] = np.arange(len(s))
        h, f = hidden, np.float32
        classes = np.array([mass[s].sum() for s in self.symbols])
        self.hidden = h
        self.p = {
            "input": random.normal(0, 0.1, (n + 1, 3 * h)).astype(f),  # the last row: a document begins
            "state": random.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(f),
            "bias": np.zeros(3 * h, f),
            "class": random.normal(0, 0.1, (h, len(classes))).astype(f),
            "class_bias": np.log(classes).astype(f),
            "word": random.normal(0, 0.1, (n, h)).astype(f),
            "word_bias": np.log(mass / classes[self.class_of]).astype(f),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(float)

    def set_flat(self, values: np.ndarray) -> GatedModel:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.asarray(values[at : at + v.size], dtype=np.float32).reshape(v.shape)
            at += v.size
        return self

    def _states(self, before: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list, np.ndarray]:
        """The state that predicts each cell of a window, what the gradients need, and the last state."""
        n, saved = self.hidden, []
        inputs = self.p["input"][before] + self.p["bias"]
        out = np.empty((*before.shape, n), np.float32)
        for t in range(len(before)):
            h = np.where(fresh[t][:, None], np.float32(0), h)
            x, s = inputs[t], h @ self.p["state"]
            gates = _sigmoid(x[:, : 2 * n] + s[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * s[:, 2 * n :])
            new = c + z * (h - c)
            if keep:
                saved.append((h, z, r, c, s[:, 2 * n :]))
            out[t] = h = new
        return out, saved, h

    def _log_p(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets given their states."""
        p, own, rows = self.p, self.class_of[target], np.arange(len(h))
        logits = h @ p["class"]
        logits += p["class_bias"]
        log_p = logits[rows, own] - _log_total(logits)
        order = np.argsort(own, kind="stable")
        h, place = h[order], self.place[target[order]]
        ends = np.searchsorted(own[order], np.arange(len(self.symbols) + 1))
        within = np.empty(len(h), np.float32)
        for c, symbols in enumerate(self.symbols):
            at = slice(ends[c], ends[c + 1])
            logits = h[at] @ p["word"][symbols].T
            logits += p["word_bias"][symbols]
            within[at] = logits[rows[: len(logits)], place[at]] - _log_total(logits)
        log_p[order] += within
        return log_p

    def _gradients(self, h: np.ndarray, target: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of minus the log probability by the output weights and by the states."""
        p, own, rows = self.p, self.class_of[target], np.arange(len(h))
        d = _softmax(h @ p["class"] + p["class_bias"])
        d[rows, own] -= 1
        g = {"class": h.T @ d, "class_bias": d.sum(axis=0), "word": np.zeros_like(p["word"]), "word_bias": np.zeros_like(p["word_bias"])}
        dh = d @ p["class"].T
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(len(self.symbols) + 1))
        for c, symbols in enumerate(self.symbols):
            at = order[ends[c] : ends[c + 1]]
            d = _softmax(h[at] @ p["word"][symbols].T + p["word_bias"][symbols])
            d[rows[: len(at)], self.place[target[at]]] -= 1
            g["word"][symbols] = d.T @ h[at]
            g["word_bias"][symbols] = d.sum(axis=0)
            dh[at] += d @ p["word"][symbols]
        return g, dh

    def _windows(self, documents: list[np.ndarray], most: int = LANES):
        target, before, owner = grid(documents, most)
        fresh = (before < 0) & (target >= 0)
        before = np.where(before < 0, len(self.class_of), before)
        for t in range(0, len(target), WINDOW):
            w = slice(t, t + WINDOW)
            yield target[w], before[w], owner[w], fresh[w]

    def log_likelihood(self, documents: list[np.ndarray], most: int = LANES) -> np.ndarray:
        """Natural log probability of each whole document."""
        out = np.zeros(len(documents))
        h = None
        for target, before, owner, fresh in self._windows(documents, most):
            h = np.zeros((target.shape[1], self.hidden), np.float32) if h is None else h
            states, _, h = self._states(before, fresh, h, keep=False)
            real = target >= 0
            log_p = self._log_p(states[real], target[real])
            out += np.bincount(owner[real], log_p, len(documents))
        return out

    def train(self, documents: list[np.ndarray], memory: dict | None = None) -> dict:
        """One reading of the documents by truncated backpropagation (Adam); returns the optimiser's memory."""
        # lanes are laid anew for each call, so the state starts at zero
        memory = memory or {"step": 0, "m": {k: np.zeros_like(v) for k, v in self.p.items()}, "v": {k: np.zeros_like(v) for k, v in self.p.items()}}
        h = None
        for target, before, _, fresh in self._windows(documents):
            h = np.zeros((target.shape[1], self.hidden), np.float32) if h is None else h
            states, saved, h = self._states(before, fresh, h, keep=True)
            real = target >= 0
            n = int(real.sum())
            if not n:
                continue
            g, d = self._gradients(states[real], target[real])
            dstates = np.zeros_like(states)
            dstates[real] = d
            g |= self._backward(before, fresh, saved, dstates)
            self._update({k: v / n for k, v in g.items()}, memory)
        return memory

    def _backward(self, before: np.ndarray, fresh: np.ndarray, saved: list, dstates: np.ndarray) -> dict:
        n, u = self.hidden, self.p["state"]
        dh = np.zeros_like(dstates[0])
        dinputs = np.empty((*before.shape, 3 * n), np.float32)
        du = np.zeros_like(u)
        for t in range(len(before) - 1, -1, -1):
            h, z, r, c, s = saved[t]
            dh = dh + dstates[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * s * r * (1 - r)
            ds = np.concatenate([dz, dr, dc * r], axis=1)
            dinputs[t, :, :n], dinputs[t, :, n : 2 * n], dinputs[t, :, 2 * n :] = dz, dr, dc
            du += h.T @ ds
            dh = np.where(fresh[t][:, None], np.float32(0), dh * z + ds @ u.T)
        flat, rows = before.ravel(), dinputs.reshape(-1, 3 * n)
        order = np.argsort(flat, kind="stable")
        symbols, first = np.unique(flat[order], return_index=True)
        dinput = np.zeros_like(self.p["input"])
        dinput[symbols] = np.add.reduceat(rows[order], first, axis=0)
        return {"input": dinput, "state": du, "bias": rows.sum(axis=0)}

    def _update(self, g: dict, memory: dict) -> None:
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        memory["step"] += 1
        step = memory["step"]
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, v in g.items():
            v = v * np.float32(scale)
            m, s = memory["m"][k], memory["v"][k]
            m += np.float32(0.1) * (v - m)
            s += np.float32(0.001) * (v * v - s)
            self.p[k] -= np.float32(rate) * m / (np.sqrt(s) + np.float32(1e-8))
