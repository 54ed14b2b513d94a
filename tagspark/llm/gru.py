"""A gated recurrent language model with a class-factored output, in numpy.

The next symbol's probability is that of its class times its own within the class, so a step
costs about two square roots of the vocabulary. Classes are cut by frequency. The model reads
many streams side by side; gradients go back through one window of steps (truncated
backpropagation through time), while the state is carried on from window to window and starts
anew after an end symbol.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Shape:
    symbols: int
    end: int
    hidden: int = 16
    # At most 256, so that sorting by class is a matter of bytes.
    classes: int = 24
    window: int = 16
    lanes: int = 512
    rate: float = 0.08


def exponentials(logits: np.ndarray) -> np.ndarray:
    """Exponentials in place, and their sum per row."""
    np.minimum(logits, 60.0, out=logits)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], np.float32)


@dataclass
class Gru:
    shape: Shape
    class_of: np.ndarray  # of each symbol; symbols of a class are neighbours in `order`
    order: np.ndarray
    place: np.ndarray  # of each symbol in `order`
    cuts: np.ndarray  # first place of each class, and the end
    params: dict[str, np.ndarray]
    squares: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, counts: np.ndarray, shape: Shape, seed: int = 11) -> Gru:
        """Before training: the symbols' frequencies, whatever came before."""
        freq = (counts + 1.0) / (counts + 1.0).sum()
        order = np.argsort(-freq, kind="stable")
        # Rare symbols would fill huge classes if mass alone decided, so its root does.
        mass = np.cumsum(np.sqrt(freq[order]))
        in_order = np.minimum((mass / mass[-1] * shape.classes).astype(int), shape.classes - 1)
        _, in_order = np.unique(in_order, return_inverse=True)
        n_classes = int(in_order[-1]) + 1
        class_of, place = np.empty(len(order), np.uint8), np.empty(len(order), np.int32)
        class_of[order], place[order] = in_order, np.arange(len(order))
        cuts = np.searchsorted(in_order, np.arange(n_classes + 1))
        draw, h = np.random.default_rng(seed), shape.hidden
        of_class = np.add.reduceat(freq[order], cuts[:-1])
        params = {
            "inputs": draw.normal(0, 0.3, (len(order), 3 * h)),
            "gates": draw.normal(0, h**-0.5, (h, 2 * h)),
            "candidate": draw.normal(0, h**-0.5, (h, h)),
            "to_class": np.zeros((h, n_classes)),
            "class_bias": np.log(of_class),
            "to_symbol": np.zeros((h, len(order))),
            "symbol_bias": np.log(freq[order] / of_class[in_order]),
        }
        params = {k: v.astype(np.float32) for k, v in params.items()}
        return cls(shape, class_of, order, place, cuts, params)

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.params.values()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for k, v in self.params.items():
            self.params[k] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def states(self, x: np.ndarray, h: np.ndarray, keep: list | None = None):
        """Hidden states of a window `x (steps, lanes)`; `keep` takes what backward needs."""
        p, n = self.params, self.shape.hidden
        fresh = (x != self.shape.end).astype(np.float32)[:, :, None]
        inputs = p["inputs"][x]
        out = np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            h = h * fresh[t]
            a = inputs[t]
            g = h @ p["gates"]
            g += a[:, : 2 * n]
            g = 1.0 / (1.0 + np.exp(-g))
            z, r = g[:, :n], g[:, n:]
            c = np.tanh(a[:, 2 * n :] + (r * h) @ p["candidate"])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((h, g, c))
            out[t] = h = new
        return out, h, fresh

    def output(self, hidden: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Log probabilities of `y` given `hidden (n, h)`; with `grads` also the gradients."""
        p = self.params
        classes = self.class_of[y]
        by_class = np.argsort(classes, kind="stable")
        hs, ys, cs = hidden[by_class], self.place[y[by_class]], classes[by_class]
        rows = np.arange(len(ys))
        logits = hs @ p["to_class"] + p["class_bias"]
        total = exponentials(logits)
        scores = np.log(np.maximum(logits[rows, cs] / total, 1e-30))
        if grads is not None:
            logits /= total[:, None]
            logits[rows, cs] -= 1.0
            back = logits @ p["to_class"].T
            grads["to_class"], grads["class_bias"] = hs.T @ logits, logits.sum(0)
            grads["to_symbol"] = np.zeros_like(p["to_symbol"])
            grads["symbol_bias"] = np.zeros_like(p["symbol_bias"])
        starts = np.searchsorted(cs, np.arange(len(self.cuts)))
        for c in range(len(self.cuts) - 1):
            a, b, lo, hi = starts[c], starts[c + 1], self.cuts[c], self.cuts[c + 1]
            if a == b or hi - lo == 1:
                continue
            own = hs[a:b] @ p["to_symbol"][:, lo:hi] + p["symbol_bias"][lo:hi]
            total = exponentials(own)
            at = (rows[: b - a], ys[a:b] - lo)
            scores[a:b] += np.log(np.maximum(own[at] / total, 1e-30))
            if grads is not None:
                own /= total[:, None]
                own[at] -= 1.0
                back[a:b] += own @ p["to_symbol"][:, lo:hi].T
                grads["to_symbol"][:, lo:hi] = hs[a:b].T @ own
                grads["symbol_bias"][lo:hi] = own.sum(0)
        out = np.empty_like(scores)
        out[by_class] = scores
        if grads is None:
            return out, None
        unsorted = np.empty_like(back)
        unsorted[by_class] = back
        return out, unsorted

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray):
        """Sum of log probabilities of a window, gradients of its negative, and the last state."""
        p, n = self.params, self.shape.hidden
        kept: list = []
        hidden, last, fresh = self.states(x, h, kept)
        grads: dict[str, np.ndarray] = {}
        scores, back = self.output(hidden.reshape(-1, n), y.ravel(), grads)
        back = back.reshape(*x.shape, n)
        steps, lanes = x.shape
        d_in = np.empty((steps, lanes, 3 * n), np.float32)
        reset = np.empty((steps, lanes, n), np.float32)
        before = np.empty((steps, lanes, n), np.float32)
        dh = np.zeros((lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            hp, g, c = kept[t]
            z, r = g[:, :n], g[:, n:]
            dh = dh + back[t]
            da = d_in[t]
            da[:, 2 * n :] = dh * (1 - z) * (1 - c * c)
            drh = da[:, 2 * n :] @ p["candidate"].T
            da[:, :n] = dh * (hp - c)
            da[:, n : 2 * n] = drh * hp
            da[:, : 2 * n] *= g * (1 - g)
            before[t], reset[t] = hp, r * hp
            dh = (dh * z + drh * r + da[:, : 2 * n] @ p["gates"].T) * fresh[t]
        flat = d_in.reshape(-1, 3 * n)
        grads["gates"] = before.reshape(-1, n).T @ flat[:, : 2 * n]
        grads["candidate"] = reset.reshape(-1, n).T @ flat[:, 2 * n :]
        symbols = x.ravel().astype(np.uint16)
        by_symbol = np.argsort(symbols, kind="stable")
        in_order = symbols[by_symbol]
        first = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        grads["inputs"] = (in_order[first], np.add.reduceat(flat[by_symbol], first, axis=0))
        return float(scores.sum()), grads, last

    def update(self, grads: dict, n: int) -> None:
        """One Adagrad step on the mean gradient."""
        if not self.squares:
            self.squares = {k: np.full_like(v, 1e-6) for k, v in self.params.items()}
        for k, grad in grads.items():
            rows, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
            grad = grad / n
            self.squares[k][rows] += grad * grad
            self.params[k][rows] -= self.shape.rate * grad / np.sqrt(self.squares[k][rows])

    def train(self, symbols: np.ndarray) -> float:
        """One pass over concatenated documents, each closed by an end; returns the log likelihood."""
        s, total = self.shape, 0.0
        lanes = max(1, min(s.lanes, len(symbols) // s.window))
        inputs = np.concatenate([[s.end], symbols[:-1]])
        # The last windows of short lanes read ends, which every stream may do.
        length = -(-len(symbols) // lanes)
        padded = np.full((2, lanes * length), s.end, np.int64)
        padded[0, : len(symbols)], padded[1, : len(symbols)] = inputs, symbols
        x, y = (a.reshape(lanes, length).T for a in padded)
        h = np.zeros((lanes, s.hidden), np.float32)
        for t in range(0, length, s.window):
            score, grads, h = self.gradients(x[t : t + s.window], y[t : t + s.window], h)
            self.update(grads, x[t : t + s.window].size)
            total += score
        return total

    def score(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probability of every whole document, its state carried through all windows.

        `symbols` are the documents one after another, each closed by an end; `ends` says where.
        Longer documents start first; a lane that is done takes up the next one.
        """
        s = self.shape
        starts = np.concatenate([[0], ends[:-1]])
        scores = np.zeros(len(ends))
        inputs = np.concatenate([[s.end], symbols[:-1]])
        waiting = np.argsort(starts - ends, kind="stable")
        document, at = np.empty(0, np.int64), np.empty(0, np.int64)
        h = np.zeros((0, s.hidden), np.float32)
        steps = np.arange(s.window)[:, None]
        while len(waiting) or len(document):
            new, waiting = np.split(waiting, [min(len(waiting), s.lanes - len(document))])
            document, at = np.append(document, new), np.append(at, starts[new])
            h = np.concatenate([h, np.zeros((len(new), s.hidden), np.float32)])
            places = at + steps
            there = places < ends[document]
            places = np.minimum(places, len(symbols) - 1)
            hidden, h, _ = self.states(inputs[places], h)
            found, _ = self.output(hidden[there], symbols[places[there]])
            lane = np.broadcast_to(np.arange(len(document)), there.shape)[there]
            scores[document] += np.bincount(lane, found, len(document))
            at = at + s.window
            going = at < ends[document]
            document, at, h = document[going], at[going], h[going]
        return scores
