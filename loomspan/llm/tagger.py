"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding of batches of windows."""

from __future__ import annotations

import numpy as np

#: Symbols: ASCII as it is but for letter case and digits, which are one each; all else is one symbol, 0 pads.
SYMBOLS = 128


def symbols(codes: np.ndarray) -> np.ndarray:
    table = np.arange(SYMBOLS)
    table[ord("A") : ord("Z") + 1] += 32
    table[ord("0") : ord("9") + 1] = ord("0")
    return table[np.minimum(codes, SYMBOLS - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Tags: 0 outside, 1 + 2k begins kind k, 2 + 2k continues it."""

    def __init__(self, kinds: int, *, dims: int = 12, hidden: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = 1 + 2 * kinds, hidden
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": draw(SYMBOLS, dims) * np.float32(np.sqrt(SYMBOLS) * 0.5), "out": draw(2 * hidden, self.tags), "bias": np.zeros(self.tags, np.float32), "trans": np.zeros((self.tags, self.tags), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(dims, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"z{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"z{d}"][hidden : 2 * hidden] = 1  # remember at first
        # a kind is continued only by itself
        self.banned = np.zeros((self.tags, self.tags), np.float32)
        for k in range(kinds):
            self.banned[:, 2 + 2 * k] = -1e4
            self.banned[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.first = np.array([0 if t % 2 or not t else -1e4 for t in range(self.tags)], np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """One direction over symbols x [T, B]: hidden states [T, B, H], and what training needs."""
        p, n = self.p, self.hidden
        steps, width = x.shape
        table = p["emb"] @ p[f"x{d}"] + p[f"z{d}"]
        h, c = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
        out, kept = np.empty((steps, width, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[t]] + h @ p[f"h{d}"]
            gate = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return out, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        forward, a = self._run(x, "f", keep)
        backward, b = self._run(x, "b", keep)
        states = np.concatenate([forward, backward], 2)
        return states @ self.p["out"] + self.p["bias"], states, {"f": a, "b": b}

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums over tag paths, scaled to sum to 1 at each step; moves; and the log of the whole sum.

        Forward times backward sums are the marginals.  The third array is what reaches a step's tags from the step
        before, without the move: forward[t - 1] x moves x reach[t] are the marginals of two tags in a row.
        """
        moves, top = np.exp((self.p["trans"] + self.banned).astype(float)), e.max(2, keepdims=True)
        x = np.exp(np.maximum(e - top, -200.0).astype(float))
        a, b, scale = np.empty_like(x), np.ones_like(x), np.empty((*x.shape[:2], 1))
        for t in range(len(x)):
            at = x[t] * ((a[t - 1] @ moves) if t else np.exp(self.first.astype(float)))
            scale[t] = at.sum(1, keepdims=True)
            a[t] = at / scale[t]
        x /= scale
        for t in range(len(x) - 2, -1, -1):
            b[t] = (x[t + 1] * b[t + 1]) @ moves.T
        return a, b, x * b, (np.log(scale) + top).sum((0, 2))

    def marginals(self, e: np.ndarray) -> np.ndarray:
        a, b, _, _ = self._sums(e)
        return a * b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tag sequences y [T, B] and its gradients."""
        p, n = self.p, self.hidden
        steps, width = x.shape
        e, states, kept = self.emissions(x, keep=True)
        moves = p["trans"] + self.banned
        a, b, reach, z = self._sums(e)
        tag, pair = np.eye(self.tags, dtype=np.float32)[y], y[:-1] * self.tags + y[1:]
        gold = (e * tag).sum((0, 2)) + moves.ravel()[pair].sum(0)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        rows = lambda v: v.reshape(-1, v.shape[2])
        g["trans"] += np.exp(moves) * (rows(a[:-1]).T @ rows(reach[1:]))
        g["trans"] -= np.bincount(pair.ravel(), minlength=moves.size).reshape(moves.shape)
        de = (a * b - tag).astype(np.float32)
        g["out"] = np.einsum("tbh,tbk->hk", states, de, optimize=True)
        g["bias"] = de.sum((0, 1))
        ds = de @ p["out"].T
        symbol = np.eye(SYMBOLS, dtype=np.float32)[x.ravel()]
        for d, part in (("f", ds[:, :, :n]), ("b", ds[:, :, n:])):
            dh, dc = np.zeros((width, n), np.float32), np.zeros((width, n), np.float32)
            held, before_of = np.empty((steps, width, 4 * n), np.float32), np.empty((steps, width, n), np.float32)
            for t, h, before, i, f, o, gg, tc in reversed(kept[d]):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = held[t]
                dz[:, :n] = dc * gg * i * (1 - i)
                dz[:, n : 2 * n] = dc * before * f * (1 - f)
                dz[:, 2 * n : 3 * n] = dh * tc * o * (1 - o)
                dz[:, 3 * n :] = dc * i * (1 - gg * gg)
                before_of[t] = h
                dh, dc = dz @ p[f"h{d}"].T, dc * f
            g[f"h{d}"] = rows(before_of).T @ rows(held)
            dtable = symbol.T @ rows(held)
            g[f"z{d}"] = dtable.sum(0)
            g[f"x{d}"] = p["emb"].T @ dtable
            g["emb"] += dtable @ p[f"x{d}"].T
        return float((z - gold).mean()), {k: v / width for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam on windows x [N, T] with tags y [N, T]; returns the loss of each epoch."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        losses, t, total = [], 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, sums = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, g = self.gradients(x[rows].T, y[rows].T)
                sums += loss * len(rows)
                t += 1
                scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((w * w).sum() for w in g.values())))))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * scale * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * (scale * g[k]) ** 2
                    self.p[k] = (self.p[k] - rate * (1 - 0.9 * t / total) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(sums / len(x))
        return losses

    def decode(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """For windows x [N, T]: spans (kind, start, end, least marginal probability of its tags) on the best path of each."""
        e = self.emissions(x.T)[0]
        moves = self.p["trans"] + self.banned
        steps, width = e.shape[:2]
        best, came = e[0] + self.first, np.zeros(e.shape, np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + moves
            came[t] = ways.argmax(1)
            best = ways.max(1) + e[t]
        path = np.zeros((steps, width), np.int64)
        path[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = came[t, np.arange(width), path[t]]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(width)]
        if not len(some := np.flatnonzero(path.any(0))):
            return out
        sure = self.marginals(e[:, some])
        for k, w in enumerate(some.tolist()):
            own = path[:, w]
            for s in np.flatnonzero(own % 2 == 1).tolist():
                end = s + 1
                while end < steps and own[end] == own[s] + 1:
                    end += 1
                out[w].append(((int(own[s]) - 1) // 2, s, end, float(sure[np.arange(s, end), k, own[s:end]].min())))
        return out
