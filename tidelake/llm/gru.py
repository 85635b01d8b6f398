"""A bidirectional gated recurrent network over bytes in numpy, with backpropagation through time."""

from __future__ import annotations

import numpy as np


#: Rows that are read together.
ROWS = 1024


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of equal length (padded with 0), and the lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    mask = np.arange(n.max(initial=1)) < n[:, None]
    x = np.zeros(mask.shape, np.uint8)
    x[mask] = np.frombuffer(b"".join(words), np.uint8)
    return x, n


def _flip(n: np.ndarray, width: int) -> np.ndarray:
    """For each row the places of its first n items in reverse; the rest stay."""
    t = np.arange(width)
    return np.where(t < n[:, None], n[:, None] - 1 - t, t)


class ByteGRU:
    """Labels every byte of a segment from what stands before and behind it."""

    def __init__(self, labels: int, hidden: int = 16, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        small = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        # per direction: input rows for the gates z, r and the candidate; recurrent weights; biases
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}x": small(256, 3 * h), f"{d}u": small(h, 3 * h), f"{d}b": np.zeros(3 * h, np.float32)}
        self.p |= {"o": small(2 * h, labels), "ob": np.zeros(labels, np.float32)}
        self.h = h

    def _run(self, d: str, x: np.ndarray, n: np.ndarray, keep: bool):
        """Hidden states (time, row, unit) in one direction; what its gradient needs, if asked."""
        h, (rows, width) = self.h, x.shape
        w, u, b = self.p[f"{d}x"], self.p[f"{d}u"], self.p[f"{d}b"]
        state, states, memo = np.zeros((rows, h), np.float32), np.empty((width, rows, h), np.float32), []
        for t in range(width):
            live = (n > t)[:, None]
            a, r = w[x[:, t]] + b, state @ u
            gates = _sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
            z, g = gates[:, :h], gates[:, h:]
            c = np.tanh(a[:, 2 * h :] + g * r[:, 2 * h :])
            new = np.where(live, (1 - z) * c + z * state, state)
            if keep:
                memo.append((state, z, g, c, r[:, 2 * h :], live))
            state = states[t] = new
        return states, memo

    def _back(self, d: str, x, memo, dstates, grad):
        h, u = self.h, self.p[f"{d}u"]
        gx, gu, gb = np.zeros_like(self.p[f"{d}x"]), np.zeros_like(u), np.zeros(3 * h, np.float32)
        down = np.zeros_like(dstates[0])
        for t in range(len(memo) - 1, -1, -1):
            prev, z, g, c, rc, live = memo[t]
            total = dstates[t] + down
            dh = np.where(live, total, 0)
            dz = dh * (prev - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dg = dc * rc * g * (1 - g)
            da = np.concatenate([dz, dg, dc], axis=1)
            dr = np.concatenate([dz, dg, dc * g], axis=1)
            np.add.at(gx, x[:, t], da)
            gb += da.sum(0)
            gu += prev.T @ dr
            down = np.where(live, dh * z + dr @ u.T, total)
        grad |= {f"{d}x": gx, f"{d}u": gu, f"{d}b": gb}

    def _logits(self, x, n, keep=False):
        rows, width = x.shape
        flip = _flip(n, width)
        back_x = np.take_along_axis(x, flip, 1)
        f, fm = self._run("f", x, n, keep)
        b, bm = self._run("b", back_x, n, keep)
        b = b[flip.T, np.arange(rows)]  # back to reading order
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["o"] + self.p["ob"], (both, flip, back_x, fm, bm)

    def reader(self):
        """A function from windows of equal length (rows of bytes) to the sums of their bytes' probabilities (row, label).

        A sigmoid is (1 + tanh(x / 2)) / 2; the halves are in the weights.
        """
        h, parts = self.h, {}
        for d in "fb":
            x, u = self.p[f"{d}x"] + self.p[f"{d}b"], self.p[f"{d}u"]
            cut = lambda m: [np.ascontiguousarray(m[:, k * h : (k + 1) * h]) for k in range(3)]
            (xz, xg, xc), (uz, ug, uc) = cut(x), cut(u)
            parts[d] = (xz / 2, xg / 2, xc, uz / 2, ug / 2, uc / 2)
        out = [np.ascontiguousarray(self.p["o"][:h].T), np.ascontiguousarray(self.p["o"][h:].T)]
        bias = self.p["ob"][:, None]

        def states(d: str, x: np.ndarray) -> np.ndarray:
            xz, xg, xc, uz, ug, uc = parts[d]
            width, rows = x.shape
            kept = np.empty((width, rows, h), np.float32)
            state = np.zeros((rows, h), np.float32)
            z, g, r, c, a = (np.empty((rows, h), np.float32) for _ in range(5))
            take = lambda table, at: np.take(table, at, axis=0, out=a, mode="clip")
            for k in range(width):
                t = k if d == "f" else width - 1 - k
                at = x[t]
                np.tanh(np.add(np.matmul(state, uz, out=z), take(xz, at), out=z), out=z)
                np.tanh(np.add(np.matmul(state, ug, out=g), take(xg, at), out=g), out=g)
                np.matmul(state, uc, out=r)
                np.add(np.multiply(g, r, out=g), r, out=g)
                np.tanh(np.add(g, take(xc, at), out=c), out=c)
                np.multiply(np.subtract(state, c, out=r), z, out=r)
                new = kept[t]
                np.add(np.add(c, state, out=c), r, out=c)
                np.multiply(c, np.float32(0.5), out=new)
                state = new
            return kept

        def read(x: np.ndarray) -> np.ndarray:
            sums = []
            for i in range(0, len(x), ROWS):
                part = np.ascontiguousarray(x[i : i + ROWS].T).astype(np.intp)
                y = out[0] @ states("f", part).reshape(-1, h).T + out[1] @ states("b", part).reshape(-1, h).T + bias
                y -= y.max(axis=0)
                np.exp(y, out=y)
                y /= y.sum(axis=0)
                sums.append(y.reshape(len(y), *part.shape).sum(axis=1).T)
            return np.concatenate(sums)

        return read

    def loss(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all bytes and its gradient."""
        rows, width = x.shape
        y, (both, flip, back_x, fm, bm) = self._logits(x, n, keep=True)
        e = np.exp(y - y.max(axis=2, keepdims=True))
        e /= e.sum(axis=2, keepdims=True)
        live = (np.arange(width)[:, None] < n)[:, :, None]
        total = max(1, int(n.sum()))
        value = -float((np.log(e[:, np.arange(rows), label] + 1e-12) * live[:, :, 0]).sum()) / total
        e[:, np.arange(rows), label] -= 1
        dy = (e * live / total).astype(both.dtype)
        grad = {"o": np.einsum("tri,trl->il", both, dy), "ob": dy.sum((0, 1))}
        dboth = dy @ self.p["o"].T
        db = np.empty_like(dboth[:, :, self.h :])
        db[flip.T, np.arange(rows)] = dboth[:, :, self.h :]
        self._back("f", x, fm, dboth[:, :, : self.h], grad)
        self._back("b", back_x, bm, db, grad)
        return value, grad

    def fit(self, words: list[bytes], label: np.ndarray, weight: np.ndarray, steps: int, batch: int = 256, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on batches drawn with the given weights; the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        cum = np.cumsum(weight / weight.sum())
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for i in range(1, steps + 1):
            pick = np.minimum(np.searchsorted(cum, rng.random(batch)), len(words) - 1)
            x, n = pad([words[k] for k in pick])
            _, grad = self.loss(x, n, label[pick])
            lr = rate * (1 - 0.9 * i / steps)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
