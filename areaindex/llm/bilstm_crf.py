"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Both directions run side by side in one array. The input table holds, for every
character class, its share of the gates, which is an embedding and its input
matrix in one. All sequences have one length; what is padded is class 0.
"""

from __future__ import annotations

import numpy as np


def character_classes(text: str) -> np.ndarray:
    """Class of each character: ASCII by itself, others by kind; 0 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(codes, 127).astype(np.int64) + 1
    high = np.flatnonzero(codes > 127)
    for i in high.tolist():
        c = text[i]
        out[i] = 129 if c.islower() else 130 if c.isupper() else 131 if c.isspace() else 132 if c.isalpha() else 133
    return out


CLASSES = 134


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class BiLstmCrf:
    def __init__(self, tags: int, hidden: int = 24, classes: int = CLASSES, seed: int = 5):
        rng, self.hidden, self.tags = np.random.default_rng(seed), hidden, tags

        def small(*shape):
            return (rng.standard_normal(shape) * 0.15).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[:, :, hidden : 2 * hidden] = 1.0  # remember by default
        self.p = {
            "input": small(2, classes, 4 * hidden) + bias, "recur": small(2, hidden, 4 * hidden),
            "out": small(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "step": small(tags, tags),
            "first": np.zeros(tags, np.float32),
        }

    # --- network -------------------------------------------------------------

    def _forward(self, x: np.ndarray, keep: bool):
        """Emissions (T, B, tags) of class numbers (B, T); with what the way back needs if ``keep``."""
        batch, steps, n = x.shape[0], x.shape[1], self.hidden
        both = np.stack([x.T, x.T[::-1]], axis=1)  # (T, 2, B)
        h, c = np.zeros((2, batch, n), np.float32), np.zeros((2, batch, n), np.float32)
        hs, trail = np.empty((steps, 2, batch, n), np.float32), []
        table, recur = self.p["input"], self.p["recur"]
        side = np.arange(2)[:, None]
        for t in range(steps):
            gates = table[side, both[t]] + h @ recur
            squashed = _sigmoid(gates[..., : 3 * n])
            i, f, o = squashed[..., :n], squashed[..., n : 2 * n], squashed[..., 2 * n :]
            g = np.tanh(gates[..., 3 * n :])
            before, c = c, f * c + i * g
            bent = np.tanh(c)
            if keep:
                trail.append((h, before, i, f, o, g, bent))
            h = o * bent
            hs[t] = h
        joined = np.concatenate([hs[:, 0], hs[::-1, 1]], axis=-1)
        return joined @ self.p["out"] + self.p["bias"], joined, both, trail

    def _backward(self, d_emit: np.ndarray, joined, both, trail) -> dict[str, np.ndarray]:
        n, steps = self.hidden, len(trail)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = d_emit.reshape(-1, self.tags)
        grads["out"] = joined.reshape(-1, 2 * n).T @ flat
        grads["bias"] = flat.sum(axis=0)
        d_joined = d_emit @ self.p["out"].T
        d_hs = np.stack([d_joined[:, :, :n], d_joined[::-1, :, n:]], axis=1)
        recur_back = self.p["recur"].transpose(0, 2, 1)
        d_h, d_c = np.zeros_like(trail[0][0]), np.zeros_like(trail[0][0])
        d_gates = np.empty((steps, *d_h.shape[:2], 4 * n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, before, i, f, o, g, bent = trail[t]
            d = d_hs[t] + d_h
            d_c = d_c + d * o * (1 - bent * bent)
            d_gates[t] = np.concatenate([
                d_c * g * i * (1 - i), d_c * before * f * (1 - f), d * bent * o * (1 - o), d_c * i * (1 - g * g)
            ], axis=-1)
            d_h, d_c = d_gates[t] @ recur_back, d_c * f
            grads["recur"] += h.transpose(0, 2, 1) @ d_gates[t]
        for side in range(2):
            np.add.at(grads["input"][side], both[:, side].ravel(), d_gates[:, side].reshape(-1, 4 * n))
        return grads

    # --- transitions ---------------------------------------------------------

    def _crf(self, emit: np.ndarray, y: np.ndarray):
        """Mean negative log-likelihood of tags y (T, B) and its gradients."""
        steps, batch, _ = emit.shape
        step, first = self.p["step"].astype(np.float64), self.p["first"].astype(np.float64)
        emit = emit.astype(np.float64)

        def total(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))
        ahead, back = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = first + emit[0]
        for t in range(1, steps):
            ahead[t] = total(ahead[t - 1][:, :, None] + step, 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            back[t] = total(step + (emit[t + 1] + back[t + 1])[:, None, :], 2)
        z = total(ahead[-1], 1)
        rows = np.arange(batch)
        gold = first[y[0]] + emit[0, rows, y[0]]
        for t in range(1, steps):
            gold = gold + step[y[t - 1], y[t]] + emit[t, rows, y[t]]
        d_emit = np.exp(ahead + back - z[None, :, None])
        d_first = d_emit[0].sum(axis=0)
        d_step = np.zeros_like(step)
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + step + (emit[t] + back[t])[:, None, :] - z[:, None, None]
            d_step += np.exp(pair).sum(axis=0)
        at = np.arange(steps)[:, None]
        d_emit[at, rows[None], y] -= 1
        np.add.at(d_first, y[0], -1)
        np.add.at(d_step, (y[:-1].ravel(), y[1:].ravel()), -1)
        return float((z - gold).mean()), d_emit / batch, d_step / batch, d_first / batch

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 24, rate: float = 0.03, seed: int = 3) -> list[float]:
        """Adam over (windows, length) classes and tags; the mean loss of each epoch."""
        rng, losses, count = np.random.default_rng(seed), [], 0
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order, seen = rng.permutation(len(x)), []
            pace = rate * (1 - epoch / epochs) + rate * 0.05
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                emit, *way = self._forward(x[pick], True)
                loss, d_emit, d_step, d_first = self._crf(emit, y[pick].T)
                grads = self._backward(d_emit.astype(np.float32), *way)
                grads["step"], grads["first"] = d_step, d_first
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                shrink, count = min(1.0, 5.0 / (size + 1e-9)), count + 1
                for k, g in grads.items():
                    g = np.asarray(g * shrink, np.float32)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    move = (mean[k] / (1 - 0.9**count)) / (np.sqrt(square[k] / (1 - 0.99**count)) + 1e-8)
                    self.p[k] = (self.p[k] - pace * move).astype(np.float32)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (B, T) and, at each place, the emission's lead over tag 0."""
        emit = self._forward(x, False)[0]
        steps, batch, _ = emit.shape
        step, score = self.p["step"], self.p["first"] + emit[0]
        came = np.empty((steps, batch, self.tags), np.int8)
        for t in range(1, steps):
            paths = score[:, :, None] + step
            came[t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + emit[t]
        tags = np.empty((steps, batch), np.int64)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = came[t][rows, tags[t]]
        lead = np.take_along_axis(emit, tags[:, :, None], 2)[:, :, 0] - emit[:, :, 0]
        return tags.T, lead.T
