"""Character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding.

Both directions run as one stacked array, so a step over time is a handful of operations on all
windows of a batch. Weights are small enough to travel with a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters from 0 to 127 stand for themselves; then one class for all others and one for padding.
OTHER, PAD = 128, 129
CLASSES = 130


def classes(text: str) -> np.ndarray:
    """The class of every code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.minimum(points, OTHER).astype(np.uint8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Tagger:
    """``look[direction, class]`` are gate inputs, ``turn`` the recurrent weights, ``out`` tag weights.

    Gates stand in the order input, forget, output, candidate. Tag 0 is "outside".
    """

    look: np.ndarray  # 2, CLASSES, 4H
    turn: np.ndarray  # 2, H, 4H
    out: np.ndarray  # 2, H, K
    bias: np.ndarray  # K
    step: np.ndarray  # K, K: from, to
    start: np.ndarray  # K

    @classmethod
    def fresh(cls, hidden: int, tags: int, seed: int) -> Tagger:
        draw = np.random.default_rng(seed)
        normal = lambda size, *shape: draw.normal(0, size, shape).astype(np.float32)
        model = cls(
            normal(0.3, 2, CLASSES, 4 * hidden), normal(0.3, 2, hidden, 4 * hidden), normal(0.3, 2, hidden, tags),
            np.zeros(tags, np.float32), normal(0.1, tags, tags), np.zeros(tags, np.float32),
        )
        model.look[:, :, hidden : 2 * hidden] += 1.0  # remember at first
        return model

    def weights(self) -> list[np.ndarray]:
        return [self.look, self.turn, self.out, self.bias, self.step, self.start]

    def states(self, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states ``(2, T, B, H)`` in the order of the text; ``keep`` takes what training needs."""
        n, length = ids.shape
        hidden = self.turn.shape[1]
        both = np.stack([ids.T, ids.T[::-1]])  # 2, T, B
        h = c = np.zeros((2, n, hidden), np.float32)
        out = np.empty((2, length, n, hidden), np.float32)
        for t in range(length):
            z = np.matmul(h, self.turn)
            z[0] += self.look[0][both[0, t]]
            z[1] += self.look[1][both[1, t]]
            gates = sigmoid(z[:, :, : 3 * hidden])
            candidate = np.tanh(z[:, :, 3 * hidden :])
            c_new = gates[:, :, hidden : 2 * hidden] * c + gates[:, :, :hidden] * candidate
            squashed = np.tanh(c_new)
            if keep is not None:
                keep.append((h, c, gates, candidate, squashed))
            c, h = c_new, gates[:, :, 2 * hidden :] * squashed
            out[0, t], out[1, length - 1 - t] = h[0], h[1]
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores ``(T, B, K)``."""
        h = self.states(ids)
        return h[0] @ self.out[0] + h[1] @ self.out[1] + self.bias

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence of every window ``(B, T)`` and how far each tag's emission is above "outside"."""
        scores = self.emissions(ids)
        length, n, tags = scores.shape
        best = scores[0] + self.start
        back = np.zeros((length, n, tags), np.int8)
        for t in range(1, length):
            through = best[:, :, None] + self.step[None]
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[t]
        path = np.zeros((n, length), np.int8)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[t][rows, path[:, t]]
        taken = np.take_along_axis(scores.transpose(1, 0, 2), path[:, :, None].astype(np.int64), axis=2)[:, :, 0]
        return path, taken - scores[:, :, 0].T

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of ``tags`` over windows, and its derivatives in the order of ``weights``."""
        keep: list = []
        h = self.states(ids, keep)
        scores = h[0] @ self.out[0] + h[1] @ self.out[1] + self.bias
        length, n, k = scores.shape
        loss, d_scores, d_step, d_start = crf_gradients(scores, tags.T, self.step, self.start)
        flat = d_scores.reshape(-1, k)
        d_out = np.stack([h[i].reshape(-1, h.shape[3]).T @ flat for i in (0, 1)])
        d_h = np.stack([d_scores @ self.out[0].T, (d_scores @ self.out[1].T)[::-1]])  # in the order of each direction
        hidden = self.turn.shape[1]
        both = np.stack([ids.T, ids.T[::-1]])
        d_look, d_turn = np.zeros_like(self.look), np.zeros_like(self.turn)
        carry_h = carry_c = np.zeros((2, n, hidden), np.float32)
        slopes = np.empty((2, length, n, 4 * hidden), np.float32)
        back = self.turn.transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            h_old, c_old, gates, candidate, squashed = keep[t]
            i, f, o = (gates[:, :, j * hidden : (j + 1) * hidden] for j in range(3))
            d = d_h[:, t] + carry_h
            d_c = d * o * (1 - squashed**2) + carry_c
            z = slopes[:, t]
            z[:, :, :hidden] = d_c * candidate * i * (1 - i)
            z[:, :, hidden : 2 * hidden] = d_c * c_old * f * (1 - f)
            z[:, :, 2 * hidden : 3 * hidden] = d * squashed * o * (1 - o)
            z[:, :, 3 * hidden :] = d_c * i * (1 - candidate**2)
            d_turn += np.matmul(h_old.transpose(0, 2, 1), z)
            carry_h, carry_c = np.matmul(z, back), d_c * f
        for direction in (0, 1):
            at, rows = both[direction].ravel(), slopes[direction].reshape(-1, 4 * hidden)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            d_look[direction][at[order][starts]] = np.add.reduceat(rows[order], starts, axis=0)
        return loss, [d_look, d_turn, d_out, flat.sum(axis=0), d_step, d_start]


def crf_gradients(scores: np.ndarray, tags: np.ndarray, step: np.ndarray, start: np.ndarray):
    """Mean loss of ``tags (T, B)`` and its derivatives by scores, transitions and start scores."""
    length, n, k = scores.shape
    rows = np.arange(n)

    def logsum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0] + start
    for t in range(1, length):
        ahead[t] = logsum(ahead[t - 1][:, :, None] + step, 1) + scores[t]
    for t in range(length - 2, -1, -1):
        behind[t] = logsum(step + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    total = logsum(ahead[-1], 1)
    share = np.exp(ahead + behind - total[:, None])
    pairs = np.exp(
        ahead[:-1, :, :, None] + step + (scores[1:] + behind[1:])[:, :, None, :] - total[:, None, None]
    ).sum(axis=(0, 1))
    gold = scores[np.arange(length)[:, None], rows, tags].sum(axis=0) + start[tags[0]] + step[tags[:-1], tags[1:]].sum(axis=0)
    share[np.arange(length)[:, None], rows, tags] -= 1
    np.subtract.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    return float((total - gold).mean()), share / n, pairs / n, share[0].sum(axis=0) / n


def train(batches, hidden: int, tags: int, seed: int = 11, rate: float = 0.02) -> Tagger:
    """Adam over ``(ids, tags)`` batches; the rate falls to a tenth towards the end."""
    model = Tagger.fresh(hidden, tags, seed)
    batches = list(batches)
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    for at, (ids, gold) in enumerate(batches, 1):
        _, slopes = model.gradients(ids, gold)
        size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
        now = rate * (1 - 0.9 * at / len(batches))
        for w, g, m, v in zip(model.weights(), slopes, first, second):
            g = g * min(1.0, 5.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.99**at)) + 1e-8)).astype(np.float32)
    return model
