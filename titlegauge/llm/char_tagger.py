"""A character-level bidirectional LSTM with a CRF on top, trained and run in numpy.

All arrays are time-major and both directions are one axis, so a time step is one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Character classes: printable ASCII, line break, other white space, other letters, the rest, padding.
PAD = 99
N_CLASSES = 100
_FORBIDDEN = -1e4


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 32, 98).astype(np.int64)
    out[points == 10] = 95
    out[(points < 32) & (points != 10)] = 96
    out[(points >= 0xC0) & (points < 0x2000)] = 97
    return out


def tag_ids(n_kinds: int) -> int:
    """Tags: 0 outside, 1 + 2k the first and 2 + 2k the later characters of kind k."""
    return 1 + 2 * n_kinds


def _allowed(n_kinds: int) -> np.ndarray:
    n = tag_ids(n_kinds)
    ok = np.ones((n, n), bool)
    for k in range(n_kinds):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class CharTagger:
    n_kinds: int
    hidden: int = 20
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.p:
            return
        rng, h, n = np.random.default_rng(self.seed), self.hidden, tag_ids(self.n_kinds)
        self.p = {
            "x": rng.normal(0, 0.3, (2, N_CLASSES, 4 * h)),
            "u": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "b": np.zeros((2, 1, 4 * h)),
            "o": rng.normal(0, 1 / np.sqrt(2 * h), (2, h, n)),
            "c": np.zeros(n),
            "a": np.zeros((n, n)),
            "s": np.zeros(n),
        }
        self.p["b"][:, :, h : 2 * h] = 1.0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of tag pairs and of first tags; a span never starts in its middle."""
        allowed = _allowed(self.n_kinds)
        return np.where(allowed, self.p["a"], _FORBIDDEN), np.where(allowed[0], self.p["s"], _FORBIDDEN)

    def _states(self, x: np.ndarray, keep: bool):
        """Hidden states (time, 2, batch, hidden); the second direction runs over reversed time."""
        steps, batch = x.shape
        h = self.hidden
        both = np.stack([x, x[::-1]], axis=1)
        state = cell = np.zeros((2, batch, h), np.float32)
        out = np.empty((steps, 2, batch, h), np.float32)
        kept = []
        for t in range(steps):
            z = state @ self.p["u"] + self.p["b"]
            z[0] += self.p["x"][0][both[t, 0]]
            z[1] += self.p["x"][1][both[t, 1]]
            gates = _sigmoid(z[:, :, : 3 * h])
            fresh = np.tanh(z[:, :, 3 * h :])
            before, previous = cell, state
            cell = gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * fresh
            shown = np.tanh(cell)
            state = gates[:, :, 2 * h :] * shown
            out[t] = state
            if keep:
                kept.append((gates, fresh, before, previous, shown))
        return out, both, kept

    def _emissions(self, states: np.ndarray) -> np.ndarray:
        return states[:, 0] @ self.p["o"][0] + states[::-1, 1] @ self.p["o"][1] + self.p["c"]

    def _forward(self, e: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
        alpha = np.empty(e.shape)
        alpha[0] = s + e[0]
        for t in range(1, len(e)):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + a, 1) + e[t]
        return alpha

    def _backward(self, e: np.ndarray, a: np.ndarray) -> np.ndarray:
        beta = np.zeros(e.shape)
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _log_sum(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return beta

    def _gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences and its gradient."""
        steps, batch = x.shape
        h = self.hidden
        states, both, kept = self._states(x, keep=True)
        e = self._emissions(states).astype(np.float64)
        a, s = self.transitions()
        alpha, beta = self._forward(e, a, s), self._backward(e, a)
        log_z = _log_sum(alpha[-1], 1)
        columns = np.arange(batch)
        gold = s[tags[0]] + e[0, columns, tags[0]]
        for t in range(1, steps):
            gold = gold + a[tags[t - 1], tags[t]] + e[t, columns, tags[t]]
        marginal = np.exp(alpha + beta - log_z[None, :, None])
        d_e = marginal.copy()
        np.put_along_axis(d_e, tags[:, :, None], np.take_along_axis(d_e, tags[:, :, None], 2) - 1, 2)
        pair = alpha[:-1][:, :, :, None] + a + (e[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None]
        d_a = np.exp(pair).sum(axis=(0, 1))
        np.subtract.at(d_a, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        allowed = _allowed(self.n_kinds)
        d_e = (d_e / batch).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["a"][...] = np.where(allowed, d_a / batch, 0)
        g["s"][...] = np.where(allowed[0], d_e[0].sum(axis=0), 0)
        g["c"][...] = d_e.sum(axis=(0, 1))
        g["o"][0] = np.einsum("tbh,tbn->hn", states[:, 0], d_e)
        g["o"][1] = np.einsum("tbh,tbn->hn", states[::-1, 1], d_e)
        d_states = np.stack([d_e @ self.p["o"][0].T, (d_e @ self.p["o"][1].T)[::-1]], axis=1)
        d_state = d_cell = np.zeros((2, batch, h), np.float32)
        u_back = self.p["u"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            gates, fresh, before, previous, shown = kept[t]
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            d_h = d_states[t] + d_state
            d_c = d_cell + d_h * o * (1 - shown * shown)
            d_z = np.concatenate(
                [
                    d_c * fresh * i * (1 - i), d_c * before * f * (1 - f),
                    d_h * shown * o * (1 - o), d_c * i * (1 - fresh * fresh),
                ],
                axis=2,
            )
            g["u"] += previous.transpose(0, 2, 1) @ d_z
            g["b"] += d_z.sum(axis=1, keepdims=True)
            for d in (0, 1):
                np.add.at(g["x"][d], both[t, d], d_z[d])
            d_state = d_z @ u_back
            d_cell = d_c * f
        return float((log_z - gold).mean()), g

    def fit(self, x: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 48, rate: float = 0.02) -> float:
        """Adam over batches of the windows (rows of ``x`` and ``tags``); returns the last mean loss."""
        rng = np.random.default_rng(self.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        recent = 0.0
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(x), batch)
            loss, g = self._gradients(x[chosen].T, tags[chosen].T)
            recent = loss if step == 1 else 0.95 * recent + 0.05 * loss
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                self.p[k] = (self.p[k] - now * move).astype(np.float32)
        return recent

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequence of each window (a row of ``x``) and its tags' marginal probabilities."""
        states, _, _ = self._states(x.T, keep=False)
        e = self._emissions(states).astype(np.float64)
        a, s = self.transitions()
        alpha, beta = self._forward(e, a, s), self._backward(e, a)
        marginal = np.exp(alpha + beta - _log_sum(alpha[-1], 1)[None, :, None])
        steps, batch, n = e.shape
        score, back = s + e[0], np.zeros((steps, batch, n), np.int64)
        for t in range(1, steps):
            both = score[:, :, None] + a
            back[t] = both.argmax(axis=1)
            score = both.max(axis=1) + e[t]
        tags = np.empty((steps, batch), np.int64)
        tags[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(batch), tags[t]]
        return tags.T, np.take_along_axis(marginal, tags[:, :, None], 2)[:, :, 0].T
