"""A character tagger in numpy: a bidirectional LSTM under a linear-chain CRF."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 2k + 1 begins and 2k + 2 continues kind k
CLASSES = 64


def char_classes(text: str) -> np.ndarray:
    """Digits, small and capital letters, other letters, each ASCII mark, and the rest."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return _TABLE[np.minimum(code, len(_TABLE) - 1)]


def _class_of(c: str) -> int:
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "z":
        return 2
    if "A" <= c <= "Z":
        return 3
    if " " <= c < "\x7f":
        return 6 + "".join(chr(i) for i in range(32, 127) if not chr(i).isalnum()).index(c)
    return 4 if c.isalpha() else 5


_TABLE = np.array([_class_of(chr(i)) for i in range(0x250)] + [4])  # class 0 pads windows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, hidden: int = 16, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        scale = 1 / np.sqrt(h)
        self.p = {f"x{d}": rng.normal(0, 0.3, (CLASSES, 4 * h)) for d in "fb"}
        self.p |= {f"h{d}": rng.normal(0, scale, (h, 4 * h)) for d in "fb"}
        self.p |= {"out": rng.normal(0, scale, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        h, p = self.hidden, self.p
        state, cell = np.zeros((2, len(x), h), p["out"].dtype)
        out, kept = np.empty((*x.shape, h), state.dtype), []
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = p["x" + d][x[:, t]] + state @ p["h" + d]
            gate = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            lid = np.tanh(cell)
            state = out[:, t] = o * lid
            if keep:
                kept.append((t, i, f, o, g, before, lid, last))
        return out, kept

    def scores(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._lstm(x, d, False)[0] for d in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h, (n, length) = self.p, self.hidden, x.shape
        runs = {d: self._lstm(x, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = both @ p["out"] + p["bias"]
        # Forward and backward sums of the CRF.
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + p["start"]
        for t in range(1, length):
            a[:, t] = e[:, t] + _log_sum(a[:, t - 1, :, None] + p["move"], 1)
        for t in range(length - 2, -1, -1):
            b[:, t] = _log_sum(p["move"] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        whole = _log_sum(a[:, -1], 1)
        there = np.eye(TAGS)[y]
        share = np.exp(a + b - whole[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + p["move"] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        path = (e * there).sum((1, 2)) + p["start"][y[:, 0]] + p["move"][y[:, :-1], y[:, 1:]].sum(1)
        grad = {"start": (share[:, 0] - there[:, 0]).sum(0), "move": pair.sum((0, 1))}
        np.subtract.at(grad["move"], (y[:, :-1], y[:, 1:]), 1)
        de = share - there
        grad["out"], grad["bias"] = np.einsum("nth,ntk->hk", both, de), de.sum((0, 1))
        back = de @ p["out"].T
        for k, d in enumerate("fb"):
            gx, gh = np.zeros_like(p["x" + d]), np.zeros_like(p["h" + d])
            dh, dc = np.zeros((2, n, h))
            for t, i, f, o, g, before, lid, last in reversed(runs[d][1]):
                dh = dh + back[:, t, k * h : (k + 1) * h]
                dc = dc + dh * o * (1 - lid * lid)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * lid * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(gx, x[:, t], dz)
                gh += last.T @ dz
                dh, dc = dz @ p["h" + d].T, dc * f
            grad["x" + d], grad["h" + d] = gx, gh
        return float((whole - path).sum()) / n, {k: v / n for k, v in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 30, size: int = 64, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam on shuffled batches; returns the loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), size):
                rows = order[at : at + size]
                loss, grad = self._gradients(x[rows], y[rows])
                total += loss * len(rows)
                norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
                step += 1
                for k, g in grad.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / len(x))
        return losses

    def narrow(self) -> Tagger:
        """Single precision, for prediction."""
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, where a kind continues only itself, and each place's lead over outside."""
        e = self.scores(x)
        move, start = self.p["move"].copy(), self.p["start"].copy()
        for k in range(len(KINDS)):
            inside = 2 * k + 2
            start[inside] = -1e9
            move[[t for t in range(TAGS) if t not in (inside - 1, inside)], inside] = -1e9
        best, back = e[:, 0] + start, np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            ways = best[:, :, None] + move
            back[:, t] = ways.argmax(1)
            best = ways.max(1) + e[:, t]
        tags = np.zeros(x.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(x))
        for t in range(x.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        lead = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags, lead
