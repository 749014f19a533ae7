"""A small character convolutional network in numpy: one tower over a value, one over what stands around it; and the calibration of its scores."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Characters of a value that a window holds, and of the text before and after it.
VALUE, BEFORE, AFTER = 48, 32, 16
#: Codes: 0 is padding, 1 to 95 are printable ASCII, then white space, other characters of two bytes at most, and the rest.
CODES = 99
EMBEDDING, WIDTH, FILTERS, HIDDEN = 12, 5, 24, 16
BATCH, RATE = 128, 3e-3


def codes_of(text: str, length: int, right: bool = False) -> np.ndarray:
    """Codes of a short text, padded at the end (with ``right``, at the beginning)."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.where((points > 32) & (points < 127), points - 31, np.where(points <= 32, 96, np.where(points < 2048, 97, 98)))
    out[points == 32] = 1
    room = np.zeros(length, np.uint8)
    if len(out):
        room[-len(out) :] = out if right else room[-len(out) :]
        if not right:
            room[: len(out)] = out
    return room


def encode(before: str, value: str, after: str) -> np.ndarray:
    """One window as codes: the value, then its surroundings. ``before`` keeps its end and ``after`` its beginning; the value is VALUE characters at most."""
    return np.concatenate([codes_of(value, VALUE), codes_of(before[-BEFORE:], BEFORE, right=True), codes_of(after[:AFTER], AFTER)])


class CharCNN:
    """Embedding, a convolution per tower with maximum and mean over places, one hidden layer, one logit."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape)
        towers = {f"{name}{t}": v for t in (0, 1) for name, v in (("conv", init(WIDTH * EMBEDDING, FILTERS)), ("shift", np.zeros(FILTERS)))}
        self.p = {"embed": rng.normal(0, 0.3, (CODES, EMBEDDING)), **towers, "w1": init(4 * FILTERS, HIDDEN), "b1": np.zeros(HIDDEN), "w2": init(HIDDEN, 1), "b2": np.zeros(1)}

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, dict]:
        kept, pooled = {}, []
        for t, part in enumerate((codes[:, :VALUE], codes[:, VALUE:])):
            seen = self.p["embed"][part]
            columns = sliding_window_view(seen, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), -1, WIDTH * EMBEDDING)
            active = np.maximum(columns @ self.p[f"conv{t}"] + self.p[f"shift{t}"], 0)
            kept[t] = columns, active, active.argmax(1)
            pooled += [active.max(1), active.mean(1)]
        features = np.concatenate(pooled, 1)
        hidden = np.maximum(features @ self.p["w1"] + self.p["b1"], 0)
        kept["features"], kept["hidden"] = features, hidden
        return (hidden @ self.p["w2"] + self.p["b2"])[:, 0], kept

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """Logits of windows, some at a time."""
        return np.concatenate([self._forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def gradients(self, codes: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean log loss, and its derivative by every parameter."""
        z, kept = self._forward(codes)
        share = weights / weights.sum()
        loss = float((share * (np.logaddexp(0, z) - y * z)).sum())
        dz = (share * (1 / (1 + np.exp(-z)) - y))[:, None]
        hidden, features = kept["hidden"], kept["features"]
        dh = (dz @ self.p["w2"].T) * (hidden > 0)
        g = {"w2": hidden.T @ dz, "b2": dz.sum(0), "w1": features.T @ dh, "b1": dh.sum(0), "embed": np.zeros_like(self.p["embed"])}
        df = dh @ self.p["w1"].T
        for t, part in enumerate((codes[:, :VALUE], codes[:, VALUE:])):
            columns, active, top = kept[t]
            d_top, d_mean = df[:, 2 * t * FILTERS : (2 * t + 1) * FILTERS], df[:, (2 * t + 1) * FILTERS : (2 * t + 2) * FILTERS]
            da = np.repeat(d_mean[:, None] / active.shape[1], active.shape[1], 1)
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + d_top[:, None], 1)
            da *= active > 0
            g[f"conv{t}"] = np.tensordot(columns, da, ((0, 1), (0, 1)))
            g[f"shift{t}"] = da.sum((0, 1))
            dc = (da @ self.p[f"conv{t}"].T).reshape(len(codes), -1, WIDTH, EMBEDDING)
            seen = np.zeros((*part.shape, EMBEDDING), dc.dtype)
            for k in range(WIDTH):
                seen[:, k : k + dc.shape[1]] += dc[:, :, k]
            g["embed"] += np.stack([np.bincount(part.ravel(), seen[..., d].ravel(), CODES) for d in range(EMBEDDING)], 1)
        return loss, g

    def learn(self, codes: np.ndarray, y: np.ndarray, weights: np.ndarray, state: np.ndarray, seed: list[int]) -> np.ndarray:
        """One pass of Adam over some rows from ``state`` on, and the state after it. The order of rows goes by ``seed``; every batch has its share of each class.

        ``weights`` are 1 on average over all rows of all parts, so the parts' steps go down one and the same loss. Steps are of single precision, states of double precision.
        """
        step, (self.p, first, second) = state[0], self._unpack(state.astype(np.float32))
        rng, place = np.random.default_rng(seed), np.zeros(len(y))
        for k in (0, 1):
            at = rng.permutation(np.flatnonzero(y == k))
            place[at] = (np.arange(len(at)) + rng.random()) / max(1, len(at))
        order, y, weights = np.argsort(place, kind="stable"), y.astype(np.float32), weights.astype(np.float32)
        for i in range(0, len(y), BATCH):
            at, step = order[i : i + BATCH], step + 1
            _, g = self.gradients(codes[at], y[at], weights[at])
            for k, v in g.items():
                v = v * weights[at].mean()
                first[k] += np.float32(0.1) * (v - first[k])
                second[k] += np.float32(0.001) * (v * v - second[k])
                self.p[k] -= np.float32(RATE / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        return np.concatenate([[step], *(x.ravel().astype(float) for part in (self.p, first, second) for x in part.values())])

    def state(self) -> np.ndarray:
        """What learning begins with: number of steps, parameters, and Adam's two means of the gradients."""
        flat = np.concatenate([x.ravel() for x in self.p.values()])
        return np.concatenate([[0.0], flat, np.zeros(2 * len(flat))])

    def take(self, state: np.ndarray) -> CharCNN:
        """Take the parameters of a state."""
        self.p = self._unpack(state)[0]
        return self

    def _unpack(self, state: np.ndarray) -> list[dict[str, np.ndarray]]:
        out, at = [], 1
        for _ in range(3):
            out.append({})
            for k, v in self.p.items():
                out[-1][k] = state[at : at + v.size].reshape(v.shape).copy()
                at += v.size
        return out


def mean_state(states: list[np.ndarray], n: list[int]) -> np.ndarray:
    """Mean of the states of several parts by their numbers of rows."""
    return sum(s * (k / sum(n)) for s, k in zip(states, n, strict=True))


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift that turn logits into calibrated probabilities, by Newton's method on smoothed labels. The slope is positive. ``n``: how often each logit and label occurs (once)."""
    n = np.ones(len(z)) if n is None else n
    n1, n0 = n[y == 1].sum(), n[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (n * (p - target)) + 1e-6 * (w - [1, 0]))
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def threshold_for_recall(p: np.ndarray, y: np.ndarray, recall: float, least: float, n: np.ndarray | None = None) -> float:
    """Of the scores from which at least ``recall`` of the positives are found, the one of the best precision, and of these the lowest; no less than ``least``.

    ``n``: how often each score and label occurs (once).
    """
    order = np.argsort(-p, kind="stable")
    n = np.ones(len(p), int) if n is None else n
    hits, found = np.cumsum((n * y)[order]), np.cumsum(n[order])
    last = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.zeros(0, bool)  # equal scores are found together
    fit = last & (hits >= recall * hits[-1]) & (hits > 0) if len(p) else last
    if not fit.any():
        return least
    precision = np.where(fit, hits / found, -1.0)
    return max(least, float(p[order][np.flatnonzero(precision == precision.max())[-1]]))
