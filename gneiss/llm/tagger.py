"""A character-level bidirectional LSTM with CRF transitions in numpy: training from labelled windows, posteriors and best paths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; 2k + 1 begins kind k and 2k + 2 continues it.
TAGS = 1 + 2 * len(KINDS)
#: Classes of characters: 0 pads, 1 is a control, 2 is not ASCII, then the printable ASCII characters.
CLASSES = 3 + 95
_CLASS = np.concatenate([np.ones(32, np.int16), np.arange(3, 98, dtype=np.int16), np.ones(1, np.int16)])
FORBIDDEN = -20.0


def classes_of(text: str) -> np.ndarray:
    """Each code point's class."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], np.int16(2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Arrays by name. wx: what each class adds to the gates of either direction; wh: recurrence; wo, bo: tag scores; trans: scores from tag to tag."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(hidden: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        wx = r.normal(0, 0.3, (2, CLASSES, 4 * hidden))
        wx[:, :, hidden : 2 * hidden] += 1.0  # gates that keep memory begin open
        trans = np.zeros((TAGS, TAGS))
        for j in range(2, TAGS, 2):
            trans[:, j] = FORBIDDEN
            trans[[j - 1, j], j] = 0
        p = {"wx": wx, "wh": r.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)), "wo": r.normal(0, hidden**-0.5, (2 * hidden, TAGS)), "bo": np.zeros(TAGS), "trans": trans}
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def scores(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Tag scores [window, place, tag] of classes [window, place]; keep gets what the gradient needs."""
        p, (n, length) = self.p, x.shape
        size = p["wh"].shape[1]
        ways = np.stack([x, x[:, ::-1]])
        h = c = np.zeros((2, n, size), p["wh"].dtype)
        out = np.empty((2, n, length, size), p["wh"].dtype)
        for t in range(length):
            z = np.stack([p["wx"][0][ways[0, :, t]], p["wx"][1][ways[1, :, t]]]) + h @ p["wh"]
            gates, g = _sigmoid(z[..., : 3 * size]), np.tanh(z[..., 3 * size :])
            i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, :, t] = h
            if keep is not None:
                keep.append((gates, g, before, tc, last))
        both = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        if keep is not None:
            keep.append((ways, both))
        return both @ p["wo"] + p["bo"]

    def posteriors(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals [window, place, tag], expected steps [tag, tag] summed over windows, log partition of each window), by forward and backward sums."""
        n, length, _ = scores.shape
        trans = np.exp(self.p["trans"])
        most = scores.max(2, keepdims=True)
        e = np.exp(scores - most)
        alpha, beta, norm = np.empty_like(e), np.empty_like(e), np.empty((n, length), e.dtype)
        for t in range(length):
            a = e[:, t] if t == 0 else (alpha[:, t - 1] @ trans) * e[:, t]
            norm[:, t] = a.sum(1)
            alpha[:, t] = a / norm[:, t, None]
        beta[:, -1] = 1
        for t in range(length - 2, -1, -1):
            beta[:, t] = ((beta[:, t + 1] * e[:, t + 1]) @ trans.T) / norm[:, t + 1, None]
        right = beta[:, 1:] * e[:, 1:] / norm[:, 1:, None]
        steps = np.einsum("nti,ntj->ij", alpha[:, :-1], right) * trans
        return alpha * beta, steps, np.log(norm).sum(1) + most[:, :, 0].sum(1)

    def best_paths(self, scores: np.ndarray) -> np.ndarray:
        """The tags of each window's best path."""
        n, length, _ = scores.shape
        back, at = np.empty((length, n, TAGS), np.int8), scores[:, 0]
        for t in range(1, length):
            step = at[:, :, None] + self.p["trans"]
            back[t] = step.argmax(1)
            at = step.max(1) + scores[:, t]
        path = np.empty((n, length), np.int8)
        path[:, -1] = at.argmax(1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        return path

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log probability of the tags, and its gradient."""
        p, (n, length), keep = self.p, x.shape, []
        size = p["wh"].shape[1]
        scores = self.scores(x, keep)
        marginals, steps, log_z = self.posteriors(scores)
        gold = np.take_along_axis(scores, y[:, :, None].astype(np.int64), 2)[:, :, 0].sum(1) + p["trans"][y[:, :-1], y[:, 1:]].sum(1)
        seen = np.zeros_like(p["trans"])
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        ds = marginals.copy()
        np.put_along_axis(ds, y[:, :, None].astype(np.int64), np.take_along_axis(ds, y[:, :, None].astype(np.int64), 2) - 1, 2)
        ds /= n
        ways, both = keep.pop()
        grad = {"wo": both.reshape(-1, 2 * size).T @ ds.reshape(-1, TAGS), "bo": ds.sum((0, 1)), "trans": np.where(p["trans"] <= FORBIDDEN, 0, (steps - seen) / n), "wx": np.zeros_like(p["wx"]), "wh": np.zeros_like(p["wh"])}
        dboth = ds @ p["wo"].T
        dout = np.stack([dboth[..., :size], dboth[:, ::-1, size:]])
        dh, dc = np.zeros((2, n, size), p["wh"].dtype), np.zeros((2, n, size), p["wh"].dtype)
        for t in range(length - 1, -1, -1):
            gates, g, before, tc, last = keep[t]
            i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
            dh = dh + dout[:, :, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            for d in (0, 1):
                np.add.at(grad["wx"][d], ways[d, :, t], dz[d])
            grad["wh"] += last.transpose(0, 2, 1) @ dz
            dh, dc = dz @ p["wh"].transpose(0, 2, 1), dc * f
        return float((log_z - gold).mean()), grad


def train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, batch: int, rate: float, seed: int) -> Tagger:
    """Adam over shuffled batches; the same input gives the same model."""
    model, r = Tagger.new(hidden, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for low in range(0, len(x), batch):
            some = order[low : low + batch]
            _, grad = model.loss(x[some], y[some])
            step += 1
            scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))))
            now = rate * (1 - epoch / epochs)
            for k, g in grad.items():
                g = g * scale
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                model.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
