"""A linear-chain conditional random field over sequences of sparse binary features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEPS, BATCH, RATE, DECAY = 400, 64, 0.1, 1e-4


@dataclass(frozen=True)
class Chain:
    """Weights by feature name and label, between neighbouring labels, and at the start."""

    weights: dict[str, tuple[float, ...]]
    between: tuple[tuple[float, ...], ...]
    start: tuple[float, ...]

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi); of equally likely ones the lower."""
        labels = range(len(self.start))
        best, back = list(self.start), []
        for k, features in enumerate(sequence):
            own = [0.0] * len(best)
            for f in features:
                w = self.weights.get(f)
                if w is not None:
                    for y in labels:
                        own[y] += w[y]
            if k:
                come = [max(labels, key=lambda x, y=y: best[x] + self.between[x][y]) for y in labels]
                back.append(come)
                best = [best[come[y]] + self.between[come[y]][y] + own[y] for y in labels]
            else:
                best = [b + o for b, o in zip(best, own, strict=True)]
        if not sequence:
            return []
        path = [max(labels, key=best.__getitem__)]
        for come in reversed(back):
            path.append(come[path[-1]])
        return path[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(scores: np.ndarray, mask: np.ndarray, between: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, label marginals and summed pair marginals of a batch of padded sequences; scores: batch, place, label."""
    n, length, k = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + start
    for t in range(1, length):
        step = log_sum(forward[:, t - 1, :, None] + between, 1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = log_sum(between + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
    total = log_sum(forward[:, -1], 1)
    single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
    pair = np.exp(forward[:, :-1, :, None] + between + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return total, single, pair * mask[:, 1:, None, None]


def train(sequences: list[tuple[list[list[str]], list[int]]], labels: int, least: int = 2) -> Chain:
    """Fit by the likelihood of the labels; features of fewer than ``least`` places are left out."""
    seen: dict[str, int] = {}
    for places, _ in sequences:
        for features in places:
            for f in features:
                seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= least)}
    coded = [([np.array([names[f] for f in p if f in names], np.int64) for p in places], np.array(y)) for places, y in sequences if places]
    size = len(names) * labels
    theta, m, s = (np.zeros(size + labels * labels + labels) for _ in range(3))
    rng = np.random.default_rng(0)
    for step in range(1, STEPS + 1):
        chosen = [coded[i] for i in rng.choice(len(coded), min(BATCH, len(coded)), replace=False)]
        length = max(len(y) for _, y in chosen)
        w, between, start = theta[:size].reshape(-1, labels), theta[size : size + labels * labels].reshape(labels, labels), theta[size + labels * labels :]
        mask, truth = np.zeros((len(chosen), length), bool), np.zeros((len(chosen), length, labels))
        place, feature = [], []
        for b, (places, y) in enumerate(chosen):
            mask[b, : len(y)] = True
            truth[b, np.arange(len(y)), y] = 1
            feature.extend(places)
            place.append(np.repeat(b * length + np.arange(len(y)), [len(p) for p in places]))
        feature, place = np.concatenate(feature), np.concatenate(place)
        scores = np.stack([np.bincount(place, w[feature, y], len(chosen) * length) for y in range(labels)], 1).reshape(len(chosen), length, labels)
        _, single, pair = marginals(scores, mask, between, start)
        off = (single - truth).reshape(-1, labels)
        grad_w = np.stack([np.bincount(feature, off[place, y], len(names)) for y in range(labels)], 1)
        true_pair = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
        grad = np.concatenate([grad_w.ravel(), (pair.sum(axis=(0, 1)) - true_pair).ravel(), (single[:, 0] - truth[:, 0]).sum(axis=0)]) / len(chosen) + DECAY * theta
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        theta = theta - RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    w = theta[:size].reshape(-1, labels)
    return Chain({f: tuple(w[i].tolist()) for f, i in names.items()}, tuple(map(tuple, theta[size : size + labels * labels].reshape(labels, labels).tolist())), tuple(theta[size + labels * labels :].tolist()))
