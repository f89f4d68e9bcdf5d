"""Linear-chain conditional random field with two labels over sparse binary features: fit, and Viterbi decoding.

The score of a label sequence y is the sum of the weights of each place's features where y is 1, of the transitions, and of
the first and last label. Fitting climbs the mean log-likelihood, less a quadratic penalty, by Adam with whole batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .bytepair import spread


@dataclass
class Chain:
    weight: np.ndarray  # of each feature for label 1
    step: np.ndarray  # 2 x 2: from, to
    ends: np.ndarray  # 2 x 2: first place, last place by label


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def gradients(chain: Chain, feature: np.ndarray, place: np.ndarray, start: np.ndarray, label: np.ndarray) -> tuple[float, Chain]:
    """Log-likelihood of sequences and its gradient. feature, place: each feature and the place that has it; start: where each
    sequence's places begin (one more than sequences); label: of each place."""
    n, most = len(start) - 1, int(np.diff(start).max())
    size = np.diff(start)
    emission = np.bincount(place, chain.weight[feature], len(label))
    grid = np.full((n, most), -1, np.int64)
    inside = np.arange(most) < size[:, None]
    grid[inside] = np.arange(len(label))
    e = np.zeros((n, most, 2))
    e[inside, 1] = emission
    last = size - 1
    forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    forward[:, 0] = e[:, 0] + chain.ends[0]
    for t in range(1, most):
        forward[:, t] = np.where(inside[:, t, None], _logsum(forward[:, t - 1, :, None] + chain.step, 1) + e[:, t], forward[:, t - 1])
    for t in range(most - 1, -1, -1):
        if t + 1 < most:
            through = _logsum(chain.step + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t < last)[:, None], through, chain.ends[1])
        else:
            backward[:, t] = chain.ends[1]
    total = _logsum(forward[np.arange(n), last] + chain.ends[1], 1)
    p = np.exp(forward + backward - total[:, None, None])
    y = np.zeros((n, most), np.int64)
    y[inside] = label
    gold = np.zeros((n, most, 2))
    gold[np.arange(n)[:, None], np.arange(most), y] = 1
    residual = (gold - p) * inside[:, :, None]
    pair = inside[:, 1:]
    joint = forward[:, :-1, :, None] + chain.step + (e + backward)[:, 1:, None, :] - total[:, None, None, None]
    joint = np.exp(np.where(pair[:, :, None, None], joint, -np.inf)).sum(axis=(0, 1))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    first, end = y[:, 0], y[np.arange(n), last]
    value = (emission * label).sum() + (seen * chain.step).sum() + chain.ends[0][first].sum() + chain.ends[1][end].sum() - total.sum()
    ends = np.stack([residual[:, 0].sum(axis=0), residual[np.arange(n), last].sum(axis=0)])
    return float(value), Chain(np.bincount(feature, residual[inside][:, 1][place], len(chain.weight)), seen - joint, ends)


def fit(feature, place, start, label, width: int, steps: int = 150, rate: float = 0.1, penalty: float = 1e-5) -> Chain:
    """Weights of `width` features. Sequences of like length are worked out together."""
    chain = Chain(np.zeros(width), np.zeros((2, 2)), np.zeros((2, 2)))
    first = np.searchsorted(place, start)
    batches = []
    for own in np.array_split(np.argsort(np.diff(start), kind="stable"), min(12, max(1, len(start) - 1))):
        if len(own):
            size, many = np.diff(start)[own], np.diff(first)[own]
            at, of = spread(start[own], size), spread(first[own], many)
            begin = np.append(0, np.cumsum(size))
            batches.append((feature[of], place[of] - np.repeat(start[own] - begin[:-1], many), begin, label[at]))
    parts = ("weight", "step", "ends")
    mean, square = ([np.zeros_like(getattr(chain, c)) for c in parts] for _ in range(2))
    places = max(1, len(label))
    for k in range(1, steps + 1):
        found = [gradients(chain, *b)[1] for b in batches]
        for i, c in enumerate(parts):
            d = sum(getattr(g, c) for g in found) / places - penalty * getattr(chain, c)
            mean[i] = 0.9 * mean[i] + 0.1 * d
            square[i] = 0.999 * square[i] + 0.001 * d * d
            getattr(chain, c)[...] += rate * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.999**k)) + 1e-8)
    return chain


def viterbi(chain: Chain, emission: list[float]) -> list[int]:
    """The best labels of a sequence of emission scores of label 1; of equal ones, 0."""
    if not emission:
        return []
    (s00, s01), (s10, s11) = chain.step.tolist()
    (b0, b1), (e0, e1) = chain.ends.tolist()
    a, b, back = b0, b1 + emission[0], []
    for x in emission[1:]:
        from0, from1 = b + s10 > a + s00, b + s11 > a + s01
        back.append((from0, from1))
        a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + x
    y = [int(b + e1 > a + e0)]
    for from0, from1 in reversed(back):
        y.append(int(from1 if y[-1] else from0))
    return y[::-1]
