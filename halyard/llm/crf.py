"""Linear-chain conditional random fields with two labels, over hashed binary features.

Label 0's emission is 0, so a position is one number: the weight sum of its features for label 1.
Sequences are worked on side by side, one position of all of them at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Positions (padding included) that are worked on at once.
CELLS = 1 << 18


@dataclass
class Model:
    weights: np.ndarray  # float32, one per hashed feature
    start: np.ndarray  # 2
    move: np.ndarray  # 2 x 2: from, to


def batches(lengths: np.ndarray, cells: int = CELLS):
    """Index arrays of sequences of like length, so that padding stays small and memory bounded."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * int(lengths[order[last]]) <= cells and lengths[order[last]] <= 2 * lengths[order[first]] + 16:
            last += 1
        yield order[first:last]
        first = last


def padded(emissions: list[np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions x sequences) emissions, 0 beyond a sequence's end, and the lengths."""
    n = np.array([len(emissions[i]) for i in some])
    out = np.zeros((n.max(), len(some)))
    for k, i in enumerate(some):
        out[: n[k], k] = emissions[i]
    return out, n


def forward_backward(model: Model, e: np.ndarray, n: np.ndarray, learning: bool = True):
    """Marginals of label 1, and for learning the expected label pairs summed over positions (2 x 2)."""
    steps, width = e.shape
    peak = np.maximum(e, 0)
    psi0, psi1 = np.exp(-peak), np.exp(e - peak)  # emission potentials, scaled to at most 1
    m = np.exp(model.move)
    a0, a1 = np.empty((steps, width)), np.empty((steps, width))
    scale = np.empty((steps, width))
    p0, p1 = np.exp(model.start[0]) * psi0[0], np.exp(model.start[1]) * psi1[0]
    for t in range(steps):
        if t:
            p0, p1 = (a0[t - 1] * m[0, 0] + a1[t - 1] * m[1, 0]) * psi0[t], (a0[t - 1] * m[0, 1] + a1[t - 1] * m[1, 1]) * psi1[t]
        s = p0 + p1
        scale[t], a0[t], a1[t] = s, p0 / s, p1 / s
    alive = np.arange(steps)[:, None] < n
    b0, b1 = np.ones(width), np.ones(width)
    marginal, pairs = np.empty((steps, width)), np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        marginal[t] = a1[t] * b1 / (a0[t] * b0 + a1[t] * b1)
        if t:
            on = alive[t]
            q0, q1 = psi0[t] * b0 / scale[t], psi1[t] * b1 / scale[t]
            if learning:
                x = np.array([[a0[t - 1] * m[0, 0] * q0, a0[t - 1] * m[0, 1] * q1], [a1[t - 1] * m[1, 0] * q0, a1[t - 1] * m[1, 1] * q1]]) * on
                pairs += x.sum(-1)
            b0, b1 = np.where(on, m[0, 0] * q0 + m[0, 1] * q1, 1.0), np.where(on, m[1, 0] * q0 + m[1, 1] * q1, 1.0)
    return np.where(alive, marginal, 0.0), pairs


def marginals(model: Model, emissions: list[np.ndarray]) -> list[np.ndarray]:
    out = [np.empty(0)] * len(emissions)
    for some in batches(np.array([len(x) for x in emissions], int)):
        p, _ = forward_backward(model, *padded(emissions, some), learning=False)
        for k, i in enumerate(some):
            out[i] = p[: len(emissions[i]), k]
    return out


def viterbi(model: Model, emissions: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest label sequences; ties go to label 0."""
    out = [np.empty(0, np.int8)] * len(emissions)
    for some in batches(np.array([len(x) for x in emissions], int)):
        e, n = padded(emissions, some)
        steps, width = e.shape
        v0, v1 = np.full(width, float(model.start[0])), model.start[1] + e[0]
        from0, from1 = np.zeros((steps, width), bool), np.zeros((steps, width), bool)
        for t in range(1, steps):
            on = t < n
            x0, y0, x1, y1 = v0 + model.move[0, 0], v1 + model.move[1, 0], v0 + model.move[0, 1], v1 + model.move[1, 1]
            from0[t], from1[t] = on & (y0 > x0), np.where(on, y1 > x1, True)
            v0, v1 = np.where(on, np.maximum(x0, y0), v0), np.where(on, np.maximum(x1, y1) + e[t], v1)
        labels = np.empty((steps, width), np.int8)
        now = v1 > v0
        for t in range(steps - 1, -1, -1):
            labels[t] = now
            now = np.where(now, from1[t], from0[t])
        for k, i in enumerate(some):
            out[i] = labels[: len(emissions[i]), k]
    return out


def fit(sequences, dimensions: int, epochs: int = 5, rate: float = 1.0, l2: float = 1e-3, cells: int = 1 << 15) -> Model:
    """Maximum likelihood with L2 on the features that a batch holds, by AdaGrad over batches of like length, in a fixed order.

    sequences: [(features (positions x slots, -1: none), labels)].
    """
    model = Model(np.zeros(dimensions), np.zeros(2), np.zeros((2, 2)))
    sums = np.full(dimensions, 1e-6), np.full(2, 1e-6), np.full((2, 2), 1e-6)
    groups = list(batches(np.array([len(y) for _, y in sequences], int), cells))
    turn = np.random.default_rng(7)
    for _ in range(epochs):
        for g in turn.permutation(len(groups)):
            some = groups[g]
            feats = [sequences[i][0] for i in some]
            e, n = padded([np.where(f < 0, 0.0, model.weights[f]).sum(1) for f in feats], np.arange(len(some)))
            p, grad_m = forward_backward(model, e, n)
            touched, place = np.unique(np.concatenate([f.ravel() for f in feats]), return_inverse=True)
            error = np.concatenate([p[: n[k], k] - sequences[i][1] for k, i in enumerate(some)])
            grad_w = np.bincount(place, np.repeat(error, feats[0].shape[1]))[touched >= 0]
            touched = touched[touched >= 0]
            grad_w += l2 * model.weights[touched]
            first = sum(p[0, k] - sequences[i][1][0] for k, i in enumerate(some))
            for i in some:
                y = sequences[i][1]
                np.subtract.at(grad_m, (y[:-1], y[1:]), 1)
            sums[0][touched] += grad_w * grad_w
            model.weights[touched] -= rate * grad_w / np.sqrt(sums[0][touched])
            for value, total, grad in ((model.start, sums[1], np.array([-first, first])), (model.move, sums[2], grad_m + l2 * model.move)):
                total += grad * grad
                value -= rate * grad / np.sqrt(total)
    return Model(model.weights.astype(np.float32), model.start, model.move)
