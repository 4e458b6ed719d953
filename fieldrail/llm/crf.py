"""A linear-chain conditional random field with two labels over hashed binary features.

A sequence's score is the sum of its blocks' feature weights where the label is 1, of the transitions
between neighbours, and of what its first and last labels weigh.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Field:
    """weight: a feature each; step[a, b]: from label a to b; begin, end: by label."""

    weight: np.ndarray
    step: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def viterbi(emission: list[float], field: Field) -> list[int]:
    """The best labels of a sequence, given what label 1 weighs at each place; ties take 1."""
    if not emission:
        return []
    (s00, s01), (s10, s11) = field.step.tolist()
    b0, b1 = field.begin.tolist()
    e0, e1 = field.end.tolist()
    low, high = b0, b1 + emission[0]
    came: list[tuple[int, int]] = []
    for x in emission[1:]:
        to0, to1 = (int(high + s10 >= low + s00), int(high + s11 >= low + s01))
        came.append((to0, to1))
        low, high = (high + s10 if to0 else low + s00), (high + s11 if to1 else low + s01) + x
    label = int(high + e1 >= low + e0)
    out = [label]
    for back in reversed(came):
        label = back[label]
        out.append(label)
    return out[::-1]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def expectations(emission: np.ndarray, size: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition, P(label 1) by place, expected steps) of sequences padded to one length."""
    n, t = emission.shape
    unary = np.stack([np.zeros_like(emission), emission], 2)
    ahead = np.empty((n, t, 2))
    ahead[:, 0] = field.begin + unary[:, 0]
    for k in range(1, t):
        ahead[:, k] = np.where((k < size)[:, None], _sum(ahead[:, k - 1, :, None] + field.step, 1) + unary[:, k], ahead[:, k - 1])
    total = _sum(ahead[:, -1] + field.end, 1)
    back = np.empty((n, t, 2))
    back[:, -1] = field.end
    steps = np.zeros((2, 2))
    for k in range(t - 2, -1, -1):
        on = k + 1 < size
        after = unary[:, k + 1] + back[:, k + 1]
        pair = ahead[:, k, :, None] + field.step + after[:, None, :] - total[:, None, None]
        steps += np.exp(pair[on]).sum(0)
        back[:, k] = np.where(on[:, None], _sum(field.step + after[:, None, :], 2), field.end)
    inside = np.arange(t) < size[:, None]
    share = np.where(inside, np.exp(np.clip(ahead[:, :, 1] + back[:, :, 1] - total[:, None], None, 0)), 0)
    return total, share, steps


def loss(sequences: list[list[list[int]]], labels: list[list[int]], field: Field, decay: float) -> tuple[float, Field]:
    """Mean negative log likelihood with a quadratic penalty, and its gradient."""
    size = np.array([len(s) for s in sequences])
    n, t = len(size), int(size.max())
    index = np.array([f for s in sequences for b in s for f in b])
    row = np.repeat(np.concatenate([i * t + np.arange(m) for i, m in enumerate(size)]), [len(b) for s in sequences for b in s])
    return _loss(index, row, size, _padded(labels, t), field, decay)


def _padded(labels: list[list[int]], t: int) -> np.ndarray:
    out = np.zeros((len(labels), t), np.int64)
    for i, y in enumerate(labels):
        out[i, : len(y)] = y
    return out


def _loss(index: np.ndarray, row: np.ndarray, size: np.ndarray, truth: np.ndarray, field: Field, decay: float) -> tuple[float, Field]:
    n, t = truth.shape
    emission = np.bincount(row, field.weight[index], n * t).reshape(n, t)
    total, share, steps = expectations(emission, size, field)
    last = truth[np.arange(n), size - 1]
    paired = np.arange(1, t) < size[:, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[:, :-1][paired], truth[:, 1:][paired]), 1)
    inside = np.arange(t) < size[:, None]
    score = (emission * truth * inside).sum() + (seen * field.step).sum() + field.begin[truth[:, 0]].sum() + field.end[last].sum()
    penalty = sum((x**2).sum() for x in (field.weight, field.step, field.begin, field.end)) * decay / 2
    wrong = (share - truth * inside) / n
    weight = np.bincount(index, wrong.reshape(-1)[row], len(field.weight)) + decay * field.weight
    # the end labels' shares
    at_end = share[np.arange(n), size - 1]
    begin = np.array([(1 - share[:, 0]).sum() - (truth[:, 0] == 0).sum(), share[:, 0].sum() - truth[:, 0].sum()]) / n + decay * field.begin
    end = np.array([(1 - at_end).sum() - (last == 0).sum(), at_end.sum() - last.sum()]) / n + decay * field.end
    return float((total.sum() - score) / n + penalty), Field(weight, (steps - seen) / n + decay * field.step, begin, end)


def fit(sequences: list[list[list[int]]], labels: list[list[int]], features: int, rounds: int = 150, rate: float = 0.1, decay: float = 2e-4) -> Field:
    """Adam over all sequences; without any, all weights are 0."""
    value = [np.zeros(features), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    if not sequences:
        return Field(*value)
    size = np.array([len(s) for s in sequences])
    t = int(size.max())
    flat = np.array([f for s in sequences for b in s for f in b])
    used, index = np.unique(flat, return_inverse=True)
    row = np.repeat(np.concatenate([i * t + np.arange(m) for i, m in enumerate(size)]), [len(b) for s in sequences for b in s])
    truth = _padded(labels, t)
    held = [np.zeros(len(used)), *value[1:]]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in held]
    for k in range(1, rounds + 1):
        _, grad = _loss(index, row, size, truth, Field(*held), decay)
        for x, (m, v), g in zip(held, state, (grad.weight, grad.step, grad.begin, grad.end)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    value[0][used] = held[0]
    return Field(value[0], *held[1:])
