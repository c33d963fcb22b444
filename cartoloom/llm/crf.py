"""Linear-chain conditional random fields in numpy: fitting by forward-backward, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cartoloom.llm._features import adam


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Crf:
    """emission[f, k]: weight of feature f for label k; step[j, k]: from label j to k; first[k]: at the start."""

    emission: np.ndarray
    step: np.ndarray
    first: np.ndarray

    @property
    def labels(self) -> int:
        return len(self.first)


def marginals(score: np.ndarray, mask: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded sequences score[n, t, k]: label marginals, expected transitions [k, k], and log partition sums.

    mask[n, t] is true for the tokens; every sequence begins at t = 0.
    """
    n, length, k = score.shape
    forward = np.zeros_like(score)
    forward[:, 0] = first + score[:, 0]
    for t in range(1, length):
        new = logsumexp(forward[:, t - 1, :, None] + step, 1) + score[:, t]
        forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
    total = logsumexp(forward[:, -1], 1)
    backward = np.zeros_like(score)
    for t in range(length - 2, -1, -1):
        new = logsumexp(step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
    single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
    pair = np.zeros((k, k))
    for t in range(1, length):
        p = np.exp(forward[:, t - 1, :, None] + step + (score[:, t] + backward[:, t])[:, None, :] - total[:, None, None])
        pair += (p * mask[:, t, None, None]).sum(0)
    return single, pair, total


def fit(features: np.ndarray, gold: np.ndarray, mask: np.ndarray, size: int, labels: int, steps: int = 80, rate: float = 0.2, l2: float = 1e-3) -> Crf:
    """features[n, t, i]: the feature ids of a token, -1 for none; gold[n, t]: its label. Full-batch Adam."""
    n, length, _ = features.shape
    used = (features >= 0) & mask[:, :, None]
    flat = np.where(used, features, size)  # row `size` is always 0
    one = np.eye(labels)[gold] * mask[:, :, None]
    seen = np.einsum("ntj,ntk->jk", one[:, :-1], one[:, 1:] * mask[:, 1:, None])

    def grad(w: list[np.ndarray]) -> list[np.ndarray]:
        emission, step, first = w
        score = np.vstack([emission, np.zeros((1, labels))])[flat].sum(2)
        single, pair, _ = marginals(score, mask, step, first)
        off = (single - one) / n
        ge = np.stack([np.bincount(flat[used], np.broadcast_to(off[:, :, None, k], flat.shape)[used], size) for k in range(labels)], 1)
        return [ge + l2 * emission, (pair - seen) / n + l2 * step, off[:, 0].sum(0) + l2 * first]

    return Crf(*adam(grad, [np.zeros((size, labels)), np.zeros((labels, labels)), np.zeros(labels)], steps, rate))


def viterbi(score: np.ndarray, mask: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels of padded sequences; ties go to the lower label."""
    best, came = advance(score, mask, step, np.broadcast_to(first, (len(score), len(first))))
    return trace(came, best.argmax(1))


def advance(score: np.ndarray, mask: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best score that ends in each label, and the label before it at each token. begin[n, k]: what label k has before
    the first token's score. Padding passes labels on."""
    n, length, k = score.shape
    best = begin + score[:, 0]
    came = np.zeros((n, length, k), np.int8)
    for t in range(1, length):
        through = best[:, :, None] + step
        came[:, t] = through.argmax(1)
        new = through.max(1) + score[:, t]
        came[:, t][~mask[:, t]] = np.arange(k)
        best = np.where(mask[:, t, None], new, best)
    return best, came


def trace(came: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The labels of the paths that end in the labels last."""
    n, length, _ = came.shape
    out = np.zeros((n, length), np.int8)
    out[:, -1] = last
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = np.take_along_axis(came[:, t], out[:, t, None].astype(np.int64), 1)[:, 0]
    return out


def through(score: np.ndarray, mask: np.ndarray, step: np.ndarray) -> np.ndarray:
    """[n, j, k]: the best score of a block that is entered from label j and left with label k."""
    best = step[None] + score[:, 0, None, :]
    for t in range(1, score.shape[1]):
        new = (best[:, :, :, None] + step).max(2) + score[:, t, None, :]
        best = np.where(mask[:, t, None, None], new, best)
    return best
