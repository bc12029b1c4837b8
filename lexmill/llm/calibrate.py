"""Platt scaling: turns a classifier's scores into probabilities."""

from __future__ import annotations

import numpy as np


def platt(scores: np.ndarray, labels: np.ndarray, rounds: int = 50):
    """(slope, shift) so that sigmoid(scores @ slope + shift) fits the labels, with Platt's smoothed targets and Newton steps.

    scores: one column, then slope is a number, or several. With one class only, the slope is 0 and the shift gives that class's
    smoothed rate; without rows it gives 0.5.
    """
    columns = (scores if scores.ndim > 1 else scores[:, None]).astype(np.float64)
    pos, neg = float((labels == 1).sum()), float((labels == 0).sum())
    prior = float(np.log((pos + 1) / (neg + 1)))
    if not pos or not neg:
        return (0.0 if scores.ndim == 1 else np.zeros(columns.shape[1])), prior
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = columns.mean(axis=0), np.where(columns.std(axis=0) > 0, columns.std(axis=0), 1.0)
    x = np.concatenate([(columns - mean) / spread, np.ones((len(columns), 1))], axis=1)
    w = np.array([0.0] * columns.shape[1] + [prior])
    ridge = np.array([1e-2] * columns.shape[1] + [1e-9])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - target) + ridge * w)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / spread
    return (float(slope[0]) if scores.ndim == 1 else slope), float(w[-1] - slope @ mean)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
