"""Turning a classifier's logit into a probability."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def platt(logit: np.ndarray, truth: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(scale, shift) of the logistic fit of the label on the logit; `weight` is how many rows each entry stands for.

    The labels are smoothed by their counts, a small ridge keeps a perfectly parted sample finite, and Newton's steps on the standardised logit are
    bounded, so that they can't run away where the curve is flat.
    """
    weight = np.ones(len(logit)) if weight is None else weight
    up, down = (weight * truth).sum(), (weight * (1 - truth)).sum()
    aim = np.where(truth == 1, (up + 1) / (up + 2), 1 / (down + 2))
    centre = float(np.average(logit, weights=weight))
    spread = float(np.sqrt(np.average((logit - centre) ** 2, weights=weight))) + 1e-9
    x = np.stack([(logit - centre) / spread, np.ones(len(logit))])
    w = np.zeros(2)
    for _ in range(200):
        p = sigmoid(w @ x)
        slope = x @ (weight * (p - aim)) + 0.01 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 0.01 * np.eye(2), slope)
        w = w - step * min(1.0, 0.5 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(step) < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)
