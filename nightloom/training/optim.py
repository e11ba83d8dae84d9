"""Optimiser and scheduler as plain state on the driver, whose size is that of the model."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Adam:
    """Adam with decay added to the gradient."""

    rate: float = 1e-3
    decay: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    steps: int = 0
    first: np.ndarray | None = field(default=None, repr=False)
    second: np.ndarray | None = field(default=None, repr=False)

    def step(self, params: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if self.first is None:
            self.first, self.second = np.zeros_like(params), np.zeros_like(params)
        g, (a, b) = gradient + self.decay * params, self.betas
        self.steps += 1
        self.first, self.second = a * self.first + (1 - a) * g, b * self.second + (1 - b) * g * g
        top, low = self.first / (1 - a**self.steps), self.second / (1 - b**self.steps)
        return params - self.rate * top / (np.sqrt(low) + self.epsilon)


@dataclass
class Plateau:
    """Multiplies the rate by a factor when a loss has not improved by a relative threshold for more than ``patience`` epochs."""

    factor: float = 0.5
    patience: int = 1
    threshold: float = 1e-4
    least_change: float = 1e-8
    best: float = float("inf")
    waited: int = 0

    def step(self, loss: float, rate: float) -> float:
        if loss < self.best * (1 - self.threshold):
            self.best, self.waited = loss, 0
        else:
            self.waited += 1
        if self.waited > self.patience:
            self.waited = 0
            lower = rate * self.factor
            return lower if rate - lower > self.least_change else rate
        return rate
