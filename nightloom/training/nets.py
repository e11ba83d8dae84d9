"""Small dense networks in numpy batches: scores, losses, and gradients for parameters and for inputs.

A model is anything with ``start()`` (its parameters as one vector), ``scores(params, x)``, ``loss(params, x, y)`` and
``gradient(params, x, y)`` (the sum of the losses, and of their gradients, over the rows of a batch).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

DELTA, UNIT = 5.0, 112.5  # fixed values: where the Huber loss turns linear, and what it is divided by


class Dense:
    """Layers of the given sizes, the first of which is the number of features and the last that of the scores; ``tanh`` or
    ``relu`` between them. Losses: ``cel``, the cross entropy of classes; ``mse`` and ``reg`` (Huber's) of one score."""

    def __init__(self, sizes: Sequence[int], activation: str = "tanh", loss: str = "cel", seed: int = 42):
        if loss != "cel" and sizes[-1] != 1:
            raise ValueError("a regression has one score")
        self.sizes, self.activation, self.kind, self.seed = tuple(int(s) for s in sizes), activation, loss, seed

    def start(self) -> np.ndarray:
        """Uniform weights within 1 / sqrt(inputs), the same for the same seed."""
        rng = np.random.default_rng(self.seed)
        shapes = zip(self.sizes, self.sizes[1:])
        return np.concatenate([rng.uniform(-1, 1, b * a + b) / np.sqrt(a) for a, b in shapes])

    def layers(self, params: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((params[at : at + a * b].reshape(b, a), params[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def _forward(self, params: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Inputs of each layer, and the scores."""
        steps, layers = [np.asarray(x, np.float64)], self.layers(params)
        for i, (w, b) in enumerate(layers):
            z = steps[-1] @ w.T + b
            steps.append(z if i == len(layers) - 1 else np.tanh(z) if self.activation == "tanh" else np.maximum(z, 0))
        return steps

    def _backward(self, params: np.ndarray, steps: list[np.ndarray], up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradients of all parameters, of each input) from those of the scores."""
        parts, layers = [], self.layers(params)
        for i in reversed(range(len(layers))):
            parts += [up.sum(0), (up.T @ steps[i]).ravel()]
            up = up @ layers[i][0]
            if i:
                up = up * (1 - steps[i] ** 2 if self.activation == "tanh" else steps[i] > 0)
        return np.concatenate(parts[::-1]), up

    def scores(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(params, x)[-1]

    def _losses(self, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's loss and its gradient for the scores."""
        if self.kind == "cel":
            z = scores - scores.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            at = np.arange(len(y)), y.astype(int)
            own = -np.log(np.maximum(p[at], 1e-300))
            p[at] -= 1
            return own, p
        e = scores[:, 0] - y
        if self.kind == "mse":
            return e * e, 2 * e[:, None]
        inside = np.abs(e) <= DELTA
        return np.where(inside, e * e / 2, DELTA * (np.abs(e) - DELTA / 2)) / UNIT, (np.clip(e, -DELTA, DELTA) / UNIT)[:, None]

    def loss(self, params: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._losses(self.scores(params, x), np.asarray(y))[0]

    def gradient(self, params: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        steps = self._forward(params, x)
        own, up = self._losses(steps[-1], np.asarray(y))
        return float(own.sum()), self._backward(params, steps, up)[0]

    def input_gradient(self, params: np.ndarray, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each row, the gradient of its target's score for its input."""
        steps = self._forward(params, x)
        up = np.zeros_like(steps[-1])
        up[np.arange(len(up)), target] = 1
        return self._backward(params, steps, up)[1]
