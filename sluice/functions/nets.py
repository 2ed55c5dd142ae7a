"""Scores of fitted linear and layered classifiers over many rows at a time, and their derivatives by the inputs."""

from __future__ import annotations

import dataclasses

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def one_hot(y: np.ndarray, classes: int) -> np.ndarray:
    return (y[:, None] == np.arange(classes)).astype(np.float64)


@dataclasses.dataclass
class Net:
    """Inputs (x - shift) * scale, then layers of weights (inputs, outputs) and biases, a logistic curve after all but the last; classes by softmax."""

    shift: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    @property
    def classes(self) -> int:
        return len(self.layers[-1][1])

    def _through(self, x: np.ndarray) -> list[np.ndarray]:
        out = [(x - self.shift) * self.scale]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if i == len(self.layers) - 1 else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes)"""
        return self._through(x)[-1]

    def shares(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.logits(x))

    def pull(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(rows, inputs): the gradient of the sum of weights (rows, classes) times logits."""
        through, g = self._through(x), weights
        for i in range(len(self.layers) - 1, -1, -1):
            g = g @ self.layers[i][0].T
            if i:
                g = g * through[i] * (1 - through[i])
        return g * self.scale

    def jacobian(self, x: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """(rows, chosen classes, inputs) for classes (rows, chosen)."""
        eye = np.eye(self.classes)
        return np.stack([self.pull(x, eye[classes[:, i]]) for i in range(classes.shape[1])], axis=1)


def of_perceptron(weights: np.ndarray, sizes: list[int], shift: np.ndarray, scale: np.ndarray) -> Net:
    """From the flat weights of Spark ML's perceptron: of each layer a matrix by inputs, then its biases."""
    layers, at = [], 0
    for n, m in zip(sizes, sizes[1:], strict=False):
        layers.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + n * m + m]))
        at += n * m + m
    return Net(shift, scale, layers)


def of_centres(centres: np.ndarray) -> Net:
    """The linear classifier that gives a row the nearest of these centres (classes, inputs): softmax of negated half squared distances."""
    n = centres.shape[1]
    return Net(np.zeros(n), np.ones(n), [(centres.T.copy(), -0.5 * (centres**2).sum(axis=1))])


def of_logistic(coefficients: np.ndarray, intercepts: np.ndarray) -> Net:
    """From a multinomial regression (classes, inputs), or a binomial one (1, inputs)."""
    if len(coefficients) == 1:
        coefficients, intercepts = np.concatenate([0 * coefficients, coefficients]), np.concatenate([[0.0], intercepts])
    n = coefficients.shape[1]
    return Net(np.zeros(n), np.ones(n), [(coefficients.T.copy(), intercepts)])
