"""A network for tables: embedded categories, flags and normalised numbers through layers with normalisation and dropout, with its derivatives."""

from __future__ import annotations

import dataclasses
import json

import numpy as np

from sluice.functions import nets, scalars

#: Sizes of the hidden layers, share of units that are dropped in training, what is added to deviations.
HIDDEN, DROP, INPUT_EPS, LAYER_EPS = (256, 128), 0.2, 1e-6, 1e-5


@dataclasses.dataclass
class Inputs:
    """Places of categories with their number of values, of flags and of numbers."""

    categorical: dict[int, int]
    binary: list[int]
    continuous: list[int]

    @classmethod
    def of(cls, width: int, categorical: dict[int, int] | None = None, binary: list[int] | None = None) -> Inputs:
        known = {int(k): int(v) for k, v in (categorical or {}).items()}
        flags = list(binary or [])
        return cls(known, flags, [i for i in range(width) if i not in known and i not in flags])


@dataclasses.dataclass
class Network:
    """values: the known values of each categorical place; any other has an embedding of zeros. mean and std of the numbers. weights by name."""

    inputs: Inputs
    values: dict[int, np.ndarray]
    mean: np.ndarray
    std: np.ndarray
    weights: dict[str, np.ndarray]
    classes: int

    @classmethod
    def start(cls, inputs: Inputs, values: dict[int, np.ndarray], mean: np.ndarray, std: np.ndarray, classes: int, most: int = 50, hidden: tuple[int, ...] = HIDDEN, seed: int = 42) -> Network:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for place, n in inputs.categorical.items():
            w[f"e{place}"] = rng.normal(size=(len(values[place]), scalars.embedding_size(n, most)))
        width = sum(v.shape[1] for v in w.values()) + len(inputs.binary) + len(inputs.continuous)
        w["gamma"], w["beta"] = np.ones(len(inputs.continuous)), np.zeros(len(inputs.continuous))
        for i, size in enumerate((*hidden, classes)):
            w[f"w{i}"], w[f"b{i}"] = rng.normal(size=(width, size)) * np.sqrt(2 / (width + size)), np.zeros(size)
            if i < len(hidden):
                w[f"s{i}"], w[f"o{i}"] = np.ones(size), np.zeros(size)
            width = size
        return cls(inputs, values, mean, np.where(std < INPUT_EPS, 1.0, std), w, classes)

    @property
    def width(self) -> int:
        return len(self.inputs.categorical) + len(self.inputs.binary) + len(self.inputs.continuous)

    @property
    def depth(self) -> int:
        return sum(k.startswith("w") for k in self.weights)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.weights.values()])

    def with_flat(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, v in self.weights.items():
            out[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return dataclasses.replace(self, weights=out)

    def _embedded(self, x: np.ndarray):
        """(place, row of its embedding, is the value known) of each categorical input."""
        for place in self.inputs.categorical:
            known = self.values[place]
            v = np.rint(x[:, place])
            at = np.minimum(np.searchsorted(known, v), max(0, len(known) - 1))
            yield place, at, (known[at] == v) if len(known) else np.zeros(len(x), bool)

    def through(self, x: np.ndarray, dropped: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Logits, and what backward() needs. With dropped, units are left out at random."""
        w = self.weights
        embedded = list(self._embedded(x))
        parts = [np.where(known[:, None], w[f"e{p}"][at] if len(self.values[p]) else 0.0, 0.0) for p, at, known in embedded]
        flags = np.clip(np.rint(np.nan_to_num(x[:, self.inputs.binary])), 0, 1)
        number = (x[:, self.inputs.continuous] - self.mean) / (self.std + INPUT_EPS)
        number = np.where(np.isnan(number), 0.0, number)
        h = np.concatenate([*parts, flags, number * w["gamma"] + w["beta"]], axis=1)
        kept = [(embedded, number)]
        for i in range(self.depth):
            z = h @ w[f"w{i}"] + w[f"b{i}"]
            if i == self.depth - 1:
                kept.append((h,))
                return z, kept
            sd = np.sqrt(z.var(axis=1, keepdims=True) + LAYER_EPS)
            normal = (z - z.mean(axis=1, keepdims=True)) / sd
            a = normal * w[f"s{i}"] + w[f"o{i}"]
            on = (a > 0).astype(np.float64)
            if dropped is not None:
                on *= (dropped.random(a.shape) >= DROP) / (1 - DROP)
            kept.append((h, sd, normal, on))
            h = a * on
        raise ValueError("no layers")

    def backward(self, kept: list, g: np.ndarray, of_weights: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Derivatives by the weights and by the inputs, of the sum of g (rows, classes) times logits. Categories and flags have none."""
        w, out = self.weights, {}
        for i in range(self.depth - 1, -1, -1):
            h = kept[i + 1][0]
            if i < self.depth - 1:
                _, sd, normal, on = kept[i + 1]
                g = g * on
                if of_weights:
                    out[f"s{i}"], out[f"o{i}"] = (g * normal).sum(axis=0), g.sum(axis=0)
                g = g * w[f"s{i}"]
                g = (g - g.mean(axis=1, keepdims=True) - normal * (g * normal).mean(axis=1, keepdims=True)) / sd
            if of_weights:
                out[f"w{i}"], out[f"b{i}"] = h.T @ g, g.sum(axis=0)
            g = g @ w[f"w{i}"].T
        embedded, number = kept[0]
        at = 0
        for place, rows, known in embedded:
            size = w[f"e{place}"].shape[1]
            if of_weights:
                out[f"e{place}"] = np.zeros_like(w[f"e{place}"])
                np.add.at(out[f"e{place}"], rows[known], g[known, at : at + size])
            at += size
        g = g[:, at + len(self.inputs.binary) :]
        if of_weights:
            out["gamma"], out["beta"] = (g * number).sum(axis=0), g.sum(axis=0)
        x = np.zeros((len(g), self.width))
        x[:, self.inputs.continuous] = g * w["gamma"] / (self.std + INPUT_EPS)
        return out, x

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.through(x)[0]

    def shares(self, x: np.ndarray) -> np.ndarray:
        return nets.softmax(self.logits(x))

    def pull(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(rows, inputs): the gradient of the sum of weights (rows, classes) times logits."""
        return self.backward(self.through(x)[1], weights, False)[1]

    def jacobian(self, x: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """(rows, chosen classes, inputs) for classes (rows, chosen)."""
        eye, kept = np.eye(self.classes), self.through(x)[1]
        return np.stack([self.backward(kept, eye[classes[:, i]], False)[1] for i in range(classes.shape[1])], axis=1)

    def rows(self) -> list[tuple[str, list[int], bytearray]]:
        """(name, shape, data) of all that it knows."""
        config = json.dumps({"classes": self.classes} | dataclasses.asdict(self.inputs)).encode()
        arrays = {f"weight {k}": v for k, v in self.weights.items()} | {f"values {k}": v for k, v in self.values.items()} | {"mean": self.mean, "std": self.std}
        return [("config", [], bytearray(config)), *((k, list(v.shape), bytearray(np.asarray(v, "<f8").tobytes())) for k, v in arrays.items())]

    @classmethod
    def of_rows(cls, rows: list[tuple[str, list[int], bytes]]) -> Network:
        by = {name: (shape, bytes(data)) for name, shape, data in rows}
        config = json.loads(by.pop("config")[1])
        arrays = {k: np.frombuffer(data, "<f8").reshape(shape) for k, (shape, data) in by.items()}
        inputs = Inputs.of(len(config["categorical"]) + len(config["binary"]) + len(config["continuous"]), config["categorical"], config["binary"])
        order = cls.start(inputs, {p: arrays[f"values {p}"] for p in inputs.categorical}, arrays["mean"], arrays["std"], config["classes"], 2).weights
        return cls(inputs, {p: arrays[f"values {p}"] for p in inputs.categorical}, arrays["mean"], arrays["std"], {k: arrays[f"weight {k}"] for k in order}, config["classes"])


@dataclasses.dataclass
class Adam:
    """Moments of a flat vector of weights; decay is apart from the gradient."""

    rate: float
    decay: float
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, flat: np.ndarray, g: np.ndarray, most: float = 1.0) -> np.ndarray:
        size = np.linalg.norm(g)
        if size > most:
            g = g * (most / (size + 1e-6))
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        up = self.first / (1 - 0.9**self.steps)
        down = np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8
        return flat * (1 - self.rate * self.decay) - self.rate * up / down


def loss_sum(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    """The sum of the rows' cross-entropies."""
    z = net.logits(x)
    z = z - z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).sum())


def gradient(net: Network, x: np.ndarray, y: np.ndarray, dropped: np.random.Generator | None) -> np.ndarray:
    """Of the mean cross-entropy, flat."""
    z, kept = net.through(x, dropped)
    g, _ = net.backward(kept, (nets.softmax(z) - nets.one_hot(y, net.classes)) / len(y))
    return np.concatenate([g[k].ravel() for k in net.weights])
