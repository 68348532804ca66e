"""A small causal self-attention language model over subword ids, trained and evaluated in numpy.

One attention layer with learned biases by distance reads the ids before a place; the id at a place is predicted from the
layer's output in two steps, first its class, then its place in the class.  Classes hold the most frequent ids, few
enough that a step is a small matrix product; ids beyond them form a last class, in which counts decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class ModelShape:
    """``window`` ids are read at a time, of which the first ``overlap`` are context that the window before has scored."""

    classes: int = 32
    per_class: int = 32
    width: int = 16
    window: int = 32
    overlap: int = 8

    @property
    def known(self) -> int:
        return self.classes * self.per_class


class Vocabulary:
    """What the counts of ids say: the frequent ids by rank, and the log probabilities of the others.

    ``ids`` and ``counts`` are those of the training texts; ``size`` is the number of all ids, each counted once more.
    Ids of rank r lie in class r % classes, so that classes are about equally likely.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, size: int, shape: ModelShape):
        order = np.lexsort((ids, -counts))[: shape.known]
        self.rank = np.full(size, shape.known, np.int32)
        self.rank[ids[order]] = np.arange(len(order))
        every = np.ones(size)
        every[ids] += counts
        self.frequency = np.zeros(shape.known + 1)
        self.frequency[: len(order)] = every[ids[order]]
        rest = self.rank == shape.known
        self.frequency[shape.known] = every[rest].sum()
        self.rest = np.where(rest, np.log(every / max(every[rest].sum(), 1.0)), 0.0)


def initial(vocabulary: Vocabulary, shape: ModelShape, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters that predict the plain frequencies, with small random vectors."""
    rng = np.random.default_rng(seed)
    k, d = shape.known, shape.width
    frequency = np.maximum(vocabulary.frequency, 1e-3)
    grid = frequency[:k].reshape(shape.per_class, shape.classes)
    small = lambda *size: rng.normal(0.0, 0.3, size).astype(F32)
    return {
        # One more row for a rest id, one for the start of a text.
        "embed": small(k + 2, d), "q": small(d, d), "k": small(d, d), "v": small(d, d) / 2, "skip": np.eye(d, dtype=F32),
        "distance": np.linspace(0.0, -2.0, shape.window).astype(F32), "class_w": small(d, shape.classes + 1) / 3,
        "class_b": np.log(np.append(grid.sum(axis=0), frequency[k]) / frequency.sum()).astype(F32),
        "place_w": small(shape.classes, d, shape.per_class) / 3,
        "place_b": np.log(grid / grid.sum(axis=0)).T.astype(F32).copy(),
    }


def flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[name].ravel() for name in sorted(parameters)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in sorted(like):
        size = like[name].size
        out[name] = np.asarray(values[at : at + size], F32).reshape(like[name].shape)
        at += size
    return out


def _bias(distance: np.ndarray, length: int) -> np.ndarray:
    """Scores by how far back a place is; later places are masked."""
    back = np.arange(length)[:, None] - np.arange(length)[None, :]
    return np.where(back >= 0, distance[np.maximum(back, 0)], F32(-1e9)).astype(F32)


def _attend(p: dict[str, np.ndarray], inputs: np.ndarray):
    """Output of the layer at each place of each row of input ids (ranks)."""
    length = inputs.shape[1]
    tables = [p["embed"] @ p[name] for name in ("q", "k", "v", "skip")]
    query, key, value, skip = (table[inputs] for table in tables)
    weight = query @ np.ascontiguousarray(key.transpose(0, 2, 1))
    weight *= F32(p["q"].shape[0] ** -0.5)
    weight += _bias(p["distance"], length)
    np.minimum(weight, F32(60.0), out=weight)
    np.exp(weight, out=weight)
    weight /= weight.sum(axis=2, keepdims=True) + F32(1e-30)
    return skip + weight @ value, (query, key, value, weight)


class Scorer:
    """The model for reading only: tables of all vectors of an id, and exponentials without a maximum taken out.

    Trained scores are small; where one is not, sums overflow, and the rows are computed again with it.
    """

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.width, self.length = p, p["q"].shape[0], len(p["distance"])
        scale = F32(self.width**-0.5)
        ones = np.ones((len(p["embed"]), 1), F32)
        self.table = np.concatenate([p["embed"] @ p["q"] * scale, p["embed"] @ p["k"], p["embed"] @ p["skip"], p["embed"] @ p["v"], ones], axis=1)
        self.bias = _bias(p["distance"], self.length)
        self.classes = p["class_w"].shape[1] - 1
        self.ones = [np.ones(self.classes + 1, F32), np.ones(p["place_w"].shape[2], F32)]

    def hidden(self, inputs: np.ndarray) -> np.ndarray:
        d = self.width
        vectors = np.take(self.table, inputs, axis=0)
        weight = vectors[:, :, :d] @ np.ascontiguousarray(vectors[:, :, d : 2 * d].transpose(0, 2, 1))
        weight += self.bias
        np.exp(weight, out=weight)
        mixed = weight @ vectors[:, :, 3 * d :]
        out = mixed[:, :, :d] / mixed[:, :, d:]
        out += vectors[:, :, 2 * d : 3 * d]
        return out if np.isfinite(out).all() else _attend(self.p, inputs)[0]

    @staticmethod
    def _log_sum(logits: np.ndarray, ones: np.ndarray) -> np.ndarray:
        sums = np.exp(logits) @ ones
        if np.isfinite(sums).all() and sums.min(initial=1.0) > 0:
            return np.log(sums)
        top = logits.max(axis=1, keepdims=True)
        return np.log(np.exp(logits - top) @ ones) + top[:, 0]

    def __call__(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, rows: int = 512) -> np.ndarray:
        """Natural log probabilities of the target ranks at the places marked in ``scored``; a rest id gets its class's."""
        parts = [self.hidden(inputs[at : at + rows])[scored[at : at + rows]] for at in range(0, len(inputs), rows)]
        h, target = np.concatenate(parts) if parts else np.zeros((0, self.width), F32), targets[scored]
        p, classes = self.p, self.classes
        known = target < classes * p["place_w"].shape[2]
        cls = np.where(known, target % classes, classes).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        h, cls, place = h[order], cls[order], (target // classes)[order]
        bounds = np.searchsorted(cls, np.arange(classes + 1))
        logits = h @ p["class_w"]
        logits += p["class_b"]
        found = logits[np.arange(len(h)), cls] - self._log_sum(logits, self.ones[0])
        for c in range(classes):
            part = slice(bounds[c], bounds[c + 1])
            if bounds[c] < bounds[c + 1]:
                logits = h[part] @ p["place_w"][c]
                logits += p["place_b"][c]
                found[part] += logits[np.arange(len(logits)), place[part]] - self._log_sum(logits, self.ones[1])
        out = np.empty(len(h))
        out[order] = found
        return out


def log_probabilities(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> np.ndarray:
    return Scorer(p)(inputs, targets, scored)


def _gradients(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray):
    """Loss per scored place and the gradient of every parameter."""
    hidden, (query, key, value, weight) = _attend(p, inputs)
    h, target = hidden[scored], targets[scored]
    n, classes, per = len(h), p["class_w"].shape[1] - 1, p["place_w"].shape[2]
    known = target < classes * per
    cls, place = np.where(known, target % classes, classes), target // classes
    g = {name: np.zeros_like(x) for name, x in p.items()}

    def softmax(logits: np.ndarray, want: np.ndarray) -> tuple[float, np.ndarray]:
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        logits /= logits.sum(axis=1, keepdims=True)
        at = np.arange(len(want))
        loss = -np.log(logits[at, want] + 1e-30).sum()
        logits[at, want] -= 1
        return float(loss), logits / F32(n)

    loss, delta = softmax(h @ p["class_w"] + p["class_b"], cls)
    g["class_w"], g["class_b"] = h.T @ delta, delta.sum(axis=0)
    dh = delta @ p["class_w"].T
    for c in range(classes):
        at = np.flatnonzero(cls == c)
        if len(at):
            more, delta = softmax(h[at] @ p["place_w"][c] + p["place_b"][c], place[at])
            loss += more
            g["place_w"][c], g["place_b"][c] = h[at].T @ delta, delta.sum(axis=0)
            dh[at] += delta @ p["place_w"][c].T
    d_hidden = np.zeros_like(hidden)
    d_hidden[scored] = dh
    d_weight = d_hidden @ np.ascontiguousarray(value.transpose(0, 2, 1))
    d_value = np.ascontiguousarray(weight.transpose(0, 2, 1)) @ d_hidden
    d_score = weight * (d_weight - (d_weight * weight).sum(axis=2, keepdims=True))
    length = inputs.shape[1]
    back = np.arange(length)[:, None] - np.arange(length)[None, :]
    g["distance"] = np.bincount(np.maximum(back, 0).ravel(), np.where(back >= 0, d_score.sum(axis=0), 0).ravel(), length).astype(F32)
    scale = F32(p["q"].shape[0] ** -0.5)
    d_query, d_key = d_score @ key * scale, np.ascontiguousarray(d_score.transpose(0, 2, 1)) @ query * scale
    embedded = p["embed"][inputs]
    d_embedded = np.zeros_like(embedded)
    for name, d in (("q", d_query), ("k", d_key), ("v", d_value), ("skip", d_hidden)):
        g[name] = np.einsum("bld,ble->de", embedded, d, optimize=True)
        d_embedded += d @ p[name].T
    np.add.at(g["embed"], inputs.ravel(), d_embedded.reshape(-1, d_embedded.shape[2]))
    return loss / max(n, 1), g


def train(p: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, rate: float, batch: int = 64):
    """One pass over the rows by Adam; rows are taken in the order given.  Returns the parameters and the mean loss."""
    p = {name: x.copy() for name, x in p.items()}
    first = {name: np.zeros_like(x) for name, x in p.items()}
    second = {name: np.zeros_like(x) for name, x in p.items()}
    losses = []
    for step, at in enumerate(range(0, len(inputs), batch), 1):
        part = slice(at, at + batch)
        loss, g = _gradients(p, inputs[part], targets[part], scored[part])
        losses.append(loss)
        for name in p:
            first[name] = 0.9 * first[name] + 0.1 * g[name]
            second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
            p[name] = (p[name] - rate * move).astype(F32)
    return p, float(np.mean(losses)) if losses else 0.0


def window_places(first: np.ndarray, shape: ModelShape) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each window of all texts; ``first`` is where each text's ids begin (and a last)."""
    step = shape.window - shape.overlap
    sizes = np.diff(first)
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - shape.window) // step)), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)


def windows(
    ranks: np.ndarray, first: np.ndarray, shape: ModelShape, places: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and places to score of all windows, or those at ``places``: every id is scored in one window.

    ``ranks`` are the texts' ids in a row.  Input ``i`` is the id before target ``i``, or the start mark.
    """
    text, number = window_places(first, shape) if places is None else places
    at = (first[text] + number * (shape.window - shape.overlap))[:, None] + np.arange(shape.window)
    inside = at < first[text + 1][:, None]
    # The start mark before all ids, and something behind them.
    padded = np.concatenate([[shape.known + 1], ranks, [0]]).astype(np.int32)
    np.minimum(at, len(ranks), out=at)
    targets, inputs = padded[at + 1], padded[at]
    inputs[number == 0, 0] = shape.known + 1
    inputs[~inside] = shape.known + 1
    scored = inside
    scored[number > 0, : shape.overlap] = False
    return inputs, targets, scored
