"""The two rankers' arithmetic on one block of rows: forward pass and gradients, in numpy.

Weights are a dict of named arrays; a task gets it by broadcast.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]

# fixed values: layer sizes and dropout of the two rankers
N_FEATURES = 8
HIDDEN = 256
EMBEDDING = 128
TOWER_DROPOUT = 0.2
DEEP_DROPOUT = 0.3


def _layers(rng, name: str, sizes: list[int]) -> Weights:
    out = {}
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        edge = 1 / np.sqrt(a)
        out[f"{name}.w{i}"] = rng.uniform(-edge, edge, (a, b))
        out[f"{name}.b{i}"] = rng.uniform(-edge, edge, b)
    return out


def two_tower_weights(seed: int = 0, hidden: int = HIDDEN, embedding: int = EMBEDDING) -> Weights:
    rng = np.random.default_rng(seed)
    sizes = [N_FEATURES, hidden, hidden // 2, embedding]
    return {**_layers(rng, "user", sizes), **_layers(rng, "item", sizes),
            **_layers(rng, "out", [1, 1])}


def wide_deep_weights(seed: int = 0, hidden: int = HIDDEN) -> Weights:
    rng = np.random.default_rng(seed)
    n = 2 * N_FEATURES
    return {**_layers(rng, "wide", [n, 1]), **_layers(rng, "deep", [n, hidden, hidden // 2, 1])}


def mlp(w: Weights, name: str, x: np.ndarray, drop: float = 0.0, rng=None):
    """Output of a stack of layers with ReLU between them, and what its gradient needs."""
    depth = sum(k.startswith(f"{name}.w") for k in w)
    kept = []
    for i in range(depth):
        z = x @ w[f"{name}.w{i}"]
        z += w[f"{name}.b{i}"]
        if i == depth - 1:
            kept.append((x, None, 1.0))
            return z, kept
        gate, scale = z > 0, 1.0
        if rng is not None and drop:
            gate &= rng.kept(z.shape, drop)
            scale = 1 / (1 - drop)
            z *= z.dtype.type(scale)
        kept.append((x, gate, scale))
        z *= gate
        x = z


def mlp_gradient(w: Weights, name: str, kept, d: np.ndarray, into: Weights) -> None:
    for i in reversed(range(len(kept))):
        x, gate, scale = kept[i]
        if gate is not None:
            d *= gate
            if scale != 1.0:
                d *= d.dtype.type(scale)
        into[f"{name}.w{i}"] = x.T @ d
        into[f"{name}.b{i}"] = d.sum(0)
        if i:  # the input itself takes no step
            d = d @ w[f"{name}.w{i}"].T


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def _unit(e: np.ndarray):
    length = np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    return e / length, length


def encode(w: Weights, tower: str, x: np.ndarray) -> np.ndarray:
    """Unit embeddings of the ``user`` or ``item`` tower."""
    return _unit(mlp(w, tower, x)[0])[0]


def two_tower_score(w: Weights, x: np.ndarray) -> np.ndarray:
    """Chance that a user likes an item, from the cosine of their embeddings."""
    cosine = (encode(w, "user", x[:, :N_FEATURES]) * encode(w, "item", x[:, N_FEATURES:])).sum(
        1, keepdims=True)
    return sigmoid(cosine @ w["out.w0"] + w["out.b0"])[:, 0]


def two_tower_step(w: Weights, x: np.ndarray, y: np.ndarray, rng) -> tuple[Weights, float]:
    """Summed gradient and loss of sigmoid(a * cosine(user, item) + b) against 0/1 labels."""
    eu, ku = mlp(w, "user", x[:, :N_FEATURES], TOWER_DROPOUT, rng)
    ei, ki = mlp(w, "item", x[:, N_FEATURES:], TOWER_DROPOUT, rng)
    (nu, lu), (ni, li) = _unit(eu), _unit(ei)
    cosine = (nu * ni).sum(1, keepdims=True)
    p = sigmoid(cosine @ w["out.w0"] + w["out.b0"])
    d = p - y[:, None]
    grad: Weights = {"out.w0": cosine.T @ d, "out.b0": d.sum(0)}
    dc = d @ w["out.w0"].T
    mlp_gradient(w, "user", ku, dc * (ni - cosine * nu) / lu, grad)
    mlp_gradient(w, "item", ki, dc * (nu - cosine * ni) / li, grad)
    return grad, log_loss(p[:, 0], y)


def wide_deep_score(w: Weights, x: np.ndarray) -> np.ndarray:
    return sigmoid(mlp(w, "wide", x)[0] + sigmoid(mlp(w, "deep", x)[0]))[:, 0]


def wide_deep_step(w: Weights, x: np.ndarray, y: np.ndarray, rng) -> tuple[Weights, float]:
    """Summed gradient and loss of sigmoid(linear + sigmoid(deep)) against labels in 0..1."""
    wide, kw = mlp(w, "wide", x)
    deep, kd = mlp(w, "deep", x, DEEP_DROPOUT, rng)
    s = sigmoid(deep)
    p = sigmoid(wide + s)
    d = p - y[:, None]
    grad: Weights = {}
    mlp_gradient(w, "wide", kw, d, grad)
    mlp_gradient(w, "deep", kd, d * s * (1 - s), grad)
    return grad, log_loss(p[:, 0], y)


def flat(w: Weights, names: list[str]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in names])


def unflat(v: np.ndarray, like: Weights, names: list[str]) -> Weights:
    out, at = {}, 0
    for n in names:
        out[n] = v[at:at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out
