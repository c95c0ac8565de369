"""Inference of the temporal ranking model: convolutional encoder, recurrent unit over the true length, linear head."""

from __future__ import annotations

import numpy as np

CHANNELS, HIDDEN = (1, 16, 32, 64), 64


def seeded_weights(seed: int = 0, extra: int = 0) -> dict[str, np.ndarray]:
    """Deterministic weights of the model's shapes, for want of trained ones."""
    rng = np.random.default_rng(seed)
    out = {}
    for i, (a, b) in enumerate(zip(CHANNELS, CHANNELS[1:], strict=False)):
        out[f"conv{i}.w"] = rng.normal(0, (2 / (9 * a)) ** 0.5, (b, a, 3, 3)).astype(np.float32)
        out[f"conv{i}.b"] = np.zeros(b, np.float32)
    bound = HIDDEN**-0.5
    for name, shape in (("w_in", (3 * HIDDEN, CHANNELS[-1])), ("w_state", (3 * HIDDEN, HIDDEN)), ("b_in", 3 * HIDDEN), ("b_state", 3 * HIDDEN), ("head.w", HIDDEN + extra), ("head.b", 1)):
        out[name] = rng.uniform(-bound, bound, shape).astype(np.float32)
    return out


def known(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The model's weights among a checkpoint's arrays, others left out; one that is missing or has another shape is an error."""
    shapes = {k: v.shape for k, v in seeded_weights().items()}
    for name, shape in shapes.items():
        got = arrays[name].shape if name in arrays else None
        if got != shape and not (name == "head.w" and got is not None and len(got) == 1 and got[0] > shape[0]):
            raise ValueError(f"weight {name} is {got}, not {shape}")
    return {name: np.asarray(arrays[name], np.float32) for name in shapes}


def parameters(weights: dict[str, np.ndarray]) -> int:
    return sum(w.size for w in weights.values())


def convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Three by three, zero border, rectified; x: items, channels, height, width."""
    views = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))
    return np.maximum(np.einsum("nchwij,ocij->nohw", views, w, optimize=True) + b[:, None, None], 0)


def halve(x: np.ndarray) -> np.ndarray:
    n, c, h, w = x.shape
    return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).max(axis=(3, 5))


def encode(crops: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    x = crops[:, None].astype(np.float32)
    for i in range(3):
        x = convolve(x, weights[f"conv{i}.w"], weights[f"conv{i}.b"])
        x = halve(x) if i < 2 else x
    return x.mean(axis=(2, 3))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def recur(steps: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """State after the last real step."""
    h = np.zeros(HIDDEN, np.float32)
    for x in steps:
        ri, zi, ni = np.split(weights["w_in"] @ x + weights["b_in"], 3)
        rs, zs, ns = np.split(weights["w_state"] @ h + weights["b_state"], 3)
        z = logistic(zi + zs)
        h = (1 - z) * np.tanh(ni + logistic(ri + rs) * ns) + z * h
    return h


#: Pixels that the encoder takes at once; its largest intermediate holds some 36 numbers for each.
PIXELS = 1 << 16


def states(stacks: list[np.ndarray], lengths: list[int], weights: dict[str, np.ndarray]) -> np.ndarray:
    """The state of each stack after its last real step: stacks x HIDDEN.

    Real frames of all stacks of one size are encoded together. The recurrent unit takes a step of all stacks at once;
    these are in order of length, so those that are over fall off at the end.
    """
    lengths = np.asarray(lengths, np.int64)
    codes = np.zeros((len(stacks), lengths.max(initial=0), CHANNELS[-1]), np.float32)
    owner, step = np.repeat(np.arange(len(stacks)), lengths), np.concatenate([np.arange(n) for n in [*lengths, 0]])
    of_size: dict[tuple, list[int]] = {}
    for i, stack in enumerate(stacks):
        of_size.setdefault(stack.shape[1:], []).append(i)
    for shape, members in of_size.items():
        at = np.flatnonzero(np.isin(owner, members))
        many = max(1, PIXELS // max(1, shape[0] * shape[1]))
        for k in range(0, len(at), many):
            now = at[k : k + many]
            codes[owner[now], step[now]] = encode(np.stack([stacks[i][t] for i, t in zip(owner[now], step[now], strict=True)]), weights)
    order = np.argsort(-lengths, kind="stable")
    h = np.zeros((len(stacks), HIDDEN), np.float32)
    for t in range(codes.shape[1]):
        live = order[: int((lengths > t).sum())]
        ri, zi, ni = np.split(codes[live, t] @ weights["w_in"].T + weights["b_in"], 3, axis=1)
        rs, zs, ns = np.split(h[live] @ weights["w_state"].T + weights["b_state"], 3, axis=1)
        z = logistic(zi + zs)
        h[live] = (1 - z) * np.tanh(ni + logistic(ri + rs) * ns) + z * h[live]
    return h


def score_many(stacks: list[np.ndarray], lengths: list[int], weights: dict[str, np.ndarray], extra: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of padded stacks; ``extra`` are the tracks' features, a row each, for a model that takes them."""
    state = states(stacks, lengths, weights)
    if len(weights["head.w"]) > HIDDEN:
        if extra is None:
            raise ValueError("this model needs features")
        state = np.concatenate([state, extra], axis=1)
    return logistic((state @ weights["head.w"] + weights["head.b"][0]).astype(np.float64))


def score(stack: np.ndarray, length: int, weights: dict[str, np.ndarray], extra: np.ndarray | None = None) -> float:
    """Probability of a padded stack; ``extra`` are the track's features for a model that takes them."""
    state = recur(encode(stack[:length], weights), weights)
    if len(weights["head.w"]) > HIDDEN:
        if extra is None:
            raise ValueError("this model needs features")
        state = np.concatenate([state, extra])
    return float(logistic(state @ weights["head.w"] + weights["head.b"][0]))
