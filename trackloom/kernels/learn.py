"""Gradients of the temporal ranking model by back-propagation, in NumPy; computed in the precision of its weights."""

from __future__ import annotations

import numpy as np

from .net import CHANNELS, HIDDEN, PIXELS, logistic


def neighbourhoods(x: np.ndarray) -> np.ndarray:
    """The three by three squares about each pixel, zero border: items, channels, height, width, 3, 3."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))


def largest_of_four(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest of each two by two pixels and which one it is; an odd last row or column is left out."""
    n, c, h, w = x.shape
    four = x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).swapaxes(3, 4).reshape(n, c, h // 2, w // 2, 4)
    at = four.argmax(axis=4)[..., None]
    return np.take_along_axis(four, at, 4)[..., 0], at


def spread(d: np.ndarray, at: np.ndarray, shape: tuple) -> np.ndarray:
    """Gradients of the largest pixels, back at the places where these were."""
    n, c, h, w = shape
    four = np.zeros((*d.shape, 4), d.dtype)
    np.put_along_axis(four, at, d[..., None], 4)
    out = np.zeros(shape, d.dtype)
    out[:, :, : h // 2 * 2, : w // 2 * 2] = four.reshape(n, c, h // 2, w // 2, 2, 2).swapaxes(3, 4).reshape(n, c, h // 2 * 2, w // 2 * 2)
    return out


def encoded(crops: np.ndarray, weights: dict) -> tuple[np.ndarray, list]:
    """Codes of crops, and what the way back needs."""
    x, kept = crops[:, None].astype(weights["conv0.w"].dtype), []
    for i in range(len(CHANNELS) - 1):
        out = np.maximum(np.einsum("nchwij,ocij->nohw", neighbourhoods(x), weights[f"conv{i}.w"], optimize=True) + weights[f"conv{i}.b"][:, None, None], 0)
        half, at = largest_of_four(out) if i < len(CHANNELS) - 2 else (out, None)
        kept.append((x, out, at))
        x = half
    return x.mean(axis=(2, 3)), kept


def encoder_gradient(d: np.ndarray, kept: list, weights: dict, into: dict) -> None:
    """Adds the encoder's share, given the gradient of the codes."""
    h, w = kept[-1][1].shape[2:]
    d = np.broadcast_to((d / (h * w))[:, :, None, None], kept[-1][1].shape)
    for i in reversed(range(len(kept))):
        x, out, at = kept[i]
        d = (d if at is None else spread(d, at, out.shape)) * (out > 0)
        into[f"conv{i}.w"] += np.einsum("nohw,nchwij->ocij", d, neighbourhoods(x), optimize=True)
        into[f"conv{i}.b"] += d.sum(axis=(0, 2, 3))
        if i:
            d = np.einsum("nohwij,ocij->nchw", neighbourhoods(d), weights[f"conv{i}.w"][:, :, ::-1, ::-1], optimize=True)


def unrolled(codes: np.ndarray, lengths: np.ndarray, weights: dict) -> tuple[np.ndarray, list]:
    """States after the last real step of each row of codes (stacks, steps, channels), and what the way back needs."""
    h, kept = np.zeros((len(codes), HIDDEN), codes.dtype), []
    for t in range(codes.shape[1]):
        live = (lengths > t)[:, None]
        ri, zi, ni = np.split(codes[:, t] @ weights["w_in"].T + weights["b_in"], 3, axis=1)
        rs, zs, ns = np.split(h @ weights["w_state"].T + weights["b_state"], 3, axis=1)
        r, z = logistic(ri + rs), logistic(zi + zs)
        n = np.tanh(ni + r * ns)
        kept.append((live, h, r, z, n, ns))
        h = np.where(live, (1 - z) * n + z * h, h)
    return h, kept


def recurrent_gradient(d: np.ndarray, codes: np.ndarray, kept: list, weights: dict, into: dict) -> np.ndarray:
    """Adds the recurrent unit's share, given the gradient of the last states; returns that of the codes."""
    of_codes = np.zeros_like(codes)
    for t in reversed(range(len(kept))):
        live, h, r, z, n, ns = kept[t]
        now = d * live
        dn = now * (1 - z) * (1 - n * n)
        dz, dr = now * (h - n) * z * (1 - z), dn * ns * r * (1 - r)
        of_in, of_state = np.concatenate([dr, dz, dn], axis=1), np.concatenate([dr, dz, dn * r], axis=1)
        into["w_in"] += of_in.T @ codes[:, t]
        into["b_in"] += of_in.sum(axis=0)
        into["w_state"] += of_state.T @ h
        into["b_state"] += of_state.sum(axis=0)
        of_codes[:, t] = of_in @ weights["w_in"]
        d = np.where(live, now * z, d) + of_state @ weights["w_state"]
    return of_codes


def gradient(stacks: list[np.ndarray], lengths: list[int], labels: np.ndarray, counts: np.ndarray, weights: dict, extra: np.ndarray | None = None) -> tuple[dict, float]:
    """Gradient and value of the cross-entropy summed over stacks, each as often as ``counts`` says.

    Stacks go through together while their frames stay within a fixed number of pixels, so memory is bounded.
    """
    kind = weights["w_in"].dtype
    into, loss = {k: np.zeros_like(w) for k, w in weights.items()}, 0.0
    lengths, groups = np.asarray(lengths, np.int64), {}
    for i, s in enumerate(stacks):
        if counts[i]:
            groups.setdefault(s.shape[1:], []).append(i)
    for (h, w), every in groups.items():
        many = max(1, PIXELS // max(1, h * w * int(lengths[every].max(initial=1))))
        for members in (np.asarray(every[k : k + many]) for k in range(0, len(every), many)):
            n = lengths[members]
            owner, step = np.repeat(np.arange(len(members)), n), np.concatenate([np.arange(m) for m in n])
            codes = np.zeros((len(members), n.max(initial=0), CHANNELS[-1]), kind)
            if len(owner):
                codes[owner, step], encoder = encoded(np.concatenate([stacks[i][:m] for i, m in zip(members, n, strict=True)]), weights)
            state, recurrent = unrolled(codes, n, weights)
            features = state if extra is None else np.concatenate([state, extra[members].astype(kind)], axis=1)
            logit, y, count = features @ weights["head.w"] + weights["head.b"][0], labels[members].astype(kind), counts[members].astype(kind)
            loss += float((count * (np.logaddexp(0, logit) - y * logit)).sum())
            d = count * (logistic(logit) - y)
            into["head.w"] += features.T @ d
            into["head.b"] += d.sum()
            of_codes = recurrent_gradient(d[:, None] * weights["head.w"][:HIDDEN], codes, recurrent, weights, into)
            if len(owner):
                encoder_gradient(of_codes[owner, step], encoder, weights, into)
    return into, loss


class Adam:
    """Steps by running moments of the gradient; ``decay`` adds that share of the weights to it."""

    def __init__(self, rate: float, decay: float = 0.0):
        self.rate, self.decay, self.t, self.first, self.second = rate, decay, 0, {}, {}

    def step(self, weights: dict, gradients: dict) -> dict:
        self.t += 1
        out = {}
        for k, w in weights.items():
            g = gradients[k] + self.decay * w
            self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * g * g
            move = (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-8)
            out[k] = (w - self.rate * move).astype(w.dtype)
        return out
