"""A small bidirectional gated recurrent network with attention pooling, in numpy: forward, gradients, Adam.

Inputs of a step are a word vector and the mean of the vectors of the word's hashed character n-grams. Both directions
run in one batched product. States of padded steps are carried over and get no attention.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8


def new_parameters(words: int, grams: int, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    h, d = HIDDEN, WORD_DIM + CHAR_DIM
    return {
        "word": n(words, WORD_DIM, scale=0.1), "char": n(grams, CHAR_DIM, scale=0.3),
        "wx": n(d, 2, 3 * h, scale=d**-0.5), "wh": n(2, h, 3 * h, scale=h**-0.5), "b": np.zeros((2, 3 * h), np.float32),
        "wa": n(2 * h, ATTEND, scale=(2 * h) ** -0.5), "ba": np.zeros(ATTEND, np.float32), "va": n(ATTEND, scale=ATTEND**-0.5),
        "wo": n(2 * h, scale=(2 * h) ** -0.5), "bo": np.zeros(1, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(p: dict, projected: tuple, index: np.ndarray, mask: np.ndarray, keep: list) -> np.ndarray:
    """Outputs (steps, windows, 2 * HIDDEN) of both directions; projected has a row of 3 * HIDDEN for each word, by direction."""
    size, steps = index.shape
    h = np.zeros((2, size, HIDDEN), np.float32)
    out = np.empty((steps, size, 2 * HIDDEN), np.float32)
    x = np.empty((2, size, 3 * HIDDEN), np.float32)
    for t in range(steps):
        back = steps - 1 - t
        x[0], x[1] = projected[0][index[:, t]], projected[1][index[:, back]]
        g = h @ p["wh"]
        gates = _sigmoid(x[..., : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
        z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
        new = np.tanh(x[..., 2 * HIDDEN :] + r * g[..., 2 * HIDDEN :])
        now = new + z * (h - new)
        m = np.stack((mask[:, t], mask[:, back]))[..., None]
        now = h + m * (now - h)
        keep.append((h, z, r, new, g[..., 2 * HIDDEN :], m))
        h = now
        out[t, :, :HIDDEN], out[back, :, HIDDEN:] = h[0], h[1]
    return out


def project(p: dict, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The input part of all gates for each word vector, by direction."""
    x = np.einsum("nd,dkh->knh", vectors, p["wx"], optimize=True) + p["b"][:, None, :]
    return np.ascontiguousarray(x[0]), np.ascontiguousarray(x[1])


def _infer(p: dict, projected: tuple, index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """The outputs of _run, without anything kept for gradients and with its buffers reused."""
    size, steps = index.shape
    h2 = 2 * HIDDEN
    out = np.empty((steps, size, h2), np.float32)
    turned = np.ascontiguousarray(index.T)
    gates, gate_in = np.empty((size, h2), np.float32), np.empty((size, h2), np.float32)
    new, new_in = np.empty((size, HIDDEN), np.float32), np.empty((size, HIDDEN), np.float32)
    for k in range(2):
        # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: the halving goes into the inputs
        of_gates, of_new = projected[k][:, :h2] * np.float32(0.5), np.ascontiguousarray(projected[k][:, h2:])
        w_gates, w_new = p["wh"][k][:, :h2] * np.float32(0.5), np.ascontiguousarray(p["wh"][k][:, h2:])
        h = np.zeros((size, HIDDEN), np.float32)
        for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
            at = turned[t]
            np.take(of_gates, at, axis=0, out=gates, mode="clip")
            np.matmul(h, w_gates, out=gate_in)
            gates += gate_in
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.take(of_new, at, axis=0, out=new, mode="clip")
            np.matmul(h, w_new, out=new_in)
            new_in *= gates[:, HIDDEN:]
            new += new_in
            np.tanh(new, out=new)
            if mask is None:
                h -= new
                h *= gates[:, :HIDDEN]
                h += new
            else:
                h += mask[:, t, None] * ((1 - gates[:, :HIDDEN]) * (new - h))
            out[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
    return out


def logits(p: dict, projected: tuple, index: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """The logit of each window; index (windows, steps) numbers words, mask has 0 for padding."""
    out = _infer(p, projected, index, mask)
    a = np.tanh(out @ p["wa"] + p["ba"]) @ p["va"]
    if mask is not None:
        a = np.where(mask.T > 0, a, -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    return np.einsum("tb,tbh,h->b", a, out, p["wo"], optimize=True) + p["bo"][0]


def gradients(p: dict, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean weighted cross-entropy, gradients of the shared parameters, and of the word vectors."""
    h = HIDDEN
    keep: list = []
    out = _run(p, project(p, vectors), index, mask, keep)
    u = np.tanh(out @ p["wa"] + p["ba"])
    a = np.where(mask.T > 0, u @ p["va"], -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, out)
    logit = pooled @ p["wo"] + p["bo"][0]
    prob = _sigmoid(logit)
    loss = float((weights * (np.logaddexp(0, logit) - labels * logit)).mean())
    d = (weights * (prob - labels) / len(labels)).astype(np.float32)
    grad = {"wo": pooled.T @ d, "bo": np.array([d.sum()], np.float32)}
    dpooled = d[:, None] * p["wo"]
    dout = a[..., None] * dpooled
    da = np.einsum("tbh,bh->tb", out, dpooled)
    ds = a * (da - (a * da).sum(axis=0))
    grad["va"] = np.einsum("tb,tbk->k", ds, u)
    du = ds[..., None] * p["va"] * (1 - u * u)
    grad["wa"] = np.einsum("tbh,tbk->hk", out, du, optimize=True)
    grad["ba"] = du.sum(axis=(0, 1))
    dout += du @ p["wa"].T
    steps = index.shape[1]
    dh = np.zeros_like(keep[0][0])
    dwh = np.zeros_like(p["wh"])
    dproj = np.zeros((2, len(vectors), 3 * h), np.float32)
    for t in reversed(range(steps)):
        back = steps - 1 - t
        before, z, r, new, gn, m = keep[t]
        dh = dh + np.stack((dout[t, :, :h], dout[back, :, h:]))
        dnow = dh * m
        dprev = dh * (1 - m) + dnow * z
        dz = dnow * (before - new) * z * (1 - z)
        dn = dnow * (1 - z) * (1 - new * new)
        dr = dn * gn * r * (1 - r)
        dg = np.concatenate((dz, dr, dn * r), axis=2)
        dx = np.concatenate((dz, dr, dn), axis=2)
        dwh += before.transpose(0, 2, 1) @ dg
        dh = dprev + dg @ p["wh"].transpose(0, 2, 1)
        np.add.at(dproj[0], index[:, t], dx[0])
        np.add.at(dproj[1], index[:, back], dx[1])
    grad["wh"] = dwh
    grad["b"] = dproj.sum(axis=1)
    grad["wx"] = np.einsum("nd,knh->dkh", vectors, dproj, optimize=True)
    return loss, grad, np.einsum("knh,dkh->nd", dproj, p["wx"], optimize=True)


class Adam:
    def __init__(self, p: dict, rate: float = 0.01):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: dict, grad: dict) -> None:
        self.step += 1
        rate = self.rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)
