"""A small decoder-only transformer: forward passes, masked loss, generation and evaluation.

For scoring tables of examples with given weights; training is out of scope.
The arrays are numpy's, a batch is an Arrow batch of examples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.sequences import SplitMix

_erf = np.vectorize(math.erf, otypes=[np.float64])


@dataclass(frozen=True)
class Config:
    vocabulary: int
    context: int
    width: int
    heads: int
    layers: int
    feed_forward: int

    def __post_init__(self):
        if any(type(x) is not int or x <= 0 for x in vars(self).values()):
            raise ValueError("sizes must be positive whole numbers")
        if self.width % self.heads:
            raise ValueError("the heads must share the width evenly")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Every weight's shape, by name."""
        w, f = self.width, self.feed_forward
        out = {"tokens": (self.vocabulary, w), "positions": (self.context, w), "norm.scale": (w,), "norm.shift": (w,), "head": (w, self.vocabulary)}
        for i in range(self.layers):
            for norm in ("first", "second"):
                out |= {f"{i}.{norm}.scale": (w,), f"{i}.{norm}.shift": (w,)}
            for name, a, b in (("query", w, w), ("key", w, w), ("value", w, w), ("output", w, w), ("in", w, f), ("out", f, w)):
                out |= {f"{i}.{name}": (a, b), f"{i}.{name}.bias": (b,)}
        return out


class Model:
    """Weights by name. Pre-norm blocks, learned positions, exact GELU."""

    def __init__(self, config: Config, weights: dict[str, np.ndarray]):
        wanted = config.shapes()
        if weights.keys() != wanted.keys() or any(weights[k].shape != s for k, s in wanted.items()):
            raise ValueError("weights don't have the names and shapes of the configuration")
        self.config, self.weights = config, {k: v.astype(np.float64) for k, v in weights.items()}

    @classmethod
    def fresh(cls, config: Config, seed: int) -> Model:
        """Normal weights of deviation 0.02; norms start as the identity, biases at 0."""
        rng = np.random.default_rng(seed)
        made = {k: np.ones(s) if k.endswith("scale") else np.zeros(s) if k.endswith(("shift", "bias")) else rng.normal(0, 0.02, s) for k, s in config.shapes().items()}
        return cls(config, made)

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * self.weights[name + ".scale"] + self.weights[name + ".shift"]

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[name] + self.weights[name + ".bias"]

    def forward(self, ids: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
        """Logits (batch, sequence, vocabulary). valid: true for a prefix of each row, not empty; padding is attended by nothing and has logits of 0."""
        c, (n, length) = self.config, ids.shape
        if not n or not 0 < length <= c.context:
            raise ValueError("a batch needs rows, and 1 to context positions")
        if ids.min() < 0 or ids.max() >= c.vocabulary:
            raise ValueError("an id is outside the vocabulary")
        hidden = np.triu(np.ones((length, length), bool), 1)[None, None]
        if valid is not None:
            if valid.shape != ids.shape or not valid[:, 0].all() or (valid[:, 1:] & ~valid[:, :-1]).any():
                raise ValueError("each row is valid in a prefix that isn't empty")
            hidden = hidden | ~valid[:, None, None, :]
        x = self.weights["tokens"][ids] + self.weights["positions"][:length]

        def split(y: np.ndarray) -> np.ndarray:
            return y.reshape(n, length, c.heads, -1).swapaxes(1, 2)

        for i in range(c.layers):
            y = self._norm(x, f"{i}.first")
            q, k, v = (split(self._linear(y, f"{i}.{name}")) for name in ("query", "key", "value"))
            scores = np.where(hidden, -np.inf, q @ k.swapaxes(2, 3) / math.sqrt(c.width // c.heads))
            scores = np.exp(scores - scores.max(-1, keepdims=True))
            seen = (scores / scores.sum(-1, keepdims=True)) @ v
            x = x + self._linear(seen.swapaxes(1, 2).reshape(n, length, -1), f"{i}.output")
            y = self._linear(self._norm(x, f"{i}.second"), f"{i}.in")
            x = x + self._linear(y * 0.5 * (1 + _erf(y / math.sqrt(2))), f"{i}.out")
        logits = self._norm(x, "norm") @ self.weights["head"]
        if not np.isfinite(logits).all():
            raise ValueError("logits aren't finite")
        return logits if valid is None else np.where(valid[:, :, None], logits, 0.0)


def masked_losses(logits: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the summed loss of its valid targets, and how many they are; none at all is an error."""
    if not valid.any():
        raise ValueError("no valid target")
    at = np.where(valid, targets, 0)
    if at.min() < 0 or at.max() >= logits.shape[-1]:
        raise ValueError("a valid target is outside the vocabulary")
    top = logits.max(-1, keepdims=True)
    loss = np.log(np.exp(logits - top).sum(-1)) + top[..., 0] - np.take_along_axis(logits, at[..., None], -1)[..., 0]
    return np.where(valid, loss, 0.0).sum(1), valid.sum(1)


def shares(logits: np.ndarray, temperature: float = 1.0, top_k: int | None = None, top_p: float = 1.0) -> list[tuple[int, float]]:
    """(id, share) of the top_k likeliest, of those the fewest that reach top_p; ties go to smaller ids."""
    if temperature <= 0 or not 0 < top_p <= 1 or (top_k is not None and top_k < 1):
        raise ValueError("temperature and top_k must be positive, top_p in (0, 1]")
    w = np.exp((logits - logits.max()) / temperature)
    order = np.lexsort((np.arange(len(w)), -w))[:top_k]
    w = w[order] / w[order].sum()
    n = min(len(w), int(np.searchsorted(np.cumsum(w), top_p)) + 1)
    return list(zip(order[:n].tolist(), (w[:n] / w[:n].sum()).tolist(), strict=True))


def drawn(found: list[tuple[int, float]], at: float) -> int:
    """The id whose stretch of the cumulative shares holds `at`; the last that has any if rounding leaves none."""
    total = 0.0
    for i, p in found:
        total += p
        if at < total:
            return i
    return max((k, i) for k, (i, p) in enumerate(found) if p > 0)[1]


def generate(model: Model, prompt: list[int], new: int, end: int | None = None, *, seed: int | None = None, temperature: float = 1.0, top_k: int | None = None, top_p: float = 1.0) -> list[int]:
    """The prompt and up to `new` ids, the end id included; greedy without a seed. All must fit the context from the start."""
    if not prompt or len(prompt) + new > model.config.context:
        raise ValueError("the prompt and what is to come must fit the context")
    rng, out = SplitMix(seed or 0), list(prompt)
    for _ in range(new):
        logits = model.forward(np.array([out]))[0, -1]
        out.append(int(logits.argmax()) if seed is None else drawn(shares(logits, temperature, top_k, top_p), (rng.next() >> 11) / 2**53))
        if out[-1] == end:
            break
    return out


def evaluate(examples: DataFrame, model: Model, batch: int = 16) -> DataFrame:
    """(targets, mean_loss, perplexity) of examples (ids, and mask of its targets if there is one), in batches padded to their longest."""
    examples = examples if "mask" in examples.columns else examples.withColumn("mask", F.lit(None).cast("array<boolean>"))

    def losses(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for i in range(0, len(t), batch):
                ids, masks = (t[c].iloc[i : i + batch].tolist() for c in ("ids", "mask"))
                width = max(map(len, ids)) - 1
                valid = np.array([[k < len(x) - 1 for k in range(width)] for x in ids])
                padded = np.array([[*x, *[0] * (width + 1 - len(x))] for x in ids])
                wanted = valid & np.array([[True] * width if m is None else [*m, *[False] * (width - len(m))] for m in masks])
                loss, n = masked_losses(model.forward(padded[:, :-1], valid), padded[:, 1:], wanted)
                yield pd.DataFrame({"loss": loss, "targets": n})

    total = examples.select("ids", "mask").mapInPandas(losses, "loss double, targets long")
    total = total.agg(F.sum("targets").alias("targets"), (F.sum("loss") / F.sum("targets")).alias("mean_loss"))
    return total.select("targets", "mean_loss", F.exp("mean_loss").alias("perplexity"))
