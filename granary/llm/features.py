"""Hashed character n-grams of words, and follow-the-regularised-leader over them."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 17


def ngrams(word: str, low: int = 1, high: int = 3) -> list[str]:
    """Character n-grams of a word between marks of its ends, and the word as a whole."""
    w = f"_{word}_"
    out = [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    out.append("=" + word)
    return out


def bucket(gram: str) -> int:
    return xxhash.xxh32_intdigest(gram) & ((1 << BITS) - 1)


class Grams:
    """Buckets of a word's n-grams, kept by word."""

    def __init__(self, low: int = 1, high: int = 3, keep: int = 200_000):
        self.low, self.high, self.keep = low, high, keep
        self.of: dict[str, list[int]] = {}

    def __call__(self, word: str) -> list[int]:
        got = self.of.get(word)
        if got is None:
            got = [bucket(g) for g in ngrams(word, self.low, self.high)]
            if len(self.of) < self.keep:
                self.of[word] = got
        return got


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) with elastic-net penalties, for several outputs."""

    def __init__(self, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, bits: int = BITS):
        self.z = np.zeros((1 << bits, outputs))
        self.n = np.zeros((1 << bits, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, idx: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step with the weights w at idx and the gradient g (distinct idx)."""
        n = self.n[idx]
        n2 = n + g * g
        self.z[idx] += g - (np.sqrt(n2) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n2


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of held-out logits that makes their confidence fit best (least log loss), searched on a grid."""
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
