"""Character Markov models for short strings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

START = "\x02"


@dataclass
class FixedOrder:
    """Log-probability of each next character after the two before it; unknown characters share a class."""

    alphabet: dict[str, int]
    table: np.ndarray

    def score(self, text: str) -> float:
        """Sum of the log-probabilities of a string's characters."""
        other = len(self.alphabet)
        codes = np.fromiter((self.alphabet.get(c, other) for c in START * 2 + text), np.int64, len(text) + 2)
        return float(self.table[codes[:-2], codes[1:-1], codes[2:]].sum())


def fixed_order(counts: Iterable[tuple[str, str, str, int]], alphabet: str, smooth: float = 0.2, weight: float = 4.0) -> FixedOrder:
    """Second-order model from (a, b, c, n) rows: c followed a and b n times.

    Each order leans on the one below it with ``weight`` imagined sightings.
    """
    codes = {c: i for i, c in enumerate(START + alphabet)}
    other = len(codes)
    seen = np.zeros((other + 1,) * 3)
    for a, b, c, n in counts:
        seen[codes.get(a, other), codes.get(b, other), codes.get(c, other)] += n
    one = seen.sum(axis=(0, 1)) + smooth
    one /= one.sum()
    two = seen.sum(axis=0)
    two = (two + weight * one) / (two.sum(axis=1, keepdims=True) + weight)
    return FixedOrder(codes, np.log((seen + weight * two[None]) / (seen.sum(axis=2, keepdims=True) + weight)))


@dataclass
class VariableOrder:
    """Contexts of every length up to ``order``, each blended with the next shorter one.

    A context seen c times with t different next characters hands t / (c + t) of its say to the
    next shorter one (Witten-Bell); below the empty context all characters are alike.
    """

    order: int
    size: int
    contexts: dict[str, tuple[int, dict[str, int]]]

    def chance(self, context: str, char: str) -> float:
        found = 1.0 / self.size
        for n in range(min(self.order, len(context)) + 1):
            seen = self.contexts.get(context[len(context) - n:])
            if seen is None:
                break
            total, following = seen
            kinds = len(following)
            found = (following.get(char, 0) + kinds * found) / (total + kinds)
        return found

    def score(self, text: str) -> float:
        padded = START * self.order + text
        return float(sum(np.log(self.chance(padded[i - self.order:i], padded[i])) for i in range(self.order, len(padded))))


def variable_order(counts: Iterable[tuple[str, str, int]], order: int, size: int = 128) -> VariableOrder:
    """Model from (context, next character, n) rows."""
    contexts: dict[str, tuple[int, dict[str, int]]] = {}
    for context, char, n in counts:
        total, following = contexts.get(context, (0, {}))
        following[char] = following.get(char, 0) + n
        contexts[context] = (total + n, following)
    return VariableOrder(order, size, contexts)
