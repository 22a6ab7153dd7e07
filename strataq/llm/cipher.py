"""Learning an unknown substitution cipher by expectation-maximisation against language bigrams.

What is known: how often symbols follow each other in the enciphered text, and how often letters do in the language
(letters of an alphabet, or the bytes of an encoding). Hidden: which letter each symbol stands for. E-step: the
posterior of letter pairs for each symbol pair; M-step: how each letter shows. Both use pair counts alone, whose
number is bounded by the symbols, however long the text is.
"""

from __future__ import annotations

import numpy as np


def smoothed(bigrams: np.ndarray) -> np.ndarray:
    """Joint probabilities of letter pairs, none of them zero."""
    p = bigrams + 0.02 * max(1.0, bigrams.sum()) / bigrams.size
    return p / p.sum()


def learn(pairs: np.ndarray, bigrams: np.ndarray, pinned: np.ndarray | None = None, reserved: int = 0, start: np.ndarray | None = None, weight: float = 0.0, rounds: int = 80, restarts: int = 6) -> tuple[np.ndarray, float]:
    """(posterior, letters x symbols, columns sum to 1; mean log-likelihood of a pair).

    pairs: symbols x symbols counts; bigrams: letters x letters counts; pinned: the letter of each symbol that is known,
    -1 for the others; reserved: the first letters that only pinned symbols stand for; start: a first guess (letters x symbols), which makes one run from there instead of restarts and
    counts as `weight` observations a symbol.
    """
    n, k = pairs.shape[0], bigrams.shape[0]
    p = smoothed(bigrams)
    letter = p.sum(1) / p.sum()
    shown = (pairs.sum(0) + pairs.sum(1)).astype(float)
    pinned = np.full(n, -1) if pinned is None else pinned
    free, held = np.flatnonzero(pinned < 0), np.flatnonzero(pinned >= 0)
    taken = np.zeros(k, dtype=bool)
    taken[pinned[held]] = True
    taken[:reserved] = True

    def pin(b: np.ndarray) -> np.ndarray:
        b[:, held] = 0
        b[pinned[held], held] = 1
        b[np.ix_(taken, free)] = 0
        return b

    best: tuple[np.ndarray, float] = (np.zeros((k, n)), -np.inf)
    for r in range(1 if start is not None else restarts):
        rng = np.random.default_rng(r)
        if start is not None:
            b = start + 1e-4
        else:
            # Frequent symbols start with frequent letters, more or less strictly; those that are pinned aside.
            rank = lambda x: np.argsort(np.argsort(-x)) / max(1, len(x))
            near = np.zeros((k, n))
            near[np.ix_(~taken, free)] = np.exp(-np.abs(rank(letter[~taken])[:, None] - rank(shown[free])[None, :]) * (4 + 4 * (r % 3)))
            b = near * (1 + 0.3 * rng.random((k, n)))
        b = pin(b / np.maximum(b.sum(1, keepdims=True), 1e-300))
        fit = -np.inf
        for t in range(rounds):
            sharp = 1.0 if start is not None else min(1.0, 0.4 + 0.6 * t / (0.6 * rounds))  # from flat to exact posteriors
            bs = b**sharp
            w = pairs / np.maximum(bs.T @ p @ bs, 1e-300)  # symbols x symbols
            # expected counts of (letter, symbol), as first and as second of a pair
            b = bs * (p @ bs @ w.T) + bs * (p.T @ bs @ w) + 1e-9
            if start is not None:
                b += weight * start
            b = pin(b / b.sum(1, keepdims=True))
            fit = float((pairs * np.log(np.maximum(b.T @ p @ b, 1e-300))).sum() / max(1, pairs.sum()))
        if fit > best[1]:
            joint = b * letter[:, None]
            best = (joint / np.maximum(joint.sum(0), 1e-300), fit)
    return best

