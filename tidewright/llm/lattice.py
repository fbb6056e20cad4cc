"""Scaled forward and backward recursions over many sequences at once, one time step after another."""

from __future__ import annotations

import numpy as np


class Lattice:
    """Sequences of positions, laid out by time: at each step the positions of all sequences that reach it are adjacent.

    `order` puts positions (sequence after sequence) into that layout; `bounds` has where each step begins and ends.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        rank = np.argsort(-lengths, kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        longest = int(lengths.max(initial=0))
        alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        begin = np.r_[0, np.cumsum(alive)].astype(np.int64)
        first = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        self.to = begin[step] + np.repeat(place, lengths)  # the place of each position in the layout
        self.sequence = np.empty(len(self.to), dtype=np.int64)
        self.sequence[self.to] = np.repeat(np.arange(len(lengths)), lengths)
        self.bounds = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))

    def laid_out(self, positions: np.ndarray) -> np.ndarray:
        out = np.empty_like(positions)
        out[self.to] = positions
        return out

    def forward(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered distributions and the scale of each position; the logarithms of a sequence's scales add up to its likelihood's."""
        alpha, scale = emit, np.empty(len(emit), dtype=emit.dtype)
        before = None
        for a, b in self.bounds:
            now = alpha[a:b]
            now *= start if before is None else before[: b - a] @ move
            total = now.sum(axis=1)
            scale[a:b] = total
            now /= total[:, None]
            before = now
        return alpha, scale

    def backward(self, emit: np.ndarray, scale: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Beta of each position, divided by the scales of the later ones."""
        beta = np.ones_like(emit)
        back = move.T
        for (a, b), (c, d) in zip(self.bounds[-2::-1], self.bounds[:0:-1]):
            later = emit[c:d] * beta[c:d]
            later /= scale[c:d, None]
            np.matmul(later, back, out=beta[a : a + d - c])
        return beta

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of the positions' values for each sequence."""
        return np.bincount(self.sequence, weights=values, minlength=len(self.lengths))
