"""What a task remembers of the words that it has seen."""

from __future__ import annotations

import numpy as np


class WordIds(dict):
    """Numbers for words in the order in which they first come; ``new`` has those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Table:
    """Arrays of whole numbers by number, in one growing array."""

    def __init__(self) -> None:
        self.flat, self.start, self.many = np.zeros(1 << 16, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        at = int(self.start[self.many])
        while len(self.flat) < at + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < self.many + len(sizes) + 1:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[at : at + len(flat)] = flat
        self.start[self.many + 1 : self.many + len(sizes) + 1] = at + np.cumsum(sizes)
        self.many += len(sizes)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays with these numbers one after the other, and their sizes."""
        first = self.start[key]
        sizes = self.start[key + 1] - first
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes
