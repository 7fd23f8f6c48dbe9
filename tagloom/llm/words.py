"""Sums over the words of a text, with what belongs to each distinct word kept by the worker."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import regex

#: Letters of any script, in a row; the quick pattern also takes numerals such as fractions, which are rare.
LETTERS, QUICK = regex.compile(r"\p{L}+"), re.compile(r"[^\W\d_]+")
#: Words a worker keeps; it starts anew beyond that.
KEEP = 250_000


def words_of(text: str) -> list[str]:
    found = QUICK.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [x for w in found for x in LETTERS.findall(w)]


def grams(word: str, least: int, most: int) -> list[str]:
    """Character n-grams of the word between its boundary signs."""
    w = f"<{word}>"
    return [w[i : i + n] for n in range(least, most + 1) for i in range(len(w) - n + 1)]


class WordTable:
    """Rows of numbers for words, made once a word by `row` and kept."""

    def __init__(self, row: Callable[[str], np.ndarray], width: int):
        self.row, self.width = row, width
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words, for use until the next call."""
        index = self.index
        found = list(map(index.get, words))
        if None in found:
            if len(index) > KEEP:
                self.clear()
                index = self.index
            for w in words:
                if w not in index:
                    n = index[w] = len(index)
                    if n == len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[n] = self.row(w)
            found = list(map(index.__getitem__, words))
        return np.array(found, np.int64)

    def sums(self, words: list[str]) -> np.ndarray:
        """Sum of the rows of all words, repeated ones as often as they stand there."""
        if not words:
            return np.zeros(self.width)
        counts = Counter(words)
        ids = self.ids(list(counts))
        return np.fromiter(counts.values(), float, len(counts)) @ self.rows[ids]
