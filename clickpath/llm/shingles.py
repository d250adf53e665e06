"""Sets of word shingles of whole texts, as sorted arrays of 64-bit hashes.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. A set holds
the hashes of all runs of ``k`` words; a text of fewer words has its whole word sequence
as its one shingle, a text without words the empty set.
"""

from __future__ import annotations

import numpy as np

from clickpath.llm.pretokens import SpanHasher, blocks, mix

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


class Shingler:
    def __init__(self, k: int):
        self.k = k
        self.hasher = SpanHasher(11)
        self.factors = np.random.default_rng(12).integers(1, 1 << 63, k + 1, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def word_hashes(self, texts: list[bytes]) -> list[np.ndarray]:
        """Hashes of the words of each text, in order."""
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, parts in blocks([t.lower() for t in texts]):
            data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)  # the blanks part the texts
            space = _IS_SPACE[data]
            start = np.flatnonzero(~space & np.append(True, space[:-1]))
            end = np.flatnonzero(space & np.append(False, ~space[:-1]))
            hashes = self.hasher.spans(data, start, end)
            ends = np.cumsum([len(p) + 1 for p in parts])
            for k, own in zip(numbers, np.split(hashes, np.searchsorted(start, ends[:-1]))):
                got[k].append(own)
        return [np.concatenate(g) if len(g) > 1 else g[0] if g else np.zeros(0, np.uint64) for g in got]

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the runs of k words, repeats included."""
        n = len(words)
        if n >= self.k:
            total = np.zeros(n - self.k + 1, np.uint64)
            for j in range(self.k):
                total += words[j:n - self.k + 1 + j] * self.factors[j]
            return mix(total)
        if n:
            return mix((words * self.factors[:n]).sum(keepdims=True, dtype=np.uint64) + self.factors[self.k:] * np.uint64(n))
        return words

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.unique(self.shingles(w)) for w in self.word_hashes(texts)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())
