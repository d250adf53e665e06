"""Pre-tokens of whole texts as arrays, and tables of what is known about them.

The split pattern of the byte-level vocabularies is, in order of preference:
contractions ('s 't 're 've 'm 'll 'd), letters, digits or other characters each
with one optional space before, white space up to the last before a word, white
space. ``split_batch`` finds its boundaries for a block of texts at once from the
class of each character and of its neighbours, and gives every pre-token a 64-bit
hash of its bytes, so that no Python object is made for a pre-token.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Bytes of text taken at once; longer texts are cut where a space follows an ASCII letter,
#: which is always a boundary.
BLOCK_BYTES = 1 << 20
_CUT = re.compile(rb"[A-Za-z] ")

LETTER, DIGIT, OTHER, SPACE, ODD = range(5)
#: The characters of Unicode's property White_Space.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """Class of every code point. ODD ones are unassigned in this interpreter's Unicode table, so
    libraries with other tables may class them differently; texts with one go through the library."""
    by_category = {"L": LETTER, "N": DIGIT}
    category = unicodedata.category
    out = np.array([ODD if (c := category(chr(i))) == "Cn" else by_category.get(c[0], OTHER)
                    for i in range(0x110000)], np.uint8)
    out[_SPACES] = SPACE
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class SpanHasher:
    """64-bit hashes of many spans of a byte buffer from running sums: each byte's random
    value times a power of an odd base, summed modulo 2^64 and shifted back by the span's start."""

    BASE = 0x9FB21C651E98DF25

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers), 1 << 16)
            back = pow(self.BASE, -1, 1 << 64)
            powers = lambda base: np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)
            self.powers, self.inverse = powers(self.BASE), powers(back)

    def spans(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(buffer) + 1)
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(self.values[buffer] * self.powers[:len(buffer)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Splitter:
    def __init__(self):
        self.classes = character_classes()
        self.hasher = SpanHasher()

    def boundaries(self, code: np.ndarray, first: np.ndarray) -> np.ndarray | None:
        """Whether a pre-token starts at each character; ``first``: a text starts there.
        None if some character is ODD."""
        kind = self.classes[code]
        if (kind == ODD).any():
            return None
        n = len(code)
        last = np.append(first[1:], True)  # a text ends with this character
        before = np.append(np.uint8(ODD), kind[:-1])
        before[first] = ODD
        after = np.append(kind[1:], np.uint8(ODD))
        after[last] = ODD
        space = kind == SPACE
        # the last white space before a word, if it is a plain one, belongs to the word
        joins = space & (code == 32) & (after <= OTHER)
        start = first | (kind != before)
        start[1:] &= ~joins[:-1] | first[1:]
        start |= space & (after <= OTHER)  # it or any other white space there stands apart
        # contractions: an apostrophe that starts a pre-token of its own
        quote = np.flatnonzero((code == 39) & start & (after == LETTER))
        if len(quote):
            at = lambda k: code[np.minimum(quote + k, n - 1)]
            one, two = at(1), at(2)
            short = np.isin(one, [ord(c) for c in "stmd"])
            room = ~last[np.minimum(quote + 1, n - 1)]
            long = room & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
                           | (one == ord("l")) & (two == ord("l")))
            size = np.where(short, 2, np.where(long, 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            ends = quote + size
            ends = ends[ends < n]
            start[ends] = True
        return start

    def split_block(self, data: bytes, starts: np.ndarray):
        """(start, end, hash, text number) of the pre-tokens of the texts that start at the given
        bytes of a block; None if a character is ODD."""
        buffer = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((buffer & 0xC0) != 0x80)
        code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(code), bool)
        filled = starts[starts < len(buffer)]
        first[np.searchsorted(lead, filled)] = True
        begins = self.boundaries(code, first)
        if begins is None:
            return None
        start = lead[begins]
        end = np.append(start[1:], len(buffer))
        owner = np.searchsorted(starts, start, side="right") - 1
        return start, end, self.hasher.spans(buffer, start, end), owner


def blocks(texts: list[bytes]):
    """Texts grouped into blocks of about BLOCK_BYTES: (list of text numbers, list of byte strings)."""
    numbers, parts, size = [], [], 0
    for k, t in enumerate(texts):
        while len(t) > BLOCK_BYTES:
            cut = _CUT.search(t, BLOCK_BYTES)
            if not cut:
                break
            yield [k], [t[:cut.end() - 1]]
            t = t[cut.end() - 1:]
        if size and size + len(t) > BLOCK_BYTES:
            yield numbers, parts
            numbers, parts, size = [], [], 0
        numbers.append(k)
        parts.append(t)
        size += len(t)
    if numbers:
        yield numbers, parts


class PieceTable:
    """What is known of pre-tokens by their hash: a sorted array of hashes and a slice of values each."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.start = self.size = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of sorted hashes, -1 where unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
        """New sorted hashes with their values; the table starts anew when it is full."""
        if len(self.hashes) + len(hashes) > self.most:
            self.clear()
        if len(hashes) > self.most:
            return
        at = np.searchsorted(self.hashes, hashes)
        start = np.cumsum(size) - size + len(self.values)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.values = np.append(self.values, values.astype(np.int32))


def slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of all the slices in a row."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
