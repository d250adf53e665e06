"""A byte-level BPE vocabulary as arrays, with exact encoding by speculation and check.

``BpeModel.encode_pieces`` proposes tokens for each pre-token by greedy longest
match, tests all adjacent token pairs of the whole batch at once for
compatibility, and merges exactly only the pre-tokens in which a pair failed.

Why pairs suffice. Byte-pair merging applies merges in rank order and a merge
makes a token of higher rank than its parts, so the state of a text at any rank
is well defined. A sequence of tokens, each of which is its own encoding, is the
encoding of its bytes exactly when no merge ever crosses a boundary, and whether
one does at a boundary depends only on the two tokens beside it: the right edge of
the left token and the left edge of the right one. ``crossing`` walks both edges
from the whole tokens down to bytes, newest part first, and looks for a merge of
two edge parts that would come before both parts are taken up by their own token.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np

NEVER = np.int64(1 << 40)
#: Pre-tokens up to this many bytes are encoded together in arrays, longer ones singly.
TOGETHER = 48

def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of every byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(tokenizer_json: str) -> list[bytes]:
    """The bytes of every id; a special token's are its string's."""
    spec = json.loads(tokenizer_json)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
    for s, i in spec["model"]["vocab"].items():
        if s not in special:
            out[i] = bytes(alphabet[c] for c in s)
    for s, i in special.items():
        out[i] = s.encode()
    return out


class IntTable:
    """Lookup of many non-negative integer keys at once: open addressing in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        self.steps = 0
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            self.steps += 1
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last stays
            self.values[slot[free]] = values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(1, self.steps):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class BpeModel:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        self.spec = tokenizer_json
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        specials = [t for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in specials):
            raise ValueError("added tokens with strip, word or normalizer rules are not covered")
        self.special = {t["content"]: t["id"] for t in specials}
        self.special_split = re.compile("(" + "|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of = token_bytes(tokenizer_json)
        self.size = len(self.bytes_of)
        id_of = {to_bytes(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.byte_id = [id_of[bytes([b])] for b in range(256)]
        self._merges(model["merges"], to_bytes, id_of)
        self._library = None

    def _merges(self, merges, to_bytes, id_of) -> None:
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ", 1) for m in merges]
        left = np.array([id_of[to_bytes(a)] for a, _ in pairs], np.int64)
        right = np.array([id_of[to_bytes(b)] for _, b in pairs], np.int64)
        made = np.array([id_of[to_bytes(a) + to_bytes(b)] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        # the first merge that makes a token gives its parts; bytes have rank -1
        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for source, target in ((rank, self.rank), (left, self.left), (right, self.right)):
            target[made[::-1]] = source[::-1]
        self.made = made
        self.pairs = IntTable(left * self.size + right, rank)
        self.merges = left, right
        # a token may be proposed only if it is its own encoding
        self.sound = np.zeros(self.size, bool)
        self.sound[self.byte_id] = True
        tops = np.unique(made)
        tops = tops[np.argsort(self.rank[tops])]
        early = self.rank[tops]
        clean = ~self.crossing(self.left[tops], self.right[tops], early)
        for t, ok in zip(tops.tolist(), clean.tolist()):
            self.sound[t] = ok and self.sound[self.left[t]] and self.sound[self.right[t]]
        self._trie()

    def _trie(self) -> None:
        """The proposable tokens as a byte trie: (node, byte) -> node, and the token that ends at a node."""
        step: dict[int, int] = {}
        ends = [-1]
        for token in np.flatnonzero(self.sound).tolist():
            node = 0
            for byte in self.bytes_of[token]:
                node = step.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = token
        self.step = IntTable(np.fromiter(step.keys(), np.int64, len(step)),
                             np.fromiter(step.values(), np.int64, len(step)))
        self.ends = np.array(ends, np.int64)
        self._step_of = self._merge_of = None

    def _rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.get(a * self.size + b)
        return np.where(r < 0, NEVER, r)

    def crossing(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether some merge crosses the boundary between tokens a and b (all pairs at once).

        ``before`` bounds the ranks looked at, for the inner boundary of a token itself.
        A part is open to a crossing merge until its own token takes it up; at equal
        rank the leftmost merge comes first, which is the left token's own.
        """
        out = np.zeros(len(a), bool)
        where = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        open_x = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        open_y = open_x - (before is not None)
        while len(where):
            r = self._rank_of_pair(x, y)
            hit = (r < open_x) & (r <= open_y) & (r < NEVER)
            out[where[hit]] = True
            rx, ry = self.rank[x], self.rank[y]
            on = ~hit & ((rx >= 0) | (ry >= 0))
            where, x, y, open_x, open_y, rx, ry = (v[on] for v in (where, x, y, open_x, open_y, rx, ry))
            down = rx > ry  # of two equal parts the right one was made later
            open_x, open_y = np.where(down, rx, open_x), np.where(down, open_y, ry)
            x, y = np.where(down, self.right[x], x), np.where(down, y, self.left[y])
        return out

    def propose(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Greedy longest match of all pre-tokens buffer[start:end] in lockstep, a byte a step.
        Returns token ids and their owners, in order."""
        owner = np.flatnonzero(start < end)
        at, begun, last = start[owner].astype(np.int64), start[owner].astype(np.int64), end[owner].astype(np.int64)
        node = np.zeros(len(owner), np.int64)
        token, token_end = np.zeros(len(owner), np.int64), at.copy()
        out = []
        while len(owner):
            inside = at < last
            to = np.where(inside, self.step.get(node << 8 | buffer[np.where(inside, at, 0)]), -1)
            on = to >= 0
            node = np.where(on, to, 0)
            at = np.where(on, at + 1, token_end)  # a step on, or back to the end of the longest token
            whole = on & (self.ends[node] >= 0)
            cut = ~on
            out.append((begun[cut], token[cut], owner[cut]))
            begun = np.where(cut, token_end, begun)
            token = np.where(whole, self.ends[node], token)
            token_end = np.where(whole, at, token_end)
            live = ~cut | (begun < last)
            if not live.all():
                owner, at, begun, last, node, token, token_end = (
                    v[live] for v in (owner, at, begun, last, node, token, token_end))
        begun, token, owner = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((begun, owner))
        return token[order], owner[order]

    def merge_together(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Exact merging of many short pre-tokens: each step makes every pre-token's next merge."""
        size = end - start
        owner = np.repeat(np.arange(len(start)), size)
        where = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        ids = np.array(self.byte_id, np.int64)[buffer[where]]
        done = []
        while len(ids):
            inner = np.append(owner[1:] == owner[:-1], False)
            rank = np.full(len(ids), NEVER)
            i = np.flatnonzero(inner)
            rank[i] = self._rank_of_pair(ids[i], ids[i + 1])
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            over = (least == NEVER)[group]
            if over.any():
                done.append((ids[over], owner[over]))
            at = np.flatnonzero(~over & (rank == least[group]))
            at = at[np.append(True, group[at][1:] != group[at][:-1])] if len(at) else at
            ids[at] = self.made[rank[at]]
            stay = ~over
            stay[at + 1] = False
            ids, owner = ids[stay], owner[stay]
        ids, owner = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(2))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def propose_one(self, piece: bytes) -> list[int]:
        """Greedy longest match of one long pre-token."""
        out, at, n = [], 0, len(piece)
        if self._step_of is None:  # only texts with long pre-tokens need it
            held = np.flatnonzero(self.step.keys >= 0)
            self._step_of = dict(zip(self.step.keys[held].tolist(), self.step.values[held].tolist()))
        step, ends = self._step_of, self.ends
        while at < n:
            node, i, token, stop = 0, at, 0, at
            while i < n:
                node = step.get(node << 8 | piece[i], -1)
                if node < 0:
                    break
                i += 1
                if ends[node] >= 0:
                    token, stop = int(ends[node]), i
            out.append(token)
            at = stop
        return out

    def merge_exactly(self, piece: bytes) -> list[int]:
        """Merges of lowest rank first, leftmost first: a heap of live pairs over a linked list."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        if self._merge_of is None:
            left, right = self.merges
            self._merge_of = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), self.made.tolist()))}
        merge_of = self._merge_of
        heap = [(*merge_of[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merge_of]
        heap = [(r, i, made, ids[i], ids[i + 1]) for r, made, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for s in (prior[i], i):
                if s >= 0 and after[s] < n:
                    found = merge_of.get((ids[s], ids[after[s]]))
                    if found:
                        heapq.heappush(heap, (found[0], s, found[1], ids[s], ids[after[s]]))
        return [t for t in ids if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct pre-tokens: all ids in a row, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(size)
        start = end - size
        buffer = np.frombuffer(b"".join(pieces) or b"\0", np.uint8).astype(np.int64)
        short = np.flatnonzero(size <= TOGETHER)
        ids, owner = self.propose(buffer, start[short], end[short])
        owner = short[owner]
        for w in np.flatnonzero(size > TOGETHER).tolist():
            more = self.propose_one(pieces[w])
            ids, owner = np.append(ids, more), np.append(owner, np.full(len(more), w))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        crossed = self.crossing(key // self.size, key % self.size)
        failed = np.unique(owner[inner[crossed[back]]])
        good = ~np.isin(owner, failed)
        found = [(ids[good], owner[good])]
        few = failed[size[failed] <= TOGETHER]
        merged, of = self.merge_together(buffer, start[few], end[few])
        found.append((merged, few[of]))
        for w in failed[size[failed] > TOGETHER].tolist():
            merged = np.array(self.merge_exactly(pieces[w]), np.int64)
            found.append((merged, np.full(len(merged), w)))
        ids, owner = (np.concatenate([f[k] for f in found]) for k in range(2))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(pieces))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of one text without special strings, by the library."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec).pre_tokenizer
        return [text[s:e] for _, (s, e) in self._library.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings; odd places are the special strings themselves."""
        return self.special_split.split(text) if self.special_split else [text]
