"""Byte-level BPE: splitting texts into pre-tokens, and two ways to encode these.

``MergeTable.count`` merges many pre-tokens at once in ragged numpy arrays, rank by rank;
``IdCache`` gives the ids of single pre-tokens and remembers them.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import regex

# The pre-token pattern of the vocabulary, with white space spelled out as
# Unicode defines it, once for any text and once for texts of ASCII and Latin letters alone.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ANY_TEXT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
LETTERS = r"A-Za-zÀ-ÖØ-öø-ſ"
PLAIN_TEXT = rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r {LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
NOT_PLAIN = rf"[^\x00-\x7f{LETTERS}]"
NO_RANK = 1 << 30
#: Bytes from which a pre-token is merged by a heap.
LONG = 1024


def splitter():
    """text -> list of pre-tokens."""
    anything, plain, odd = regex.compile(ANY_TEXT).findall, re.compile(PLAIN_TEXT).findall, re.compile(NOT_PLAIN).search
    return lambda text: anything(text) if odd(text) else plain(text)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + n)
    return {c: b for b, c in shown.items()}


class MergeTable:
    """Pair ranks of a tokenizers .json file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, model = spec["model"]["vocab"], spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = max(ids.values()) + 1
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in byte_symbols().items():
            self.of_byte[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count_long(self, raw: bytes) -> int:
        """Symbols left of one long pre-token: pairs wait in a heap by rank and place, so time
        follows n log n where rounds over all of it would follow its square."""
        symbol = self.of_byte[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks_of(np.array(symbol[:-1]), np.array(symbol[1:])).tolist()
        heap = [(r, i, symbol[i], symbol[i + 1]) for i, r in enumerate(ranks) if r < NO_RANK]
        heapq.heapify(heap)
        of_pair: dict[tuple[int, int], int] = {}
        left = n

        def wait(i: int, j: int) -> None:
            pair = (symbol[i], symbol[j])
            if pair not in of_pair:
                of_pair[pair] = int(self.ranks_of(np.array([pair[0]]), np.array([pair[1]]))[0])
            if of_pair[pair] < NO_RANK:
                heapq.heappush(heap, (of_pair[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has merged since
            symbol[i], symbol[j] = int(self.made[rank]), -1
            after[i] = after[j]
            left -= 1
            if after[i] < n:
                before[after[i]] = i
                wait(i, after[i])
            if before[i] >= 0:
                wait(before[i], i)
        return left

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token after all merges."""
        raw = [t.encode() for t in tokens]
        long = [i for i, r in enumerate(raw) if len(r) > LONG]
        if long:
            out = np.zeros(len(raw), dtype=np.int64)
            out[long] = [self.count_long(raw[i]) for i in long]
            short = np.setdiff1d(np.arange(len(raw)), long)
            if len(short):
                out[short] = self.count([tokens[i] for i in short])
            return out
        length = np.array([len(r) for r in raw], dtype=np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        alive = np.arange(len(raw))
        left = length.copy()
        while len(alive):
            ends = np.cumsum(length)
            starts = ends - length
            rank = np.full(len(symbol), NO_RANK, dtype=np.int64)
            rank[:-1] = self.ranks_of(symbol[:-1], symbol[1:])
            rank[ends - 1] = NO_RANK
            best = np.minimum.reduceat(rank, starts)
            goes_on = best < NO_RANK
            merge = (rank == np.repeat(best, length)) & (rank < NO_RANK)
            # of pairs that overlap (equal symbols in a row) every second one merges, from the left
            touch = np.flatnonzero(merge[1:] & merge[:-1]) + 1
            if len(touch):
                hit = np.flatnonzero(merge)
                fresh = np.r_[True, np.diff(hit) > 1]
                first = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
                merge[hit[(hit - first) % 2 == 1]] = False
            symbol[merge] = self.made[rank[merge]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[np.flatnonzero(merge) + 1] = False
            length = length - np.add.reduceat(merge.astype(np.int64), starts)
            left[alive] = length
            symbol = symbol[keep & np.repeat(goes_on, ends - starts)]
            alive, length = alive[goes_on], length[goes_on]
        return left


class IdCache(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes, from a tokenizers .json
    file.  Emptied when full, so memory stays bounded; an emptied entry is computed anew.

    The file's merges come in order of the ids they make, which is what ranks by id mean."""

    def __init__(self, vocabulary: str, most: int = 400_000):
        super().__init__()
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        ids, byte_of = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{vocabulary}: merges are not in the order of their ids")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items() if t not in self.special}
        self.encode = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = np.array(self.encode(token), dtype="<u4").tobytes()
        self[token] = ids
        return ids
