"""Texts as the integer ids of a byte-level BPE tokenizer.

A text is split by the tokenizer's pattern, and the bytes of each piece are merged: of all adjacent pairs the one of
lowest rank, the leftmost of several, until none has a rank. The pairs of a piece wait in a rank queue: a hierarchical
bitmap with one bit for each rank finds the lowest rank that waits in three steps, and each rank has its places in order.
A merge touches two neighbours, so a piece of any length costs its length times a logarithm. Pieces of few bytes are
merged by a plain scan, which is faster there and gives the same. Pieces recur, so those of moderate length are remembered.

Defined results for odd input: null and empty texts have an empty list; lone surrogates, which UTF-8 can't hold, count as
replacement characters; special tokens are never made, and their spelling in a text is encoded as any other text.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from itertools import chain

import regex

REMEMBERED = 1 << 17
#: Bytes up to which a scan for the lowest rank beats the queue.
SCANNED = 24
#: Longer pieces are rare, and would fill the memory.
REMEMBERED_LENGTH = 64
#: Unicode's White_Space; Python's own class has more.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(pattern: str) -> str:
    """``pattern`` with Unicode's whitespace in place of Python's."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def _ascii(pattern: str) -> str:
    """The same on ASCII texts, without Unicode's classes: several times faster."""
    pattern = pattern.replace(r"\p{L}\p{N}]", "a-zA-Z0-9]")
    return pattern.replace(r"\p{L}", "[a-zA-Z]").replace(r"\p{N}", "[0-9]")


class Known(dict):
    """Pieces and their ids; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> list[int]:
        ids = self.make(piece)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class BitmapQueue:
    """Places waiting by rank; ranks below 64 ** 3. The lowest rank comes first, and its lowest place."""

    def __init__(self) -> None:
        self.top = 0
        self.middle: dict[int, int] = {}
        self.low: dict[int, int] = {}
        self.places: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        waiting = self.places.get(rank)
        if waiting is not None:
            heapq.heappush(waiting, place)
            return
        self.places[rank] = [place]
        a, b = rank >> 12, rank >> 6
        self.top |= 1 << a
        self.middle[a] = self.middle.get(a, 0) | 1 << (b & 63)
        self.low[b] = self.low.get(b, 0) | 1 << (rank & 63)

    def pop(self) -> tuple[int, int] | None:
        """Rank and place of the first; None if nothing waits."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        m = self.middle[a]
        b = a << 6 | (m & -m).bit_length() - 1
        w = self.low[b]
        rank = b << 6 | (w & -w).bit_length() - 1
        waiting = self.places[rank]
        place = heapq.heappop(waiting)
        if not waiting:
            del self.places[rank]
            self.low[b] = w & (w - 1)
            if not self.low[b]:
                self.middle[a] = m & (m - 1)
                if not self.middle[a]:
                    self.top &= self.top - 1
        return rank, place


class Tokenizer:
    """``ranks``: id of each token by its bytes; the order of the ids is that of the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        pattern = _pattern(pattern)
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(_ascii(pattern)).findall
        self._known = Known(self.merged)

    def merged(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.scanned(data) if len(data) <= SCANNED else self.queued(data)

    def scanned(self, data: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.ranks)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def queued(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0 if none does
        before = list(range(-1, n))  # where the part that ends here begins
        queue = BitmapQueue()
        for i in range(n - 1):
            if (rank := ranks.get(data[i : i + 2])) is not None:
                queue.push(rank, i)
        while (first := queue.pop()) is not None:
            rank, i = first
            j = end[i]
            # an entry whose parts have been merged otherwise is stale
            if not j or j >= n or ranks.get(data[i : end[j]]) != rank:
                continue
            k = end[j]
            end[i], end[j], before[k] = k, 0, i
            if k < n and (rank := ranks.get(data[i : end[k]])) is not None:
                queue.push(rank, i)
            if i > 0 and (rank := ranks.get(data[before[i] : k])) is not None:
                queue.push(rank, before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.split_ascii(text) if text.isascii() else self.split(text)
        return list(chain.from_iterable(map(self._known.__getitem__, pieces)))


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks in a file of lines of a token in base 64 and its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


@lru_cache(maxsize=4)
def public(name: str) -> Tokenizer:
    """A tokenizer of the package ``public_tokenizers``, which has to be on the executors too."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        return Tokenizer(read_ranks(f.read()), public_tokenizers.PATTERN)
