"""Evaluation texts leaking into training text.

SimHash over windows: every item is cut into windows of WINDOW words, the least passage that counts, and so is every
document. A window's fingerprint is the SimHash of its five-word shingles, each weighted by its letters. Fingerprints
are cut into RADIUS + 1 blocks; two fingerprints within RADIUS bits of each other agree in one block at least, so an
index by blocks finds every pair within the radius. Candidates are verified by their exact weighted-shingle similarity.
Equal passages have equal fingerprints and similarity 1, so no shared passage of WINDOW words is ever missed.

The items are a stated query set, held against all documents block by block: an index holds at most ITEMS_IN_BLOCK
items, so what is broadcast is bounded whatever the number of items. The documents are read once for a block, nothing
of them is shuffled, and a document is worked on in slices, so its length doesn't matter.

Defined results for odd input: null and empty texts, and those of fewer than WINDOW words, share nothing; repeated rows
give one result row; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidelta.llm.words import plain_words

WINDOW = 12
SHINGLE = 5
RADIUS = 3
SIMILARITY = 0.8
#: About 40 windows an item, 40 bytes a window and 2 MB of block offsets: some 10 MB at most.
ITEMS_IN_BLOCK = 4_000
#: Words worked on at once: 32 MB of votes.
SLICE = 1 << 16

_BLOCKS = RADIUS + 1
_BITS = 64 // _BLOCKS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.array([], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bits that depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the shingle that starts at each word."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.array([], np.uint64), np.array([], np.int32)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * _ODD + hashes[k : k + n]
    letters = np.concatenate([[0], np.cumsum(lengths)])
    return _mix(h), (letters[SHINGLE:] - letters[:-SHINGLE]).astype(np.int32)


def fingerprints(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The SimHash of the window that starts at each word; shingles as ``shingles`` gives them."""
    span = WINDOW - SHINGLE + 1
    n = len(shingle) - span + 1
    if n <= 0:
        return np.array([], np.uint64)
    bits = np.unpackbits(shingle.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    votes = np.empty((len(shingle) + 1, 64), np.int32)
    votes[0] = 0
    np.cumsum((2 * bits - 1).astype(np.int32) * weight[:, None], axis=0, out=votes[1:])
    return np.packbits(votes[span:] - votes[:-span] > 0, axis=1).view(np.uint64).ravel()


def _blocks(prints: np.ndarray) -> np.ndarray:
    return (prints[None, :] >> (np.arange(_BLOCKS, dtype=np.uint64)[:, None] * np.uint64(_BITS))) & np.uint64((1 << _BITS) - 1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POP[(a ^ b).view(np.uint16).reshape(-1, 4)].sum(axis=1)


@dataclass
class Index:
    """The windows of some items: fingerprints, their order by each block, shingles and words."""

    item: np.ndarray
    place: np.ndarray
    prints: np.ndarray
    order: np.ndarray
    offsets: np.ndarray
    shingle: np.ndarray
    weight: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> Index:
        parts = []
        for item, text in items:
            words = plain_words(text)
            if len(words) < WINDOW:
                continue
            hashes, lengths = _hashes(words), np.array([len(w) for w in words])
            s, w = shingles(hashes, lengths)
            n, span = len(words) - WINDOW + 1, WINDOW - SHINGLE + 1
            at = np.arange(n)[:, None]
            parts.append((np.full(n, item, np.int64), np.arange(n), fingerprints(s, w), s[at + np.arange(span)], w[at + np.arange(span)], hashes[at + np.arange(WINDOW)]))
        if not parts:
            z = np.zeros(0, np.int64)
            return cls(z, z, z.astype(np.uint64), np.zeros((_BLOCKS, 0), np.int64), np.zeros((_BLOCKS, (1 << _BITS) + 1), np.int64), z, z, z)
        item, place, prints, s, w, words = (np.concatenate(p) for p in zip(*parts))
        blocks = _blocks(prints)
        order = np.argsort(blocks, axis=1, kind="stable")
        offsets = np.stack([np.searchsorted(np.sort(b), np.arange((1 << _BITS) + 1)) for b in blocks])
        return cls(item, place, prints, order.astype(np.int32), offsets.astype(np.int32), s, w, words)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index into ``prints``, index of a window here) at most RADIUS bits apart, each once."""
        found = []
        for b, values in enumerate(_blocks(prints)):
            low = self.offsets[b][values]
            many = self.offsets[b][values + np.uint64(1)] - low
            at = np.repeat(np.arange(len(prints)), many)
            if not len(at):
                continue
            first = np.repeat(np.cumsum(many) - many, many)
            own = self.order[b][np.repeat(low, many) + np.arange(len(at)) - first]
            near = _distance(prints[at], self.prints[own]) <= RADIUS
            found.append(at[near] * np.int64(len(self.prints)) + own[near])
        keys = np.unique(np.concatenate(found)) if found else np.array([], np.int64)
        return keys // max(len(self.prints), 1), keys % max(len(self.prints), 1)


def weighted_similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of rows of shingles; a shingle that repeats in a row counts each time."""
    out = np.empty(len(a))
    for i in range(len(a)):
        left: dict = {}
        for s, w in zip(a[i].tolist(), wa[i].tolist()):
            left[s] = left.get(s, 0) + w
        right: dict = {}
        for s, w in zip(b[i].tolist(), wb[i].tolist()):
            right[s] = right.get(s, 0) + w
        both = sum(min(w, right[s]) for s, w in left.items() if s in right)
        out[i] = both / (sum(left.values()) + sum(right.values()) - both)
    return out


def matches(index: Index, ids: list, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document number, index window, place in the document and whether all words are equal, of each verified pair."""
    hashes, lengths, owner = [], [], []
    held = 0
    for d, text in enumerate(texts):
        words = plain_words(text)
        if len(words) >= WINDOW:
            hashes.append(_hashes(words))
            lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
            owner.append(np.full(len(words), d))
            held += len(words)
        if held > SLICE or (d == len(texts) - 1 and held):
            yield from _slices(index, np.concatenate(hashes), np.concatenate(lengths), np.concatenate(owner))
            hashes, lengths, owner, held = [], [], [], 0


def _slices(index: Index, hashes: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> Iterator[tuple]:
    span = WINDOW - SHINGLE + 1
    for start in range(0, len(hashes) - WINDOW + 1, SLICE):
        h, n, o = (x[start : start + SLICE + WINDOW - 1] for x in (hashes, lengths, owner))
        s, w = shingles(h, n)
        prints = fingerprints(s, w)
        inside = np.flatnonzero(o[: len(prints)] == o[WINDOW - 1 :])
        at, own = index.within_radius(prints[inside])
        if not len(at):
            continue
        at = inside[at]
        step = np.arange(span)
        equal = (h[at[:, None] + np.arange(WINDOW)] == index.words[own]).all(axis=1)
        similar = equal.copy()
        rest = np.flatnonzero(~equal)
        if len(rest):
            similar[rest] = weighted_similarity(s[at[rest, None] + step], w[at[rest, None] + step], index.shingle[own[rest]], index.weight[own[rest]]) >= SIMILARITY
        keep = np.flatnonzero(similar)
        yield o[at[keep]], own[keep], start + at[keep], equal[keep]


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``item_id``, ``doc_id``, ``windows`` (windows of the item found in the document, word for word) and ``near`` (found at all)."""
    spark = documents.sparkSession
    queries = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, -(-queries.count() // (ITEMS_IN_BLOCK // 2)))  # half full on average, since a hash deals the items out
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    whole = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index.of([(r.i, r.t) for r in mine.collect()]))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ix = index.value
            for batch in batches:
                ids, rows = batch["d"].to_numpy(), []
                for doc, own, _, equal in matches(ix, ids, batch["t"].tolist()):
                    rows.append(pd.DataFrame({"item_id": ix.item[own], "doc_id": ids[doc], "place": ix.place[own], "equal": equal}).drop_duplicates())
                if rows:
                    found = pd.concat(rows).drop_duplicates()
                    grouped = found.groupby(["item_id", "doc_id"])
                    yield pd.DataFrame({"windows": grouped["equal"].sum().astype("int64"), "near": grouped["place"].nunique().astype("int64")}).reset_index()

        part = docs.mapInPandas(scan, "item_id bigint, doc_id bigint, windows bigint, near bigint")
        whole = part if whole is None else whole.unionByName(part)
    # a document that occurs twice gives equal rows
    return whole.groupBy("item_id", "doc_id").agg(F.max("windows").alias("windows"), F.max("near").alias("near"))
