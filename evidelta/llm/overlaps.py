"""Held-out claims that also stand among the training claims, word for word or nearly so.

Two claims overlap when they share at least 80 % of the words of the longer one, repeats counted, order free. Edit
distance can't express that: a claim with its clauses swapped is a case, however many edits lie between. So the pigeonhole
of a segment join is applied to the claims' words in one global order, rare words first. Of n words, ceil(0.8 n) = t must
be shared, so the first shared word is among the n - t + 1 first of both claims, the second among the n - t + 2 first,
and so on. A rare first shared word is a key by itself; a frequent one makes a key with the shared words after it, as many
as it takes until about TARGET claims are expected to hold them all, DEEPEST at most. Where a key ends depends on its words
alone, so every pair within the rule has a key in common, and a key has much the same number of claims whatever the table's size.

Each keyed row carries a sketch of its claim's words, so candidates are checked where the keys meet and nearly all of the false ones
end there; only pairs that pass are written. The keys are made and joined in several passes over a share each, as many
as keep a pass's shuffle in proportion to the claims (PASS_BYTES each). At the end the claims of the pairs left are read again and
compared exactly.

A sketch has 112 bits and the number of words. Each word, a repeated one numbered, flips one bit, so that sketches differ in no more
bits than the claims do in words: no pair within the rule is refused. Words are compared by hashes until the end; a
collision only costs a comparison. Frequencies are counted by BUCKETS hashes, so what is collected and broadcast has a
bounded size. Claims of more than SHORT words, and those short enough to match one, are also keyed by single words, as the
combinations would be too many.

Defined results for odd input: null claims and those of fewer than LEAST words overlap with nothing, and rows with a null
id make no case; repeated rows give one result row; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidelta.llm.words import case_words
from evidelta.session import release, stored

LEAST = 6
SHORT = 64
#: Claims expected to hold a key's words, and words of a key at most. LEAST words have a shared one for each of these.
TARGET, DEEPEST = 200, 4
BUCKETS = 1 << 20
#: Shuffled bytes of a keyed row, about; those allowed to a pass for each claim, and in any case.
ROW_BYTES, PASS_BYTES, PASS_LEAST = 32, 240, 1 << 29
#: Claims and words that numpy handles at once.
ROWS, WORDS = 1_000, 32_000
FOUND_BITS = 25
_ALL48 = (1 << 48) - 1
_MOST = (1 << 16) - 1
#: Fractions of a power of two by which frequencies are told apart.
_STEP = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def needed(n):
    """The words that a claim of ``n`` words must share with one no longer: 80 %, rounded up."""
    return (4 * n + 4) // 5


def bag(text: str) -> str:
    """The words in order, a repeated one numbered, as one text."""
    seen: dict[str, int] = {}
    out = []
    for w in case_words(text):
        seen[w] = n = seen.get(w, 0) + 1
        out.append(w if n == 1 else f"{w}#{n}")
    return " ".join(sorted(out))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _upto(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... below each of ``counts``, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def read(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of the texts with LEAST words, their numbers of words, all their words as hashes, and the two parts of their sketches."""
    words = [case_words(t) for t in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    places = np.flatnonzero(sizes >= LEAST)
    n = sizes[places]
    if not len(places):
        return places, n, np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = np.fromiter((zlib.crc32(w.encode()) for i in places for w in words[i]), np.uint64, n.sum())
    tagged = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | hashes
    tagged.sort()
    at = np.arange(len(tagged))
    new = np.append(True, tagged[1:] != tagged[:-1])
    repeats = at - np.maximum.accumulate(np.where(new, at, 0))
    tokens = tagged.astype(np.uint32) + repeats.astype(np.uint32) * np.uint32(0x9E3779B9)
    bit = (_mixed(tokens.astype(np.uint64)) >> np.uint64(20)) % np.uint64(112)
    flip = np.uint64(1) << (bit % np.uint64(64))
    starts = np.cumsum(n) - n
    low, high = (np.bitwise_xor.reduceat(np.where(side, flip, np.uint64(0)), starts) for side in (bit < 64, bit >= 64))
    high |= np.minimum(n, _MOST).astype(np.uint64) << np.uint64(48)
    return places, n, tokens, low.view(np.int64), high.view(np.int64)


def keys(n: np.ndarray, tokens: np.ndarray, often: np.ndarray, claims: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of claims with ``n`` words each that belong to a pass: the claims' places and the keys.

    ``often``: by bucket, how often its words occur among ``claims`` claims, in steps of the binary logarithm; 0 for up to TARGET times.
    """
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    order = row << np.uint64(44) | often[tokens & np.uint32(BUCKETS - 1)].astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64)
    order.sort()
    word, log = order & np.uint64(0xFFFFFFFF), (order >> np.uint64(32) & np.uint64(0xFFF)).astype(np.int64)
    starts, spare = np.cumsum(n) - n, n - needed(n)
    few, all_claims = round(_STEP * math.log2(TARGET)), round(_STEP * math.log2(max(claims, 1)))
    mine = (lambda key: key >> np.uint64(7)) if parts == 1 else (lambda key: (key >> np.uint64(7)) % np.uint64(parts) == part)
    out_rows, out_keys = [], []

    def first(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, place = np.repeat(rows, spare[rows] + 1), _upto(spare[rows] + 1)
        place += starts[rows]
        return rows, place, _mixed(word[place] ^ np.uint64(seed << 40))

    def take(rows: np.ndarray, key: np.ndarray, which: np.ndarray) -> None:
        out_rows.append(rows[which])
        out_keys.append(key[which])

    whole = parts == 1
    rows, place, key = first(np.flatnonzero(n >= needed(SHORT + 1)), 2)
    take(rows, key, np.full(len(key), True) if whole else mine(key))
    rows, place, key = first(np.flatnonzero(n <= SHORT), 1)
    expected = log[place]
    for deep in range(1, DEEPEST + 1):
        ends = (expected <= few) | (deep == DEEPEST)
        if deep == 2 and not whole:  # a longer key belongs to the pass of its first two words
            here = mine(key)
            rows, place, key, expected, ends = rows[here], place[here], key[here], expected[here], ends[here]
        take(rows, key, ends & mine(key) if deep == 1 and not whole else ends)
        if deep == DEEPEST:
            break
        rows, place, key, expected = rows[~ends], place[~ends], key[~ends], expected[~ends]
        more = starts[rows] + spare[rows] + deep - place
        place = np.repeat(place, more) + 1 + _upto(more)
        rows, key, expected = np.repeat(rows, more), np.repeat(key, more), np.repeat(expected, more)
        key, expected = _mixed(key ^ word[place]), expected + log[place] - all_claims
    return np.concatenate(out_rows), np.concatenate(out_keys).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def bags(df: DataFrame, claim: str) -> DataFrame:
    """The distinct bags of words of the claims with LEAST words or more, as hashes, and their sketches."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            _, n, tokens, low, high = read(batch.column(0).to_pylist())
            ends = np.append(0, 4 * np.cumsum(n)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays([packed, pa.array(low), pa.array(high)], names=["_tokens", "_low", "_high"])

    return df.select(claim).mapInArrow(made, "_tokens binary, _low bigint, _high bigint").distinct()


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of words and the words of packed bags."""
    packed = column.to_pylist()
    return np.array([len(x) // 4 for x in packed], np.int64), np.frombuffer(b"".join(packed), np.uint32)


def frequencies(all_bags: DataFrame) -> np.ndarray:
    """By bucket, how often its words occur, as ``keys`` takes it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(_tokens(batch.column(0))[1] & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(n)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["w", "n"])

    sums = all_bags.select("_tokens").mapInArrow(counted, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > TARGET).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[sums["w"].to_numpy()] = np.rint(_STEP * np.log2(np.maximum(sums["n"].to_numpy(), 1)))
    return np.minimum(often, 0xFFF)


def _may_overlap() -> Column:
    """Whether the sketches of two claims leave it possible that they overlap."""
    left, right = (F.shiftrightunsigned(f"_{x}_high", 48) for x in "lr")
    longer = F.greatest(left, right)
    low, high = F.col("_l_low").bitwiseXOR(F.col("_r_low")), F.col("_l_high").bitwiseXOR(F.col("_r_high")).bitwiseAND(F.lit(_ALL48))
    shared = F.floor((longer * 4 + 4) / 5)
    return (longer == _MOST) | ((F.least(left, right) * 5 >= longer * 4) & (F.bit_count(low) + F.bit_count(high) <= left + right - shared * 2))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """The sketches of the bags of ``left`` and ``right`` that have a key in common and may overlap by their sketches."""
    spark = left.sparkSession
    both = left.unionByName(right)
    claims, table = both.count(), spark.sparkContext.broadcast(frequencies(both))

    def keyed(side: DataFrame, name: str, part: int, parts: int) -> DataFrame:
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                n, tokens = _tokens(batch.column(0))
                low, high = (batch.column(k).to_numpy() for k in (1, 2))
                ends = np.cumsum(n)
                block = (ends - 1) // WORDS
                for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(block)) + 1):
                    if len(rows):
                        at, key = keys(n[rows], tokens[ends[rows[0]] - n[rows[0]] : ends[rows[-1]]], table.value, claims, part, parts)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(low[rows][at]), pa.array(high[rows][at])], names=["_key", f"_{name}_low", f"_{name}_high"])

        return side.select("_tokens", "_low", "_high").mapInArrow(made, f"_key bigint, _{name}_low bigint, _{name}_high bigint")

    # how many passes: from the keys of a 64th of the bags; the passes together cover all bags and keys
    few = both.where(F.pmod(F.xxhash64("_low", "_high"), F.lit(64)) == 0)
    size = 64 * ROW_BYTES * keyed(few, "l", 0, 1).count()
    parts = max(1, math.ceil(size / max(PASS_BYTES * claims, PASS_LEAST)))
    found = None
    for part in range(parts):
        joined = keyed(left, "l", part, parts).join(keyed(right, "r", part, parts), "_key").where(_may_overlap())
        passed = stored(joined.select("_l_low", "_l_high", "_r_low", "_r_high").distinct())
        del joined
        release(spark)
        found = passed if found is None else found.unionByName(passed)
    return found.distinct()


def _bit(low, high) -> object:
    """A sketch's place in a bitmap; for columns and arrays alike."""
    if isinstance(low, Column):
        return low.bitwiseXOR(F.shiftrightunsigned(low, 39)).bitwiseXOR(high).bitwiseAND(F.lit((1 << FOUND_BITS) - 1))
    low, high = low.view(np.uint64), high.view(np.uint64)
    return ((low ^ (low >> np.uint64(39)) ^ high) & np.uint64((1 << FOUND_BITS) - 1)).astype(np.int64)


def _claims(df: DataFrame, claim: str, found: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose claim may be in ``found``, with its words and sketch in place of the claim."""
    # 4 MB at most, whatever the size of found
    at = _bit(F.col(f"_{name}_low"), F.col(f"_{name}_high"))
    blocks = found.groupBy(F.shiftright(at, 15).alias("b")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(0x7FFF))).alias("bits")).collect()
    bits = np.zeros(1 << FOUND_BITS - 3, np.uint8)
    for r in blocks:
        bits[r.b << 12 : (r.b + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(bits)
    fields = [f for f in df.schema.fields if f.name != claim]
    names = [f.name for f in fields] + [f"_{name}", f"_{name}_low", f"_{name}_high"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(batch.schema.get_field_index(claim)).to_pylist()
            places, _, _, low, high = read(texts)
            bit = _bit(low, high)
            hit = np.flatnonzero(sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            rows = pa.array(places[hit])
            others = [batch.column(batch.schema.get_field_index(f.name)).take(rows) for f in fields]
            yield pa.RecordBatch.from_arrays([*others, pa.array([bag(texts[i]) for i in places[hit]], pa.string()), pa.array(low[hit]), pa.array(high[hit])], names=names)

    return df.mapInArrow(made, StructType([*fields, StructField(names[-3], StringType()), *(StructField(x, LongType()) for x in names[-2:])]))


def overlaps(heldout: DataFrame, heldout_claim: str, training: DataFrame, training_claim: str) -> DataFrame:
    """Every pair of overlapping rows, with the columns of both but their claims; these must differ in name."""
    spark = heldout.sparkSession
    sides = [stored(bags(heldout, heldout_claim)), stored(bags(training, training_claim))]
    release(spark)
    found = stored(candidates(*sides))
    left, right = _claims(heldout, heldout_claim, found, "l"), _claims(training, training_claim, found, "r")
    pairs = found.join(left, ["_l_low", "_l_high"]).join(right, ["_r_low", "_r_high"])
    a, b = F.split("_l", " "), F.split("_r", " ")
    shared = F.size(F.array_intersect(a, b))
    return pairs.where(shared * 5 >= F.greatest(F.size(a), F.size(b)) * 4).drop("_l", "_r", "_l_low", "_l_high", "_r_low", "_r_high")
