"""Duplicates hidden by formatting differences.

Merkle-style bottom-up hashing: every compared field of a record becomes a digest. A leaf is normalised to its letters
and digits; a citation is an unordered node whose children (the volume-reporter-page unit, which keeps its order, the
court and the year) are digested first and sorted; the record is an ordered node of its named fields. Records are grouped
by root digest, 16 bytes, alone, with partial aggregation before the shuffle. A full comparison of the normalised
structures then confirms the groups of several records, whose structures alone are shuffled for it; unequal structures
under one digest fall apart into groups of their own.

The digests are made in one Arrow step, whose result is written once: the patterns of Unicode classes that they need run
several times faster in Python than in the JVM. The way back from a group to its members sends digests and ids only, and
answers heavy groups (a thousandth of all rows or more, so at most a thousand of them) from a broadcast of 24 bytes
each; no group is ever gathered in one task.

Defined results for odd input: a row with a null or blank compared field (blank also if nothing but punctuation) has no
copies and is a group of its own; rows are counted as they stand, so a row repeated with its id adds to the copies but is
no copy of itself; extra columns are ignored; empty tables have no groups.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.operators.skew import heavy_keys, lookup_skewed
from evidelta.session import cut, stored

_ASCII_REST = bytes(b for b in range(128) if not chr(b).isalnum())
#: Variation selectors and other marks that show nothing.
_HIDDEN = "\ufe00-\ufe0f\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\uffa0"
_REST = regex.compile(rf"[^\p{{L}}\p{{N}}\p{{M}}]+|[{_HIDDEN}]")
_INVISIBLE = regex.compile(rf"[\p{{Cf}}{_HIDDEN}]+")
#: An ordinal of a reporter's series, like 2d, belongs to the reporter's name.
_TOKEN = regex.compile(r"\d+(?:st|nd|rd|th|d)(?!\p{L})|\d+|[\p{L}\p{M}]+|\p{N}+")
_ASCII_TOKEN = re.compile(r"\d+(?:st|nd|rd|th|d)(?![a-z])|\d+|[a-z]+")
_YEAR = re.compile(r"(?:1[6-9]|20)\d\d")


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).casefold()


def letters_and_digits(text: str | None) -> str | None:
    """``text`` without case, whitespace, punctuation and invisible characters; None if nothing is left."""
    if text is None:
        return None
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_REST).decode() or None
    return _REST.sub("", _folded(text)) or None


@lru_cache(maxsize=1 << 17)
def citation_node(name: str, text: str | None) -> tuple[str, str] | None:
    """Structure and digest of a citation: an unordered node, so its children's digests are sorted."""
    parts = citation_parts(text)
    if parts is None:
        return None
    children = sorted(digest(p, v) for p, v in zip(("unit", "court", "year"), parts) if v)
    return "/".join(parts), digest(name, *children)


def citation_parts(text: str | None) -> tuple[str, str, str] | None:
    """Unit, court and year of a citation, "" where absent; None if it is blank.

    The unit is number, name, number; a year can't be its volume unless nothing else fits. Text without such a unit is
    kept whole, as the unit.
    """
    whole = letters_and_digits(text)
    if whole is None:
        return None
    folded = _folded(text)
    if not folded.isascii():
        folded = _INVISIBLE.sub("", folded)
    tokens = (_ASCII_TOKEN if folded.isascii() else _TOKEN).findall(folded)
    # runs of names between the numbers
    runs: list[tuple[bool, str]] = []
    for t in tokens:
        number = t.isdigit()
        if runs and not number and not runs[-1][0]:
            runs[-1] = (False, runs[-1][1] + t)
        else:
            runs.append((number, t))
    units = [i for i in range(len(runs) - 2) if runs[i][0] and not runs[i + 1][0] and runs[i + 2][0]]
    if not units:
        return whole, "", ""
    at = next((i for i in units if not _YEAR.fullmatch(runs[i][1])), units[0])
    rest = runs[:at] + runs[at + 3 :]
    return "|".join(t for _, t in runs[at : at + 3]), "".join(t for n, t in rest if not n), " ".join(t for n, t in rest if n)


def digest(*parts: str) -> str:
    """The digest of a node with these children, in this order, in hexadecimal."""
    data = "".join([f"{len(p)}:{p}" for p in parts]).encode("utf-8", "surrogatepass")
    return hashlib.blake2b(data, digest_size=16).hexdigest()


def record_node(table: str, kinds: list[tuple[str, str]], values: tuple) -> tuple[str | None, str | None]:
    """Root digest and normalised structure of one record; both None if a compared field is null or blank.

    ``kinds``: name and kind of each value; a "leaf" is compared by letters and digits, an "exact" one as it stands, a
    "citation" by its parts in any order.
    """
    shape, children = [], []
    for (name, kind), value in zip(kinds, values):
        if kind == "citation":
            node = citation_node(name, value)
            if node is None:
                return None, None
            shape.append(node[0])
            children.append(node[1])
        else:
            kept = letters_and_digits(value) if kind == "leaf" else value if value and value.strip() else None
            if kept is None:
                return None, None
            shape.append(kept)
            children.append(digest(name, kept))
    return digest(table, *children), "".join([f"{len(p)}:{p}" for p in shape])


def records(df: DataFrame, table: str, row_id: str, fields: list[tuple[str, str, Column]], opened=None) -> DataFrame:
    """``_table``, ``_id``, ``_root`` and ``_shape`` of all rows with an id; fields: (name, kind, text column).

    ``_root`` and ``_shape`` are null where a compared field is null or blank, so that the row stands alone. The root digest
    holds the table's name, so records of several tables can be grouped together. ``opened``: makes the compared values of a
    row from those of the columns, in the same step.
    """
    kinds = [(n, k) for n, k, _ in fields]
    columns = [f"_{i}" for i in range(len(fields))]

    def make(batches):
        for batch in batches:
            out = []
            for row in zip(batch["_id"], *[batch[c] for c in columns if c in batch]):
                values = opened(*row[1:]) if opened else row[1:]
                root, shape = record_node(table, kinds, values)
                out.append((row[0], None if root is None else bytes.fromhex(root), shape))
            yield pd.DataFrame(out, columns=["_id", "_root", "_shape"])

    made = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("_id"), *[c.cast("string").alias(f"_{i}") for i, (_, _, c) in enumerate(fields) if c is not None])
    return made.mapInPandas(make, "_id bigint, _root binary, _shape string").select(F.lit(table).alias("_table"), "*")


def _confirmed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the stored ``rows``: groups by digest alone (``_table``, ``_root``, ``first_id``, ``copies``), and those of several rows that a full comparison confirms, with their ``_shape``."""
    digests = rows.where(F.col("_root").isNotNull()).groupBy("_table", "_root").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    several = cut(digests.where(F.col("copies") > 1))
    heavy = heavy_keys(several.select("_root", F.col("copies").alias("n")), "_root")
    suspects = lookup_skewed(rows.where(F.col("_root").isNotNull()), several.select("_root"), "_root", heavy)
    return digests, suspects.groupBy("_table", "_root", "_shape").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def groups(rows: DataFrame) -> DataFrame:
    """One row for each group of equal records: ``_table``, ``first_id``, ``copies``. Rows without a root are groups of their own, keyed by their id."""
    rows = stored(rows)  # read several times; the normalisation is the dear part
    digests, confirmed = _confirmed(rows)
    alone = rows.where(F.col("_root").isNull()).select("_table", F.col("_id").alias("first_id")).distinct().withColumn("copies", F.lit(1).cast("bigint"))
    own = ["_table", "first_id", "copies"]
    return alone.unionByName(digests.where(F.col("copies") == 1).select(own)).unionByName(confirmed.select(own))


def members(rows: DataFrame) -> DataFrame:
    """``table_name``, ``first_id`` and ``copy_id`` of every member of a group but its first."""
    rows = stored(rows.where(F.col("_root").isNotNull()))  # read several times; the normalisation is the dear part
    confirmed = cut(_confirmed(rows)[1])
    # unequal structures under one digest: none, unless the digest is broken; their rows are told apart by the structure
    broken = confirmed.groupBy("_root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("_root")
    table = confirmed.where(F.col("copies") > 1).select("_root", "first_id", "copies")
    plain = table.join(broken, "_root", "left_anti")
    heavy = heavy_keys(plain.select("_root", F.col("copies").alias("n")), "_root")
    found = lookup_skewed(rows.select("_table", "_id", "_root"), plain.select("_root", "first_id"), "_root", heavy)
    apart = rows.join(confirmed.where(F.col("copies") > 1).join(broken, "_root", "left_semi").select("_root", "_shape", "first_id"), ["_root", "_shape"])
    pairs = found.unionByName(apart.select("_table", "_id", "_root", "first_id"))
    return pairs.where(F.col("first_id") != F.col("_id")).select(F.col("_table").alias("table_name"), "first_id", F.col("_id").alias("copy_id")).distinct()
