"""Deeply nested records as related flat tables.

Dewey labelling: every node of a record's tree gets the ordinal path from the root as its label, for example 6.2.1.0. The
parent of an object is found by truncation: without the last ordinal where the object is a member, without the last two
where it stands in an array. Objects with one schema path form one table, in which each is a row: its label, its
parent's label, its place and its scalar members. So a row of any table joins its parent by record and label.

A schema path is the list of member names on the way, with "[]" for a place in an array; member names that begin with a
bracket or a backslash are written with a backslash before them, so that no name is taken for a place. An object is put
together within the walk over its record: one pass, no shuffle, whatever the number of tables.

A walk follows the wanted paths alone; with ``paths`` None all nodes are labelled, and a label is as long as its node is deep.

Defined results for odd input: a text that is no complete object (see ``readable_object``) has no rows, and
``unreadable`` counts it; depth and length of numbers don't matter; null members are null; where a path is declared
``repeated``, an object that stands there alone counts as an array of one; elements that are no objects count in the
places of the others and have no row; a nested value in a scalar column is null, and has a row in its own table; repeated
rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.functions.jsonread import kind_of, plain, readable_object, scalar_text

PLACE = "[]"
Path = tuple[str, ...]
ROWS = "row_id bigint, path array<string>, label string, parent_label string, pos int, members map<string,string>, kinds map<string,string>"


def step(name: str) -> str:
    """A member name as a step of a path."""
    return "\\" + name if name[:1] in ("[", "\\") else name


def walk(root: dict, repeated: frozenset[Path], paths: frozenset[Path] | None) -> Iterator[tuple[Path, list[int], list[int] | None, int, dict]]:
    """Path, label, parent's label, place and value of the objects at ``paths``, parents first, without recursion."""
    ways = None if paths is None else {p[:i] for p in paths for i in range(len(p) + 1)}
    stack: list[tuple[object, Path, list[int], list[int] | None, int]] = [(root, (), [], None, 0)]
    while stack:
        node, path, label, parent, pos = stack.pop()
        if isinstance(node, dict):
            if path in repeated:
                path, label, pos = (*path, PLACE), [*label, 0], 0
            if ways is not None and path not in ways:
                continue
            if paths is None or path in paths:
                yield path, label, parent, pos, node
            below = [(v, (*path, step(k)), [*label, i], label, i) for i, (k, v) in enumerate(node.items()) if isinstance(v, (dict, list))]
        else:
            inner = (*path, PLACE)
            if ways is not None and inner not in ways:
                continue
            below = [(v, inner, [*label, i], parent, i) for i, v in enumerate(node) if isinstance(v, (dict, list))]
        stack.extend(b for b in reversed(below) if ways is None or b[1] in ways)


def objects(df: DataFrame, row_id: str, text: str, repeated: list[Path] = (), paths: list[Path] | None = None) -> DataFrame:
    """The objects of the JSON in ``text`` as rows: ROWS. ``members`` holds the scalar members, ``kinds`` the kind of every member."""
    declared, wanted = frozenset(map(tuple, repeated)), None if paths is None else frozenset(map(tuple, paths))
    names = [c.split()[0] for c in ROWS.split(", ")]

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row, value in zip(batch["row_id"], batch["text"]):
                root = readable_object(value)
                if root is None:
                    continue
                for path, label, parent, pos, node in walk(root, declared, wanted):
                    members = {plain(k): scalar_text(v) for k, v in node.items() if not isinstance(v, (dict, list))}
                    kinds = {plain(k): kind_of(v) for k, v in node.items()}
                    out.append((row, [plain(p) for p in path], _text(label), None if parent is None else _text(parent), pos, members, kinds))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return df.where(F.col(row_id).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text")).mapInPandas(shred, ROWS)


def _text(label: list[int]) -> str:
    return ".".join(map(str, label))


def at(path: Path) -> Column:
    """Whether a row belongs to the table of ``path``."""
    return F.col("path") == (F.array(*[F.lit(p) for p in path]) if path else F.array().cast("array<string>"))


def table(rows: DataFrame, path: Path, fields: list[str]) -> DataFrame:
    """The flat table of the objects at ``path``: row_id, label, parent_label, pos, and a column for each of ``fields``."""
    return rows.where(at(path)).select("row_id", "label", "parent_label", "pos", *[F.col("members")[f].alias(f) for f in fields])


def other_members(rows: DataFrame, known: dict[Path, list[str]]) -> DataFrame:
    """The members that no table has a column for, one row each: row_id, label of their object, member, kind, value (null if nested).

    ``known``: the columns, and the members with tables of their own, of each path.
    """
    parts = F.explode(F.map_entries("kinds")).alias("m")
    opened = rows.select("row_id", "path", "label", "members", parts)
    shown = F.lit(False)
    for path, fields in known.items():
        shown = shown | (at(path) & F.col("m.key").isin(fields))
    return opened.where(~shown).select("row_id", "label", F.col("m.key").alias("member"), F.col("m.value").alias("kind"), F.col("members")[F.col("m.key")].alias("value"))


def unreadable(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id`` of the rows whose ``text`` holds no complete object, null texts included."""
    check = F.pandas_udf(lambda texts: pd.Series([readable_object(t) is not None for t in texts], dtype=bool), "boolean").asNondeterministic()
    return df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), check(F.col(text)).alias("_ok")).where(~F.col("_ok")).select("row_id")
