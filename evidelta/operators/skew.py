"""Splitting off heavy keys before a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds at least this share of the rows. There are at most 1 / HEAVY_SHARE such keys,
#: whatever the data, so a table with one row for each of them may be broadcast.
HEAVY_SHARE = 1 / 1000
#: Characters of a key that is kept as it is; a longer one is replaced by its digest, which bounds the bytes too.
KEPT = 200


def short_key(key: Column) -> Column:
    """``key`` as text of bounded length: itself, or its SHA-256 digest if it is long. Only a collision of SHA-256 and length could make unequal keys equal."""
    text = key.cast("string")
    return F.when(F.length(text) > KEPT, F.concat(F.lit("sha256:"), F.sha2(text, 256), F.lit(":"), F.length(text))).otherwise(text)


def heavy_keys(counts: DataFrame, key: str, n: str = "n", share: float = HEAVY_SHARE) -> DataFrame:
    """Keys of ``counts`` (one row or several for a key, ``n`` rows each) with at least ``share`` of all rows.

    Null keys never count. The result has one column, ``key``, and at most ``1 / share`` rows.
    """
    by_key = counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(n).alias("_n"))
    total = by_key.agg(F.sum("_n").alias("_total"))
    # one row, so this nested-loop join is a scalar lookup
    return by_key.join(F.broadcast(total)).where(F.col("_n") >= F.greatest(F.lit(2), F.col("_total") * share)).select(key)


def split_by(rows: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` of the heavy keys, and the others (null keys among them); ``heavy`` is broadcast."""
    few = F.broadcast(heavy)
    return rows.join(few, key, "left_semi"), rows.join(few, key, "left_anti")


def lookup_skewed(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``rows`` inner-joined to ``table`` (unique ``key``): heavy keys by broadcast alone, the others by shuffle.

    ``table`` has bounded rows, no texts: what is broadcast is one row of it for each heavy key.
    """
    _, light = split_by(rows, key, heavy)
    hot = table.join(F.broadcast(heavy), key, "left_semi")
    return rows.join(F.broadcast(hot), key).unionByName(light.join(table, key))
