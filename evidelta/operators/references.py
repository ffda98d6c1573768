"""References to records that do not exist.

A reference is an orphan unless its key names a parent row that is not deleted and was loaded no later than the referring
row. Only the earliest such load time of a key matters, so parents shrink to one row a key.

Skew-aware split: references are pre-aggregated per key and period (partial aggregation before the shuffle). Keys with at
least a thousandth of all references are heavy, so at most a thousand of them: their references are checked against a
broadcast of their parents where they lie, and never shuffled. The remaining keys go through a shuffled anti-join. Both
sets of orphans are united.

Defined results for odd input: null keys never make a case. A referring row without a time can't be preceded by any
parent, so it is an orphan, in the null period. A parent without a time is never in time. Keys are compared as stored;
repeated rows count each time. Extra columns are ignored, and empty tables give empty results (no parents: every
reference is an orphan). Periods are months in UTC, whatever the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidelta.functions.times import month
from evidelta.operators.skew import heavy_keys, short_key, split_by


def first_live(parents: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """``_key`` and ``_live``, the earliest load time of a parent row of that key that is not deleted."""
    return (
        parents.where(F.col(key).isNotNull() & F.col(deleted).isNull() & F.col(loaded).isNotNull())
        .groupBy(short_key(F.col(key)).alias("_key"))
        .agg(F.min(loaded).alias("_live"))
    )


def _references(children: DataFrame, row_id: str, key: str, loaded: str) -> DataFrame:
    return children.where(F.col(key).isNotNull()).select(
        F.col(row_id).alias("_row"), short_key(F.col(key)).alias("_key"), F.col(loaded).alias("_at"), month(children, loaded).alias("_period")
    )


def _per_key_and_period(refs: DataFrame) -> DataFrame:
    return refs.groupBy("_key", "_period").agg(F.count(F.lit(1)).alias("n"))


def _orphans(refs: DataFrame, live: DataFrame) -> DataFrame:
    heavy = heavy_keys(_per_key_and_period(refs), "_key")
    hot, rest = split_by(refs, "_key", heavy)
    parents = F.broadcast(heavy.join(live, "_key"))
    in_time = lambda p: (refs["_key"] == p["_key"]) & (p["_live"] <= refs["_at"])
    return hot.join(parents, in_time(parents), "left_anti").unionByName(rest.join(live, in_time(live), "left_anti"))


def orphan_rows(children: DataFrame, row_id: str, key: str, parents: DataFrame, parent_key: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """The orphan references: ``row_id`` (of the referring row), ``period`` (month of its load time)."""
    refs = _references(children, row_id, key, loaded)
    return _orphans(refs, first_live(parents, parent_key, loaded, deleted)).select(F.col("_row").alias("row_id"), F.col("_period").alias("period"))


def orphan_counts(children: DataFrame, row_id: str, key: str, parents: DataFrame, parent_key: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """``period``, ``references_n``, ``orphans``: references and orphans per month of load time."""
    refs = _references(children, row_id, key, loaded)
    none = F.lit(0).cast("bigint")
    every = refs.groupBy("_period").agg(F.count(F.lit(1)).alias("n"), none.alias("orphans"))
    lost = _orphans(refs, first_live(parents, parent_key, loaded, deleted)).groupBy("_period").agg(none.alias("n"), F.count(F.lit(1)).alias("orphans"))
    return every.unionByName(lost).groupBy(F.col("_period").alias("period")).agg(F.sum("n").alias("references_n"), F.sum("orphans").alias("orphans"))
