"""Differences between two copies of a dataset.

Both copies are first reduced to the row that counts for each key (partial aggregation, so a key delivered a billion
times is no burden), then spread over buckets by a hash of the key. In a bucket both sides share one dictionary of
keys; a key's place in it is its ordinal. Each side's keys become a compressed presence bitmap: AND-NOT of the bitmaps
yields the missing rows, their intersection drives a comparison of columns aligned by ordinal, in Arrow.

Defined results for odd input: null keys never make a case; repeated rows count once; of rows with one key the one with
the latest time counts, then the largest id (null times and ids come before all others); extra columns are ignored;
an empty copy makes every key of the other one missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidelta.functions.bitmap import Bitmap

#: Keys of both sides in one bucket, at most about this many: some 100 MB of Arrow data with a few text columns.
BUCKET_KEYS = 200_000


def latest(df: DataFrame, key: str, values: dict[str, Column], order: list[str]) -> DataFrame:
    """One row for each non-null ``key``: ``_key`` and ``values`` of the row that is last in ``order``."""
    picked = F.struct(*[c.alias(n) for n, c in values.items()])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), picked.alias("_v"), F.struct(*order).alias("_o"))
    return rows.groupBy("_key").agg(F.max_by("_v", "_o").alias("_v")).select("_key", *[F.col("_v")[n].alias(n) for n in values])


def _differences(fields: list[str], missing_left: str, missing_right: str):
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        lk, rk = left.column("_key").combine_chunks(), right.column("_key").combine_chunks()
        shared = pc.unique(pa.chunked_array([lk, rk]))
        lo = pc.index_in(lk, shared).to_numpy(zero_copy_only=False)
        ro = pc.index_in(rk, shared).to_numpy(zero_copy_only=False)
        on_left, on_right = Bitmap.of(lo), Bitmap.of(ro)
        out = [(on_left.and_not(on_right).ordinals(), missing_right), (on_right.and_not(on_left).ordinals(), missing_left)]
        both = (on_left & on_right).ordinals()
        if len(both):
            at_left, at_right = np.empty(len(shared), np.int64), np.empty(len(shared), np.int64)
            at_left[lo], at_right[ro] = np.arange(len(lo)), np.arange(len(ro))
            for i, name in enumerate(fields):
                a = left.column(f"f{i}").take(pa.array(at_left[both]))
                b = right.column(f"f{i}").take(pa.array(at_right[both]))
                differ = pc.xor(pc.is_null(a), pc.is_null(b))
                differ = pc.or_(differ, pc.fill_null(pc.not_equal(a, b), False))
                out.append((both[differ.to_numpy(zero_copy_only=False)], name))
        return pa.table(
            {
                "key": pa.concat_arrays([shared.take(pa.array(o)).cast(pa.string()) for o, _ in out]),
                "finding": pa.concat_arrays([pa.array([n] * len(o), pa.string()) for o, n in out]),
            }
        )

    return compare


def differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: dict[str, Column],
    order: list[str],
    missing_left: str = "missing_in_left",
    missing_right: str = "missing_in_right",
) -> DataFrame:
    """``key`` and ``finding``: rows missing on a side, and each of ``fields`` whose (normalised) values differ."""
    places = {f"f{i}": c for i, c in enumerate(fields.values())}
    a, b = latest(left, key, places, order), latest(right, key, places, order)
    rows = left.count() + right.count()  # a scan of the columns that the callers filter by, if any; else of the footers
    spark = left.sparkSession
    buckets = max(-(-rows // BUCKET_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("_bucket")
    a, b = a.select(bucket, "*"), b.select(bucket, "*")
    compare = _differences(list(fields), missing_left, missing_right)
    return a.groupBy("_bucket").cogroup(b.groupBy("_bucket")).applyInArrow(compare, "key string, finding string")
