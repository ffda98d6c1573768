"""The gate on a stream of candidate rows, against a baseline that is there.

An extension: candidates are joined to the baseline, left, as they arrive, and classified with the same rules. That a baseline
case is missing from the candidate can't be known before a stream ends, so no row says so.

Defined results for odd input: a candidate whose key the baseline lacks is a new case; null and empty keys are left out, as
they can't be paired; rows that arrive again are classified again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidelta.operators import gate


def classified(baseline: DataFrame, candidates: DataFrame, key: str = "case_id") -> DataFrame:
    """A stream (or table) of candidates as ``case_id``, ``classification``, ``blocking``, ``changes``."""
    rows = candidates.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return gate.run_diff(baseline, rows, key, how="right_outer")


def start(baseline: DataFrame, candidates: DataFrame, table: str, checkpoint: str, key: str = "case_id") -> StreamingQuery:
    """Writes each batch's classified rows to the Parquet folder ``table``; a batch that is written again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return classified(baseline, candidates, key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
