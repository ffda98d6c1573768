"""Column functions on times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month(df: DataFrame, column: str) -> Column:
    """Year and month in UTC, as 2020-03; a timestamp without a zone is taken for UTC."""
    time = F.col(column)
    if dict(df.dtypes)[column] == "timestamp":
        time = F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp_ntz"))
    return F.date_format(time, "yyyy-MM")
