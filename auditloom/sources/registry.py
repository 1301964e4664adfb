"""Registry records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def registry_history(records: DataFrame, key: str, program: str, ts: str) -> DataFrame:
    """Records of one program, newest first; the filter reaches the scan."""
    return records.where(F.col(key) == program).orderBy(F.desc(ts))
