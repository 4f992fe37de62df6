"""An addition to the batch ledger: the same roll-up over an append-only stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(ledger: DataFrame, late: str = "1 hour", width: str = "24 hours") -> DataFrame:
    """ledger: at (timestamp), purpose, cost. Calls and cost by purpose and window; rows later than ``late`` are not waited for."""
    return ledger.withWatermark("at", late).groupBy(F.window("at", width), "purpose").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost")).select(F.col("window.start").alias("begin"), "purpose", "calls", "cost")
