"""Counts of arriving facts a time window, source and relation, from a stream with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.hotkeys import clean_key


def arrivals(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """start, source, relation, n. Rows later than `late` behind the newest are left out; works on tables as well."""
    x = stream.withWatermark("loaded_at", late) if stream.isStreaming else stream
    g = x.groupBy(F.window("loaded_at", window), clean_key("source").alias("source"), clean_key("relation").alias("relation")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "source", "relation", "n")
