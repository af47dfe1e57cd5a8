"""Size-checked choices between broadcast and shuffle plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A build side is broadcast only when a count proves that it is within both bounds.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 16 * 1024 * 1024


def measured_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """One distributed aggregate: are the rows and their string bytes within bounds?"""
    widths = [F.coalesce(F.octet_length(F.col(f"`{n}`").cast("string")), F.lit(0)) + 16 for n in df.columns]
    total = widths[0]
    for w in widths[1:]:
        total = total + w
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def small_side(df: DataFrame, **bounds) -> DataFrame:
    """The frame with a broadcast hint if measured small, else unchanged."""
    return F.broadcast(df) if measured_small(df, **bounds) else df
