"""Generators over costly arrays.

For ``explode`` and ``inline`` the optimizer adds a filter on the array's size and
pushes it down, which works the array out a second time and, below a shuffle, in
another place.  The outer forms keep one evaluation; the filler rows of empty
arrays are dropped right after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def inline_rows(df: DataFrame, keep: list, structs: Column | str, not_null: str) -> DataFrame:
    """``keep`` columns and the fields of each struct; ``not_null`` names a field that is never null."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(not_null).isNotNull())


def explode_rows(df: DataFrame, keep: list, items: Column | str, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def explode_map(df: DataFrame, keep: list, entries: Column | str, key: str, value: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(entries).alias(key, value)).where(F.col(key).isNotNull())


def rows_with_any(df: DataFrame, array_col: str) -> DataFrame:
    """Rows whose array is not empty."""
    others = [c for c in df.columns if c != array_col]
    boxed = F.expr(f"IF(size(`{array_col}`) > 0, array(`{array_col}`), NULL)")
    return explode_rows(df, others, boxed, array_col).select(*df.columns)
