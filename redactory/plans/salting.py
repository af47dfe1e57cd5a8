"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .sizing import measured_small

SALTS = 16


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, spread_by: str | list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join facts to a lookup with unique keys.

    A lookup measured small is broadcast.  Otherwise both sides are shuffled on
    (key, salt): each fact row takes one salt from ``spread_by`` and each lookup
    row is repeated once per salt, so a hot key is split over ``salts`` tasks.
    The shuffle is asked for: Spark judges the lookup by its compressed file and
    without its repetitions, and would gather it on the driver for a broadcast.
    """
    if measured_small(lookup):
        return facts.join(F.broadcast(lookup), key, how)
    return salted_join(facts, lookup, key, spread_by, how, salts)


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, spread_by: str | list[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    by = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
