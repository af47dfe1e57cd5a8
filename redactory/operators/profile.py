"""Column profiling: which string columns hold free text or personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .. import fixed_values as fv
from ..functions import text as tx
from ..plans.spread import spread
from ..registry import DIGIT_PAIR


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def pii_screen(c: str | Column) -> Column:
    """Quick test for e-mail, social security number, phone or card.

    Each half of the pattern runs only behind a cheap test that its hits pass.
    """
    col = F.col(c) if isinstance(c, str) else c
    # For a yes or no the shortest local part and top level decide.
    mail = col.contains("@") & F.rlike(col, F.lit(r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}"))
    digits = F.rlike(col, F.lit(DIGIT_PAIR)) & F.rlike(col, F.lit(fv.QUICK_SCREEN_DIGITS))
    return F.coalesce(mail | digits, F.lit(False))


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per string column: non-null rows, mean words, screen hits, chosen flag.

    One aggregate over all columns, then unpivoted; no row leaves its task.
    """
    columns = string_columns(df) if columns is None else columns
    if not columns:
        raise ValueError("the table has no string columns")
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(F.col(c)).alias(f"n{i}"),
                 F.sum(F.expr(tx.count_words(f"`{c}`"))).alias(f"w{i}"),
                 F.count_if(pii_screen(c)).alias(f"h{i}")]
    one = spread(df.select(*columns)).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                              F.col(f"n{i}").alias("non_null"), F.col(f"w{i}").alias("words"),
                              F.col(f"h{i}").alias("screen_hits")) for i, c in enumerate(columns)])
    return _judge(one.select(F.inline(rows)))


def _judge(stats: DataFrame) -> DataFrame:
    mean = F.when(F.col("non_null") > 0, F.col("words") / F.col("non_null"))
    return (stats.withColumn("mean_words", mean)
            .withColumn("chosen", F.coalesce(
                (F.col("mean_words") >= fv.TEXT_COLUMN_MIN_WORDS) | (F.col("screen_hits") > 0), F.lit(False)))
            .select("position", "column", "non_null", F.round("mean_words", 6).alias("mean_words"),
                    "screen_hits", "chosen"))


def sampled_profile(df: DataFrame, key: str, sample: int = fv.TEXT_COLUMN_SAMPLE) -> DataFrame:
    """The same profile over the first ``sample`` non-null values of each column in key order.

    One small top-k per column, each reading only that column and the key.
    """
    columns = [c for c in string_columns(df) if c != key]
    if not columns:
        raise ValueError("the table has no string columns")
    tops = [df.select(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).alias("value"), F.col(key))
            .where(F.col("value").isNotNull()).orderBy(key).limit(sample).drop(key)
            for i, c in enumerate(columns)]
    values = reduce(DataFrame.unionAll, tops)
    return _judge(values.groupBy("position", "column").agg(
        F.count("value").alias("non_null"), F.sum(F.expr(tx.count_words("value"))).alias("words"),
        F.count_if(pii_screen("value")).alias("screen_hits")))


def choose_columns(profile: DataFrame) -> DataFrame:
    """Chosen columns; if none qualifies, the first eight string columns."""
    any_chosen = profile.agg(F.max(F.col("chosen").cast("int"))).scalar() == 1
    return (profile.where(F.when(any_chosen, F.col("chosen"))
                          .otherwise(F.col("position") < fv.TEXT_COLUMN_FALLBACK))
            .select("position", "column"))


def detect_text_columns(df: DataFrame, key: str | None = None,
                        sample: int | None = fv.TEXT_COLUMN_SAMPLE) -> list[str]:
    """Names of the columns to treat; without a key or a sample size, all rows are read."""
    profile = profile_columns(df) if key is None or sample is None else sampled_profile(df, key, sample)
    rows = sorted(profile.collect(), key=lambda r: r["position"])  # one row per column of the schema
    chosen = [r["column"] for r in rows if r["chosen"]]
    return chosen or [r["column"] for r in rows][:fv.TEXT_COLUMN_FALLBACK]
