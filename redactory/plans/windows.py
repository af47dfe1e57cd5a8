"""Window computations that stay bounded when one key holds most of the rows.

A plain window over a hot key sorts the whole key in one task.  Here a key is cut
into buckets of consecutive sequence numbers (or days); the window runs inside a
bucket, and a second, much smaller window carries values between buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEQ_BUCKET = 100_000


def previous_values(df: DataFrame, key: str, seq: str, values: list[str],
                    bucket: int = SEQ_BUCKET) -> DataFrame:
    """Add ``prev_<value>``: the last non-null value of the key before the row.

    ``seq`` is a unique integer order, so a bucket never holds more than
    ``bucket`` rows of a key.
    """
    cut = df.withColumn("_b", F.floor(F.col(seq) / F.lit(bucket)).cast("bigint"))
    inside = W.partitionBy(key, "_b").orderBy(seq)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    local = cut.select("*", *[F.last(v, ignorenulls=True).over(before).alias(f"_in_{v}") for v in values])

    ends = cut.groupBy(key, "_b").agg(*[
        F.max(F.when(F.col(v).isNotNull(), F.struct(seq, v))).alias(f"_end_{v}") for v in values]).select(
        key, "_b", *[F.col(f"_end_{v}.{v}").alias(v) for v in values])
    earlier = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        key, "_b", *[F.last(v, ignorenulls=True).over(earlier).alias(f"_carry_{v}") for v in values])

    carried = carried.withColumnsRenamed({key: "_key", "_b": "_bucket"})
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")), "left")
    return joined.select(*df.columns, *[
        F.coalesce(f"_in_{v}", f"_carry_{v}").alias(f"prev_{v}") for v in values])


def running_clamped_sum(df: DataFrame, ts: str, delta: str, out: str) -> DataFrame:
    """Running sum of ``delta`` in time order that is held at zero from below.

    ``ts`` must be unique.  clamped = S - least(0, running minimum of S), so it
    needs a running sum and a running minimum.  Both are worked out inside a day
    and carried between days, whose number is small.
    """
    cut = df.withColumn("_day", F.to_date(ts))
    inside = W.partitionBy("_day").orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = (cut.withColumn("_s", F.sum(delta).over(inside))
             .withColumn("_m", F.min("_s").over(inside)))
    days = local.groupBy("_day").agg(F.sum(delta).alias("_t"), F.min("_s").alias("_low"))
    before = W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carry = (days.withColumn("_s0", F.coalesce(F.sum("_t").over(before), F.lit(0)))
             .withColumn("_m0", F.min(F.col("_s0") + F.col("_low")).over(before))
             .select("_day", "_s0", "_m0"))
    both = local.join(carry, "_day")
    total = F.col("_s0") + F.col("_s")
    low = F.least(F.coalesce("_m0", F.lit(0)), F.col("_s0") + F.col("_m"), F.lit(0))
    return both.withColumn(out, total - low).select(*df.columns, out)


def running_total(df: DataFrame, keys: list[str], day: Column, ts: str, delta: str, out: str) -> DataFrame:
    """Running sum per key in time order, cut by day; ``ts`` unique per key."""
    cut = df.withColumn("_day", day)
    inside = W.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut.withColumn("_s", F.sum(delta).over(inside))
    days = cut.groupBy(*keys, "_day").agg(F.sum(delta).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carry = days.select(*keys, "_day", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s0"))
    return (local.join(carry, [*keys, "_day"])
            .withColumn(out, F.col("_s0") + F.col("_s")).select(*df.columns, out))
