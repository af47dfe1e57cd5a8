"""Job telemetry from an event table (job_id, ts, seq, status, entities, rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed_values as fv
from ..plans.windows import previous_values, running_total


def _terminal(status: Column) -> Column:
    return F.upper(status).isin(fv.TERMINAL_JOB_STATUSES)


def status_transitions(events: DataFrame) -> DataFrame:
    return events.groupBy(F.upper("status").alias("status")).agg(F.count(F.lit(1)).alias("transitions"))


def job_durations(events: DataFrame) -> DataFrame:
    """Seconds from a job's first event to its first terminal event after that."""
    return (events.groupBy("job_id").agg(
        F.min("ts").alias("created"), F.min(F.when(_terminal(F.col("status")), F.col("ts"))).alias("closed"))
        .where(F.col("closed").isNotNull())
        .withColumn("duration_s", F.timestamp_diff("MICROSECOND", F.col("created"), F.col("closed")) / F.lit(1e6)))


def duration_histogram(durations: DataFrame, buckets: list[int] = fv.DURATION_BUCKETS) -> DataFrame:
    """Cumulative bucket counts; the last bucket has no upper limit."""
    limits = [*map(float, buckets), float("inf")]
    one = durations.agg(*[F.count_if(F.col("duration_s") <= b).alias(f"b{i}") for i, b in enumerate(limits)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"),
                              F.col(f"b{i}").alias("n")) for i, b in enumerate(limits)])
    return one.select(F.inline(rows))


def telemetry_totals(events: DataFrame) -> DataFrame:
    """Jobs seen, terminal events, entities and rows processed."""
    # Distinct jobs by a grouped pre-aggregate, so a hot job sends one row per task.
    per_job = events.groupBy("job_id").agg(
        F.count_if(_terminal(F.col("status"))).alias("t"), F.sum("entities").alias("e"), F.sum("rows").alias("r"))
    return per_job.agg(F.count(F.lit(1)).alias("jobs_created"), F.sum("t").alias("terminal_events"),
                       F.sum("e").alias("entities"), F.sum("r").alias("rows"))


def queue_depth(events: DataFrame) -> DataFrame:
    """Jobs whose latest status is that status."""
    latest = events.groupBy("job_id").agg(F.max_by(F.upper("status"), F.struct("ts", "seq")).alias("status"))
    return latest.groupBy("status").agg(F.count(F.lit(1)).alias("depth"))


def queue_depth_over_time(events: DataFrame) -> DataFrame:
    """Jobs in each status after every second in which one entered or left it.

    A change adds one to its own status and takes one from the job's previous one.
    """
    named = events.select("job_id", "seq", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
                          F.upper("status").alias("status"))
    moves = previous_values(named, "job_id", "seq", ["status"])
    steps = F.filter(F.array(
        F.struct(F.col("status").alias("status"), F.lit(1).alias("delta")),
        F.struct(F.col("prev_status").alias("status"), F.lit(-1).alias("delta"))), lambda s: s["status"].isNotNull())
    return depth_of_moves(moves.select("ts", F.inline(steps)))


def depth_of_moves(moves: DataFrame) -> DataFrame:
    """Running depth of each status from moves (status, ts, delta) in any order, one row per second with a move."""
    netted = moves.groupBy("status", "ts").agg(F.sum("delta").alias("delta"))
    return running_total(netted, ["status"], F.to_date("ts"), "ts", "delta", "depth").select("status", "ts", "depth")


def rates(events: DataFrame, width: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Events per second in fixed windows, per status."""
    return (events.groupBy(F.window("ts", width).alias("w"), F.upper("status").alias("status"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "status", "n",
                    F.round(F.col("n") / F.lit(seconds), 6).alias("per_second")))


QUANTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
BIN_BITS = 6  # of a number's leading bits that name its bin


def value_bin(ms: Column) -> Column:
    """A coarse bin that keeps the order: the position of the first bit and the ``BIN_BITS`` after it.

    Some 64 * 2^6 bins at most, whatever the values; small values have a bin each.
    """
    bits = F.length(F.bin(F.greatest(ms, F.lit(1))))
    drop = F.greatest(bits - 1 - BIN_BITS, F.lit(0))
    return F.when(ms <= 0, F.lit(-1)).otherwise(drop * (1 << (BIN_BITS + 1)) + F.call_function("shiftright", ms, drop))


def duration_quantiles(durations: DataFrame) -> DataFrame:
    """Exact p50, p95 and p99 of job durations in whole milliseconds, interpolated between the two nearest ranks.

    Durations are counted by coarse bin first; the bins that hold the wanted ranks are known from those few counts, and
    only their values are counted one by one.  Where bins hold very many different values, no task gets more than those
    of a bin's value range.  No durations give one row without quantiles.
    """
    ms = F.round(F.col("duration_s") * 1000, 0).cast("bigint")
    counts = (durations.select(ms.alias("ms")).where("ms IS NOT NULL").groupBy("ms").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bin", value_bin(F.col("ms"))))
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"))
    earlier = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # a row a bin
    placed = bins.select("bin", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                         F.sum("n").over(W.partitionBy()).alias("jobs"))
    place = F.col("q.at") * (F.col("jobs") - 1)
    asked = placed.withColumn("q", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(at).alias("at")) for name, at in QUANTILES]))).withColumn("side", F.explode(
            F.array(F.lit(0), F.lit(1)))).select(
        "bin", "before", "jobs", F.col("q.name").alias("name"), "side", place.alias("place"),
        F.when(F.col("side") == 0, F.floor(place)).otherwise(F.ceil(place)).alias("rank"), "n").where(
        "rank >= before AND rank < before + n").drop("n")
    # At most two bins a quantile; their values, with the ranks that each stands for.
    within = W.partitionBy("name", "side").orderBy("ms").rowsBetween(W.unboundedPreceding, W.currentRow)
    values = counts.join(F.broadcast(asked), "bin").withColumn("last", F.col("before") + F.sum("n").over(within)).where(
        "rank < last AND rank >= last - n")
    ends = values.groupBy("name").agg(
        F.max("jobs").alias("jobs"), F.max("place").alias("place"), F.max(F.when(F.col("side") == 0, F.col("ms"))).alias("low"),
        F.max(F.when(F.col("side") == 1, F.col("ms"))).alias("high"))
    exact = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    return ends.withColumn("value", F.round(exact / 1000, 6)).agg(
        F.coalesce(F.max("jobs"), F.lit(0)).alias("jobs"),
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name, _ in QUANTILES])
