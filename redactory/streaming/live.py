"""Structured Streaming forms of redaction, counts, telemetry, progress and due reviews."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from .. import fixed_values as fv
from ..operators.detect import detect, detections
from ..operators.job import deidentify, newest_by_source
from ..operators.reviews import fire
from ..policy import Policy


def deidentify_stream(stream: DataFrame, columns: list[str], policy: Policy) -> DataFrame:
    """Stateless: the same projection as on a table."""
    return deidentify(stream, columns, policy)


def live_entity_counts(stream: DataFrame, text_col: str, ts: str, policy: Policy, width: str = "1 hour",
                       slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Detections per window and entity type; a window is final once the watermark passes it."""
    found = detections(detect(stream.withWatermark(ts, lateness), text_col, policy.but(explain=False)), [ts])
    return _windowed(found, ts, width, slide, ["entity_type"])


def live_event_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "1 hour", slide: str | None = None,
                      lateness: str = "10 minutes") -> DataFrame:
    """Rows per window and key, for audit rows and job events alike."""
    return _windowed(stream.withWatermark(ts, lateness), ts, width, slide, keys)


def _windowed(stream: DataFrame, ts: str, width: str, slide: str | None, keys: list[str]) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (stream.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"))


def live_progress(stream: DataFrame) -> DataFrame:
    """Newest progress record per job and source; run in update mode, and read with ``job.merge_progress``."""
    return newest_by_source(stream)


_MOVES = "status string, at long, delta int"
_JOB_STATE = "seqs string, pruned boolean"


def _moves(history: list[list]) -> Counter:
    """Moves of a job's events ``[seq, second, status]`` in order: into each status, out of the one before."""
    steps = [(status, at, 1) for _, at, status in history]
    steps += [(before[2], after[1], -1) for before, after in zip(history, history[1:])]
    return Counter(steps)


def live_queue_moves(events: DataFrame, lateness: str = "1 hour", remember_days: int | None = None) -> DataFrame:
    """Moves ``(status, ts, delta)`` of jobs between statuses, for ``telemetry.depth_of_moves`` and sums per status.

    ``events`` is a stream ``(job_id, seq, ts, status)``; statuses are upper-cased and moves are dated to the second.
    An event adds one to its status and takes one from the status before it by ``seq``.  One that arrives out of
    order takes back what its neighbours have sent and sends what they should have, so the sums are those of the
    ordered events.  A repeated (job_id, seq) changes nothing, nor does a row without one of its four values.

    Each job keeps its events of the last ``lateness`` before the newest event seen, and one before them; an event
    older than that one by ``seq`` changes nothing.  With ``remember_days`` a job is forgotten so long after its last
    event while its status is final; by default one event a job is kept for good.
    """
    remember = None if remember_days is None else remember_days * 86_400_000

    def recent(history: list[list], now: int) -> tuple[list[list], bool]:
        past = 0
        while past < len(history) and history[past][1] * 1000 < now:
            past += 1
        return history[max(past - 1, 0):], past > 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentWatermarkMs()
        text, pruned = state.get if state.exists else ("[]", False)
        held, cut = recent(json.loads(text), now)
        pruned = pruned or cut
        known = {event[0]: event for event in held}
        oldest = held[0][0] if pruned else None
        for batch in batches:
            for seq, at, status in zip(batch["seq"].tolist(), batch["at"].tolist(), batch["status"].tolist()):
                if oldest is None or seq > oldest:
                    known.setdefault(seq, [seq, at, status])
        history = [known[seq] for seq in sorted(known)]
        old, new = _moves(held), _moves(history)
        rows = [(status, at, delta) for (status, at, delta) in (new - old).elements()]
        rows += [(status, at, -delta) for (status, at, delta) in (old - new).elements()]
        history, cut = recent(history, now)
        state.update((json.dumps(history), pruned or cut))
        if remember is not None and history[-1][2] in fv.TERMINAL_JOB_STATUSES:
            state.setTimeoutTimestamp(max(history[-1][1] * 1000, now) + remember)
        if rows:
            yield pd.DataFrame(rows, columns=["status", "at", "delta"])

    second = "unix_seconds(date_trunc('second', cast(ts as timestamp)))"
    timed = events.where("job_id IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL").withWatermark(
        "ts", lateness).selectExpr("job_id", "cast(seq as long) AS seq", f"{second} AS at", "upper(status) AS status", "ts")
    moves = _behind_the_clock(timed).groupBy("job_id").applyInPandasWithState(step, _MOVES, _JOB_STATE, "append",
                                                                              "EventTimeTimeout")
    return moves.select("status", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "delta")


def _behind_the_clock(timed: DataFrame) -> DataFrame:
    """Spark drops rows whose event time is behind the clock.  The clock has read it by now, so none is left to judge by."""
    return timed.withColumn("ts", F.lit(None).cast("timestamp").alias("ts", metadata=timed.schema["ts"].metadata))


_REVIEW = "id string, title string, pipeline_card_id string"
_REVIEW_STATE = "held string"
BUCKETS = 1024


def fire_when_due(appointments: DataFrame, lateness: str = "10 minutes", remember_days: int | None = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """Appointments at the moment they come due: ``(id, title, pipeline_card_id)``.

    ``appointments`` is a stream of versions ``(id, title, pipeline_card_id, scheduled_for, status, seq, ts)``.  The
    newest version by ``seq`` counts, however far its ``ts`` is behind; ``ts`` only drives the clock, which trails the
    newest one by ``lateness``.  Each id keeps one version and a time, so an appointment that arrives early fires
    later, one that arrives late fires at once, and one that was cancelled or moved does not fire at its old time.
    After firing or cancelling, an id is remembered for good: a repeated row may arrive at any time.  With
    ``remember_days`` it is forgotten so long after its time, and a row that arrives later counts as a new id.
    Without a time it never fires; a row without ``seq`` changes nothing.

    The ids are kept together by hash, in ``buckets`` states with one timer each, because a Python call costs
    milliseconds and an id microseconds.  The number is fixed for the life of a checkpoint; a batch reads and writes the
    states of its ids' buckets whole, so take more for more than some ten million ids.
    """
    remember = None if remember_days is None else remember_days * 86_400_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = {i: rest for i, *rest in json.loads(state.get[0])} if state.exists else {}
        text = lambda v: v if isinstance(v, str) else None
        seen = set()
        if not state.hasTimedOut:
            for batch in batches:
                for i, title, card, due, status, seq in zip(*(batch[c].tolist() for c in (
                        "id", "title", "pipeline_card_id", "due", "status", "seq"))):
                    seen.add(i)
                    if i not in held or seq > held[i][0]:
                        held[i] = [seq, text(title), text(card), due, text(status), None]
        fired, timers = [], []
        for i, row in list(held.items()):
            _, title, card, due, status, forget = row
            if status == "scheduled" and 0 <= due <= now:
                fired.append((i, title, card))
                status = row[4] = "fired"
                seen.add(i)
            if status == "scheduled" and due > now:
                timers.append(due)
            elif remember is not None:
                if i in seen or forget is None:
                    forget = row[5] = max(due, now) + remember
                if forget <= now:
                    del held[i]
                else:
                    timers.append(forget)
        if not held:
            state.remove()
        else:
            state.update((json.dumps([[i, *row] for i, row in held.items()]),))
            if timers:
                state.setTimeoutTimestamp(min(timers))
        if fired:
            yield pd.DataFrame(fired, columns=["id", "title", "pipeline_card_id"])

    timed = appointments.where("id IS NOT NULL AND seq IS NOT NULL").withWatermark("ts", lateness).selectExpr(
        f"pmod(xxhash64(id), {buckets}) AS bucket", "id", "title", "pipeline_card_id",
        "coalesce(unix_millis(cast(scheduled_for as timestamp)), -1) AS due", "status", "cast(seq as long) AS seq", "ts")
    return _behind_the_clock(timed).groupBy("bucket").applyInPandasWithState(step, _REVIEW, _REVIEW_STATE, "append",
                                                                             "EventTimeTimeout")


def watch_due_appointments(appointments: DataFrame, cards: Callable[[], DataFrame],
                           write: Callable[[str, DataFrame, int], None]) -> Callable[[str], StreamingQuery]:
    """What follows from appointments as they come due (see ``fire_when_due``).

    Every batch joins the current cards.  ``write(name, rows, batch_id)`` must be idempotent per batch id.
    Returns a function that starts the query with a checkpoint location.
    """
    due = fire_when_due(appointments)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # three outputs of one batch
        for name, rows in fire(kept, cards()).items():
            write(name, rows, batch_id)
        kept.unpersist()

    def start(checkpoint: str) -> StreamingQuery:
        return (due.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())

    return start
