"""Due review appointments: each fires once, at the first run at or after its time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.when import as_moment, ntz
from ..plans.salting import lookup_join


def due_appointments(appts: DataFrame, as_of: datetime | str) -> DataFrame:
    """Scheduled appointments whose time has come."""
    return appts.where((F.col("status") == "scheduled") & (F.col("scheduled_for") <= ntz(as_moment(as_of))))


def fire(due: DataFrame, cards: DataFrame) -> dict[str, DataFrame]:
    """What follows from due appointments: card moves, completed appointments, audit rows."""
    linked = due.where(F.col("pipeline_card_id").isNotNull()).select(
        F.col("id").alias("appt_id"), F.col("title").alias("appt_title"), F.col("pipeline_card_id").alias("card_id"))
    waiting = cards.where(F.col("status") == "in_progress").select(F.col("id").alias("card_id"))
    advanced = lookup_join(linked, waiting, "card_id", "appt_id")
    # Several appointments may name one card; the card moves once.
    moves = advanced.groupBy("card_id").agg(F.min_by("appt_title", "appt_id").alias("appt_title"))
    card_rows = moves.select(
        F.lit("pipeline.advance").alias("action"), F.lit("card").alias("resource_type"),
        F.col("card_id").alias("resource_id"),
        F.concat(F.lit("Auto-advanced to Review via appointment '"), "appt_title", F.lit("'")).alias("details"))
    appt_rows = due.select(
        F.lit("appointment.due").alias("action"), F.lit("appointment").alias("resource_type"),
        F.col("id").alias("resource_id"),
        F.concat(F.lit("Appointment '"), "title", F.lit("' came due — actions executed")).alias("details"))
    return {
        "card_changes": moves.select(F.col("card_id").alias("id"), F.lit("review").alias("status")),
        "appointment_changes": due.select("id", F.lit("completed").alias("status")),
        "audit": card_rows.unionByName(appt_rows),
    }
