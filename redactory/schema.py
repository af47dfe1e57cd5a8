"""Record schemas."""

from pyspark.sql import types as T

SPAN_DDL = (
    "struct<entity_type:string,start:int,`end`:int,score:double,"
    "text:string,recognizer:string,rationale:string>"
)
SPANS_DDL = f"array<{SPAN_DDL}>"

SPAN = T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("recognizer", T.StringType()),
    T.StructField("rationale", T.StringType()),
])

SESSION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("original_text", T.StringType()),
    T.StructField("anonymized_text", T.StringType()),
    T.StructField("entities", T.ArrayType(SPAN)),
    T.StructField("entity_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("operator", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("pipeline_card_id", T.StringType()),
    T.StructField("processing_ms", T.DoubleType()),
])

CARD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("card_type", T.StringType()),
    T.StructField("data_source", T.StringType()),
    T.StructField("assignee", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("session_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("done_at", T.TimestampNTZType()),
    T.StructField("attestation", T.StringType()),
    T.StructField("attested", T.BooleanType()),
    T.StructField("attested_by", T.StringType()),
    T.StructField("attested_at", T.TimestampNTZType()),
    T.StructField("scenario_id", T.StringType()),
    T.StructField("job_id", T.StringType()),
])

APPOINTMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("scheduled_for", T.TimestampNTZType()),
    T.StructField("duration_mins", T.IntegerType()),
    T.StructField("attendees", T.ArrayType(T.StringType())),
    T.StructField("pipeline_card_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

AUDIT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("actor", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("resource_type", T.StringType()),
    T.StructField("resource_id", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("severity", T.StringType()),
])

PROGRESS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("pct", T.DoubleType()),
    T.StructField("processed", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("ts", T.StringType()),
    T.StructField("updated_at", T.DoubleType()),
])

CHANGE_FEED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("op", T.StringType()),
    T.StructField("payload", T.StringType()),
])
