"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, FloatType, MapType, StringType, StructField, StructType,
                               TimestampNTZType, TimestampType)


def read_table(spark: SparkSession, path: str | list[str], fmt: str = "csv", schema: StructType | str | None = None,
               encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """A CSV, JSON, Parquet or ORC table.

    CSV has a header; without a schema its columns are strings, which is what
    redaction works on and needs no second pass over the files.  Large files are
    split over tasks.  Values with line breaks inside quotes need ``multiline``,
    which reads each file in one task.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return (reader.option("header", True).option("encoding", encoding).option("quote", '"')
                .option("escape", '"').option("multiLine", multiline).csv(path))
    if fmt == "json":
        return reader.option("encoding", encoding).json(path)
    if fmt in ("parquet", "orc"):
        return reader.format(fmt).load(path)
    raise ValueError(f"unsupported format: {fmt}")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks that hold plain values only."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (flat(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def rows_from_json(df: DataFrame, json_col: str, schema: StructType | str, keep: list[str] | None = None) -> DataFrame:
    """JSON documents as rows: keys become columns, ``_id`` is dropped, a document
    that is a bare value ends up in ``value``, an object that cannot be read in ``corrupt``."""
    known = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    bad = "_corrupt_document"
    read = F.from_json(json_col, StructType([*known.fields, StructField(bad, StringType())]),
                       {"columnNameOfCorruptRecord": bad})
    parsed = df.select(*(keep or []), F.col(json_col).alias("_raw"), read.alias("_doc"))
    fields = [c for c in known.fieldNames() if c != "_id"]
    is_object = F.col("_raw").rlike(r"^[ \t\r\n]*\{")
    return parsed.select(*(keep or []), *[F.col(f"_doc.`{c}`").alias(c) for c in fields],
                         F.when(~is_object, F.col("_raw")).alias("value"),
                         F.when(is_object, F.col(f"_doc.{bad}")).alias("corrupt"))


def to_json_rows(df: DataFrame, out_col: str = "document") -> DataFrame:
    """Every row as one JSON document: nulls and NaN become null, times become ISO text."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        cells.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias(out_col))


def list_payloads(df: DataFrame, payload_col: str, schema: StructType | str, order_col: str, descending: bool = False,
                  limit: int | None = None, tie: str = "id") -> DataFrame:
    """Records kept as JSON payloads: parsed, in order, optionally the first few."""
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    out = df.select(tie, order_col, F.from_json(payload_col, schema).alias("_p")).orderBy(order, tie)
    if limit is not None:
        if limit <= 0:
            raise ValueError("limit must be greater than 0")
        out = out.limit(limit)
    return out.select(tie, order_col, "_p.*")


def write_payloads(df: DataFrame, path: str, key: str, group_bytes: int = 16 << 20) -> None:
    """Keep records so that one key is found by reading few of them: files are ranges of the key, sorted inside.

    Row groups carry their smallest and largest key, which ``get_payload`` skips by.  Rows without a key come first.
    """
    (df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
     .option("parquet.block.size", group_bytes).parquet(path))


def get_payload(df: DataFrame, payload_col: str, schema: StructType | str, key: str, value) -> DataFrame:
    """The parsed payload of one key; none for an unknown or null key, and one row per row that has it.

    The comparison is pushed to the scan: on a table from ``write_payloads`` only row groups that can hold the key are read.
    """
    return df.where(F.col(key) == F.lit(value)).select(key, F.from_json(payload_col, schema).alias("_p")).select(key, "_p.*")


def where_json(df: DataFrame, payload_col: str, path: str, value: str) -> DataFrame:
    """Rows whose payload has a value at a JSON path."""
    return df.where(F.get_json_object(payload_col, path) == value)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def preview(df: DataFrame, key: str, n: int = 50) -> DataFrame:
    """First rows in key order, nulls in text shown as empty."""
    return df.orderBy(key).limit(n).na.fill("")
