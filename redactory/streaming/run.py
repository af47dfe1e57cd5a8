"""Running a stream over what is available now, into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import work_dir


def stream_of(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of Parquet files as a stream: one file, or a folder of parts under the table's name."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        folder = path
    else:
        reader = reader.option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_appending(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end of the available data; rows are appended as they become final."""
    spark = stream.sparkSession
    base = work_dir(spark, name)
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_updating(stream: DataFrame, name: str, *keys: str) -> DataFrame:
    """Run an update-mode aggregate; each batch is one folder, and the newest row per key counts.

    A batch that is run again replaces its own folder.
    """
    spark = stream.sparkSession
    base = work_dir(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    fields = stream.columns
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r"))
    return newest.select("r.*")


def run_summing(stream: DataFrame, name: str, keys: list[str], value: str) -> DataFrame:
    """Run an append-mode stream to the end of the available data, its values summed per key and batch.

    A batch that is run again replaces its own folder.
    """
    spark = stream.sparkSession
    base = work_dir(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias(value)).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (stream.writeStream.outputMode("append").foreachBatch(write)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
