"""Result records as a stream: windowed counts with a watermark, and the latest record per cell by foreachBatch.

Both run over all files that are there (trigger availableNow), keep their checkpoint in the shared folder, and leave a
table behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.records import latest, named
from netweave.session import work_dir


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of files as a stream, or a single file by way of its folder."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return stream.option("pathGlobFilter", place.getName()).parquet(str(place.getParent().toString()))
    return stream.parquet(path)


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Records and converged ones per calendar day of recording.

    In update mode: a batch puts out only the days it changed, state of days older than the watermark is dropped, and
    rows later than that no longer count. A day's last row holds; a batch that comes twice writes the same folder again.
    """
    root = work_dir(spark, "stream")
    rows = _stream(spark, path).withColumn("at", F.col("recorded_at").cast("timestamp")).where("at is not null").withWatermark("at", "365 days")
    counts = rows.groupBy(F.window("at", "1 day")).agg(F.count("*").alias("n_records"), F.count_if("converged").alias("n_converged"))

    def keep(batch: DataFrame, epoch: int) -> None:
        changed = batch.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_records", "n_converged")
        changed.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    last = out.groupBy("day").agg(F.max_by(F.struct("n_records", "n_converged"), "epoch").alias("last"))
    return last.select("day", "last.n_records", "last.n_converged")


def latest_cells(spark: SparkSession, path: str) -> DataFrame:
    """The latest record per cell, merged batch by batch; a batch that comes twice changes nothing."""
    root = work_dir(spark, "stream")
    columns = ["network", "mu", "recorded_at", "record_id", "iterations", "seconds"]

    def merge(batch: DataFrame, epoch: int) -> None:
        new = named(batch).select(*columns)
        if epoch:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{root}/state/{epoch - 1}"))
        latest(new).select(*columns).write.mode("overwrite").parquet(f"{root}/state/{epoch}")
        batch.sparkSession.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("append").parquet(f"{root}/epochs")

    _stream(spark, path).writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{root}/epochs").agg(F.max("epoch")).first()[0]
    return spark.read.parquet(f"{root}/state/{last}").select("network", "mu", "record_id", "iterations")
