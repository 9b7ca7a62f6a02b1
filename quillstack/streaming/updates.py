"""The change log as a stream.  An extension: catalogues themselves are batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, fingerprint: Column, time: str, lateness: str = "1 day") -> DataFrame:
    """Events once for each fingerprint within the watermark; later repeats of what state has forgotten pass again."""
    return events.withColumn("fingerprint", fingerprint).withWatermark(time, lateness).dropDuplicatesWithinWatermark(["fingerprint"])


def counts_by_window(events: DataFrame, time: str, kind: str, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(start, kind, n) of tumbling windows; rows later than the watermark are dropped."""
    n = events.withWatermark(time, lateness).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("start"), kind, "n")


def append_each_batch(stream: DataFrame, path: str, checkpoint: str, key: str = "fingerprint"):
    """Append to a log at path what it doesn't hold yet, batch by batch; a repeated batch adds nothing (INC-06, INC-08)."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
