"""Incremental ingest as a file stream: new files, one for each content, by batches that can be repeated."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is named and all runs in one process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared}/quire-stream" if shared else "file://" + tempfile.mkdtemp(prefix="quire-stream-")


def arrivals(spark: SparkSession, sf_dir: str, name: str, **options: object) -> DataFrame:
    """A table's files as a stream. The table is a folder, or one file, which a stream finds in the folder above."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def unique_contents(stream: DataFrame) -> DataFrame:
    """(doc_id, content_hash) of the first arrival of each content; the state keeps hashes only."""
    return stream.select("doc_id", F.sha2("text", 256).alias("content_hash")).dropDuplicates(["content_hash"])


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream = arrivals(spark, sf_dir, "documents", maxFilesPerTrigger=1)
    sink = unique_contents(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    q = sink.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema("doc_id long, content_hash string").parquet(f"{base}/out")


@query("stream_ingest", "SELECT sha256(text) AS content_hash FROM documents GROUP BY text")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_available(spark, sf_dir).select("content_hash")


@query("base_stream_tumbling", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def base_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capability of Spark, not of the blueprint: counts by day of an event stream.

    Every batch's changed windows are written under the batch's number, which a repeated batch overwrites; the last
    version of a window counts.
    """
    import uuid

    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream = arrivals(spark, sf_dir, "events")
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("w struct<start:timestamp,end:timestamp>, event_type string, count long, batch long").option("basePath", f"{base}/out").parquet(f"{base}/out")
    return out.groupBy(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type").agg(F.max_by("count", "batch").alias("n"))
