"""Streaming operators run over stored tables until everything is read, so that their results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..streaming.threads import thread_states, windowed_counts
from .registry import query


@query("windowed_counts", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour by type."""
    w = windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@query("thread_state_stream", """
    WITH t AS (SELECT *, coalesce(thread_id, 'unknown_thread') AS thread FROM email_requests)
    SELECT thread, count(*) AS turn_count, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_updated, arg_max(lang, (received_at, request_id)) FILTER (WHERE lang IS NOT NULL) AS lang FROM t GROUP BY 1""")  # fmt: skip
def thread_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The mails as a stream through keyed state, to the end; the last state of every thread."""
    at = shared_folder(spark, "stream")
    source = f"{d}/email_requests.parquet"
    schema = spark.read.parquet(source).schema
    src = spark.readStream.schema(schema).parquet(source if _is_folder(spark, source) else _folder_of(source))
    mails = src.select("request_id", F.col("thread_id").alias("thread"), "received_at", "subject", "lang")
    collected = f"{at}/out"

    def keep(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n)).write.mode("append").parquet(collected)

    q = thread_states(mails).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(collected).groupBy("thread").agg(F.max_by(F.struct("turn_count", "last_updated", "lang"), "batch").alias("s"))
    return last.select("thread", "s.turn_count", F.date_format("s.last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "s.lang")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _folder_of(path: str) -> str:
    """A single file as a pattern that a stream can watch."""
    head, _, name = path.rpartition("/")
    return f"{head}/{name[:-1]}[{name[-1]}]"


