"""Streams: state of mail threads, and ingestion of what isn't stored yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "turn_count long, last_updated timestamp, subject string, subject_at timestamp, lang string, lang_at timestamp"
OUTPUT = "thread string, turn_count long, last_updated timestamp, subject string, lang string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds a micro-batch's mails to a thread's state: counts turns, keeps the latest time and the latest non-null fields."""
    if state.hasTimedOut:
        state.remove()
        return
    n, at, subject, subject_at, lang, lang_at = state.get if state.exists else (0, None, None, None, None, None)
    for rows in batches:  # one Arrow batch at a time, in any order
        n += len(rows)
        newest = rows["received_at"].max()
        at = newest if at is None or newest > at else at
        for field in ("subject", "lang"):
            known = rows[rows[field].notna()]
            if len(known):
                last = known.sort_values(["received_at", "request_id"], kind="stable").iloc[-1]
                if field == "subject" and (subject_at is None or last["received_at"] >= subject_at):
                    subject, subject_at = last["subject"], last["received_at"]
                elif field == "lang" and (lang_at is None or last["received_at"] >= lang_at):
                    lang, lang_at = last["lang"], last["received_at"]
    state.update((n, at, subject, subject_at, lang, lang_at))
    yield pd.DataFrame({"thread": [key[0]], "turn_count": [n], "last_updated": [at], "subject": [subject], "lang": [lang]})


def thread_states(mails: DataFrame, retention_days: int | None = None) -> DataFrame:
    """The state of each thread after every micro-batch that touches it (update mode).

    mails: a stream of request_id, thread, received_at, subject, lang; a null thread counts as unknown_thread. A thread's
    state is one small row, and its mails are read an Arrow batch at a time. With retention_days, a thread
    that is silent for so long by event time is forgotten.
    """
    m = mails.select("request_id", F.coalesce("thread", F.lit("unknown_thread")).alias("thread"), "received_at", "subject", "lang")
    if retention_days:
        m = m.withWatermark("received_at", f"{retention_days} days")
    advance = _advance
    if retention_days:

        def advance(key, batches, state):  # noqa: ANN001, ANN202
            yield from _advance(key, batches, state)
            if state.exists:
                state.setTimeoutTimestamp(int(state.get[1].timestamp() * 1000) + retention_days * 86_400_000 + 1)

    timeout = GroupStateTimeout.EventTimeTimeout if retention_days else GroupStateTimeout.NoTimeout
    return m.groupBy("thread").applyInPandasWithState(advance, OUTPUT, STATE, "update", timeout)


def ingest_new(stream: DataFrame, stored_path: str, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A stream writer that appends rows with a key not yet stored; `prepare` (an embedding model, say) sees these only.

    Each micro-batch is reduced to one row a key and anti-joined with the stored keys first; a batch that is repeated after
    a failure finds its rows stored and adds none.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.where(F.col(key).isNotNull()).dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored_path)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "*.parquet")):  # something is stored: of it only the keys are read
            fresh = fresh.join(spark.read.parquet(stored_path).select(key), key, "left_anti")
        prepare(fresh).write.mode("append").parquet(stored_path)

    return stream.writeStream.foreachBatch(batch)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows; rows later than `late` are dropped. Spark's own operator, for batch and stream."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    return w.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
