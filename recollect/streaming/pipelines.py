"""Streaming counterparts: sweeping new files, windows with late data, rate limits and a ring of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions import hashing as H
from recollect.functions import text as X
from recollect.sources import work as W


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(df: DataFrame, mode: str = "append", key: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives what it wrote to the shared folder: every batch's rows
    (append), the last batch (complete), or each key's rows of the last batch that had it (update)."""
    spark = df.sparkSession
    path = W.fresh(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    if not W.names(spark, path):
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    elif mode == "update":
        rows = rows.join(rows.groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_last")), (F.col(key) == F.col("_key")) & (F.col("batch") == F.col("_last"))).drop("_key", "_last")
    return rows.drop("batch")


def sweep(messages: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Messages (content) not seen within the delay, by fingerprint."""
    return messages.withColumn("fp", H.fingerprint(X.match_key(F.col("content")))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["fp"])


def tumbling(events: DataFrame, at: str, size: str, delay: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and keys; rows later than the delay are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, delay).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, delay: str, key: str) -> DataFrame:
    """Sessions of a key, closed by a gap."""
    out = events.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def rate_limited(requests: DataFrame, at: str, key: str, most: int, delay: str = "1 minute") -> DataFrame:
    """Keys and fixed minutes with more requests than allowed."""
    counted = requests.withWatermark(at, delay).groupBy(F.window(at, "1 minute"), key).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > most).select(F.col("window.start").alias("minute"), key, "n")


def ring(samples: DataFrame, key: str, size: int = 300) -> DataFrame:
    """The last ``size`` samples (ts, value) of each key, as their count, first and last instant and mean, after each batch."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [] if not state.exists else list(zip(*state.get, strict=True))
        for pdf in batches:
            held += [(int(t.value // 1000), float(v)) for t, v in zip(pd.to_datetime(pdf["ts"]), pdf["value"], strict=True)]
        held = sorted(held)[-size:]
        state.update(([t for t, _ in held], [v for _, v in held]))
        yield pd.DataFrame({"key": [k[0]], "n": [len(held)], "first_us": [held[0][0]], "last_us": [held[-1][0]], "mean": [sum(v for _, v in held) / len(held)]})

    return samples.groupBy(key).applyInPandasWithState(keep, "key string, n long, first_us long, last_us long, mean double", "ts array<long>, value array<double>", "update", GroupStateTimeout.NoTimeout)


def compacted(df: DataFrame, path: str, rows_per_file: int = 1_000_000, checkpoint: str | None = None):
    """Folds each micro-batch into few files in a folder of its number, so that a batch run again after a failure replaces
    what it wrote; ``folded`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}/_checkpoint").trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """What ``compacted`` wrote."""
    return spark.read.parquet(path).drop("batch")
