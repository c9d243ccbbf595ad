"""Rate flags kept as state, rows that come too late, and events joined with their filing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recollect.sources import work as W

FLAG = "key string, id long, recent long, flagged boolean, late boolean"
_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
#: Keys are dealt into so many lanes, each with a state and timers of its own; fixed for the life of a stream.
LANES = 1024


@contextmanager
def versioned_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which processors with timers need, in a store for each core: every
    store costs the same in each batch, however little it holds."""
    had = {name: spark.conf.get(name, None) for name in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # asked for without a default: a session that sets no number has Spark's own, not None
    spark.conf.set(_PARTITIONS, str(min(int(spark.conf.get(_PARTITIONS)), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for name, value in had.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _RateFlags(StatefulProcessor):
    """State of a lane of keys: how many events each key had in each second that may still count, and the events not yet
    flagged. All events whose second is whole are flagged at once, so a batch costs a lane the same few calls to its state
    however many keys and seconds it has."""

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "key array<string>, second array<long>, n array<long>")
        self.waiting = handle.getValueState("waiting", "key array<string>, second array<long>, id array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = [self._held(self.waiting, "id")]
        for pdf in rows:
            late = pdf["ms"].to_numpy() < mark
            if late.any():
                yield self._told(pdf[late], pd.array([None] * int(late.sum()), "Int64"), True)
            new = pdf[~late]
            waiting.append(pd.DataFrame({"key": new["key"], "second": new["ms"].to_numpy() // 1000, "id": new["id"]}))
        self._wait(pd.concat(waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() // 1000 - 1  # the last second that is whole
        waiting = self._held(self.waiting, "id")
        due = waiting["second"].to_numpy() <= done
        if not due.any():
            return
        now = waiting[due]
        counts = pd.concat([self._held(self.counts, "n"), now[["key", "second"]].assign(n=1)]).groupby(["key", "second"], sort=False, dropna=False)["n"].sum().reset_index()
        # one axis for all keys: each key's seconds lie apart from the next one's by more than the span that counts
        codes = pd.factorize(pd.concat([counts["key"], now["key"]]), use_na_sentinel=False)[0].astype(np.int64)
        least = counts["second"].min()
        place = codes * (int(counts["second"].max() - least) + self.seconds + 1) + (pd.concat([counts["second"], now["second"]]).to_numpy() - least)
        held, asked = place[: len(counts)], place[len(counts) :]
        order = np.argsort(held, kind="stable")
        before = np.concatenate([[0], np.cumsum(counts["n"].to_numpy()[order])])
        recent = before[np.searchsorted(held[order], asked, "right")] - before[np.searchsorted(held[order], asked - self.seconds, "left")] - 1
        yield self._told(now, pd.array(recent, "Int64"), False)
        keep = counts[counts["second"].to_numpy() > done - self.seconds]
        self.counts.update(tuple(keep[c].tolist() for c in ("key", "second", "n")))
        self._wait(waiting[~due])

    def _wait(self, waiting: pd.DataFrame) -> None:
        if len(waiting):
            self.waiting.update(tuple(waiting[c].tolist() for c in ("key", "second", "id")))
            self.handle.registerTimer(int(waiting["second"].min() + 1) * 1000)  # when the watermark is there, the first second is whole
        else:
            self.waiting.clear()

    def _held(self, state, last: str) -> pd.DataFrame:
        key, second, rest = state.get() if state.exists() else ([], [], [])
        return pd.DataFrame({"key": pd.Series(list(key), dtype=object), "second": np.array(second, np.int64), last: np.array(rest, np.int64)})

    def _told(self, rows: pd.DataFrame, recent, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": rows["key"].to_numpy(), "id": rows["id"].to_numpy(), "recent": recent, "flagged": recent >= self.most, "late": late})

    def close(self) -> None:
        pass


def rate_flags(events: DataFrame, key: str, at: str, ident: str, seconds: int, count: int, delay: str, lanes: int = LANES) -> DataFrame:
    """``governance.rate_flags`` of a stream: (key, id, recent, flagged, late). An event is told of once, when the watermark
    has passed its second, so that all of its second and the ``seconds`` before are in; one that is behind the watermark
    as it comes counts nowhere and is told of as late. Start it inside ``versioned_state``."""
    timed = events.withWatermark(at, delay)
    # milliseconds in place of the instant: Spark drops late rows of an instant by itself
    rows = timed.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("id"), F.unix_millis(at).alias("ms"))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(lanes).cast("long")))
    return rows.groupBy("lane").transformWithStateInPandas(_RateFlags(seconds, count), FLAG, "append", "eventtime")


def split_late(events: DataFrame, at: str, delay: str, path: str):
    """Starts a stream that writes its rows below ``path``, on-time ones and those behind the watermark apart. The watermark
    of a batch is the greatest instant of the batches before it, less the delay. Each batch writes folders of its own
    number, the mark last, so one that is run again after a failure replaces what it wrote."""
    spark = events.sparkSession
    rows = f"{path}/rows"

    def write(batch: DataFrame, number: int) -> None:
        before = [n for n in W.names(spark, f"{path}/marks") if n.startswith("batch=") and int(n[6:]) < number]
        mark = spark.read.parquet(*(f"{path}/marks/{n}" for n in before)).agg(F.max("mark")).first()[0] if before else None
        told = F.lit(False) if mark is None else F.coalesce(F.col(at) < F.lit(mark).cast("timestamp") - F.expr(f"interval {delay}"), F.lit(False))
        batch.withColumn("late", told).write.mode("overwrite").partitionBy("late").parquet(f"{rows}/batch={number}")
        written = spark.read.schema(batch.schema).parquet(f"{rows}/batch={number}")
        written.agg(F.max(at).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def split(spark: SparkSession, path: str) -> DataFrame:
    """What ``split_late`` wrote: its rows, with ``late`` and the number of their batch."""
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def filed(events: DataFrame, filings: DataFrame, allowed: str, delay: str) -> DataFrame:
    """Streams of events (id, ts) and their filings (id, filed_at, ...), joined: (id, filed_at, ..., ts), with ts null where
    no event of the id lies within ``allowed`` before the filing. Both sides' state goes once the watermarks are past it."""
    left = filings.withWatermark("filed_at", delay)
    right = events.select(F.col("id").alias("_id"), "ts").withWatermark("ts", delay)
    near = (F.col("id") == F.col("_id")) & (F.col("ts") <= F.col("filed_at")) & (F.col("ts") >= F.col("filed_at") - F.expr(f"interval {allowed}"))
    return left.join(right, near, "left_outer").drop("_id")
