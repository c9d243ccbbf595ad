"""Streams in many batches, after restarts and failures, and with rows that come late."""

import datetime as dt
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.streaming import pipelines as P
from recollect.streaming import stateful as ST

UTC = dt.timezone.utc
DAY = dt.datetime(2024, 5, 1, tzinfo=UTC)
EVENT = "id long, agent string, ts timestamp"


def _at(minutes):
    return DAY + dt.timedelta(minutes=float(minutes))


def _run(spark, path, flags, out):
    with ST.versioned_state(spark):
        flags.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()


def test_rate_flags_over_batches_and_restarts(spark, tmp_path):
    """Ties of one second in one batch and in two, a late event that counts nowhere, and a restart between all batches."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rng = np.random.default_rng(2)
    events = [(i, f"a{i % 3}", _at(m)) for i, m in enumerate(np.sort(rng.integers(0, 600, 120)))] + [(500, "a0", _at(300)), (501, "a0", _at(300))]
    events.sort(key=lambda e: e[2])
    parts = [events[:50], events[50:90], [*events[90:], (900, "a0", _at(10))], [(1000, "end", DAY + dt.timedelta(days=99))]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{path}/{n}")
        _run(spark, path, ST.rate_flags(P.stream(spark, f"{path}/*", spark.createDataFrame([], EVENT).schema), "agent", "ts", "id", 3600, 4, "15 minutes"), out)
    got = {r.id: (r.recent, r.flagged, r.late) for r in spark.read.schema(ST.FLAG).parquet(out).collect()}
    assert spark.read.schema(ST.FLAG).parquet(out).count() == len(got)
    second = lambda e: int(e[2].timestamp())
    want = {}
    for e in events:
        n = sum(o[1] == e[1] and second(e) - 3600 <= second(o) <= second(e) for o in events) - 1
        want[e[0]] = (n, n >= 4, False)
    want[900] = (None, None, True)
    got.pop(1000, None)
    assert got == want and any(f for _, f, _ in want.values())


def test_a_lane_of_many_seconds_calls_its_timer_once(spark, tmp_path):
    """Keys of one lane keep apart, also at the ends of their time; a batch asks for one timer, not for one a second."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = [(100 * k + i, f"a{k}", _at(i)) for k in range(5) for i in range(40)] + [(1000, "end", DAY + dt.timedelta(days=99))]
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(f"{path}/0")
    flags = ST.rate_flags(P.stream(spark, f"{path}/*", spark.createDataFrame([], EVENT).schema), "agent", "ts", "id", 600, 4, "15 minutes", lanes=1)
    _run(spark, path, flags, out)
    got = {r.id: r.recent for r in spark.read.schema(ST.FLAG).parquet(out).collect()}
    assert got == {100 * k + i: min(i, 10) for k in range(5) for i in range(40)}

    class Handle:
        timers = []

        def getValueState(self, *_):
            return SimpleNamespace(exists=lambda: False, update=lambda row: None, clear=lambda: None)

        getListState = lambda self, *_: SimpleNamespace(appendList=lambda rows: None)
        registerTimer = timers.append

    flagger, rows = ST._RateFlags(600, 4), pd.DataFrame({"key": "a", "id": range(40), "ms": np.arange(40) * 60_000})
    flagger.init(Handle())
    assert list(flagger.handleInputRows((0,), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == [] and Handle.timers == [1000]


def test_state_in_a_session_that_sets_no_number_of_partitions(spark):
    """Spark's own number counts there, and the session sets none afterwards either."""
    session, name = spark.newSession(), "spark.sql.shuffle.partitions"
    session.conf.unset(name)
    own = int(session.conf.get(name))
    with ST.versioned_state(session):
        assert int(session.conf.get(name)) == min(own, spark.sparkContext.defaultParallelism)
    assert session.conf.get(name, None) is None and int(session.conf.get(name)) == own


def _slices(spark, path, slices, start):
    for n, ids in enumerate(slices):
        spark.createDataFrame([(i, "a", _at(m)) for i, m in ids], EVENT).coalesce(1).write.parquet(f"{path}/{n}")
        start(P.stream(spark, f"{path}/*", spark.createDataFrame([], EVENT).schema))


def test_late_rows_and_a_batch_that_is_run_again(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    slices = [[(1, 100), (2, 10)], [(3, 130), (4, 89), (5, 91)], [(6, 119), (7, 120), (8, 200)]]
    original, fails = ST.W.names, []

    def start(stream):
        query = ST.split_late(stream, "ts", "10 minutes", out)
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            fails.append(1)
            ST.split_late(stream, "ts", "10 minutes", out).awaitTermination()

    def names(spark, where):
        # the batch fails once, after it has read the marks of the others
        if not fails and original(spark, where):
            fails.append(0)
            raise RuntimeError("lost")
        return original(spark, where)

    monkeypatch.setattr(ST.W, "names", names)
    _slices(spark, path, slices, start)
    got = ST.split(spark, out)
    assert sum(fails) == 1 and got.count() == 8
    assert {r.id for r in got.filter("late").collect()} == {4, 6}


def test_compaction_writes_a_failed_batch_once(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, "a", _at(i)) for i in range(100)], EVENT).repartition(4).write.parquet(path)
    stream = P.stream(spark, path, spark.createDataFrame([], EVENT).schema, 2)
    P.compacted(stream, out, 30, f"{out}-state").awaitTermination()
    P.compacted(stream, out, 30, f"{out}-state").awaitTermination()
    # a batch that had written but not committed is run again
    import os

    last = max(int(n) for n in os.listdir(f"{out}-state/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.path.exists(f"{out}-state/commits/{name}") and os.remove(f"{out}-state/commits/{name}")
    P.compacted(stream, out, 30, f"{out}-state").awaitTermination()
    assert sorted(r.id for r in P.folded(spark, out).collect()) == list(range(100))
    assert max(r["count"] for r in P.folded(spark, out).groupBy(F.input_file_name()).count().collect()) <= 30


def test_filings_without_their_event(spark, tmp_path):
    at = DAY
    happened = [(1, at), (2, at), (3, at - dt.timedelta(days=3)), (5, at + dt.timedelta(hours=1)), (99, at + dt.timedelta(days=400))]
    filings = [(1, at + dt.timedelta(hours=1)), (2, at), (3, at), (4, at), (5, at), (98, at + dt.timedelta(days=400))]
    for name, rows, schema in (("h", happened, "id long, ts timestamp"), ("f", filings, "id long, filed_at timestamp")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    streams = [P.stream(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema) for n in "hf"]
    got = {r.id: r.ts is not None for r in P.once(ST.filed(*streams, "2 days", "10 days")).collect()}
    assert {i: m for i, m in got.items() if i < 98} == {1: True, 2: True, 3: False, 4: False, 5: False}
