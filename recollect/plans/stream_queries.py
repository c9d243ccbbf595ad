"""Queries of record building and of the streaming pipelines run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import hashing as H
from recollect.functions import text as X
from recollect.operators import records as R
from recollect.plans.register import query
from recollect.sources import files
from recollect.sources import work as W
from recollect.sources.tables import spread, table
from recollect.streaming import pipelines as P
from recollect.streaming import stateful as ST


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1714550400) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.select("conv_id", "turn", X.speaker_label(F.lit(None).cast("string"), F.col("role")).alias("label"), "text", stamp.alias("timestamp"))


@query(r"""WITH RECURSIVE m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, upper(role[1]) || role[2:] || ': ' || text AS b FROM conversations),
f AS (SELECT conv_id, turn, i, b, 0 AS c, strlen(b) AS size FROM m WHERE i = 1
UNION ALL SELECT m.conv_id, m.turn, m.i, m.b, CASE WHEN f.size + strlen(m.b) + 2 <= 800 THEN f.c ELSE f.c + 1 END, CASE WHEN f.size + strlen(m.b) + 2 <= 800 THEN f.size + strlen(m.b) + 2 ELSE strlen(m.b) END FROM f JOIN m ON m.conv_id = f.conv_id AND m.i = f.i + 1)
SELECT conv_id, CAST(c AS BIGINT) AS chunk_index, min(turn) AS first_turn, max(turn) AS last_turn, strftime(TIMESTAMP '2024-05-01 08:00:00' + to_hours(conv_id) + to_minutes(min(turn)), '%Y-%m-%dT%H:%M:%SZ') AS started_at, string_agg(b, chr(10) || chr(10) ORDER BY i) AS content FROM f GROUP BY conv_id, c""")
def q_chunk_exchanges(spark, sf_dir):
    """Conversations packed into chunks on message boundaries."""
    return R.exchanges(_turns(spark, sf_dir))


@query()
def q_mine(spark, sf_dir):
    """Records mined from documents as files."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("lang").alias("wing"), F.col("source").alias("room"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), "text", F.lit("2024-05-01T09:00:00Z").alias("filed_at"))
    return R.mined(d)


@query("SELECT min(conv_id * 1000 + turn) AS id, text AS content FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE conv_id % 5 = 0) AND conv_id % 5 <> 0 GROUP BY text")
def q_sweep(spark, sf_dir):
    """Messages not stored yet, each text once."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), "conv_id")
    stored = c.filter("conv_id % 5 = 0").select(H.fingerprint(X.match_key(F.col("content"))).alias("fp"))
    return R.swept(c.filter("conv_id % 5 <> 0").select("id", "content"), stored).select("id", "content")


@query("SELECT conv_id AS source, turn + 1 AS line, role, text FROM conversations WHERE trim(text) <> ''")
def q_transcripts(spark, sf_dir):
    """Transcript lines parsed back into messages."""
    c = table(spark, sf_dir, "conversations")
    json = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message")))
    return files.messages(c.select(F.col("conv_id").alias("source"), F.col("turn").alias("line"), json.alias("json"))).select("source", "line", "role", "text")


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    folder = path if static.inputFiles()[0].rstrip("/") != path.rstrip("/") and len(static.inputFiles()) > 1 else f"{sf_dir}/events*.parquet"
    return P.stream(spark, folder, static.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def q_stream_tumbling(spark, sf_dir):
    """Daily counts, computed as a stream."""
    return P.once(P.tumbling(_events(spark, sf_dir), "ts", "1 day", "40 days", "event_type"), "complete")


@query("SELECT w AS start, event_type, count(*) AS n, sum(value) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY ALL")
def q_stream_sliding(spark, sf_dir):
    """Days sliding by half, computed as a stream."""
    return P.once(P.tumbling(_events(spark, sf_dir), "ts", "24 hours", "40 days", "event_type", slide="12 hours"), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, i""")
def q_event_sessions(spark, sf_dir):
    """Sessions of users by gaps of six hours."""
    return P.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "1 day", "user_id")


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def q_stream_rate_limit(spark, sf_dir):
    """Minutes with more requests than allowed, computed as a stream."""
    return P.once(P.rate_limited(_events(spark, sf_dir), "ts", "event_type", 1), "complete")


@query("""WITH r AS (SELECT event_type, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS i FROM events)
SELECT event_type AS key, count(*) AS n, min(t) AS first_us, max(t) AS last_us, avg(value) AS mean FROM r WHERE i <= 50 GROUP BY event_type""")
def q_stream_ring(spark, sf_dir):
    """The last samples of each event type, kept as state."""
    return P.once(P.ring(_events(spark, sf_dir).select("event_type", "ts", "value"), "event_type", 50), "update", "key")


def _messages(spark, sf_dir):
    """Conversation turns as messages that arrive by conversation."""
    c = table(spark, sf_dir, "conversations").select(F.col("text").alias("content"), F.timestamp_seconds(F.lit(1714550400) + F.col("conv_id")).alias("ts"))
    path = W.fresh(spark, "messages")
    c.repartition(5).write.parquet(path)
    return P.stream(spark, path, c.schema, 2)


@query("SELECT DISTINCT nfc_normalize(text) AS content FROM conversations")
def q_stream_sweep(spark, sf_dir):
    """Messages swept as files arrive, each text once."""
    swept = P.once(P.sweep(_messages(spark, sf_dir), delay="60 days"))
    return swept.select(X.match_key(F.col("content")).alias("content"))


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS texts, true AS few FROM conversations")
def q_stream_compaction(spark, sf_dir):
    """Arriving batches folded into files of 256 rows at most; a second run finds nothing new and adds nothing."""
    source, path = _messages(spark, sf_dir), W.fresh(spark, "folded")
    for _ in range(2):
        P.compacted(source, path, 256, f"{path}-state").awaitTermination()
    folded = P.folded(spark, path).select("content", F.input_file_name().alias("file"))
    most = folded.groupBy("file").agg(F.count("*").alias("n")).agg((F.max("n") <= 256).alias("few"))
    return folded.agg(F.count("*").alias("n_rows"), F.countDistinct("content").alias("texts")).crossJoin(most)  # one row each


def _delivered(spark, rows, slices, start) -> None:
    """Rows come slice by slice (a Column of few values, rising) into a folder; after each, the stream that ``start`` makes
    of the folder goes on from where it stopped."""
    path, rows = W.fresh(spark, "delivered"), rows.withColumn("_slice", slices)
    for n, r in enumerate(rows.select("_slice").distinct().orderBy("_slice").collect()):  # few values
        rows.filter(F.col("_slice").eqNullSafe(F.lit(r[0]))).drop("_slice").write.parquet(f"{path}/slice{n}")
        start(P.stream(spark, f"{path}/*", rows.drop("_slice").schema))


def _timed_events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: An instant after all others, whose row lets a stream's watermark pass them.
_END = "2100-01-01 00:00:00"


@query("SELECT event_id, recent, recent >= 3 AS flagged, false AS late FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS recent FROM events)")
def q_stream_rate_flag(spark, sf_dir):
    """Rate flags from a stream that comes in slices of ten days, stopped and started again after each."""
    e = _timed_events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("user_id"), F.lit(_END).cast("timestamp").alias("ts"))
    out = W.fresh(spark, "rate-flags")

    def start(stream):
        flags = ST.rate_flags(stream, "user_id", "ts", "event_id", 86400, 3, "1 hour")
        with ST.versioned_state(spark):
            flags.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()

    _delivered(spark, e.unionByName(end.select(e.columns)), F.floor(F.unix_timestamp("ts") / (10 * 86400)), start)
    return spark.read.schema(ST.FLAG).parquet(out).filter("id >= 0").select(F.col("id").alias("event_id"), "recent", "flagged", "late")


@query("""WITH e AS (SELECT event_id, ts, CAST(floor(epoch(ts + to_hours(CAST(event_id % 7 * 36 AS INTEGER))) / 864000) AS BIGINT) AS slice FROM events),
m AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e GROUP BY slice)
SELECT event_id, coalesce(ts < mark - INTERVAL 5 DAY, false) AS late FROM e JOIN m USING (slice)""")
def q_stream_late(spark, sf_dir):
    """Events that come up to nine days after they happened: those behind the watermark of five days go to a side table."""
    e, out = _timed_events(spark, sf_dir).select("event_id", "ts"), W.fresh(spark, "late-events")
    filed = F.unix_timestamp("ts") + F.col("event_id") % 7 * 36 * 3600
    _delivered(spark, e, F.floor(filed / (10 * 86400)), lambda s: ST.split_late(s, "ts", "5 days", out).awaitTermination())
    return ST.split(spark, out).select("event_id", "late")


@query("SELECT event_id, ts + to_hours(CAST(event_id % 7 * 12 AS INTEGER)) AS filed_at, CASE WHEN event_id % 7 < 5 AND event_id % 11 <> 0 THEN ts END AS ts FROM events")
def q_stream_filed(spark, sf_dir):
    """A stream of filings joined with the stream of events that happened within two days before; without one, ts is null."""
    e = _timed_events(spark, sf_dir)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(_END).cast("timestamp").alias("ts"))
    happened = e.filter("event_id % 11 <> 0").select(F.col("event_id").cast("long").alias("id"), "ts").unionByName(end)
    filings = e.select(F.col("event_id").cast("long").alias("id"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7 * 12).cast("int"))).alias("filed_at")).unionByName(end.select("id", F.col("ts").alias("filed_at")))
    paths = [W.fresh(spark, n) for n in ("happened", "filings")]
    happened.write.parquet(paths[0])
    filings.write.parquet(paths[1])
    streams = [P.stream(spark, p, d.schema) for p, d in zip(paths, (happened, filings), strict=True)]
    return P.once(ST.filed(*streams, "2 days", "100 days")).filter("id >= 0").select(F.col("id").alias("event_id"), "filed_at", "ts")
