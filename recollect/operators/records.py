"""Records from files and conversations: mining, exchange packing, sweeping, listing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.functions import hashing as H
from recollect.functions import temporal as D
from recollect.functions import text as X


_MINED = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("time_mentions", D.MENTION)]))


def _miner():
    """An Arrow UDF of (safe text, mode, anchor date): chunks with their entities and date mentions, all that needs Python
    in one pass."""
    civil, locale = list(D.civil_months()), D.Locale()

    def one(text: str | None, kind: str, at: object) -> list[dict]:
        if not isinstance(text, str):
            return []
        at = at if isinstance(at, dt.date) else None
        content = X.CODE_EDGES.sub("", text) if kind == "code" else X.tidied(text)
        return [{"content": c, "entities": X.find_entities(c), "time_mentions": D.found_mentions(c, at, locale, civil)} for c in X.split_chunks(content)]

    @F.pandas_udf(_MINED)
    def mine(safe: pd.Series, mode: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(safe, mode, day, strict=True)])

    return mine


def mined(texts: DataFrame, added_by: str = "mine") -> DataFrame:
    """Records of (wing, room, source, text, filed_at): normalised, cut into chunks, with ids, entities and date mentions."""
    found = _miner()(X.make_safe(F.col("text")), X.mode_for_path(F.col("source")), D.anchor(F.col("filed_at")))
    rows = texts.select("wing", "room", "source", "filed_at", F.posexplode(found).alias("chunk_index", "c"))
    return rows.select(
        H.drawer_id(F.col("wing"), F.col("room"), F.col("source"), F.col("chunk_index")).alias("id"), "wing", "room", "source", "chunk_index", "c.content", F.lit(added_by).alias("added_by"), "filed_at",
        "c.entities", "c.time_mentions",
    )


def _packed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Chunks of messages sorted by conversation and turn; the open chunk goes on from batch to batch."""
    names = ["conv_id", "chunk_index", "first_turn", "last_turn", "started_at", "content"]
    conv, index, chunk, used = None, 0, None, 0
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            block = f"{r.label}: {r.text}"
            grows, same = len(block.encode()), chunk is not None and (r.conv_id == conv or pd.isna(r.conv_id) and pd.isna(conv))
            if same and used + grows + 2 <= size:
                chunk[3], chunk[5], used = r.turn, chunk[5] + "\n\n" + block, used + grows + 2
                continue
            if chunk is not None:
                out.append(chunk)
            index, conv, used = index + 1 if same else 0, r.conv_id, grows
            chunk = [conv, index, r.turn, r.turn, r.timestamp, block]
        yield pd.DataFrame(out, columns=names)
    if chunk is not None:
        yield pd.DataFrame([chunk], columns=names)


def exchanges(messages: DataFrame, size: int = 800) -> DataFrame:
    """Conversations (conv_id, turn, label, text, timestamp) packed into chunks of at most size bytes on message boundaries,
    each with the timestamp of its first message. A conversation is a fold over its turns, streamed through one task in
    order: a batch of it is held, whatever its length."""
    rows = messages.select("conv_id", "turn", "label", "text", "timestamp").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return rows.mapInPandas(lambda it: _packed(it, size), "conv_id long, chunk_index long, first_turn long, last_turn long, started_at string, content string")


def swept(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages (id, content) that no stored record (fp) and no earlier message repeats."""
    keyed = messages.withColumn("fp", H.fingerprint(X.match_key(F.col("content")))).join(stored.select("fp").distinct(), "fp", "left_anti")
    first = F.row_number().over(Window.partitionBy("fp").orderBy("id"))
    return keyed.withColumn("_r", first).filter("_r = 1").drop("_r")


def located(chunk: Column, body: Column) -> Column:
    """Byte span of a chunk in its body."""
    return X.locate(chunk, body)


def located_chunks(rows: DataFrame) -> DataFrame:
    """(source, chunk_index, s, e) of the paragraphs of chunks (source, chunk_index, body, content) in their body, in
    bytes: each source's chunks are looked for in order, on from where the last began, so a repeated paragraph is found
    where its chunk is. A source is one document's chunks; tasks hold whole sources, sorted, and go through them in batches."""

    columns = ["source", "chunk_index", "content"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, body, cursor = None, None, 0
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                out: list[tuple] = []
                for i, (own, index, content) in enumerate(zip(*(part.column(c).to_pylist() for c in columns), strict=True)):
                    if body is None or own != source:
                        source, body, cursor = own, (part.column("body")[i].as_py() or "").encode(), 0
                    for piece in filter(None, (p.strip().encode() for p in (content or "").split("\n\n"))):
                        at = body.find(piece, cursor)
                        if at >= 0:
                            out.append((own, index, at, at + len(piece)))
                            cursor = at
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), *[pa.int64()] * 3))], ["source", "chunk_index", "s", "e"])

    dealt = rows.select("source", F.col("chunk_index").cast("long").alias("chunk_index"), "content", "body").repartition("source").sortWithinPartitions("source", "chunk_index")
    return dealt.mapInArrow(locate, "source string, chunk_index long, s long, e long")
