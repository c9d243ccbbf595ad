"""File and transcript sources and sinks."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import hashing as H
from recollect.functions import text as X
from recollect.operators import governance as G
from recollect.sources import work as W

#: Extensions that are mined (fixed values).
MINED = "md txt markdown rst org log jsonl".split()
NOISE = ("", "progress", "file-history-snapshot", "queue-operation")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of every file below a folder with a mined extension, dot-files left out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    name = F.regexp_extract("source", "([^/]*)$", 1)
    hidden = F.rlike(F.regexp_replace("source", "^[a-z]+:", ""), F.lit(r"/\.[^/]"))
    return rows.filter(F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(MINED) & ~hidden)


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source, line, value) of text files, lines from 0: files are split over tasks, and numbered by the lines of the
    blocks before."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    inside = F.row_number().over(Window.partitionBy("source", "block").orderBy("at")) - 1
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("source", "block").agg(F.count("*").alias("n")).select("source", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("inside", inside).join(blocks, ["source", "block"]).select("source", (F.col("before") + F.col("inside")).alias("line"), "value")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Messages of *.jsonl transcripts: source, line, id, role, speaker, text, timestamp. Blank, malformed and noise lines are skipped."""
    return messages(numbered_lines(spark, path, "*.jsonl").withColumnRenamed("value", "json"))


def messages(lines: DataFrame) -> DataFrame:
    """The messages of JSON lines (source, line, json)."""
    j = lambda p: F.get_json_object("json", p)
    read = lines.filter(F.trim("json") != "").select(
        "source", (F.col("line") + 1).alias("line"), F.coalesce(j("$.uuid"), j("$.id")).alias("id"), F.coalesce(j("$.type"), j("$.message.role"), F.lit("unknown")).alias("role"),
        F.coalesce(j("$.speaker"), j("$.message.name")).alias("speaker"), F.coalesce(j("$.message.content"), j("$.content"), j("$.summary")).alias("content"), j("$.timestamp").alias("timestamp"),
    )
    read, content = read.filter(~F.col("role").isin(*NOISE)), F.col("content")
    block = F.startswith(F.ltrim(content), F.lit("[")) | F.startswith(F.ltrim(content), F.lit("{"))
    text = F.when(block, X.render_content(F.when(block, content))).otherwise(content)
    return read.select("source", "line", "id", "role", "speaker", text.alias("text"), "timestamp").filter(F.trim("text") != "")


def export_jsonl(records: DataFrame, path: str) -> None:
    """Records as JSON lines."""
    records.write.json(path)


def import_jsonl(spark: SparkSession, path: str, schema: str, any_length: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of exported JSON lines: records with a broken line, a bad name or, unless any length will do, too
    long a content are rejected."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = F.col("_corrupt").isNull() & X.valid_name(F.col("wing")) & X.valid_name(F.col("room"))
    good = good if any_length else good & X.valid_content(F.col("content"))
    marked = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    return marked.filter("_good").drop("_good", "_corrupt"), marked.filter("not _good").drop("_good")


def imported(spark: SparkSession, path: str, schema: str, any_length: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of exported JSON lines, screened again as if they were new: what has a signal goes to quarantine."""
    good, bad = import_jsonl(spark, path, schema, any_length)
    return G.diverted(good, X.screen(F.col("content"))), bad


def imported_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected) of exported facts (id, subject, predicate, object, valid_from): ids are derived again, and a line
    whose id is another than its parts give is rejected."""
    rows = spark.read.schema("id string, subject string, predicate string, object string, valid_from string").json(path)
    derived = rows.withColumn("_id", H.triple_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from")))
    return derived.filter("id <=> _id").drop("_id"), derived.filter("not id <=> _id").drop("_id")


def evaluation_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of an evaluation, one JSON object a line; blank lines are skipped, a broken one fails."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def sent_to_folder(path: str, rows: list) -> None:
    """Puts a batch of (id, vector) into a shared folder as one Parquet file named after its ids: sent again, it replaces itself."""
    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(where, recursive=True)
    name = hashlib.sha256(",".join(str(i) for i, _ in rows).encode()).hexdigest()
    batch = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([list(v) for _, v in rows], pa.list_(pa.float32()))})
    with system.open_output_stream(f"{where}/{name}.parquet") as out:
        pq.write_table(batch, out)


def pushed(vectors: DataFrame, send, batch: int = 64) -> DataFrame:
    """Hands every row (id, embedding) to ``send``, a picklable function of a list of (id, vector), in batches; the
    receipts (batch size, least and greatest id) are what an audit keeps. A retried task sends its batches again, so
    ``send`` has to be an upsert."""

    def push(batches):
        held: list = []

        def receipt(rows: list) -> pd.DataFrame:
            send(rows)
            ids = [r[0] for r in rows]
            return pd.DataFrame({"size": [len(rows)], "least": [min(ids)], "most": [max(ids)]})

        for pdf in batches:
            held += list(zip(pdf["id"].tolist(), pdf["embedding"], strict=True))
            while len(held) >= batch:
                yield receipt(held[:batch])
                held = held[batch:]
        if held:
            yield receipt(held)

    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInPandas(push, "size long, least long, most long")


def bundle_manifest(parts: dict[str, DataFrame], key: bytes) -> DataFrame:
    """(part, rows, digest, tag) of a bundle: the digest is the sum of the first 60 bits of the rows' hashes, whatever
    their order, and the tag binds part, rows and digest to a key."""
    out = None
    for name, df in parts.items():
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        own = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("part"), "rows", "digest")
        out = own if out is None else out.unionByName(own)
    return out.withColumn("tag", H.hmac(key, F.concat_ws("\u001f", "part", F.col("rows").cast("string"), "digest")))


def bundle_faults(manifest: DataFrame, parts: dict[str, DataFrame], key: bytes) -> DataFrame:
    """(part, fault) of a received bundle against its manifest: a tag that isn't the key's, rows or contents that differ."""
    now = bundle_manifest(parts, key).select("part", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    tag = H.hmac(key, F.concat_ws("\u001f", "part", F.col("rows").cast("string"), "digest"))
    fault = F.when(F.col("_rows").isNull(), "missing").when(F.col("rows").isNull(), "unlisted").when(F.col("tag") != tag, "forged").when(F.col("rows") != F.col("_rows"), "rows").when(F.col("digest") != F.col("_digest"), "content")
    return manifest.join(now, "part", "full").select("part", fault.alias("fault")).filter("fault is not null")


def snapshot(records: DataFrame, folder: str, stamp: str) -> None:
    """A dated copy below a folder."""
    records.write.parquet(f"{folder}/snapshot={stamp}")


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Stamps of the copies below a folder, oldest first."""
    return [n.split("=", 1)[1] for n in W.names(spark, folder) if n.startswith("snapshot=")]


def restored(spark: SparkSession, folder: str, stamp: str | None = None) -> DataFrame:
    """The copy of a stamp, or the newest."""
    have = snapshots(spark, folder)
    if (stamp or (have[-1] if have else None)) not in have:
        raise FileNotFoundError(f"no snapshot {stamp or ''} below {folder}")
    return spark.read.parquet(f"{folder}/snapshot={stamp or have[-1]}")


def pruned(spark: SparkSession, folder: str, keep: int = 10) -> list[str]:
    """Removes all but the newest copies; the stamps removed."""
    gone = snapshots(spark, folder)[:-keep] if keep else snapshots(spark, folder)
    for stamp in gone:
        W.remove(spark, f"{folder}/snapshot={stamp}")
    return gone


def surplus_snapshots(stamps: DataFrame, keep: int = 10) -> DataFrame:
    """Stamps (stamp) beyond the newest ``keep``."""
    newest = stamps.orderBy(F.desc("stamp")).limit(keep)
    return stamps.join(newest, "stamp", "left_anti")
