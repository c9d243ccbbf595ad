"""Sharding by extendible hashing, in DataFrame operations only.

A row's key is hashed to 60 bits. A bucket is a prefix of those bits; the directory starts with the
empty prefix, and only buckets above the byte limit are split on one more bit, until every shard
fits. Sizes are summed once per prefix cell instead of rescanning the rows at each split: a first
histogram goes a little deeper than the total asks for, and only rows of cells that are still too
large are summed again, eight bits deeper.

A bucket whose rows all have one hash can't be split by it. A single row above the limit is a shard
of its own. If several rows share the key (repeated rows), they are written to the shared folder
and split further by the same procedure on their row number there; such shards are named
``<prefix>+<prefix of the row number's hash>``.

Edge cases: null keys hash as the empty string; null texts count no bytes; an empty table gives no
rows; other columns are kept, but for those named like the four results, which these replace (names
beginning with ``_x_`` are reserved).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.staging import Staged

BITS, STRIDE = 60, 8
MAX_BYTES = 256 << 20
HELPERS = ["_x_hash", "_x_bytes"]


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.expr(f"shiftrightunsigned({h}, {BITS} - {depth})") if isinstance(h, str) else F.shiftrightunsigned(h, BITS - depth)


def _bits(prefix: str, depth: str) -> Column:
    return F.expr(f"CASE WHEN {depth} = 0 THEN '' ELSE lpad(conv({prefix}, 10, 2), {depth}, '0') END")


def directory(sizes: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame]]:
    """Leaves of the directory for (hash, bytes, n): for each histogram depth, its cells with their shard."""
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    deep, above, rows, out = min(22, max(1, math.ceil(math.log2(max(1.0, total / max_bytes))) + 2)), -1, sizes, []
    while True:
        cells = Staged(
            rows.groupBy(F.shiftrightunsigned("hash", BITS - deep).alias("cell"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi")),
            "shard-cells",
        ).df
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(above + 1), F.lit(deep)))).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {deep} - depth)"))
        fits = (
            levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter((F.col("shard_bytes") <= max_bytes) | (F.col("lo") == F.col("hi")))
        )
        best = levels.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        leaves = Staged(best.select("cell", "s.*"), "shard-leaves").df
        out.append((deep, leaves))
        left = cells.join(leaves, "cell", "left_anti").select("cell")
        if deep == BITS or left.isEmpty():
            return out
        rows = rows.join(left, F.shiftrightunsigned("hash", BITS - deep) == left["cell"], "left_semi")
        above, deep = deep, min(BITS, deep + STRIDE)


def _placed(docs: DataFrame, max_bytes: int) -> DataFrame:
    """docs (with _x_hash and _x_bytes) with the shard's depth, prefix, bytes and rows."""
    sizes = Staged(docs.groupBy(F.col("_x_hash").alias("hash")).agg(F.sum("_x_bytes").alias("bytes"), F.count("*").alias("n")), "shard-sizes").df
    names, out = ["depth", "prefix", "shard_bytes", "shard_docs"], docs
    for k, (deep, leaves) in enumerate(directory(sizes, max_bytes)):
        own = leaves.select(F.col("cell").alias("_x_cell"), *(F.col(c).alias(f"_x_{c}") for c in names) if k == 0 else (F.col(c).alias(f"_x_{c}_{k}") for c in names))
        out = out.withColumn("_x_cell", F.shiftrightunsigned("_x_hash", BITS - deep)).join(own, "_x_cell", "left").drop("_x_cell")
        if k:
            out = out.withColumns({f"_x_{c}": F.coalesce(F.col(f"_x_{c}"), F.col(f"_x_{c}_{k}")) for c in names}).drop(*(f"_x_{c}_{k}" for c in names))
    return out


def shards(docs: DataFrame, max_bytes: int = MAX_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard_id, depth, shard_docs and shard_bytes of each row's shard."""
    hashed = docs.withColumns({"_x_hash": key_hash(F.col(key)), "_x_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")})
    kept = [c for c in docs.columns if c not in ("shard_id", "depth", "shard_docs", "shard_bytes")]
    told = [F.col("_x_depth").alias("depth"), F.col("_x_shard_docs").alias("shard_docs"), F.col("_x_shard_bytes").alias("shard_bytes")]
    placed = _placed(hashed, max_bytes)
    fit = placed.select(*kept, _bits("_x_prefix", "_x_depth").alias("shard_id"), *told)
    crowded = (F.col("_x_shard_bytes") > max_bytes) & (F.col("_x_shard_docs") > 1)
    sizes = hashed.groupBy("_x_hash").agg(F.sum("_x_bytes").alias("b"), F.count("*").alias("n")).filter((F.col("b") > max_bytes) & (F.col("n") > 1))
    if sizes.isEmpty():
        return fit
    over = Staged(placed.filter(crowded).select(*kept, *HELPERS, _bits("_x_prefix", "_x_depth").alias("_x_outer")), "shard-overflow").df
    numbered = Staged(over.withColumn("_x_hash", key_hash(F.monotonically_increasing_id())), "shard-numbered").df
    again = _placed(numbered, max_bytes).select(*kept, F.concat(F.col("_x_outer"), F.lit("+"), _bits("_x_prefix", "_x_depth")).alias("shard_id"), *told)
    return placed.filter(~crowded).select(*kept, _bits("_x_prefix", "_x_depth").alias("shard_id"), *told).unionByName(again)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet per shard; rows of a shard meet in one task, which its byte limit bounds."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
