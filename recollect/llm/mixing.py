"""Mixing sources to target weights by fixed-length token blocks.

Each source's documents are laid end to end in a pseudorandom order, and its words cut into blocks
of ``block_words``. A source's target is its weight's share of ``total`` times all words, at most
``repeats`` times its own, the excess shared again by weight. The mix is a row of slots, one block
each, dealt over output shards of ``shard_slots``. Every shard draws its counts of the sources from
a multinomial; because free draws miss the targets of small sources, slots drawn beyond a source's
quota pass, in order, to the sources drawn too rarely. The k-th slot of a source takes the block
that a keyed pseudorandom permutation of its block indices (another one for each pass) gives k, and
blocks are joined to documents by that index. A quota is at most ``repeats`` passes, so no block,
and so no document, is taken more often.

All draws are seeded by shard, source and pass: reruns, and retries of lost tasks, agree. Running
positions are summed in two levels, so a source with a third of all rows isn't one task. Sources are
rows of a table, however many there are: targets come from a level found by sums over them, and a
shard's multinomial is drawn first over groups of ``GROUP`` sources and then within each, which is the
same draw; only the groups' quotas reach the driver.

Edge cases: null or wordless texts have size 0 and are never taken; the null source is one source,
the last; an empty table gives no rows; repeated rows are separate documents; other columns, whatever
their names, pass through ``mixed_documents`` and are ignored by ``mix_plan``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.llm import textscan as ts
from recollect.llm.staging import Staged, unused

WEIGHTS, TOTAL, REPEATS = (3.0, 1.0, 2.0), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 1 << 14, 20
BUCKET_ROWS, GROUP, PIECE, TASK_SLOTS = 4096, 1024, 256, 250_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[float], weights: list[float], total: float, repeats: float) -> list[float]:
    """min(repeats * size, weight * level), the level such that all sum to total * sum(sizes)."""
    left, out, open_ = total * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level > repeats * sizes[i]]
        for i in full or open_:
            out[i] = repeats * sizes[i] if full else weights[i] * level
        if not full:
            break
        open_ -= set(full)
        left -= sum(out[i] for i in full)
    return out


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a four-round Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            a, b = b, a ^ (ts.mix(b + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        return a << np.uint64(half) | b

    x = once(k.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _running(df: DataFrame, group: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the group before this one, by buckets and then within them."""
    own = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inside.join(sums, [group, bucket]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _numbered(found: DataFrame) -> DataFrame:
    """found with ``src``, the place of each source in code-point order, null last: numbered range by range."""
    order = [F.col("source").isNull(), F.col("source")]
    at = Staged(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "mix-order").df
    ranges = sorted(at.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each task
    before, total = [F.lit(0).cast("long")], 0
    for r in ranges:
        before += [F.lit(r["part"]), F.lit(total).cast("long")]
        total += r["n"]
    if not ranges:
        return at.withColumn("src", F.col("at")).drop("at")
    offset = F.create_map(*before[1:])[F.shiftright("at", 33)]
    return at.withColumn("src", offset + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def _level(sources: DataFrame, total: float, repeats: float) -> float:
    """The level of ``targets``, over sources (size, weight); infinite where all are full."""
    sums = sources.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    level, full = total * (sums["size"] or 0) / (sums["weight"] or 1), -1
    while True:
        above = F.col("weight") * level > repeats * F.col("size")
        now = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, repeats * F.col("size"))).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if now["n"] == full or not now["open"]:
            return level if now["open"] else math.inf
        full, level = now["n"], (total * sums["size"] - (now["taken"] or 0)) / now["open"]


def _group_draws(batches: Iterator[pd.DataFrame], quota: np.ndarray, slots: int, shard_slots: int, seed: int) -> Iterator[pd.DataFrame]:
    """How many slots of each shard go to each group of sources."""
    for pdf in batches:
        for shard in pdf["id"]:
            n = min(shard_slots, slots - shard * shard_slots)
            counts = np.random.default_rng([seed, shard]).multinomial(n, quota / quota.sum())
            own = np.flatnonzero(counts)
            yield pd.DataFrame({"shard": shard, "part": own, "n": counts[own], "lane": shard // BUCKET_ROWS})


def _source_draws(draws: pd.DataFrame, sources: pd.DataFrame, seed: int) -> pd.DataFrame:
    """How many of these go to each source: both draws together are one multinomial over all sources."""
    out = [pd.DataFrame({"shard": [], "src": [], "slots": [], "bucket": []}, dtype="int64")]
    sources = sources.sort_values("src")
    share = sources["quota"].to_numpy() / sources["quota"].sum() if len(sources) else np.zeros(0)
    for shard, part, n in zip(draws["shard"], draws["part"], draws["n"], strict=True):
        counts = np.random.default_rng([seed, shard, part, 1]).multinomial(n, share)
        own = np.flatnonzero(counts)
        out.append(pd.DataFrame({"shard": shard, "src": sources["src"].to_numpy()[own], "slots": counts[own], "bucket": shard // BUCKET_ROWS}))
    return pd.concat(out)


def _runs(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, low, high): the ranks that sources take. Slots drawn beyond a source's quota pass, in order, to the sources
    drawn too rarely; both are laid end to end and meet in pieces of ``PIECE`` slots."""
    got = sources.join(drawn.groupBy("src").agg(F.sum("slots").alias("drawn")), "src", "left").fillna({"drawn": 0}).withColumns({"one": F.lit(0), "lane": F.expr(f"src div {GROUP}")})
    got = got.withColumns({"over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), "under": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))}).select("src", "quota", "drawn", "over", "under", "one", "lane")
    got = _running(_running(got, "one", "lane", ["src"], "over", "over_from"), "one", "lane", ["src"], "under", "under_from")
    got = Staged(got.select("src", "quota", "drawn", "over", "under", "over_from", "under_from"), "mix-quotas").df
    rows = _running(drawn, "src", "bucket", ["shard"], "slots", "start").select("src", "start", (F.col("start") + F.col("slots")).alias("end")).join(got, "src")
    own = rows.select("src", F.col("start").alias("low"), F.least("end", "quota").alias("high")).filter("low < high")
    pieces = lambda df: df.withColumn("piece", F.explode(F.expr(f"sequence(low div {PIECE}, (high - 1) div {PIECE})")))
    shift = F.col("over_from") - F.col("quota")
    spare = pieces(rows.filter("end > quota").select((F.greatest("start", "quota") + shift).alias("low"), (F.col("end") + shift).alias("high")))
    lacking = pieces(got.filter("under > 0").select(F.col("src"), F.col("under_from").alias("low"), (F.col("under_from") + F.col("under")).alias("high"), (F.col("drawn") - F.col("under_from")).alias("shift")))
    edge = lambda f, x, y: f(F.col(f"a.{x}"), F.col(f"b.{y}"))
    met = spare.alias("a").join(lacking.alias("b"), F.col("a.piece") == F.col("b.piece"))
    low = F.greatest(edge(F.greatest, "low", "low"), F.col("a.piece") * PIECE)
    high = F.least(edge(F.least, "high", "high"), (F.col("a.piece") + 1) * PIECE)
    passed = met.select(F.col("b.src").alias("src"), (low + F.col("b.shift")).alias("low"), (high + F.col("b.shift")).alias("high")).filter("low < high")
    return own.unionByName(passed)


def _slots(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """(src, block) of each slot of the runs."""
    for pdf in batches:
        for src, low, high, n in zip(pdf["src"], pdf["low"], pdf["high"], pdf["n_blocks"], strict=True):
            ranks = np.arange(low, high)
            for once in np.unique(ranks // n):
                own = ranks[ranks // n == once] % n
                yield pd.DataFrame({"src": src, "block": permuted(own, int(n), seed * 1_000_003 + int(src) * 101 + int(once))})


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, row_key, size, source_size, target, taken, and pieces (at, words, times) of its blocks."""
    spark = docs.sparkSession
    sized = Staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64(F.col("doc_id").cast("long"), "text", "source").alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes",
    ).df
    found = _numbered(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    found = Staged(found.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("src") % len(weights) + 1).cast("int"))), "mix-weights").df
    level = _level(found, total, repeats)
    most = (F.col("size") * repeats).cast("double")
    sources = found.withColumns({"target": most if level == math.inf else F.least(most, F.col("weight") * level), "n_blocks": F.ceil(F.col("size") / block_words).cast("long"), "buckets": F.greatest(F.lit(1), F.expr(f"n div {BUCKET_ROWS}"))})
    quota = F.when(F.col("size") > 0, F.least(F.bround(F.col("target") / F.col("size") * F.col("n_blocks")).cast("long"), F.col("n_blocks") * repeats)).otherwise(0)
    sources = Staged(sources.select(F.col("source").alias("name"), "src", F.col("size").alias("source_size"), "target", "n_blocks", "buckets", quota.cast("long").alias("quota"), F.expr(f"src div {GROUP}").alias("part")), "mix-sources").df
    rows = sized.join(sources.select("name", "src", "source_size", "target", "buckets"), F.col("source").eqNullSafe(F.col("name"))).withColumn("bucket", F.pmod(F.xxhash64("row_key"), F.col("buckets")))
    laid = _running(rows, "src", "bucket", ["row_key", "doc_id"], "size", "pos").select("doc_id", "row_key", "size", "src", "source_size", "target", "pos")
    laid = Staged(laid, "mix-laid").df
    groups = sources.groupBy("part").agg(F.sum("quota").alias("q")).orderBy("part").toArrow()  # a row for each GROUP sources
    of_group = groups.column("q").to_numpy().astype(np.int64) if groups.num_rows else np.zeros(0, np.int64)
    slots = int(of_group.sum())
    if not slots:
        return laid.select("doc_id", "row_key", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<at:long,words:long,times:long>>").alias("pieces"))
    shards = -(-slots // shard_slots)
    draws = spark.range(shards).mapInPandas(lambda it: _group_draws(it, of_group, slots, shard_slots, seed), "shard long, part long, n long, lane long")
    own = sources.filter("quota > 0").select("part", "src", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // BUCKET_ROWS).cast("long"))).alias("lane"))
    drawn = draws.groupBy("part", "lane").cogroup(own.groupBy("part", "lane")).applyInPandas(lambda a, b: _source_draws(a, b, seed), "shard long, src long, slots long, bucket long")
    runs = _runs(Staged(drawn, "mix-draws").df, sources.select("src", "quota")).join(sources.select("src", "n_blocks"), "src")
    taken = (
        runs.repartition(min(20_000, max(1, slots // TASK_SLOTS)), "src", "low")
        .mapInPandas(lambda it: _slots(it, seed), "src long, block long").groupBy("src", "block").agg(F.count("*").alias("times"))
    )
    pieces = (
        laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"pos div {block_words}"), F.expr(f"(pos + size - 1) div {block_words}"))))
        .withColumn("at", F.greatest(F.lit(0), F.col("block") * block_words - F.col("pos")))
        .withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("pos")) - F.col("at"))
        .select("src", "pos", "block", "at", "words")
    )
    per_doc = pieces.join(taken.hint("merge"), ["src", "block"]).groupBy("src", "pos").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("at", "words", "times"))).alias("pieces"))
    out = laid.withColumn("key_pos", F.when(F.col("size") > 0, F.col("pos"))).join(per_doc.withColumnRenamed("pos", "key_pos"), ["src", "key_pos"], "left")
    return out.select("doc_id", "row_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.array().cast("array<struct<at:long,words:long,times:long>>")).alias("pieces"))


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], plan_name: str) -> Iterator[pa.RecordBatch]:
    """Each document's taken words, one row for each pass over it; runs of words keep their spacing."""
    for batch in batches:
        texts, plans = batch.column("text"), batch.column(plan_name)
        for words in ts.blocks(texts, ts.NON_SPACE):
            source, out = [], []
            for r in range(words.rows):
                base, plan = words.first[r], plans[words.row0 + r].as_py()
                for once in range(1, max((p["times"] for p in plan), default=0) + 1):
                    runs: list[list[int]] = []
                    for p in plan:
                        if p["times"] >= once:
                            if runs and runs[-1][1] == p["at"]:
                                runs[-1][1] += p["words"]
                            else:
                                runs.append([p["at"], p["at"] + p["words"]])
                    source.append(words.row0 + r)
                    out.append("\n".join(words.data[words.start[base + a] : words.end[base + b - 1]].tobytes().decode() for a, b in runs))
            rows = batch.select(names).take(pa.array(source, pa.int64()))
            columns = {n: rows.column(n) for n in names} | {"text": pa.array(out, pa.string())}
            if "n_chars" in names:
                columns["n_chars"] = pa.array([len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows like docs whose texts are the words taken, one row for each pass over a document."""
    row, pieces, copy = unused(docs, "_x_row", "_x_pieces", "_x_copy")
    named = lambda h: F.struct(h.alias("h"), F.col("doc_id").cast("long").alias("id")).alias(row)  # noqa: E731  # the hash alone could be another document's
    plan = mix_plan(docs, **options).filter("taken > 0").select(named(F.col("row_key")), F.col("pieces").alias(pieces))
    plan = Staged(plan.withColumn(copy, F.row_number().over(Window.partitionBy(row).orderBy(pieces))), "mix-plan").df
    keyed = docs.withColumn(row, named(F.xxhash64(F.col("doc_id").cast("long"), "text", "source")))
    first, more = plan.filter(F.col(copy) == 1).drop(copy), plan.filter(F.col(copy) > 1)
    if more.isEmpty():
        joined = keyed.join(first, row).drop(row)
    else:  # rows of equal doc_id, text and source take the plans of these in the order of a hash of all columns
        order = Window.partitionBy(row).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        every = keyed.withColumn(copy, F.row_number().over(order))
        joined = every.join(plan, [row, copy]).drop(row, copy)
    return joined.mapInArrow(lambda it, names=docs.columns: _cut(it, names, pieces), docs.schema)
