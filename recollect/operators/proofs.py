"""Proofs of forgetting: documents that show, apart from the audit chain, what it recorded between two of its heads.

A proof names what it forgot (``named``: proof, id), the chain's heads before and after (``headers``: proof, chain, seq of the
last row before, head_before, head_after) and the rows between (``records``: proof, place from 0, record_id, tag). Folding
head_before through the tags must give head_after; every record must be the tombstone (``del/`` and the id) of a named id,
and every named id must have one. That needs no chain. With the chain at hand, the heads must be its own at those
places, and nothing named may be there still.

The records of a proof are sorted and streamed through the fold, so a task holds a batch of them, whatever the length of a
proof; the other checks are joins and counts. A proof has one verdict: the first of FAULTS that it has, or ``verified``.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOMBSTONE = "del/"
#: In the order in which they are told.
FAULTS = ["not a tombstone", "not named", "no tombstone", "places are not counted on", "heads do not chain", "not in the chain", "still there"]


def proofs(audit: DataFrame, heads: DataFrame, forgotten: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, records, named) for forgettings (proof, chain, first, last): the audit's rows (chain, seq, record_id, tag)
    from first to last, with the heads (chain, seq, head) around them; '' before a chain's first row."""
    of = forgotten.select("proof", F.col("chain").cast("string").alias("chain"), "first", "last")
    rows = audit.withColumn("chain", F.col("chain").cast("string")).join(of, "chain").filter("seq between first and last")
    records = rows.select("proof", (F.row_number().over(Window.partitionBy("proof").orderBy("seq")) - 1).cast("long").alias("place"), "record_id", "tag")
    before = of.join(heads, "chain", "left").groupBy("proof", "chain", "first", "last").agg(
        F.max_by("head", F.when(F.col("seq") < F.col("first"), F.col("seq"))).alias("head_before"), F.max(F.when(F.col("seq") < F.col("first"), F.col("seq"))).alias("seq"), F.max_by("head", F.when(F.col("seq") <= F.col("last"), F.col("seq"))).alias("head_after")
    )
    headers = before.select("proof", "chain", F.coalesce("seq", F.lit(0).cast("long")).alias("seq"), F.coalesce("head_before", F.lit("")).alias("head_before"), "head_after")
    return headers, records, rows.filter(F.startswith("record_id", F.lit(TOMBSTONE))).select("proof", F.substring("record_id", len(TOMBSTONE) + 1, 1 << 20).alias("id")).distinct()


def _fold(batches: Iterator[pd.DataFrame], key: bytes | None) -> Iterator[pd.DataFrame]:
    """The head after each proof's last record, of rows sorted by proof and place, which begin with the head before."""
    at, head = None, ""
    for pdf in batches:
        done = []
        for proof, tag, begin in zip(pdf["proof"], pdf["tag"], pdf["head_before"], strict=True):
            if proof != at:
                if at is not None:
                    done.append((at, head))
                at, head = proof, begin
            step = (head + "\x1f" + (tag or "")).encode()
            head = hashlib.sha256(step).hexdigest() if key is None else hmac.new(key, step, "sha256").hexdigest()
        yield pd.DataFrame(done, columns=["proof", "folded"])
    if at is not None:
        yield pd.DataFrame([(at, head)], columns=["proof", "folded"])


def checked(headers: DataFrame, records: DataFrame, named: DataFrame, key: bytes | None = None) -> DataFrame:
    """(proof, faults): what is wrong with each proof by itself."""
    begun = records.select(F.col("proof").cast("string").alias("proof"), "place", "tag").join(headers.select(F.col("proof").cast("string").alias("proof"), "head_before"), "proof")
    folded = begun.repartition("proof").sortWithinPartitions("proof", "place").mapInPandas(lambda it: _fold(it, key), "proof string, folded string")
    stone = F.startswith("record_id", F.lit(TOMBSTONE))
    rows = records.select("proof", "place", stone.alias("stone"), F.when(stone, F.substring("record_id", len(TOMBSTONE) + 1, 1 << 20)).alias("id"))
    want = named.select("proof", F.col("id").cast("string").alias("id")).distinct().withColumn("_named", F.lit(True))
    seen = rows.join(want, ["proof", "id"], "left").groupBy("proof").agg(
        F.max(~F.col("stone")).alias("other"), F.max(F.col("stone") & F.col("_named").isNull()).alias("strange"), F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    without = want.join(rows.select("proof", "id"), ["proof", "id"], "left_anti").groupBy("proof").agg(F.lit(True).alias("without"))
    out = headers.join(seen, "proof", "left").join(without, "proof", "left").withColumn("_p", F.col("proof").cast("string")).join(folded.withColumnRenamed("proof", "_p"), "_p", "left")
    counted = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("places") == F.col("n"))
    wrong = [F.col("other"), F.col("strange"), F.col("without"), ~F.coalesce(counted, F.col("n").isNull()), ~F.coalesce("folded", "head_before").eqNullSafe(F.col("head_after"))]
    return out.select("proof", F.array_compact(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.lit(f)) for w, f in zip(wrong, FAULTS, strict=False)))).alias("faults"))


def verdicts(headers: DataFrame, records: DataFrame, named: DataFrame, heads: DataFrame, live: DataFrame, key: bytes | None = None) -> DataFrame:
    """(proof, verdict) of proofs against the chain's heads (chain, seq, head) and what is there (id) now. A proof's heads
    belong to the chain where the one before is its head at ``seq`` and the one after comes as many rows later as the
    proof has records."""
    own = checked(headers, records, named, key)
    size = records.groupBy("proof").agg(F.count("*").alias("n"))
    placed = headers.join(size, "proof", "left").withColumn("last", F.col("seq") + F.coalesce("n", F.lit(0)))
    # places count a chain's rows, so that numbers may have gaps
    ranked = heads.withColumn("nth", F.row_number().over(Window.partitionBy("chain").orderBy("seq")))
    start = placed.join(ranked.select("chain", F.col("seq"), F.col("head").alias("was"), F.col("nth").alias("at")), ["chain", "seq"], "left").withColumn("at", F.when(F.col("seq") == 0, 0).otherwise(F.col("at")))
    end = start.withColumn("nth", F.col("at") + F.coalesce("n", F.lit(0))).join(ranked.select("chain", "nth", F.col("head").alias("became")), ["chain", "nth"], "left")
    became = F.when(F.col("nth") == 0, F.lit("")).otherwise(F.col("became"))
    was = F.when(F.col("seq") == 0, F.lit("")).otherwise(F.col("was"))
    astray = end.filter(~(was.eqNullSafe(F.col("head_before")) & became.eqNullSafe(F.col("head_after")))).select("proof", F.lit(FAULTS[5]).alias("fault"))
    there = named.withColumn("id", F.col("id").cast("string")).join(live.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("proof", F.lit(FAULTS[6]).alias("fault")).distinct()
    faults = own.select("proof", F.explode("faults").alias("fault")).unionByName(astray).unionByName(there)
    order = F.create_map(*(F.lit(x) for k, f in enumerate(FAULTS) for x in (f, k)))
    first = faults.groupBy("proof").agg(F.min_by("fault", order[F.col("fault")]).alias("fault"))
    return headers.select("proof").join(first, "proof", "left").select("proof", F.coalesce("fault", F.lit("verified")).alias("verdict"))
