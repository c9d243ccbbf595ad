"""Stewardship of records: duplicates, trust, retention, admission, audit chain, forgetting."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import hashing as H
from recollect.functions import text as X
from recollect.operators.ranks import ranked
from recollect.operators.search import QUARANTINE


def record_totals(records: DataFrame) -> DataFrame:
    """Records, wings and rooms outside the quarantine wing, in one aggregate."""
    return records.filter(F.col("wing") != QUARANTINE).agg(F.count("*").alias("records"), F.countDistinct("wing").alias("wings"), F.countDistinct("wing", "room").alias("rooms"))


def totals(records: DataFrame, tunnels: DataFrame, audit: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: record totals, tunnels, writes in the audit, and facts by whether they are open."""
    one = record_totals(records).crossJoin(tunnels.agg(F.count("*").alias("tunnels"))).crossJoin(audit.agg(F.count("*").alias("writes")))
    return one.crossJoin(facts.agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull()).alias("open_facts")))  # one row each


def duplicate_groups(records: DataFrame) -> DataFrame:
    """Fingerprints that more than one record outside quarantine has."""
    return records.filter(F.col("wing") != QUARANTINE).groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("keeps")).filter("n > 1")


def deduplicated(records: DataFrame) -> DataFrame:
    """Survivors of duplicate groups (the least id) with the occurrences (content_date, filed_at) of all they stand for:
    one for each date, the first filed, the undated first. Dates are merged before they are gathered, so a group's
    list grows with its dates, not with its copies."""
    groups = records.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    dated = records.select("fp", F.explode("occurrences").alias("o")).groupBy("fp", "o.content_date").agg(F.min("o.filed_at").alias("filed_at"))
    lists = dated.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("content_date", F.lit("")).alias("k"), "content_date", "filed_at"))).alias("o"))
    merged = F.transform("o", lambda x: F.struct(x["content_date"].alias("content_date"), x["filed_at"].alias("filed_at")))
    return groups.join(lists, "fp").select("id", "n", merged.alias("occurrences"))


def expired(records: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Ids older than any policy (wing, room or '' for the whole wing, max_age_days) of theirs allows; strictly older."""
    p = policies.select(F.col("wing").alias("_w"), F.col("room").alias("_r"), "max_age_days")
    hit = (F.col("wing") == F.col("_w")) & ((F.col("_r") == "") | (F.col("room") == F.col("_r")))
    rows = records.join(F.broadcast(p), hit)  # policies are a declared list
    return rows.filter(F.col("filed_at") < now - F.make_interval(days=F.col("max_age_days"))).select("id").distinct()


def rate_flags(events: DataFrame, key: str, at: str, seconds: int, count: int) -> DataFrame:
    """Events with at least ``count`` others of their key in the ``seconds`` before them. A key's time is cut into spans
    of that length, and each span counts its events and those of the span before, so a busy key is many tasks."""
    t = F.col(at).cast("timestamp").cast("long")
    spans = F.explode(F.array(F.struct(F.lit(False).alias("before"), F.floor(t / seconds).alias("span")), F.struct(F.lit(True).alias("before"), (F.floor(t / seconds) + 1).alias("span"))))
    w = Window.partitionBy(key, "_s.span").orderBy(t).rangeBetween(-seconds, 0)
    counted = events.withColumn("_s", spans).withColumn("recent", F.count("*").over(w) - 1)
    return counted.filter("not _s.before").drop("_s").withColumn("flagged", F.col("recent") >= count)


def sampling_caps(rows: DataFrame, want: int, divisor: int = 8) -> DataFrame:
    """One row: wings, agents, and how many of ``want`` sampled rows one wing and one agent may give: an even split over
    as many groups as there are, ``divisor`` at most."""
    one = rows.agg(F.countDistinct("wing").alias("wings"), F.countDistinct("agent").alias("agents"))
    cap = lambda n: F.ceil(F.lit(want) / F.least(F.lit(divisor), F.greatest(n, F.lit(1))))
    return one.select("wings", "agents", cap(F.col("wings")).alias("wing_cap"), F.when(F.col("agents") > 0, cap(F.col("agents"))).alias("agent_cap"))


def diverted(records: DataFrame, signals: Column, rate: Column | None = None, trusted: Column | None = None) -> DataFrame:
    """Records with any signal go to the quarantine wing under a quarantine id, their aim kept; (id, wing, room, source, chunk)."""
    wrong_place = F.size(X.screen(F.concat_ws(" ", "wing", "room"))) > 0
    codes = F.concat(F.transform(signals, lambda s: s["code"]), F.when(rate, F.array(F.lit("rate-anomaly"))).otherwise(F.array().cast("array<string>")) if rate is not None else F.array().cast("array<string>"),
                     F.when(wrong_place, F.array(F.lit("destination-anomaly"))).otherwise(F.array().cast("array<string>")))
    out = records.withColumn("signals", codes)
    hit = (F.size("signals") > 0) & (F.col("wing") != QUARANTINE)
    hit = hit & ~trusted if trusted is not None else hit
    return out.withColumns({
        "intended_wing": F.when(hit, F.col("wing")), "intended_room": F.when(hit, F.col("room")),
        "id": F.when(hit, H.drawer_id(F.col("wing"), F.col("room"), F.col("source"), F.col("chunk"), "quarantine")).otherwise(F.col("id")), "wing": F.when(hit, QUARANTINE).otherwise(F.col("wing")),
    })


def allowed(records: DataFrame, ids: Column) -> DataFrame:
    """Quarantined records that were looked at and allowed: back where they were meant to go."""
    back = ids & (F.col("wing") == QUARANTINE)
    home = H.drawer_id(F.col("intended_wing"), F.col("intended_room"), F.col("source"), F.col("chunk"))
    return records.withColumns({
        "id": F.when(back, home).otherwise(F.col("id")), "wing": F.when(back, F.col("intended_wing")).otherwise(F.col("wing")),
        "intended_wing": F.when(~back, F.col("intended_wing")), "intended_room": F.when(~back, F.col("intended_room")),
    })


def pending(records: DataFrame) -> DataFrame:
    """Quarantined records that wait for a decision: id, aim, signals."""
    return records.filter(F.col("wing") == QUARANTINE).select("id", "intended_wing", "intended_room", "signals")


def denied(records: DataFrame, ids: Column) -> tuple[DataFrame, DataFrame]:
    """Records without the quarantined ones that were looked at and refused, and tombstones (id) of these; others can't be denied."""
    gone = ids & (F.col("wing") == QUARANTINE)
    return records.filter(~F.coalesce(gone, F.lit(False))), records.filter(gone).select("id")


def read_audit(hits: DataFrame, actor: str, at: Column) -> DataFrame:
    """A row (record_id, action, actor, at) for each record whose content a read returned."""
    return hits.select(F.col("id").cast("string").alias("record_id"), F.lit("read").alias("action"), F.lit(actor).alias("actor"), at.alias("at")).distinct()


def tagged(rows: DataFrame, key: bytes, *parts: str) -> DataFrame:
    """Rows with the tag of some columns under a key."""
    return rows.withColumn("tag", H.hmac(key, F.concat_ws("\u001f", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))))


def retagged(rows: DataFrame, old: bytes, new: bytes, *parts: str) -> tuple[DataFrame, DataFrame]:
    """(rows under the new key, rows whose tag the old key doesn't hold): a forged row is never given a fresh tag."""
    had = tagged(rows.withColumnRenamed("tag", "_had"), old, *parts)
    return tagged(had.filter("_had = tag").drop("_had"), new, *parts), had.filter("not _had <=> tag").drop("tag").withColumnRenamed("_had", "tag")


def verified_all(parts: dict[str, tuple[DataFrame, tuple[str, ...]]], key: bytes, audit: DataFrame, heads: DataFrame) -> DataFrame:
    """(part, checked, faults): the tags of each part's rows, and the audit's chains against their stored heads."""
    out = heads.agg(F.count("*").alias("checked")).crossJoin(verified(audit, heads).agg(F.count("*").alias("faults"))).select(F.lit("chain").alias("part"), "checked", "faults")
    for name, (rows, columns) in parts.items():
        again = tagged(rows.withColumnRenamed("tag", "_had"), key, *columns)
        out = out.unionByName(again.agg(F.count("*").alias("checked"), F.count_if(~F.col("_had").eqNullSafe(F.col("tag"))).alias("faults")).select(F.lit(name).alias("part"), "checked", "faults"))
    return out


def history(audit: DataFrame, subject: str, fenced: list[str] = ()) -> DataFrame:
    """Audit rows of a subject: its id, or a path that begins or ends with it, outside fenced name spaces."""
    hit = (F.col("record_id") == subject) | F.endswith(F.col("record_id"), F.lit("/" + subject)) | F.startswith(F.col("record_id"), F.lit(subject + "/"))
    for name in fenced:
        hit = hit & ~F.startswith(F.col("record_id"), F.lit(name))
    return audit.filter(hit)


def _carried(batches: Iterator[pd.DataFrame], key: bytes | None = None) -> Iterator[pd.DataFrame]:
    """Heads of rows sorted by chain and seq; the head goes on from batch to batch."""
    at, head = None, ""
    for pdf in batches:
        heads = []
        for chain, tag in zip(pdf["chain"], pdf["tag"], strict=True):
            step = ((head if chain == at else "") + "\x1f" + tag).encode()
            head = hashlib.sha256(step).hexdigest() if key is None else hmac.new(key, step, "sha256").hexdigest()
            at = chain
            heads.append(head)
        yield pd.DataFrame({"chain": pdf["chain"], "seq": pdf["seq"], "head": heads})


def chain_heads(audit: DataFrame, key: bytes | None = None) -> DataFrame:
    """(chain, seq, head) of audit rows (chain, seq, tag): a fold in order of seq, under a key if one is given. A chain is
    sorted and streamed through the fold, so a task holds one batch of it, whatever its length; a fold can't be split."""
    rows = audit.select(F.col("chain").cast("string").alias("chain"), "seq", "tag")
    return rows.repartition("chain").sortWithinPartitions("chain", "seq").mapInPandas(lambda it: _carried(it, key), "chain string, seq long, head string")


def verified(audit: DataFrame, heads: DataFrame, key: bytes | None = None) -> DataFrame:
    """Rows whose recomputed head differs from the stored one."""
    again = chain_heads(audit, key).withColumnRenamed("head", "now")
    return heads.join(again, ["chain", "seq"], "full").filter(~F.col("head").eqNullSafe(F.col("now")))


def forget_check(attested: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What a forgetting claims and what the audit shows, both ways: claimed without a tombstone, tombstoned without a claim."""
    missing = attested.join(tombstones, "id", "left_anti").select("id", F.lit("no tombstone").alias("fault"))
    return missing.unionByName(tombstones.join(attested, "id", "left_anti").select("id", F.lit("not attested").alias("fault")))


def islands(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """Contiguous runs of seq within a group: (group, first, last, n)."""
    return ranked(rows.select(group, seq), group, seq).withColumn("_i", F.col(seq) - F.col("rank")).groupBy(group, "_i").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n")).drop("_i")


def updated(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records with the contents of changes (id, content) in place of theirs."""
    new = changes.select("id", F.col("content").alias("_new"))
    return records.join(new, "id", "left").withColumn("content", F.coalesce("_new", "content")).drop("_new")
