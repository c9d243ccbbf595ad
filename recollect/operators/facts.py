"""Temporal facts: (id, subject, predicate, object, valid_from, valid_to, confidence, extracted_at, ...) with text instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import temporal as D


def upserted(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with new ones added; a fact of the same id is replaced by the latest extracted."""
    both = facts.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy(F.desc("_new"), F.desc("extracted_at"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def about(facts: DataFrame, name: str, direction: str = "both", at: str | None = None) -> DataFrame:
    """Facts of an entity as subject (outgoing), object (incoming) or either, valid at an instant (open ones without)."""
    side = {"outgoing": F.col("subject") == name, "incoming": F.col("object") == name, "both": (F.col("subject") == name) | (F.col("object") == name)}[direction]
    return facts.filter(side).filter(D.valid_at(F.col("valid_from"), F.col("valid_to"), None if at is None else F.lit(at)))


def related(facts: DataFrame, predicate: str, at: str | None = None) -> DataFrame:
    """Facts of a predicate valid at an instant."""
    return facts.filter(F.col("predicate") == predicate).filter(D.valid_at(F.col("valid_from"), F.col("valid_to"), None if at is None else F.lit(at)))


def invalidated(facts: DataFrame, chosen: Column, at: str) -> DataFrame:
    """Closes the open facts chosen, except approved canonical ones, which only their authority may close."""
    guarded = (F.coalesce("authority_class", F.lit("")) == "canonical") & (F.coalesce("review_state", F.lit("")) == "approved") if "authority_class" in facts.columns else F.lit(False)
    return facts.withColumn("valid_to", F.when(chosen & F.col("valid_to").isNull() & ~guarded, F.lit(at)).otherwise(F.col("valid_to")))


def superseded(states: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """valid_from and valid_to of successive states of a key: each state ends where the next begins."""
    w = Window.partitionBy(*key).orderBy(*order)
    return states.withColumn("valid_to", F.lead("valid_from").over(w))


def timeline(facts: DataFrame) -> DataFrame:
    """Place of each fact by start (unknown first), then extraction, within its subject."""
    w = Window.partitionBy("subject").orderBy(F.coalesce(D.temporal_key(F.col("valid_from")), F.lit("")), "extracted_at", "id")
    return facts.withColumn("place", F.row_number().over(w))


def stats(facts: DataFrame) -> DataFrame:
    """Entities, facts, open and closed facts, in one pass over exploded names."""
    named = facts.select("id", F.explode(F.array("subject", "object")).alias("name"), F.posexplode(F.array(F.col("valid_to"))).alias("_p", "closed"))
    one = facts.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("active"), F.count("valid_to").alias("closed"))
    return one.crossJoin(named.agg(F.countDistinct("name").alias("entities")))  # one row each


def canonical(facts: DataFrame) -> DataFrame:
    """The holder of each canonical key: canonical, approved, open, latest extracted."""
    held = facts.filter((F.col("authority_class") == "canonical") & (F.col("review_state") == "approved") & F.col("valid_to").isNull())
    return held.groupBy("canonical_key").agg(F.max_by(F.struct("id", "object"), F.struct("extracted_at", "id")).alias("h")).select("canonical_key", "h.id", "h.object")


def declared(facts: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """Facts with new ones declared canonical and approved: any other open holder of their canonical key ends at ``at``."""
    taking = new.groupBy("canonical_key").agg(F.max("id").alias("_keep"))
    both = upserted(facts, new.withColumns({"authority_class": F.lit("canonical"), "review_state": F.lit("approved")}))
    held = (F.col("authority_class") == "canonical") & (F.col("review_state") == "approved") & F.col("valid_to").isNull()
    ends = held & F.col("_keep").isNotNull() & (F.col("id") != F.col("_keep"))
    return both.join(taking, "canonical_key", "left").withColumn("valid_to", F.when(ends, F.lit(at)).otherwise(F.col("valid_to"))).drop("_keep")


def entities(facts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the names that facts are about, in order, with how many facts have them as subject and as object."""
    sides = facts.select(F.col("subject").alias("name"), F.lit(1).alias("s"), F.lit(0).alias("o")).union(facts.select("object", F.lit(0), F.lit(1)))
    return sides.groupBy("name").agg(F.sum("s").alias("as_subject"), F.sum("o").alias("as_object")).orderBy("name").offset(offset).limit(limit)


def exported(facts: DataFrame) -> DataFrame:
    """(id, line): each fact as one JSON object, its columns in order of name."""
    return facts.select("id", F.to_json(F.struct(*sorted(facts.columns))).alias("line"))


def receipts(facts: DataFrame, records: DataFrame) -> DataFrame:
    """verdict of each fact: its source record's fingerprint against the one on its receipt (source_id, fp, tag_valid)."""
    now = records.select(F.col("id").alias("source_id"), F.col("fp").alias("now"), F.lit(True).alias("there"))
    joined = facts.join(now, "source_id", "left")
    verdict = (
        F.when(F.col("fp").isNull() & F.col("tag_valid").isNull(), "unreceipted")
        .when(F.col("fp").isNull() | F.col("tag_valid").isNull() | ~F.col("tag_valid"), "tampered")
        .when(F.col("there").isNull(), "dangling")
        .when(F.col("fp") == F.col("now"), "verified")
        .otherwise("source-changed")
    )
    return joined.withColumn("verdict", verdict).drop("now", "there")


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """Each event with the latest state of its key that began by then: one sort of both sides, no range join."""
    payload = [c for c in states.columns if c not in (key, start)]
    tagged = states.select(key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(*payload, F.col(start)).alias("_state"), *(F.lit(None).cast(t).alias(f"_e_{n}") for n, t in events.dtypes))
    asked = events.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_state"), *(F.col(n).alias(f"_e_{n}") for n in events.columns))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.unionByName(asked).withColumn("_state", F.last("_state", ignorenulls=True).over(w)).filter("_kind = 1")
    return filled.select(*(F.col(f"_e_{n}").alias(n) for n in events.columns), *(F.col(f"_state.{c}").alias(c) for c in payload), F.col(f"_state.{start}").alias("state_from"))


def refined(texts: DataFrame, extract, confidence: float = 1.0) -> DataFrame:
    """Facts distilled from texts (id, content, filed_at): the extractor (a Column function giving structs of
    subject, predicate, object, claim) proposes, only claims that stand in the text stay, one row for each fact id."""
    from recollect.functions import hashing as H

    found = texts.select("id", "content", "filed_at", F.explode(extract(F.col("content"))).alias("t")).filter(F.contains(F.col("content"), F.col("t.claim")))
    out = found.select(
        H.triple_id(F.col("t.subject"), F.col("t.predicate"), F.col("t.object"), F.substring("filed_at", 1, 10)).alias("fact_id"),
        F.col("t.subject").alias("subject"), F.col("t.predicate").alias("predicate"), F.col("t.object").alias("object"), F.substring("filed_at", 1, 10).alias("valid_from"), F.lit(confidence).alias("confidence"), F.col("id").alias("source_id"),
    )
    return out.groupBy("fact_id", "subject", "predicate", "object", "valid_from", "confidence").agg(F.min("source_id").alias("source_id"), F.count("*").alias("seen"))
