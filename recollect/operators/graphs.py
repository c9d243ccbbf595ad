"""Graph operators over edges and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tunnelled(edges: DataFrame, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Edges with new ones (from_wing, to_wing, label) added once, under an id of their parts, and those of ``gone`` (id) removed."""
    key = F.substring(F.sha2(F.concat_ws("\u001f", F.least("from_wing", "to_wing"), F.greatest("from_wing", "to_wing"), "label"), 256), 1, 32)
    out = edges.select("from_wing", "to_wing", "label").unionByName(new).withColumn("id", key).dropDuplicates(["id"])
    return out if gone is None else out.join(gone, "id", "left_anti")


def followed(edges: DataFrame, node) -> DataFrame:
    """Neighbours of a node along undirected edges (from_wing, to_wing, label)."""
    there = edges.filter(F.col("from_wing") == node).select(F.col("to_wing").alias("wing"), "label")
    return there.unionByName(edges.filter(F.col("to_wing") == node).select(F.col("from_wing").alias("wing"), "label")).distinct()


def traversed(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) reached from start (node), breadth first over undirected edges (a, b); each step only extends the new nodes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = start.select("node", F.lit(0).alias("depth"))
    front = seen
    for step in range(1, depth + 1):
        front = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(front)
    return seen


def hallways(records: DataFrame, latest: int | None = None, least: int = 2) -> DataFrame:
    """Pairs of entities by how many records (id, filed_at, entities) name both."""
    if latest is not None:
        records = records.orderBy(F.desc("filed_at"), F.desc("id")).limit(latest)
    named = records.select("id", F.explode(F.array_distinct("entities")).alias("entity"))
    pairs = named.alias("x").join(named.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.entity") < F.col("y.entity")))
    counted = pairs.groupBy(F.col("x.entity").alias("entity_a"), F.col("y.entity").alias("entity_b")).agg(F.count("*").alias("strength"))
    return counted.filter(F.col("strength") >= least)


def closets(records: DataFrame, entities: int = 6, ids: int = 4) -> DataFrame:
    """Per wing and room: count, first and last day, most frequent entities, first ids."""
    base = records.groupBy("wing", "room").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    named = records.select("wing", "room", F.explode("entities").alias("entity")).groupBy("wing", "room", "entity").agg(F.count("*").alias("f"))
    order = Window.partitionBy("wing", "room").orderBy(F.desc("f"), "entity")
    top = named.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= entities).groupBy("wing", "room").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"]).alias("entities"))
    firsts = records.withColumn("r", F.row_number().over(Window.partitionBy("wing", "room").orderBy("id"))).filter(F.col("r") <= ids).groupBy("wing", "room").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return base.join(top, ["wing", "room"], "left").join(firsts, ["wing", "room"])
