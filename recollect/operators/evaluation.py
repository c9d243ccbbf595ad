"""Retrieval and extraction metrics, span arithmetic and budgeted selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import token_f1
from recollect.operators.ranks import ranked


def retrieval(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: any and all gold in the first k, NDCG at k. The ideal is the retrieved relevances sorted, so missed gold doesn't lower it."""
    head = hits.filter(F.col("rank") <= k).join(gold.withColumn("rel", F.lit(1.0)), ["query_id", "id"], "left").fillna({"rel": 0.0})
    return graded(head, gold.groupBy("query_id").agg(F.count("*").alias("wanted")))


def graded(head: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same of first hits (query_id, rank, rel) and the number of gold rows of each query (query_id, wanted)."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank"))
    gain = head.withColumn("ideal", place).groupBy("query_id").agg(F.sum("rel").alias("found"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("rel") / F.log2(F.col("ideal") + 1)).alias("idcg"))
    out = wanted.join(gain, "query_id", "left").fillna({"found": 0.0, "dcg": 0.0, "idcg": 0.0})
    return out.select("query_id", (F.col("found") > 0).alias("any"), (F.col("found") == F.col("wanted")).alias("all"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def merged_spans(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching spans (key, s, e) as disjoint ones; a span without a begin stays by itself."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("s"), F.asc_nulls_last("e"))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_n", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _added(have: list[tuple[int, int]], span: tuple[int, int]) -> int:
    return sum(e - s for s, e in _merge([*have, span])) - sum(e - s for s, e in have)


def _walked(rows: DataFrame, step: type, schema: str) -> DataFrame:
    """What ``step`` gives for the rows of each query in the order of (query_id, rank): tasks hold whole queries, sorted, and
    go through them in batches, with the state of one query at a time."""
    columns = ["query_id", "rank", *(c for c in rows.columns if c not in ("query_id", "rank"))]
    names = [f.split()[0] for f in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if state is None or row[0] != query:
                    out += state.end() if state else ()
                    query, state = row[0], step(row[0])
                out += state.take(*row[1:])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(names), types, strict=True)], names)
        out = state.end() if state else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [{"long": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]
    return rows.select(*columns).repartition("query_id").sortWithinPartitions("query_id", "rank").mapInArrow(walk, schema)


class _Select:
    """Takes hits while what each adds to its room fits the budget."""

    budget: int

    def __init__(self, query):
        self.query, self.spent, self.have = query, 0, {}

    def take(self, rank, room, s, e) -> list[tuple]:
        if s is None or e is None:
            return []
        have = self.have.get(room, [])
        add = _added(have, (s, e))
        if not add or self.spent + add > self.budget:
            return []
        self.spent += add
        self.have[room] = _merge([*have, (s, e)])
        return [(self.query, rank, add, self.spent)]

    def end(self) -> list[tuple]:
        return []


def selected(hits: DataFrame, budget: int) -> DataFrame:
    """Hits (query_id, rank, room, s, e) taken in order while what each adds to its room fits the budget; those without a span add nothing."""
    return _walked(hits.select("query_id", "rank", "room", "s", "e"), type("Select", (_Select,), {"budget": budget}), "query_id long, rank int, added long, spent long")


class _Cover:
    """What the hits so far leave uncovered of the wanted spans, which come before them."""

    buckets: tuple[int, ...]

    def __init__(self, query):
        self.query, self.left, self.rank = query, {}, None

    def take(self, rank, room, s, e, wanted) -> list[tuple]:
        if wanted:
            self.left.setdefault(room, []).append((s, e))
        elif self.rank is None:
            if room in self.left and s is not None and e is not None:
                self.left[room] = [piece for a, b in self.left[room] for piece in self._less(a, b, s, e)]
            if not any(self.left.values()):
                self.rank = rank
        return []

    @staticmethod
    def _less(a, b, s, e) -> list[tuple]:
        if a is None or b is None:
            return [(a, b)]
        if a >= b:  # a point: covered by a span that holds it or ends there
            return [] if s <= a and b <= e else [(a, b)]
        if s >= e:
            return [(a, b)]
        return [(x, y) for x, y in ((a, min(b, s)), (max(a, e), b)) if x < y]

    def end(self) -> list[tuple]:
        return [(self.query, self.rank, next((b for b in self.buckets if self.rank is not None and self.rank <= b), None))]


def covering_rank(hits: DataFrame, wanted: DataFrame, buckets: tuple[int, ...] = (10, 20, 40, 80, 160)) -> DataFrame:
    """Per query the least rank whose hits together cover every wanted span (query_id, room, s, e), and its bucket; null if none does."""
    first = F.lit(None).cast("int")  # nulls sort first: what is wanted comes before all hits
    both = hits.select("query_id", "rank", "room", "s", "e", F.lit(False).alias("wanted")).unionByName(wanted.select("query_id", first.alias("rank"), "room", "s", "e", F.lit(True).alias("wanted")))
    return _walked(both, type("Cover", (_Cover,), {"buckets": buckets}), "query_id long, rank long, bucket long")


def aligned(predicted: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs (group, p, g, f1) of predicted and gold token lists, best first, at least the threshold."""
    scored = predicted.join(gold, "group").select("group", "p", "g", token_f1(F.col("p_tokens"), F.col("g_tokens")).alias("f1")).filter(F.col("f1") >= threshold)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used_p, used_g, out = set(), set(), []
        for r in pdf.sort_values(["f1", "p", "g"], ascending=[False, True, True]).itertuples():
            if r.p not in used_p and r.g not in used_g:
                used_p.add(r.p)
                used_g.add(r.g)
                out.append((r.group, r.p, r.g, r.f1))
        return pd.DataFrame(out, columns=["group", "p", "g", "f1"])

    return scored.groupBy("group").applyInPandas(greedy, "group long, p long, g long, f1 double")


def floor_percentiles(values: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.99, 1.0)) -> DataFrame:
    """Values at index floor((n - 1) * share) of each key's sorted values."""
    sizes = values.groupBy(key).agg(F.count("*").alias("n"))
    names = {s: f"p{int(s * 100)}" for s in shares}
    # the places asked for are a few rows a key, whatever its size
    asked = sizes.select(F.col(key).alias("_key"), "n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.floor((F.col("n") - 1) * s) + 1).alias("rank")) for s, name in names.items()))).alias("_a"))
    held = ranked(values.select(key, value), key, value)
    found = held.join(asked, held[key].eqNullSafe(asked["_key"]) & (held["rank"] == asked["_a.rank"]))
    return found.groupBy(key).agg(*(F.max(F.when(F.col("_a.name") == name, F.col(value))).alias(name) for name in names.values()), F.max("n").alias("n"))
