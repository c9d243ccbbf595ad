"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each quantised by its own codebook; a cell is a pair of centroids. For
a query, the pairs are visited in order of their summed score (inner products of the halves with
their centroids) by the multi-sequence heap, until the cells visited hold enough vectors. The vectors
of those cells are reranked by the exact measure in double precision. What is enough is measured:
the true neighbours of ``TRIAL_QUERIES`` queries, found by one exact pass over all rows, show how far the
heap has to go for ``target`` of them. On clustered vectors that is a small share of the rows; vectors
without structure need a large one, whatever the index.

The codebooks are fitted on at most ``FIT_ROWS`` vectors, those of the least hashes; every vector is
indexed. They hold a power of two of centroids, so that a cell holds about ``CELL`` entries, up to
``MAX_CENTROIDS``. Equal vectors are one entry that keeps its ``top + 1`` least ids, which is all that any
query can return of them, so a vector with a third of all rows is one candidate; the least id names the
entry. Entries are compared by their left centroid in pages of about ``PAGE`` entries with pages of about
``PAGE`` queries: a crowded centroid is many pages, none left out, and a query is sent to a page once, with
the cells it visits there. Queries are dealt to their pages by their nearest left centroid, so that those
of a page visit alike, and a page of entries is sent only to the pages of queries that visit it. Of a page each query keeps its ``top + 1`` best entries, ties by least id. Codebooks (2 *
centroids half vectors) and the cell counts (centroids**2) are all that is shipped.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, neither as queries nor as candidates; fewer candidates than ``top`` give
fewer rows; ties go to the lesser id; of several vectors under one id the one of least hash counts; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.staging import Scratch, Staged

TOP, CELL, MAX_CENTROIDS = 20, 64, 1024
FIT_ROWS, ROUNDS, PAGE = 20_000, 12, 16_384
TRIAL_QUERIES, TARGET = 256, 0.96


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 4) -> np.ndarray:
    """Lloyd's centroids from distinct starting rows."""
    k = min(k, len(x))
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1)[None, :] - 2 * x @ centre.T).argmin(1)


def n_centroids(entries: int) -> int:
    """The centroids of a half: the least power of two whose square holds the entries in cells of ``CELL``."""
    return min(MAX_CENTROIDS, 1 << max(1, (max(entries, 1) // CELL).bit_length() + 1 >> 1))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def traverse(a: np.ndarray, b: np.ndarray, size: np.ndarray, enough: int) -> list[int]:
    """Cells i * len(b) + j by falling a[i] + b[j], until they hold ``enough`` entries."""
    p, q = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out, held = [(-(a[p[0]] + b[q[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(p[i]) * len(b) + int(q[j])
        if size[cell]:
            out.append(cell)
            held += int(size[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(p) and y < len(q) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[p[x]] + b[q[y]]), x, y))
    return out


class Index:
    """Codebooks of the halves and the number of entries of each cell."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.dim, self.cut = left, right, left.shape[1] + right.shape[1], left.shape[1]
        self.size = np.zeros(len(left) * len(right), np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.cut], self.left) * len(self.right) + _nearest(x[:, self.cut :], self.right)


def _assigned(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = index.cells(_matrix(batch.column("v"), index.dim)) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(batch.column(c) for c in ("entry", "h", "v"))], names=["cell", "entry", "h", "v"])


def _probed(batches: Iterator[pa.RecordBatch], index: Index, enough: int, pages: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each query at the pages it goes to, with the right centroids of the cells it visits there."""
    n_right = len(index.right)
    for batch in batches:
        x = _matrix(batch.column("v"), index.dim)
        a, b = x[:, : index.cut] @ index.left.T, x[:, index.cut :] @ index.right.T
        for at in range(0, len(x), 200):
            who, left, page, cells, asking = [], [], [], [], batch.column("asking")
            for i in range(at, min(at + 200, len(x))):
                by_left: dict[int, list[int]] = {}
                for c in traverse(a[i], b[i], index.size, enough):
                    by_left.setdefault(c // n_right, []).append(c % n_right)
                for own, rights in by_left.items():
                    for k in range(pages[own]):
                        who.append(i)
                        left.append(own)
                        page.append(k)
                        cells.append(rights)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int32()), pa.array(page, pa.int32()), *(c.take(pa.array(who, pa.int64())) for c in (asking, batch.column("query"), batch.column("v"))), pa.array(cells, pa.list_(pa.int32()))],
                names=["left", "page", "asking", "query", "v", "cells"],
            )


def _led(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Each query with the left centroid that it visits first."""
    for batch in batches:
        lead = (_matrix(batch.column("v"), index.dim)[:, : index.cut] @ index.left.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "h", "v")), pa.array(lead.astype(np.int32))], names=["query", "h", "v", "lead"])


def _dealt(asked: DataFrame, page: int) -> DataFrame:
    """asked (with lead) with its page of queries: those of a lead go together, about ``page`` to each."""
    sizes = asked.groupBy("lead").agg(F.count("*").alias("n")).orderBy("lead").collect()  # at most a row for each left centroid
    first, spread, before = [], [], 0
    for r in sizes:
        first += [F.lit(r["lead"]), F.lit(before)]
        spread += [F.lit(r["lead"]), F.lit(r["n"])]
        before += r["n"]
    if not sizes:
        return asked.withColumn("asking", F.lit(0))
    place = F.create_map(*first)[F.col("lead")] + F.pmod(F.xxhash64("query"), F.create_map(*spread)[F.col("lead")])
    return asked.withColumn("asking", F.floor(place / page).cast("int"))


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with those of y, summed component by component."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _best(query: np.ndarray, score: np.ndarray, entry: np.ndarray, keep: int) -> np.ndarray:
    """Each query's first ``keep`` rows by falling score, then least id."""
    order = np.lexsort((entry, -score, query))
    q = query[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[place < keep]


def _reranked(queries: pa.Table, entries: pa.Table, dim: int, top: int) -> pa.Table:
    """Each query's top + 1 best entries of one page. Matrix products choose those that may be among them, with a
    margin for rounding; the measure itself decides."""
    if not entries.num_rows or not queries.num_rows:
        return pa.table({"query": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    x, y = (_matrix(t.column("v").combine_chunks(), dim) for t in (queries, entries))
    ids, own, cell = entries.column("entry").to_numpy(), queries.column("query").to_numpy(), entries.column("right").to_numpy()
    margin = 1e-12 * dim * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
    asked = queries.column("cells").combine_chunks()
    visits = np.zeros((len(x), int(max(cell.max(), asked.flatten().to_numpy().max(initial=0))) + 1), bool)
    visits[np.repeat(np.arange(len(x)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()] = True
    order = np.lexsort(visits.T[::-1])  # queries that visit alike cells go together
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(x), 256):
        part = order[at : at + 256]
        members = np.flatnonzero(visits[part].any(0)[cell])
        if not len(members):
            continue
        about = np.where(visits[part][:, cell[members]], x[part] @ y[members].T, -np.inf)
        keep = min(top + 1, len(members))
        bar = -np.partition(-about, keep - 1, axis=1)[:, keep - 1]
        i, j = np.nonzero((about >= (bar - 2 * margin[part])[:, None]) & (about > -np.inf))
        i, j = part[i], members[j]
        score = paired(x[i], y[j])
        first = _best(i, score, ids[j], top + 1)
        out.append((i[first], j[first], score[first]))
    i, j, score = (np.concatenate([o[k] for o in out]) for k in range(3))
    return pa.table({"query": own[i], "entry": ids[j], "score": score})


def _trials(batches: Iterator[pa.RecordBatch], ids: np.ndarray, x: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """The best entries of each batch for each trial query, with their cells."""
    for batch in batches:
        score = x @ _matrix(batch.column("v"), x.shape[1]).T
        score[ids[:, None] == batch.column("h").to_numpy()[None, :]] = -np.inf
        keep = min(top, batch.num_rows)
        at = np.argpartition(-score, keep - 1, axis=1)[:, :keep] if keep else np.zeros((len(ids), 0), np.int64)
        who = np.repeat(np.arange(len(ids)), keep)
        yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), batch.column("cell").take(pa.array(at.ravel())), pa.array(score[who, at.ravel()])], names=["trial", "cell", "score"])


def _enough(celled: DataFrame, index: Index, asked: DataFrame, top: int, target: float) -> int:
    """How many entries the cells before a true neighbour's, and its own, hold, for ``target`` of those of the trial queries."""
    trial = asked.select("h", "v").distinct().orderBy(F.xxhash64("h", F.lit(5)), "h").limit(TRIAL_QUERIES).toArrow()
    if not trial.num_rows:
        return 0
    ids, x = trial.column("h").to_numpy(), _matrix(trial.column("v").combine_chunks(), index.dim)
    near = celled.mapInArrow(lambda it: _trials(it, ids, x, top), "trial int, cell int, score double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score")))).filter(F.col("r") <= top).select("trial", "cell").toArrow()
    need = []
    score = (x[:, : index.cut] @ index.left.T)[:, :, None] + (x[:, index.cut :] @ index.right.T)[:, None, :]
    for t in range(len(ids)):
        order = np.argsort(-score[t].ravel(), kind="stable")
        held = np.empty(len(order), np.int64)
        held[order] = np.cumsum(index.size[order])
        need.append(held[near.column("cell").to_numpy()[near.column("trial").to_numpy() == t]])
    need = np.concatenate(need)
    return int(np.quantile(need, target)) if len(need) else 0


def usable(v: Column, dim: int) -> Column:
    """Vectors that take part: dim finite components, not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) == dim) & ok, F.lit(False))


def search(vectors: DataFrame, queries: Column, top: int = TOP, centroids: int | None = None, target: float = TARGET, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of each row for which ``queries`` (on vec_id) holds."""
    with Scratch() as scratch:
        return scratch.keep(Staged(_search(vectors, queries, top, centroids, target, page), "ann-found"))


def _search(vectors: DataFrame, queries: Column, top: int, centroids: int | None, target: float, page: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null")
    width = rows.filter("size(v) > 0").groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = width["dim"] if width else 1
    one = F.min(F.struct(F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")).alias("one")
    rows = Staged(rows.filter(usable(F.col("v"), dim)).groupBy("vec_id").agg(one).select("vec_id", "one.*"), "ann-rows").df
    least = rows.select("h", "h2", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("h", "h2").orderBy("vec_id"))).filter(F.col("r") <= top + 1)
    members = Staged(least.select(F.min("vec_id").over(Window.partitionBy("h", "h2")).alias("entry"), "vec_id"), "ann-members").df
    entries = Staged(rows.groupBy("h", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("entry")).select("entry", "h", "v"), "ann-entries").df
    sample = entries.orderBy("h", "entry").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(sample, dim)
    centroids = centroids or n_centroids(entries.count())
    cut = (dim + 1) // 2 if dim > 1 else 1
    right = kmeans(x[:, cut:], centroids) if dim > 1 else np.zeros((1, 0))
    index = Index(kmeans(x[:, :cut], centroids), right)
    celled = Staged(entries.mapInArrow(lambda it: _assigned(it, index), "cell int, entry long, h long, v array<double>"), "ann-cells").df
    for r in celled.groupBy("cell").agg(F.count("*").alias("n")).toArrow().to_pylist():  # at most centroids**2 rows
        index.size[r["cell"]] = r["n"]
    asked = Staged(rows.filter(queries).select(F.col("vec_id").alias("query"), "h", "v"), "ann-queries").df
    enough = max(top + 1, _enough(celled, index, asked, top, target))
    n_right = len(index.right)
    pages = np.maximum(1, -(-index.size.reshape(-1, n_right).sum(1) // page))
    paged = celled.select(F.expr(f"cell div {n_right}").cast("int").alias("left"), (F.col("cell") % n_right).alias("right"), "entry", "v")
    paged = paged.withColumn("page", F.pmod(F.xxhash64("entry", F.lit(1)), F.element_at(F.lit(pages.tolist()), F.col("left") + 1)).cast("int"))
    shipped = spark.sparkContext.broadcast(index)
    led = Staged(asked.mapInArrow(lambda it: _led(it, shipped.value), "query long, h long, v array<double>, lead int"), "ann-led").df
    probes = _dealt(led, page).mapInArrow(lambda it: _probed(it, shipped.value, enough, pages), "left int, page int, asking int, query long, v array<double>, cells array<int>")
    probes = Staged(probes, "ann-probes").df
    wanted = probes.select("left", "page", F.col("asking").alias("by")).distinct()
    paged = paged.join(wanted, ["left", "page"]).withColumnRenamed("by", "asking")
    met = ["left", "page", "asking"]
    found = probes.groupBy(*met).cogroup(paged.groupBy(*met)).applyInArrow(lambda a, b: _reranked(a, b, dim, top), "query long, entry long, score double")
    listed = found.join(members, "entry").filter("query <> vec_id")
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= top)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
