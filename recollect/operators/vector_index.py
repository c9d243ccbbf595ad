"""A stored vector index: inverted lists of product-quantised codes below a folder, one partition for each list.

Centroids and codebooks are fitted on a bounded sample and kept with the lists, as is the number of lists to probe: the
least with which TRIALS vectors of the sample find RECALL of their exact neighbours. Vectors are added to the lists of the
centroids there are; when more than ``STALE`` times the vectors it was fitted for are live, the index is fitted and
written anew. A search reads the lists its queries probe, ranks their entries by table look-ups on the codes, and scores a
pool of the nearest by the vectors themselves.

A query may have a scope: a set of members that alone count, or that don't. The sets meet the lists by a join, so only
entries that count are ranked, and a query goes on to further lists until they hold a pool of entries that count for it,
or there are none: members of a rare scope are all seen, wherever they lie.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import vectors as V
from recollect.operators import search as S
from recollect.sources import work as W

SAMPLE, STALE, PAGE = 16_384, 1.5, 16_384
#: Queries that meet a page of a list in one task, and rows that a task makes at a time.
ASKED, ROWS_AT_ONCE = 1024, 4096
TRIALS, RECALL, DEPTH = 256, 0.97, 10
ROWS = "id long, embedding array<float>, codes array<short>, list_id int"


def _order(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """All lists, nearest first, for each vector."""
    return np.argsort((centre * centre).sum(1)[None] - 2 * V.ProductQuantizer.unit(x) @ centre.T, axis=1, kind="stable")


class VectorIndex:
    """An index of vectors (id, embedding), each id once; one that was built before at the path is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if "model" in W.names(spark, path):
            model = json.loads(spark.read.text(f"{path}/model").first()[0])
            self.centre, self.coder = np.array(model["centre"]), V.ProductQuantizer.of([np.array(b) for b in model["books"]])
            self.probes, self.trained, self.live = model["probes"], model["trained"], self.entries().count()

    def build(self, vectors: DataFrame, lists: int | None = None) -> None:
        """Fits and writes the index of these vectors, in place of what there was."""
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        live = rows.count()
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
        x = np.stack(sample["embedding"].to_numpy()).astype(float)
        self.centre = V.lloyd(V.ProductQuantizer.unit(x), lists or min(max(int(live**0.5), 16), 4096))
        self.coder = V.ProductQuantizer(x)
        staged = W.fresh(self.spark, "vector-lists")
        self._listed(rows).write.partitionBy("list_id").parquet(staged)
        W.remove(self.spark, f"{self.path}/lists")
        self.spark.read.schema(ROWS).parquet(staged).write.partitionBy("list_id").parquet(f"{self.path}/lists")
        W.remove(self.spark, staged)
        self.trained = self.live = live
        self.probes = self._measured(sample[:TRIALS])
        model = {"centre": self.centre.tolist(), "books": [b.tolist() for b in self.coder.books], "probes": self.probes, "trained": live}
        self.spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/model")

    def _measured(self, trials: pd.DataFrame) -> int:
        """How many lists these vectors must probe to find RECALL of their DEPTH nearest."""
        asked = self.spark.createDataFrame(trials[["id", "embedding"]], "id long, embedding array<float>")
        found = S.nearest(asked, self.entries().select("id", "embedding"), DEPTH).join(self.entries().select("id", "list_id"), "id")
        own = found.select("query_id", "list_id").toPandas()  # DEPTH rows a trial
        if not len(own):
            return len(self.centre)
        order = _order(np.stack(trials["embedding"].to_numpy()).astype(float), self.centre)
        place = {(q, lst): p for q, lists in zip(trials["id"], order, strict=True) for p, lst in enumerate(lists.tolist())}
        places = sorted(place[key] for key in zip(own["query_id"], own["list_id"], strict=True))
        return max(1, places[min(len(places) - 1, int(np.ceil(RECALL * len(places))) - 1)] + 1)

    def _listed(self, rows: DataFrame) -> DataFrame:
        centre, coder = self.centre, self.coder

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["embedding"].to_numpy()).astype(float)
                    near = V._near(coder.unit(x), centre).astype("int32")
                    yield pd.DataFrame({"id": pdf["id"], "embedding": pdf["embedding"], "codes": list(coder.encode(x).astype("int16")), "list_id": near})

        return rows.mapInPandas(place, ROWS)

    def add(self, vectors: DataFrame) -> bool:
        """Adds vectors of new ids; whether the index had to be fitted anew."""
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        new = rows.count()
        if self.live + new > STALE * self.trained:
            self.build(self.entries().select("id", "embedding").unionByName(rows))
            return True
        self._listed(rows).write.mode("append").partitionBy("list_id").parquet(f"{self.path}/lists")
        self.live += new
        return False

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, pool: int | None = 200, members: DataFrame | None = None, without: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of the k best by cosine for each query (id, embedding, and scope if scopes differ), not
        itself, among the ``pool`` nearest codes of the probed lists (as many as were measured, if not said), or with no
        pool among all their entries. ``members`` (id, and scope if scopes differ) alone count, or, with ``without``, don't."""
        scope = lambda rows: (F.col("scope").cast("string") if "scope" in rows.columns else F.lit("")).alias("scope")
        asked = queries.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), scope(queries))
        entries = self.entries()
        sizes = {r["list_id"]: r["n"] for r in entries.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # at most 4,096 rows
        if members is None:
            entries = entries.withColumn("scopes", F.lit(None).cast("array<string>"))
            asked = asked.withColumns({"lists": F.array().cast("array<int>"), "sizes": F.array().cast("array<long>")})
        else:
            sets = members.select(F.col("id").cast("long").alias("id"), scope(members)).distinct().groupBy("id").agg(F.collect_list("scope").alias("scopes"))
            entries = entries.join(sets, "id", "left" if without else "inner")
            held = entries.select("list_id", F.explode("scopes").alias("scope")).groupBy("scope", "list_id").agg(F.count("*").alias("n"))
            held = held.groupBy("scope").agg(F.collect_list("list_id").alias("lists"), F.collect_list("n").alias("sizes"))  # at most 4,096 numbers a scope
            asked = asked.join(held, "scope", "left")
        probed = self._probed(asked, sizes, probes or self.probes, max(k + 1, pool or 0), members is not None, without)
        return self._ranked(probed, queries.count(), entries, sizes, k, pool, members is not None, without)

    def _probed(self, asked: DataFrame, sizes: dict[int, int], probes: int, enough: int, scoped: bool, without: bool) -> DataFrame:
        """(query_id, scope, list_id, page, probe): the lists that each query goes to."""
        centre, n_lists = self.centre, len(self.centre)
        pages = {own: -(-n // PAGE) for own, n in sizes.items()}
        whole, named = np.array([sizes.get(lst, 0) for lst in range(n_lists)]), ["query_id", "scope", "list_id", "page", "probe"]

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                rows, parts = [], [pdf[at : at + ASKED] for at in range(0, len(pdf), ASKED)]
                nearest = (own for part in parts for own in _order(np.stack(part["embedding"].to_numpy()).astype(float), centre))
                for i, v, scope, lists, counts, own in zip(pdf["id"], pdf["embedding"], pdf["scope"], pdf["lists"], pdf["sizes"], nearest, strict=True):
                    count = np.zeros(n_lists, np.int64)
                    if lists is not None and len(lists):
                        count[np.asarray(lists, np.int64)] = np.asarray(counts, np.int64)
                    count = whole - count if without or not scoped else count
                    # at least ``probes`` lists, and on until they hold enough entries that count
                    last = max(probes, int(np.searchsorted(np.cumsum(count[own]), enough)) + 1)
                    rows += [(i, scope, lst, page, v) for lst in own[:last].tolist() if count[lst] for page in range(pages.get(lst, 0))]
                    while len(rows) >= ROWS_AT_ONCE:
                        yield pd.DataFrame(rows[:ROWS_AT_ONCE], columns=named)
                        rows = rows[ROWS_AT_ONCE:]
                yield pd.DataFrame(rows, columns=named)

        return asked.mapInPandas(probe, "query_id long, scope string, list_id int, page int, probe array<float>")

    def _ranked(self, probed: DataFrame, queries: int, entries: DataFrame, sizes: dict[int, int], k: int, pool: int | None, scoped: bool, without: bool) -> DataFrame:
        coder, most = self.coder, pool or k

        def scan(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "id": [], "near": [], "score": []})]
            if len(asked) and len(held):
                codes, x, ids = np.stack(held["codes"].to_numpy()).astype(np.uint8), coder.unit(np.stack(held["embedding"].to_numpy()).astype(float)), held["id"].to_numpy()
                inside: dict[str, list[int]] = {}
                for row, scopes in enumerate(held["scopes"] if scoped else ()):
                    for scope in scopes if scopes is not None else ():
                        inside.setdefault(scope, []).append(row)
                for query, scope, v in zip(asked["query_id"], asked["scope"], asked["probe"], strict=True):
                    v = np.asarray(v, float)
                    count = np.full(len(ids), without or not scoped)
                    count[inside.get(scope, [])] = not without
                    at = np.flatnonzero(count & (ids != query))
                    d = coder.distances(v, codes[at]) if pool else -(x[at] @ coder.unit(v[None])[0])
                    first = at[np.lexsort((ids[at], d))[:most]]
                    out.append(pd.DataFrame({"query_id": query, "id": ids[first], "near": np.sort(d)[:most], "score": x[first] @ coder.unit(v[None])[0]}))
            return pd.concat(out)

        count = F.create_map(*(F.lit(x) for own, n in sizes.items() for x in (own, -(-n // PAGE))))
        held = entries.withColumn("page", F.pmod(F.xxhash64("id"), count[F.col("list_id")].cast("long")).cast("int"))
        # queries of a page are dealt into parts, so that a task's hits stay few however many queries there are; a page goes to
        # the parts in which its list is asked for, and lists that none asks for aren't read
        parts = max(1, -(-queries // ASKED))
        probed = probed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts).cast("long")).cast("int"))
        met = probed.groupBy("list_id").agg(F.collect_set("part").alias("parts"))  # at most 4,096 rows
        held = held.join(met.hint("broadcast"), "list_id").withColumn("part", F.explode("parts")).drop("parts")
        own = ["list_id", "page", "part"]
        hits = probed.groupBy(*own).cogroup(held.groupBy(*own)).applyInPandas(scan, "query_id long, id long, near double, score double")
        nearest = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "id"))).filter(F.col("r") <= most)
        return nearest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")
