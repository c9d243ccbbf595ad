"""Late interaction over token matrices: exact in pages, and by codes.

The score of a query's matrix and a record's is the sum, over the query's rows, of the best inner product with a row of the
record. Pages of queries meet pages of records, each two in one task, and give the k best of that page only.

``TokenIndex`` codes tokens: the nearest of a table of centroids, and what remains by a product quantiser. A record is
stored as these codes beside an int8 fixed-dimensional encoding, whose inner product with the query's stands for the
score. In a page, the encodings choose a pool; the pool is scored from look-up tables (a query row's products with all
centroids and with all codebook entries); the best of these are scored by the matrices themselves. How large a share of
a page the pool and its best must be is measured when the index is built, so that TRIALS records find RECALL of their
DEPTH best each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import vectors as V
from recollect.sources import work as W

ARTIFACT = "id long, codes array<array<int>>, scales array<double>, fde array<double>"
ENTRY = "id long, fde binary, scale double, tokens binary, rows array<array<float>>"
QUERY_PAGE, PAGE, SAMPLE, CENTROIDS, TRIALS, DEPTH, RECALL, PLACES = 256, 8192, 16_384, 256, 64, 10, 0.98, 9


def artifacts(matrices: DataFrame, encoder: V.FixedEncoder) -> DataFrame:
    """The artifacts of matrices (id, rows): int8 rows with their scales, and an encoding."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, rows in zip(pdf["id"], pdf["rows"], strict=True):
                x = np.stack(rows).astype(float) if len(rows) else np.zeros((0, encoder.dim))
                scale = np.abs(x).max(1, initial=0) / 127
                codes = np.where(scale[:, None] > 0, np.floor(np.abs(x) / np.where(scale > 0, scale, 1)[:, None] + 0.5) * np.sign(x), 0).astype(int)
                out.append((i, codes.tolist(), scale.tolist(), encoder.encode(x, False).tolist()))
            yield pd.DataFrame(out, columns=["id", "codes", "scales", "fde"])

    return matrices.select(F.col("id").cast("long").alias("id"), "rows").mapInPandas(make, ARTIFACT)


def missing(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records (id, ...) without an artifact."""
    return records.join(stored.select("id"), "id", "left_anti")


def restored(stored: DataFrame) -> DataFrame:
    """(id, rows) that artifacts stand for."""
    return stored.select("id", F.zip_with("codes", "scales", lambda row, scale: F.transform(row, lambda c: c * scale)).alias("rows"))


def _matrix(rows, dim: int) -> np.ndarray:
    return np.stack(rows).astype(float) if rows is not None and len(rows) else np.zeros((0, dim))


def _sums(products: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of products of query rows with the rows of consecutive records: each record's score, 0 without rows."""
    out, full = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(full) and len(products):
        begin = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.maximum.reduceat(products, begin, axis=1).sum(0)
    return out


def _paged(queries: DataFrame, records: DataFrame, scan: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``scan`` of each page of queries (query_id, asked) with each page of records (id, ...)."""
    asked, held = max(1, -(-queries.count() // QUERY_PAGE)), max(1, -(-records.count() // PAGE))
    one = queries.withColumns({"p": F.pmod(F.xxhash64("query_id"), F.lit(asked).cast("long")), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(held - 1).cast("long")))})
    two = records.withColumns({"q": F.pmod(F.xxhash64("id"), F.lit(held).cast("long")), "p": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long")))})
    two = two.toDF(*(f"{c}_" for c in two.columns)).toDF(*two.columns)  # columns of their own, where both come of one table
    return one.groupBy("p", "q").cogroup(two.groupBy("p", "q")).applyInPandas(scan, schema)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").cast("long").alias("query_id"), F.col("rows").cast("array<array<double>>").alias("asked"))


def nearest(queries: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k records (id, rows) of greatest score with each query (id, rows), to PLACES
    decimals, ties to the lesser id."""
    return _best(scored(queries, records, k), "score", k)


def scored(queries: DataFrame, records: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, score): the score of each query (id, rows) with every record (id, rows), or with the k best of each
    page, to PLACES decimals."""

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
        if len(a) and len(b):
            b = b.sort_values("id")
            dim = next((len(r[0]) for r in [*a["asked"], *b["rows"]] if r is not None and len(r)), 0)
            parts, ids = [_matrix(r, dim) for r in b["rows"]], b["id"].to_numpy()
            x, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            for query, rows in zip(a["query_id"], a["asked"], strict=True):
                score = _sums(_matrix(rows, dim) @ x.T, sizes).round(PLACES) + 0.0
                first = np.argsort(-score, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": query, "id": ids[first], "score": score[first]}))
        return pd.concat(out)

    rows = records.select(F.col("id").cast("long").alias("id"), F.col("rows").cast("array<array<double>>").alias("rows"))
    return _paged(_asked(queries), rows, scan, "query_id long, id long, score double")


def _best(hits: DataFrame, score: str, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id"))).filter(F.col("rank") <= k)


class TokenCoder:
    """Codes of token rows: the nearest centroid, and a product quantiser's codes of what remains."""

    def __init__(self, centre: np.ndarray, books: list[np.ndarray]):
        self.centre, self.books = centre, books

    @classmethod
    def fitted(cls, sample: np.ndarray) -> TokenCoder:
        centre = V.lloyd(sample, CENTROIDS)
        left = sample - centre[V._near(sample, centre)]
        width = next(w for w in (8, 4, 2, 1) if sample.shape[1] % w == 0)
        return cls(centre, [V.lloyd(part, 256) for part in np.split(left, sample.shape[1] // width, axis=1)])

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """A row of bytes for each token: centroid, then a code for each part."""
        own = V._near(rows, self.centre) if len(rows) else np.zeros(0, np.int64)
        parts = np.split(rows - self.centre[own], len(self.books), axis=1)
        return np.stack([own, *(V._near(p, b) if len(p) else own for p, b in zip(parts, self.books, strict=True))], 1).astype(np.uint8)

    def products(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of query rows with the tokens that codes stand for, by look-up tables."""
        out = (query @ self.centre.T)[:, codes[:, 0]]
        for at, (part, book) in enumerate(zip(np.split(query, len(self.books), axis=1), self.books, strict=True)):
            out += (part @ book.T)[:, codes[:, at + 1]]
        return out


def _unpacked(held: pd.DataFrame, parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The encodings of a page of entries, and each one's codes, a row of ``parts`` bytes for a token."""
    fde = np.frombuffer(b"".join(held["fde"]), np.int8).reshape(len(held), -1).astype(np.float32) * held["scale"].to_numpy(np.float32)[:, None]
    return fde, [np.frombuffer(t, np.uint8).reshape(-1, parts) for t in held["tokens"]]


class TokenIndex:
    """A stored index of token matrices (id, rows); one that was built before at the path is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if "model" in W.names(spark, path):
            m = json.loads(spark.read.text(f"{path}/model").first()[0])
            self.coder, self.encoder = TokenCoder(np.array(m["centre"]), [np.array(b) for b in m["books"]]), V.FixedEncoder(m["dim"])
            self.pool, self.head = m["pool"], m["head"]

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries")

    def build(self, matrices: DataFrame) -> None:
        """Fits the coder on a bounded sample, codes all matrices, and measures the pool."""
        rows = matrices.select(F.col("id").cast("long").alias("id"), F.col("rows").cast("array<array<float>>").alias("rows"))
        tokens = rows.select(F.explode("rows").alias("t")).orderBy(F.xxhash64("t")).limit(SAMPLE).toPandas()["t"]
        sample = np.stack(tokens.to_numpy()).astype(float) if len(tokens) else np.zeros((1, 8))
        self.coder, self.encoder = TokenCoder.fitted(sample), V.FixedEncoder(sample.shape[1])
        self.pool = self.head = 1.0
        W.remove(self.spark, f"{self.path}/entries")
        self._coded(rows).write.parquet(f"{self.path}/entries")
        self._measure()
        m = {"centre": self.coder.centre.tolist(), "books": [b.tolist() for b in self.coder.books], "dim": self.encoder.dim, "pool": self.pool, "head": self.head}
        self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/model")

    def add(self, matrices: DataFrame) -> None:
        """Codes and adds matrices of new ids."""
        self._coded(matrices.select(F.col("id").cast("long").alias("id"), F.col("rows").cast("array<array<float>>").alias("rows"))).write.mode("append").parquet(f"{self.path}/entries")

    def _coded(self, rows: DataFrame) -> DataFrame:
        coder, encoder = self.coder, self.encoder

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for i, own in zip(pdf["id"], pdf["rows"], strict=True):
                    x = _matrix(own, encoder.dim)
                    fde = encoder.encode(x, False)
                    scale = float(np.abs(fde).max(initial=0)) / 127
                    out.append((i, np.rint(fde / (scale or 1)).astype(np.int8).tobytes(), scale, coder.encode(x).tobytes(), own))
                yield pd.DataFrame(out, columns=["id", "fde", "scale", "tokens", "rows"])

        return rows.mapInPandas(code, ENTRY)

    def _measure(self) -> None:
        """The shares of a page that hold RECALL of the DEPTH best of TRIALS records, by encodings and then by codes."""
        trials = self.entries().select("id", "rows").orderBy(F.xxhash64("id"), "id").limit(TRIALS)
        true = nearest(trials, self.entries().select("id", "rows"), DEPTH).select("query_id", "id")
        coder, encoder, parts = self.coder, self.encoder, len(self.coder.books) + 1

        def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "id": [], "pool": [], "head": []})]
            if len(a) and len(b):
                fde, codes = _unpacked(b, parts)
                tokens, sizes = np.concatenate(codes), np.array([len(c) for c in codes])
                for query, rows in zip(a["query_id"], a["asked"], strict=True):
                    x = _matrix(rows, encoder.dim)
                    near, coded = fde @ encoder.encode(x, True).astype(np.float32), _sums(coder.products(x, tokens), sizes)
                    place = [(np.argsort(np.argsort(-s, kind="stable")) + 1) / len(b) for s in (near, coded)]
                    out.append(pd.DataFrame({"query_id": query, "id": b["id"], "pool": place[0], "head": place[1]}))
            return pd.concat(out)

        places = _paged(_asked(trials), self.entries().drop("rows"), scan, "query_id long, id long, pool double, head double")
        own = places.join(true, ["query_id", "id"], "left_semi").select("pool", "head").toPandas()  # DEPTH rows a trial
        if len(own):
            self.pool, self.head = (float(np.quantile(own[c], RECALL, method="higher")) for c in ("pool", "head"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): for each query (id, rows) the k records of greatest score that were found; scores are
        those of the matrices, to PLACES decimals, ties to the lesser id."""
        coder, encoder, parts, pool, head = self.coder, self.encoder, len(self.coder.books) + 1, self.pool, self.head

        def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "id": [], "score": []})]
            if len(a) and len(b):
                b = b.sort_values("id")
                fde, codes = _unpacked(b, parts)
                ids, sizes, rows = b["id"].to_numpy(), np.array([len(c) for c in codes]), b["rows"].to_numpy()
                most, best = (max(k, int(np.ceil(share * len(b)))) for share in (pool, head))
                for query, asked in zip(a["query_id"], a["asked"], strict=True):
                    x = _matrix(asked, encoder.dim)
                    first = np.argsort(-(fde @ encoder.encode(x, True).astype(np.float32)), kind="stable")[:most]
                    coded = _sums(coder.products(x, np.concatenate([codes[j] for j in first])), sizes[first])
                    top = np.sort(first[np.argsort(-coded, kind="stable")[:best]])
                    score = _sums(x @ np.concatenate([_matrix(rows[j], encoder.dim) for j in top]).T, sizes[top]).round(PLACES) + 0.0
                    own = np.argsort(-score, kind="stable")[:k]
                    out.append(pd.DataFrame({"query_id": query, "id": ids[top][own], "score": score[own]}))
            return pd.concat(out)

        return _best(_paged(_asked(queries), self.entries(), scan, "query_id long, id long, score double"), "score", k)
