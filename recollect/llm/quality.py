"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels of 1) and unlabelled text train a logistic score by the non-negative
unbiased risk: prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]). Features are properties of
the whole text (shares of character kinds, repetition of words and lines, lengths), each cut into
quantile bins, so the linear score can bend; they are computed in one pass over the table, which both
training and scoring read.

The class prior is estimated from positives and unlabelled text alone, at every size: in ``FOLDS`` folds,
a score that tells one from the other is fitted without the fold it is asked about, and over all folds
together the prior is the least ratio of the shares of unlabelled and positive texts above a threshold,
where both bear it out (the ratio's upper confidence bound is least). Few rows make the bound wide, so
that the ratio is taken where most positives are above the threshold.

Bins, prior and risk cover all positives and all unlabelled rows, by aggregation. Only the start is
fitted on a sample (``START`` rows of each kind, those of the least hashes), which also gives the
curvature: each of the ``PASSES`` passes over all rows sums the gradient of the whole risk and steps
against that curvature by at most ``REACH``. Where the negative part of the risk is below zero the step
goes up that part instead, so the passes end where it is about zero; the last half of them is averaged.

Edge cases: null and empty texts have the features of an empty text and get a score; labels that are
null, or of no document, teach nothing; several labels of one document count as their mean; without
positives or without unlabelled text every score is the share of positives among the labels (0.5 without
labels); repeated rows are scored alike; an empty table gives no rows; other columns are ignored by
``quality_scores`` and kept by ``keep_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import textscan as ts
from recollect.llm.staging import Staged

START, STEPS, PASSES, REACH = 6000, 600, 8, 0.25
THRESHOLD, BINS, RIDGE = 0.7, 10, 1e-4
FEATURES, SCORE_BINS, DOUBT, FOLDS = 20, 10_000, 0.1, 5


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 symbols, 6 blank, 7 line end, 8 non-ASCII."""
    kind = np.zeros(256, np.uint8)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 1, 2, 3
    for c in ".,;:'\"()-?":
        kind[ord(c)] = 4
    for c in "!#$%&*+/<=>@[\\]^_`{|}~":
        kind[ord(c)] = 5
    kind[[0x20, 0x09]], kind[[0x0A, 0x0D]], kind[128:] = 6, 7, 8
    return kind


_KIND = _kinds()


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _features(words: ts.Block) -> np.ndarray:
    """(rows, FEATURES) of the block's whole texts."""
    n_rows, size = words.rows, np.diff(words.offsets)
    kind = _KIND[words.data]
    row_of_byte = np.repeat(np.arange(n_rows), size)
    counts = np.bincount(row_of_byte * 9 + kind, minlength=9 * n_rows).reshape(n_rows, 9)
    n_words = np.diff(words.first)
    row = words.row_of()
    length = np.bincount(row, words.end - words.start, n_rows)
    same = np.zeros(len(row), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((words.hash, row))
    h, r = words.hash[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=n_rows)
    at = np.flatnonzero(new)
    often = np.zeros(n_rows)
    np.maximum.at(often, r[at], np.diff(np.append(at, len(h))))
    last = _KIND[words.data[words.end - 1]] if len(row) else np.zeros(0, np.uint8)
    first = _KIND[words.data[words.start]] if len(row) else last
    lines = counts[:, 7] + 1
    word_upper = np.bincount(row, (first == 2), n_rows)
    columns = [*(_ratio(counts[:, k], size) for k in range(9)), np.log1p(n_words), _ratio(length, n_words), _ratio(distinct, n_words), _ratio(often, n_words),
               _ratio(np.bincount(row, same, n_rows), n_words), _ratio(np.bincount(row, last == 5, n_rows), n_words), _ratio(np.bincount(row, last == 4, n_rows), n_words),
               _ratio(n_words, lines), _ratio(word_upper, n_words), _ratio(distinct, n_words) * np.log1p(n_words), _ratio(np.bincount(row, words.end - words.start == 1, n_rows), n_words)]
    return np.stack(columns, 1).astype(np.float32)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in ts.blocks(batch.column("text"), ts.NON_SPACE, lower=False):
            x = _features(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.row0, words.rows), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))], names=["doc_id", "x"])


class Model:
    """Bins of each feature and the weights of the bins."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") + i * (BINS + 1) for i, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[self.cells(x)].sum(1) + self.bias, -30, 30)))


class Risk:
    """The risk of a linear score over cells, from sums over positives and unlabelled rows."""

    def __init__(self, prior: float, size: int):
        self.prior, self.size = prior, size

    def sums(self, cells: np.ndarray, positive: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Of unlabelled rows and of positives each: rows, softplus of the scores, and by cell the rows and the sigmoids."""
        out = np.zeros((2, 2 + 2 * self.size))
        g = theta[cells].sum(1) + theta[-1]
        for k, own in enumerate((~positive, positive)):
            part, each = cells[own], np.ones(own.sum())
            sigma = 1 / (1 + np.exp(-np.clip(g[own], -500, 500)))
            out[k, :2] = own.sum(), np.logaddexp(0, g[own]).sum()
            for at, x in ((2, each), (2 + self.size, sigma)):
                out[k, at : at + self.size - 1] = np.bincount(part.ravel(), np.repeat(x, part.shape[1]), self.size - 1)
                out[k, at + self.size - 1] = x.sum()
        return out.ravel()

    def gradient(self, sums: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Down the whole risk with the ridge where its negative part is not below zero, else up the negative part."""
        u, p = (x / max(x[0], 1) for x in sums.reshape(2, -1))
        rows, sigmoid = slice(2, 2 + self.size), slice(2 + self.size, None)
        toward, away = self.prior * (p[sigmoid] - p[rows]), u[sigmoid] - self.prior * p[sigmoid]
        return (toward + away if u[1] >= self.prior * p[1] else -away) + RIDGE * np.append(theta[:-1], 0)

    def curvature(self, cells: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Second derivatives over unlabelled rows, damped."""
        x = np.zeros((len(cells), self.size))
        x[np.arange(len(cells))[:, None], cells] = 1
        x[:, -1] = 1
        sigma = 1 / (1 + np.exp(-np.clip(theta[cells].sum(1) + theta[-1], -500, 500)))
        return (x * (sigma * (1 - sigma))[:, None]).T @ x / max(len(cells), 1) + 1e-3 * np.eye(self.size)


def _model(edges: np.ndarray, theta: np.ndarray) -> Model:
    return Model(edges, theta[:-1], float(theta[-1]))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, edges: np.ndarray | None = None, steps: int = STEPS) -> Model:
    """The model of little non-negative risk over these rows, by Adam over all of them at once."""
    both = np.concatenate([positive, unlabelled])
    if edges is None:
        edges = np.stack([np.quantile(both[:, i], np.linspace(0, 1, BINS + 2)[1:-1]) for i in range(both.shape[1])])
    n = len(edges) * (BINS + 1) + 1
    risk, cells, is_positive = Risk(prior, n), _model(edges, np.zeros(n)).cells(both), np.arange(len(both)) < len(positive)
    theta, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for step in range(1, steps + 1):
        g = risk.gradient(risk.sums(cells, is_positive, theta), theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return _model(edges, theta)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): how often each feature has a value with these leading bits, which order like the values."""
    out = np.zeros(FEATURES << 16, np.int64)
    for batch in batches:
        bits = _matrix(batch).astype(np.float32).view(np.uint32) >> np.uint32(16)
        out += np.bincount((bits + (np.arange(FEATURES, dtype=np.uint32) << np.uint32(16))).ravel(), minlength=len(out))
    at = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["cell", "n"])


def _edges(rows: DataFrame) -> np.ndarray:
    """The bins' edges, quantiles over all rows."""
    got = rows.mapInArrow(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most FEATURES << 16 rows
    n = np.zeros(FEATURES << 16)
    n[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    below = np.cumsum(n.reshape(FEATURES, -1), axis=1)
    cut = np.linspace(0, 1, BINS + 2)[1:-1]
    at = np.stack([np.searchsorted(b, cut * b[-1]) for b in below])
    return (np.minimum(at + 1, (1 << 16) - 1).astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def _starts(rows: DataFrame) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """The features and folds of at most ``START`` rows of each kind, those of the least hashes."""
    out = {}
    for positive in (True, False):
        got = rows.filter(F.col("positive") == positive).orderBy("h", "doc_id").limit(START).select("x", "fold").toArrow()
        x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64) if got.num_rows else np.zeros((0, FEATURES))
        out[positive] = x, got.column("fold").to_numpy()
    return out


def best_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from histograms of a score over positives and unlabelled rows."""
    p, u = (np.cumsum(x[::-1]) / max(x.sum(), 1) for x in (positive, unlabelled))
    slack = sum(np.sqrt(np.log(4 / DOUBT) / 2 / max(x.sum(), 1)) for x in (positive, unlabelled))
    some = p > 0
    at = np.argmin((u[some] + slack) / p[some])
    return float(u[some][at] / p[some][at])


def _asked(batches: Iterator[pa.RecordBatch], models: list[Model]) -> Iterator[pa.RecordBatch]:
    """(positive, bin, n) of each row's score by the model of the other folds."""
    out = np.zeros((2, SCORE_BINS), np.int64)
    for batch in batches:
        x, fold, positive = _matrix(batch), batch.column("fold").to_numpy(), batch.column("positive").to_numpy(zero_copy_only=False)
        for k, model in enumerate(models):
            score = np.minimum((model.score(x[fold == k]) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)
            for kind in (0, 1):
                out[kind] += np.bincount(score[positive[fold == k] == bool(kind)], minlength=SCORE_BINS)
    kind, at = np.nonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at), pa.array(out[kind, at])], names=["positive", "bin", "n"])


def _prior(rows: DataFrame, starts: dict[bool, tuple[np.ndarray, np.ndarray]], edges: np.ndarray) -> float:
    """The class prior."""
    models = [fit(*(x[fold != k] for x, fold in (starts[True], starts[False])), 0.5, edges, STEPS // 3) for k in range(FOLDS)]
    got = rows.mapInArrow(lambda it: _asked(it, models), "positive int, bin long, n long").groupBy("positive", "bin").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, SCORE_BINS))
    n[got.column("positive").to_numpy(), got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return min(max(best_ratio(n[1], n[0]), 0.05), 0.98)


def _summed(batches: Iterator[pa.RecordBatch], model: Model, risk: Risk, theta: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * (2 + 2 * risk.size))
    for batch in batches:
        total += risk.sums(model.cells(_matrix(batch)), batch.column("positive").to_numpy(zero_copy_only=False), theta)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "x"])


def _whole(rows: DataFrame, model: Model, risk: Risk, theta: np.ndarray) -> np.ndarray:
    """The sums over all rows; a few hundred of them reach the driver."""
    got = rows.mapInArrow(lambda it: _summed(it, model, risk, theta), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(2 * (2 + 2 * risk.size))
    out[got.column("at").to_numpy()] = got.column("x").to_numpy()
    return out


def train(rows: DataFrame, labels: DataFrame, teaches: Column, label: str = "quality") -> tuple[Model | None, float]:
    """A model from labels of documents for which ``teaches`` (a condition on doc_id) holds, and the prior."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter(teaches & F.col("y").isNotNull()).groupBy("doc_id").agg((F.avg("y") >= 0.5).alias("y"))
    h = F.xxhash64("doc_id", F.lit(10))
    marked = rows.join(known, "doc_id", "left").select("doc_id", "x", "y", h.alias("h"), F.coalesce("y", F.lit(False)).alias("positive"), F.pmod(h, F.lit(FOLDS)).cast("int").alias("fold"))
    marked = Staged(marked, "quality-marked").df
    share = marked.select("doc_id", "y").filter("y is not null").distinct().agg(F.avg(F.col("y").cast("double")).alias("p")).first()["p"]
    if share is None:
        return None, 0.5
    rows = marked.filter("y is null or y")
    starts = _starts(rows)
    start = {kind: x for kind, (x, _) in starts.items()}
    if not len(start[True]) or not len(start[False]):
        return None, share
    edges = _edges(rows)
    prior = _prior(rows, starts, edges)
    model = fit(start[True], start[False], prior, edges)
    theta = np.append(model.weights, model.bias)
    risk, seen = Risk(prior, len(theta)), []
    curvature = risk.curvature(model.cells(start[False]), theta)
    for _ in range(PASSES):
        step = np.linalg.solve(curvature, risk.gradient(_whole(rows, model, risk, theta), theta))
        theta = theta - step * min(1.0, REACH / max(np.abs(step).max(), 1e-12))
        seen.append(theta)
    return _model(edges, np.mean(seen[len(seen) // 2 :], axis=0)), prior


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None, prior: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch)
        score = model.score(x) if model else np.full(len(x), prior)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every document, written once."""
    return Staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_feature_rows, "doc_id long, x array<float>"), "quality-features").df


def quality_scores(docs: DataFrame, labels: DataFrame, teaches: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document."""
    rows = feature_rows(docs)
    model, prior = train(rows, labels, teaches)
    scored = rows.mapInArrow(lambda it: _scored(it, model, prior), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _kept(batches: Iterator[pa.RecordBatch], model: Model | None, prior: float, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = [model.score(_features(w).astype(np.float64)) if model else np.full(w.rows, prior) for w in ts.blocks(batch.column("text"), ts.NON_SPACE, lower=False)]
        yield batch.filter(pa.array(np.concatenate([np.zeros(0), *score]) >= threshold))


def keep_quality(docs: DataFrame, labels: DataFrame, teaches: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, all columns kept."""
    model, prior = train(feature_rows(docs), labels, teaches)
    return docs.mapInArrow(lambda it: _kept(it, model, prior, threshold), docs.schema)
