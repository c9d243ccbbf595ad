"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of a benchmark item (a shorter item, if not empty, is one
window). A document word inside any occurrence of a window is *hit*.

Fingerprints: of the hashes of all k-grams (k = ``gram``) of a text, the least in every run of
``length - gram + 1`` consecutive k-grams. Every run spans exactly ``length`` words, so two texts
that share ``length`` words share the fingerprint of that run: no shared window is missed. Where a
document fingerprint is one of the benchmark's, the hit is extended to the whole window and
confirmed by the hash of all its words. Items shorter than a window can't be winnowed at that
length; they are looked up by the hash of all their words, one pass for each width that occurs.

The benchmark's window table is shipped to the executors only while it has at most
``max_shipped`` windows; beyond that, fingerprints and windows meet in shuffle joins (``_joined``).
Both ways give the same rows.

Edge cases: a null or wordless text has no words and no hits; null or wordless texts of items have
no windows; items with a null item_id hit like others, but are not listed or counted as items; repeated
items each count, repeated item ids once; repeated documents each get their own row; other columns of
either table are ignored by ``contamination`` and those of documents kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import textscan as ts
from recollect.llm.staging import Staged, unused

LENGTH, GRAM, MAX_SHIPPED = 10, 5, 2_000_000
REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _windows(words: ts.Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, winnowing fingerprint and whole hash of every full window of a block's rows."""
    whole = ts.grams(words.hash, length)
    at = np.flatnonzero(ts.in_row(words.first, len(words.hash), length))
    return at, ts.sliding_min(ts.grams(words.hash, gram), length - gram + 1)[at], whole[at]


def _item_windows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(item_id, width, fp, whole): width is the number of words of the window."""
    for batch in batches:
        ids = batch.column("item_id")
        for words in ts.blocks(batch.column("text"), ts.ALNUM):
            at, fp, whole = _windows(words, length, gram)
            row = words.row_of()[at]
            sizes = np.diff(words.first)
            short = [(r, n, ts.grams(words.hash[words.first[r] : words.first[r + 1]], n)[0]) for r, n in enumerate(sizes) if 0 < n < length]
            rows = np.concatenate([row, np.array([s[0] for s in short], np.int64)])
            width = np.concatenate([np.full(len(at), length), np.array([s[1] for s in short], np.int64)])
            whole = np.concatenate([whole, np.array([s[2] for s in short], np.uint64)])
            fp = np.concatenate([fp, np.zeros(len(short), np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows + words.row0)).cast(pa.int64()), pa.array(width.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64))],
                names=["item_id", "width", "fp", "whole"],
            )


def _table(windows: DataFrame) -> pd.DataFrame:
    """The windows with item ids as nullable integers (toPandas would make floats of them)."""
    return windows.toArrow().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


class _Index:
    """The benchmark's windows, sorted for lookup: windows by (width, hash) with their items."""

    def __init__(self, pdf: pd.DataFrame, length: int):
        self.by_width = {}
        for width, part in pdf.groupby("width"):
            part = part.drop_duplicates(["whole", "item_id"]).sort_values(["whole", "item_id"])
            key = part["whole"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(key, kind="stable")
            key, item = key[order], part["item_id"].to_numpy()[order]
            uniq = np.unique(key)
            known = ~pd.isna(item)
            first = np.searchsorted(key[known], np.append(uniq, uniq[-1:]), "left")
            first[-1] = known.sum()
            self.by_width[int(width)] = (uniq, first, item[known].astype(np.int64))
        fp = np.unique(pdf.loc[pdf["width"] == length, "fp"].to_numpy(np.int64).view(np.uint64))
        self.fp, self.seen = fp, np.zeros(1 << 20, bool)
        self.seen[fp >> np.uint64(44)] = True


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted_keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == x, i, -1)


def _digest(items: np.ndarray) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


_CLEAN = _digest(np.zeros(0, np.int64))


def _scan_documents(batches: Iterator[pa.RecordBatch], index: _Index, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for words in ts.blocks(batch.column("text"), ts.ALNUM):
            n = len(words.hash)
            depth = np.zeros(n + 1, np.int32)
            found: dict[int, list[np.ndarray]] = {}
            for width, (keys, first, items) in index.by_width.items():
                if width == length:
                    fps = ts.sliding_min(ts.grams(words.hash, gram), length - gram + 1)
                    at = np.flatnonzero(index.seen[fps >> np.uint64(44)] & ts.in_row(words.first, n, length))
                    at = at[_find(index.fp, fps[at]) >= 0]
                else:
                    at = np.flatnonzero(ts.in_row(words.first, n, width))
                if not len(at):
                    continue
                whole = ts.grams(words.hash, width)[at]
                k = _find(keys, whole)
                at, k = at[k >= 0], k[k >= 0]
                np.add.at(depth, at, 1)
                np.add.at(depth, at + width, -1)
                row = np.searchsorted(words.first, at, "right") - 1
                for r, j in np.unique(np.stack([row, k]), axis=1).T if len(at) else ():
                    found.setdefault(int(r), []).append(items[first[j] : first[j + 1]])
            hit = np.append(0, np.cumsum(np.cumsum(depth)[:n] > 0))
            n_hit = hit[words.first[1:]] - hit[words.first[:-1]]
            n_items, digest = np.zeros(words.rows, np.int64), [_CLEAN] * words.rows
            for r, parts in found.items():
                own = np.unique(np.concatenate(parts))
                n_items[r], digest[r] = len(own), _digest(own)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(words.row0, words.rows).cast(pa.int64()), pa.array(np.diff(words.first)), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(n_hit > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """One row per document: how many of its words lie in benchmark windows, and of which items."""
    windows = Staged(
        benchmark.select("item_id", "text").mapInArrow(lambda it: _item_windows(it, length, gram), "item_id long, width int, fp long, whole long"),
        "benchmark-windows",
    )
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if windows.df.count() > max_shipped:
        return _joined(docs, windows.df, length, gram).drop("row_key")
    index = docs.sparkSession.sparkContext.broadcast(_Index(_table(windows.df), length))
    windows.drop()
    return docs.mapInArrow(lambda it: _scan_documents(it, index.value, length, gram), REPORT)


def _doc_windows(batches: Iterator[pa.RecordBatch], widths: list[int], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each document's windows: full ones with their fingerprint, others for each width asked for."""
    for batch in batches:
        for words in ts.blocks(batch.column("text"), ts.ALNUM):
            n, out = len(words.hash), []
            for width in widths:
                if width == length:
                    at, fp, whole = _windows(words, length, gram)
                else:
                    at = np.flatnonzero(ts.in_row(words.first, n, width))
                    whole = ts.grams(words.hash, width)[at]
                    fp = np.zeros(len(at), np.uint64)
                out.append((at, np.full(len(at), width, np.int32), fp, whole))
            at, width, fp, whole = (np.concatenate([o[i] for o in out]) for i in range(4))
            row = np.searchsorted(words.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key").take(pa.array(row + words.row0)), pa.array((at - words.first[row]).astype(np.int32)), pa.array(width), pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64))],
                names=["row_key", "at", "width", "fp", "whole"],
            )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in ts.blocks(batch.column("text"), ts.ALNUM):
            part = batch.slice(words.row0, words.rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(np.diff(words.first))], names=["doc_id", "row_key", "n_words"])


def _row_key(doc_id: Column) -> Column:
    """128 bits of a document's id and text."""
    return F.concat_ws("-", *(F.hex(F.xxhash64(F.lit(k), doc_id, "text")) for k in (1, 2)))


def _joined(docs: DataFrame, windows: DataFrame, length: int, gram: int) -> DataFrame:
    """The same rows for a benchmark of any size: fingerprints filter by a semi join before windows are compared."""
    keyed = docs.withColumn("row_key", _row_key(F.col("doc_id")))
    widths = [r[0] for r in windows.select("width").distinct().collect()]  # at most `length` values
    spans = keyed.select("row_key", "text").mapInArrow(lambda it: _doc_windows(it, widths, length, gram), "row_key string, at int, width int, fp long, whole long")
    spans = spans.join(windows.select("width", "fp").distinct(), ["width", "fp"], "left_semi")
    hits = Staged(spans.join(windows.select("width", "whole").distinct(), ["width", "whole"]).select("row_key", "at", "width", "whole").distinct(), "window-hits").df
    covered = (
        hits.select("row_key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1)).alias("word"))
        .distinct().groupBy("row_key").agg(F.count("*").alias("n_hit"))
    )
    named = windows.filter("item_id is not null").select("width", "whole", "item_id").distinct()  # a window once for each text, not for each place
    items = hits.select("row_key", "width", "whole").distinct().join(named, ["width", "whole"]).select("row_key", "item_id").distinct().groupBy("row_key").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("own")
    )
    sizes = keyed.mapInArrow(_counts, "doc_id long, row_key string, n_words long")
    found = sizes.join(covered, "row_key", "left").join(items, "row_key", "left")
    return found.select(
        "row_key", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("own", ","), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _flag_documents(batches: Iterator[pa.RecordBatch], index: _Index, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.concatenate([np.zeros(0, bool), *(~r.column("contaminated").to_numpy(zero_copy_only=False) for r in _scan_documents(iter([batch]), index, length, gram))])
        yield batch.filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, gram: int = GRAM, max_shipped: int = MAX_SHIPPED) -> DataFrame:
    """The documents without a hit, all columns kept."""
    windows = Staged(
        benchmark.select("item_id", "text").mapInArrow(lambda it: _item_windows(it, length, gram), "item_id long, width int, fp long, whole long"),
        "benchmark-windows",
    )
    if windows.df.count() > max_shipped:
        (name,) = unused(docs, "_row_key")
        keyed = docs.withColumn(name, _row_key(F.col("doc_id").cast("long")))
        found = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), windows.df, length, gram)
        bad = found.filter("contaminated").select(F.col("row_key").alias(name)).distinct()
        return keyed.join(bad, name, "left_anti").drop(name)
    index = docs.sparkSession.sparkContext.broadcast(_Index(_table(windows.df), length))
    windows.drop()
    return docs.mapInArrow(lambda it: _flag_documents(it, index.value, length, gram), docs.schema)
