"""Repeated passages by a sparse suffix array.

A passage is at least ``min_words`` words. Of a text's suffixes only those at minimiser positions are
retained: in every window of ``min_words`` words, the first k-gram (k = ``GRAM``) of least hash.
Windows that follow one another mostly share it, so about two suffixes in ``min_words - GRAM + 2``
words remain, and a passage in two texts retains the same suffixes in both. Those whose k-gram
another document has too are sorted by their words to the right, then by those to the left.

Each sorted suffix is compared with its nearest neighbours of other documents on both sides: their
longest common prefix to the right, then extended to the left. Every window that these two lengths
cover is matched. The prefix shared with the nearer neighbour also bounds what any other suffix can
share, so the windows that remain *open* are those it still allows: another suffix may share less to
the right and more to the left. Open windows are settled exactly, by the hash of all their words
(128 bits) over the windows of all retained suffixes. Matched windows that touch are joined to spans.

A span is thus exactly the union of ``min_words``-word windows of a document that another document
(another doc_id or text) has too, words being runs of non-space, with A-Z lower-cased (compared by 48
bits of hash a word).

The order is global and dealt by range, so a k-gram that a third of all documents share fills as many
tasks as it needs; the suffixes at the edges of a task, whose neighbours lie in another, count all
their windows as open. Spark samples the ranges, which scans the texts once more.

Edge cases: null texts and texts of fewer words have no spans; repeated rows (equal doc_id and text)
are one document and repeat nothing by themselves; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import textscan as ts
from recollect.llm.sieve import maybe, sieve
from recollect.llm.staging import Scratch, Staged

MIN_WORDS, GRAM, LANES = 50, 16, 64
WORD = 6  # bytes of a word's hash in a sorted suffix
_U = np.uint64
SUFFIXES = "key long, right binary, left binary, row_key long, at long, near int, far int"
MATCHES = "row_key long, at long, matched long, open array<struct<w1:long,w2:long>>"


def _anchors(words: ts.Block, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each retained suffix: its row, the word it starts at, how many words before it the nearest and the
    farthest of its windows start, and its key."""
    at = np.flatnonzero(ts.in_row(words.first, len(words.hash), min_words))
    if not len(at):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = ts.grams(words.hash, gram)
    least = ts.sliding_argmin(grams, min_words - gram + 1)[at]
    begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(begin[1:], len(at)) - 1
    own = least[begin]
    return np.searchsorted(words.first, own, "right") - 1, own, own - at[last], own - at[begin], ts.mix(grams[own])


def _keys(batches: Iterator[pa.RecordBatch], min_words: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in ts.blocks(batch.column("text"), ts.NON_SPACE):
            row, _, _, _, key = _anchors(words, min_words, gram)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("row_key").take(pa.array(row + words.row0))], names=["key", "row_key"])


def _flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, and so on."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(size * WORD)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int, gram: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The suffixes whose key may be repeated, as far as their windows reach."""
    for batch in batches:
        for words in ts.blocks(batch.column("text"), ts.NON_SPACE):
            row, own, near, far, key = _anchors(words, min_words, gram)
            keep = maybe(bitmap, key)
            row, own, near, far, key = row[keep], own[keep], near[keep], far[keep], key[keep]
            code = words.hash.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WORD]
            right, back = code[_flat(own, min_words - near)], code[2 * np.repeat(own, far) - 1 - _flat(own, far)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), _binary(right, min_words - near), _binary(back, far), batch.column("row_key").take(pa.array(row + words.row0)),
                 pa.array(own - words.first[row]), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32))],
                names=["key", "right", "left", "row_key", "at", "near", "far"],
            )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Bytes of a binary column, a row each, filled up with zeros."""
    column = column.combine_chunks()
    size = pa.compute.binary_length(column).to_numpy().astype(np.int64)
    out = np.zeros((len(size), width), np.uint8)
    out[np.repeat(np.arange(len(size)), size), _flat(np.zeros(len(size), np.int64), size)] = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return out


def _common(words: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words rows i and j have in common from the first on."""
    differs = words[i] != words[j]
    same = np.where(differs.any(1), differs.argmax(1), words.shape[1]) // WORD
    return np.minimum(same, np.minimum(size[i], size[j]))


def _bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers with the bits low to high, both included, set; 0 where there are none."""
    top = np.where(high >= 63, ~_U(0), (_U(1) << np.clip(high + 1, 0, 63).astype(np.uint64)) - _U(1))
    return np.where(high >= low, top & ~((_U(1) << np.clip(low, 0, 63).astype(np.uint64)) - _U(1)), _U(0))


def _two_hashes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the k words, given by their codes, from each position on."""
    return ts.grams(ts.mix(codes), k).view(np.int64), ts.grams(ts.mix(codes ^ _U(0x6C62272E07BB0142)), k).view(np.int64)


def _compared(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes with the windows that neighbours match, as bits by how many words before the suffix they start,
    and the hashes of those still open. A document's run of suffixes is held until its next neighbour is read."""
    held: pa.Table | None = None
    start = True
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        runs = _run_starts(held)
        if len(runs) > 2:
            yield _neighbours(held, runs, min_words, 0 if start else runs[1], runs[-1], start, False)
            held, start = held.slice(int(runs[-1]) - 1), False
    if held is not None:
        runs = _run_starts(held)
        yield _neighbours(held, runs, min_words, 0 if start else runs[1], held.num_rows, start, True)


def _run_starts(table: pa.Table) -> np.ndarray:
    key, row_key = table.column("key").to_numpy(), table.column("row_key").to_numpy()
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row_key[1:] != row_key[:-1])))


def _neighbours(table: pa.Table, runs: np.ndarray, min_words: int, a: int, b: int, first: bool, last: bool) -> pa.RecordBatch:
    """Rows a to b, compared with the last of the run before theirs and the first of the run after; the table's first
    (last) run has an unknown neighbour before (after) it."""
    key, near, far = table.column("key").to_numpy(), table.column("near").to_numpy().astype(np.int64), table.column("far").to_numpy().astype(np.int64)
    n, reach = len(key), min_words - near
    right, left = _matrix(table.column("right"), min_words * WORD), _matrix(table.column("left"), int(far.max(initial=1)) * WORD)
    i = np.arange(a, b)
    run = np.searchsorted(runs, i, "right") - 1
    matched, most = np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64)
    for other, unknown in ((runs[run] - 1, first), (np.append(runs, n)[run + 1], last)):
        inside = (other >= 0) & (other < n)
        j = np.where(inside, other, i)
        shared = np.where(inside & (key[i] == key[j]), _common(right, reach, i, j), 0)
        matched |= _bits(np.maximum(near[i], min_words - shared), np.minimum(far[i], _common(left, far, i, j)))
        most = np.maximum(most, np.where(inside | ~np.bool_(unknown), shared, min_words))
    open_ = _bits(np.maximum(near[i], min_words - most), far[i]) & ~matched
    opened = np.flatnonzero(open_)
    w1, w2, count = _open_windows(right, left, reach, far, i[opened], open_[opened], min_words)
    offsets = np.zeros(len(i) + 1, np.int32)
    offsets[opened + 1] = count
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets).astype(np.int32)), pa.StructArray.from_arrays([pa.array(w1), pa.array(w2)], names=["w1", "w2"]))
    keep = np.flatnonzero(matched | open_)
    part = table.slice(a, b - a).select(["row_key", "at"]).take(pa.array(keep)).combine_chunks()
    columns = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns), pa.array(matched[keep].view(np.int64)), lists.take(pa.array(keep))]
    return pa.RecordBatch.from_arrays(columns, names=["row_key", "at", "matched", "open"])


def _open_windows(right: np.ndarray, left: np.ndarray, reach: np.ndarray, far: np.ndarray, rows: np.ndarray, bits: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two hashes of each open window of the rows, and their number by row."""
    def codes(x: np.ndarray) -> np.ndarray:
        out, parts = np.zeros((len(x), x.shape[1] // WORD), np.uint64), x.reshape(len(x), x.shape[1] // WORD, WORD)
        for b in range(WORD):
            out = out << _U(8) | parts[:, :, b]
        return out

    after, before, whole, starts, count, total = codes(right[rows]), codes(left[rows]), [], [], [], 0
    for k, r in enumerate(rows):
        whole += [before[k, : far[r]][::-1], after[k, : reach[r]]]
        back = np.flatnonzero((bits[k] >> np.arange(64, dtype=np.uint64)) & _U(1))
        starts.append(total + far[r] - back)
        count.append(len(back))
        total += far[r] + reach[r]
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    at = np.concatenate(starts)
    w1, w2 = _two_hashes(np.concatenate(whole), min_words)
    return w1[at], w2[at], np.array(count, np.int32)


def _same_windows(batches: Iterator[pa.RecordBatch], min_words: int, gram: int, keys: np.ndarray, opened: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows of retained suffixes that may be open ones."""
    for batch in batches:
        for words in ts.blocks(batch.column("text"), ts.NON_SPACE):
            row, own, near, far, key = _anchors(words, min_words, gram)
            keep = np.flatnonzero(maybe(keys, key))
            w1, w2 = _two_hashes(words.hash >> _U(64 - 8 * WORD), min_words)
            back = _flat(near[keep], far[keep] - near[keep] + 1)
            who = np.repeat(keep, far[keep] - near[keep] + 1)
            at = own[who] - back
            known = maybe(opened, w1[at]) if len(at) else np.zeros(0, bool)
            who, back, at = who[known], back[known], at[known]
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1[at]), pa.array(w2[at]), batch.column("row_key").take(pa.array(row[who] + words.row0)), pa.array(own[who] - words.first[row[who]]), pa.array(back)],
                names=["w1", "w2", "row_key", "at", "back"],
            )


def _merged(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Each document's matched windows as spans (start, words)."""
    for batch in batches:
        ids, keys, starts, sizes = [], [], [], []
        for doc_id, row_key, found in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), batch.column("found").to_pylist(), strict=True):
            at = np.array([f["at"] for f in found], np.int64)
            mask = np.array([f["matched"] for f in found], np.int64).view(np.uint64)
            which, back = np.nonzero((mask[:, None] >> np.arange(64, dtype=np.uint64)) & _U(1))
            windows = np.unique(at[which] - back)
            cut = np.flatnonzero(windows[1:] - windows[:-1] > min_words)
            begin, end = windows[np.append(0, cut + 1)], windows[np.append(cut, len(windows) - 1)] + min_words
            ids += [doc_id] * len(begin)
            keys += [row_key] * len(begin)
            starts += begin.tolist()
            sizes += (end - begin).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, keys, starts, sizes)], names=["doc_id", "row_key", "start_word", "n_words"])


def _places(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(row_key, at, matched): the retained suffixes with their matched windows, as bits."""
    spark = docs.sparkSession
    scan = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    keys = scan.mapInArrow(lambda it: _keys(it, min_words, gram), "key long, row_key long")
    repeated = Staged(keys.groupBy("key").agg(F.min("row_key").alias("lo"), F.max("row_key").alias("hi")).filter("lo <> hi").select("key"), "suffix-keys")
    bitmap = spark.sparkContext.broadcast(sieve(repeated.df, "key"))
    repeated.drop()
    order = ["key", "right", "left", "row_key", "at"]
    suffixes = scan.mapInArrow(lambda it: _suffixes(it, min_words, gram, bitmap.value), SUFFIXES)
    sorted_ = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    matches = Staged(sorted_.mapInArrow(lambda it: _compared(it, min_words), MATCHES), "suffix-matches").df
    found = matches.filter("matched <> 0").select("row_key", "at", "matched")
    opened = matches.select(F.explode("open").alias("w")).select("w.w1", "w.w2").distinct()
    opened = Staged(opened, "open-windows").df
    if opened.isEmpty():
        return found
    windows = spark.sparkContext.broadcast(sieve(opened, "w1"))
    same = scan.mapInArrow(lambda it: _same_windows(it, min_words, gram, bitmap.value, windows.value), "w1 long, w2 long, row_key long, at long, back long")
    same = Staged(same.withColumn("lane", F.pmod("row_key", F.lit(LANES))), "same-windows").df
    # a window of very many documents is settled in each of its lanes; only lanes with one document ask the others
    lanes = Staged(same.groupBy("w1", "w2", "lane").agg(F.min("row_key").alias("lo"), F.max("row_key").alias("hi")), "window-lanes").df
    shared = lanes.groupBy("w1", "w2").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least <> most").select("w1", "w2")
    alone = lanes.filter("lo = hi").join(shared, ["w1", "w2"], "left_semi").select("w1", "w2", "lane")
    known = lanes.filter("lo <> hi").select("w1", "w2", "lane").union(alone)
    more = same.join(known.hint("merge"), ["w1", "w2", "lane"]).groupBy("row_key", "at").agg(F.expr("bit_or(shiftleft(1L, cast(back as int)))").alias("matched"))
    return found.union(more)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word and n_words of every maximal span that other documents repeat."""
    if not gram <= min_words < gram + 64:
        raise ValueError("min_words must be at least gram and less than gram + 64")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch() as scratch:
        names = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key")).distinct()
        found = _places(docs, min_words, gram).groupBy("row_key").agg(F.collect_set(F.struct("at", "matched")).alias("found"))
        spans = found.join(names, "row_key").select("doc_id", "row_key", "found").mapInArrow(lambda it: _merged(it, min_words), "doc_id long, row_key long, start_word long, n_words long")
        return scratch.keep(Staged(spans.select("doc_id", "start_word", "n_words"), "repeated-spans"))
