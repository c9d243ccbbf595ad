"""Runs of repeated words in whole texts, by divide and conquer (Main and Lorentz).

Words are the runs of bytes other than white space, interned: two words are equal when their bytes are.
A *run* is a stretch of consecutive words whose smallest period q fits at least twice, of at least
``least`` words, that no neighbouring word extends with the same period.

A text is halved again and again. At each midpoint, Z-functions of the right half, of the left half
read backwards, and of one half against the other give, for every period q at once, how far words q
apart agree to both sides of the midpoint; where they agree for q words or more, a repetition crosses
it. One that a word beyond the halves would extend is left to the larger halves that hold it whole;
what is found is deduplicated by its interval, keeping the smallest period. (Two periods of one
stretch, the larger of which fits twice, have a common divisor that is one too, so the smallest period
is always among those found for the interval.)

Most texts hold no run, so stretches where one can lie are found first, for a block of texts at once:
words q apart agree in at least half of ``least`` consecutive places, so all but a few words of a run
begin a gram of that many words that occurs a second time within the run. Texts are cut wherever no
gram near repeats inside the same stretch, until nothing changes; only what is left is halved. This
leaves no run out: a gram's repeat inside a run always lies in the same stretch.

Edge cases: a null or empty text, or one of white space, has no runs and an empty collapsed text; texts
of any length are taken whole (n log n steps for n words); repeated rows and ids each have their own row;
other columns are kept, and columns named runs or collapsed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.llm import textscan as ts

LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on agree with the beginning."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    n, pending = len(words), [(0, len(words))]
    while pending:
        low, high = pending.pop()
        if high - low < least:
            continue
        mid = (low + high) // 2
        pending += [(low, mid), (mid, high)]
        left, right = words[low:mid], words[mid:high]
        back = left[::-1]
        # words from the midpoint on against those q later; words before it against those q later
        ahead = z_function(right) + [0]
        behind = z_function(back + [-1] + words[low:high][::-1])[len(back) + 1 :]
        for q in range(1, len(right) + 1):
            a, b = behind[len(right) - q], ahead[q]
            if a and a + b >= q and a + b + q >= least:
                _keep(found, words, mid - min(a, mid - low), mid + q + b, q, n)
        # words before the midpoint against those q earlier; words from it on against those q earlier
        behind = z_function(back) + [0]
        ahead = z_function(right + [-1] + words[low:high])[len(right) + 1 :]
        for q in range(1, len(left) + 1):
            a, b = behind[q], min(ahead[mid - low - q], high - mid)
            if b and a + b >= q and a + b + q >= least:
                _keep(found, words, mid - q - a, mid + b, q, n)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def _keep(found: dict, words: list[int], begin: int, end: int, q: int, n: int) -> None:
    """Notes a repetition with its smallest period, unless a neighbouring word extends it."""
    if begin and words[begin - 1] == words[begin - 1 + q] or end < n and words[end] == words[end - q]:
        return
    if q < found.get((begin, end), n):
        found[begin, end] = q


def _stretches(words: ts.Interned, least: int) -> list[tuple[int, int, int]]:
    """(row, begin, end), counted in the block's words: where runs can lie."""
    gram = max(1, least // 2)
    # a run of less than ``least`` words isn't asked for, so words q apart agree in ``gram`` places at least
    hashes = ts.grams(ts.mix(words.ids.astype(np.uint64)), gram)
    at = np.flatnonzero(ts.in_row(words.first, len(words.ids), gram))
    row = words.row_of()
    part = row.copy()
    while len(at):
        key = ts.mix(hashes[at] + ts.mix(part[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        if again.all():
            break
        at = at[again]
        # in a run of period q, at most gram - 1 places in the middle lack a repeat; a new stretch begins where more do
        fresh = np.r_[True, (np.diff(at) > gram) | (row[at[1:]] != row[at[:-1]])]
        part[at] = np.cumsum(fresh)
    if not len(at):
        return []
    fresh = np.flatnonzero(np.r_[True, part[at[1:]] != part[at[:-1]]])
    begin, end = at[fresh], at[np.r_[fresh[1:] - 1, len(at) - 1]] + gram
    return list(zip(row[begin].tolist(), begin.tolist(), end.tolist(), strict=True))


def _block(words: ts.Interned, least: int) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Runs of each row, and whether each word is kept."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.first) - 1)]
    kept = np.ones(len(words.ids), bool)
    for row, begin, end in _stretches(words, least):
        for start, length, period in runs_of(words.ids[begin:end].tolist(), least):
            kept[begin + start + period : begin + start + length] = False
            runs[row].append((begin + start - int(words.first[row]), length, period))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs, kept


def _collapsed(words: ts.Interned, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space: word bytes, and the byte after each kept word that isn't its row's last."""
    size = len(words.data)
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, words.start[kept], 1)
    np.add.at(step, words.end[kept], -1)
    out = np.cumsum(step)[:size] > 0
    row = words.row_of()[kept]
    gaps = words.end[kept][:-1][row[1:] == row[:-1]]
    out[gaps] = True
    data = words.data.copy()
    data[gaps] = 0x20
    cuts = np.r_[0, np.cumsum(out)][words.offsets]
    return pa.Array.from_buffers(pa.large_utf8(), len(words.offsets) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[out])])


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with their runs (by start, then period) and the text without the words that repeat.

    ``collapsed`` drops every word that some run contains after its first period, and joins the rest by one space.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    source = docs.select(*kept)
    schema = source.limit(0).selectExpr("*", f"cast(null as {RUNS}) as runs", "cast(null as string) as collapsed").schema

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in ts.interned(batch.column(batch.schema.names.index("text")), ts.NON_SPACE, lower=False):
                runs, whole = _block(words, least)
                part = batch.slice(words.row0, len(runs))
                found = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _ARROW)
                yield part.append_column("runs", found).append_column("collapsed", _collapsed(words, whole).cast(pa.string()))

    return source.mapInArrow(scanned, schema)
