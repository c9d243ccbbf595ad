"""Language identification of mixed text.

A word is a run of letters (ASCII letters and non-ASCII bytes; Latin-1 capitals are folded). The
script range that holds its first letter narrows the candidate languages to those that were seen
writing that script. Each candidate gives the word a score, the sum of learned log frequencies of
its byte trigrams (with a boundary mark before and after), and Viterbi over the words, with a fixed
penalty for changing language, labels every word; runs of one label are the spans. The language of
a whole text is the one with the most letters under its labels.

The trigram model is fitted on about ``PER_LANGUAGE`` documents of each language (all, if there are
fewer), those whose uniform hash lies below that share of its range. Every language that occurs is
learned; the model takes a quarter of a MB for each, whatever the size of the corpus, and the more
there are the fewer texts are labelled at once. All texts are labelled whole.

Edge cases: a null text, or one without a letter (of Unicode's letter categories: digits, fractions and
symbols are none), is ``und`` with score 0 and has no spans; without
any language to learn every text is ``und``; ties go to the language first in code-point order;
repeated rows are labelled alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import textscan as ts
from recollect.llm.staging import Staged

PER_LANGUAGE = 1500
CELLS, SWITCH, SCRIPT_SHARE = 1 << 16, 8.0, 0.002
BLOCK_BYTES = 3_000_000
LETTERS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
# --- Fixed values: first code points of ranges of the Unicode block chart, and a number for each script ---
RANGES = [
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 6), (0x0750, 5), (0x0780, 17), (0x07C0, 18), (0x0800, 19), (0x0860, 6),
    (0x0870, 5), (0x0900, 7), (0x0980, 8), (0x0A00, 20), (0x0A80, 21), (0x0B00, 22), (0x0B80, 23), (0x0C00, 24), (0x0C80, 25), (0x0D00, 26), (0x0D80, 27), (0x0E00, 9),
    (0x0E80, 10), (0x0F00, 28), (0x1000, 29), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x13A0, 30), (0x1400, 31), (0x1680, 14), (0x1780, 32), (0x1800, 33), (0x18B0, 31),
    (0x1900, 14), (0x1C80, 2), (0x1C90, 11), (0x1CC0, 14), (0x1D00, 0), (0x1DC0, 14), (0x1E00, 0), (0x1F00, 1), (0x2000, 14), (0x2C60, 0), (0x2C80, 14), (0x2D00, 11),
    (0x2D30, 14), (0x2D80, 13), (0x2DE0, 2), (0x2E00, 14), (0x2E80, 16), (0x3000, 14), (0x3040, 15), (0x3100, 16), (0x3130, 12), (0x3190, 16), (0x31F0, 15), (0x3200, 14),
    (0x3400, 16), (0xA000, 34), (0xA4D0, 14), (0xA640, 2), (0xA6A0, 14), (0xA720, 0), (0xA800, 14), (0xA960, 12), (0xA980, 14), (0xAA60, 29), (0xAA80, 14), (0xAB00, 13),
    (0xAB30, 0), (0xAB70, 30), (0xABC0, 14), (0xAC00, 12), (0xD800, 14), (0xF900, 16), (0xFB00, 14), (0xFB50, 5), (0xFE00, 14), (0xFE70, 5), (0xFF00, 14), (0xFF66, 15),
    (0xFFA0, 12), (0xFFE0, 14), (0x20000, 16), (0x323B0, 14),
]
# --- End of fixed values ---
_FROM, _SCRIPT = np.array([r[0] for r in RANGES]), np.array([r[1] for r in RANGES])
SCRIPTS = int(_SCRIPT.max()) + 1


def _scripts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Script of the character that begins at each start."""
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    a, b, c, d = (padded[start + i] for i in range(4))
    code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))
    return _SCRIPT[np.searchsorted(_FROM, code, "right") - 1]


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, byte for byte; other bytes that aren't letters as 0."""
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    low[latin] += 32
    low[~LETTERS[data]] = 0
    return low


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Cell of the three bytes around each byte of a block."""
    low = np.concatenate([np.zeros(1, np.uint32), _folded(data).astype(np.uint32), np.zeros(1, np.uint32)])
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


class Model:
    """Languages, log frequencies (CELLS, languages) of trigram cells and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * CELLS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.allowed = share >= SCRIPT_SHARE
        self.allowed[~self.allowed.any(1)] = True


def _emissions(words: ts.Block, model: Model) -> np.ndarray:
    """(words, languages): how much a word speaks for a language, against the mean of the candidates."""
    cells, n = _trigrams(words.data), len(words.start)
    out = np.empty((n, len(model.langs)))
    total = np.zeros(len(cells) + 1)
    for k in range(len(model.langs)):
        np.cumsum(model.logp[cells, k], out=total[1:])
        out[:, k] = total[words.end] - total[words.start]
    open_ = model.allowed[_scripts(words.data, words.start)]
    out -= np.where(open_, out, 0).sum(1, keepdims=True) / open_.sum(1, keepdims=True)
    out[~open_] = -50.0
    return out


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; all texts of a block take their steps together, longest first."""
    n_langs, sizes = score.shape[1], np.diff(first)
    label = np.zeros(len(score), np.int16)
    if n_langs == 1 or not len(score):
        return label
    # a text whose words' best scores exceed those of one language by less than a switch costs has that language throughout
    sums = np.add.reduceat(np.vstack([score, np.zeros((1, n_langs))]), np.minimum(first[:-1], len(score)), 0)
    best = np.add.reduceat(np.append(score.max(1), 0), np.minimum(first[:-1], len(score)))
    plain = (sizes == 0) | (best - sums.max(1) <= switch)
    label[:] = np.repeat(sums.argmax(1), sizes)
    rows = np.flatnonzero(~plain)
    rows = rows[np.argsort(-sizes[rows], kind="stable")]
    if not len(rows):
        return label
    long = sizes[rows]
    alive = len(rows) - np.searchsorted(long[::-1], np.arange(long[0]), "right")
    value, begin = score[first[rows]].copy(), first[rows]
    moved = np.zeros(score.shape, np.uint8)
    top = np.zeros(len(score), np.int16)
    for t in range(1, long[0]):
        k = alive[t]
        at, was = begin[:k] + t, value[:k]
        lead = was.argmax(1)
        jump = was[np.arange(k), lead] - switch
        go = was < jump[:, None]
        moved[at], top[at] = go, lead
        value[:k] = np.where(go, jump[:, None], was) + score[at]
    now = value.argmax(1)
    for t in range(long[0] - 1, 0, -1):
        k = alive[t]
        at = begin[:k] + t
        label[at] = now[:k]
        now[:k] = np.where(moved[at, now[:k]] == 1, top[at], now[:k])
    label[begin] = now
    return label


def _lettered(words: ts.Block, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter; asked of Unicode only where no ASCII letter answers."""
    ascii_ = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(LETTERS[words.data] & (words.data < 0x80), out=ascii_[1:])
    has = ascii_[words.offsets[1:]] > ascii_[words.offsets[:-1]]
    for r in np.flatnonzero(~has & (np.diff(words.first) > 0)):
        has[r] = any(map(str.isalpha, texts[words.row0 + int(r)].as_py()))
    return has


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n) over the trigrams, and (lang, -1 - script, n) over the words, of each batch."""
    for batch in batches:
        tally: dict[str, np.ndarray] = {}
        langs = batch.column("lang").to_pylist()
        for words in ts.blocks(batch.column("text"), LETTERS):
            cells, scripts, row = _trigrams(words.data), _scripts(words.data, words.start), words.row_of()
            inside = LETTERS[words.data]
            own = np.array(langs[words.row0 : words.row0 + words.rows], dtype=object)
            for lang in set(own):
                rows = own == lang
                bytes_ = np.repeat(rows, np.diff(words.offsets)) & inside
                n = tally.setdefault(lang, np.zeros(CELLS + SCRIPTS, np.int64))
                n[:CELLS] += np.bincount(cells[bytes_], minlength=CELLS)
                n[CELLS:] += np.bincount(scripts[rows[row]], minlength=SCRIPTS)
        for lang, n in tally.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "cell", "n"])


def train(docs: DataFrame, teaches: Column) -> Model | None:
    """A model from texts with a language of the documents for which ``teaches`` (on doc_id) holds."""
    known = docs.filter(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    found = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return None
    share = F.create_map(*(x for lang, n in found.items() for x in (F.lit(lang), F.lit(min(1.0, PER_LANGUAGE / n)))))
    chosen = known.filter(F.shiftrightunsigned("h", 1).cast("double") <= share[F.col("lang")] * float(1 << 63)).select("lang", "text")
    counts = Staged(chosen.mapInArrow(_counted, "lang string, cell int, n long"), "lang-counts").df.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most languages * (CELLS + SCRIPTS) rows
    langs = sorted(found)
    table = np.zeros((CELLS + SCRIPTS, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    table[counts.column("cell").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    return Model(langs, table[:CELLS], table[CELLS:])


def _block_bytes(model: Model | None) -> int:
    """Bytes of text labelled at once: word scores of all languages are held."""
    return max(1 << 16, BLOCK_BYTES * 8 // max(8, len(model.langs) if model else 0))


def _labelled(words: ts.Block, model: Model, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label, and the letters (bytes) of each text under each label."""
    label = viterbi(_emissions(words, model), words.first, switch)
    n = len(model.langs)
    letters = np.bincount(words.row_of() * n + label, words.end - words.start, words.rows * n).reshape(words.rows, n)
    return label, letters


def _predicted(batches: Iterator[pa.RecordBatch], model: Model | None, switch: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in ts.blocks(batch.column("text"), LETTERS, block_bytes=_block_bytes(model)):
            pred, score = ["und"] * words.rows, np.zeros(words.rows)
            if model:
                _, letters = _labelled(words, model, switch)
                has, best = _lettered(words, batch.column("text")), letters.argmax(1)
                pred = [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                score = np.where(has, letters[np.arange(words.rows), best] / np.maximum(letters.sum(1), 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.row0, words.rows), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred and score (the share of letters under that label) of every text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _predicted(it, model, switch), "doc_id long, lang_pred string, score double")


def _spanned(batches: Iterator[pa.RecordBatch], model: Model, switch: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in ts.blocks(batch.column("text"), LETTERS, block_bytes=_block_bytes(model)):
            label, _ = _labelled(words, model, switch)
            has, out = _lettered(words, batch.column("text")), []
            for r in range(words.rows):
                a, b = words.first[r], words.first[r + 1]
                if not has[r] or a == b:
                    out.append([])
                    continue
                cut = np.append(a, a + 1 + np.flatnonzero(label[a + 1 : b] != label[a : b - 1]))
                edge = [words.offsets[r], *words.start[cut[1:]], words.offsets[r + 1]]
                out.append([{"lang": model.langs[label[c]], "text": words.data[x:y].tobytes().decode()} for c, x, y in zip(cut, edge, edge[1:], strict=False)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(words.row0, words.rows), pa.array(out, kind)], names=["doc_id", "spans"])


def language_spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id and its spans (lang, text), which join to the whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _spanned(it, model, switch), "doc_id long, spans array<struct<lang:string,text:string>>")
