"""Token counts of whole texts under a byte-level BPE vocabulary, by the whole-token shortcut.

A text is cut into pre-tokens (a letter, digit or other run with one space before it, a contraction,
white space); a pre-token's tokens depend on its bytes alone. Most pre-tokens of a text are entries of
the vocabulary, but an entry isn't always what its own bytes merge to. So, once per tokenizer file and
before any text is read, every entry's bytes are merged by the file's rules: those that end as one
token are *proven* and a pre-token equal to one of them counts 1. Only the other pre-tokens of a block
of texts are merged, each distinct one once.

Everything works on blocks of texts at once: code points are classified through a table taken from the
tokenizer library's own regular expressions, pre-tokens are slices of the block's UTF-8, distinct ones
come from an Arrow dictionary, and merging runs in rounds over all of them (each round merges, in
every pre-token, all places of its best pair). Pre-tokens of more than LONG bytes are merged one by one
with a heap, as their rounds would each pass over all their bytes.

The file must be a byte-level BPE of the tokenizers library without normaliser, dropout, unknown token,
affixes or prefix space; others are refused. Strings of special tokens inside a text count as that one
token, as the library does by default.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a text of any length is counted whole, in
pieces that end before white space, where a pre-token always begins; repeated rows and ids each have
their own row; other columns are kept, a column with the name of a result is replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

LONG, PIECE, NEVER = 256, 1 << 20, 1 << 31
LETTER, DIGIT, OTHER, SPACE = range(4)
#: The contractions that the pre-token pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@dataclass
class Vocabulary:
    """A tokenizer file: ``entries`` are the bytes of each token, ``pairs`` the sorted keys left << 32 | right, with rank and result."""

    entries: list[bytes]
    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    special: list[str]
    classes: np.ndarray
    proven: pa.Array


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(spare)}


def _classes() -> np.ndarray:
    """LETTER, DIGIT, OTHER or SPACE for every code point, by the library's own expressions."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        rest = Split(Regex(pattern + "+"), "removed").pre_tokenize_str(text)
        member = np.ones(len(points), bool)
        for _, (a, b) in rest:
            member[a:b] = False
        out[points[member]] = kind
    return out


@functools.lru_cache(maxsize=4)
def read_vocabulary(path: str) -> Vocabulary:
    """The file's rules, and which entries are proven to be one token."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = not (spec["normalizer"] or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"))
    if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or not plain:
        raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take in their surroundings")
    letters, ids = _byte_letters(), model["vocab"]
    entries = [b""] * (max(ids.values()) + 1)
    for entry, at in ids.items():
        entries[at] = bytes(letters[c] for c in entry)
    byte_ids = np.zeros(256, np.int64)
    for letter, byte in letters.items():
        byte_ids[byte] = ids[letter]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
    results, order = np.array([ids[a + b] for a, b in merges], np.int64), np.argsort(pairs, kind="stable")
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    rules = Vocabulary(entries, byte_ids, pairs[order], order, results[order], special, _classes(), pa.array([], pa.binary()))
    whole = pa.array([e for e in entries if e], pa.binary())
    rules.proven = whole.filter(pa.array(merged_sizes(whole, rules) == 1))
    return rules


def _best(left: np.ndarray, right: np.ndarray, rules: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of pairs of tokens; pairs that don't merge have the rank NEVER."""
    keys = left << 32 | right
    at = np.minimum(np.searchsorted(rules.pairs, keys), len(rules.pairs) - 1)
    return np.where(rules.pairs[at] == keys, rules.ranks[at], NEVER), rules.results[at]


def merged_sizes(words: pa.Array, rules: Vocabulary) -> np.ndarray:
    """How many tokens each word's bytes merge to; each round merges all places of every word's best pair."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = sizes.copy()
    for k in np.flatnonzero(sizes > LONG):
        out[k] = _merged_long(data[offsets[k] : offsets[k + 1]], rules)
    short = np.flatnonzero((sizes > 1) & (sizes <= LONG))
    if not len(short):
        return out
    word = np.repeat(short, sizes[short])
    ids = rules.byte_ids[data[np.repeat(offsets[short], sizes[short]) + _within(sizes[short])]]
    # of the pair that each token makes with the next one; the last token of a word makes none
    rank, result = np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)
    new = np.flatnonzero(word[:-1] == word[1:])
    while True:
        rank[new], result[new] = _best(ids[new], ids[new + 1], rules)
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least, size = np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(ids)])
        done = least == NEVER
        out[word[begin[done]]] = size[done]
        if done.all():
            return out
        hit = (rank == np.repeat(least, size)) & (rank < NEVER)
        # of overlapping places (one token repeated) every other one merges, from the left
        first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], np.arange(len(hit)), 0))
        hit &= (np.arange(len(hit)) - first) % 2 == 0
        ids = np.where(hit, result, ids)
        swallowed = np.r_[False, hit[:-1]]
        keep = ~swallowed & ~np.repeat(done, size)
        ids, word, rank, result, hit = ids[keep], word[keep], rank[keep], result[keep], hit[keep]
        new = np.flatnonzero((hit | np.r_[hit[1:], False]) & np.r_[word[:-1] == word[1:], False])
        rank[hit & ~np.r_[word[:-1] == word[1:], False]] = NEVER


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive groups of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _merged_long(data: np.ndarray, rules: Vocabulary) -> int:
    """The same for one long word: pairs in a heap by rank and place, tokens in a linked list."""
    ids = rules.byte_ids[data]
    n = len(ids)
    rank, result = _best(ids[:-1], ids[1:], rules)
    at = np.flatnonzero(rank < NEVER)
    heap = [(int(rank[k]), int(k), int(ids[k]), int(ids[k + 1]), int(result[k])) for k in at]
    heapq.heapify(heap)
    token, after, before, left = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), n

    def push(a: int, b: int) -> None:
        key = token[a] << 32 | token[b]
        k = int(np.searchsorted(rules.pairs, key))
        if k < len(rules.pairs) and rules.pairs[k] == key:
            heapq.heappush(heap, (int(rules.ranks[k]), a, token[a], token[b], int(rules.results[k])))

    while heap:
        _, a, x, y, made = heapq.heappop(heap)
        b = after[a]
        if token[a] != x or b >= n or token[b] != y:
            continue  # one of the two has merged elsewhere
        token[a], token[b], after[a] = made, -1, after[b]
        left -= 1
        if after[a] < n:
            before[after[a]] = a
            push(a, after[a])
        if before[a] >= 0:
            push(before[a], a)
    return left


def _starts(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; ``ends`` are the ends of the texts they come from."""
    n = len(points)
    kind = classes[points]
    head, last = np.zeros(n, bool), np.zeros(n, bool)
    head[np.r_[0, ends[:-1]]] = True
    last[ends - 1] = True
    before, blank = np.r_[SPACE, kind[:-1]], kind == SPACE
    after_blank = before == SPACE
    joined = np.r_[0, points[:-1]] == 0x20
    start = head | np.where(blank, ~after_blank, np.where(after_blank, ~joined, before != kind))
    # the last of several blanks before a word goes with the word or stands alone
    start[:-1] |= blank[:-1] & ~blank[1:] & ~last[:-1]
    quote = np.flatnonzero(start & (points == ord("'")))
    for form in CONTRACTIONS:
        size = len(form)
        at = quote[quote + size <= n]
        fits = np.ones(len(at), bool)
        for k in range(1, size):
            fits &= (points[at + k] == ord(form[k])) & ~head[at + k]
        start[at[fits] + 1] = False
        at = at[fits] + size
        start[at[at < n]] = True
    return start


def _pieces(text: str, classes: np.ndarray) -> Iterator[str]:
    """The text in pieces that each end before white space that follows something else; whole if there is no such place."""
    begin = 0
    if len(text) > PIECE:
        blank = classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == SPACE
        cuts = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        at = np.unique(np.searchsorted(cuts, np.arange(PIECE, len(text), PIECE)))
        for end in cuts[at[at < len(cuts)]].tolist():
            yield text[begin:end]
            begin = end
    yield text[begin:]


def _plain_parts(text: str, special: list[str]) -> tuple[list[str], int]:
    """What lies between the special strings of a text, and how many of them it has; the longest one that fits counts."""
    parts, found = [text], 0
    for string in special:
        if string in text:
            parts = [q for p in parts for q in p.split(string)]
    if len(parts) > 1:
        found = len(parts) - 1
    return parts, found


def _count_block(texts: list[str], row: list[int], counts: np.ndarray, rules: Vocabulary) -> None:
    """Adds to ``counts`` the tokens of these texts, each of which belongs to a row."""
    whole = "".join(texts)
    if not whole:
        return
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    row, sizes = np.array(row)[sizes > 0], sizes[sizes > 0]
    ends = np.cumsum(sizes)
    start = np.flatnonzero(_starts(points, ends, rules.classes))
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.r_[0, np.cumsum(width)]
    data = pa.py_buffer(whole.encode())
    offsets = np.r_[place[start], place[-1]].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), data]).dictionary_encode()
    distinct = words.dictionary
    rest = pc.is_null(pc.index_in(distinct, value_set=rules.proven))
    size = np.ones(len(distinct), np.int64)
    if pc.any(rest).as_py():
        size[rest.to_numpy(zero_copy_only=False)] = merged_sizes(distinct.filter(rest), rules)
    owner = np.searchsorted(ends, start, "right")
    np.add.at(counts, row[owner], size[words.indices.to_numpy()])


def count_tokens(texts: list[str | None], rules: Vocabulary) -> np.ndarray:
    """Tokens of each text."""
    counts, held, rows, size = np.zeros(len(texts), np.int64), [], [], 0
    for k, text in enumerate(texts):
        parts, found = _plain_parts(text or "", rules.special)
        counts[k] += found
        for piece in (p for part in parts for p in _pieces(part, rules.classes)):
            held.append(piece)
            rows.append(k)
            size += len(piece)
            if size >= PIECE:
                _count_block(held, rows, counts, rules)
                held, rows, size = [], [], 0
    _count_block(held, rows, counts, rules)
    return counts


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """The documents with n_bytes, n_tokens and over_limit; ``tokenizer`` is a file's path on the driver, its rules go to the tasks."""
    rules = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer))
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    source = docs.select(*kept, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            yield batch.append_column("n_tokens", pa.array(count_tokens(column.to_pylist(), rules.value)))

    schema = source.withColumn("n_tokens", F.lit(0).cast("long")).schema
    return source.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
