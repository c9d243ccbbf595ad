"""How the sources of a language differ in their words: counts in byte tries, merged by prefix range.

A :class:`Trie` holds terms below their language (key: language, a zero byte, term; no term has a zero
byte) as a radix trie laid out flat: leaves in the order of their bytes, each stored as the depth at
which it leaves the path of the leaf before it and the label from there on, with the number of
documents that hold the term and one counter for each source. Tries merge by adding up equal leaves.

1. Each task counts its documents into one trie (it writes and starts anew beyond MAX_LEAVES leaves)
   and stores it in branches of BRANCH leaves, so a term costs one leaf a task however often it occurs.
2. First keys of a bounded sample of branches cut the key space into prefix ranges of about equal size;
   branches that a cut divides are split. Each range's branches are merged by one task, a page at a
   time, and leaves in fewer than ``least_docs`` documents are dropped.
3. Totals of each group and language are sums over the kept leaves. The merged leaves are then read in
   the order of their bytes: for every pair of sources the terms' divergences are added up in tiles of
   TILE sources, and each group's best terms are held, ties to the lesser bytes.

Shares are whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) with N the counts of the group
(or the whole language) over its language's V kept terms, and the divergence of p and q is
floor((p - q)^2 / (p + q)). All of it is exact in 64 bits for N + 2 V below 9 * 10^15.

The groups' totals are the one table that goes to the driver and to all tasks: a row for each (language,
source) that occurs. The pair part alone has a row for each two of them.

Edge cases: null text, lang and source read as empty; a group without terms has its pairs, and no
terms; a language without kept terms has pairs of value 0; repeated rows and ids are documents of
their own; very long texts are counted whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import textscan as ts
from recollect.llm.staging import Scratch, Staged

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
MAX_LEAVES, BRANCH, BLOCK_BYTES, TILE, CELLS = 1_000_000, 1024, 4_000_000, 256, 2_000_000
RANGE_LEAVES, MAX_RANGES, SAMPLED = 200_000, 20_000, 20
REPORT = "lang string, source string, part string, item string, value bigint, rank int"
_BRANCH_ROW = "first binary, leaves int, shared binary, tail_size binary, tails binary, docs binary, n_sources binary, names array<string>, source binary, count binary"
_LEAF_ROW = "lang string, term string, sources array<string>, counts array<bigint>"


@dataclass
class Trie:
    """Leaves in any order of keys, distinct: counter k belongs to leaf ``leaf[k]`` and source ``names[source[k]]``."""

    keys: pa.Array
    docs: np.ndarray
    leaf: np.ndarray
    source: np.ndarray
    count: np.ndarray
    names: list[str] = field(default_factory=list)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(count[order], begin) if len(key) else count[:0]


def merged(tries: list[Trie]) -> Trie:
    """One trie of all these, its leaves in the order of their bytes."""
    names = list(dict.fromkeys(n for t in tries for n in t.names))
    at = {n: k for k, n in enumerate(names)}
    found = pa.concat_arrays([t.keys for t in tries]).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    leaf_of = place[found.indices.to_numpy()]
    docs = np.zeros(len(order), np.int64)
    np.add.at(docs, leaf_of, np.concatenate([t.docs for t in tries]))
    shift = np.cumsum([0, *(len(t.keys) for t in tries)])
    leaf = leaf_of[np.concatenate([t.leaf + s for t, s in zip(tries, shift, strict=False)])]
    source = np.concatenate([np.array([at[n] for n in t.names], np.int64)[t.source] for t in tries])
    key, count = _summed(leaf * max(1, len(names)) + source, np.concatenate([t.count for t in tries]))
    leaf, source = np.divmod(key, max(1, len(names)))
    return Trie(found.dictionary.take(pa.array(order)), docs, leaf, source, count, names)


def _selected(trie: Trie, begin: int, end: int) -> Trie:
    """The leaves from one place to another of an ordered trie."""
    a, b = np.searchsorted(trie.leaf, [begin, end])
    return Trie(trie.keys[begin:end], trie.docs[begin:end], trie.leaf[a:b] - begin, trie.source[a:b], trie.count[a:b], trie.names)


def _packed(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest one takes, which the first byte tells."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _bytes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    keys = pa.concat_arrays([keys.cast(pa.large_binary())])
    offsets = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
    return np.frombuffer(keys.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8), offsets


def _shared(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes each key has in common with the one before it."""
    size, out = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
    live, depth = np.arange(1, len(out)), 0
    while len(live):
        live = live[np.minimum(size[live], size[live - 1]) > depth]
        live = live[data[offsets[live] + depth] == data[offsets[live - 1] + depth]]
        depth += 1
        out[live] = depth
    return out


def branch_row(trie: Trie) -> dict:
    """An ordered trie as one row: of each key only what it doesn't share with the one before."""
    data, offsets = _bytes(trie.keys)
    shared, size = _shared(data, offsets), np.diff(offsets)
    inside = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
    used, source = np.unique(trie.source, return_inverse=True)
    return {
        "first": trie.keys[0].as_py(), "leaves": len(trie.keys), "shared": _packed(shared), "tail_size": _packed(size - shared),
        "tails": data[offsets[0] : offsets[-1]][inside >= np.repeat(shared, size)].tobytes(), "docs": _packed(trie.docs),
        "n_sources": _packed(np.bincount(trie.leaf, minlength=len(trie.keys))), "names": [trie.names[k] for k in used], "source": _packed(source), "count": _packed(trie.count),
    }


def branch(row: dict) -> Trie:
    """The trie of such a row."""
    keys, key, place = [], b"", 0
    for shared, size in zip(_unpacked(row["shared"]).tolist(), _unpacked(row["tail_size"]).tolist(), strict=True):
        key = key[:shared] + row["tails"][place : place + size]
        place += size
        keys.append(key)
    leaf = np.repeat(np.arange(len(keys)), _unpacked(row["n_sources"]))
    return Trie(pa.array(keys, pa.large_binary()), _unpacked(row["docs"]), leaf, _unpacked(row["source"]), _unpacked(row["count"]), list(row["names"]))


def counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> Iterator[Trie]:
    """The tries of blocks of documents."""
    for words in ts.interned(texts, ts.ALPHA, lower=True, block_bytes=BLOCK_BYTES):
        rows = len(words.first) - 1
        lang, source = (c.slice(words.row0, rows).dictionary_encode() for c in (langs, sources))
        lang_of, source_of = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
        terms = max(1, len(words.distinct))
        in_row, count = np.unique(words.row_of() * terms + words.ids, return_counts=True)
        row, term = np.divmod(in_row, terms)
        keys, docs = np.unique(lang_of[row] * terms + term, return_counts=True)
        counter, count = _summed((lang_of[row] * terms + term) * len(source.dictionary) + source_of[row], count)
        key, code = np.divmod(counter, max(1, len(source.dictionary)))
        heads = lang.dictionary.cast(pa.large_binary()).take(pa.array(keys // terms))
        joined = pc.binary_join_element_wise(heads, words.distinct.take(pa.array(keys % terms)), pa.scalar(b"\0", pa.large_binary()))
        yield Trie(joined, docs, np.searchsorted(keys, key), code, count, source.dictionary.to_pylist())


def _text(column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()).fill_null("")


def _rows(trie: Trie) -> Iterator[dict]:
    for begin in range(0, len(trie.keys), BRANCH):
        yield branch_row(_selected(trie, begin, min(begin + BRANCH, len(trie.keys))))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_ARROW_BRANCH = pa.schema([("first", pa.binary()), ("leaves", pa.int32()), *((n, pa.binary()) for n in ("shared", "tail_size", "tails", "docs", "n_sources")), ("names", pa.list_(pa.string())), ("source", pa.binary()), ("count", pa.binary())])


def branches(docs: DataFrame) -> DataFrame:
    """The branches of every task's tries."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[Trie] = []
        for batch in batches:
            for trie in counted(_text(batch.column(0)), _text(batch.column(1)), _text(batch.column(2))):
                if len(trie.keys):
                    held.append(trie)
                if sum(len(t.keys) for t in held) > MAX_LEAVES:
                    held = [merged(held)]
                    if len(held[0].keys) > MAX_LEAVES // 2:
                        yield from _rows(held.pop())
        if held:
            yield from _rows(merged(held))

    texts = docs.select("lang", "source", "text")
    return texts.mapInArrow(lambda batches: _batches(grown(batches), _ARROW_BRANCH), _BRANCH_ROW)


def _cuts(stored: DataFrame) -> list[bytes]:
    """Keys at which prefix ranges of about RANGE_LEAVES leaves begin, from a sample of at most some SAMPLED branches a range."""
    spark = stored.sparkSession
    n, leaves = stored.agg(F.count("*"), F.coalesce(F.sum("leaves"), F.lit(0))).first()
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves // RANGE_LEAVES))
    some = stored.select("first").sample(fraction=min(1.0, SAMPLED * ranges / max(n, 1)), seed=7)
    firsts = sorted(bytes(r[0]) for r in some.collect())
    return sorted({firsts[len(firsts) * k // ranges] for k in range(1, ranges)}) if firsts else []


def kept_leaves(stored: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, sources, counts) of every term in at least so many documents of its language."""
    cuts = _cuts(stored)
    names = [f.name for f in _ARROW_BRANCH]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        edges = np.array([*cuts, None], dtype=object)[:-1]
        for batch in batches:
            for row in batch.to_pylist():
                trie = branch(row)
                keys = trie.keys.to_pylist()
                low = int(np.searchsorted(edges, keys[0], "right")) if len(edges) else 0
                high = int(np.searchsorted(edges, keys[-1], "right")) if len(edges) else 0
                if low == high:
                    yield row | {"range": low}
                    continue
                places = np.searchsorted(edges, np.array([*keys, None], dtype=object)[:-1], "right")
                begin = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                for a, b in zip(begin, [*begin[1:], len(keys)], strict=True):
                    yield branch_row(_selected(trie, int(a), int(b))) | {"range": int(places[a])}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size, at = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != at and held:
                    yield from leaves(merged(held))
                    held, size = [], 0
                at = row["range"]
                held.append(branch(row))
                size += row["leaves"]
                if size > MAX_LEAVES and len(held) > 1:
                    held = [merged(held)]
                    size = min(len(held[0].keys), MAX_LEAVES // 2)
        if held:
            yield from leaves(merged(held))

    def leaves(trie: Trie) -> Iterator[dict]:
        first = np.searchsorted(trie.leaf, np.arange(len(trie.keys) + 1))
        for k in np.flatnonzero(trie.docs >= least_docs).tolist():
            lang, term = trie.keys[k].as_py().rsplit(b"\0", 1)
            here = slice(first[k], first[k + 1])
            yield {"lang": lang.decode(), "term": term.decode(), "sources": [trie.names[c] for c in trie.source[here]], "counts": trie.count[here].tolist()}

    cut = stored.select(*names).mapInArrow(lambda b: _batches(split(b), _ARROW_BRANCH.append(pa.field("range", pa.int32()))), _BRANCH_ROW + ", range int")
    leaf = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    dealt = cut.repartition(len(cuts) + 1, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(lambda b: _batches(joined(b), leaf, 4096), _LEAF_ROW)


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / whole), by long division in thousands; 0 where ``whole`` is."""
    whole = np.maximum(whole, 1)
    out, left = np.divmod(count + 2, whole)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


@dataclass
class Groups:
    """A language's sources in the order of their bytes, with N + 2 V of each and of the whole language."""

    names: list[str]
    whole: np.ndarray
    language: int


def _traversal(batches: Iterator[pa.RecordBatch], groups: dict[str, Groups], top: int) -> Iterator[dict]:
    """Sums of divergences of pairs of sources, and each group's best terms, of the leaves of one task."""
    best: dict[tuple[str, str], list[tuple[int, str]]] = {}
    tiles: dict[tuple[str, int, int], np.ndarray] = {}
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            part = batch.filter(pc.equal(lang.indices, code))
            step = max(1, CELLS // len(groups[name].names))
            for begin in range(0, part.num_rows, step):
                _page(name, part.slice(begin, step), groups[name], top, best, tiles)
        if sum(t.size for t in tiles.values()) > CELLS:
            yield from _tile_rows(tiles, groups)
            tiles = {}
    yield from _tile_rows(tiles, groups)
    for (name, source), held in best.items():
        for value, term in held:
            yield {"lang": name, "source": source, "part": "term", "item": term, "value": value}


def _page(name: str, part: pa.RecordBatch, own: Groups, top: int, best: dict, tiles: dict) -> None:
    """Some leaves of one language."""
    sources, size = part.column(2), pc.list_value_length(part.column(2)).to_numpy()
    column = pc.index_in(sources.flatten(), value_set=pa.array(own.names)).to_numpy().astype(np.int64)
    count = np.zeros((part.num_rows, len(own.names)), np.int64)
    count[np.repeat(np.arange(part.num_rows), size), column] = part.column(3).flatten().to_numpy()
    p = shares(count, own.whole[None, :])
    q = shares(count.sum(axis=1), np.full(part.num_rows, own.language))
    for left in range(0, len(own.names), TILE):
        for right in range(left, len(own.names), TILE):
            b = p[:, right : right + TILE]
            rows = [divergence(p[:, k : k + 1], b).sum(axis=0) for k in range(left, min(left + TILE, len(own.names)))]
            tiles[name, left, right] = tiles.get((name, left, right), 0) + np.array(rows)
    terms = part.column(1).to_pylist()
    value = np.where((count > 0) & (p > q[:, None]), divergence(p, q[:, None]), -1)
    for k, source in enumerate(own.names):
        # the best of a page: all from the top-th value on, then by bytes among equals
        here = value[:, k]
        some = np.flatnonzero(here >= max(0, np.partition(here, len(here) - top)[len(here) - top] if len(here) > top else 0))
        if len(some):
            held = best.get((name, source), []) + [(int(here[j]), terms[j]) for j in some]
            best[name, source] = sorted(held, key=lambda x: (-x[0], x[1].encode()))[:top]


def _tile_rows(tiles: dict, groups: dict[str, Groups]) -> Iterator[dict]:
    """A row for each two sources, both ways; a pair inside one tile has both already."""
    for (name, left, right), sums in tiles.items():
        names = groups[name].names
        for i, row in enumerate(sums.tolist()):
            for j, value in enumerate(row):
                if left + i != right + j:
                    yield {"lang": name, "source": names[left + i], "part": "pair", "item": names[right + j], "value": value}
                    if left != right:
                        yield {"lang": name, "source": names[right + j], "part": "pair", "item": names[left + i], "value": value}


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with every other of its language, ``term`` with the language."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with Scratch() as scratch:
        stored = Staged(branches(docs), "tries")
        leaves = scratch.keep(Staged(kept_leaves(stored.df, least_docs), "leaves"))
    counters = leaves.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    sums = counters.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    terms = leaves.groupBy("lang").agg(F.count("*").alias("v"))
    occurring = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0)
    table = Staged(occurring, "groups")
    totals = table.df.toPandas()
    table.drop()
    groups = {}
    for lang, own in totals.groupby("lang"):
        own = own.assign(key=[s.encode() for s in own.source]).sort_values("key")
        twice = 2 * int(own.v.iloc[0])
        groups[lang] = Groups(own.source.tolist(), own.n.to_numpy(np.int64) + twice, int(own.n.sum()) + twice)
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    found = leaves.mapInArrow(lambda b: _batches(_traversal(b, groups, top), arrow, 4096), "lang string, source string, part string, item string, value bigint")
    # every two sources of a language have a row, whether or not it keeps terms
    known = docs.sparkSession.createDataFrame(totals[["lang", "source"]], "lang string, source string")
    others = known.join(known.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = found.unionByName(others).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
