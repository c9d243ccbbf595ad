"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct word shingles. Documents with the same set are one class, found
by a 128-bit fingerprint of the set, so copies never meet one another. Each class carries ``COORDS``
minwise tokens. Independent trees branch the classes: every node picks one coordinate, and with
probability 1/4 a second one, from a hash of its path, and sends a class to the child that its
minwise token there names (1.25 branches on average, so a pair at similarity 0.8 keeps one shared
child on average at any depth). Nodes of at most ``SMALL`` classes are compared exhaustively, larger
ones branch on. Trees repeat until the target recall (``TREES``; a pair at exactly 0.8 is missed by
all of them about once in several thousand).

Classes that crowd a node which keeps more than half of the node it comes of, or a node of the last
level, are alike, and minwise tokens don't tell them apart; branching on would only copy them. They are compared by their rarest shingles instead, which is
exact: of two sets that link, each holds a shared shingle among its first ``n - 0.8 n + 1`` in any
common order, and in the order of rising counts among the crowded classes those are the ones that
a family doesn't share. Counts are kept in cells of fixed number, so they can be shipped; as they fill
up, families that are small against them are compared more broadly, but nothing is lost. Where the first shared shingle stands too late in either set for enough
others to follow, the pair can't link and isn't made.

Comparing is in two steps: minwise agreement proposes, the full sets confirm. First every class is
checked against one earlier partner in each node, in large nodes in blocks of ``SMALL`` that all hold
the node's ``LEADERS`` first classes: linear work that connects most of a group of many near copies.
What is then still in different components is compared by ``FINE`` minwise tokens: at first each
class with its ``PARTNERS`` nearest, at last all. Buckets of a shingle that are larger than ``WIDE``
are split by component, and each two blocks that hold different components meet in a task of their
own. So each proposed pair is confirmed, refuted or already connected, while groups of copies don't
expand into pairs.

Edge cases: null or wordless texts have an empty set and are linked with nothing; texts of fewer
words than a shingle are one shingle of all their words; repeated rows share a class; rows without a
doc_id make no class, join that of their text, and stay in ``unique_documents``; different texts
under one doc_id are linked each by its own text, and each is judged for itself (of repeated rows
one stays); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recollect.llm import textscan as ts
from recollect.llm.components import components
from recollect.llm.sieve import maybe, sieve
from recollect.llm.staging import Scratch, Staged, unused

SHINGLE, PERCENT = 5, 80
COORDS, TREES, FIRST_LEVEL, LAST_LEVEL = 64, 12, 3, 5
SMALL, LEADERS, AGREE, SURE = 64, 16, 40, 52
FINE, FINE_AGREE, PARTNERS, WIDE = 512, 374, 4, 256
ROUNDS, CELL_BITS, BLOCK_BITS = (PARTNERS, None), 21, 12
COUNTERS, SETS = 1000, 20_000
_U = np.uint64
_FACTORS = ts.mix(np.arange(1, COORDS + FINE + 1, dtype=np.uint64) * _U(0xE7037ED1A0B428DB)) | _U(1)


def _sets(words: ts.Block, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted."""
    whole, out = ts.grams(words.hash, k), []
    for r in range(words.rows):
        a, b = words.first[r], words.first[r + 1]
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(ts.grams(words.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class_of(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the fingerprint of each set; 0 for empty ones."""
    sizes = np.array([len(s) for s in own], np.int64)
    full, out = np.flatnonzero(sizes), np.zeros((2, len(own)), np.int64)
    if len(full):
        x, starts = np.concatenate([own[r] for r in full]), np.cumsum(sizes[full]) - sizes[full]
        for half, salt in enumerate((0x51ED270B, 0x2F3A5C9D7B1E)):
            out[half, full] = ts.mix(np.add.reduceat(ts.mix(x + _U(salt)), starts) + sizes[full].astype(np.uint64)).view(np.int64)
    return out[0], out[1]


def _profiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, cls, cls2, sig); the last three are null for empty sets."""
    for batch in batches:
        for words in ts.blocks(batch.column("text"), ts.NON_SPACE):
            own = _sets(words, k)
            sizes = np.array([len(s) for s in own], np.int64)
            full = np.flatnonzero(sizes)
            (cls, cls2), sig = _class_of(own), np.zeros((words.rows, COORDS), np.uint16)
            if len(full):
                x, starts = np.concatenate([own[r] for r in full]), np.cumsum(sizes[full]) - sizes[full]
                for i in range(COORDS):
                    sig[full, i] = (np.minimum.reduceat(x * _FACTORS[i], starts) * _U(0x9E3779B97F4A7C15)) >> _U(48)
            empty = pa.array(sizes == 0)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * COORDS), words.rows, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(words.row0, words.rows), pa.array(sizes), pa.array(cls, mask=sizes == 0), pa.array(cls2, mask=sizes == 0), pa.compute.if_else(empty, pa.scalar(None, pa.binary()), packed)],
                names=["doc_id", "n_shingles", "cls", "cls2", "sig"],
            )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDS)


def _branch(who: np.ndarray, path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level down: the children of each path for the class that stands there, and which path each comes of."""
    h = ts.mix(path + _U(0x2545F4914F6CDD1D))
    first = (h & _U(COORDS - 1)).astype(np.int64)
    two = np.flatnonzero((h >> _U(8)) & _U(3) == 0)
    second = (first[two] + 1 + ((h[two] >> _U(16)) % _U(COORDS - 1)).astype(np.int64)) % COORDS
    who, at, coord, of = np.concatenate([who, who[two]]), np.concatenate([path, path[two]]), np.concatenate([first, second]), np.concatenate([np.arange(len(path)), two])
    return who, ts.mix(at * _U(3) + (coord.astype(np.uint64) << _U(16)) + sig[who, coord] + _U(1)), of


def _rooted(batches: Iterator[pa.RecordBatch], trees: int, level: int) -> Iterator[pa.RecordBatch]:
    """(path, cls) at the first level that is looked at."""
    roots = ts.mix(np.arange(1, trees + 1, dtype=np.uint64))
    for batch in batches:
        cls, sig = batch.column("cls").to_numpy(), _signatures(batch.column("sig"))
        for a in range(0, len(cls), 2000):
            part = sig[a : a + 2000]
            who, path = np.repeat(np.arange(len(part)), trees), np.tile(roots, len(part))
            for _ in range(level):
                who, path, _ = _branch(who, path, part)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(cls[a : a + 2000][who])], names=["path", "cls"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, cls, of): the children of each class's nodes, with the size of the node that each comes of."""
    for batch in batches:
        paths, sig = batch.column("paths"), _signatures(batch.column("sig"))
        who = np.repeat(np.arange(len(paths)), pa.compute.list_value_length(paths).to_numpy())
        who, path, of = _branch(who, paths.flatten().to_numpy().view(np.uint64), sig)
        columns = [pa.array(path.view(np.int64)), pa.array(batch.column("cls").to_numpy()[who]), pa.array(batch.column("sizes").flatten().to_numpy()[of])]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "cls", "of"])


def _nodes(reps: DataFrame, trees: int, small: int) -> DataFrame:
    """(path, block, cls, lead, large): the nodes to compare first, each of at most about small + LEADERS classes; large
    marks the blocks of a crowded node, lead its leaders in blocks that aren't their own. A node is crowded at the last
    level, or where it keeps more than half of the node it comes of."""
    rows = reps.select("cls", "sig").mapInArrow(lambda it: _rooted(it, trees, FIRST_LEVEL), "path long, cls long").withColumn("of", F.lit(None).cast("long")).hint("merge")
    out, crowds = None, None
    for level in range(FIRST_LEVEL, LAST_LEVEL + 1):
        # counted and joined in one job: the counts come dealt by path, as the join wants them
        kept = Staged(rows.join(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "path"), "path-rows").df
        leaves = kept.filter(F.col("n") <= small).select("path", F.lit(0).cast("long").alias("block"), "cls", F.lit(False).alias("lead"), F.lit(False).alias("large"))
        out = leaves if out is None else out.union(leaves)
        large = kept.filter(F.col("n") > small)
        if large.isEmpty():
            break
        alike = F.lit(True) if level == LAST_LEVEL else F.coalesce(2 * F.col("n") > F.col("of"), F.lit(False))
        crowd = large.filter(alike).select("path", "cls", "n")
        crowds = crowd if crowds is None else crowds.union(crowd)
        if level < LAST_LEVEL:
            standing = large.filter(~alike).groupBy("cls").agg(F.collect_list(F.struct("path", "n")).alias("at"))  # at most trees * 1.25**level
            standing = standing.select("cls", F.transform("at", lambda x: x["path"]).alias("paths"), F.transform("at", lambda x: x["n"]).alias("sizes"))
            rows = standing.join(reps.select("cls", "sig"), "cls").mapInArrow(_deeper, "path long, cls long, of long").hint("merge")
    if crowds is None:
        return out
    blocks = F.ceil(F.col("n") / small).cast("long")
    dealt = crowds.select("path", F.pmod(F.xxhash64("cls"), blocks).alias("block"), "cls", F.lit(False).alias("lead"))
    least = crowds.groupBy("path", F.pmod(F.xxhash64("cls"), F.lit(LEADERS)).alias("lane")).agg(F.min("cls").alias("cls"), F.first("n").alias("n"))
    led = least.select("path", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "cls", F.lit(True).alias("lead"))
    return out.union(dealt.union(led).groupBy("path", "block", "cls").agg(F.min("lead").alias("lead")).withColumn("large", F.lit(True)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches again, cut only between nodes."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        path, block = held.column("path").to_numpy(), held.column("block").to_numpy()
        new = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1]))
        if len(new):
            yield held.slice(0, int(new[-1]) + 1)
            held = held.slice(int(new[-1]) + 1)
    if held is not None:
        yield held


def _first_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each class with its first sure, or else best, earlier partner in its node, and
    (a, a) for other classes that have a partner."""
    for table in _runs(batches):
        begin, end, cls = *_bounds(table), table.column("cls").to_numpy()
        sig = _signatures(table.column("sig"))
        two = begin[end - begin == 2]
        two = two[(sig[two] == sig[two + 1]).sum(1) >= AGREE]
        left, right = [two], [two + 1]
        for a, b in zip(begin, end, strict=True):
            if b - a < 3:
                continue
            own = sig[a:b]
            agree = (own[:, None, :] == own[None, :, :]).sum(2)
            earlier = np.tril(agree, -1)
            best = np.where((earlier >= SURE).any(1), (earlier >= SURE).argmax(1), earlier.argmax(1))
            has = earlier[np.arange(b - a), best] >= AGREE
            i, j = best[has], np.flatnonzero(has)
            lone = np.setdiff1d(np.flatnonzero((agree >= AGREE).sum(1) > 1), np.concatenate([i, j]))
            left += [a + i, a + lone]
            right += [a + j, a + lone]
        yield _pairs(cls, left, right)


def _other_partners(batches: Iterator[pa.RecordBatch], percent: int, partners: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of different components whose sizes, places and fine signatures allow a link: of each class
    its nearest ``partners``, or all. A pair that meets in several nodes is made in the first of them only (``paths``
    lists those of a class), one that meets in several shingles not where the shingle before is shared as well.
    Classes of sides 0 and 1 meet the other side only, those of side 2 one another."""
    for table in _runs(batches):
        begin, end = _bounds(table)
        cls, root, size, here, side, pos = (table.column(c).to_numpy() for c in ("cls", "root", "n", "path", "side", "pos"))
        before, none_before = table.column("before").fill_null(0).to_numpy(), table.column("before").is_null().to_numpy()
        paths = table.column("paths").combine_chunks()
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(begin, end, strict=True):
            of, n, on, room, last = root[a:b], size[a:b], side[a:b], (size - np.maximum(pos, 0))[a:b], before[a:b]
            if (of == of[0]).all():
                continue
            agree = np.zeros((b - a, b - a), np.int32)
            for i in range(b - a):
                fits = (of != of[i]) & ((on != on[i]) | (on == 2)) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                fits &= ((100 + percent) * np.minimum(room, room[i]) >= percent * (n + n[i])) & (none_before[a:b] | none_before[a + i] | (last != last[i]))
                to = np.flatnonzero(fits)
                agree[i, to] = (fine[a + i] == fine[a + to]).sum(1)
            if partners is not None and b - a > partners:
                nearest = np.argpartition(-agree, partners - 1, axis=1)[:, :partners]
                near_only = np.zeros_like(agree)
                np.put_along_axis(near_only, nearest, np.take_along_axis(agree, nearest, 1), 1)
                agree = near_only
            near = agree >= FINE_AGREE
            i, j = np.nonzero(np.triu(near | near.T, 1))
            if pos[a] < 0 and len(i):
                lists = {k: set(paths[a + k].as_py()) for k in np.unique(np.concatenate([i, j])).tolist()}
                first = np.array([min(lists[x] & lists[y]) == here[a] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[first], j[first]
            left.append(a + i)
            right.append(a + j)
        yield _pairs(cls, left, right)


def _bounds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    path, block = table.column("path").to_numpy(), table.column("block").to_numpy()
    cut = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
    return np.append(0, cut), np.append(cut, len(path))


def _pairs(cls: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a, b = cls[np.concatenate(left)], cls[np.concatenate(right)]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("path", "block").sortWithinPartitions("path", "block", "cls")


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (ts.mix(tokens + _U(0x3C79AC492BA7B653)) >> _U(64 - CELL_BITS)).astype(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Batches of sets in parts: what is made of a part is let go before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packed(n: np.ndarray) -> pa.RecordBatch:
    """Counts above zero, a row for each ``1 << BLOCK_BITS`` cells: (block, cells, counts)."""
    at = np.flatnonzero(n)
    block, begin = np.unique(at >> BLOCK_BITS, return_index=True)
    offsets = pa.array(np.append(begin, len(at)).astype(np.int32))
    columns = [pa.array(block), pa.ListArray.from_arrays(offsets, pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(n[at].astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "cells", "counts"])


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's shingles fall into each cell, packed."""
    n = np.zeros(1 << CELL_BITS, np.uint32)
    for part in _sliced(batches):
        np.add.at(n, _cells(np.frombuffer(b"".join(part.column("shingles").to_pylist()), np.uint64)), 1)
    yield _packed(n)


def _added(cells: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur, each once, and the sums of their counts."""
    at, n = (np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in column.chunks)]) for column in (cells, counts))
    own, where = np.unique(at, return_inverse=True)
    return own, np.bincount(where, n, len(own)).astype(np.int64)


def _cells_of(sets: DataFrame) -> np.ndarray:
    """The counts over all sets, from at most ``COUNTERS`` tasks."""
    tasks = min(COUNTERS, max(1, -(-sets.count() // SETS)))
    packed = sets.select("shingles").coalesce(tasks).mapInArrow(_cell_counts, "block long, cells array<long>, counts array<long>")

    def merged(table: pa.Table) -> pa.Table:
        own, n = _added(table.column("cells"), table.column("counts"))
        return pa.table({"block": table.column("block").slice(0, 1), "cells": pa.array([own], pa.list_(pa.int64())), "counts": pa.array([n], pa.list_(pa.int64()))})

    got = packed.groupBy("block").applyInArrow(merged, packed.schema).toArrow()  # at most 2**CELL_BITS counts
    out = np.zeros(1 << CELL_BITS, np.int64)
    own, n = _added(got.column("cells"), got.column("counts"))
    out[own] = n
    return out


def _ranked(batches: Iterator[pa.RecordBatch], percent: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cls, skipped, tokens) of sets, as ``_prefixes`` says."""
    for batch in _sliced(batches):
        skipped, out = [], []
        for shingles in batch.column("shingles").to_pylist():
            tokens = np.frombuffer(shingles, np.uint64)
            often = counts[_cells(tokens)]
            first = np.lexsort((tokens, often))[: len(tokens) * (100 - percent) // 100 + 1]
            shared = first[often[first] > 1]
            skipped.append(len(first) - len(shared))
            out.append(tokens[shared].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(skipped, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["cls", "skipped", "tokens"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, skipped, tokens): the first shingles of each set that a link must share one of, in a common order, the
    ``skipped`` before them being in no other set. The order is that of counts in 2**CELL_BITS cells, then of shingles:
    whatever the counts say, no link is lost; the truer they are, the fewer classes share one of these shingles."""
    counts = np.minimum(_cells_of(sets), 0xFFFFFFFF).astype(np.uint32)
    shipped = sets.sparkSession.sparkContext.broadcast(counts)
    ranked = sets.select("cls", "shingles").mapInArrow(lambda it: _ranked(it, percent, shipped.value), "cls long, skipped long, tokens array<long>")
    return ranked.filter(F.size("tokens") > 0)


def _tasks(rows: DataFrame, roots: DataFrame, wide: int) -> DataFrame:
    """(path, block, cls, side, pos, before) of the nodes and buckets (path, cls, pos, before) that hold different components: those of
    at most ``wide`` classes whole, and of larger ones every two blocks of classes that hold different components.
    Components of at least ``wide`` classes have blocks of their own, the others share theirs."""
    rows = rows.join(roots, "cls")
    live = rows.groupBy("path").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("classes")).filter("lo <> hi").select("path", "classes")
    rows = Staged(rows.join(live, "path"), "node-rows").df
    small = rows.filter(F.col("classes") <= wide).select("path", F.lit(0).cast("long").alias("block"), "cls", F.lit(2).alias("side"), "pos", "before")
    rows = rows.filter(F.col("classes") > wide)
    sizes = Staged(rows.groupBy("path", "root").agg(F.count("*").alias("n")).select("path", "root", "n", F.when(F.col("n") >= wide, F.col("root")).alias("own")), "node-components").df
    if sizes.isEmpty():
        return small
    groups = sizes.groupBy("path", "own").agg(F.ceil(F.sum("n") / wide).cast("long").alias("blocks"))
    key = F.xxhash64("path", "own", "i")
    blocks = groups.select("path", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i")).select("path", "own", key.alias("key"))
    p, q = blocks.toDF("path", "own_p", "p"), blocks.toDF("path", "own_q", "q")
    same = (F.col("p") == F.col("q")) & F.col("own_p").isNull()
    two = (F.col("p") < F.col("q")) & ~F.coalesce(F.col("own_p") == F.col("own_q"), F.lit(False))
    met = p.join(q, "path").filter(same | two).withColumn("block", F.xxhash64("p", "q"))
    met = met.filter("p <> q").select("path", "block", F.explode(F.create_map(F.col("p"), F.lit(0), F.col("q"), F.lit(1))).alias("key", "side")).union(
        met.filter("p = q").select("path", "block", F.col("p").alias("key"), F.lit(2).alias("side"))
    )
    members = (
        rows.select("path", "cls", "root", "pos", "before").join(sizes.select("path", "root", "own"), ["path", "root"])
        .join(groups.withColumnRenamed("own", "of"), "path").filter("own <=> of")
        .withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks"))).select("path", key.alias("key"), "cls", "pos", "before")
    )
    return small.unionByName(members.join(met, ["path", "key"]).select("path", "block", "cls", "side", "pos", "before"))


def _further(nodes: DataFrame, prefixes: DataFrame, fine: DataFrame, roots: DataFrame, tried: DataFrame, percent: int, partners: int | None, wide: int = WIDE) -> DataFrame:
    """Untried pairs between components."""
    known = fine.join(roots.select("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    own = nodes.filter("not large").select("path", "cls")
    placed = prefixes.select("cls", "skipped", "tokens", F.posexplode("tokens").alias("at", "path"))
    placed = placed.select("path", "cls", (F.col("skipped") + F.col("at")).alias("pos"), F.expr("try_element_at(tokens, nullif(at, 0))").alias("before"))
    rows = own.select("path", "cls", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("before")).union(placed)
    listed = own.groupBy("cls").agg(F.collect_list("path").alias("paths"))  # a few for each tree
    tasks = _tasks(rows, known.select("cls", "root"), wide).join(known, "cls").join(listed, "cls", "left")
    tasks = tasks.withColumn("paths", F.when(F.col("pos") < 0, F.col("paths")))
    pairs = _by_node(tasks).mapInArrow(lambda it: _other_partners(it, percent, partners), "a long, b long").distinct()
    return Staged(pairs.join(tried, ["a", "b"], "left_anti"), "more-pairs").df


def _full_sets(batches: Iterator[pa.RecordBatch], k: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array(maybe(bitmap, batch.column("h").to_numpy())))
        for words in ts.blocks(batch.column("text"), ts.NON_SPACE):
            own = [s for s in _sets(words, k) if len(s)]
            if not own:
                continue
            sizes = np.array([len(s) for s in own])
            x, starts = np.concatenate(own), np.cumsum(sizes) - sizes
            fine = np.stack([(np.minimum.reduceat(x * f, starts) * _U(0x9E3779B97F4A7C15)) >> _U(56) for f in _FACTORS[COORDS:]], 1).astype(np.uint8)
            columns = [pa.array(_class_of(own)[0]), pa.array(sizes), pa.array([f.tobytes() for f in fine], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "fine", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _confirm(it, percent), "a long, b long")


def _connected(links: DataFrame, reps: DataFrame) -> DataFrame:
    """(cls, root, component_id) of linked classes; components are ordered by their least doc_id."""
    u, v = (reps.select(F.col("cls").alias(c), F.struct("rep", "cls").alias(n)) for c, n in (("a", "u"), ("b", "v")))
    found = components(links.join(u, "a").join(v, "b").select("u", "v"))
    return found.select(F.col("node.cls").alias("cls"), F.col("root.cls").alias("root"), F.col("root.rep").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, trees: int = TREES, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, class id, component_id (least doc_id) and whether it is kept. Documents link
    at PERCENT; the trees' branching and the bars for proposals (AGREE of COORDS, FINE_AGREE of FINE) are set for that
    similarity, so it isn't an option."""
    with Scratch() as scratch:
        return scratch.keep(_near_duplicates(docs, shingle, PERCENT, trees, small))


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, trees: int, small: int) -> Staged:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = Staged(docs.mapInArrow(lambda it: _profiles(it, shingle), "doc_id long, n_shingles long, cls long, cls2 long, sig binary"), "profiles").df
    classes = Staged(rows.filter("cls is not null and doc_id is not null").groupBy("cls", "cls2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes").df
    nodes = Staged(_nodes(classes.select("cls", "sig"), trees, small), "nodes").df
    first = _by_node(nodes.drop("lead", "large").join(classes.select("cls", "sig"), "cls")).mapInArrow(_first_partners, "a long, b long").distinct()
    first = Staged(first, "pairs").df
    involved = first.select(F.explode(F.array("a", "b")).alias("cls"), F.lit(False).alias("crowd")).union(nodes.filter("large").select("cls", F.lit(True)))
    involved = Staged(involved.groupBy("cls").agg(F.max("crowd").alias("crowd")).join(classes.select("cls", "rep"), "cls").select("cls", "rep", "crowd"), "involved").df
    bitmap = docs.sparkSession.sparkContext.broadcast(sieve(involved.select(F.xxhash64("rep").alias("h")), "h"))
    sets = docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(lambda it: _full_sets(it, shingle, bitmap.value), "cls long, n long, fine binary, shingles binary")
    sets = Staged(sets.join(involved.select("cls", "crowd"), "cls").dropDuplicates(["cls"]), "sets").df
    links = Staged(_confirmed(first.filter("a <> b"), sets, percent), "links").df
    roots = _connected(links, involved)
    prefixes = Staged(_prefixes(sets.filter("crowd"), percent), "prefixes").df
    for partners in ROUNDS:
        more = _further(nodes, prefixes, sets.select("cls", "n", "fine"), roots, first, percent, partners)
        if more.isEmpty():
            continue
        extra = Staged(_confirmed(more, sets, percent), "more-links").df
        first = first.union(more)
        if not extra.isEmpty():
            links = links.union(extra)
            roots = _connected(links, involved)
    ids = classes.select("cls", "cls2", "rep").join(roots, "cls", "left").select("cls", "cls2", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "cls", "cls2").join(ids, ["cls", "cls2"], "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", F.col("cls").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
    return Staged(out, "near-duplicates")


def _classed(batches: Iterator[pa.RecordBatch], k: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls = [_class_of(_sets(words, k))[0] for words in ts.blocks(batch.column("text"), ts.NON_SPACE)]
        yield batch.append_column(name, pa.array(np.concatenate([np.zeros(0, np.int64), *cls])))


def unique_documents(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """One document of each near-duplicate group, the one of least doc_id; all columns kept. Of different texts under
    one doc_id each is judged for itself; of rows with the same doc_id and set the first by a hash of all columns stays."""
    found = near_duplicates(docs, shingle, **options).select("doc_id", "class_id", "kept")
    repeated = Staged(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated-ids").df
    gone = found.filter("not kept").select("doc_id").distinct()
    single = docs.join(gone, "doc_id", "left_anti")
    if repeated.isEmpty():
        return single
    again = docs.join(repeated, "doc_id", "left_semi")
    own, first = unused(docs, "_x_class", "_x_first")
    again = again.mapInArrow(lambda it: _classed(it, shingle, own), T.StructType([*again.schema, T.StructField(own, T.LongType())]))
    stay = found.filter("kept").select("doc_id", F.coalesce("class_id", F.lit(0)).alias(own)).distinct()
    least = Window.partitionBy("doc_id", own).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    again = again.join(stay, ["doc_id", own], "left_semi").withColumn(first, F.row_number().over(least)).filter(F.col(first) == 1)
    return single.join(repeated, "doc_id", "left_anti").unionByName(again.drop(own, first))
