"""Ranked retrieval: scope, candidates, lexical and semantic channels, fusion, gate, ranking and paging.

The scope is applied before candidates are counted or ranked, so a limit never hides in-scope rows,
and BM25 statistics are those of the scoped pool.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as X
from recollect.functions import vectors as V
from recollect.operators import ranks

K1, B = 1.2, 0.75
TRUST = {"quarantined": 0, "standard": 1, "trusted": 2}
QUARANTINE = "quarantine-pending"


@dataclass(frozen=True)
class SearchOptions:
    """What a search may declare; the weights and the gate are parameters, not constants."""

    query: str = ""
    wing: str | None = None
    room: str | None = None
    kind: str | None = None
    min_trust: str | None = None
    limit: int = 10
    offset: int = 0
    room_cap: int | None = None
    language: str | None = None
    vector: tuple[float, ...] | None = None
    semantic_weight: float = 0.6
    gate: float = V.GATE
    #: A Column over the records' columns that orders the first ``rerank_depth`` hits anew, highest first.
    rerank: Column | None = None
    rerank_depth: int = 20


def in_scope(rows: DataFrame, wing: str | None = None, room: str | None = None, kind: str | None = None) -> DataFrame:
    """Equality scope; the quarantine wing only when named."""
    for name, value in (("wing", wing), ("room", room), ("kind", kind)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows if wing is not None else rows.filter(F.col("wing") != QUARANTINE)


def trust_rank(trust: Column) -> Column:
    """quarantined 0, standard 1 (also where unassigned), trusted 2."""
    return F.when(trust == "quarantined", 0).when(trust == "trusted", 2).otherwise(1)


def above_floor(rows: DataFrame, trust: DataFrame, floor: str) -> DataFrame:
    """Rows whose wing is assigned at least the floor; trust is (wing, trust)."""
    if TRUST[floor] == 0:
        return rows
    return rows.join(trust, "wing", "left").filter(trust_rank(F.col("trust")) >= TRUST[floor]).drop("trust")


def effective_floor(requested: str | None, vault: str | None, wing: str | None) -> str:
    """The request's floor, else the vault's unless a wing is named."""
    return requested or (vault if vault and wing is None else None) or "quarantined"


def floor_of(requested: Column, vault: Column, wing: Column) -> Column:
    """``effective_floor`` of columns."""
    return F.coalesce(requested, F.when(wing.isNull(), vault), F.lit("quarantined"))


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def bm25(pool: DataFrame, query_terms: list[str]) -> DataFrame:
    """(id, bm25) of pool rows (id, tokens) that hold a query term, by statistics of the pool."""
    terms = F.array(*(F.lit(t) for t in query_terms))
    sized = pool.select("id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: F.array_contains(terms, t)).alias("hits"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(query_terms)))
    rows = sized.filter(F.size("hits") > 0).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i, t in enumerate(query_terms):
        tf = _occurrences(F.col("hits"), t)
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("id", score.alias("bm25"))


def approximate(pool: DataFrame, query_terms: list[str], language: str | None) -> DataFrame:
    """(id, morph) of pool rows (id, tokens) without the word itself but with one of its stem, or one edit away:
    half the weight of exact evidence, and at most one occurrence for each query word."""
    near = F.lit(0.0)
    for t in query_terms:
        word = F.lit(t)
        near = near + F.when(~F.array_contains("tokens", t) & _any_like(F.col("tokens"), word, language), 0.5).otherwise(0.0)
    return pool.select("id", near.alias("morph")).filter("morph > 0")


def _any_like(tokens: Column, word: Column, language: str | None) -> Column:
    if language is None:
        return F.exists(tokens, lambda x: X.within_one_edit(x, word))
    return F.exists(tokens, lambda x: (X.stem(x, language) == X.stem(word, language)) | X.within_one_edit(x, word))


def external(records: DataFrame, vector: list[float], limit: int, offset: int = 0) -> DataFrame:
    """Hits of a vector that the caller computed; a vector of another length than the records' is refused."""
    sizes = records.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if sizes["lo"] is not None and not sizes["lo"] == sizes["hi"] == len(vector):
        raise ValueError(f"the vector has {len(vector)} components, the records have {sizes['lo']} to {sizes['hi']}")
    probe = F.array(*(F.lit(float(x)) for x in vector))
    return top(records.withColumn("score", V.semantic(V.cosine(F.col("embedding"), probe))), "score", limit, offset)


def pool_size(live: int, scoped: int | None = None) -> tuple[int, int]:
    """Rows of the first and second candidate stage: shares of what is live, or of a scope within bounds."""
    if scoped is not None:
        return min(scoped, 2048), min(scoped, 1024)
    return max(live // 64, 1), max(live // 512, 1)


def pool_columns(live: Column, scoped: Column) -> tuple[Column, Column]:
    """``pool_size`` of columns; scoped is null where nothing narrows the scope."""
    first = F.when(scoped.isNotNull(), F.least(scoped, F.lit(2048))).otherwise(F.greatest((live / 64).cast("long"), F.lit(1)))
    return first, F.when(scoped.isNotNull(), F.least(scoped, F.lit(1024))).otherwise(F.greatest((live / 512).cast("long"), F.lit(1)))


def refreshing(new: DataFrame, old: DataFrame, least: float, page: int = 4096) -> DataFrame:
    """(id, refreshes, score) of new records (id, wing, room, embedding of unit length) that an old one of their wing and
    room is like, at least ``least``; the nearest, ties by least id. Rooms are compared page by page: a page of old
    records meets the page of new ones in one task, as a product of matrices."""
    counts = new.select("wing", "room", F.lit(1).alias("n"), F.lit(0).alias("o")).union(old.select("wing", "room", F.lit(0), F.lit(1))).groupBy(F.col("wing").alias("w"), F.col("room").alias("r"))
    sizes = counts.agg(F.ceil(F.sum("n") / page).cast("int").alias("mine"), F.ceil(F.sum("o") / page).cast("int").alias("theirs")).filter("mine > 0 and theirs > 0").toDF("wing", "room", "mine", "theirs")
    deal = lambda rows, own: rows.join(sizes, ["wing", "room"]).withColumn("p", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
    one = deal(new, "mine").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))).select("wing", "room", "p", "q", F.col("id").cast("long").alias("id"), "embedding")
    two = deal(old, "theirs").withColumnRenamed("p", "q").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("mine") - 1))).select("wing", "room", "p", "q", F.col("id").cast("long").alias("id"), "embedding")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "refreshes": [], "score": []})
        b, own, out = b.sort_values("id"), np.stack(a["embedding"].to_numpy()), []
        theirs = np.stack(b["embedding"].to_numpy()).T
        for at in range(0, len(own), 256):  # a slice of the product at a time
            score = (own[at : at + 256] @ theirs).round(9)
            best = score.argmax(1)  # the first, so the least id
            top = score[np.arange(len(score)), best]
            near = top >= least
            out.append(pd.DataFrame({"id": a["id"].to_numpy()[at : at + 256][near], "refreshes": b["id"].to_numpy()[best[near]], "score": top[near]}))
        return pd.concat(out)

    keys = ["wing", "room", "p", "q"]
    two = two.toDF(*(f"{c}_" for c in two.columns)).toDF(*two.columns)  # columns of their own, where both come of one table
    found = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(meet, "id long, refreshes long, score double")
    return found.groupBy("id").agg(F.max_by("refreshes", F.struct("score", -F.col("refreshes"))).alias("refreshes"), F.max("score").alias("score"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, page: int = 8192, places: int = 12) -> DataFrame:
    """(query_id, id, score, rank): the k rows (id, embedding) of greatest cosine with each query (id, embedding), not
    itself, by similarity to ``places`` decimals, then id. Pages of queries meet pages of rows, each two in one task."""
    asked, held = (max(1, -(-d.count() // page)) for d in (queries, rows))
    one = queries.select(F.col("id").cast("long").alias("query_id"), F.col("embedding").alias("probe"), F.pmod(F.xxhash64("id"), F.lit(asked).cast("long")).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(held - 1).cast("long"))).alias("q"))
    two = rows.select(F.col("id").cast("long").alias("id"), "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long"))).alias("p"), F.pmod(F.xxhash64("id"), F.lit(held).cast("long")).alias("q"))
    two = two.toDF(*(f"{c}_" for c in two.columns)).toDF(*two.columns)

    def unit(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(float)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        b = b.sort_values("id")
        ids, other, out = b["id"].to_numpy(), unit(b["embedding"]), []
        for at in range(0, len(a), 256):
            own = a["query_id"].to_numpy()[at : at + 256]
            score = (unit(a["probe"][at : at + 256]) @ other.T).round(places)
            score[own[:, None] == ids[None, :]] = -np.inf
            near = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(own, near.shape[1]), "id": ids[near.ravel()], "score": np.take_along_axis(score, near, 1).ravel()}))
        found = pd.concat(out)
        return found[found["score"] > -np.inf]

    found = one.groupBy("p", "q").cogroup(two.groupBy("p", "q")).applyInPandas(meet, "query_id long, id long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def remote(index, records: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """Hits (id, score, rank): candidates of an external index, four for each hit and 20 at least, ranked again by the
    records' own vectors (id, embedding)."""
    probe = F.array(*(F.lit(float(x)) for x in vector))
    near = index.query(vector, max(4 * limit, 20)).select("id")
    return top(records.join(F.broadcast(near), "id").select("id", V.semantic(V.cosine(F.col("embedding"), probe)).alias("score")), "score", limit)  # the candidates are bounded


def squash(score: Column) -> Column:
    """[0, inf) to [0, 1)."""
    return score / (score + 1)


def admitted(exact: Column, morph: Column, semantic: Column, gate: float) -> Column:
    """Lexical evidence of any kind, or semantic evidence above the gate."""
    return (exact > 0) | (morph > 0) | (semantic > gate)


def fuse(lexical: Column, semantic: Column, weight: float, disjoint: Column | None = None, ceiling: float = 0.95) -> Column:
    """Weighted blend; where the query and the text share no script, the semantic weight is at its ceiling."""
    w = F.lit(weight) if disjoint is None else F.when(disjoint, ceiling).otherwise(weight)
    return w * semantic + (1 - w) * lexical


def reciprocal_rank(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """(id, rrf) from rankings of (id, rank)."""
    out = rankings[0].select("id", (1.0 / (k + F.col("rank"))).alias("s"))
    for r in rankings[1:]:
        out = out.union(r.select("id", 1.0 / (k + F.col("rank"))))
    return out.groupBy("id").agg(F.sum("s").alias("rrf"))


def top(hits: DataFrame, score: str, limit: int, offset: int = 0) -> DataFrame:
    """Rank-space page of hits by falling score, ties by id: a bounded sort, not a full one."""
    head = hits.orderBy(F.desc(score), "id").limit(offset + limit)
    ranked = head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))  # offset + limit rows
    return ranked.filter(F.col("rank") > offset)


def leading(rows: DataFrame, score: str, n: int, low: float, high: float, bins: int = 4096) -> DataFrame:
    """The ``n`` rows of greatest score, and any more that share the last one's bin: a histogram of the scores, between
    bounds that hold for all of them, gives the threshold, so nothing is sorted and no task holds them all."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(score) - low) / (high - low) * bins)))
    counts = sorted(((r["b"], r["n"]) for r in rows.groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect() if r["b"] is not None), reverse=True)  # at most ``bins`` rows
    left, least = n, 0
    for b, size in counts:
        left, least = left - size, b
        if left <= 0:
            break
    return rows.filter(place >= least)


def capped(hits: DataFrame, group: str, score: str, cap: int, depth: int, per: str | None = None) -> DataFrame:
    """The first ``depth`` places: at most cap of each group first, then the rest, each by score; of each query, where
    ``per`` names its column. Only the per-group ranking shuffles; the places of one ranking are a bounded sort."""
    if per is not None:
        within = F.row_number().over(Window.partitionBy(per, group).orderBy(F.desc(score), "id"))
        spare = hits.withColumn("_spare", (within > cap).cast("int"))
        place = F.row_number().over(Window.partitionBy(per).orderBy("_spare", F.desc(score), "id"))
        return spare.withColumn("place", place).filter(F.col("place") <= depth).drop("_spare")
    own = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "id"))
    head = hits.withColumn("spare", (own > cap).cast("int")).orderBy("spare", F.desc(score), "id").limit(depth)
    return head.withColumn("place", F.row_number().over(Window.orderBy("spare", F.desc(score), "id"))).drop("spare")


def first_of_group(ranked: DataFrame, group: str, depth: int | None = None, per: str | None = None) -> DataFrame:
    """The first ``depth`` groups, or all, in the order in which they appear, with their rank; of each query, where ``per``
    names its column."""
    if per is not None:
        place = F.row_number().over(Window.partitionBy(per).orderBy("seen"))
        out = ranked.groupBy(per, group).agg(F.min("rank").alias("seen")).select(per, group, place.alias("rank"))
        return out if depth is None else out.filter(F.col("rank") <= depth)
    best = ranked.groupBy(group).agg(F.min("rank").alias("seen"))
    if depth is None:
        return ranks.ranked(best.withColumn("_all", F.lit(0)), "_all", "seen", group).select(group, F.col("rank").cast("int").alias("rank"))
    best = best.orderBy("seen").limit(depth)
    return best.select(group, F.row_number().over(Window.orderBy("seen")).alias("rank"))


def rescored(ranked: DataFrame, late: Column, n: int) -> DataFrame:
    """A page of ranked hits with its first n ranks in the order of a second score, the others as they were."""
    head = F.when(F.col("rank") <= n, late)
    return ranked.withColumn("late", head).withColumn("place", F.row_number().over(Window.orderBy((F.col("rank") > n).cast("int"), F.desc_nulls_last("late"), "rank")))


def query_terms(query: str) -> list[str]:
    """The words of a query that postings are asked for, each once."""
    return list(dict.fromkeys(t for t in X.segment_text(X.fold_key(query))[0] if len(t.encode()) > 1))


def disjoint(mask: Column, query: str) -> Column:
    """Whether a text with this script mask shares no script with the query; ASCII queries share with every text."""
    if not any(c.isalpha() and not c.isascii() for c in query):
        return F.lit(False)
    return X.scripts_disjoint(mask, X.script_mask(F.lit(query)))


def ranked_page(hits: DataFrame, options: SearchOptions, contents: DataFrame | None = None) -> DataFrame:
    """The page that was asked for of hits (id, wing, room, disjoint, semantic, bm25, morph): gated, fused, ranked, the
    head ranked again by ``options.rerank`` over the columns of ``contents`` (id, ...)."""
    hits = hits.fillna({"morph": 0.0, "bm25": 0.0}).withColumn("lexical", squash(F.col("bm25") + F.col("morph")))
    hits = hits.filter(admitted(F.col("bm25"), F.col("morph"), F.col("semantic"), options.gate))
    blend = fuse(F.col("lexical"), F.col("semantic"), options.semantic_weight, F.col("disjoint"))
    hits = hits.withColumns({"score": blend, "lexical_exact": squash(F.col("bm25")), "lexical_morph": squash(F.col("morph"))}).drop("bm25", "morph", "disjoint")
    depth = options.offset + options.limit
    if options.rerank is not None:
        head = top(hits, "score", max(depth, options.rerank_depth))
        seen = contents.drop("wing", "room").join(F.broadcast(head), "id")  # a page of hits
        again = rescored(seen.withColumn("late", options.rerank), F.col("late"), options.rerank_depth).select(*head.columns, "place")
        return again.filter((F.col("place") > options.offset) & (F.col("place") <= depth)).drop("rank").withColumnRenamed("place", "rank")
    if options.room_cap:
        page = capped(hits, "room", "score", options.room_cap, depth).withColumnRenamed("place", "rank")
        return page.filter(F.col("rank") > options.offset)
    return top(hits, "score", options.limit, options.offset)


def search(records: DataFrame, options: SearchOptions, trust: DataFrame | None = None) -> DataFrame:
    """Hits (id, wing, room, score, rank and the channels semantic, lexical, lexical_exact, lexical_morph) of records
    (id, wing, room, content, embedding optional), by a scan of them; ``SearchIndex`` asks stored postings instead."""
    pool = in_scope(records, options.wing, options.room, options.kind)
    if trust is not None and options.min_trust:
        pool = above_floor(pool, trust, options.min_trust)
    terms = query_terms(options.query)
    scored = pool.withColumn("tokens", X.words(X.search_key(F.col("content"))))
    apart = disjoint(X.script_mask(F.col("content")), options.query).alias("disjoint")
    lexical = bm25(scored, terms) if terms else scored.select("id", F.lit(0.0).alias("bm25")).limit(0)
    if "embedding" in records.columns:
        probe = F.array(*(F.lit(float(x)) for x in options.vector or V.hash_embed(options.query)))
        hits = scored.select("id", "wing", "room", apart, V.semantic(V.cosine(F.col("embedding"), probe)).alias("semantic")).join(lexical, "id", "left")
    else:
        hits = scored.select("id", "wing", "room", apart, F.lit(0.5).alias("semantic")).join(lexical, "id", "left" if options.language else "inner")
    if terms and options.language:
        hits = hits.join(approximate(scored, terms, options.language), "id", "left")
    else:
        hits = hits.withColumn("morph", F.lit(0.0))
    return ranked_page(hits, options, pool)
