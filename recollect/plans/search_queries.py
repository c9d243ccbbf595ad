"""Queries of retrieval over documents and embeddings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import text as X
from recollect.functions import vectors as V
from recollect.operators import late as L
from recollect.operators import search as S
from recollect.operators.index import SearchIndex
from recollect.operators.vector_index import VectorIndex
from recollect.plans.register import ORACLES, query
from recollect.sources import work as W
from recollect.sources.tables import spread, table


def records(spark, sf_dir):
    """Documents as records: the language is the wing, the source the room."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("wing"), F.col("source").alias("room"), F.col("text").alias("content"))


_QUERY = "thing whand edly"
_TOKENS = r"regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\p{L}\p{N}]+')"


def _bm25_sql(where: str, words: list[str] | None = None) -> str:
    terms = words or _QUERY.split()
    tf = [f"len(list_filter(t, lambda x: x = '{w}'))" for w in terms]
    stats = ", ".join(f"count(*) FILTER ({c} > 0) AS df{i}" for i, c in enumerate(tf))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * len(t) / avgdl))" for i, c in enumerate(tf))
    return f"""p AS (SELECT doc_id, lang, source, {_TOKENS} AS t FROM documents WHERE {where}),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl, {stats} FROM p),
sc AS (SELECT doc_id, lang, source, {score} AS bm25 FROM p, st WHERE {" OR ".join(f"{c} > 0" for c in tf)})"""


@query(f"WITH {_bm25_sql("lang = 'en'")} SELECT doc_id AS id, bm25 FROM sc")
def q_bm25(spark, sf_dir):
    """BM25 over one wing, by that wing's statistics."""
    pool = S.in_scope(records(spark, sf_dir), wing="en").select("id", X.words(X.search_key(F.col("content"))).alias("tokens"))
    return S.bm25(pool, _QUERY.split())


@query(f"WITH {_bm25_sql('true')} SELECT * FROM (SELECT doc_id AS id, lang AS wing, source AS room, 0.5 AS semantic, bm25 / (bm25 + 1) AS lexical, bm25 / (bm25 + 1) AS lexical_exact, 0.0 AS lexical_morph, 0.3 + 0.4 * bm25 / (bm25 + 1) AS score, CAST(row_number() OVER (ORDER BY 0.3 + 0.4 * bm25 / (bm25 + 1) DESC, doc_id) AS INTEGER) AS rank FROM sc) WHERE rank > 5 AND rank <= 25")
def q_search(spark, sf_dir):
    """Lexical search over all wings, second page."""
    return S.search(records(spark, sf_dir), S.SearchOptions(query=_QUERY, limit=20, offset=5))


#: Signed sums of hashed features by slot, x(doc_id, slot, x), and their lengths, xn(doc_id, size).
_EMBED = rf"""xt AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
xf AS (SELECT doc_id, 'u:' || unnest(w) AS f FROM xt
UNION ALL SELECT doc_id, 'b:' || w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM xt)
UNION ALL SELECT doc_id, 't:' || substr(y, i, 3) FROM (SELECT doc_id, y, unnest(range(1, length(y) - 1)) AS i FROM (SELECT doc_id, unnest(w) AS y FROM xt) WHERE length(y) > 3)),
xh AS (SELECT doc_id, sha256(f) AS h FROM xf),
x AS (SELECT doc_id, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) % 384 AS slot, sum(CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM xh GROUP BY ALL),
xn AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM x GROUP BY doc_id)"""
_PROBE = "(VALUES " + ", ".join(f"({slot}, {x!r})" for slot, x in enumerate(V.hash_embed(_QUERY).tolist()) if x) + ") p(slot, y)"


@query(f"""WITH {_bm25_sql("lang = 'en'")}, {_EMBED},
c AS (SELECT doc_id, (1 + sum(x * y) / any_value(size)) / 2 AS semantic FROM x JOIN {_PROBE} USING (slot) JOIN xn USING (doc_id) GROUP BY doc_id),
h AS (SELECT doc_id, source, coalesce(semantic, 0.5) AS semantic, coalesce(bm25, 0) AS exact FROM p LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, bm25 FROM sc) USING (doc_id)),
s AS (SELECT *, exact / (exact + 1) AS lexical, 0.6 * semantic + 0.4 * exact / (exact + 1) AS score FROM h WHERE exact > 0 OR semantic > 0.56),
o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) > 2 THEN 1 ELSE 0 END AS spare FROM s)
SELECT doc_id AS id, 'en' AS wing, source AS room, semantic, lexical, exact / (exact + 1) AS lexical_exact, 0.0 AS lexical_morph, score, CAST(row_number() OVER (ORDER BY spare, score DESC, doc_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 20""")
def q_hybrid_search(spark, sf_dir):
    """Lexical and hash-embedding channels fused, gated, capped by room."""
    rows = records(spark, sf_dir).withColumn("embedding", V.embed(F.col("content")))
    return S.search(rows, S.SearchOptions(query=_QUERY, wing="en", limit=20, room_cap=2))


_indexes: dict[tuple, SearchIndex] = {}


def stored_index(spark, sf_dir, embedded: bool = True) -> SearchIndex:
    """The index of the documents, made by the first query of a session that asks for it, in two segments; made anew when
    the table's files are others."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_size").alias("s")).distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64("f", "t", "s") % (1 << 40))).first()
    key = (spark.sparkContext.applicationId, sf_dir, embedded, *state)
    if key not in _indexes:
        rows = records(spark, sf_dir)
        rows = rows.withColumn("embedding", V.embed(F.col("content"))) if embedded else rows
        index = SearchIndex(spark, W.fresh(spark, "search-index"))
        index.add(rows.filter("id % 3 <> 0"))
        index.add(rows.filter("id % 3 = 0"))
        _indexes[key] = index
    return _indexes[key]


@query(ORACLES["q_hybrid_search"])
def q_indexed_search(spark, sf_dir):
    """The hybrid search, from the stored index."""
    return stored_index(spark, sf_dir).search(S.SearchOptions(query=_QUERY, wing="en", limit=20, room_cap=2), exact=True)


@query(f"""WITH {_bm25_sql("lang = 'en'")}, s AS (SELECT doc_id, source, bm25 / (bm25 + 1) AS lexical, 0.3 + 0.4 * bm25 / (bm25 + 1) AS score FROM sc),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s),
o AS (SELECT r.*, CASE WHEN rank <= 10 THEN -strlen(text) END AS late FROM r JOIN documents USING (doc_id) WHERE rank <= 25)
SELECT doc_id AS id, 'en' AS wing, source AS room, 0.5 AS semantic, lexical, lexical AS lexical_exact, 0.0 AS lexical_morph, score, CAST(row_number() OVER (ORDER BY CASE WHEN rank > 10 THEN 1 ELSE 0 END, late DESC NULLS LAST, rank) AS INTEGER) AS rank FROM o""")
def q_rerank_search(spark, sf_dir):
    """A search whose first ten hits a second scorer orders anew, the shorter text first."""
    shorter = -F.octet_length("content")
    return S.search(records(spark, sf_dir), S.SearchOptions(query=_QUERY, wing="en", limit=25, rerank=shorter, rerank_depth=10))


@query("SELECT vec_id AS id, (1 + list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1))) / 2 AS semantic FROM embeddings WHERE (1 + list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1))) / 2 > 0.56")
def q_semantic_gate(spark, sf_dir):
    """Vectors that the gate admits for one probe."""
    e = table(spark, sf_dir, "embeddings")
    probe = e.filter("vec_id = 1").select(F.col("embedding").alias("probe")).limit(1)
    sem = V.semantic(V.cosine(F.col("embedding"), F.col("probe")))
    return e.crossJoin(F.broadcast(probe)).select(F.col("vec_id").alias("id"), sem.alias("semantic")).filter(S.admitted(F.lit(0.0), F.lit(0.0), F.col("semantic"), V.GATE))


_KNN = """k AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
FROM embeddings q JOIN embeddings c ON q.vec_id < 10 AND q.vec_id <> c.vec_id)"""


def _nearest(spark, sf_dir):
    """Scores of ten stated queries against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    rows = e.join(F.broadcast(q), F.col("query_id") != F.col("vec_id"))  # ten stated rows
    return rows.select("query_id", F.col("vec_id").alias("id"), "label", V.cosine(F.col("probe"), F.col("embedding")).alias("score"))


#: Ranked neighbours, by similarity to twelve places, of every row whose id is divisible by 20.
KNN20 = """k20 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, q.label AS own, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS score
FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)"""


def neighbours(spark, sf_dir, k):
    """Exact nearest rows of every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.nearest(e.filter("id % 20 = 0"), e, k)


@query(f"WITH {KNN20} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k20) WHERE rank <= 5")
def q_knn(spark, sf_dir):
    """Exact nearest vectors of every row whose id is divisible by 20."""
    return neighbours(spark, sf_dir, 5)


@query(f"""WITH {_KNN}, m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY score DESC, id) > 2 THEN 1 ELSE 0 END AS spare FROM k WHERE query_id = 0)
SELECT id, label, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY spare, score DESC, id) AS place FROM m) WHERE place <= 30""")
def q_room_cap(spark, sf_dir):
    """At most two hits of a label first, then refilled by score."""
    hits = _nearest(spark, sf_dir).filter("query_id = 0")
    return S.capped(hits, "label", "score", 2, 30).select("id", "label", "place")


@query(f"""WITH {_KNN}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rank FROM k WHERE query_id = 0)
SELECT label, CAST(row_number() OVER (ORDER BY min(rank)) AS INTEGER) AS rank FROM r GROUP BY label""")
def q_session_rank(spark, sf_dir):
    """Labels in the order in which their vectors first appear."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = _nearest(spark, sf_dir).filter("query_id = 0").withColumn("rank", F.row_number().over(w))
    return S.first_of_group(ranked, "label")


_K100 = f"{KNN20}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM k20 QUALIFY r <= 100)"


def _hundred(spark, sf_dir):
    """The hundred nearest of every row whose id is divisible by 20, with their label."""
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return neighbours(spark, sf_dir, 100).join(label, "id")


@query(f"""WITH {_K100}, m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) > 2 THEN 1 ELSE 0 END AS spare FROM h)
SELECT query_id, id, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY spare, score DESC, id) AS INTEGER) AS place FROM m QUALIFY place <= 30""")
def q_room_caps(spark, sf_dir):
    """At most two hits of a label first, then refilled by score, for every query of the set."""
    return S.capped(_hundred(spark, sf_dir), "label", "score", 2, 30, per="query_id").select("query_id", "id", "label", "place")


@query(f"""WITH {_K100} SELECT query_id, label, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS INTEGER) AS rank FROM h GROUP BY query_id, label""")
def q_session_ranks(spark, sf_dir):
    """Labels in the order in which they first appear among a hundred hits, for every query of the set."""
    return S.first_of_group(_hundred(spark, sf_dir), "label", per="query_id")


@query(f"""WITH {_KNN}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k WHERE query_id < 2)
SELECT id, sum(1.0 / (60 + rank)) AS rrf FROM r WHERE rank <= 50 GROUP BY id""")
def q_rrf(spark, sf_dir):
    """Reciprocal-rank fusion of two rankings."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    r = _nearest(spark, sf_dir).filter("query_id < 2").withColumn("rank", F.row_number().over(w)).filter("rank <= 50")
    return S.reciprocal_rank(r.filter("query_id = 0").select("id", "rank"), r.filter("query_id = 1").select("id", "rank"))


@query(f"""WITH {_KNN}, r AS (SELECT k.id, k.label, row_number() OVER (ORDER BY score DESC, k.id) AS rank, embedding[1]::DOUBLE AS late FROM k JOIN embeddings e ON e.vec_id = k.id WHERE query_id = 0)
SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN rank > 20 THEN 1 ELSE 0 END, CASE WHEN rank <= 20 THEN late END DESC NULLS LAST, rank) AS INTEGER) AS place FROM r WHERE rank <= 60""")
def q_late_rescore(spark, sf_dir):
    """The head of a ranking in the order of a second score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    r = _nearest(spark, sf_dir).filter("query_id = 0").withColumn("rank", F.row_number().over(w)).filter("rank <= 60")
    r = r.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("first")), "id")
    return S.rescored(r, F.col("first"), 20).select("id", "place")


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE / (list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) / 127)) AS INTEGER)) AS codes FROM embeddings")
def q_quantize(spark, sf_dir):
    """int8 codes of vectors."""
    return table(spark, sf_dir, "embeddings").select("vec_id", V.quantize(F.col("embedding"))["codes"].alias("codes"))


def _matrices(spark, sf_dir):
    """Token matrices of ten rows each."""
    m = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 10").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
    return m.select("doc", F.transform("r", lambda x: x["embedding"]).alias("rows"))


@query("""WITH t AS (SELECT vec_id // 10 AS doc, list(embedding::DOUBLE[] ORDER BY vec_id) AS rows FROM embeddings GROUP BY doc)
SELECT a.doc AS q, b.doc AS d, list_sum(list_transform(a.rows, lambda x: list_max(list_transform(b.rows, lambda y: list_inner_product(x, y))))) AS score FROM t a JOIN t b ON a.doc % 20 = 0""")
def q_maxsim(spark, sf_dir):
    """Late-interaction scores of every twentieth token matrix with all, in pages."""
    m = _matrices(spark, sf_dir).withColumnRenamed("doc", "id")
    return L.scored(m.filter("id % 20 = 0"), m).select(F.col("query_id").alias("q"), F.col("id").alias("d"), "score")


@query("SELECT label, d + 1 AS dim, avg(embedding[d + 1]::DOUBLE) AS mean FROM embeddings, range(64) r(d) GROUP BY label, d")
def q_centroids(spark, sf_dir):
    """Mean vector of each label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    return e.groupBy("label", (F.col("d") + 1).alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("mean"))


SAMPLE = 4096


def _sample(spark, sf_dir, n=SAMPLE):
    """A bounded training sample: the vectors of the least hashes, ordered by id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toPandas().sort_values("vec_id")
    return np.stack(rows["embedding"].to_numpy()).astype(float) if len(rows) else np.zeros((1, 8))


@query()
def q_pq_search(spark, sf_dir):
    """Product-quantised search by every row whose id is divisible by 20: all codes, in pages, looked up in each query's
    tables; the pool reranked exactly."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, W.fresh(spark, "vector-codes"))
    index.build(e, 1)
    return index.search(e.filter("id % 20 = 0"), 10)


@query()
def q_pq_report(spark, sf_dir):
    """How well the codebook fits the rows of its sample and all others; a ratio above 1.5 flags an unfit sample."""
    pq, e = V.ProductQuantizer(_sample(spark, sf_dir)), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    chosen = e.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).withColumn("inside", F.lit(True))

    def errors(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"inside": pdf["inside"], "error": [pq.error(np.asarray(v, float)[None]) for v in pdf["embedding"]]})

    rows = e.join(F.broadcast(chosen), "vec_id", "left").select(F.coalesce("inside", F.lit(False)).alias("inside"), "embedding").mapInPandas(errors, "inside boolean, error double")  # the sample is bounded
    means = rows.agg(F.avg(F.when(F.col("inside"), F.col("error"))).alias("sample_error"), F.avg(F.when(~F.col("inside"), F.col("error"))).alias("probe_error"))
    return means.withColumn("unfit", F.coalesce(F.col("probe_error") / F.col("sample_error") > 1.5, F.lit(False)))


@query()
def q_ivf_probe(spark, sf_dir):
    """Inverted lists: queries go to as many of the nearest lists as were measured, and on while those hold too few, and
    score all rows there."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, W.fresh(spark, "vector-lists"))
    index.build(e)
    return index.search(e.filter("id % 20 = 0"), 5, pool=None)


@query()
def q_stored_vectors(spark, sf_dir):
    """A stored index of two thirds of the vectors, the rest added, which makes it fit itself anew; then opened again and
    searched by every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, W.fresh(spark, "vector-index"))
    index.build(e.filter("id % 3 = 0"))
    index.add(e.filter("id % 3 <> 0"))
    return VectorIndex(spark, index.path).search(e.filter("id % 20 = 0"), 10)


def _labelled_index(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("scope"))
    index = VectorIndex(spark, W.fresh(spark, "scoped-vectors"))
    index.build(e)
    return index, e.filter("id % 20 = 0"), e.select("id", "scope")


@query()
def q_scoped_vectors(spark, sf_dir):
    """The nearest of its own label for every row whose id is divisible by 20."""
    index, asked, members = _labelled_index(spark, sf_dir)
    return index.search(asked, 10, members=members)


@query()
def q_excluding_vectors(spark, sf_dir):
    """The nearest of all labels but its own for every row whose id is divisible by 20."""
    index, asked, members = _labelled_index(spark, sf_dir)
    return index.search(asked, 10, members=members, without=True)


_LATE = """WITH r AS (SELECT vec_id, vec_id // 10 AS doc, embedding::DOUBLE[] AS e, list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) / 127 AS scale FROM embeddings),
x AS (SELECT doc, list_transform(e, lambda x: floor(abs(x) / scale + 0.5) * sign(x) * scale) AS e FROM r),
d AS (SELECT q.doc AS query_id, q.vec_id AS q, x.doc, max(list_inner_product(q.e, x.e)) AS best FROM x JOIN r q ON q.doc % 20 = 0 GROUP BY ALL),
s AS (SELECT query_id, doc AS id, greatest(0.0, least(1.0, (round(sum(best), 9) / count(*) + 1) / 2)) AS late FROM d GROUP BY ALL)
SELECT query_id, id, late, CAST(row_number() OVER (PARTITION BY query_id ORDER BY late DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""


@query(_LATE)
def q_late_search(spark, sf_dir):
    """Late interaction of every twentieth matrix over stored artifacts, half of them made up after the others."""
    encoder, m = V.FixedEncoder(64), _matrices(spark, sf_dir).withColumnRenamed("doc", "id")
    path = W.fresh(spark, "token-artifacts")
    L.artifacts(m.filter("id % 2 = 0"), encoder).write.parquet(path)
    L.artifacts(L.missing(m, spark.read.parquet(path)), encoder).write.mode("append").parquet(path)
    asked = m.filter("id % 20 = 0")
    found = L.nearest(asked, L.restored(spark.read.parquet(path)), 10).join(asked.select(F.col("id").alias("query_id"), F.size("rows").alias("n")), "query_id")
    return found.select("query_id", "id", V.late_score(F.col("score"), F.col("n")).alias("late"), "rank")


@query()
def q_token_search(spark, sf_dir):
    """Late interaction by codes: half of the matrices indexed, half added, the index opened again and asked for every twentieth."""
    m = _matrices(spark, sf_dir).withColumnRenamed("doc", "id")
    index = L.TokenIndex(spark, W.fresh(spark, "token-index"))
    index.build(m.filter("id % 2 = 0"))
    index.add(m.filter("id % 2 <> 0"))
    return L.TokenIndex(spark, index.path).search(m.filter("id % 20 = 0"), 10)


@query()
def q_fde(spark, sf_dir):
    """Fixed-dimensional encodings of token matrices: their inner product with that of the first, beside the exact score."""
    encoder = V.FixedEncoder(64)
    first = _matrices(spark, sf_dir).orderBy("doc").limit(1).toPandas()
    q = np.stack(first["rows"][0]).astype(float) if len(first) else np.zeros((1, 64))
    code = encoder.encode(q, True)

    def score(batches):
        for pdf in batches:
            m = [np.stack(r).astype(float) for r in pdf["rows"]]
            yield pd.DataFrame({"doc": pdf["doc"], "fde": [float(code @ encoder.encode(x, False)) for x in m], "maxsim": [float((q @ x.T).max(1).sum()) for x in m]})

    return _matrices(spark, sf_dir).mapInPandas(score, "doc long, fde double, maxsim double")


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents),
f AS (SELECT doc_id, 'u:' || unnest(w) AS f FROM t
UNION ALL SELECT doc_id, 'b:' || w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)
UNION ALL SELECT doc_id, 't:' || substr(x, i, 3) FROM (SELECT doc_id, x, unnest(range(1, length(x) - 1)) AS i FROM (SELECT doc_id, unnest(w) AS x FROM t) WHERE length(x) > 3)),
h AS (SELECT doc_id, sha256(f) AS h FROM f),
s AS (SELECT doc_id, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) % 384 AS slot, abs(sum(CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END)) AS x FROM h GROUP BY ALL)
SELECT t.doc_id, CASE WHEN max(x) IS NULL THEN 0.0 ELSE 1.0 END AS norm, coalesce(min(slot) FILTER (x = m), 0) AS slot FROM t LEFT JOIN (SELECT *, max(x) OVER (PARTITION BY doc_id) AS m FROM s) s ON s.doc_id = t.doc_id GROUP BY t.doc_id""")
def q_hash_embed(spark, sf_dir):
    """Hash embeddings of documents, with their length and the slot of the largest component."""
    e = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", V.embed(F.col("text")).alias("v"))
    e = e.withColumn("a", F.transform("v", lambda x: F.abs(x)))
    return e.select("doc_id", F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 9).alias("norm"), (F.array_position("a", F.array_max("a")) - 1).alias("slot"))


@query(f"""WITH {_EMBED}, d AS (SELECT x.doc_id, lang, source, slot, x / size AS v FROM x JOIN xn USING (doc_id) JOIN documents USING (doc_id)),
c AS (SELECT n.doc_id AS id, o.doc_id AS refreshes, sum(n.v * o.v) AS score FROM d n JOIN d o ON n.doc_id % 7 = 0 AND o.doc_id % 7 <> 0 AND n.lang = o.lang AND n.source = o.source AND n.slot = o.slot GROUP BY ALL HAVING sum(n.v * o.v) >= 0.9)
SELECT id, arg_max(refreshes, (round(score, 9), -refreshes)) AS refreshes, round(max(score), 9) AS score FROM c GROUP BY id""")
def q_dedup_refresh(spark, sf_dir):
    """New texts that an existing record of their wing and room is close enough to: those refresh it instead of being added."""
    rows = records(spark, sf_dir).withColumn("embedding", V.embed(F.col("content")))
    return S.refreshing(rows.filter("id % 7 = 0"), rows.filter("id % 7 <> 0"), 0.9)


def _morph_sql(words: list[str]) -> str:
    listed = "|".join(sorted(X.SUFFIXES["en"].split(), key=lambda e: (-len(e), e)))
    stem = lambda x: f"regexp_replace({x}, '^(.{{3,}}?)(?:{listed})$', '\\1')"
    near = lambda w: f"CASE WHEN list_contains(t, '{w}') THEN 0 WHEN len(list_filter(t, lambda x: {stem('x')} = {stem(repr(w))} OR (length(x) >= 5 AND {len(w)} >= 5 AND levenshtein(x, '{w}') <= 1))) > 0 THEN 0.5 ELSE 0 END"
    return " + ".join(near(w) for w in words)


_WORDS = ["whands", "edlys"]


@query(f"""WITH m AS (SELECT doc_id, source, {_morph_sql(_WORDS)} AS morph FROM (SELECT doc_id, source, {_TOKENS} AS t FROM documents WHERE lang = 'en')),
{_bm25_sql("lang = 'en'", _WORDS)},
h AS (SELECT m.doc_id, m.source, morph, coalesce(bm25, 0) AS exact FROM m LEFT JOIN (SELECT doc_id, bm25 FROM sc) USING (doc_id) WHERE morph > 0 OR bm25 > 0)
SELECT doc_id AS id, 'en' AS wing, source AS room, 0.5 AS semantic, (exact + morph) / (exact + morph + 1) AS lexical, exact / (exact + 1) AS lexical_exact, morph / (morph + 1) AS lexical_morph, 0.3 + 0.4 * (exact + morph) / (exact + morph + 1) AS score,
CAST(row_number() OVER (ORDER BY 0.3 + 0.4 * (exact + morph) / (exact + morph + 1) DESC, doc_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 30""")
def q_search_morph(spark, sf_dir):
    """Search in a declared language: inflected and mistyped words count half."""
    return S.search(records(spark, sf_dir), S.SearchOptions(query=" ".join(_WORDS), wing="en", limit=30, language="en"))


@query(ORACLES["q_search_morph"])
def q_indexed_morph(spark, sf_dir):
    """The same from the stored index: inflected and mistyped words come from its dictionary, and no text is read."""
    return stored_index(spark, sf_dir, False).search(S.SearchOptions(query=" ".join(_WORDS), wing="en", limit=30, language="en"))


@query(f"""WITH {_bm25_sql('doc_id % 5 <> 0')}, r AS (SELECT doc_id, 0.3 + 0.4 * bm25 / (bm25 + 1) AS score, row_number() OVER (ORDER BY 0.3 + 0.4 * bm25 / (bm25 + 1) DESC, doc_id) AS rank FROM sc)
SELECT CAST((rank - 1) // 10 + 1 AS INTEGER) AS page, doc_id AS id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40""")
def q_pinned_pages(spark, sf_dir):
    """Four pages of one ranking: between them records are added, removed and folded together, which only later versions see."""
    rows, index = records(spark, sf_dir), SearchIndex(spark, W.fresh(spark, "paged-index"))
    index.add(rows.filter("id % 5 in (1, 2)"))
    index.add(rows.filter("id % 5 in (3, 4)"))
    pinned, pages = index.at(), []
    changes = [lambda: index.add(rows.filter("id % 5 = 0")), lambda: index.remove(rows.filter("id % 2 = 0")), index.compact, lambda: None]
    for page, change in enumerate(changes):
        hits = pinned.search(S.SearchOptions(query=_QUERY, limit=10, offset=10 * page))
        pages.append(hits.select(F.lit(page + 1).alias("page"), "id", "score", "rank"))
        change()
    return reduce(lambda a, b: a.unionByName(b), pages)


@query(f"""WITH {_bm25_sql('doc_id % 5 = 0 OR doc_id % 2 <> 0')}
SELECT doc_id AS id, 0.3 + 0.4 * bm25 / (bm25 + 1) AS score, CAST(row_number() OVER (ORDER BY 0.3 + 0.4 * bm25 / (bm25 + 1) DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 40""")
def q_index_versions(spark, sf_dir):
    """The latest version after records were removed, others added again, segments folded and old versions dropped."""
    rows, index = records(spark, sf_dir), SearchIndex(spark, W.fresh(spark, "versioned-index"))
    index.add(rows.filter("id % 5 <> 0"))
    index.add(rows.filter("id % 5 = 0"))
    index.remove(rows.filter("id % 2 = 0"))
    index.compact()
    index.expire(index.add(rows.filter("id % 10 = 0")))
    return index.search(S.SearchOptions(query=_QUERY, limit=40)).select("id", "score", "rank")


@query(f"""WITH {_EMBED}, c AS (SELECT doc_id, (1 + sum(x * y) / any_value(size)) / 2 AS semantic FROM x JOIN {_PROBE} USING (slot) JOIN xn USING (doc_id) GROUP BY doc_id)
SELECT doc_id AS id, lang AS wing, source AS room, semantic, 0.0 AS lexical, 0.0 AS lexical_exact, 0.0 AS lexical_morph, 0.95 * semantic AS score, CAST(row_number() OVER (ORDER BY 0.95 * semantic DESC, doc_id) AS INTEGER) AS rank
FROM c JOIN documents USING (doc_id) WHERE semantic > 0.56 QUALIFY rank <= 20""")
def q_cross_script(spark, sf_dir):
    """A query in a script that no text has: words can't meet, so the vector weighs the most it may."""
    rows = records(spark, sf_dir).withColumn("embedding", V.embed(F.col("content")))
    return S.search(rows, S.SearchOptions(query="память", vector=tuple(V.hash_embed(_QUERY).tolist()), limit=20))


@query("SELECT vec_id AS id, (1 + list_cosine_similarity(embedding::DOUBLE[], [1.0, 2.0] || list_resize([0.0], 62, 0.0))) / 2 AS score, CAST(row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], [1.0, 2.0] || list_resize([0.0], 62, 0.0)) DESC, vec_id) AS INTEGER) AS rank FROM embeddings QUALIFY rank <= 10")
def q_external_vector(spark, sf_dir):
    """Search by a vector of the caller's."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.external(rows, [1.0, 2.0] + [0.0] * 62, 10).select("id", "score", "rank")


@query(f"""WITH {_EMBED}, d AS (SELECT doc_id, slot, x / size AS v FROM x JOIN xn USING (doc_id)),
c AS (SELECT a.doc_id, sum(a.v * b.v) AS s FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 AND a.slot = b.slot GROUP BY a.doc_id),
n AS (SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT {V.semantic_floor()!r} AS floor, 0.56 AS gate, avg(CASE WHEN 0.5 + 0.5 * (coalesce(s, 0) - {V.semantic_floor()!r}) / (1 - {V.semantic_floor()!r}) > 0.56 THEN 1.0 ELSE 0.0 END) AS admitted FROM n LEFT JOIN c USING (doc_id)""")
def q_calibration(spark, sf_dir):
    """The floor and gate of the hash embedder, and the share of document pairs above the gate."""
    floor = V.semantic_floor()
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", V.embed(F.col("text")).alias("v"))
    after = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("v").alias("w"))
    pairs = d.join(after, "doc_id").select(V.semantic(V.dot(F.col("v"), F.col("w")), floor).alias("s"))
    return pairs.agg(F.lit(floor).alias("floor"), F.lit(V.GATE).alias("gate"), F.avg((F.col("s") > V.GATE).cast("double")).alias("admitted"))


@query("SELECT vec_id, list_sum(list_transform(list_zip(embedding, list_transform(embedding, lambda x: round(x::DOUBLE / (list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) / 127)) * (list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) / 127))), lambda p: abs(p[1]::DOUBLE - p[2]))) / 64 < 0.005 AS close FROM embeddings")
def q_dequantize(spark, sf_dir):
    """Whether int8 codes come back close to their vectors."""
    e = table(spark, sf_dir, "embeddings").withColumn("back", V.dequantize(V.quantize(F.col("embedding"))))
    off = F.aggregate(F.zip_with("embedding", "back", lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", (off / 64 < 0.005).alias("close"))
