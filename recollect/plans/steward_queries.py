"""Queries of stewardship, record listing, set operations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import hashing as H
from recollect.functions import text as X
from recollect.operators import evaluation as E
from recollect.operators import governance as G
from recollect.operators import intervals as IV
from recollect.operators import proofs as PR
from recollect.operators import search as S
from recollect.plans.register import query
from recollect.plans.search_queries import KNN20, neighbours, records
from recollect.sources.tables import table

_R = "(SELECT doc_id AS id, lang AS wing, source AS room, text AS content FROM documents)"


@query("SELECT lang AS wing, source AS room, count(*) AS n FROM documents WHERE lang <> 'quarantine-pending' GROUP BY lang, source")
def q_taxonomy(spark, sf_dir):
    """Records per wing and room, outside the quarantine wing."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") != "quarantine-pending")
    return docs.groupBy(F.col("lang").alias("wing"), F.col("source").alias("room")).agg(F.count("*").alias("n"))


@query(f"SELECT room, count(*) AS n FROM {_R} WHERE wing = 'en' GROUP BY room")
def q_rooms(spark, sf_dir):
    """Rooms of one wing."""
    return S.in_scope(records(spark, sf_dir), wing="en").groupBy("room").agg(F.count("*").alias("n"))


@query(f"SELECT wing, list({{'room': room, 'n': n}} ORDER BY room) AS rooms FROM (SELECT wing, room, count(*) AS n FROM {_R} GROUP BY ALL) GROUP BY wing")
def q_taxonomy_nested(spark, sf_dir):
    """Wings with their rooms and counts."""
    n = records(spark, sf_dir).groupBy("wing", "room").agg(F.count("*").alias("n"))
    return n.groupBy("wing").agg(F.array_sort(F.collect_list(F.struct("room", "n"))).alias("rooms"))


@query(f"SELECT count(*) AS records, count(DISTINCT wing) AS wings, count(DISTINCT (wing, room)) AS rooms FROM {_R}")
def q_totals(spark, sf_dir):
    """Totals outside quarantine."""
    return G.record_totals(records(spark, sf_dir))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def q_recent(spark, sf_dir):
    """The newest rows."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id")


@query(f"SELECT id, substr(content, 1, 120) AS preview FROM {_R} WHERE wing = 'en' ORDER BY id LIMIT 20 OFFSET 40")
def q_list_page(spark, sf_dir):
    """A page of records with previews."""
    return S.in_scope(records(spark, sf_dir), wing="en").orderBy("id").offset(40).limit(20).select("id", F.substring("content", 1, 120).alias("preview"))


@query(f"SELECT * FROM {_R} WHERE id = 42")
def q_point_get(spark, sf_dir):
    """One record by id; the filter reaches the scan."""
    return records(spark, sf_dir).filter("id = 42")


_T = "(VALUES ('src0', 'quarantined'), ('src1', 'trusted'), ('src2', 'trusted')) t(wing, trust)"


def _by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("wing"), F.col("lang").alias("room"))
    return d, spark.createDataFrame([("src0", "quarantined"), ("src1", "trusted"), ("src2", "trusted")], "wing string, trust string")


@query(f"SELECT 'standard' AS floor, d.doc_id AS id FROM documents d LEFT JOIN {_T} ON t.wing = source WHERE coalesce(trust, 'standard') <> 'quarantined' UNION ALL SELECT 'trusted', d.doc_id FROM documents d JOIN {_T} ON t.wing = source WHERE trust = 'trusted'")
def q_trust_floor(spark, sf_dir):
    """Records at or above two trust floors."""
    d, t = _by_source(spark, sf_dir)
    at = lambda floor: S.above_floor(d, t, floor).select(F.lit(floor).alias("floor"), "id")
    return at("standard").unionByName(at("trusted"))


@query(f"SELECT count(*) FILTER (quality IS NULL) AS unlabelled, (SELECT count(*) FROM {_T} WHERE trust = 'quarantined') AS wings_below FROM documents LEFT JOIN labels USING (doc_id)")
def q_exclusion_counts(spark, sf_dir):
    """What a scope leaves out, counted: rows without a label, wings below the floor."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    _, t = _by_source(spark, sf_dir)
    return d.agg(F.count_if(F.col("quality").isNull()).alias("unlabelled")).crossJoin(t.agg(F.count_if(S.trust_rank(F.col("trust")) < 1).alias("wings_below")))  # one row each


@query("SELECT event_id FROM (SELECT event_id, event_type || '/' || user_id AS record_id FROM events) WHERE (record_id = '7' OR record_id LIKE '%/7' OR record_id LIKE '7/%') AND record_id NOT LIKE 'error%'")
def q_history(spark, sf_dir):
    """Audit rows of one subject, outside a fenced name space."""
    a = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "event_type", "user_id").alias("record_id"))
    return G.history(a, "7", ["error"]).select("event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def q_json_path(spark, sf_dir):
    """Rows by a JSON path."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k > 50")


@query("SELECT DISTINCT source AS wing FROM documents WHERE source LIKE 'src1%'")
def q_prefix_distinct(spark, sf_dir):
    """Wings by a prefix."""
    return table(spark, sf_dir, "documents").filter(F.startswith("source", F.lit("src1"))).select(F.col("source").alias("wing")).distinct()


@query("SELECT sha256(text) AS fp, count(*) AS n, min(doc_id) AS keeps FROM documents GROUP BY text HAVING count(*) > 1")
def q_dedup_groups(spark, sf_dir):
    """Groups of equal texts."""
    return G.duplicate_groups(records(spark, sf_dir).withColumn("fp", H.content_fp(F.col("content"))))


_OCC = """o AS (SELECT doc_id, sha256(text) AS fp, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 4 AS INTEGER), '%Y-%m-%d') END AS content_date, strftime(TIMESTAMP '2024-06-01' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%SZ') AS filed_at FROM documents)"""


@query(f"""WITH {_OCC}, u AS (SELECT fp, content_date, min(filed_at) AS filed_at FROM o GROUP BY ALL)
SELECT g.id, g.n, (SELECT list({{'content_date': content_date, 'filed_at': filed_at}} ORDER BY coalesce(content_date, '')) FROM u WHERE u.fp = g.fp) AS occurrences FROM (SELECT fp, min(doc_id) AS id, count(*) AS n FROM o GROUP BY fp) g""")
def q_occurrences(spark, sf_dir):
    """Survivors of deduplication with the occurrences they absorb."""
    r = records(spark, sf_dir)
    day = F.when(F.col("id") % 3 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")), "yyyy-MM-dd"))
    filed = F.date_format(F.timestamp_seconds(F.lit(1717200000) + F.col("id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    r = r.select("id", H.content_fp(F.col("content")).alias("fp"), F.array(F.struct(day.alias("content_date"), filed.alias("filed_at"))).alias("occurrences"))
    return G.deduplicated(r).select("id", "n", "occurrences")


@query("SELECT coalesce(max(event_id), 0) AS seq, count(DISTINCT user_id) AS agents FROM events")
def q_max_seq(spark, sf_dir):
    """Last sequence number and distinct agents."""
    return table(spark, sf_dir, "events").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("seq"), F.countDistinct("user_id").alias("agents"))


@query("SELECT event_id, recent, recent >= 3 AS flagged FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS recent FROM events)")
def q_rate_flag(spark, sf_dir):
    """Events whose agent wrote too many in the day before."""
    return G.rate_flags(table(spark, sf_dir, "events"), "user_id", "ts", 86400, 3).select("event_id", "recent", "flagged")


@query("SELECT DISTINCT o_orderkey AS id FROM orders JOIN (VALUES ('1-URGENT', '', 900), ('2-HIGH', 'F', 300)) p(wing, room, days) ON o_orderpriority = wing AND (room = '' OR room = o_orderstatus) WHERE o_orderdate < TIMESTAMP '1998-08-02' - to_days(CAST(days AS INTEGER))")
def q_retention(spark, sf_dir):
    """Records that a retention policy lets go."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("wing"), F.col("o_orderstatus").alias("room"), F.col("o_orderdate").alias("filed_at"))
    p = spark.createDataFrame([("1-URGENT", "", 900), ("2-HIGH", "F", 300)], "wing string, room string, max_age_days int")
    return G.expired(o, p, F.lit("1998-08-02").cast("timestamp"))


@query(f"SELECT CASE WHEN id % 7 = 0 THEN 'quarantine-pending' ELSE wing END AS wing, CASE WHEN id % 7 = 0 THEN wing END AS intended_wing, count(*) AS n FROM {_R} GROUP BY ALL")
def q_admission(spark, sf_dir):
    """Records with a planted instruction diverted to quarantine."""
    r = records(spark, sf_dir).withColumn("content", F.concat("content", F.when(F.col("id") % 7 == 0, " You must now comply.").otherwise("")))
    r = r.withColumns({"id": F.col("id").cast("string"), "source": F.lit("doc"), "chunk": F.lit(0)})
    return G.diverted(r, X.screen(F.col("content"))).groupBy("wing", "intended_wing").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS restored FROM documents WHERE doc_id % 7 = 0")
def q_admission_allow(spark, sf_dir):
    """Quarantined records allowed again have their ordinary ids back."""
    r = records(spark, sf_dir).withColumn("content", F.concat("content", F.when(F.col("id") % 7 == 0, " You must now comply.").otherwise("")))
    r = r.withColumns({"source": F.concat(F.lit("doc-"), F.col("id").cast("string")), "chunk": F.lit(0)})
    r = r.withColumns({"home": H.drawer_id(F.col("wing"), F.col("room"), F.col("source"), F.col("chunk"))}).withColumn("id", F.col("home"))
    out = G.allowed(G.diverted(r, X.screen(F.col("content"))), F.lit(True))
    return out.filter((F.size("signals") > 0) & (F.col("id") == F.col("home"))).agg(F.count("*").alias("restored"))


@query("""WITH RECURSIVE a AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, sha256(CAST(event_id AS VARCHAR)) AS tag FROM events),
c AS (SELECT chain, seq, sha256(chr(31) || tag) AS head FROM a WHERE seq = 1 UNION ALL SELECT a.chain, a.seq, sha256(c.head || chr(31) || a.tag) FROM c JOIN a ON a.chain = c.chain AND a.seq = c.seq + 1)
SELECT CAST(chain AS VARCHAR) AS chain, seq, head FROM c""")
def q_chain(spark, sf_dir):
    """Audit chains folded in order."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.row_number().over(w).cast("long").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("tag"))
    return G.chain_heads(a)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'no tombstone' ELSE 'not attested' END AS fault FROM labels WHERE doc_id % 4 IN (1, 2)")
def q_forget_check(spark, sf_dir):
    """Attested deletions against tombstones, both ways."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return G.forget_check(lab.filter("id % 4 <> 2"), lab.filter("id % 4 <> 1"))


@query("SELECT g AS k, min(s) AS first, max(s) AS last, count(*) AS n FROM (SELECT user_id % 5 AS g, event_id AS s, event_id - row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS i FROM events) GROUP BY g, i")
def q_contiguous_runs(spark, sf_dir):
    """Runs of consecutive sequence numbers."""
    return G.islands(table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("k"), "event_id"), "k", "event_id")


_RUNS = """a AS (SELECT event_id AS seq, event_type || '/' || user_id AS record_id, sha256(CAST(value AS VARCHAR)) AS tag, strftime(ts, '%Y-%m-%d') AS day FROM events),
d AS (SELECT seq // 20 AS doc, seq % 20 AS p, record_id, tag, day FROM a WHERE seq % 20 < 6),
r AS (SELECT doc, p - CASE WHEN doc % 5 = 2 AND p > 3 THEN 1 ELSE 0 END AS place, CASE WHEN doc % 5 = 3 AND p = 0 THEN 'other' ELSE record_id END AS record_id, CASE WHEN doc % 5 = 1 AND p = 2 THEN 'forged' ELSE tag END AS tag, day FROM d WHERE NOT (doc % 5 = 2 AND p = 3))"""


@query(f"""WITH {_RUNS}, n AS (SELECT doc, count(*) AS n FROM r GROUP BY doc),
s AS (SELECT r.doc, a.seq - r.place AS start, count(*) AS agree, bool_or(place = 0) AS first FROM r JOIN a USING (record_id, tag, day) GROUP BY ALL),
m AS (SELECT doc, min(start) FILTER (agree = n) AS start, bool_or(first) AS first FROM s JOIN n USING (doc) GROUP BY doc)
SELECT doc, n, start, CASE WHEN start IS NOT NULL THEN NULL WHEN coalesce(first, false) THEN 'not contiguous' ELSE 'no such record' END AS fault,
CASE WHEN start IS NOT NULL THEN (SELECT count(*) FROM events e WHERE e.event_id % 500 = 0 AND e.event_id >= start + n) END AS later FROM n LEFT JOIN m USING (doc)""")
def q_run_match(spark, sf_dir):
    """Attested runs of every twentieth stretch of the audit matched with it; some have a forged, a missing or a strange record."""
    e = table(spark, sf_dir, "events")
    audit = e.select(F.col("event_id").alias("seq"), F.concat_ws("/", "event_type", "user_id").alias("record_id"), F.sha2(F.col("value").cast("string"), 256).alias("tag"), F.date_format("ts", "yyyy-MM-dd").alias("at"))
    doc, p = F.expr("seq div 20"), F.col("seq") % 20
    cut = (doc % 5 == 2) & (p > 3)
    r = audit.filter((p < 6) & ~((doc % 5 == 2) & (p == 3))).select(
        doc.alias("doc"), (p - F.when(cut, 1).otherwise(0)).alias("place"), F.when((doc % 5 == 3) & (p == 0), "other").otherwise(F.col("record_id")).alias("record_id"), F.when((doc % 5 == 1) & (p == 2), "forged").otherwise(F.col("tag")).alias("tag"), "at"
    )
    return IV.marks_after(IV.matched_runs(r, audit, ["record_id", "tag", "at"]), e.filter("event_id % 500 = 0").select(F.col("event_id").alias("seq")))


@query("""WITH a AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id, sha256(CAST(event_id AS VARCHAR)) AS tag FROM events),
c AS (SELECT chain, list(tag ORDER BY seq) AS tags, list(event_id ORDER BY seq) AS ids FROM a GROUP BY chain),
p AS (SELECT chain, ids, list_reduce([''] || tags[1:2], lambda h, t: sha256(h || chr(31) || t)) AS was, list_reduce([''] || tags[1:6], lambda h, t: sha256(h || chr(31) || t)) AS became, tags[3:6] AS t FROM c WHERE len(tags) >= 6),
f AS (SELECT *, CASE chain % 7 WHEN 1 THEN [t[1], 'forged', t[3], t[4]] WHEN 2 THEN [t[1], t[2], t[4]] WHEN 3 THEN [t[1], t[3], t[2], t[4]] ELSE t END AS shown FROM p)
SELECT chain AS proof, CASE WHEN chain % 7 = 5 THEN 'not named' WHEN chain % 7 = 2 THEN 'no tombstone' WHEN list_reduce([was] || shown, lambda h, t: sha256(h || chr(31) || t)) <> became THEN 'heads do not chain'
WHEN chain % 7 = 4 THEN 'not in the chain' WHEN chain % 7 = 6 THEN 'still there' ELSE 'verified' END AS verdict FROM f""")
def q_forget_proofs(spark, sf_dir):
    """Proofs of the third to sixth row of every chain: some forged, cut, swapped, moved to another chain, of a record not
    named, or of one that is still there."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.row_number().over(w).cast("long").alias("seq"), F.concat(F.lit("del/"), F.col("event_id").cast("string")).alias("record_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("tag"))
    heads = G.chain_heads(a)
    runs = a.groupBy("chain").agg(F.count("*").alias("n")).filter("n >= 6").select(F.col("chain").alias("proof"), "chain", F.lit(3).cast("long").alias("first"), F.lit(6).cast("long").alias("last"))
    headers, records, named = PR.proofs(a, heads, runs)
    kind, place = F.col("proof") % 7, F.col("place")
    headers = headers.withColumn("chain", F.when(kind == 4, F.concat(F.lit("x"), "chain")).otherwise(F.col("chain")))
    records = records.withColumn("tag", F.when((kind == 1) & (place == 1), "forged").otherwise(F.col("tag"))).filter(~((kind == 2) & (place == 2)))
    moved = F.when((kind == 3) & place.isin(1, 2), 3 - place).when((kind == 2) & (place == 3), 2).otherwise(place)
    first = records.filter("place = 0").select("proof", F.expr("substring(record_id, 5)").alias("id"))
    named = named.join(first.filter(F.col("proof") % 7 == 5), ["proof", "id"], "left_anti")
    live = first.filter(F.col("proof") % 7 == 6).select("id")
    return PR.verdicts(headers, records.withColumn("place", moved), named, heads, live)


@query("SELECT count(*) AS n FROM documents JOIN labels USING (doc_id)")
def q_inner_count(spark, sf_dir):
    """Rows that both tables have."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_backfill(spark, sf_dir):
    """Rows that derived data is missing for."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_hydrate(spark, sf_dir):
    """Candidate ids turned into rows."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def q_intersect(spark, sf_dir):
    """Members of both sets."""
    lab = table(spark, sf_dir, "labels")
    return lab.filter("quality = 1").select("doc_id").intersect(lab.filter("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def q_union_ids(spark, sf_dir):
    """Ids of either set, once."""
    lab = table(spark, sf_dir, "labels")
    return lab.filter("quality = 0").select("doc_id").union(lab.filter("toxic = 1").select("doc_id")).distinct()


@query("SELECT event_type AS code, CAST(count(*) AS BIGINT) AS n, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.99) AS BIGINT) + 1] AS p99, max(value) AS p100 FROM events GROUP BY event_type")
def q_score_percentiles(spark, sf_dir):
    """Counts and percentiles by class."""
    return E.floor_percentiles(table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), "value"), "code", "value")


@query(f"""WITH {KNN20}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM k20),
g AS (SELECT query_id, id FROM k20 WHERE label = own AND id % 4 = 0),
r AS (SELECT h.query_id, rank, CASE WHEN g.id IS NULL THEN 0.0 ELSE 1.0 END AS rel FROM h LEFT JOIN g USING (query_id, id) WHERE rank <= 10),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM r),
s AS (SELECT query_id, sum(rel) AS found, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(ideal + 1)) AS idcg FROM i GROUP BY query_id),
w AS (SELECT query_id, count(*) AS wanted FROM g GROUP BY query_id)
SELECT query_id, coalesce(found, 0) > 0 AS "any", coalesce(found, 0) = wanted AS "all", CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM w LEFT JOIN s USING (query_id)""")
def q_retrieval_metrics(spark, sf_dir):
    """Recall and NDCG of nearest-vector rankings against labels, for every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    own = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # gold are the rows of the query's label whose id is divisible by 4, itself left out: counted by label, not listed for each query
    sizes = e.filter("vec_id % 4 = 0").groupBy("label").agg(F.count("*").alias("n"))
    wanted = own.join(sizes, "label").select("query_id", (F.col("n") - (F.col("query_id") % 4 == 0).cast("int")).alias("wanted")).filter("wanted > 0")
    hits = neighbours(spark, sf_dir, 10).select("query_id", "id", "rank").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("theirs")), "id").join(own, "query_id")
    rel = ((F.col("theirs") == F.col("label")) & (F.col("id") % 4 == 0)).cast("double")
    return E.graded(hits.select("query_id", "rank", F.coalesce(rel, F.lit(0.0)).alias("rel")), wanted)


_SPANS = "(SELECT o_custkey AS k, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS s, CAST(epoch(o_orderdate) // 86400 + 40 AS BIGINT) AS e, o_orderkey FROM orders)"


def _spans(spark, sf_dir):
    # the nearest day, of two the even one: so the SQL's cast has it, also of a time of day and before 1970
    s = F.rint(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6) / 86400).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), s.alias("s"), (s + 40).alias("e"), "o_orderkey", "o_totalprice")


@query(f"""WITH m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS n FROM {_SPANS}),
g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, i""")
def q_merge_spans(spark, sf_dir):
    """Overlapping spans merged."""
    return E.merged_spans(_spans(spark, sf_dir).select("k", "s", "e"), "k")


def _span_hits(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _spans(spark, sf_dir).select(F.col("k").alias("query_id"), rank.alias("rank"), F.lit("r").alias("room"), "s", "e")


_RANKED = "h AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS s FROM orders)"


@query(f"""WITH RECURSIVE {_RANKED},
f AS (SELECT k, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS taken, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS spent FROM h WHERE rank = 1
UNION ALL SELECT k, rank, CASE WHEN adds > 0 AND spent + adds <= 200 THEN list_append(taken, s) ELSE taken END, CASE WHEN adds > 0 AND spent + adds <= 200 THEN adds ELSE 0 END, spent + CASE WHEN adds > 0 AND spent + adds <= 200 THEN adds ELSE 0 END
FROM (SELECT f.k, h.rank, f.taken, f.spent, h.s, CAST(len(list_filter(range(h.s, h.s + 40), lambda x: len(list_filter(f.taken, lambda t: t <= x AND x < t + 40)) = 0)) AS BIGINT) AS adds FROM f JOIN h ON h.k = f.k AND h.rank = f.rank + 1))
SELECT k AS query_id, CAST(rank AS INTEGER) AS rank, added, spent FROM f WHERE added > 0""")
def q_budget_select(spark, sf_dir):
    """Hits taken while what they add fits a budget."""
    return E.selected(_span_hits(spark, sf_dir), 200)


@query(f"""WITH {_RANKED}, w AS (SELECT k, unnest(range(m, m + 30)) AS x FROM (SELECT k, min(s) AS m FROM h GROUP BY k)),
c AS (SELECT w.k, x, min(rank) AS r FROM w JOIN h ON h.k = w.k AND h.s <= x AND x < h.s + 40 GROUP BY ALL)
SELECT k AS query_id, max(r) AS rank, CAST(CASE WHEN max(r) <= 10 THEN 10 WHEN max(r) <= 20 THEN 20 WHEN max(r) <= 40 THEN 40 WHEN max(r) <= 80 THEN 80 WHEN max(r) <= 160 THEN 160 END AS BIGINT) AS bucket FROM c GROUP BY k""")
def q_covering_rank(spark, sf_dir):
    """Rank by which all wanted spans are covered."""
    h = _span_hits(spark, sf_dir)
    wanted = h.groupBy("query_id", "room").agg(F.min("s").alias("s"), (F.min("s") + 30).alias("e"))
    return E.covering_rank(h, wanted)


@query(r"""WITH RECURSIVE t AS (SELECT item_id % 5 AS g, item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM benchmark),
s AS (SELECT a.g, a.item_id AS x, b.item_id AS y, 2.0 * list_sum(list_transform(list_distinct(a.w), lambda v: least(len(list_filter(a.w, lambda u: u = v)), len(list_filter(b.w, lambda u: u = v))))) / (len(a.w) + len(b.w)) AS f1 FROM t a JOIN t b USING (g)),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, x, y) AS i FROM s WHERE f1 >= 0.3),
r AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used_x, CAST([] AS BIGINT[]) AS used_y, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y, CAST(NULL AS DOUBLE) AS f1 FROM o WHERE i = 1
UNION ALL SELECT r.g, o.i, CASE WHEN list_contains(used_x, o.x) OR list_contains(used_y, o.y) THEN used_x ELSE list_append(used_x, o.x) END, CASE WHEN list_contains(used_x, o.x) OR list_contains(used_y, o.y) THEN used_y ELSE list_append(used_y, o.y) END,
CASE WHEN list_contains(used_x, o.x) OR list_contains(used_y, o.y) THEN NULL ELSE o.x END, o.y, o.f1 FROM r JOIN o ON o.g = r.g AND o.i = r.i + 1)
SELECT g AS "group", x AS p, y AS g, f1 FROM r WHERE x IS NOT NULL""")
def q_greedy_align(spark, sf_dir):
    """Predicted texts matched to gold ones, one to one."""
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("group"), "item_id", X.f1_tokens(F.col("text")).alias("t"))
    p = b.select("group", F.col("item_id").alias("p"), F.col("t").alias("p_tokens"))
    return E.aligned(p, b.select("group", F.col("item_id").alias("g"), F.col("t").alias("g_tokens")), 0.3)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def q_first_holder(spark, sf_dir):
    """The latest holder of each key."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT arg_min(vec_id, h) AS vec_id, block FROM (SELECT vec_id, vec_id // 50 AS block, md5(CAST(vec_id AS VARCHAR)) AS h FROM embeddings) GROUP BY block")
def q_stratified_sample(spark, sf_dir):
    """One row of each block, by least hash."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 50").alias("block"), F.md5(F.col("vec_id").cast("string")).alias("h"))
    return e.groupBy("block").agg(F.min_by("vec_id", "h").alias("vec_id")).select("vec_id", "block")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 3")
def q_capped_sample(spark, sf_dir):
    """At most three rows of each source, by least hash."""
    w = Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query("SELECT s_suppkey, n FROM (SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey) ORDER BY n, s_suppkey LIMIT 1")
def q_placement(spark, sf_dir):
    """The least loaded instance."""
    load = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(load, "s_suppkey", "left").fillna({"n": 0}).orderBy("n", "s_suppkey").limit(1)


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i FROM conversations")
def q_append_index(spark, sf_dir):
    """Running index of appended rows."""
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", i.alias("i"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE sha256(text) END AS content FROM documents WHERE doc_id % 17 <> 0")
def q_update_delete(spark, sf_dir):
    """Records after an update of some and the removal of others."""
    r = records(spark, sf_dir).select("id", H.content_fp(F.col("content")).alias("content"))
    out = G.updated(r, r.filter("id % 10 = 0").select("id", F.lit("changed").alias("content")))
    return out.join(r.filter("id % 17 = 0").select("id"), "id", "left_anti")


@query("SELECT CAST(user_id AS VARCHAR) AS chain, count(*) - CASE WHEN user_id % 10 = 7 THEN 4 ELSE 0 END AS faults FROM events WHERE user_id % 10 IN (3, 7) GROUP BY user_id HAVING user_id % 10 = 3 OR count(*) >= 5")
def q_verify_chain(spark, sf_dir):
    """Chains in which a tag was altered after the fact, with how many heads no longer hold."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.row_number().over(w).cast("long").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("tag"))
    forged = a.withColumn("tag", F.when((F.col("chain") % 10 == 3) & (F.col("seq") == 1) | (F.col("chain") % 10 == 7) & (F.col("seq") == 5), "forged").otherwise(F.col("tag")))
    return G.verified(forged, G.chain_heads(a)).groupBy("chain").agg(F.count("*").alias("faults"))
