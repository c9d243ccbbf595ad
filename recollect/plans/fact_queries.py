"""Queries of facts and graphs: orders as dated states of customers, lineitems as co-occurrence, nations as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.functions import hashing as H
from recollect.operators import facts as K
from recollect.operators import graphs as G
from recollect.operators import intervals as I
from recollect.plans.register import query
from recollect.plans.search_queries import records
from recollect.sources.tables import table


def facts(spark, sf_dir):
    """(customer, status, order status) from each order's day until the customer's next order."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), F.lit(1.0).alias("confidence"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"), "o_orderpriority", "o_totalprice",
    )
    return K.superseded(o, ["subject", "predicate"], ["valid_from", "id"])


_FACTS = """f AS (SELECT o_orderkey AS id, 'customer-' || o_custkey AS subject, 'status' AS predicate, o_orderstatus AS object, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
lead(strftime(o_orderdate, '%Y-%m-%d')) OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS valid_to, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS extracted_at, o_orderpriority, o_totalprice FROM orders)"""


@query(f"WITH {_FACTS} SELECT id, subject, object, valid_from, valid_to FROM f")
def q_supersede(spark, sf_dir):
    """Successive states: each ends where the next begins."""
    return facts(spark, sf_dir).select("id", "subject", "object", "valid_from", "valid_to")


@query(f"WITH {_FACTS} SELECT id, subject, object FROM f WHERE valid_from <= '1996-06-30' AND (valid_to IS NULL OR valid_to > '1996-06-30')")
def q_as_of(spark, sf_dir):
    """Facts of one predicate valid on a day."""
    return K.related(facts(spark, sf_dir), "status", "1996-06-30").select("id", "subject", "object")


@query(f"WITH {_FACTS} SELECT id, subject, object FROM f WHERE (subject = 'customer-7' OR object = 'customer-7') AND valid_to IS NULL")
def q_entity_facts(spark, sf_dir):
    """Open facts of one entity, in either direction."""
    return K.about(facts(spark, sf_dir), "customer-7").select("id", "subject", "object")


@query(f"WITH {_FACTS} SELECT id, subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY coalesce(valid_from || 'T00:00:00Z', ''), extracted_at, id) AS INTEGER) AS place FROM f")
def q_timeline(spark, sf_dir):
    """Facts of each subject in the order of their start."""
    return K.timeline(facts(spark, sf_dir)).select("id", "subject", "place")


@query(f"WITH {_FACTS} SELECT count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS active, count(valid_to) AS closed, (SELECT count(DISTINCT n) FROM (SELECT subject AS n FROM f UNION ALL SELECT object FROM f)) AS entities FROM f")
def q_kg_stats(spark, sf_dir):
    """Counts of facts and entities."""
    return K.stats(facts(spark, sf_dir)).select("triples", "active", "closed", "entities")


@query(f"WITH {_FACTS} SELECT id, CASE WHEN valid_to IS NULL AND object = 'O' AND o_orderpriority <> '1-URGENT' THEN '1999-01-01' ELSE valid_to END AS valid_to FROM f")
def q_invalidate(spark, sf_dir):
    """Open facts closed on a day, except approved canonical ones."""
    f = facts(spark, sf_dir).withColumn("authority_class", F.when(F.col("o_orderpriority") == "1-URGENT", "canonical").otherwise("stated")).withColumn("review_state", F.lit("approved"))
    return K.invalidated(f, F.col("object") == "O", "1999-01-01").select("id", "valid_to")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS object FROM orders")
def q_kg_add(spark, sf_dir):
    """Facts added again under their id replace what was there."""
    f = facts(spark, sf_dir).select("id", "subject", "object", "extracted_at")
    return K.upserted(f, f.filter("id % 10 = 0").withColumn("object", F.lit("X"))).select("id", "object")


@query("SELECT canonical_key, arg_max(id, (extracted_at, id)) AS id, arg_max(object, (extracted_at, id)) AS object FROM (SELECT o_orderkey AS id, o_orderstatus AS object, o_custkey AS canonical_key, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS extracted_at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY canonical_key")
def q_canonical(spark, sf_dir):
    """The holder of each canonical key."""
    o = table(spark, sf_dir, "orders")
    cls = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "canonical").otherwise("stated")
    f = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("object"), F.col("o_custkey").alias("canonical_key"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted_at"), cls.alias("authority_class"), F.lit("approved").alias("review_state"), F.lit(None).cast("string").alias("valid_to"))
    return K.canonical(f)


@query("""SELECT d.doc_id AS id, CASE WHEN quality IS NULL THEN 'unreceipted' WHEN toxic = 1 THEN 'tampered' WHEN d.doc_id % 13 = 0 THEN 'dangling' WHEN d.doc_id % 5 = 0 THEN 'source-changed' ELSE 'verified' END AS verdict
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_receipts(spark, sf_dir):
    """Receipt verdicts: facts made from documents against the documents as they are now."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fp = F.when(F.col("quality").isNotNull(), H.content_fp(F.col("text")))
    f = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source_id"), fp.alias("fp"), (F.col("toxic") == 0).alias("tag_valid"))
    now = H.content_fp(F.when(F.col("id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return K.receipts(f, records(spark, sf_dir).filter("id % 13 <> 0").select("id", now.alias("fp"))).select("id", "verdict")


@query("SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderdate + INTERVAL 29 YEAR AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.s")
def q_asof_join(spark, sf_dir):
    """Each event with its user's latest order by then."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.expr("o_orderdate + INTERVAL 29 YEAR").alias("s")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return K.as_of(e, o, "k", "ts", "s").select("event_id", "o_orderkey")


@query("""WITH f AS (SELECT o_orderkey AS fact_id, o_custkey AS k, CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) END AS s, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 900 AS INTEGER) END AS e FROM orders),
l AS (SELECT l_orderkey, l_linenumber, o_custkey AS k, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, fact_id FROM l JOIN f USING (k) WHERE (s IS NULL OR s <= day) AND (e IS NULL OR e > day)""")
def q_valid_then(spark, sf_dir):
    """Every shipment beside all facts of its customer that are valid on its day; facts overlap, some begin or end open."""
    o = table(spark, sf_dir, "orders").withColumn("subject", F.col("o_custkey").cast("string"))
    day = F.to_date("o_orderdate")
    f = o.select("subject", F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderkey") % 23 != 0, F.date_format(day, "yyyy-MM-dd")).alias("valid_from"), F.when(F.col("o_orderkey") % 17 != 0, F.date_format(F.date_add(day, (30 + F.col("o_orderkey") % 900).cast("int")), "yyyy-MM-dd")).alias("valid_to"))
    shipped = table(spark, sf_dir, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "subject").hint("merge"), "l_orderkey")
    events = shipped.select("subject", "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"))
    return I.valid_then(events, f).select("l_orderkey", "l_linenumber", "fact_id")


@query("SELECT x.o_orderkey AS id, y.o_orderkey AS supersedes, CASE WHEN y.o_orderkey IS NULL THEN 'dangling' WHEN x.o_orderstatus = y.o_orderstatus THEN 'same' ELSE 'changed' END AS link FROM orders x LEFT JOIN orders y ON y.o_orderkey = x.o_orderkey - 1")
def q_supersession(spark, sf_dir):
    """Records joined to those they supersede."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    old = o.select(F.col("id").alias("supersedes"), F.col("o_orderstatus").alias("was"))
    link = F.when(F.col("supersedes").isNull(), "dangling").when(F.col("o_orderstatus") == F.col("was"), "same").otherwise("changed")
    return o.join(old, F.col("id") - 1 == F.col("supersedes"), "left").select("id", "supersedes", link.alias("link"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS id, 'p' || (l_partkey % 40) AS entity FROM lineitem)
SELECT x.entity AS entity_a, y.entity AS entity_b, count(*) AS strength FROM e x JOIN e y ON x.id = y.id AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 2""")
def q_hallways(spark, sf_dir):
    """Co-occurring entities of orders' parts."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string"))).alias("entities"))
    return G.hallways(li)


@query("""WITH r AS (SELECT doc_id AS id, lang AS wing, source AS room, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS day, ['e' || (doc_id % 9), 'f' || (doc_id % 4)] AS entities FROM documents),
b AS (SELECT wing, room, count(*) AS n, min(day) AS first_day, max(day) AS last_day, list(id ORDER BY id)[1:4] AS ids FROM r GROUP BY wing, room),
c AS (SELECT wing, room, entity, count(*) AS f FROM (SELECT wing, room, unnest(entities) AS entity FROM r) GROUP BY ALL)
SELECT b.*, (SELECT list(entity ORDER BY f DESC, entity)[1:6] FROM c WHERE c.wing = b.wing AND c.room = b.room) AS entities FROM b""")
def q_closet_index(spark, sf_dir):
    """Index card of each wing and room."""
    r = records(spark, sf_dir).select("id", "wing", "room", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")), "yyyy-MM-dd").alias("day"),
                                      F.array(F.concat(F.lit("e"), (F.col("id") % 9).cast("string")), F.concat(F.lit("f"), (F.col("id") % 4).cast("string"))).alias("entities"))
    return G.closets(r)


_EDGES = "(SELECT n_nationkey AS a, (n_nationkey * 7 + n_regionkey) % 25 AS b FROM nation)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).cast("long").alias("b"))


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), t AS (SELECT 3 AS node, 0 AS depth UNION SELECT e.b, t.depth + 1 FROM t JOIN e ON e.a = t.node WHERE t.depth < 3)
SELECT node, min(depth) AS depth FROM t GROUP BY node""")
def q_traverse(spark, sf_dir):
    """Nodes within three steps, each at its first depth."""
    return G.traversed(_edges(spark, sf_dir), spark.range(3, 4).toDF("node"), 3)


@query(f"SELECT DISTINCT wing, label FROM (SELECT b AS wing, 'x' AS label FROM {_EDGES} WHERE a = 3 UNION ALL SELECT a, 'x' FROM {_EDGES} WHERE b = 3)")
def q_follow(spark, sf_dir):
    """Neighbours of one node."""
    return G.followed(_edges(spark, sf_dir).select(F.col("a").alias("from_wing"), F.col("b").alias("to_wing"), F.lit("x").alias("label")), 3)


@query(r"""SELECT sha256(encode('conversation') || unhex('1F') || encode('ends_with') || unhex('1F') || encode(object) || unhex('1F') || encode('2024-05-01') || unhex('1F'))[1:32] AS fact_id, 'conversation' AS subject, 'ends_with' AS predicate, object, '2024-05-01' AS valid_from, min(id) AS source_id, count(*) AS seen
FROM (SELECT conv_id || '-' || turn AS id, lower(regexp_extract(text, '(\w+)\W*$', 1)) AS object FROM conversations) GROUP BY object""")
def q_refine(spark, sf_dir):
    """Facts distilled from conversation turns by a rule extractor, only where the claim stands in the text."""

    def extract(content):
        word = F.regexp_extract(content, r"(\w+)\W*$", 1)
        return F.array(F.struct(F.lit("conversation").alias("subject"), F.lit("ends_with").alias("predicate"), F.lower(word).alias("object"), word.alias("claim")))

    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.lit("2024-05-01T10:00:00Z").alias("filed_at"))
    return K.refined(c, extract).drop("confidence")


@query("SELECT lang || '-' || source AS wing, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS INTEGER) AS entry, doc_id FROM documents WHERE source LIKE 'src1%'")
def q_diary(spark, sf_dir):
    """Diary entries of agents: appended in order, read back by wing."""
    from pyspark.sql.window import Window

    r = records(spark, sf_dir).filter(F.startswith(F.col("room"), F.lit("src1")))
    entry = F.row_number().over(Window.partitionBy("wing", "room").orderBy("id")) - 1
    return r.select(F.concat_ws("-", "wing", "room").alias("wing"), entry.alias("entry"), F.col("id").alias("doc_id"))


@query(r"SELECT doc_id AS id, [strlen(substr(text, 1, strpos(text, 'of ') - 1)), 3] AS span, 'grounded' AS state FROM documents WHERE strpos(text, 'of ') > 0 UNION ALL SELECT doc_id, NULL, 'absent' FROM documents WHERE strpos(text, 'of ') = 0")
def q_support(spark, sf_dir):
    """Three-way grounding of a claim: where it stands, or that it doesn't."""
    s = records(spark, sf_dir).select("id", X.locate(F.lit("of "), F.col("content")).alias("s"))
    return s.select("id", F.when(F.col("s").isNotNull(), F.array("s.offset", "s.len")).alias("span"), F.when(F.col("s").isNotNull(), "grounded").otherwise("absent").alias("state"))


@query("SELECT least(a, b) || '-' || greatest(a, b) AS pair FROM (SELECT CAST(n_nationkey AS VARCHAR) AS a, CAST(n_regionkey AS VARCHAR) AS b FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR) FROM nation) WHERE a <> '7' AND b <> '7' GROUP BY 1")
def q_tunnels(spark, sf_dir):
    """Edges added twice are kept once; those of one wing are removed."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("from_wing"), F.col("n_regionkey").cast("string").alias("to_wing"), F.lit("x").alias("label"))
    back = n.select(F.col("to_wing").alias("from_wing"), F.col("from_wing").alias("to_wing"), "label")
    both = G.tunnelled(n, back)
    out = G.tunnelled(n, back, both.filter("from_wing = '7' or to_wing = '7'").select("id"))
    return out.select(F.concat_ws("-", F.least("from_wing", "to_wing"), F.greatest("from_wing", "to_wing")).alias("pair"))
