"""The training-data queries (one per operator) and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import langid
from recollect.llm.annsearch import search
from recollect.llm.decontam import contamination
from recollect.llm.divergence import source_divergence
from recollect.llm.extraction import main_text
from recollect.llm.mixing import mix_plan
from recollect.llm.neardup import near_duplicates
from recollect.llm.periodic import periodic_runs
from recollect.llm.quality import quality_scores
from recollect.llm.sharding import shards
from recollect.llm.suffixes import repeated_spans
from recollect.llm.tokencount import token_counts
from recollect.llm.urlrules import judge
from recollect.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


#: The shard limit of op1: small enough that the smallest tables split as well.
SHARD_BYTES = 1 << 20


@_query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, each of at most SHARD_BYTES bytes of text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards(docs, SHARD_BYTES).select("doc_id", "shard_id", "depth", "shard_docs", "shard_bytes")


ORACLES["op1_sharding"] = """
WITH d AS (SELECT doc_id, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:15] AS BIGINT) AS h, coalesce(strlen(text), 0) AS b FROM documents),
p AS (SELECT doc_id, h, b, depth, h >> (60 - depth) AS prefix FROM d, range(0, 61) r(depth)),
s AS (SELECT depth, prefix, sum(b) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL HAVING sum(b) <= 1048576 OR min(h) = max(h)),
f AS (SELECT doc_id, min(p.depth) AS depth FROM p JOIN s USING (depth, prefix) GROUP BY doc_id)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard_id,
       CAST(depth AS INTEGER) AS depth, shard_docs, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM f JOIN p USING (doc_id, depth) JOIN s USING (depth, prefix)
"""


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 10-word windows of the benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS own
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(own, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document and whether it is the one that stays."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op9_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 2) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.u = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned without the labels of held-out documents."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned without the held-out documents."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of 50 words and more that documents share with others."""
    return repeated_spans(table(spark, sf_dir, "documents"))


ORACLES["op5_repeated_passages"] = r"""
WITH d AS (
  SELECT doc_id, hash(text) AS h, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
g AS (SELECT doc_id, h, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS g FROM (SELECT doc_id, h, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT (doc_id, h)) > 1),
m AS (SELECT doc_id, h, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, h ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g SEMI JOIN r USING (g)),
s AS (SELECT doc_id, h, i, sum(fresh) OVER (PARTITION BY doc_id, h ORDER BY i) AS span FROM m)
SELECT doc_id, min(i) AS start_word, max(i) + 50 - min(i) AS n_words FROM s GROUP BY doc_id, h, span
"""


@_query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vec_id."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


@_query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the listed rules and, where none fits, by rules mined from the labels."""
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and (quality is not null or toxic is not null)")
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    labelled = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op6_url_filter"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
t AS (
  SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN list_sort(list_distinct(list_concat(
    ['s:' || regexp_extract(url, '(?s)^(.*?)://', 1)],
    list_transform(list_filter(string_split(host, '.'), lambda s: s <> ''), lambda s: 'h:' || s),
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: 'p:' || regexp_replace(s, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: 'q:' || string_split(s, '=')[1]),
    CASE WHEN contains(url, '#') THEN ['f:'] ELSE [] END))) ELSE [] END AS items
  FROM p),
l AS (
  SELECT doc_id, max(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
e AS (SELECT page_id, items, bad FROM t JOIN l ON doc_id = page_id WHERE len(items) > 0),
least AS (SELECT greatest(5, ceil(0.005 * count(*))) AS k FROM e),
sub AS (
  SELECT page_id, items, 0 AS i, CAST([] AS VARCHAR[]) AS s FROM e WHERE bad
  UNION ALL
  SELECT page_id, items, i + 1, x FROM (SELECT page_id, items, i, unnest([s, list_append(s, items[i + 1])]) AS x FROM sub WHERE i < len(items))),
f AS (SELECT s, count(*) AS n FROM sub WHERE i = len(items) AND len(s) > 0 GROUP BY s HAVING count(*) >= (SELECT k FROM least)),
rules AS (SELECT s FROM f JOIN e ON list_has_all(e.items, f.s) GROUP BY s, n HAVING n / count(*) >= 0.6),
hit AS (SELECT DISTINCT page_id FROM t JOIN rules ON list_has_all(t.items, rules.s)),
listed(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('block', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN listed ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN hit.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fits USING (page_id) LEFT JOIN hit USING (page_id)
"""


@_query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of every source differ from those of each other source and of their language."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS all_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n.n, 0) AS n, coalesce(v.v, 0) AS v, coalesce(all_n, 0) AS all_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
         1 + CAST((1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v) AS BIGINT) AS p, 1 + CAST((1000000000::HUGEINT * (kept.c + 2)) // (g.all_n + 2 * g.v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents; in those whose crc32 of the id ends in 0, the words from one place on repeat the first few from there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("long")
        moved = F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x))
        return F.when(n > 0, F.array_join(moved, " "))

    # an array of one element binds the words to a name, so that they are found once a text
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    new = F.transform(F.array(words), planted)[0]
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(new, "text")).otherwise(F.col("text")))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of repeated words in every document, and digests of them and of the text without the repeats."""
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLES["op12_periodic_runs"] = r"""
WITH h AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || CAST([ord(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')] AS BIGINT[]),
           lambda crc, b: list_reduce([xor(crc, b)] || CAST(range(8) AS BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) AS h
  FROM documents),
g AS (SELECT row, doc_id, w, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM h),
p AS (SELECT row, doc_id, w, planted, a, 1 + (len(w) - a) // k AS p FROM g),
d AS (SELECT row, doc_id, unnest(w) AS x, unnest(range(len(w))) AS i, planted, a, p, w FROM p),
words AS (SELECT row, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % p + 1] ELSE x END AS x FROM d),
agree AS (SELECT a.row, a.i, b.i - a.i AS q FROM words a JOIN words b ON a.row = b.row AND a.x = b.x AND a.i < b.i),
island AS (SELECT row, q, min(i) AS b, count(*) AS m FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM agree) GROUP BY row, q, k HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT row, b AS start, m + q AS length, min(q) AS period FROM island GROUP BY ALL),
dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
texts AS (SELECT row, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (row, i) GROUP BY row),
digest AS (SELECT row, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row),
best AS (SELECT row, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY length DESC, start, period) = 1)
SELECT doc_id, coalesce(n, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM h LEFT JOIN digest USING (row) LEFT JOIN best USING (row) LEFT JOIN texts USING (row)
"""


@_query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 512).select("doc_id", "n_bytes", "n_tokens", "over_limit")
