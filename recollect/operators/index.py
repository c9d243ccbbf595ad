"""A stored search index: postings, a dictionary for approximate words, record lengths and scripts, and int8 codes of
embeddings, in segments below a folder, under versions that searches can be pinned to.

A segment is written once for each batch of records. Its postings are dealt into buckets by their term's hash, the more
the larger the segment is, and written in order of bucket, term and record by ranges, so a term that many records hold
fills several files and a query reads the row groups of its terms only. The dictionary posts every word of five letters
and more under the hashes of itself and of its one-letter deletions: words one edit from a query's share a key with it,
and are confirmed by their distance. Words of a stem are the stem with each suffix of the language, which are looked up
like the query's own.

``add``, ``remove`` and ``compact`` write their files first and then a manifest, the log of segments and removals, under
the next version's number; of two writers one finds the number taken and goes on from the other's manifest. A removal
holds for the segments before it in the log. ``at`` gives the index as it was, so the pages of one iteration are slices
of one ranking whatever is added or removed meanwhile; ``expire`` drops versions and files that only those had.

Scopes and trust floors are applied before anything is counted, so statistics are those of the scope, as in the scan.
The semantic channel takes its candidates from the codes (a share of the rows, ``search.pool_size``) and scores these,
and all lexical hits, by the vectors themselves; with ``exact`` it scores every row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.functions import vectors as V
from recollect.operators import search as S
from recollect.sources import work as W

BUCKET_POSTINGS, MAX_BUCKETS, SHIPPED_WORDS = 1_000_000, 4096, 100_000
#: Words of fewer letters are never taken for mistyped ones.
TYPO_LETTERS = 5


class SearchIndex:
    """An index of records (id, wing, room, content, and kind and embedding if they have them); of one version, if given."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.version = spark, path, version

    # --- versions ---

    def versions(self) -> list[int]:
        """Numbers of the versions there are, rising."""
        return sorted(int(n.removesuffix(".json")) for n in W.names(self.spark, f"{self.path}/versions") if n.endswith(".json"))

    def at(self, version: int | None = None) -> SearchIndex:
        """The index as of a version, the latest if none is given."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        elif version and version not in known:
            raise ValueError(f"there is no version {version}")
        return SearchIndex(self.spark, self.path, version)

    def _log(self) -> list[dict]:
        """Segments and removals of this version, in the order in which they came."""
        return json.loads(W.read_text(self.spark, f"{self.path}/versions/{self.version:020d}.json")) if self.version else []

    def _commit(self, change) -> int:
        """Writes ``change`` of the latest log as the next version."""
        while True:
            last = self.at()
            if W.put_new(self.spark, f"{self.path}/versions/{last.version + 1:020d}.json", json.dumps(change(last._log()))):
                return last.version + 1

    def expire(self, before: int) -> None:
        """Drops versions below a number, and files that no version from there on has. The latest version always stays."""
        known = self.versions()
        kept = [v for v in known if v >= before] or known[-1:]
        used = {e["name"] for v in kept for e in self.at(v)._log()}
        held = {e["name"] for v in known for e in self.at(v)._log()}
        for version in set(known) - set(kept):
            W.remove(self.spark, f"{self.path}/versions/{version:020d}.json")
        for name in held - used:
            for part in ("records", "postings", "words", "removals"):
                W.remove(self.spark, self._folder(part, name))

    def _folder(self, part: str, name: str) -> str:
        return f"{self.path}/{part}/{'removal' if part == 'removals' else 'segment'}={name}"

    # --- writing ---

    def add(self, records: DataFrame) -> int:
        """Adds a segment of new records and gives the version that has it; texts are read and cut into words once."""
        staged = W.fresh(self.spark, "index-words")
        named = [c for c in ("id", "wing", "room", "kind", "embedding") if c in records.columns]
        records.select(*named, X.words(X.search_key(F.col("content"))).alias("tokens"), X.script_mask(F.col("content")).alias("mask")).write.parquet(staged)
        words = self.spark.read.parquet(staged)
        rows = words.select(*named, F.size("tokens").alias("dl"), "mask")
        if "embedding" in named:
            rows = rows.withColumn("codes", V.quantize(F.col("embedding"))["codes"].cast("array<tinyint>"))
        postings = words.select(F.explode("tokens").alias("term"), "id", F.lit(1).alias("tf"))
        size = words.agg(F.sum(F.size(F.array_distinct("tokens")))).first()[0] or 0
        entry = self._write(rows, postings, size)
        W.remove(self.spark, staged)
        return self._commit(lambda log: [*log, entry])

    def _write(self, rows: DataFrame, postings: DataFrame, size: int) -> dict:
        """A segment's files, and what the log says of it; ``postings`` (term, id, tf) are added up."""
        name = f"s{uuid.uuid4().hex}"
        buckets = min(MAX_BUCKETS, 1 << max(0, (size // BUCKET_POSTINGS).bit_length()))
        rows.write.parquet(self._folder("records", name))
        dealt = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartitionByRange("bucket", "term", "id")
        dealt = dealt.groupBy("bucket", "term", "id").agg(F.sum("tf").cast("int").alias("tf")).select("term", "id", "tf", "bucket")  # a range holds all of a term in a record
        dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(self._folder("postings", name))
        terms = self.spark.read.schema(dealt.schema).parquet(self._folder("postings", name)).select("term").filter(F.char_length("term") >= TYPO_LETTERS).distinct()
        keys = terms.select(F.explode(X.edit_keys(F.col("term"))).alias("key"), "term")
        keys = keys.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
        keys.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(self._folder("words", name))
        return {"kind": "segment", "name": name, "buckets": buckets, "id": rows.schema["id"].dataType.simpleString()}

    def remove(self, ids: DataFrame) -> int:
        """Leaves out these records (id) from now on, and gives the version that does."""
        name = f"r{uuid.uuid4().hex}"
        ids.select("id").distinct().write.parquet(self._folder("removals", name))
        return self._commit(lambda log: [*log, {"kind": "removal", "name": name}])

    def compact(self) -> int:
        """Folds the latest version's segments into one without the removed records, and gives the version that has it."""
        base = self.at()
        log, live = base._log(), base.records(True).drop("_seq")
        postings = base._read("postings").join(live.select("id", "segment"), ["id", "segment"], "left_semi").select("term", "id", "tf")
        entry = self._write(live.drop("segment"), postings, postings.count())
        return self._commit(lambda now: [entry, *now[len(log) :]])

    # --- reading ---

    def _segments(self) -> list[tuple[int, dict]]:
        return [(k, e) for k, e in enumerate(self._log()) if e["kind"] == "segment"]

    def _files(self, part: str, entries: list[dict]) -> DataFrame:
        """A part of segments or removals, with the name of each row's."""
        names = [self._folder(part, e["name"]) for e in entries]
        reader = self.spark.read.option("basePath", f"{self.path}/{part}").option("mergeSchema", part == "records")
        if part in ("postings", "words"):  # a segment may have none
            reader = reader.schema(f"{'key bigint, term string' if part == 'words' else f'term string, id {entries[0]['id']}, tf int'}, segment string, bucket int")
        return reader.parquet(*names)

    def _read(self, part: str, hashes: list[int] | None = None) -> DataFrame:
        """Postings or words of all segments; of the buckets of these hashes only, if given."""
        entries = [e for _, e in self._segments()]
        rows = self._files(part, entries)
        if hashes is not None:
            asked = F.lit(False)
            for n in {e["buckets"] for e in entries}:
                own = [e["name"] for e in entries if e["buckets"] == n]
                asked = asked | F.col("segment").isin(own) & F.col("bucket").isin(sorted({h % n for h in hashes}))
            rows = rows.filter(asked)
        return rows.drop("bucket")

    def records(self, with_segment: bool = False) -> DataFrame:
        """What the index holds of each record."""
        if self.version is None:
            return self.at().records(with_segment)
        segments = self._segments()
        if not segments:
            return self.spark.createDataFrame([], "id long, wing string, room string, dl int, mask long, segment string, _seq int")
        seq = F.create_map(*(F.lit(x) for k, e in segments for x in (e["name"], k)))
        rows = self._files("records", [e for _, e in segments]).withColumn("_seq", seq[F.col("segment")])
        removals = [(k, e) for k, e in enumerate(self._log()) if e["kind"] == "removal"]
        if removals:
            place = F.create_map(*(F.lit(x) for k, e in removals for x in (e["name"], k)))
            gone = self._files("removals", [e for _, e in removals]).groupBy("id").agg(F.max(place[F.col("removal")]).alias("_gone"))
            rows = rows.join(gone, "id", "left").filter(F.col("_gone").isNull() | (F.col("_seq") > F.col("_gone"))).drop("_gone")
        return rows if with_segment else rows.drop("segment", "_seq")

    def _hashes(self, terms: list[str]) -> list[int]:
        return [r[0] for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t")).select(F.xxhash64("t")).collect()]  # a few words

    def _lexical(self, pool: DataFrame, terms: list[str]) -> DataFrame:
        """(id, bm25) of the pool's records that hold a term, by statistics of the pool."""
        sizes = pool.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        found = self._read("postings", self._hashes(terms)).filter(F.col("term").isin(terms))
        found = pool.select("id", "segment", "dl").join(found, ["id", "segment"])
        df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row for each query word
        if not df:
            return found.select("id", F.lit(0.0).alias("bm25")).limit(0)
        idf = F.create_map(*(x for t, n in df.items() for x in (F.lit(t), F.log(F.lit(1 + (sizes["n"] - n + 0.5) / (n + 0.5))))))
        score = idf[F.col("term")] * F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("dl") / sizes["avgdl"]))
        return found.groupBy("id").agg(F.sum(score).alias("bm25"))

    def near_words(self, terms: list[str], language: str) -> DataFrame:
        """(word, term): stored words that share a query word's stem in the language or are one edit from it."""
        stems = [(w, t) for w in terms for t in X.inflected(w, language) if t != w]
        out = self.spark.createDataFrame(stems, "word string, term string")
        long = [w for w in terms if len(w) >= TYPO_LETTERS]
        if long:
            asked = self.spark.createDataFrame([(w,) for w in long], "word string").select("word", F.explode(X.edit_keys(F.col("word"))).alias("key"))
            keys = [r.key for r in asked.select("key").distinct().collect()]  # one more than a word has letters, for each
            held = self._read("words", keys).filter(F.col("key").isin(keys)).join(F.broadcast(asked), "key")
            out = out.unionByName(held.filter((F.levenshtein("term", "word", 1) >= 0) & (F.col("term") != F.col("word"))).select("word", "term"))
        return out.distinct()

    def _approximate(self, pool: DataFrame, terms: list[str], language: str) -> DataFrame:
        """(id, morph) as ``search.approximate`` gives it, from postings."""
        near = self.near_words(terms, language).withColumn("hash", F.xxhash64("term"))
        told = near.agg(F.count("*").alias("n"), F.collect_set(F.pmod("hash", F.lit(MAX_BUCKETS))).alias("buckets")).first()  # at most MAX_BUCKETS numbers
        words = F.broadcast(near.drop("hash")) if told["n"] <= SHIPPED_WORDS else near.drop("hash")
        alike = self._read("postings", told["buckets"]).join(words, "term").select("id", "segment", "word").distinct()
        own = self._read("postings", self._hashes(terms)).filter(F.col("term").isin(terms)).select("id", "segment", F.col("term").alias("word"))
        only = alike.join(own, ["id", "segment", "word"], "left_anti").join(pool.select("id", "segment"), ["id", "segment"], "left_semi")
        return only.groupBy("id").agg((F.count("*") * 0.5).alias("morph"))

    def search(self, options: S.SearchOptions, trust: DataFrame | None = None, exact: bool = False, contents: DataFrame | None = None) -> DataFrame:
        """The hits that ``search.search`` gives for the records of this version; ``contents`` are the records, for reranking."""
        if self.version is None:
            return self.at().search(options, trust, exact, contents)
        pool = S.in_scope(self.records(True), options.wing, options.room, options.kind)
        if trust is not None and options.min_trust:
            pool = S.above_floor(pool, trust, options.min_trust)
        terms = S.query_terms(options.query) if self._segments() else []
        nothing = pool.select("id").limit(0)
        lexical = self._lexical(pool, terms) if terms else nothing.select("id", F.lit(0.0).alias("bm25"))
        morph = self._approximate(pool, terms, options.language) if terms and options.language else nothing.select("id", F.lit(0.0).alias("morph"))
        hits = pool.select("id", "wing", "room", S.disjoint(F.col("mask"), options.query).alias("disjoint"), *(["embedding", "codes"] if "embedding" in pool.columns else []))
        worded = lexical.select("id").union(morph.select("id"))
        if "embedding" in pool.columns:
            probe = F.array(*(F.lit(float(x)) for x in options.vector or V.hash_embed(options.query)))
            if not exact:
                scoped = any((options.wing, options.room, options.kind, options.min_trust))
                live = pool.count()
                size = max(S.pool_size(live, live if scoped else None)[0], 4 * (options.offset + options.limit))
                near = S.leading(pool.select("id", V.cosine(F.col("codes"), probe).alias("near")), "near", size, -1.0, 1.0).select("id")
                hits = hits.join(near.union(worded).distinct(), "id", "left_semi")
            hits = hits.withColumn("semantic", V.semantic(V.cosine(F.col("embedding"), probe))).drop("embedding", "codes")
        else:
            hits = hits.join(worded.distinct(), "id", "left_semi").withColumn("semantic", F.lit(0.5))
        return S.ranked_page(hits.join(lexical, "id", "left").join(morph, "id", "left"), options, contents)
