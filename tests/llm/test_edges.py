"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import langid
from recollect.llm.annsearch import search
from recollect.llm.decontam import contamination, decontaminate
from recollect.llm.extraction import labelled_pages, main_text, train
from recollect.llm.mixing import mix_plan, mixed_documents
from recollect.llm.neardup import near_duplicates, unique_documents
from recollect.llm.quality import keep_quality, quality_scores
from recollect.llm.sharding import shards
from recollect.llm.staging import Scratch, Staged
from recollect.llm.suffixes import repeated_spans
from recollect.llm.urlrules import judge

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, depth string, cls int, hash string, root string, _extra string"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(40_000))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "one", "de", None),
    (7, "The quick brown fox jumps over the lazy dog and runs away from it all", "en", "b"), (8, "the quick brown FOX jumps over the lazy dog and runs away from it all today", "en", "b"),
    (9, "Été à la plage, 日本語 текст ελληνικά — 123", "fr", "c"), (None, "no id here", "en", "c"), (7, "another text under one id", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, "x", "y", 1, "h", "r", "e") for i, t, lang, s in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs"), (2, "ONE"), (3, None), (4, ""), (5, "one"), (None, "lazy dog")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 1, 0), (9, 0, 1), (9, 0, 1), (99, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def test_sharding(docs, empty):
    got = shards(docs, 200_000).collect()
    assert len(got) == len(ROWS) and all(r.shard_bytes <= 200_000 or r.shard_docs == 1 for r in got)
    assert shards(empty, 1000).count() == 0
    assert shards(docs, 1 << 40).select("shard_id").distinct().collect()[0][0] == ""


def test_sharding_splits_repeated_rows(spark):
    same = spark.createDataFrame([(1, "x" * 100)] * 64, "doc_id long, text string")
    got = shards(same, 1000).collect()
    assert len(got) == 64 and all(r.shard_bytes <= 1000 for r in got)


def test_mixing(docs, empty):
    got = mix_plan(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[1] == 0
    assert mix_plan(empty).count() == 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(r.text.split()) for r in out.select("text").collect())
    assert words == sum(r.taken for r in got)
    assert mixed_documents(empty).count() == 0


def test_mixing_keeps_repeated_rows_of_different_sources(spark):
    """Rows of one id and text in two sources: each takes what its own row's plan says, and is written as itself."""
    text = " ".join(f"w{k}" for k in range(640))
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, text, "a")], "doc_id long, text string, source string")
    out = mixed_documents(docs)
    words, plan = {}, {}
    for r in out.collect():
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + len(r.text.split())
    for r in mix_plan(docs).collect():
        plan[r.doc_id, "a" if r.source_size == 1280 else "b"] = r.taken
    assert words == {k: n for k, n in plan.items() if n}
    assert sorted(map(tuple, mixed_documents(docs).collect())) == sorted(map(tuple, out.collect()))


def test_language(docs, empty):
    model = langid.train(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[4].lang_pred == "en" and len(got) == 10
    spans = langid.language_spans(docs, model).filter("doc_id = 9").collect()[0].spans
    assert "".join(s.text for s in spans) == ROWS[9][1]
    assert langid.train(empty, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_texts_without_letters(spark, docs):
    model = langid.train(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "½ ² ① 12"), (2, "—– 3 €"), (3, "½ ª"), (4, "日"), (5, "٣ ३")], "doc_id long, text string")
    assert {r.doc_id for r in langid.predict(odd, model).collect() if r.lang_pred == "und"} == {1, 2, 5}
    ties = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a"), (2, "same words", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(ties, langid.train(ties, F.lit(True))).collect()} == {"a"}


def test_every_language_is_learned(spark):
    """More languages than fit one block of scores at the usual size, each with words of its own."""
    names = [f"l{i:03}" for i in range(260)]
    rows = [(i, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + k)}" for k in range(20)), n) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs, F.lit(True))).collect()}
    assert got == {i: n for i, _, n in rows}


def test_contamination_both_ways(docs, empty, bench):
    got, joined = (sorted(map(tuple, contamination(docs, bench, max_shipped=n).collect()), key=str) for n in (10**6, 0))
    assert got == joined and len(got) == len(ROWS)
    hit = {(r[0], r[1]): r for r in got}
    assert hit[7, 15][2] == 10 and hit[7, 15][3] == 1 and hit[6, 1][3] == 2 and hit[1, 0][2] == 0
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    for n in (10**6, 0):
        kept = decontaminate(docs, bench, max_shipped=n)
        assert kept.columns == docs.columns
        assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for i, t, _, _ in ROWS if i not in (6, 7, 8))


@pytest.mark.parametrize("shipped", [10**6, 0])
def test_items_without_an_id_hit(spark, shipped):
    big = 2**60 + 1  # not a float
    docs = spark.createDataFrame([(1, "x lazy dog y"), (2, "clean"), (3, "a cat b lazy dog")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "lazy dog"), (big, "cat")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, bench, max_shipped=shipped).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, 0, sha(""), True), 2: (0, 0, sha(""), False), 3: (3, 1, sha(str(big)), True)}
    assert [r.doc_id for r in decontaminate(docs, bench, max_shipped=shipped).collect()] == [2]


def test_near_duplicates(docs, empty):
    got = near_duplicates(docs, shingle=2).collect()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert len(got) == len(ROWS) and by[1, 0].component_id == 1 and by[2, 0].kept and by[3, 0].kept
    assert [r.component_id for r in got if r.doc_id in (4, 5)] == [4, 4, 4] and by[8, 15].component_id == 7
    assert near_duplicates(empty).count() == 0
    kept = unique_documents(docs)
    assert set(kept.columns) == set(docs.columns) and kept.filter("doc_id in (4, 5)").count() == 1
    assert unique_documents(empty).count() == 0
    assert kept.filter("doc_id = 7").count() == 2 and unique_documents(docs, shingle=2).filter("doc_id in (7, 8)").count() == 2  # two texts under one id


def test_scratch_tables_go(spark, tmp_path):
    with Scratch():
        inner = Staged(spark.range(3), "gone")
        with Scratch() as scratch:
            kept = scratch.keep(Staged(spark.range(2), "kept"))
            assert kept.count() == 2
        assert kept.count() == inner.df.count() - 1 == 2
    for df in (inner.df, kept):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
            df.count()


def test_repeated_spans(docs, empty):
    got = {r.doc_id: r for r in repeated_spans(docs).collect()}
    assert set(got) == {4, 5} and got[4].start_word == 0 and got[4].n_words == 80_000
    assert repeated_spans(empty).count() == 0


def test_quality(docs, empty, labels):
    got = quality_scores(docs, labels, F.lit(True)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality_scores(empty, labels, F.lit(True)).count() == 0
    assert quality_scores(docs, labels.limit(0), F.lit(True)).count() == len(ROWS)
    assert keep_quality(docs, labels, F.lit(True)).columns == docs.columns


def test_search(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, 2.0, float(i)]) for i in range(60)] + [(100, None), (101, [0.0] * 4), (102, [nan, 1.0, 1.0, 1.0]), (103, [inf, 1.0, 1.0, 1.0]), (104, [1.0]), (105, [1.0, None, 1.0, 1.0]), (20, [2.0, 1.0, 2.0, 20.0]), (200, [1.0, 1.0, 2.0, 7.0])]
    v = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, entry string, page int")
    got = search(v, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {0, 20, 40, 200} and all(len(x) == 20 for x in by.values())
    assert [x for x, _ in by[20][:2]] == [59, 58] and not any(100 < x < 106 for own in by.values() for x, _ in own)
    assert search(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert search(v.filter("vec_id < 5"), F.col("vec_id") % 20 == 0).count() == 4


def test_search_keeps_ties_of_equal_vectors(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0, 0.5, 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    got = {}
    for r in search(v, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [x for _, x in sorted(got[20])] == [i for i in range(21) if i != 20] and [x for _, x in sorted(got[0])] == list(range(1, 21))


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "plain text"), (4, "HTTP://A.Example.COM/en/7?x=1#f", "<p>unclosed <b>bold"), (4, "http://x://y/z", "<div class='"), (5, "ftp://com/en/", "<script>var a='<p>'</script>"), (None, "http:///x", "<p>a &amp; b</p>")]
    pages = spark.createDataFrame([(*r, "k", "z") for r in rows], "page_id long, url string, html string, url_key string, confidence string")
    labelled = spark.createDataFrame([(4, True), (5, False), (77, True)], "page_id long, bad boolean")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7")]
    got = sorted(map(tuple, judge(pages, labelled, rules).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert (4, "a.example.com", "/en/7", "example.com/en/7", "allow") in got and (5, "com", "/en/", "com/en/", "block") in got
    assert (3, "", "", None, "allow") in got and (4, "x:", "//y/z", None, "allow") in got and len(got) == 7
    assert judge(pages.limit(0), labelled, rules).count() == 0
    texts = sorted(((r.page_id, r.text) for r in main_text(pages, train(labelled_pages(60), 120)).collect()), key=str)
    assert (1, "") in texts and (2, "") in texts and (3, "plain text") in texts and (5, "") in texts and (None, "a & b") in texts and len(texts) == 7
    assert main_text(pages.limit(0), train(labelled_pages(20), 20)).count() == 0


def test_pipeline_stages(spark, docs, empty, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, empty):
            out = stage(spark, df, sf_dir)
            out.count()
            if name != "sharding":
                assert out.columns == docs.columns, name


def test_pipeline_stages_with_clashing_columns(spark, docs, sf_dir):
    """Columns named like helpers pass through unchanged, repeated rows among them."""
    clashing = docs.withColumns({n: F.concat(F.lit("own "), F.coalesce(F.col("source"), F.lit("?"))) for n in ("_x_row", "_X_Pieces", "_x_copy", "_x_class", "_x_first", "_row_key")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing.unionByName(clashing.limit(5)), sf_dir)
        assert out.columns == clashing.columns, name
        for r in out.collect():
            assert {r["_x_row"], r["_X_Pieces"], r["_x_copy"], r["_x_class"], r["_x_first"], r["_row_key"]} == {"own " + (r["source"] or "?")}, name


def test_long_and_repeated_pages(spark):
    """A page of some MB, and pages that repeat, urls of some KB and repeated ones."""
    body = "".join(f"<p>Sentence number {i} of a long report on rivers, towns and trade.</p>" for i in range(20_000))
    page = f"<html><body><nav><a href=/>home</a></nav><article><h1>Report</h1>{body}</article><footer>all rights reserved</footer></body></html>"
    long_url = "http://a.example.net/de/" + "x/" * 2000 + "?q=" + "y" * 3000
    rows = [(1, long_url, page), (2, long_url, page), (2, long_url, page), (3, "http://b.org/", "<p>Short.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars, r.text[:8], r.text.count("\n\n")) for r in main_text(pages, train(labelled_pages(60), 120)).collect())
    assert got[0][1:] == got[1][1:] == got[2][1:] and got[0][2:] == ("Report\n\n", 20_000) and len(got) == 4
    judged = judge(pages.select("page_id", "url"), spark.createDataFrame([(1, True), (3, False)], "page_id long, bad boolean"), [("block", "net/de/")]).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in judged) == [(1, "net/de/", "block"), (2, "net/de/", "block"), (2, "net/de/", "block"), (3, None, "allow")]


def test_repeated_and_tied_texts_score_alike(spark, labels):
    docs = spark.createDataFrame([(4, LONG), (4, LONG), (7, "one text"), (8, "one text"), (9, None), (10, "")], "doc_id long, text string")
    got = [(r.doc_id, r.score) for r in quality_scores(docs, labels, F.lit(True)).collect()]
    by = {}
    for i, score in got:
        by.setdefault(i, set()).add(score)
    assert len(got) == 6 and all(len(s) == 1 for s in by.values()) and by[7] == by[8] and by[9] == by[10]
    tied = spark.createDataFrame([(7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_scores(docs, tied, F.lit(True)).count() == 6


def test_stages_decide(spark, sf_dir):
    """Each stage on its own input: what it has to drop goes, all else stays as it was."""
    stage = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = table.orderBy("doc_id").filter("length(text) > 400").limit(30)
    copies = first.withColumn("doc_id", F.col("doc_id") + 1_000_000)
    kept = stage["near_duplicates"](spark, first.unionByName(copies), sf_dir).select("doc_id").collect()
    assert kept and all(r.doc_id < 1_000_000 for r in kept)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("size(split(text, ' ')) >= 10").orderBy("item_id").first().text
    leak = first.withColumns({"doc_id": F.col("doc_id") + 2_000_000, "text": F.concat(F.lit("Before. "), F.lit(item), F.lit(" After."))})
    clean = spark.createDataFrame([(5, "nothing of any test is in here", "en", "a", 30)], first.schema)
    assert [r.doc_id for r in stage["decontamination"](spark, leak.unionByName(clean), sf_dir).collect()] == [5]
    junk = first.withColumns({"doc_id": F.col("doc_id") + 3_000_000, "text": F.lit("&&& *** $$$ ### " * 60)})
    stays = {r.doc_id for r in stage["quality"](spark, table.unionByName(junk), sf_dir).select("doc_id").collect()}
    assert len(stays) > 0.6 * table.count() and not any(i >= 3_000_000 for i in stays)
    mixed = stage["mixing"](spark, first, sf_dir).collect()
    texts = {r.doc_id: r.text.split() for r in first.collect()}
    assert all(set(r.text.split()) <= set(texts[r.doc_id]) and r.n_chars == len(r.text) for r in mixed)
    sharded = stage["sharding"](spark, first, sf_dir).collect()
    assert len(sharded) == 30 and all(r.shard_bytes <= corpus_pipeline.SHARD_BYTES for r in sharded)
