"""The stored search index: approximate words, versions, pinned pages, writers that meet."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import index as I
from recollect.operators import search as S
from recollect.operators.index import SearchIndex
from recollect.plans.search_queries import records


def _within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=7), st.sampled_from(sorted(X.SUFFIXES)))
def test_inflected_words_lead_back(word, language):
    import re

    listed = "|".join(sorted(X.SUFFIXES[language].split(), key=lambda s: (-len(s), s)))
    base = lambda t: re.sub(f"^(.{{3,}}?)(?:{listed})$", r"\1", t)
    for other in X.inflected(word, language):
        assert base(other) == base(word)
    assert word in X.inflected(word, language)


def test_words_one_edit_apart_share_a_key(spark):
    words = ["house", "houses", "hause", "ouse", "mouse", "xhouse", "ouseh", "haus", "straße", "strasse", "strase", "😀abcd", "😀abcde"]
    keys = {r.w: set(r.k) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.edit_keys(F.col("w")).alias("k")).collect()}
    for a in words:
        assert len(keys[a]) == len({a} | {a[:i] + a[i + 1 :] for i in range(len(a))})
        for b in words:
            assert not _within_one(a, b) or keys[a] & keys[b]


@pytest.fixture(scope="module")
def index(spark, sf_dir, tmp_path_factory):
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("index")))
    for part in range(3):
        index.add(records(spark, sf_dir).filter(f"id % 3 = {part}"))
    return index


@pytest.mark.parametrize("query, language, wing", [("whands edlys", "en", "en"), ("ouxmentre laa", "fr", None), ("thing whand", "de", None), ("zzzzzzz", "en", None), ("", "en", None)])
def test_approximate_words_are_those_of_the_scan(spark, sf_dir, index, query, language, wing):
    options = S.SearchOptions(query=query, language=language, wing=wing, limit=500)
    got, want = index.search(options), S.search(records(spark, sf_dir), options)
    key = lambda df: [(r["rank"], r.id, round(r.score, 9), round(r.lexical_morph, 9)) for r in df.orderBy("rank").collect()]
    assert key(got) == key(want)


def test_near_words_against_all_words(spark, sf_dir, index):
    stored = [r[0] for r in records(spark, sf_dir).select(F.explode(X.words(X.search_key(F.col("content"))))).distinct().collect()]
    asked = [w for w in stored if len(w) == 6][:25] + ["whands"]
    got = {(r.word, r.term) for r in index.at().near_words(asked, "en").collect() if r.term in set(stored)}
    stems = {w: set(X.inflected(w, "en")) for w in asked}
    want = {(w, t) for w in asked for t in stored if t != w and (t in stems[w] or len(t) >= 5 and _within_one(w, t))}
    assert got == want and len(want) > 25


def test_words_of_many_buckets(spark, sf_dir, tmp_path, monkeypatch, index):
    """Segments of different numbers of buckets answer alike, and words too many to ship are joined."""
    monkeypatch.setattr(I, "BUCKET_POSTINGS", 500)
    monkeypatch.setattr(I, "SHIPPED_WORDS", 0)
    other = SearchIndex(spark, str(tmp_path))
    other.add(records(spark, sf_dir).filter("id < 150"))
    other.add(records(spark, sf_dir).filter("id >= 150"))
    assert len({e["buckets"] for _, e in other.at()._segments()} - {1}) >= 1
    options = S.SearchOptions(query="whands edlys thing", language="en", limit=300)
    assert [tuple(r) for r in other.search(options).orderBy("rank").collect()] == [tuple(r) for r in index.search(options).orderBy("rank").collect()]


def _ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_pages_of_one_version(spark, tmp_path):
    rows = spark.createDataFrame([(i, "w", "r", "word " * (1 + i % 5) + f"x{i}") for i in range(60)], "id long, wing string, room string, content string")
    index, page = SearchIndex(spark, str(tmp_path)), lambda n: S.SearchOptions(query="word", limit=10, offset=10 * n)
    assert index.search(page(0)).count() == 0
    index.add(rows.filter("id < 40"))
    pinned = index.at()
    seen = _ids(pinned.search(page(0)))
    index.remove(rows.filter("id % 3 = 0"))
    index.add(rows.filter("id >= 40"))
    seen += _ids(pinned.search(page(1)))
    index.compact()
    seen += _ids(pinned.search(page(2))) + _ids(pinned.search(page(3)))
    assert sorted(seen) == list(range(40))
    assert index.versions() == [1, 2, 3, 4]
    now = lambda: {r.id for r in index.at().records().collect()}
    assert now() == {i for i in range(60) if i >= 40 or i % 3}
    # a removed record that is added again is there again; removals hold for what came before them
    index.add(rows.filter("id = 3"))
    assert 3 in now() and 6 not in now()
    index.expire(index.versions()[-1])
    assert len(index.versions()) == 1 and 3 in now() and len(now()) == 47
    with pytest.raises(ValueError):
        index.at(1)


def test_two_writers_meet(spark, tmp_path, monkeypatch):
    """The second of two writers that began at one version goes on from the first one's."""
    rows = spark.createDataFrame([(i, "w", "r", f"word x{i}") for i in range(4)], "id long, wing string, room string, content string")
    index, late = SearchIndex(spark, str(tmp_path)), SearchIndex(spark, str(tmp_path))
    index.add(rows.filter("id = 0"))
    stale = late.at()
    known = [stale, None]
    monkeypatch.setattr(late, "at", lambda version=None: known.pop(0) or SearchIndex.at(late, version) if known else SearchIndex.at(late, version))
    index.add(rows.filter("id = 1"))
    late.add(rows.filter("id = 2"))
    assert {r.id for r in index.records().collect()} == {0, 1, 2} and index.versions() == [1, 2, 3]


def test_segments_without_words(spark, tmp_path):
    schema = "id long, wing string, room string, content string"
    index = SearchIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame([], schema))
    index.add(spark.createDataFrame([(1, "w", "r", None), (2, "w", "r", " ")], schema))
    index.add(spark.createDataFrame([(3, "w", "r", "one word")], schema))
    assert _ids(index.search(S.SearchOptions(query="words", language="en"))) == [3]
    assert index.records().count() == 3


def test_the_head_by_histogram(spark):
    rows = spark.createDataFrame([(i, (i * 37 % 101) / 50 - 1) for i in range(101)] + [(200, None)], "id long, s double")
    for n in (1, 7, 50, 101, 1000):
        got = {r.id for r in S.leading(rows, "s", n, -1.0, 1.1).collect()}
        best = sorted(range(101), key=lambda i: -(i * 37 % 101))[:n]
        assert set(best) <= got and len(got) <= n + 2
