"""Source divergence, periodic runs and token counts against plain versions, and their edge cases."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recollect.llm import divergence, periodic, tokencount
from recollect.llm import queries as Q
from recollect.llm import textscan as ts
from recollect.llm.divergence import Trie, branch, branch_row, merged, source_divergence
from recollect.llm.periodic import periodic_runs, runs_of
from recollect.llm.tokencount import count_tokens, read_vocabulary, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, runs int, collapsed int, n_tokens string, N_Bytes string, docs int, leaf string"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(40_000))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "one", "de", None),
    (None, "no id " * 9, "en", "c"), (7, "Tie tie TIE été Été", "en", "b"), (7, "other text, same id", "en", "c"), (8, "日本語 текст ελληνικά — 123", "xx", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 1, 2, "x", "y", 3, "z") for i, t, lang, s in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- source divergence ---


def plain_divergence(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [s for x, s in groups if x == lang]
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def p(counter, term, kept=kept):
            return 1 + 1_000_000_000 * (counter[term] + 2) // (sum(counter[t] for t in kept) + 2 * len(kept))

        shares = {s: {t: p(counts[lang, s], t) for t in kept} for s in own}
        every = {t: p(whole, t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(s, sum(f(shares[source][t], shares[s][t]) for t in kept)) for s in own if s != source]
        terms = [(t, f(shares[source][t], every[t])) for t in kept if counts[lang, source][t] and shares[source][t] > every[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def some_documents():
    rng = np.random.default_rng(5)
    words = [chr(97 + k) * (1 + k % 3) for k in range(26)] + ["été", "日本", "ß", "ÅB"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), rng.choice(["en", "de", "fr"]), f"s{rng.integers(0, 6)}") for _ in range(300)]
    rows += [("tie", "en", "s0"), ("eit", "en", "s0")] * 12 + [("rare", "zz", "only"), ("", "zz", "none"), (None, None, None), ("a b", None, "s\0"), ("a", "e\0n", "s1")]
    return [(None if t is None else str(t), None if lang is None else str(lang), s) for t, lang, s in rows]


@pytest.mark.parametrize("least,leaves,branch_size,tile,cells", [(10, 1_000_000, 1024, 256, 2_000_000), (3, 40, 4, 2, 8), (1, 7, 1, 1, 1)])
def test_divergence_against_a_plain_version(spark, monkeypatch, least, leaves, branch_size, tile, cells):
    """Also with tries that are written early, branches split by every cut, and small tiles."""
    monkeypatch.setattr(divergence, "MAX_LEAVES", leaves)
    monkeypatch.setattr(divergence, "BRANCH", branch_size)
    monkeypatch.setattr(divergence, "RANGE_LEAVES", leaves)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = some_documents()
    got = source_divergence(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5), least, 4)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, least, 4)


def test_divergence_edges(spark, docs, empty):
    got = [tuple(r) for r in source_divergence(docs, 2).collect()]
    assert sorted(got) == plain_divergence([(t, lang, s) for _, t, lang, s in ROWS], 2, 10)
    assert source_divergence(empty).count() == 0
    assert source_divergence(empty).columns == ["lang", "source", "part", "item", "value", "rank"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text(alphabet="ab\0é日", max_size=6), st.sampled_from("xyz"), st.integers(1, 1 << 40)), max_size=12), min_size=1, max_size=4))
def test_tries_merge_and_are_stored(parts):
    tries, want = [], Counter()
    for part in parts:
        sums = Counter()
        for key, source, n in part:
            sums[key, source] += n
            want[key, source] += n
        keys = sorted({k for k, _ in sums})
        if keys:
            cells = sorted(sums.items())
            tries.append(Trie(pa.array([k.encode() for k in keys], pa.large_binary()), np.ones(len(keys), np.int64), np.array([keys.index(k) for (k, _), _ in cells]), np.array(["xyz".index(s) for (_, s), _ in cells]), np.array([n for _, n in cells]), list("xyz")))
    if not tries:
        return
    out = branch(branch_row(merged(tries)))
    keys = [k.decode() for k in out.keys.to_pylist()]
    assert keys == sorted({k for k, _ in want}, key=str.encode)
    assert {(keys[at], out.names[s]): int(n) for at, s, n in zip(out.leaf, out.source, out.count, strict=True)} == dict(want)
    assert out.docs.tolist() == [sum(any(k == key for k, _, _ in part) for part in parts) for key in keys]


def test_shares_are_exact():
    count, whole = [0, 1, 10**13, 4 * 10**15, 5], [7, 3 * 10**15, 10**13 + 2, 8 * 10**15 + 5, 7]
    assert divergence.shares(np.array(count), np.array(whole)).tolist() == [1 + 10**9 * (c + 2) // w for c, w in zip(count, whole, strict=True)]


# --- periodic runs ---


def plain_runs(words, least):
    """Every maximal stretch that agrees with itself q words on, smallest q first."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def plain_text(words, least):
    dropped = {i for s, n, q in plain_runs(words, least) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


PIECES = st.lists(st.tuples(st.lists(st.sampled_from(["a", "b", "c", "é", "x1", "x2"]), min_size=1, max_size=9), st.integers(1, 6)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(2, 14))
def test_runs_of_words(pieces, least):
    words = [w for part, n in pieces for w in part * n]
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    assert runs_of([ids[w] for w in words], least) == plain_runs(words, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(PIECES, max_size=5), st.integers(2, 14), st.integers(1, 60))
def test_runs_of_blocks(texts, least, block):
    texts = [[w for part, n in pieces for w in part * n] for pieces in texts]
    got = []
    for words in ts.interned(pa.array(["  " + "\n\t ".join(t) for t in texts], pa.string()), ts.NON_SPACE, False, block):
        runs, kept = periodic._block(words, least)
        got += zip(runs, periodic._collapsed(words, kept).to_pylist(), strict=True)
    assert got == [(plain_runs(t, least), plain_text(t, least)) for t in texts]


def test_runs_query_against_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [None, "", " \n", "w"] + [" ".join(rng.choice(list("abcdefghijkl"), rng.integers(1, 60))) for _ in range(200)] + ["x  y\n" * 30, "\t".join(f"w{k}" for k in range(3000))]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "no id")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    import hashlib

    planted = 0
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(k).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_text(words, 12).encode()).hexdigest()
    assert planted > 5 and got[None].n_runs == 0


def test_runs_edges(spark, docs, empty):
    got = periodic_runs(docs)
    assert len(got.columns) == len(docs.columns) and got.schema["runs"].dataType.elementType.names == ["start", "length", "period"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r.runs == [] and r.collapsed == "" for r in rows if not (r.text or "").strip())
    for r in rows:
        assert [tuple(x) for x in r.runs] == ([(0, 18, 2)] if r.doc_id is None else [])
        assert r.collapsed == ("no id" if r.doc_id is None else " ".join((r.text or "").split()))
    assert periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, 1)


def test_long_runs_end():
    """One word 100,000 times, and a period of a third of the text."""
    assert runs_of([0] * 100_000) == [(0, 100_000, 1)]
    assert runs_of(list(range(20_000)) * 3) == [(0, 60_000, 20_000)]


# --- token counts ---


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_code_point(library):
    texts = [f"a{chr(c)}1{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert count_tokens(texts, read_vocabulary(VOCABULARY)).tolist() == library(texts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from(["'s", "'ll", "'re", "'", " ", "  ", "\n", "\r\n", " ", "the", " The", "é", "日本", "٣", "12", "--", "<|endoftext|>", "<|", "|>", "😀"]), max_size=25).map("".join)), max_size=6))
def test_tokens_against_the_library(library, texts):
    assert count_tokens(texts, read_vocabulary(VOCABULARY)).tolist() == library(texts)


def test_long_texts_and_words(library, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["a" * 5000, "".join(rng.choice(list("abcdeth"), 30_000)), "é" * 700 + " " * 900 + "x", "the cat " * 3000, "ab" * 3000, "x <|endoftext|>" * 900, "\n".join(f"line {k}" for k in range(2000))]
    for piece in (1 << 20, 997):
        monkeypatch.setattr(tokencount, "PIECE", piece)
        assert count_tokens(texts, read_vocabulary(VOCABULARY)).tolist() == library(texts)


def test_entries_are_proven_by_merging(library):
    """An entry is proven exactly if the library makes its text one token, where it is a text and one pre-token."""
    rules = read_vocabulary(VOCABULARY)
    proven = set(rules.proven.to_pylist())
    texts = [e.decode() for e in rules.entries if e and not e.endswith(b"\xef\xbf\xbd") and _is_text(e)]
    for text, n in zip(texts, library(texts), strict=True):
        assert (text.encode() in proven) == (n == 1)


def _is_text(entry):
    try:
        entry.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_token_query(spark, sf_dir, library):
    got = Q.QUERIES["op13_token_counts"](spark, sf_dir).toPandas()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    assert len(got) == len(texts)
    assert got.n_tokens.tolist() == library([texts[k] for k in got.doc_id])
    assert got.n_bytes.tolist() == [len((texts[k] or "").encode()) for k in got.doc_id]
    assert (got.over_limit == (got.n_tokens > 512)).all()


def test_token_edges(spark, docs, empty, library, tmp_path):
    rows = token_counts(docs, VOCABULARY, 3).collect()
    assert [r.n_tokens for r in rows] == library([r.text for r in rows]) and len(rows) == len(ROWS)
    assert [r.n_bytes for r in rows] == [len((r.text or "").encode()) for r in rows]
    assert [r.over_limit for r in rows] == [r.n_tokens > 3 for r in rows]
    assert token_counts(empty, VOCABULARY, 3).count() == 0
    with pytest.raises(ValueError):
        read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# --- pages and urls that took too long ---

ODD = {
    "stray quote": "<a " * 330_000 + '"', "unmatched ends": "<x>" * 130_000 + "text" + "</y>" * 130_000, "names that run on": "<x" * 400_000 + ' "', "tags in quotes": '<a "<b" ' * 120_000 + '"',
    "cells below a deep nest": "<td><div>" + "<x>" * 50_000 + "<td></td>" * 60_000, "quotes in names": '<x"' * 300_000 + ' "', "two kinds of quotes": "<a '\"' " * 100_000 + "'",
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_odd_pages_end(spark, name):
    """A megabyte of each kind, through the whole operator."""
    import time

    from recollect.llm.extraction import main_text

    pages = spark.createDataFrame([(1, "http://x", ODD[name]), (2, "http://x", "<body><article><p>" + "A plain sentence of the article, long enough. " * 9 + "</p></article></body>")], "page_id long, url string, html string")
    began = time.time()
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert time.time() - began < 60 and got[2].startswith("A plain sentence")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", '"', "'", "<a ", "<p>", "</p>", "<li>", "<ul>", "<td>", '<div class="x" id=\'y\'>', "<x>", "</y>", "text", " ", "<!--", "-->", '<b"c', "a=", "</", "<script>", "</script>", "<br>", "&amp;", "<tr>", "<table>", "/", "\n"]), max_size=24).map("".join))
def test_tags_end_at_the_first_bracket_outside_quotes(page):
    """Against the pattern that says where a tag ends, tried at every place anew."""
    from recollect.llm.htmltree import _Tags

    pattern = re.compile(r"([a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)", re.S)
    tags = _Tags(page)
    for at in range(len(page)):
        if page[at].isascii() and page[at].isalpha():
            m, got = pattern.match(page, at), tags.match(at)
            assert (got is None) == (m is None)
            if m:
                assert got == (m.end(1), m.end() - (m.end() > got[1]))


@pytest.mark.parametrize("segments", [10, 40])
def test_long_urls_labelled_again_and_again(spark, segments):
    import time

    from recollect.llm.urlrules import judge

    url = "http://ex.com/" + "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(segments))
    pages = spark.createDataFrame([(i, url if i < 8 else f"http://ok.org/{chr(97 + i % 26)}/x") for i in range(30)] + [(90, "http://other.net/zzz"), (91, "http://other.net/saa")], "page_id long, url string")
    labelled = spark.createDataFrame([(i, i < 6) for i in range(12)], "page_id long, bad boolean")
    began = time.time()
    got = {r.page_id: r.verdict for r in judge(pages, labelled, []).collect()}
    # any token of the repeated url tells it, as it did when every token was a rule of its own
    assert time.time() - began < 60 and {i for i, v in got.items() if v == "block"} == {*range(8), 91}


def test_rules_against_all_subsets(spark):
    """Random urls of few tokens: verdicts are those of every subset of every blocked url that holds often and surely enough."""
    from itertools import combinations

    from recollect.llm.urlrules import judge, tokens

    rng = np.random.default_rng(6)
    rows = []
    for i in range(160):
        parts = rng.choice(list("abcdef"), rng.integers(1, 5))
        twin = ["tw", "in"] if i % 3 == 0 else []
        rows.append((i, "http://h.com/" + "/".join([*parts, *twin])))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = {i: "a" in url.split("/")[3:] and "b" in url.split("/")[3:] or rng.random() < 0.15 for i, url in rows if i < 120}
    items = {r.page_id: frozenset(r.t) for r in pages.select("page_id", tokens(pages.url).alias("t")).collect()}
    least = max(5, int(np.ceil(0.005 * 120)))
    sets = Counter(s for i, b in bad.items() if b for k in range(1, len(items[i]) + 1) for s in map(frozenset, combinations(sorted(items[i]), k)))
    rules = [s for s, n in sets.items() if n >= least and n / sum(s <= items[i] for i in bad) >= 0.6]
    want = {i: "block" if any(r <= t for r in rules) else "allow" for i, t in items.items()}
    got = judge(pages, spark.createDataFrame(list((i, bool(b)) for i, b in bad.items()), "page_id long, bad boolean"), [])
    assert {r.page_id: r.verdict for r in got.collect()} == want and set(want.values()) == {"block", "allow"}
