"""Points in spans, runs in an audit, and proofs of forgetting, against plain versions."""

import hashlib
import hmac
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.operators import governance as G
from recollect.operators import intervals as I
from recollect.operators import proofs as P


def _plain(points, spans):
    return sorted((p, s) for p, k, at in points for s, key, a, b in spans if k is not None and k == key and at is not None and (a is None or a <= at) and (b is None or b > at))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-40, 3000))), max_size=30), st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-100, 3100)), st.one_of(st.none(), st.integers(-100, 3100))), max_size=30), st.sampled_from([2, 100_000]), st.sampled_from([1, 60_000_000, 86_400_000_000]))
def test_points_in_spans(spark, points, spans, most, unit):
    points = [(k, None if t is None else t * unit + 7) for k, t in points]
    spans = [(k, None if a is None else a * unit + i % 9, None if b is None else b * unit + i % 11) for i, (k, a, b) in enumerate(spans)]
    points, spans = [(i, *p) for i, p in enumerate(points)], [(i, *s) for i, s in enumerate(spans)]
    had, I.CELL_SPANS = I.CELL_SPANS, most
    try:
        got = I.stabbed(spark.createDataFrame(points, "p int, k string, t long"), spark.createDataFrame(spans, "s int, k string, b long, e long"), ["k"], "t", "b", "e")
        assert sorted((r.p, r.s) for r in got.select("p", "s").collect()) == _plain(points, spans)
    finally:
        I.CELL_SPANS = had


def test_long_axes_and_hot_cells(spark, monkeypatch):
    """Instants in microseconds over decades; a cell with far more spans than a lane takes."""
    monkeypatch.setattr(I, "CELL_SPANS", 10)
    rng = random.Random(1)
    high = 40 * 365 * 86_400_000_000
    points = [(i, "k", rng.randrange(high)) for i in range(60)] + [(60, "k", 0), (61, "k", high)]
    spans = [(i, "k", None, None) for i in range(55)] + [(100 + i, "k", a := rng.randrange(high), a + rng.randrange(1, high // 3)) for i in range(60)] + [(300, "k", points[0][2], points[0][2] + 1), (301, "k", 5, 5), (302, "k", 9, 3)]
    got = I.stabbed(spark.createDataFrame(points, "p int, k string, t long"), spark.createDataFrame(spans, "s int, k string, b long, e long"), ["k"], "t", "b", "e")
    assert sorted((r.p, r.s) for r in got.select("p", "s").collect()) == _plain(points, spans)


def test_keys_of_few_and_of_many_spans(spark, monkeypatch):
    """Keys on both sides of FEW, and one without spans; no side of a join of points and spans is shipped whole."""
    monkeypatch.setattr(I, "FEW", 3)
    rng = random.Random(3)
    points = [(i, rng.choice("abcd"), rng.choice([None, *range(40)])) for i in range(80)]
    spans = [(i, k, rng.choice([None, *range(30)]), rng.choice([None, *range(10, 40)])) for i, k in enumerate("aab" + "c" * 20)]
    got = I.stabbed(spark.createDataFrame(points, "p int, k string, t long"), spark.createDataFrame(spans, "s int, k string, b long, e long"), ["k"], "t", "b", "e")
    assert sorted((r.p, r.s) for r in got.select("p", "s").collect()) == _plain(points, spans)


@pytest.mark.parametrize("name", ["q_typo", "q_valid_then"])
def test_exploded_sides_are_not_broadcast(spark, sf_dir, name):
    from recollect.plans import registry

    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # the keys with many spans, one for every FEW rows at most, may be shipped
    assert all("LeftAnti" in line for line in plan.splitlines() if "Broadcast" in line and "Join" in line)


def test_runs_in_an_audit(spark):
    rng = random.Random(5)
    audit = [(s, rng.choice("xyz"), None if rng.random() < 0.1 else rng.choice("12")) for s in range(400) if s % 37]
    at = {s: (a, b) for s, a, b in audit}
    docs = {}
    for d in range(60):
        start, n = rng.choice(audit)[0], rng.randrange(1, 7)
        docs[d] = [at.get(start + k, ("q", "q")) for k in range(n)]
        if d % 3 == 0:
            docs[d][rng.randrange(n)] = ("w", "1")
    got = {r.doc: (r.n, r.start, r.fault) for r in I.matched_runs(spark.createDataFrame([(d, k, *r) for d, rows in docs.items() for k, r in enumerate(rows)], "doc int, place long, a string, b string"), spark.createDataFrame(audit, "seq long, a string, b string"), ["a", "b"]).collect()}
    for d, rows in docs.items():
        starts = [s for s in at if all(at.get(s + k) == r for k, r in enumerate(rows))]
        fault = None if starts else "not contiguous" if rows[0] in at.values() else "no such record"
        assert got[d] == (len(rows), min(starts, default=None), fault)
    matched = spark.createDataFrame([(1, 2, 10), (2, 1, None)], "doc int, n long, start long")
    assert {r.doc: r.later for r in I.marks_after(matched, spark.createDataFrame([(11,), (12,), (40,)], "seq long")).collect()} == {1: 2, 2: None}


# --- proofs ---

KEY = b"a key"


def _step(head, tag, key):
    step = f"{head}\x1f{tag}".encode()
    return hashlib.sha256(step).hexdigest() if key is None else hmac.new(key, step, "sha256").hexdigest()


@pytest.fixture(scope="module", params=[None, KEY])
def vault(request, spark):
    """Two chains with gaps in their numbers, their heads, and proofs of rows 4 to 8, of the first row, and of a last one."""
    key = request.param
    rows = [(c, 10 * k + c, f"del/{c}-{k}" if k != 9 else "write/x", f"tag{c}.{k}") for c in (1, 2) for k in range(1, 13)]
    audit = spark.createDataFrame(rows, "chain int, seq long, record_id string, tag string")
    heads = G.chain_heads(audit, key).cache()
    wanted = spark.createDataFrame([("mid", 1, 41, 81), ("first", 1, 11, 11), ("last", 2, 122, 122)], "proof string, chain int, first long, last long")
    return key, rows, heads, [df.cache() for df in P.proofs(audit, heads, wanted)]


def _verdict(spark, vault, headers=None, records=None, named=None, live=()):
    key, _, heads, (h, r, n) = vault
    out = P.verdicts(headers or h, records or r, named or n, heads, spark.createDataFrame([(x,) for x in live], "id string"), key)
    return {r.proof: r.verdict for r in out.collect()}


def test_honest_proofs(spark, vault):
    key, rows, heads, (headers, records, named) = vault
    assert _verdict(spark, vault) == {"mid": "verified", "first": "verified", "last": "verified"}
    head, want = "", {}
    for c, s, _, tag in rows:
        if c == 1:
            head = _step(head, tag, key)
            want[s] = head
    mid = headers.filter("proof = 'mid'").first()
    assert (mid.head_before, mid.head_after, mid.seq) == (want[31], want[81], 31) and headers.filter("proof = 'first'").first().head_before == ""
    assert {r.proof: list(r.faults) for r in P.checked(headers, records, named, key).collect()} == {"mid": [], "first": [], "last": []}


@pytest.mark.parametrize("change, want", [
    (lambda h, r, n: (h, r.withColumn("tag", F.when((F.col("proof") == "mid") & (F.col("place") == 3), "forged").otherwise(F.col("tag"))), n), "heads do not chain"),
    (lambda h, r, n: (h, r.filter("not (proof = 'mid' and place = 4)"), n), "no tombstone"),
    (lambda h, r, n: (h, r.filter("not (proof = 'mid' and place = 4)"), n.filter("id <> '1-8'")), "heads do not chain"),
    (lambda h, r, n: (h, r.withColumn("place", F.when((F.col("proof") == "mid") & (F.col("place") > 2), F.col("place") + 1).otherwise(F.col("place"))), n), "places are not counted on"),
    (lambda h, r, n: (h, r.withColumn("place", F.when((F.col("proof") == "mid") & F.col("place").isin(1, 2), 3 - F.col("place")).otherwise(F.col("place"))), n), "heads do not chain"),
    (lambda h, r, n: (h, r, n.filter("id <> '1-5'")), "not named"),
    (lambda h, r, n: (h, r.withColumn("record_id", F.when((F.col("proof") == "mid") & (F.col("place") == 0), "write/1-4").otherwise(F.col("record_id"))), n), "not a tombstone"),
    (lambda h, r, n: (h.withColumn("seq", F.when(F.col("proof") == "mid", 21).otherwise(F.col("seq"))), r, n), "not in the chain"),
    (lambda h, r, n: (h.withColumn("chain", F.when(F.col("proof") == "mid", "2").otherwise(F.col("chain"))), r, n), "not in the chain"),
    (lambda h, r, n: (h.withColumn("head_before", F.when(F.col("proof") == "mid", "0").otherwise(F.col("head_before"))), r, n), "heads do not chain"),
])
def test_changed_proofs_are_found(spark, vault, change, want):
    assert _verdict(spark, vault, *change(*vault[3])) == {"mid": want, "first": "verified", "last": "verified"}


def test_forgotten_records_must_be_gone(spark, vault):
    assert _verdict(spark, vault, live=["1-5", "1-1x"]) == {"mid": "still there", "first": "verified", "last": "verified"}


def test_a_run_cut_at_both_ends_with_its_own_heads_is_not_the_chain_s(spark, vault):
    """A document made up whole: its heads chain, but they aren't the chain's."""
    key, _, _, (headers, records, named) = vault
    tags = [r.tag for r in records.filter("proof = 'mid'").orderBy("place").collect()]
    head = "f" * 64
    for tag in tags:
        head = _step(head, tag, key)
    forged = headers.withColumns({"head_before": F.when(F.col("proof") == "mid", "f" * 64).otherwise(F.col("head_before")), "head_after": F.when(F.col("proof") == "mid", head).otherwise(F.col("head_after"))})
    assert _verdict(spark, vault, forged)["mid"] == "not in the chain"
