"""Operators on small hand-made cases."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.functions import vectors as V
from recollect.operators import evaluation as E
from recollect.operators import governance as G
from recollect.operators import ranks
from recollect.operators import records as R
from recollect.operators import search as S
from recollect.plans import registry
from recollect.sources import files
from recollect.streaming import pipelines as P


def test_selection_fits_its_budget(spark):
    hits = spark.createDataFrame([(1, 1, "r", 0, 100), (1, 2, "r", 50, 150), (1, 3, "r", 0, 150), (1, 4, "q", 0, 500), (1, 5, "q", 0, 40)], "query_id long, rank int, room string, s long, e long")
    assert [(r["rank"], r.added, r.spent) for r in E.selected(hits, 200).orderBy("rank").collect()] == [(1, 100, 100), (2, 50, 150), (5, 40, 190)]


def test_covering_rank_needs_the_union(spark):
    hits = spark.createDataFrame([(1, 1, "r", 0, 50), (1, 2, "r", 50, 90), (2, 1, "r", 0, 10)], "query_id long, rank int, room string, s long, e long")
    wanted = spark.createDataFrame([(1, "r", 40, 60), (2, "r", 5, 20)], "query_id long, room string, s long, e long")
    assert {r.query_id: (r["rank"], r.bucket) for r in E.covering_rank(hits, wanted).collect()} == {1: (2, 10), 2: (None, None)}


def test_session_rank_has_all_labels(spark, tmp_path):
    rows = [(i, [1.0, i / 100], i) for i in range(150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r.label for r in registry.QUERIES["q_session_rank"](spark, str(tmp_path)).collect()) == list(range(1, 150))


def _vectors(spark, path, x):
    rows = [(20 * i + (i % 7 > 0), [float(v) for v in r], i % 5) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return {i for i, _, _ in rows if i % 20 == 0}


@pytest.mark.parametrize("name", ["q_pq_search", "q_ivf_probe"])
def test_every_twentieth_vector_is_asked(spark, tmp_path, name):
    asked = _vectors(spark, tmp_path, np.random.default_rng(3).normal(size=(400, 64)))
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert len(asked) > 20 and set(got["query_id"]) == asked and (got["query_id"] != got["id"]).all()


def test_a_query_whose_lists_hold_too_few_goes_to_all(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(2, 64))
    rows = [(i, [float(v) for v in x[int(i > 0)]], 0) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["q_ivf_probe"](spark, str(tmp_path)).toPandas()
    assert got.groupby("query_id").size().to_dict() == {q: 5 for q in (0, 20, 40, 60, 80)}


def test_alignment_takes_whole_texts(spark, tmp_path):
    texts = [(i, " ".join([f"s{k}" for k in range(20)] + [f"w{i}x{k}" for k in range(200)])) for i in (5, 10)]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.QUERIES["q_greedy_align"](spark, str(tmp_path)).collect()
    assert sorted((r.p, r.g, r.f1) for r in got) == [(5, 5, 1.0), (10, 10, 1.0)]


def test_alignment_is_one_to_one(spark):
    p = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "b", "c"])], "group long, p long, p_tokens array<string>")
    g = spark.createDataFrame([(1, 7, ["a", "b"]), (1, 8, ["c", "d"])], "group long, g long, g_tokens array<string>")
    assert [(r.p, r.g) for r in E.aligned(p, g).collect()] == [(1, 7)]


def test_floors(spark):
    assert S.effective_floor("trusted", "standard", None) == "trusted"
    assert S.effective_floor(None, "standard", None) == "standard" and S.effective_floor(None, "standard", "w") == "quarantined"
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "wing string")
    trust = spark.createDataFrame([("a", "quarantined"), ("b", "trusted")], "wing string, trust string")
    assert {r.wing for r in S.above_floor(rows, trust, "standard").collect()} == {"b", "c"}
    assert {r.wing for r in S.above_floor(rows, trust, "trusted").collect()} == {"b"}


def test_search_channels(spark):
    rows = spark.createDataFrame([("1", "w", "r", "the engines were started"), ("2", "w", "r", "one engine"), ("3", "w", "r", "nothing"), ("4", S.QUARANTINE, "r", "engine")], "id string, wing string, room string, content string")
    assert [r.id for r in S.search(rows, S.SearchOptions(query="engine")).collect()] == ["2"]
    assert [r.id for r in S.search(rows, S.SearchOptions(query="engine", language="en")).orderBy("rank").collect()] == ["2", "1"]
    assert [r.id for r in S.search(rows, S.SearchOptions(query="engine", wing=S.QUARANTINE)).collect()] == ["4"]
    assert S.search(rows, S.SearchOptions(query="!")).count() == 0


def test_external_vectors_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert [r.id for r in S.external(rows, [0.1, 1.0], 1).collect()] == [2]
    with pytest.raises(ValueError):
        S.external(rows, [1.0], 1)
    assert V.external_spec("external:mine@64") == ("mine", 64)
    with pytest.raises(ValueError):
        V.external_spec("mine@64")
    assert 0 <= V.semantic_floor() <= 0.98 and S.pool_size(64_000) == (1000, 125) and S.pool_size(10, 5000) == (2048, 1024)


def test_chain_detects_a_change(spark):
    a = spark.createDataFrame([("c", i, f"t{i}") for i in range(30)], "chain string, seq long, tag string")
    for key in (None, b"key"):
        heads = G.chain_heads(a, key)
        assert G.verified(a, heads, key).count() == 0
        forged = a.withColumn("tag", F.when(F.col("seq") == 15, "x").otherwise(F.col("tag")))
        assert sorted(r.seq for r in G.verified(forged, heads, key).collect()) == list(range(15, 30))
        assert G.verified(a.filter("seq < 10 or seq >= 20"), heads, key).count() == 20  # a whole stretch taken out


def test_long_chain_is_one_fold(spark):
    a = spark.range(20_050).selectExpr("'c' AS chain", "id AS seq", "concat('t', id) AS tag")
    head, want = "", {}
    for i in range(20_050):
        want[i] = head = hashlib.sha256(f"{head}\x1ft{i}".encode()).hexdigest()
    heads = G.chain_heads(a.unionByName(a.filter("seq < 3").withColumn("chain", F.lit("b"))))
    assert {r.seq: r.head for r in heads.filter("chain = 'c'").collect()} == want
    assert {r.seq: r.head for r in heads.filter("chain = 'b'").collect()} == {i: want[i] for i in range(3)}


def test_updates_keep_the_last_batch_of_a_key(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 02:00:00", 3.0), ("a", "2024-01-01 01:00:00", 2.0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        spark.read.parquet(str(tmp_path / f"in{i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = P.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    assert sorted((r.key, r.n, r.mean) for r in P.once(P.ring(source, "event_type", 5), "update", "key").collect()) == [("a", 2, 1.5), ("b", 1, 3.0)]
    assert P.once(source.filter("value > 9")).count() == 0


def test_rates_of_a_busy_key(spark):
    """Counts over spans are those of one window over the key."""
    rng = np.random.default_rng(4)
    rows = [(int(k), int(t)) for k, t in zip(rng.integers(0, 2, 400), rng.integers(0, 3000, 400), strict=True)]
    events = spark.createDataFrame(rows, "k long, t long").withColumn("at", F.timestamp_seconds("t"))
    got = sorted((r.k, r.t, r.recent, r.flagged) for r in G.rate_flags(events, "k", "at", 100, 5).collect())
    want = sorted((k, t, n := sum(a == k and t - 100 <= b <= t for a, b in rows) - 1, n >= 5) for k, t in rows)
    assert got == want


def test_snapshots(spark):
    stamps = spark.createDataFrame([(f"2024-{m:02}",) for m in range(1, 13)], "stamp string")
    assert sorted(r.stamp for r in files.surplus_snapshots(stamps).collect()) == ["2024-01", "2024-02"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 2.0), ("b", "2024-01-01 02:00:00", 3.0)], "content string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    source = P.stream(spark, str(tmp_path / "in"), rows.schema)
    assert P.once(P.sweep(source)).count() == 2
    query = P.compacted(P.stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), checkpoint=str(tmp_path / "check"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_conversations_are_packed_over_batches():
    """Chunks don't depend on where batches are cut."""
    rng = np.random.default_rng(6)
    rows = [(c, t, "User", "w" * int(rng.integers(0, 60)), f"at{t}") for c in range(5) for t in range(int(rng.integers(1, 40)))]
    whole = pd.DataFrame(rows, columns=["conv_id", "turn", "label", "text", "timestamp"])
    want = pd.concat(R._packed(iter([whole]), 120)).reset_index(drop=True)
    for n in (1, 3, 7):
        cut = [whole[i : i + n] for i in range(0, len(whole), n)]
        assert pd.concat([p for p in R._packed(iter(cut), 120) if len(p)]).reset_index(drop=True).astype(str).equals(want.astype(str))
    assert (want["content"].str.len() <= 120).all() and want.groupby("conv_id")["chunk_index"].agg(lambda x: list(x) == list(range(len(x)))).all()
    assert "\n\n".join(want["content"]) == "\n\n".join(f"User: {r[3]}" for r in rows)


def test_ranks_of_large_groups(spark):
    """A group that holds most rows fills many ranges; ranks are those of one sort, also of a null group."""
    rng = np.random.default_rng(1)
    rows = [(["a", "a", "a", "b", None][int(k)], int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 5, 3000), rng.permutation(3000), strict=True))]
    got = {r.i: r["rank"] for r in ranks.ranked(spark.createDataFrame(rows, "g string, v int, i int").repartition(7), "g", "v").collect()}
    for group in ("a", "b", None):
        own = sorted((v, i) for g, v, i in rows if g == group)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert ranks.ranked(spark.createDataFrame([], "g string, v int"), "g", "v").count() == 0


def test_graded_queries_without_hits(spark):
    hits = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (2, 1, 0.0)], "query_id int, rank int, rel double")
    wanted = spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "query_id int, wanted int")
    got = {r.query_id: (r["any"], r["all"], round(r.ndcg, 4)) for r in E.graded(hits, wanted).collect()}
    assert got == {1: (True, True, 0.6309), 2: (False, False, 0.0), 3: (False, False, 0.0)}


def test_budgets_and_covering_ranks_of_many_queries(spark):
    """Against a plain walk: queries without hits or without wants, rooms, points, spans without an end, and batches that cut queries."""
    import random

    from recollect.operators import evaluation as E

    rng = random.Random(6)
    hits = [(q, r, rng.choice("xy"), s := rng.randrange(30), None if rng.random() < 0.05 else s + rng.randrange(12)) for q in range(200) if q % 9 for r in range(1, rng.randrange(2, 9))]
    wanted = [(q, rng.choice("xy"), s := rng.randrange(30), s + rng.randrange(5)) for q in range(200) if q % 7 for _ in range(rng.randrange(1, 3))]
    covered, taken = {}, []
    for q in range(200):
        want, have, spent = [w[1:] for w in wanted if w[0] == q], {}, 0
        own = [h[1:] for h in hits if h[0] == q]
        if want or own:
            covered[q] = None
        for rank, room, s, e in own:
            if e is not None:
                have[room] = E._merge([*have.get(room, []), (s, e)])
            if covered[q] is None and all(any(a <= s and e <= b for a, b in have.get(room, [])) for room, s, e in want):
                covered[q] = rank
        have = {}
        for rank, room, s, e in own:
            add = E._added(have.get(room, []), (s, e)) if e is not None else 0
            if add and spent + add <= 20:
                spent += add
                have[room] = E._merge([*have.get(room, []), (s, e)])
                taken.append((q, rank, add, spent))
    h, w = spark.createDataFrame(hits, "query_id long, rank int, room string, s long, e long"), spark.createDataFrame(wanted, "query_id long, room string, s long, e long")
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(tuple(r) for r in E.selected(h, 20).collect()) == sorted(taken)
        got = E.covering_rank(h, w)
        assert {r.query_id: r["rank"] for r in got.collect()} == covered and got.filter("rank <= 10 and bucket <> 10").isEmpty()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)


def test_chunks_are_located_in_sorted_streams(spark):
    """Sources are gone through in batches, not in a group call each; repeated paragraphs are found where their chunk is."""
    bodies = {"a": "one\n\ntwo\n\none\n\nthree", "b": "one", "é": "ä one\n\none"}
    chunks = [("a", 1, bodies["a"], "one\n\nthree"), ("a", 0, bodies["a"], "one\n\ntwo"), ("b", 0, "one", "one"), ("b", 1, "one", "lost"), ("é", 0, bodies["é"], "ä one"), ("é", 1, bodies["é"], "one")]
    found = R.located_chunks(spark.createDataFrame(chunks, "source string, chunk_index long, body string, content string"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0, 0, 3), ("a", 0, 5, 8), ("a", 1, 5 + 5, 13), ("a", 1, 15, 20), ("b", 0, 0, 3), ("é", 0, 0, 6), ("é", 1, 3, 6)]
