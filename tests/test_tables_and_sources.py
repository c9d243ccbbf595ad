"""Table functions in Spark SQL, and the data source of lines by byte ranges."""

import datetime as dt
import random

import pytest
from pyspark.errors import AnalysisException

from recollect.functions import table_functions as TF
from recollect.functions import text as X
from recollect.plans import registry
from recollect.sources import line_source as LS
from recollect.streaming import pipelines as P


def test_chunks_are_those_of_the_column_function(spark, sf_dir):
    want = registry.QUERIES["q_chunks"](spark, sf_dir).select("doc_id", "chunk_index", "bytes", "content")
    got = registry.QUERIES["q_chunks_sql"](spark, sf_dir)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_table_functions_take_constants_and_nulls(spark):
    TF.register(spark)
    d = spark.createDataFrame([(1, "one two. " * 40, dt.date(2024, 5, 2)), (2, None, None), (3, "", dt.date(2024, 5, 2)), (4, "Seen yesterday", None)], "id int, t string, d date")
    got = spark.sql("SELECT d.id, c.* FROM {d} d, LATERAL chunks_of(d.t, size => 60, overlap => 10) c WHERE d.id <> 4", d=d).collect()
    assert [r.content for r in got] == X.split_chunks("one two. " * 40, 60, 10) and {r.id for r in got} == {1}
    assert spark.sql("SELECT m.* FROM {d} d, LATERAL mentions_of('yesterday', d.d) m WHERE d.id = 1", d=d).first().resolved == "2024-05-01"
    assert spark.sql("SELECT m.* FROM {d} d, LATERAL mentions_of(d.t, d.d) m WHERE d.id <> 4", d=d).count() == 0
    assert spark.sql("SELECT e.* FROM {d} d, LATERAL entities_of(d.t) e", d=d).columns == ["entity"]
    for bad in ("chunks_of(d.t, size => d.id)", "chunks_of(d.t, size => 5, overlap => 9)", "chunks_of(d.id)", "mentions_of(d.t, d.d, language => 'xx')", "mentions_of(d.t, d.t)"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT x.* FROM {{d}} d, LATERAL {bad} x", d=d).count()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("lines"), random.Random(4)
    texts = {"empty.txt": "", "one.txt": "no end", "ends.txt": "a\n", "blank.txt": "\n\n\n", "crlf.txt": "a\r\nb\r\n", "long.txt": "x" * 5000 + "\n" + "é" * 3000 + "\ny"}
    texts |= {f"sub/r{k}.txt": "".join(rng.choice(["a", "bc", "\n", "é", "\n", "日本"]) for _ in range(rng.randrange(400))) for k in range(4)}
    (path / "sub").mkdir()
    for name, text in texts.items():
        (path / name).write_bytes(text.encode())
    (path / "_skipped.txt").write_text("x\n")
    (path / "other.log").write_text("x\n")
    return path, texts


def _lines(text):
    parts = text.split("\n")
    return [p.removesuffix("\r") for p in (parts[:-1] if parts[-1] == "" else parts)]


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_lines_of_ranges(spark, folder, size, monkeypatch):
    path, texts = folder
    LS.register(spark)
    rows = spark.read.format("text_ranges").option("pattern", "*.txt").option("rangebytes", size if size > 1 else 3).load(str(path))
    got = {}
    for r in LS.numbered(rows).orderBy("source", "line").collect():
        assert r.line == len(got.setdefault(r.source, []))
        got[r.source].append(r.value)
    assert got == {f"{path}/{name}": _lines(t) for name, t in texts.items() if _lines(t)}


def test_ranges_read_in_small_pieces(folder, monkeypatch):
    """Every cut of a file into ranges, pieces of three bytes."""
    path, texts = folder
    monkeypatch.setattr(LS, "PIECE", 3)
    for name in ("crlf.txt", "blank.txt", "one.txt", "sub/r0.txt"):
        size = len(texts[name].encode())
        for step in range(1, 12):
            ranges = [LS._Range(f"{path}/{name}", at, min(at + step, size), size) for at in range(0, size, step)]
            assert [v for r in ranges for _, _, _, v in LS.lines(r)] == _lines(texts[name])


def test_a_stream_reads_whole_lines_once(spark, tmp_path):
    """Files grow between runs, also within a line; each line is read once, when it is whole."""
    LS.register(spark)
    path = tmp_path / "in"
    path.mkdir()
    rows = spark.readStream.format("text_ranges").option("rangebytes", 4).load(str(path))
    seen, out = [], str(tmp_path / "out")

    def run():
        rows.writeStream.foreachBatch(lambda b, n: seen.extend(r.value for r in b.collect())).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()

    (path / "a").write_bytes(b"one\ntwo\nthr")
    run()
    assert sorted(seen) == ["one", "two"]
    with open(path / "a", "ab") as f:
        f.write(b"ee\nfour\n")
    (path / "b").write_bytes(b"five\n")
    run()
    assert sorted(seen) == ["five", "four", "one", "three", "two"]
    run()
    assert len(seen) == 5
    assert P.once(rows).count() == 5


def test_small_ranges_share_tasks_and_are_read_once(tmp_path, monkeypatch):
    """Many small ranges are dealt to few tasks, each line stays with its range, and no range reads far beyond its end."""
    text = [f"line {i} " + "x" * (i % 90) for i in range(6000)]
    (tmp_path / "a.txt").write_text("\n".join(text) + "\n")
    size, read = (tmp_path / "a.txt").stat().st_size, []
    reader = LS._Reader(LS._Folder({"path": str(tmp_path), "rangebytes": "1000"}))
    tasks = reader.partitions()
    assert size // 1000 > 3 * LS.TASKS and len(tasks) <= 2 * LS.TASKS
    pieces = LS._pieces
    monkeypatch.setattr(LS, "TAIL", 512)
    monkeypatch.setattr(LS, "_pieces", lambda *a: (read.append(len(d)) or d for d in pieces(*a)))
    rows = [r for t in tasks for r in reader.read(t)]
    assert [v for *_, v in rows] == text and len({b for _, b, _, _ in rows}) == -(-size // 1000)
    assert all(n == 0 for (_, b, n, _), before in zip(rows[1:], rows, strict=False) if b != before[1])
    assert sum(read) < 2 * size
