"""File sources and JSON round trips."""

import json

from recollect.sources import files


def test_files_and_transcripts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("one\ntwo")
    (tmp_path / ".hidden.md").write_text("no")
    (tmp_path / "b.exe").write_text("no")
    lines = [{"type": "user", "uuid": "m-17", "message": {"content": "where is the ledger?"}}, {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "look", "input": "shelf 4"}]}}, {"type": "summary", "summary": "ledger found"}]
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(lines[0]), "", "broken{", *map(json.dumps, lines[1:])]))
    texts = {r.source.split("/")[-1]: r.text for r in files.text_files(spark, str(tmp_path)).collect()}
    assert set(texts) == {"a.md", "c.jsonl"} and texts["a.md"] == "one\ntwo"
    got = [(r.line, r.role, r.text) for r in files.transcripts(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(1, "user", "where is the ledger?"), (4, "assistant", "[tool_use: look]\nshelf 4"), (5, "summary", "ledger found")]


def test_export_and_import(spark, tmp_path):
    df = spark.createDataFrame([("1", "w", "r", "text"), ("2", "a/b", "r", "text")], "id string, wing string, room string, content string")
    files.export_jsonl(df, str(tmp_path / "out"))
    good, bad = files.import_jsonl(spark, str(tmp_path / "out"), "id string, wing string, room string, content string")
    assert [r.id for r in good.collect()] == ["1"] and bad.count() == 1


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Files cut into many blocks keep their line numbers, empty lines included."""
    texts = {f"f{k}.txt": [("x" * (i * 37 % 211)) + f" {k} {i}" if i % 5 else "" for i in range(700 + k)] for k in range(3)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, lines in texts.items():
        own = sorted((r.line, r.value) for r in got if r.source.endswith(name))
        assert own == list(enumerate(lines))
