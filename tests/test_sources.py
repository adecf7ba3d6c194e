import json

import pytest
from pyspark.sql import functions as F

from tallyfold import providers as P
from tallyfold.schemas import over_cap, pair_ok, violations
from tallyfold.sources import files, tables, writers
from tallyfold.streaming import ingest


def test_versions(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"), ["k"])
    table.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 1)
    table.upsert(spark.createDataFrame([("a", 2)], "k string, v int").withColumn("extra", F.lit("x")), 2)
    assert {(r["k"], r["v"], r["extra"]) for r in table.read().collect()} == {("a", 2, "x"), ("b", 1, None)}
    small = table.compact(str(tmp_path / "c"))
    assert small.read().count() == 2
    table.replace(spark.createDataFrame([("z", 9)], "k string, v int"))
    assert [r["k"] for r in table.read().collect()] == ["z"]


def test_jobs(spark):
    manifest = spark.createDataFrame([("f1", "success"), ("f2", "partial")], "file_id string, status string")
    wanted = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file_id string")
    assert sorted(r[0] for r in tables.pending(wanted, manifest, "file_id").collect()) == ["f2", "f3"]
    assert tuple(tables.progress(wanted, manifest, "file_id").first()) == (1, 3)
    jobs = spark.createDataFrame([("a", "completed", 3), ("b", "paused", 1), ("c", "running", 2)], "job_id string, status string, updated_at int")
    assert tables.latest_unfinished(jobs).first()["job_id"] == "c"


def test_files(spark, tmp_path):
    for name, content in (("b.pdf", b"two"), ("a.pdf", b"two"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    found = files.pdf_files(spark, str(tmp_path)).orderBy("name").collect()
    assert [r["name"] for r in found] == ["a.pdf", "b.pdf"] and found[0]["file_hash"] == found[1]["file_hash"]
    (tmp_path / "o.md").write_text("# A\r\n## B")
    assert [r["line"] for r in files.outline_lines(spark, str(tmp_path / "o.md")).orderBy("ord").collect()] == ["# A", "## B"]
    assert [files.source_kind(x) for x in ("x.MD", "x.json", "x.pdf")] == ["outline", "json", "paged"]
    with pytest.raises(ValueError):
        files.source_kind("x.docx")

    def reader(content):
        if content == b"two":
            return [(1, "paragraph", "hello", None), (2, "odd", "x", None), (2, "text", " ", None)]
        raise OSError

    blocks = files.read_blocks(files.pdf_files(spark, str(tmp_path)), reader)
    assert sorted((r["pos"], r["block_type"]) for r in blocks.collect()) == [(0, "text"), (0, "text"), (1, "other"), (1, "other")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("p1", 2, "S", "2", "Why?", ["x", "y"]), ("p1", 1, "S", "1", "How?", [])], "paper_id string, ord int, section string, question_number string, question_text string, options array<string>")
    assert writers.paper_markdown(rows).first()["markdown"] == "# p1\n\n## S\n- 1. How?\n- 2. Why?\n  - A. x\n  - B. y"
    writers.write_json(rows, str(tmp_path / "j"), "paper_id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert writers.type_line({"mcq": 3}).startswith("MCQ: 3 | Short Answer: 0")
    one = spark.createDataFrame([(1,)], "n int")
    assert "| 1 |" in writers.final_report(one, {"T": one}, ["note"])


def test_provider_calls(spark):
    seen = []

    def complete(prompt, room, attempt):
        seen.append(room)
        return '{"a": ' if attempt == 1 else '```json\n{"a": 1}\n```'

    assert P.call(P.Provider("m", complete), "p") == ({"a": 1}, None, 2, False)
    assert seen == [6000, 9000]

    def fails(prompt, room, attempt):
        raise P.classify_error(401, "no")

    assert P.call(P.Provider("m", fails), "p")[1:] == ("no", 1, False)
    assert P.classify_error(429, "free-models-per-day").out_of_quota and P.classify_error(429, "slow down").retryable
    assert P.rotated(["a", "b", "c", "d"], 4) == ["d", "a", "b"]


def test_stream_upserts_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").write.parquet(source)
    table = tables.VersionedTable(spark, str(tmp_path / "t"), ["k"])
    stream = lambda: ingest.stream_table(spark, source, spark.read.parquet(source).schema)
    ingest.upsert_stream(stream(), table, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", 2)], "k string, v int").write.mode("append").parquet(source)
    ingest.upsert_stream(stream(), table, str(tmp_path / "cp")).awaitTermination()
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {("a", 2), ("b", 1)}


def test_rules(spark):
    rows = spark.createDataFrame([("x", "b", "a"), ("y", "a", "b")], "k string, a string, b string")
    assert [tuple(r) for r in violations(rows, "k", {"order": pair_ok(F.col("a"), F.col("b"))}).collect()] == [("x", "order")]
    assert [r["k"] for r in over_cap(spark.createDataFrame([("x",)] * 3 + [("y",)], "k string"), "k", 2).collect()] == ["x"]


def test_rows_of_one_version_and_columns_that_stay(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "v"), ["k"], ["seq"])
    rows = spark.createDataFrame([("a", 1, "z", "first"), ("a", 2, "b", "later")], "k string, seq int, v string, seen string")
    table.upsert(rows, 1)
    assert table.read().first()["v"] == "b"
    new = spark.createDataFrame([("a", 3, "new-seen"), ("n", 3, "now")], "k string, seq int, seen string")
    table.upsert(table.merged(new, ["seen"]), 2)
    assert {r["k"]: (r["v"], r["seen"]) for r in table.read().collect()} == {"a": ("b", "later"), "n": (None, "now")}
