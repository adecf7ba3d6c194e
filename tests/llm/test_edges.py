"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import stages
from tallyfold.llm.bpe import encode_documents
from tallyfold.llm.contamination import find_contamination
from tallyfold.llm.context_mixing import score_documents
from tallyfold.llm.jaccard_join import shingle_components
from tallyfold.llm.learned_partitions import search_neighbours
from tallyfold.llm.licenses import scan_licenses
from tallyfold.llm.line_runs import dedup_lines
from tallyfold.llm.perspectives import rotate_perspectives
from tallyfold.llm.queries import tokenizer_path
from tallyfold.llm.secret_scan import scan_secrets
from tallyfold.llm.toxicity import score_toxicity, train_toxicity

LONG = "word line " * 40_000 + "x" * 50_000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten"),
    (6, "a"), (6, "a"), (None, "orphan text of nobody"), (7, LONG), (8, "tail\n" + "a line that two share\n" * 3), (9, "A LINE that two share "), (10, "퟿\x00é 𝒳"),
]
EVEN = "CASE WHEN doc_id % 2 = 0 THEN true WHEN doc_id IS NOT NULL THEN NULL END"


@pytest.fixture(scope="module")
def docs(spark):
    """Beside doc_id and text, columns named like those that the operators add or use."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = ["score", "lost", "row", "n_words", "kept_text", "ids", "c0", "component", "token", "n", "kind", "lang", "source"]
    return frame.withColumns({c: F.lit("kept") for c in clash}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (8, 0), (99, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "two three four"), (3, "two three four"), (None, "orphan text"), (4, "line that two share")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "toxicity": lambda d: score_toxicity(d, train_toxicity(d, labels, F.col("doc_id") % 2 == 0)),
        "jaccard": lambda d: shingle_components(d),
        "mixing": lambda d: score_documents(d, F.expr(EVEN)),
        "licenses": lambda d: scan_licenses(d),
        "lines": lambda d: dedup_lines(d),
        "bpe": lambda d: encode_documents(d, tokenizer_path()),
        "secrets": lambda d: scan_secrets(d),
        "contamination": lambda d: find_contamination(d, benchmark),
    }


NAMES = ["toxicity", "jaccard", "mixing", "licenses", "lines", "bpe", "secrets", "contamination"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_comes_back_once(spark, docs, labels, benchmark, name):
    got = operators(labels, benchmark)[name](docs)
    assert len(set(got.columns)) == len(got.columns)
    ids = sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=lambda x: (x is None, x or 0))
    assert ids == sorted((r[0] for r in ROWS), key=lambda x: (x is None, x or 0))


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, docs, labels, benchmark, name):
    got = operators(labels.where("false"), benchmark.where("false"))[name](docs.where("false"))
    assert got.collect() == []


@pytest.mark.parametrize("name", ["lines", "bpe", "contamination", "toxicity"])
def test_other_columns_pass(docs, labels, benchmark, name):
    row = operators(labels, benchmark)[name](docs).where("doc_id = 4").first()
    assert row["c0"] == row["kind"] == row["row"] == "kept"


@pytest.mark.parametrize(("name", "stage"), [("toxicity", stages.drop_toxic), ("lines", stages.drop_repeated_lines), ("copies", stages.keep_one_of_near_copies), ("benchmark", stages.drop_contaminated)])
def test_stages_keep_the_columns(spark, docs, labels, benchmark, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted(r["doc_id"] for r in got.where("doc_id is not null").select("doc_id").collect())
    everything = [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]
    assert kept == {"toxicity": everything, "lines": everything, "copies": [x for x in everything if x != 5], "benchmark": [1, 2, 3, 6, 6, 7, 10]}[name]
    assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_last_stage(spark, docs, tmp_path):
    got = {r["doc_id"]: r["n_tokens"] for r in stages.encode(spark, docs, str(tmp_path)).collect()}
    assert got[1] == got[2] == 0 and got[6] == 1


def test_line_texts(docs):
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert (got[9]["n_dropped"], got[9]["kept_text"]) == (1, "")
    assert (got[8]["n_lines"], got[8]["n_dropped"]) == (5, 0)
    assert (got[5]["kept_text"], got[4]["kept_text"]) == ("", ROWS[3][1])
    assert (got[1]["n_lines"], got[1]["kept_text"]) == (1, "")


def test_jaccard_groups(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in shingle_components(docs).collect()}
    assert {(4, 6, 4, 1), (5, 6, 4, 1), (1, 0, 1, 0), (3, 0, 3, 0), (6, 1, 6, 0)} <= got
    assert any(r[0] is None and r[2] is None and r[3] is None for r in got)


def test_neighbour_edges(spark):
    schema = "vec_id long, embedding array<float>, query_id string, part int"
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]),
        (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (0, [5.0, 5.0]), (9, [-1.0, 3.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in search_neighbours(frame.where("vec_id is null or vec_id <> 0 or embedding[1] = 0"), F.col("vec_id") % 4 == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 2.0), (2, 2, 2.0), (3, 9, -1.0)]
    assert search_neighbours(frame.where("false"), F.col("vec_id") % 4 == 0).collect() == []
    assert search_neighbours(frame.where("vec_id = 9"), F.col("vec_id") == 9).collect() == []


def test_perspective_edges(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, start long"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, 2, None, None), (2, None, "system", ""), (None, 5, "a", "x"), (1, 3, "bob", "yo")]
    got = rotate_perspectives(spark.createDataFrame([(*r, "s", 1) for r in rows], schema)).collect()
    by = {}
    for r in got:
        by.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert sorted(by, key=repr) == sorted([(1, "user"), (1, "unknown"), (1, "bob"), (2, "system"), (None, "a")], key=repr)
    bob = sorted(by[1, "bob"], key=lambda r: r["position"])
    assert "".join(r["segment"] for r in bob) == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=user\nhi<|im_end|>\n<|im_start|>user name=user\nhi<|im_end|>\n"
        "<|im_start|>user name=unknown\n<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    )
    text = "".join(r["segment"] for r in bob)
    assert [text[r["mask_start"] : r["mask_stop"]] for r in bob if r["mask_start"] is not None] == ["yo<|im_end|>\n"]
    assert all(text[r["start"] : r["stop"]] == r["segment"] for r in bob)
    assert rotate_perspectives(spark.createDataFrame([], schema)).collect() == []
