"""The registered queries on the smallest tables: against their SQL, or the columns and rows of their contracts."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallyfold.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_context_mixing": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op5_learned_partitions": {"query_id", "rank", "vec_id", "score"},
    "op7_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op13_wrappers": {"page_id", "url", "text", "n_chars"},
}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    frame = __spark_entry__.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    names = list(rel.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_its_contract(spark, duck, name):
    rows = __spark_entry__.queries()[name](spark, SF_DIR).collect()
    assert COLUMNS[name] <= set(rows[0].asDict())
    if name == "op5_learned_partitions":
        assert {r["query_id"] for r in rows} == {r[0] for r in duck.sql("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
        return
    if name == "op13_wrappers":
        assert sorted((r["page_id"], r["url"]) for r in rows) == sorted(duck.sql("SELECT page_id, url FROM pages").fetchall())
        assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
        return
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall())
    if name == "op3_context_mixing":
        assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    if name == "op7_bpe":
        plain = dict(duck.sql("SELECT doc_id, sha256(coalesce(text, '')) FROM documents").fetchall())
        assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == plain
    if name == "op4_license_scan":
        counts = duck.sql(
            r"""SELECT doc_id, len(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM documents"""
        )
        assert {r["doc_id"]: r["n_words"] for r in rows} == dict(counts.fetchall())
    if name == "op8_secret_scan":
        base = lambda r: [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert all(len(base(r)) == r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows)


def test_pipeline_runs_over_its_tables(spark, duck):
    rows = __spark_entry__.queries()["pipeline"](spark, SF_DIR).collect()
    known = {r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall()}
    assert rows and {r["doc_id"] for r in rows} <= known
