"""The registered queries: columns, types and rows of their results on the smallest tables."""

import os

import pytest

pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

COLUMNS = {
    "op1_": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_": "page_id bigint, url string, text string, n_chars bigint",
    "op8_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_": "page_id bigint, host string, path string, rule string, verdict string",
}


@pytest.mark.parametrize("prefix", COLUMNS)
def test_columns_and_rows(spark, prefix):
    from kindred.llm.queries import QUERIES

    out = next(f for name, f in QUERIES.items() if name.startswith(prefix))(spark, DIR)
    assert {c: t for c, t in out.dtypes} == dict(c.split(" ") for c in COLUMNS[prefix].split(", "))
    rows = out.collect()
    if prefix == "op9_":
        asked = spark.read.parquet(f"{DIR}/embeddings.parquet").where("vec_id % 50 = 0").count()
        assert len(rows) == 5 * asked and {r["rank"] for r in rows} == {1, 2, 3, 4, 5}
        return
    table, key = ("pages", "page_id") if prefix in ("op6_", "op10_") else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).collect())
    if prefix == "op3_":
        assert sorted(r["doc_id"] for r in rows if r["start"] == 0) == ids
    else:
        assert sorted(r[key] for r in rows) == ids
