"""The queries that have SQL give DuckDB's rows, names and types; all have a stable schema."""

import os

import duckdb
import pytest

from turnstone.llm import queries

SF = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "labels"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, oracle, name):
    df, want = queries.QUERIES[name](spark, SF), oracle.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert {c: TYPES[str(t)] for c, t in zip(want.columns, want.types)} == dict(df.dtypes)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


CONTRACT = {
    "op1": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op3": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op9": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op11": {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint"),
    "op12": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns(spark, name):
    found = dict(queries.QUERIES[name](spark, SF).dtypes)
    assert CONTRACT[name.partition("_")[0]].items() <= found.items()
