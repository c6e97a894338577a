"""The registered queries on the smallest tables: columns and types as agreed, and SQL twins where there are any."""

import os
import re

import pytest

from lakeshore.llm import queries

SF = "/root/testdata/sf0.001"
AGREED = {
    "op1_planes": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_tiff": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_suffixes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_chosen_path": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_linelabels": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op13_periodic": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", AGREED)
def test_registered_query(spark, con, name):
    got = queries.REGISTRY.queries[name](spark, SF)
    assert [f"{n} {kind}" for n, kind in got.dtypes][: AGREED[name].count(",") + 1] == re.split(", ", AGREED[name])
    rows = [tuple(r) for r in got.collect()]
    table, key, each = {"op4_warc": ("pages", "page_id", 1), "op11_whitening": ("embeddings", "vec_id", 16)}.get(name, ("documents", "doc_id", 1))
    ids = [r[0] for r in con.sql(f"SELECT {key} FROM {table}").fetchall() for _ in range(each)]
    assert sorted(r[0] for r in rows) == sorted(ids)
    if name in queries.REGISTRY.oracles:
        want = con.sql(queries.REGISTRY.oracles[name])
        assert sorted(map(str, [tuple(r) for r in want.select(*got.columns).fetchall()])) == sorted(map(str, rows))
