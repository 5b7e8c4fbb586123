"""The registered queries: names, columns, DuckDB parity on whole tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from paperweave.llm.queries import ORACLES, QUERIES

COLUMNS = {
    1: "doc_id n_shingles component_id",
    2: "doc_id n_words n_hit n_items items_sha256 contaminated",
    3: "doc_id held_out score predicted",
    4: "doc_id n_lines n_dropped kept_sha256",
    5: "doc_id n_assign n_access n_hex base_sha256 spans",
    6: "doc_id n_bytes n_tokens over_limit",
    7: "doc_id size text_crc32 law shard slot grown_shard",
    8: "doc_id n_words n_removed kept_sha256",
    9: "doc_id keep_id group_size kept text_sha256",
    10: "doc_id size source_size target taken",
    11: "client_id version valid_from valid_to is_deleted source segment city balance_cents first_seq n_changes",
    12: "page_id record_type payload_bytes payload_digest refers_to",
    13: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == COLUMNS[int(re.match(r"op(\d+)_", name)[1])].split()
    got = df.collect()
    if not name.startswith("op11_"):
        assert len(got) == spark.read.parquet(f"{sf}/{'pages' if name.startswith('op12_') else 'documents'}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "client_changes"):
            path = f"{sf}/{t}.parquet"
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        r = con.sql(ORACLES[name])
        at = [r.columns.index(c) for c in df.columns]
        assert sorted(map(tuple, got), key=repr) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
