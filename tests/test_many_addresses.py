"""Queries with their SQL on events of users beyond 65,535, whose names in the tables are no valid addresses."""

from datetime import datetime, timedelta

import pytest

duckdb = pytest.importorskip("duckdb")

NAMES = ["field_ip_hex", "normalize_accepted", "normalize_rejected", "ingest_errors", "ingest_report", "access_outcomes", "canonical_addresses", "parse_caddy_failed_login", "parse_combined", "parse_json_access", "parse_json_override", "parse_traefik", "brute_force_top_ips"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("many"))
    kinds = ["click", "view", "error", "signup", "purchase"]
    rows = [(i, datetime(2024, 1, 2) + timedelta(minutes=7 * i), 65_530 + i % 13, "error" if i > 60 else kinds[i % 5], 1.0, f'{{"k": {i % 97}}}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{where}/events.parquet")
    return where


@pytest.mark.parametrize("name", NAMES)
def test_addresses_beyond_the_third_number(spark, tables, name):
    from __spark_entry__ import oracle_sql, queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{tables}/events.parquet/*.parquet'")
    result = db.execute(oracle_sql()[name])
    columns, want = [c[0] for c in result.description], result.fetchall()
    got = [tuple(r[c] for c in columns) for r in queries()[name](spark, tables).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want)
