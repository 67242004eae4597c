"""Some registered queries next to their SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normal

SF = "/root/testdata/sf0.001"
NAMES = ["event_filter", "insert_ignore", "parse_sshd", "parse_dispatch", "external_ip", "distinct_burst",
         "failures_then_success", "alerts_minute_fold", "incident_priority", "anomaly_top20", "coverage_techniques"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, db, name):
    assert normal(queries()[name](spark, SF).toPandas()) == normal(db.execute(oracle_sql()[name]).df())


def test_entry(spark):
    assert entry(spark).count() > 0
