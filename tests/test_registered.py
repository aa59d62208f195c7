"""Every registered query on the smallest tables: equal to its SQL, or at least whole and stable."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, con, name):
    ok, text = compare(spark, FOLDER, name, QUERIES[name], SQL[name], con)
    assert ok, text


@pytest.mark.parametrize("name", ["s5_create_snapshot", "s9_list_projections", "s10_predicted_snapshots", "p11_execute_split", "i2_re_embed"])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_query_has_a_callable_and_sql_names_exist():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = {r["set"]: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"train", "val", "test"}
    assert all(0 < r["supported_pairs"] <= r["pairs"] for r in rows.values())
