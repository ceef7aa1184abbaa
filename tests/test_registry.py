from __future__ import annotations

import os

import duckdb
import pytest

from graphloom import registry
from tests.oracle import SMALL, TABLES, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_context_of_equal_numbers(spark, tmp_path):
    """What the SQL decides is equal; ties that it leaves open, in the list and in the choice of a parent, go by id."""
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    lines = ", ".join(f"(0, {part}, {supplier}, {number}, {part / 2})" for part, supplier, number in [(9, 5, 1), (3, 7, 1), (6, 5, 1), (8, 2, 4), (1, 4, 4), (2, 0, 2)])
    values = f"(VALUES {lines}) t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)"
    duckdb.sql(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber, l_quantity::DOUBLE AS l_quantity FROM {values}) TO '{tmp_path}/lineitem.parquet'")
    sql = registry.ORACLE_SQL["kg_context"]
    by_id = sql.replace("ORDER BY d, k)", "ORDER BY d, k, v)").replace(", list_append(p.k, e.seq))", ", row(list_append(p.k, e.seq), p.v, e.rel, e.w))")
    assert by_id.count("k, v)") == 1 and by_id.count("row(list_append") == 5
    nodes = same(spark, registry.QUERIES["kg_context"], by_id, str(tmp_path))["listed"][0].split(";")
    assert [n.split(":")[0] for n in nodes if ":contains:" in n] == ["34", "64", "94", "24", "14", "84"]
    assert [n.split(":")[2] for n in nodes if n.startswith("53:")] == ["64"]
