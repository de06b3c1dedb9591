"""The SQL of groups without dependencies knows 2 ** 20 starts; the code, like a plain scan, has no such end."""

import duckdb
import pytest

from sparstrata.jobs import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, entries", [("group_nodep", "f1"), ("order_nodep", "oe")])
def test_groups_go_on_behind_the_last_start_that_the_sql_knows(spark, name, entries):
    con, sql, start = duckdb.connect(), catalog.ORACLES[name], catalog._starts()
    for table in ("supplier", "part", "orders", "customer", "lineitem"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert start in sql
    nearest = dict(con.execute(f"{sql.split(', pr as (')[0]} select i, coalesce(max(case when j < i then j end), -1) from {entries} group by i").fetchall())
    wanted, s = {}, 0
    for i in sorted(nearest):
        s = i if i - s >= 8 or nearest[i] >= s else s
        wanted[i] = s
    found = {r.i: r.g for r in catalog.QUERIES[name](spark, SF).collect()}
    told = lambda k: {i: g for i, _, g in con.execute(sql.replace(start, catalog._starts(k))).fetchall()}
    assert found == wanted == told(20)
    starts = sorted(set(wanted.values()))
    assert len(starts) > 64
    short = told(6)
    assert {i for i in found if short[i] != found[i]} == {i for i in found if i >= starts[64]}
