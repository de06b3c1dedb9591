"""Every registered query of the main library against its SQL, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from sparstrata.jobs import catalog

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    key = lambda r: tuple(str(x) for x in r)
    return [names[k] for k in order], sorted((tuple(r[k] for k in order) for r in rows), key=key)


def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = tables().sql(catalog.ORACLES[name])
    wanted = rows_of(rel.columns, rel.fetchall())
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1])
    for a, b in zip(found[1], wanted[1], strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12), (a, b)
