"""Views and table functions for SQL text."""

import random

import pytest

from sparstrata.jobs import sql
from sparstrata.sources import market_source


def test_views_and_functions_agree(spark):
    rng = random.Random(11)
    rows = [(i, i, 4.0) for i in range(60)] + [(i, j, 1.0) for i in range(60) for j in range(i) if i % 5 == j % 5 and rng.random() < 0.3]
    a = spark.createDataFrame(rows, "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i % 3)) for i in range(60)], "i long, b double")
    sql.publish(spark, "small", a, b, solved=True)
    join = "small a join small_pieces p on p.i = a.i join small_sides s on s.i = a.i"
    level = "(select * from triangle_levels(table(select p.piece, a.i, a.j from small a join small_pieces p on p.i = a.i) partition by piece))"
    x = f"(select * from triangle_solve(table(select p.piece, a.i, a.j, a.v, s.b from {join}) partition by piece))"
    assert spark.sql(f"select * from {level} l join small_levels using (i) where l.level = small_levels.level").count() == 60
    assert spark.sql(f"select * from {x} f join small_solution s using (i) where abs(f.x - s.x) < 1e-12").count() == 60
    assert spark.sql(f"select max(abs(y - b)) from (select a.i, sum(v * x) y from small a join {x} f on f.i = a.j group by a.i) join small_sides using (i)").first()[0] < 1e-12
    assert spark.sql("select * from triangle_levels(table(select 1 piece, i, j from small where i < 0) partition by piece)").count() == 0


@pytest.mark.parametrize("rows", ["(1L, 0L, 1D, 1D)", "(0L, 0L, 0D, 1D)", "(0L, 0L, cast(null as double), 1D)", "(0L, 0L, 1D, 1D), (1L, 1L, 1D, 1D), (1L, 0L, 1D, 1D), (0L, 1L, 1D, 1D)"])
def test_unsound_parts_are_refused(spark, rows):
    sql.register(spark)
    with pytest.raises(Exception, match="ValueError"):
        spark.sql(f"select * from triangle_solve(table(select 1 piece, * from values {rows} t(i, j, v, b)) partition by piece)").collect()


def test_a_written_matrix_is_a_view(spark, tmp_path):
    market_source.register(spark)
    a = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0), (1, 1, 4.0)], "i long, j long, v double")
    a.write.format("matrix_market").options(m=2, n=2).mode("append").save(f"{tmp_path}/a")
    sql.register(spark)
    spark.sql(f"create or replace temporary view filed using matrix_market options (path '{tmp_path}/a')")
    found = spark.sql("select * from triangle_solve(table(select 1 piece, i, j, v, 1D b from filed) partition by piece) order by i").collect()
    assert [tuple(r) for r in found] == [(0, 0.5), (1, 0.125)]
