"""The data source of coordinate text: round trips, ranges of rows, and failed writes."""

import pytest
from pyspark.sql import functions as F

from sparstrata.sources import market_source
from sparstrata.sources.market import read_market


@pytest.fixture(scope="module")
def source(spark):
    market_source.register(spark)
    return spark


def as_set(df):
    return set(map(tuple, df.select("i", "j", "v").collect()))


def test_round_trip_and_ranges(source, tmp_path):
    entries = {(i, j, 1 / (i + j + 1)) for i in range(200) for j in (i, i // 2)}
    a = source.createDataFrame(sorted(entries), "i long, j long, v double").repartitionByRange(4, "i")
    path = f"file://{tmp_path}/m"
    a.write.format("matrix_market").option("m", 200).option("n", 200).mode("append").save(path)
    read = lambda **options: source.read.format("matrix_market").options(**options).load(path)
    assert as_set(read()) == entries == as_set(read(split=100))
    assert as_set(read(split=100).where("i >= 20 and i < 25 and v < 0.03")) == {e for e in entries if 20 <= e[0] < 25 and e[2] < 0.03}
    assert as_set(read().where(F.col("i") == 7)) == {e for e in entries if e[0] == 7}
    reader = market_source.MarketReader(path, 1 << 20)
    whole = len(reader.partitions())
    assert list(reader.pushFilters([market_source.LessThan(("i",), 10)])) == [] and len(reader.partitions()) < whole == 4


def test_files(source, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n\n3 3 3\n1 1 2\n3 2 -1.5\n2 2 1e3\n")
    found = source.read.format("matrix_market").option("split", 5).load(f"{tmp_path}/a.mtx")
    assert as_set(found) == {(0, 0, 2.0), (2, 1, -1.5), (1, 1, 1000.0)} == as_set(read_market(source, f"file://{tmp_path}/a.mtx"))
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n2\n")
    with pytest.raises(Exception, match="not supported"):
        source.read.format("matrix_market").load(f"{tmp_path}/b.mtx").count()


def test_a_failed_task_leaves_no_matrix(source, tmp_path):
    a = source.range(100, numPartitions=4).select(F.col("id").alias("i"), F.col("id").alias("j"), F.when(F.col("id") == 90, F.raise_error(F.lit("lost"))).otherwise(1.0).cast("double").alias("v"))
    path = f"{tmp_path}/broken"
    for rows, why in ((a, "lost"), (source.range(5).selectExpr("id i", "id + 97 j", "1D v"), "not in a matrix")):
        with pytest.raises(Exception, match=why):
            rows.write.format("matrix_market").option("m", 100).option("n", 100).mode("append").save(path)
        with pytest.raises(Exception, match="no whole matrix"):
            source.read.format("matrix_market").load(path).count()
