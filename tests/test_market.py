import pytest

from sparstrata.sources import market
from sparstrata.sources.market import read_market, read_rows, write_market, write_rows


def as_set(df):
    return {(r.i, r.j, r.v) for r in df.collect()}


def test_round_trip(spark, tmp_path):
    entries = {(i, i, i + 0.5) for i in range(4000)} | {(3999, 0, -0.1)}
    frame = spark.createDataFrame(sorted(entries), "i long, j long, v double").repartition(3)
    write_market(frame, f"file://{tmp_path}/m", 4000, 4000)
    assert as_set(read_market(spark, f"file://{tmp_path}/m")) == entries
    assert market.market_header(spark, f"file://{tmp_path}/m") == market.Header(4000, 4000, 4001, "real", "general")


def test_symmetric_pattern(spark, tmp_path):
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% a comment\n\n2 2 2\n1 1\n2 1\n")
    assert as_set(read_market(spark, f"file://{tmp_path}/s.mtx")) == {(0, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0)}


def test_complex(spark, tmp_path):
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 2 5\n")
    with pytest.raises(ValueError):
        read_market(spark, f"file://{tmp_path}/c.mtx")
    assert as_set(read_market(spark, f"file://{tmp_path}/c.mtx", real_part=True)) == {(0, 0, 2.0)}


@pytest.mark.parametrize(
    "text",
    [
        "1 1 1\n1 1 1\n",
        "%%MatrixMarket matrix array real general\n1 1\n1\n",
        "%%MatrixMarket matrix coordinate real hermitian\n1 1 1\n1 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n",
        "%%MatrixMarket matrix coordinate real general\n1 1\n1 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n",
        "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1\n",
    ],
)
def test_unsound_files_are_refused(spark, tmp_path, text):
    (tmp_path / "x.mtx").write_text(text)
    with pytest.raises(ValueError):
        read_market(spark, f"file://{tmp_path}/x.mtx")


def test_row_text(spark, tmp_path):
    (tmp_path / "t.csr").write_text("3 4\n0 1 2\n0 1 0 2\n2.0 3.0 0.5 4.0\n")
    assert as_set(read_rows(spark, f"file://{tmp_path}/t.csr")) == {(0, 0, 2.0), (1, 1, 3.0), (2, 0, 0.5), (2, 2, 4.0)}


def test_row_text_round_trip(spark, tmp_path):
    entries = {(i, j, 1 / (i + j + 1)) for i in range(300) for j in (i, i // 2, i // 3)}
    write_rows(spark.createDataFrame(sorted(entries), "i long, j long, v double").repartition(3), f"file://{tmp_path}/r", 300)
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("*/part-*")))
    (tmp_path / "whole.csr").write_text(text)
    assert as_set(read_rows(spark, f"file://{tmp_path}/whole.csr")) == entries


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b,c", 2, 1.5)], "matrix string, m long, time double")
    for _ in range(2):
        market.append_table(rows, f"file://{tmp_path}/log")
    found = market.read_table(spark, f"file://{tmp_path}/log", "matrix string, m long, time double")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, [*rows.collect(), *rows.collect()]))


def test_skew_symmetric(spark, tmp_path):
    (tmp_path / "k.mtx").write_text("%%MatrixMarket matrix coordinate real skew-symmetric\n3 3 2\n2 1 4.5\n3 2 -1\n")
    assert as_set(read_market(spark, f"file://{tmp_path}/k.mtx")) == {(1, 0, 4.5), (0, 1, -4.5), (2, 1, -1.0), (1, 2, 1.0)}


def test_plan_log_goes_by_the_order_of_values(spark, tmp_path):
    (tmp_path / "log.csv").write_text("matrix,tbs,sws,rp,alpha,lp,rg,ws,ls,time\nm,64,1,0,4,0,1,2,0,3.5\n")
    row = market.read_plan_log(spark, f"file://{tmp_path}/log.csv").first()
    assert (row.matrix, row.ls, row.ws, row.rg, row.time) == ("m", 1, 2, 0, 3.5)


def test_row_text_from_many_splits(spark, tmp_path):
    entries = {(i, j, 1 / (i + j + 1)) for i in range(0, 400, 3) for j in (i, i // 2)}
    write_rows(spark.createDataFrame(sorted(entries), "i long, j long, v double").repartition(3), f"file://{tmp_path}/r", 400)
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("*/part-*")))
    (tmp_path / "whole.csr").write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "300b")
    try:
        assert as_set(read_rows(spark, f"file://{tmp_path}/r")) == entries == as_set(read_rows(spark, f"file://{tmp_path}/whole.csr"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (tmp_path / "lines.csr").write_text("\n".join(text.split()))
    assert as_set(read_rows(spark, f"file://{tmp_path}/lines.csr", "\n")) == entries
    (tmp_path / "short.csr").write_text(" ".join(text.split()[:-1]))
    with pytest.raises(ValueError, match="words"):
        read_rows(spark, f"file://{tmp_path}/short.csr")
