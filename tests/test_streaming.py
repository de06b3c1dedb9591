from datetime import datetime, timedelta

from sparstrata.streaming import runs


def test_closed_windows_are_kept_once(spark, tmp_path):
    day = datetime(2024, 1, 1)
    parts = [
        [(1, 1, 5.0, day), (1, 1, 3.0, day + timedelta(hours=2)), (1, 2, 9.0, day + timedelta(hours=3))],
        [(1, 1, 4.0, day + timedelta(days=1, hours=5)), (2, 1, 1.0, day + timedelta(days=2, hours=5))],
        [(1, 1, 0.5, day)],  # too late
    ]
    for part in parts:
        spark.createDataFrame(part, runs.SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = runs.read_runs(spark, f"file://{tmp_path}/in", 1)
        runs.keep_best_times(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    found = {(r.start, r.matrix, r.plan): (r.n, r.time) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert found[day, 1, 1] == (2, 3.0) and found[day, 1, 2] == (1, 9.0)
    assert found.get((day + timedelta(days=1), 1, 1)) == (1, 4.0) and (day + timedelta(days=2), 2, 1) not in found
