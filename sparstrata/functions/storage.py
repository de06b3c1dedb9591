"""Written intermediates, so that loops keep short plans and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (as in tests) a temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and fixes columns such as
    ``monotonically_increasing_id`` that a recomputation could change.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, label: str, key: str, order: str | None = None, placed: bool = False) -> DataFrame:
    """As ``written``, in buckets of ``key``: a later join or grouping by it does not shuffle these rows again.

    Buckets are as many as a shuffle has partitions, each in the ``order`` of a
    column. ``placed`` spares the shuffle of rows that a join by the key has just
    brought together. Buckets are found through the session's catalogue; ``forget``
    takes the table out of it. A table that is dealt by the key is given back as it is.
    """
    if getattr(df, "_dealt", (None, None))[1] == key:
        return df
    spark = df.sparkSession
    n, path, name = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark, label), f"dealt_{uuid.uuid4().hex}"
    writer = (df if placed else df.repartition(n, key)).write.bucketBy(n, key)
    (writer.sortBy(order) if order else writer).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    table._dealt = (name, key)
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``written`` or ``dealt`` has returned and that nothing still to run reads."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()} if table is not None else ():
            jvm, jsc = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
        if getattr(table, "_dealt", None):
            table.sparkSession.sql(f"drop table if exists {table._dealt[0]}")
