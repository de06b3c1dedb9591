"""Exact deduplication: tree-merge of sorted digest runs.

Every row becomes a (digest, id) entry of one of ``runs`` runs. Within a run
entries are aggregated to one per digest and written in digest order. Then, in
rounds, ``fan_in`` neighbouring runs are merged into one, until one run is
left. Every level retains, for each digest, the identifier to keep and how many
rows it stands for, and checks that all entries of a digest agree on text
length and on a second, independent hash.

Only DataFrame functions; texts themselves are read once and never shuffled.
A merge is an aggregation on (run, digest): a run is spread over all tasks and
copies are combined before each exchange, so a digest that a third of all rows
share is one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of, with_groups

RUNS = 16
FAN_IN = 4


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, carry: bool = False) -> DataFrame:
    """One written entry per row: id, row number, digest, check hash, length, run.

    With ``carry`` the whole row comes along as struct ``row``.
    """
    text = text_of(text_col)
    columns = [
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("uid"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    entries = docs.select(*columns).withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(runs)).cast("int"))
    return saved(entries, "digests")


def merge_runs(entries: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN, keep: str = "smallest") -> DataFrame:
    """Merge runs level by level; rows (digest, best(id, uid), n_rows) of the last run."""
    pick = {"smallest": F.min, "largest": F.max}[keep]

    def level(df: DataFrame) -> DataFrame:
        found = df.groupBy("run", "digest").agg(
            pick("best").alias("best"),
            F.sum("n_rows").alias("n_rows"),
            F.min("check").alias("check"),
            F.max("check").alias("check_hi"),
            F.min("n_bytes").alias("n_bytes"),
            F.max("n_bytes").alias("n_bytes_hi"),
        )
        agree = (F.col("check") == F.col("check_hi")) & (F.col("n_bytes") == F.col("n_bytes_hi"))
        verified = F.when(agree, F.col("best")).otherwise(F.raise_error(F.lit("texts with one digest differ")))
        found = found.select("run", "digest", verified.alias("best"), "n_rows", "check", "n_bytes")
        return saved(found.sortWithinPartitions("run", "digest"), "runs")

    merged = level(entries.select("run", "digest", F.struct("id", "uid").alias("best"), F.lit(1).cast("long").alias("n_rows"), "check", "n_bytes"))
    while runs > 1:
        runs = -(-runs // fan_in)
        merged = level(merged.withColumn("run", (F.col("run") / fan_in).cast("int")))
    return merged.select("digest", "best", "n_rows")


def _decided(entries: DataFrame, keep: str, runs: int, fan_in: int) -> DataFrame:
    copies = saved(merge_runs(entries, runs, fan_in, keep).where("n_rows > 1"), "copies")
    alone = F.col("n_rows").isNull()
    return with_groups(entries, copies, ["digest"], "n_rows", F.col("uid")).withColumns(
        {
            "keep_id": F.when(alone, F.col("id")).otherwise(F.col("best.id")),
            "kept": alone | (F.col("uid") == F.col("best.uid")),
            "group_size": F.coalesce("n_rows", F.lit(1).cast("long")),
        }
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one per input row.

    Null text counts as empty. Null ids sort before all others. Rows that
    repeat both id and text are separate rows of a group, of which just one is
    kept. An empty table gives no rows; other columns are ignored.
    """
    found = _decided(fingerprints(docs, id_col, text_col, runs), keep, runs, fan_in)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    entries = fingerprints(docs, id_col, text_col, runs, carry=True)
    lost = _decided(entries.drop("row"), keep, runs, fan_in).where(~F.col("kept")).select("uid")
    return entries.join(lost, "uid", "left_anti").select("row.*")
