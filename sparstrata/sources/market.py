"""Matrix Market and compressed-row text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparstrata.functions.scan import prefix
from sparstrata.functions.storage import fresh_path, written
from sparstrata.operators.matrix import expand_symmetric, row_pointers


class Header(NamedTuple):
    m: int
    n: int
    nnz: int
    field: str
    symmetry: str


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")]
    return spark.read.text(path).select("value", *place)


def market_header(spark: SparkSession, path: str) -> Header:
    """Sizes and kind of a coordinate file: its banner, and the first line of the same file that is neither comment nor blank.

    Comments between the two fit into the file's first split.
    """
    return _header(_lines(spark, path))[0]


def _header(lines: DataFrame) -> tuple[Header, tuple[str, int]]:
    banner = lines.where(F.col("value").startswith("%%MatrixMarket")).orderBy("line").first()
    if banner is None:
        raise ValueError("no banner")
    words = banner["value"].lower().split()
    if len(words) != 5 or words[1] != "matrix" or words[2] != "coordinate" or words[3] not in ("real", "integer", "pattern", "complex") or words[4] not in ("general", "symmetric", "skew-symmetric", "hermitian"):
        raise ValueError(f"not supported: {banner['value']}")
    if words[4] == "hermitian" and words[3] in ("real", "pattern"):
        raise ValueError(f"not a valid kind: {banner['value']}")
    if words[4] == "skew-symmetric" and words[3] == "pattern":
        raise ValueError(f"not a valid kind: {banner['value']}")
    own = lines.where((F.col("file") == banner["file"]) & (F.col("part") == banner["part"]))
    sizes = own.where(~F.col("value").startswith("%") & (F.trim("value") != "")).orderBy("line").first()
    numbers = [] if sizes is None else sizes["value"].split()
    if len(numbers) != 3 or not all(x.isdigit() for x in numbers):
        raise ValueError("no sizes")
    return Header(*map(int, numbers), words[3], words[4]), (sizes["file"], sizes["line"])


def read_market(spark: SparkSession, path: str, real_part: bool = False) -> DataFrame:
    """(i, j, v), 0-based, of a coordinate file or a folder of its pieces; symmetric and skew-symmetric ones are expanded, pattern entries are 1.

    The number of entries and the range of their indices are checked against the
    sizes. Complex values are refused, or with ``real_part`` lose the other part.
    """
    lines = _lines(spark, path)
    header, (file, line) = _header(lines)
    if header.field == "complex" and not real_part:
        raise ValueError("complex values")
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "") & ~((F.col("file") == file) & (F.col("line") == line)))
    p = F.split(F.trim("value"), "\\s+")
    token = lambda k, kind: F.get(p, F.lit(k)).try_cast(kind)
    value = F.lit(1.0) if header.field == "pattern" else token(2, "double")
    entries = body.select((token(0, "long") - 1).alias("i"), (token(1, "long") - 1).alias("j"), value.alias("v"))
    fine = F.col("i").between(0, header.m - 1) & F.col("j").between(0, header.n - 1) & F.col("v").isNotNull()
    count, sound = entries.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(fine, F.lit(False)).cast("long")), F.lit(0))).first()
    if count != header.nnz or sound != count:
        raise ValueError(f"{count} entries of which {count - sound} are not in range, where {header.nnz} were announced")
    if header.symmetry == "skew-symmetric":
        # the diagonal is zero and not stored
        return entries.unionByName(entries.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v")))
    return entries if header.symmetry == "general" else expand_symmetric(entries)


def write_market(a: DataFrame, path: str, m: int, n: int) -> None:
    """A folder that ``read_market`` reads: banner and sizes in one file, entries in others."""
    spark = a.sparkSession
    head = spark.range(1).select(F.lit(f"%%MatrixMarket matrix coordinate real general\n{m} {n} {a.count()}").alias("value"))
    head.coalesce(1).write.mode("overwrite").text(path)
    a.select(F.format_string("%d %d %.17g", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value")).write.mode("append").text(path)


def write_rows(a: DataFrame, path: str, m: int) -> None:
    """Compressed-row text in four folders, whose files in order of their names are one file of the format.

    Sizes, row pointers without the last, columns, and values in full precision,
    apart by blanks; the diagonal is last in its row. Each folder is sorted as a whole.
    """
    spark = a.sparkSession
    put = lambda rows, name: rows.write.mode("overwrite").option("lineSep", " ").text(f"{path}/{name}")
    put(spark.range(1).select(F.lit(f"{m} {a.count()}").alias("value")).coalesce(1), "0-sizes")
    put(row_pointers(a, m).repartitionByRange("i").sortWithinPartitions("i").select(F.col("ptr").cast("string").alias("value")), "1-pointers")
    order = [F.col("i"), F.expr("i = j"), F.col("j")]
    # both files come from one sorted table, so that they agree in order
    entries = written(a.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "row-text")
    sorted_again = entries.repartitionByRange("at").sortWithinPartitions("at")
    put(sorted_again.select(F.col("j").cast("string").alias("value")), "2-columns")
    put(sorted_again.select(F.format_string("%.17g", "v").alias("value")), "3-values")


def _numbered_tokens(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(place, token) of the words of a file, or of all files below a folder in order of their names.

    Records are numbered inside their splits and splits by the sums of those
    before; a record's words are numbered by a prefix scan. The driver sees
    a row for each split.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at")]
    read = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).text(path)
    records = written(read.select("value", *place), "tokens")
    splits = records.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()
    bases, before = [], 0
    for file, part, n, first in sorted(map(tuple, splits)):
        bases.append((file, part, before - first))
        before += n
    shift = F.broadcast(spark.createDataFrame(bases, "file string, part long, shift long"))
    words = F.filter(F.split("value", "\\s+"), lambda x: x != "")
    numbered = records.join(shift, ["file", "part"]).select((F.col("at") + F.col("shift")).alias("record"), words.alias("words"))
    placed = prefix(numbered.withColumn("n", F.size("words").cast("long")), "record", "n", "start")
    return placed.select("start", F.posexplode("words").alias("k", "token")).select((F.col("start") + F.col("k")).alias("place"), "token")


def read_rows(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """(i, j, v) of compressed-row text: sizes, row pointers, columns, values.

    Reads a file of the format or the folder that ``write_rows`` makes. Words end at
    the separator or at any other white space; a file is split at separators
    alone, so one whose words stand in lines of their own is read with a line feed.
    Fewer or more words than the sizes announce raise an error.
    """
    tokens = written(_numbered_tokens(spark, path, separator), "places")
    sizes = {r["place"]: int(r["token"]) for r in tokens.where("place < 2").collect()}
    if len(sizes) < 2:
        raise ValueError("no sizes")
    m, nnz = sizes[0], sizes[1]
    if (n := tokens.count()) != 2 + m + 2 * nnz:
        raise ValueError(f"{n} words where {2 + m + 2 * nnz} were announced")
    section = lambda first, size, name, kind: tokens.where(F.col("place").between(first, first + size - 1)).select((F.col("place") - first).alias("k"), F.col("token").cast(kind).alias(name))
    starts = section(2, m, "start", "long").withColumnRenamed("k", "i")
    following = starts.select((F.col("i") - 1).alias("i"), F.col("start").alias("stop"))
    filled = starts.join(following, "i", "left").where(F.coalesce("stop", F.lit(nnz)) > F.col("start")).select(F.col("start").alias("k"), "i")
    entries = section(2 + m, nnz, "j", "long").join(section(2 + m + nnz, nnz, "v", "double"), "k").join(filled, "k", "left")
    # a row begins where its pointer points, and goes on to the next that is not empty
    return prefix(entries, "k", "i", "before", "max").select(F.coalesce("i", "before").alias("i"), "j", "v")


def append_table(rows: DataFrame, path: str) -> None:
    """Append a table of features, runs or plans as CSV with its column names."""
    rows.write.mode("append").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that ``append_table`` has written, by the names of its columns."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


#: Logs of plans hold their values in this order, whatever order their header names.
PLAN_LOG = "matrix string, tbs int, sws int, rp int, alpha int, lp int, ls int, ws int, rg int, time double"


def read_plan_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of plans as CSV, by the order of its values; its header line, which may name another order, is skipped."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(PLAN_LOG).csv(path)


def market_round_trip(a: DataFrame, m: int) -> DataFrame:
    """A matrix written to the shared folder as coordinate text and read back."""
    path = fresh_path(a.sparkSession, "market")
    write_market(a, path, m, m)
    return read_market(a.sparkSession, path)


def rows_round_trip(a: DataFrame, m: int) -> DataFrame:
    """A matrix written to the shared folder as compressed-row text and read back."""
    path = fresh_path(a.sparkSession, "rows")
    write_rows(a, path, m)
    return read_rows(a.sparkSession, path)
