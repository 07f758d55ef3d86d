"""CSV in and out: tolerant scans, guarded and fully quoted sinks, and a history table kept by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_scan(spark: SparkSession, path: str, delimiter: str | None = None, most: int = 64) -> DataFrame:
    """Quoted CSV with a header: doubled quotes and newlines in quotes, trimmed cells, rows of empty cells dropped, short
    rows padded. Rows may be wider than the header, up to `most` cells: the table is as wide as the widest, and columns
    without a name are called column_5 and so on. Without a delimiter the first lines tell it.

    A file is read by one task, since quotes may hold line ends; a table of many files is read by many.
    """
    if delimiter is None:
        from ..operators.records import csv_delimiter

        lines = "\n".join(r["value"] for r in spark.read.text(path).limit(5).collect())
        delimiter = spark.range(1).select(csv_delimiter(F.lit(lines)).alias("d")).first()["d"]
    cells = [f"c{k}" for k in range(most)]
    raw = spark.read.schema(", ".join(f"{c} string" for c in cells)).csv(path, header=False, sep=delimiter, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", enforceSchema=True)
    first = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = first.columns
    wide = raw.agg(F.max(F.array_max(F.transform(F.array(*cells), lambda c, k: F.when(c.isNotNull(), k + 1))))).first()[0] or 0
    if wide <= len(named):
        return first.dropna("all")
    schema = ", ".join(f"`{n}` string" for n in [*(n.replace("`", "``") for n in named), *(f"column_{k}" for k in range(len(named) + 1, wide + 1))])
    whole = spark.read.schema(schema).csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", enforceSchema=True)
    return whole.dropna("all")


def csv_all_quoted(df: DataFrame, path: str, bom: bool = True) -> None:
    """Write with every field of a row quoted (nulls as empty ones) and CRLF line ends. Each file begins with a byte-order
    mark, unless told otherwise, and the plain names of the columns; an empty table gives one file with these alone."""
    head = F.lit(("\ufeff" if bom else "") + ",".join(df.columns))
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = df.select(F.concat_ws(",", *map(cell, df.columns)).alias("value"))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its partition, which is a file
    lines = rows.select(F.when(number == 0, F.concat_ws("\r\n", head, "value")).otherwise(F.col("value")).alias("value"))
    if df.isEmpty():
        lines = df.sparkSession.range(1).select(head.alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def csv_safe(df: DataFrame, path: str, policy: str = "strict") -> None:
    """Write text columns behind the formula guard of a policy."""
    from ..operators.records import csv_guard

    df.select(*[csv_guard(F.col(c), policy).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def batch_log(runs: DataFrame, path: str) -> None:
    """(name, size, status, out_size, reason) of a batch as CSV, quoted where it is needed."""
    runs.select("name", "size", "status", "out_size", "reason").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def newest(history: DataFrame, user: str, ts: str, tie: str, n: int = 100) -> DataFrame:
    w = Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tie))
    return history.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def streaming_history(stream: DataFrame, path: str, checkpoint: str, user: str, ts: str, tie: str, n: int = 100, parts: int = 16):
    """Keep the newest n rows of each user under `path`; runs until all rows there are read.

    Each batch writes the newest n of its own rows per user to a folder of its own, dealt to `parts` by user, so that a
    trigger costs its rows, not the history, and a replayed batch overwrites its own folder only. read_history merges
    the folders; compact_history makes them one.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        kept = newest(batch.dropDuplicates([user, tie]), user, ts, tie, n)
        kept.withColumn("part", F.pmod(F.xxhash64(user), F.lit(parts))).write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, path: str, schema, user: str, ts: str, tie: str, n: int = 100) -> DataFrame:
    """The newest n rows of each user over all batches; a row that came twice counts once."""
    rows = spark.read.option("basePath", path).option("recursiveFileLookup", "true").schema(schema).parquet(path)
    return newest(rows.dropDuplicates([user, tie]), user, ts, tie, n)


def compact_history(spark: SparkSession, path: str, to: str, schema, user: str, ts: str, tie: str, n: int = 100, parts: int = 16) -> None:
    """Write what read_history gives as one batch under a new path, for the next stream to go on from."""
    rows = read_history(spark, path, schema, user, ts, tie, n)
    rows.withColumn("part", F.pmod(F.xxhash64(user), F.lit(parts))).write.partitionBy("part").parquet(f"{to}/batch=0")
