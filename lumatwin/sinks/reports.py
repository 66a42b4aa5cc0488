"""Reports as files. A report is written by all tasks, as a folder of parts; ``single`` makes one part of a small one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatwin.operators import reports, selection

# The headings of an exported selection.
SELECTION = ["File ID", "Group ID", "File Path", "File Size", "Role", "Is Selected", "Is Safe Duplicate"]


def to_csv(rows: DataFrame, path: str, fields: list[str] | None = None, separator: str = ",", single: bool = False) -> None:
    text = reports.as_text(rows, fields)
    (text.coalesce(1) if single else text).write.mode("overwrite").csv(path, header=True, sep=separator, quote='"', escape='"', emptyValue="", nullValue="")


def to_json(rows: DataFrame, path: str, fields: list[str] | None = None, now: float | None = None) -> None:
    """A folder with the records as JSON lines, and its metadata (number of records, fields, time) as a JSON line of its own."""
    names = reports.chosen(fields)
    records = rows.select(*names)
    stamp = F.timestamp_micros(F.lit(int(now * 1e6))) if now is not None else F.current_timestamp()
    if "action_timestamp" in names:
        records = records.withColumn("action_timestamp_formatted", F.date_format(F.timestamp_micros((F.col("action_timestamp") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss"))
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/records")
    records.agg(F.count("*").alias("total_records")).select(F.struct("total_records", F.array(*map(F.lit, names)).alias("fields"), stamp.alias("exported_at")).alias("metadata")).write.mode("overwrite").json(f"{path}/metadata")


def both(rows: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Both forms, of rows that are computed once."""
    kept = rows.persist()
    try:
        to_csv(kept, f"{path}/csv", fields)
        to_json(kept, f"{path}/json", fields)
    finally:
        kept.unpersist()


def history(deleted: DataFrame, path: str) -> None:
    """One JSON line for each batch of deleted(batch_id, path, size, method), with its files; a batch of any size is nested by an aggregation, so batches must be small."""
    deleted.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sort_array(F.collect_list(F.struct("path", "size", "method"))).alias("deleted")).write.mode("overwrite").json(path)


def selection_csv(rows: DataFrame, path: str) -> None:
    """The selected rows of a selection with the headings shown."""
    selection.exported(rows).toDF(*SELECTION).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def selection_json(rows: DataFrame, path: str, now: float) -> None:
    """The selected rows as JSON lines, and figures on them as a JSON line of its own."""
    selection.exported(rows).write.mode("overwrite").json(f"{path}/files")
    info = selection.stats(rows).select(F.struct(F.lit(float(now)).alias("timestamp"), F.col("total_selected").alias("total_files"), F.struct("*").alias("selection_stats")).alias("export_info"))
    info.write.mode("overwrite").json(f"{path}/export_info")


def save_figures(row: DataFrame, path: str) -> None:
    """One row of figures as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def load_figures(spark, path: str, schema) -> DataFrame:
    """Figures as they were saved; no row where there are none or they can't be read."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def analyse(spark, table: str) -> None:
    """Statistics of a catalogued table and its columns, for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def compact(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """df rewritten into files of a bounded number of rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
