"""Files dropped into a folder become ledger partitions and queues, exactly once.

A file belongs to the ledger its folder names, or to a ledger of its own. Every statistic is relative to the whole
ledger, so a batch reads all files of each ledger it touches, new and old: late files, and a file that was written
anew since, take part. Nothing is published before the review of the batch has succeeded, and a repeated batch
overwrites the same partitions. Under ``out``: ``lines``, ``queue``, ``sources`` (file, rows read), ``refused``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.config import LEDGER, Thresholds
from ledgerloom.operators.scale import stage
from ledgerloom.plans.review import build_findings
from ledgerloom.sources.conform import conform
from ledgerloom.sources.files import csv_records, parse_rows, split_header
from ledgerloom.sources.mapping import LedgerError

SOURCES = "ledger_id string, file string, rows_read bigint"
REFUSED = "file string, reason string"


def ledger_name(file: Column, by: str = "file") -> Column:
    """The ledger of a dropped file: its ``folder``, or the ``file`` name without extension."""
    return F.regexp_extract(file, r"([^/]+)/[^/]+$" if by == "folder" else r"([^/]+?)(\.[^./]*)?$", 1)


def recorded(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A table of earlier batches, empty before the first."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*keys).parquet(path)
    return spark.read.schema(schema).parquet(path)


def laid_end_to_end(records: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a ledger's files numbered on from file to file (by path), and the rows of each file.

    Ledgers are named once per file, not per row, and the list of files goes to the rows, not the rows to their file.
    """
    counted = records.groupBy("file").agg(F.max("source_row").alias("rows_read"))
    sizes = stage(counted.select(ledger_name(F.col("file"), by).alias(LEDGER), "file", "rows_read"))
    before = Window.partitionBy(LEDGER).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(LEDGER, "file", F.coalesce(F.sum("rows_read").over(before), F.lit(0)).alias("offset"))
    return records.join(F.broadcast(offsets), "file"), sizes


def conform_files(spark: SparkSession, paths: list[str], by: str) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Files to canonical lines, their source records, and the files refused with the reason.

    Files with equal headers are read together; only first lines come to the driver.
    """
    records, refused = csv_records(spark, paths)
    placed, sizes = laid_end_to_end(records, by)
    first = stage(records.where(F.col("source_row") == 1).select("file", F.col("value").alias("header")))
    heads = first.select("header").distinct().collect()
    landed = None
    for (header,) in heads:
        own = first.where(F.col("header") == header).select("file")
        try:
            rows = parse_rows(placed.join(F.broadcast(own), "file", "left_semi"), split_header(header), [F.col(LEDGER), F.col("offset")])
            lines = conform(rows.withColumn("source_row", F.col("source_row") + F.col("offset")).drop("offset"))[0]
        except LedgerError as problem:
            refused = refused.unionByName(own.withColumn("reason", F.lit(str(problem))))
            continue
        landed = lines if landed is None else landed.unionByName(lines)
    refused = stage(refused)
    return landed, sizes.join(refused, "file", "left_anti").select(LEDGER, "file", "rows_read"), refused


def replace_ledgers(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(LEDGER).parquet(path)


def land_batch(spark: SparkSession, batch: DataFrame, out: str, thresholds: Thresholds, use_model: bool, by: str) -> None:
    new = stage(batch.select("file").distinct().withColumn(LEDGER, ledger_name(F.col("file"), by)))
    old = recorded(spark, f"{out}/sources", SOURCES, (LEDGER,)).join(new.select(LEDGER).distinct(), LEDGER, "left_semi")
    # File names only, which the driver holds for every scan.
    paths = [r[0] for r in new.select("file").union(old.select("file")).distinct().collect()]
    if not paths:
        return
    landed, sources, refused = conform_files(spark, sorted(paths), by)
    known = recorded(spark, f"{out}/refused", REFUSED)
    refused.join(known, ["file", "reason"], "left_anti").write.mode("append").parquet(f"{out}/refused")
    if landed is None:
        return
    lines = stage(landed)
    queue = stage(build_findings(lines, thresholds, use_model=use_model))
    replace_ledgers(lines, f"{out}/lines")
    replace_ledgers(queue, f"{out}/queue")
    replace_ledgers(sources, f"{out}/sources")


def ingest_stream(
    spark: SparkSession, drop: str, out: str, thresholds: Thresholds | None = None, *, use_model: bool = True, by: str = "file"
) -> StreamingQuery:
    """Process what lies in ``drop`` and stop (``availableNow``); checkpoints under ``out``."""
    names = spark.readStream.format("text").load(drop).select(F.col("_metadata.file_path").alias("file"))
    limits = thresholds or Thresholds()
    return (
        names.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(lambda batch, _id: land_batch(spark, batch, out, limits, use_model, by))
        .start()
    )
