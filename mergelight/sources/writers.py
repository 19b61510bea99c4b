"""Sinks: review payloads, job results, convention profiles, tables of micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.operators.jobs import live_results
from mergelight.session import folder_names, for_one_action, remove_folder
from mergelight.sources.code_tree import put_files


def write_review_payload(payloads: DataFrame, path: str) -> None:
    """Payload parts as Parquet; the JSON text is ready to send as it is."""
    payloads.write.mode("append").parquet(path)


def write_code_tree(files: DataFrame, root: str) -> int:
    """Write each file's content below ``root`` under its name, by the tasks that hold it; how many."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [put_files(root, zip(batch["filename"], batch["content"]))]})

    return files.select("filename", "content").mapInPandas(write, "n BIGINT").agg(F.sum("n")).first()[0] or 0


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write rows to the folder of their batch; a batch that is written again replaces itself."""
    with for_one_action(rows.sparkSession):  # the write makes its own plan
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def write_job_results(results: DataFrame, path: str, completed_at: Column, batch: str = "0") -> None:
    """Finished reviews in one folder per day and batch.

    Only folders that get rows are replaced, so a batch that is written again (with the same
    ``completed_at``) changes nothing, and batches don't touch each other.
    """
    stamped = results.withColumns({"completed_at": completed_at, "batch": F.lit(batch)})
    dated = stamped.withColumn("completed_on", F.to_date("completed_at"))
    # a few files per folder; a day with very many results is split by its measured size
    dated.hint("rebalance", "completed_on").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "completed_on", "batch"
    ).parquet(path)


def read_job_results(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Results of the last day; the folder filter reads at most two days."""
    stored = spark.read.parquet(path)
    recent = stored.filter(F.col("completed_on") >= F.to_date(now) - 1)
    return live_results(recent, now).drop("completed_on", "batch")


def expire_job_results(spark: SparkSession, path: str, today: str) -> list[str]:
    """Remove the folders of days that no result of the last day can lie in; gives their names."""
    days = fixed.CACHE_SECONDS // 86_400
    oldest = spark.range(1).select(F.date_sub(F.lit(today).cast("date"), days).cast("string")).first()[0]
    old = [n for n in folder_names(spark, path) if n.startswith("completed_on=") and n[13:] < oldest]
    for name in old:
        remove_folder(spark, f"{path}/{name}")
    return sorted(old)


def write_conventions(profiles: DataFrame, path: str, learned_at: Column) -> None:
    """Append freshly learned profiles with their time."""
    profiles.withColumn("learned_at", learned_at).write.mode("append").parquet(path)
