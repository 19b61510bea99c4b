"""Streams of review events, job states, files, findings and conventions.

Stateless streams apply the batch operator itself, the others keep state per key or in tables
written per micro-batch; a stream that has read everything equals its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mergelight import fixed, schemas
from mergelight.operators.files import analyzable_files, reviewable_files
from mergelight.operators.findings import cluster_findings, merge_findings, rank_findings
from mergelight.operators.jobs import review_jobs
from mergelight.operators.ranking import line_islands, range_rank
from mergelight.operators.text import scan_security_rules
from mergelight.session import by_merge, drop_unused
from mergelight.sources.writers import write_batch
from mergelight.streaming.processors import REFRESH_OUT, STATUS_OUT, NewestStatus, ProfileAge


def keep_state(spark: SparkSession) -> None:
    """State of keyed streams lies in RocksDB: on disk, however many keys there are."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def stream_review_jobs(
    events: DataFrame, secret: str | None, path: str, checkpoint: str,
    redelivery: str | None = None,
) -> StreamingQuery:
    """Events to job rows in Parquet.

    Without ``redelivery`` the stream is stateless: an event sent twice gives two rows.  With a
    time such as ``"1 hour"`` a pull request's commit that was queued within that time is not queued
    again, and events older than that are too late; state is dropped as time goes on.
    """
    jobs = review_jobs(events, secret)
    if redelivery is not None:
        keep_state(events.sparkSession)
        jobs = jobs.withWatermark("created_at", redelivery).dropDuplicatesWithinWatermark(
            ["repo", "pr_number", "head_sha"]
        )
    return (
        jobs.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_job_status(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Newest status per job, from updates (job_id, ts, status, result) in any order.

    State is keyed by job; only jobs whose status changed go out.  Every micro-batch has a
    folder of its own, written anew if the batch runs again, and ``read_job_status`` gives
    the newest row of each job.
    """
    keep_state(updates.sparkSession)
    timed = updates.select("job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "status", "result")
    changed = timed.groupBy("job_id").transformWithState(
        NewestStatus(), STATUS_OUT, outputMode="Update", timeMode="None"
    )

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return (
        changed.writeStream.foreachBatch(upsert).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_job_status(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each job that ``stream_job_status`` has written."""
    stored = spark.read.schema(f"{STATUS_OUT}, batch BIGINT").parquet(path)
    newest = F.max_by(F.struct("status", "result", "at"), F.struct("at", "status", "batch"))
    return stored.groupBy("job_id").agg(newest.alias("now")).select(
        "job_id", "now.status", "now.result", F.timestamp_micros("now.at").alias("updated_at")
    )


def stream_rule_findings(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rule hits of a stream of changed files; the scan is stateless."""
    found = scan_security_rules(analyzable_files(reviewable_files(files)))
    return (
        found.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


FINDING_STORE = f"{schemas.FINDINGS.replace('seq BIGINT', 'seq ' + schemas.FINDING_ORDER)}, batch BIGINT"


def _touched(stored: DataFrame, batch_id: int) -> DataFrame:
    """Stored findings that a batch can change, with the run of lines they lie in.

    Similar findings are at most three lines apart, so only runs of lines with a finding of
    the batch can cluster anew.  Findings without a job, file or line are never clustered with others.
    """
    file, reach = ["job_id", "file_path"], fixed.LINE_PROXIMITY
    new = F.col("batch") == batch_id
    has_place = F.col("job_id").isNotNull() & F.col("file_path").isNotNull() & F.col("line_number").isNotNull()
    files = stored.filter(new & has_place).select(*file).distinct()
    placed = stored.filter(has_place)
    lines = placed.join(by_merge(files), file, "left_semi").groupBy(*file, "line_number").agg(F.bool_or(new).alias("new"))
    runs = line_islands(lines, file, "line_number", reach)
    ends = runs.groupBy(*file, "island").agg(
        F.max("line_number").alias("island_end"), F.bool_or("new").alias("new")
    ).filter("new").drop("new")
    spots = runs.drop("new").join(ends, [*file, "island"])
    alone = stored.filter(new & ~has_place).withColumns({
        "island": F.lit(None).cast("bigint"), "island_end": F.lit(None).cast("bigint"),
    })
    return placed.join(spots, [*file, "line_number"]).unionByName(alone)


def merge_batch(spark: SparkSession, store: str, merged: str, batch_id: int) -> None:
    """Cluster what a batch of stored findings touches anew, and write the result under its number."""
    stored = spark.read.schema(FINDING_STORE).parquet(store).filter(F.col("batch") <= batch_id)
    drop_unused(spark)  # what the batches before have kept
    ranked = range_rank(_touched(stored, batch_id), "job_id", ["seq", "agent", "id"], "_number")
    numbered = ranked.withColumnsRenamed({"seq": "_order", "_number": "seq"})
    clusters = merge_findings(cluster_findings(numbered.drop("_order", "island", "island_end", "batch")))
    seeds = numbered.select("job_id", "seq", "_order", "island", "island_end")
    placed = clusters.join(by_merge(seeds), ["job_id", "seq"]).withColumn("seq", F.col("_order")).drop("_order")
    write_batch(placed, merged, batch_id)


def stream_merged_findings(findings: DataFrame, store: str, merged: str, checkpoint: str) -> StreamingQuery:
    """Keep findings of detectors and cluster, merge anew what each micro-batch touches.

    A job's findings may come in any number of batches: runs of lines that get a finding are
    clustered again from the stored table.  Both folders are written per batch number, so a
    batch that runs again changes nothing.  ``read_merged_findings`` ranks the newest state.
    """
    spark = findings.sparkSession

    def review(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, store, batch_id)
        merge_batch(spark, store, merged, batch_id)

    return (
        findings.writeStream.foreachBatch(review).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_merged_findings(spark: SparkSession, merged: str) -> DataFrame:
    """Merged findings as they stand now, ranked per job.

    A run of lines only grows, so a result is outdated when a later batch clustered a run
    that holds its place; the newest run of each place is looked up by file.
    """
    rows = spark.read.parquet(merged)
    file = ["job_id", "file_path"]
    runs = rows.filter(F.col("island").isNotNull()).select(*file, "batch", "island", "island_end").distinct()
    later = runs.toDF(*file, "_batch", "_island", "_end")
    same = [rows[c] == later[c] for c in file]
    outdated = (
        (later["_batch"] > rows["batch"]) & (later["_island"] <= rows["island"]) & (rows["island"] <= later["_end"])
    )
    current = rows.join(later, [*same, outdated], "left_anti")
    return rank_findings(current.drop("batch", "island", "island_end"))


def stream_repos_to_refresh(
    profiles: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
    seconds: int = fixed.CACHE_SECONDS,
) -> StreamingQuery:
    """Repositories whose newest profile is older than ``seconds``, one row each time it expires.

    State keeps the time of the newest profile per repo with a timer; several profiles of a
    repo leave one timer.  ``write`` gets the rows (repo, learned_at, expired_at) of a micro-batch,
    which ``repo_conventions`` of the review plan learns anew.
    """
    keep_state(profiles.sparkSession)
    timed = profiles.select(
        "repo", "learned_at", F.unix_micros(F.col("learned_at").cast("timestamp")).alias("learned")
    ).withWatermark("learned_at", "0 seconds")
    expired = timed.groupBy("repo").transformWithState(
        ProfileAge(seconds), REFRESH_OUT, outputMode="Update", timeMode="EventTime"
    )

    def refresh(batch: DataFrame, batch_id: int) -> None:
        learned_at = F.timestamp_micros("learned")
        write(batch.select(
            "repo", learned_at.alias("learned_at"), F.timestamp_micros(F.col("learned") + seconds * 1_000_000).alias("expired_at")
        ), batch_id)

    return (
        expired.writeStream.foreachBatch(refresh).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
