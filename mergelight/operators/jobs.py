"""Review events and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.signature import signature_of
from mergelight.functions.text import json_field

HANDLED_ACTIONS = ["opened", "synchronize"]
CALL_WINDOW_MICROS = 60_000_000


def verify_signature(events: DataFrame, secret: str | None) -> DataFrame:
    """Add ``verified``: 200, 401 for a wrong signature, 503 when no secret is set."""
    if not secret:
        return events.withColumn("verified", F.lit(503))
    right = F.coalesce(F.col("signature"), F.lit("")) == signature_of(F.col("body"), secret)
    return events.withColumn("verified", F.when(right, 200).otherwise(401))


def classify_event(events: DataFrame) -> DataFrame:
    """Add ``status`` and ``reason``: rejected, bad_request, pong, ignored or queued."""
    action = json_field(F.col("body"), "$.action", "")
    kind = F.col("event_type")
    verified = F.col("verified") if "verified" in events.columns else F.lit(200)
    wanted = action.isin(HANDLED_ACTIONS)
    handled = kind == "pull_request"
    status = (
        F.when(verified != 200, "rejected")
        .when(F.try_parse_json("body").isNull(), "bad_request")
        .when(kind == "ping", "pong")
        .when(handled & wanted, "queued")
        .otherwise("ignored")
    )
    reason = F.when(
        ~handled, F.concat(F.lit("Event type '"), kind, F.lit("' not handled"))
    ).otherwise(F.concat(F.lit("Action '"), action, F.lit("' not handled")))
    marked = events.withColumn("status", status)
    return marked.withColumn("reason", F.when(F.col("status") == "ignored", reason))


def project_review_job(queued: DataFrame) -> DataFrame:
    """Review jobs of queued events; absent fields become empty text or 0."""
    body = F.col("body")
    return queued.select(
        F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), body), 256).alias("job_id"),
        json_field(body, "$.repository.full_name", "").alias("repo"),
        json_field(body, "$.pull_request.number", 0).cast("int").alias("pr_number"),
        json_field(body, "$.pull_request.title", "").alias("pr_title"),
        json_field(body, "$.pull_request.head.sha", "").alias("head_sha"),
        json_field(body, "$.pull_request.base.sha", "").alias("base_sha"),
        json_field(body, "$.installation.id", 0).alias("installation_id"),
        F.col("ts").alias("created_at"),
        F.lit("queued").alias("status"),
    )


def review_jobs(events: DataFrame, secret: str | None) -> DataFrame:
    """Events to jobs: verify, classify, keep what is queued, project."""
    classified = classify_event(verify_signature(events, secret))
    return project_review_job(classified.filter(F.col("status") == "queued"))


def latest_job_status(updates: DataFrame) -> DataFrame:
    """Newest status per job out of (job_id, ts, status, result) updates.

    ``max_by`` combines before the shuffle, so a job with very many updates is cheap.
    """
    newest = F.max_by(F.struct("status", "result", "ts"), F.struct("ts", "status"))
    return updates.groupBy("job_id").agg(newest.alias("now")).select(
        "job_id", "now.status", "now.result", F.col("now.ts").alias("updated_at")
    )


def jobs_with_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Job records with their latest status and result; unknown where there is none.

    Of several results of a job, the one completed last counts.
    """
    values = [c for c in results.columns if c != "job_id"]
    order = [c for c in ("completed_at",) if c in values]
    newest = F.max_by(F.struct(*values), F.struct(*order, F.xxhash64(*values)))
    known = results.groupBy("job_id").agg(newest.alias("_newest")).select(
        "job_id", F.col("_newest.status").alias("known_status"),
        *[f"_newest.{c}" for c in values if c != "status"],
    )
    return (
        jobs.drop("status").join(known, "job_id", "left")
        .withColumn("status", F.coalesce("known_status", F.lit("unknown")))
        .drop("known_status")
    )


def recent_jobs(jobs: DataFrame, limit: int = fixed.RECENT_JOBS) -> DataFrame:
    """The newest jobs first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def dashboard_stats(jobs: DataFrame, limit: int = fixed.RECENT_JOBS) -> DataFrame:
    """Over the newest jobs: reviews, severe findings, critical findings, mean time."""
    critical = F.coalesce("critical_count", F.lit(0))
    high = F.coalesce("high_count", F.lit(0))
    seconds = F.nullif("processing_time_seconds", F.lit(0.0))
    return recent_jobs(jobs, limit).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.coalesce(F.sum(critical + high), F.lit(0)).alias("bugs_found"),
        F.coalesce(F.sum(critical), F.lit(0)).alias("security_issues"),
        F.avg(seconds).alias("avg_seconds"),
    )


def call_rate_check(
    calls: DataFrame, key: str, ts: str, limit: int = fixed.CALLS_PER_MINUTE
) -> DataFrame:
    """Add ``calls_before`` (earlier calls in the last 60 seconds) and ``limited``.

    Calls are counted per key and microsecond first.  Counts are then cut in minutes, each
    minute also seeing the one before, so a busy key is spread over many small windows.  The calls
    of a minute are a difference of two running sums, which each row adds to once.
    Calls without a key are those of one more key; a call without a time has none before it.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    counted = calls.groupBy(key, at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    own = F.floor(F.col("at") / CALL_WINDOW_MICROS)
    spread = counted.select(
        key, "at", "n", F.explode(F.array(own, own + 1)).alias("minute")
    )
    along = Window.partitionBy(key, "minute").orderBy("at")

    def calls_until(micros: int) -> Column:
        up_to = along.rangeBetween(Window.unboundedPreceding, -micros)
        return F.coalesce(F.sum("n").over(up_to), F.lit(0))

    rated = (
        spread.withColumn("calls_before", calls_until(1) - calls_until(CALL_WINDOW_MICROS))
        .filter(F.col("minute") == own)
        .select(key, "at", "calls_before")
    )
    known = rated.select(F.col(key).alias("_key"), F.col("at").alias("_at"), "calls_before")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("at") == F.col("_at"))
    return (
        calls.withColumn("at", at).join(known, same, "left").drop("at", "_key", "_at")
        .withColumn("calls_before", F.coalesce("calls_before", F.lit(0)))
        .withColumn("limited", F.col("calls_before") >= limit)
    )


def live_results(results: DataFrame, now: Column) -> DataFrame:
    """Results kept for a day after they were completed."""
    oldest = now - F.expr(f"INTERVAL {fixed.CACHE_SECONDS} SECONDS")
    return results.filter(F.col("completed_at") > oldest)
