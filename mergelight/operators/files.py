"""File table: filter, filter statistics, priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelight.functions.files import (
    detect_language,
    is_analyzable,
    is_test_file,
    review_reason,
)
from mergelight.operators.ranking import range_rank
from mergelight.session import by_merge


def with_review_reason(files: DataFrame) -> DataFrame:
    """Fill the language where it is missing, then name the reason to leave a file out."""
    if "language" in files.columns:
        given = F.when(F.col("language") != "", F.col("language"))
    else:
        given = F.lit(None).cast("string")
    filled = files.withColumn("language", F.coalesce(given, detect_language(F.col("filename"))))
    reason = review_reason(*map(F.col, ["filename", "status", "content", "language"]))
    return filled.withColumn("reason", reason)


def reviewable_files(files: DataFrame) -> DataFrame:
    """Files that are neither removed, binary, empty, too large, unsupported nor generated."""
    return with_review_reason(files).filter(F.col("reason").isNull()).drop("reason")


def analyzable_files(files: DataFrame) -> DataFrame:
    """Files with content in a supported language."""
    return files.filter(is_analyzable(F.col("content"), F.col("language")))


def coverage_source_files(files: DataFrame) -> DataFrame:
    """Analyzable files that are not tests themselves."""
    return analyzable_files(files).filter(~is_test_file(F.col("filename")))


def skip_reason_counts(files: DataFrame) -> DataFrame:
    """Per job: number of files in all, processed, and left out per reason."""
    reasons = with_review_reason(files).select("job_id", "reason")
    return reasons.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("reason").isNull()).alias("processed_files"),
        *[
            F.count_if(F.col("reason") == name).alias(name)
            for name in (
                "removed", "binary", "no_content", "too_large",
                "unsupported_language", "generated",
            )
        ],
    )


def attach_impact(files: DataFrame, scores: DataFrame) -> DataFrame:
    """Impact score per file, 0.0 where the graph does not know the file."""
    known = scores.select("job_id", "filename", F.col("impact_score").alias("known_score"))
    return (
        files.drop("impact_score")
        .join(by_merge(known), ["job_id", "filename"], "left")
        .withColumn("impact_score", F.coalesce(F.col("known_score"), F.lit(0.0)))
        .drop("known_score")
    )


def review_priority(names: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ``review_ord`` per job: falling impact, equal impact in file order.

    ``names`` is a narrow table (no content): content never follows the order, findings do.
    """
    keys = attach_impact(names, scores)
    return range_rank(keys, "job_id", [F.col("impact_score").desc(), "ord"], "review_ord")
