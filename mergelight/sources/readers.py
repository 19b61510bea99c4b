"""Readers of code trees, exported pull-request files, diffs, events and merged PRs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed, schemas
from mergelight.functions.files import pr_file_language
from mergelight.functions.text import basename, lookup, split_lines, stem
from mergelight.sources.code_tree import CodeTree


def scan_code_files(spark: SparkSession, root: str, job_id: str = "local") -> DataFrame:
    """Source files below ``root`` as a file table.

    Listing leaves out pruned folders unopened, other endings, and files with more bytes than the
    longest text can have; what is left is read in tasks of bounded size.  Texts that are not
    UTF-8 or too long are left out.  Line ends are unified as text mode does.
    """
    if ":" not in root:
        root = os.path.abspath(root)
    spark.dataSource.register(CodeTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    raw = (
        spark.read.format("code_tree").option("extensions", ",".join(fixed.SCAN_LANGUAGE))
        .option("pruned", ",".join(fixed.SCAN_PRUNED_DIRS)).load(root)
        .filter(F.col("size") <= 4 * fixed.MAX_FILE_CHARS)  # a character has four bytes at most
    )
    name = basename(F.col("filename"))
    extension = F.substring(name, F.length(stem(F.col("filename"))) + 1, F.lit(2**31 - 1))
    kept = raw.withColumn("language", lookup(extension, fixed.SCAN_LANGUAGE)).filter(
        F.col("language").isNotNull()
    )
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    texts = kept.select(
        F.lit(job_id).alias("job_id"), "filename", F.lit("modified").alias("status"),
        text.alias("content"), "language",
    )
    short = texts.filter(F.length("content") <= fixed.MAX_FILE_CHARS)  # null when not UTF-8
    return short.withColumns({
        "additions": F.size(split_lines(F.col("content"))), "deletions": F.lit(0),
    })


def read_pr_files(spark: SparkSession, path: str) -> DataFrame:
    """Exported pull-request file records (JSON lines) as a file table."""
    return pr_file_table(spark.read.schema(schemas.PR_FILE_RECORDS).json(path))


def pr_file_table(records: DataFrame) -> DataFrame:
    """Defaults, content and language of exported records.

    Content is there only for files that are not removed, have a head commit and are
    smaller than 500,000 bytes.
    """
    readable = (
        (F.coalesce("status", F.lit("")) != "removed")
        & (F.coalesce("head_sha", F.lit("")) != "")
        & (F.coalesce("size", F.lit(0)) < fixed.MAX_FILE_CHARS)
    )
    content = decode_content(F.col("content"), F.col("encoding"), F.col("content_size"))
    return records.select(
        "job_id", "ord", "filename",
        F.coalesce("status", F.lit("modified")).alias("status"),
        F.coalesce("additions", F.lit(0)).alias("additions"),
        F.coalesce("deletions", F.lit(0)).alias("deletions"),
        "patch",
        F.when(readable, content).alias("content"),
        pr_file_language(F.col("filename")).alias("language"),
    )


def decode_content(content: Column, encoding: Column, size: Column) -> Column:
    """Text of a stored file: base64 decoded, bad bytes replaced, null above 1,000,000 bytes."""
    compact = F.regexp_replace(content, r"\s", "")
    decoded = F.make_valid_utf8(F.try_to_binary(compact, F.lit("base64")).cast("string"))
    coded = (encoding == "base64") & (content != "")
    text = F.when(coded, decoded).otherwise(F.coalesce(content, F.lit("")))
    return F.when(F.coalesce(size, F.lit(0)) <= fixed.MAX_CONTENT_BYTES, text)


def read_pr_diffs(spark: SparkSession, path: str) -> DataFrame:
    """One row per diff file: name without ending as ``job_id``, whole text as ``diff``."""
    whole = spark.read.text(path, wholetext=True)
    name = F.substring_index(F.col("_metadata.file_name"), ".", 1)
    return whole.select(name.alias("job_id"), F.col("value").alias("diff"))


def read_diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """Diff files line by line: (job_id, block, at, value) for ``parse_diff_lines``.

    Files are split among tasks; ``block`` is where a split begins and ``at`` counts within it.  A
    file that ends with a line feed has an empty last line, as its text has.
    """
    found = spark.read.option("lineSep", "\n").text(path).select(
        F.substring_index(F.col("_metadata.file_name"), ".", 1).alias("job_id"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        "value", F.col("_metadata.file_size").alias("size"),
    )
    bytes_ = F.sum(F.octet_length("value").cast("bigint") + 1)
    ended = found.groupBy("job_id").agg(bytes_.alias("bytes"), F.max("size").alias("size")).filter("bytes = size")
    last = ended.select(
        "job_id", F.col("size").alias("block"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("value")
    )
    return found.drop("size").unionByName(last)


def read_merged_prs(spark: SparkSession, path: str) -> DataFrame:
    """Exported closed pull requests (JSON lines or Parquet by file ending)."""
    reader = spark.read.schema(schemas.MERGED_PRS)
    return reader.parquet(path) if path.endswith(".parquet") else reader.json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Review events as a batch."""
    return spark.read.schema(schemas.EVENTS).json(path)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Review events as a stream over a folder of JSON lines."""
    return (
        spark.readStream.schema(schemas.EVENTS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Changed files as a stream over a folder of Parquet files."""
    return (
        spark.readStream.schema(schemas.FILES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
