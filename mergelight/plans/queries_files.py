"""Queries: file classification, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions import files as ff
from mergelight.functions import text as ft
from mergelight.functions.conventions import docstring_style, naming_style
from mergelight.functions.findings import (
    agent_tag,
    severity_at_most_medium,
    severity_icon,
    severity_rank,
    shared_title_words,
)
from mergelight.operators import files as of
from mergelight.operators import responses as rs
from mergelight.plans.adapters import table, view
from mergelight.plans.catalog import query
from mergelight.sources.readers import decode_content, pr_file_table


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_case(subject: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {subject} {whens} END"


def sql_any(subject: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({subject}, '{p}')" for p in parts) + ")"


WS = "'" + fixed.WHITESPACE + "'"
EXT = (
    "CASE WHEN contains(filename, '.') "
    "THEN lower('.' || regexp_extract(filename, '([^.]*)$', 1)) ELSE '' END"
)
LANGUAGE = sql_case(f"({EXT})", fixed.LANGUAGE_BY_EXTENSION)
SUPPORTED = f"({LANGUAGE}) IN ({sql_list(fixed.SUPPORTED_LANGUAGES)})"
GENERATED = (
    f"({sql_any('lower(filename)', fixed.GENERATED_NAME_PARTS)} OR "
    f"{sql_any('lower(left(content, 500))', fixed.GENERATED_MARKERS)})"
)
SKIP = f"""CASE WHEN status = 'removed' THEN 'removed'
  WHEN ({EXT}) IN ({sql_list(fixed.BINARY_EXTENSIONS)}) THEN 'binary'
  WHEN content IS NULL OR content = '' THEN 'no_content'
  WHEN length(content) > 500000 THEN 'too_large' END"""
REASON = f"""coalesce({SKIP},
  CASE WHEN NOT coalesce({SUPPORTED}, false) THEN 'unsupported_language'
       WHEN coalesce({GENERATED}, false) THEN 'generated' END)"""
BASENAME = "regexp_extract(filename, '([^/]*)$', 1)"
TEST_FILE = (
    f"(starts_with(lower({BASENAME}), 'test_') OR contains(lower({BASENAME}), 'conftest') "
    "OR contains(filename, '__tests__') OR "
    + " OR ".join(f"ends_with(lower({BASENAME}), '{e}')" for e in fixed.TEST_NAME_ENDINGS)
    + ")"
)


@query("detect_language", f"SELECT ord, ({LANGUAGE}) AS language FROM files_v")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files_v").select(
        "ord", ff.detect_language(F.col("filename")).alias("language")
    )


@query("file_extension", f"SELECT ord, {EXT} AS extension FROM files_v")
def file_extension(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files_v").select(
        "ord", ff.file_extension(F.col("filename")).alias("extension")
    )


@query("skip_reason", f"SELECT ord, {SKIP} AS reason FROM files_v")
def skip_reason(spark: SparkSession, d: str) -> DataFrame:
    reason = ff.skip_reason(F.col("filename"), F.col("status"), F.col("content"))
    return view(spark, d, "files_v").select("ord", reason.alias("reason"))


@query(
    "is_generated_file",
    f"SELECT ord, coalesce({GENERATED}, false) AS generated FROM files_v",
)
def is_generated_file(spark: SparkSession, d: str) -> DataFrame:
    generated = ff.is_generated_file(F.col("filename"), F.col("content"))
    return view(spark, d, "files_v").select("ord", generated.alias("generated"))


@query(
    "reviewable_files",
    f"""SELECT job_id, ord, filename, ({LANGUAGE}) AS language, CAST(length(content) AS INTEGER) AS n_chars
FROM files_v WHERE {REASON} IS NULL""",
)
def reviewable_files(spark: SparkSession, d: str) -> DataFrame:
    return of.reviewable_files(view(spark, d, "files_v")).select(
        "job_id", "ord", "filename", "language", F.length("content").alias("n_chars")
    )


@query(
    "analyzable_files",
    f"SELECT job_id, ord, filename FROM files_v WHERE content <> '' AND {SUPPORTED}",
)
def analyzable_files(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files_v").withColumn("language", ff.detect_language(F.col("filename")))
    return of.analyzable_files(files).select("job_id", "ord", "filename")


@query("is_test_file", f"SELECT ord, {TEST_FILE} AS is_test FROM files_v")
def is_test_file(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files_v").select(
        "ord", ff.is_test_file(F.col("filename")).alias("is_test")
    )


@query(
    "coverage_source_files",
    f"SELECT job_id, ord, filename FROM files_v WHERE content <> '' AND {SUPPORTED} AND NOT {TEST_FILE}",
)
def coverage_source_files(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files_v").withColumn("language", ff.detect_language(F.col("filename")))
    return of.coverage_source_files(files).select("job_id", "ord", "filename")


@query(
    "is_security_sensitive",
    f"""SELECT ord, ({sql_any('lower(filename)', fixed.SENSITIVE_WORDS)} OR
  {sql_any('lower(left(content, 3000))', fixed.SENSITIVE_WORDS)}) AS sensitive
FROM files_v WHERE content <> ''""",
)
def is_security_sensitive(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files_v").filter(F.col("content") != "")
    sensitive = ff.is_security_sensitive(F.col("filename"), F.col("content"))
    return files.select("ord", sensitive.alias("sensitive"))


def _purpose_sql() -> str:
    whens = [f"WHEN {sql_any('lower(filename)', w)} THEN '{p}'" for w, p in fixed.PATH_PURPOSES]
    whens += [
        f"WHEN {sql_any('lower(left(content, 2000))', w)} THEN '{p}'"
        for w, p in fixed.CONTENT_PURPOSES
    ]
    return "CASE " + " ".join(whens) + f" ELSE '{fixed.DEFAULT_PURPOSE}' END"


@query("file_purpose", f"SELECT ord, {_purpose_sql()} AS purpose FROM files_v WHERE content <> ''")
def file_purpose(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files_v").filter(F.col("content") != "")
    return files.select("ord", ff.file_purpose(F.col("filename"), F.col("content")).alias("purpose"))


@query(
    "skip_reason_counts",
    f"""SELECT job_id, count(*) AS total_files,
  count(*) FILTER (WHERE reason IS NULL) AS processed_files,
  count(*) FILTER (WHERE reason = 'removed') AS removed,
  count(*) FILTER (WHERE reason = 'binary') AS "binary",
  count(*) FILTER (WHERE reason = 'no_content') AS no_content,
  count(*) FILTER (WHERE reason = 'too_large') AS too_large,
  count(*) FILTER (WHERE reason = 'unsupported_language') AS unsupported_language,
  count(*) FILTER (WHERE reason = 'generated') AS generated
FROM (SELECT job_id, {REASON} AS reason FROM files_v) GROUP BY job_id""",
)
def skip_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return of.skip_reason_counts(view(spark, d, "files_v"))


PR_LANGUAGE = sql_case(
    "(CASE WHEN contains(filename, '.') THEN regexp_extract(filename, '([^.]*)$', 1) END)",
    fixed.PR_FILE_LANGUAGE,
)


@query(
    "read_pr_files",
    f"""SELECT ord, filename, coalesce(status, 'modified') AS status,
  coalesce(additions, 0) AS additions, 0 AS deletions,
  CASE WHEN coalesce(status, '') <> 'removed' AND ord % 19 <> 0 AND size < 500000
       THEN coalesce(content, '') END AS content, {PR_LANGUAGE} AS language
FROM (SELECT ord, filename, CASE WHEN ord % 7 = 0 THEN NULL ELSE status END AS status,
        CASE WHEN ord % 3 = 0 THEN NULL ELSE CAST(ord % 100 AS INTEGER) END AS additions,
        CASE WHEN ord % 17 = 0 THEN 600000 ELSE ord END AS size, content FROM files_v)""",
)
def read_pr_files(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("ord")
    records = view(spark, d, "files_v").select(
        "job_id", "ord", F.when(n % 19 != 0, "sha").alias("head_sha"), "filename",
        F.when(n % 7 != 0, F.col("status")).alias("status"),
        F.when(n % 3 != 0, (n % 100).cast("int")).alias("additions"),
        F.lit(None).cast("int").alias("deletions"), F.lit(None).cast("string").alias("patch"),
        F.when(n % 17 == 0, 600000).otherwise(n).alias("size"),
        F.base64(F.encode("content", "UTF-8")).alias("content"),
        F.octet_length("content").cast("bigint").alias("content_size"),
        F.lit("base64").alias("encoding"),
    )
    return pr_file_table(records).select(
        "ord", "filename", "status", "additions", "deletions", "content", "language"
    )


@query(
    "decode_content",
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN
  CASE WHEN doc_id % 2 = 0 THEN text || chr(65533) ELSE text END END AS content FROM documents""",
)
def decode_content_query(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    even = F.col("doc_id") % 2 == 0
    raw = F.encode("text", "UTF-8")
    coded = F.base64(F.when(even, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw))
    size = F.when(F.col("doc_id") % 5 == 0, 1_000_001).otherwise(F.octet_length("text"))
    return docs.select("doc_id", decode_content(coded, F.lit("base64"), size).alias("content"))


@query(
    "severity_rank",
    f"""SELECT seq, CASE sev {" ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(fixed.SEVERITIES))}
  ELSE 5 END AS rank, coalesce({sql_case('sev', fixed.SEVERITY_ICONS)}, '{fixed.DEFAULT_ICON}') AS icon
FROM (SELECT seq, CASE WHEN seq % 9 = 0 THEN 'OTHER' ELSE severity END AS sev FROM findings_v)""",
)
def severity_rank_query(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("seq") % 9 == 0, "OTHER").otherwise(F.col("severity"))
    return view(spark, d, "findings_v").select(
        "seq", severity_rank(severity).alias("rank"), severity_icon(severity).alias("icon")
    )


@query(
    "agent_tag",
    """SELECT seq, CASE WHEN seq % 2 = 0 THEN '[' || upper(agent) || ']'
  ELSE '[' || upper(agent) || ' X]' END AS tag FROM findings_v""",
)
def agent_tag_query(spark: SparkSession, d: str) -> DataFrame:
    agent = F.when(F.col("seq") % 2 == 0, F.concat(F.col("agent"), F.lit("Agent"))).otherwise(
        F.concat(F.lit(" agent"), F.col("agent"), F.lit(" x "))
    )
    return view(spark, d, "findings_v").select("seq", agent_tag(agent).alias("tag"))


@query(
    "confidence_filter",
    """SELECT seq FROM findings_v WHERE CASE agent WHEN 'BugDetector' THEN confidence >= 0.6
  WHEN 'StyleAdvisor' THEN confidence >= 0.6 WHEN 'SecurityScanner' THEN confidence >= 0.5
  ELSE true END""",
)
def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    return rs.confidence_filter(view(spark, d, "findings_v")).select("seq")


@query(
    "clamp_style_severity",
    """SELECT seq, CASE WHEN agent <> 'StyleAdvisor' THEN severity
  WHEN severity IN ('CRITICAL', 'HIGH') THEN 'MEDIUM' ELSE severity END AS severity FROM findings_v""",
)
def clamp_style_severity(spark: SparkSession, d: str) -> DataFrame:
    return rs.clamp_style_severity(view(spark, d, "findings_v")).select("seq", "severity")


@query(
    "clamp_missing_severity",
    """SELECT seq, CASE WHEN seq % 4 = 0 THEN 'LOW' WHEN severity IN ('CRITICAL', 'HIGH') THEN 'MEDIUM'
  ELSE severity END AS severity FROM findings_v""",
)
def clamp_missing_severity(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("seq") % 4 != 0, F.col("severity"))
    return view(spark, d, "findings_v").select(
        "seq", severity_at_most_medium(given).alias("severity")
    )


STOP = sql_list(fixed.TITLE_STOP_WORDS)


@query(
    "shared_title_words",
    f"""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(
  list_intersect(string_split(lower(p_name), ' '), string_split('the ' || lower(p_type) || ' ' || lower(p_name), ' '))),
  lambda w: w <> '' AND w NOT IN ({STOP}))), ' ') AS shared FROM part""",
)
def shared_title_words_query(spark: SparkSession, d: str) -> DataFrame:
    other = F.concat(F.lit("The "), F.col("p_type"), F.lit("  "), F.col("p_name"))
    shared = shared_title_words(F.col("p_name"), other)
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(F.array_sort(shared), " ").alias("shared")
    )


@query(
    "path_parts",
    """SELECT p_partkey, base, CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'a/b' ELSE '/x' END AS dir,
  CASE WHEN k = 0 THEN '.env' WHEN k = 1 THEN 'm' || p_partkey || '.tar' ELSE 'm' || p_partkey END AS stem
FROM (SELECT p_partkey, p_partkey % 3 AS k, CASE p_partkey % 3 WHEN 0 THEN '.env'
  WHEN 1 THEN 'm' || p_partkey || '.tar.gz' ELSE 'm' || p_partkey END AS base FROM part)""",
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("p_partkey").cast("string")
    path = (
        F.when(F.col("p_partkey") % 3 == 0, ".env")
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a/b//m"), number, F.lit(".tar.gz")))
        .otherwise(F.concat(F.lit("/x/m"), number))
    )
    return table(spark, d, "part").select(
        "p_partkey", ft.basename(path).alias("base"), ft.dirname(path).alias("dir"),
        ft.stem(path).alias("stem"),
    )


@query(
    "normalize_path",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.' WHEN 1 THEN 'b/m' || p_partkey
  WHEN 2 THEN '../m' || p_partkey WHEN 3 THEN '/m' || p_partkey ELSE 'a/m' || p_partkey END AS path
FROM part""",
)
def normalize_path_query(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 5
    path = (
        F.when(k == 0, "a/./..")
        .when(k == 1, F.concat(F.lit("a/../b//./m"), number))
        .when(k == 2, F.concat(F.lit("x/../../m"), number))
        .when(k == 3, F.concat(F.lit("/../m"), number, F.lit("/")))
        .otherwise(F.concat(F.lit("./a/m"), number))
    )
    return table(spark, d, "part").select("p_partkey", ft.normalize_path(path).alias("path"))


@query(
    "capitalize",
    "SELECT p_partkey, upper(left(p_brand || 'X', 1)) || lower(substr(p_brand || 'X', 2)) AS name FROM part",
)
def capitalize_query(spark: SparkSession, d: str) -> DataFrame:
    name = F.lower(F.concat("p_brand", F.lit("X")))
    return table(spark, d, "part").select("p_partkey", ft.capitalize(name).alias("name"))


@query(
    "naming_style",
    """SELECT p_partkey, CASE WHEN n = lower(n) AND regexp_matches(n, '[a-z]') AND contains(n, '_') THEN 'snake'
  WHEN regexp_matches(n, '^[a-z].*[A-Z]') THEN 'camel' ELSE 'none' END AS style
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN 'do' || p_type
  WHEN 2 THEN p_type ELSE '_' || p_type END AS n FROM part)""",
)
def naming_style_query(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.replace("p_name", F.lit(" "), F.lit("_")))
        .when(k == 1, F.concat(F.lit("do"), "p_type"))
        .when(k == 2, F.col("p_type")).otherwise(F.concat(F.lit("_"), "p_type"))
    )
    return table(spark, d, "part").select("p_partkey", naming_style(name).alias("style"))


@query(
    "docstring_style",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'numpy' WHEN 2 THEN 'sphinx'
  ELSE 'none' END AS style FROM part""",
)
def docstring_style_query(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    text = F.concat(
        F.col("p_name"),
        F.when(k == 0, " Returns: x :param").when(k == 1, " Parameters\n --- :type")
        .when(k == 2, " :type x").otherwise(" Parameters"),
    )
    return table(spark, d, "part").select("p_partkey", docstring_style(text).alias("style"))


@query(
    "time_ago",
    """SELECT event_id, CASE WHEN s < 60 THEN 'just now'
  WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago'
  WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
  ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS age
FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(ts)) / 1e6 AS s FROM events)""",
)
def time_ago_query(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", ft.time_ago(F.col("ts"), now).alias("age"))


@query(
    "escape_html",
    """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '"', '&quot;') AS escaped FROM pages""",
)
def escape_html_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", ft.escape_html(F.col("html")).alias("escaped")
    )


@query(
    "json_field",
    """SELECT event_id, coalesce(json_extract_string(body, '$.pull_request.title'), '') AS title,
  coalesce(CAST(json_extract_string(body, '$.pull_request.number') AS BIGINT), 0) AS number,
  coalesce(CAST(json_extract_string(body, '$.installation.id') AS BIGINT), 0) AS installation
FROM webhook_v""",
)
def json_field_query(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return view(spark, d, "webhook_v").select(
        "event_id", ft.json_field(body, "$.pull_request.title", "").alias("title"),
        ft.json_field(body, "$.pull_request.number", 0).alias("number"),
        ft.json_field(body, "$.installation.id", 0).alias("installation"),
    )
