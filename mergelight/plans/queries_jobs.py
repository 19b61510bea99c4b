"""Queries: model responses, prompts, events, jobs and their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.signature import hmac_pads, signature_of
from mergelight.operators import jobs as oj
from mergelight.operators import responses as rs
from mergelight.operators import text as ot
from mergelight.plans.adapters import table, view
from mergelight.plans.catalog import query
from mergelight.plans.queries_files import WS, sql_case
from mergelight.session import new_folder
from mergelight.sources.writers import expire_job_results, read_job_results
from mergelight.sources.writers import write_job_results as write_results
from mergelight.streaming import reviews as st

def as_stream(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """Rows written to a few files and read as a stream, one file a micro-batch."""
    path = new_folder(spark, "stream")
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


# --- responses ---------------------------------------------------------------


def responses(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "responses_v").select(
        F.lit("r").alias("job_id"), "agent", "file_path", F.col("resp_id").alias("file_ord"),
        (F.col("resp_id") % 3).cast("int").alias("chunk_index"),
        (F.col("resp_id") % 3 * 231 + 1).cast("int").alias("chunk_start"),
        (F.col("resp_id") % 8 != 7).alias("has_test_file"), "response",
    )


CLEANED = f"""cleaned AS (SELECT resp_id, agent, file_path,
  trim(CASE WHEN starts_with(trim(response, {WS}), repeat(chr(96), 3))
    THEN regexp_replace(regexp_replace(trim(response, {WS}), '^[^\\n]*\\n', ''), '\\n\\s*`{{3}}$', '')
    ELSE trim(response, {WS}) END, {WS}) AS cleaned FROM responses_v)"""


@query(
    "parse_model_response",
    f"""WITH {CLEANED}
SELECT resp_id AS file_ord, cleaned, CASE WHEN json_valid(cleaned) THEN json_type(cleaned) = 'OBJECT' ELSE false END AS valid
FROM cleaned""",
)
def parse_model_response(spark: SparkSession, d: str) -> DataFrame:
    return rs.parse_model_response(responses(spark, d)).select("file_ord", "cleaned", "valid")


def _default_sql(name: str) -> str:
    return sql_case("agent", {a: str(v[name]) for a, v in fixed.RESPONSE_DEFAULTS.items()})


ITEMS = f"""{CLEANED},
items AS (SELECT resp_id, agent, file_path, unnest(CAST(json_extract(cleaned, '$.findings') AS JSON[])) AS item,
    unnest(range(0, CAST(json_array_length(cleaned, '$.findings') AS BIGINT))) AS item_ord,
    agent = 'TestCoverage' AND resp_id % 8 = 7 AS untested FROM cleaned WHERE json_valid(cleaned)),
fields AS (SELECT resp_id, agent, file_path, item_ord, untested,
    coalesce(CAST(item->>'$.line' AS BIGINT), 1) AS line,
    coalesce(item->>'$.severity', {_default_sql('severity')}) AS severity,
    coalesce(item->>'$.category', {_default_sql('category')}) AS category,
    coalesce(item->>'$.title', CASE WHEN untested THEN 'No test file for ' || file_path ELSE {_default_sql('title')} END) AS title,
    coalesce(item->>'$.description', CASE WHEN untested THEN 'No test coverage' ELSE {_default_sql('description')} END) AS description,
    coalesce(item->>'$.suggestion', CASE WHEN untested THEN 'Create test file' ELSE {_default_sql('suggestion')} END) AS suggestion,
    coalesce(CAST(item->>'$.confidence' AS DOUBLE), CASE WHEN untested THEN 0.8 WHEN agent = 'TestCoverage' THEN 0.7 ELSE 0 END) AS confidence
  FROM items)"""


def _response_sql(line: str) -> str:
    return f"""WITH {ITEMS}
SELECT agent, file_path, {line} AS line_number, category, title, description, suggestion, confidence,
  CASE WHEN agent = 'StyleAdvisor' AND severity IN ('CRITICAL', 'HIGH') THEN 'MEDIUM' ELSE severity END AS severity
FROM fields WHERE agent = 'TestCoverage' OR confidence >= CASE agent WHEN 'SecurityScanner' THEN 0.5 ELSE 0.6 END"""


RESPONSE_COLUMNS = [
    "agent", "file_path", "line_number", "severity", "category", "title", "description",
    "suggestion", "confidence",
]


@query("response_findings", _response_sql("line"))
def response_findings(spark: SparkSession, d: str) -> DataFrame:
    return rs.response_findings(responses(spark, d)).select(RESPONSE_COLUMNS)


@query("response_findings_shifted", _response_sql("line + resp_id % 3 * 231"))
def response_findings_shifted(spark: SparkSession, d: str) -> DataFrame:
    found = rs.response_findings(responses(spark, d), parity=False)
    return found.select(RESPONSE_COLUMNS)


@query(
    "rejected_responses",
    f"""WITH {CLEANED}
SELECT agent, file_path, 'not a JSON object' AS problem FROM cleaned WHERE NOT json_valid(cleaned)""",
)
def rejected_responses(spark: SparkSession, d: str) -> DataFrame:
    return rs.rejected_responses(responses(spark, d)).select("agent", "file_path", "problem")


# --- prompts and model -------------------------------------------------------


def conversation_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files, for prompt cuts on long texts."""
    return table(spark, d, "documents").select(
        F.lit("docs").alias("job_id"), F.col("doc_id").alias("ord"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("filename"),
        F.lit("python").alias("language"), F.col("text").alias("content"),
    )


FENCED = "repeat(chr(96), 3) || 'python' || chr(10) || left({text}, {n}) || chr(10) || repeat(chr(96), 3)"
SHAPE = "'" + rs.ANSWER_SHAPE.replace("'", "''") + "'"


@query(
    "build_prompt_security",
    f"""SELECT doc_id AS ord, md5('Find security weaknesses in this python file.' || chr(10) || 'File: d' || doc_id || '.py'
  || chr(10) || 'Purpose: ' || CASE WHEN contains(lower(left(text, 2000)), 'crypto') OR contains(lower(left(text, 2000)), 'encrypt') THEN 'cryptographic operations'
    WHEN contains(lower(left(text, 2000)), 'session') OR contains(lower(left(text, 2000)), 'cookie') THEN 'session management'
    ELSE 'general application logic' END
  || chr(10) || chr(10) || {FENCED.format(text='text', n=8000)} || chr(10) || chr(10) || {SHAPE}) AS prompt_md5 FROM documents""",
)
def build_prompt_security(spark: SparkSession, d: str) -> DataFrame:
    prompts = rs.security_prompts(conversation_files(spark, d))
    return prompts.select("ord", F.md5("prompt").alias("prompt_md5"))


@query(
    "build_prompt_bug",
    f"""WITH src AS (SELECT job_id, ord, filename, content, p_size FROM code_v JOIN part ON ord = p_partkey)
SELECT job_id, ord, md5('Find logic errors in this python file.' || chr(10) || 'File: ' || filename || chr(10)
  || 'Functions: ["load_' || ord || '","saveItem' || p_size || '"]' || chr(10) || chr(10)
  || {FENCED.format(text='content', n=8000)} || chr(10) || chr(10) || {SHAPE}) AS prompt_md5 FROM src""",
)
def build_prompt_bug(spark: SparkSession, d: str) -> DataFrame:
    prompts = rs.bug_prompts(view(spark, d, "code_v"))
    return prompts.select("job_id", "ord", F.md5("prompt").alias("prompt_md5"))


@query(
    "build_prompt_style",
    f"""SELECT doc_id AS ord, md5('Find departures from the conventions of this repository in a python file.' || chr(10)
  || 'File: d' || doc_id || '.py' || chr(10) || 'naming_style: snake_case' || chr(10) || 'uses_type_hints: true' || chr(10)
  || 'uses_docstrings: true' || chr(10) || 'docstring_style: google' || chr(10) || 'max_function_length: 50' || chr(10)
  || 'uses_async: false' || chr(10) || 'Common patterns:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'guard first' || chr(10) || lang ELSE 'None documented' END
  || chr(10) || 'Patterns to avoid:' || chr(10) || 'None documented' || chr(10) || chr(10)
  || {FENCED.format(text='text', n=6000)} || chr(10) || chr(10) || {SHAPE}) AS prompt_md5 FROM documents""",
)
def build_prompt_style(spark: SparkSession, d: str) -> DataFrame:
    defaults = {n: F.lit(v) for n, v in fixed.CONVENTION_DEFAULTS.items()}
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "lang")
    files = conversation_files(spark, d).join(langs, "ord").withColumns({
        **defaults,
        "common_patterns": F.when(
            F.col("ord") % 2 == 0, F.array(F.lit("guard first"), F.col("lang"))
        ).otherwise(F.array().cast("array<string>")),
        "anti_patterns": F.lit(None).cast("array<string>"),
    })
    return rs.style_prompts(files).select("ord", F.md5("prompt").alias("prompt_md5"))


@query(
    "build_prompt_coverage",
    f"""WITH src AS (SELECT job_id, ord, filename, content, p_size FROM code_v JOIN part ON ord = p_partkey)
SELECT job_id, ord, ord % 2 = 0 AS has_test_file, md5('Find code without tests in this python file.' || chr(10) || 'File: ' || filename || chr(10)
  || 'Functions: ["load_' || ord || '","saveItem' || p_size || '"]' || chr(10) || chr(10)
  || {FENCED.format(text='content', n=6000)}
  || CASE WHEN ord % 2 = 0 THEN chr(10) || 'Test file: t' || ord || '.py' || chr(10) || {FENCED.format(text="repeat('assert x; ', 500)", n=4000)}
     || chr(10) || chr(10) ELSE chr(10) || 'There is no test file.' || chr(10) || chr(10) END || {SHAPE}) AS prompt_md5 FROM src""",
)
def build_prompt_coverage(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "code_v")
    functions = ot.extract_functions_lines(files, with_body=False)
    tests = files.filter(F.col("ord") % 2 == 0).select(
        "job_id", "ord",
        F.concat(F.lit("t"), F.col("ord").cast("string"), F.lit(".py")).alias("test_filename"),
        F.repeat(F.lit("assert x; "), 500).alias("test_content"),
    )
    prompts = rs.coverage_prompts(files, functions, tests)
    return prompts.select("job_id", "ord", "has_test_file", F.md5("prompt").alias("prompt_md5"))


@query(
    "score_with_model",
    """SELECT doc_id AS ord, CASE WHEN doc_id >= 0 THEN 'len ' || length(text) END AS response FROM documents""",
)
def score_with_model(spark: SparkSession, d: str) -> DataFrame:
    prompts = conversation_files(spark, d).select("ord", F.col("content").alias("prompt"))

    def stub(texts: list[str]) -> list[str]:
        return [f"len {len(text)}" for text in texts]

    good, _ = rs.split_errors(rs.score_with_model(prompts, stub))
    return good.select("ord", "response")


# --- events and jobs ---------------------------------------------------------

SECRET = "a secret that is longer than one block of sixty-four bytes, so it is hashed first"
KEY_PADS = [pad.hex() for pad in hmac_pads(SECRET)]
HMAC = (
    f"sha256(from_hex('{KEY_PADS[1]}') || from_hex(sha256(from_hex('{KEY_PADS[0]}') || encode(body))))"
)


def signed_events(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    signature = (
        F.when(F.col("event_id") % 7 == 0, "sha256=00")
        .when(F.col("event_id") % 11 != 0, signature_of(body, SECRET))
    )
    broken = F.when(F.col("event_id") % 13 == 0, F.substring("body", 1, 30)).otherwise(body)
    return view(spark, d, "webhook_v").withColumn("body", broken).withColumn("signature", signature)


SIGNED = f"""broken AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 13 = 0 THEN left(body, 30) ELSE body END AS body FROM webhook_v),
verified AS (SELECT *, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 401 ELSE 200 END AS verified, {HMAC} AS digest FROM broken),
parsed AS (SELECT *, CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.action'), '') END AS action FROM verified),
classified AS (SELECT *, CASE WHEN verified <> 200 THEN 'rejected' WHEN NOT json_valid(body) THEN 'bad_request'
    WHEN event_type = 'ping' THEN 'pong' WHEN event_type <> 'pull_request' THEN 'ignored'
    WHEN action IN ('opened', 'synchronize') THEN 'queued' ELSE 'ignored' END AS status FROM parsed),
reasoned AS (SELECT *, CASE WHEN status = 'ignored' THEN CASE WHEN event_type <> 'pull_request'
    THEN 'Event type ''' || event_type || ''' not handled' ELSE 'Action ''' || action || ''' not handled' END END AS reason FROM classified)"""


@query("verify_signature", f"WITH {SIGNED} SELECT event_id, verified, 'sha256=' || digest AS expected FROM verified")
def verify_signature(spark: SparkSession, d: str) -> DataFrame:
    verified = oj.verify_signature(signed_events(spark, d), SECRET)
    expected = signature_of(F.col("body"), SECRET)
    return verified.select("event_id", "verified", expected.alias("expected"))


@query("classify_event", f"WITH {SIGNED} SELECT event_id, status, reason FROM reasoned")
def classify_event(spark: SparkSession, d: str) -> DataFrame:
    classified = oj.classify_event(oj.verify_signature(signed_events(spark, d), SECRET))
    return classified.select("event_id", "status", "reason")


PROJECTED = """SELECT sha256(event_id || '|' || body) AS job_id, json_extract_string(body, '$.repository.full_name') AS repo,
  CAST(json_extract_string(body, '$.pull_request.number') AS INTEGER) AS pr_number,
  coalesce(json_extract_string(body, '$.pull_request.title'), '') AS pr_title,
  json_extract_string(body, '$.pull_request.head.sha') AS head_sha, '' AS base_sha, 0::BIGINT AS installation_id,
  epoch_us(ts) AS created_us, 'queued' AS status"""


def _with_micros(jobs: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    return jobs.withColumn("created_us", micros).drop("created_at")


@query(
    "project_review_job",
    f"{PROJECTED} FROM webhook_v WHERE event_type = 'pull_request'",
)
def project_review_job(spark: SparkSession, d: str) -> DataFrame:
    events = view(spark, d, "webhook_v").filter(F.col("event_type") == "pull_request")
    return _with_micros(oj.project_review_job(events))


@query("stream_review_jobs", f"WITH {SIGNED} {PROJECTED} FROM reasoned WHERE reasoned.status = 'queued'")
def stream_review_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The stream over all events, run to its end."""
    out = new_folder(spark, "jobs")
    events = as_stream(spark, signed_events(spark, d))
    st.stream_review_jobs(events, SECRET, out, new_folder(spark, "state")).awaitTermination()
    return _with_micros(spark.read.parquet(out))


@query(
    "stream_job_status",
    """SELECT job_id, arg_max(status, (ts, status)) AS status, arg_max(result, (ts, status)) AS result,
  epoch_us(max(ts)) AS updated_us
FROM (SELECT 'u' || user_id AS job_id, ts, event_type AS status, props AS result FROM events) GROUP BY job_id""",
)
def stream_job_status(spark: SparkSession, d: str) -> DataFrame:
    """The keyed stream over all updates, some files a micro-batch, run to its end."""
    updates = table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), "ts",
        F.col("event_type").alias("status"), F.col("props").alias("result"),
    )
    micros = F.unix_micros(F.col("updated_at").cast("timestamp"))
    out = new_folder(spark, "status")
    st.stream_job_status(as_stream(spark, updates), out, new_folder(spark, "state")).awaitTermination()
    return st.read_job_status(spark, out).select(
        "job_id", "status", "result", micros.alias("updated_us")
    )


@query(
    "latest_job_status",
    """SELECT job_id, arg_max(status, (ts, status)) AS status, epoch_us(max(ts)) AS updated_us
FROM (SELECT 'u' || user_id AS job_id, ts, event_type AS status FROM events) GROUP BY job_id""",
)
def latest_job_status(spark: SparkSession, d: str) -> DataFrame:
    """The same for a table of updates."""
    updates = table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("job_id"), "ts",
        F.col("event_type").alias("status"), F.col("props").alias("result"),
    )
    micros = F.unix_micros(F.col("updated_at").cast("timestamp"))
    return oj.latest_job_status(updates).select("job_id", "status", micros.alias("updated_us"))


@query(
    "jobs_with_results",
    """SELECT j.job_id, coalesce(r.status, 'unknown') AS status, r.critical_count
FROM (SELECT 'pr' || number AS job_id FROM merged_prs_v UNION ALL SELECT 'new' || number FROM merged_prs_v) j
LEFT JOIN results_v r USING (job_id)""",
)
def jobs_with_results(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("number").cast("string")
    names = F.explode(F.array(F.concat(F.lit("pr"), number), F.concat(F.lit("new"), number)))
    jobs = view(spark, d, "merged_prs_v").select(
        names.alias("job_id"), F.lit("queued").alias("status")
    )
    results = view(spark, d, "results_v").select("job_id", "status", "critical_count")
    return oj.jobs_with_results(jobs, results)


@query(
    "recent_jobs",
    "SELECT job_id, repo, status FROM results_v ORDER BY created_at DESC, job_id DESC LIMIT 50",
)
def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return oj.recent_jobs(view(spark, d, "results_v")).select("job_id", "repo", "status")


@query(
    "dashboard_stats",
    """SELECT count(*) AS total_reviews, CAST(sum(critical_count + high_count) AS BIGINT) AS bugs_found,
  CAST(sum(critical_count) AS BIGINT) AS security_issues, round(avg(nullif(processing_time_seconds, 0)), 6) AS avg_seconds
FROM (SELECT * FROM results_v ORDER BY created_at DESC, job_id DESC LIMIT 50)""",
)
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = oj.dashboard_stats(view(spark, d, "results_v"))
    return stats.withColumn("avg_seconds", F.round("avg_seconds", 6))


@query(
    "call_rate_check",
    """SELECT event_id, CAST(coalesce(sum(1) OVER w, 0) AS BIGINT) AS calls_before, coalesce(sum(1) OVER w, 0) >= 30 AS limited
FROM (SELECT event_id, user_id % 3 AS k, CAST(epoch_us(ts) / 100 AS BIGINT) AS moment FROM events)
WINDOW w AS (PARTITION BY k ORDER BY moment RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING)""",
)
def call_rate_check(spark: SparkSession, d: str) -> DataFrame:
    # events are minutes apart: time runs a hundred times faster here, so windows fill
    at = F.timestamp_micros(
        F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 100).cast("bigint")
    )
    calls = table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 3).alias("k"), at.alias("called_at")
    )
    return oj.call_rate_check(calls, "k", "called_at").select(
        "event_id", "calls_before", "limited"
    )


@query(
    "write_job_results",
    """SELECT job_id, status, critical_count FROM results_v
WHERE TIMESTAMP '1998-07-01' + INTERVAL 1 DAY * (day(created_at) - 1) > TIMESTAMP '1998-07-30 12:00:00'""",
)
def write_job_results(spark: SparkSession, d: str) -> DataFrame:
    """All results, completed over a month, in two batches, one of them written twice.

    Old days expire, and the last one is read.
    """
    path = new_folder(spark, "results")
    done = view(spark, d, "results_v")
    completed = F.to_timestamp(F.date_add(F.lit("1998-07-01").cast("date"), F.dayofmonth("created_at") - 1))
    for batch in (0, 1, 0):
        write_results(done.filter(F.col("number") % 2 == batch), path, completed, str(batch))
    expire_job_results(spark, path, "1998-07-31")
    now = F.lit("1998-07-31 12:00:00").cast("timestamp")
    return read_job_results(spark, path, now).select("job_id", "status", "critical_count")


@query(
    "model_error_isolation",
    """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN upper(p_name) END AS response,
  CASE WHEN p_size % 7 = 0 THEN 'ValueError: no answer to ' || p_name END AS error FROM part""",
)
def model_error_isolation(spark: SparkSession, d: str) -> DataFrame:
    """A prompt that fails loses its own answer only; the model is a fixed function."""
    prompts = table(spark, d, "part").select(
        "p_partkey", F.concat(F.when(F.col("p_size") % 7 == 0, "!").otherwise(""), "p_name").alias("prompt")
    )

    def model(texts: list[str]) -> list[str]:
        for text in texts:
            if text.startswith("!"):
                raise ValueError(f"no answer to {text[1:]}")
        return [text.upper() for text in texts]

    return rs.score_with_model(prompts, model)
