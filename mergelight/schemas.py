"""Record schemas (Spark DDL) of the tables that operators exchange."""

FILES = (
    "job_id STRING, ord BIGINT, filename STRING, status STRING, additions INT, "
    "deletions INT, patch STRING, content STRING, language STRING, impact_score DOUBLE"
)
# Where a finding stands among those of its job, before they are numbered.
FINDING_ORDER = "STRUCT<agent: INT, file: BIGINT, kind: INT, place: BIGINT, item: BIGINT>"
# ``seq`` is a FINDING_ORDER in tables of detectors and a number in tables of whole jobs.
FINDINGS = (
    "job_id STRING, seq BIGINT, id STRING, agent STRING, file_path STRING, "
    "line_number BIGINT, end_line BIGINT, severity STRING, category STRING, title STRING, "
    "description STRING, suggestion STRING, code_snippet STRING, fix_example STRING, "
    "confidence DOUBLE, contributing_agents ARRAY<STRING>"
)
AGENT_RUNS = (
    "job_id STRING, agent STRING, ord INT, processing_time_seconds DOUBLE, "
    "files_analyzed BIGINT, error STRING"
)
CONVENTIONS = (
    "repo STRING, naming_style STRING, uses_type_hints BOOLEAN, uses_docstrings BOOLEAN, "
    "docstring_style STRING, max_function_length INT, uses_black_formatting BOOLEAN, "
    "uses_async BOOLEAN, test_naming_pattern STRING, common_patterns ARRAY<STRING>, "
    "anti_patterns ARRAY<STRING>, learned_at TIMESTAMP"
)
MERGED_PRS = (
    "repo STRING, number BIGINT, title STRING, updated_at TIMESTAMP, "
    "merged_at TIMESTAMP, diff STRING"
)
RESPONSES = (
    "job_id STRING, agent STRING, file_path STRING, file_ord BIGINT, chunk_index INT, "
    "chunk_start INT, has_test_file BOOLEAN, response STRING"
)
EVENTS = "event_id BIGINT, ts TIMESTAMP, event_type STRING, signature STRING, body STRING"
JOBS = (
    "job_id STRING, repo STRING, pr_number INT, pr_title STRING, head_sha STRING, "
    "base_sha STRING, installation_id BIGINT, created_at TIMESTAMP, status STRING"
)
PR_FILE_RECORDS = (
    "job_id STRING, ord BIGINT, head_sha STRING, filename STRING, status STRING, "
    "additions INT, deletions INT, patch STRING, size BIGINT, content STRING, "
    "content_size BIGINT, encoding STRING"
)
