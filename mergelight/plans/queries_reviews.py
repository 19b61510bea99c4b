"""Queries: whole reviews, with and without a model, and code trees on disk.

The SQL twin of a review builds the findings of all agents in review order (``raw_v``) and runs
the twin of clustering and merging over them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.operators.text import rules_for
from mergelight.plans.adapters import view
from mergelight.plans.catalog import query
from mergelight.plans.queries_files import REASON, WS, sql_any
from mergelight.plans.queries_findings import CLUSTERS, RANK, SUMMARY_TEXT
from mergelight.plans.queries_graph import IMPACT, PATTERNS
from mergelight.plans.queries_text import JS_SQL, PY_DEF_SQL, function_files, rule_hit_sql
from mergelight.plans.review import default_detectors, review
from mergelight.session import new_folder
from mergelight.sources.readers import scan_code_files as read_tree
from mergelight.sources.writers import write_code_tree

# Files of a review with their place in review order.
KEPT = f"""{IMPACT},
listed AS (SELECT job_id, ord, filename, language, content FROM code_v
  UNION ALL SELECT job_id, ord + 1000000, filename, language, content FROM script_v),
kept AS (SELECT l.*, row_number() OVER (PARTITION BY l.job_id ORDER BY i.impact_score DESC, l.ord) AS place
  FROM listed l JOIN impact i ON i.job_id = l.job_id AND i.filename = l.filename)"""

# Functions of these files; none of them has a test file.
GAPS = f"""func_lines AS (SELECT job_id, filename, language, unnest(range(1, len(ls) + 1)) AS start_line, unnest(ls) AS line
  FROM (SELECT job_id, filename, language, string_split(content, chr(10)) AS ls FROM kept)),
missing AS (SELECT job_id, filename, start_line, CASE WHEN language = 'python' THEN regexp_extract(line, '{PY_DEF_SQL}', 2)
    ELSE regexp_extract(line, '{JS_SQL}', 1) || regexp_extract(line, '{JS_SQL}', 2) END AS name,
    row_number() OVER (PARTITION BY job_id, filename ORDER BY start_line) - 1 AS func_ord
  FROM func_lines WHERE CASE WHEN language = 'python' THEN regexp_matches(line, '{PY_DEF_SQL}')
    ELSE regexp_matches(line, '{JS_SQL}') END)"""

HITS = "\n  UNION ALL ".join(
    f"""SELECT job_id, filename, place, line_number, {number} AS rule_no, '{severity}' AS severity, '{category}' AS category,
    '{title}' AS title, trim(line, {WS}) AS shown FROM lines WHERE {rule_hit_sql(number, pattern)}"""
    for number, pattern, title, severity, category in rules_for(parity=True)
)
RULES = f"""lines AS (SELECT job_id, filename, place, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line
  FROM (SELECT job_id, filename, place, string_split(content, chr(10)) AS ls FROM kept)),
rule_raw AS (SELECT job_id, 'SecurityScanner' AS agent, 1 AS a, 0 AS kind, place, line_number AS p, rule_no AS i,
    filename AS file_path, line_number, severity, category, title,
    'Pattern detected on line ' || line_number || ': ' || left(shown, 100) AS description,
    '{fixed.RULE_SUGGESTION}' AS suggestion, 0.9 AS confidence FROM ({HITS}))"""

COVERAGE = """gap_raw AS (SELECT g.job_id, 'TestCoverage' AS agent, 3 AS a, 0 AS kind, k.place, g.func_ord AS p, 0 AS i,
    g.filename AS file_path, g.start_line AS line_number, 'MEDIUM' AS severity, 'missing-test' AS category,
    'No test for ' || name || '()' AS title,
    'Function ' || name || ' defined at line ' || start_line || ' has no corresponding test case.' AS description,
    'Add test cases covering happy path, edge cases, and error conditions for ' || name || '.' AS suggestion, 0.8 AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, filename ORDER BY func_ord) AS r FROM missing) g
  JOIN kept k ON k.job_id = g.job_id AND k.filename = g.filename WHERE g.r <= 5)"""


def merged_sql(files: str, raw: str) -> str:
    """``merged``: clusters of the findings that the tables of ``raw`` (comma-separated) give."""
    rows = " UNION ALL ".join(f"SELECT * FROM {name}" for name in raw.split(", "))
    clusters = CLUSTERS.removeprefix("WITH RECURSIVE ").replace("findings_v", "raw_v")
    return f"""WITH RECURSIVE {files},
raw_v AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY a, place, kind, p, i) AS seq,
    CAST(NULL AS VARCHAR) AS fix_example FROM ({rows})),
{clusters}"""


def review_jobs_of(files: DataFrame) -> DataFrame:
    return files.select("job_id").distinct().select(
        "job_id", F.concat(F.lit("org/"), "job_id").alias("repo"), F.lit(1).alias("pr_number"),
        F.concat(F.lit("Change "), "job_id").alias("pr_title"), F.lit("head").alias("head_sha"),
    )


COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS count_{s}" for s in fixed.SEVERITIES)


@query(
    "review_summary",
    merged_sql(f"{KEPT}, {GAPS}, {RULES}, {COVERAGE}", "rule_raw, gap_raw") + f""",
sized AS (SELECT job_id, count(*) AS n_files FROM kept GROUP BY job_id),
counts AS (SELECT job_id, count(*) AS total, {COUNTS} FROM merged GROUP BY job_id),
runs AS (SELECT s.job_id, r.ord, r.agent, s.n_files, count(v.seq) AS n
  FROM sized s CROSS JOIN (VALUES (0, 'SecurityScanner'), (1, 'TestCoverage')) r(ord, agent)
  LEFT JOIN raw_v v ON v.job_id = s.job_id AND v.agent = r.agent GROUP BY 1, 2, 3, 4),
runs_text AS (SELECT job_id, string_agg('| ' || agent || ' | ' || n || ' | 0.0s |', chr(10) ORDER BY ord) AS agent_rows,
    '[' || string_agg('{{"ord":' || ord || ',"agent":"' || agent || '","findings":' || n
      || ',"processing_time_seconds":0.0,"files_analyzed":' || n_files || '}}', ',' ORDER BY ord) || ']' AS agent_results
  FROM runs GROUP BY job_id)
SELECT job_id, 'org/' || job_id AS repo, 1 AS pr_number, total AS total_findings, count_CRITICAL AS critical_count,
  count_HIGH AS high_count, count_MEDIUM AS medium_count, count_LOW AS low_count, n_files AS files_reviewed, agent_results,
  CASE WHEN total = 0 THEN 'APPROVE' WHEN count_CRITICAL + count_HIGH > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS review_decision,
  {SUMMARY_TEXT} AS executive_summary, 0.0::DOUBLE AS processing_time_seconds
FROM (SELECT s.job_id, s.n_files, 2 * s.n_files AS files, 0.0::DOUBLE AS seconds, 'Change ' || s.job_id AS pr_title,
    'org/' || s.job_id AS repo, chr(10) AS nl, coalesce(total, 0) AS total,
    {", ".join(f"coalesce(count_{s}, 0) AS count_{s}" for s in fixed.SEVERITIES)}, agent_rows, agent_results
  FROM sized s LEFT JOIN counts USING (job_id) JOIN runs_text USING (job_id))""",
)
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Whole review of the code and script views, one row per job."""
    files = function_files(spark, d).withColumns({
        "status": F.lit("modified"),
        "ord": F.when(F.col("language") == "python", F.col("ord"))
        .otherwise(F.col("ord") + 1_000_000),
    })
    done = review(review_jobs_of(files), files)
    return done.summary.withColumn("agent_results", F.to_json("agent_results"))


# Files of the coverage view that are reviewed; nothing imports anything, so files stay in order.
COVER_KEPT = f"kept AS (SELECT *, ord AS place FROM cover_v WHERE {REASON} IS NULL)"
RANKED = f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY {RANK}, seq) AS rank, agent, file_path,
  line_number, severity, title, description, members FROM merged"""
RANKED_COLUMNS = [
    "job_id", "rank", "agent", "file_path", "line_number", "severity", "title", "description", "members",
]


@query(
    "review_findings",
    merged_sql(
        f"{COVER_KEPT}, {PATTERNS.replace('cover_v', 'kept')}, {RULES}, {COVERAGE}", "rule_raw, gap_raw"
    ) + RANKED,
)
def review_findings(spark: SparkSession, d: str) -> DataFrame:
    """Merged and ranked findings of a whole review of the coverage view."""
    files = view(spark, d, "cover_v")
    return review(review_jobs_of(files), files).findings.select(RANKED_COLUMNS)


def fixed_answers(prompts: list[str]) -> list[str]:
    """A stand-in for a model: one finding for the file that a prompt names."""
    out = []
    for prompt in prompts:
        name = re.search(r"\nFile: (.*)\n", prompt)[1]
        entry = {"line": len(name), "severity": "HIGH" if len(name) % 2 else "LOW", "category": "model",
                 "title": f"Look at {name}", "confidence": 0.9}
        out.append(json.dumps({"findings": [entry]}))
    return out


CODE_KEPT = KEPT.replace("""
  UNION ALL SELECT job_id, filename, language, content FROM script_v)""", ")").replace("""
  UNION ALL SELECT job_id, ord + 1000000, filename, language, content FROM script_v)""", ")")
SENSITIVE = f"""({sql_any('lower(filename)', fixed.SENSITIVE_WORDS)}
    OR {sql_any('lower(left(content, 3000))', fixed.SENSITIVE_WORDS)})"""
DEFAULT_TEXTS = {
    agent: (values["description"], values["suggestion"]) for agent, values in fixed.RESPONSE_DEFAULTS.items()
} | {"TestCoverage": (fixed.NO_TEST_FILE_DEFAULTS["description"], fixed.NO_TEST_FILE_DEFAULTS["suggestion"])}
ASKED = "\n  UNION ALL ".join(
    f"""SELECT job_id, '{agent}' AS agent, {a} AS a, 1 AS kind, place, 0 AS p, 0 AS i, filename AS file_path,
    length(filename) AS line_number, CASE WHEN length(filename) % 2 = 0 THEN 'LOW'
      ELSE '{"MEDIUM" if agent == "StyleAdvisor" else "HIGH"}' END AS severity, 'model' AS category,
    'Look at ' || filename AS title, '{DEFAULT_TEXTS[agent][0]}' AS description, '{DEFAULT_TEXTS[agent][1]}' AS suggestion,
    0.9 AS confidence FROM kept WHERE {SENSITIVE if agent == "SecurityScanner" else "true"}"""
    for a, agent in enumerate(fixed.AGENTS)
)


@query(
    "review_with_model",
    merged_sql(f"{CODE_KEPT}, {RULES}, model_raw AS ({ASKED})", "rule_raw, model_raw") + RANKED,
)
def review_with_model(spark: SparkSession, d: str) -> DataFrame:
    """All four agents over the code view; the model is a fixed function of the prompt."""
    files = view(spark, d, "code_v")
    done = review(review_jobs_of(files), files, detectors=default_detectors(fixed_answers))
    return done.findings.select(RANKED_COLUMNS)


@query(
    "scan_code_files",
    """WITH tree AS (SELECT job_id || '/' || filename AS filename, content FROM code_v
  UNION ALL SELECT job_id || '/' || filename, content FROM script_v)
SELECT filename, CASE WHEN ends_with(filename, '.py') THEN 'python' WHEN ends_with(filename, '.js') THEN 'javascript'
    ELSE 'typescript' END AS language,
  CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS additions, sha256(content) AS content_sha256
FROM tree""",
)
def scan_code_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the code and script views written to a tree, among others to leave out, and read."""
    root = new_folder(spark, "tree")
    named = function_files(spark, d).withColumn("filename", F.concat_ws("/", "job_id", "filename"))
    left_out = [
        F.concat("job_id", F.lit("/node_modules/"), "ord", F.lit(".js")),
        F.concat("job_id", F.lit("/notes"), "ord", F.lit(".md")),
    ]
    some = function_files(spark, d).filter(F.col("ord") % 10 == 0).select(
        F.explode(F.array(*left_out)).alias("filename"), "content"
    )
    write_code_tree(named.select("filename", "content").unionByName(some), root)
    return read_tree(spark, root).select(
        "filename", "language", "additions", F.sha2("content", 256).alias("content_sha256")
    )
