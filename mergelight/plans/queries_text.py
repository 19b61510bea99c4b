"""Queries: lines, rules, functions, chunks, imports, diffs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.operators import diffs as od
from mergelight.operators import files as of
from mergelight.operators import responses as rs
from mergelight.operators import text as ot
from mergelight.plans.adapters import table, view
from mergelight.plans.catalog import query
from mergelight.plans.queries_files import REASON, WS

SPACE = r"[\s\x0b\x{85}\p{Z}]"


def re2(pattern: str) -> str:
    """A pattern for the SQL twin: same meaning of white space and dot."""
    outside = re.sub(r"\\s", lambda _: SPACE, pattern)
    return outside.replace("'", "''")


def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """Code, scripts, documents and pages as one file table."""
    columns = ["job_id", "ord", "filename", "content"]
    docs = table(spark, d, "documents").select(
        F.lit("docs").alias("job_id"), F.col("doc_id").alias("ord"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("text").alias("content"),
    )
    pages = table(spark, d, "pages").select(
        F.lit("pages").alias("job_id"), F.col("page_id").alias("ord"),
        F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("filename"),
        F.col("html").alias("content"),
    )
    return (
        view(spark, d, "code_v").select(columns)
        .unionByName(view(spark, d, "script_v").select(columns))
        .unionByName(docs).unionByName(pages)
    )


SCANNED = """scanned AS (
  SELECT job_id, ord, filename, content FROM code_v
  UNION ALL SELECT job_id, ord, filename, content FROM script_v
  UNION ALL SELECT 'docs', doc_id, 'd' || doc_id, text FROM documents
  UNION ALL SELECT 'pages', page_id, 'h' || page_id, html FROM pages),
line_lists AS (SELECT job_id, ord, filename, string_split(content, chr(10)) AS ls FROM scanned),
lines AS (SELECT job_id, ord, filename, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line
  FROM line_lists)"""


def rule_hit_sql(number: int, pattern: str) -> str:
    if number == 11:
        loader = re2(r"(?is)yaml\.load\s*\([^)]*\)\s*,\s*Loader")
        plain = re2(r"(?is)yaml\.load\s*\([^)]*\)")
        return f"regexp_matches(regexp_replace(line, '{loader}', chr(1), 'g'), '{plain}')"
    return f"regexp_matches(line, '(?is){re2(pattern)}')"


def _scan_sql(rules: list[ot.Rule]) -> str:
    hits = [
        f"""SELECT job_id, filename AS file_path, line_number, '{title}' AS title,
  '{severity}' AS severity, '{category}' AS category, trim(line, {WS}) AS shown
FROM lines WHERE {rule_hit_sql(number, pattern)}"""
        for number, pattern, title, severity, category in rules
    ]
    union = "\nUNION ALL\n".join(hits)
    return f"""WITH {SCANNED}
SELECT job_id, file_path, line_number, title, severity, category,
  'Pattern detected on line ' || line_number || ': ' || left(shown, 100) AS description,
  left(shown, 200) AS code_snippet, 0.9::DOUBLE AS confidence FROM ({union})"""


SCAN_COLUMNS = [
    "job_id", "file_path", "line_number", "title", "severity", "category", "description",
    "code_snippet", "confidence",
]


@query("scan_security_rules", _scan_sql(ot.rules_for(parity=True)))
def scan_security_rules(spark: SparkSession, d: str) -> DataFrame:
    return ot.scan_security_rules(scanned_files(spark, d)).select(SCAN_COLUMNS)


@query("scan_security_rules_all", _scan_sql(ot.rules_for(parity=False)))
def scan_security_rules_all(spark: SparkSession, d: str) -> DataFrame:
    return ot.scan_security_rules(scanned_files(spark, d), parity=False).select(SCAN_COLUMNS)


STREAMED = f"""scanned AS (SELECT job_id, ord, filename, content FROM files_v WHERE {REASON} IS NULL),
{SCANNED[SCANNED.index("line_lists AS"):]}"""


@query(
    "stream_findings",
    _scan_sql(ot.rules_for(parity=True)).replace(SCANNED, STREAMED),
)
def stream_findings(spark: SparkSession, d: str) -> DataFrame:
    """Filter, then scan: what the stream of rule findings applies to each micro-batch."""
    files = of.analyzable_files(of.reviewable_files(view(spark, d, "files_v")))
    return ot.scan_security_rules(files).select(SCAN_COLUMNS)


@query("error_isolation")
def error_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Files that do not parse give one error row each; all others give their functions."""
    docs = table(spark, d, "documents").select(
        F.lit("docs").alias("job_id"), F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("filename"), F.lit("python").alias("language"),
        F.col("text").alias("content"),
    )
    code = view(spark, d, "code_v").select(docs.columns)
    good, bad = rs.split_errors(ot.extract_functions_ast(docs.unionByName(code)))
    failed = bad.groupBy("job_id").agg(F.count(F.lit(1)).alias("failed_files"))
    found = good.groupBy("job_id").agg(F.count(F.lit(1)).alias("functions"))
    return failed.join(found, "job_id", "full")


USER_RULES = [
    (1, r"return\s+\w+\(", "Call result returned", "INFO", "house-rule"),
    (2, r"\bthe\b.*\bof\b", "Wordy line", "LOW", "house-style"),
]


@query(
    "rules_cross_lines",
    f"""WITH {SCANNED}
SELECT job_id, filename, line_number, 1 AS rule_no FROM lines WHERE regexp_matches(line, '(?is){re2(USER_RULES[0][1])}')
UNION ALL
SELECT job_id, filename, line_number, 2 AS rule_no FROM lines WHERE regexp_matches(line, '(?is){re2(USER_RULES[1][1])}')""",
)
def rules_cross_lines(spark: SparkSession, d: str) -> DataFrame:
    hits = ot.matching_rules(scanned_files(spark, d), ["job_id", "filename"], rules=USER_RULES)
    return hits.select("job_id", "filename", "line_number", "rule_no")


@query(
    "explode_lines",
    """SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)""",
)
def explode_lines(spark: SparkSession, d: str) -> DataFrame:
    return ot.explode_lines(table(spark, d, "conversations"), "text", ["conv_id", "turn"])


def function_files(spark: SparkSession, d: str) -> DataFrame:
    columns = ["job_id", "ord", "filename", "language", "content"]
    return view(spark, d, "code_v").select(columns).unionByName(
        view(spark, d, "script_v").select(columns)
    )


PY_DEF_SQL = re2(r"^\s*(async\s+)?def\s+(\w+)\s*\(([^)]*)\)")
JS_SQL = re2(fixed.JS_FUNCTION)


@query(
    "extract_functions_lines",
    f"""WITH src AS (SELECT job_id, ord, filename, language, content FROM code_v
  UNION ALL SELECT job_id, ord, filename, language, content FROM script_v),
lists AS (SELECT job_id, ord, filename, language, string_split(content, chr(10)) AS ls FROM src),
rows AS (SELECT job_id, ord, filename, language, ls, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM lists),
tops AS (SELECT *, min(CASE WHEN trim(line, {WS}) <> '' AND NOT starts_with(line, ' ') AND NOT starts_with(line, chr(9)) THEN n END)
  OVER (PARTITION BY job_id, filename ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_top FROM rows),
hits AS (SELECT *, CASE WHEN language = 'python' THEN regexp_extract(line, '{PY_DEF_SQL}', 2)
    ELSE regexp_extract(line, '{JS_SQL}', 1) || regexp_extract(line, '{JS_SQL}', 2) END AS name,
  CASE WHEN language = 'python' THEN regexp_extract(line, '{PY_DEF_SQL}', 3) ELSE '' END AS parameters,
  CASE WHEN language = 'python' AND next_top IS NOT NULL THEN next_top - 1 ELSE least(n + 49, len(ls)) END AS end_line
  FROM tops WHERE CASE WHEN language = 'python' THEN regexp_matches(line, '{PY_DEF_SQL}') ELSE regexp_matches(line, '{JS_SQL}') END)
SELECT job_id, filename, row_number() OVER (PARTITION BY job_id, filename ORDER BY n) - 1 AS func_ord, name,
  n AS start_line, end_line, md5(array_to_string(ls[n:end_line], chr(10))) AS body_md5, parameters FROM hits""",
)
def extract_functions_lines(spark: SparkSession, d: str) -> DataFrame:
    found = ot.extract_functions_lines(function_files(spark, d))
    return found.select(
        "job_id", "filename", "func_ord", "name", "start_line", "end_line",
        F.md5("body").alias("body_md5"), "parameters",
    )


@query(
    "extract_functions_ast",
    """SELECT job_id, filename, 0::BIGINT AS func_ord, 'load_' || ord AS name, 4::BIGINT AS start_line, 5::BIGINT AS end_line,
  '(a, b)' AS parameters FROM code_v
UNION ALL
SELECT job_id, filename, 1::BIGINT, regexp_extract(content, 'async def (\\w+)', 1), 7::BIGINT, 10::BIGINT, '(p)' FROM code_v""",
)
def extract_functions_ast(spark: SparkSession, d: str) -> DataFrame:
    return ot.extract_functions_ast(view(spark, d, "code_v")).select(
        "job_id", "filename", "func_ord", "name", "start_line", "end_line", "parameters"
    )


BOUNDARY = (
    f"(trim(x, {WS}) = '' OR "
    + " OR ".join(f"starts_with(trim(x, {WS}), '{s}')" for s in fixed.CHUNK_BOUNDARY_STARTS)
    + ")"
)


@query(
    "chunk_files",
    f"""WITH RECURSIVE src AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
flags AS (SELECT doc_id, ls, len(ls) AS n, list_transform(ls, lambda x: {BOUNDARY}) AS fl FROM src),
walk(doc_id, chunk_index, first, past) AS (
  SELECT doc_id, 0, 0::BIGINT, CASE WHEN n <= 40 THEN n ELSE coalesce(list_filter(range(40, 20, -1), lambda j: fl[j + 1])[1], 40) END
  FROM flags
  UNION ALL
  SELECT w.doc_id, w.chunk_index + 1, w.past - 10,
    CASE WHEN w.past + 30 >= f.n THEN f.n
         ELSE coalesce(list_filter(range(w.past + 30, w.past + 10, -1), lambda j: f.fl[j + 1])[1], w.past + 30) END
  FROM walk w JOIN flags f ON w.doc_id = f.doc_id WHERE w.past < f.n)
SELECT w.doc_id AS ord, w.chunk_index, CAST(w.first + 1 AS INTEGER) AS chunk_start, CAST(w.past AS INTEGER) AS chunk_end,
  md5(array_to_string(f.ls[w.first + 1:w.past], chr(10))) AS chunk_md5
FROM walk w JOIN flags f ON w.doc_id = f.doc_id""",
)
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.col("text").alias("content")
    )
    return ot.chunk_files(docs, max_lines=40, overlap=10).select(
        "ord", "chunk_index", "chunk_start", "chunk_end", F.md5("chunk").alias("chunk_md5")
    )


IMPORT_SQL = f"""list_concat(
  regexp_extract_all(content, '{re2(fixed.ES6_IMPORT)}', 1),
  regexp_extract_all(content, '{re2(fixed.REQUIRE_CALL)}', 1))"""


@query("js_imports", f"SELECT job_id, filename, unnest({IMPORT_SQL}) AS import_path FROM script_v")
def js_imports(spark: SparkSession, d: str) -> DataFrame:
    return ot.js_imports(view(spark, d, "script_v"))


PY_IMPORT_SQL = """list_concat(
  regexp_extract_all(content, '(?m)^import (\\S+)', 1),
  regexp_extract_all(content, '(?m)^from (\\S+) import', 1))"""


@query("py_imports", f"SELECT job_id, filename, unnest({PY_IMPORT_SQL}) AS import_path FROM code_v")
def py_imports(spark: SparkSession, d: str) -> DataFrame:
    return ot.py_imports(view(spark, d, "code_v", kept=False))


@query(
    "py_imports_lines",
    f"SELECT job_id, filename, unnest({PY_IMPORT_SQL}) AS import_path FROM code_v",
)
def py_imports_lines(spark: SparkSession, d: str) -> DataFrame:
    return ot.py_imports_lines(view(spark, d, "code_v"))


# --- diffs -------------------------------------------------------------------

DIFF_LINES = """lists AS (SELECT diff_id, string_split(diff, chr(10)) AS ls FROM diffs_v),
raw AS (SELECT diff_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM lists)"""

POSITIONS = f"""{DIFF_LINES},
marked AS (SELECT *, starts_with(line, 'diff --git') AS head, starts_with(line, '@@') AS hunk FROM raw),
headed AS (SELECT *, sum(head::INT) OVER w AS section,
    last_value(CASE WHEN head THEN regexp_extract(line, 'b/(.+)$', 1) END IGNORE NULLS) OVER w AS file
  FROM marked WINDOW w AS (PARTITION BY diff_id ORDER BY n)),
kept AS (SELECT *, CASE WHEN hunk THEN CAST(regexp_extract(line, '\\+(\\d+)', 1) AS BIGINT) END AS start,
    NOT hunk AND NOT starts_with(line, '-') AS moves
  FROM headed WHERE NOT head AND (hunk OR (file IS NOT NULL AND NOT starts_with(line, '---') AND NOT starts_with(line, '+++')))),
state AS (SELECT *, row_number() OVER (PARTITION BY diff_id, section ORDER BY n) AS position,
    coalesce(last_value(start - 1 IGNORE NULLS) OVER w, 0) AS base, count(start) OVER w AS hunk_no
  FROM kept WINDOW w AS (PARTITION BY diff_id ORDER BY n)),
placed AS (SELECT *, base + sum(moves::INT) OVER (PARTITION BY diff_id, hunk_no ORDER BY n) AS at FROM state),
last_section AS (SELECT diff_id, file, max(section) AS section FROM headed WHERE head GROUP BY 1, 2),
positions AS (SELECT p.diff_id, p.file, CAST(p.at AS BIGINT) AS line, CAST(max(position) AS INTEGER) AS position,
    CAST(min(position) AS INTEGER) AS ins_order
  FROM placed p JOIN last_section USING (diff_id, file, section) WHERE moves GROUP BY 1, 2, 3)"""


@query("parse_diff", f"WITH {POSITIONS} SELECT diff_id, file, line, position, ins_order FROM positions")
def parse_diff(spark: SparkSession, d: str) -> DataFrame:
    return od.parse_diff(view(spark, d, "diffs_v"), key="diff_id")


@query(
    "parse_diff_hunks_only",
    f"""WITH {DIFF_LINES},
headed AS (SELECT *, starts_with(line, 'diff --git') AS head, starts_with(line, '@@') AS hunk,
    sum(starts_with(line, 'diff --git')::INT) OVER w AS section,
    last_value(CASE WHEN starts_with(line, 'diff --git') THEN regexp_extract(line, '.* b/(.+)$', 1) END IGNORE NULLS) OVER w AS file
  FROM raw WINDOW w AS (PARTITION BY diff_id ORDER BY n)),
hunks AS (SELECT *, sum(hunk::INT) OVER (PARTITION BY diff_id, section ORDER BY n) AS hunk_no,
    last_value(CASE WHEN hunk THEN CAST(regexp_extract(line, '\\+(\\d+)', 1) AS BIGINT) END IGNORE NULLS)
      OVER (PARTITION BY diff_id, section ORDER BY n) AS start
  FROM headed WHERE NOT head),
body AS (SELECT *, row_number() OVER (PARTITION BY diff_id, section ORDER BY n) - 1 AS position,
    NOT hunk AND NOT starts_with(line, '-') AS moves
  FROM hunks WHERE hunk_no > 0 AND NOT starts_with(line, chr(92)) AND line <> ''),
placed AS (SELECT *, start - 1 + sum(moves::INT) OVER (PARTITION BY diff_id, section, hunk_no ORDER BY n) AS spot FROM body)
SELECT diff_id, file, CAST(spot AS BIGINT) AS line, CAST(max(position) AS INTEGER) AS position
FROM placed WHERE moves GROUP BY 1, 2, 3""",
)
def parse_diff_hunks_only(spark: SparkSession, d: str) -> DataFrame:
    return od.parse_diff(view(spark, d, "diffs_v"), key="diff_id", parity=False).drop("ins_order")


PROBES = """probes AS (
  SELECT p_partkey AS diff_id, 'src/f' || (p_partkey % 7) || '.py' AS file, CAST(p_size * 3 - 20 AS BIGINT) AS line FROM part
  UNION ALL SELECT p_partkey, 'g.js b/web/g.js', p_partkey % 130 FROM part
  UNION ALL SELECT p_partkey, 'absent.py', 5 FROM part)"""


def probes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    place = F.inline(F.array(
        F.struct(
            F.concat(F.lit("src/f"), (key % 7).cast("string"), F.lit(".py")).alias("file"),
            (F.col("p_size") * 3 - 20).cast("bigint").alias("line"),
        ),
        F.struct(F.lit("g.js b/web/g.js").alias("file"), (key % 130).alias("line")),
        F.struct(F.lit("absent.py").alias("file"), F.lit(5).cast("bigint").alias("line")),
    ))
    return part.select(key.alias("diff_id"), place)


@query(
    "nearest_diff_position",
    f"""WITH {POSITIONS}, {PROBES}
SELECT diff_id, file, line, position FROM (
  SELECT q.diff_id, q.file, q.line, p.position, row_number() OVER (PARTITION BY q.diff_id, q.file, q.line
    ORDER BY abs(p.line - q.line), p.ins_order) AS r
  FROM probes q LEFT JOIN positions p ON q.diff_id = p.diff_id AND q.file = p.file) WHERE r = 1""",
)
def nearest_diff_position(spark: SparkSession, d: str) -> DataFrame:
    positions = od.parse_diff(view(spark, d, "diffs_v"), key="diff_id")
    return od.nearest_diff_position(probes(spark, d), positions, key="diff_id")


@query(
    "map_comments",
    f"""WITH {POSITIONS}, {PROBES}
SELECT diff_id AS job_id, file AS path, line, body, position FROM (
  SELECT q.diff_id, q.file, q.line, 'note ' || q.line AS body, p.position,
    row_number() OVER (PARTITION BY q.diff_id, q.file, q.line ORDER BY abs(p.line - q.line), p.ins_order) AS r
  FROM probes q LEFT JOIN positions p ON q.diff_id = p.diff_id AND q.file = p.file) WHERE r = 1""",
)
def map_comments(spark: SparkSession, d: str) -> DataFrame:
    positions = od.parse_diff(view(spark, d, "diffs_v"), key="diff_id")
    comments = probes(spark, d).select(
        F.col("diff_id").alias("job_id"), F.col("file").alias("path"), "line",
        F.concat(F.lit("note "), F.col("line").cast("string")).alias("body"),
    )
    return od.map_comments(comments, positions.withColumnRenamed("diff_id", "job_id"))
