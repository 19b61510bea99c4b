"""Views that shape the test tables like review data, as SQL both engines can run.

``{table}`` stands for a base table and ``{{`` for a brace.  All views work row by row or
group by a key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight.session import cut_lineage

VIEWS = {
    # one valid Python file per part, 100 files per job, importing each other
    "code_v": """
SELECT 'pr' || CAST(CAST(FLOOR(p_partkey/100) AS BIGINT) AS STRING) AS job_id,
       p_partkey AS ord,
       'pkg/m' || CAST(p_partkey % 100 AS STRING) || '.py' AS filename,
       'modified' AS status, 'python' AS language,
       'import pkg.m' || CAST(CAST(FLOOR((p_partkey % 100)/2) AS BIGINT) AS STRING) || chr(10)
    || 'from pkg.m' || CAST(CAST(FLOOR((p_partkey % 100)/3) AS BIGINT) AS STRING) || ' import x' || chr(10)
    || chr(10)
    || 'def load_' || CAST(p_partkey AS STRING) || '(a, b):' || chr(10)
    || CASE WHEN p_size % 3 = 0 THEN '    return eval(a)' ELSE '    return a' END || chr(10)
    || chr(10)
    || 'async def saveItem' || CAST(p_size AS STRING) || '(p) -> int:' || chr(10)
    || CASE WHEN p_size % 5 = 0 THEN '    token = "abcdefgh' || CAST(p_size AS STRING) || '"'
            ELSE '    # eval(p)' END || chr(10)
    || CASE WHEN p_size % 7 = 0 THEN '    yaml.load(p), Loader' ELSE '    yaml.load(p)' END || chr(10)
    || '    return md5(p)' || chr(10) AS content
FROM {part}""",
    # script files that import and require each other
    "script_v": """
SELECT 'pr' || CAST(CAST(FLOOR(p_partkey/100) AS BIGINT) AS STRING) AS job_id,
       p_partkey AS ord,
       CASE WHEN p_partkey % 10 = 0 THEN 'web/d' || CAST(p_partkey % 100 AS STRING) || '/index.js'
            ELSE 'web/c' || CAST(p_partkey % 100 AS STRING) || '.ts' END AS filename,
       'modified' AS status,
       CASE WHEN p_partkey % 10 = 0 THEN 'javascript' ELSE 'typescript' END AS language,
       'import {{ a, b }} from ''./c' || CAST(CAST(FLOOR((p_partkey % 100)/2) AS BIGINT) AS STRING) || '''' || chr(10)
    || 'import "./side' || CAST(p_size AS STRING) || '.css";' || chr(10)
    || 'const d = require( "../web/d' || CAST(CAST(FLOOR((p_partkey % 100)/10) AS BIGINT) * 10 AS STRING) || '" );' || chr(10)
    || 'function render' || CAST(p_partkey AS STRING) || '(a) {{' || chr(10)
    || CASE WHEN p_size % 4 = 0 THEN '  el.innerHTML = a;' ELSE '  return a;' END || chr(10)
    || '}}' || chr(10)
    || 'const go' || CAST(p_size AS STRING) || ' = async (x) => x;' || chr(10) AS content
FROM {part}""",
    # source files and, for some of them, test files under different names
    "cover_v": """
SELECT 'pr' || CAST(CAST(FLOOR(p_partkey/100) AS BIGINT) AS STRING) AS job_id,
       p_partkey * 2 AS ord,
       'pkg/m' || CAST(p_partkey % 100 AS STRING) || '.py' AS filename,
       'modified' AS status, 'python' AS language,
       'def load_' || CAST(p_partkey AS STRING) || '(a):' || chr(10) || '    return a' || chr(10)
    || 'def keep_' || CAST(p_size AS STRING) || '(a):' || chr(10) || '    return a' || chr(10)
    || CASE WHEN p_size % 4 = 0 THEN 'def a1(): pass' || chr(10) || 'def a2(): pass' || chr(10)
         || 'def a3(): pass' || chr(10) || 'def a4(): pass' || chr(10) ELSE '' END AS content
FROM {part}
UNION ALL
SELECT 'pr' || CAST(CAST(FLOOR(p_partkey/100) AS BIGINT) AS STRING) AS job_id,
       p_partkey * 2 + 1 AS ord,
       CASE p_size % 5 WHEN 0 THEN 'tests/test_m' || CAST(p_partkey % 100 AS STRING) || '.py'
                       WHEN 1 THEN './pkg/tests/test_m' || CAST(p_partkey % 100 AS STRING) || '.py'
                       WHEN 2 THEN 'qa/test_m' || CAST(p_partkey % 100 AS STRING) || '_more.py'
                       WHEN 3 THEN 'qa/old_m' || CAST(p_partkey % 100 AS STRING) || '_test.py'
                       ELSE 'docs/n' || CAST(p_partkey % 100 AS STRING) || '.md' END AS filename,
       'modified' AS status, CASE WHEN p_size % 5 = 4 THEN CAST(NULL AS STRING) ELSE 'python' END AS language,
       CASE WHEN p_size % 6 = 0 THEN ''
            WHEN p_size % 2 = 0 THEN 'def test_Load():' || chr(10) || '    load_' || CAST(p_partkey AS STRING) || '(1)' || chr(10)
            ELSE 'def testKeep_' || CAST(p_size AS STRING) || '(): pass' || chr(10) END AS content
FROM {part}""",
    # mixed languages and skip reasons
    "files_v": """
SELECT 'pr' || CAST(CAST(FLOOR(doc_id/4) AS BIGINT) % 20 AS STRING) AS job_id, doc_id AS ord,
       CASE doc_id % 6 WHEN 0 THEN 'src/m' WHEN 1 THEN 'tests/test_m' WHEN 2 THEN 'web/m'
                       WHEN 3 THEN 'assets/m' WHEN 4 THEN 'cmd/auth_m' ELSE 'gen/m' END
       || CAST(CAST(FLOOR(doc_id/6) AS BIGINT) AS STRING)
       || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.TSX'
                          WHEN 3 THEN '.png' WHEN 4 THEN '.go' ELSE '_pb2.py' END AS filename,
       CASE WHEN doc_id % 11 = 0 THEN 'removed' ELSE 'modified' END AS status,
       CASE WHEN doc_id % 13 = 0 THEN CAST(NULL AS STRING) ELSE text END AS content
FROM {documents}""",
    # findings of four agents, unique seq
    "findings_v": """
SELECT g.seq, 'pr' || CAST(g.s % 20 AS STRING) AS job_id,
       CASE CAST(FLOOR(g.seq/10) AS BIGINT) % 4 WHEN 0 THEN 'BugDetector' WHEN 1 THEN 'SecurityScanner'
            WHEN 2 THEN 'StyleAdvisor' ELSE 'TestCoverage' END AS agent,
       'src/f' || CAST(g.pk % 40 AS STRING) || '.py' AS file_path,
       CAST(g.q AS BIGINT) * 4 + g.seq % 10 AS line_number,
       CASE g.pk % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'
            WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity,
       p.p_brand AS category, p.p_name AS title,
       'seen at ' || CAST(g.seq AS STRING) AS description, 'fix ' || p.p_type AS suggestion,
       CASE WHEN g.pk % 3 = 0 THEN '' ELSE 'x = ' || p.p_type END AS fix_example,
       CAST(g.pk % 10 AS DOUBLE) / 10 AS confidence
FROM (SELECT l_orderkey * 10 + l_linenumber AS seq, MIN(l_partkey) AS pk, MIN(l_suppkey) AS s,
             MIN(l_quantity) AS q FROM {lineitem} GROUP BY l_orderkey * 10 + l_linenumber) g
JOIN {part} p ON g.pk = p.p_partkey""",
    # two-file diffs with deletions, a stale line, and a no-newline marker
    "diffs_v": """
SELECT p_partkey AS diff_id,
  'diff --git a/src/f' || CAST(p_partkey % 7 AS STRING) || '.py b/src/f' || CAST(p_partkey % 7 AS STRING) || '.py' || chr(10)
  || 'index 1..2 100644' || chr(10) || '--- a/src/f.py' || chr(10) || '+++ b/src/f.py' || chr(10)
  || '@@ -1,3 +' || CAST(p_size AS STRING) || ',5 @@' || chr(10) || ' keep' || chr(10) || '+new' || chr(10)
  || '-old' || chr(10) || '--- dropped' || chr(10)
  || '@@ -40,2 +' || CAST(p_size + 60 AS STRING) || ',4 @@ def g' || chr(10) || '+g' || chr(10) || ' h' || chr(10)
  || 'diff --git a/web/g.js b/web/g.js' || chr(10) || 'new file mode 100644' || chr(10)
  || '--- /dev/null' || chr(10) || '+++ b/web/g.js' || chr(10)
  || '@@ -0,0 +1,2 @@' || chr(10) || '+' || p_name || chr(10) || '+' || p_type || chr(10)
  || chr(92) || ' No newline at end of file' || chr(10) AS diff
FROM {part}""",
    # model answers: missing keys, low confidence, fences, broken JSON
    "responses_v": """
SELECT p_partkey AS resp_id,
  CASE p_partkey % 4 WHEN 0 THEN 'BugDetector' WHEN 1 THEN 'SecurityScanner'
       WHEN 2 THEN 'StyleAdvisor' ELSE 'TestCoverage' END AS agent,
  'src/f' || CAST(p_partkey AS STRING) || '.py' AS file_path,
  CASE WHEN p_size % 9 = 0 THEN '{{"findings": [' ELSE
    CASE WHEN p_size % 4 = 0 THEN repeat(chr(96), 3) || 'json' || chr(10) ELSE '' END
    || '{{"findings": [{{"line": ' || CAST(p_size AS STRING) || ', "severity": "HIGH", "title": "' || p_name
    || '", "confidence": 0.' || CAST(p_partkey % 10 AS STRING) || '}}, {{"category": "logic-error", "confidence": 0.9}}, {{"line": 3}}]}}'
    || CASE WHEN p_size % 4 = 0 THEN chr(10) || repeat(chr(96), 3) ELSE '' END
  END AS response
FROM {part}""",
    # review events of every kind
    "webhook_v": """
SELECT event_id, ts,
  CASE event_type WHEN 'signup' THEN 'ping' WHEN 'error' THEN 'push' ELSE 'pull_request' END AS event_type,
  '{{"action": "' || CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize' ELSE 'closed' END
  || '", "pull_request": {{"number": ' || CAST(event_id AS STRING)
  || CASE WHEN event_id % 5 = 0 THEN '' ELSE ', "title": "PR ' || CAST(event_id AS STRING) || '"' END
  || ', "head": {{"sha": "h' || CAST(event_id AS STRING) || '"}}}}, "repository": {{"full_name": "org/r'
  || CAST(user_id AS STRING) || '"}}}}' AS body
FROM {events}""",
    # closed pull requests, some merged, with ties in time and code in the diff
    "merged_prs_v": """
SELECT 'org/r' || CAST(o_custkey % 50 AS STRING) AS repo, o_orderkey AS number,
       o_orderpriority AS title, o_orderdate AS updated_at,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS merged_at,
       CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS STRING) ELSE
       'diff --git a/x.py b/x.py' || chr(10) || '--- a/x.py' || chr(10) || '+++ b/x.py' || chr(10)
       || '@@ -1,2 +1,9 @@' || chr(10)
       || '+def get_item_' || CAST(o_orderkey AS STRING)
       || CASE WHEN o_orderkey % 2 = 0 THEN '(a) -> int:' ELSE '(a):' END || chr(10)
       || CASE o_orderkey % 4 WHEN 0 THEN '+    "Args: a"' WHEN 1 THEN '+    ":param a: b"'
               WHEN 2 THEN '+    "Parameters ---"' ELSE '+    b = a' END || chr(10)
       || '+    return a' || chr(10) || ' context' || chr(10)
       || CASE WHEN o_orderkey % 3 = 0 THEN '+async def saveItem(p):' ELSE '+def saveItem(p):' END || chr(10)
       || '+    return p' || chr(10) || '-gone' || chr(10) || '+tiny' || chr(10) END AS diff
FROM {orders}""",
    # finished reviews of queued events
    "results_v": """
SELECT o_orderkey AS number, 'pr' || CAST(o_orderkey AS STRING) AS job_id,
       'org/r' || CAST(o_custkey % 50 AS STRING) AS repo,
       o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'started' ELSE 'failed' END AS status,
       CAST(o_orderkey % 4 AS BIGINT) AS critical_count, CAST(o_orderkey % 7 AS BIGINT) AS high_count,
       CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE CAST(o_orderkey % 90 AS DOUBLE) END AS processing_time_seconds
FROM {orders}""",
}
# Small tables that grow into much text or work per row.
SPREAD = {"part", "documents", "pages"}
# Rows of one piece at most: Spark cuts files by their packed size, which tells little of what a row grows into.
PIECE_ROWS = {"part": 50_000}
# Tables that a view groups: the key, and the rows of one piece at most, since a task holds the groups of its piece.
GROUPED = {"findings_v": ("lineitem", "l_orderkey * 10 + l_linenumber", 500_000)}
BASE_TABLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, spread over all cores when it lies in fewer pieces than there are cores.

    Narrow tables whose rows grow into texts are also cut by number of rows (known from the
    files' footers).  Others of real size come in more pieces and are left as they are.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.sparkContext.defaultParallelism
    if name in PIECE_ROWS:
        wanted = max(wanted, -(-rows.count() // PIECE_ROWS[name]))
    if name in SPREAD and rows.rdd.getNumPartitions() < wanted:
        return rows.repartition(wanted)
    return rows


def kept_pieces(rows: DataFrame, text: str, piece_rows: int) -> DataFrame:
    """The columns of a spread narrow table that ``text`` names, kept as they are spread.

    Else the planner moves what a filter asks of the texts made of a row to before the spread, where
    a piece of a file is one task.  More rows than a piece meet other tables by a shuffled hash join,
    which sends nothing through the driver and sorts nothing.
    """
    rows = cut_lineage(rows.select([c for c in rows.columns if re.search(rf"\b{c}\b", text)]))
    return rows.hint("shuffle_hash") if rows.count() > piece_rows else rows


def grouped_table(rows: DataFrame, key: str, piece_rows: int) -> DataFrame:
    """``rows`` dealt by what they are grouped by, into pieces of about ``piece_rows`` rows.

    A shuffle of the planner's has a fixed number of partitions and joins small ones by their packed
    size, so what a task holds would grow with the table.
    """
    pieces = -(-rows.count() // piece_rows)
    return rows.repartition(pieces, F.expr(key)) if pieces > 1 else rows


def view(spark: SparkSession, sf_dir: str, name: str, kept: bool = True) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of ``sf_dir``.

    Where nothing filters by the texts, spread tables need not be ``kept`` (see ``kept_pieces``).
    """
    text = VIEWS[name]
    bases = {b: table(spark, sf_dir, b) for b in set(BASE_TABLE.findall(text))}
    for base in bases.keys() & PIECE_ROWS.keys() if kept else ():
        bases[base] = kept_pieces(bases[base], text, PIECE_ROWS[base])
    if name in GROUPED:
        base, key, piece_rows = GROUPED[name]
        bases[base] = grouped_table(bases[base], key, piece_rows)
    return spark.sql(text, **bases)


def with_views(body: str) -> str:
    """``body`` preceded by the views it names, as SQL text over registered tables."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    if not used:
        return body
    texts = []
    for name in used:
        bases = set(BASE_TABLE.findall(VIEWS[name]))
        texts.append(f"{name} AS ({VIEWS[name].format(**{b: b for b in bases})})")
    recursive = "WITH RECURSIVE " if "WITH RECURSIVE" in body else "WITH "
    joined = ",\n".join(texts)
    head = re.match(r"\s*WITH( RECURSIVE)?\s", body)
    if head:
        return f"{recursive}{joined},\n{body[head.end():]}"
    return f"{recursive}{joined}\n{body}"
