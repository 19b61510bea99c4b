"""Queries: import graph, test coverage, conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.operators import conventions as oc
from mergelight.operators import coverage as ov
from mergelight.operators import files as of
from mergelight.operators import graph as og
from mergelight.operators import text as ot
from mergelight.plans.adapters import table, view
from mergelight.plans.catalog import query
from mergelight.plans.queries_text import IMPORT_SQL, PY_IMPORT_SQL, function_files

# --- graph -------------------------------------------------------------------

EDGES = f"""src AS (SELECT job_id, filename, language, content FROM code_v
  UNION ALL SELECT job_id, filename, language, content FROM script_v),
imports AS (SELECT DISTINCT job_id, filename AS src, unnest(CASE WHEN language = 'python' THEN {PY_IMPORT_SQL} ELSE {IMPORT_SQL} END) AS imp FROM src),
dirs AS (SELECT *, regexp_extract(src, '^(.*)/[^/]*$', 1) AS dir FROM imports),
ups AS (SELECT *, regexp_extract(dir, '^(.*)/[^/]*$', 1) AS up FROM dirs),
asked AS (SELECT job_id, src, imp, CASE WHEN starts_with(imp, '../') THEN CASE WHEN up = '' THEN imp[4:] ELSE up || '/' || imp[4:] END
    WHEN starts_with(imp, './') THEN dir || '/' || imp[3:] ELSE replace(imp, '.', '/') END AS base FROM ups),
exact AS (SELECT a.job_id, a.src, a.imp, c.path, c.prio FROM asked a JOIN (
    SELECT job_id, src, imp, unnest([imp, base{"".join(f", base || '{t}'" for e in fixed.IMPORT_EXTENSIONS for t in (e, f'/__init__{e}', f'/index{e}'))}]) AS path,
      unnest(range(0, 17)) AS prio FROM asked) c USING (job_id, src, imp)
  JOIN (SELECT DISTINCT job_id, filename FROM src) f ON f.job_id = c.job_id AND f.filename = c.path),
resolved AS (SELECT job_id, src, imp, arg_min(path, prio) AS dst FROM exact GROUP BY 1, 2, 3),
edges AS (SELECT DISTINCT job_id, src, dst FROM resolved WHERE src <> dst)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    return og.build_graph(function_files(spark, d))


@query("resolve_imports", f"WITH {EDGES} SELECT job_id, src, dst FROM edges")
def resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query(
    "graph_stats",
    f"""WITH {EDGES}
SELECT n.job_id, n.nodes, coalesce(e.edges, 0) AS edges
FROM (SELECT job_id, count(DISTINCT filename) AS nodes FROM src GROUP BY job_id) n
LEFT JOIN (SELECT job_id, count(*) AS edges FROM edges GROUP BY job_id) e USING (job_id)""",
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return og.graph_stats(function_files(spark, d), edges(spark, d))


CLOSURE = f"""{EDGES},
closure(job_id, filename, dependent) AS (
  SELECT job_id, dst, src FROM edges
  UNION
  SELECT c.job_id, c.filename, e.src FROM closure c JOIN edges e ON e.job_id = c.job_id AND e.dst = c.dependent),
dependents AS (SELECT * FROM closure WHERE filename <> dependent)"""


@query(
    "transitive_dependents",
    f"WITH RECURSIVE {CLOSURE} SELECT job_id, filename, dependent FROM dependents",
)
def transitive_dependents(spark: SparkSession, d: str) -> DataFrame:
    return og.transitive_dependents(edges(spark, d))


IMPACT = f"""{CLOSURE},
nodes AS (SELECT job_id, count(DISTINCT filename) AS nodes FROM src GROUP BY job_id),
impact AS (SELECT f.job_id, f.filename, count(x.dependent) / greatest(n.nodes, 1) AS impact_score
  FROM (SELECT DISTINCT job_id, filename FROM src) f JOIN nodes n USING (job_id)
  LEFT JOIN dependents x ON x.job_id = f.job_id AND x.filename = f.filename GROUP BY f.job_id, f.filename, n.nodes)"""


@query(
    "impact_scores",
    f"WITH RECURSIVE {IMPACT} SELECT job_id, filename, round(impact_score, 9) AS impact_score FROM impact",
)
def impact_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = og.impact_scores(function_files(spark, d), edges(spark, d))
    return scores.withColumn("impact_score", F.round("impact_score", 9))


def python_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = function_files(spark, d)
    return files, og.impact_scores(files, edges(spark, d))


@query(
    "review_priority",
    f"""WITH RECURSIVE {IMPACT},
ordered AS (SELECT job_id, ord, filename FROM code_v UNION ALL SELECT job_id, ord + 1000000, filename FROM script_v)
SELECT o.job_id, o.filename, round(i.impact_score, 9) AS impact_score,
  row_number() OVER (PARTITION BY o.job_id ORDER BY i.impact_score DESC, o.ord) AS ord
FROM ordered o JOIN impact i ON i.job_id = o.job_id AND i.filename = o.filename""",
)
def review_priority(spark: SparkSession, d: str) -> DataFrame:
    files, scores = python_scores(spark, d)
    spread = F.when(F.col("language") == "python", F.col("ord")).otherwise(F.col("ord") + 1000000)
    names = files.select("job_id", spread.alias("ord"), "filename")
    ranked = of.review_priority(names, scores)
    return ranked.select(
        "job_id", "filename", F.round("impact_score", 9).alias("impact_score"),
        F.col("review_ord").alias("ord"),
    )


@query(
    "attach_impact",
    f"""WITH RECURSIVE {IMPACT}
SELECT s.job_id, s.filename, coalesce(round(i.impact_score, 9), 0.0) AS impact_score
FROM (SELECT job_id, filename FROM src UNION ALL SELECT job_id, 'new/' || filename FROM src) s
LEFT JOIN impact i ON i.job_id = s.job_id AND i.filename = s.filename""",
)
def attach_impact(spark: SparkSession, d: str) -> DataFrame:
    files, scores = python_scores(spark, d)
    keys = files.select("job_id", "filename")
    more = keys.unionByName(keys.withColumn("filename", F.concat(F.lit("new/"), "filename")))
    joined = of.attach_impact(more, scores)
    return joined.select("job_id", "filename", F.round("impact_score", 9).alias("impact_score"))


# --- coverage ----------------------------------------------------------------

PATTERNS = """sources AS (SELECT job_id, ord, filename, regexp_extract(filename, '([^/]*)\\.py$', 1) AS name,
    regexp_extract(filename, '^(.*)/[^/]*$', 1) AS dir FROM cover_v
  WHERE content <> '' AND language = 'python' AND NOT (starts_with(lower(regexp_extract(filename, '([^/]*)$', 1)), 'test_')
    OR ends_with(lower(filename), '_test.py'))),
names AS (SELECT job_id, ord, filename, regexp_replace(filename, '^\\./', '') AS normal FROM cover_v),
exact AS (SELECT s.job_id, s.ord, min(n.ord) AS test_ord FROM sources s JOIN names n ON n.job_id = s.job_id AND
    list_contains(['tests/test_' || name || '.py', 'test/test_' || name || '.py', 'tests/' || name || '_test.py',
      dir || '/tests/test_' || name || '.py', dir || '/test_' || name || '.py'], n.normal) GROUP BY 1, 2),
loose AS (SELECT s.job_id, s.ord, min(n.ord) AS test_ord FROM sources s JOIN names n ON n.job_id = s.job_id
    AND (contains(n.filename, 'test_' || name) OR contains(n.filename, name || '_test')) GROUP BY 1, 2),
matches AS (SELECT s.job_id, s.ord, s.filename, coalesce(e.test_ord, l.test_ord) AS test_ord,
    CASE WHEN e.test_ord IS NOT NULL THEN 'exact' ELSE 'contains' END AS match
  FROM sources s LEFT JOIN exact e USING (job_id, ord) LEFT JOIN loose l USING (job_id, ord)
  WHERE coalesce(e.test_ord, l.test_ord) IS NOT NULL),
tests AS (SELECT m.job_id, m.ord, v.content AS test_content FROM matches m JOIN cover_v v ON v.job_id = m.job_id AND v.ord = m.test_ord
  WHERE v.content <> ''),
func_lists AS (SELECT job_id, ord, filename, string_split(content, chr(10)) AS ls FROM cover_v WHERE content <> '' AND language = 'python'),
func_lines AS (SELECT job_id, ord, filename, unnest(range(1, len(ls) + 1)) AS start_line, unnest(ls) AS line FROM func_lists),
functions AS (SELECT job_id, ord, filename, start_line, regexp_extract(line, '^\\s*(async\\s+)?def\\s+(\\w+)\\s*\\(([^)]*)\\)', 2) AS name,
    row_number() OVER (PARTITION BY job_id, ord ORDER BY start_line) - 1 AS func_ord
  FROM func_lines WHERE regexp_matches(line, '^\\s*(async\\s+)?def\\s+(\\w+)\\s*\\(([^)]*)\\)')),
untested AS (SELECT f.* FROM functions f JOIN sources USING (job_id, ord) JOIN tests t USING (job_id, ord)
  WHERE NOT (contains(test_content, 'test_' || f.name) OR contains(test_content, f.name)
    OR contains(test_content, 'test' || upper(f.name[1]) || lower(f.name[2:]))
    OR contains(test_content, 'Test' || upper(f.name[1]) || lower(f.name[2:])))),
alone AS (SELECT f.* FROM functions f JOIN sources USING (job_id, ord) ANTI JOIN tests t USING (job_id, ord)),
missing AS (SELECT job_id, ord, filename, start_line, name, func_ord FROM untested
  UNION ALL SELECT job_id, ord, filename, start_line, name, func_ord FROM alone)"""


def cover_functions(files: DataFrame) -> DataFrame:
    return ot.extract_functions_lines(files.filter(F.col("content") != ""), with_body=False)


@query(
    "match_test_files",
    f"WITH {PATTERNS} SELECT job_id, ord, filename, test_ord, match FROM matches",
)
def match_test_files(spark: SparkSession, d: str) -> DataFrame:
    return ov.match_test_files(view(spark, d, "cover_v"))


@query(
    "untested_functions",
    f"WITH {PATTERNS} SELECT job_id, ord, filename, func_ord, name, start_line FROM untested",
)
def untested_functions(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "cover_v")
    return ov.untested_functions(files, cover_functions(files)).drop("end_line")


@query(
    "functions_without_test_file",
    f"WITH {PATTERNS} SELECT job_id, ord, filename, func_ord, name, start_line FROM alone",
)
def functions_without_test_file(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "cover_v")
    return ov.functions_without_test_file(files, cover_functions(files)).drop("end_line")


@query(
    "basic_coverage_findings",
    f"""WITH {PATTERNS}
SELECT job_id, filename AS file_path, start_line AS line_number, 'MEDIUM' AS severity, 'missing-test' AS category,
  'No test for ' || name || '()' AS title,
  'Function ' || name || ' defined at line ' || start_line || ' has no corresponding test case.' AS description,
  'Add test cases covering happy path, edge cases, and error conditions for ' || name || '.' AS suggestion,
  0.8::DOUBLE AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY job_id, ord ORDER BY func_ord) AS r FROM missing) WHERE r <= 5""",
)
def basic_coverage_findings(spark: SparkSession, d: str) -> DataFrame:
    return ov.coverage_findings(view(spark, d, "cover_v")).select(
        "job_id", "file_path", "line_number", "severity", "category", "title", "description",
        "suggestion", "confidence",
    )


# --- conventions -------------------------------------------------------------

RECENT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, number DESC) AS r FROM merged_prs_v),
recent AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, number DESC) AS pr_rank
  FROM ranked WHERE r <= 6 AND merged_at IS NOT NULL AND diff IS NOT NULL),
merged AS (SELECT * FROM recent WHERE pr_rank <= 3)"""


@query("recent_merged_prs", f"WITH {RECENT} SELECT repo, number, CAST(pr_rank AS INTEGER) AS pr_rank, title FROM merged")
def recent_merged_prs(spark: SparkSession, d: str) -> DataFrame:
    return oc.recent_merged_prs(view(spark, d, "merged_prs_v")).select(
        "repo", "number", "pr_rank", "title"
    )


BLOCKS = f"""{RECENT},
pr_lines AS (SELECT repo, pr_rank, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line
  FROM (SELECT repo, pr_rank, string_split(diff, chr(10)) AS ls FROM merged)),
added AS (SELECT *, n - row_number() OVER (PARTITION BY repo, pr_rank ORDER BY n) AS run
  FROM pr_lines WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')),
runs AS (SELECT repo, pr_rank, min(n) AS first_line, trim(string_agg(line[2:], chr(10) ORDER BY n), ' ' || chr(10)) AS sample
  FROM added GROUP BY repo, pr_rank, run),
samples AS (SELECT repo, sample, row_number() OVER (PARTITION BY repo ORDER BY pr_rank, first_line) AS sample_ord
  FROM runs WHERE length(sample) > 20)"""


@query(
    "added_code_blocks",
    f"WITH {BLOCKS} SELECT repo, CAST(sample_ord AS INTEGER) AS sample_ord, left(sample, 2000) AS sample FROM samples WHERE sample_ord <= 20",
)
def added_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    return oc.added_code_blocks(oc.recent_merged_prs(view(spark, d, "merged_prs_v")))


@query(
    "convention_prompt",
    f"""WITH {BLOCKS}
SELECT repo, left(string_agg(left(sample, 2000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY sample_ord), 6000) AS code
FROM samples WHERE sample_ord <= 10 GROUP BY repo""",
)
def convention_prompt(spark: SparkSession, d: str) -> DataFrame:
    merged = oc.recent_merged_prs(view(spark, d, "merged_prs_v"))
    return oc.convention_prompt(oc.added_code_blocks(merged)).select("repo", "code")


LEARNED = f"""{BLOCKS},
facts AS (SELECT repo, regexp_extract(sample, 'def (\\w+)', 1) AS name, starts_with(sample, 'async') AS is_async,
    contains(sample, '-> int') AS hinted, contains(sample, '    "') AS documented, contains(sample, 'Args:') AS google,
    contains(sample, 'Parameters') AS numpy, contains(sample, ':param') AS sphinx,
    len(string_split(sample, chr(10))) AS n_lines FROM samples WHERE sample_ord <= 20),
counted AS (SELECT repo, count(name) AS functions, count(*) FILTER (WHERE contains(name, '_')) AS snake,
    count(*) FILTER (WHERE name = 'saveItem') AS camel, count(*) FILTER (WHERE hinted) AS hinted,
    count(*) FILTER (WHERE documented) AS documented, count(*) FILTER (WHERE google) AS google,
    count(*) FILTER (WHERE numpy) AS numpy, count(*) FILTER (WHERE sphinx) AS sphinx,
    sum(n_lines) AS total_lines, coalesce(bool_or(is_async), false) AS uses_async
  FROM (SELECT DISTINCT repo FROM merged) LEFT JOIN facts USING (repo) GROUP BY repo),
measured AS (SELECT repo, CASE WHEN snake >= camel THEN 'snake_case' ELSE 'camelCase' END AS naming_style,
    hinted * 2 > functions AS uses_type_hints, documented * 2 > functions AS uses_docstrings,
    CASE WHEN google >= numpy AND google >= sphinx THEN 'google' WHEN numpy >= sphinx THEN 'numpy' ELSE 'sphinx' END AS docstring_style,
    CAST(least(CASE WHEN functions > 0 THEN total_lines // functions ELSE 50 END * 2, 200) AS INTEGER) AS max_function_length,
    uses_async FROM counted)"""


@query(
    "learn_conventions",
    f"""WITH {LEARNED}
SELECT a.repo, coalesce(naming_style, 'snake_case') AS naming_style, coalesce(uses_type_hints, true) AS uses_type_hints,
  coalesce(uses_docstrings, true) AS uses_docstrings, coalesce(docstring_style, 'google') AS docstring_style,
  coalesce(max_function_length, 50) AS max_function_length, coalesce(uses_async, false) AS uses_async,
  false AS uses_black_formatting, 'test_*' AS test_naming_pattern
FROM (SELECT DISTINCT repo FROM merged_prs_v) a LEFT JOIN measured m USING (repo)""",
)
def learn_conventions(spark: SparkSession, d: str) -> DataFrame:
    prs = view(spark, d, "merged_prs_v")
    return oc.learn_conventions(prs, prs).drop("common_patterns", "anti_patterns")


@query(
    "merge_conventions",
    f"""WITH {LEARNED},
modelled AS (SELECT DISTINCT repo, CASE WHEN CAST(substr(repo, 6) AS INTEGER) % 2 = 0 THEN true END AS black FROM merged_prs_v)
SELECT m.repo, naming_style, docstring_style, coalesce(black, false) AS uses_black_formatting, 'Test*' AS test_naming_pattern,
  10 AS n_common, 0 AS n_anti FROM measured m JOIN modelled USING (repo)""",
)
def merge_conventions(spark: SparkSession, d: str) -> DataFrame:
    prs = view(spark, d, "merged_prs_v")
    merged = oc.recent_merged_prs(prs)
    measured = oc.conventions_from_facts(oc.function_facts(oc.added_code_blocks(merged)), merged)
    even = F.substring("repo", 6, 10).cast("int") % 2 == 0
    modelled = prs.select("repo").distinct().select(
        "repo", F.when(even, True).alias("uses_black_formatting"),
        F.lit("camelCase").alias("naming_style"), F.lit("Test*").alias("test_naming_pattern"),
        F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i.cast("string"))
        .alias("common_patterns"),
    )
    return oc.merge_conventions(measured, modelled).select(
        "repo", "naming_style", "docstring_style", "uses_black_formatting", "test_naming_pattern",
        F.size("common_patterns").alias("n_common"), F.size("anti_patterns").alias("n_anti"),
    )


@query(
    "files_with_conventions",
    f"""WITH {LEARNED}
SELECT job_id, ord, coalesce(naming_style, 'snake_case') AS naming_style,
  coalesce(max_function_length, 50) AS max_function_length
FROM (SELECT job_id, ord, 'org/r' || (ord % 60) AS repo FROM code_v) f LEFT JOIN measured m USING (repo)""",
)
def files_with_conventions(spark: SparkSession, d: str) -> DataFrame:
    prs = view(spark, d, "merged_prs_v")
    repo = F.concat(F.lit("org/r"), (F.col("ord") % 60).cast("string"))
    files = view(spark, d, "code_v").withColumn("repo", repo)
    joined = oc.files_with_conventions(files, oc.learn_conventions(prs, prs))
    return joined.select("job_id", "ord", "naming_style", "max_function_length")


NOW = "1998-12-01 00:00:00"


def stored_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with the time of the newest pull request that a repo closed."""
    return table(spark, d, "orders").groupBy(
        F.concat(F.lit("org/r"), (F.col("o_custkey") % 1000).cast("string")).alias("repo")
    ).agg((F.max("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOURS")).alias("learned_at"))


STORED_SQL = """stored AS (SELECT 'org/r' || (o_custkey % 1000) AS repo, max(o_orderdate) + INTERVAL 1 HOUR AS learned_at
  FROM orders GROUP BY 1),
fresh AS (SELECT repo FROM stored WHERE learned_at > TIMESTAMP '1998-12-01' - INTERVAL 1 DAY)"""


@query("convention_cache", f"WITH {STORED_SQL} SELECT repo FROM fresh")
def convention_cache(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return oc.fresh_conventions(stored_profiles(spark, d), now).select("repo")


@query(
    "repos_to_refresh",
    f"""WITH {STORED_SQL}
SELECT DISTINCT repo FROM (SELECT 'org/r' || (o_custkey % 1200) AS repo FROM orders) ANTI JOIN fresh USING (repo)""",
)
def repos_to_refresh(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    repos = table(spark, d, "orders").select(
        F.concat(F.lit("org/r"), (F.col("o_custkey") % 1200).cast("string")).alias("repo")
    )
    return oc.repos_to_refresh(repos, stored_profiles(spark, d), now)
