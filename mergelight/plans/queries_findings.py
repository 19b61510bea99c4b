"""Queries: clustering, merging, ranking, decisions, counts, comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.findings import finding_order
from mergelight.operators import findings as of
from mergelight.operators import ranking as rk
from mergelight.operators import reports as rp
from mergelight.operators import responses as rs
from mergelight.plans.adapters import view
from mergelight.plans.catalog import query
from mergelight.plans.queries_files import STOP, sql_case
from mergelight.session import for_one_action, new_folder
from mergelight.streaming import reviews as st

RANK = "CASE severity " + " ".join(
    f"WHEN '{s}' THEN {n}" for n, s in enumerate(fixed.SEVERITIES)
) + " ELSE 5 END"

CLUSTERS = f"""WITH RECURSIVE t AS (SELECT *, list_filter(list_distinct(string_split(lower(title), ' ')),
    lambda w: w <> '' AND w NOT IN ({STOP})) AS ws FROM findings_v),
gaps AS (SELECT *, line_number - lag(line_number) OVER (PARTITION BY job_id, file_path ORDER BY line_number, seq) AS gap FROM t),
isl AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3 THEN 1 ELSE 0 END)
    OVER (PARTITION BY job_id, file_path ORDER BY line_number, seq) AS island FROM gaps),
m AS (SELECT job_id, file_path, island, seq, line_number, category, ws,
    row_number() OVER (PARTITION BY job_id, file_path, island ORDER BY seq) AS pos FROM isl),
fold(job_id, file_path, island, pos, seeds, seq, cluster_seq) AS (
  SELECT job_id, file_path, island, pos, [{{'s': seq, 'l': line_number, 'c': category, 'w': ws}}], seq, seq FROM m WHERE pos = 1
  UNION ALL
  SELECT job_id, file_path, island, pos,
    CASE WHEN hit IS NULL THEN list_append(seeds, {{'s': seq, 'l': line_number, 'c': category, 'w': ws}}) ELSE seeds END,
    seq, coalesce(hit.s, seq)
  FROM (SELECT m.job_id, m.file_path, m.island, m.pos, f.seeds, m.seq, m.line_number, m.category, m.ws,
      list_filter(f.seeds, lambda s: abs(s.l - m.line_number) <= 3
        AND (s.c = m.category OR len(list_intersect(s.w, m.ws)) >= 2))[1] AS hit
    FROM fold f JOIN m ON m.job_id = f.job_id AND m.file_path = f.file_path AND m.island = f.island AND m.pos = f.pos + 1)),
clusters AS (SELECT v.*, f.cluster_seq FROM findings_v v JOIN fold f ON v.job_id = f.job_id AND v.seq = f.seq),
agents AS (SELECT job_id, cluster_seq, count(*) AS members, max(confidence) AS confidence,
    arg_min(severity, {RANK} * 1e12 + seq) AS severity, arg_min(category, {RANK} * 1e12 + seq) AS category,
    arg_min(title, {RANK} * 1e12 + seq) AS title, arg_min(line_number, {RANK} * 1e12 + seq) AS line_number,
    arg_min(file_path, {RANK} * 1e12 + seq) AS file_path,
    string_agg('**' || agent || '**: ' || description, chr(10) || chr(10) ORDER BY seq) AS descriptions,
    list_sort(list(DISTINCT agent)) AS agent_list,
    CASE WHEN count(*) > 1 THEN arg_min(fix_example, seq) FILTER (WHERE fix_example <> '')
         ELSE min(fix_example) END AS fix_example,
    arg_min(description, seq) AS first_description
  FROM clusters GROUP BY 1, 2),
advice AS (SELECT job_id, cluster_seq, string_agg(suggestion, ' | ' ORDER BY first_seq) AS suggestion
  FROM (SELECT job_id, cluster_seq, suggestion, min(seq) AS first_seq FROM clusters GROUP BY 1, 2, 3) GROUP BY 1, 2),
merged AS (SELECT job_id, cluster_seq AS seq, file_path, line_number, severity, category, title, confidence, members, fix_example,
    CASE WHEN members > 1 THEN array_to_string(list_transform(agent_list, lambda a: '[' || upper(a) || ']'), '')
         ELSE agent_list[1] END AS agent,
    CASE WHEN members > 1 THEN descriptions ELSE first_description END AS description, suggestion,
    array_to_string(agent_list, ',') AS contributing_agents
  FROM agents JOIN advice USING (job_id, cluster_seq))
"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    return of.with_finding_defaults(view(spark, d, "findings_v"))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return of.cluster_findings(findings(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return of.merge_findings(clustered(spark, d))


@query("cluster_findings", CLUSTERS + "SELECT job_id, seq, cluster_seq FROM clusters")
def cluster_findings(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).select("job_id", "seq", "cluster_seq")


@query(
    "seed_member_pairs",
    CLUSTERS + """SELECT c.job_id, c.seq, c.cluster_seq, c.line_number - s.line_number AS line_distance,
  c.category = s.category AS same_category,
  array_to_string(list_sort(list_intersect(ct.ws, st.ws)), ' ') AS shared_words
FROM clusters c JOIN clusters s ON c.job_id = s.job_id AND c.cluster_seq = s.seq
JOIN t ct ON ct.job_id = c.job_id AND ct.seq = c.seq JOIN t st ON st.job_id = s.job_id AND st.seq = s.seq
WHERE c.seq <> c.cluster_seq""",
)
def seed_member_pairs(spark: SparkSession, d: str) -> DataFrame:
    return of.seed_member_pairs(clustered(spark, d)).select(
        "job_id", "seq", "cluster_seq", "line_distance", "same_category",
        F.array_join("shared_words", " ").alias("shared_words"),
    )


MERGED_COLUMNS = [
    "job_id", "seq", "agent", "file_path", "line_number", "severity", "category", "title",
    "description", "suggestion", "fix_example", "confidence", "members",
]


@query(
    "merge_findings",
    CLUSTERS + f"SELECT {', '.join(MERGED_COLUMNS)}, contributing_agents FROM merged",
)
def merge_findings(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select(
        *MERGED_COLUMNS, F.array_join("contributing_agents", ",").alias("contributing_agents")
    )


@query(
    "rank_findings",
    CLUSTERS + f"""SELECT job_id, seq, severity,
  row_number() OVER (PARTITION BY job_id ORDER BY {RANK}, seq) AS rank FROM merged""",
)
def rank_findings(spark: SparkSession, d: str) -> DataFrame:
    return of.rank_findings(merged(spark, d)).select("job_id", "seq", "severity", "rank")


@query(
    "dedup_stats",
    CLUSTERS + """SELECT job_id, count(*) AS input_findings, count(DISTINCT cluster_seq) AS output_findings,
  count(*) - count(DISTINCT cluster_seq) AS groups_merged FROM clusters GROUP BY job_id""",
)
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return of.dedup_stats(clustered(spark, d))


@query(
    "stream_merged_findings",
    CLUSTERS + f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY {RANK}, seq) AS rank, file_path, line_number,
  severity, title, members, md5(description) AS description_md5 FROM merged""",
)
def stream_merged_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of all jobs in several micro-batches; each clusters anew what it touches."""
    rows = view(spark, d, "findings_v")
    order = finding_order(0, F.lit(0), 0, F.col("seq"), 0)
    source, store, done, state = (new_folder(spark, n) for n in ("stream", "store", "merged", "state"))
    with for_one_action(spark):
        rows.repartition(3, "severity", "line_number").write.option("compression", "zstd").parquet(source)
    raw = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream = of.with_finding_defaults(raw).withColumn("seq", order)
    st.stream_merged_findings(stream, store, done, state).awaitTermination()
    return st.read_merged_findings(spark, done).select(
        "job_id", "rank", "file_path", "line_number", "severity", "title", "members",
        F.md5("description").alias("description_md5"),
    )


COMMENT = f"""'**' || coalesce({sql_case('severity', fixed.SEVERITY_ICONS)}, '{fixed.DEFAULT_ICON}') || ' ' || severity || ': ' || title
  || '**' || chr(10) || chr(10) || description || chr(10) || chr(10) || '**Suggestion:** ' || suggestion
  || CASE WHEN fix_example <> '' THEN chr(10) || chr(10) || repeat(chr(96), 3) || chr(10) || fix_example || chr(10) || repeat(chr(96), 3) ELSE '' END
  || chr(10) || chr(10) || '*Detected by mergelight ' || replace(contributing_agents, ',', ', ') || '*'"""


@query(
    "format_finding",
    CLUSTERS + f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY {RANK}, seq) AS rank,
  file_path AS path, line_number AS line, 'RIGHT' AS side, {COMMENT} AS body FROM merged""",
)
def format_finding(spark: SparkSession, d: str) -> DataFrame:
    return rp.review_comments(of.rank_findings(merged(spark, d)))


@query(
    "line_islands",
    """WITH u AS (SELECT DISTINCT job_id, file_path, line_number FROM findings_v),
g AS (SELECT *, line_number - lag(line_number) OVER w AS gap FROM u WINDOW w AS (PARTITION BY job_id, file_path ORDER BY line_number)),
s AS (SELECT *, CASE WHEN gap IS NULL OR gap > 3 THEN line_number END AS first FROM g)
SELECT job_id, file_path, line_number,
  max(first) OVER (PARTITION BY job_id, file_path ORDER BY line_number) AS island FROM s""",
)
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "findings_v").select("job_id", "file_path", "line_number").distinct()
    return rk.line_islands(
        lines, ["job_id", "file_path"], "line_number", fixed.LINE_PROXIMITY
    ).select("job_id", "file_path", "line_number", "island")


JOBS_SQL = "SELECT DISTINCT job_id FROM files_v"


@query(
    "review_decision",
    """SELECT j.job_id, CASE WHEN count(f.seq) = 0 THEN 'APPROVE'
  WHEN count(*) FILTER (WHERE f.severity IN ('CRITICAL', 'HIGH')) > 0 THEN 'REQUEST_CHANGES'
  ELSE 'COMMENT' END AS review_decision
FROM (SELECT DISTINCT job_id || CASE WHEN seq % 2 = 0 THEN 'x' ELSE '' END AS job_id FROM findings_v) j
LEFT JOIN (SELECT * FROM findings_v WHERE job_id <> 'pr3' OR severity NOT IN ('CRITICAL', 'HIGH')) f USING (job_id)
GROUP BY j.job_id""",
)
def review_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings_v")
    suffix = F.when(F.col("seq") % 2 == 0, "x").otherwise("")
    jobs = rows.select(F.concat("job_id", suffix).alias("job_id")).distinct()
    mild = ~F.col("severity").isin("CRITICAL", "HIGH")
    return of.review_decision(jobs, rows.filter((F.col("job_id") != "pr3") | mild))


@query(
    "severity_counts",
    """SELECT job_id, count(*) AS total_findings,
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
  count(*) FILTER (WHERE severity = 'HIGH') AS high_count,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_count,
  count(*) FILTER (WHERE severity = 'LOW') AS low_count,
  count(*) FILTER (WHERE severity = 'INFO') AS info_count FROM findings_v GROUP BY job_id""",
)
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return of.severity_counts(view(spark, d, "findings_v"))


RUNS_SQL = """runs AS (SELECT job_id, agent, CAST(min(ord) AS INTEGER) AS ord, CAST(max(seconds) AS DOUBLE) AS processing_time_seconds,
    CAST(max(files) AS BIGINT) AS files_analyzed FROM (
  SELECT job_id, agent, CASE agent WHEN 'BugDetector' THEN 0 WHEN 'SecurityScanner' THEN 1 WHEN 'StyleAdvisor' THEN 2 ELSE 3 END AS ord,
    seq % 40 / 4.0 AS seconds, seq % 13 AS files FROM findings_v
  UNION ALL SELECT DISTINCT job_id, 'Idle', 4, 0.25, 2 FROM findings_v) GROUP BY job_id, agent)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings_v")
    order = F.array_position(F.array(*[F.lit(a) for a in fixed.AGENTS]), F.col("agent")) - 1
    busy = rows.groupBy("job_id", "agent").agg(
        F.min(order).cast("int").alias("ord"),
        (F.max(F.col("seq") % 40) / 4).cast("double").alias("processing_time_seconds"),
        F.max(F.col("seq") % 13).alias("files_analyzed"),
    )
    idle = rows.select("job_id").distinct().select(
        "job_id", F.lit("Idle").alias("agent"), F.lit(4).alias("ord"),
        F.lit(0.25).alias("processing_time_seconds"),
        F.lit(2).cast("bigint").alias("files_analyzed"),
    )
    return busy.unionByName(idle).withColumn("error", F.lit(None).cast("string"))


@query(
    "agent_performance",
    f"""WITH {RUNS_SQL}
SELECT r.job_id, r.agent, r.ord, count(f.seq) AS findings, r.processing_time_seconds, r.files_analyzed
FROM runs r LEFT JOIN findings_v f ON r.job_id = f.job_id AND r.agent = f.agent
GROUP BY r.job_id, r.agent, r.ord, r.processing_time_seconds, r.files_analyzed""",
)
def agent_performance(spark: SparkSession, d: str) -> DataFrame:
    return of.agent_performance(runs(spark, d), view(spark, d, "findings_v")).drop("error")


@query(
    "review_totals",
    f"""WITH {RUNS_SQL}
SELECT job_id, CAST(sum(files_analyzed) AS BIGINT) AS files_reviewed,
  round(sum(processing_time_seconds), 6) AS total_time FROM runs GROUP BY job_id""",
)
def review_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = of.review_totals(runs(spark, d))
    return totals.withColumn("total_time", F.round("total_time", 6))


SUMMARY_TEXT = f"""'## \U0001f9d9 mergelight Review Summary' || nl || nl || '**PR:** ' || coalesce(pr_title, 'N/A') || nl
  || '**Repository:** ' || coalesce(repo, 'N/A') || nl || nl || '### Findings' || nl || nl || '| Severity | Count |' || nl
  || '|----------|-------|' || nl || {" || ".join(
      f"'| {fixed.SEVERITY_ICONS[s]} {s.title()} | ' || count_{s} || ' |' || nl" for s in fixed.SEVERITIES)}
  || '| **Total** | **' || total || '** |' || nl || nl || '### Agent Performance' || nl || nl
  || '| Agent | Findings | Time |' || nl || '|-------|----------|------|' || nl || coalesce(agent_rows || nl, '') || nl
  || '**Files reviewed:** ' || coalesce(files, 0) || nl || '**Total analysis time:** ' || printf('%.1fs', coalesce(seconds, 0.0)) || nl || nl
  || '---' || nl || '*Powered by mergelight*'"""


@query(
    "executive_summary",
    f"""WITH {RUNS_SQL},
perf AS (SELECT r.job_id, r.ord, r.agent, r.processing_time_seconds AS t, count(f.seq) AS n
  FROM runs r LEFT JOIN findings_v f ON r.job_id = f.job_id AND r.agent = f.agent GROUP BY 1, 2, 3, 4),
agent_text AS (SELECT job_id, string_agg('| ' || agent || ' | ' || n || ' | ' || printf('%.1fs', t) || ' |', chr(10) ORDER BY ord) AS agent_rows
  FROM perf GROUP BY job_id),
counts AS (SELECT job_id, count(*) AS total, {", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS count_{s}" for s in fixed.SEVERITIES)}
  FROM findings_v WHERE seq % 3 = 0 GROUP BY job_id),
totals AS (SELECT job_id, CAST(sum(files_analyzed) AS BIGINT) AS files, sum(processing_time_seconds) AS seconds FROM runs GROUP BY job_id),
jobs AS (SELECT job_id, CASE WHEN job_id < 'pr2' THEN NULL ELSE 'Change ' || job_id END AS pr_title, 'org/' || job_id AS repo
  FROM (SELECT DISTINCT job_id FROM findings_v))
SELECT job_id, {SUMMARY_TEXT} AS executive_summary
FROM (SELECT *, chr(10) AS nl FROM jobs JOIN counts USING (job_id) JOIN agent_text USING (job_id) JOIN totals USING (job_id))""",
)
def executive_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings_v")
    title = F.when(F.col("job_id") >= "pr2", F.concat(F.lit("Change "), "job_id"))
    jobs = rows.select("job_id").distinct().select(
        "job_id", title.alias("pr_title"), F.concat(F.lit("org/"), "job_id").alias("repo")
    )
    return rp.executive_summary(jobs, rows, rows.filter(F.col("seq") % 3 == 0), runs(spark, d))


MAPPED_SQL = """mapped AS (SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rank, file_path AS path,
    line_number AS line, description AS body, CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(seq % 50 AS INTEGER) END AS position
  FROM findings_v)"""


def mapped_comments(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings_v")
    ranked = rk.range_rank(rows, "job_id", ["seq"], "rank")
    return ranked.select(
        "job_id", "rank", F.col("file_path").alias("path"), F.col("line_number").alias("line"),
        F.col("description").alias("body"),
        F.when(F.col("seq") % 5 != 0, (F.col("seq") % 50).cast("int")).alias("position"),
    )


@query(
    "additional_findings_section",
    f"""WITH {MAPPED_SQL}
SELECT job_id, (rank - 1) // 1000 AS part, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Additional findings:**' || chr(10)
  || string_agg(chr(10) || '- **' || path || ':' || line || '** — ' || body || chr(10), '' ORDER BY rank) AS section
FROM mapped WHERE position IS NULL GROUP BY 1, 2""",
)
def additional_findings_section(spark: SparkSession, d: str) -> DataFrame:
    return rp.additional_findings_section(mapped_comments(spark, d), comments_per_part=1000)


@query(
    "review_payload",
    f"""WITH {MAPPED_SQL},
texts AS (SELECT job_id, (rank - 1) // 1000 AS part, count(position) AS n_comments,
    '[' || coalesce(string_agg('{{"path":"' || path || '","position":' || position || ',"body":"' || body || '"}}', ',' ORDER BY rank)
      FILTER (position IS NOT NULL), '') || ']' AS comments,
    '\\n\\n---\\n\\n**Additional findings:**\\n' || string_agg('\\n- **' || path || ':' || line || '** — ' || body || '\\n', '' ORDER BY rank)
      FILTER (position IS NULL) AS section FROM mapped GROUP BY 1, 2)
SELECT job_id, part, n_comments, md5('{{"commit_id":"sha-' || job_id || '","body":"' || CASE WHEN part = 0 THEN 'SUMMARY' ELSE '' END
  || coalesce(section, '') || '","event":"' || CASE WHEN part = 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END
  || '","comments":' || comments || '}}') AS payload_md5 FROM texts""",
)
def review_payload(spark: SparkSession, d: str) -> DataFrame:
    mapped = mapped_comments(spark, d)
    names = mapped.select("job_id").distinct()
    jobs = names.select("job_id", F.concat(F.lit("sha-"), "job_id").alias("head_sha"))
    summary = names.select(
        "job_id", F.lit("SUMMARY").alias("executive_summary"),
        F.lit("REQUEST_CHANGES").alias("review_decision"),
    )
    payloads = rp.review_payload(jobs, mapped, summary, comments_per_part=1000)
    return payloads.select(
        "job_id", "part",
        F.size(F.from_json("payload", "comments ARRAY<STRUCT<position: INT>>")["comments"]).cast("bigint").alias("n_comments"),
        F.md5("payload").alias("payload_md5"),
    )


@query(
    "union_findings",
    """SELECT agent, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM findings_v GROUP BY agent""",
)
def union_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = findings(spark, d)
    tables = [rows.filter(F.col("agent") == name) for name in fixed.AGENTS]
    return of.union_findings(tables).groupBy("agent").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


@query(
    "finding_factory",
    """SELECT seq, sha256(concat_ws('|', job_id, agent, file_path, line_number, category, seq)) AS id,
  confidence, 0 AS n_agents FROM findings_v""",
)
def finding_factory(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select(
        "seq", "id", "confidence", F.size("contributing_agents").alias("n_agents")
    )


@query(
    "severity_set",
    """SELECT job_id, file_path, array_to_string(list_sort(list(DISTINCT severity)), ',') AS severities
FROM findings_v GROUP BY 1, 2""",
)
def severity_set(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "findings_v").groupBy("job_id", "file_path").agg(
        F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities")
    )


@query(
    "validate_findings",
    """SELECT seq, severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO') AND confidence BETWEEN 0 AND 1
  AND line_number >= 1 AND title <> '' AS sound
FROM (SELECT seq, CASE WHEN seq % 97 = 0 THEN 'BLOCKER' ELSE severity END AS severity,
  confidence * 1.25 AS confidence, line_number - 30 AS line_number, title FROM findings_v)""",
)
def validate_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings_v").withColumns({
        "severity": F.when(F.col("seq") % 97 == 0, "BLOCKER").otherwise(F.col("severity")),
        "confidence": F.col("confidence") * 1.25,
        "line_number": F.col("line_number") - 30,
    })
    good, bad = rs.validate_findings(rows)
    return good.select("seq", F.lit(True).alias("sound")).unionByName(
        bad.select("seq", F.lit(False).alias("sound"))
    )


@query(
    "review_summary_row",
    f"""WITH {RUNS_SQL},
jobs AS (SELECT DISTINCT job_id FROM findings_v UNION ALL SELECT DISTINCT 'idle-' || job_id FROM findings_v),
files AS (SELECT job_id, count(DISTINCT file_path) AS files_reviewed FROM findings_v GROUP BY job_id),
counts AS (SELECT job_id, count(*) AS total_findings, {", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}_count" for s in fixed.SEVERITIES[:4])}
  FROM findings_v WHERE seq % 3 = 0 AND (job_id <> 'pr3' OR severity NOT IN ('CRITICAL', 'HIGH')) GROUP BY job_id),
agents AS (SELECT r.job_id, string_agg(r.agent || ':' || n, ',' ORDER BY r.ord) AS agent_counts, sum(r.processing_time_seconds) AS seconds
  FROM (SELECT r.job_id, r.agent, r.ord, r.processing_time_seconds, count(f.seq) AS n FROM runs r
    LEFT JOIN findings_v f ON r.job_id = f.job_id AND r.agent = f.agent GROUP BY 1, 2, 3, 4) r GROUP BY r.job_id)
SELECT job_id, coalesce(total_findings, 0) AS total_findings, {", ".join(
    f"coalesce({s.lower()}_count, 0) AS {s.lower()}_count" for s in fixed.SEVERITIES[:4])},
  coalesce(files_reviewed, 0) AS files_reviewed,
  CASE WHEN total_findings IS NULL THEN 'APPROVE' WHEN critical_count + high_count > 0 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS review_decision,
  files_reviewed IS NULL AS nothing_to_review, coalesce(agent_counts, '') AS agent_counts,
  round(coalesce(seconds, 0), 6) AS processing_time_seconds
FROM jobs LEFT JOIN files USING (job_id) LEFT JOIN counts USING (job_id) LEFT JOIN agents USING (job_id)""",
)
def review_summary_row(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "findings_v")
    mild = ~F.col("severity").isin("CRITICAL", "HIGH")
    kept = rows.filter((F.col("seq") % 3 == 0) & ((F.col("job_id") != "pr3") | mild))
    names = rows.select("job_id").distinct()
    jobs = names.unionByName(names.withColumn("job_id", F.concat(F.lit("idle-"), "job_id")))
    jobs = jobs.withColumns({
        "repo": F.lit("o/r"), "pr_number": F.lit(1), "pr_title": F.lit("t"),
    })
    files = rows.select("job_id", "file_path").distinct()
    summary = rp.review_summary(jobs, files, rows, kept, runs(spark, d))
    counted = F.transform(
        "agent_results", lambda r: F.concat(r["agent"], F.lit(":"), r["findings"].cast("string"))
    )
    return summary.select(
        "job_id", "total_findings", "critical_count", "high_count", "medium_count", "low_count",
        "files_reviewed", "review_decision",
        (F.col("executive_summary") == fixed.NO_FILES_SUMMARY).alias("nothing_to_review"),
        F.coalesce(F.array_join(counted, ","), F.lit("")).alias("agent_counts"),
        F.round("processing_time_seconds", 6).alias("processing_time_seconds"),
    )
