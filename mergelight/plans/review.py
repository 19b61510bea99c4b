"""From changed files to decisions, comments, summaries and payloads.

File content is read where it lies and never shuffled: one pass gives a narrow facts
table (names, functions, imports), one pass runs the rules, and only the text of files
that can be tests meets the functions it may mention.  Order, impact and merging work on
names and findings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.files import is_security_sensitive
from mergelight.functions.text import dirname
from mergelight.operators.conventions import (
    added_code_blocks,
    convention_answers,
    convention_prompt,
    files_with_conventions,
    fresh_conventions,
    learn_conventions,
    recent_merged_prs,
    repos_to_refresh,
)
from mergelight.operators.coverage import (
    basic_coverage_findings,
    coverage_gaps,
    is_coverage_source,
    test_texts,
    tested_files,
)
from mergelight.operators.diffs import map_comments, parse_diff
from mergelight.operators.files import analyzable_files, review_priority, reviewable_files
from mergelight.operators.findings import (
    cluster_findings,
    merge_findings,
    rank_findings,
    resequence,
    union_findings,
)
from mergelight.operators.graph import build_graph, impact_scores
from mergelight.operators.ranking import range_rank
from mergelight.operators.reports import review_comments, review_payload, review_summary
from mergelight.operators.responses import (
    bug_prompts,
    coverage_prompts,
    response_findings,
    score_with_model,
    security_prompts,
    split_errors,
    style_prompts,
)
from mergelight.operators.text import file_facts, scan_security_rules
from mergelight.session import by_merge, cut_lineage
from mergelight.sources.readers import scan_code_files

Model = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class ReviewInput:
    """What a detector sees: files with content, their facts, conventions per repo."""

    files: DataFrame
    facts: DataFrame
    order: DataFrame
    edges: DataFrame
    jobs: DataFrame
    conventions: DataFrame | None = None


@dataclass(frozen=True)
class Found:
    """Findings of a detector and what failed on the way: (job_id, error), one row each."""

    findings: DataFrame
    failed: DataFrame


# A detector turns the input into findings.
Detector = Callable[[ReviewInput], DataFrame | Found]


@dataclass(frozen=True)
class Review:
    """Tables of finished reviews, all keyed by job.

    ``failed`` has (job_id, agent, error) of every failure, ``learned`` the profiles by repo that
    were not in the cache, for ``write_conventions``.
    """

    order: DataFrame
    raw_findings: DataFrame
    findings: DataFrame
    comments: DataFrame
    agent_runs: DataFrame
    summary: DataFrame
    failed: DataFrame | None = None
    learned: DataFrame | None = None


def rule_detector(seen: ReviewInput) -> DataFrame:
    return scan_security_rules(analyzable_files(seen.files))


def _ordered_facts(seen: ReviewInput) -> DataFrame:
    """Facts numbered by review order, since the first test file in that order counts."""
    order = seen.order.select("job_id", "filename", "review_ord")
    return seen.facts.join(by_merge(order), ["job_id", "filename"]).drop("ord").withColumnRenamed(
        "review_ord", "ord"
    )


def coverage_detector(seen: ReviewInput) -> DataFrame:
    gaps = coverage_gaps(_ordered_facts(seen), test_texts(seen.files))
    return basic_coverage_findings(gaps)


def _cut(files: DataFrame, limit: int) -> DataFrame:
    """Content as far as a prompt shows it, so that no more of it travels."""
    return files.withColumn("content", F.substring("content", 1, limit))


def _answers(prompts: DataFrame, model: Model, agent: str) -> tuple[DataFrame, DataFrame]:
    """Ask the model once: its answers as the responses table, and failed prompts."""
    good, bad = split_errors(cut_lineage(score_with_model(prompts, model)))
    columns = {
        "agent": F.lit(agent), "file_path": F.col("filename"), "file_ord": F.col("ord"),
        "chunk_index": F.lit(0), "chunk_start": F.lit(1), "has_test_file": F.lit(True),
    }
    present = {n: F.col(n) for n in columns if n in good.columns}
    return good.withColumns({**columns, **present}), bad


def _flat_functions(facts: DataFrame) -> DataFrame:
    return facts.select("job_id", "ord", F.inline("functions")).select(
        "job_id", "ord", "func_ord", "name"
    )


def bug_detector(model: Model) -> Detector:
    """Model findings per chunk."""

    def detect(seen: ReviewInput) -> DataFrame:
        prompts = bug_prompts(analyzable_files(seen.files))
        answers, failed = _answers(prompts, model, "BugDetector")
        return Found(response_findings(answers), failed)

    return detect


def security_detector(model: Model) -> Detector:
    """Rule hits of every file, model findings of sensitive files."""

    def detect(seen: ReviewInput) -> DataFrame:
        sources = analyzable_files(seen.files)
        sensitive = sources.filter(is_security_sensitive(F.col("filename"), F.col("content")))
        answers, failed = _answers(security_prompts(sensitive), model, "SecurityScanner")
        return Found(scan_security_rules(sources).unionByName(response_findings(answers)), failed)

    return detect


def style_detector(model: Model) -> Detector:
    """Model findings against the conventions of the repository."""

    def detect(seen: ReviewInput) -> DataFrame:
        conventions = seen.conventions
        if conventions is None:
            conventions = seen.jobs.select("repo").distinct().withColumns({
                **{n: F.lit(v) for n, v in fixed.CONVENTION_DEFAULTS.items()},
                "common_patterns": F.array().cast("array<string>"),
                "anti_patterns": F.array().cast("array<string>"),
            })
        sources = _cut(analyzable_files(seen.files), fixed.PROMPT_CHARS["style"]).join(
            seen.jobs.select("job_id", "repo"), "job_id"
        )
        prompts = style_prompts(files_with_conventions(sources, conventions))
        answers, failed = _answers(prompts, model, "StyleAdvisor")
        return Found(response_findings(answers), failed)

    return detect


def model_coverage_detector(model: Model) -> Detector:
    """Model findings for files with something untested; plain findings where it fails."""

    def detect(seen: ReviewInput) -> DataFrame:
        facts = cut_lineage(_ordered_facts(seen))
        texts = test_texts(seen.files)
        gaps = cut_lineage(coverage_gaps(facts, texts))
        shown = texts.withColumn("test_content", F.substring("test_content", 1, fixed.PROMPT_TEST_CHARS))
        tests = tested_files(facts).join(by_merge(shown), ["job_id", "test_filename"])
        wanted = gaps.select("job_id", "ord", "filename").distinct()
        sources = _cut(seen.files.drop("ord"), fixed.PROMPT_CHARS["coverage"]).join(
            by_merge(wanted), ["job_id", "filename"]
        )
        prompts = coverage_prompts(sources, _flat_functions(facts), tests)
        asked = cut_lineage(score_with_model(prompts, model))
        good, bad = split_errors(asked)
        answers = good.withColumns({
            "agent": F.lit("TestCoverage"), "file_path": F.col("filename"),
            "file_ord": F.col("ord"), "chunk_index": F.lit(0), "chunk_start": F.lit(1),
        })
        plain = gaps.join(by_merge(bad.select("job_id", "ord")), ["job_id", "ord"], "left_semi")
        return Found(response_findings(answers).unionByName(basic_coverage_findings(plain)), bad)

    return detect


def default_detectors(model: Model | None = None) -> dict[str, Detector]:
    """Detectors by agent name, in agent order; without a model, rules and coverage only."""
    if model is None:
        return {"SecurityScanner": rule_detector, "TestCoverage": coverage_detector}
    return {
        "BugDetector": bug_detector(model),
        "SecurityScanner": security_detector(model),
        "StyleAdvisor": style_detector(model),
        "TestCoverage": model_coverage_detector(model),
    }


def agent_runs(
    facts: DataFrame, agents: list[str] | None = None, failed: DataFrame | None = None
) -> DataFrame:
    """One run per job and agent with the number of files it looks at.

    ``failed`` (job_id, agent, error) has what failed; a run's ``error`` gives the number of
    failures and the least of their texts.  Spark runs agents as branches of one job, so
    there is no time per agent: it is 0.
    """
    counted = facts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("all_files"),
        F.count_if(is_coverage_source()).alias("source_files"),
    )
    rows = [
        F.struct(
            F.lit(name).alias("agent"), F.lit(n).alias("ord"),
            F.col("source_files" if name == "TestCoverage" else "all_files")
            .alias("files_analyzed"),
        )
        for n, name in enumerate(agents or fixed.AGENTS)
    ]
    runs = counted.select("job_id", F.inline(F.array(*rows))).withColumn(
        "processing_time_seconds", F.lit(0.0)
    )
    if failed is None:
        return runs.withColumn("error", F.lit(None).cast("string"))
    errors = failed.groupBy("job_id", "agent").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" failed: "), F.min("error")).alias("error")
    )
    return runs.join(errors, ["job_id", "agent"], "left").select(*runs.columns, "error")


def merged_review_findings(raw_findings: DataFrame) -> DataFrame:
    """Cluster, merge and rank."""
    return rank_findings(cut_lineage(merge_findings(cluster_findings(raw_findings))))


def repo_conventions(
    repos: DataFrame, merged_prs: DataFrame, stored: DataFrame | None = None,
    now: Column | None = None, model: Model | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Profiles of all ``repos``, and those of them that had to be learned.

    The newest stored profile counts while it is younger than a day at ``now``; other repos are
    learned from their merged pull requests, with a model's description where one is given.
    A repo without merged pull requests has the defaults; an answer that fails costs its own
    repo the model's part only.
    """
    names = [*fixed.CONVENTION_DEFAULTS, "common_patterns", "anti_patterns"]
    wanted = repos.select("repo").distinct()
    if stored is None:
        missing, fresh = cut_lineage(wanted), None
    else:
        missing = cut_lineage(repos_to_refresh(wanted, stored, now))
        known = fresh_conventions(stored, now)
        fresh = files_with_conventions(known.join(wanted, "repo", "left_semi").select("repo"), known)
    prs = merged_prs.join(missing, "repo", "left_semi")
    described = None
    if model is not None:
        prompts = convention_prompt(added_code_blocks(recent_merged_prs(prs))).select("repo", "prompt")
        described = convention_answers(cut_lineage(score_with_model(prompts, model, batch_rows=1)))
    learned = cut_lineage(learn_conventions(missing, prs, described))
    profiles = learned if fresh is None else learned.unionByName(fresh.select("repo", *names))
    return profiles, learned


def review(
    jobs: DataFrame, files: DataFrame, conventions: DataFrame | None = None,
    detectors: dict[str, Detector] | None = None, merged_prs: DataFrame | None = None,
    now: Column | None = None, model: Model | None = None,
) -> Review:
    """Review every job: ``jobs`` (schemas.JOBS) and their changed ``files`` (schemas.FILES).

    With ``merged_prs``, ``conventions`` is the cache of stored profiles at ``now``: repos
    without a fresh one are learned (see ``repo_conventions``), and new profiles are in
    ``learned``.  With a ``model`` all four agents run and conventions are described by it.
    """
    detectors = detectors or default_detectors(model)
    learned = None
    if merged_prs is not None:
        conventions, learned = repo_conventions(jobs.select("repo"), merged_prs, conventions, now, model)
    kept = reviewable_files(files)
    facts = cut_lineage(file_facts(kept))
    edges = cut_lineage(build_graph(facts))
    names = facts.select("job_id", "ord", "filename")
    order = cut_lineage(review_priority(names, impact_scores(names, edges)))
    seen = ReviewInput(kept, facts, order, edges, jobs, conventions)
    made = {name: detect(seen) for name, detect in detectors.items()}
    found = [f.findings if isinstance(f, Found) else f for f in made.values()]
    raw = resequence(union_findings(found), order)
    merged = cut_lineage(merged_review_findings(raw))
    failed = [
        f.failed.select("job_id", F.lit(name).alias("agent"), "error")
        for name, f in made.items() if isinstance(f, Found)
    ]
    failures = reduce(DataFrame.unionByName, failed) if failed else None
    runs = agent_runs(facts, list(detectors), failures)
    return Review(
        order=order, raw_findings=raw, findings=merged, comments=review_comments(merged),
        agent_runs=runs, summary=review_summary(jobs, names, raw, merged, runs),
        failed=failures, learned=learned,
    )


def review_payloads(jobs: DataFrame, done: Review, diffs: DataFrame) -> DataFrame:
    """Review bodies with comments at diff positions."""
    mapped = map_comments(done.comments, parse_diff(diffs))
    return review_payload(jobs, mapped, done.summary)


def number_files(files: DataFrame) -> DataFrame:
    """Add ``ord`` by folder and name; names only are sorted, content stays where it is."""
    names = files.select("job_id", "filename", dirname(F.col("filename")).alias("_folder"))
    numbered = range_rank(names, "job_id", ["_folder", "filename"], "ord").drop("_folder")
    return files.join(by_merge(numbered), ["job_id", "filename"])


def review_directory(spark: SparkSession, root: str, job_id: str = "local") -> Review:
    """Review a code tree on disk as one job, files in path order."""
    files = number_files(scan_code_files(spark, root, job_id))
    jobs = spark.range(1).select(
        F.lit(job_id).alias("job_id"), F.lit(root).alias("repo"), F.lit(0).alias("pr_number"),
        F.lit("").alias("pr_title"), F.lit("").alias("head_sha"),
    )
    return review(jobs, files)
