"""Findings: union, similarity clustering, merge, rank, decision and counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mergelight import fixed, schemas
from mergelight.functions.findings import (
    agent_tag,
    finding_id,
    meaningful_words,
    severity_rank,
    shared_title_words,
)
from mergelight.operators.clustering import NODE, greedy_seeds
from mergelight.operators.ranking import range_rank
from mergelight.session import by_merge, cut_lineage

FINDING_FIELDS = [tuple(field.split(" ", 1)) for field in schemas.FINDINGS.split(", ")]


def with_finding_defaults(df: DataFrame, agent: str | None = None) -> DataFrame:
    """Project to the findings schema; fill id, agent, confidence and empty lists."""
    present = set(df.columns)
    if "agent" not in present:
        df = df.withColumn("agent", F.lit(agent))
    confidence = F.col("confidence") if "confidence" in present else F.lit(None)
    filled = {
        "confidence": F.coalesce(confidence.cast("double"), F.lit(0.7)),
        "contributing_agents": (
            F.col("contributing_agents") if "contributing_agents" in present else F.array()
        ),
    }
    if "id" not in present:
        filled["id"] = finding_id(
            *map(F.col, ["job_id", "agent", "file_path", "line_number", "category", "seq"])
        )
    columns = []
    for name, kind in FINDING_FIELDS:
        if name in filled:
            value = filled[name]
        elif name in present or name == "agent":
            value = F.col(name)
        else:
            value = F.lit(None)
        if name == "seq" and isinstance(df.schema["seq"].dataType, StructType):
            columns.append(value)
        else:
            columns.append(value.cast(kind).alias(name))
    return df.select(*columns)


def union_findings(tables: list[DataFrame]) -> DataFrame:
    """All agents' findings; ``seq`` keeps agent, file and in-file order."""
    return reduce(DataFrame.unionByName, tables)


def number_findings(findings: DataFrame) -> DataFrame:
    """Findings of detectors with ``seq`` as their number in the job, in finding order from 1."""
    numbered = range_rank(findings, "job_id", ["seq", "agent", "id"], "_number")
    return numbered.withColumn("seq", F.col("_number")).select(*findings.columns)


def resequence(findings: DataFrame, order: DataFrame) -> DataFrame:
    """Number findings by the review order (job_id, filename, review_ord) of their files.

    Detectors order by the numbers files come with, straight off the scan; the order that
    impact gives is applied here, to findings only.  Files without a place are left out.
    """
    # a name that a job lists twice has the place of its first entry
    placed = order.groupBy("job_id", F.col("filename").alias("file_path")).agg(
        F.min("review_ord").alias("review_ord")
    )
    by_review = F.col("seq").withField("file", F.col("review_ord").cast("bigint"))
    moved = findings.join(by_merge(placed), ["job_id", "file_path"]).withColumn("seq", by_review)
    return number_findings(moved.select(*findings.columns))


# --- clustering --------------------------------------------------------------


PLACE = ["job_id", "file_path", "line_number"]
WRITTEN = [*PLACE, "_category", "_title"]
SIGNATURE = [*PLACE, "_category", "_title_words"]


def cluster_findings(findings: DataFrame, **layout: int) -> DataFrame:
    """Add ``cluster_seq``: the ``seq`` of the seed that a finding joins.

    In ``seq`` order a finding joins the first seed on its file that is at most three
    lines away and similar to it; otherwise it becomes a seed (see ``clustering``).

    Findings with equal place, category and title, then those with equal title words, always share a
    seed, so they are collapsed first (map-side), and a title is taken apart once for all findings that
    have it at one place.  A finding without a job, file or line is near no other and stays alone.
    """
    written = [*map(F.col, PLACE), F.coalesce("category", F.lit("")), F.coalesce("title", F.lit(""))]
    named = [value.alias(name) for name, value in zip(WRITTEN, written)]
    title_words = F.array_join(F.sort_array(meaningful_words(F.col("_title"))), " ")
    distinct = cut_lineage(
        findings.dropna(subset=PLACE).groupBy(*named).agg(F.min("seq").alias("seq"))
        .withColumn("_title_words", title_words)
    )
    nodes = distinct.groupBy(*SIGNATURE).agg(F.min("seq").alias("seq")).toDF(*NODE)
    seeds = greedy_seeds(nodes, **layout).drop("seq").toDF(*SIGNATURE, "cluster_seq")
    chosen = distinct.join(by_merge(seeds), SIGNATURE).select(
        *[F.col(name).alias(f"chosen_{name}") for name in WRITTEN], "cluster_seq"
    )
    # compared as they are written, so no row carries its category and title twice
    same = reduce(and_, [value == F.col(f"chosen_{name}") for name, value in zip(WRITTEN, written)])
    return findings.join(by_merge(chosen), same, "left").select(
        *findings.columns, F.coalesce("cluster_seq", "seq").alias("cluster_seq")
    )


def seed_member_pairs(clustered: DataFrame) -> DataFrame:
    """Each non-seed finding with its seed and the title words they share (linear in size)."""
    seeds = clustered.filter(F.col("seq") == F.col("cluster_seq")).select(
        "job_id", "cluster_seq",
        F.col("line_number").alias("seed_line"), F.col("category").alias("seed_category"),
        F.col("title").alias("seed_title"),
    )
    members = clustered.filter(F.col("seq") != F.col("cluster_seq"))
    return members.join(by_merge(seeds), ["job_id", "cluster_seq"]).select(
        "job_id", "file_path", "cluster_seq", "seq",
        (F.col("line_number") - F.col("seed_line")).alias("line_distance"),
        (F.col("category") == F.col("seed_category")).alias("same_category"),
        F.array_sort(shared_title_words(F.col("seed_title"), F.col("title"))).alias("shared_words"),
    )


# --- merge, rank, decide -----------------------------------------------------


# Members of a cluster whose texts come together in one row of ``merged_parts``.
PART_SIZE = 65_536


def cluster_members(clustered: DataFrame) -> DataFrame:
    """(job_id, cluster_seq, seq, agent, description, suggestion): members, a row each."""
    return clustered.select("job_id", "cluster_seq", "seq", "agent", "description", "suggestion")


BEST = [
    "file_path", "line_number", "end_line", "severity", "category", "title", "agent",
    "description", "suggestion", "fix_example", "code_snippet",
]


def _best_fields(order: Column) -> list[Column]:
    """What the best member has, a column each: one that nobody asks for is neither read nor shuffled."""
    return [F.min_by(n, order).alias(f"best_{n}") for n in BEST]


def _heads(grouped: DataFrame) -> DataFrame:
    """Clusters as findings: what the best member gives, and what all members do."""
    many = F.col("members") > 1
    tags = F.array_join(F.transform("contributing_agents", agent_tag), "")
    return grouped.select(
        "job_id", F.col("cluster_seq").alias("seq"), "id",
        F.when(many, tags).otherwise(F.col("best_agent")).alias("agent"),
        *[F.col(f"best_{n}").alias(n) for n in (
            "file_path", "line_number", "end_line", "severity", "category", "title", "description", "suggestion",
        )],
        *[F.when(many, F.col(n)).otherwise(F.col(f"best_{n}")).alias(n)
          for n in ("code_snippet", "fix_example")],
        "confidence", "contributing_agents", "members",
        *[c for c in grouped.columns if c == "parts"],
    )


def merged_heads(clustered: DataFrame) -> DataFrame:
    """One row per cluster without the joined texts.

    Best severity (first on ties) gives identity and place; the highest confidence, the first
    filled example and snippet, and all agents come from all members.  Aggregates hold one
    value each, so a cluster of any size combines before the shuffle.
    """
    order = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("seq"))

    def first_filled(name: str) -> Column:
        return F.min_by(name, F.when(F.coalesce(F.col(name) != "", F.lit(False)), F.col("seq")))

    grouped = clustered.groupBy("job_id", "cluster_seq").agg(
        F.min_by("id", order).alias("id"),
        *_best_fields(order),
        F.count(F.lit(1)).alias("members"),
        F.array_sort(F.collect_set("agent")).alias("contributing_agents"),
        F.max("confidence").alias("confidence"),
        first_filled("fix_example").alias("fix_example"),
        first_filled("code_snippet").alias("code_snippet"),
    )
    return _heads(grouped)


def merged_parts(members: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """(job_id, seq, part, text, advice): texts of a cluster's members in order, in parts.

    A part holds the members with ``seq`` in one run of ``part_size`` numbers, so no row holds
    more; parts are named by the first number of their run.  ``advice`` lists
    suggestions that are new in the part.
    """
    said = F.struct(
        F.col("seq"), F.concat(F.lit("**"), F.col("agent"), F.lit("**: "), F.col("description")).alias("text")
    )
    key, part = ["job_id", "cluster_seq"], (F.floor(F.col("seq") / part_size) * part_size).alias("part")
    texts = members.groupBy(*key, part).agg(F.array_sort(F.collect_list(said)).alias("said"))
    first = members.filter(F.col("suggestion").isNotNull()).groupBy(*key, "suggestion").agg(F.min("seq").alias("seq"))
    advice = first.groupBy(*key, part).agg(F.array_sort(F.collect_list(F.struct("seq", "suggestion"))).alias("new"))
    return texts.join(by_merge(advice), [*key, "part"], "left").select(
        "job_id", F.col("cluster_seq").alias("seq"), "part",
        F.array_join(F.transform("said", lambda s: s["text"]), "\n\n").alias("text"),
        F.array_join(F.transform("new", lambda s: s["suggestion"]), " | ").alias("advice"),
    )


def merge_findings(clustered: DataFrame, part_size: int | None = None) -> DataFrame:
    """One finding per cluster, with the texts of all its members put together.

    The members are read and shuffled once, to where their cluster is put together: its whole text,
    which is the feature, comes together in one row anyway.  With ``part_size`` members are combined
    there in parts first.  Callers with very large clusters take ``merged_heads`` and ``merged_parts``,
    whose rows are bounded.
    """
    key, snippets = ["job_id", "cluster_seq"], ["fix_example", "code_snippet"]
    order = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("seq"))
    said = F.struct(
        F.col("seq"), F.concat(F.lit("**"), F.col("agent"), F.lit("**: "), F.col("description")).alias("text"),
        F.col("suggestion"),
    )
    run = [] if part_size is None else [F.floor(F.col("seq") / part_size).alias("part")]
    filled = {n: F.when(F.coalesce(F.col(n) != "", F.lit(False)), F.col("seq")) for n in snippets}
    parts = clustered.repartition(*key).groupBy(*key, *run).agg(
        F.min(order).alias("order"),
        F.min_by("id", order).alias("id"),
        *_best_fields(order),
        F.count(F.lit(1)).alias("members"),
        F.collect_set("agent").alias("agents"),
        F.max("confidence").alias("confidence"),
        *[F.min_by(n, at).alias(n) for n, at in filled.items()],
        *[F.min(at).alias(f"{n}_seq") for n, at in filled.items()],
        F.collect_list(said).alias("said"),
    )
    texts = F.transform(
        F.sort_array(F.transform("said", lambda s: F.struct(s["seq"], s["text"]))), lambda s: s["text"]
    )
    numbered = F.filter("said", lambda s: s["seq"].isNotNull())
    advice = F.transform(
        F.sort_array(F.transform(numbered, lambda s: F.struct(s["seq"], s["suggestion"]))), lambda s: s["suggestion"]
    )
    text = F.struct(
        F.array_join(F.nullif(F.array_compact(texts), F.array().cast("array<string>")), "\n\n").alias("text"),
        F.array_distinct(F.array_compact(advice)).alias("advice")
    )
    if part_size is None:
        whole = parts.withColumns({"contributing_agents": F.array_sort("agents"), "parts": F.array(text)})
    else:
        whole = parts.withColumn("text", F.struct("part", text.alias("of"))).groupBy(*key).agg(
            F.min_by("id", "order").alias("id"),
            *[F.min_by(f"best_{n}", "order").alias(f"best_{n}") for n in BEST],
            F.sum("members").alias("members"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("agents")))).alias("contributing_agents"),
            F.max("confidence").alias("confidence"),
            *[F.min_by(n, f"{n}_seq").alias(n) for n in snippets],
            F.transform(F.sort_array(F.collect_list("text")), lambda p: p["of"]).alias("parts"),
        )
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    advised = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["advice"])))
    told = (F.col("members") > 1) & F.col("job_id").isNotNull() & F.col("seq").isNotNull()
    heads = _heads(whole)
    return heads.select(*[
        F.when(told, F.array_join(advised, " | ")).otherwise(F.col(c)).alias(c) if c == "suggestion"
        else F.when(told, joined).otherwise(F.col(c)).alias(c) if c == "description"
        else F.col(c)
        for c in heads.columns if c != "parts"
    ])


def rank_findings(merged: DataFrame) -> DataFrame:
    """Add ``rank`` per job: severity first, equal severity in cluster order.

    Only job, number and severity are computed to be ranked; the other columns come with the result, as
    far as it is asked for them.  Callers that read it several times keep ``merged`` first.
    """
    places = merged.select("job_id", "seq", severity_rank(F.col("severity")).alias("_severity"))
    ranks = range_rank(places, "job_id", ["_severity", "seq"], "rank").drop("_severity")
    return merged.join(by_merge(ranks), ["job_id", "seq"]).select(*merged.columns, "rank")


def review_decision(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """APPROVE without findings, REQUEST_CHANGES on CRITICAL or HIGH, else COMMENT."""
    severe = findings.groupBy("job_id").agg(
        F.bool_or(F.coalesce(F.col("severity").isin("CRITICAL", "HIGH"), F.lit(False)))
        .alias("severe")
    )
    return jobs.select("job_id").join(severe, "job_id", "left").select(
        "job_id",
        F.when(F.col("severe").isNull(), "APPROVE")
        .when(F.col("severe"), "REQUEST_CHANGES")
        .otherwise("COMMENT").alias("review_decision"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per job: number of findings in all and per severity."""
    return findings.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[
            F.count_if(F.col("severity") == name).alias(f"{name.lower()}_count")
            for name in fixed.SEVERITIES
        ],
    )


def agent_performance(agent_runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (before merging) and time per agent run; runs without findings stay."""
    found = findings.groupBy("job_id", "agent").agg(F.count(F.lit(1)).alias("n"))
    return agent_runs.join(found, ["job_id", "agent"], "left").select(
        "job_id", "agent", "ord", F.coalesce("n", F.lit(0)).alias("findings"),
        "processing_time_seconds", "files_analyzed", "error",
    )


def review_totals(agent_runs: DataFrame) -> DataFrame:
    """Per job: files and seconds added up over agents."""
    return agent_runs.groupBy("job_id").agg(
        F.sum("files_analyzed").alias("files_reviewed"),
        F.sum("processing_time_seconds").alias("total_time"),
    )


def dedup_stats(clustered: DataFrame) -> DataFrame:
    """Per job: findings before and after merging, and the difference.

    A cluster is counted at its seed, so the result needs one partial aggregate only.
    """
    seeds = F.count_if(F.col("seq") == F.col("cluster_seq"))
    return clustered.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("input_findings"),
        seeds.alias("output_findings"),
        (F.count(F.lit(1)) - seeds).alias("groups_merged"),
    )
