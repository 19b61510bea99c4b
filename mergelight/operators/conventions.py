"""Coding conventions of a repository, learned from merged pull requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.conventions import docstring_style, naming_style
from mergelight.operators.diffs import added_blocks
from mergelight.operators.responses import parse_model_response
from mergelight.workers import sample_functions


def recent_merged_prs(prs: DataFrame, limit: int = fixed.MERGED_PRS_TO_LEARN_FROM) -> DataFrame:
    """Newest merged pull requests per repo, with ``pr_rank``.

    Of the ``2 * limit`` last updated closed ones, those merged and with a diff, at most
    ``limit``.  Ranking sees keys only (Spark keeps top rows per key before the shuffle);
    diffs join back for the few that stay.
    """
    newest = Window.partitionBy("repo").orderBy(F.desc("updated_at"), F.desc("number"))
    keys = prs.select(
        "repo", "number", "updated_at", "merged_at", F.col("diff").isNotNull().alias("has_diff")
    )
    recent = keys.withColumn("row", F.row_number().over(newest)).filter(
        F.col("row") <= 2 * limit
    )
    merged = recent.filter(F.col("merged_at").isNotNull() & F.col("has_diff"))
    kept = merged.withColumn("pr_rank", F.row_number().over(newest)).filter(
        F.col("pr_rank") <= limit
    )
    return kept.select("repo", "number", "pr_rank").join(
        prs.select("repo", "number", *[c for c in ("title", "merged_at", "diff") if c in prs.columns]),
        ["repo", "number"],
    )


def added_code_blocks(merged: DataFrame, limit: int = fixed.MAX_SAMPLES) -> DataFrame:
    """(repo, sample_ord, sample): added code of merged pull requests, first ``limit``.

    Each row keeps at most ``limit`` blocks before blocks of a repo are numbered.
    """
    blocks = F.slice(added_blocks(F.col("diff")), 1, limit)
    exploded = merged.select(
        "repo", "pr_rank", F.posexplode(blocks).alias("block_ord", "sample")
    )
    order = Window.partitionBy("repo").orderBy("pr_rank", "block_ord")
    numbered = exploded.withColumn("sample_ord", F.row_number().over(order))
    return numbered.filter(F.col("sample_ord") <= limit).select("repo", "sample_ord", "sample")


FACTS = (
    "repo STRING, name STRING, is_async BOOLEAN, has_return_hint BOOLEAN, docstring STRING, "
    "length INT"
)


def function_facts(samples: DataFrame) -> DataFrame:
    """One row per Python function in the samples; samples that do not parse give none."""

    columns = [field.split()[0] for field in FACTS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (row.repo, *facts)
                for row in batch.itertuples(index=False)
                for facts in sample_functions(row.sample)
            ]
            yield pd.DataFrame(rows, columns=columns)

    candidates = samples.filter(F.col("sample").contains("def"))
    return candidates.select("repo", "sample").mapInPandas(parse, FACTS)


def _with_defaults(profile: DataFrame) -> DataFrame:
    """All convention columns; what is missing or null takes its default."""
    columns = [F.col("repo")]
    for name, default in fixed.CONVENTION_DEFAULTS.items():
        value = F.coalesce(F.col(name), F.lit(default)) if name in profile.columns else F.lit(default)
        columns.append(value.alias(name))
    for name in ("common_patterns", "anti_patterns"):
        empty = F.array().cast("array<string>")
        columns.append(
            (F.coalesce(F.col(name), empty) if name in profile.columns else empty).alias(name)
        )
    return profile.select(*columns)


def conventions_from_facts(facts: DataFrame, learned_from: DataFrame) -> DataFrame:
    """Measured profile per repo of ``learned_from``; repos without functions included."""
    style = docstring_style(F.coalesce("docstring", F.lit("")))
    naming = naming_style(F.col("name"))
    counted = facts.groupBy("repo").agg(
        F.count(F.lit(1)).alias("functions"),
        F.count_if(naming == "snake").alias("snake"),
        F.count_if(naming == "camel").alias("camel"),
        F.count_if("has_return_hint").alias("hinted"),
        F.count("docstring").alias("documented"),
        F.count_if(style == "google").alias("google"),
        F.count_if(style == "numpy").alias("numpy"),
        F.count_if(style == "sphinx").alias("sphinx"),
        F.sum("length").alias("lines"),
        F.bool_or("is_async").alias("any_async"),
    )
    joined = learned_from.select("repo").distinct().join(counted, "repo", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns[1:-1]]
    full = joined.select("repo", *zero, F.coalesce("any_async", F.lit(False)).alias("uses_async"))
    mean = F.when(F.col("functions") > 0, F.floor(F.col("lines") / F.col("functions"))).otherwise(50)
    best = F.greatest("google", "numpy", "sphinx")
    return full.select(
        "repo",
        F.when(F.col("snake") >= F.col("camel"), "snake_case").otherwise("camelCase")
        .alias("naming_style"),
        (F.col("hinted") * 2 > F.col("functions")).alias("uses_type_hints"),
        (F.col("documented") * 2 > F.col("functions")).alias("uses_docstrings"),
        F.when(F.col("google") == best, "google").when(F.col("numpy") == best, "numpy")
        .otherwise("sphinx").alias("docstring_style"),
        F.least(mean * 2, F.lit(200)).cast("int").alias("max_function_length"),
        "uses_async",
    )


def merge_conventions(measured: DataFrame, modelled: DataFrame | None = None) -> DataFrame:
    """Measured values first, then a model's, then defaults; pattern lists from the model only."""
    if modelled is None:
        return _with_defaults(measured)
    known = [c for c in fixed.CONVENTION_DEFAULTS if c in modelled.columns]
    lists = [c for c in ("common_patterns", "anti_patterns") if c in modelled.columns]
    renamed = modelled.select(
        "repo", *[F.col(c).alias(f"_{c}") for c in known],
        *[F.slice(c, 1, fixed.MAX_PATTERNS).alias(c) for c in lists],
    )
    joined = measured.join(renamed, "repo", "left")
    for name in known:
        own = [F.col(name)] if name in measured.columns else []
        joined = joined.withColumn(name, F.coalesce(*own, F.col(f"_{name}")))
    return _with_defaults(joined)


ANSWER_KINDS = {
    "naming_style": "string", "uses_type_hints": "boolean", "uses_docstrings": "boolean",
    "docstring_style": "string", "max_function_length": "int", "uses_black_formatting": "boolean",
    "uses_async": "boolean", "test_naming_pattern": "string",
    "common_patterns": "array<string>", "anti_patterns": "array<string>",
}


def convention_answers(answers: DataFrame) -> DataFrame:
    """Profile per repo as a model describes it: ``answers`` has (repo, response).

    An answer may be fenced.  A value that is missing or of another type is null, so that measured
    values and defaults take its place; an answer that is no JSON object gives no row.  Of several
    answers for a repo the least text counts.
    """
    one = answers.filter(F.col("response").isNotNull()).groupBy("repo").agg(F.min("response").alias("response"))
    parsed = parse_model_response(one).filter("valid")
    return parsed.select(
        "repo",
        *[F.try_variant_get("answer", f"$.{name}", kind).alias(name) for name, kind in ANSWER_KINDS.items()],
    )


def learn_conventions(
    repos: DataFrame, prs: DataFrame, modelled: DataFrame | None = None
) -> DataFrame:
    """Convention profile of every repo; repos without merged pull requests get defaults."""
    merged = recent_merged_prs(prs)
    facts = function_facts(added_code_blocks(merged))
    learned = merge_conventions(conventions_from_facts(facts, merged), modelled)
    return _with_defaults(repos.select("repo").distinct().join(learned, "repo", "left"))


def files_with_conventions(files: DataFrame, conventions: DataFrame) -> DataFrame:
    """Every file with the profile of its repo, defaults where none is known.

    The profile table has one row per repo; whether it is broadcast is left to the size
    that Spark measures.
    """
    profile = conventions.drop("learned_at") if "learned_at" in conventions.columns else conventions
    joined = files.join(profile, "repo", "left")
    defaulted = {
        name: F.coalesce(F.col(name), F.lit(value))
        for name, value in fixed.CONVENTION_DEFAULTS.items()
    }
    return joined.withColumns(defaulted)


def convention_prompt(samples: DataFrame) -> DataFrame:
    """(repo, prompt): the first ten samples as one text for a model."""
    used = samples.filter(F.col("sample_ord") <= fixed.PROMPT_SAMPLES)
    ordered = F.array_sort(F.collect_list(F.struct("sample_ord", "sample")))
    joined = F.array_join(F.transform(ordered, lambda s: s["sample"]), "\n\n---\n\n")
    code = used.groupBy("repo").agg(
        F.substring(joined, 1, fixed.PROMPT_SAMPLE_CHARS).alias("code")
    )
    text = F.concat(
        F.lit("Describe the coding conventions of "), F.col("repo"),
        F.lit(" as JSON, judging by code from merged pull requests.\n\n```\n"), F.col("code"),
        F.lit("\n```\n\nFields: "),
        F.lit(", ".join([*fixed.CONVENTION_DEFAULTS, "common_patterns", "anti_patterns"])),
    )
    return code.select("repo", "code", text.alias("prompt"))


def fresh_conventions(stored: DataFrame, now: Column) -> DataFrame:
    """The newest stored profile of each repo, where it is younger than a day."""
    oldest = now - F.expr(f"INTERVAL {fixed.CACHE_SECONDS} SECONDS")
    values = [c for c in stored.columns if c != "repo"]
    newest = F.max_by(F.struct(*values), F.struct("learned_at", F.xxhash64(*values)))
    kept = stored.filter(F.col("learned_at") > oldest).groupBy("repo").agg(newest.alias("_newest"))
    return kept.select(*["repo" if c == "repo" else f"_newest.{c}" for c in stored.columns])


def repos_to_refresh(repos: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Repos without a fresh stored profile."""
    fresh = fresh_conventions(stored, now).select("repo")
    return repos.select("repo").distinct().join(fresh, "repo", "left_anti")
