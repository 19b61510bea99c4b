"""Expressions over findings: ranks, tags, similarity and comment text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.text import lookup, strip, words

# Kinds of findings of one agent and file, in order.
RULE_HITS, MODEL_ITEMS = 0, 1


def finding_order(
    agent_ord: Column | int, file_ord: Column, kind: int, place: Column, item: Column | int
) -> Column:
    """What findings are sorted by: agent, file, kind, line or chunk or function, rule or entry."""
    agent = F.lit(agent_ord) if isinstance(agent_ord, int) else agent_ord
    last = F.lit(item) if isinstance(item, int) else item
    return F.struct(
        agent.cast("int").alias("agent"), file_ord.cast("bigint").alias("file"),
        F.lit(kind).alias("kind"), place.cast("bigint").alias("place"), last.cast("bigint").alias("item"),
    )


def finding_id(*parts: Column) -> Column:
    """Stable identifier made from what makes a finding unique."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def severity_rank(severity: Column) -> Column:
    rank = F.when(severity == fixed.SEVERITIES[0], 0)
    for position, name in enumerate(fixed.SEVERITIES[1:], start=1):
        rank = rank.when(severity == name, position)
    return rank.otherwise(len(fixed.SEVERITIES))


def severity_icon(severity: Column) -> Column:
    return F.coalesce(lookup(severity, fixed.SEVERITY_ICONS), F.lit(fixed.DEFAULT_ICON))


def agent_tag(agent: Column) -> Column:
    short = strip(F.replace(F.upper(agent), F.lit("AGENT"), F.lit("")))
    return F.concat(F.lit("["), short, F.lit("]"))


def meaningful_words(title: Column) -> Column:
    """Distinct title words without stop words."""
    stop = F.array(*[F.lit(w) for w in fixed.TITLE_STOP_WORDS])
    return F.array_except(words(title), stop)


def shared_title_words(left: Column, right: Column) -> Column:
    return F.array_intersect(meaningful_words(left), meaningful_words(right))


def is_similar(category_a: Column, words_a: Column, category_b: Column, words_b: Column) -> Column:
    """Same category, or at least two meaningful title words in common."""
    return (category_a == category_b) | (F.size(F.array_intersect(words_a, words_b)) >= 2)


def severity_at_most_medium(severity: Column) -> Column:
    """Style findings never exceed MEDIUM; a missing severity is LOW."""
    return F.coalesce(
        F.when(severity.isin("CRITICAL", "HIGH"), F.lit("MEDIUM")).otherwise(severity),
        F.lit("LOW"),
    )


def confidence_threshold(agent: Column) -> Column:
    """Lowest confidence an agent's model findings need; null when there is none."""
    limit = F.lit(None).cast("double")
    for name, values in fixed.RESPONSE_DEFAULTS.items():
        limit = F.when(agent == name, F.lit(values["threshold"]).cast("double")).otherwise(limit)
    return limit


def passes_confidence(agent: Column, confidence: Column) -> Column:
    limit = confidence_threshold(agent)
    return limit.isNull() | (F.coalesce(confidence, F.lit(0.0)) >= limit)


def format_finding(
    severity: Column,
    title: Column,
    description: Column,
    suggestion: Column,
    fix_example: Column,
    agents: Column,
    product: str,
) -> Column:
    """Markdown text of one inline comment."""
    fenced = F.concat(F.lit("\n\n```\n"), fix_example, F.lit("\n```"))
    fix = F.when(F.coalesce(fix_example != "", F.lit(False)), fenced).otherwise("")
    return F.concat(
        F.lit("**"), severity_icon(severity), F.lit(" "), severity, F.lit(": "), title,
        F.lit("**\n\n"), description, F.lit("\n\n**Suggestion:** "), suggestion, fix,
        F.lit(f"\n\n*Detected by {product} "), F.array_join(agents, ", "), F.lit("*"),
    )
