"""Expressions that classify changed files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.text import basename, contains_any, lookup


def file_extension(filename: Column) -> Column:
    """Lower-case text from the last dot of the whole path; empty without a dot."""
    tail = F.lower(F.concat(F.lit("."), F.substring_index(filename, ".", -1)))
    return F.when(F.instr(filename, ".") > 0, tail).otherwise(F.lit(""))


def detect_language(filename: Column) -> Column:
    return lookup(file_extension(filename), fixed.LANGUAGE_BY_EXTENSION)


def pr_file_language(filename: Column) -> Column:
    """Language by the case-sensitive map used while PR files are read."""
    tail = F.substring_index(filename, ".", -1)
    return F.when(F.instr(filename, ".") > 0, lookup(tail, fixed.PR_FILE_LANGUAGE))


def has_content(content: Column) -> Column:
    return F.coalesce(content != "", F.lit(False))


def skip_reason(filename: Column, status: Column, content: Column) -> Column:
    """First reason to leave a file out, null when there is none."""
    return (
        F.when(status == "removed", "removed")
        .when(file_extension(filename).isin(fixed.BINARY_EXTENSIONS), "binary")
        .when(~has_content(content), "no_content")
        .when(F.length(content) > fixed.MAX_FILE_CHARS, "too_large")
    )


def is_generated_file(filename: Column, content: Column) -> Column:
    head = F.lower(F.substring(content, 1, 500))
    by_name = contains_any(F.lower(filename), fixed.GENERATED_NAME_PARTS)
    return by_name | F.coalesce(contains_any(head, fixed.GENERATED_MARKERS), F.lit(False))


def review_reason(filename: Column, status: Column, content: Column, language: Column) -> Column:
    """Skip reason including language and generated files; null means reviewable."""
    supported = F.coalesce(language.isin(fixed.SUPPORTED_LANGUAGES), F.lit(False))
    return F.coalesce(
        skip_reason(filename, status, content),
        F.when(~supported, "unsupported_language").when(
            is_generated_file(filename, content), "generated"
        ),
    )


def is_test_file(filename: Column) -> Column:
    name = F.lower(basename(filename))
    test = name.startswith("test_") | name.contains("conftest") | filename.contains("__tests__")
    for ending in fixed.TEST_NAME_ENDINGS:
        test = test | name.endswith(ending)
    return test


def is_analyzable(content: Column, language: Column) -> Column:
    supported = F.coalesce(language.isin(fixed.SUPPORTED_LANGUAGES), F.lit(False))
    return has_content(content) & supported


def is_security_sensitive(filename: Column, content: Column) -> Column:
    head = F.lower(F.substring(content, 1, 3000))
    return contains_any(F.lower(filename), fixed.SENSITIVE_WORDS) | contains_any(
        head, fixed.SENSITIVE_WORDS
    )


def file_purpose(filename: Column, content: Column) -> Column:
    path = F.lower(filename)
    head = F.lower(F.substring(content, 1, 2000))
    cases = [(contains_any(path, w), p) for w, p in fixed.PATH_PURPOSES]
    cases += [(contains_any(head, w), p) for w, p in fixed.CONTENT_PURPOSES]
    chain = F.when(*cases[0])
    for condition, purpose in cases[1:]:
        chain = chain.when(condition, purpose)
    return chain.otherwise(fixed.DEFAULT_PURPOSE)
