"""Source and test files: matching, untested functions, coverage findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.files import has_content, is_test_file
from mergelight.functions.findings import RULE_HITS, finding_order
from mergelight.functions.text import capitalize, dirname, normalize_path, stem
from mergelight.operators.findings import with_finding_defaults
from mergelight.operators.text import file_facts
from mergelight.session import by_merge, cut_lineage

FILE = ["job_id", "ord"]


def file_names(files: DataFrame) -> DataFrame:
    """Narrow file table: what matching needs, without content."""
    filled = F.col("has_content") if "has_content" in files.columns else has_content(F.col("content"))
    return files.select(*FILE, "filename", "language", filled.alias("has_content"))


def is_coverage_source() -> Column:
    """Whether a row of a names table is code of a supported language, not a test."""
    return (
        F.col("has_content")
        & F.coalesce(F.col("language").isin(fixed.SUPPORTED_LANGUAGES), F.lit(False))
        & ~is_test_file(F.col("filename"))
    )


def source_names(names: DataFrame) -> DataFrame:
    """Files with content in a supported language that are not tests."""
    return names.filter(is_coverage_source())


def _candidate_paths(sources: DataFrame) -> DataFrame:
    """Test paths of every source file, as written and normalised."""
    name, folder = stem(F.col("filename")), dirname(F.col("filename"))
    patterns = F.when(F.lit(False), F.array().cast("array<string>"))
    for language, texts in fixed.TEST_FILE_PATTERNS.items():
        patterns = patterns.when(F.col("language") == language, F.array(*map(F.lit, texts)))
    raw = sources.select(
        *FILE, name.alias("name"), folder.alias("folder"), F.explode(patterns).alias("pattern")
    )
    filled = F.replace(
        F.replace("pattern", F.lit("{name}"), F.col("name")), F.lit("{dir}"), F.col("folder")
    )
    paths = raw.select(*FILE, filled.alias("path"))
    both = F.array_distinct(F.array(F.col("path"), normalize_path(F.col("path"))))
    return paths.select(*FILE, F.explode(both).alias("path"))


def _exact_matches(sources: DataFrame, names: DataFrame) -> DataFrame:
    """First file, in file order, whose path or normalised path is a pattern path."""
    paths = F.array_distinct(F.array(F.col("filename"), normalize_path(F.col("filename"))))
    owners = (
        names.select("job_id", F.explode(paths).alias("path"), "ord")
        .groupBy("job_id", "path").agg(F.min("ord").alias("test_ord"))
    )
    return (
        _candidate_paths(sources).join(by_merge(owners), ["job_id", "path"])
        .groupBy(*FILE).agg(F.min("test_ord").alias("exact_ord"))
    )


def _name_keys(path: Column) -> Column:
    """Every name for which a path contains ``test_{name}`` or ``{name}_test``."""
    places = F.sequence(F.lit(1), F.length(path))
    after = F.transform(
        F.filter(places, lambda i: F.substr(path, i, F.lit(5)) == "test_"),
        lambda i: F.substr(path, i + 5),
    )
    before = F.transform(
        F.filter(places, lambda i: F.substr(path, i, F.lit(5)) == "_test"),
        lambda i: F.left(path, i - 1),
    )
    prefixes = F.transform(
        after, lambda t: F.transform(F.sequence(F.lit(0), F.length(t)), lambda k: F.left(t, k))
    )
    suffixes = F.transform(
        before, lambda t: F.transform(F.sequence(F.lit(0), F.length(t)), lambda k: F.right(t, k))
    )
    return F.array_distinct(F.flatten(F.concat(prefixes, suffixes)))


def _fallback_matches(sources: DataFrame, names: DataFrame) -> DataFrame:
    """First file whose path contains ``test_{name}`` or ``{name}_test``.

    The containment test becomes an equality: a path lists all names it would match, which
    is bounded by its length, and the first file per name is kept before the join.
    """
    marked = names.filter(F.col("filename").contains("test_") | F.col("filename").contains("_test"))
    owners = (
        marked.select("job_id", F.explode(_name_keys(F.col("filename"))).alias("name"), "ord")
        .groupBy("job_id", "name").agg(F.min("ord").alias("loose_ord"))
    )
    named = sources.select(*FILE, stem(F.col("filename")).alias("name"))
    return named.join(by_merge(owners), ["job_id", "name"]).select(*FILE, "loose_ord")


def match_test_files(files: DataFrame) -> DataFrame:
    """(job_id, ord, filename, test_ord, match) per source file that has a test file."""
    names = file_names(files)
    sources = source_names(names)
    found = (
        _exact_matches(sources, names).withColumn("loose_ord", F.lit(None).cast("bigint"))
        .unionByName(
            _fallback_matches(sources, names)
            .withColumn("exact_ord", F.lit(None).cast("bigint"))
        )
        .groupBy(*FILE).agg(F.min("exact_ord").alias("exact"), F.min("loose_ord").alias("loose"))
    )
    return sources.select(*FILE, "filename").join(by_merge(found), FILE).select(
        *FILE, "filename",
        F.coalesce("exact", "loose").alias("test_ord"),
        F.when(F.col("exact").isNotNull(), "exact").otherwise("contains").alias("match"),
    )


def has_test_case(function: Column, test_content: Column) -> Column:
    """Whether a test text mentions the function, plainly or in a test name."""
    name = capitalize(function)
    return (function != "") & (
        test_content.contains(function)
        | test_content.contains(F.concat(F.lit("test"), name))
        | test_content.contains(F.concat(F.lit("Test"), name))
    )


def tested_files(names: DataFrame) -> DataFrame:
    """(job_id, ord, test_filename): source files whose test file has content."""
    filled = names.filter("has_content").select(
        "job_id", F.col("ord").alias("test_ord"), F.col("filename").alias("test_filename")
    )
    return match_test_files(names).join(by_merge(filled), ["job_id", "test_ord"]).select(
        *FILE, "test_filename"
    )


def test_texts(files: DataFrame) -> DataFrame:
    """(job_id, test_filename, test_content) of files that can be a test file at all."""
    name = F.col("filename")
    likely = (name.contains("test") | name.contains(".spec.")) & has_content(F.col("content"))
    return files.filter(likely).select(
        "job_id", name.alias("test_filename"), F.col("content").alias("test_content")
    )


def _functions_per_file(functions: DataFrame) -> DataFrame:
    """One row per file; a facts table already has this form."""
    if "functions" in functions.columns:
        return functions.filter(F.size("functions") > 0).select(*FILE, "filename", "functions")
    record = F.struct("func_ord", "name", "start_line", "end_line")
    return functions.groupBy(*FILE, "filename").agg(F.collect_list(record).alias("functions"))


def _flat_functions(per_file: DataFrame, functions: Column) -> DataFrame:
    plain = F.transform(
        functions,
        lambda f: F.struct(*[f[c].alias(c) for c in ("func_ord", "name", "start_line", "end_line")]),
    )
    return per_file.select(*FILE, "filename", F.inline(plain))


def untested_functions(
    files: DataFrame, functions: DataFrame, texts: DataFrame | None = None,
    tested: DataFrame | None = None,
) -> DataFrame:
    """Functions of files with a test file that the test text never mentions.

    ``functions`` has one row per function, or is a facts table.  A file's functions travel
    as one short array, so each test text meets a file once, not once per function.
    """
    tested = tested_files(file_names(files)) if tested is None else tested
    texts = test_texts(files) if texts is None else texts
    joined = (
        _functions_per_file(functions).join(by_merge(tested), FILE)
        .join(by_merge(texts), ["job_id", "test_filename"])
    )
    missing = F.filter("functions", lambda f: ~has_test_case(f["name"], F.col("test_content")))
    return _flat_functions(joined, missing)


def functions_without_test_file(
    files: DataFrame, functions: DataFrame, tested: DataFrame | None = None
) -> DataFrame:
    """Functions of source files without a test file, or with an empty one."""
    names = file_names(files)
    tested = tested_files(names) if tested is None else tested
    alone = source_names(names).select(*FILE).join(by_merge(tested), FILE, "left_anti")
    per_file = _functions_per_file(functions).join(by_merge(alone), FILE, "left_semi")
    return _flat_functions(per_file, F.col("functions"))


def basic_coverage_findings(
    untested: DataFrame, agent: str = "TestCoverage", agent_ord: int = 3
) -> DataFrame:
    """``missing-test`` findings for the first five untested functions of each file."""
    first = Window.partitionBy(*FILE).orderBy("func_ord")
    kept = untested.withColumn("row", F.row_number().over(first)).filter(
        F.col("row") <= fixed.BASIC_COVERAGE_LIMIT
    )
    name, line = F.col("name"), F.col("start_line").cast("string")
    found = kept.select(
        "job_id",
        finding_order(agent_ord, F.col("ord"), RULE_HITS, F.col("func_ord"), 0).alias("seq"),
        F.col("filename").alias("file_path"),
        F.col("start_line").alias("line_number"),
        F.lit("MEDIUM").alias("severity"),
        F.lit("missing-test").alias("category"),
        F.concat(F.lit("No test for "), name, F.lit("()")).alias("title"),
        F.concat(
            F.lit("Function "), name, F.lit(" defined at line "), line,
            F.lit(" has no corresponding test case."),
        ).alias("description"),
        F.concat(
            F.lit("Add test cases covering happy path, edge cases, and error conditions for "),
            name, F.lit("."),
        ).alias("suggestion"),
        F.lit(0.8).alias("confidence"),
    )
    return with_finding_defaults(found, agent)


def coverage_gaps(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Untested functions of all source files: ``facts`` without, ``texts`` with content."""
    tested = cut_lineage(tested_files(file_names(facts)))
    return untested_functions(facts, facts, texts, tested).unionByName(
        functions_without_test_file(facts, facts, tested)
    )


def coverage_findings(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Coverage detector without a model: untested functions of every source file."""
    facts = cut_lineage(file_facts(files)) if facts is None else facts
    return basic_coverage_findings(coverage_gaps(facts, test_texts(files)))
