"""Merged pull requests, code samples, learned profiles and their cache."""

import datetime as dt

from pyspark.sql import functions as F

from mergelight.fixed import CONVENTION_DEFAULTS
from mergelight.functions.conventions import docstring_style, naming_style
from mergelight.operators import conventions as oc

PR = "repo string, number bigint, title string, updated_at timestamp, merged_at timestamp, diff string"


def pr(repo, number, day, merged=True, diff="+x"):
    moment = dt.datetime(2024, 1, day)
    return (repo, number, f"t{number}", moment, moment if merged else None, diff)


def added(*lines):
    return "@@ -1 +1 @@\n" + "\n".join("+" + line for line in lines) + "\n end"


def test_newest_merged_with_diff(spark):
    rows = [pr("a", n, 20 - n) for n in range(1, 10)]
    rows[0] = pr("a", 1, 19, merged=False)
    rows[1] = pr("a", 2, 18, diff=None)
    rows += [pr("b", n, 1) for n in (5, 6, 7, 8)]
    rows += [pr("c", n, n, merged=n < 3) for n in range(1, 10)]
    got = oc.recent_merged_prs(spark.createDataFrame(rows, PR)).orderBy("repo", "pr_rank").collect()
    assert [(r.repo, r.number) for r in got] == [
        ("a", 3), ("a", 4), ("a", 5), ("b", 8), ("b", 7), ("b", 6)]


def test_profiles(spark):
    google = '    """Args: a"""'
    rows = [
        pr("hints", 1, 2, diff=added("def get_it(a) -> int:", google, "    return a", "", "async def do_it():", "    return 1")),
        pr("camel", 1, 2, diff=added("def doThing(a):", "    '''x", "    :param a: b'''", "    return a")),
        pr("tie", 1, 2, diff=added("def a_b(x):", "    return x", "def aB(x) -> int:", "    return x")),
        pr("indented", 1, 2, diff=added("    x = 1  # loses its margin", "    def aB(x): pass")),
        pr("none", 1, 2, diff="no code"),
        pr("unmerged", 1, 2, merged=False),
    ]
    prs = spark.createDataFrame(rows, PR)
    got = {r.repo: r for r in oc.learn_conventions(prs, prs).collect()}

    def facts(repo):
        r = got[repo]
        return (r.naming_style, r.uses_type_hints, r.uses_docstrings, r.docstring_style,
                r.max_function_length, r.uses_async)

    assert facts("hints") == ("snake_case", False, False, "google", 4, True)
    assert facts("camel") == ("camelCase", False, True, "sphinx", 8, False)
    assert facts("tie") == ("snake_case", False, False, "google", 4, False)
    assert facts("indented") == facts("none") == ("snake_case", False, False, "google", 100, False)
    assert {n: got["unmerged"][n] for n in CONVENTION_DEFAULTS} == CONVENTION_DEFAULTS
    assert got["hints"].common_patterns == []


def test_model_fills_what_is_not_measured(spark):
    measured = spark.createDataFrame([("r", "camelCase", True)],
                                     "repo string, naming_style string, uses_async boolean")
    model = spark.createDataFrame(
        [("r", "snake_case", True, [str(n) for n in range(12)], None)],
        "repo string, naming_style string, uses_black_formatting boolean, "
        "common_patterns array<string>, anti_patterns array<string>")
    row = oc.merge_conventions(measured, model).first()
    assert (row.naming_style, row.uses_async, row.uses_black_formatting) == ("camelCase", True, True)
    assert (len(row.common_patterns), row.anti_patterns, row.max_function_length) == (10, [], 50)


def test_sample_limit_counts_over_pull_requests(spark):
    many = "\n".join(f"+this is a long enough line {n}\n gap" for n in range(15))
    prs = spark.createDataFrame([pr("a", 1, 9, diff=many), pr("a", 2, 8, diff=many)], PR)
    samples = oc.added_code_blocks(oc.recent_merged_prs(prs)).orderBy("sample_ord").collect()
    assert [r.sample_ord for r in samples] == list(range(1, 21))
    assert samples[15].sample.endswith("line 0")
    prompt = oc.convention_prompt(oc.added_code_blocks(oc.recent_merged_prs(prs))).first()
    assert prompt.code.count("\n\n---\n\n") == 9 and prompt.code in prompt.prompt


def test_styles(spark):
    names = {"a_b": "snake", "_foo1": "snake", "__": "none", "aB": "camel", "_aB": "none",
             "run": "none", "A_b": "none", "éÀ": "camel"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", naming_style(F.col("n")).alias("s")).collect()} == names
    texts = {"Returns: :param": "google", "Parameters\n---": "numpy", ":type": "sphinx", "Parameters": "none"}
    df = spark.createDataFrame([(n,) for n in texts], "n string")
    assert {r.n: r.s for r in df.select("n", docstring_style(F.col("n")).alias("s")).collect()} == texts


def test_cache_age(spark):
    now = F.lit(dt.datetime(2024, 1, 3))
    stored = spark.createDataFrame(
        [("new", dt.datetime(2024, 1, 2, 0, 0, 1)), ("edge", dt.datetime(2024, 1, 2)), ("old", dt.datetime(2023, 1, 1))],
        "repo string, learned_at timestamp")
    repos = spark.createDataFrame([(r,) for r in ("new", "edge", "old", "never")], "repo string")
    assert [r.repo for r in oc.fresh_conventions(stored, now).collect()] == ["new"]
    assert sorted(r.repo for r in oc.repos_to_refresh(repos, stored, now).collect()) == ["edge", "never", "old"]


def test_one_profile_a_repo_is_fresh(spark):
    stored = spark.sql(
        "SELECT * FROM VALUES ('r', 1, timestamp'2024-01-01 10:00:00'), ('r', 2, timestamp'2024-01-01 11:00:00') "
        "AS t(repo, max_function_length, learned_at)")
    got = oc.fresh_conventions(stored, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert got.columns == stored.columns
    assert [(r.repo, r.max_function_length) for r in got.collect()] == [("r", 2)]
