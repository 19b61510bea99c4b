"""Model answers: fences, defaults, thresholds, broken entries, failing models."""

import json
import time

import pytest
from pyspark.sql import functions as F

from mergelight import schemas
from mergelight.operators import responses as rs


def answers(spark, *rows):
    full = [dict(dict(job_id="j", agent="BugDetector", file_path="f.py", file_ord=n, chunk_index=0,
                      chunk_start=1, has_test_file=True), **r) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.RESPONSES)


@pytest.mark.parametrize("text, cleaned", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), (' \n```\n{}\n ```  \n', "{}"),
    ("```\n{}\nrest```", "{}\nrest```"), ("```json", ""), ("```\n```", ""), ("{}\n```", "{}\n```"),
])
def test_fences(spark, text, cleaned):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(rs.strip_fence(F.col("t")).alias("c")).first().c == cleaned


def test_defaults_thresholds_and_style_cap(spark):
    one = json.dumps({"findings": [{"severity": "CRITICAL", "confidence": 0.55, "line": "7", "code_snippet": "s"}, {}]})
    agents = ["BugDetector", "SecurityScanner", "StyleAdvisor", "TestCoverage"]
    rows = [dict(agent=a, response=one) for a in agents]
    rows.append(dict(agent="StyleAdvisor", response=one.replace("0.55", "0.6")))
    rows.append(dict(agent="TestCoverage", response='{"findings": [{}]}', has_test_file=False))
    got = rs.response_findings(answers(spark, *rows)).orderBy("seq").collect()
    short = [(r.agent, r.severity, r.line_number, r.confidence, r.title, r.code_snippet) for r in got]
    assert short == [
        ("SecurityScanner", "CRITICAL", 7, 0.55, "Potential security issue", "s"),
        ("StyleAdvisor", "MEDIUM", 7, 0.6, "Style deviation", "s"),
        ("TestCoverage", "CRITICAL", 7, 0.55, "Missing test coverage", None),
        ("TestCoverage", "MEDIUM", 1, 0.7, "Missing test coverage", None),
        ("TestCoverage", "MEDIUM", 1, 0.8, "No test file for f.py", None),
    ]


def test_broken_answers_are_set_aside_one_by_one(spark):
    rows = [
        dict(response='{"findings": ['), dict(response="[1]"), dict(response=None),
        dict(response='{"findings": "none"}'), dict(response='{"other": 1}'),
        dict(response=json.dumps({"findings": [
            {"confidence": 0.9, "title": None}, {"confidence": "high"}, {"confidence": 0.9, "line": "x"},
            "text", {"confidence": 0.9, "title": "kept"}]})),
    ]
    df = answers(spark, *rows)
    assert [r.title for r in rs.response_findings(df).collect()] == ["kept"]
    rejected = rs.rejected_responses(df).collect()
    assert sorted((r.item_ord is None, r.item_ord) for r in rejected if r.item_ord is not None) == [
        (False, 0), (False, 1), (False, 2), (False, 3)]
    assert sum(r.item_ord is None for r in rejected) == 3


def test_chunk_lines_shift_only_outside_parity(spark):
    row = dict(response='{"findings": [{"line": 5, "confidence": 1}]}', chunk_index=2, chunk_start=463)
    df = answers(spark, row)
    assert rs.response_findings(df).first().line_number == 5
    assert rs.response_findings(df, parity=False).first().line_number == 467


@pytest.mark.parametrize("batch_rows", [1, 7, 64])
def test_a_failing_prompt_costs_no_other_its_answer(spark, batch_rows):
    prompts = spark.createDataFrame([(n, f"p{n}") for n in range(20)], "n int, prompt string").repartition(4, "n")

    def model(texts):
        if "p3" in texts:
            raise RuntimeError("busy")
        return [t.upper() for t in texts]

    good, bad = rs.split_errors(rs.score_with_model(prompts, model, batch_rows=batch_rows))
    assert {r.n: r.response for r in good.collect()} == {n: f"P{n}" for n in range(20) if n != 3}
    assert [(r.n, r.error) for r in bad.collect()] == [(3, "RuntimeError: busy")]


def test_a_wrong_number_of_answers_is_an_error(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "n int, prompt string").coalesce(1)
    good, bad = rs.split_errors(rs.score_with_model(prompts, lambda texts: ["x"] if texts != ["b"] else []))
    assert [(r.n, r.response) for r in good.collect()] == [(1, "x")]
    assert [(r.n, r.error) for r in bad.collect()] == [(2, "ValueError: 0 answers to 1 prompts")]


def test_validation(spark):
    rows = [("HIGH", 0.5, 1, "t"), ("ODD", 0.5, 1, "t"), ("LOW", 1.5, 1, "t"), ("LOW", 0.5, 0, "t"), (None, 0.5, 1, "t")]
    good, bad = rs.validate_findings(spark.createDataFrame(
        rows, "severity string, confidence double, line_number bigint, title string"))
    assert (good.count(), bad.count()) == (1, 4)


def test_calls_are_in_flight_together_and_answers_in_order(spark):
    prompts = spark.range(200).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).coalesce(1)

    def model(texts):
        time.sleep(0.1)
        if texts == ["p7"]:
            raise ValueError("no")
        return [t.upper() for t in texts]

    rs.score_with_model(prompts.limit(1), model).collect()  # starts the worker
    started = time.perf_counter()
    rows = rs.score_with_model(prompts, model, batch_rows=1).collect()
    assert time.perf_counter() - started < 200 * 0.1 / 4
    assert [r.id for r in rows] == list(range(200))
    assert [(r.id, r.error) for r in rows if r.error] == [(7, "ValueError: no")]
    assert all(r.response == f"P{r.id}" for r in rows if r.id != 7)


def test_a_bad_prompt_costs_few_calls(spark, tmp_path):
    prompts = spark.range(64).select("id", F.col("id").cast("string").alias("prompt")).coalesce(1)
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as out:
            out.write("x")
        if "13" in texts:
            raise ValueError("no")
        return texts

    rows = rs.score_with_model(prompts, model, in_flight=1).collect()
    assert [r.id for r in rows if r.error] == [13] and len(open(log).read()) == 13
