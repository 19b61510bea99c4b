"""Sources, sinks and whole reviews."""

import base64
import datetime as dt
import json

import pyarrow.fs
from pyspark.sql import functions as F

from pyspark.sql.datasource import LessThanOrEqual

from mergelight import fixed, schemas
from mergelight.plans import review as pl
from mergelight.sources import code_tree, readers, writers
from mergelight.sources.code_tree import CodeTreeReader


def make_tree(root):
    texts = {
        "core/a.py": "import core.b\ndef go(x):\n    return md5(x)\n",
        "core/b.py": "password = 'abcdefghij'\r\ndef save(x):\r    return x\n",
        "tests/test_a.py": "from core import a\ndef test_go(): go(1)\n",
        "web/x y%20+é.js": "el.innerHTML = 1\n", "web/Upper.PY": "md5(x)", "notes.md": "md5(x)",
        "node_modules/m.js": "eval(x)", "core/__pycache__/a.py": "x", "venvx/ok.ts": "const f = (x) => x",
        "big.py": "x" * 500_001,
    }
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "bad.py").write_bytes(b"x = '\xff'")


def test_directory_scan(spark, tmp_path):
    make_tree(tmp_path)
    rows = {r.filename: r for r in readers.scan_code_files(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["core/a.py", "core/b.py", "tests/test_a.py", "venvx/ok.ts", "web/x y%20+é.js"]
    assert rows["core/b.py"].content == "password = 'abcdefghij'\ndef save(x):\n    return x\n"
    assert (rows["core/b.py"].additions, rows["venvx/ok.ts"].language) == (4, "typescript")


def test_directory_review(spark, tmp_path):
    make_tree(tmp_path)
    done = pl.review_directory(spark, str(tmp_path))
    got = [(r.severity, r.file_path, r.line_number) for r in done.findings.orderBy("rank").collect()]
    assert got == [
        ("CRITICAL", "core/b.py", 1), ("HIGH", "web/x y%20+é.js", 1), ("MEDIUM", "core/a.py", 3),
        ("MEDIUM", "core/b.py", 2), ("MEDIUM", "venvx/ok.ts", 1),
    ]
    order = {r.filename: (r.review_ord, r.impact_score) for r in done.order.collect()}
    assert order["core/b.py"] == (1, 0.4) or order["core/b.py"][0] == 1
    row = done.summary.first()
    assert (row.total_findings, row.critical_count, row.files_reviewed) == (5, 1, 5)
    assert row.review_decision == "REQUEST_CHANGES"
    assert "| SecurityScanner | 3 | 0.0s |" in row.executive_summary


def test_pull_request_records(spark, tmp_path):
    code = base64.encodebytes("é = 1\n".encode() * 30).decode()
    rows = [
        dict(job_id="j", ord=0, head_sha="h", filename="a.py", content=code, encoding="base64", size=5),
        dict(job_id="j", ord=1, head_sha="h", filename="a.PY", status="removed", content=code, encoding="base64"),
        dict(job_id="j", ord=2, head_sha="h", filename="b.tsx", content="plain", size=500_000),
        dict(job_id="j", ord=3, filename="c.js", content="plain"),
        dict(job_id="j", ord=4, head_sha="h", filename="d", content="plain", additions=3),
        dict(job_id="j", ord=5, head_sha="h", filename="e.py", content="plain", content_size=1_000_001),
        dict(job_id="j", ord=6, head_sha="h", filename="f.py", content=base64.b64encode(b"a\xff").decode(), encoding="base64"),
        dict(job_id="j", ord=7, head_sha="h", filename="g.py"),
    ]
    (tmp_path / "files.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r.ord: r for r in readers.read_pr_files(spark, str(tmp_path)).collect()}
    assert [got[n].content for n in range(8)] == [
        "é = 1\n" * 30, None, None, None, "plain", None, "a�", ""]
    assert [got[n].language for n in range(5)] == ["python", None, "typescript", "javascript", None]
    assert (got[0].status, got[4].additions, got[0].deletions) == ("modified", 3, 0)


def test_diffs_and_sinks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "pr1.diff").write_text("diff --git a/x b/x\n@@ -1 +1 @@\n+a\n")
    row = readers.read_pr_diffs(spark, str(tmp_path / "d")).first()
    assert (row.job_id, row.diff.count("\n")) == ("pr1", 3)
    out = str(tmp_path / "results")
    for day in (1, 2, 3):
        moment = F.lit(dt.datetime(2024, 1, day, 12))
        writers.write_job_results(spark.createDataFrame([(f"j{day}",)], "job_id string"), out, moment)
    now = F.lit(dt.datetime(2024, 1, 3, 13))
    assert sorted(r.job_id for r in writers.read_job_results(spark, out, now).collect()) == ["j3"]
    payloads = str(tmp_path / "payloads")
    writers.write_review_payload(spark.createDataFrame([("j", 0, "{}")], "job_id string, part int, payload string"), payloads)
    assert spark.read.parquet(payloads).count() == 1
    profiles = str(tmp_path / "profiles")
    writers.write_conventions(spark.createDataFrame([("r",)], "repo string"), profiles, now)
    assert spark.read.parquet(profiles).columns == ["repo", "learned_at"]


def jobs(spark, *names):
    rows = [(n, "o/" + n, 1, "title", "head") for n in names]
    return spark.createDataFrame(rows, "job_id string, repo string, pr_number int, pr_title string, head_sha string")


def changed(spark, rows):
    full = [(j, n, f, s, 0, 0, None, c, None, 0.0) for j, n, f, s, c in rows]
    return spark.createDataFrame(full, schemas.FILES)


def test_review_with_a_model(spark):
    files = changed(spark, [
        ("a", 0, "auth.py", "modified", "token = 'abcdefgh1'\ndef login(u):\n    return u\n"),
        ("a", 1, "tests/test_auth.py", "modified", "nothing"),
        ("a", 2, "fail.py", "modified", "def boom(x):\n    pass\n"),
        ("b", 0, "logo.png", "modified", "x"),
    ])

    def model(prompts):
        if any("fail.py" in p and "without tests" in p for p in prompts):
            raise RuntimeError("model down")
        line = {"line": 1, "severity": "HIGH", "title": "Hardcoded secret in login", "confidence": 0.9}
        return [json.dumps({"findings": [line] if "auth.py\n" in p and "tests/" not in p.split("\n")[1] else []})
                for p in prompts]

    done = pl.review(jobs(spark, "a", "b"), files, detectors=pl.default_detectors(model))
    raw = {(r.agent, r.file_path) for r in done.raw_findings.collect()}
    assert {("BugDetector", "auth.py"), ("SecurityScanner", "auth.py"), ("StyleAdvisor", "auth.py"),
            ("TestCoverage", "fail.py")} <= raw
    errors = {r.agent: r.error for r in done.agent_runs.collect() if r.error}
    assert errors == {"TestCoverage": "1 failed: RuntimeError: model down"}
    top = done.findings.orderBy("rank").filter("job_id = 'a'").first()
    assert top.severity == "CRITICAL" and "Detected" not in top.description
    summary = {r.job_id: r for r in done.summary.collect()}
    assert summary["b"].review_decision == "APPROVE"
    assert summary["b"].executive_summary == "No reviewable files in this PR."
    assert summary["a"].review_decision == "REQUEST_CHANGES"
    diff = "diff --git a/auth.py b/auth.py\n@@ -0,0 +1,3 @@\n+token\n+def\n+return"
    diffs = spark.createDataFrame([("a", diff)], "job_id string, diff string")
    payloads = {r.job_id: json.loads(r.payload) for r in pl.review_payloads(jobs(spark, "a", "b"), done, diffs).collect()}
    assert payloads["a"]["comments"][0]["position"] == 2
    assert "fail.py" in payloads["a"]["body"] and payloads["b"]["comments"] == []


def test_content_is_not_shuffled(spark):
    """Scans of text end in narrow rows before any exchange."""
    files = changed(spark, [("a", 0, "x.py", "modified", "md5(x)")])
    from mergelight.operators.text import chunk_files, extract_functions_lines, file_facts, scan_security_rules

    for step in (scan_security_rules, extract_functions_lines, file_facts, chunk_files):
        plan = step(files)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, step.__name__


def test_runs_are_those_of_the_given_detectors(spark):
    files = changed(spark, [("a", 0, "x.py", "modified", "token = 'abcdefgh1'")])
    done = pl.review(jobs(spark, "a"), files, detectors={"SecurityScanner": pl.rule_detector})
    assert [(r.agent, r.files_analyzed, r.error) for r in done.agent_runs.collect()] == [("SecurityScanner", 1, None)]
    assert [r.agent for r in done.summary.first().agent_results] == ["SecurityScanner"]


def test_pruned_folders_are_not_listed_and_large_files_not_read(spark, tmp_path, monkeypatch):
    make_tree(tmp_path)
    (tmp_path / "huge.py").write_bytes(b"x" * 2_000_001)
    (tmp_path / "node_modules" / "deep").mkdir()
    reader = CodeTreeReader(str(tmp_path), (".py", ".js", ".ts"), frozenset(fixed.SCAN_PRUNED_DIRS))
    size, other = LessThanOrEqual(("size",), 2_000_000), LessThanOrEqual(("other",), 1)
    assert list(reader.pushFilters([size, other])) == [other]
    opened, selector = [], pyarrow.fs.FileSelector
    monkeypatch.setattr(pyarrow.fs, "FileSelector", lambda folder: opened.append(folder) or selector(folder))
    names = [name for name, _ in reader.listed()]
    assert "big.py" in names and "huge.py" not in names and len(reader.partitions()) == 1
    assert {str(folder)[len(str(tmp_path)):] for folder in opened} == {"", "/core", "/tests", "/web", "/venvx"}
    assert readers.scan_code_files(spark, str(tmp_path)).count() == 5


def test_code_tree_comes_in_bounded_partitions(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([(f"d{n % 7}/f{n}.py", "x" * n) for n in range(300)], "filename string, content string")
    assert writers.write_code_tree(files.repartition(3), str(tmp_path)) == 300
    monkeypatch.setattr(code_tree, "PARTITION_FILES", 20)
    reader = CodeTreeReader(str(tmp_path), (".py",), frozenset())
    parts = reader.partitions()
    assert len(parts) == 15 and all(len(p.paths) <= 20 for p in parts)
    found = readers.scan_code_files(spark, str(tmp_path)).collect()
    assert {r.filename: r.content for r in found} == {r.filename: r.content for r in files.collect()}
    assert readers.scan_code_files(spark, str(tmp_path / "d0")).count() == 43


PRS = "repo string, number bigint, title string, updated_at timestamp, merged_at timestamp, diff string"


def test_conventions_are_learned_and_cached(spark):
    """A fresh profile is used, the others are learned with the model's part; failures cost that only."""
    at = dt.datetime(2024, 1, 1)
    added = "diff --git a/x.py b/x.py\n@@ -0,0 +1,3 @@\n+def getItem(a: int) -> int:\n+    return a + 1\n+\n"
    prs = spark.createDataFrame(
        [(f"o/{r}", 1, "t", at, at, added) for r in "abc"] + [("o/z", 1, "t", at, at, added)], PRS)
    stored = spark.createDataFrame(
        [("o/a", "PascalCase", True, True, "numpy", 9, False, False, "Test*", ["p"], [], at + dt.timedelta(hours=h))
         for h in (1, 2)] + [("o/b", "old", True, True, "numpy", 9, False, False, "Test*", [], [], at - dt.timedelta(days=2))],
        schemas.CONVENTIONS)

    def model(prompts):
        (prompt,) = prompts
        if "conventions of o/c" in prompt:
            raise RuntimeError("down")
        return ['```json\n{"naming_style": "x", "test_naming_pattern": "Test*", "uses_black_formatting": true, '
                '"max_function_length": "long", "common_patterns": ["one", "two"], "anti_patterns": 3}\n```']

    repos = spark.createDataFrame([("o/a",), ("o/b",), ("o/c",), ("o/d",)], "repo string")
    now = F.lit(at + dt.timedelta(hours=3))
    profiles, learned = pl.repo_conventions(repos, prs, stored, now, model)
    got = {r.repo: r for r in profiles.collect()}
    assert sorted(got) == ["o/a", "o/b", "o/c", "o/d"] and sorted(r.repo for r in learned.collect()) == ["o/b", "o/c", "o/d"]
    assert (got["o/a"].naming_style, got["o/a"].max_function_length) == ("PascalCase", 9)
    b = got["o/b"]
    assert (b.naming_style, b.test_naming_pattern, b.uses_black_formatting, b.common_patterns, b.anti_patterns) == (
        "camelCase", "Test*", True, ["one", "two"], [])
    assert (got["o/c"].naming_style, got["o/c"].test_naming_pattern, got["o/c"].common_patterns) == ("camelCase", "test_*", [])
    assert got["o/d"].naming_style == "snake_case"
    done = pl.review(jobs(spark, "a", "d"), changed(spark, [("a", 0, "x.py", "modified", "md5(x)")]),
                     conventions=stored, merged_prs=prs, now=now)
    assert [r.repo for r in done.learned.collect()] == ["o/d"] and done.findings.count() == 1
