"""Clustering, merging, ranking and reports."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mergelight.fixed import TITLE_STOP_WORDS
from mergelight.functions.findings import MODEL_ITEMS, RULE_HITS, agent_tag, finding_order, format_finding
from mergelight.operators import findings as of
from mergelight.operators import ranking as rk
from mergelight.operators import reports as rp
from mergelight.operators.text import scan_security_rules

KIND = ("job_id string, seq bigint, agent string, file_path string, line_number bigint, "
        "severity string, category string, title string, description string, suggestion string, "
        "fix_example string, code_snippet string, confidence double")


def table(spark, rows):
    return of.with_finding_defaults(spark.createDataFrame(rows, KIND))


def finding(seq, line, category="c", title="t", agent="A", severity="LOW", path="f", **more):
    row = dict(job_id="j", seq=seq, agent=agent, file_path=path, line_number=line,
               severity=severity, category=category, title=title, description=f"d{seq}",
               suggestion="s", fix_example=None, code_snippet=None, confidence=0.5)
    return {**row, **more}


def similar(a, b):
    shared = set(a["title"].lower().split()) & set(b["title"].lower().split())
    return a["category"] == b["category"] or len(shared - set(TITLE_STOP_WORDS)) > 1


def brute_clusters(rows):
    """seq -> seed, by comparing each finding with all seeds before it."""
    seeds, chosen = [], {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        fits = [s for s in seeds if (s["job_id"], s["file_path"]) == (row["job_id"], row["file_path"])
                and abs(s["line_number"] - row["line_number"]) <= 3 and similar(s, row)]
        if not fits:
            seeds.append(row)
        chosen[row["seq"]] = (fits or [row])[0]["seq"]
    return chosen


def random_findings(rng, n, lines, files=2, categories=6):
    titles = ["null check missing", "missing null check here", "the a of", "sql in the query",
              "unsafe sql query", "Name Style", "style name", ""]
    order = rng.sample(range(10 * n), n)
    return [finding(order[i], rng.randint(-3, lines), rng.choice("pqrstu"[:categories]),
                    rng.choice(titles), path=rng.choice("fg"[:files]),
                    job_id=rng.choice("jk")) for i in range(n)]


def clusters(spark, rows, **options):
    got = of.cluster_findings(table(spark, rows), **options).select("seq", "cluster_seq").collect()
    assert len(got) == len(rows)
    return {r.seq: r.cluster_seq for r in got}


@pytest.mark.parametrize("n, lines", [(300, 40), (300, 2500), (250, 3)])
def test_clusters_agree_with_brute_force(spark, n, lines):
    rows = random_findings(random.Random(n + lines), n, lines)
    assert clusters(spark, rows) == brute_clusters(rows)


def test_seed_not_chain_decides(spark):
    rows = [finding(1, 10), finding(2, 13), finding(3, 16), finding(4, 13, "x", "other thing"),
            finding(5, 13, "y", "the of and")]
    assert clusters(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("seed, block_lines, ahead, lines", [
    (1, 8, 1, 30), (2, 16, 2, 60), (3, 4096, 1, 30), (4, 4, 16, 200), (5, 7, 1, 3), (6, 2, 1, 40),
])
def test_rounds_agree_with_brute_force(spark, seed, block_lines, ahead, lines):
    """Small blocks and few findings ahead make many rounds of the one way there is."""
    rows = random_findings(random.Random(seed), 120, lines, files=1)
    assert clusters(spark, rows, block_lines=block_lines, ahead=ahead) == brute_clusters(rows)


def test_long_titles(spark):
    rng = random.Random(8)
    words = [f"w{n}" for n in range(4000)]
    rows = [finding(n, n % 9, f"c{n}", " ".join(rng.sample(words, 1500))) for n in range(40)]
    rows += [finding(50 + n, n % 9, f"d{n}", f"own{n} {rows[n]['title'].split()[0]}") for n in range(10)]
    small = clusters(spark, rows[:2])  # starts the workers
    started = time.perf_counter()
    assert small and clusters(spark, rows) == brute_clusters(rows)
    assert time.perf_counter() - started < 5


def test_one_line_with_very_many_titles(spark):
    """A cell with thousands of different titles is decided by its first ones."""
    rows = [finding(n, 5, "c", f"title number {n}") for n in range(1, 3000)]
    rows += [finding(0, 6, "d", "title number 7"), finding(5000, 5, "e", "title zero"), finding(5001, 9, "c", "apart")]
    assert clusters(spark, rows) == brute_clusters(rows)


def test_islands_cross_bucket_edges(spark):
    lines = [1020, 1022, 1023, 1024, 1027, 1031, 2046, 2049, 5000, 8190, 8193, 8195]
    df = spark.createDataFrame([("f", n) for n in lines], "k string, n bigint")
    got = {r.n: r.island for r in rk.line_islands(df, ["k"], "n", 3).collect()}
    first, want = None, {}
    for last, n in zip([None, *lines], lines):
        first = n if last is None or n - last > 3 else first
        want[n] = first
    assert got == want


@pytest.mark.parametrize("keys, parts", [("ab", 4), ("a", 7), ("abcdefgh", 3), ("ab", 1)])
def test_range_rank_equals_row_number(spark, keys, parts):
    rng = random.Random(4)
    rows = [(rng.choice([*keys, None]), rng.randint(0, 3), n) for n in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k string, s int, n bigint").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = rk.range_rank(df, "k", [F.col("s").desc(), "n"], "r").collect()
        none = rk.range_rank(df.limit(0), "k", ["n"], "r").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for key in {k for k, *_ in rows}:
        ordered = sorted((-s, n) for k, s, n in rows if k == key)
        want.update({(key, n): i for i, (_, n) in enumerate(ordered, start=1)})
    assert {(r.k, r.n): r.r for r in got} == want and none == 0


def test_rank_of_one_huge_job(spark):
    """All rows of one job: every partition begins where the last one ends."""
    df = spark.range(1_000_000).select(F.lit("j").alias("k"), (F.col("id") * 7 % 1_000_003).alias("n"))
    ranked = rk.range_rank(df, "k", ["n"], "r")
    off = ranked.selectExpr("n", "r", "row_number() over (order by n) as want").filter("r <> want")
    assert off.isEmpty() and ranked.agg(F.max("r")).first()[0] == 1_000_000


def test_islands_of_many_rows_on_few_lines(spark):
    df = spark.createDataFrame([("f", n % 5 * 3, n) for n in range(200)], "k string, line bigint, x int")
    got = rk.line_islands(df, ["k"], "line", 3)
    assert got.count() == 200 and {r.island for r in got.collect()} == {0}


def test_finding_order_has_no_upper_ends(spark):
    """Rule 300, ten agents and 40,000 entries of one answer: all stand in order."""
    lit = F.lit
    parts = [
        spark.range(40_000).select(finding_order(2, lit(1), MODEL_ITEMS, lit(0), F.col("id")).alias("seq"), "id"),
        spark.range(10).select(finding_order(F.col("id"), lit(0), RULE_HITS, lit(600_000), lit(300)).alias("seq"),
                               (F.col("id") * 100_000).alias("id")),
        spark.range(3).select(finding_order(2, lit(1), RULE_HITS, lit(2**40), 255 + F.col("id")).alias("seq"),
                              (-1 - F.col("id")).alias("id")),
    ]
    rows = of.union_findings(parts).withColumns({"job_id": lit("j"), "agent": lit("A")})
    rows = rows.withColumn("id", F.format_string("%012d", F.col("id")))
    got = of.number_findings(rows).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, 40_014))
    assert [int(r.id) for r in got] == [0, 100_000, 200_000, -1, -2, -3, *range(40_000), *range(300_000, 1_000_000, 100_000)]


def test_merge_takes_best_and_keeps_all_text(spark):
    rows = [
        finding(1, 10, agent="BugDetector", severity="MEDIUM", fix_example="", confidence=0.4),
        finding(2, 11, agent="SecurityAgent", severity="HIGH", suggestion="z", fix_example="fix"),
        finding(3, 12, agent="BugDetector", severity="HIGH", suggestion="s", code_snippet="code"),
        finding(4, 50, agent="Solo", severity="ODD"),
    ]
    merged = of.rank_findings(of.merge_findings(of.cluster_findings(table(spark, rows))))
    one, solo = merged.orderBy("rank").collect()
    assert (one.severity, one.line_number, one.description) == (
        "HIGH", 11, "**BugDetector**: d1\n\n**SecurityAgent**: d2\n\n**BugDetector**: d3")
    assert (one.agent, one.suggestion) == ("[BUGDETECTOR][SECURITY]", "s | z")
    assert (one.fix_example, one.code_snippet, one.confidence) == ("fix", "code", 0.5)
    assert one.contributing_agents == ["BugDetector", "SecurityAgent"]
    assert (solo.agent, solo.contributing_agents, solo.description) == ("Solo", ["Solo"], "d4")
    assert (one["rank"], solo["rank"]) == (1, 2)


def test_one_place_holding_most_findings(spark):
    """Copies of one finding over several parts become one whole finding."""
    rows = [finding(n, 7, agent=f"A{n % 3}", suggestion=f"s{n % 4}") for n in range(40)]
    rows += [finding(41 + n, 100 + 9 * n) for n in range(10)]
    clustered = of.cluster_findings(table(spark, rows))
    merged = of.merge_findings(clustered, part_size=16).orderBy("seq").collect()
    assert [r.members for r in merged] == [40] + [1] * 10
    assert merged[0].description == "\n\n".join(f"**A{n % 3}**: d{n}" for n in range(40))
    assert merged[0].suggestion == "s0 | s1 | s2 | s3" and merged[0].contributing_agents == ["A0", "A1", "A2"]
    parts = of.merged_parts(of.cluster_members(clustered), part_size=16).filter("seq = 0").orderBy("part").collect()
    assert [(r.part, r.text.count("**: "), r.advice) for r in parts] == [
        (0, 16, "s0 | s1 | s2 | s3"), (16, 16, None), (32, 8, None)]


def test_a_cluster_of_very_many_members_is_no_single_row(spark):
    rows = spark.range(1_000_000).select(
        F.lit("j").alias("job_id"), F.col("id").alias("seq"), F.lit("A").alias("agent"), F.lit("f").alias("file_path"),
        F.lit(3).cast("bigint").alias("line_number"), F.lit("c").alias("category"), F.lit("t").alias("title"),
        F.lit("LOW").alias("severity"), F.lit("x").alias("description"), F.lit("s").alias("suggestion"))
    clustered = of.cluster_findings(of.with_finding_defaults(rows))
    heads = of.merged_heads(clustered).collect()
    assert [(r.seq, r.members, r.description) for r in heads] == [(0, 1_000_000, "x")]
    parts = of.merged_parts(of.cluster_members(clustered))
    assert parts.count() == -(-1_000_000 // of.PART_SIZE)
    assert parts.agg(F.max(F.length("text"))).first()[0] < 12 * of.PART_SIZE


def test_decisions(spark):
    jobs = spark.createDataFrame([(j,) for j in "abcd"], "job_id string")
    rows = [finding(1, 1, job_id="b", severity="LOW"), finding(2, 1, job_id="c", severity="CRITICAL"),
            finding(3, 1, job_id="c"), finding(4, 1, job_id="d", severity="HIGH")]
    got = {r.job_id: r.review_decision
           for r in of.review_decision(jobs, table(spark, rows)).collect()}
    assert got == {"a": "APPROVE", "b": "COMMENT", "c": "REQUEST_CHANGES", "d": "REQUEST_CHANGES"}


def test_no_findings_at_all(spark):
    empty = table(spark, [finding(1, 1)]).filter("seq = 0")
    assert of.rank_findings(of.merge_findings(of.cluster_findings(empty))).count() == 0


def test_comment_text(spark):
    lit = [F.lit(x) for x in ("HIGH", "T", "D", "S", "x = 1")]
    text = spark.range(1).select(
        format_finding(*lit, F.array(F.lit("A"), F.lit("B")), "Tool").alias("t"),
        format_finding(F.lit("ODD"), *lit[1:4], F.lit(""), F.array(F.lit("A")), "Tool").alias("u"),
        agent_tag(F.lit("Bug Agent")).alias("tag"),
    ).first()
    assert text.t == ("**⚠️ HIGH: T**\n\nD\n\n**Suggestion:** S\n\n```\nx = 1\n```\n\n*Detected by Tool A, B*")
    assert text.u.startswith("**\U0001f4dd ODD: T**") and "```" not in text.u
    assert text.tag == "[BUG]"


def test_payload_parts_hold_every_comment(spark):
    comments = [("j", n, f"p{n}", n, f"b{n}", None if n % 3 == 0 else n) for n in range(1, 26)]
    mapped = spark.createDataFrame(
        comments, "job_id string, rank bigint, path string, line bigint, body string, position int")
    jobs = spark.createDataFrame([("j", "sha"), ("idle", "s2")], "job_id string, head_sha string")
    summary = spark.createDataFrame([("j", "SUM", "COMMENT"), ("idle", "OK", "APPROVE")],
                                    "job_id string, executive_summary string, review_decision string")
    import json

    rows = rp.review_payload(jobs, mapped, summary, comments_per_part=10).collect()
    parts = {(r.job_id, r.part): json.loads(r.payload) for r in rows}
    assert sorted(parts) == [("idle", 0), ("j", 0), ("j", 1), ("j", 2)]
    assert parts["idle", 0] == {"commit_id": "s2", "body": "OK", "event": "APPROVE", "comments": []}
    placed = [c for n in range(3) for c in parts["j", n]["comments"]]
    assert [c["position"] for c in placed] == [n for n in range(1, 26) if n % 3]
    assert parts["j", 0]["body"].startswith("SUM\n\n---\n\n**Additional findings:**\n\n- **p3:3** — b3\n\n- **p6:6**")
    listed = "".join(parts["j", n]["body"] for n in range(3))
    assert all(f"**p{n}:{n}**" in listed for n in range(3, 26, 3))


def test_a_review_is_one_body_and_decides_once(spark):
    mapped = spark.createDataFrame(
        [("j", n, "p", n, "b", n) for n in range(1, 6)],
        "job_id string, rank bigint, path string, line bigint, body string, position int")
    jobs = spark.createDataFrame([("j", "sha")], "job_id string, head_sha string")
    summary = spark.createDataFrame([("j", "S", "REQUEST_CHANGES")],
                                    "job_id string, executive_summary string, review_decision string")
    import json

    whole = [json.loads(r.payload) for r in rp.review_payload(jobs, mapped, summary).collect()]
    assert [(p["event"], len(p["comments"])) for p in whole] == [("REQUEST_CHANGES", 5)]
    parts = rp.review_payload(jobs, mapped, summary, comments_per_part=2).orderBy("part").collect()
    assert [json.loads(r.payload)["event"] for r in parts] == ["REQUEST_CHANGES", "COMMENT", "COMMENT"]


def test_findings_without_a_place_stay_alone(spark):
    rows = [finding(1, 10), finding(2, None), finding(3, None), finding(4, 11)]
    assert clusters(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 1}


def test_a_single_finding_keeps_its_empty_texts(spark):
    rows = [finding(1, 10, fix_example="", code_snippet="")]
    one = of.merge_findings(of.cluster_findings(table(spark, rows))).first()
    assert (one.fix_example, one.code_snippet) == ("", "")


def test_a_name_listed_twice_gives_its_findings_once(spark):
    files = spark.createDataFrame([("j", 1, "f.py", "exec(y)\nexec(z)", "python")],
                                  "job_id string, ord bigint, filename string, content string, language string")
    found = scan_security_rules(files)
    order = spark.createDataFrame([("j", "f.py", 4), ("j", "f.py", 2)], "job_id string, filename string, review_ord bigint")
    assert [r.seq for r in of.resequence(found, order).collect()] == [1, 2]
