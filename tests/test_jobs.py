"""Events, signatures, job tables and their streams."""

import collections
import datetime as dt
import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from mergelight import fixed, schemas, session
from mergelight.functions.signature import hmac_sha256
from mergelight.functions.text import time_ago
from mergelight.operators import clustering
from mergelight.operators import findings as of
from mergelight.operators import jobs as oj
from mergelight.operators import ranking as rk
from mergelight.operators import text as ot
from mergelight.sources import readers, writers
from mergelight.streaming import reviews as st
from mergelight.streaming.processors import STATUS_OUT

START = dt.datetime(2024, 5, 1)


@pytest.mark.parametrize("secret", ["k", "s" * 64, "long secret " * 9, "é"])
def test_signature_equals_the_standard_library(spark, secret):
    bodies = ["", "{}", "é" * 100, "x" * 1000]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for r in df.select("b", hmac_sha256(F.col("b"), secret).alias("h")).collect():
        assert r.h == hmac.new(secret.encode(), r.b.encode(), hashlib.sha256).hexdigest()


def event_rows(secret="k"):
    body = {"action": "opened", "pull_request": {"number": 4, "head": {"sha": "h"}},
            "repository": {"full_name": "o/r"}, "installation": {"id": 9}}
    texts = [
        ("pull_request", json.dumps(body)), ("pull_request", json.dumps({**body, "action": "closed"})),
        ("pull_request", json.dumps({"action": "synchronize"})), ("push", "{}"), ("ping", "{}"), ("pull_request", "{"),
    ]
    rows = []
    for n, (kind, text) in enumerate(texts):
        sign = "sha256=" + hmac.new(secret.encode(), text.encode(), hashlib.sha256).hexdigest()
        rows.append((n, START + dt.timedelta(seconds=n), kind, sign, text))
    rows += [(6, START, "pull_request", None, texts[0][1]), (7, START, "pull_request", "sha256=0", texts[0][1])]
    return rows


def test_events_to_jobs(spark):
    events = spark.createDataFrame(event_rows(), schemas.EVENTS)
    got = {r.event_id: (r.verified, r.status, r.reason)
           for r in oj.classify_event(oj.verify_signature(events, "k")).collect()}
    assert got == {
        0: (200, "queued", None), 1: (200, "ignored", "Action 'closed' not handled"), 2: (200, "queued", None),
        3: (200, "ignored", "Event type 'push' not handled"), 4: (200, "pong", None), 5: (200, "bad_request", None),
        6: (401, "rejected", None), 7: (401, "rejected", None),
    }
    assert oj.verify_signature(events, "").select("verified").distinct().first().verified == 503
    full, bare = oj.review_jobs(events, "k").orderBy("created_at").collect()
    assert (full.repo, full.pr_number, full.head_sha, full.installation_id) == ("o/r", 4, "h", 9)
    assert (bare.repo, bare.pr_number, bare.pr_title, bare.status) == ("", 0, "", "queued")


def test_call_rate_counts_the_minute_before(spark):
    moments = [0, 0, 1, 30, 59.999999, 60, 60.000001, 119.5, 120, 300]
    calls = spark.createDataFrame([(n, "k", START + dt.timedelta(seconds=s)) for n, s in enumerate(moments)],
                                  "n int, k string, t timestamp")
    for r in oj.call_rate_check(calls, "k", "t", limit=4).collect():
        want = sum(0 < moments[r.n] - m < 60 - 5e-7 for m in moments)
        assert (r.calls_before, r.limited) == (want, want >= 4), r.n


def test_job_tables(spark):
    jobs = spark.createDataFrame([(f"j{n}", START + dt.timedelta(hours=n), "queued", n, 1, float(n % 2))
                                  for n in range(60)],
                                 "job_id string, created_at timestamp, status string, critical_count int, "
                                 "high_count int, processing_time_seconds double")
    assert [r.job_id for r in oj.recent_jobs(jobs).limit(2).collect()] == ["j59", "j58"]
    row = oj.dashboard_stats(jobs).first()
    assert tuple(row) == (50, sum(range(10, 60)) + 50, sum(range(10, 60)), 1.0)
    results = spark.createDataFrame([("j1", "finished", 3)], "job_id string, status string, total int")
    got = {r.job_id: (r.status, r.total) for r in oj.jobs_with_results(
        jobs.select("job_id", "status").filter("job_id in ('j1', 'j2')"), results).collect()}
    assert got == {"j1": ("finished", 3), "j2": ("unknown", None)}


def test_age_text(spark):
    ages = {59: "just now", 60: "1m ago", 3599: "59m ago", 3600: "1h ago", 86399: "23h ago", 200000: "2d ago"}
    df = spark.createDataFrame([(s, START - dt.timedelta(seconds=s)) for s in ages], "s int, t timestamp")
    got = df.select("s", time_ago(F.col("t"), F.lit(START)).alias("a")).collect()
    assert {r.s: r.a for r in got} == ages


def test_event_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(event_rows(), schemas.EVENTS).repartition(3).write.json(source)
    st.stream_review_jobs(readers.stream_events(spark, source, 1), "k", out, str(tmp_path / "c")).awaitTermination()
    batch = oj.review_jobs(readers.read_events(spark, source), "k")
    assert sorted(spark.read.parquet(out).select(batch.columns).collect()) == sorted(batch.collect())


UPDATES = "job_id string, ts timestamp, status string, result string"


def test_status_stream_goes_on_after_a_restart(spark, tmp_path):
    """Late updates change nothing, a second run continues, a repeated batch writes the same."""
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    rng = random.Random(1)
    rows = [(f"j{rng.randrange(5)}", START + dt.timedelta(seconds=rng.randrange(40)), f"s{n}", f"r{n}") for n in range(60)]
    rows += [("null", None, "s", None), ("j0", None, None, "late")]
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, UPDATES).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", 1).parquet(source)
        st.stream_job_status(stream, out, check).awaitTermination()
    got = sorted(st.read_job_status(spark, out).collect())
    assert got == sorted(oj.latest_job_status(spark.createDataFrame(rows, UPDATES)).collect())
    last = spark.read.parquet(out).filter("batch = 0").drop("batch").collect()
    writers.write_batch(spark.createDataFrame(last, STATUS_OUT), out, 0)
    assert sorted(st.read_job_status(spark, out).collect()) == got


def test_a_redelivered_event_is_queued_once_where_asked_for(spark, tmp_path):
    body = json.dumps({"action": "opened", "pull_request": {"number": 7, "head": {"sha": "h"}}, "repository": {"full_name": "o/r"}})
    other = body.replace('"h"', '"h2"')
    at = [START, START + dt.timedelta(minutes=1), START + dt.timedelta(minutes=2), START + dt.timedelta(hours=9)]
    texts = [body, body, other, other.replace("h2", "h3")]
    at.append(START)  # hours late
    texts.append(body.replace('"h"', '"h9"'))
    sign = lambda text: "sha256=" + hmac.new(b"k", text.encode(), hashlib.sha256).hexdigest()
    rows = [(n, t, "pull_request", sign(x), x) for n, (t, x) in enumerate(zip(at, texts))]
    for name, redelivery, want in (("on", "1 hour", {"h": 1, "h2": 1, "h3": 1}), ("off", None, {"h": 2, "h2": 1, "h3": 1, "h9": 1})):
        source, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
        for row in rows:  # a file each, in order
            spark.createDataFrame([row], schemas.EVENTS).coalesce(1).write.mode("append").json(source)
            stream = readers.stream_events(spark, source, 1)
            st.stream_review_jobs(stream, "k", out, str(tmp_path / f"{name}-c"), redelivery).awaitTermination()
        shas = collections.Counter(r.head_sha for r in spark.read.parquet(out).collect())
        assert shas == want


def test_file_stream_finds_what_the_batch_finds(spark, tmp_path):
    rows = [(f"j{n % 2}", n, f"f{n}.py", "modified", 0, 0, None, f"os.system({n})\nmd5(x)", None, 0.0) for n in range(8)]
    files = spark.createDataFrame(rows, schemas.FILES)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    files.repartition(4).write.parquet(source)
    st.stream_rule_findings(readers.stream_files(spark, source, 2), out, str(tmp_path / "c")).awaitTermination()
    batch = ot.scan_security_rules(files)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(r.id for r in batch.collect())


def test_findings_of_a_job_may_come_in_any_batches(spark, tmp_path):
    """Two batches that meet on the same lines give what one batch gives."""
    rng = random.Random(2)
    lines = [(f"j{rng.randrange(2)}", rng.randrange(3), rng.choice([*range(1, 60), None]), rng.choice("pqr"),
              rng.choice(["null check missing", "missing null check", "other thing", "sql query unsafe", "unsafe sql"]))
             for _ in range(120)]
    rows = [(job, f"f{file}", line, kind, title, rng.choice(fixed.SEVERITIES), f"d{n}", "s", rng.choice(["A", "B"]),
             (rng.randrange(3), file, 0, line or 0, n)) for n, (job, file, line, kind, title) in enumerate(lines)]
    kind = ("job_id string, file_path string, line_number bigint, category string, title string, severity string, "
            f"description string, suggestion string, agent string, seq {schemas.FINDING_ORDER}")
    found = of.with_finding_defaults(spark.createDataFrame(rows, kind))
    schema = found.schema
    all_rows = found.collect()
    source, store, merged = (str(tmp_path / n) for n in ("in", "store", "merged"))
    for part in (all_rows[:50], all_rows[50:51], all_rows[51:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        st.stream_merged_findings(stream, store, merged, str(tmp_path / "c")).awaitTermination()
    names = ["job_id", "rank", "severity", "file_path", "line_number", "title", "description", "agent", "members"]
    got = sorted((tuple(r) for r in st.read_merged_findings(spark, merged).select(*names).collect()), key=repr)
    whole = of.rank_findings(of.merge_findings(of.cluster_findings(of.number_findings(found))))
    assert got == sorted((tuple(r) for r in whole.select(*names).collect()), key=repr)
    st.merge_batch(spark, store, merged, 1)  # a batch that runs again
    again = st.read_merged_findings(spark, merged).select(*names).collect()
    assert sorted(map(tuple, again), key=repr) == got


def test_a_batch_keeps_whole_findings_once(spark, tmp_path, monkeypatch):
    """What a batch touches was kept four times with all its texts, and nothing of it went in between."""
    kept, keep = [], session.cut_lineage
    for module in (clustering, of, rk, st):
        monkeypatch.setattr(module, "cut_lineage", lambda df: kept.append(df.columns) or keep(df), raising=False)
    rows = [("j", f"f{n % 2}", n, "c", f"title {n}", "LOW", f"d{n}", "s", "A", (0, 0, 0, n, 0)) for n in range(8)]
    kind = ("job_id string, file_path string, line_number bigint, category string, title string, severity string, "
            f"description string, suggestion string, agent string, seq {schemas.FINDING_ORDER}")
    store, merged = str(tmp_path / "store"), str(tmp_path / "merged")
    writers.write_batch(of.with_finding_defaults(spark.createDataFrame(rows, kind)), store, 0)
    st.merge_batch(spark, store, merged, 0)
    assert sum("description" in names for names in kept) == 1
    assert sorted(r.description for r in st.read_merged_findings(spark, merged).collect()) == [
        "**A**: d0\n\n**A**: d2", "**A**: d1\n\n**A**: d3", "**A**: d4\n\n**A**: d6", "**A**: d5\n\n**A**: d7"]


def test_an_expired_profile_is_refreshed_once(spark, tmp_path):
    """Two stored profiles of a repo leave one timer; the time is that of the profiles."""
    source, check, seen = str(tmp_path / "in"), str(tmp_path / "c"), []
    day = dt.timedelta(days=1)
    kind = "repo string, naming_style string, learned_at timestamp"
    batches = [
        [("r", "old", START), ("q", "only", START)], [("r", "new", START + day / 2)],
        [("tick", "x", START + 1.2 * day)], [("tick", "x", START + 3 * day)], [("tock", "x", START + 9 * day)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).parquet(source)
        st.stream_repos_to_refresh(stream, lambda df, n: seen.extend(df.collect()), check).awaitTermination()
    assert sorted((r.repo, r.learned_at, r.expired_at) for r in seen) == [
        ("q", START, START + day), ("r", START + day / 2, START + 1.5 * day), ("tick", START + 3 * day, START + 4 * day)]


def test_result_store_is_idempotent_and_expires(spark, tmp_path):
    out = str(tmp_path / "results")
    rows = [(f"j{n}", START + dt.timedelta(hours=9 * n)) for n in range(12)]
    for batch, part in (("a", rows[:7]), ("b", rows[7:]), ("a", rows[:7])):  # the first one comes twice
        done = spark.createDataFrame(part, "job_id string, at timestamp")
        writers.write_job_results(done, out, F.col("at"), batch)
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == sorted(j for j, _ in rows)
    now = START + dt.timedelta(hours=9 * 11)
    live = lambda: sorted(r.job_id for r in writers.read_job_results(spark, out, F.lit(now)).collect())
    want = live()
    assert want == ["j10", "j11", "j9"]
    gone = writers.expire_job_results(spark, out, now.strftime("%Y-%m-%d"))
    assert gone and live() == want and spark.read.parquet(out).count() < 12


def test_calls_without_key_or_time_stay(spark):
    calls = spark.createDataFrame(
        [(None, "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:10"), ("a", None), ("a", "2024-01-01 00:00:20")],
        "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = [(r.k, r.calls_before) for r in oj.call_rate_check(calls, "k", "t").orderBy("t").collect()]
    assert sorted(got, key=str) == sorted([("a", 0), (None, 0), (None, 1), ("a", 0)], key=str)


def test_the_result_completed_last_counts(spark):
    jobs = spark.createDataFrame([("j",), ("k",)], "job_id string")
    jobs = jobs.withColumn("status", F.lit("queued"))
    results = spark.createDataFrame(
        [("j", "failed", 1), ("j", "finished", 2)], "job_id string, status string, completed_at int")
    got = {(r.job_id, r.status) for r in oj.jobs_with_results(jobs, results).collect()}
    assert got == {("j", "finished"), ("k", "unknown")}


def test_call_rate_windows_add_each_row_once(spark):
    at = [0, 1, 1, 30_000_000, 59_999_999, 60_000_000, 60_000_001, 119_999_999, 200_000_000]
    rows = [(i, k, t) for i, (k, t) in enumerate([("a", t) for t in at] + [(None, t) for t in at[3:7]])]
    calls = spark.createDataFrame(rows, "id long, k string, micros long").selectExpr("id", "k", "timestamp_micros(micros) AS t")
    rated = oj.call_rate_check(calls, "k", "t", limit=3)
    plan = rated._jdf.queryExecution().executedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", plan)
    assert frames and set(frames) == {"unboundedpreceding$()"}
    want = {i: sum(kk == k and t - 60_000_000 < tt < t for _, kk, tt in rows) for i, k, t in rows}
    assert {r.id: r.calls_before for r in rated.collect()} == want
    assert {r.id for r in rated.collect() if r.limited} == {i for i, n in want.items() if n >= 3}
