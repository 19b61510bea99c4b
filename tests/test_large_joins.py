"""Tables that grow with the input meet by a shuffle, however small the planner takes them to be."""

import time

from pyspark.sql import functions as F

from mergelight import session
from mergelight.operators import coverage as ov
from mergelight.operators import files as of
from mergelight.operators import findings as fd
from mergelight.operators import graph as og
from mergelight.operators import ranking
from mergelight.operators import responses as rs
from mergelight.plans import adapters
from mergelight.session import cut_lineage
from mergelight.sources import writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def code_files(spark):
    return spark.createDataFrame(
        [("j", 0, "pkg/a.py", "python", "import pkg.b\ndef run(): pass\n"),
         ("j", 1, "pkg/b.py", "python", "def walk(): pass\n"),
         ("j", 2, "tests/test_a.py", "python", "def test_run(): run()\n")],
        "job_id string, ord bigint, filename string, language string, content string",
    )


def functions(spark):
    return spark.createDataFrame(
        [("j", 0, "pkg/a.py", 0, "run", 2, 2), ("j", 1, "pkg/b.py", 0, "walk", 1, 1)],
        "job_id string, ord bigint, filename string, func_ord int, name string, start_line int, end_line int",
    )


def test_coverage_sends_no_table_through_the_driver(spark):
    files, names = code_files(spark), functions(spark)
    matched = ov.match_test_files(files)
    alone = ov.functions_without_test_file(files, names)
    untested = ov.untested_functions(files, names)
    for found in (matched, alone, untested):
        assert "Broadcast" not in plan(found)
    assert [(r.ord, r.test_ord) for r in matched.collect()] == [(0, 2)]
    assert [r.name for r in alone.collect()] == ["walk"]
    assert untested.collect() == []


def test_prompts_meet_texts_by_shuffle(spark):
    files = code_files(spark)
    tests = files.selectExpr("job_id", "ord", "'t.py' AS test_filename", "repeat('x', 5000) AS test_content").filter("ord = 0")
    prompts = rs.coverage_prompts(files, functions(spark).drop("filename"), tests)
    assert "Broadcast" not in plan(prompts)
    assert {r.ord: r.has_test_file for r in prompts.collect()} == {0: True, 1: False}


def test_import_graph_meets_by_shuffle(spark):
    files = code_files(spark)
    edges = og.build_graph(files)
    assert "Broadcast" not in plan(edges)
    assert [(r.src, r.dst) for r in edges.collect()] == [("pkg/a.py", "pkg/b.py")]
    numbered = og._numbered(edges, og._nodes(edges))
    bits = numbered.selectExpr("job_id", "dst AS node", "0 AS word", "1 AS bits")
    assert "Broadcast" not in plan(og._sent(bits, numbered)) + plan(og._jumped(numbered))
    scores = files.select("job_id", "filename").withColumn("impact_score", F.lit(0.5))
    joined = of.attach_impact(files.select("job_id", "filename"), scores)
    assert "Broadcast" not in plan(joined)
    assert [r.impact_score for r in joined.collect()] == [0.5] * 3


def test_findings_meet_by_shuffle(spark):
    rows = spark.createDataFrame(
        [("j", n, "Agent", "a.py", 10 * (n // 2), "LOW", "style", f"long line {n // 2}", f"at {n}", "cut it", "", 0.5) for n in range(4)],
        "job_id string, seq long, agent string, file_path string, line_number long, severity string, category string, "
        "title string, description string, suggestion string, fix_example string, confidence double",
    )
    clustered = fd.cluster_findings(fd.with_finding_defaults(rows))
    merged = fd.merge_findings(clustered)
    ranked = fd.rank_findings(merged)
    for found in (clustered, fd.seed_member_pairs(clustered), merged, ranked):
        assert "Broadcast" not in plan(found)
    assert {r.seq: r.cluster_seq for r in clustered.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert sorted((r.seq, r["rank"], r.members) for r in ranked.collect()) == [(0, 1, 2), (2, 2, 2)]


def odd_members(spark):
    rows = [("j", n, agent, "a.py", 10, severity, "style", "long line", text, advice, fix, 0.5)
            for n, agent, severity, text, advice, fix in [
                (1, "B", "LOW", "one", "cut it", ""), (2, "A", "HIGH", None, "wrap it", "x"), (3, "B", "HIGH", "three", None, "y"),
                (7, None, "INFO", "seven", "cut it", None), (9, "A", None, "nine", "", ""), (None, "C", "LOW", "none", "lost", "z")]]
    return fd.with_finding_defaults(spark.createDataFrame(
        rows, "job_id string, seq long, agent string, file_path string, line_number long, severity string, category string, "
        "title string, description string, suggestion string, fix_example string, confidence double"))


def test_merging_reads_and_shuffles_members_once(spark):
    """clusters were computed three times, and all their columns shuffled for each."""
    merged = fd.merge_findings(cut_lineage(fd.cluster_findings(odd_members(spark))))
    assert plan(merged).count("ExistingRDD") == 1 and plan(merged).count("Exchange hashpartitioning") == 1
    one = merged.first()
    assert (one.seq, one.severity, one.members, one.fix_example) == (1, "HIGH", 6, "x")
    assert one.description == "**C**: none\n\n**B**: one\n\n**B**: three\n\n**A**: nine"
    assert one.suggestion == "cut it | wrap it | " and one.contributing_agents == ["A", "B", "C"]
    parts = fd.merge_findings(cut_lineage(fd.cluster_findings(odd_members(spark))), part_size=2)
    assert parts.collect() == merged.collect()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName() for n in range(files.length()) if files.apply(n).getName().startswith("shuffle_")}


def left_over(spark, before, seconds=10):
    until = time.monotonic() + seconds
    while (left := shuffle_files(spark) - before) and time.monotonic() < until:
        time.sleep(0.1)
    return left


def test_what_was_shuffled_goes_with_the_lineage(spark, tmp_path):
    """Shuffles of steps that are kept stayed until the driver collected its garbage: they added up."""
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    summed = rows.repartition(5, "id").groupBy("k").agg(F.sum("id").alias("n"))
    want, before = sorted(summed.collect()), shuffle_files(spark)
    setting = spark.conf.get(session.SHUFFLES_GO)
    kept = cut_lineage(rows.repartition(5, "id").groupBy("k").agg(F.sum("id").alias("n")))
    writers.write_batch(rows.repartition(5, "id"), str(tmp_path), 0)
    assert not left_over(spark, before) and spark.conf.get(session.SHUFFLES_GO) == setting
    assert sorted(kept.collect()) == sorted(kept.collect()) == want == sorted(summed.collect())
    assert spark.read.parquet(f"{tmp_path}/batch=0").count() == 1000


def test_ranking_computes_and_keeps_what_it_is_asked_for(spark, monkeypatch):
    """Merged findings were kept with all their texts, also for callers that ask for none of them."""
    kept = []
    for module in (fd, ranking):
        monkeypatch.setattr(module, "cut_lineage", lambda df: kept.append(df.columns) or cut_lineage(df))
    merged = fd.merge_findings(cut_lineage(fd.cluster_findings(odd_members(spark))))
    kept.clear()
    ranked = fd.rank_findings(merged)
    assert kept and not any("description" in names for names in kept)
    assert "cut it" in ranked.first().suggestion and ranked.first()["rank"] == 1
    numbers = ranked.select("job_id", "seq", "severity", "rank")
    shuffled = [line for line in plan(numbers).splitlines() if "Project" in line]
    assert numbers.first().severity == "HIGH" and not any("description" in line for line in shuffled)


def test_titles_are_taken_apart_once(spark):
    """every finding's title was taken apart twice, once to collapse and once to join."""
    assert "array_except" not in plan(fd.cluster_findings(odd_members(spark)))


def test_groups_of_findings_come_in_pieces_of_bounded_rows(spark, small):
    rows = spark.range(1000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    key = adapters.GROUPED["findings_v"][1]
    dealt = adapters.grouped_table(rows, key, 100)
    assert dealt.rdd.getNumPartitions() == 10
    grouped = plan(dealt.groupBy(F.expr(key)).count())
    assert grouped.count("Exchange") == 1  # no second shuffle, whose pieces would grow
    assert plan(adapters.grouped_table(rows, key, 1000).groupBy(F.expr(key)).count()).count("REPARTITION_BY_NUM") == 0


def test_a_large_part_table_is_not_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr(adapters, "PIECE_ROWS", {"part": 50})
    monkeypatch.setattr(adapters, "GROUPED", {"findings_v": (*adapters.GROUPED["findings_v"][:2], 1000)})
    found = adapters.view(spark, small, "findings_v")
    assert "Broadcast" not in plan(found) and "REPARTITION_BY_NUM" in plan(found)
    monkeypatch.undo()
    whole = adapters.view(spark, small, "findings_v")
    assert found.exceptAll(whole).isEmpty() and whole.exceptAll(found).isEmpty()


def test_filters_on_texts_made_of_rows_run_where_rows_are_spread(spark, small):
    files = adapters.view(spark, small, "code_v")
    asked = files.filter(F.lower("content").contains("token")).select("filename")
    assert "Exchange" not in plan(asked)  # not in the one task that reads the file
    assert asked.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
