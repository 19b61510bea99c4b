"""What physical plans must and must not contain."""

import pytest

import __spark_entry__ as driver

UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
WHOLE_REVIEWS = {"review_summary", "review_findings"}


@pytest.fixture(scope="module")
def plans(spark, small):
    found = {}
    for name, function in driver.queries().items():
        if name not in WHOLE_REVIEWS:
            found[name] = function(spark, small)._jdf.queryExecution().executedPlan().toString()
    return found


def test_no_cross_joins_and_no_row_at_a_time_python(plans):
    bad = {(name, word) for name, plan in plans.items() for word in UNWANTED if word in plan}
    assert not bad


@pytest.mark.parametrize("name", ["recent_merged_prs"])
def test_top_rows_are_kept_before_the_shuffle(plans, name):
    assert "WindowGroupLimit" in plans[name]


@pytest.mark.parametrize("name", [
    "scan_security_rules", "explode_lines", "parse_diff", "js_imports", "classify_event",
    "response_findings", "build_prompt_bug",
])
def test_no_exchange_of_text(plans, name):
    exchanges = [line for line in plans[name].split("\n") if "Exchange" in line]
    # the only exchanges spread small test tables over the cores
    assert all("RoundRobinPartitioning" in line for line in exchanges)


@pytest.mark.parametrize("name", ["severity_counts", "skip_reason_counts"])
def test_aggregates_combine_before_the_shuffle(plans, name):
    assert "partial_count" in plans[name]


def test_scans_read_only_the_columns_they_need(plans):
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plans["py_imports"]
    assert "html" not in plans["explode_lines"]


def test_narrow_tables_are_cut_by_rows(spark, tmp_path, monkeypatch):
    from mergelight.plans import adapters

    monkeypatch.setattr(adapters, "PIECE_ROWS", {"part": 5})
    spark.range(200).coalesce(1).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = adapters.table(spark, str(tmp_path), "part")
    assert rows.rdd.getNumPartitions() == max(40, spark.sparkContext.defaultParallelism)
    assert sorted(r.p_partkey for r in rows.collect()) == list(range(200))
