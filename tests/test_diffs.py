"""Diff positions, nearest positions, comments and added code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mergelight.operators import diffs as od
from mergelight.sources import readers


def brute_positions(text):
    """file -> {line: (position, first position)}, line by line with the known quirks."""
    found, name, place, line_no = {}, None, 0, 0
    for line in text.split("\n"):
        if line[:10] == "diff --git":
            hit = re.search("b/(.+)", line)
            if hit:
                name, place = hit[1], 0
                found[name] = {}
        elif line[:2] == "@@":
            hit = re.search(r"\+(\d+)", line)
            line_no = int(hit[1]) - 1 if hit else line_no
            place += 1
        elif name is not None and line[:3] not in ("---", "+++"):
            place += 1
            if line[:1] != "-":
                line_no += 1
                first = found[name].get(line_no, (0, place))[1]
                found[name][line_no] = (place, first)
    return {(n, k): v for n, lines in found.items() for k, v in lines.items()}


def random_diff(rng):
    pool = ["+a", "-b", " c", "", "+++ b/x", "--- a/x", "@@ -1 +%d,3 @@", "@@ none @@",
            "\\ No newline", "index 1..2", "diff --git a/f%d b/f%d", "diff --git broken",
            "diff --git a/lib/x b/lib/x", "+\r", "++double"]
    lines = []
    for _ in range(rng.randint(0, 60)):
        line = rng.choice(pool)
        count = line.count("%d")
        lines.append(line % ((rng.randint(1, 4),) * count if "diff" in line else (rng.randint(1, 30),))
                     if count else line)
    return "\n".join(lines)


def test_positions_agree_with_brute_force(spark):
    rng = random.Random(11)
    texts = [random_diff(rng) for _ in range(150)] + ["", "diff --git a/é b/é\r\n@@ -1 +2 @@\n x"]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id bigint, diff string")
    got = {}
    for r in od.parse_diff(df).collect():
        got.setdefault(r.job_id, {})[(r.file, r.line)] = (r.position, r.ins_order)
    for n, text in enumerate(texts):
        assert got.get(n, {}) == brute_positions(text), text


@pytest.mark.parametrize("parity, seed", [(True, 3), (False, 4)])
def test_lines_in_blocks_give_what_whole_texts_give(spark, parity, seed):
    rng = random.Random(seed)
    texts = [random_diff(rng) for _ in range(120)] + ["", "diff --git a/é b/é\r\n@@ -1 +2 @@\n x\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "job_id bigint, diff string")
    want = sorted(map(tuple, od.parse_diff(df, parity=parity).collect()))
    rows = [(n, at // 4, at, line) for n, text in enumerate(texts) for at, line in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "job_id bigint, block bigint, at bigint, value string")
    got = sorted(map(tuple, od.parse_diff_lines(lines, parity).collect()))
    assert got == want


def test_a_long_diff_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    texts = {f"d{n}": "\n".join(random_diff(rng) for _ in range(40)) + "\n" * (n % 2) for n in range(4)}
    for name, text in texts.items():
        (tmp_path / f"{name}.diff").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = readers.read_diff_lines(spark, str(tmp_path))
        blocks = lines.select("job_id", "block").distinct().count()
        got = sorted(map(tuple, od.parse_diff_lines(lines).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.createDataFrame(sorted(texts.items()), "job_id string, diff string")
    assert blocks > 8 and got == sorted(map(tuple, od.parse_diff(whole).collect()))


def test_hunks_only_mode(spark):
    text = ("diff --git a/b/x.py b/b/x.py\nindex 1\n--- a/b/x.py\n+++ b/b/x.py\n@@ -1 +5,2 @@\n keep\n"
            "--- gone\n+++ added\n\\ No newline at end of file\n@@ -9 +20 @@\n+last\n")
    df = spark.createDataFrame([("j", text)], "job_id string, diff string")
    rows = {(r.file, r.line): r.position for r in od.parse_diff(df, parity=False).collect()}
    assert rows == {("b/x.py", 5): 1, ("b/x.py", 6): 3, ("b/x.py", 20): 5}


@pytest.mark.parametrize("spread", [60, 9000])
def test_nearest_agrees_with_brute_force(spark, spread):
    rng = random.Random(spread)
    marks = {(f, rng.randint(1, spread)): (rng.randint(1, 99), n)
             for n, f in enumerate(rng.choice("abc") for _ in range(80))}
    probes = {(f, rng.randint(-5, spread + 5)) for f in "abcd" for _ in range(120)}
    positions = spark.createDataFrame(
        [("j", f, line, p, n) for (f, line), (p, n) in marks.items()],
        "job_id string, file string, line bigint, position int, ins_order int",
    )
    asked = spark.createDataFrame(
        [("j", f, line) for f, line in probes] * 2, "job_id string, file string, line bigint"
    )
    rows = od.nearest_diff_position(asked, positions).collect()
    assert len(rows) == 2 * len(probes)
    for r in rows:
        near = [(abs(line - r.line), n, p) for (f, line), (p, n) in marks.items() if f == r.file]
        assert r.position == (min(near)[2] if near else None)


def test_comments_outside_the_diff_stay_unmapped(spark):
    positions = spark.createDataFrame([("j", "a", 3, 7, 7)],
                                      "job_id string, file string, line bigint, position int, ins_order int")
    comments = spark.createDataFrame([("j", "a", 9, "x"), ("j", "z", 3, "y"), ("k", "a", 3, "w")],
                                     "job_id string, path string, line bigint, body string")
    got = {(r.job_id, r.path): r.position for r in od.map_comments(comments, positions).collect()}
    assert got == {("j", "a"): 7, ("j", "z"): None, ("k", "a"): None}


def test_added_blocks(spark):
    long = "y" * 3000
    text = ("+++ b/x\n+  first line of code here\n+second\n context\n+tiny\n-gone\n++ plus sign starts this\n"
            f"+{long}\n+++ not code\n+the last block, no line end")
    df = spark.createDataFrame([(text,)], "d string")
    got = df.select(od.added_blocks(F.col("d")).alias("b")).first().b
    assert got == ["first line of code here\nsecond",
                   ("+ plus sign starts this\n" + long)[:2000], "the last block, no line end"]
    many = "\n".join("+" + "z" * 30 for _ in range(20_000))
    size = spark.createDataFrame([(many,)], "d string").select(
        F.size(od.added_blocks(F.col("d"))).alias("n")).first().n
    assert size == 1
