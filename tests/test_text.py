"""Lines, rules, functions, chunks and imports on edge cases and random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mergelight.functions import text as ft
from mergelight.functions.files import file_extension, is_generated_file, skip_reason
from mergelight.operators import text as ot


def frame(spark, contents, language="python"):
    rows = [("j", n, f"f{n}", language, c) for n, c in enumerate(contents)]
    return spark.createDataFrame(
        rows, "job_id string, ord bigint, filename string, language string, content string"
    )


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lines_keep_blank_ends_and_carriage_returns(spark):
    files = frame(spark, ["", "a\n", "a\r\nb", "\n\n"])
    rows = ot.explode_lines(files, "content", ["ord"]).orderBy("ord", "line_number").collect()
    got = {}
    for r in rows:
        got.setdefault(r.ord, []).append(r.line)
    assert got == {0: [""], 1: ["a", ""], 2: ["a\r", "b"], 3: ["", "", ""]}


@pytest.mark.parametrize("path, base, folder, stem", [
    ("a/b/c.tar.gz", "c.tar.gz", "a/b", "c.tar"), ("c", "c", "", "c"), ("/x", "x", "/", "x"),
    (".env", ".env", "", ".env"), ("a//b.py", "b.py", "a", "b"), ("..a.b", "..a.b", "", "..a"),
])
def test_path_parts(spark, path, base, folder, stem):
    p = F.lit(path)
    got = spark.range(1).select(ft.basename(p), ft.dirname(p), ft.stem(p)).first()
    assert tuple(got) == (base, folder, stem)


def test_normal_paths_agree_with_the_standard_library(spark):
    import posixpath

    rng = random.Random(3)
    paths = ["", ".", "..", "/..", "//a", "///a", "a/.."]
    paths += ["/".join(rng.choice(["a", "b", ".", "..", ""]) for _ in range(rng.randint(1, 7)))
              for _ in range(200)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for row in df.select("p", ft.normalize_path(F.col("p")).alias("n")).collect():
        assert row.n == posixpath.normpath(row.p), row.p


def test_one_decimal_rounds_like_the_binary_value(spark):
    rng = random.Random(5)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 1.25, 9.95, 0.009, 2.5, 1e6 + 0.05, 1024.0, 0.999]
    values += [round(rng.uniform(0, 500), rng.choice([2, 3, 9])) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", ft.one_decimal(F.col("v")).alias("t")).collect():
        assert row.t == "%.1f" % row.v, row.v


def test_extension_and_filters(spark):
    names = ["README", "dir.x/file", "A.PY", "b.Tsx"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.e for r in df.select(file_extension(F.col("n")).alias("e")).collect()]
    assert got == ["", ".x/file", ".py", ".tsx"]
    made = spark.createDataFrame(
        [("Cargo.lock", "x", False), ("a_pb2.py", "x", True), ("a.py", "z" * 491 + "generated", True),
         ("a.py", "z" * 492 + "generated", False), ("a.py", "DO NOT EDIT", True)],
        "n string, c string, want boolean",
    )
    for row in made.withColumn("got", is_generated_file(F.col("n"), F.col("c"))).collect():
        assert row.got == row.want, row.n
    reasons = spark.createDataFrame(
        [("a.png", "removed", "x"), ("a.PNG", "modified", "x"), ("a.py", "modified", ""),
         ("a.py", "modified", None), ("a.py", "modified", "x" * 500_001), ("a.py", "added", "x" * 500_000)],
        "n string, s string, c string",
    )
    got = [r.r for r in reasons.select(
        skip_reason(F.col("n"), F.col("s"), F.col("c")).alias("r")).collect()]
    assert got == ["removed", "binary", "no_content", "no_content", "too_large", None]


RULE_LINES = {
    1: ['API_KEY = "12345678"', "password = 'longenough'", "TOKEN = 'abcdefgh'"],
    2: ["subprocess.call(x, shell = True)"],
    3: ["subprocess.Popen(c, shell=True)", "subprocess.run(c,shell=True)"],
    4: ["os.system (x)"], 6: ["my_exec(x)"], 7: ["cur.execute(f'select')"],
    8: ["execute('a %s b' % (x))"], 9: ["MD5(x)", "hashlib.sha1 (x)"],
    10: ["pickle.load(f)", "pickle.loads(f)"], 11: ["yaml.load(f)"],
    12: ["random.choice(x)"], 13: ["el.innerHTML = x"], 14: ["document.write(x)"],
    15: ["<a dangerouslySetInnerHTML/>"],
}


def test_each_rule_fires_and_near_misses_do_not(spark):
    lines = [(number, text) for number, texts in RULE_LINES.items() for text in texts]
    misses = ['password = "short"', "yaml.load(f) , Loader=x", "subprocess.call(x)", "plain"]
    files = frame(spark, [t for _, t in lines] + misses)
    hits = {}
    for r in ot.matching_rules(files, ["ord"], parity=True).collect():
        hits.setdefault(r.ord, set()).add(r.rule_no)
    for n, (number, _) in enumerate(lines):
        assert number in hits.get(n, set()), lines[n]
    assert not any(len(lines) + n in hits for n in range(len(misses)))


def test_eval_rule_only_outside_parity(spark):
    files = frame(spark, ["eval(x)", "# eval(x)", "exec(eval(x))"])
    assert {r.rule_no for r in ot.matching_rules(files, ["ord"]).collect()} == {6}
    found = ot.matching_rules(files, ["ord"], parity=False).filter("rule_no = 5")
    assert sorted(r.ord for r in found.collect()) == [0, 2]


def test_finding_text_is_stripped_and_cut(spark):
    files = frame(spark, ["\t　os.system(" + "x" * 300 + ") \x0b"])
    row = ot.scan_security_rules(files).first()
    assert row.code_snippet == ("os.system(" + "x" * 300)[:200]
    assert row.description == "Pattern detected on line 1: " + ("os.system(" + "x" * 300)[:100]
    assert (row.confidence, row.contributing_agents) == (0.9, [])


def brute_functions(content):
    """(name, start, end, body, parameters) per def line, by definition."""
    lines = content.split("\n")
    out = []
    for number, line in enumerate(lines, start=1):
        hit = re.match(r"\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)", line)
        if not hit:
            continue
        outer = [n for n, later in enumerate(lines, start=1)
                 if n > number and later.strip() and later[:1] not in (" ", "\t")]
        end = outer[0] - 1 if outer else min(number + 49, len(lines))
        out.append((hit[1], number, end, "\n".join(lines[number - 1:end]), hit[2]))
    return out


def test_python_functions_agree_with_brute_force(spark):
    rng = random.Random(1)
    pool = ["def a(x):", "    def b(self, y=1):", "async  def c():", "    return 1", "", "  ",
            "x = 1", "\tdef d( z )  :", "class K:", "@deco", "def broken(", "# def e(f): 　"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 130))) for _ in range(60)]
    got = {}
    for r in ot.extract_functions_lines(frame(spark, texts)).orderBy("ord", "func_ord").collect():
        got.setdefault(r.ord, []).append((r.name, r.start_line, r.end_line, r.body, r.parameters))
    for n, text in enumerate(texts):
        assert got.get(n, []) == brute_functions(text)


def test_script_functions(spark):
    text = "export function go(a) {\n const f = async (x) => x\n let g = function () {}\nvar h = 3\n" * 20
    rows = ot.extract_functions_lines(frame(spark, [text], "javascript")).collect()
    assert [r.name for r in rows[:3]] == ["go", "f", "g"]
    assert [(r.start_line, r.end_line) for r in rows[:2]] == [(1, 50), (2, 51)]
    assert max(r.end_line for r in rows) == 81


def test_syntax_tree_functions_and_errors(spark):
    files = frame(spark, ["@d\ndef a(x, *, y=2):\n    def b(): pass\n    return b\n", "def (", "x\0"])
    rows = ot.extract_functions_ast(files).orderBy("ord", "func_ord").collect()
    assert [(r.name, r.start_line, r.end_line, r.parameters) for r in rows if r.error is None] == [
        ("a", 2, 4, "(x, *, y=2)"), ("b", 3, 3, "()")]
    assert [r.ord for r in rows if r.error] == [1, 2]


def brute_chunks(lines, size, overlap):
    """First and last line of each chunk, by definition."""
    marks = ("def ", "class ", "function ", "async ")
    spans, first = [], 0
    while True:
        past = first + size
        if past >= len(lines):
            return spans + [(first + 1, len(lines))]
        tries = [j for j in range(past, max(past - 20, first), -1)
                 if not lines[j].strip() or lines[j].strip().startswith(marks)]
        past = tries[0] if tries else past
        spans.append((first + 1, past))
        first = past - overlap


@pytest.mark.parametrize("size, overlap", [(300, 50), (40, 10)])
def test_chunks_agree_with_brute_force(spark, size, overlap):
    rng = random.Random(size)
    texts = ["\n".join(["x"] * n) for n in (1, 299, 300, 301, 350, 581)]
    pool = ["code"] * 20 + ["", "  def f():", "class A:", "async x"]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 900))) for _ in range(25)]
    got = {}
    chunks = ot.chunk_files(frame(spark, texts), size, overlap).orderBy("ord", "chunk_index")
    for r in chunks.collect():
        got.setdefault(r.ord, []).append(((r.chunk_start, r.chunk_end), r.chunk))
    for n, text in enumerate(texts):
        lines = text.split("\n")
        spans = [(1, len(lines))] if len(lines) <= size else brute_chunks(lines, size, overlap)
        assert [s for s, _ in got[n]] == spans
        assert [c for _, c in got[n]] == ["\n".join(lines[a - 1:b]) for a, b in spans]


def test_chunk_size_must_leave_progress(spark):
    with pytest.raises(ValueError):
        ot.chunk_files(frame(spark, ["x"]), 60, 50)


def test_imports(spark):
    python = frame(spark, ["import a.b as c, d\nfrom . import x\nfrom .m import y\ntry:\n  from q import z\nexcept: pass",
                           "import (", "no such word"])
    assert sorted(r.import_path for r in ot.py_imports(python).collect()) == ["a.b", "d", "m", "q"]
    script = frame(spark, ["import a, {b} from './x'; import \"y\"\nconst z = require ( '../z/index' )\nimport(`no`)"],
                   "typescript")
    assert [r.import_path for r in ot.js_imports(script).collect()] == ["./x", "y", "../z/index"]
