"""Import resolution, closure, impact, and matching of test files."""

import posixpath
import random

import pytest

from mergelight.fixed import IMPORT_EXTENSIONS, TEST_FILE_PATTERNS
from mergelight.operators import coverage as ov
from mergelight.operators import files as of
from mergelight.operators import graph as og
from mergelight.operators import text as ot


def names(spark, paths, job="j"):
    return spark.createDataFrame([(job, n, p) for n, p in enumerate(paths)],
                                 "job_id string, ord bigint, filename string")


def brute_target(imp, src, known):
    """The known file an import means, trying every spelling in order."""
    base = (posixpath.normpath(posixpath.join(posixpath.dirname(src), imp))
            if imp.startswith(".") else imp.replace(".", "/"))
    tries = [imp, base]
    for ext in IMPORT_EXTENSIONS:
        tries += [base + ext, posixpath.join(base, "__init__" + ext), posixpath.join(base, "index" + ext)]
    return next((t for t in tries if t in known), None)


def test_imports_resolve_like_trying_every_spelling(spark):
    rng = random.Random(2)
    parts = ["a", "b", "pkg", "index", "__init__", "x.y"]
    paths = {"/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice(
        IMPORT_EXTENSIONS + ["", ".md"]) for _ in range(120)} | {"a.b", "/index.js", ".py"}
    asked = [(rng.choice(sorted(paths)), imp) for _ in range(400) for imp in [rng.choice([
        ".".join(rng.choice(parts[:5]) for _ in range(rng.randint(1, 3))),
        rng.choice(["./", "../", "../../", "."]) + rng.choice(parts) + rng.choice(["", "/b", ".js"]),
        rng.choice(parts) + "/" + rng.choice(["", "index", "b"]), rng.choice(sorted(paths)), "/",
    ])]]
    imports = spark.createDataFrame([("j", s, i) for s, i in asked],
                                    "job_id string, filename string, import_path string")
    got = {(r.src, r.dst) for r in og.resolve_imports(imports, names(spark, sorted(paths))).collect()}
    want = {(s, brute_target(i, s, paths)) for s, i in asked}
    assert got == {(s, t) for s, t in want if t and t != s}


def test_impact_with_cycles_and_chains(spark):
    rng = random.Random(9)
    nodes = [f"n{i}" for i in range(40)]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)}
    pairs |= {(f"n{i}", f"n{i + 1}") for i in range(12)} | {("n5", "n4"), ("n7", "n7")}
    edges = spark.createDataFrame([("j", a, b) for a, b in pairs if a != b],
                                  "job_id string, src string, dst string")
    reach = {n: set() for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            top = stack.pop()
            for a, b in pairs:
                if b == top and a not in reach[n]:
                    reach[n].add(a)
                    stack.append(a)
        reach[n].discard(n)
    got = {(r.filename, r.dependent) for r in og.transitive_dependents(edges).collect()}
    assert got == {(n, d) for n in nodes for d in reach[n]}
    files = names(spark, nodes + ["alone"])
    scores = og.impact_scores(files, edges)
    assert {r.filename: r.impact_score for r in scores.collect()} == {
        **{n: len(reach[n]) / 41 for n in nodes}, "alone": 0.0}
    ordered = [r.filename for r in of.review_priority(files, scores).orderBy("review_ord").collect()]
    assert ordered == sorted(nodes + ["alone"], key=lambda n: -len(reach.get(n, ())))


def brute_counts(pairs):
    """Dependents per node by a search from each node against the edges."""
    back = {}
    for a, b in pairs:
        back.setdefault(b, set()).add(a)
    counts = {}
    for n in back:
        seen, stack = set(), [n]
        while stack:
            for a in back.get(stack.pop(), ()):
                if a not in seen:
                    seen.add(a)
                    stack.append(a)
        counts[n] = len(seen - {n})
    return {n: c for n, c in counts.items() if c}


def counts_of(spark, pairs):
    edges = spark.createDataFrame([("j", a, b) for a, b in pairs], "job_id string, src string, dst string")
    return {r.filename: r.dependents for r in og.dependent_counts(edges).collect()}


@pytest.mark.parametrize("pairs", [
    [(f"n{i:03}", f"n{i + 1:03}") for i in range(20)],  # a chain
    [(f"n{i:03}", f"n{(i + 1) % 20:03}") for i in range(20)],  # a cycle
    [(f"n{i:03}", "hub") for i in range(300)] + [("hub", f"m{i:03}") for i in range(100)],  # a hub
    [(f"n{i:03}", f"n{(i + 1) % 9:03}") for i in range(9)] + [("n007", "x"), ("x", "y"), ("y", "x"), ("a", "n003")],
])
def test_counts_of_chains_cycles_and_hubs(spark, pairs):
    assert counts_of(spark, pairs) == brute_counts(pairs)


@pytest.mark.parametrize("seed", [2])
def test_counts_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"f{rng.randrange(150)}", f"f{rng.randrange(150)}") for _ in range(60 * seed)})
    pairs = [(a, b) for a, b in pairs if a != b]
    assert counts_of(spark, pairs) == brute_counts(pairs)


def test_jobs_do_not_mix(spark):
    files = names(spark, ["a.py", "b.py"], "j").union(names(spark, ["a.py"], "k"))
    imports = spark.createDataFrame([("j", "a.py", "b"), ("k", "a.py", "b")],
                                    "job_id string, filename string, import_path string")
    edges = og.resolve_imports(imports, files)
    assert [(r.job_id, r.src, r.dst) for r in edges.collect()] == [("j", "a.py", "b.py")]
    stats = {r.job_id: (r.nodes, r.edges) for r in og.graph_stats(files, edges).collect()}
    assert stats == {"j": (2, 1), "k": (1, 0)}


def brute_test_file(source, language, paths):
    stem, folder = posixpath.splitext(posixpath.basename(source))[0], posixpath.dirname(source)
    filled = {p.replace("{name}", stem).replace("{dir}", folder) for p in TEST_FILE_PATTERNS[language]}
    filled |= {posixpath.normpath(p) for p in filled}
    for path in paths:
        if path in filled or posixpath.normpath(path) in filled:
            return path
    return next((p for p in paths if "test_" + stem in p or stem + "_test" in p), None)


@pytest.mark.parametrize("seed", [1, 2])
def test_test_files_match_like_a_linear_search(spark, seed):
    rng = random.Random(seed)
    stems = ["news", "latest_news", "a", "ab", "index", "test", ".env"]
    shapes = ["{s}.py", "src/{s}.py", "src/{s}.js", "lib/x/{s}.ts", "tests/test_{s}.py", "./tests/test_{s}.py",
              "src/tests/test_{s}.py", "{s}.test.js", "__tests__/{s}.test.ts", "qa/{s}_test_old.md",
              "qa/test_{s}more.py", "lib/x/__tests__/{s}.test.ts", "{s}.spec.js", "src/../tests/{s}_test.py"]
    paths = list(dict.fromkeys(rng.choice(shapes).format(s=rng.choice(stems)) for _ in range(70)))
    kinds = {".py": "python", ".js": "javascript", ".ts": "typescript"}
    rows = [("j", n, p, kinds.get(posixpath.splitext(p)[1]), "x") for n, p in enumerate(paths)]
    files = spark.createDataFrame(
        rows, "job_id string, ord bigint, filename string, language string, content string")
    got = {r.filename: paths[r.test_ord] for r in ov.match_test_files(files).collect()}
    sources = [r.filename for r in ov.source_names(ov.file_names(files)).collect()]
    want = {s: brute_test_file(s, kinds[posixpath.splitext(s)[1]], paths) for s in sources}
    assert got == {s: t for s, t in want.items() if t}


def test_coverage_findings(spark):
    source = "def load(a):\n    pass\ndef Save(b):\n    pass\n" + "".join(
        f"def f{n}():\n    pass\n" for n in range(7))
    rows = [("j", 0, "src/m.py", "python", source), ("j", 1, "tests/test_m.py", "python", "testLoad f1 f2 f3 f4"),
            ("j", 2, "src/n.py", "python", "def only(): pass"), ("j", 3, "tests/test_n.py", "python", ""),
            ("k", 0, "a.js", "javascript", "function go() {}")]
    files = spark.createDataFrame(
        rows, "job_id string, ord bigint, filename string, language string, content string")
    got = ov.coverage_findings(files).orderBy("seq").collect()
    titles = {}
    for r in got:
        titles.setdefault((r.job_id, r.file_path), []).append(r.title)
    assert titles == {
        ("j", "src/m.py"): [f"No test for {n}()" for n in ("Save", "f0", "f5", "f6")],
        ("j", "src/n.py"): ["No test for only()"], ("k", "a.js"): ["No test for go()"],
    }
    assert {(r.severity, r.category, r.confidence) for r in got} == {("MEDIUM", "missing-test", 0.8)}
    missing = ov.functions_without_test_file(files, ot.extract_functions_lines(files))
    assert missing.count() == 2
