"""Row-to-rows operators over source text.

All of them work inside the row (array functions after a split), so text is read,
taken apart and dropped in the scan stage: no shuffle carries file content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelight import fixed
from mergelight.functions.files import has_content
from mergelight.functions.findings import RULE_HITS, finding_order
from mergelight.functions.text import contains_any, let, split_lines, starts_with_any, strip
from mergelight.operators.findings import with_finding_defaults
from mergelight.workers import UNREADABLE, import_targets, python_functions

Rule = tuple[int, str, str, str, str]

# Any text that a built-in rule hits contains one of these once it is in lower case, ...
RULE_HINTS = [
    "password", "secret", "api_key", "token", "private_key", "subprocess.", "os.system", "eval",
    "exec", "md5", "sha1", "pickle.load", "yaml.load", "random.", "innerhtml", "document.write",
]
# ... or has a letter that equals s or i only when case is ignored.
FOLDED_LETTERS = ["\u017f", "\u0130", "\u0131"]


def may_hit_rules(text: Column) -> Column:
    """Cheap substring test that no text with a rule hit fails."""
    hinted = let(F.lower(text), lambda lowered: contains_any(lowered, RULE_HINTS))
    return hinted | contains_any(text, FOLDED_LETTERS)


def java_rule(pattern: str) -> str:
    """Ignore case, let a dot match all but a line feed, and use Unicode white space."""
    return "(?isU)" + pattern


def explode_lines(table: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per line, numbered from 1."""
    pairs = F.posexplode(split_lines(F.col(text))).alias("pos", "line")
    return table.select(*keys, pairs).select(
        *keys, (F.col("pos") + 1).cast("bigint").alias("line_number"), "line"
    )


def rules_for(parity: bool) -> list[Rule]:
    if parity:
        return [r for r in fixed.SECURITY_RULES if r[0] not in fixed.RULES_THAT_NEVER_FIRE]
    return fixed.SECURITY_RULES


def matching_rules(
    table: DataFrame, keys: list[str], text: str = "content",
    rules: list[Rule] | None = None, parity: bool = True,
) -> DataFrame:
    """Every (line, rule) hit: keys, line_number, line, rule_no, title, severity, category.

    Patterns are literals, so each compiles once.  With the built-in rules a cheap hint
    drops files, then lines, that cannot match before the rules themselves run.
    """
    source = table.select(*keys, text)
    if rules is None:
        source = source.filter(may_hit_rules(F.col(text)))
    lines = explode_lines(source, text, keys)
    if rules is None:
        lines = lines.filter(may_hit_rules(F.col("line")))
    hits = [
        F.when(
            F.col("line").rlike(java_rule(pattern)),
            F.struct(
                F.lit(number).alias("rule_no"), F.lit(title).alias("title"),
                F.lit(severity).alias("severity"), F.lit(category).alias("category"),
            ),
        )
        for number, pattern, title, severity, category in (rules or rules_for(parity))
    ]
    exploded = lines.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return exploded.select(*keys, "line_number", "line", "hit.*")


def scan_security_rules(
    files: DataFrame, rules: list[Rule] | None = None, parity: bool = True,
    agent: str = "SecurityScanner", agent_ord: int = 1,
) -> DataFrame:
    """Findings table of all rule hits in the ``content`` of ``files``."""
    hits = matching_rules(files, ["job_id", "ord", "filename"], rules=rules, parity=parity)
    line = strip(F.col("line"))
    found = hits.select(
        "job_id",
        finding_order(
            agent_ord, F.col("ord"), RULE_HITS, F.col("line_number"), F.col("rule_no")
        ).alias("seq"),
        F.lit(agent).alias("agent"),
        F.col("filename").alias("file_path"),
        "line_number",
        "severity",
        "category",
        "title",
        F.concat(
            F.lit("Pattern detected on line "), F.col("line_number").cast("string"),
            F.lit(": "), F.substring(line, 1, 100),
        ).alias("description"),
        F.lit(fixed.RULE_SUGGESTION).alias("suggestion"),
        F.substring(line, 1, 200).alias("code_snippet"),
        F.lit(fixed.RULE_CONFIDENCE).alias("confidence"),
    )
    return with_finding_defaults(found, agent)


# --- functions ---------------------------------------------------------------


def _python_functions(lines: Column) -> Column:
    """(index, name, parameters, end) per ``def`` line, walking the lines backwards."""
    pattern = "(?dU)" + fixed.PY_DEF
    numbered = F.reverse(
        F.transform(lines, lambda text, i: F.struct(text.alias("text"), i.alias("i")))
    )
    start = F.struct(
        F.lit(None).cast("int").alias("top"),
        F.size(lines).alias("n"),
        F.array().cast("array<struct<i:int,name:string,parameters:string,end:int>>").alias("out"),
    )

    def step(acc: Column, line: Column) -> Column:
        text, i = line["text"], line["i"]
        entry = F.struct(
            i.alias("i"),
            F.regexp_extract(text, pattern, 2).alias("name"),
            F.regexp_extract(text, pattern, 3).alias("parameters"),
            F.coalesce(acc["top"], F.least(i + 50, acc["n"])).alias("end"),
        )
        outermost = ~starts_with_any(text, [" ", "\t"]) & (strip(text) != "")
        return F.struct(
            F.when(outermost, i).otherwise(acc["top"]).alias("top"),
            acc["n"].alias("n"),
            F.when(text.rlike(pattern), F.concat(F.array(entry), acc["out"]))
            .otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(numbered, start, step, lambda acc: acc["out"])


def _script_functions(lines: Column) -> Column:
    """(index, name, parameters, end) per function-like line of JavaScript or TypeScript."""
    pattern = "(?dU)" + fixed.JS_FUNCTION
    numbered = F.transform(
        lines,
        lambda text, i: F.when(
            text.rlike(pattern),
            F.struct(
                i.alias("i"),
                F.concat(
                    F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
                ).alias("name"),
                F.lit("").alias("parameters"),
                (i + 50).alias("end"),
            ),
        ),
    )
    return let(
        F.size(lines),
        lambda n: F.transform(
            F.array_compact(numbered),
            lambda f: F.struct(
                f["i"].alias("i"), f["name"].alias("name"), f["parameters"].alias("parameters"),
                F.least(f["end"], n).alias("end"),
            ),
        ),
    )


def functions_of(content: Column, language: Column, with_body: bool = True) -> Column:
    """Array of function records found line by line."""

    def records(lines: Column) -> Column:
        found = F.when(language == "python", _python_functions(lines)).otherwise(
            _script_functions(lines)
        )

        def record(f: Column, k: Column) -> Column:
            body = F.array_join(F.slice(lines, f["i"] + 1, f["end"] - f["i"]), "\n")
            return F.struct(
                k.cast("bigint").alias("func_ord"),
                f["name"].alias("name"),
                (f["i"] + 1).cast("bigint").alias("start_line"),
                f["end"].cast("bigint").alias("end_line"),
                (body if with_body else F.lit(None).cast("string")).alias("body"),
                f["parameters"].alias("parameters"),
            )

        return F.transform(found, record)

    return let(split_lines(content), records)


def extract_functions_lines(files: DataFrame, with_body: bool = True) -> DataFrame:
    """Functions found by pattern, line by line: no parser, no Python worker, no shuffle."""
    found = functions_of(F.col("content"), F.coalesce("language", F.lit("python")), with_body)
    return files.select("job_id", "ord", "filename", F.inline(found))


AST_FUNCTIONS = (
    "job_id STRING, ord BIGINT, filename STRING, func_ord BIGINT, name STRING, "
    "start_line BIGINT, end_line BIGINT, body STRING, parameters STRING, error STRING"
)


def extract_functions_ast(files: DataFrame) -> DataFrame:
    """Functions of Python files by syntax tree; a file that fails yields one error row."""

    columns = [field.split()[0] for field in AST_FUNCTIONS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch.itertuples(index=False):
                head = (key.job_id, key.ord, key.filename)
                try:
                    functions = python_functions(key.content)
                except UNREADABLE as problem:
                    rows.append((*head, None, None, None, None, None, None,
                                 f"{type(problem).__name__}: {problem}"))
                    continue
                rows.extend((*head, n, *f, None) for n, f in enumerate(functions))
            yield pd.DataFrame(rows, columns=columns)

    python_files = files.filter((F.col("language") == "python") & F.col("content").isNotNull())
    return python_files.select("job_id", "ord", "filename", "content").mapInPandas(
        parse, AST_FUNCTIONS
    )


# --- chunks ------------------------------------------------------------------


def chunks_of(content: Column, max_lines: int = 300, overlap: int = 50) -> Column:
    """Array of overlapping chunks that try not to cut inside a function."""
    reach = 20
    advance = max_lines - reach + 1 - overlap
    if advance < 1:
        raise ValueError("max_lines must exceed overlap by at least 20")

    def is_boundary(line: Column) -> Column:
        text = strip(line)
        return (text == "") | starts_with_any(text, fixed.CHUNK_BOUNDARY_STARTS)

    def bounds(flags: Column, n: Column) -> Column:
        begin = F.struct(
            F.lit(0).alias("start"), F.lit(False).alias("done"),
            F.array().cast("array<struct<first:int,past:int>>").alias("bounds"),
        )

        def step(acc: Column, _: Column) -> Column:
            far = F.least(acc["start"] + max_lines, n)
            lowest = F.greatest(far - reach, acc["start"]) + 1
            cuts = F.filter(
                F.sequence(far, lowest, F.lit(-1)), lambda j: F.get(flags, j)
            )
            end = F.when(far < n, F.coalesce(F.get(cuts, F.lit(0)), far)).otherwise(far)
            following = let(
                end,
                lambda e: F.struct(
                    (e - overlap).alias("start"),
                    (e >= n).alias("done"),
                    F.concat(
                        acc["bounds"],
                        F.array(F.struct(acc["start"].alias("first"), e.alias("past"))),
                    ).alias("bounds"),
                ),
            )
            return F.when(acc["done"], acc).otherwise(following)

        steps = F.sequence(F.lit(0), F.floor(n / advance).cast("int") + 1)
        return F.aggregate(steps, begin, step, lambda acc: acc["bounds"])

    def split_up(lines: Column) -> Column:
        n = F.size(lines)
        whole = F.array(F.struct(F.lit(0).alias("first"), n.alias("past")))
        cut = let(
            F.transform(lines, is_boundary), lambda flags: let(n, lambda m: bounds(flags, m))
        )
        return F.transform(
            F.when(n <= max_lines, whole).otherwise(cut),
            lambda b, k: F.struct(
                k.cast("int").alias("chunk_index"),
                (b["first"] + 1).cast("int").alias("chunk_start"),
                b["past"].cast("int").alias("chunk_end"),
                F.array_join(F.slice(lines, b["first"] + 1, b["past"] - b["first"]), "\n")
                .alias("chunk"),
            ),
        )

    return let(split_lines(content), split_up)


def chunk_files(files: DataFrame, max_lines: int = 300, overlap: int = 50) -> DataFrame:
    """Overlapping line chunks of every file, with first and last line number."""
    keys = [c for c in ("job_id", "ord", "filename", "language") if c in files.columns]
    return files.select(*keys, F.inline(chunks_of(F.col("content"), max_lines, overlap)))


# --- imports -----------------------------------------------------------------


def _script_targets(content: Column) -> Column:
    """Targets of ``import ... from`` / ``import`` statements, then of ``require`` calls."""
    return F.concat(
        F.regexp_extract_all(content, F.lit("(?dU)" + fixed.ES6_IMPORT), 1),
        F.regexp_extract_all(content, F.lit("(?dU)" + fixed.REQUIRE_CALL), 1),
    )


def js_imports(files: DataFrame) -> DataFrame:
    """Import targets of script files, in text order."""
    scripts = files.filter(F.col("language").isin("javascript", "typescript"))
    return scripts.select(
        "job_id", "filename", F.explode(_script_targets(F.col("content"))).alias("import_path")
    )


_syntax_tree_targets = F.pandas_udf(import_targets, T.ArrayType(T.StringType()))


def imports_of(content: Column, language: Column) -> Column:
    """Array of import targets of one file, null where there can be none.

    Only Python text with the word ``import`` travels to a Python worker; the other
    columns of the row stay in the JVM.
    """
    is_script = language.isin("javascript", "typescript")
    wanted = F.when((language == "python") & content.contains("import"), content)
    return F.when(is_script, _script_targets(content)).otherwise(_syntax_tree_targets(wanted))


def py_imports(files: DataFrame) -> DataFrame:
    """Import targets of Python files by syntax tree."""
    python_files = files.filter(F.col("language") == "python")
    targets = imports_of(F.col("content"), F.lit("python"))
    return python_files.select("job_id", "filename", F.explode(targets).alias("import_path"))


def py_imports_lines(files: DataFrame) -> DataFrame:
    """Import targets by line patterns: a way without Python workers for plain code.

    Exact for one statement per line outside of strings; ``py_imports`` is exact always.
    """
    plain = F.regexp_extract_all(
        "content", F.lit(r"(?md)^[ \t]*import[ \t]+([A-Za-z_][\w.]*)"), 1
    )
    origin = F.regexp_extract_all(
        "content", F.lit(r"(?md)^[ \t]*from[ \t]+\.*([A-Za-z_][\w.]*)[ \t]+import\b"), 1
    )
    python_files = files.filter(F.col("language") == "python")
    return python_files.select(
        "job_id", "filename", F.explode(F.concat(plain, origin)).alias("import_path")
    )


# --- one pass ----------------------------------------------------------------


def file_facts(files: DataFrame) -> DataFrame:
    """Everything later steps need from the text of a file, read in one pass.

    job_id, ord, filename, language, has_content, functions (without bodies) and imports:
    a narrow table, so that file content itself is never shuffled or stored again.
    """
    content, language = F.col("content"), F.col("language")
    return files.select(
        "job_id", "ord", "filename", "language", has_content(content).alias("has_content"),
        functions_of(content, language, with_body=False).alias("functions"),
        imports_of(content, language).alias("imports"),
    )
