"""Model prompts, model responses and the findings in them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.files import file_purpose
from mergelight.functions.findings import (
    MODEL_ITEMS,
    finding_order,
    passes_confidence,
    severity_at_most_medium,
)
from mergelight.functions.text import strip
from mergelight.operators.findings import with_finding_defaults
from mergelight.operators.text import chunks_of, functions_of
from mergelight.session import by_merge

FENCE = "```"
TEXT_FIELDS = ["severity", "category", "title", "description", "suggestion"]
ANSWER_SHAPE = (
    'Answer with JSON only: {"findings": [{"line": 0, "severity": "", "category": "", '
    '"title": "", "description": "", "suggestion": "", "fix_example": "", "confidence": 0.0}]}'
)


# --- prompts -----------------------------------------------------------------


def _code(content: Column, language: Column, limit: int) -> Column:
    cut = F.substring(F.coalesce(content, F.lit("")), 1, limit)
    return F.concat(F.lit(FENCE), language, F.lit("\n"), cut, F.lit(f"\n{FENCE}"))


def _bulleted(values: Column) -> Column:
    joined = F.array_join(F.coalesce(values, F.array().cast("array<string>")), "\n")
    return F.when(joined == "", "None documented").otherwise(joined)


def _function_names(functions: DataFrame) -> DataFrame:
    """(job_id, ord, names): function names of a file as a JSON list, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("func_ord", "name")))
    names = F.to_json(F.transform(ordered, lambda f: f["name"]))
    return functions.groupBy("job_id", "ord").agg(names.alias("names"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def bug_prompts(files: DataFrame) -> DataFrame:
    """One prompt per chunk: code and the names of the functions in its file.

    Names and chunks come out of the same row, so no text is shuffled to meet its names.
    """
    content, language = F.col("content"), F.coalesce("language", F.lit("python"))
    functions = functions_of(content, language, with_body=False)
    chunks = files.select(
        "job_id", "ord", "filename", language.alias("language"),
        F.to_json(F.transform(functions, lambda f: f["name"])).alias("names"),
        F.inline(chunks_of(content)),
    )
    prompt = _text(
        "Find logic errors in this ", F.col("language"), " file.\nFile: ", F.col("filename"),
        "\nFunctions: ", F.col("names"), "\n\n",
        _code(F.col("chunk"), F.col("language"), fixed.PROMPT_CHARS["bug"]), "\n\n", ANSWER_SHAPE,
    )
    return chunks.select("job_id", "ord", "filename", "chunk_index", "chunk_start",
                         prompt.alias("prompt"))


def security_prompts(files: DataFrame) -> DataFrame:
    """One prompt per security-sensitive file (the caller filters)."""
    language = F.coalesce("language", F.lit("python"))
    prompt = _text(
        "Find security weaknesses in this ", language, " file.\nFile: ", F.col("filename"),
        "\nPurpose: ", file_purpose(F.col("filename"), F.col("content")), "\n\n",
        _code(F.col("content"), language, fixed.PROMPT_CHARS["security"]), "\n\n", ANSWER_SHAPE,
    )
    return files.select("job_id", "ord", "filename", prompt.alias("prompt"))


def style_prompts(files: DataFrame) -> DataFrame:
    """One prompt per file, with the conventions of its repo (see files_with_conventions)."""
    language = F.coalesce("language", F.lit("python"))
    facts = [
        part
        for name in ("naming_style", "uses_type_hints", "uses_docstrings", "docstring_style",
                     "max_function_length", "uses_async")
        for part in (f"\n{name}: ", F.col(name).cast("string"))
    ]
    prompt = _text(
        "Find departures from the conventions of this repository in a ", language,
        " file.\nFile: ", F.col("filename"), *facts,
        "\nCommon patterns:\n", _bulleted(F.col("common_patterns")),
        "\nPatterns to avoid:\n", _bulleted(F.col("anti_patterns")), "\n\n",
        _code(F.col("content"), language, fixed.PROMPT_CHARS["style"]), "\n\n", ANSWER_SHAPE,
    )
    return files.select("job_id", "ord", "filename", prompt.alias("prompt"))


def coverage_prompts(files: DataFrame, functions: DataFrame, tests: DataFrame) -> DataFrame:
    """One prompt per source file; ``tests`` gives test_filename and test_content, if any."""
    language = F.coalesce("language", F.lit("python"))
    joined = files.join(by_merge(_function_names(functions)), ["job_id", "ord"]).join(
        by_merge(tests), ["job_id", "ord"], "left"
    )
    tested = F.coalesce(F.col("test_content") != "", F.lit(False))
    test_part = F.when(
        tested,
        _text("\nTest file: ", F.col("test_filename"), "\n",
              _code(F.col("test_content"), language, fixed.PROMPT_TEST_CHARS), "\n\n"),
    ).otherwise("\nThere is no test file.\n\n")
    prompt = _text(
        "Find code without tests in this ", language, " file.\nFile: ", F.col("filename"),
        "\nFunctions: ", F.col("names"), "\n\n",
        _code(F.col("content"), language, fixed.PROMPT_CHARS["coverage"]), test_part, ANSWER_SHAPE,
    )
    return joined.select("job_id", "ord", "filename", tested.alias("has_test_file"),
                         prompt.alias("prompt"))


def score_with_model(
    prompts: DataFrame, model: Callable[[list[str]], list[str]], text: str = "prompt",
    output: str = "response", batch_rows: int = 64, in_flight: int = fixed.CALLS_IN_FLIGHT,
) -> DataFrame:
    """Send prompts to a caller-supplied function, at most ``batch_rows`` at a time, near the data.

    A partition has ``in_flight`` calls open at most; answers come out in the order of the prompts,
    and no more prompts are held than those in flight.  ``model`` is called from several threads.

    A batch that fails, or that gets another number of answers, is halved and sent again, so
    one bad prompt among n costs about 2 log2(n) calls more.  A prompt that fails alone gives a
    null response and the problem in ``error``; all others go on.
    """
    schema = f"{prompts.drop(text)._jdf.schema().toDDL()}, {output} STRING, error STRING"

    def answers(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = list(model(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} prompts")
            return [(answer, None) for answer in found]
        except Exception as problem:  # any failure of the caller's function is a record
            if len(texts) == 1:
                return [(None, f"{type(problem).__name__}: {problem}")]
        half = len(texts) // 2
        return answers(texts[:half]) + answers(texts[half:])

    def answered(part: pd.DataFrame, call: Future) -> pd.DataFrame:
        found = call.result()
        return part.drop(columns=[text]).assign(
            **{output: [a for a, _ in found], "error": [e for _, e in found]}
        )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_calls: deque[tuple[pd.DataFrame, Future]] = deque()
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for low in range(0, len(batch), batch_rows):
                    part = batch.iloc[low : low + batch_rows]
                    if len(open_calls) >= in_flight:
                        yield answered(*open_calls.popleft())
                    open_calls.append((part, pool.submit(answers, part[text].tolist())))
            while open_calls:
                yield answered(*open_calls.popleft())

    return prompts.mapInPandas(ask, schema)


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a value in ``error``."""
    return rows.filter(F.col("error").isNull()), rows.filter(F.col("error").isNotNull())


# --- responses ---------------------------------------------------------------


def strip_fence(response: Column) -> Column:
    """Text without a Markdown fence: first line, and last line when it is a bare fence."""
    text = strip(response)
    rest = F.when(
        F.instr(text, "\n") > 0,
        F.substr(text, F.instr(text, "\n") + 1),
    ).otherwise("")
    last = F.substring_index(rest, "\n", -1)
    without_last = F.left(rest, F.greatest(F.length(rest) - F.length(last) - 1, F.lit(0)))
    unfenced = F.when(strip(last) == FENCE, without_last).otherwise(rest)
    return F.when(text.startswith(FENCE), strip(unfenced)).otherwise(text)


def parse_model_response(responses: DataFrame) -> DataFrame:
    """Add ``answer`` (variant) and ``valid``: whether the response is a JSON object."""
    cleaned = strip_fence(F.col("response"))
    parsed = responses.withColumn("cleaned", cleaned).withColumn(
        "answer", F.try_parse_json("cleaned")
    )
    is_object = F.schema_of_variant("answer").startswith("OBJECT")
    return parsed.withColumn("valid", F.coalesce(is_object, F.lit(False)))


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get(F.col("item"), f"$.{name}", kind)


def _present(name: str) -> Column:
    return F.try_variant_get(F.col("item"), f"$.{name}", "variant").isNotNull()


def response_items(parsed: DataFrame) -> DataFrame:
    """One row per entry of ``findings``, with ``item_valid``.

    Defaults later fill *missing* keys only.  An entry whose known keys hold null or a
    value of the wrong type is invalid; it is set aside alone, not with its whole file.
    """
    entries = F.try_variant_get("answer", "$.findings", "array<variant>")
    exploded = parsed.filter("valid").withColumns({"entries": entries})
    keys = [c for c in exploded.columns if c not in ("entries", "answer", "cleaned", "response", "valid")]
    items = exploded.select(*keys, F.posexplode("entries").alias("item_ord", "item"))
    checks = [
        ~_present(name) | _field(name, kind).isNotNull()
        for name, kind in [
            ("line", "bigint"), ("confidence", "double"),
            *[(f, "string") for f in TEXT_FIELDS],
        ]
    ]
    sound = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    for check in checks:
        sound = sound & check
    return items.withColumn("item_valid", sound)


def _default(name: str, kind: str) -> Column:
    value = F.lit(None).cast(kind)
    for agent, values in fixed.RESPONSE_DEFAULTS.items():
        value = F.when(F.col("agent") == agent, F.lit(values[name]).cast(kind)).otherwise(value)
    return value


def item_fields(items: DataFrame) -> DataFrame:
    """Typed fields of valid entries, defaults filled per agent."""
    valid = items.filter("item_valid")
    if "has_test_file" not in valid.columns:
        valid = valid.withColumn("has_test_file", F.lit(True))
    untested = (F.col("agent") == "TestCoverage") & ~F.coalesce("has_test_file", F.lit(True))
    alone = dict(fixed.NO_TEST_FILE_DEFAULTS)
    defaults = {name: _default(name, "string") for name in TEXT_FIELDS}
    defaults["title"] = F.when(
        untested, F.concat(F.lit(alone["title"]), F.col("file_path"))
    ).otherwise(defaults["title"])
    for name in ("description", "suggestion"):
        defaults[name] = F.when(untested, F.lit(alone[name])).otherwise(defaults[name])
    confidence = F.when(untested, F.lit(alone["confidence"])).otherwise(
        _default("confidence", "double")
    )
    snippet = F.when(F.col("agent") != "TestCoverage", _field("code_snippet", "string"))
    return valid.withColumns({
        "line_number": F.coalesce(_field("line", "bigint"), F.lit(1).cast("bigint")),
        **{name: F.coalesce(_field(name, "string"), defaults[name]) for name in TEXT_FIELDS},
        "fix_example": _field("fix_example", "string"),
        "code_snippet": snippet,
        "confidence": F.coalesce(_field("confidence", "double"), confidence),
    }).drop("item")


def confidence_filter(findings: DataFrame) -> DataFrame:
    """Drop findings below their agent's threshold."""
    return findings.filter(passes_confidence(F.col("agent"), F.col("confidence")))


def clamp_style_severity(findings: DataFrame) -> DataFrame:
    """Style findings are MEDIUM at most."""
    severity = F.when(
        F.col("agent") == "StyleAdvisor", severity_at_most_medium(F.col("severity"))
    ).otherwise(F.col("severity"))
    return findings.withColumn("severity", severity)


def response_findings(responses: DataFrame, parity: bool = True) -> DataFrame:
    """Findings in model responses (columns as in schemas.RESPONSES).

    Line numbers of later chunks are relative to the chunk; ``parity`` keeps them so,
    otherwise they are shifted to the file.
    """
    fields = item_fields(response_items(parse_model_response(responses)))
    kept = clamp_style_severity(confidence_filter(fields))
    if not parity:
        shift = F.coalesce("chunk_start", F.lit(1)) - 1
        kept = kept.withColumn("line_number", F.col("line_number") + shift)
    agent_ord = F.array_position(
        F.array(*[F.lit(a) for a in fixed.AGENTS]), F.col("agent")
    ) - 1
    order = finding_order(
        agent_ord, F.col("file_ord"), MODEL_ITEMS, F.coalesce("chunk_index", F.lit(0)), F.col("item_ord")
    )
    return with_finding_defaults(kept.withColumn("seq", order))


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Responses that are not JSON objects, and single entries that do not fit."""
    parsed = parse_model_response(responses)
    whole = parsed.filter(~F.col("valid")).select(
        "job_id", "agent", "file_path", F.lit(None).cast("int").alias("item_ord"),
        F.lit("not a JSON object").alias("problem"),
    )
    items = response_items(parsed).filter(~F.col("item_valid")).select(
        "job_id", "agent", "file_path", "item_ord", F.lit("entry does not fit").alias("problem")
    )
    return whole.unionByName(items)


def validate_findings(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split entries (item_fields rows) by schema: severity, confidence range, line >= 1."""
    sound = (
        F.col("severity").isin(fixed.SEVERITIES)
        & F.col("confidence").between(0.0, 1.0)
        & (F.col("line_number") >= 1)
        & (F.col("title") != "")
    )
    marked = items.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    return marked.filter("_sound").drop("_sound"), marked.filter(~F.col("_sound")).drop("_sound")
