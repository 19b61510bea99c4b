"""Unified diffs: line-to-position maps, nearest position, comments, added code.

A diff that is a row is taken apart inside it by array functions, so parsing needs no shuffle; one
that is too long for a row comes as lines in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.text import let, split_lines, strip
from mergelight.operators.ranking import nearest_line

HEADER = "diff --git"
VALID_HEADER = r"diff --git[^\n]*?b/[^\n]"
ADDED_BLOCK = r"(?md)(?:^\+\+?(?:[^+\n][^\n]*)?(?:\n|\z))++"
ENTRY = "array<struct<line:bigint,position:int>>"


def _hunk_start(line: Column) -> Column:
    """First new line number of a hunk header, null for other lines."""
    number = F.regexp_extract(line, r"\+(\d+)", 1).try_cast("bigint")
    return F.when(line.startswith("@@"), number)


def _sections(diff: Column, parity: bool) -> Column:
    """Array of file sections: name, then the steps that move line or position.

    A step is a line that advances the new file, or a hunk header (``start`` set).
    """
    pieces = F.split(diff, rf"\n(?={VALID_HEADER})", -1)

    def section(piece: Column) -> Column:
        named = piece.rlike(r"\A" + VALID_HEADER)

        def from_lines(lines: Column) -> Column:
            pattern = r"(?s)b/(.+)\z" if parity else r"(?s).* b/(.+)\z"
            name = F.when(named, F.regexp_extract(lines[0], pattern, 1))
            body = F.when(named, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
            if parity:
                counted = F.filter(
                    body,
                    lambda x: ~x.startswith(HEADER)
                    & (
                        x.startswith("@@")
                        | (named & ~x.startswith("---") & ~x.startswith("+++"))
                    ),
                )
                first = 1
            else:
                opened = F.array_position(F.transform(body, lambda x: x.startswith("@@")), True)
                hunks = F.when(
                    named & (opened > 0),
                    F.slice(body, F.greatest(opened, F.lit(1)).cast("int"), F.size(body)),
                ).otherwise(F.array().cast("array<string>"))
                counted = F.filter(hunks, lambda x: ~x.startswith("\\") & (x != ""))
                first = 0
            numbered = F.transform(
                counted,
                lambda x, i: F.struct(
                    (i + first).alias("position"),
                    _hunk_start(x).alias("start"),
                    (x.startswith("-") | x.startswith("@@")).alias("still"),
                ),
            )
            steps = F.filter(numbered, lambda s: ~s["still"] | s["start"].isNotNull())
            return F.struct(name.alias("file"), steps.alias("steps"))

        return let(split_lines(piece), from_lines)

    return F.transform(pieces, section)


def _marks(steps: Column) -> Column:
    """Index and start of each hunk header, led by a mark for what comes before."""
    indexed = F.transform(
        steps, lambda s, k: F.struct(k.alias("at"), s["start"].alias("start"))
    )
    lead = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("start")))
    return F.concat(lead, F.filter(indexed, lambda m: m["start"].isNotNull()))


def _with_entry_line(sections: Column) -> Column:
    """Running line number on entry of each section (it carries over between files)."""
    begin = F.struct(
        F.lit(0).cast("bigint").alias("line"), F.array().cast("array<bigint>").alias("entered")
    )

    def step(acc: Column, section: Column) -> Column:
        n = F.size(section["steps"])
        last = F.element_at(section["marks"], -1)
        after = F.when(
            last["start"].isNotNull(), last["start"] - 1 + (n - 1 - last["at"])
        ).otherwise(acc["line"] + n)
        return F.struct(
            after.cast("bigint").alias("line"),
            F.concat(acc["entered"], F.array(acc["line"])).alias("entered"),
        )

    return F.aggregate(sections, begin, step, lambda acc: acc["entered"])


def _entries(section: Column, entered: Column) -> Column:
    """(line, position) of every step of a section, in order."""
    n = F.size(section["steps"])

    def hunk(mark: Column, i: Column) -> Column:
        until = F.coalesce(F.get(section["marks"], i + 1)["at"], n)
        base = F.coalesce(mark["start"] - 1, entered)
        part = F.slice(section["steps"], mark["at"] + 2, until - mark["at"] - 1)
        return F.transform(
            part,
            lambda s, k: F.struct(
                (base + k + 1).cast("bigint").alias("line"),
                s["position"].cast("int").alias("position"),
            ),
        )

    return F.flatten(F.transform(section["marks"], hunk))


def _last_write_wins(file: Column, entries: Column) -> Column:
    """One record per line: the last position, and the first one as insertion order."""

    def records(e: Column) -> Column:
        last = F.filter(e, lambda x, i: ~x["line"].eqNullSafe(F.get(e, i + 1)["line"]))
        first = F.filter(
            e, lambda x, i: (i == 0) | (x["line"] != F.get(e, F.greatest(i - 1, F.lit(0)))["line"])
        )
        return F.zip_with(
            last, first,
            lambda a, b: F.struct(
                file.alias("file"), a["line"].alias("line"), a["position"].alias("position"),
                b["position"].alias("ins_order"),
            ),
        )

    return let(F.array_sort(entries), records)


def diff_positions(diff: Column, parity: bool = True) -> Column:
    """Array of (file, line, position, ins_order) of one diff text.

    ``parity`` keeps the known quirks: the name starts at the leftmost ``b/``, header lines
    count as context, and line numbers run on into the next file.  Without it only hunk
    bodies count.
    """
    begun = F.transform(
        _sections(diff, parity),
        lambda s: F.struct(
            s["file"].alias("file"), s["steps"].alias("steps"), _marks(s["steps"]).alias("marks")
        ),
    )

    def positions(sections: Column) -> Column:
        names = F.transform(sections, lambda s: F.coalesce(s["file"], F.lit("")))
        return let(names, lambda n: let(_with_entry_line(sections), lambda e: collected(
            sections, n, e
        )))

    def collected(sections: Column, names: Column, entered: Column) -> Column:
        def one(section: Column, i: Column) -> Column:
            repeated = F.array_contains(
                F.slice(names, i + 2, F.size(names)), F.coalesce(section["file"], F.lit(""))
            )
            keep = section["file"].isNotNull() & ~repeated
            found = _last_write_wins(section["file"], _entries(section, F.get(entered, i)))
            empty = F.array().cast(
                "array<struct<file:string,line:bigint,position:int,ins_order:int>>"
            )
            return F.when(keep, found).otherwise(empty)

        return F.flatten(F.transform(sections, one))

    return let(begun, positions)


def diff_files(diff: Column, parity: bool = True) -> Column:
    """Distinct file names that the headers of a diff name."""
    return F.array_distinct(
        F.array_compact(F.transform(_sections(diff, parity), lambda s: s["file"]))
    )


def parse_diff(diffs: DataFrame, key: str = "job_id", parity: bool = True) -> DataFrame:
    """Flat position map: key, file, line, position, ins_order."""
    return diffs.select(key, F.inline(diff_positions(F.col("diff"), parity)))


DIFF, BLOCK_ORDER = "job_id", ["job_id", "block"]


def _carried(per_block: DataFrame, keys: list[str], value: Column, output: str) -> DataFrame:
    """Sum of a value over the earlier blocks of a key; the table has one row per key and block."""
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(*keys, "block", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(output))


def _numbered_sections(lines: DataFrame) -> DataFrame:
    """Add ``section``: how many file headers came up to a line."""
    header = F.col("value").rlike(r"\A" + VALID_HEADER)
    marked = lines.withColumn("header", header.cast("int"))
    inside = Window.partitionBy(*BLOCK_ORDER).orderBy("at")
    counted = marked.withColumn("_own", F.sum("header").over(inside))
    totals = marked.groupBy(*BLOCK_ORDER).agg(F.sum("header").alias("n"))
    before = _carried(totals, [DIFF], F.col("n"), "_before")
    return counted.join(before, BLOCK_ORDER).withColumn(
        "section", (F.col("_own") + F.col("_before")).cast("bigint")
    ).drop("_own", "_before")


def _counted(lines: DataFrame, parity: bool) -> DataFrame:
    """Lines of sections that have a position, with it (1 for the first, 0 without ``parity``)."""
    value, named = F.col("value"), F.col("section") > 0
    hunk = value.startswith("@@")
    if parity:
        kept = lines.filter(
            ~value.startswith(HEADER) & (hunk | (named & ~value.startswith("---") & ~value.startswith("+++")))
        )
        first = 1
    else:
        opened = lines.filter(hunk & named).groupBy(DIFF, "section").agg(
            F.min(F.struct("block", "at")).alias("opened")
        )
        body = lines.filter(named & (F.col("header") == 0)).join(opened, [DIFF, "section"])
        kept = body.filter(
            (F.struct("block", "at") >= F.col("opened")) & ~value.startswith("\\") & (value != "")
        ).drop("opened")
        first = 0
    inside = Window.partitionBy(*BLOCK_ORDER, "section").orderBy("at")
    placed = kept.withColumn("_own", F.row_number().over(inside))
    totals = kept.groupBy(*BLOCK_ORDER, "section").agg(F.count(F.lit(1)).alias("n"))
    before = _carried(totals, [DIFF, "section"], F.col("n"), "_before")
    return placed.join(before, [*BLOCK_ORDER, "section"]).withColumn(
        "position", (F.col("_own") + F.col("_before") + (first - 1)).cast("int")
    ).drop("_own", "_before")


def _steps(counted: DataFrame) -> DataFrame:
    """Lines that advance the new file, with its line number.

    The number is that of the last hunk header and the steps since, in whatever block it was; a
    block is summed up by its steps and, if it has a header, by the number at its end.
    """
    value = F.col("value")
    start = _hunk_start(value)
    still = value.startswith("-") | value.startswith("@@")
    moves = counted.withColumn("start", start).filter(~still | F.col("start").isNotNull())
    step = F.when(F.col("start").isNull(), 1).otherwise(0)
    moves = moves.withColumn("step", step)
    inside = Window.partitionBy(*BLOCK_ORDER).orderBy("at")
    run = moves.withColumn("_steps", F.sum("step").over(inside))
    header = F.when(F.col("start").isNotNull(), F.struct("start", F.col("_steps").alias("steps")))
    run = run.withColumn("_at_start", F.last(header, True).over(inside))
    number = F.col("_at_start.start") - 1 + F.col("_steps") - F.col("_at_start.steps")
    own = run.withColumn("_line", number)
    blocks = own.groupBy(*BLOCK_ORDER).agg(
        F.max("_steps").alias("steps"), F.max_by("_line", "at").alias("end"),
    )
    until = Window.partitionBy(DIFF).orderBy("block")
    summed = blocks.withColumn("total", F.sum("steps").over(until))
    fixed_end = F.last(F.col("end") - F.col("total"), True).over(until.rowsBetween(Window.unboundedPreceding, -1))
    entry = summed.select(
        *BLOCK_ORDER, (F.coalesce(fixed_end, F.lit(0)) + F.col("total") - F.col("steps")).alias("_entry")
    )
    line = F.coalesce("_line", F.col("_entry") + F.col("_steps"))
    return own.join(entry, BLOCK_ORDER).filter(F.col("step") == 1).withColumn("line", line.cast("bigint"))


def parse_diff_lines(lines: DataFrame, parity: bool = True) -> DataFrame:
    """Flat position map of diffs that come as lines: (job_id, block, at, value).

    Lines are in order by ``block`` and ``at``.  What a line depends on - its section, position
    and line number - is kept per block and carried over a table with a row for each
    block (and section), so a diff of any length is as many tasks as it has blocks.  Gives what
    ``parse_diff`` gives for the joined text, but for the order of the rows.
    """
    sections = _numbered_sections(lines)
    pattern = r"(?s)b/(.+)\z" if parity else r"(?s).* b/(.+)\z"
    names = sections.filter("header = 1").groupBy(DIFF, F.regexp_extract("value", pattern, 1).alias("file")).agg(
        F.max("section").alias("section")  # of files named twice the last one counts
    )
    steps = _steps(_counted(sections.filter("header = 0") if parity else sections, parity))
    return (
        steps.groupBy(DIFF, "section", "line")
        .agg(F.max("position").alias("position"), F.min("position").alias("ins_order"))
        .join(names, [DIFF, "section"])
        .select(DIFF, "file", "line", "position", "ins_order")
    )


def nearest_diff_position(probes: DataFrame, positions: DataFrame, key: str = "job_id") -> DataFrame:
    """Probes (key, file, line) with the position of the nearest mapped line, or null."""
    nearest = nearest_line(probes, positions, [key, "file"], "line", "position", "ins_order")
    return probes.join(nearest, [key, "file", "line"], "left")


def map_comments(comments: DataFrame, positions: DataFrame) -> DataFrame:
    """Comments (job_id, path, line, body) with their diff position; null means unmapped."""
    probes = comments.select("job_id", F.col("path").alias("file"), "line").distinct()
    nearest = nearest_line(probes, positions, ["job_id", "file"], "line", "position", "ins_order")
    return comments.join(
        nearest.withColumnRenamed("file", "path"), ["job_id", "path", "line"], "left"
    )


def added_blocks(diff: Column) -> Column:
    """Array of runs of added lines, cleaned, without runs of up to 20 characters."""
    runs = F.regexp_extract_all(diff, F.lit(ADDED_BLOCK), 0)
    texts = F.transform(runs, lambda r: strip(F.regexp_replace(r, r"(?md)^\+", "")))
    long_enough = F.filter(texts, lambda t: F.length(t) > fixed.MIN_SAMPLE_CHARS)
    return F.transform(long_enough, lambda t: F.substring(t, 1, fixed.MAX_SAMPLE_CHARS))
