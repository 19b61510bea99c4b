"""Text, path and JSON expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergelight.fixed import WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name inside ``body``.

    A lambda that mentions an outer expression evaluates it for every element; binding
    it as a lambda variable keeps array work linear.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove white space of every kind on both sides (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """Lines by line feed; a trailing empty line and carriage returns are kept."""
    return F.split(text, "\n", -1)


def words(text: Column) -> Column:
    """Distinct lower-case words, split at any white space."""
    spaced = F.translate(F.lower(text), WHITESPACE, " " * len(WHITESPACE))
    return F.array_distinct(F.filter(F.split(spaced, " "), lambda w: w != ""))


def contains_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def starts_with_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.startswith(part)
    return found


def lookup(key: Column, mapping: dict[str, str]) -> Column:
    """Value of a constant map, null when the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; trailing slashes go unless nothing else is left."""
    head = F.regexp_extract(path, r"(?s)\A(.*/)?[^/]*\z", 1)
    return F.when(head.rlike(r"\A/+\z"), head).otherwise(F.regexp_replace(head, r"/+\z", ""))


def stem(path: Column) -> Column:
    """Base name without its last extension; leading dots do not start an extension."""
    return F.regexp_replace(basename(path), r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")


def normalize_path(path: Column) -> Column:
    """Collapse ``.``, ``..`` and repeated slashes; an empty path becomes ``.``."""
    absolute = path.startswith("/")
    double = path.startswith("//") & ~path.startswith("///")
    prefix = F.when(double, "//").when(absolute, "/").otherwise("")
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        can_pop = (F.size(acc) > 0) & (last != "..")
        popped = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        at_root = absolute & (F.size(acc) == 0)
        return (
            F.when(part != "..", F.concat(acc, F.array(part)))
            .when(can_pop, popped)
            .when(at_root, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    joined = F.concat(prefix, F.array_join(F.aggregate(parts, empty, step), "/"))
    return F.when(joined == "", ".").otherwise(joined)


def join_path(directory: Column, name: Column) -> Column:
    """Directory and relative name with one slash between them."""
    return (
        F.when(name.startswith("/") | (directory == ""), name)
        .when(directory.endswith("/"), F.concat(directory, name))
        .otherwise(F.concat(directory, F.lit("/"), name))
    )


def capitalize(name: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 2**31 - 1)))


def escape_html(text: Column) -> Column:
    escaped = F.coalesce(text, F.lit(""))
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    return escaped


def time_ago(moment: Column, now: Column) -> Column:
    """Age as text: just now, minutes, hours or days."""
    micros = [F.unix_micros(t.cast("timestamp")) for t in (now, moment)]
    seconds = (micros[0] - micros[1]) / F.lit(1e6)

    def age(unit: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(suffix))

    return (
        F.when(moment.isNull(), "-")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, age(60, "m ago"))
        .when(seconds < 86400, age(3600, "h ago"))
        .otherwise(age(86400, "d ago"))
    )


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded by the exact binary value and half to even.

    ``format_string`` rounds halves up.  The distance to the nearest half of a tenth is
    compared in whole numbers: value = m / 2**e and half = k / 20.  Not for negatives.
    """
    k = F.rint(value * 20).cast("bigint")
    e = F.lit(53) - F.floor(F.log2(value)).cast("int")
    m = (value * F.pow(F.lit(2.0), e)).cast("bigint")
    side = F.signum(m * 20 - F.call_function("shiftleft", k, e))
    lower = F.floor((k - 1) / 2).cast("bigint")
    half = F.when(side > 0, lower + 1).when(side < 0, lower).otherwise(lower + lower % 2)
    tenths = F.when(value < 0.01, F.lit(0).cast("bigint")).when(k % 2 == 0, k / 2).otherwise(half)
    whole = tenths.cast("bigint")
    return F.concat(
        F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string")
    )


def json_field(body: Column, path: str, default: str | int) -> Column:
    """A field of a JSON text, with a default; the type follows the default."""
    raw = F.get_json_object(body, path)
    if isinstance(default, int):
        return F.coalesce(raw.try_cast("bigint"), F.lit(default).cast("bigint"))
    return F.coalesce(raw, F.lit(default))
