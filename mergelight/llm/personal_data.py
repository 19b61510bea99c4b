"""Personal data by anchor expansion.

An Aho-Corasick automaton goes over a text once and finds anchors: at-signs and their spelt-out
forms, plus signs, digits, schemes, and words that announce an account or a secret.  From each
anchor a parser goes left and right over a fixed set of signs, one step a sign and without going
back, to the boundaries of what it may stand in, and validates it.  Anchors inside an
expanded chain of the same kind are passed over, so a text is read a bounded number of times.

Kinds of the base, whose spans are those of these patterns (leftmost, not overlapping, dropped when
invalid): email, ip (parts at most 255), card (14 to 19 digits, Luhn), phone (10 to 15 digits).

The method adds: cards that stand between other numbers; emails with letters beyond ASCII or
spelt-out signs (``name [at] host [dot] org``);
phone numbers behind ``tel:``; address: a scheme with a login, or with a numeric host; account: an
IBAN with valid check digits, or 6 to 20 digits after a cue; secret: what a cue such as ``token``
is set to, 8 signs or more with a digit.  An added span that lies within another one is left out.

Defined results: a null or empty text has no spans; spans are sorted by start, kind and end and
count code points; repeated rows and rows with any id have their spans each; other columns are
kept, one named ``spans`` is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from mergelight.llm.common import fresh_name, hex_sha256

KINDS = ("email", "ip", "card", "phone", "address", "account", "secret")
BASE = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}

DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = _ALNUM | frozenset("._%+-")
LABEL = _ALNUM | {"-"}
PHONE = DIGITS | frozenset(" ().-")
SECRET = _ALNUM | frozenset("_-+/=.")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "postgres://", "mysql://", "redis://")
AT_SIGNS = ("[at]", "(at)", "{at}")
DOT_SIGNS = ("[dot]", "(dot)", "{dot}")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key")
#: Digits in the groups of a written card number.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3))
#: Letters of scripts that are written with spaces; others would run on over whole sentences.
_LAST_LETTER = "֏"
_CUE_REACH = 24


@lru_cache(maxsize=1)
def anchors():
    """The automaton: (kind of anchor, length) for every literal."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in DIGITS:
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("spelt", AT_SIGNS), ("tel", ("tel:",)),
                        ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in {word, word.capitalize(), word.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _left(text: str, at: int, signs: frozenset, floor: int) -> int:
    while at > floor and text[at - 1] in signs:
        at -= 1
    return at


def _right(text: str, at: int, signs: frozenset) -> int:
    size = len(text)
    while at < size and text[at] in signs:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def domain_end(text: str, at: int) -> int | None:
    """End of two labels or more that begin at ``at`` and are joined by single dots."""
    end, labels = _right(text, at, LABEL), 0
    if end == at:
        return None
    while end < len(text) and text[end] == ".":
        after = _right(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return end if labels else None


def dotted_runs(text: str, at: int) -> list[tuple[int, int]]:
    """Runs of digits from ``at`` that are joined by single dots."""
    runs = [(at, _right(text, at, DIGITS))]
    while True:
        end = runs[-1][1]
        if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS):
            return runs
        runs.append((end + 1, _right(text, end + 1, DIGITS)))


def digit_chain(text: str, at: int) -> int:
    """End of digits from ``at`` with at most one space or hyphen between two of them."""
    end, size = at + 1, len(text)
    while end < size:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < size and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def phone_end(text: str, at: int) -> int | None:
    """End of a number whose plus sign is at ``at``: its last digit in a run of signs of a number."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _right(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 and text[end - 1] in DIGITS else None


def small_part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def is_card(text: str) -> bool:
    digits = only_digits(text) if len(text) < 40 else ""  # 19 digits and 18 separators at most
    return 14 <= len(digits) <= 19 and luhn(digits)


# --- what the method adds ----------------------------------------------------


def cards_within(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """Cards inside a longer chain of digits: whole runs, or runs of the usual group lengths."""
    runs = []
    while at < end:
        stop = _right(text, at, DIGITS)
        runs.append((at, stop))
        at = stop + 1
    found, i = [], 0
    while i < len(runs):
        for lengths in ((), *CARD_GROUPS):
            group = runs[i : i + max(len(lengths), 1)]
            start, stop = group[0][0], group[-1][1]
            if lengths and tuple(b - a for a, b in group) != lengths:
                continue
            if is_card(text[start:stop]):
                found.append((start, stop))
                i += len(group) - 1
                break
        i += 1
    return found


def _letter(sign: str) -> bool:
    return sign <= _LAST_LETTER and sign.isalnum()


def wide_email(text: str, at: int) -> tuple[int, int] | None:
    """An address around the at-sign at ``at`` whose letters may lie beyond ASCII."""
    start = at
    while start and (text[start - 1] in LOCAL or _letter(text[start - 1])):
        start -= 1
    while start < at and text[start] in ".-":
        start += 1
    labels, end = [], at + 1
    while True:
        stop = end
        while stop < len(text) and (text[stop] == "-" or _letter(text[stop])):
            stop += 1
        if stop == end:
            break
        labels.append((end, stop))
        if stop + 1 >= len(text) or text[stop] != ".":
            break
        end = stop + 1
    if start == at or len(labels) < 2 or labels[-1][1] - labels[-1][0] < 2:
        return None
    return start, labels[-1][1]


def spelt_email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """name [at] host [dot] org: the sign is at ``at`` and ends before ``after``."""
    end = at - (at > 0 and text[at - 1] == " ")
    start = _left(text, end, LOCAL, 0)
    if start == end:
        return None
    spot, dots = after + text.startswith(" ", after), 0
    while True:
        stop = _right(text, spot, LABEL)
        if stop == spot:
            return None
        gap = stop + text.startswith(" ", stop)
        sign = next((d for d in DOT_SIGNS if text[gap : gap + len(d)].lower() == d), None)
        if sign is None and text.startswith(".", stop) and stop + 1 < len(text) and text[stop + 1] in LABEL:
            spot = stop + 1
        elif sign is not None:
            spot = gap + len(sign)
            spot += text.startswith(" ", spot)
        else:
            return (start, stop) if dots else None
        dots += 1


def address(text: str, at: int, host: int) -> tuple[int, int] | None:
    """A scheme that begins at ``at`` with a login or a numeric host; the host begins at ``host``."""
    end = host
    while end < len(text) and text[end] not in "/?#\"'<>" and not text[end].isspace():
        end += 1
    login, sign, name = text[host:end].rpartition("@")
    parts = name.partition(":")[0].split(".")
    numeric = len(parts) == 4 and all(p and set(p) <= DIGITS and small_part(p) for p in parts)
    return (at, end) if (sign and login and name) or numeric else None


def _boundary(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


def iban(text: str, at: int) -> int | None:
    """End of a valid IBAN that begins at ``at``; groups may be separated by single spaces."""
    signs, spot = [], at
    best = None
    while spot < len(text) and len(signs) < 34:
        if text[spot] in _ALNUM:
            signs.append(text[spot].upper())
            spot += 1
            if len(signs) == 4 and not ("".join(signs[:2]).isalpha() and set(signs[2:]) <= DIGITS):
                return None  # no country and check digits: most words end here
            whole = spot >= len(text) or not text[spot].isalnum()
            if whole and len(signs) >= 15:
                if int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1:
                    best = spot
        elif text[spot] == " " and signs and spot + 1 < len(text) and text[spot + 1] in _ALNUM:
            spot += 1
        else:
            break
    return best


def account(text: str, at: int, after: int) -> tuple[int, int] | None:
    """The account that a cue at ``at`` announces, at most _CUE_REACH signs behind it."""
    if not _boundary(text, at):
        return None
    for spot in range(after, min(len(text), after + _CUE_REACH)):
        if text[spot] == "\n":
            return None
        if spot > after and text[spot] in _ALNUM and _boundary(text, spot):
            end = iban(text, spot)
            if end:
                return spot, end
            if text[spot] in DIGITS:
                end = digit_chain(text, spot)
                whole = end >= len(text) or not text[end].isalnum()
                return (spot, end) if whole and 6 <= len(only_digits(text[spot:end])) <= 20 else None
            if not DIGITS.isdisjoint(text[spot : _right(text, spot, _ALNUM)]):
                return None  # a name with digits that is no valid number
    return None


def secret(text: str, at: int, after: int) -> tuple[int, int] | None:
    """What the cue at ``at`` is set to."""
    spot = after + text[after : after + 1].count('"')
    spot += len(text[spot : spot + 3]) - len(text[spot : spot + 3].lstrip(" "))
    if not _boundary(text, at) or text[spot : spot + 1] not in ("=", ":"):
        return None
    spot += 1
    spot += len(text[spot : spot + 3]) - len(text[spot : spot + 3].lstrip(" "))
    spot += text[spot : spot + 1] in ("'", '"')
    end = _right(text, spot, SECRET)
    while end > spot and text[end - 1] == ".":
        end -= 1
    return (spot, end) if end - spot >= 8 and not DIGITS.isdisjoint(text[spot:end]) else None


def personal_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is a base span) of all spans of a text."""
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int]] = []
    email_end = card_end = ip_end = run_end = secret_end = 0
    for last, (kind, length) in anchors().iter(text or ""):
        at = last + 1 - length
        if kind == "digit":
            if at < run_end:
                continue
            run_end = _right(text, at, DIGITS)
            if at >= card_end:
                card_end = digit_chain(text, at)
                if card_end - at >= 14:
                    if is_card(text[at:card_end]):
                        base.append(("card", at, card_end))
                    else:
                        more.extend(("card", *span) for span in cards_within(text, at, card_end))
            if at >= ip_end:
                runs = dotted_runs(text, at)
                ip_end = runs[-1][1]
                for i in range(0, len(runs) - 3, 4):
                    if all(small_part(text[a:b]) for a, b in runs[i : i + 4]):
                        base.append(("ip", runs[i][0], runs[i + 3][1]))
        elif kind == "at":
            start, end = _left(text, at, LOCAL, email_end), domain_end(text, at + 1)
            if end and start < at:
                base.append(("email", start, end))
                email_end = end
            wide = wide_email(text, at)
            if wide:
                more.append(("email", *wide))
        elif kind == "plus":
            end = phone_end(text, at)
            if end and 10 <= len(only_digits(text[at:end])) <= 15:
                base.append(("phone", at, end))
        elif kind == "tel":
            end = digit_chain(text, last + 1) if text[last + 1 : last + 2] in DIGITS else 0
            if _boundary(text, at) and 7 <= len(only_digits(text[last + 1 : end])) <= 15:
                more.append(("phone", last + 1, end))
        else:
            parse, name = {"scheme": (address, "address"), "spelt": (spelt_email, "email"),
                           "account": (account, "account"), "secret": (secret, "secret")}[kind]
            found = parse(text, at, last + 1) if kind != "secret" or at >= secret_end else None
            if found:
                more.append((name, *found))
                if kind == "secret":
                    secret_end = found[1]
    out = [(*span, True) for span in base]
    return sorted(out + _new_spans(base, more), key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def _new_spans(base: list[tuple], more: list[tuple]) -> list[tuple[str, int, int, bool]]:
    """Added spans that lie within no other span; a sweep by start, the farthest end so far decides."""
    out, reach = [], -1
    for start, end, added, kind in sorted(
        [(s, -e, 0, k) for k, s, e in base] + [(s, -e, 1, k) for k, s, e in more]
    ):
        if added and -end > reach:
            out.append((kind, start, -end, False))
        reach = max(reach, -end)
    return out


_SPAN = StructType([
    StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()),
    StructField("base", BooleanType()),
])
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def with_spans(docs: DataFrame, column: str = "spans", step: int = 256) -> DataFrame:
    """``docs`` with the personal data of each text, (kind, start, end, base), in ``column``."""
    raw = fresh_name(docs, "_raw")
    kept = [c for c in docs.columns if c.lower() != column]
    rows = docs.select(*kept, F.make_valid_utf8(F.col("text").cast("string")).alias(raw))

    def find(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                spans = [
                    [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in personal_spans(t)]
                    for t in batch[raw].to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in kept], pa.array(spans, _SPAN_ARROW)], names=[*kept, column]
                )

    return rows.mapInArrow(find, StructType([*[docs.schema[c] for c in kept], StructField(column, ArrayType(_SPAN))]))


def covered(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with ``<KIND>`` in place of each stretch of spans, named after its first one."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns; personal data in ``text`` is replaced by its kind."""
    column = fresh_name(docs, "_spans")

    @F.pandas_udf(StringType())
    def cover(texts, lists):
        out = [
            text if text is None else covered(text, [(s["kind"], s["start"], s["end"]) for s in spans])
            for text, spans in zip(texts, lists, strict=True)
        ]
        return texts.__class__(out, index=texts.index, dtype=object)

    text = F.make_valid_utf8(F.col("text").cast("string"))
    return with_spans(docs, column).withColumn("text", cover(text, column)).drop(column)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): base counts, and all spans."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE
    ]
    return found.select("doc_id", *counts, hex_sha256(_listed(base)).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
