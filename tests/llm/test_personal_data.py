"""Base spans against the patterns themselves, added spans and redaction on examples."""

import hashlib
import random
import re

import pytest

from mergelight.llm import personal_data as pd_

RNG = random.Random(3)
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute_force(text):
    spans = [
        (m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(PATTERNS.items())
        for m in re.finditer(p, text) if valid(kind, m.group())
    ]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def base_of(text):
    return [(k, a, b) for k, a, b, base in pd_.personal_spans(text) if base]


def card(n):
    body = "".join(RNG.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


SNIPPETS = [
    "a@b.c", "a.b@c-d.ef.", "@", "x@y", "a@b@c.d", "a@b.c@d.e", "1.2.3.4", "1.2.3", "1.2.3.4.5", "1.2.3.4.5.6.7.8.9",
    "256.1.1.1", "000255.0.0.01", "+1 (017) 555-7713", "+12", "+1 2", "+ 1", "+1()", "+12345678901-", "++4912345678",
    "1-2 3", "--", " ", ".", "é", "漢", "\n", "12 ", "token = ", "5", "55", "@x.y", "%", "_", "+", "99999999999999999999.1",
]


def test_base_spans_equal_the_patterns():
    for _ in range(6000):
        parts = [RNG.choice([*SNIPPETS, card(RNG.randint(13, 20))]) for _ in range(RNG.randint(1, 12))]
        text = RNG.choice(["", " "]).join(parts)
        assert base_of(text) == brute_force(text), text


def test_base_spans_of_random_signs():
    for _ in range(4000):
        text = "".join(RNG.choice("0123459..--  ++@@aZ()é") for _ in range(RNG.randint(0, 80)))
        assert base_of(text) == brute_force(text), text


@pytest.mark.parametrize("text, kind, found", [
    ("mail josé.núñez@correo.example.com now", "email", "josé.núñez@correo.example.com"),
    ("write to jane [at] mail [dot] example [dot] org today", "email", "jane [at] mail [dot] example [dot] org"),
    ("jane(at)mail.example.org", "email", "jane(at)mail.example.org"),
    ("call tel:030-1234567 now", "phone", "030-1234567"),
    ("see https://bob:pw@host.example/x", "address", "https://bob:pw@host.example"),
    ("see http://10.0.0.1:8080/x", "address", "http://10.0.0.1:8080"),
    ("IBAN: GB82 WEST 1234 5698 7654 32.", "account", "GB82 WEST 1234 5698 7654 32"),
    ("iban no. DE89370400440532013000", "account", "DE89370400440532013000"),
    ("Account number 12345678, please", "account", "12345678"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ("API_KEY=abc123def456.", "secret", "abc123def456"),
])
def test_added_spans(text, kind, found):
    assert [(k, text[a:b]) for k, a, b, base in pd_.personal_spans(text) if not base] == [(kind, found)]


def test_cards_between_other_numbers():
    one, two = "4111111111111111", "5500005555555559"
    for text, found in [(f"{one} {two}", [one, two]), (f"7 4111-1111-1111-1111 {two} 12", ["4111-1111-1111-1111", two]),
                        ("1 2 3 4 5 6 7 8 9 10 11 12 13", []), (f"1{one} 22", [])]:
        spans = pd_.personal_spans(text)
        assert [text[a:b] for k, a, b, base in spans if k == "card" and not base] == found


@pytest.mark.parametrize("text", [
    "see https://example.org/a?b=1", "IBAN GB82 WEST 1234 5698 7654 33", "an account of 1999 events", "tokens = 12",
    "token = short", "at [at] nothing", "secret: words only here", "my account\n12345678", "http://999.1.1.1/", "a@b",
])
def test_clean_texts(text):
    assert pd_.personal_spans(text) == []


def test_long_texts_are_read_a_bounded_number_of_times():
    import time

    for text in ("1" * 300_000, "1." * 150_000, "a@" * 150_000, "token=" * 50_000 + "1", "+1 " * 100_000, "iban " * 60_000,
                 "http://" * 50_000, "[at]" * 75_000, "é" * 300_000 + "@x.yz", "1 " * 150_000, "tel:" * 75_000 + "1" * 20):
        started = time.perf_counter()
        pd_.personal_spans(text)
        assert time.perf_counter() - started < 5


def test_query_and_redaction(spark, odd_docs, odd_rows):
    texts = ["call +1 (017) 555-7713 or a@b.c", f"card {card(16)}, 10.1.2.3 é@x.yz", None, "", "clean", "a@b.c a@b.c"]
    rows = [*odd_rows, *((500 + i, t, "s") for i, t in enumerate(texts)), (500, texts[0], "s")]
    docs = spark.createDataFrame([(i, t, "own") for i, t, _ in rows], "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pd_.span_digest(docs).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        base = brute_force(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pd_.personal_spans(t))
        want.append((i, *(sum(k == kind for k, *_ in base) for kind in PATTERNS), hashlib.sha256(listed.encode()).hexdigest(), every))
    assert got == sorted(want, key=repr)
    hidden = pd_.redacted(docs)
    assert hidden.columns == docs.columns
    found = {r.doc_id: (r.text, r.spans) for r in hidden.where("doc_id >= 500 and doc_id < 600").collect()}
    assert found == {
        500: ("call <PHONE> or <EMAIL>", "own"), 501: ("card <CARD>, <IP> <EMAIL>", "own"), 502: (None, "own"),
        503: ("", "own"), 504: ("clean", "own"), 505: ("<EMAIL> <EMAIL>", "own"),
    }
    assert pd_.with_spans(odd_docs).columns == [*[c for c in odd_docs.columns if c != "spans"], "spans"]
    assert pd_.span_digest(docs.limit(0)).count() == 0
