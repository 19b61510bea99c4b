"""Cuts by skip list against slicing, and whole rows against a plain re-telling of the rules."""

import hashlib
import random

import numpy as np
import pytest
import regex

from mergelight.llm import fill_in_middle as fim

RNG = random.Random(5)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 255, 256, 257, 5000])
def test_skip_list_finds_every_rank(n):
    points = np.array([RNG.randint(1, 9) for _ in range(n)], dtype=np.int64)
    lanes = fim.SkipList(points)
    sums = np.concatenate(([0], np.cumsum(points)))
    ranks = range(n + 1) if n < 300 else [0, 1, n - 1, n, *RNG.sample(range(n), 200)]
    assert all(lanes.seek(r) == (r, sums[r]) for r in ranks)
    assert all(len(lane) <= fim.FAN for lane in (lanes.points[-1], lanes.units[-1]))


@pytest.mark.parametrize("pattern", [None, r"\w+", r"\X", r"[^\n]*\n?", "zzz"])
def test_units_cover_the_text(pattern):
    unit = regex.compile(pattern) if pattern else None
    for text in ("", "a", "one two  three\n\nfour", "é 😀👩‍💻 漢字", "zzzz"):
        widths = fim.unit_widths(text, unit)
        assert widths.sum() == len(text) and (widths > 0).all()
        n, a, b = fim.ranked_cuts(text, (RNG.randrange(1 << 32), RNG.randrange(1 << 32)), unit)
        ends = {0, *np.cumsum(widths).tolist()}
        assert n == len(widths) and a in ends and b in ends and a <= b


def expected(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return len(t), "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_rows_equal_the_rules_and_come_back(odd_docs, odd_rows):
    done = fim.fill_in_middle(odd_docs)
    assert set(done.columns) == {*odd_docs.columns, "prefix_chars", "middle_chars"}
    done = done.withColumn("back", fim.restored(done["output"], done["form"]))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in done.collect()), key=repr)
    assert got == sorted(((i, *expected(i, t), t or "") for i, t, _ in odd_rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_digest_and_empty_table(odd_docs, odd_rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.fim_digest(odd_docs).collect()), key=repr)
    assert got == sorted(((i, *expected(i, t)[:4], sha(expected(i, t)[4]), sha(t or "")) for i, t, _ in odd_rows), key=repr)
    assert fim.fim_digest(odd_docs.limit(0)).count() == 0


def test_cuts_at_words(spark):
    texts = [(i, " ".join(RNG.choice(["ab", "cde", "f", "ghij"]) for _ in range(40))) for i in range(50)]
    done = fim.fill_in_middle(spark.createDataFrame(texts, "doc_id long, text string"), unit=r"\w+")
    of = dict(texts)
    for r in done.where("form <> 'plain'").collect():
        text, ends = of[r.doc_id], {r.prefix_chars, r.prefix_chars + r.middle_chars}
        assert r.n == 79 and all(at in (0, len(text)) or (text[at - 1] == " ") != (text[at] == " ") for at in ends)
    back = done.select("doc_id", fim.restored(done["output"], done["form"]).alias("text")).collect()
    assert {r.doc_id: r.text for r in back} == of
