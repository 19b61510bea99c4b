"""Every operator on the same odd rows: nulls, empty and long texts, repeated rows, ids with several texts,
clashing columns, empty tables, labels of one kind."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD_SCHEMA  # noqa: F401  (the schema that odd_docs has)

from mergelight.llm import (
    byte_bpe,
    decontaminate,
    jaccard_join,
    line_dedup,
    quality,
    queries,
    sharding,
    spot_signatures,
    token_files,
    toxicity,
    url_filter,
)

LOWER = {c: c + 32 for c in range(65, 91)}
LABELS = "doc_id long, quality int, toxic int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(rows):
    return collections.Counter(map(tuple, rows))


@pytest.fixture(scope="module")
def some_labels(spark, odd_rows):
    rows = [(i, n % 2, n % 3 % 2) for n, (i, *_) in enumerate(odd_rows)] + [(1, None, None), (None, 1, 1), (10**6, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


def test_contamination(spark, odd_docs, odd_rows):
    items = [(1, " ".join(odd_rows[0][1].split()[3:25])), (1, "one two"), (2, "ONE two"), (None, "same text"), (3, None), (4, "")]
    got = decontaminate.contamination_digest(odd_docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(LOWER))
        n = min(13, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[at : at + n])].add(item)
    want = []
    for i, text in {(i, t) for i, t, _ in odd_rows}:  # repeated rows are one
        words, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[tuple(words[at : at + n])] - {None}
        listed = ",".join(sorted(map(str, found)))
        want.append((i, len(words), len(hit), len(found), sha(listed), bool(hit) and 20 * len(hit) >= len(words)))
    assert counted(got) == counted(want)


def test_byte_bpe(odd_docs, odd_rows):
    path = public_tokenizers.path(queries.BYTE_BPE)
    done = byte_bpe.round_trip(odd_docs, path, public_tokenizers.PATTERN)
    assert done.columns == [*odd_docs.columns, "ids", "decoded"]
    assert counted((r.doc_id, r.decoded) for r in done.collect()) == counted((i, t or "") for i, t, _ in odd_rows)
    assert byte_bpe.bpe_digest(odd_docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_links(odd_docs, odd_rows):
    got = jaccard_join.jaccard_components(odd_docs).collect()
    sets = collections.defaultdict(list)
    for i, text, _ in odd_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i].append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    low = lambda i: -(2**63) if i is None else i
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                near = any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])
                if near and of[a] != of[b]:
                    of[a] = of[b] = min(of[a], of[b], key=low)
                    changed = True
    want = []
    for i, text, _ in odd_rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        n = 1 if 0 < len(words) < 5 else len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
        want.append((i, n, of[i]))
    assert counted(got) == counted(want)
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == set(of.values())


def test_lines(odd_docs, odd_rows, spark):
    long = "a line that is long enough to count, 40 signs and more"
    rows = [*odd_rows, *((700 + n // 2, f"{n}\n {long.upper()} \n{long}", "s") for n in range(12)), (700, f"0\n {long.upper()} \n{long}", "s")]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t, _ in rows], "doc_id long, text string, keep string, id int")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    low = lambda i: -(2**63) if i is None else i
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(low(i))
    want = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != low(i) for x in lines]
        want.append((i, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone, strict=True) if not g))))
    assert counted(line_dedup.line_digest(docs).collect()) == counted(want)
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_token_files(odd_docs, odd_rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    tool = Tokenizer.from_file(path)
    got = token_files.token_digest(odd_docs, f"{tmp_path}/files", path).collect()
    crc = lambda t: zlib.crc32(np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert counted((r.doc_id, r.ids_crc32) for r in got) == counted((i, crc(t)) for i, t, _ in odd_rows)
    at = 0
    order = sorted(got, key=lambda r: r.start)
    for row in order:
        assert row.start == at
        at += row.n_tokens
    ids = [-(2**63) if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    assert token_files.token_digest(odd_docs.limit(0), f"{tmp_path}/none", path).count() == 0


def test_fingerprints(odd_docs, odd_rows):
    got = spot_signatures.fingerprint_table(odd_docs).collect()
    assert counted((r.doc_id, r.n_chars) for r in got) == counted((i, len(t or "")) for i, t, _ in odd_rows)
    of = collections.defaultdict(set)
    texts = collections.defaultdict(set)
    for i, t, _ in odd_rows:
        texts[i].add(t or "")
    for r in got:
        if len(texts[r.doc_id]) == 1:
            of[next(iter(texts[r.doc_id]))].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in of.values())


def test_classifiers(spark, odd_docs, odd_rows, some_labels):
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], LABELS)
    none = some_labels.limit(0)
    for score in (quality.quality_scores, toxicity.toxicity_scores):
        for labels in (some_labels, one_kind, none):
            got = score(odd_docs, labels).collect()
            assert counted((r.doc_id,) for r in got) == counted((i,) for i, *_ in odd_rows)
            assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    kept = quality.keep_good(odd_docs, some_labels)
    assert kept.columns == odd_docs.columns


def test_shards(odd_docs, odd_rows):
    got = sharding.shard_table(odd_docs).collect()
    assert counted((r.doc_id, r.text_crc32) for r in got) == counted((i, zlib.crc32((t or "").encode())) for i, t, _ in odd_rows)


def test_urls(spark):
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None), (2, None), (3, ""), (4, "://"), (5, "x://ORG"), (1, "http://com/de/"),
            (6, "http://é.org/ß?q"), (7, "http://org" + "/a" * 50_000)]
    pages = spark.createDataFrame([(*r, "h", "p", "r", "v") for r in rows],
                                  "page_id long, url string, host string, path string, rule string, verdict string")
    got = url_filter.url_verdicts(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    want = {("http://a.org/x"): ("org/", "allow"), "x://ORG": (None, "allow"), "http://com/de/": ("com/de/", "block"),
            "http://é.org/ß?q": ("org/", "allow"), "http://org" + "/a" * 50_000: ("org/", "allow")}
    assert counted((r.page_id, r.rule, r.verdict) for r in got) == counted((i, *want.get(u, (None, "allow"))) for i, u in rows)
    assert url_filter.url_verdicts(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    doubled = url_filter.rule_table(spark, [*url_filter.RULES, url_filter.RULES[0]])
    assert url_filter.url_verdicts(pages, doubled).count() == len(rows)


def test_pipeline_stages(spark, odd_rows, small, tmp_path):
    """Odd rows through all stages: columns stay, nulls and repeated rows are handled as the stages say."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in odd_rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    columns, before = docs.columns, docs.count()
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
        empty = spark.createDataFrame([], spark.read.parquet(f"{small}/documents.parquet").schema)
        assert stage(spark, empty, small).count() == 0
