"""Text operators against brute force, on small rows with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from mergelight.llm import byte_bpe, common, decontaminate, jaccard_join, line_dedup, quality, queries, sharding, spot_signatures
from mergelight.llm import token_files, toxicity, url_filter
from mergelight.session import cut_lineage

DOCS = "doc_id long, text string, lang string, _text string, id string"
RNG = random.Random(7)
WORDS = [a + b for a in "ba ce di fo gu".split() for b in "la me ni po ru st".split()]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, long_line = prose(60), prose(14)
    out = [(0, base), (1, base), (2, base + " " + prose(4)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"),
           (7, "ONE two"), (None, prose(20)), (8, prose(4000)), (9, "ÀÉ 漢字 😀 \x1c x" * 5)]
    out += [(10 + i, f"{prose(12)}\n  {long_line.upper()} \n{prose(3)}") for i in range(7)]
    out += [(40 + i, " ".join(base.split()[i : i + 50])) for i in range(5)]
    return [(i, t, "en", "x", "y") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    made = [(r[0], RNG.randint(0, 1), RNG.choice([0, 1, None])) for r in rows]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_contamination(spark, docs, rows):
    items = [(1, " ".join(rows[0][1].split()[5:30])), (2, "one TWO"), (3, None), (4, "..."), (5, rows[9][1][:400])]
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids)) for r in decontaminate.contamination(
        docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    for i, text, *_ in rows:
        w, hit, found = word.findall(lower(text or "")), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        assert got[i] == (len(w), len(hit), sorted(found))


def test_links(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a is not None and b is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    assert got == {i: (len(sets[i]), of[i]) for i in sets}


def test_lines(docs, rows):
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_digest(docs).collect()}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        often = lambda k: len(k) >= 40 and len(holders[k]) >= 5
        kept = [x for x in lines if not (often(key(x)) and max(holders[key(x)]) != i)]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        assert got[i] == (len(lines), len(lines) - len(kept), digest)
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns


def test_stream_of_lines_is_the_same_in_any_batches(spark):
    import pyarrow as pa

    rows = sorted((k, -d, p) for k in range(6) for d in range(k + 1) for p in range(1 + d % 2))
    whole = [(-d, p) for k, d, p in rows if k >= 4 and -d != k]
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_pydict({
            "id": [-d for _, d, _ in part], "text_hash": [0] * len(part), "n_lines": [9] * len(part),
            "at": [p for *_, p in part], "h1": [k for k, *_ in part], "h2": [0] * len(part),
        }) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = [(r["id"], r["at"]) for b in line_dedup._stream(batches, {}, 5) for r in b.to_pylist()]
        assert sorted(got) == sorted(whole)


def test_byte_bpe(docs, rows):
    import tiktoken

    path = public_tokenizers.path(queries.BYTE_BPE)
    ranks = byte_bpe.read_ranks(path)
    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = byte_bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).collect()
    assert all(r.ids == tool.encode_ordinary(r.text or "") and r.decoded == (r.text or "") for r in done)
    machine = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    machine.transducer.most_states = 50  # tables are begun anew many times
    for n in range(600):
        signs = ["aabe tTh  \n\t\x1céß漢😀's1#-", "ab \n\r\t.,;'s12 é\x85\u00a0\u3000\u200b\x1f", "ab  . ,\n"][n % 3]
        text = "".join(RNG.choice(signs) for _ in range(RNG.randint(0, 60))) * RNG.choice([1, 1, 3])
        assert machine.encode(text).tolist() == tool.encode_ordinary(text)
        assert byte_bpe.decoder(path).decode(machine.encode(text), chunk=3) == text
    assert byte_bpe.decoder(path).decode(np.array([ranks[b"\xe6"]])) == "�"


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    tool = Tokenizer.from_file(path)
    more = [(900, "a <|endoftext|> b"), (901, "A <|ENDOFTEXT|>, b<|startoftext|>"), (902, "İstanbul ǅ ﬁ x" * 3)]
    rows = rows + [(i, t, "en", "x", "y") for i, t in more]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.token_digest(docs, f"{tmp_path}/files", path).collect()}
    start, ids_of = 0, {}
    for i, text, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = ids_of[i] = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    values = np.sort(np.random.default_rng(1).integers(0, 10**6, 999))
    packed = token_files.EliasFano.of(values, 10**6 + 1)
    assert packed.all().tolist() == values.tolist() == [packed.select(i) for i in range(999)]
    blocks = spark.read.parquet(f"{tmp_path}/files").collect()
    for block in blocks:
        names = np.frombuffer(block.doc_ids, "<i8").tolist()
        for at in (0, len(names) - 1):
            if names[at] != 0:  # 0 stands for a null id too
                found = token_files.document_ids(spark, f"{tmp_path}/files", block.shard, block.block, at)
                assert found.tolist() == ids_of[names[at]]


def test_stretches_are_encoded_as_whole_texts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    tool, own = Tokenizer.from_file(path), token_files.StretchEncoder(path)
    signs = "aAbB İıßéÉ漢ñ.,;: \n\t'sdtre1２#-_<|>😀\u0301\u00a0\u2028 ﬁǅ"
    for _ in range(60):
        texts = ["".join(RNG.choice(signs) for _ in range(RNG.randint(0, 40))) for _ in range(50)]
        texts += [texts[0] + RNG.choice(["<|endoftext|>", "a<|startoftext|> b", " <|ENDOFTEXT|>"]) + texts[1], None]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, own.kind).tolist() == tool.encode(text or "", add_special_tokens=False).ids


def test_forms_of_a_stretch_are_learnt_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    tool, own = Tokenizer.from_file(path), token_files.StretchEncoder(path)
    texts = ["word Word WORD. word, word!! Word.** (word", "J\u030c j\u030c. T\u0308, x\u0338< a<\u0338 ..'s a!'s a's. l'm.", "É. é!! 1. ½,. ǅ. Σ."]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == tool.encode(text, add_special_tokens=False).ids
    assert sorted(s for s in own.known if "word" in s.lower()) == ["(word", "word"]


def test_texts_that_keep_all_lines_stay_out_of_python(spark, monkeypatch):
    import pandas as pd

    @F.pandas_udf("string")
    def seen(text: pd.Series, keep: pd.Series) -> pd.Series:
        assert not (keep.isna() & text.notna()).any()
        return text

    monkeypatch.setattr(line_dedup, "_kept", seen)
    line = "a line of more than forty letters that all of them hold"
    docs = spark.createDataFrame([(i, line if i < 6 else f"own {i}") for i in range(9)], "doc_id long, text string")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), "kept", "n_dropped").collect()
    assert sorted((r.doc_id, r.n_dropped) for r in done) == [(i, int(i < 5)) for i in range(9)]
    assert {r.doc_id: r.kept for r in done if r.doc_id > 4} == {i: line if i < 6 else f"own {i}" for i in range(5, 9)}


def minimax(sizes, shards):
    """Least capacity of contiguous shards, trying all; a size above it is alone."""
    def count(c):
        n, held = 1, 0
        for s in sizes:
            if held and held + s > c:
                n, held = n + 1, 0
            held += s
        return n

    return next(c for c in range(1, sum(sizes) + 1) if count(c) <= shards)


def test_shards(spark, docs, rows):
    big = [(300 + i, "big " * 500, "en", "x", "y") for i in range(30)]
    for some, shards in ((rows, 4), (rows + big, 7), (rows + rows[:5], 3)):
        got = sharding.sharded(spark.createDataFrame(some, DOCS).repartition(3), shards).collect()
        texts, keys = collections.defaultdict(set), {}
        for i, t, *_ in some:
            keys[t or ""] = min(keys.get(t or "", 2**62), -1 if i is None else i)
            texts[i].add(t or "")
        by_crc = {zlib.crc32(t.encode()): t for t in keys}
        size, slots, of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
        group_size = collections.Counter()
        for r in got:
            text = by_crc[r.text_crc32]
            assert text in texts[r.doc_id] and r["size"] == len(text.encode()) + 1
            size[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
            of[keys[text]].add(r.shard)
            group_size[keys[text]] += r["size"]
        assert len(got) == len(some) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        in_order = [next(iter(of[k])) for k in sorted(of)]
        assert all(len(s) == 1 for s in of.values()) and in_order == sorted(in_order) and in_order[-1] < shards
        capacity = minimax([group_size[k] for k in sorted(of)], shards)
        alone = {next(iter(of[k])) for k in of if group_size[k] > capacity}
        assert all(n <= capacity or shard in alone for shard, n in size.items())


def test_minimax_equals_brute_force():
    for _ in range(300):
        keys = sorted(RNG.sample(range(-500, 2000), RNG.randint(1, 60)))
        sizes = [RNG.choice([1, 2, 5, RNG.randint(1, 300), RNG.choice([3, 5000])]) for _ in keys]
        shards = RNG.randint(1, 8)

        def sums(shift, inside=None):
            found = collections.defaultdict(list)
            for k, s in zip(keys, sizes, strict=True):
                if inside is None or any(k >> p.shift == p.number for p in inside):
                    found[k >> shift].append(s)
            return [sharding.Piece(n, shift, sum(x), max(x), len(x)) for n, x in sorted(found.items())]

        def finer(pieces):
            return [p for s in {p.shift for p in pieces} for p in sums(max(0, s - 3), [p for p in pieces if p.shift == s])]

        best = minimax(sizes, shards)
        capacity, cuts = sharding.minimax_cuts(sums(9), shards, finer)
        held = collections.Counter()
        for k, s in zip(keys, sizes, strict=True):
            held[sum(k >= c for c in cuts)] += s
        assert capacity == best and max(held.values()) <= max(best, *sizes) and len(cuts) < shards


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in spot_signatures.fingerprint_table(docs).collect()}
    order = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows)
    for n, (i, text) in enumerate(order):
        k = len(text) // 4
        edited = text[: len(text) - k] + order[(n + 1) % len(order)][1][:k]
        row = got[None if i == -1 else i]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1


def test_edited_texts_over_very_many_ranges(spark):
    """The place of a range is looked up in a flat list, so the plan isn't deeper with more ranges."""
    docs = spark.createDataFrame([(i, f"text {i:05}") for i in range(900)], "doc_id long, text string")
    pairs = spot_signatures.edited_pairs(docs, ranges=600).where("not guest")
    got = {r.doc_id: r.edited for r in pairs.select("doc_id", "edited").collect()}
    assert got == {i: f"text {i:05}"[:-2] + "te" for i in range(900)}


def test_similar_sets(spark):
    sets = [(i, sorted(RNG.sample(range(30), RNG.randint(1, 12)))) for i in range(60)]
    table = spark.createDataFrame(sets, "doc_id long, signatures array<int>")
    got = spot_signatures.similar_sets(table, 0.5).count()
    distinct = {tuple(s) for _, s in sets}
    alike = [(a, b) for a in distinct for b in distinct if a < b and 2 * len({*a} & {*b}) >= len({*a} | {*b})]
    assert got == len(alike)


def test_urls(spark):
    urls = ["http://a.org/x", "HTTP://A.Example.ORG/es/1", "http://example.org/en/12?q", "https://x.com/fr/", "ftp://com/de/",
            "no scheme", None, "http://org", "://org/", "http://notexample.org/es/", "http://example.org/en/2#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for shards in (1, 3):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(
            pages, url_filter.rule_table(spark, url_filter.RULES), shards=shards).collect()}
        assert [got[i] for i in range(len(urls))] == [
            ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
            ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"),
            ("org/", "allow"), ("org/", "allow")]


def test_cascade_is_exact_over_its_universe_with_tiny_bitmaps(spark):
    universe = spark.range(4000).selectExpr("concat('k', id) AS key").selectExpr("key", "xxhash64(key) AS key_hash")
    listed = universe.where("pmod(key_hash, 5) = 0")
    cascade = url_filter.build_cascade(universe, listed, bits=13)
    rows = universe.selectExpr("key_hash", "pmod(key_hash, 5) = 0 AS mine").toPandas()
    assert len(cascade.levels) > 2 and (cascade.listed(rows.key_hash.to_numpy()) == rows.mine.to_numpy()).all()


def test_scores_have_a_value_for_every_row(docs, labels, rows):
    for found in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        scores = found.collect()
        assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    found = [
        decontaminate.contamination_digest(none, items), jaccard_join.jaccard_components(none), line_dedup.line_digest(none),
        sharding.shard_table(none), spot_signatures.fingerprint_table(none), quality.quality_scores(none, labels),
        toxicity.toxicity_scores(none, labels),
    ]
    assert [f.count() for f in found] == [0] * len(found)
    assert not decontaminate.contamination(docs, items.limit(0)).where("contaminated").count()
    assert quality.quality_scores(docs, labels.limit(0)).count() == docs.count()


@pytest.mark.parametrize("kind, label", [("quality", "quality"), ("toxicity", "toxic")])
def test_held_out_rows_are_told_apart(spark, kind, label):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    made = quality.quality_scores(docs, labels) if kind == "quality" else toxicity.toxicity_scores(docs, labels)
    both = made.where("held_out").join(labels, "doc_id").toPandas()
    y, rank = both[label].to_numpy(), both.score.rank().to_numpy()
    n1, n0 = y.sum(), (1 - y).sum()
    assert (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_text_query_equals_sql(spark, small, name):
    assert compare(spark, connect(small), small, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_pipeline(spark, small):
    import corpus_pipeline

    done = corpus_pipeline.run(spark, small)
    assert 0 < done.count() < spark.read.parquet(f"{small}/documents.parquet").count()
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_idle_tables_are_dropped_and_made_anew():
    import time

    from mergelight.llm.common import IdleTables

    made = []
    tables = IdleTables(lambda key: made.append(key) or [key], seconds=0.05)
    with tables.use("a"):
        time.sleep(0.2)
        with tables.use("a") as again:
            assert again == ["a"] and made == ["a"]
    time.sleep(0.5)
    assert not tables.held
    with tables.use("a") as found:
        assert found == ["a"] and made == ["a", "a"]


def test_partitions_send_what_they_counted_or_marked_in_few_bytes(spark, tmp_path, monkeypatch):
    """A counted or marked table has a fixed size: with many partitions, whole tables of zeros would fill disk and memory."""
    kept = []

    def keep(df):
        kept.append(cut_lineage(df))
        return kept[-1]

    monkeypatch.setattr(jaccard_join, "cut_lineage", keep)
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(2000))) for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8, "doc_id")
    rows, counts = jaccard_join.digests_and_counts(docs, 5)
    sent = kept[0].where("chunk is not null").agg(F.sum(F.length("counts")), F.count("*")).first()
    assert sent[1] and sent[0] < 8 * (1 << jaccard_join.COUNT_BITS)  # a byte for each slot and row at most
    want = np.zeros(1 << jaccard_join.COUNT_BITS, dtype=np.int64)
    for _, text in texts:
        (tokens,) = jaccard_join.shingle_sets(pa.array([text]), 5)
        np.add.at(want, jaccard_join.slot_of(tokens), 1)
    assert (counts == want).all() and rows.count() == 8
    hashes = np.random.default_rng(3).integers(-(2**63), 2**63, 500)
    ids = spark.createDataFrame([(int(h),) for h in hashes], "h long").repartition(5)
    bitmap = np.zeros(1 << (common.FILTER_BITS - 3), dtype=np.uint8)
    common.set_bits(bitmap, hashes.view(np.uint64))
    assert (common.filter_bitmap(ids, "h") == bitmap).all()
