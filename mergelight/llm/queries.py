"""The operators' queries over the given tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mergelight.llm.byte_bpe import bpe_digest
from mergelight.llm.common import table
from mergelight.llm.decontaminate import contamination_digest
from mergelight.llm.fill_in_middle import fim_digest
from mergelight.llm.filter_audit import filter_audit
from mergelight.llm.jaccard_join import jaccard_components
from mergelight.llm.line_dedup import line_digest
from mergelight.llm.personal_data import span_digest
from mergelight.llm.quality import quality_scores
from mergelight.llm.sharding import shard_table
from mergelight.llm.spot_signatures import fingerprint_table
from mergelight.llm.token_files import token_digest
from mergelight.llm.toxicity import toxicity_scores
from mergelight.llm.url_filter import RULES, rule_table, url_verdicts
from mergelight.session import ensure_checkpoint_dir

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return bpe_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a new folder of token files beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
    return token_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_url_filter, op3_byte_bpe, op4_toxicity, op5_sharding, op6_jaccard_join,
        op7_token_files, op8_fingerprints, op9_line_dedup, op10_quality, op11_filter_audit,
        op12_fill_in_middle, op13_personal_data,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (
    SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")},
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item_window AS (
    SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM (
        SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p
        FROM item WHERE len(ws) > 0)),
doc_window AS (
    SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
        FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM doc_window JOIN item_window USING (n, w)),
word AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit)
    GROUP BY doc_id),
found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (
        SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP2_SQL = rf"""
WITH part AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
page AS (
    SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part),
fit AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
    FROM page, (VALUES {_RULE_ROWS}) AS r(h, p, v)
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM page LEFT JOIN fit USING (page_id)
"""

OP6_SQL = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS s FROM (
        SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM doc WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b
    ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
    SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, n
"""

OP9_SQL = rf"""
WITH line AS (
    SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS l FROM (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
    SELECT doc_id, p, l, {_LOWER.format("trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
    FROM line),
often AS (
    SELECT k, max(doc_id) AS keeps FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, p, l, coalesce(keeps <> doc_id, false) AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
fail AS (
    SELECT part, CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails,
        coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
    FROM doc LEFT JOIN labels USING (doc_id)),
cell AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad
    FROM fail GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
perm AS (
    SELECT '' AS o UNION ALL
    SELECT o || f FROM perm, letter WHERE strpos(o, f) = 0),
step AS (SELECT o, s, substr(o, s, 1) AS f FROM perm, range(1, 6) r(s) WHERE length(o) = 5),
gone AS (
    SELECT part, fails, n, n_good, n_bad, o, coalesce(min(strpos(o, f)), 6) AS went
    FROM cell CROSS JOIN perm LEFT JOIN letter ON strpos(fails, f) > 0 WHERE length(o) = 5
    GROUP BY part, fails, n, n_good, n_bad, o),
counted AS (
    SELECT part, o, s, f, sum(CASE WHEN went > s THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN went = s THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN went < s AND strpos(fails, f) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN went = s THEN n_good ELSE 0 END) AS good_lost,
        sum(CASE WHEN went = s THEN n_bad ELSE 0 END) AS toxic_lost
    FROM gone JOIN step USING (o) GROUP BY part, o, s, f)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
    CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

OP12_SQL = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
word AS (
    SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
        CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
        CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM doc),
cut AS (
    SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
            THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM word),
part AS (
    SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM part
"""

ORACLES = {
    "op1_decontamination": OP1_SQL, "op2_url_filter": OP2_SQL, "op6_jaccard_join": OP6_SQL,
    "op9_line_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_fill_in_middle": OP12_SQL,
}
