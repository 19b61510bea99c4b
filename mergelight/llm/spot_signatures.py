"""Document fingerprints by spot signatures, with DataFrame operations only.

A signature is an anchor (a common word) with the chain of the next ``chain`` content words
after it; content words are all words that aren't anchors, searched among the next ``reach``
words.  The start of a text counts as an anchor, so that every text with a word has a signature; a
text with signs but no word has one, of the whole text.  The fingerprint is the set of 32-bit
hashes of all signatures, sorted; likeness is the Jaccard similarity of two sets.

``similar_sets`` finds all pairs of sets with a likeness of ``least`` or more: equal sets are one
class; sets are partitioned by length so that only neighbouring partitions can hold partners; in
each, sets meet on the rarest signatures of which they must share one, and are compared only if
their lengths allow the likeness.

``edited_pairs`` gives each document its edited text: the last quarter of its code points is
replaced by the beginning of the next document.  Documents are dealt to ranges of ids, and the
first document of each range is sent to the range before as well, so that each text travels
once and the next one is always there.

Defined results: a null text is an empty one; an empty text has no signature and its likeness to
another empty one is 1, to anything else 0; repeated rows follow each other and stay; ties in the
id are ordered by the text's hash; a null id comes before all; the only document is its own
successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mergelight.session import cut_lineage

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in that is was for on with as by at be this it from or an are not have has but "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch aus "
    "le la les de du et que qui un une dans en pour pas sur au est par il se "
    "el los las del y por con no para lo su al es como mas"
).split()
CHAIN = 2
REACH = 8
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signature_set(text: Column, chain: int = CHAIN, reach: int = REACH, anchors: list[str] | None = None) -> Column:
    """Sorted distinct hashes of the signatures of a text that isn't null."""
    known = anchors or ANCHORS

    def chain_from(ws, start):
        return F.array_join(
            F.slice(F.filter(F.slice(ws, start, reach), lambda w: ~w.isin(known)), 1, chain), " "
        )

    def spots(ws):
        begin = F.array(F.hash(F.lit("^"), chain_from(ws, F.lit(1))))
        marked = F.transform(ws, lambda w, i: F.when(w.isin(known), F.hash(w, chain_from(ws, i + 2))))
        return F.concat(begin, F.filter(marked, lambda s: s.isNotNull()))

    # a transform over one element binds the words, which are used several times
    every = F.flatten(F.transform(F.array(words(text)), spots))
    return (
        F.when(text == "", F.array().cast("array<int>"))
        .when(~text.rlike(r"[\p{L}\p{N}]"), F.array(F.hash(text)))
        .otherwise(F.sort_array(F.array_distinct(every)))
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / F.greatest(every, F.lit(1))).cast("double")


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), " ")


def _in_order():
    return W.partitionBy("range").orderBy("guest", "id", "place")


def edited_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, edited and the place in order): documents with their edited texts.

    ``id`` and ``place`` order a range; its last row is a guest, the first document of the next one.
    """
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("id", shares, 100 * ranges)).first()[0] or []  # one number a range
    cut_list = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    spot = F.size(F.filter(cut_list, lambda c: c < F.col("id")))
    rows = rows.withColumns({"range": spot, "place": F.xxhash64("text"), "guest": F.lit(False)})
    firsts = sorted((r["range"], r["id"]) for r in rows.groupBy("range").agg(F.min("id").alias("id")).collect())
    before = {ident: firsts[i - 1][0] for i, (_, ident) in enumerate(firsts)}  # one id a range
    # two flat lists: an expression nested once a range would be deeper than the driver's stack
    idents = F.array(*map(F.lit, before)).cast("array<bigint>")
    homes = F.array(*map(F.lit, before.values())).cast("array<int>")
    home = F.get(homes, (F.array_position(idents, F.col("id")) - 1).cast("int"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("place"))  # an id may have several documents
    guests = rows.where(F.col("id").isin(list(before))).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    guests = guests.withColumns({"range": home, "guest": F.lit(True)})
    quarter = F.floor(F.length("text") / 4).cast("int")
    both = rows.unionByName(guests).withColumn("_next", F.coalesce(F.lead("text").over(_in_order()), F.lit("")))
    edited = F.concat(F.left("text", F.length("text") - quarter), F.left("_next", quarter))
    return both.withColumn("edited", edited).drop("_next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, signatures, edited_signatures, next_signatures) of every row."""
    pairs = edited_pairs(docs).withColumns({
        "signatures": signature_set(F.col("text")), "edited_signatures": signature_set(F.col("edited")),
        "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256),
    }).drop("text", "edited")
    following = F.lead("signatures").over(_in_order())
    return pairs.withColumn("next_signatures", following).where("not guest").drop("id", "range", "place", "guest")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def similar_sets(sets: DataFrame, least: float = 0.75, ident: str = "doc_id", column: str = "signatures") -> DataFrame:
    """(class_a, class_b, likeness) of all pairs of different sets that are alike; see ``set_classes``."""
    classes = set_classes(sets, ident, column).groupBy("class").agg(F.first(column).alias("s"))
    classes = cut_lineage(classes.where(F.size("s") > 0).withColumn("n", F.size("s")))
    counts = classes.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("f"))
    # a set shares one of its n - ceil(least n) + 1 rarest signatures with every partner
    ranked = classes.select("class", "n", F.explode("s").alias("x")).join(counts, "x")
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("f", "x")))
    rare = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)))
    rare = rare.select("x", "class", "n", part.cast("int").alias("part"))
    left = rare.select("x", F.col("class").alias("class_a"), F.col("n").alias("na"),
                       F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = rare.select("x", F.col("class").alias("class_b"), F.col("n").alias("nb"), "part")
    near = left.join(right, ["x", "part"]).where(
        "na < nb or (na = nb and class_a < class_b)"
    ).where(F.col("na") >= least * F.col("nb") - 1e-9)
    pairs = near.select("class_a", "class_b").distinct()
    a = classes.select(F.col("class").alias("class_a"), F.col("s").alias("sa"))
    b = classes.select(F.col("class").alias("class_b"), F.col("s").alias("sb"))
    like = likeness(F.col("sa"), F.col("sb"))
    compared = pairs.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", like.alias("likeness"))
    return compared.where(F.col("likeness") >= least - 1e-12)


def set_classes(sets: DataFrame, ident: str = "doc_id", column: str = "signatures") -> DataFrame:
    """``sets`` with ``class``, the digest of the set: rows with equal sets are one class."""
    return sets.withColumn("class", F.sha2(fingerprint(F.col(column)), 256))
