"""Import graph: resolution, closure, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelight import fixed
from mergelight.functions.text import dirname, join_path, normalize_path
from mergelight.operators.ranking import range_rank
from mergelight.operators.text import imports_of
from mergelight.session import by_merge, cut_lineage


def file_imports(files: DataFrame) -> DataFrame:
    """(job_id, filename, import_path) of Python and script files, or of a facts table."""
    if "imports" in files.columns:
        targets = F.col("imports")
    else:
        targets = imports_of(F.col("content"), F.col("language"))
    return files.select("job_id", "filename", F.explode(targets).alias("import_path"))


def import_targets(files: DataFrame) -> DataFrame:
    """(job_id, base, dst): what an import may write to mean a file.

    Turned around from trying 16 candidates per import: every file tells the few bases
    that reach it, and the strongest file per base is kept before any join.
    """
    path = F.col("filename")
    slot = F.struct
    options = [slot(path.alias("base"), F.lit(0).alias("prio"))]
    for number, extension in enumerate(fixed.IMPORT_EXTENSIONS):
        first = 1 + 3 * number
        shorter = F.expr(f"left(filename, greatest(length(filename) - {len(extension)}, 0))")
        options.append(
            F.when(path.endswith(extension),
                   slot(shorter.alias("base"), F.lit(first).alias("prio")))
        )
        for place, entry in enumerate(("__init__", "index"), start=1):
            tail = f"/{entry}{extension}"
            folder = F.expr(f"left(filename, greatest(length(filename) - {len(tail)}, 0))")
            for base in (folder, F.concat(folder, F.lit("/"))):
                options.append(
                    F.when(path.endswith(tail) & (base != ""),
                           slot(base.alias("base"), F.lit(first + place).alias("prio")))
                )
    found = files.select(
        "job_id", path.alias("dst"), F.inline(F.array_compact(F.array(*options)))
    )
    return found.groupBy("job_id", "base").agg(
        F.min_by("dst", F.struct("prio", "dst")).alias("dst")
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges (job_id, src, dst) between changed files; self edges are dropped."""
    names = files.select("job_id", "filename").distinct()
    raw = F.col("import_path")
    relative = normalize_path(join_path(dirname(F.col("src")), raw))
    base = F.when(raw.startswith("."), relative).otherwise(F.replace(raw, F.lit("."), F.lit("/")))
    asked = (
        imports.withColumnRenamed("filename", "src").withColumn("base", base).distinct()
    )
    exact = names.select("job_id", F.col("filename").alias("import_path"), F.lit(True).alias("hit"))
    found = (
        asked.join(by_merge(exact), ["job_id", "import_path"], "left")
        .join(by_merge(import_targets(names)), ["job_id", "base"], "left")
        .withColumn("dst", F.when(F.col("hit"), raw).otherwise(F.col("dst")))
    )
    return found.filter(F.col("dst") != F.col("src")).select("job_id", "src", "dst").distinct()


def build_graph(files: DataFrame) -> DataFrame:
    """Edges of the import graph of every job."""
    return resolve_imports(file_imports(files), files)


def graph_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Per job: number of nodes (changed files) and distinct edges."""
    nodes = files.select("job_id", "filename").distinct().groupBy("job_id").agg(
        F.count(F.lit(1)).alias("nodes")
    )
    counted = edges.distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(counted, "job_id", "left").select(
        "job_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges")
    )


# Nodes whose reachability lies in one 64-bit word.
WORD = 64
NODE, BITS = ["job_id", "node"], ["job_id", "node", "word"]


def _nodes(edges: DataFrame) -> DataFrame:
    """(job_id, filename, node): files with an edge, numbered in each job by name.

    Neighbours in a folder get neighbouring numbers, so their bits lie in the same words.
    """
    ends = F.explode(F.array("src", "dst")).alias("filename")
    names = edges.select("job_id", ends).distinct()
    ranked = range_rank(names, "job_id", ["filename"], "_rank")
    return cut_lineage(ranked.select("job_id", "filename", (F.col("_rank") - 1).alias("node")))


def _numbered(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(job_id, src, dst): edges, which are distinct, by number."""
    src = nodes.select("job_id", F.col("filename").alias("src"), F.col("node").alias("src_node"))
    dst = nodes.select("job_id", F.col("filename").alias("dst"), F.col("node").alias("dst_node"))
    both = edges.join(by_merge(src), ["job_id", "src"]).join(by_merge(dst), ["job_id", "dst"])
    both = both.filter("src_node <> dst_node")
    return cut_lineage(both.select(
        "job_id", F.col("src_node").alias("src"), F.col("dst_node").alias("dst")
    ))


def _bit(node: str) -> list[Column]:
    """Word and bit of a node."""
    return [
        F.floor(F.col(node) / WORD).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(node) % WORD).cast("int")).alias("bits"),
    ]


def _sent(bits: DataFrame, along: DataFrame) -> DataFrame:
    """What the ends of edges learn: all that reaches their beginnings."""
    return bits.withColumnRenamed("node", "src").join(by_merge(along), ["job_id", "src"]).select(
        "job_id", F.col("dst").alias("node"), "word", "bits"
    )


def _jumped(jumps: DataFrame) -> DataFrame:
    """Jump edges of double length: the origin of a jump's origin; nodes without one fall out."""
    first = jumps.select("job_id", F.col("dst").alias("src"), F.col("src").alias("origin"))
    longer = jumps.join(by_merge(first), ["job_id", "src"]).filter("origin <> dst")
    return longer.select("job_id", F.col("origin").alias("src"), "dst")


def reach_bits(numbered: DataFrame) -> DataFrame:
    """(job_id, node, word, bits): the files that reach each node along edges, as bits.

    Bits spread in rounds.  A round sends what is new along the edges, and all there is along
    jump edges, one a node, which double their length with each round: a chain of n imports takes
    about log2(n) rounds.  Words are combined by ``bit_or`` before and after the shuffle, so a
    file that very many others import costs a word per 64 of them.  Cycles end when nothing is new; a
    node on a cycle reaches itself.
    """
    known = cut_lineage(
        numbered.select("job_id", F.col("dst").alias("node"), *_bit("src"))
        .groupBy(*BITS).agg(F.bit_or("bits").alias("bits"))
    )
    news = known
    jumps = numbered.groupBy("job_id", "dst").agg(F.min("src").alias("src")).select("job_id", "src", "dst")
    while True:
        jumps = cut_lineage(_jumped(jumps))
        direct = jumps.select("job_id", F.col("dst").alias("node"), *_bit("src"))
        came = _sent(news, numbered).unionByName(_sent(known, jumps)).unionByName(direct)
        both = known.select(*BITS, F.col("bits").alias("old"), F.lit(0).cast("bigint").alias("come"))
        both = both.unionByName(came.select(*BITS, F.lit(0).cast("bigint").alias("old"), F.col("bits").alias("come")))
        merged = cut_lineage(both.groupBy(*BITS).agg(F.bit_or("old").alias("old"), F.bit_or("come").alias("come")))
        fresh = F.col("come").bitwiseAND(F.bitwise_not("old"))
        news = merged.select(*BITS, fresh.alias("bits")).filter("bits <> 0")
        if news.isEmpty():
            return known
        known = merged.select(*BITS, F.col("old").bitwiseOR(F.col("come")).alias("bits"))


def _without_self(bits: DataFrame) -> DataFrame:
    word, own = _bit("node")
    others = F.when(F.col("word") == word, F.col("bits").bitwiseAND(F.bitwise_not(own))).otherwise(F.col("bits"))
    return bits.withColumn("bits", others).filter("bits <> 0")


def transitive_dependents(edges: DataFrame) -> DataFrame:
    """(job_id, filename, dependent): files that import ``filename`` directly or not.

    A file is never its own dependent.  The pairs are made here, from bits, for callers that ask
    for them; counts and impact don't list them.
    """
    edges = cut_lineage(edges.select("job_id", "src", "dst").distinct())
    nodes = _nodes(edges)
    bits = _without_self(reach_bits(_numbered(edges, nodes)))
    places = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)),
        lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0,
    )
    importers = F.transform(places, lambda i: F.col("word") * WORD + i)
    pairs = bits.select("job_id", "node", F.explode(importers).alias("importer"))
    target = nodes.select("job_id", "node", "filename")
    importer = nodes.select("job_id", F.col("node").alias("importer"), F.col("filename").alias("dependent"))
    return pairs.join(by_merge(target), NODE).join(by_merge(importer), ["job_id", "importer"]).select(
        "job_id", "filename", "dependent"
    )


def dependent_counts(edges: DataFrame) -> DataFrame:
    """Number of transitive dependents per file (files with at least one): bits are counted."""
    edges = cut_lineage(edges.select("job_id", "src", "dst").distinct())
    nodes = _nodes(edges)
    bits = _without_self(reach_bits(_numbered(edges, nodes)))
    counts = bits.groupBy(*NODE).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("dependents"))
    return counts.join(by_merge(nodes), NODE).select("job_id", "filename", "dependents")


def impact_scores(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of the job's files that depend on each file, directly or not."""
    names = files.select("job_id", "filename").distinct()
    totals = names.groupBy("job_id").agg(F.count(F.lit(1)).alias("nodes"))
    return (
        names.join(by_merge(dependent_counts(edges)), ["job_id", "filename"], "left")
        .join(totals, "job_id")
        .select(
            "job_id", "filename",
            (F.coalesce("dependents", F.lit(0)) / F.greatest("nodes", F.lit(1))).alias(
                "impact_score"
            ),
        )
    )
