"""Mixing sources to target weights with hash-threshold histograms.

Each document has a 60-bit hash of its id. A source's share is met by taking every document a whole number of times
and once more those whose hash lies under the source's threshold. The threshold is found without sorting: sum the
sizes by (source, hash bucket), find the bucket in which the budget ends, and refine that bucket alone with the next
bits. Four levels of 15 bits resolve the hash fully. Every sum is a partial aggregate, so a source that holds a third
of all rows costs no more than any other, and a histogram has at most 32,768 rows a source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of equal id
share a hash and stand or fall together; a source of size 0 takes nothing and leaves its share to the others as far as
their limits allow; no rows give no rows. Further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import documents, text_or_empty, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BITS = 15
LEVELS = 4
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def hash60(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, base, left): one row a source.

    Shares by weight, stopped at ``max_repeat`` times the size with the excess reshared, are a water level: with the
    sources ordered by limit over weight, the k least are at their limit and the rest share what remains.
    The windows run over one row a source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("most", F.col("source_size") * max_repeat)
    level = Window.orderBy(F.expr("most / w"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("open", (F.col("rest") * F.col("w")) <= F.col("most") * F.col("rest_w"))
        .withColumn("k", F.row_number().over(level))
    )
    every = Window.partitionBy()
    per = per.withColumn("k0", F.min(F.when(F.col("open"), F.col("k"))).over(every))
    per = per.withColumn("r0", F.max(F.when(F.col("k") == F.col("k0"), F.col("rest"))).over(every)).withColumn("w0", F.max(F.when(F.col("k") == F.col("k0"), F.col("rest_w"))).over(every))
    target = F.when(F.col("k") >= F.col("k0"), (F.col("w") * F.col("r0")).cast("double") / F.col("w0").cast("double")).otherwise(F.col("most").cast("double"))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return per.withColumn("target", target).withColumn("base", base).select("source", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("left"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, edge, edge_taken): hashes under ``edge`` are within the budget ``left``, ``edge`` itself if that is nearer.

    ``edge`` is null where the whole source is within the budget.
    """
    state = goals.select("source", F.col("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        same = sizes["source"].eqNullSafe(state["source"])
        here = sizes.join(state, same & (F.shiftright(sizes["h"], shift + BITS) == state["prefix"]))
        hist = here.groupBy(state["source"], F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.max("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        over = hist.withColumn("c", F.sum("s").over(upto)).filter(F.col("c") > F.col("left"))
        edge = over.groupBy("source").agg(F.min_by(F.struct((F.col("left") - (F.col("c") - F.col("s"))).alias("left"), F.col("bucket").alias("prefix"), "s"), "bucket").alias("e"))
        # a table of known size: small ones are broadcast by their statistics, and the documents aren't shuffled
        last = level == LEVELS - 1
        state = written(edge.select("source", "e.left", "e.prefix", *(["e.s"] if last else [])), "mix-level")
    return state.select("source", F.col("prefix").alias("edge"), ((F.col("s") - F.col("left")) < F.col("left")).alias("edge_taken"))


def _sizes(docs: DataFrame, key: str, source: str, size: Column | None) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), (n_words() if size is None else size).alias("size"), hash60(key).alias("h"))


def plan_of(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row a source with all that decides how often its documents are taken."""
    goals = written(targets(sizes, weights, max_repeat), "mix-targets")
    edges = thresholds(sizes, goals)
    plan = goals.alias("g").join(edges.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select("g.source", "source_size", "target", "base", F.col("left") > 0, "edge", "edge_taken")
    # names that no table of documents has
    return written(plan.toDF(*[f"_mix_{c}" for c in ("source", "source_size", "target", "base", "some", "edge", "edge_taken")]), "mix-plan")


def repeats(hash_: Column, max_repeat: int = MAX_REPEAT) -> Column:
    """How often a row joined to its source's plan is taken."""
    edge = F.col("_mix_edge")
    once = F.col("_mix_some") & (edge.isNull() | (hash_ < edge) | ((hash_ == edge) & F.col("_mix_edge_taken")))
    return F.least(F.col("_mix_base") + F.when(once, 1).otherwise(0), F.lit(max_repeat)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, key: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """One row a document: its size, its source's size and target, how often (``repeats``) and how much (``taken``) it is taken."""
    sizes = written(_sizes(docs, key, source, size), "mix-sizes")
    plan = plan_of(sizes, weights, max_repeat)
    out = sizes.join(plan, sizes["source"].eqNullSafe(plan["_mix_source"])).withColumn("repeats", repeats(F.col("h"), max_repeat))
    return out.select(F.col("id").alias(key), "source", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), "repeats", (F.col("size") * F.col("repeats")).alias("taken"), "h")


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, key: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Texts are joined to one row a source, not shuffled."""
    plan = plan_of(written(_sizes(docs, key, source, size), "mix-sizes"), weights, max_repeat)
    joined = docs.join(plan, F.col(source).cast("string").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_repeats", repeats(hash60(key), max_repeat))
    return joined.filter("_mix_repeats > 0").withColumn("_mix_k", F.explode(F.sequence(F.lit(1), F.col("_mix_repeats")))).select(docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str, select: str) -> str:
    """The same in DuckDB SQL, with a sort by hash where Spark has histograms. ``docs``: a relation; ``select``: what follows."""
    return rf"""
    mix_sizes AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM {docs}),
    mix_per AS (SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::BIGINT AS most,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM mix_sizes GROUP BY source),
    mix_rest AS (SELECT *, row_number() OVER o AS k,
        (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
        (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_w
        FROM mix_per WINDOW o AS (ORDER BY most::DOUBLE / w, source NULLS LAST)),
    mix_open AS (SELECT k AS k0, rest AS r0, rest_w AS w0 FROM mix_rest WHERE rest * w <= most * rest_w ORDER BY k LIMIT 1),
    mix_target AS (SELECT source, source_size, CASE WHEN k >= k0 THEN (w * r0)::DOUBLE / w0 ELSE most::DOUBLE END AS target FROM mix_rest LEFT JOIN mix_open ON true),
    mix_goal AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM mix_target),
    mix_cum AS (SELECT s.*, g.source_size, g.target, g.base, g.target - g.base * g.source_size AS left_,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
        sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
        FROM mix_sizes s JOIN mix_goal g ON s.source IS NOT DISTINCT FROM g.source),
    mix_edge AS (SELECT source AS esource, min(h) AS edge FROM mix_cum WHERE c > left_ GROUP BY source),
    mixed AS (SELECT c.*, least(base + CASE WHEN left_ > 0 AND (edge IS NULL OR h < edge OR (h = edge AND c - left_ < left_ - (c - own))) THEN 1 ELSE 0 END, 3)::BIGINT AS repeats
        FROM mix_cum c LEFT JOIN mix_edge ON c.source IS NOT DISTINCT FROM esource)
    {select}"""


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES = {"op3_mix_sources": "WITH " + mix_sql("documents", "SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken FROM mixed").lstrip()}
