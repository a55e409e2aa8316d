"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, targets come from weights by water-filling under a cap, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as
its probability. The draw depends on seed and doc_id only, so reruns agree.

Defined results: null text counts no words and is emitted nothing from (size 0); a null source is
a source of its own, last in order; repeated rows of one doc_id are mixed each, with the same
draw; an empty table gives an empty result; extra columns pass through mix(), all but one named `copy`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import fraction, fresh, materialize, read_table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all tokens.
SHARE = 1.5
#: No source is used more than so often.
MAX_REPEATS = 2
SEED = "mix-1"
#: Most sources whose targets are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), one row per source.

    A source is capped iff filling all sources to its own cap level takes no more than the whole;
    the level of the rest follows. The input has one row per source, already aggregated, so the
    windows without partitions order only the catalogue of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    s = s.withColumn("level", F.col("cap") / F.col("weight"))
    everything, upto = Window.partitionBy(), Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("whole", F.sum("source_size").over(everything) * F.lit(share)).withColumn("weights", F.sum("weight").over(everything))
    s = s.withColumn("caps_upto", F.sum("cap").over(upto)).withColumn("weights_upto", F.sum("weight").over(upto))
    s = s.withColumn("capped", F.col("caps_upto") + F.col("level") * (F.col("weights") - F.col("weights_upto")) <= F.col("whole"))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    s = s.withColumn("rest", F.try_divide(F.col("whole") - used, free_weight))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("rest")))
    return s.select("source", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, seed: str = SEED, max_repeats: float = MAX_REPEATS, names: tuple[str, ...] = ("size", "source_size", "target", "copies"), **weights) -> DataFrame:
    """Add size, source_size, target and copies to documents, under these names or others; columns of these names are replaced."""
    size, source_size, target, copies = names
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    sizes = docs.select("source", word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    key = fresh(docs, "_source")
    t = source_targets(sizes, max_repeats=max_repeats, **weights).select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    t = materialize(t)
    t = F.broadcast(t) if t.count() <= BROADCAST_SOURCES else t  # texts then stay where they are, and no source is one task
    out = docs.select(*keep, word_count(F.col("text")).alias(size)).join(t, F.col("source").eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.least(F.coalesce(F.try_divide(F.col(target), F.col(source_size)), F.lit(0.0)), F.lit(float(max_repeats)))
    draw = fraction(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return out.withColumn(copies, (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long"))


def mix(docs: DataFrame, seed: str = SEED, **weights) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with `copy` counting from 0; a column `copy` of the input is replaced."""
    names = tuple(fresh(docs, n) for n in ("size", "source_size", "target", "copies"))
    out = with_copies(docs, seed, names=names, **weights).filter(F.col(names[3]) > 0)
    kept = [c for c in docs.columns if c.lower() != "copy"]
    return out.select(*kept, F.explode(F.sequence(F.lit(0), (F.col(names[3]) - 1).cast("int"))).alias("copy"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS level, (SELECT sum(source_size) * 1.5::DOUBLE FROM w) AS whole, (SELECT sum(weight) FROM w) AS weights FROM w),
u AS (SELECT *, sum(cap) OVER (ORDER BY level RANGE UNBOUNDED PRECEDING) AS caps_upto, sum(weight) OVER (ORDER BY level RANGE UNBOUNDED PRECEDING) AS weights_upto FROM l),
c AS (SELECT *, caps_upto + level * (weights - weights_upto) <= whole AS capped FROM u),
r AS (SELECT *, (whole - coalesce((SELECT sum(cap) FROM c WHERE capped), 0)) / nullif((SELECT sum(weight) FROM c WHERE NOT capped), 0) AS rest FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, weight * rest) END AS target FROM r),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(coalesce(t.target / nullif(t.source_size, 0), 0), 2) AS rate,
  CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""
