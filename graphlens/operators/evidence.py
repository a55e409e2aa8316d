"""What generated names are, and whether descriptions are worth giving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.text import before_comma, normalise, strip


def surface_index(entities: DataFrame) -> DataFrame:
    """(key, entity) of normalised names, full texts and ids. A name beats a text and an id; of equal
    names the last entity wins, of equal texts or ids the first."""
    forms = F.array(F.struct(F.lit(0).alias("kind"), normalise(before_comma(F.col("text"))).alias("key")), F.struct(F.lit(1).alias("kind"), normalise(F.col("text")).alias("key")), F.struct(F.lit(1).alias("kind"), normalise(F.col("id")).alias("key")))
    f = entities.select("id", F.explode(forms).alias("f")).select("id", "f.kind", "f.key").filter(F.coalesce(F.col("key"), F.lit("")) != "")
    names = F.max(F.when(F.col("kind") == 0, F.col("id")))
    others = F.min(F.when(F.col("kind") == 1, F.col("id")))
    return f.groupBy("key").agg(F.coalesce(names, others).alias("entity"))


def hallucinations(predictions: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Add category to (relation, gold, text): correct, no entity, outside the relation's range, or plausible."""
    index = surface_index(entities)
    seen = edges.select("relation", F.col("tail").alias("entity")).distinct().withColumn("seen", F.lit(1))
    ranges = edges.select("relation").distinct().withColumn("has_range", F.lit(1))
    j = predictions.withColumn("key", normalise(F.col("text"))).join(index, "key", "left").join(seen, ["relation", "entity"], "left").join(F.broadcast(ranges), "relation", "left")
    category = F.when(F.col("entity").isNull(), "type1_oov").when(F.col("entity") == F.col("gold"), "correct").when(F.col("has_range").isNotNull() & F.col("seen").isNull(), "type2_type_violation").otherwise("plausible_wrong")
    return j.withColumn("category", category).drop("key", "seen", "has_range")


def rates(classified: DataFrame, *by: str) -> DataFrame:
    n = classified.groupBy(*by, "category").agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


# Words that name what stands on a side of a relation.
TYPE_WORDS = ("person", "place", "location", "organi", "film", "work", "group", "country", "city", "event", "entity", "concept", "word", "noun", "verb", "category", "member", "part")


def gate(texts: DataFrame, template: str) -> DataFrame:
    """(id, name, text) -> checks of a description: template, distinct, length, informative, typed, and passed and rejected."""
    d = strip(F.col("text"))
    words = F.filter(F.split(d, r"\s+"), lambda w: w != "")
    long = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda w: F.length(w) > 2))
    typed = F.lit(False)
    for t in TYPE_WORDS:
        typed = typed | F.contains(F.lower(d), F.lit(t))
    n = texts.groupBy(F.lower(strip(F.col("text"))).alias("_k")).agg(F.count("*").alias("_n"))
    c = texts.withColumn("_k", F.lower(d)).join(n, "_k").select(
        "id", (~d.rlike(template)).alias("template"), (F.col("_n") == 1).alias("distinct"), F.size(words).between(6, 40).alias("length"), (F.size(F.array_except(long(d), long(F.col("name")))) >= 4).alias("informative"), typed.alias("typed"),
    )
    every: Column = F.col("template") & F.col("distinct") & F.col("length") & F.col("informative") & F.col("typed")
    return c.withColumns({"passed": every, "rejected": ~(F.col("template") & F.col("distinct"))})
