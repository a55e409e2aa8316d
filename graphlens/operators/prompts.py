"""Rendering prompts and measuring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The question, the wrapper and the two answers.
YES, NO = "Yes, this is true.", "No, this is not true."
WRAPPER = ("Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n", "\n\n### Response:\n")


def question(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(F.lit("Is this true: "), head, F.lit(" "), relation, F.lit(" "), tail, F.lit("?"))


def wrapped(prompt: Column) -> Column:
    return F.concat(F.lit(WRAPPER[0]), prompt, F.lit(WRAPPER[1]))


def with_text(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Add head_text and tail_text; entities without a text keep their id."""
    for end in ("head", "tail"):
        t = entities.select(F.col("id").alias(end), F.col("text").alias("_t"))
        triples = triples.join(t, end, "left").withColumn(f"{end}_text", F.coalesce("_t", end)).drop("_t")
    return triples


def verdict_text(label: Column) -> Column:
    return F.when(label == 1, YES).otherwise(NO)


def lengths(df: DataFrame, text: str, *by: str) -> DataFrame:
    """min, median, p95, p99 and max in words: the element at int(n * p) of the sorted lengths, from their counts."""
    n = df.groupBy(*by, F.size(F.split(text, " ")).alias("w")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy("w"))
    n = n.withColumns({"upto": upto, "total": F.sum("m").over(Window.partitionBy(*by))})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * p), F.col("total") - 1), F.col("w")))
    return n.groupBy(*by).agg(F.min("w").alias("min"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("w").alias("max"))


def exclusions(triples: DataFrame, k: int) -> DataFrame:
    """(head, relation, exclusions): the first k tails of each, in order; the asked tail may be among them."""
    first = F.row_number().over(Window.partitionBy("head", "relation").orderBy("tail"))
    few = triples.select("head", "relation", "tail").distinct().withColumn("_k", first).filter(F.col("_k") <= k)  # limited before a list is made
    return few.groupBy("head", "relation").agg(F.array_join(F.array_sort(F.collect_list("tail")), "; ").alias("exclusions"))


# Questions in plain English, the first whose key the relation holds.
TEMPLATES = (("located", "Where is {} located?"), ("citizen", "Which country is {} a citizen of?"), ("contain", "What does {} contain?"), ("placed", "Who placed {}?"))


def plain_question(relation: Column, head: Column) -> Column:
    out = F.concat(F.lit("What is the "), relation, F.lit(" of "), head, F.lit("?"))
    for key, text in reversed(TEMPLATES):
        a, b = text.split("{}")
        out = F.when(F.contains(F.lower(relation), F.lit(key)), F.concat(F.lit(a), head, F.lit(b))).otherwise(out)
    return out


def same_share(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("same_share"))
