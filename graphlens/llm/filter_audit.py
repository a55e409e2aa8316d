"""How five document filters interact: every order, every step, and Shapley values, by part of the corpus.

Each document gets the mask of the filters that it fails. For each part the number of documents that a
set S of filters removes is a multilinear polynomial in five 0/1 variables, formed from the mask counts:
    f(x) = sum over sets T of a_T * prod(x_i, i in T),   a_T = (-1)^(|T|+1) * sum of counts of masks that hold T.
Its corners say what is left after each step of an order. The Shapley value of filter i is the integral
of df/dx_i along the diagonal, that is the sum of a_T / |T| over the T that hold i, in exact rationals;
120 times that is the filter's removals summed over all orders.

Filter E (a text that a smaller doc_id has as well) needs no join: texts meet by their sha256 in partial
aggregates, and of a group only the rows of its smallest doc_id pass, so copies are counted and never paired.

Defined results: a null text is the empty text; a null lang is the part ''; a null doc_id has no order,
so it neither fails E nor makes another fail; repeated rows count each, and rows of one doc_id and text
pass E together; several labels of a doc_id count as set if any is; an empty table gives no rows; texts
of any length are whole; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import materialize, read_table

FILTERS = "ABCDE"
#: Most labels that are broadcast (some 16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Failure of A: under so many words; of B: under so many percent of words distinct; of C: over so many percent of characters in A-Z.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def words(text: Column) -> Column:
    """The runs of characters other than \\x20 and \\x09-\\x0D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for the conditions A to D that the text fails."""
    w = words(text)
    a = F.size(w) < LEAST_WORDS
    b = 100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w)
    c = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long")
    d = text.rlike("[#$%&*|]")
    return sum(((x.cast("int") * (1 << i)) for i, x in enumerate((a, b, c, d))), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang) and (doc_id, quality, toxic) -> (part, mask, n, good, toxic), bit 4 of the mask for E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = materialize(labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).filter("doc_id IS NOT NULL AND (good OR toxic)"))
    if marks.count() <= BROADCAST_LABELS:
        rows = rows.join(F.broadcast(marks), "doc_id", "left")
    else:  # rows without doc_id match nothing and are spread
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
        rows = rows.withColumn("_s", spread).join(marks.withColumn("_s", F.lit(0).cast("long")), ["doc_id", "_s"], "left")
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    # a text's rows by part and labels, with the smallest doc_id and the number of rows that it has
    first = F.min(F.struct("doc_id", "n"))
    copies = rows.filter("doc_id IS NOT NULL").groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"))
    kind = F.struct("part", "good", "toxic", "n", F.col("first.doc_id").alias("least"), F.col("first.n").alias("at_least"))
    texts = copies.groupBy("digest", "mask").agg(F.min("first.doc_id").alias("least"), F.collect_list(kind).alias("kinds"))  # one row a part and label
    kinds = texts.select("mask", "least", F.explode("kinds").alias("x"))
    passing = F.when(F.col("x.least") == F.col("least"), F.col("x.at_least")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("x.n") - passing).alias("n"))))
    counted = kinds.select("x.part", "x.good", "x.toxic", both.alias("y")).select("part", "good", "toxic", "y.mask", "y.n")
    counted = counted.unionByName(rows.filter("doc_id IS NULL").select("part", "good", "toxic", "mask", "n"))
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def polynomial(counts: dict[int, int], size: int) -> dict[int, int]:
    """Coefficients a_T of the removal polynomial by the set T, a bit mask; counts by mask of failed filters."""
    return {t: (1 if t.bit_count() % 2 else -1) * sum(n for m, n in counts.items() if m & t == t) for t in range(1, 1 << size)}


def corner(poly: dict[int, int], chosen: int) -> int:
    """The value where the chosen variables are 1 and the others 0: what these filters remove."""
    return sum(a for t, a in poly.items() if t & chosen == t)


def shapley(poly: dict[int, int], i: int) -> Fraction:
    """The integral of the derivative by variable i along the diagonal."""
    return sum((Fraction(a, t.bit_count()) for t, a in poly.items() if t >> i & 1), Fraction(0))


def audit_rows(part: str, counts: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """All orders and steps of one part from its mask counts (at most 2^filters rows)."""
    size, total = len(filters), int(counts["n"].sum())
    removed, good, toxic = (polynomial(dict(zip(counts["mask"].tolist(), counts[c].tolist(), strict=True)), size) for c in ("n", "good", "toxic"))
    every = (1 << size) - 1
    corners = {s: [corner(p, s) for p in (removed, good, toxic)] for s in range(1 << size)}
    values = [shapley(removed, i) * factorial(size) for i in range(size)]
    assert all(v.denominator == 1 for v in values)
    out = []
    for order in permutations(range(size)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here, good_lost, toxic_lost = (y - x for x, y in zip(corners[before], corners[after], strict=True))
            unique = corners[every][0] - corners[every ^ 1 << i][0]
            out.append((part, "".join(filters[j] for j in order), step, total - corners[after][0], here, corners[1 << i][0] - here, unique, good_lost, toxic_lost, int(values[i])))
            before = after
    return pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    return mask_counts(docs, labels).groupBy("part").applyInPandas(lambda key, counts: audit_rows(key[0], counts), AUDIT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def _orders_sql() -> str:
    """A table of all orders of the filters."""
    return ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))


#: The masks by plain conditions and one scan for each step of each order; no polynomials.
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
  + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own, list_sum([1 << (ascii(x) - 65) for x in string_split(filter_order[1:step - 1], '') if x <> '']) AS before
  FROM (VALUES {_orders_sql()}) v(filter_order), (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT c.part, o.filter_order, CAST(o.step AS INT) AS step, ascii(o.filter_order[o.step]) AS f,
  sum(n) FILTER (mask & (coalesce(before, 0)::INT | own) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & coalesce(before, 0)::INT = 0) AS removed,
  sum(n) FILTER (mask & own > 0 AND mask & coalesce(before, 0)::INT > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
  sum(good) FILTER (mask & own > 0 AND mask & coalesce(before, 0)::INT = 0) AS good_lost, sum(toxic) FILTER (mask & own > 0 AND mask & coalesce(before, 0)::INT = 0) AS toxic_lost
  FROM c, o GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM s
"""
