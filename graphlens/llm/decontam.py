"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Each benchmark item gives windows of 13 consecutive words (an item of fewer words is one window).
Window hashes are broadcast when their number is within BROADCAST_WINDOWS, else Spark joins them by
shuffle; each document position hashes its own windows of all lengths in generated code, hits are
verified word by word, the hit positions are merged per document, and item ids (of any type) join last. Only DataFrame functions are used.

Defined results: null and empty texts have no words, no hits and are not contaminated; null item
ids name no item but their windows still hit; repeated document rows get the same result each;
an empty benchmark gives no hits, an empty table an empty result; documents of any length are scanned
whole; with_contamination() replaces columns that have the names of its results, decontaminate() keeps
every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import fresh, lower_ascii, materialize, read_table

WINDOW = 13
#: A document is contaminated if so many hit words, times this, reach its words.
SHARE = 20
#: Most windows that are broadcast (some 100 bytes each); a larger benchmark is joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; never null."""
    split = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.array_remove(split, "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(n, gram, item_id), distinct: the windows of each item with their length."""
    w = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    w = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return w.select("n", F.slice("w", F.col("at"), F.col("n")).alias("gram"), "item_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items) of the documents with a hit.

    Documents are read once: each position hashes the windows of all lengths that the benchmark has. Items meet
    windows only after the hits are known.
    """
    named = materialize(benchmark_windows(benchmark, window))
    grams = materialize(named.select("n", "gram").distinct())
    sizes = {r["n"]: r["c"] for r in grams.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most `window` rows
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    if not sizes:
        none = F.lit(0).cast("long")
        return docs.select("doc_id", F.xxhash64("text").alias("text_key"), none.alias("n_words"), none.alias("n_hit"), F.array().cast(_ids(benchmark)).alias("items")).limit(0)
    d = whole.select("doc_id", "text_key", "w", F.posexplode("w").alias("pos", "word"))
    hashed = lambda list_of, at, n: F.xxhash64(F.lit(n), *[F.get(list_of, at + k) for k in range(n)])
    each = F.array(*[F.when(F.col("pos") + n <= F.size("w"), F.struct(F.lit(n).alias("n"), hashed("w", F.col("pos"), n).alias("h"))) for n in sorted(sizes)])
    here = d.select("doc_id", "text_key", "w", "pos", F.explode(each).alias("x")).filter("x IS NOT NULL").select("doc_id", "text_key", "w", "pos", "x.n", "x.h")
    of_gram = F.coalesce(*[F.when(F.col("n") == n, hashed("gram", F.lit(0), n)) for n in sorted(sizes)])
    g = grams.select(of_gram.alias("gh"), "gram")
    if sum(sizes.values()) <= BROADCAST_WINDOWS:  # the text's words stay in the row's buffer, no row is copied
        hit = here.join(F.broadcast(g), F.col("h") == F.col("gh"))
    else:  # positions are shuffled with their hash only; what hits meets its text's words again
        at = here.drop("w").join(g, F.col("h") == F.col("gh")).select(F.col("doc_id").alias("at_doc"), F.col("text_key").alias("at_key"), "pos", "n", "gram")
        hit = whole.join(at, F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("text_key") == F.col("at_key")))
    hit = hit.filter(F.slice("w", F.col("pos") + 1, F.col("n")) == F.col("gram"))
    hit = materialize(hit.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), F.struct(F.col("pos").alias("s"), (F.col("pos") + F.col("n")).alias("e")).alias("span"), "n", "gram"))
    items = hit.select("doc_id", "text_key", "n", "gram").distinct().join(named.filter("item_id IS NOT NULL"), ["n", "gram"]).groupBy(F.col("doc_id").alias("i_doc"), F.col("text_key").alias("i_key")).agg(F.collect_set("item_id").alias("items"))
    per_doc = hit.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"))
    per_doc = per_doc.join(items, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("text_key") == F.col("i_key")), "left")
    per_doc = per_doc.withColumn("items", F.coalesce("items", F.array().cast(_ids(benchmark))))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["end"], x["s"].cast("long")))).alias("n"), F.greatest(a["end"], x["e"].cast("long")).alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    n_hit = F.aggregate(F.array_sort("spans"), zero, step, lambda a: a["n"])
    return per_doc.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), "items")


def _ids(benchmark: DataFrame) -> str:
    return f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"


def contaminated(n_hit: Column, n_words: Column, share: int) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def with_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Add n_words, n_hit, items and contaminated to documents; columns of these names are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "items", "contaminated")]
    h = hits(docs, benchmark, window)
    doc, key, text = (fresh(docs, c) for c in ("_doc", "_key", "_text"))
    h = h.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), "n_hit", "items")
    d = docs.select(*keep, F.xxhash64("text").alias(text), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = d.join(h, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(text) == F.col(key)), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast(_ids(benchmark)))
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), items.alias("items"), contaminated(n_hit, F.col("n_words"), share).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that are not contaminated, as they are, whatever their other columns are called."""
    doc, key = fresh(docs, "_doc"), fresh(docs, "_key")
    bad = hits(docs, benchmark, window).filter(contaminated(F.col("n_hit"), F.col("n_words"), share)).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_contamination(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT DISTINCT n FROM g),
x AS (SELECT rid, i, k.n, array_to_string(w[i:i + k.n - 1], ' ') AS gram FROM p JOIN k ON i + k.n - 1 <= len(w)),
h AS (SELECT rid, i, x.n, item_id FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""
