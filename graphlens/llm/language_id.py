"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams of lower-cased text are summed in Spark over a bounded sample of
labelled documents (TRAIN_DOCS per language, chosen by hash); the log-probability matrix is
broadcast (languages x BUCKETS doubles) and whole texts are scored in numpy, as sparse batches of
grams; long texts in pieces of CHUNK characters that overlap, so that memory stays bounded and no gram
is lost (letters are lower-cased within a piece).

Defined results: a text that is null or has no letter is `und` with score 0; rows without a
language are not learned from; without any labelled row every text is `und`; repeated rows get the
same result each; an empty table gives an empty result; ties go to the language that sorts first;
with_language() replaces columns that have the names of its results, reject() keeps every column.
More than MAX_LANGUAGES labels are refused, as the matrix is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import doc_part, extended, fraction, fresh, read_table

BITS = 15
BUCKETS = 1 << BITS
#: Most documents a language is learned from.
TRAIN_DOCS = 2000
#: Most languages: the matrix has 8 * BUCKETS bytes for each.
MAX_LANGUAGES = 1000
SMOOTHING = 0.5
CHUNK = 1 << 20
UNDETERMINED = "und"
#: Documents below this score are rejected by reject().
MIN_SCORE = 0.5
LETTER = re.compile(r"[^\W\d_]")
GAP = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Bucket of the 2-gram and of the 3-gram at each character but the last two."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    pair = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B)
    three = (pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    pair = pair * np.uint32(0x165667B1)
    shift = np.uint32(32 - BITS)
    return np.concatenate([pair >> shift, (three ^ (three >> np.uint32(13))) * np.uint32(0x9E3779B1) >> shift])


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The normalised text between a space and two spaces, runs of other characters being one space, in pieces
    that overlap by two characters: their grams are those of the whole."""
    carry = " "
    for at in range(0, len(text), chunk):
        part = GAP.sub(" ", text[at : at + chunk].lower())
        if at and carry[-1] == " " and part.startswith(" "):
            part = part[1:]
        piece = carry + part
        if len(piece) > 2:
            yield piece
        carry = piece[-2:]
    yield carry + "  "


def training_docs(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """At most so many labelled documents of each language, outside the held-out part."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (doc_part(F.col("doc_id"), 3) != 1))
    draw = fraction(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = Window.partitionBy("lang").orderBy("draw", "doc_id")
    # a language's rows are thinned by the same hash to about twice the number before they are ordered, so that no language is one large task
    share = known.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count("*")).alias("share")).withColumnRenamed("lang", "_lang")
    ids = known.select("doc_id", "lang", draw.alias("draw")).join(F.broadcast(share), F.col("lang") == F.col("_lang")).filter(F.col("draw") < F.col("share"))  # one row a language
    ids = ids.select("doc_id", "lang", "draw").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language)
    chosen = ids.select("doc_id").distinct()  # bounded by per_language and the number of languages
    return known.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")


def known_languages(docs: DataFrame) -> int:
    return docs.select("lang").filter(F.col("lang").isNotNull()).distinct().limit(MAX_LANGUAGES + 1).count()


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bucket] with the log prior in the last column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                s[BUCKETS] += 1
                for piece in pieces(text):
                    s[:BUCKETS] += np.bincount(grams(piece), minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(s[at])], names=["lang", "bucket", "n"])

    if known_languages(docs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = training_docs(docs).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + 1))
    table[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), counts["bucket"].to_numpy(dtype=int)] = counts["n"]
    prior = np.log(table[:, BUCKETS:] / max(table[:, BUCKETS].sum(), 1)) if langs else table[:, BUCKETS:]
    smooth = table[:, :BUCKETS] + SMOOTHING
    return langs, np.concatenate([np.log(smooth / smooth.sum(axis=1, keepdims=True)), prior], axis=1)


def score_texts(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], list[float]]:
    """Predictions of a batch: the grams of many texts, sparse rows of counts, times the matrix of log probabilities."""
    known = [bool(langs and t and LETTER.search(t)) for t in texts]
    total = np.tile(model[:, BUCKETS], (len(texts), 1))
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        size = 0
        if held:
            g = np.concatenate(held)
            owner = np.repeat(owners, [len(x) for x in held])
            for k in range(len(langs)):
                total[:, k] += np.bincount(owner, weights=np.take(model[k], g), minlength=len(texts))
            held.clear()
            owners.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text) if known[i] else ():
            held.append(grams(piece))
            owners.append(i)
            size += len(held[-1])
            if size > 2 * CHUNK:
                flush()
    flush()
    best = total.argmax(axis=1) if langs else np.zeros(len(texts), int)
    pred = [langs[b] if k else UNDETERMINED for k, b in zip(known, best.tolist(), strict=True)]
    score = [float(1.0 / np.exp(t - t[b]).sum()) if k else 0.0 for k, b, t in zip(known, best.tolist(), total, strict=True)]
    return pred, score


def with_language(docs: DataFrame, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability to documents, learning from their own labels; columns of these names are replaced."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    model = spark.sparkContext.broadcast(train(docs))
    out = docs.select(*keep)
    schema = extended(out, f"`{pred}` string, `{score}` double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for b in batches:
            said, p = score_texts(b.column("text").to_pylist(), langs, table)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(p, pa.float64())], names=[*b.schema.names, pred, score])

    return out.mapInArrow(predict, schema)


def reject(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a known language, as they are, whatever their other columns are called."""
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return with_language(docs, pred, score).filter((F.col(pred) != UNDETERMINED) & (F.col(score) >= min_score)).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return with_language(docs).select("doc_id", (doc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
