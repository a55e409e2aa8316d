"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from bounded samples of labelled documents (DICT_DOCS per label, a piece
of PIECE bytes of each). A text is cut into pieces of PIECE bytes, all pieces are compressed with
both dictionaries, and the normalised difference of the two sizes becomes a probability by logistic
regression on a second, disjoint sample (CALIBRATION_DOCS per label).

Defined results: null and empty texts have no size difference and get the score of that point; with
labels of one kind only, or none, every score is the share of label 1 (0.5 without labels);
several labels of one document count as their largest; repeated rows get the same result each; texts
of any length are compressed whole; an empty table gives an empty result; with_quality() replaces
columns named score and predicted, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import discard, doc_part, extended, fraction, materialize, read_table

PIECE = 2048
DICT_DOCS = 2000
CALIBRATION_DOCS = 2000
DICT_BYTES = 112 * 1024
LEVEL = 3
SEED = "quality:"


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; where there is too little to train one, the samples themselves."""
    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return whole[-size:]


def compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in dictionaries:
        data = zstandard.ZstdCompressionDict(d)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def features(text: str | None, both: list[zstandard.ZstdCompressor]) -> list[float]:
    """The size difference over the sum of both sizes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    good = bad = 0
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        good += len(both[0].compress(piece))
        bad += len(both[1].compress(piece))
    return [(bad - good) / (bad + good) if good + bad else 0.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights [bias, ...] by Newton's method on standardised columns, folded back to raw columns."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / sd], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    raw = w[1:] / sd
    return np.concatenate([[w[0] - raw @ mean], raw])


def labelled(docs: DataFrame, labels: DataFrame, most: int = DICT_DOCS + CALIBRATION_DOCS) -> DataFrame:
    """(text, quality, draw, part) of the bounded samples: part 0 for dictionaries, 1 for calibration."""
    lab = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    lab = lab.filter(doc_part(F.col("doc_id"), 3) != 1)
    lab = lab.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("draw", fraction(F.lit(SEED), F.col("doc_id").cast("string")))
    lab = materialize(lab)
    # a label's rows are thinned by the same hash to about twice the number before they are ordered, so that no label is one large task
    share = lab.groupBy(F.col("quality").alias("_q")).agg((F.lit(2.0 * most) / F.count("*")).alias("share"))
    lab = lab.join(F.broadcast(share), F.col("quality") == F.col("_q")).filter(F.col("draw") < F.col("share"))  # two rows
    lab = lab.select("doc_id", "quality", "draw", F.row_number().over(Window.partitionBy("quality").orderBy("draw", "doc_id")).alias("n"))
    lab = lab.filter(F.col("n") <= most).withColumn("part", (F.col("n") % 2).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("text", "quality", "draw", "part")  # at most two samples per label


def train(docs: DataFrame, labels: DataFrame) -> tuple[tuple[bytes, bytes] | None, np.ndarray]:
    """(dictionaries, calibration weights); no dictionaries and a single bias where one label is missing."""
    sc = docs.sparkSession.sparkContext
    rows = materialize(labelled(docs, labels))
    at = (F.floor(F.col("draw") * F.greatest(F.length("text") - PIECE, F.lit(0))) + 1).cast("int")
    pieces = rows.filter("part = 0 AND text IS NOT NULL").select("quality", F.substr("text", at, F.lit(PIECE)).alias("t")).collect()
    samples = [sorted(r["t"].encode("utf-8", "surrogatepass")[:PIECE] for r in pieces if r["quality"] == q and r["t"]) for q in (1, 0)]
    counts = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not all(samples):
        discard(rows)
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return None, np.array([np.log(share / (1 - share))])
    dictionaries = (build_dictionary(samples[0]), build_dictionary(samples[1]))
    shared = sc.broadcast(dictionaries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = compressors(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), pa.array([features(t, both) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=["quality", "x"])

    got = rows.filter("part = 1").select("quality", "text").mapInArrow(measure, "quality int, x array<double>").collect()
    got = got or rows.select("quality", "text").mapInArrow(measure, "quality int, x array<double>").collect()
    discard(rows)
    got.sort()
    return dictionaries, fit_logistic(np.array([r["x"] for r in got]), np.array([r["quality"] for r in got], float))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add score and predicted to documents."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    out = docs.select(*keep)
    schema = extended(out, "score double, predicted int")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries, w = model.value
        both = compressors(dictionaries) if dictionaries else []
        for b in batches:
            texts = b.column("text").to_pylist()
            x = np.array([features(t, both) for t in texts]).reshape(len(texts), -1) if both else np.zeros((len(texts), 0))
            score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return out.mapInArrow(predict, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_quality(docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", (doc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
