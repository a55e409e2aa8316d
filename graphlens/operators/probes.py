"""What vectors say about labels: sliced mutual information and a logistic probe."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.hashing import det_number
from graphlens.functions.ordering import checkpointed, with_dense_index


def normal(seed: str, *parts: Column) -> Column:
    """A normal number drawn by hash: Box and Muller's from two uniform numbers of four places."""
    u = lambda x: (det_number(f"{seed}-{x}", *parts) % 10000 + F.lit(0.5)) / F.lit(10000.0)
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(F.lit(2 * math.pi) * u("b"))


def moments(vectors: DataFrame) -> DataFrame:
    """(dim, mean, sd) of each component, sd of the population."""
    x = vectors.select(F.posexplode("vector").alias("dim", "x"))
    return x.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def projections(vectors: DataFrame, directions: int, seed: str = "dir") -> DataFrame:
    """(id, label, direction, p): standardised vectors on unit directions that a hash draws.

    Standardising is folded into the directions, one row a direction, so vectors are read twice and never exploded with their components.
    """
    m = checkpointed(moments(vectors))
    d = m.select("dim", "mean", "sd", F.explode(F.sequence(F.lit(0), F.lit(directions - 1))).alias("direction"))
    d = d.withColumn("u", normal(seed, F.col("direction").cast("string"), F.col("dim").cast("string")))
    d = d.withColumn("u", F.col("u") / F.sqrt(F.sum(F.col("u") * F.col("u")).over(Window.partitionBy("direction")))).withColumn("w", F.col("u") / (F.col("sd") + 1e-8))
    rows = d.groupBy("direction").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "w"))), lambda x: x["w"]).alias("w"), F.sum(F.col("w") * F.col("mean")).alias("c"))
    table = rows.agg(F.collect_list(F.struct("direction", "w", "c")).alias("ds"))  # directions x components numbers
    j = vectors.crossJoin(F.broadcast(table)).select("id", "label", "vector", F.explode("ds").alias("d"))
    dot = F.aggregate(F.zip_with("vector", "d.w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return j.select("id", "label", F.col("d.direction").alias("direction"), F.round(dot - F.col("d.c"), 9).alias("p"))


def sliced_information(vectors: DataFrame, directions: int = 128, bins: int = 10, seed: str = "dir") -> DataFrame:
    """(smi, sd, p95, n, directions): mutual information in nats of a label and each projection, over random directions.

    vectors: (id, label, vector of doubles, all of one length). A projection is cut into `bins` of equal
    numbers of rows; all projections are ordered together by range partitions. Rows with a null are left out.
    """
    vectors = vectors.filter("label IS NOT NULL AND vector IS NOT NULL")
    n = vectors.count()
    at = with_dense_index(projections(vectors, directions, seed), "direction", "p", "id")
    cell = at.withColumn("bin", F.floor((F.col("idx") - F.col("direction") * n) * bins / F.lit(max(n, 1))))
    c = checkpointed(cell.groupBy("direction", "bin", "label").agg(F.count("*").alias("m")))  # directions x bins x labels
    b = c.groupBy("direction", "bin").agg(F.sum("m").alias("b"))
    y = c.filter("direction = 0").groupBy("label").agg(F.sum("m").alias("y"))
    j = c.join(b, ["direction", "bin"]).join(y, "label")
    mi = j.groupBy("direction").agg(F.greatest(F.lit(0.0), F.sum(F.col("m") / F.lit(n) * F.log(F.col("m") * F.lit(float(n)) / (F.col("b") * F.col("y"))))).alias("mi"))
    return mi.agg(F.avg("mi").alias("smi"), F.stddev_pop("mi").alias("sd"), F.percentile("mi", F.lit(0.95)).alias("p95"), F.lit(n).cast("long").alias("n"), F.count("*").alias("directions"))


def _sums(beta: list[float]):
    """Partial sums of a Newton step over a partition: the gradient and the weighted products of all pairs of components."""

    def run(batches):
        b, total = np.array(beta), None
        for x in batches:
            if len(x):
                a = np.column_stack([np.stack(x["vector"].to_numpy()).astype(float), np.ones(len(x))])
                p = 1 / (1 + np.exp(-(a @ b)))
                part = np.concatenate([a.T @ (x["y"].to_numpy(float) - p), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total)), "v": total})

    return run


def logistic(vectors: DataFrame, ridge: float = 1.0, rounds: int = 8) -> list[float]:
    """Weights of the components, then of the constant, of a logistic model with labels 0 and 1 in `y`, by Newton's method.

    Each round every task sends one gradient and one matrix of weighted products, which partial aggregates
    add; the driver solves a system of as many equations as components. All weights but the constant are
    held by the ridge. An empty table gives weights of 0 for no component.
    """
    size = vectors.agg(F.max(F.size("vector"))).first()[0]
    if not size:
        return [0.0]
    k = size + 1
    beta = np.zeros(k)
    hold = np.full(k, ridge)
    hold[-1] = 1e-9
    for _ in range(rounds):
        sums = vectors.select("vector", "y").mapInPandas(_sums(beta.tolist()), "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
        flat = np.zeros(k + k * k)
        for at, v in sums.collect():  # components squared
            flat[at] = v
        beta = beta + np.linalg.solve(flat[k:].reshape(k, k) + np.diag(hold), flat[:k] - hold * beta)
    return beta.tolist()


def logistic_score(vector: Column, beta: list[float]) -> Column:
    """P(y = 1) of a vector under the weights."""
    dot = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(b)) for b in beta[:-1]]), lambda a, b: a * b), F.lit(float(beta[-1])), lambda a, x: a + x)
    return 1 / (1 + F.exp(-dot))
