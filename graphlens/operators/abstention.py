"""Selective prediction: risk-coverage curves and abstention at a threshold. Columns: id, conf, correct (0 or 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.ordering import with_dense_offsets

POINTS = 50


def risk_coverage(df: DataFrame, points: int | None = POINTS) -> DataFrame:
    """(k, coverage, precision, risk) at about so many k, or at every k; rows by confidence, then id.

    Rows are sorted by range and numbered with the sums of the partitions before: neither one confidence nor the
    whole is one task.
    """
    n = df.agg(F.count("*")).first()[0]
    order = F.struct((-F.col("conf")).alias("c"), F.col("id").alias("i"))
    each = df.select("conf", "id", "correct", F.lit(1).alias("one")).withColumn("o", order)
    each = with_dense_offsets(each, F.col("o"), "one", "correct")
    each = each.select((F.col("before_one") + 1).alias("k"), (F.col("before_correct") + F.col("correct")).alias("hits"))
    if points is not None and n:
        m = min(points, n)
        at = sorted({int(1 + i * (n - 1) / (m - 1)) if m > 1 else 1 for i in range(m)})
        each = each.filter(F.col("k").isin(at))
    return each.select("k", (F.col("k") / F.lit(float(max(n, 1)))).alias("coverage"), (F.col("hits") / F.col("k")).alias("precision"), (1 - F.col("hits") / F.col("k")).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve by trapezoids, over the coverage it spans; at most POINTS rows."""
    w = Window.orderBy("coverage")
    c = curve.withColumns({"dc": F.col("coverage") - F.lag("coverage").over(w), "mid": (F.col("risk") + F.lag("risk").over(w)) / 2})
    span = F.max("coverage") - F.min("coverage")
    return c.agg(F.coalesce(F.try_divide(F.sum(F.col("dc") * F.col("mid")), span), F.max("risk")).alias("aurc"))


def coverage_at_precision(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(target, coverage, k): the most that can be answered at a precision; null if none, degenerate under 5 %."""
    cols = [F.max(F.when(F.col("precision") >= t, F.struct("coverage", "k"))).alias(f"t{i}") for i, t in enumerate(targets)]
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"t{i}.coverage").alias("coverage"), F.col(f"t{i}.k").alias("k")) for i, t in enumerate(targets)]))
    return curve.agg(*cols).select(rows.alias("x")).select("x.*").withColumn("degenerate", F.coalesce(F.col("coverage") < 0.05, F.lit(True)))


def precision_at_coverage(curve: DataFrame, coverage: float) -> DataFrame:
    at = F.min(F.struct(F.abs(F.col("coverage") - coverage).alias("d"), "k", "precision"))
    return curve.agg(at.alias("x")).select(F.lit(coverage).alias("coverage"), F.col("x.k").alias("k"), F.col("x.precision").alias("precision"))


def at_threshold(df: DataFrame, threshold: float) -> DataFrame:
    """What abstaining below a confidence does."""
    kept, right = F.col("conf") >= threshold, F.col("correct") == 1
    n = df.agg(F.count("*").alias("n"), F.count_if(kept).alias("answered"), F.count_if(kept & right).alias("answered_right"), F.count_if(right).alias("right"), F.count_if(~kept & ~right).alias("errors_avoided"), F.count_if(~kept & right).alias("right_withheld"))
    d = lambda a, b: F.try_divide(a, b)
    out = n.withColumns({"coverage": d("answered", "n"), "selective_accuracy": d("answered_right", "answered"), "forced_accuracy": d("right", "n"), "abstention_precision": d("errors_avoided", F.col("n") - F.col("answered"))})
    return out.withColumn("gain", F.col("selective_accuracy") - F.col("forced_accuracy"))
