"""Comparing arms and policies: (arm, qid, rank) or one accuracy for each arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_table(rows: DataFrame) -> DataFrame:
    """(condition, acc_real, acc_anon, floor) -> gap and the share of what is above chance that the names carry."""
    chance = F.coalesce("floor", F.lit(0.5))
    gap = F.col("acc_real") - F.col("acc_anon")
    return rows.filter(F.col("acc_real").isNotNull() & F.col("acc_anon").isNotNull()).select("condition", gap.alias("gap"), chance.alias("chance_level"), F.when(F.col("acc_real") > chance, gap / (F.col("acc_real") - chance)).alias("memorisation_share"))


def recovery(acc: Column, top: Column, bottom: Column) -> Column:
    """Share of the gap between two arms that a third recovers; null without a gap."""
    return F.when(top - bottom > 1e-9, (acc - bottom) / (top - bottom))


def mrr_by(ranks: DataFrame, *by: str) -> DataFrame:
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"))


def selection_ceiling(ranks: DataFrame) -> DataFrame:
    """(n, mrr, hits_1) of the best rank of each query over all policies: no router can do better."""
    best = ranks.groupBy("qid").agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= 1).cast("double")).alias("hits_1"))


def win_share(ranks: DataFrame) -> DataFrame:
    """(policy, wins, share): how often each policy is best; of equal ranks the first policy wins."""
    best = ranks.groupBy("qid").agg(F.min(F.struct("rank", "policy"))["policy"].alias("policy"))
    n = best.groupBy("policy").agg(F.count("*").alias("wins"))
    return n.withColumn("share", F.col("wins") / F.sum("wins").over(Window.partitionBy()))


def headroom(ranks: DataFrame, base: str) -> DataFrame:
    """(policy, mrr, recovered): the share of the ceiling's lead over the base policy that each policy recovers."""
    m = mrr_by(ranks, "policy")
    top = selection_ceiling(ranks).select(F.col("mrr").alias("top"))
    low = m.filter(F.col("policy") == base).select(F.col("mrr").alias("low"))
    return m.crossJoin(top).crossJoin(low).select("policy", "mrr", recovery(F.col("mrr"), F.col("top"), F.col("low")).alias("recovered"))  # one row each


def efficiency(ranks: DataFrame) -> DataFrame:
    """(policy, mrr, tokens, mrr_per_1k) of ranks that carry the tokens they spent."""
    e = ranks.groupBy("policy").agg(F.avg(1 / F.col("rank")).alias("mrr"), F.avg("tokens").alias("tokens"))
    return e.withColumn("mrr_per_1k", F.try_divide(F.col("mrr") * 1000, "tokens"))


def leaderboard(cells: DataFrame, base: str) -> DataFrame:
    """(policy, budget, mrr) -> place within the budget and lead over the base policy there."""
    w = Window.partitionBy("budget")
    own = F.max(F.when(F.col("policy") == base, F.col("mrr"))).over(w)
    return cells.withColumns({"place": F.row_number().over(w.orderBy(F.desc("mrr"), "policy")), "lead": F.col("mrr") - own})


def chance_mrr(n: Column) -> Column:
    """Mean reciprocal rank of a random order of n."""
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k) / n


def data_axis(points: DataFrame, share: float = 0.95) -> DataFrame:
    """(run, n, acc) -> the fewest rows that reach a share of what the most rows give."""
    last = points.groupBy("run").agg(F.max_by("acc", "n").alias("full"))
    return points.join(last, "run").filter(F.col("acc") >= share * F.col("full")).groupBy("run").agg(F.min("n").alias("enough"), F.max("full").alias("full"))
