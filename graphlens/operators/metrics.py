"""Metrics of scored binary predictions. Columns: label (1 or -1), p_yes; groups may be given by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.ordering import with_dense_offsets
from graphlens.functions.text import CATEGORIES, category

#: Bin edges, ten equal steps as doubles of a running product.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)
EVEN_EDGES = tuple(i / 10 for i in range(11))


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def confusion(scored: DataFrame, *by: str, threshold: float = 0.5, strict: bool = False, empty=0.0) -> DataFrame:
    """tp, fp, tn, fn and what follows; ratios over nothing are `empty` (None keeps them null)."""
    said = F.col("p_yes") > threshold if strict else F.col("p_yes") >= threshold
    true = F.col("label") == 1
    c = scored.groupBy(*by).agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumns({
        "n": tp + fp + tn + fn,
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, empty),
        "precision": ratio(tp, tp + fp, empty),
        "recall": ratio(tp, tp + fn, empty),
        "neg_precision": ratio(tn, tn + fn, empty),
        "neg_recall": ratio(tn, tn + fp, empty),
    })
    f1 = lambda p, r: ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r), empty)
    c = c.withColumns({"f1": f1("precision", "recall"), "neg_f1": f1("neg_precision", "neg_recall")})
    return c.withColumns({"macro_f1": (F.col("f1") + F.col("neg_f1")) / 2, "balanced_accuracy": (F.col("recall") + F.col("neg_recall")) / 2, "positive_rate": ratio(tp + fp, F.col("n"), empty)})


def majority_baseline(scored: DataFrame, *by: str, degenerate: float = 0.95) -> DataFrame:
    """Share of the larger class, share of answers of one kind, and whether nearly all answers are the same."""
    said = (F.col("p_yes") >= 0.5).cast("double")
    out = scored.groupBy(*by).agg(F.avg((F.col("label") == 1).cast("double")).alias("pos"), F.avg(said).alias("said_yes"))
    return out.select(*by, F.greatest(F.col("pos"), 1 - F.col("pos")).alias("majority"), "said_yes", (F.greatest(F.col("said_yes"), 1 - F.col("said_yes")) > degenerate).alias("degenerate"))


def accuracy_by(scored: DataFrame, by: str, least: int = 20) -> DataFrame:
    """Accuracy of each group of so many rows, with the best, the worst and their spread."""
    acc = scored.groupBy(by).agg(F.count("*").alias("n"), F.avg(((F.col("p_yes") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("accuracy")).filter(F.col("n") >= least)
    return acc.agg(F.count("*").alias("n_groups"), F.min_by(by, F.struct("accuracy", by)).alias("worst"), F.max_by(by, F.struct("accuracy", by)).alias("best"), (F.max("accuracy") - F.min("accuracy")).alias("spread"))


def class_confusion(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """(class, support, predicted, correct, precision, recall, f1) for every class seen on either side."""
    n = pairs.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.struct(F.col("gold").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))))
    c = n.select(both.alias("x"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    c = c.groupBy(F.col("x.class").alias("class")).agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("correct"))
    c = c.withColumns({"precision": ratio(F.col("correct"), F.col("predicted"), 0.0), "recall": ratio(F.col("correct"), F.col("support"), 0.0)})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def bins(edges=EDGES) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def bin_of(conf: Column, edges=EDGES) -> Column:
    """Number of the bin, closed to the right; the first is closed on both sides."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (conf > edges[i]) & (conf <= edges[i + 1])
        out = F.when(inside | (conf == edges[0]) if i == 0 else inside, i).otherwise(out)
    return out


def reliability(df: DataFrame, conf: str, correct: str, *by: str, edges=EDGES) -> DataFrame:
    """(bin, n, conf, acc) of the bins that have rows."""
    return df.withColumn("bin", bin_of(F.col(conf), edges)).filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(conf).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))


def calibration_error(df: DataFrame, conf: str, correct: str, *by: str, edges=EDGES) -> DataFrame:
    """Expected and largest calibration error, and the Brier score."""
    gap = F.abs(F.col("acc") - F.col("conf"))
    r = reliability(df, conf, correct, *by, edges=edges)
    e = r.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    brier = df.groupBy(*by).agg(F.avg(F.pow(F.col(conf) - F.col(correct).cast("double"), F.lit(2))).alias("brier"))
    return e.join(brier, list(by)) if by else e.crossJoin(brier)  # one row each


def subtotals(df: DataFrame, first: str, second: str, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """(first, second, level, n, accuracy, conf) by both columns, by each, and overall, from one scan.

    level is the grouping id: 0 for both, 1 for the first alone, 2 for the second alone, 3 overall; `all` stands
    for what a row sums over, and a null value is its own group.
    """
    g = df.groupingSets([[F.col(first), F.col(second)], [F.col(first)], [F.col(second)], []], F.col(first), F.col(second))
    g = g.agg(F.grouping_id().alias("level"), F.grouping(first).alias("_a"), F.grouping(second).alias("_b"), F.count("*").alias("n"), F.avg(correct).alias("accuracy"), F.avg(conf).alias("conf"))
    name = lambda c, flag: F.when(F.col(flag) == 1, "all").otherwise(F.col(c)).alias(c)
    return g.select(name(first, "_a"), name(second, "_b"), "level", "n", "accuracy", "conf")


def calibration_subtotals(df: DataFrame, conf: str, correct: str, by: str, least: int, edges=EDGES) -> DataFrame:
    """(by, n, ece, mce, brier) of each group of at least so many rows, and of all rows (`all`), from one scan.

    Rows are summed by group and bin, and by bin alone, with grouping sets; the rest works on these few sums.
    """
    hit = F.col(correct).cast("double")
    binned = df.withColumn("bin", bin_of(F.col(conf), edges)).withColumns({"_hit": hit, "_gap": F.pow(F.col(conf) - hit, F.lit(2))})
    g = binned.groupingSets([[F.col(by), F.col("bin")], [F.col("bin")]], F.col(by), F.col("bin"))
    g = g.agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), F.sum(conf).alias("c"), F.sum("_hit").alias("h"), F.sum("_gap").alias("q"))
    gap = F.abs(F.col("h") - F.col("c")) / F.col("n")
    name = F.when(F.col("_all") == 1, "all").otherwise(F.col(by))
    inside = F.col("bin").isNotNull()
    out = g.groupBy(name.alias(by), "_all").agg(F.sum("n").alias("n"), (F.sum(F.when(inside, F.col("n") * gap)) / F.sum(F.when(inside, F.col("n")))).alias("ece"), F.max(F.when(inside, gap)).alias("mce"), (F.sum("q") / F.sum("n")).alias("brier"))
    return out.filter((F.col("_all") == 1) | (F.col("n") >= least)).drop("_all")


def temperature(df: DataFrame, conf: str, correct: str, grid: list[float]) -> DataFrame:
    """(temperature, nll): the temperature on the grid with the least mean negative log likelihood, the first on ties.

    All temperatures are summed in one pass over the rows, one aggregate each.
    """
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(conf)))
    logit = F.log(p / (1 - p))

    def nll(t: float) -> Column:
        q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-logit / t))))
        return F.avg(-F.when(F.col(correct) == 1, F.log(q)).otherwise(F.log(1 - q)))

    sums = df.agg(*[nll(t).alias(f"t{i}") for i, t in enumerate(grid)])
    every = F.array(*[F.struct(F.col(f"t{i}").alias("nll"), F.lit(t).alias("temperature")) for i, t in enumerate(grid)])
    return sums.select(F.array_min(every).alias("x")).select("x.temperature", "x.nll")


def auc(scored: DataFrame, score: str = "p_yes", *by: str) -> DataFrame:
    """Area under the curve by tie-averaged ranks; null for one class. Ties are summed before they are ranked."""
    g = scored.groupBy(*by, score).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    if by:
        below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        g = g.withColumn("below", below)
    else:
        g = with_dense_offsets(g, F.asc(score), "q", name="below")
    s = g.withColumn("won", F.col("p") * (F.col("below") + F.col("q") / 2.0)).groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return s.select(*by, "n_pos", "n_neg", F.try_divide("won", F.col("n_pos") * F.col("n_neg")).alias("auc"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The score that, as a threshold, gives the best balanced accuracy; ties stay together, the highest wins."""
    g = scored.groupBy("p_yes").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    total = g.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    g = with_dense_offsets(g, F.desc("p_yes"), "p", "q")
    share = lambda c: F.try_divide(F.col(f"before_{c}") + F.col(c), F.lit(total[c]))
    g = g.withColumn("balanced", (share("p") + 1 - share("q")) / 2)
    return g.agg(F.max(F.struct("balanced", "p_yes")).alias("x")).select(F.col("x.p_yes").alias("threshold"), F.col("x.balanced").alias("balanced_accuracy"))


def response_breakdown(answers: DataFrame, text: str) -> DataFrame:
    """(category, n, rate) for all categories, those without answers too."""
    n = answers.groupBy(category(F.col(text)).alias("category")).agg(F.count("*").alias("n"))
    every = answers.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    out = every.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return out.withColumn("rate", ratio(F.col("n"), F.sum("n").over(Window.partitionBy()), 0.0))


def parser_accuracy(answers: DataFrame, verdict: Column, unparseable_as: int | None = None) -> DataFrame:
    v = verdict if unparseable_as is None else F.coalesce(verdict, F.lit(unparseable_as))
    return answers.agg(F.count("*").alias("n"), F.count_if(verdict.isNull()).alias("unparseable"), F.avg(F.coalesce(v == F.col("gold"), F.lit(False)).cast("double")).alias("accuracy"))


def decomposition(arms: DataFrame) -> DataFrame:
    """From (arm, accuracy) of arms real, permuted, anonymised and chance: what of the whole is memory, what is left."""
    a = arms.groupBy().pivot("arm", ["real", "permuted", "anonymised", "chance"]).agg(F.first("accuracy"))
    return a.withColumns({"above_chance": F.col("real") - F.col("chance"), "memory": F.col("real") - F.col("permuted"), "residual": F.col("anonymised") - F.col("chance")}).withColumn("memory_share", F.try_divide("memory", "above_chance"))


def sampled_agreement(samples: DataFrame) -> DataFrame:
    """(qid, sample_idx, text) -> agreement, distinct answers, normalised entropy and the mode (first seen on ties)."""
    n = samples.groupBy("qid", "text").agg(F.count("*").alias("n"), F.min("sample_idx").alias("first"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("qid"))
    g = n.withColumn("p", p).groupBy("qid").agg(F.max(F.struct(F.col("n").alias("n"), (-F.col("first")).alias("f"), "text"))["text"].alias("mode"), F.max("p").alias("agreement"), F.count("*").alias("n_distinct"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return g.select("qid", "mode", "agreement", (1 - F.col("agreement")).alias("disagreement"), "n_distinct", F.when(F.col("n_distinct") > 1, F.col("h") / F.log2("n_distinct")).otherwise(0.0).alias("entropy"))


def fit_diagnosis(curve: DataFrame) -> DataFrame:
    """(run, step, loss) -> first, last and least loss, the step of the least, and a verdict."""
    d = curve.groupBy("run").agg(F.min_by("loss", "step").alias("first"), F.max_by("loss", "step").alias("last"), F.min("loss").alias("least"), F.min_by("step", F.struct("loss", "step")).alias("best_step"), F.max("step").alias("last_step"))
    verdict = F.when(F.col("last") > F.col("least") * 1.1, "overfit").when(F.col("last") > F.col("first") * 0.95, "underfit").otherwise("good")
    return d.withColumn("verdict", verdict)


def perplexity(df: DataFrame, nll: str, weight: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.exp(F.sum(F.col(nll) * F.col(weight)) / F.sum(weight)).alias("perplexity"))
