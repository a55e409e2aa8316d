"""Reports over runs: decompositions, calibration before and after, verdicts, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions.ordering import with_dense_index
from graphlens.functions.text import lenient_verdict
from graphlens.operators import abstention, metrics

#: The spread of a 0/1 outcome and the factor for 80 % power, when only n is known.
POWER_FACTOR, USUAL_SD = 2.8, 0.30


def scaled(conf: Column, temperature: float) -> Column:
    """A confidence after its logit is divided by a temperature."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), conf))
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / temperature))


def calibration_report(df: DataFrame, conf: str, correct: str, temperature: float) -> DataFrame:
    """(method, ece, mce, brier, best, too_confident): the raw confidence, scaled by a temperature, and a constant one."""
    mean = df.agg(F.avg(F.col(correct).cast("double"))).first()[0]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.alias("c")) for m, c in (("raw", F.col(conf)), ("temperature", scaled(F.col(conf), temperature)), ("constant", F.lit(mean).cast("double")))]))
    long = df.select(F.col(correct).alias("correct"), rows.alias("x")).select("correct", "x.*")
    e = metrics.calibration_error(long, "c", "correct", "method")
    over = long.groupBy("method").agg((F.avg("c") > F.avg(F.col("correct").cast("double"))).alias("too_confident"))
    first = F.row_number().over(Window.orderBy("ece", "method")) == 1  # three rows
    return e.join(over, "method").withColumn("best", first)


def source_ranks(df: DataFrame, sources: dict[str, Column], correct: str) -> DataFrame:
    """(source, ece, brier, auc, place): confidence sources by calibration error."""
    long = df.select(F.col(correct).alias("correct"), F.when(F.col(correct) == 1, 1).otherwise(-1).alias("label"), F.explode(F.array(*[F.struct(F.lit(n).alias("source"), c.alias("c")) for n, c in sources.items()])).alias("x")).select("correct", "label", "x.*")
    e = metrics.calibration_error(long, "c", "correct", "source").join(metrics.auc(long, "c", "source").select("source", "auc"), "source")
    return e.drop("mce").withColumn("place", F.row_number().over(Window.orderBy("ece", "source")))  # one row a source


def interval_verdict(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "better").when(hi < 0, "worse").otherwise("indistinguishable")


def detectable_from_n(n: Column) -> Column:
    return POWER_FACTOR * USUAL_SD / F.sqrt(n)


def relative_change(now: Column, before: Column) -> Column:
    """Up or down by more than a tenth, or flat; null without a base."""
    change = F.try_divide(now - before, F.abs(before))
    return F.when(change > 0.1, "up").when(change < -0.1, "down").when(change.isNotNull(), "flat")


def abstention_report(df: DataFrame, targets: list[float]) -> DataFrame:
    """Coverage at each target precision, why a target is not reached, and the target that makes the headline."""
    curve = abstention.risk_coverage(df)
    r = abstention.coverage_at_precision(curve, targets)
    top = curve.agg(F.max("precision")).first()[0]
    reason = F.when(F.col("coverage").isNull(), F.when(F.lit(top) < F.col("target"), "precision never reached").otherwise("between points")).when(F.col("degenerate"), "too few answers").otherwise("reached")
    r = r.withColumn("reason", reason)
    best = r.filter("reason = 'reached'").agg(F.max("target")).first()[0]
    return r.withColumn("headline", F.coalesce(F.col("target") == F.lit(best), F.lit(False)))


def mrr_terms(ranks: DataFrame) -> DataFrame:
    """From (arm, rank, n_way) of arms real, permuted and anonymised: what names, bindings and the rest add to chance."""
    m = ranks.groupBy().pivot("arm", ["real", "permuted", "anonymised"]).agg(F.avg(1 / F.col("rank")))
    chance = ranks.agg(F.avg(F.aggregate(F.sequence(F.lit(1), F.col("n_way").cast("int")), F.lit(0.0), lambda a, i: a + 1 / i) / F.col("n_way")).alias("chance"))  # n_way is a parameter
    d = m.crossJoin(chance)  # one row each
    return d.withColumns({"binding": F.col("real") - F.col("permuted"), "names": F.col("permuted") - F.col("anonymised"), "residual": F.col("anonymised") - F.col("chance")})


def markdown(table: DataFrame, order: str, columns: dict[str, str]) -> DataFrame:
    """(place, line): a table as lines of Markdown, in the order of a column without ties; a null cell is empty.

    Lines are numbered by range partitions, so a long table is written in parallel; an empty table is its head.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns.values()]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = with_dense_index(table.select(F.col(order).alias("_o"), line.alias("line")), "_o").select((F.col("idx") + 3).alias("place"), "line")
    head = rows.sparkSession.createDataFrame([(1, f"| {' | '.join(columns)} |"), (2, f"|{'-|' * len(columns)}")], "place long, line string")
    return head.unionByName(rows)


def looks_binary(answers: DataFrame, answer: str, *by: str) -> DataFrame:
    """(n, parsed, n_distinct, looks_binary): nearly all answers parse as yes or no, and there are at most four different ones, compared whole and trimmed."""
    a = answers.withColumns({"_p": lenient_verdict(F.col(answer)).isNotNull().cast("double"), "_a": F.trim(answer)})
    g = a.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_p").alias("parsed"), F.count_distinct("_a").alias("n_distinct"))
    return g.withColumn("looks_binary", (F.col("parsed") >= 0.9) & (F.col("n_distinct") <= 4))


def pair_coverage(a: DataFrame, b: DataFrame, on: str, *by: str, least: float = 0.9) -> DataFrame:
    """(n_a, n_b, n_both, coverage, paired) of two cells of runs: the share of the larger one's queries that both have."""
    j = a.select(on, *by).distinct().withColumn("_a", F.lit(1)).join(b.select(on, *by).distinct().withColumn("_b", F.lit(1)), [on, *by], "full")
    g = j.groupBy(*by).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"))
    g = g.withColumn("coverage", F.col("n_both") / F.greatest("n_a", "n_b"))
    return g.withColumn("paired", F.col("coverage") >= least)


def completeness(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """(split, n, empty, n_short, n_blank, n_unlabelled) of the files of a graph's splits, below folders split=<name>.

    Short lines have under three columns, blank ones an empty head, relation or tail, unlabelled ones no fourth column; an empty or missing file has 0 lines.
    """
    p = F.split("value", "\t")
    rows = spark.read.text(folder).select(F.col("split").cast("string").alias("split"), F.size(p).alias("k"), F.exists(F.slice(p, 1, 3), lambda x: F.trim(x) == "").alias("blank"))
    whole = F.col("k") >= 3
    g = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(~whole).alias("n_short"), F.count_if(whole & F.col("blank")).alias("n_blank"), F.count_if(F.col("k") == 3).alias("n_unlabelled"))
    want = spark.createDataFrame([(x,) for x in splits], "split string").join(g, "split", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return want.select("split", zero("n"), F.col("n").isNull().alias("empty"), zero("n_short"), zero("n_blank"), zero("n_unlabelled"))


def confusion_summary(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """(accuracy, macro_f1, micro_f1, n_observed, top_gold, top_pred, top_n) of gold and predicted classes.

    macro over the classes that are some row's gold; the top confusion is the pair of different classes
    with most rows, the first by name on ties. A null prediction is a class of its own.
    """
    c = metrics.class_confusion(pairs, gold, pred)
    per = c.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"), (2 * F.sum("correct") / (F.sum("support") + F.sum("predicted"))).alias("micro_f1"), F.count_if(F.col("support") > 0).alias("n_observed"))
    n = pairs.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    wrong = ~F.col("g").eqNullSafe(F.col("p"))
    top = n.agg((F.sum(F.when(~wrong, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.min(F.when(wrong, F.struct((-F.col("n")).alias("m"), "g", "p"))).alias("t"))
    return top.crossJoin(per).select("accuracy", "macro_f1", "micro_f1", "n_observed", F.col("t.g").alias("top_gold"), F.col("t.p").alias("top_pred"), (-F.col("t.m")).alias("top_n"))  # one row each


def forgetting(perplexities: DataFrame, base: str, kept: float = 0.05, degraded: float = 0.25) -> DataFrame:
    """(method, perplexity, delta, relative, reading) against the perplexity of the base method: preserved, degraded or substantial forgetting."""
    b = perplexities.filter(F.col("method") == base).agg(F.max("perplexity").alias("_base"))
    j = perplexities.filter(F.col("method") != base).crossJoin(F.broadcast(b))  # one row
    j = j.withColumn("delta", F.col("perplexity") - F.col("_base")).withColumn("relative", F.try_divide("delta", "_base"))
    reading = F.when(F.col("delta") <= kept * F.col("_base"), "preserved").when(F.col("delta") <= degraded * F.col("_base"), "degraded").otherwise("substantial forgetting")
    return j.select("method", "perplexity", "delta", "relative", reading.alias("reading"))


def shape(counts: DataFrame) -> DataFrame:
    """(n, buckets, entropy, top_share) of a histogram (bucket, n): entropy in bits."""
    total = F.sum("n")
    return counts.agg(total.cast("long").alias("n"), F.count("*").alias("buckets"), (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"), (F.max("n") / total).alias("top_share"))
