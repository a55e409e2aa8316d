"""Named queries on reports, audits and the small building blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions import text as tx
from graphlens.functions.hashing import det_number, unit
from graphlens.functions.ordering import checkpointed, with_dense_index
from graphlens.operators import audit, graph, metrics, probes, ranking, reports, sampling, types
from graphlens.plans import base
from graphlens.plans.base import T, U, number

from graphlens.plans.queries import ANSWERS, ARMS, BINS, BUCKET, CURVE, ORACLE_SQL, THREE, THREE_ARMS, R, answers, features, query, rounded, scored_sets, three_arms
from graphlens.plans.queries import arms as two_arms


TRIPLE = sampling.TRIPLE
O = ORACLE_SQL  # noqa: E741  SQL of other queries, taken as subqueries


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ reports


STRATA = O["sa2_stratified_sample"]


@query("ag2_relation_stats", f"WITH s AS (SELECT 'full' AS part, relation, count(*) AS n FROM triples GROUP BY relation UNION ALL SELECT 'sample', relation, count(*) FROM ({STRATA}) GROUP BY relation), r AS (SELECT part, n, row_number() OVER (PARTITION BY part ORDER BY n DESC, relation) AS k FROM s) SELECT part, count(*) AS n_relations, CAST(sum(n) AS BIGINT) AS n, round(max(n) / CAST(min(n) AS DOUBLE), 6) AS ratio, round(sum(n) FILTER (k <= 1) / CAST(sum(n) AS DOUBLE), 6) AS top1, round(sum(n) FILTER (k <= 3) / CAST(sum(n) AS DOUBLE), 6) AS top3 FROM r GROUP BY part")
def _(spark, sf):
    t = base.triples(spark, sf)
    s = t.select(F.lit("full").alias("part"), "relation").unionByName(sampling.stratified_sample(t, 1000, 10).select(F.lit("sample").alias("part"), "relation")).groupBy("part", "relation").agg(F.count("*").alias("n"))
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "relation")))  # one row a relation
    upto = lambda k: F.sum(F.when(F.col("k") <= k, F.col("n"))) / F.sum("n")
    return rounded(r.groupBy("part").agg(F.count("*").alias("n_relations"), F.sum("n").alias("n"), (F.max("n") / F.min("n")).alias("ratio"), upto(1).alias("top1"), upto(3).alias("top3")))


PARSED = "(SELECT CASE WHEN contains(answer, 'Yes') THEN 1 WHEN contains(answer, 'No') THEN 0 END AS strict, CASE WHEN contains(answer, 'Yes') OR contains(answer, ' yes') THEN 1 WHEN contains(answer, 'No') OR contains(answer, 'not') OR contains(answer, 'n''t') OR contains(answer, 'no') THEN 0 END AS lenient, CAST(starts_with(lower(trim(answer)), 'y') AS INTEGER) AS constrained, CAST(conv_id % 2 = 0 AS INTEGER) AS gold FROM a)"


@query("ag12_decomposition", f"WITH {ANSWERS}, v AS (SELECT avg(CAST(coalesce(strict = gold, false) AS DOUBLE)) AS strict, avg(CAST(coalesce(lenient = gold, false) AS DOUBLE)) AS lenient, avg(CAST(constrained = gold AS DOUBLE)) AS ceiling FROM {PARSED}) SELECT {R('strict', 'lenient', 'ceiling')}, round(ceiling - strict, 6) AS format_cost, round(ceiling - 0.5, 6) AS above_chance, round(ceiling - lenient, 6) AS residual FROM v")
def _(spark, sf):
    a = answers(spark, sf).withColumn("gold", (F.col("conv_id") % 2 == 0).cast("int"))
    share = lambda v: F.avg(F.coalesce(v.cast("int") == F.col("gold"), F.lit(False)).cast("double"))
    v = a.agg(share(tx.strict_verdict(F.col("answer"))).alias("strict"), share(tx.lenient_verdict(F.col("answer"))).alias("lenient"), share(tx.constrained_verdict(F.col("answer"))).alias("ceiling"))
    return rounded(v.withColumns({"format_cost": F.col("ceiling") - F.col("strict"), "above_chance": F.col("ceiling") - 0.5, "residual": F.col("ceiling") - F.col("lenient")}))


INSIDE = "(x.c > lo OR (lo = 0 AND x.c >= lo)) AND x.c <= hi"


def calibrated(long: str, by: str) -> str:
    """CTE e(by, ece, brier) of rows (by, c, correct)."""
    return f"x AS ({long}), eb AS (SELECT {by}, bin, count(*) AS n, avg(c) AS c, avg(CAST(correct AS DOUBLE)) AS a FROM x JOIN b ON {INSIDE} GROUP BY {by}, bin), ee AS (SELECT {by}, sum(n * abs(a - c)) / sum(n) AS ece, max(abs(a - c)) AS mce FROM eb GROUP BY {by}), e AS (SELECT ee.*, q.brier, q.over FROM ee JOIN (SELECT {by}, avg(pow(c - correct, 2)) AS brier, avg(c) > avg(CAST(correct AS DOUBLE)) AS over FROM x GROUP BY {by}) q USING ({by}))"


LOGIT = "ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, conf)) / (1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, conf))))"


@query("ag24_calibration_report", f"WITH {BINS}, " + calibrated(f"SELECT 'raw' AS method, conf AS c, correct FROM scored UNION ALL SELECT 'temperature', 1 / (1 + exp(-{LOGIT} / 2.0::DOUBLE)), correct FROM scored UNION ALL SELECT 'constant', (SELECT avg(correct) FROM scored), correct FROM scored", "method") + f" SELECT method, {R('ece', 'mce', 'brier')}, row_number() OVER (ORDER BY round(ece, 9), method) = 1 AS best, method <> 'constant' AND over AS too_confident FROM e")
def _(spark, sf):
    r = reports.calibration_report(base.scored(spark, sf), "conf", "correct", 2.0)
    return rounded(r.withColumn("too_confident", (F.col("method") != "constant") & F.col("too_confident")))


OTHER = f"(0.5::DOUBLE + {U.format(number('second', *T))} / 2.0::DOUBLE)"


@query("ag25_source_ranks", f"WITH {BINS}, " + calibrated(f"SELECT 'model' AS source, conf AS c, correct FROM scored UNION ALL SELECT 'sampled', {OTHER}, correct FROM scored", "source") + ", r AS (SELECT source, correct, rank() OVER (PARTITION BY source ORDER BY c) + (count(*) OVER (PARTITION BY source, c) - 1) / 2.0::DOUBLE AS r FROM x), u AS (SELECT source, (sum(r) FILTER (correct = 1) - count(*) FILTER (correct = 1) * (count(*) FILTER (correct = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (correct = 1) * count(*) FILTER (correct <> 1), 0) AS auc FROM r GROUP BY source) SELECT source, round(ece, 6) AS ece, round(brier, 6) AS brier, round(auc, 6) AS auc, row_number() OVER (ORDER BY ece, source) AS place FROM e JOIN u USING (source)")
def _(spark, sf):
    s = base.scored(spark, sf)
    return rounded(reports.source_ranks(s, {"model": F.col("conf"), "sampled": F.lit(0.5) + unit("second", *TRIPLE) / 2.0}, "correct"))


@query("ag30_familiar_calibration", f"WITH {BINS}, {BUCKET}, " + calibrated("SELECT bucket, conf AS c, correct FROM fam WHERE bucket IN (SELECT bucket FROM fam GROUP BY bucket HAVING count(*) >= 20) UNION ALL SELECT 'all', conf, correct FROM fam", "bucket") + f" SELECT bucket, {R('ece', 'mce', 'brier')} FROM e")
def _(spark, sf):
    """By familiarity, and all rows together, from one scan with grouping sets."""
    f = audit.familiarity(base.split(spark, sf, "train"), base.scored(spark, sf))
    return rounded(metrics.calibration_subtotals(f, "conf", "correct", "bucket", 20).drop("n"))


@query("ag30_metrics_subtotals", f"WITH {BUCKET} SELECT coalesce(CASE WHEN grouping(bucket) = 0 THEN bucket END, 'all') AS bucket, coalesce(CASE WHEN grouping(relation) = 0 THEN relation END, 'all') AS relation, CAST(grouping(bucket, relation) AS BIGINT) AS level, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(conf), 6) AS conf FROM fam GROUP BY GROUPING SETS ((bucket, relation), (bucket), (relation), ())")
def _(spark, sf):
    """Accuracy by familiarity and relation, of each alone, and overall, from one scan."""
    f = audit.familiarity(base.split(spark, sf, "train"), base.scored(spark, sf))
    return rounded(metrics.subtotals(f, "bucket", "relation"))


@query("ag14_subtotals", "WITH seen AS (SELECT head AS e FROM train UNION SELECT tail FROM train), b AS (SELECT qid, CASE (CAST(head IN (SELECT e FROM seen) AS INTEGER) + CAST(tail IN (SELECT e FROM seen) AS INTEGER)) WHEN 2 THEN 'both' WHEN 1 THEN 'one' ELSE 'neither' END AS bucket FROM queries), x AS (SELECT r.*, bucket FROM ranks r JOIN b USING (qid)) SELECT CASE WHEN grouping(bucket) = 0 THEN bucket ELSE 'all' END AS bucket, CASE WHEN grouping(relation) = 0 THEN relation ELSE 'all' END AS relation, CAST(grouping(bucket, relation) AS BIGINT) AS level, count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS DOUBLE)), 6) AS hits_1 FROM x GROUP BY GROUPING SETS ((bucket, relation), (bucket), (relation), ())")
def _(spark, sf):
    """Ranks by familiarity and relation, of each alone, and overall, from one scan."""
    q = audit.familiarity(base.split(spark, sf, "train"), base.with_qid(base.split(spark, sf, "test"))).select("qid", "bucket")
    return rounded(ranking.ranking_subtotals(ranking.gold_ranks_of_sets(scored_sets(spark, sf)).join(q, "qid"), "bucket", "relation"))


@query("ag38_rescored_verdicts", "SELECT relation, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(CAST(p_yes >= 0.5 AS DOUBLE)), 6) AS said_yes, CASE WHEN greatest(avg(CAST(p_yes >= 0.5 AS DOUBLE)), 1 - avg(CAST(p_yes >= 0.5 AS DOUBLE))) > 0.95 THEN 'degenerate' WHEN avg(correct) > 0.5 THEN 'above chance' ELSE 'at chance' END AS verdict FROM scored GROUP BY relation")
def _(spark, sf):
    yes = F.avg((F.col("p_yes") >= 0.5).cast("double"))
    verdict = F.when(F.greatest(yes, 1 - yes) > 0.95, "degenerate").when(F.avg("correct") > 0.5, "above chance").otherwise("at chance")
    return rounded(base.scored(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), yes.alias("said_yes"), verdict.alias("verdict")))


@query("ag53_mrr_terms", f"WITH {THREE_ARMS}, m AS (SELECT " + ", ".join(f'avg(1 / \"{k}\"::DOUBLE) AS \"{k}\"' for k in THREE) + ", avg(list_sum(list_transform(range(1, n_way + 1), lambda i: 1 / i::DOUBLE)) / n_way) AS chance FROM three) SELECT round(\"real\", 6) AS \"real\", round(permuted, 6) AS permuted, round(anonymised, 6) AS anonymised, round(chance, 6) AS chance, round(\"real\" - permuted, 6) AS binding, round(permuted - anonymised, 6) AS names, round(anonymised - chance, 6) AS residual FROM m")
def _(spark, sf):
    r = three_arms(spark, sf)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(k).alias("rank")) for k in THREE]))
    return rounded(reports.mrr_terms(r.select("n_way", each.alias("x")).select("n_way", "x.*")))


@query("ag56_frozen_probe", f"WITH {ARMS}, m AS (SELECT relation, avg(a) AS a, avg(b) AS b FROM arm GROUP BY relation) SELECT round(max(a), 6) AS best_a, round(max(b), 6) AS best_b, round(max(a) - max(b), 6) AS gap FROM m")
def _(spark, sf):
    m = two_arms(spark, sf).groupBy("relation").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return rounded(m.agg(F.max("a").alias("best_a"), F.max("b").alias("best_b"), (F.max("a") - F.max("b")).alias("gap")))


def _newton_sql(rounds: int, ridge: float) -> str:
    """Newton's rounds for two components and a constant, each a step of sums and Cramer's rule."""
    parts = ["v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS z, CAST(label % 2 AS DOUBLE) AS y FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)", "b0 AS (SELECT 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS r)"]
    det = lambda m: "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format(*m)
    for i in range(rounds):
        parts.append(f"w{i} AS (SELECT v.*, b.p, b.q, b.r, 1 / (1 + exp(-(b.p * x + b.q * z + b.r))) AS m FROM v, b{i} b WHERE vec_id % 5 <> 0)")
        parts.append(f"s{i} AS MATERIALIZED (SELECT any_value(p) AS p, any_value(q) AS q, any_value(r) AS r, sum(x * (y - m)) - {ridge} * any_value(p) AS g0, sum(z * (y - m)) - {ridge} * any_value(q) AS g1, sum(y - m) - 1e-9::DOUBLE * any_value(r) AS g2, sum(x * x * m * (1 - m)) + {ridge} AS xx, sum(x * z * m * (1 - m)) AS xz, sum(x * m * (1 - m)) AS x1, sum(z * z * m * (1 - m)) + {ridge} AS zz, sum(z * m * (1 - m)) AS z1, sum(m * (1 - m)) + 1e-9::DOUBLE AS o FROM w{i})")
        h, g = ["xx", "xz", "x1", "xz", "zz", "z1", "x1", "z1", "o"], ["g0", "g1", "g2"]
        solved = [f"{c} + {det([g[k // 3] if k % 3 == j else x for k, x in enumerate(h)])} / {det(h)} AS {c}" for j, c in enumerate("pqr")]
        parts.append(f"b{i + 1} AS MATERIALIZED (SELECT {', '.join(solved)} FROM s{i})")
    return ", ".join(parts)


@query("ag60_logistic_probe", f"WITH {_newton_sql(8, 1.0)}, t AS (SELECT y, 1 / (1 + exp(-(b.p * x + b.q * z + b.r))) AS p FROM v, b8 b WHERE vec_id % 5 = 0) SELECT count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS nll, (SELECT round(p, 5) FROM b8) AS weight_1, (SELECT round(q, 5) FROM b8) AS weight_2, (SELECT round(r, 5) FROM b8) AS constant FROM t")
def _(spark, sf):
    """Two components, fitted on four fifths of the vectors by Newton's method and judged on the rest; ag60_whole_probe takes all components."""
    v = labelled_vectors(spark, sf).withColumn("vector", F.slice("vector", 1, 2))
    w = probes.logistic(v.filter("id % 5 <> 0"))
    p = v.filter("id % 5 = 0").withColumn("p", probes.logistic_score(F.col("vector"), w))
    nll = F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))
    out = p.agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"), nll.alias("nll"))
    return rounded(out).withColumns({n: F.lit(round(x, 5) + 0.0) for n, x in zip(("weight_1", "weight_2", "constant"), w, strict=True)})


@query("ag60_whole_probe")
def _(spark, sf):
    """The probe on all components; the tests hold its weights against plain Newton steps on 64 columns."""
    v = labelled_vectors(spark, sf)
    w = probes.logistic(v.filter("id % 5 <> 0"))
    p = v.filter("id % 5 = 0").withColumn("p", probes.logistic_score(F.col("vector"), w))
    return rounded(p.agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy")))


def labelled_vectors(spark, sf):
    """(id, vector, label, y) of the vectors that have a label and are whole."""
    v = table(spark, sf, "embeddings").filter(F.col("embedding").isNotNull() & F.col("label").isNotNull())
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label", (F.col("label") % 2).cast("double").alias("y"))


SLICES, SLICE_BINS = 16, 8


def _gauss(side: str) -> str:
    return f"(({number('slice-' + side, 'CAST(j AS VARCHAR)', 'CAST(d AS VARCHAR)')} % 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE)"


@query("ag59_sliced_information", f"WITH v AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), c AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM v), m AS (SELECT d, avg(x) AS mean, stddev_pop(x) AS sd FROM c GROUP BY d), g AS (SELECT j, d, sqrt(-2 * ln({_gauss('a')})) * cos(2 * pi() * {_gauss('b')}) AS u FROM (SELECT DISTINCT d FROM m), (SELECT unnest(range(0, {SLICES})) AS j)), w AS MATERIALIZED (SELECT j, d, u / sqrt(sum(u * u) OVER (PARTITION BY j)) / (sd + 1e-8::DOUBLE) AS w, mean FROM g JOIN m USING (d)), p AS (SELECT vec_id, label, j, round(sum(x * w) - sum(w * mean), 9) AS p FROM c JOIN w USING (d) GROUP BY ALL), k AS (SELECT j, label, floor((row_number() OVER (PARTITION BY j ORDER BY p, vec_id) - 1) * {SLICE_BINS} / (count(*) OVER (PARTITION BY j))::DOUBLE) AS bin FROM p), n AS (SELECT j, bin, label, count(*)::DOUBLE AS m FROM k GROUP BY ALL), mi AS (SELECT j, greatest(0, sum(m / t * ln(m * t / (b * y)))) AS mi FROM (SELECT *, sum(m) OVER (PARTITION BY j) AS t, sum(m) OVER (PARTITION BY j, bin) AS b, sum(m) OVER (PARTITION BY j, label) AS y FROM n) GROUP BY j) SELECT round(avg(mi), 6) AS smi, round(stddev_pop(mi), 6) AS sd, round(quantile_cont(mi, 0.95), 6) AS p95, (SELECT count(*) FROM v) AS n, count(*) AS directions FROM mi")
def _(spark, sf):
    return rounded(probes.sliced_information(labelled_vectors(spark, sf), SLICES, SLICE_BINS, "slice"))


@query("ag66_manifest", f"WITH {BUCKET} SELECT (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM test) AS n_test, round((SELECT count(*) FROM seen) / CAST((SELECT count(*) FROM ents) AS DOUBLE), 6) AS seen_entities, round(avg(CAST(bucket = 'both' AS DOUBLE)), 6) AS both_seen, round(avg(CAST(label = 1 AS DOUBLE)), 6) AS positive_rate FROM fam")
def _(spark, sf):
    train, test = base.split(spark, sf, "train"), base.split(spark, sf, "test")
    every = base.triples(spark, sf).select(F.explode(F.array("head", "tail")).alias("e")).agg(F.count_distinct("e").alias("n_all"))
    seen = audit.ends(train).distinct().agg(F.count("*").alias("n_seen"))
    f = audit.familiarity(train, base.scored(spark, sf)).agg(F.avg((F.col("bucket") == "both").cast("double")).alias("both_seen"), F.avg((F.col("label") == 1).cast("double")).alias("positive_rate"))
    n = train.agg(F.count("*").alias("n_train")).crossJoin(test.agg(F.count("*").alias("n_test"))).crossJoin(every).crossJoin(seen).crossJoin(f)  # one row each
    return rounded(n.select("n_train", "n_test", (F.col("n_seen") / F.col("n_all")).alias("seen_entities"), "both_seen", "positive_rate"))


@query("ag68_best_method", f"WITH {ARMS}, m AS (SELECT relation, avg(a) AS a, avg(b) AS b FROM arm GROUP BY relation) SELECT arg_max(relation, a) AS best_a, arg_max(relation, b) AS best_b, round((max(a) - max(b)) / max(b), 6) AS change, CASE WHEN (max(a) - max(b)) / max(b) > 0.1 THEN 'up' WHEN (max(a) - max(b)) / max(b) < -0.1 THEN 'down' ELSE 'flat' END AS reading FROM (SELECT * FROM m ORDER BY relation)")
def _(spark, sf):
    m = two_arms(spark, sf).groupBy("relation").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    top = lambda c: F.min_by("relation", F.struct(-F.col(c), "relation"))
    d = m.agg(top("a").alias("best_a"), top("b").alias("best_b"), F.max("a").alias("a"), F.max("b").alias("b"))
    return rounded(d.select("best_a", "best_b", ((F.col("a") - F.col("b")) / F.col("b")).alias("change"), reports.relative_change(F.col("a"), F.col("b")).alias("reading")))


SPREAD = "s AS (SELECT relation, count(*) AS n, avg(a - b) AS d, stddev_samp(a - b) / sqrt(count(*)) AS sem FROM arm GROUP BY relation)"


@query("ag69_interval_verdicts", f"WITH {ARMS}, {SPREAD} SELECT relation, n, round(d, 6) AS diff, CASE WHEN d - 1.96::DOUBLE * sem > 0 THEN 'better' WHEN d + 1.96::DOUBLE * sem < 0 THEN 'worse' ELSE 'indistinguishable' END AS verdict FROM s")
def _(spark, sf):
    d = F.col("a") - F.col("b")
    s = two_arms(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.avg(d).alias("diff"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("sem"))
    return rounded(s.select("relation", "n", "diff", reports.interval_verdict(F.col("diff") - 1.96 * F.col("sem"), F.col("diff") + 1.96 * F.col("sem")).alias("verdict")))


@query("ag70_detectable_from_n", "SELECT relation, count(*) AS n, round(2.8::DOUBLE * 0.30::DOUBLE / sqrt(count(*)), 6) AS detectable FROM test GROUP BY relation")
def _(spark, sf):
    return rounded(base.split(spark, sf, "test").groupBy("relation").agg(F.count("*").alias("n"), reports.detectable_from_n(F.count("*")).alias("detectable")))


@query("ab4_abstention_report", f"WITH {CURVE}, t(target) AS (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)), r AS (SELECT target, max(coverage) FILTER (precision >= target) AS coverage FROM t, curve GROUP BY target), q AS (SELECT *, CASE WHEN coverage IS NULL THEN 'precision never reached' WHEN coverage < 0.05 THEN 'too few answers' ELSE 'reached' END AS reason FROM r) SELECT target, round(coverage, 6) AS coverage, reason, coalesce(target = (SELECT max(target) FROM q WHERE reason = 'reached'), false) AS headline FROM q")
def _(spark, sf):
    return rounded(reports.abstention_report(base.scored(spark, sf), [0.5, 0.9, 0.95, 0.99]).select("target", "coverage", "reason", "headline"))


@query("st9_looks_binary", f"WITH {ANSWERS}, v AS (SELECT (conv_id + turn) % 5 AS kind, answer, CASE WHEN contains(answer, 'Yes') OR contains(answer, ' yes') THEN 1 WHEN contains(answer, 'No') OR contains(answer, 'not') OR contains(answer, 'n''t') OR contains(answer, 'no') THEN 0 END AS v FROM (SELECT * FROM a UNION ALL SELECT conv_id + 5 - turn % 5, 0, CASE conv_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'No.' END FROM a WHERE (conv_id + turn) % 5 = 4)) SELECT CASE WHEN answer IN ('Yes', 'No', 'No.') THEN 'short' ELSE CAST(kind AS VARCHAR) END AS kind, count(*) AS n, round(avg(CAST(v IS NOT NULL AS DOUBLE)), 6) AS parsed, count(DISTINCT trim(answer)) AS n_distinct, avg(CAST(v IS NOT NULL AS DOUBLE)) >= 0.9 AND count(DISTINCT trim(answer)) <= 4 AS looks_binary FROM v GROUP BY 1")
def _(spark, sf):
    """Kinds of answers, whole texts compared; one kind, made from every fifth conversation, is short answers only."""
    a = answers(spark, sf)
    short = a.filter((F.col("conv_id") + F.col("turn")) % 5 == 4).select(F.lit(0).alias("_k"), F.element_at(F.array(F.lit("Yes"), F.lit("No"), F.lit("No.")), (F.col("conv_id") % 3 + 1).cast("int")).alias("answer"))
    every = a.select(((F.col("conv_id") + F.col("turn")) % 5).alias("_k"), "answer").unionByName(short)
    kind = F.when(F.col("answer").isin("Yes", "No", "No."), "short").otherwise(F.col("_k").cast("string"))
    return rounded(reports.looks_binary(every.withColumn("kind", kind), "answer", "kind"))


# ------------------------------------------------------------------ audits


UNSEEN = f"u AS (SELECT head, relation, tail, {number('ind', 'head')} % 10000 < 1000 AS uh, {number('ind', 'tail')} % 10000 < 1000 AS ut FROM triples), w AS (SELECT *, CASE WHEN NOT uh AND NOT ut THEN 'train' WHEN uh THEN 'query' ELSE 'support' END AS part FROM u), tr AS (SELECT head AS e FROM w WHERE part = 'train' UNION SELECT tail FROM w WHERE part = 'train')"


@query("se10_inductive_checks", f"WITH {UNSEEN} SELECT 'query_heads_seen' AS \"check\", count(*) AS n FROM w WHERE part = 'query' AND head IN (SELECT e FROM tr) UNION ALL SELECT 'relations_unknown', count(DISTINCT relation) FROM w WHERE part = 'query' AND relation NOT IN (SELECT relation FROM w WHERE part = 'train') UNION ALL SELECT 'fully_seen', count(*) FROM w WHERE part <> 'train' AND head IN (SELECT e FROM tr) AND tail IN (SELECT e FROM tr) UNION ALL SELECT 'query_tails_orphan', count(*) FROM w WHERE part = 'query' AND tail NOT IN (SELECT e FROM tr) UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT (head, relation, tail)) FROM w")
def _(spark, sf):
    w = checkpointed(sampling.inductive_split(base.triples(spark, sf), 0.1))  # read five times
    return audit.inductive_checks(w)


@query("se13_completeness", f"WITH x AS (SELECT split, {number('hole', *T)} % 40 AS k FROM kg) SELECT split, count(*) AS n, false AS empty, count(*) FILTER (k = 0) AS n_short, count(*) FILTER (k = 1) AS n_blank, count(*) FILTER (k NOT IN (0, 1, 3)) AS n_unlabelled FROM x GROUP BY split UNION ALL SELECT 'extra', 0, true, 0, 0, 0")
def _(spark, sf):
    """The splits as files, some lines short, some with a blank end, some labelled, and one empty file: what each lacks."""
    from graphlens.plans import files

    k = det_number("hole", *TRIPLE) % 40
    line = F.when(k == 0, F.concat_ws("\t", "head", "relation")).when(k == 1, F.concat_ws("\t", "head", "relation", F.lit(" "), F.lit(""))).when(k == 3, F.concat_ws("\t", *TRIPLE, F.lit("1"))).otherwise(F.concat_ws("\t", *TRIPLE))

    def write(path):
        g = base.graph_of(spark, sf).select("split", line.alias("value"))
        g.write.partitionBy("split").text(path)
        g.limit(0).select("value").write.text(f"{path}/split=extra")

    def back(path):
        return reports.completeness(spark, path, ["train", "valid", "test", "extra"])

    return rounded(files.round_trip(spark, write, back, 1 << 20))


@query("se15_split_overlap", "WITH s AS (SELECT head AS e FROM train UNION SELECT tail FROM train), t AS (SELECT head AS e FROM test UNION SELECT tail FROM test) SELECT count(*) AS n, count(*) FILTER (e IN (SELECT e FROM s)) AS n_seen, round(avg(CAST(e IN (SELECT e FROM s) AS DOUBLE)), 6) AS share FROM t")
def _(spark, sf):
    s = audit.ends(base.split(spark, sf, "train")).distinct().toDF("e").withColumn("seen", F.lit(True))
    t = audit.ends(base.split(spark, sf, "test")).distinct().toDF("e").join(s, "e", "left")
    return rounded(t.agg(F.count("*").alias("n"), F.count_if(F.col("seen")).alias("n_seen"), F.avg(F.coalesce("seen", F.lit(False)).cast("double")).alias("share")))


@query("se12_split_union", "SELECT split, relation, count(*) AS n FROM (SELECT 'train' AS split, * FROM train UNION ALL SELECT 'valid', * FROM valid UNION ALL SELECT 'test', * FROM test) GROUP BY ALL")
def _(spark, sf):
    parts = [base.split(spark, sf, s).select(F.lit(s).alias("split"), *TRIPLE) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split", "relation").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ filters and joins


@query("fi1_positive_queries", "SELECT head, relation, tail FROM labelled WHERE coalesce(label, 1) = 1")
def _(spark, sf):
    return base.labelled(spark, sf).filter(F.coalesce("label", F.lit(1)) == 1).select(*TRIPLE)


@query("pr7_unlabelled_rule", "SELECT relation, count(*) FILTER (relation = 'performs' OR label = 1) AS n_positive, count(*) AS n FROM labelled GROUP BY relation")
def _(spark, sf):
    """A set without labels is all positive: here one relation loses its labels."""
    x = base.labelled(spark, sf).withColumn("label", F.when(F.col("relation") != "performs", F.col("label")))
    g = x.groupBy("relation").agg(F.count_if(F.col("label") == 1).alias("p"), F.count("label").alias("m"), F.count("*").alias("n"))
    return g.select("relation", F.when(F.col("m") == 0, F.col("n")).otherwise(F.col("p")).alias("n_positive"), "n")


RECORD = f"SELECT *, {number('shape', *T)} % 6 AS shape FROM test"


@query("pr8_columns_by_position", f"SELECT head AS a, CASE WHEN shape <> 1 THEN relation END AS b, CASE WHEN shape <> 1 THEN CASE WHEN shape = 2 THEN '' ELSE tail END END AS c, CASE WHEN shape = 3 THEN 'extra' END AS d, CASE shape WHEN 1 THEN 1 WHEN 3 THEN 4 ELSE 3 END AS n_columns FROM ({RECORD})")
def _(spark, sf):
    """Columns of records of several shapes: short, with an empty column, with one more, with white space at the ends."""
    shape = det_number("shape", *TRIPLE) % 6
    line = F.when(shape == 1, F.col("head")).when(shape == 2, F.concat_ws("\t", "head", "relation", F.lit(""))).when(shape == 3, F.concat_ws("\t", *TRIPLE, F.lit("extra"))).when(shape == 4, F.concat(F.lit("  "), F.concat_ws("\t", *TRIPLE), F.lit(" \r"))).otherwise(F.concat_ws("\t", *TRIPLE))
    parts = F.split(F.regexp_replace("line", r"^[ \r\n]+|[ \r\n]+$", ""), "\t")
    return base.split(spark, sf, "test").select(line.alias("line")).select(*[F.get(parts, i).alias(n) for i, n in enumerate("abcd")], F.size(parts).alias("n_columns")).transform(rounded)


@query("fi3_induced_subgraph", "SELECT head, relation, tail FROM triples WHERE head IN (SELECT id FROM entities) AND tail IN (SELECT id FROM entities)")
def _(spark, sf):
    t, keep = base.triples(spark, sf), base.entities(spark, sf).select("id")
    return t.join(keep.withColumnRenamed("id", "head"), "head", "left_semi").join(keep.withColumnRenamed("id", "tail"), "tail", "left_semi").select(*TRIPLE)


@query("fi4_min_support", "SELECT relation, count(*) AS n FROM test GROUP BY relation HAVING count(*) >= 20")
def _(spark, sf):
    return base.split(spark, sf, "test").groupBy("relation").agg(F.count("*").alias("n")).filter("n >= 20")


@query("fi5_self_loops", "SELECT relation, count(*) FILTER (split_part(head, ':', 2) = split_part(tail, ':', 2)) AS n_same_number, count(*) FILTER (head = tail) AS n_loops FROM triples GROUP BY relation")
def _(spark, sf):
    num = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(2))
    return base.triples(spark, sf).groupBy("relation").agg(F.count_if(num("head") == num("tail")).alias("n_same_number"), F.count_if(F.col("head") == F.col("tail")).alias("n_loops"))


@query("fi6_blank_texts", "SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS n_blank FROM documents GROUP BY source")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n_blank"))


@query("jo1_lookup", "SELECT t.head, t.relation, e.text FROM test t LEFT JOIN entities e ON e.id = t.head")
def _(spark, sf):
    return base.split(spark, sf, "test").join(base.entities(spark, sf).withColumnRenamed("id", "head"), "head", "left").select("head", "relation", "text")


@query("jo2_tails_in_range", "SELECT head, relation, tail FROM test SEMI JOIN (SELECT DISTINCT relation, tail FROM train) k USING (relation, tail)")
def _(spark, sf):
    """The right side is distinct, so it is partly combined before the shuffle and a popular tail is one row."""
    return base.split(spark, sf, "test").join(base.split(spark, sf, "train").select("relation", "tail").distinct(), ["relation", "tail"], "left_semi").select(*TRIPLE)


@query("jo3_closed_world", "SELECT head, relation, tail FROM labelled l WHERE label = -1 AND NOT EXISTS (SELECT 1 FROM triples k WHERE k.head = l.head AND k.relation = l.relation AND k.tail = l.tail)")
def _(spark, sf):
    return base.labelled(spark, sf).filter("label = -1").join(base.triples(spark, sf), TRIPLE, "left_anti").select(*TRIPLE)


@query("jo4_unknown_pairs", "SELECT head, relation, count(*) AS n FROM labelled l WHERE NOT EXISTS (SELECT 1 FROM train k WHERE k.head = l.head AND k.relation = l.relation) GROUP BY head, relation")
def _(spark, sf):
    known = base.split(spark, sf, "train").select("head", "relation").distinct()
    return base.labelled(spark, sf).join(known, ["head", "relation"], "left_anti").groupBy("head", "relation").agg(F.count("*").alias("n"))


@query("jo5_candidate_grid", "WITH r AS (SELECT DISTINCT relation FROM test), e AS (SELECT id FROM entities WHERE starts_with(id, 'region:')) SELECT relation, id AS candidate FROM r, e WHERE NOT EXISTS (SELECT 1 FROM triples k WHERE k.relation = r.relation AND k.tail = e.id)")
def _(spark, sf):
    e = table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("candidate"))
    g = base.split(spark, sf, "test").select("relation").distinct().crossJoin(F.broadcast(e))  # a small table by one row a relation
    return g.join(base.triples(spark, sf).select("relation", F.col("tail").alias("candidate")).distinct(), ["relation", "candidate"], "left_anti")


@query("jo6_mirror_edges", "SELECT a.relation, b.relation AS back, count(*) AS n FROM triples a JOIN triples b ON b.head = a.tail AND b.tail = a.head GROUP BY ALL")
def _(spark, sf):
    t = base.triples(spark, sf)
    b = t.select(F.col("tail").alias("head"), F.col("head").alias("tail"), F.col("relation").alias("back"))
    return t.join(b, ["head", "tail"]).groupBy("relation", "back").agg(F.count("*").alias("n"))


@query("jo7_two_hop_counts", "SELECT a.relation AS first, b.relation AS second, count(*) AS n FROM triples a JOIN triples b ON b.head = a.tail GROUP BY ALL")
def _(spark, sf):
    """Counted at the middle first: the paths themselves are never made."""
    t = base.triples(spark, sf)
    into = t.groupBy(F.col("tail").alias("mid"), F.col("relation").alias("first")).agg(F.count("*").alias("a"))
    out = t.groupBy(F.col("head").alias("mid"), F.col("relation").alias("second")).agg(F.count("*").alias("b"))
    return into.join(out, "mid").groupBy("first", "second").agg(F.sum(F.col("a") * F.col("b")).alias("n"))


SECOND = f"o AS (SELECT concat_ws('|', head, relation, tail, label) AS id, CAST((0.6::DOUBLE * {U.format(number('again', *T))} + 0.4::DOUBLE * CAST(label = 1 AS DOUBLE) >= 0.5) = (label = 1) AS INTEGER) AS correct FROM labelled)"


@query("jo8_paired_cells", f"WITH {SECOND} SELECT s.correct AS a, o.correct AS b, count(*) AS n FROM scored s JOIN o USING (id) GROUP BY ALL")
def _(spark, sf):
    a, b = (base.scored(spark, sf, salt).select("id", F.col("correct").alias(n)) for salt, n in (("score", "a"), ("again", "b")))
    return rounded(a.join(b, "id").groupBy("a", "b").agg(F.count("*").alias("n")))


@query("jo8_coverage", f"WITH {SECOND}, cut AS (SELECT relation, id FROM scored WHERE {number('cut', 'id')} % 12 < length(relation) - 8 OR {number('cut', 'id')} % 12 > 2), c AS (SELECT relation, count(DISTINCT id) AS n_a FROM scored GROUP BY relation), d AS (SELECT relation, count(DISTINCT id) AS n_b FROM cut GROUP BY relation) SELECT relation, n_a, coalesce(n_b, 0) AS n_b, coalesce(n_b, 0) AS n_both, round(coalesce(n_b, 0) / n_a::DOUBLE, 6) AS coverage, coalesce(n_b, 0) / n_a::DOUBLE >= 0.9 AS paired FROM c LEFT JOIN d USING (relation)")
def _(spark, sf):
    """Cells that lack some of the queries: pairs count only where nine in ten queries are in both."""
    a = base.scored(spark, sf).select("relation", "id")
    cut = det_number("cut", "id") % 12
    return rounded(reports.pair_coverage(a, a.filter((cut < F.length("relation") - 8) | (cut > 2)), "id", "relation"))


@query("jo10_positional_zip", "WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM entities), b AS (SELECT text, row_number() OVER (ORDER BY text, id) AS k FROM entities) SELECT id, text FROM a JOIN b USING (k)")
def _(spark, sf):
    e = base.entities(spark, sf)
    return with_dense_index(e.select("id"), "id").join(with_dense_index(e, "text", "id").select("text", "idx"), "idx").select("id", "text")


@query("jo12_default", "SELECT id, coalesce(degree, 0) AS degree FROM entities LEFT JOIN degrees ON entity = id")
def _(spark, sf):
    d = graph.degrees(base.triples(spark, sf)).select(F.col("entity").alias("id"), "degree")
    return base.entities(spark, sf).select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


# ------------------------------------------------------------------ windows, texts, numbers, nested values


@query("wi5_curve_points", f"WITH {CURVE} SELECT k FROM curve")
def _(spark, sf):
    from graphlens.operators import abstention

    return abstention.risk_coverage(base.scored(spark, sf)).select("k")


@query("wi8_budget_cut", "SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM conversations) WHERE spent <= 400")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)  # the turns of one conversation
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w).alias("spent")).filter("spent <= 400")


@query("wi10_signature_vocabulary", "SELECT sig FROM topsig")
def _(spark, sf):
    return types.induced_types(base.triples(spark, sf)).filter("type <> 'OTHER'").select(F.col("type").alias("sig")).distinct()


@query("wi11_most_common", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(10)


@query("wi13_ordered_relations", "WITH a AS (SELECT relation, avg(correct) AS accuracy FROM scored GROUP BY relation) SELECT row_number() OVER (ORDER BY round(accuracy, 9) DESC, relation) AS place, relation, round(accuracy, 6) AS accuracy FROM a")
def _(spark, sf):
    a = base.scored(spark, sf).groupBy("relation").agg(F.avg("correct").alias("accuracy"))
    return rounded(a.select(F.row_number().over(Window.orderBy(F.desc(F.round("accuracy", 9)), "relation")).alias("place"), "relation", "accuracy"))  # one row a relation


@query("wi14_first_last_least", "SELECT user_id, round(arg_min(value, event_id), 6) AS first, round(arg_max(value, event_id), 6) AS last, round(min(value), 6) AS least FROM events GROUP BY user_id")
def _(spark, sf):
    return rounded(table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"), F.min("value").alias("least")))


@query("ba2_cut_at_words", "SELECT conv_id, turn, array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ') AS cut FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "conversations").filter(F.col("text").isNotNull()).select("conv_id", "turn", F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("cut"))


@query("st7_constrained", f"WITH {ANSWERS} SELECT conv_id, turn, CAST(starts_with(lower(trim(answer)), 'y') AS INTEGER) AS constrained FROM a")
def _(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", tx.constrained_verdict(F.col("answer")).cast("int").alias("constrained"))


ANSWERED = f"SELECT t.relation, coalesce(b.text, t.tail) AS gold, CASE {number('reply', *T)} % 5 WHEN 0 THEN upper(coalesce(b.text, t.tail)) || '.' WHEN 1 THEN '  ' || coalesce(b.text, t.tail) || ', of course' WHEN 2 THEN coalesce(a.text, t.head) WHEN 3 THEN '' ELSE 'It is ' || coalesce(b.text, t.tail) END AS reply FROM test t LEFT JOIN entities a ON a.id = t.head LEFT JOIN entities b ON b.id = t.tail"
NORM = r"lower(trim(regexp_replace(regexp_replace(split_part({}, ',', 1), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')))"


@query("st10_answer_correct", f"WITH x AS ({ANSWERED}) SELECT relation, count(*) AS n, count(*) FILTER ({NORM.format('reply')} = {NORM.format('gold')} AND {NORM.format('reply')} <> '') AS n_exact, count(*) FILTER (contains(lower(reply), {NORM.format('gold')})) AS n_mentioned FROM x GROUP BY relation")
def _(spark, sf):
    """Replies with the gold name, in other writing or in a sentence, with another name, and empty: right as a name, or mentioned."""
    from graphlens.operators import prompts

    s = prompts.with_text(base.split(spark, sf, "test"), base.entities(spark, sf))
    k, gold = det_number("reply", *TRIPLE) % 5, F.col("tail_text")
    reply = F.when(k == 0, F.concat(F.upper(gold), F.lit("."))).when(k == 1, F.concat(F.lit("  "), gold, F.lit(", of course"))).when(k == 2, F.col("head_text")).when(k == 3, "").otherwise(F.concat(F.lit("It is "), gold))
    s = s.select("relation", gold.alias("gold"), reply.alias("reply"))
    return s.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(tx.same_answer(F.col("reply"), F.col("gold"))).alias("n_exact"), F.count_if(F.contains(F.lower("reply"), tx.answer_name(F.col("gold")))).alias("n_mentioned"))


@query("st12_opaque_labels", "SELECT id, looks_opaque, n_alpha_words FROM features")
def _(spark, sf):
    return rounded(features(spark, sf).select("id", "looks_opaque", "n_alpha_words"))


PAIR = f"e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE {U.format(number('py', 'CAST(event_id AS VARCHAR)'))} END AS y, CASE WHEN event_id % 7 = 0 THEN 0 ELSE {U.format(number('pn', 'CAST(event_id AS VARCHAR)'))} END AS n FROM events)"


@query("st16_normalised_yes", f"WITH {PAIR} SELECT event_id, round(CASE WHEN y + n = 0 THEN 0.5 ELSE y / (y + n) END, 6) AS p_yes FROM e")
def _(spark, sf):
    at = F.col("event_id").cast("string")
    zero = F.col("event_id") % 7 == 0
    e = table(spark, sf, "events").select("event_id", F.when(zero, 0.0).otherwise(unit("py", at)).alias("y"), F.when(zero, 0.0).otherwise(unit("pn", at)).alias("n"))
    return rounded(e.select("event_id", F.coalesce(F.try_divide("y", F.col("y") + F.col("n")), F.lit(0.5)).alias("p_yes")))


@query("ma1_functions", f"SELECT id, {', '.join(f'round({e}, 6) AS {n}' for n, e in (('entropy', '-(c * log2(c) + (1 - c) * log2(1 - c))'), ('logit', 'ln(c / (1 - c))'), ('back', '1 / (1 + exp(-ln(c / (1 - c))))'), ('root', 'sqrt(c)')))} FROM (SELECT id, greatest(0.01::DOUBLE, least(0.99::DOUBLE, conf)) AS c FROM scored)")
def _(spark, sf):
    c = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("conf")))
    z = F.log(c / (1 - c))
    return rounded(base.scored(spark, sf).select("id", (-(c * F.log2(c) + (1 - c) * F.log2(1 - c))).alias("entropy"), z.alias("logit"), (1 / (1 + F.exp(-z))).alias("back"), F.sqrt(c).alias("root")))


@query("ar1_arrays", "WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, len(w) AS n, len(list_distinct(w)) AS n_distinct, list_contains(w, w[1]) AS has_first, w[2] AS second, array_to_string(w[1:3], '|') AS begin, coalesce(list_position(w, 'the'), 0) AS place FROM w")
def _(spark, sf):
    w = F.col("w")
    a = table(spark, sf, "conversations").filter(F.col("text").isNotNull()).select("conv_id", "turn", F.split("text", " ").alias("w"))
    return rounded(a.select("conv_id", "turn", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.array_contains(w, F.get(w, F.lit(0))).alias("has_first"), F.get(w, F.lit(1)).alias("second"), F.array_join(F.slice(w, 1, 3), "|").alias("begin"), F.array_position(w, "the").alias("place")))




@query("js1_nested_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("sc8_file_inventory")
def _(spark, sf):
    from graphlens.sources import kg

    return kg.inventory(spark, sf).groupBy("parent").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))

