"""More named queries: identifiers, evidence, arms and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text as tx
from graphlens.functions.hashing import det_number, unit
from graphlens.operators import arms, audit, evidence, metrics, prompts, reports, routing, sampling, stats, types
from graphlens.plans import base
from graphlens.plans.base import T, U, key, number
from graphlens.plans.queries import ARMS, BARE_SQL, FAITH, candidate_lists, features, query, r6, rounded, scored_sets
from graphlens.plans.queries import arms as two_arms

# ------------------------------------------------------------------ identifiers and names

IDS = "i AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '_NN_' || (user_id % 9) WHEN 1 THEN '__' || event_type || '_' || (user_id % 9) WHEN 2 THEN event_type || '_VB' || (user_id % 9) ELSE event_type END AS name FROM events)"


def names(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = (F.col("user_id") % 9).cast("string")
    name = F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit("_NN_"), n)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("__"), "event_type", F.lit("_"), n)).when(F.col("event_id") % 4 == 2, F.concat("event_type", F.lit("_VB"), n)).otherwise(F.col("event_type"))
    return e.select("event_id", name.alias("name"))


@query("ty1_pos_suffix", f"WITH {IDS} SELECT event_id, nullif(regexp_extract(name, '_(NN|VB|JJ|RB)_?[0-9]*$', 1), '') AS pos FROM i")
def _(spark, sf):
    return names(spark, sf).select("event_id", tx.pos_suffix(F.col("name")).alias("pos"))


@query("ty6_wordnet_ids", f"WITH {IDS}, t AS (SELECT *, '^(.+?)_(NN|VB|JJ|RB)_?([0-9]+)$' AS a, '^_*(.+?)_([0-9]+)$' AS b FROM i) SELECT event_id, CASE WHEN regexp_matches(name, a) THEN regexp_extract(name, a, 1) WHEN regexp_matches(name, b) THEN regexp_extract(name, b, 1) END AS lemma, CASE WHEN regexp_matches(name, a) THEN CASE regexp_extract(name, a, 2) WHEN 'NN' THEN 'n' WHEN 'VB' THEN 'v' WHEN 'JJ' THEN 'a' ELSE 'r' END END AS pos, CAST(CASE WHEN regexp_matches(name, a) THEN regexp_extract(name, a, 3) WHEN regexp_matches(name, b) THEN regexp_extract(name, b, 2) END AS INTEGER) AS sense FROM t")
def _(spark, sf):
    return names(spark, sf).select("event_id", tx.wordnet_id(F.col("name")).alias("w")).select("event_id", "w.lemma", "w.pos", "w.sense")


@query("ty2_relation_paths", "SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://[^/]*', ''), '/'), lambda x: x <> '')[1] AS domain, CASE WHEN len(list_filter(string_split(regexp_replace(url, '^https?://[^/]*', ''), '/'), lambda x: x <> '')) > 1 THEN list_filter(string_split(regexp_replace(url, '^https?://[^/]*', ''), '/'), lambda x: x <> '')[-1] END AS property FROM pages")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", tx.path_parts(F.regexp_replace("url", "^https?://[^/]*", "")).alias("x")).select("page_id", "x.domain", "x.property")


CLASSES = ("<wordnet_person_100007846>", "<wikicat_English_male_film_actors>", "<wikicategory_Cities_in_Texas>", "<http://schema.org/Person>", "<http://yago-knowledge.org/schema/Place>", "other")


@query("ty10_one_class_each", "WITH c AS (SELECT DISTINCT user_id, event_type AS class FROM events), n AS (SELECT class, count(*) AS n FROM c GROUP BY class), r AS (SELECT user_id, c.class, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN c.class LIKE 'p%' THEN 0 ELSE 1 END, n DESC, c.class) AS k FROM c JOIN n USING (class)) SELECT user_id AS entity, class FROM r WHERE k = 1")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("entity"), F.col("event_type").alias("class")).distinct()
    return types.one_class_each(c, F.when(F.col("class").startswith("p"), 0).otherwise(1))


ATOM = "CASE p_partkey % 5 WHEN 0 THEN '<wordnet_' || replace(lower(p_name), ' ', '_') || '_1000' || (p_partkey % 100) || '>' WHEN 1 THEN '<wikicat_' || replace(p_name, ' ', '_') || '_parts_of_' || replace(p_type, ' ', '_') || '>' WHEN 2 THEN '<http://schema.org/' || replace(p_type, ' ', '_') || '>' WHEN 3 THEN '<wikicategory_' || replace(p_name, ' ', '_') || 'es>' ELSE replace(p_name, ' ', '_') END"


HEAD = "list_filter(string_split(regexp_split_to_array(wiki, '_(?:in|of|from|by|at|for|about|with|during)_')[1], '_'), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$'))"
LAST = "lower(coalesce(list_filter(toks, lambda t: NOT ends_with(t, 'ed') AND lower(t) NOT IN ('and', 'or', 'the', 'a', 'an'))[-1], toks[1]))"
SINGULAR = "CASE WHEN ends_with(noun, 'ss') OR length(noun) <= 3 THEN noun " + " ".join(f"WHEN ends_with(noun, '{end}') THEN left(noun, length(noun) - {len(end)}) || '{put}'" for end, put in tx.PLURALS) + " ELSE noun END"
CLASS_SQL = f"atoms AS (SELECT p_partkey, trim({ATOM}, '<>') AS v FROM part), cl AS (SELECT p_partkey, nullif(regexp_extract(v, '^wordnet_([a-z][a-z_]*?)_[0-9]+$', 1), '') AS wordnet, lower(nullif(regexp_extract(v, '^https?://(?:schema\\.org|yago-knowledge\\.org/schema)/(\\w+)$', 1), '')) AS schema_name, nullif(regexp_extract(v, '^wikicat(?:egory)?_(.+)$', 1), '') AS wiki FROM atoms), hd AS (SELECT *, {HEAD} AS toks FROM cl), nn AS (SELECT *, {LAST} AS noun FROM hd)"


WIKI = "replace(p_name || CASE p_partkey % 4 WHEN 0 THEN 's by ' || p_brand WHEN 1 THEN ' classes_in_' || p_type WHEN 2 THEN ' bodies used_with_' || p_brand ELSE ' and ' || (1900 + p_size) END, ' ', '_')"


@query("st13_head_nouns", f"WITH w AS (SELECT {WIKI} AS wiki, count(*) AS n FROM part GROUP BY 1), hd AS (SELECT *, {HEAD} AS toks FROM w), nn AS (SELECT *, {LAST} AS noun FROM hd) SELECT wiki AS category, n, {SINGULAR} AS head FROM nn")
def _(spark, sf):
    """The head noun, in the singular, of each category: names with a preposition, a participle, a year or a conjunction at the end."""
    k = F.col("p_partkey") % 4
    more = F.when(k == 0, F.concat(F.lit("s by "), "p_brand")).when(k == 1, F.concat(F.lit(" classes_in_"), "p_type")).when(k == 2, F.concat(F.lit(" bodies used_with_"), "p_brand"))
    more = more.otherwise(F.concat(F.lit(" and "), (F.col("p_size") + 1900).cast("string")))
    c = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.replace(F.concat("p_name", more), F.lit(" "), F.lit("_")).alias("category")).agg(F.count("*").alias("n"))
    return c.select("category", "n", tx.category_head(F.col("category")).alias("head"))


@query("ty9_class_names", f"WITH {CLASS_SQL}, nw AS (SELECT *, {SINGULAR} AS one FROM nn) SELECT p_partkey, CASE WHEN wordnet IS NOT NULL THEN 'wordnet' WHEN schema_name IS NOT NULL THEN 'schema' WHEN one IS NOT NULL THEN 'wikicat' END AS kind, coalesce(wordnet, schema_name, one) AS name FROM nw")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    joined = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    k = F.col("p_partkey")
    atom = F.when(k % 5 == 0, F.concat(F.lit("<wordnet_"), F.lower(joined("p_name")), F.lit("_1000"), (k % 100).cast("string"), F.lit(">"))).when(k % 5 == 1, F.concat(F.lit("<wikicat_"), joined("p_name"), F.lit("_parts_of_"), joined("p_type"), F.lit(">")))
    atom = atom.when(k % 5 == 2, F.concat(F.lit("<http://schema.org/"), joined("p_type"), F.lit(">"))).when(k % 5 == 3, F.concat(F.lit("<wikicategory_"), joined("p_name"), F.lit("es>"))).otherwise(joined("p_name"))
    return p.select("p_partkey", tx.class_name(atom).alias("c")).select("p_partkey", "c.kind", "c.name")


@query("sc14_cell_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN 'S' || (o_orderkey % 5) END AS policy, CASE WHEN o_orderkey % 5 < 4 THEN CAST((o_orderkey % 3 + 1) * 100 AS INTEGER) END AS budget, CASE WHEN o_orderkey % 5 < 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'head' ELSE 'tail' END END AS direction FROM orders")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey")
    name = F.when(k % 5 < 4, F.concat(F.lit("S"), (k % 5).cast("string"), F.lit("_B"), ((k % 3 + 1) * 100).cast("string"), F.when(k % 2 == 0, "_head").otherwise("_tail"))).otherwise("notes")
    return o.select("o_orderkey", tx.cell_name(name).alias("c")).select("o_orderkey", "c.policy", "c.budget", "c.direction")


@query("ag3_id_shapes", "SELECT round(avg(CAST(regexp_matches(entity, '_(NN|VB|JJ|RB)_?[0-9]*$') AS DOUBLE)), 6) AS pos, round(avg(CAST(starts_with(entity, '/m/') AS DOUBLE)), 6) AS freebase, round(avg(CAST(regexp_matches(entity, '[0-9]+$') AS DOUBLE)), 6) AS numbered FROM ents")
def _(spark, sf):
    e = base.triples(spark, sf).select(F.explode(F.array("head", "tail")).alias("e")).distinct()
    share = lambda c: F.avg(c.cast("double"))
    return rounded(e.agg(share(F.col("e").rlike("_(NN|VB|JJ|RB)_?[0-9]*$")).alias("pos"), share(F.col("e").startswith("/m/")).alias("freebase"), share(F.col("e").rlike("[0-9]+$")).alias("numbered")))


@query("st6_logit_verdicts", "SELECT id, CAST(p_yes >= 1 - p_yes AS INTEGER) AS verdict, round(abs(p_yes - (1 - p_yes)) / (p_yes + (1 - p_yes)), 6) AS confidence, round(p_yes / (p_yes + (1 - p_yes)), 6) AS share FROM scored")
def _(spark, sf):
    p = F.col("p_yes")
    return base.scored(spark, sf).select("id", tx.verdict_from_scores(p, 1 - p).alias("verdict"), r6(tx.confidence_from_scores(p, 1 - p)).alias("confidence"), r6(tx.p_yes_share(p, 1 - p)).alias("share"))


# ------------------------------------------------------------------ evidence

PRED = f"p AS (SELECT qid, relation, tail AS gold, CASE {number('pred', 'qid')} % 4 WHEN 0 THEN tail WHEN 1 THEN head WHEN 2 THEN 'nobody ' || qid ELSE (SELECT min(x.tail) FROM test x WHERE x.relation = queries.relation) END AS text FROM queries)"


@query("ag39_ag41_hallucinations", f"WITH {PRED}, f AS (SELECT id, lower(split_part(text, ',', 1)) AS k, 0 AS kind FROM entities UNION ALL SELECT id, lower(text), 1 FROM entities UNION ALL SELECT id, lower(id), 1 FROM entities), s AS (SELECT k, coalesce(max(id) FILTER (kind = 0), min(id) FILTER (kind = 1)) AS e FROM f WHERE k <> '' GROUP BY k), c AS (SELECT p.relation, CASE WHEN e IS NULL THEN 'type1_oov' WHEN e = gold THEN 'correct' WHEN EXISTS (SELECT 1 FROM train t WHERE t.relation = p.relation) AND NOT EXISTS (SELECT 1 FROM train t WHERE t.relation = p.relation AND t.tail = e) THEN 'type2_type_violation' ELSE 'plausible_wrong' END AS category FROM p LEFT JOIN s ON s.k = lower(p.text)) SELECT relation, category, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY relation))::DOUBLE, 6) AS rate FROM c GROUP BY relation, category")
def _(spark, sf):
    q = base.with_qid(base.split(spark, sf, "test"))
    low = q.groupBy("relation").agg(F.min("tail").alias("low"))
    k = det_number("pred", "qid") % 4
    text = F.when(k == 0, F.col("tail")).when(k == 1, F.col("head")).when(k == 2, F.concat(F.lit("nobody "), "qid")).otherwise(F.col("low"))
    p = q.join(F.broadcast(low), "relation").select("qid", "relation", F.col("tail").alias("gold"), text.alias("text"))
    return rounded(evidence.rates(evidence.hallucinations(p, base.entities(spark, sf), base.split(spark, sf, "train")), "relation"))


@query("pt10_description_gate", r"WITH b AS (SELECT item_id AS id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS d FROM benchmark), n AS (SELECT lower(d) AS k, count(*) AS n FROM b GROUP BY 1), c AS (SELECT id, NOT regexp_matches(d, '^a relation') AS template, n = 1 AS \"distinct\", len(list_filter(regexp_split_to_array(d, '\s+'), lambda w: w <> '')) BETWEEN 6 AND 40 AS \"length\", len(list_distinct(list_filter(regexp_split_to_array(lower(d), '[^a-z0-9_]+'), lambda w: length(w) > 2 AND w <> 'the'))) >= 4 AS informative, regexp_matches(lower(d), 'person|place|location|organi|film|work|group|country|city|event|entity|concept|word|noun|verb|category|member|part') AS typed FROM b JOIN n ON n.k = lower(d)) SELECT *, template AND \"distinct\" AND \"length\" AND informative AND typed AS passed, NOT (template AND \"distinct\") AS rejected FROM c".replace('\\"', '"'))
def _(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("id"), "text", F.lit("the").alias("name"))
    return evidence.gate(b, "^a relation")


# ------------------------------------------------------------------ prompts and samples


@query("pt2_wrapped_prompts", "SELECT head, relation, tail, length('Is this true: ' || head || ' ' || relation || ' ' || tail || '?') + 140 AS n FROM test")
def _(spark, sf):
    w = prompts.wrapped(prompts.question(F.col("head"), F.col("relation"), F.col("tail")))
    return base.split(spark, sf, "test").select("head", "relation", "tail", F.length(w).cast("long").alias("n"))


@query("pt6_typed_prompts", "SELECT head, relation, tail, 'Is this true: ' || head || ' [' || regexp_extract(head, '^([A-Za-z]+):', 1) || '] ' || relation || ' ' || tail || ' [' || regexp_extract(tail, '^([A-Za-z]+):', 1) || ']?' AS prompt FROM test")
def _(spark, sf):
    tag = lambda c: F.concat(F.col(c), F.lit(" ["), tx.id_prefix(F.col(c)), F.lit("]"))
    return base.split(spark, sf, "test").withColumn("prompt", prompts.question(tag("head"), F.col("relation"), tag("tail")))


@query("pt14_same_share", "SELECT count(*) AS n, round(avg(CAST(coalesce(a.text, head) = head AND coalesce(b.text, tail) = tail AS DOUBLE)), 6) AS same_share FROM test LEFT JOIN entities a ON a.id = head LEFT JOIN entities b ON b.id = tail")
def _(spark, sf):
    t = prompts.with_text(base.split(spark, sf, "test"), base.entities(spark, sf))
    q = lambda h, x: prompts.question(F.col(h), F.col("relation"), F.col(x))
    return rounded(prompts.same_share(t.select(q("head", "tail").alias("a"), q("head_text", "tail_text").alias("b")), "a", "b"))


@query("sa15_instructions", f"SELECT head, relation, tail, label, 'Is this true: ' || head || ' ' || relation || ' ' || tail || '?' AS instruction, CASE WHEN label = 1 THEN 'Yes, this is true.' ELSE 'No, this is not true.' END AS output, {number('shuffle', *T, 'CAST(label AS VARCHAR)')} AS place FROM labelled")
def _(spark, sf):
    d = base.labelled(spark, sf)
    return d.select("head", "relation", "tail", "label", prompts.question(F.col("head"), F.col("relation"), F.col("tail")).alias("instruction"), prompts.verdict_text(F.col("label")).alias("output"), det_number("shuffle", *sampling.TRIPLE, F.col("label").cast("string")).alias("place"))


@query("sa20_validation_split", f"SELECT relation, {number('val', *T)} % 10000 < 1000 AS valid, count(*) AS n FROM train GROUP BY ALL")
def _(spark, sf):
    return base.split(spark, sf, "train").groupBy("relation", (det_number("val", *sampling.TRIPLE) % 10000 < 1000).alias("valid")).agg(F.count("*").alias("n"))


@query("ag9_coverage", f"WITH s AS (SELECT *, row_number() OVER (ORDER BY {base.key('cover', *T)}) AS k FROM train), n(n) AS (VALUES (1000), (5000)), e AS (SELECT DISTINCT n.n, u.e FROM n JOIN (SELECT k, head AS e FROM s UNION ALL SELECT k, tail FROM s) u ON u.k <= n.n) SELECT CAST(n AS BIGINT) AS n, count(*) AS n_entities FROM e GROUP BY n")
def _(spark, sf):
    train = base.split(spark, sf, "train")
    out = None
    for n in (1000, 5000):
        s = sampling.uniform_sample(train, n, "cover", *sampling.TRIPLE)
        one = s.select(F.explode(F.array("head", "tail")).alias("e")).distinct().agg(F.lit(n).cast("long").alias("n"), F.count("*").alias("n_entities"))
        out = one if out is None else out.unionByName(one)
    return out


@query("sa14_relation_candidates", "SELECT q.qid, r.relation AS candidate FROM queries q, (SELECT DISTINCT relation FROM triples) r")
def _(spark, sf):
    return sampling.relation_candidates(base.with_qid(base.split(spark, sf, "test")), base.triples(spark, sf).select("relation").distinct(), 100)


@query("sa14_capped_candidates", f"WITH x AS (SELECT q.qid, r.relation AS candidate, r.relation = q.relation AS gold, {key('relcand', 'q.qid', 'r.relation')} AS h FROM queries q, (SELECT DISTINCT relation FROM triples) r), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gold DESC, h) AS k FROM x) SELECT qid, candidate FROM k WHERE k <= 4")
def _(spark, sf):
    """More relations than the cap of four: the gold one, and others by a hash of the query."""
    return sampling.relation_candidates(base.with_qid(base.split(spark, sf, "test")), base.triples(spark, sf).select("relation").distinct(), 4)


@query("se9_candidate_audit", "WITH c AS (SELECT qid, count(*) AS n, sum(is_gold) AS g, count(*) FILTER (is_gold = 0 AND EXISTS (SELECT 1 FROM triples t WHERE t.head = candidates.head AND t.relation = candidates.relation AND t.tail = candidates.candidate)) AS bad FROM candidates GROUP BY qid) SELECT count(*) AS n_queries, min(n) AS least, max(n) AS most, count(*) FILTER (g <> 1) AS without_gold, CAST(sum(bad) AS BIGINT) AS contaminated FROM c")
def _(spark, sf):
    known = base.graph_of(spark, sf).select("head", "relation", F.col("tail").alias("candidate"))
    c = sampling.with_gold(candidate_lists(spark, sf))
    others = c.select("head", "relation", F.explode(F.filter("c", lambda x: x["is_gold"] == 0)["candidate"]).alias("candidate"))
    bad = sampling.known_among(others, known, "head", "relation", "candidate").agg(F.count("*")).scalar()
    q = c.select(F.size("c").cast("long").alias("n"), F.size(F.filter("c", lambda x: x["is_gold"] == 1)).alias("g"))
    return q.agg(F.count("*").alias("n_queries"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("g") != 1).alias("without_gold"), F.when(F.count("*") > 0, bad).alias("contaminated"))


# ------------------------------------------------------------------ arms and policies

POLICIES = ("S0", "S1", "S2")
PR = "pr AS (SELECT p.policy, q.qid, " + number("prank", "p.policy", "q.qid") + " % 10 + 1 AS rank, " + number("ptok", "p.policy", "q.qid") + " % 200 AS tokens FROM queries q, (VALUES ('S0'), ('S1'), ('S2')) p(policy))"


def policy_ranks(spark, sf):
    q = base.with_qid(base.split(spark, sf, "test")).select("qid")
    q = q.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in POLICIES])))
    return q.withColumns({"rank": det_number("prank", "policy", "qid") % 10 + 1, "tokens": det_number("ptok", "policy", "qid") % 200})


@query("ag49_selection_ceiling", f"WITH {PR}, b AS (SELECT qid, min(rank) AS r FROM pr GROUP BY qid) SELECT count(*) AS n, round(avg(1.0::DOUBLE / r), 6) AS mrr, round(avg(CAST(r <= 1 AS DOUBLE)), 6) AS hits_1 FROM b")
def _(spark, sf):
    return rounded(arms.selection_ceiling(policy_ranks(spark, sf)))


@query("ag49_win_share", f"WITH {PR}, b AS (SELECT policy, row_number() OVER (PARTITION BY qid ORDER BY rank, policy) AS k FROM pr) SELECT policy, count(*) AS wins, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM b WHERE k = 1 GROUP BY policy")
def _(spark, sf):
    return rounded(arms.win_share(policy_ranks(spark, sf)))


@query("ag50_efficiency", f"WITH {PR} SELECT policy, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(tokens), 6) AS tokens, round(avg(1.0::DOUBLE / rank) * 1000 / nullif(avg(tokens), 0), 6) AS mrr_per_1k FROM pr GROUP BY policy")
def _(spark, sf):
    return rounded(arms.efficiency(policy_ranks(spark, sf)))


@query("ag50_headroom", f"WITH {PR}, m AS (SELECT policy, avg(1.0::DOUBLE / rank) AS mrr FROM pr GROUP BY policy), t AS (SELECT avg(1.0::DOUBLE / r) AS top FROM (SELECT min(rank) AS r FROM pr GROUP BY qid)), l AS (SELECT mrr AS low FROM m WHERE policy = 'S0') SELECT policy, round(mrr, 6) AS mrr, round(CASE WHEN top - low > 1e-9 THEN (mrr - low) / (top - low) END, 6) AS recovered FROM m, t, l")
def _(spark, sf):
    return rounded(arms.headroom(policy_ranks(spark, sf), "S0"))


@query("ag51_leaderboard", f"WITH {PR}, c AS (SELECT policy, CAST(tokens // 50 AS BIGINT) AS budget, avg(1.0::DOUBLE / rank) AS mrr FROM pr GROUP BY ALL) SELECT policy, budget, round(mrr, 6) AS mrr, row_number() OVER (PARTITION BY budget ORDER BY mrr DESC, policy) AS place, round(mrr - max(mrr) FILTER (policy = 'S0') OVER (PARTITION BY budget), 6) AS lead FROM c")
def _(spark, sf):
    c = arms.mrr_by(policy_ranks(spark, sf).withColumn("budget", F.floor(F.col("tokens") / 50)), "policy", "budget").drop("n")
    return rounded(arms.leaderboard(c, "S0"))


@query("ag52_chance_mrr", "SELECT n_nationkey AS n, round((SELECT sum(1.0::DOUBLE / k) FROM range(1, n_nationkey + 1) r(k)) / n_nationkey, 6) AS chance FROM nation WHERE n_nationkey > 0")
def _(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey > 0")
    return n.select(F.col("n_nationkey").alias("n"), r6(arms.chance_mrr(F.col("n_nationkey").cast("int"))).alias("chance"))


@query("ag26_gap_table", f"WITH {ARMS}, a AS (SELECT relation AS condition, avg(a) AS r, avg(b) AS n FROM arm GROUP BY relation) SELECT condition, round(r - n, 6) AS gap, 0.5::DOUBLE AS chance_level, round(CASE WHEN r > 0.5 THEN (r - n) / (r - 0.5::DOUBLE) END, 6) AS memorisation_share FROM a")
def _(spark, sf):
    a = two_arms(spark, sf).groupBy(F.col("relation").alias("condition")).agg(F.avg("a").alias("acc_real"), F.avg("b").alias("acc_anon")).withColumn("floor", F.lit(None).cast("double"))
    return rounded(arms.gap_table(a))


@query("ag54_data_axis", "WITH p AS (SELECT user_id AS run, event_id AS n, value AS acc FROM events), f AS (SELECT run, arg_max(acc, n) AS \"full\" FROM p GROUP BY run) SELECT p.run, min(p.n) AS enough, round(max(\"full\"), 6) AS \"full\" FROM p JOIN f ON f.run = p.run WHERE p.acc >= 0.95::DOUBLE * f.\"full\" GROUP BY p.run")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("n"), F.col("value").alias("acc"))
    return rounded(arms.data_axis(p))


@query("ag33_bonferroni", f"WITH t AS ({BARE_SQL['ag31_mcnemar']}) SELECT relation, p_exact AS p, round(least(1, p_exact * count(*) OVER ()), 6) AS p_adjusted, least(1, p_exact * count(*) OVER ()) < 0.05 AS significant FROM t")
def _(spark, sf):
    """The exact McNemar p of each relation, corrected for their number."""
    t = rounded(stats.mcnemar(two_arms(spark, sf), "relation")).select("relation", F.col("p_exact").alias("p"))
    return rounded(stats.bonferroni(t).withColumn("significant", F.col("p_adjusted") < 0.05))


@query("ag18_confusion_summary", "WITH p AS (SELECT relation AS gold, CASE WHEN correct = 1 THEN relation ELSE 'contains' END AS pred FROM scored), k AS (SELECT gold AS class FROM p UNION SELECT pred FROM p), c AS (SELECT class, (SELECT count(*) FROM p WHERE gold = class) AS support, (SELECT count(*) FROM p WHERE pred = class) AS predicted, (SELECT count(*) FROM p WHERE gold = class AND pred = class) AS hit FROM k), f AS (SELECT *, coalesce(2.0::DOUBLE * hit / nullif(support + predicted, 0), 0) AS f1 FROM c), t AS (SELECT gold, pred, count(*) AS n FROM p WHERE gold <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 1) SELECT round((SELECT avg(CAST(gold = pred AS DOUBLE)) FROM p), 6) AS accuracy, round(avg(f1) FILTER (support > 0), 6) AS macro_f1, round(2.0::DOUBLE * sum(hit) / (sum(support) + sum(predicted)), 6) AS micro_f1, count(*) FILTER (support > 0) AS n_observed, (SELECT gold FROM t) AS top_gold, (SELECT pred FROM t) AS top_pred, (SELECT n FROM t) AS top_n FROM f")
def _(spark, sf):
    s = base.scored(spark, sf).select(F.col("relation").alias("gold"), F.when(F.col("correct") == 1, F.col("relation")).otherwise("contains").alias("pred"))
    return rounded(reports.confusion_summary(s, "gold", "pred"))


@query("ag62_forgetting", "WITH e AS (SELECT event_type AS method, exp(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1) / 100) AS perplexity FROM events GROUP BY event_type), b AS (SELECT perplexity AS base FROM e WHERE method = 'view') SELECT method, round(perplexity, 6) AS perplexity, round(perplexity - base, 6) AS delta, round((perplexity - base) / base, 6) AS relative, CASE WHEN perplexity - base <= 0.05 * base THEN 'preserved' WHEN perplexity - base <= 0.25 * base THEN 'degraded' ELSE 'substantial forgetting' END AS reading FROM e, b WHERE method <> 'view'")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("method"), (F.col("value") / 100).alias("nll"), (F.col("event_id") % 7 + 1).alias("w"))
    return rounded(reports.forgetting(metrics.perplexity(e, "nll", "w", "method"), "view"))


@query("ag62_perplexity", "SELECT event_type, round(exp(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1) / 100), 6) AS perplexity FROM events GROUP BY event_type")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", (F.col("value") / 100).alias("nll"), (F.col("event_id") % 7 + 1).alias("w"))
    return rounded(metrics.perplexity(e, "nll", "w", "event_type"))


@query("ag20_even_bins", "WITH b(bin, lo, hi) AS (VALUES " + ", ".join(f"({i}, {i / 10!r}::DOUBLE, {(i + 1) / 10!r}::DOUBLE)" for i in range(10)) + ") SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(CAST(correct AS DOUBLE)), 6) AS acc FROM scored s JOIN b ON (s.conf > lo OR (lo = 0 AND s.conf >= lo)) AND s.conf <= hi GROUP BY bin")
def _(spark, sf):
    return rounded(metrics.reliability(base.scored(spark, sf), "conf", "correct", edges=metrics.EVEN_EDGES))


@query("ag44_normalised_confidence", "SELECT id, round((p_yes - min(p_yes) OVER ()) / (max(p_yes) OVER () - min(p_yes) OVER () + 1e-9::DOUBLE), 6) AS conf FROM scored")
def _(spark, sf):
    s = base.scored(spark, sf)
    span = s.agg(F.min("p_yes").alias("lo"), F.max("p_yes").alias("hi"))
    return s.crossJoin(F.broadcast(span)).select("id", r6((F.col("p_yes") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).alias("conf"))  # one row


@query("ma2_standardised", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / (stddev_pop(value) OVER (PARTITION BY event_type) + 1e-8::DOUBLE), 5) AS z FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    m = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return e.join(F.broadcast(m), "event_type").select("event_id", F.round((F.col("value") - F.col("mean")) / (F.col("sd") + 1e-8), 5).alias("z"))  # one row a type


@query("rt8_single_element_probe", f"WITH {FAITH} SELECT * FROM faith WHERE id = 'nation:1'")
def _(spark, sf):
    return rounded(routing.faithfulness(features(spark, sf).filter("id = 'nation:1'")))


@query("jo9_shared_queries", f"WITH {PR} SELECT count(*) AS n FROM (SELECT qid FROM pr WHERE rank <= 5 GROUP BY qid HAVING count(DISTINCT policy) = 3)")
def _(spark, sf):
    r = policy_ranks(spark, sf).filter("rank <= 5").groupBy("qid").agg(F.count_distinct("policy").alias("n")).filter(F.col("n") == len(POLICIES))
    return r.agg(F.count("*").alias("n"))


@query("wi12_largest_changes", f"WITH {PR}, d AS (SELECT a.qid, CAST(b.rank - a.rank AS BIGINT) AS delta FROM pr a JOIN pr b ON a.qid = b.qid AND a.policy = 'S0' AND b.policy = 'S1') SELECT qid, delta FROM d ORDER BY delta, qid LIMIT 20")
def _(spark, sf):
    p = policy_ranks(spark, sf)
    a, b = (p.filter(F.col("policy") == x).select("qid", F.col("rank").alias(x)) for x in ("S0", "S1"))
    return a.join(b, "qid").select("qid", (F.col("S1") - F.col("S0")).alias("delta")).orderBy("delta", "qid").limit(20)


@query("ag58_specificity", "WITH w AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS t FROM entities), d AS (SELECT t, count(*) AS df FROM w GROUP BY t), s AS (SELECT id, avg(1.0::DOUBLE / (df + 1)) AS s FROM w JOIN d USING (t) GROUP BY id) SELECT CAST(least(4, floor(s * 80)) AS BIGINT) AS depth, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    w = base.entities(spark, sf).select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("t")).distinct()
    df = w.groupBy("t").agg(F.count("*").alias("df"))
    s = w.join(df, "t").groupBy("id").agg(F.avg(1 / (F.col("df") + 1)).alias("s"))
    return s.groupBy(F.least(F.lit(4), F.floor(F.col("s") * 80)).cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("ag58_shape", "WITH w AS (SELECT DISTINCT id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS t FROM entities), d AS (SELECT t, count(*) AS df FROM w GROUP BY t), s AS (SELECT id, avg(1.0::DOUBLE / (df + 1)) AS s FROM w JOIN d USING (t) GROUP BY id), h AS (SELECT least(4, floor(s * 80)) AS depth, count(*) AS n FROM s GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS buckets, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, round(max(n) / sum(n)::DOUBLE, 6) AS top_share FROM h")
def _(spark, sf):
    """Entropy and the share of the largest bucket of the depths."""
    w = base.entities(spark, sf).select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("t")).distinct()
    s = w.join(w.groupBy("t").agg(F.count("*").alias("df")), "t").groupBy("id").agg(F.avg(1 / (F.col("df") + 1)).alias("s"))
    return rounded(reports.shape(s.groupBy(F.least(F.lit(4), F.floor(F.col("s") * 80)).alias("depth")).agg(F.count("*").alias("n"))))


@query("ag59_projected_vectors", f"SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * ({U.format(number('dir', 'CAST(i AS VARCHAR)'))} - 0.5::DOUBLE))), 6) AS p FROM embeddings")
def _(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (unit("dir", (i + 1).cast("string")) - F.lit(0.5))), F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", r6(p).alias("p"))



# ------------------------------------------------------------------ splits, distributions, pairs


@query("se5_unseen_share", "WITH e AS (SELECT head AS e FROM test UNION SELECT tail FROM test), s AS (SELECT head AS e FROM train UNION SELECT tail FROM train) SELECT count(*) AS n, round(avg(CAST(s.e IS NULL AS DOUBLE)), 6) AS unseen FROM e LEFT JOIN s ON s.e = e.e")
def _(spark, sf):
    e = audit.ends(base.split(spark, sf, "test"))
    s = audit.ends(base.split(spark, sf, "train")).withColumn("seen", F.lit(1))
    return rounded(e.join(s, "entity", "left").agg(F.count("*").alias("n"), F.avg(F.col("seen").isNull().cast("double")).alias("unseen")))


@query("ag67_degenerate_ranking", f"WITH s AS (SELECT qid, count(*) AS n, max(score) - min(score) AS spread FROM cscored GROUP BY qid) SELECT max(spread) < 0.05 AS degenerate, count(*) FILTER (n < {base.N_WAY}) AS short_sets, round(max(spread), 6) AS largest_spread FROM s")
def _(spark, sf):
    scores = F.transform("c", lambda x: x["score"])
    s = scored_sets(spark, sf).select(F.size("c").alias("n"), (F.array_max(scores) - F.array_min(scores)).alias("spread"))
    return rounded(s.agg((F.max("spread") < 0.05).alias("degenerate"), F.count_if(F.col("n") < base.N_WAY).alias("short_sets"), F.max("spread").alias("largest_spread")))


@query("ag71_prediction_distribution", "WITH v AS (SELECT relation, p_yes >= 0.5 AS yes FROM scored) SELECT relation, count(*) AS n, count(*) FILTER (yes) AS n_yes, count(DISTINCT yes) = 1 AS always_same FROM v GROUP BY relation")
def _(spark, sf):
    v = base.scored(spark, sf).select("relation", (F.col("p_yes") >= 0.5).alias("yes"))
    return v.groupBy("relation").agg(F.count("*").alias("n"), F.count_if("yes").alias("n_yes"), (F.count_distinct("yes") == 1).alias("always_same"))


@query("ag34_all_pairs", f"WITH {ARMS}, a AS (SELECT relation, avg(a) AS acc FROM arm GROUP BY relation) SELECT x.relation AS one, y.relation AS other, round(x.acc - y.acc, 6) AS diff FROM a x JOIN a y ON x.relation < y.relation")
def _(spark, sf):
    a = two_arms(spark, sf).groupBy("relation").agg(F.avg("a").alias("acc"))
    x, y = a.select(F.col("relation").alias("one"), F.col("acc").alias("xa")), a.select(F.col("relation").alias("other"), F.col("acc").alias("ya"))
    return x.join(F.broadcast(y), F.col("one") < F.col("other")).select("one", "other", r6(F.col("xa") - F.col("ya")).alias("diff"))  # one row a relation


@query("jo11_paired_runs", f"WITH {PR} SELECT count(*) AS n, round(avg(abs(a.rank - b.rank)), 6) AS mean_delta, CAST(max(abs(a.rank - b.rank)) AS BIGINT) AS largest FROM pr a JOIN pr b ON a.qid = b.qid AND a.policy = 'S0' AND b.policy = 'S2'")
def _(spark, sf):
    r = policy_ranks(spark, sf)
    a, b = (r.filter(F.col("policy") == x).select("qid", F.col("rank").alias(x)) for x in ("S0", "S2"))
    d = F.abs(F.col("S0") - F.col("S2"))
    return rounded(a.join(b, "qid").agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.max(d).alias("largest")))


@query("ag27_recovery", f"WITH {ARMS}, m AS (SELECT avg(a) AS a, avg(b) AS b FROM arm), r AS (SELECT relation, avg(a) AS acc FROM arm GROUP BY relation) SELECT relation, round(CASE WHEN a - b > 1e-9 THEN (acc - b) / (a - b) END, 6) AS recovered FROM r, m")
def _(spark, sf):
    t = two_arms(spark, sf)
    m = t.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    r = t.groupBy("relation").agg(F.avg("a").alias("acc"))
    return r.crossJoin(F.broadcast(m)).select("relation", r6(arms.recovery(F.col("acc"), F.col("ma"), F.col("mb"))).alias("recovered"))  # one row
