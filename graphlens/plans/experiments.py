"""Named queries on conditions, contexts and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphlens.functions import text as tx
from graphlens.functions.hashing import det_key, det_number
from graphlens.operators import budget, conditions, context, graph, joins, prompts, ranking, reports, routing, sampling, types
from graphlens.plans import base
from graphlens.plans.base import T, U, key, number
from graphlens.plans.queries import BARE_SQL, INV, ORACLE_SQL, PLANS, SAFE, TYPED, features, query, rounded, scored_sets

TRIPLE = sampling.TRIPLE
O = ORACLE_SQL  # noqa: E741  SQL of other queries, taken as subqueries


def tests(spark, sf):
    return base.with_qid(base.split(spark, sf, "test"))


def shown(spark, sf):
    return prompts.with_text(base.split(spark, sf, "test"), base.entities(spark, sf))


NAMED = "nm AS (SELECT t.*, coalesce(a.text, t.head) AS ht, coalesce(b.text, t.tail) AS tt FROM test t LEFT JOIN entities a ON a.id = t.head LEFT JOIN entities b ON b.id = t.tail)"
PRE = "regexp_extract({}, '^([A-Za-z]+):', 1)"

# ------------------------------------------------------------------ conditions, grids and training sets


#: Negatives of a triple under condition E.
MANY = 6
MANY_SQL = f"many AS (SELECT tn.*, j, CASE WHEN n - 1 > 0 THEN {number('typed-many', *T, 'CAST(j AS VARCHAR)')} % (n - 1) END AS pick FROM tn, (SELECT unnest(range(0, {MANY})) AS j)), many_neg AS (SELECT many.head, many.relation, p.new AS tail FROM many JOIN pool p ON p.relation = many.relation AND p.idx = many.pick + CASE WHEN many.pick >= many.gold THEN 1 ELSE 0 END)"


def _condition_sql() -> str:
    """Rows of each kind of negatives once, named in three ways once, then shown under every condition."""
    letters = ", ".join(f"('{k}', '{c.names}', {str(c.tags).lower()}, '{c.negatives}')" for k, c in conditions.CONDITIONS.items())
    show = lambda e: f"CASE names WHEN 'real' THEN coalesce({e}e.text, {e}) WHEN 'anonymous' THEN coalesce({e}a.text, {e}) ELSE coalesce({e}p.text, {e}) END || CASE WHEN tags THEN ' (' || {PRE.format(e)} || ')' ELSE '' END"
    joins_of = " ".join(f"LEFT JOIN {t} {e}{t[0]} ON {e}{t[0]}.id = r.{e}" for e in ("head", "tail") for t in ("entities", "anon", "perm"))
    return f"""WITH {TYPED}, {MANY_SQL}, random_neg AS ({BARE_SQL['sa5_random_negatives']}), anon AS ({BARE_SQL['pr1_anonymise']}), perm AS ({BARE_SQL['pr2_permute']}),
  negs AS (SELECT 'random' AS kind, neg_head AS head, relation, neg_tail AS tail FROM random_neg UNION ALL SELECT 'typed', head, relation, neg_tail FROM typed WHERE neg_tail IS NOT NULL UNION ALL SELECT 'typed_many', head, relation, tail FROM many_neg),
  rows AS (SELECT kind, head, relation, tail, 1 AS label FROM test, (SELECT DISTINCT kind FROM negs) UNION ALL SELECT kind, head, relation, tail, -1 FROM negs), c(condition, names, tags, kind) AS (VALUES {letters})
  SELECT condition, head, relation, tail, label, 'Is this true: ' || {show('head')} || ' ' || relation || ' ' || {show('tail')} || '?' AS prompt FROM rows r {joins_of} JOIN c ON c.kind = r.kind"""


def instances(spark, sf):
    test, known = base.split(spark, sf, "test"), base.graph_of(spark, sf).drop("split")
    pool = sampling.tail_pool(known)
    random = sampling.random_negatives(test, sampling.entity_index(known)).select(F.col("neg_head").alias("head"), "relation", F.col("neg_tail").alias("tail"))
    typed = sampling.typed_negatives(test, known, pool=pool).filter(F.col("neg_tail").isNotNull()).select("head", "relation", F.col("neg_tail").alias("tail"))
    many = sampling.typed_negatives(test, known, "typed-many", MANY, pool).filter(F.col("neg_tail").isNotNull()).select("head", "relation", F.col("neg_tail").alias("tail"))
    return conditions.instances(test, {"random": random, "typed": typed, "typed_many": many}, base.entities(spark, sf))


query("sa16_conditions", _condition_sql())(instances)


@query("se7_built_instances", f"SELECT condition, count(*) AS n, round(avg(CAST(label = 1 AS DOUBLE)), 6) AS positive_rate, CAST(quantile_disc(length(prompt), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(length(prompt), 0.99) AS BIGINT) AS p99, count(*) FILTER (prompt = '') AS n_empty FROM ({_condition_sql()}) GROUP BY condition")
def _(spark, sf):
    n = F.length("prompt")
    return rounded(instances(spark, sf).groupBy("condition").agg(F.count("*").alias("n"), F.avg((F.col("label") == 1).cast("double")).alias("positive_rate"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length(prompt))").cast("long").alias("p50"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY length(prompt))").cast("long").alias("p99"), F.count_if(n == 0).alias("n_empty")))


@query("se8_condition_pairs", f"WITH i AS MATERIALIZED ({_condition_sql()}), r AS (SELECT *, {number('row', 'head', 'relation', 'tail', 'CAST(label AS VARCHAR)')} AS id FROM i), s AS (SELECT condition, count(*) AS n, CAST(sum(id % 1000003) AS BIGINT) AS sig FROM r GROUP BY condition), u AS (SELECT condition, id, count(*) AS m, min(prompt) AS prompt FROM r GROUP BY ALL), p AS (SELECT a.condition AS a, b.condition AS b, sum(least(a.m, b.m)) AS n_both, count(*) FILTER (a.prompt = b.prompt) AS n_same FROM u a JOIN u b ON a.id = b.id AND a.condition < b.condition GROUP BY ALL) SELECT x.condition AS a, y.condition AS b, x.n AS n_a, y.n AS n_b, x.n = y.n AND x.sig = y.sig AS aligned, CAST(coalesce(p.n_both, 0) AS BIGINT) AS n_both, coalesce(p.n_same, 0) AS n_same_prompt FROM s x JOIN s y ON x.condition < y.condition LEFT JOIN p ON p.a = x.condition AND p.b = y.condition")
def _(spark, sf):
    """Pairs of conditions: same signature of the rows, how many rows they share, and how many of these show the same prompt."""
    rows = instances(spark, sf).withColumn("id", det_number("row", *TRIPLE, F.col("label").cast("string")))
    return rounded(conditions.aligned(rows))


TAG_FLOORS = f"WITH pt AS (SELECT DISTINCT entity, {PRE.format('entity')} AS type FROM ents), n AS (SELECT relation, type, count(*) AS n FROM train t JOIN pt ON pt.entity = t.tail GROUP BY ALL), m AS (SELECT relation, type AS modal FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n DESC, type) AS k FROM n) WHERE k = 1), tr AS (SELECT DISTINCT relation, tail FROM train), j AS (SELECT l.relation, l.label, coalesce(pt.type = m.modal, false) AS f1, tr.tail IS NOT NULL AS f2 FROM labelled l LEFT JOIN pt ON pt.entity = l.tail LEFT JOIN m ON m.relation = l.relation LEFT JOIN tr ON tr.relation = l.relation AND tr.tail = l.tail), r AS (SELECT relation, 'MODAL' AS rule, label, f1 AS fires FROM j UNION ALL SELECT relation, 'RANGE', label, f2 FROM j), o AS (SELECT relation, rule, avg(CAST(fires AS DOUBLE)) FILTER (label = 1) AS fp, avg(CAST(fires AS DOUBLE)) FILTER (label <> 1) AS fn, avg(CAST(fires = (label = 1) AS DOUBLE)) AS accuracy FROM r GROUP BY ALL), floors AS (SELECT *, coalesce(fp > 0.98 AND fn > 0.98 OR fp < 0.02 AND fn < 0.02, true) AS vacuous FROM o)"


@query("se14_leak_gate", TAG_FLOORS + ", c(condition, tags) AS (VALUES " + ", ".join(f"('{k}', {str(c.tags).lower()})" for k, c in conditions.CONDITIONS.items()) + ") SELECT condition, relation, rule, round(accuracy, 6) AS floor FROM floors, c WHERE tags AND NOT vacuous AND accuracy >= 0.55")
def _(spark, sf):
    """Conditions that show type tags are blocked on the relations where a tag alone answers well."""
    e = base.triples(spark, sf).select(F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("text", F.lit(""))
    floors = types.tag_leak(base.split(spark, sf, "train"), base.labelled(spark, sf), types.types_by_identifier(e), "relation")
    return rounded(conditions.blocked(floors))


POLICIES, BUDGETS, DIRECTIONS = ("S0", "R", "S1", "S2", "S3", "S4"), (100, 200, 400), ("tail", "head")


@query("ba4_grid", "WITH p(policy) AS (VALUES ('S0'), ('R'), ('S1'), ('S2'), ('S3'), ('S4')), b(budget) AS (VALUES (100), (200), (400)), d(direction) AS (VALUES ('tail'), ('head')) SELECT policy || '_B' || budget || '_' || direction AS run, policy, budget, direction, count(*) AS n, CAST(sum(number) AS BIGINT) AS fingerprint FROM (SELECT {} % 1000003 AS number FROM queries), p, b, d GROUP BY ALL".format(number("grid", "qid")))
def _(spark, sf):
    g = conditions.grid(tests(spark, sf).select("qid"), POLICIES, BUDGETS, DIRECTIONS)
    return rounded(g.groupBy("run", "policy", "budget", "direction").agg(F.count("*").alias("n"), F.sum(det_number("grid", "qid") % 1000003).alias("fingerprint")))


def _pick(values, seed, *parts):
    return f"[{', '.join(repr(v) for v in values)}][{number(seed, *parts)} % {len(values)} + 1]"


@query("sa18_mixed_training", f"WITH neg AS (SELECT n.head, n.relation, n.neg_tail AS tail FROM ({O['sa6_typed_negatives']}) n WHERE neg_tail IS NOT NULL AND NOT EXISTS (SELECT 1 FROM triples k WHERE k.head = n.head AND k.relation = n.relation AND k.tail = n.neg_tail)), a AS (SELECT head, relation, tail, 1 AS label FROM test UNION ALL SELECT head, relation, tail, -1 FROM neg) SELECT head, relation, tail, label, {_pick(POLICIES, 'mix-p', *T)} AS policy, {_pick(BUDGETS, 'mix-b', *T)} AS budget, {_pick(DIRECTIONS, 'mix-d', *T)} AS direction FROM a")
def _(spark, sf):
    test, known = base.split(spark, sf, "test"), base.graph_of(spark, sf).drop("split")
    neg = sampling.typed_negatives(test, known).filter(F.col("neg_tail").isNotNull()).select("head", "relation", F.col("neg_tail").alias("tail")).join(known, TRIPLE, "left_anti")
    rows = test.select(*TRIPLE, F.lit(1).alias("label")).unionByName(neg.select(*TRIPLE, F.lit(-1).alias("label")))
    return rounded(rows.withColumns({"policy": conditions.choice(POLICIES, "mix-p", *TRIPLE), "budget": conditions.choice(BUDGETS, "mix-b", *TRIPLE), "direction": conditions.choice(DIRECTIONS, "mix-d", *TRIPLE)}))


@query("sa19_qualitative_sample", f"SELECT head, relation, tail, label FROM labelled ORDER BY {key('quali', *T, 'CAST(label AS VARCHAR)')} LIMIT 30")
def _(spark, sf):
    d = base.labelled(spark, sf).withColumn("h", det_key("quali", *TRIPLE, F.col("label").cast("string")))
    return rounded(d.orderBy("h").limit(30).drop("h"))


@query("sa21_permutation_split", f"SELECT id, CASE WHEN row_number() OVER (ORDER BY {key('perm-split', 'id')}, id) <= floor((SELECT count(*) FROM scored) * 0.3) THEN 'validation' ELSE 'test' END AS part FROM scored")
def _(spark, sf):
    return sampling.validation_part(base.scored(spark, sf).select("id"), "id")


@query("sk4_report_table", "WITH m AS (SELECT relation, count(*) AS n, count(*) FILTER (label = 1) AS positive FROM labelled GROUP BY relation) SELECT 1 AS place, '| Relation | Rows | Positive |' AS line UNION ALL SELECT 2, '|-|-|-|' UNION ALL SELECT 2 + row_number() OVER (ORDER BY relation), '| ' || relation || ' | ' || n || ' | ' || positive || ' |' FROM m")
def _(spark, sf):
    m = base.labelled(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positive"))
    return reports.markdown(m, "relation", {"Relation": "relation", "Rows": "n", "Positive": "positive"})


@query("sa7_near_misses", f"WITH r AS (SELECT qid, candidate, is_gold, row_number() OVER (PARTITION BY qid ORDER BY score DESC, candidate) AS k FROM cscored), c AS (SELECT qid, candidate, row_number() OVER (PARTITION BY qid ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY qid) AS n FROM r WHERE k <= 20 AND is_gold = 0) SELECT qid, candidate AS near_miss FROM c WHERE i = {number('near', 'qid')} % n")
def _(spark, sf):
    best = F.array_sort(F.transform("c", lambda x: F.struct((-x["score"]).alias("s"), x["candidate"].alias("candidate"), x["is_gold"].alias("is_gold"))))
    c = scored_sets(spark, sf).select("qid", F.filter(F.slice(best, 1, 20), lambda x: x["is_gold"] == 0).alias("c"))
    return c.filter(F.size("c") > 0).select("qid", F.get("c", (det_number("near", "qid") % F.size("c")).cast("int"))["candidate"].alias("near_miss"))


# ------------------------------------------------------------------ prompts and context


@query("pt3_optional_blocks", f"WITH {NAMED}, x AS ({O['pt5_exclusions']}) SELECT nm.head, nm.relation, nm.tail, 'Is this true: ' || ht || ' ' || nm.relation || ' ' || tt || '? Type: ' || {PRE.format('nm.head')} || '.' || CASE WHEN x.exclusions IS NULL THEN '' ELSE ' Known: ' || x.exclusions || '.' END AS prompt FROM nm LEFT JOIN x ON x.head = nm.head AND x.relation = nm.relation")
def _(spark, sf):
    x = prompts.exclusions(base.split(spark, sf, "train"), 10)
    s = shown(spark, sf).join(x, ["head", "relation"], "left")
    known = F.coalesce(F.concat(F.lit(" Known: "), "exclusions", F.lit(".")), F.lit(""))
    return s.select(*TRIPLE, F.concat(prompts.question(F.col("head_text"), F.col("relation"), F.col("tail_text")), F.lit(" Type: "), tx.id_prefix(F.col("head")), F.lit("."), known).alias("prompt"))


@query("pt8_slots", f"WITH {NAMED} SELECT head, relation, tail, 'tail' AS direction, 'Is this true: ' || ht || ' ' || relation || ' ' AS prefix, '?' AS suffix FROM nm UNION ALL SELECT head, relation, tail, 'head', 'Is this true: ', ' ' || relation || ' ' || tt || '?' FROM nm UNION ALL SELECT head, relation, tail, 'relation', 'Is this true: ' || ht || ' ', ' ' || tt || '?' FROM nm")
def _(spark, sf):
    return conditions.slots(shown(spark, sf))


EXAMPLES = "ex AS (SELECT relation, string_agg(head || ' -> ' || tail, '; ' ORDER BY head, tail) AS text FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY head, tail) AS k FROM train) WHERE k <= 2 GROUP BY relation)"


@query("pt11_relation_examples", f"WITH {EXAMPLES} SELECT relation, text FROM ex")
def _(spark, sf):
    return context.examples(base.split(spark, sf, "train"), 2)


@query("pt15_policy_distinctness", f"WITH {PLANS}, f AS (SELECT level, CAST(sum({number('pd', 'id', 'action')} % 1000003) AS BIGINT) AS f FROM plans GROUP BY level) SELECT count(*) AS n_policies, count(DISTINCT f) AS n_distinct FROM f")
def _(spark, sf):
    f = routing.routed(features(spark, sf)).groupBy("level").agg(F.sum(det_number("pd", "id", "action") % 1000003).alias("f"))
    return f.agg(F.count("*").alias("n_policies"), F.count_distinct("f").alias("n_distinct"))


FEATS = ("label_len_chars", "label_len_words", "n_alpha_words", "description_len", "ambiguity", "degree")


@query("pt16_feature_variance", "WITH " + ", ".join(["v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM features" for f in FEATS) + ")"]) + " SELECT feature, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS sd, min(x) = max(x) AS constant FROM v GROUP BY feature")
def _(spark, sf):
    v = features(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in FEATS])).alias("v")).select("v.*")
    return rounded(v.groupBy("feature").agg(F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.stddev_pop("x").alias("sd"), (F.min("x") == F.max("x")).alias("constant")))


NEAR = INV.replace("triples", "train") + ", inc AS (SELECT DISTINCT entity AS head, relation AS via, other FROM (SELECT relation, head AS entity, tail AS other FROM train UNION ALL SELECT relation, tail, head FROM train)), nb AS (SELECT qid, via, other, row_number() OVER (PARTITION BY qid ORDER BY via, other) AS place FROM queries q JOIN inc USING (head) WHERE other <> q.tail AND NOT EXISTS (SELECT 1 FROM inv WHERE inv.relation = q.relation AND inv.inverse = via)), nbt AS (SELECT qid, string_agg(via || ' ' || other, '; ' ORDER BY place) AS text FROM nb WHERE place <= 3 GROUP BY qid)"


def near(spark, sf):
    train = base.split(spark, sf, "train")
    return context.neighbours(train, tests(spark, sf), 3, graph.inverse_relations(train))


def near_texts(spark, sf):
    """The test queries with their neighbours in one line, as `text`."""
    train = base.split(spark, sf, "train")
    return context.near_sets(train, tests(spark, sf), 3, graph.inverse_relations(train)).withColumn("text", context.near_text(F.col("near"))).drop("near")


@query("gr11_context_neighbours", f"WITH {NEAR} SELECT qid, via, other, place FROM nb WHERE place <= 3")
def _(spark, sf):
    return rounded(near(spark, sf))


@query("gr7_neighbour_block", f"WITH {NEAR} SELECT qid, text FROM nbt")
def _(spark, sf):
    return near_texts(spark, sf).filter("text IS NOT NULL").select("qid", "text")


def _variant_sql() -> str:
    lead = {"demonstrations": "'Other triples using ' || relation || ': ' || demonstrations", "meaning": "meaning", "neighbours": "'Known facts: ' || neighbours", "paths": "'Known connections: ' || paths"}

    def prompt(on: tuple[str, ...]) -> str:
        tag = lambda e: f"{e}_text" + (f" || ' [' || {PRE.format(e)} || ']'" if "types" in on else "")
        parts = [f"CASE WHEN {b} <> '' THEN {x} || '.' END" for b, x in lead.items() if b in on]
        parts.append(f"'Is this true: ' || {tag('head')} || ' ' || relation || ' ' || {tag('tail')} || '?'")
        return "concat_ws(' ', " + ", ".join([*parts, *([f"'{conditions.STRUCTURAL_INSTRUCTION}'"] if "instruction" in on else [])]) + ")"

    paths = BARE_SQL["gr8_safe_paths"]
    made = " UNION ALL ".join(f"SELECT head, relation, tail, '{v}' AS variant, {prompt(on)} AS prompt FROM shown" for v, on in conditions.VARIANTS.items())
    return f"WITH {NEAR}, {EXAMPLES}, pa AS MATERIALIZED ({paths}), shown AS MATERIALIZED (SELECT q.*, coalesce(a.text, q.head) AS head_text, coalesce(b.text, q.tail) AS tail_text, ex.text AS demonstrations, {MEANING.replace('CASE relation', 'CASE q.relation').replace('|| relation ||', '|| q.relation ||')} AS meaning, nbt.text AS neighbours, pa.paths FROM queries q LEFT JOIN entities a ON a.id = q.head LEFT JOIN entities b ON b.id = q.tail LEFT JOIN ex ON ex.relation = q.relation LEFT JOIN nbt ON nbt.qid = q.qid LEFT JOIN pa ON pa.qid = q.qid) {made}"


def variant_sets(spark, sf):
    """The test triples under P0 to P7, with everything that the variants show, one row a triple."""
    q, train, e = tests(spark, sf), base.split(spark, sf, "train"), base.entities(spark, sf)
    inverses = graph.inverse_relations(train)
    rows = context.near_sets(train, q, 3, inverses).withColumn("neighbours", context.near_text(F.col("near"))).drop("near")
    rows = prompts.with_text(rows, e).join(F.broadcast(context.examples(train, 2).withColumnRenamed("text", "demonstrations")), "relation", "left")  # one row a relation
    rows = rows.join(graph.safe_paths(train, q, inverses, e), "qid", "left")
    return conditions.variant_sets(rows.withColumn("meaning", context.relation_text(F.col("relation"))))


@query("gr14_leak_assertion", f"WITH {NEAR} SELECT q.relation, count(*) AS n, count(*) FILTER (len(list_filter(string_split(nbt.text, ';'), lambda s: ends_with(trim(s), q.tail))) > 0) AS n_leaking FROM nbt JOIN queries q USING (qid) GROUP BY q.relation")
def _(spark, sf):
    t = near_texts(spark, sf).filter("text IS NOT NULL")
    return t.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(context.leaking(F.col("text"), F.col("tail"))).alias("n_leaking"))


MEANING = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in context.RELATION_TEXTS.items()) + " ELSE 'the relation ' || relation || ' holds between the two' END"


@query("pt6_prompt_variants", _variant_sql())
def _(spark, sf):
    return variant_sets(spark, sf).select(*TRIPLE, F.explode("prompts").alias("x")).select(*TRIPLE, "x.variant", "x.prompt")


#: The blocks that variants switch on; the rows of the query have no column for paths.
SWITCHED = ("demonstrations", "meaning", "neighbours", "paths")


def _flag_sql() -> str:
    cells = ", ".join(f"('{v}', '{b}', {str(b in on).lower()}, {str(b != 'paths').lower()})" for v, on in conditions.VARIANTS.items() for b in SWITCHED)
    return f"""WITH {NEAR}, {EXAMPLES}, shown AS MATERIALIZED (SELECT q.qid, ex.text AS demonstrations, {MEANING.replace('CASE relation', 'CASE q.relation').replace('|| relation ||', '|| q.relation ||')} AS meaning, nbt.text AS neighbours FROM queries q LEFT JOIN ex ON ex.relation = q.relation LEFT JOIN nbt ON nbt.qid = q.qid),
  f AS (SELECT count(*) AS n, count(*) FILTER (demonstrations <> '') AS demonstrations, count(*) FILTER (meaning <> '') AS meaning, count(*) FILTER (neighbours <> '') AS neighbours FROM shown),
  c AS (SELECT variant, block, asked, known, n, CASE block WHEN 'demonstrations' THEN demonstrations WHEN 'meaning' THEN meaning WHEN 'neighbours' THEN neighbours ELSE 0 END AS n_filled FROM f, (VALUES {cells}) v(variant, block, asked, known)),
  m AS (SELECT *, CASE WHEN asked THEN n - n_filled ELSE 0 END AS n_missing, CASE WHEN asked THEN 0 ELSE n_filled END AS n_unused FROM c)
  SELECT variant, block, asked, n, n_filled, n_missing, n_unused, CASE WHEN asked AND NOT known THEN 'no_column' WHEN n_missing > 0 THEN 'missing' WHEN n_unused > 0 THEN 'unused' ELSE 'ok' END AS status FROM m"""


@query("pt4_flag_audit", _flag_sql())
def _(spark, sf):
    """Which variants find what they switch on, and which blocks are there for nothing, over all test triples."""
    train = base.split(spark, sf, "train")
    rows = near_texts(spark, sf).withColumnRenamed("text", "neighbours").join(F.broadcast(context.examples(train, 2).withColumnRenamed("text", "demonstrations")), "relation", "left")  # one row a relation
    return conditions.flag_audit(rows.withColumn("meaning", context.relation_text(F.col("relation"))), SWITCHED)


@query("ag66_context_coverage", f"WITH v AS MATERIALIZED ({_variant_sql()}), p AS (SELECT head, relation, tail, prompt FROM v WHERE variant = 'P0') SELECT variant, count(*) AS n, round(avg(CAST(v.prompt <> p.prompt AS DOUBLE)), 6) AS coverage, avg(CAST(v.prompt <> p.prompt AS DOUBLE)) >= 0.5 AS usable FROM v JOIN p USING (head, relation, tail) GROUP BY variant")
def _(spark, sf):
    """How many prompts of each variant show anything beyond the plain question; below half a variant is not usable."""
    plain = F.filter("prompts", lambda x: x["variant"] == "P0")[0]["prompt"]
    each = variant_sets(spark, sf).select(F.explode(F.transform("prompts", lambda x: F.struct(x["variant"].alias("variant"), (x["prompt"] != plain).cast("double").alias("shows")))).alias("x")).select("x.*")
    g = each.groupBy("variant").agg(F.count("*").alias("n"), F.avg("shows").alias("coverage"))
    return rounded(g.withColumn("usable", F.col("coverage") >= 0.5))


@query("gr15_relation_text", f"SELECT DISTINCT relation, {MEANING} AS text FROM triples")
def _(spark, sf):
    return base.triples(spark, sf).select("relation").distinct().select("relation", context.relation_text(F.col("relation")).alias("text"))


BLOCKS = f"{NEAR}, {EXAMPLES}, bl AS (SELECT qid, 'type_tag' AS kind, head AS target, {PRE.format('head')} AS text FROM queries UNION ALL SELECT qid, 'entity_description', head, e.text FROM queries q JOIN entities e ON e.id = q.head UNION ALL SELECT qid, 'relation_description', relation, {MEANING} FROM queries UNION ALL SELECT qid, 'neighbours', head, nbt.text FROM queries JOIN nbt USING (qid) UNION ALL SELECT qid, 'demonstrations', q.relation, ex.text FROM queries q JOIN ex ON ex.relation = q.relation), blocks AS (SELECT *, len(string_split(text, ' ')) AS tokens FROM bl)"


@query("gr13_candidate_blocks", f"WITH {BLOCKS} SELECT qid, kind, target, text, tokens FROM blocks")
def _(spark, sf):
    return context.blocks(tests(spark, sf), base.split(spark, sf, "train"), base.entities(spark, sf), 3, 2, graph.inverse_relations(base.split(spark, sf, "train")))


BUDGET = 12
RANGE_TYPES = "rb AS (SELECT relation, 0.0::DOUBLE - sum(p * log2(p)) AS bits FROM (SELECT relation, n / (sum(n) OVER (PARTITION BY relation))::DOUBLE AS p FROM (SELECT t.relation, y.type, count(*) AS n FROM train t JOIN types y ON y.entity = t.tail GROUP BY ALL)) GROUP BY relation)"
LABELS = "ew AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM entities), iw AS (SELECT id, max(ln((SELECT count(*) FROM entities) / df::DOUBLE)) AS idf FROM ew JOIN (SELECT w, count(*) AS df FROM ew GROUP BY w) USING (w) GROUP BY id), sn AS (SELECT lower(text) AS k, count(*) AS senses FROM entities GROUP BY 1), lab AS (SELECT e.id, len(list_filter(regexp_split_to_array(trim(e.text), '\\s+'), lambda x: x <> '')) AS words, iw.idf, sn.senses FROM entities e LEFT JOIN iw USING (id) LEFT JOIN sn ON sn.k = lower(e.text))"
TRAITED = f"{BLOCKS}, {RANGE_TYPES}, {LABELS}, tb AS (SELECT b.*, coalesce(l.words >= 3, false) AS described, coalesce(l.words, 0) < 3 AS short, coalesce(rb.bits >= 2, false) AS diffuse, coalesce(rb.bits < 2, false) AS narrow, coalesce(l.idf < 2, false) AS general, coalesce(l.senses >= 3, false) AS ambiguous, l.words FROM blocks b JOIN queries q USING (qid) LEFT JOIN lab l ON l.id = q.head LEFT JOIN rb ON rb.relation = q.relation)"
S1_WHY, S3_WHY = "CASE WHEN described THEN 'described' ELSE 'not described' END", "CASE WHEN short THEN 'short label' ELSE 'long label' END"
S2_WHY = "CASE WHEN diffuse THEN 'range of many types' WHEN narrow THEN 'range of few types' ELSE 'range unknown' END"
KIND_AT = f"(list_position({list(budget.KINDS)}, kind) - 1)"
#: Priority and reason of each policy in SQL.
POLICY_SQL = {
    "S0": (f"-{KIND_AT}", "'kinds in fixed order'"),
    "R": (U.format(number("policy", "kind", "target")), "'drawn by hash'"),
    "S1": ("CASE kind WHEN 'neighbours' THEN if(described, 0.5, 3) WHEN 'entity_description' THEN if(described, 2.5, NULL) ELSE 1 END", S1_WHY),
    "S2": ("CASE kind WHEN 'type_tag' THEN if(diffuse, 1, 3) WHEN 'neighbours' THEN if(diffuse, 2.5, 0.5) ELSE 1 END", S2_WHY),
    "S3": ("CASE kind WHEN 'entity_description' THEN CASE WHEN NOT short THEN 3 WHEN words > 0 THEN 1 END WHEN 'neighbours' THEN if(short, 3, 0.5) ELSE 1 END", S3_WHY),
    "S4": ("CASE kind WHEN 'neighbours' THEN 1 + if(described, 0, 1.5) + if(short, 1, 0) + if(diffuse, 1, 0) WHEN 'entity_description' THEN if(described, 3, NULL) WHEN 'type_tag' THEN if(narrow, 2, 0.8) ELSE 1 END", f"{S1_WHY} || ', ' || {S3_WHY} || ', ' || {S2_WHY}"),
    "S5": ("CASE kind WHEN 'neighbours' THEN CASE WHEN ambiguous THEN 3.5 WHEN general THEN 0.5 ELSE 2.5 END WHEN 'entity_description' THEN CASE WHEN described THEN if(general, 1, 3) END WHEN 'demonstrations' THEN if(general OR described, 0.3, 2) WHEN 'type_tag' THEN if(general, 2.5, 1) ELSE 1 END", "CASE WHEN kind = 'neighbours' AND ambiguous THEN 'label of several senses' WHEN general THEN 'general label' ELSE 'specific label' END"),
}
JUDGED = f"{TRAITED}, jd AS (" + " UNION ALL ".join(f"SELECT qid, kind, target, tokens, '{p}' AS policy, CAST({value} AS DOUBLE) AS priority, {why} AS reason FROM tb" for p, (value, why) in POLICY_SQL.items()) + ")"


def _filled_sql() -> str:
    """The fold over the blocks of a query, one table for each place in the order: there are five kinds at most."""
    out = f"{JUDGED}, pb AS (SELECT *, row_number() OVER (PARTITION BY qid, policy ORDER BY priority DESC, {KIND_AT}, target) AS k FROM jd WHERE priority IS NOT NULL), f0 AS (SELECT DISTINCT qid, policy, 0 AS spent, []::STRUCT(kind VARCHAR, tokens BIGINT)[] AS kept FROM jd)"
    for i in range(1, 6):
        room = f"{BUDGET} - s.spent"
        n = f"CASE WHEN b.tokens <= {room} THEN b.tokens WHEN b.kind NOT IN {budget.ATOMIC} AND {room} > 0 THEN {room} ELSE 0 END"
        out += f", n{i} AS (SELECT s.*, b.kind, coalesce(CASE WHEN {room} > 0 THEN {n} END, 0) AS n FROM f{i - 1} s LEFT JOIN pb b ON b.qid = s.qid AND b.policy = s.policy AND b.k = {i}), f{i} AS (SELECT qid, policy, spent + n AS spent, CASE WHEN n > 0 THEN list_append(kept, {{'kind': kind, 'tokens': CAST(n AS BIGINT)}}) ELSE kept END AS kept FROM n{i})"
    return out


FILLED = _filled_sql()


def traited_sets(spark, sf):
    """The test queries with their candidate blocks and with what the policies look at, one row a query."""
    q, train, e = tests(spark, sf), base.split(spark, sf, "train"), base.entities(spark, sf)
    range_types = graph.entropy(train.join(types.induced_types(base.triples(spark, sf)).select(F.col("entity").alias("tail"), "type"), "tail"), ["relation"], "type", "bits")
    labels = context.label_traits(e).withColumnRenamed("id", "head")
    sets = context.block_sets(q, train, e, 3, 2, graph.inverse_relations(train)).join(labels, "head", "left").join(F.broadcast(range_types), "relation", "left")  # one row a relation
    return sets.withColumns({"described": F.col("words") >= budget.WORDS, "depth": F.lit(None).cast("int")})


def traited(spark, sf):
    return traited_sets(spark, sf).select("qid", *budget.TRAITS, F.explode("blocks").alias("b")).select("qid", "b.*", *budget.TRAITS)


def filled(spark, sf, policies=budget.POLICIES, *keep):
    return budget.allocated_sets(traited_sets(spark, sf), F.lit(BUDGET), policies, *keep)


def filled_shapes(spark, sf):
    return budget.allocated_shapes(traited_sets(spark, sf), F.lit(BUDGET))


@query("ba3_policies", f"WITH {JUDGED} SELECT policy, kind, reason, count(*) AS n, count(*) FILTER (priority IS NULL) AS n_refused, round(min(priority), 6) AS lowest, round(max(priority), 6) AS highest FROM jd GROUP BY policy, kind, reason")
def _(spark, sf):
    j = budget.judged(traited(spark, sf))
    return rounded(j.groupBy("policy", "kind", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("priority").isNull()).alias("n_refused"), F.min("priority").alias("lowest"), F.max("priority").alias("highest")))


@query("ba1_budget_fill", f"WITH {FILLED} SELECT qid, policy, CAST(spent AS BIGINT) AS spent, array_to_string(list_transform(kept, lambda x: x.kind || ':' || x.tokens), ',') AS kept FROM f5")
def _(spark, sf):
    return filled(spark, sf).select("qid", "policy", F.col("spent").cast("long").alias("spent"), F.array_join(F.transform("kept", lambda k: F.concat_ws(":", k["kind"], k["tokens"].cast("string"))), ",").alias("kept"))


@query("ba5_spent_by_kind", f"WITH {FILLED}, u AS (SELECT policy, x.kind, x.tokens FROM (SELECT policy, unnest(kept) AS x FROM f5)) SELECT policy, kind, count(*) AS n_blocks, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / ({BUDGET} * (SELECT count(*) FROM queries))::DOUBLE, 6) AS utilisation FROM u GROUP BY policy, kind")
def _(spark, sf):
    spent, n = budget.spent_by_kind(filled_shapes(spark, sf), "policy", times="n"), tests(spark, sf).agg(F.count("*")).scalar()
    return rounded(spent.withColumn("utilisation", F.col("tokens") / (BUDGET * n)))


@query("mp1_token_map", f"WITH {FILLED}, m AS (SELECT policy, map_from_entries(list_transform(kept, lambda x: struct_pack(k := x.kind, v := CAST(x.tokens AS BIGINT)))) AS m FROM f5) SELECT policy, count(*) AS n, CAST(sum(coalesce(list_sum(map_values(m)), 0)) AS BIGINT) AS spent, CAST(sum(coalesce(m['neighbours'], 0)) AS BIGINT) AS on_neighbours, CAST(sum(coalesce(m['nothing'], 7)) AS BIGINT) AS on_nothing, CAST(sum(cardinality(m)) AS BIGINT) AS kinds FROM m GROUP BY policy")
def _(spark, sf):
    """Each allocation as a map of tokens by kind: looked up with a default for kinds that it lacks, and summed."""
    m = filled_shapes(spark, sf).select("policy", "n", F.map_from_entries(F.transform("kept", lambda x: F.struct(x["kind"], x["tokens"].cast("long")))).alias("m"))
    got = lambda k, default: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(default).cast("long"))
    spent = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    total = lambda c: F.sum(c * F.col("n"))
    return rounded(m.groupBy("policy").agg(F.sum("n").alias("n"), total(spent).alias("spent"), total(got("neighbours", 0)).alias("on_neighbours"), total(got("nothing", 7)).alias("on_nothing"), total(F.size("m")).alias("kinds")))


@query("ba6_allocation_diff", f"WITH {FILLED}, s AS (SELECT qid, policy, array_to_string(list_transform(kept, lambda x: x.kind), ',') AS kinds FROM f5) SELECT a.policy AS a, b.policy AS b, a.kinds AS kinds_a, b.kinds AS kinds_b, count(*) AS n FROM s a JOIN s b ON a.qid = b.qid AND a.policy < b.policy AND a.kinds <> b.kinds GROUP BY ALL")
def _(spark, sf):
    f = filled_shapes(spark, sf).select("qid", "n", "policy", F.array_join(F.transform("kept", lambda k: k["kind"]), ",").alias("kinds"))
    sets = f.groupBy("qid", "n").agg(F.array_sort(F.collect_list(F.struct("policy", "kinds"))).alias("s"))  # one for each policy
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: (y["policy"] > x["policy"]) & (y["kinds"] != x["kinds"])), lambda y: F.struct(x["policy"].alias("a"), y["policy"].alias("b"), x["kinds"].alias("kinds_a"), y["kinds"].alias("kinds_b")))))
    return sets.select("n", F.explode(pairs).alias("p")).select("n", "p.*").groupBy("a", "b", "kinds_a", "kinds_b").agg(F.sum("n").alias("n"))


@query("gr4_evidence_colours", "WITH p AS (SELECT qid, candidate FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, candidate) AS k FROM cscored) WHERE k = 1), seen AS (SELECT head AS e FROM train UNION SELECT tail FROM train), rg AS (SELECT DISTINCT relation, tail FROM train) SELECT CASE WHEN p.candidate = q.tail THEN 'gold' WHEN rg.tail IS NOT NULL THEN 'in_range' WHEN seen.e IS NOT NULL THEN 'type_violation' ELSE 'oov' END AS colour, count(*) AS n FROM queries q JOIN p USING (qid) LEFT JOIN rg ON rg.relation = q.relation AND rg.tail = p.candidate LEFT JOIN seen ON seen.e = p.candidate GROUP BY 1")
def _(spark, sf):
    best = F.array_min(F.transform("c", lambda x: F.struct((-x["score"]).alias("s"), x["candidate"].alias("candidate"))))
    j = scored_sets(spark, sf).select("relation", "tail", best["candidate"].alias("predicted"))
    return context.colours(j, base.split(spark, sf, "train")).groupBy("colour").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ types and identifiers


PT = f"pt AS (SELECT entity, coalesce(nullif({PRE.format('entity')}, ''), 'OTHER') AS type FROM ents)"


def by_prefix(spark, sf):
    e = base.triples(spark, sf).select(F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("text", F.lit(""))
    return types.types_by_identifier(e)


GATES = f"{PT}, g AS (SELECT 'exogenous' AS source, count(*) AS n, count(DISTINCT type) AS n_types, avg(CAST(type = 'OTHER' AS DOUBLE)) AS other FROM pt UNION ALL SELECT 'induced', count(*), count(DISTINCT type), avg(CAST(type = 'OTHER' AS DOUBLE)) FROM types)"


@query("ty12_built_types", f"WITH {GATES} SELECT source, n, n_types, round(other, 6) AS other, n_types >= 2 AND other <= CASE source WHEN 'exogenous' THEN 0.1 ELSE 0.5 END AS passes FROM g")
def _(spark, sf):
    gate = lambda df, name: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.count_distinct("type").alias("n_types"), F.avg((F.col("type") == "OTHER").cast("double")).alias("other"))
    g = gate(by_prefix(spark, sf), "exogenous").unionByName(gate(types.induced_types(base.triples(spark, sf)), "induced"))
    return rounded(g.withColumn("passes", (F.col("n_types") >= 2) & (F.col("other") <= F.when(F.col("source") == "exogenous", 0.1).otherwise(0.5))))


@query("ty4_type_dispatch", f"WITH {PT}, m AS (SELECT CASE WHEN avg(CAST(type = 'OTHER' AS DOUBLE)) <= 0.1 THEN 'prefix' ELSE 'induced' END AS strategy FROM pt) SELECT strategy, type, count(*) AS n FROM m, (SELECT 'prefix' AS s, type FROM pt UNION ALL SELECT 'induced', type FROM types) x WHERE x.s = m.strategy GROUP BY ALL")
def _(spark, sf):
    p = by_prefix(spark, sf)
    prefixed = p.agg(F.avg((F.col("type") == "OTHER").cast("double"))).first()[0]
    name, chosen = ("prefix", p) if prefixed is not None and prefixed <= 0.1 else ("induced", types.induced_types(base.triples(spark, sf)))
    return chosen.groupBy(F.lit(name).alias("strategy"), "type").agg(F.count("*").alias("n"))


PROVIDERS = (("", "other"), ("customer:", "people"), ("customer:1", "early"), ("part:", "goods"), ("order:", "orders"))


OWN_PREFIX = "SELECT substr(entity, 1, length(entity) - 1) AS prefix, 'own:' || substr(entity, 1, length(entity) - 1) AS provider FROM ents WHERE {} % 4 = 0".format(number("prefix", "entity"))


@query("ty11_provider_dispatch", "WITH p AS (SELECT prefix, min(provider) AS provider FROM (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PROVIDERS) + f") v(prefix, provider) UNION ALL {OWN_PREFIX}) GROUP BY prefix), k AS (SELECT DISTINCT length(prefix) AS n FROM p), x AS (SELECT entity, arg_max(p.provider, k.n) AS provider, max(k.n) AS n FROM ents JOIN k ON length(entity) >= k.n JOIN p ON p.prefix = substr(entity, 1, k.n) GROUP BY entity) SELECT provider, n AS prefix_length, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    """Providers by a table of prefixes: some of kinds of entities, and one of every fourth entity's id without its last character."""
    e = base.triples(spark, sf).select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    own = F.expr("substring(id, 1, length(id) - 1)")
    table = e.filter(det_number("prefix", "id") % 4 == 0).select(own.alias("prefix"), F.concat(F.lit("own:"), own).alias("value"))
    table = table.unionByName(spark.createDataFrame(PROVIDERS, "prefix string, value string"))
    best = joins.longest_prefix(e, table)
    return best.groupBy(F.col("value").alias("provider"), F.length("prefix").cast("long").alias("prefix_length")).agg(F.count("*").alias("n"))


@query("ty14_type_invariance", f"WITH a AS (SELECT id, {PRE.format('id')} AS type FROM ({O['pr1_anonymise']})), b AS (SELECT id, {PRE.format('id')} AS type FROM ({O['pr2_permute']})), e AS (SELECT id, {PRE.format('id')} AS type FROM entities) SELECT 'anonymised' AS variant, count(*) AS n, count(*) FILTER (a.type IS DISTINCT FROM e.type) AS n_changed FROM e FULL JOIN a USING (id) UNION ALL SELECT 'permuted', count(*), count(*) FILTER (b.type IS DISTINCT FROM e.type) FROM e FULL JOIN b USING (id)")
def _(spark, sf):
    e = base.entities(spark, sf)
    was = types.types_by_identifier(e).select("entity", F.col("type").alias("was"))
    diff = lambda v, name: was.join(types.types_by_identifier(v), "entity", "full").agg(F.lit(name).alias("variant"), F.count("*").alias("n"), F.count_if(~F.col("type").eqNullSafe(F.col("was"))).alias("n_changed"))
    return diff(sampling.anonymise(e), "anonymised").unionByName(diff(sampling.permute(e), "permuted"))


@query("ty8_concept_types", "SELECT regexp_extract('concept:' || event_type || ':' || user_id, '^concept:([^:]+):', 1) AS type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("concept:"), "event_type", F.lit(":"), F.col("user_id").cast("string")).alias("id"))
    return e.groupBy(F.regexp_extract("id", "^concept:([^:]+):", 1).alias("type")).agg(F.count("*").alias("n"))


LINE = "CASE c_custkey % 3 WHEN 0 THEN '<id_' || c_custkey || '>' || chr(9) || '<customer_' || c_custkey || '>' || chr(9) || 'rdf:type' || chr(9) || '<wordnet_' || lower(c_mktsegment) || '_1>' WHEN 1 THEN '<http://x.org/customer_' || c_custkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://schema.org/' || c_mktsegment || '> .' ELSE '<customer_' || c_custkey || '>' || chr(9) || 'rdfs:label' || chr(9) || c_name END"


@query("sc10_type_lines", f"WITH l AS (SELECT {LINE} AS line FROM customer), p AS (SELECT regexp_extract(line, '<(?:[^<>]*/)?([^<>/]+)>\\s+(?:rdf:type|<[^<>]*#type>)\\s+<(?:[^<>]*/)?([^<>/]+)>', 1) AS subject, regexp_extract(line, '<(?:[^<>]*/)?([^<>/]+)>\\s+(?:rdf:type|<[^<>]*#type>)\\s+<(?:[^<>]*/)?([^<>/]+)>', 2) AS class FROM l) SELECT subject, class FROM p WHERE subject <> ''")
def _(spark, sf):
    from graphlens.sources import kg

    c = spark.read.parquet(f"{sf}/customer.parquet")
    k, tab = F.col("c_custkey").cast("string"), F.lit("\t")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<id_"), k, F.lit(">"), tab, F.lit("<customer_"), k, F.lit(">"), tab, F.lit("rdf:type"), tab, F.lit("<wordnet_"), F.lower("c_mktsegment"), F.lit("_1>")))
    line = line.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("<http://x.org/customer_"), k, F.lit("> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://schema.org/"), "c_mktsegment", F.lit("> .")))
    return kg.type_lines(c.select(line.otherwise(F.concat(F.lit("<customer_"), k, F.lit(">"), tab, F.lit("rdfs:label"), tab, "c_name")).alias("line")))


RUN_STEMS = f"stems AS (SELECT DISTINCT concat_ws('-', 'ch1rank', relation, tail, 'S' || ({number('arm', *T)} % 5), 's' || ({number('seed', *T)} % 3)) AS stem, relation, tail FROM test)"


def run_stems(spark, sf):
    """Names of result files: chapter, relation, answer, arm and seed of each test triple."""
    arm, seed = (F.concat(F.lit("Ss"[i]), (det_number(s, *TRIPLE) % n).cast("string")) for i, (s, n) in enumerate((("arm", 5), ("seed", 3))))
    return base.split(spark, sf, "test").select(F.concat_ws("-", F.lit("ch1rank"), "relation", "tail", arm, seed).alias("stem"), "relation", "tail").distinct()


#: Parts of a run's name: the chapter, the data set, the arm, the seed; a name without these has none.
RUN_NAME = r"^(ch[0-9]+[a-z]*)-(.+)-(S[0-9])-s([0-9]+)$"


@query("sc15_dataset_of_run", f"WITH {RUN_STEMS}, r AS (SELECT stem AS run FROM stems UNION SELECT tail FROM stems) SELECT run, nullif(regexp_extract(run, '{RUN_NAME}', 2), '') AS dataset, nullif(regexp_extract(run, '{RUN_NAME}', 3), '') AS arm, CAST(nullif(regexp_extract(run, '{RUN_NAME}', 4), '') AS BIGINT) AS seed FROM r")
def _(spark, sf):
    """The parts of run names, among them names that are none."""
    stems = run_stems(spark, sf)
    r = stems.select(F.col("stem").alias("run")).unionByName(stems.select(F.col("tail").alias("run"))).distinct()
    part = lambda i: F.nullif(F.regexp_extract("run", RUN_NAME, i), F.lit(""))
    return r.select("run", part(2).alias("dataset"), part(3).alias("arm"), part(4).cast("long").alias("seed"))


@query("sc17_results_of_run", f"WITH {RUN_STEMS}, r AS (SELECT DISTINCT relation || '-' || tail AS run FROM stems), f AS (SELECT DISTINCT stem, CASE {number('fit', 'stem')} % 3 WHEN 0 THEN 'OVERFIT at step 3' WHEN 1 THEN 'Underfit' ELSE 'good fit' END AS verdict FROM stems) SELECT run, count(*) AS n, max(stem) AS stem, CASE WHEN contains(upper(arg_max(verdict, stem)), 'OVERFIT') THEN 'over' WHEN contains(upper(arg_max(verdict, stem)), 'UNDERFIT') THEN 'under' ELSE 'ok' END AS fit FROM r JOIN f ON contains(f.stem, r.run) GROUP BY run")
def _(spark, sf):
    """Result files whose name contains a run's: also those of runs whose name goes on. The last file counts."""
    stems = run_stems(spark, sf)
    names = stems.select(F.concat_ws("-", "relation", "tail").alias("name")).distinct()
    j = joins.contained(names, stems.select(F.col("stem").alias("text")))
    verdict = F.element_at(F.array(F.lit("OVERFIT at step 3"), F.lit("Underfit"), F.lit("good fit")), (det_number("fit", "text") % 3 + 1).cast("int"))
    v = F.upper(F.max_by("verdict", "text"))
    fit = F.when(F.contains(v, F.lit("OVERFIT")), "over").when(F.contains(v, F.lit("UNDERFIT")), "under").otherwise("ok")
    return j.withColumn("verdict", verdict).groupBy(F.col("name").alias("run")).agg(F.count("*").alias("n"), F.max("text").alias("stem"), fit.alias("fit"))


@query("st15_run_ids", "SELECT relation, split, concat_ws('-', 'ch1', relation, split, CAST(count(*) AS VARCHAR)) AS run FROM kg GROUP BY relation, split")
def _(spark, sf):
    return base.graph_of(spark, sf).groupBy("relation", "split").agg(F.concat_ws("-", F.lit("ch1"), "relation", "split", F.count("*").cast("string")).alias("run"))


@query("st14_hash_ids", "SELECT head, relation, tail, qid FROM queries")
def _(spark, sf):
    return tests(spark, sf).select(*TRIPLE, "qid")


@query("sa4_subset_universe", f"WITH s AS ({O['sa3_entity_subset']}) SELECT head AS entity FROM s UNION SELECT tail FROM s")
def _(spark, sf):
    return sampling.entity_subset(base.triples(spark, sf), 500).select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


@query("sa10_pools", "SELECT relation, 'head' AS side, count(DISTINCT head) AS n FROM triples GROUP BY relation UNION ALL SELECT relation, 'tail', count(DISTINCT tail) FROM triples GROUP BY relation")
def _(spark, sf):
    return graph.relation_sides(base.triples(spark, sf)).groupBy("relation", "side").agg(F.count("*").alias("n"))


@query("rt6_routed_extras", f"WITH {PLANS} SELECT level, id, action FROM costs WHERE action <> 'none'")
def _(spark, sf):
    return routing.routed(features(spark, sf)).filter("action <> 'none'").select("level", "id", "action")


@query("rt2_quality_bands", "SELECT id, quality_band FROM features")
def _(spark, sf):
    return features(spark, sf).select("id", "quality_band")


@query("ag63_token_savings", f"WITH {PLANS}, m AS (SELECT level, avg(token_cost) AS mean, max(token_cost) AS most FROM costs GROUP BY level) SELECT level, round(mean, 6) AS mean, CAST(most AS BIGINT) AS most, round(1 - mean / (SELECT mean FROM m WHERE level = 'L0'), 6) AS saved FROM m")
def _(spark, sf):
    m = routing.routed(features(spark, sf)).groupBy("level").agg(F.avg("token_cost").alias("mean"), F.max("token_cost").alias("most"))
    first = F.first_value("mean").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row a level
    return rounded(m.withColumn("saved", 1 - F.col("mean") / first))


@query("ag64_dominated_levels", f"WITH {PLANS}, m AS (SELECT level, avg(token_cost) AS cost, avg(CAST(action <> 'none' AS DOUBLE)) AS kept FROM costs GROUP BY level) SELECT level, round(cost, 6) AS cost, round(kept, 6) AS kept, EXISTS (SELECT 1 FROM m y WHERE y.cost < m.cost AND y.kept >= m.kept - 0.005) AS dominated FROM m")
def _(spark, sf):
    m = routing.routed(features(spark, sf)).groupBy("level").agg(F.avg("token_cost").alias("cost"), F.avg((F.col("action") != "none").cast("double")).alias("kept"))
    y = F.broadcast(m.select(F.col("level").alias("yl"), F.col("cost").alias("yc"), F.col("kept").alias("yk")))  # one row a level
    better = m.join(y, (F.col("yc") < F.col("cost")) & (F.col("yk") >= F.col("kept") - 0.005), "left_semi").select("level", F.lit(True).alias("d"))
    return rounded(m.join(F.broadcast(better), "level", "left").withColumn("dominated", F.coalesce("d", F.lit(False))).drop("d"))


@query("ag43_hits_in_samples", "WITH s AS (SELECT qid, is_gold, row_number() OVER (PARTITION BY qid ORDER BY score DESC, candidate) AS k FROM cscored) SELECT round(avg(CAST(h1 AS DOUBLE)), 6) AS hits1, round(avg(CAST(h3 AS DOUBLE)), 6) AS hits3, round(avg(CAST(h5 AS DOUBLE)), 6) AS hits5 FROM (SELECT qid, max(is_gold) FILTER (k <= 1) AS h1, max(is_gold) FILTER (k <= 3) AS h3, max(is_gold) FILTER (k <= 5) AS h5 FROM s GROUP BY qid)")
def _(spark, sf):
    best = F.array_sort(F.transform("c", lambda x: F.struct((-x["score"]).alias("s"), x["candidate"].alias("candidate"))))
    c = scored_sets(spark, sf).select(F.transform(F.slice(best, 1, 5), lambda x: x["candidate"]).alias("top"), F.col("tail").alias("gold"))
    return rounded(c.agg(*[F.avg(F.array_contains(F.slice("top", 1, k), F.col("gold")).cast("double")).alias(f"hits{k}") for k in (1, 3, 5)]))


@query("wi9_first_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 2")
def _(spark, sf):
    return graph.first_per_group(spark.read.parquet(f"{sf}/conversations.parquet"), ["conv_id"], ["turn"], 2).select("conv_id", "turn")


@query("wi3_average_ranks", "SELECT id, round(rank() OVER (ORDER BY p_yes DESC) + (count(*) OVER (PARTITION BY p_yes) - 1) / 2.0::DOUBLE, 6) AS rank FROM scored")
def _(spark, sf):
    s = base.scored(spark, sf).select("id", "p_yes")
    return rounded(ranking.tied_ranks(s, "p_yes").select("id", "rank"))
