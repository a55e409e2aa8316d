"""The named queries: each a composition of operators on the canonical graph, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions import text as tx
from graphlens.functions.hashing import det_number, unit
from graphlens.operators import abstention, audit, graph, metrics, prompts, ranking, routing, sampling, stats, types
from graphlens.plans import base
from graphlens.plans.base import N_WAY, T, U, key, number, sql
from graphlens.sources.kg import canonical_graph, canonical_split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The SQL of a query without the tables that it names: for use within other SQL, which then makes them once.
BARE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name], BARE_SQL[name] = sql(oracle), oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def R(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def L(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cols)


# ------------------------------------------------------------------ scans and surface forms


@query("sc3_load_triples", "SELECT head, relation, tail, split FROM kg")
def _(spark, sf):
    return canonical_split(base.triples(spark, sf)).select("head", "relation", "tail", "split")


@query("sc4_describe", "SELECT split AS part, count(*) AS n FROM kg GROUP BY split UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', 10")
def _(spark, sf):
    return canonical_graph(spark, sf).describe()


@query("sc6_known_triples", "SELECT count(*) AS n FROM (SELECT DISTINCT head, relation, tail FROM triples)")
def _(spark, sf):
    return canonical_graph(spark, sf).all_true().agg(F.count("*").alias("n"))


@query("sc9_entity_types", "SELECT DISTINCT entity, coalesce(nullif(regexp_extract(entity, '^([A-Za-z]+):', 1), ''), 'OTHER') AS type FROM ents")
def _(spark, sf):
    e = base.triples(spark, sf).select(F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("text", F.lit(""))
    return types.types_by_identifier(e)


@query("pr1_anonymise", "SELECT id, 'entity' || (row_number() OVER (ORDER BY id) - 1) AS text FROM entities")
def _(spark, sf):
    return sampling.anonymise(base.entities(spark, sf))


PERM = f"r AS (SELECT id, text, row_number() OVER (ORDER BY {key('perm', 'id')}, id) AS k FROM entities), p AS (SELECT a.id, b.text FROM r a JOIN r b ON b.k = a.k % (SELECT count(*) FROM r) + 1)"


@query("pr2_permute", f"WITH {PERM} SELECT id, text FROM p")
def _(spark, sf):
    return sampling.permute(base.entities(spark, sf))


@query("pr3_permutation_invariants", f"WITH {PERM} SELECT (SELECT count(*) FROM (SELECT text FROM entities EXCEPT ALL SELECT text FROM p)) AS texts_lost, (SELECT count(*) FROM (SELECT text FROM p EXCEPT ALL SELECT text FROM entities)) AS texts_new, (SELECT round(avg(CAST(p.text <> e.text AS DOUBLE)), 6) FROM p JOIN entities e USING (id)) AS renamed")
def _(spark, sf):
    e = base.entities(spark, sf)
    p = sampling.permute(e)
    lost = e.select("text").exceptAll(p.select("text")).agg(F.count("*").alias("texts_lost"))
    new = p.select("text").exceptAll(e.select("text")).agg(F.count("*").alias("texts_new"))
    moved = p.join(e.withColumnRenamed("text", "old"), "id").agg(r6(F.avg((F.col("text") != F.col("old")).cast("double"))).alias("renamed"))
    return lost.crossJoin(new).crossJoin(moved)  # one row each


@query("pr4_surface_lookup", "SELECT t.head, t.relation, t.tail, coalesce(a.text, t.head) AS head_text, coalesce(b.text, t.tail) AS tail_text FROM test t LEFT JOIN entities a ON a.id = t.head LEFT JOIN entities b ON b.id = t.tail")
def _(spark, sf):
    return prompts.with_text(base.split(spark, sf, "test"), base.entities(spark, sf))


@query("pr5_name_before_comma", "SELECT id, split_part(text, ',', 1) AS name FROM entities")
def _(spark, sf):
    return base.entities(spark, sf).select("id", tx.before_comma(F.col("text")).alias("name"))


@query("pr6_verdict_text", "SELECT head, relation, tail, label, CASE WHEN label = 1 THEN 'Yes, this is true.' ELSE 'No, this is not true.' END AS output FROM labelled")
def _(spark, sf):
    return base.labelled(spark, sf).withColumn("output", prompts.verdict_text(F.col("label")))


# ------------------------------------------------------------------ filters, graph


@query("fi2_drop_negative_evidence", "SELECT relation, count(*) AS n FROM labelled WHERE coalesce(label, 1) <> -1 GROUP BY relation")
def _(spark, sf):
    return base.labelled(spark, sf).filter(F.coalesce("label", F.lit(1)) != -1).groupBy("relation").agg(F.count("*").alias("n"))


@query("fi7_domination", "WITH a AS (SELECT relation, count(*) AS n, avg(correct) AS acc FROM scored GROUP BY relation) SELECT x.relation FROM a x WHERE EXISTS (SELECT 1 FROM a y WHERE y.n < x.n AND y.acc >= x.acc - 0.005)")
def _(spark, sf):
    a = base.scored(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.avg("correct").alias("acc"))
    y = F.broadcast(a.select(F.col("n").alias("yn"), F.col("acc").alias("yacc")))  # one row a relation
    return a.join(y, (F.col("yn") < F.col("n")) & (F.col("yacc") >= F.col("acc") - 0.005), "left_semi").select("relation")


@query("gr1_degrees", "SELECT entity, n_in, n_out, degree FROM degrees")
def _(spark, sf):
    return graph.degrees(base.triples(spark, sf))


@query("gr2_relation_profile", "SELECT relation, count(*) AS n, count(DISTINCT head) AS n_heads, count(DISTINCT tail) AS n_tails FROM triples GROUP BY relation")
def _(spark, sf):
    return graph.relation_profile(base.triples(spark, sf))


NEAR = f"n AS (SELECT entity, other FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {key('hop', 'entity', 'other')}) AS k FROM (SELECT DISTINCT entity, other FROM incident)) WHERE k <= 3)"


@query("gr3_two_hop_neighbourhood", "WITH n AS (SELECT DISTINCT entity, other FROM incident), s AS (SELECT DISTINCT head AS entity FROM triples WHERE relation = 'basedIn'), h1 AS (SELECT DISTINCT other AS entity FROM s JOIN n USING (entity) WHERE other NOT IN (SELECT entity FROM s)), h2 AS (SELECT DISTINCT other AS entity FROM h1 JOIN n USING (entity) WHERE other NOT IN (SELECT entity FROM s UNION ALL SELECT entity FROM h1)) SELECT entity, 0 AS hop FROM s UNION ALL SELECT entity, 1 FROM h1 UNION ALL SELECT entity, 2 FROM h2")
def _(spark, sf):
    t = base.triples(spark, sf)
    return graph.k_hop(t, t.filter("relation = 'basedIn'").select(F.col("head").alias("entity")), 2)


@query("gr3_frontier_limit", f"WITH {NEAR}, s AS (SELECT DISTINCT head AS entity FROM triples WHERE relation = 'basedIn'), h1 AS (SELECT DISTINCT other AS entity FROM s JOIN n USING (entity) WHERE other NOT IN (SELECT entity FROM s)), f1 AS (SELECT entity FROM h1 ORDER BY {key('hop', 'entity')}, entity LIMIT 5), h2 AS (SELECT DISTINCT other AS entity FROM f1 JOIN n USING (entity) WHERE other NOT IN (SELECT entity FROM s UNION ALL SELECT entity FROM h1)) SELECT entity, 0 AS hop FROM s UNION ALL SELECT entity, 1 FROM h1 UNION ALL SELECT entity, 2 FROM h2")
def _(spark, sf):
    t = base.triples(spark, sf)
    return graph.k_hop(t, t.filter("relation = 'basedIn'").select(F.col("head").alias("entity")), 2, 3, frontier=5)


INV = "sup AS (SELECT relation, count(*) AS s FROM triples GROUP BY relation), back AS (SELECT DISTINCT tail AS head, head AS tail, relation AS inverse FROM triples), co AS (SELECT relation, inverse, count(*) AS n FROM triples JOIN back USING (head, tail) GROUP BY ALL), rate AS (SELECT relation, inverse, CAST(n AS DOUBLE) / s AS rate FROM co JOIN sup USING (relation) WHERE s >= 100), inv AS (SELECT a.relation, a.inverse, a.rate, b.rate AS rate_back FROM rate a JOIN rate b ON a.relation = b.inverse AND a.inverse = b.relation WHERE a.rate >= 0.5 AND b.rate >= 0.5)"


@query("gr5_inverse_relations", f"WITH {INV} SELECT relation, inverse, {R('rate', 'rate_back')} FROM inv")
def _(spark, sf):
    return rounded(graph.inverse_relations(base.triples(spark, sf)))


@query("gr6_guarded_neighbours", f"WITH {INV.replace('triples', 'train')}, i AS (SELECT relation, head AS entity, tail AS other FROM train UNION ALL SELECT relation, tail, head FROM train), j AS (SELECT DISTINCT q.qid, q.head, i.relation AS via, i.other FROM queries q JOIN i ON i.entity = q.head WHERE NOT (i.other = q.tail AND i.relation = q.relation) AND NOT EXISTS (SELECT 1 FROM inv WHERE inv.relation = q.relation AND inv.inverse = i.relation)), k AS (SELECT *, {key('nbr', 'head', 'via', 'other')} AS h, row_number() OVER (PARTITION BY qid ORDER BY {key('nbr', 'head', 'via', 'other')}) AS r FROM j) SELECT qid, string_agg(other, '|' ORDER BY h) AS neighbours FROM k WHERE r <= 3 GROUP BY qid")
def _(spark, sf):
    train = base.split(spark, sf, "train")
    return graph.guarded_neighbours(train, base.with_qid(base.split(spark, sf, "test")), graph.inverse_relations(train), 3)


SAFE = f"{INV.replace('triples', 'train')}, ni AS (SELECT DISTINCT entity, relation AS via, other FROM (SELECT relation, head AS entity, tail AS other FROM train UNION ALL SELECT relation, tail, head FROM train)), safe AS (SELECT q.qid, q.head, q.tail, ni.entity, via, other FROM queries q JOIN ni ON ni.entity IN (q.head, q.tail) WHERE via <> q.relation AND NOT EXISTS (SELECT 1 FROM inv WHERE inv.relation = q.relation AND inv.inverse = via))"


@query("gr6_safe_neighbours", f"WITH {SAFE}, d AS (SELECT DISTINCT qid, head, coalesce(e.text, other) AS text FROM safe LEFT JOIN entities e ON e.id = other WHERE entity = head AND other <> head AND other <> tail), k AS (SELECT *, {key('nbr', 'head', 'text')} AS h, row_number() OVER (PARTITION BY qid ORDER BY {key('nbr', 'head', 'text')}) AS r FROM d) SELECT qid, string_agg(text, '|' ORDER BY h) AS neighbours FROM k WHERE r <= 3 GROUP BY qid")
def _(spark, sf):
    train = base.split(spark, sf, "train")
    return graph.safe_neighbours(train, base.with_qid(base.split(spark, sf, "test")), graph.inverse_relations(train), base.entities(spark, sf), 3)


@query("gr8_two_hop_paths", "WITH p AS (SELECT q.qid, count(*) AS n FROM queries q JOIN train a ON a.head = q.head JOIN train s ON s.head = a.tail AND s.tail = q.tail GROUP BY q.qid) SELECT qid, coalesce(n, 0) AS n_paths FROM queries LEFT JOIN p USING (qid)")
def _(spark, sf):
    return graph.two_hop_counts(base.split(spark, sf, "train"), base.with_qid(base.split(spark, sf, "test")))


@query("gr8_safe_paths", f"WITH {SAFE}, la AS (SELECT qid, other AS mid, arg_min(via, {key('path', 'via')}) AS last FROM safe WHERE entity = tail AND other <> tail GROUP BY ALL), fi AS (SELECT qid, head, tail, via, other AS mid FROM safe WHERE entity = head AND other <> head AND other <> tail), j AS (SELECT *, {key('path', 'qid', 'via', 'mid')} AS h FROM fi JOIN la USING (qid, mid)), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h) AS r FROM j), p AS (SELECT qid, string_agg(concat_ws(' ', coalesce(a.text, head), via, coalesce(m.text, mid), last, coalesce(b.text, tail)), '; ' ORDER BY h) AS paths FROM k LEFT JOIN entities a ON a.id = head LEFT JOIN entities m ON m.id = mid LEFT JOIN entities b ON b.id = tail WHERE r <= 3 GROUP BY qid) SELECT qid, coalesce(paths, '') AS paths FROM queries LEFT JOIN p USING (qid)")
def _(spark, sf):
    train = base.split(spark, sf, "train")
    return graph.safe_paths(train, base.with_qid(base.split(spark, sf, "test")), graph.inverse_relations(train), base.entities(spark, sf))


@query("gr9_leak_audit", "WITH e AS (SELECT head, tail FROM train UNION SELECT tail, head FROM train) SELECT relation, count(*) AS n_leaks FROM queries q WHERE EXISTS (SELECT 1 FROM e WHERE e.head = q.head AND e.tail = q.tail) GROUP BY relation")
def _(spark, sf):
    q = base.with_qid(base.split(spark, sf, "test"))
    return q.join(graph.leaks(base.split(spark, sf, "train"), q).select("qid"), "qid", "left_semi").groupBy("relation").agg(F.count("*").alias("n_leaks"))


@query("gr10_unseen_support", "SELECT head, relation, tail FROM valid v WHERE head NOT IN (SELECT head FROM train UNION SELECT tail FROM train) OR tail NOT IN (SELECT head FROM train UNION SELECT tail FROM train)")
def _(spark, sf):
    return graph.touching_unseen(base.split(spark, sf, "train"), base.split(spark, sf, "valid"))


@query("gr12_range_type_entropy", "WITH n AS (SELECT relation, regexp_extract(tail, '^([A-Za-z]+):', 1) AS t, count(*) AS n FROM triples GROUP BY ALL), p AS (SELECT relation, n / (sum(n) OVER (PARTITION BY relation))::DOUBLE AS p FROM n) SELECT relation, round(0.0::DOUBLE - sum(p * log2(p)), 6) AS entropy FROM p GROUP BY relation")
def _(spark, sf):
    return rounded(graph.entropy(base.triples(spark, sf).withColumn("t", tx.id_prefix(F.col("tail"))), ["relation"], "t"))


# ------------------------------------------------------------------ sampling, splits, negatives


@query("sa1_uniform_sample", f"SELECT head, relation, tail FROM triples ORDER BY {key('sample', *T)} LIMIT 500")
def _(spark, sf):
    return sampling.uniform_sample(base.triples(spark, sf), 500, "sample", *sampling.TRIPLE)


@query("sa2_stratified_sample", f"WITH h AS (SELECT *, {key('strat', *T)} AS h FROM triples), f AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY h) <= 10 AS fl FROM h) SELECT head, relation, tail FROM f ORDER BY fl DESC, h LIMIT 1000")
def _(spark, sf):
    return sampling.stratified_sample(base.triples(spark, sf), 1000, 10)


@query("sa3_entity_subset", f"WITH top AS (SELECT entity FROM degrees ORDER BY degree DESC, entity LIMIT 350), rest AS (SELECT entity FROM degrees WHERE entity NOT IN (SELECT entity FROM top) ORDER BY {key('subset', 'entity')} LIMIT 150), keep AS (SELECT entity FROM top UNION ALL SELECT entity FROM rest) SELECT head, relation, tail FROM triples WHERE head IN (SELECT entity FROM keep) AND tail IN (SELECT entity FROM keep)")
def _(spark, sf):
    return sampling.entity_subset(base.triples(spark, sf), 500)


@query("sa5_random_negatives", f"WITH n AS (SELECT count(*) AS n FROM eidx), t AS (SELECT test.*, CASE WHEN {number('neg-side', *T)} % 2 = 0 THEN 'head' ELSE 'tail' END AS side, {number('neg', *T)} % n.n AS idx, ({number('neg', *T)} % n.n + 1) % n.n AS after FROM test, n), j AS (SELECT t.*, a.entity AS new, b.entity AS nxt FROM t JOIN eidx a ON a.idx = t.idx JOIN eidx b ON b.idx = t.after), p AS (SELECT *, CASE WHEN new = CASE WHEN side = 'head' THEN head ELSE tail END THEN nxt ELSE new END AS put FROM j) SELECT head, relation, tail, side, CASE WHEN side = 'head' THEN put ELSE head END AS neg_head, CASE WHEN side = 'tail' THEN put ELSE tail END AS neg_tail FROM p")
def _(spark, sf):
    return sampling.random_negatives(base.split(spark, sf, "test"), sampling.entity_index(base.triples(spark, sf)))


TYPED = f"pool AS (SELECT relation, tail AS new, row_number() OVER (PARTITION BY relation ORDER BY tail) - 1 AS idx, count(*) OVER (PARTITION BY relation) AS n FROM (SELECT DISTINCT relation, tail FROM triples)), tn AS (SELECT t.*, p.n, p.idx AS gold FROM test t LEFT JOIN pool p ON p.relation = t.relation AND p.new = t.tail), tp AS (SELECT *, CASE WHEN n - 1 > 0 THEN {number('typed', *T)} % (n - 1) END AS pick FROM tn), typed AS (SELECT tp.head, tp.relation, tp.tail, p.new AS neg_tail FROM tp LEFT JOIN pool p ON p.relation = tp.relation AND p.idx = tp.pick + CASE WHEN tp.pick >= tp.gold THEN 1 ELSE 0 END)"


@query("sa6_typed_negatives", f"WITH {TYPED} SELECT * FROM typed")
def _(spark, sf):
    return sampling.typed_negatives(base.split(spark, sf, "test"), base.triples(spark, sf))


@query("sa8_fallback_rate", f"WITH {TYPED} SELECT relation, count(*) AS n, round(avg(CAST(neg_tail IS NULL OR EXISTS (SELECT 1 FROM triples k WHERE k.head = typed.head AND k.relation = typed.relation AND k.tail = neg_tail) AS DOUBLE)), 6) AS unusable FROM typed GROUP BY relation")
def _(spark, sf):
    t = base.triples(spark, sf)
    neg = sampling.typed_negatives(base.split(spark, sf, "test"), t)
    known = t.select("head", "relation", F.col("tail").alias("neg_tail"), F.lit(1).alias("k"))
    j = neg.join(known, ["head", "relation", "neg_tail"], "left")
    return rounded(j.groupBy("relation").agg(F.count("*").alias("n"), F.avg((F.col("neg_tail").isNull() | F.col("k").isNotNull()).cast("double")).alias("unusable")))


TRIES60 = f"s AS (SELECT DISTINCT relation, 'head' AS side, head AS new FROM train UNION SELECT DISTINCT relation, 'tail', tail FROM train), pool AS (SELECT *, row_number() OVER (PARTITION BY relation, side ORDER BY new) - 1 AS idx FROM s), size AS (SELECT relation, side, count(*) AS n FROM pool GROUP BY ALL), t0 AS (SELECT test.*, try, CASE WHEN {number('tneg-side', *T, 'CAST(try AS VARCHAR)')} % 2 = 0 THEN 'head' ELSE 'tail' END AS side FROM test, (SELECT unnest(range(0, 60)) AS try)), t1 AS (SELECT t0.*, coalesce(n, 0) AS n FROM t0 LEFT JOIN size ON size.relation = t0.relation AND size.side = t0.side), t2 AS (SELECT *, {number('tneg', *T, 'CAST(try AS VARCHAR)')} % CASE WHEN n < 2 THEN (SELECT count(*) FROM eidx) ELSE n END AS idx FROM t1), tj AS (SELECT t2.*, pool.new FROM t2 JOIN pool ON pool.relation = t2.relation AND pool.side = t2.side AND pool.idx = t2.idx WHERE n >= 2 UNION ALL SELECT t2.*, e.entity FROM t2 JOIN eidx e ON e.idx = t2.idx WHERE n < 2), tg AS (SELECT *, CASE WHEN side = 'head' THEN new ELSE head END AS neg_head, CASE WHEN side = 'tail' THEN new ELSE tail END AS neg_tail FROM tj), tk AS (SELECT tg.*, EXISTS (SELECT 1 FROM triples k WHERE k.head = neg_head AND k.relation = tg.relation AND k.tail = neg_tail) AS known FROM tg WHERE neg_head <> neg_tail), best AS (SELECT head, relation, tail, min(try) FILTER (NOT known) AS try FROM tk GROUP BY ALL), acc AS (SELECT tk.head, tk.relation, tk.tail, count(*) AS accidental FROM tk JOIN best b ON b.head = tk.head AND b.relation = tk.relation AND b.tail = tk.tail WHERE known AND tk.try < coalesce(b.try, 60) GROUP BY ALL)"


@query("sa9_whole_test_negatives", f"WITH {TRIES60} SELECT t.head, t.relation, t.tail, k.neg_head, k.neg_tail, b.try, coalesce(a.accidental, 0) AS accidental, CAST(b.try IS NULL AS INTEGER) AS skipped FROM test t LEFT JOIN best b ON b.head = t.head AND b.relation = t.relation AND b.tail = t.tail LEFT JOIN acc a ON a.head = t.head AND a.relation = t.relation AND a.tail = t.tail LEFT JOIN tk k ON k.head = t.head AND k.relation = t.relation AND k.tail = t.tail AND k.try = b.try")
def _(spark, sf):
    known = base.graph_of(spark, sf).drop("split")
    return sampling.whole_test_negatives(base.split(spark, sf, "test"), base.split(spark, sf, "train"), known, sampling.entity_index(known))


@query("sa9_test_negatives", f"WITH {TRIES60} SELECT t.head, t.relation, t.tail, k.neg_head, k.neg_tail, b.try FROM test t LEFT JOIN best b ON b.head = t.head AND b.relation = t.relation AND b.tail = t.tail LEFT JOIN tk k ON k.head = t.head AND k.relation = t.relation AND k.tail = t.tail AND k.try = b.try")
def _(spark, sf):
    """One negative for every test triple: the first of 60 tries that is no known triple."""
    known = base.graph_of(spark, sf).drop("split")
    return sampling.whole_test_negatives(base.split(spark, sf, "test"), base.split(spark, sf, "train"), known, sampling.entity_index(known)).drop("accidental", "skipped")


@query("sa11_inductive_split", f"WITH u AS (SELECT head, relation, tail, {number('ind', 'head')} % 10000 < 1000 AS uh, {number('ind', 'tail')} % 10000 < 1000 AS ut FROM triples) SELECT relation, CASE WHEN NOT uh AND NOT ut THEN 'train' WHEN uh THEN 'query' ELSE 'support' END AS part, count(*) AS n FROM u GROUP BY ALL")
def _(spark, sf):
    return sampling.inductive_split(base.triples(spark, sf), 0.1).groupBy("relation", "part").agg(F.count("*").alias("n"))


def candidate_lists(spark, sf):
    t = base.graph_of(spark, sf).drop("split")
    return sampling.candidate_lists(base.with_qid(base.split(spark, sf, "test")), t, sampling.entity_index(t), N_WAY)


def candidates(spark, sf):
    return sampling.listed(candidate_lists(spark, sf))


@query("sa12_candidates", "SELECT qid, head, relation, candidate, CAST(is_gold AS INTEGER) AS is_gold FROM candidates")
def _(spark, sf):
    return candidates(spark, sf)


@query("sa13_fingerprint", "WITH c AS (SELECT qid, string_agg(candidate, ',' ORDER BY candidate) AS c FROM candidates GROUP BY qid) SELECT count(*) AS n_queries, CAST(sum(('0x' || substr(sha256(concat_ws('|', qid, c)), 1, 8))::BIGINT) AS BIGINT) AS fingerprint FROM c")
def _(spark, sf):
    return sampling.fingerprint(candidates(spark, sf))


@query("sa17_preference_pairs", "SELECT head, relation, tail, 'Is this true: ' || head || ' ' || relation || ' ' || tail || '?' AS prompt, kind, chosen, rejected FROM test, (VALUES ('positive', 'Yes, this is true.', 'No, this is not true.'), ('negative', 'No, this is not true.', 'Yes, this is true.')) v(kind, chosen, rejected)")
def _(spark, sf):
    return sampling.preference_pairs(base.split(spark, sf, "test"), prompts.YES, prompts.NO, prompts.question(F.col("head"), F.col("relation"), F.col("tail")))


# ------------------------------------------------------------------ prompts


@query("pt1_question", "SELECT t.head, t.relation, t.tail, 'Is this true: ' || coalesce(a.text, t.head) || ' ' || t.relation || ' ' || coalesce(b.text, t.tail) || '?' AS prompt FROM test t LEFT JOIN entities a ON a.id = t.head LEFT JOIN entities b ON b.id = t.tail")
def _(spark, sf):
    t = prompts.with_text(base.split(spark, sf, "test"), base.entities(spark, sf))
    return t.select("head", "relation", "tail", prompts.question(F.col("head_text"), F.col("relation"), F.col("tail_text")).alias("prompt"))


@query("pt5_exclusions", "WITH x AS (SELECT DISTINCT head, relation, tail FROM train), r AS (SELECT *, row_number() OVER (PARTITION BY head, relation ORDER BY tail) AS k FROM x) SELECT head, relation, string_agg(tail, '; ' ORDER BY tail) AS exclusions FROM r WHERE k <= 10 GROUP BY ALL")
def _(spark, sf):
    return prompts.exclusions(base.split(spark, sf, "train"), 10)


@query("pt7_demonstrations", "SELECT relation, head, tail FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY head, tail) AS k FROM train) WHERE k <= 3")
def _(spark, sf):
    return graph.first_per_group(base.split(spark, sf, "train"), ["relation"], ["head", "tail"], 3).select("relation", "head", "tail")


@query("pt9_prompt_lengths", "WITH w AS (SELECT len(string_split(text, ' ')) AS w FROM conversations WHERE text IS NOT NULL), s AS (SELECT list(w ORDER BY w) AS a, count(*) AS n FROM w) SELECT a[1] AS min, a[least(n, CAST(floor(n * 0.5::DOUBLE) AS BIGINT) + 1)] AS median, a[least(n, CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1)] AS p95, a[least(n, CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1)] AS p99, a[n] AS max FROM s")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").filter(F.col("text").isNotNull())
    return rounded(prompts.lengths(c, "text"))


@query("pt12_plain_questions", "SELECT head, relation, tail, CASE WHEN contains(lower(relation), 'located') THEN 'Where is ' || head || ' located?' WHEN contains(lower(relation), 'citizen') THEN 'Which country is ' || head || ' a citizen of?' WHEN contains(lower(relation), 'contain') THEN 'What does ' || head || ' contain?' WHEN contains(lower(relation), 'placed') THEN 'Who placed ' || head || '?' ELSE 'What is the ' || relation || ' of ' || head || '?' END AS question FROM test")
def _(spark, sf):
    return base.split(spark, sf, "test").withColumn("question", prompts.plain_question(F.col("relation"), F.col("head")))


@query("pt13_rank_verdicts", "SELECT CASE WHEN rank = 1 THEN 'first' WHEN rank <= 3 THEN 'top 3' WHEN rank <= 10 THEN 'top 10' ELSE 'missed' END AS verdict, count(*) AS n FROM ranks GROUP BY 1")
def _(spark, sf):
    return ranking.gold_ranks_of_sets(scored_sets(spark, sf)).groupBy(tx.rank_verdict(F.col("rank")).alias("verdict")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ types


@query("ty3_induced_types", "SELECT entity, type FROM types")
def _(spark, sf):
    return types.induced_types(base.triples(spark, sf))


@query("ty5_type_coverage", "WITH n AS (SELECT type, count(*) AS n FROM types GROUP BY type) SELECT count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_entities, CAST(coalesce(sum(n) FILTER (type = 'OTHER'), 0) AS BIGINT) AS n_other, max(n) AS largest, CAST((SELECT sum(n) FROM (SELECT n FROM n ORDER BY n DESC LIMIT 5)) AS BIGINT) AS top_sum FROM n")
def _(spark, sf):
    return types.type_coverage(types.induced_types(base.triples(spark, sf)))


PREFIX = "pt AS (SELECT entity, regexp_extract(entity, '^([A-Za-z]+):', 1) AS type FROM ents)"


@query("ty13_tag_leak", f"WITH {PREFIX}, n AS (SELECT relation, type, count(*) AS n FROM train t JOIN pt ON pt.entity = t.tail GROUP BY ALL), m AS (SELECT relation, type AS modal FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY n DESC, type) AS k FROM n) WHERE k = 1), j AS (SELECT l.label, coalesce(pt.type = m.modal, false) AS f1, EXISTS (SELECT 1 FROM train t WHERE t.relation = l.relation AND t.tail = l.tail) AS f2 FROM labelled l LEFT JOIN pt ON pt.entity = l.tail LEFT JOIN m ON m.relation = l.relation), r AS (SELECT 'MODAL' AS rule, label, f1 AS fires FROM j UNION ALL SELECT 'RANGE', label, f2 FROM j), o AS (SELECT rule, avg(CAST(fires AS DOUBLE)) FILTER (label = 1) AS fires_pos, avg(CAST(fires AS DOUBLE)) FILTER (label <> 1) AS fires_neg, avg(CAST(fires = (label = 1) AS DOUBLE)) AS accuracy FROM r GROUP BY rule), v AS (SELECT *, coalesce(fires_pos > 0.98 AND fires_neg > 0.98 OR fires_pos < 0.02 AND fires_neg < 0.02, true) AS vacuous FROM o) SELECT rule, {R('fires_pos', 'fires_neg', 'accuracy')}, vacuous, CASE WHEN vacuous THEN 'vacuous' WHEN accuracy < 0.55 THEN 'clean' WHEN accuracy < 0.75 THEN 'material' ELSE 'leak' END AS verdict FROM v")
def _(spark, sf):
    t = base.triples(spark, sf).select(F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("text", F.lit(""))
    return rounded(types.tag_leak(base.split(spark, sf, "train"), base.labelled(spark, sf), types.types_by_identifier(t)))


# ------------------------------------------------------------------ metrics


@query("ag1_edge_imbalance", "WITH n AS (SELECT relation, count(*) AS n FROM triples GROUP BY relation) SELECT count(*) AS n_relations, round(CAST(max(n) AS DOUBLE) / min(n), 6) AS ratio, round((SELECT sum(n) FROM (SELECT n FROM n ORDER BY n DESC LIMIT 1)) / CAST(sum(n) AS DOUBLE), 6) AS top_share FROM n")
def _(spark, sf):
    n = base.triples(spark, sf).groupBy("relation").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_relations"), r6(F.try_divide(F.max("n"), F.min("n"))).alias("ratio"), r6(F.aggregate(F.slice(F.sort_array(F.collect_list("n"), asc=False), F.lit(1), F.greatest(F.lit(1), F.floor(F.count("*") / 10).cast("int"))), F.lit(0).cast("long"), lambda a, x: a + x) / F.sum("n")).alias("top_share"))


@query("ag4_description_stats", "WITH w AS (SELECT len(string_split(text, ' ')) AS w FROM entities) SELECT round(median(w), 6) AS median, round(avg(w), 6) AS mean, CAST(max(w) AS BIGINT) AS max, round(avg(CAST(w <= 1 AS DOUBLE)), 6) AS bare FROM w")
def _(spark, sf):
    w = base.entities(spark, sf).select(F.size(F.split("text", " ")).alias("w"))
    return rounded(w.agg(F.median("w").alias("median"), F.avg("w").alias("mean"), F.max("w").alias("max"), F.avg((F.col("w") <= 1).cast("double")).alias("bare")))


@query("ag5_label_balance", "SELECT relation, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg FROM labelled GROUP BY relation")
def _(spark, sf):
    return base.labelled(spark, sf).groupBy("relation").agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") != 1).alias("n_neg"))


@query("ag6_type_entropy", "WITH n AS (SELECT type, count(*) AS n FROM types GROUP BY type), p AS (SELECT n / (SELECT sum(n) FROM n)::DOUBLE AS p FROM n) SELECT round(0.0::DOUBLE - sum(p * log2(p)), 6) AS entropy FROM p")
def _(spark, sf):
    return rounded(graph.entropy(types.induced_types(base.triples(spark, sf)), [], "type"))


@query("ag7_ambiguity", "WITH n AS (SELECT lower(split_part(text, ',', 1)) AS name, count(*) AS n FROM entities GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS n_shared, CAST(sum(n) AS BIGINT) AS n_entities, (SELECT name FROM n ORDER BY n DESC, name LIMIT 1) AS worst, max(n) AS worst_n FROM n")
def _(spark, sf):
    n = base.entities(spark, sf).groupBy(F.lower(tx.before_comma(F.col("text"))).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
    return n.agg(F.count("*").alias("n_shared"), F.sum("n").alias("n_entities"), F.min(F.struct((-F.col("n")).alias("m"), "name"))["name"].alias("worst"), F.max("n").alias("worst_n"))


@query("ag8_degree_stats", "WITH s AS (SELECT list(degree ORDER BY degree) AS a, count(*) AS n, avg(degree) AS mean, avg(CAST(degree = 1 AS DOUBLE)) AS ones FROM degrees) SELECT round(mean, 6) AS mean, a[greatest(1, CAST(floor(0.9::DOUBLE * n) AS BIGINT))] AS p90, a[n] AS max, round(ones, 6) AS degree_one, (SELECT entity FROM degrees ORDER BY degree DESC, entity LIMIT 1) AS hub FROM s")
def _(spark, sf):
    d = graph.degrees(base.triples(spark, sf))
    n = d.groupBy("degree").agg(F.count("*").alias("m"))
    total = F.sum("m").over(Window.partitionBy())
    n = n.withColumns({"upto": F.sum("m").over(Window.orderBy("degree")), "total": total})  # one row for each degree
    p90 = n.agg(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.lit(0.9) * F.col("total"))), F.col("degree"))).alias("p90"))
    s = d.agg(r6(F.avg("degree")).alias("mean"), F.max("degree").alias("max"), r6(F.avg((F.col("degree") == 1).cast("double"))).alias("degree_one"), F.min(F.struct((-F.col("degree")).alias("m"), "entity"))["entity"].alias("hub"))
    return s.crossJoin(p90).select("mean", "p90", "max", "degree_one", "hub")  # one row each


def answers(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").filter(F.col("text").isNotNull())
    put = F.element_at(F.array(*[F.lit(x) for x in ("Yes, this is true. ", "No. ", "I don't know. ", "another ", "")]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(put, F.regexp_replace("text", "[^ -~]", "")).alias("answer"))


ANSWERS = "a AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Yes, this is true. ' WHEN 1 THEN 'No. ' WHEN 2 THEN 'I don''t know. ' WHEN 3 THEN 'another ' ELSE '' END || regexp_replace(text, '[^ -~]', '', 'g') AS answer FROM conversations WHERE text IS NOT NULL)"
YES = "(contains(answer, 'Yes') OR contains(answer, ' yes'))"
MARKED = "(contains(answer, 'No') OR contains(answer, 'not') OR contains(answer, 'n''t') OR contains(answer, 'no'))"
ALONE = "regexp_matches(answer, '(^|[^A-Za-z])(No|not|n''t|no)([^A-Za-z]|$)')"
REFUSED = "regexp_matches(answer, '" + tx.REFUSAL_PATTERN.replace("'", "''") + "')"
CATEGORY = f"CASE WHEN {YES} THEN 'answered_yes' WHEN {REFUSED} THEN 'refusal_scored_as_no' WHEN {MARKED} AND NOT {ALONE} THEN 'spurious_substring' WHEN {MARKED} THEN 'answered_no' ELSE 'unparseable' END"


@query("st1_st8_parsers", f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN contains(answer, 'Yes') THEN 1 WHEN contains(answer, 'No') THEN 0 END AS strict, CASE WHEN {YES} THEN 1 WHEN {MARKED} THEN 0 END AS lenient, {REFUSED} AS refusal, {CATEGORY} AS category, CAST(starts_with(lower(trim(answer)), 'y') AS INTEGER) AS constrained, CASE WHEN {REFUSED} THEN NULL WHEN regexp_matches(answer, '" + tx.NO_PATTERN.replace("'", "''") + "') THEN 0 WHEN regexp_matches(answer, '" + tx.YES_PATTERN + "') THEN 1 END AS clean FROM a")
def _(spark, sf):
    a = F.col("answer")
    return answers(spark, sf).select("conv_id", "turn", tx.strict_verdict(a).alias("strict"), tx.lenient_verdict(a).alias("lenient"), tx.is_refusal(a).alias("refusal"), tx.category(a).alias("category"), tx.constrained_verdict(a).alias("constrained"), tx.clean_verdict(a).alias("clean"))


@query("ag10_parser_accuracy", f"WITH {ANSWERS}, g AS (SELECT (conv_id + turn) % 2 AS gold, CASE WHEN contains(answer, 'Yes') THEN 1 WHEN contains(answer, 'No') THEN 0 END AS v FROM a) SELECT count(*) AS n, count(*) FILTER (v IS NULL) AS unparseable, round(avg(CAST(coalesce(v = gold, false) AS DOUBLE)), 6) AS accuracy FROM g")
def _(spark, sf):
    a = answers(spark, sf).withColumn("gold", (F.col("conv_id") + F.col("turn")) % 2)
    return rounded(metrics.parser_accuracy(a, tx.strict_verdict(F.col("answer"))))


@query("ag11_response_breakdown", f"WITH {ANSWERS}, n AS (SELECT {CATEGORY} AS category, count(*) AS n FROM a GROUP BY 1), e(category) AS (VALUES ('answered_yes'), ('answered_no'), ('refusal_scored_as_no'), ('spurious_substring'), ('unparseable')) SELECT category, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM n)::DOUBLE, 6) AS rate FROM e LEFT JOIN n USING (category)")
def _(spark, sf):
    return rounded(metrics.response_breakdown(answers(spark, sf), "answer"))


@query("st11_normalisers", r"SELECT conv_id, turn, lower(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^\.+|\.+$', '', 'g')) AS norm FROM conversations WHERE text IS NOT NULL")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").filter(F.col("text").isNotNull()).select("conv_id", "turn", tx.normalise(F.col("text")).alias("norm"))


def candidate_scores(spark, sf):
    c = candidates(spark, sf)
    return c.withColumn("score", F.lit(0.6) * unit("rank", "head", "relation", "candidate") + F.lit(0.4) * F.col("is_gold"))


def scored_sets(spark, sf):
    """(qid, head, relation, tail, c): the scored candidates of a query in its row, as an array of (score, candidate, is_gold)."""
    score = lambda x: F.lit(0.6) * unit("rank", "head", "relation", x["candidate"]) + F.lit(0.4) * x["is_gold"]
    scored = F.transform("c", lambda x: F.struct(score(x).alias("score"), x["candidate"].alias("candidate"), x["is_gold"].alias("is_gold")))
    return sampling.with_gold(candidate_lists(spark, sf)).withColumn("c", scored)


@query("ag13_ranking_metrics", "SELECT count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(rank), 6) AS mr, round(avg(CAST(rank <= 1 AS DOUBLE)), 6) AS hits_1, round(avg(CAST(rank <= 3 AS DOUBLE)), 6) AS hits_3, round(avg(CAST(rank <= 10 AS DOUBLE)), 6) AS hits_10 FROM ranks")
def _(spark, sf):
    return rounded(ranking.ranking_metrics(ranking.gold_ranks_of_sets(scored_sets(spark, sf))))


@query("ag14_ranking_by_relation", "SELECT relation, count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(rank), 6) AS mr, round(avg(CAST(rank <= 1 AS DOUBLE)), 6) AS hits_1, round(avg(CAST(rank <= 3 AS DOUBLE)), 6) AS hits_3, round(avg(CAST(rank <= 10 AS DOUBLE)), 6) AS hits_10 FROM ranks GROUP BY relation")
def ranking_by_relation(spark, sf):
    return rounded(ranking.ranking_metrics(ranking.gold_ranks_of_sets(scored_sets(spark, sf)), "relation"))


@query("wi1_gold_ranks", "SELECT qid, relation, rank, n_way FROM ranks")
def _(spark, sf):
    return rounded(ranking.gold_ranks_of_sets(scored_sets(spark, sf)))


@query("wi2_top_and_margin", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, candidate) AS k FROM cscored) SELECT qid, string_agg(candidate, '|' ORDER BY k) FILTER (k <= 5) AS top, round(CASE WHEN count(*) > 1 THEN max(score) FILTER (k = 1) - max(score) FILTER (k = 2) ELSE 0 END, 6) AS margin FROM r GROUP BY qid")
def _(spark, sf):
    return rounded(ranking.top_and_margin_of_sets(scored_sets(spark, sf)))


CONF = "c AS (SELECT {by}count(*) FILTER (p_yes >= 0.5 AND label = 1) AS tp, count(*) FILTER (p_yes >= 0.5 AND label <> 1) AS fp, count(*) FILTER (p_yes < 0.5 AND label <> 1) AS tn, count(*) FILTER (p_yes < 0.5 AND label = 1) AS fn FROM scored{group}), m AS (SELECT *, tp + fp + tn + fn AS n, coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + tn + fn, 0), 0) AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0) AS neg_precision, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS neg_recall FROM c), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(2 * neg_precision * neg_recall / nullif(neg_precision + neg_recall, 0), 0) AS neg_f1 FROM m)"
CONF_OUT = f"tp, fp, tn, fn, n, {R('accuracy', 'precision', 'recall', 'neg_precision', 'neg_recall', 'f1', 'neg_f1')}, round((f1 + neg_f1) / 2, 6) AS macro_f1, round((recall + neg_recall) / 2, 6) AS balanced_accuracy, round(coalesce(CAST(tp + fp AS DOUBLE) / nullif(n, 0), 0), 6) AS positive_rate"


@query("ag15_binary_metrics", f"WITH {CONF.format(by='', group='')} SELECT {CONF_OUT} FROM f")
def _(spark, sf):
    return rounded(metrics.confusion(base.scored(spark, sf)))


@query("ag65_metrics_by_relation", f"WITH {CONF.format(by='relation, ', group=' GROUP BY relation')} SELECT relation, {CONF_OUT} FROM f")
def _(spark, sf):
    return rounded(metrics.confusion(base.scored(spark, sf), "relation"))


@query("ag16_majority_baseline", "WITH x AS (SELECT relation, avg(CAST(label = 1 AS DOUBLE)) AS pos, avg(CAST(p_yes >= 0.5 AS DOUBLE)) AS said_yes FROM scored GROUP BY relation) SELECT relation, round(greatest(pos, 1 - pos), 6) AS majority, round(said_yes, 6) AS said_yes, greatest(said_yes, 1 - said_yes) > 0.95 AS degenerate FROM x")
def _(spark, sf):
    return rounded(metrics.majority_baseline(base.scored(spark, sf), "relation"))


@query("ag17_accuracy_spread", "WITH a AS (SELECT relation, avg(CAST((p_yes >= 0.5) = (label = 1) AS DOUBLE)) AS acc FROM scored GROUP BY relation HAVING count(*) >= 20) SELECT count(*) AS n_groups, (SELECT relation FROM a ORDER BY acc, relation LIMIT 1) AS worst, (SELECT relation FROM a ORDER BY acc DESC, relation DESC LIMIT 1) AS best, round(max(acc) - min(acc), 6) AS spread FROM a")
def _(spark, sf):
    return rounded(metrics.accuracy_by(base.scored(spark, sf), "relation"))


@query("ag18_class_confusion", "WITH p AS (SELECT relation AS gold, CASE WHEN correct = 1 THEN relation ELSE 'contains' END AS pred FROM scored), k AS (SELECT gold AS class FROM p UNION SELECT pred FROM p), c AS (SELECT class, (SELECT count(*) FROM p WHERE gold = class) AS support, (SELECT count(*) FROM p WHERE pred = class) AS predicted, (SELECT count(*) FROM p WHERE gold = class AND pred = class) AS correct FROM k), r AS (SELECT *, coalesce(CAST(correct AS DOUBLE) / nullif(predicted, 0), 0) AS precision, coalesce(CAST(correct AS DOUBLE) / nullif(support, 0), 0) AS recall FROM c) SELECT class, support, predicted, correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r")
def _(spark, sf):
    p = base.scored(spark, sf).select(F.col("relation").alias("gold"), F.when(F.col("correct") == 1, F.col("relation")).otherwise("contains").alias("pred"))
    return rounded(metrics.class_confusion(p, "gold", "pred"))


BINS = "b(bin, lo, hi) AS (VALUES " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(metrics.EDGES, metrics.EDGES[1:], strict=False))) + ")"


@query("ag19_reliability_bins", f"WITH {BINS} SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(CAST(correct AS DOUBLE)), 6) AS acc FROM scored s JOIN b ON (s.conf > lo OR (lo = 0 AND s.conf >= lo)) AND s.conf <= hi GROUP BY bin")
def _(spark, sf):
    return rounded(metrics.reliability(base.scored(spark, sf), "conf", "correct"))


@query("ag19_ag21_calibration_error", f"WITH {BINS}, r AS (SELECT relation, bin, count(*) AS n, avg(conf) AS c, avg(CAST(correct AS DOUBLE)) AS a FROM scored s JOIN b ON (s.conf > lo OR (lo = 0 AND s.conf >= lo)) AND s.conf <= hi GROUP BY relation, bin) SELECT r.relation, round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(max(abs(a - c)), 6) AS mce, round(any_value(q.b), 6) AS brier FROM r JOIN (SELECT relation, avg(pow(conf - correct, 2)) AS b FROM scored GROUP BY relation) q USING (relation) GROUP BY r.relation")
def _(spark, sf):
    return rounded(metrics.calibration_error(base.scored(spark, sf), "conf", "correct", "relation"))


GRID = [round(0.25 * i, 2) for i in range(1, 21)]


@query("ag22_temperature", "WITH g(t) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in GRID) + "), l AS (SELECT correct, ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, conf)) / (1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, conf)))) AS z FROM scored), q AS (SELECT t, correct, greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, 1 / (1 + exp(-z / t)))) AS q FROM l, g), n AS (SELECT t, avg(-CASE WHEN correct = 1 THEN ln(q) ELSE ln(1 - q) END) AS nll FROM q GROUP BY t) SELECT t AS temperature, round(nll, 6) AS nll FROM n ORDER BY nll, t LIMIT 1")
def _(spark, sf):
    return rounded(metrics.temperature(base.scored(spark, sf), "conf", "correct", GRID))


def _pooled_sql(source: str, by: str, out: str) -> str:
    """Pooling in SQL, for rows (k, s, m) in groups: the largest of the smallest means of runs that begin before and end after."""
    return f"{out}_c AS MATERIALIZED (SELECT *, sum(s) OVER w AS cs, sum(m) OVER w AS cm FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY k)), {out}_p AS (SELECT b.k, min((b.cs - a.cs + a.s) / (b.cm - a.cm + a.m)::DOUBLE) OVER (PARTITION BY a.k ORDER BY b.k DESC) AS low FROM {out}_c a JOIN {out}_c b ON b.{by} = a.{by} AND b.k >= a.k), {out} AS MATERIALIZED (SELECT c.*, x.fit FROM {out}_c c JOIN (SELECT k, max(low) AS fit FROM {out}_p GROUP BY k) x USING (k))"


# runs of 100 confidences are pooled on their own first, then their blocks together
@query("ag23_isotonic", f"WITH g AS (SELECT conf, sum(correct) AS s, count(*) AS m FROM scored GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY conf) AS k FROM g), r0 AS MATERIALIZED (SELECT *, (k - 1) // 100 AS run FROM r), {_pooled_sql('r0', 'run', 'one')}, blocks AS MATERIALIZED (SELECT run, fit AS own, min(k) AS k, sum(s) AS s, sum(m) AS m, 0 AS whole FROM one GROUP BY run, fit), {_pooled_sql('blocks', 'whole', 'two')} SELECT round(one.conf, 6) AS conf, round(two.fit, 6) AS fit FROM one JOIN two ON two.run = one.run AND two.own = one.fit")
def _(spark, sf):
    return rounded(stats.isotonic(base.scored(spark, sf), "conf", "correct"))


BUCKET = "seen AS (SELECT head AS e FROM train UNION SELECT tail FROM train), fam AS (SELECT s.*, CASE (CAST(head IN (SELECT e FROM seen) AS INTEGER) + CAST(tail IN (SELECT e FROM seen) AS INTEGER)) WHEN 2 THEN 'both' WHEN 1 THEN 'one' ELSE 'neither' END AS bucket FROM scored s)"


@query("ag28_seen_unseen", f"WITH {BUCKET} SELECT bucket, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(conf), 6) AS conf FROM fam GROUP BY bucket")
def _(spark, sf):
    f = audit.familiarity(base.split(spark, sf, "train"), base.scored(spark, sf))
    return rounded(f.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("conf").alias("conf")))


@query("ag29_balanced_seen_unseen", f"WITH {BUCKET}, c AS (SELECT bucket, label, avg(correct) AS r, count(*) AS n FROM fam GROUP BY ALL) SELECT bucket, CAST(sum(n) AS BIGINT) AS n, round(avg(r), 6) AS balanced FROM c GROUP BY bucket")
def _(spark, sf):
    f = audit.familiarity(base.split(spark, sf, "train"), base.scored(spark, sf))
    c = f.groupBy("bucket", "label").agg(F.avg("correct").alias("r"), F.count("*").alias("n"))
    return rounded(c.groupBy("bucket").agg(F.sum("n").alias("n"), F.avg("r").alias("balanced")))


def arms(spark, sf):
    """Two arms of 0/1 results on the same queries."""
    s = base.labelled(spark, sf)
    right = lambda salt, lean: (((F.lit(1 - lean) * unit(salt, *sampling.TRIPLE) + F.lit(lean) * (F.col("label") == 1).cast("double") >= 0.5) == (F.col("label") == 1)).cast("int"))
    return s.withColumns({"a": right("arm-a", 0.4), "b": right("arm-b", 0.2)})


ARMS = f"arm AS (SELECT relation, CAST((0.6::DOUBLE * {U.format(number('arm-a', *T))} + 0.4::DOUBLE * CAST(label = 1 AS DOUBLE) >= 0.5) = (label = 1) AS INTEGER) AS a, CAST((0.8::DOUBLE * {U.format(number('arm-b', *T))} + 0.2::DOUBLE * CAST(label = 1 AS DOUBLE) >= 0.5) = (label = 1) AS INTEGER) AS b FROM labelled)"


TAIL = "list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2::DOUBLE))))"


@query("ag31_mcnemar", f"WITH {ARMS}, c AS (SELECT relation, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 0 AND b = 1) AS n01 FROM arm GROUP BY relation), d AS (SELECT *, n10 + n01 AS n, least(n10, n01) AS k FROM c) SELECT relation, n10, n01, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * {TAIL}) END, 6) AS p_exact, round(coalesce(pow(abs(n10 - n01) - 1, 2) / nullif(n, 0), 0), 6) AS chi2 FROM d")
def _(spark, sf):
    return rounded(stats.mcnemar(arms(spark, sf), "relation"))


#: Two-sided p of Student's t in SQL: the density summed by Simpson's rule in u = atan(t / sqrt(freedom)).
STUDENT = "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs(t) / sqrt(v)) * i / 2000.0::DOUBLE), v - 1))) * atan(abs(t) / sqrt(v)) / 6000 * 2 * exp(lgamma((v + 1) / 2.0::DOUBLE) - lgamma(v / 2.0::DOUBLE)) / sqrt(pi())"


@query("ag32_paired_t", f"WITH {ARMS}, s AS (SELECT relation, count(*) AS n, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd FROM arm GROUP BY relation), x AS (SELECT relation, n, mean_diff, mean_diff * sqrt(n) / nullif(sd, 0) AS t, mean_diff / nullif(sd, 0) AS dz, n - 1 AS v FROM s) SELECT relation, n, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(dz, 6) AS dz, round(CASE WHEN v > 0 AND t IS NOT NULL THEN greatest(0, 1 - {STUDENT}) END, 5) AS p FROM x")
def _(spark, sf):
    return rounded(stats.paired_t(arms(spark, sf), "relation")).withColumn("p", F.round(F.greatest("p", F.lit(0.0)), 5))


GAPS = f"gap AS (SELECT relation, floor((10 * ({number('gap-a', *T)} % 10000) - 9 * ({number('gap-b', *T)} % 10000)) / 1000.0::DOUBLE) AS d FROM labelled)"


def gaps(spark, sf):
    """Two arms of scores on the same triples, in whole hundredths, so that many differences are tied."""
    d = F.floor((10 * (det_number("gap-a", *sampling.TRIPLE) % 10000) - 9 * (det_number("gap-b", *sampling.TRIPLE) % 10000)) / F.lit(1000.0))
    return base.labelled(spark, sf).select("relation", d.alias("a"), F.lit(0).alias("b"))


@query("ag32_wilcoxon", f"""WITH {GAPS}, k AS (SELECT relation, abs(d) AS s, count(*) AS m, count(*) FILTER (d > 0) AS mp FROM gap WHERE d <> 0 GROUP BY ALL), r AS (SELECT *, sum(m) OVER (PARTITION BY relation ORDER BY s) - m + (m + 1) / 2.0::DOUBLE AS rank FROM k),
  w AS (SELECT relation, CAST(sum(m) AS DOUBLE) AS n, sum(rank * mp) AS wp, sum(rank * (m - mp)) AS wm, sum(pow(m, 3) - m) AS ties FROM r GROUP BY relation), z AS (SELECT *, (wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w),
  p AS (SELECT *, CASE WHEN abs(z) >= 12 THEN 0 ELSE greatest(0, 1 - sqrt(2 / pi()) * abs(z) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 2000.0::DOUBLE, 2) / 2)))) END AS p FROM z), o AS (SELECT relation, count(*) FILTER (d = 0) AS n_zero FROM gap GROUP BY relation)
  SELECT relation, CAST(n AS BIGINT) AS n, n_zero, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(p, 6) AS p FROM p JOIN o USING (relation) WHERE n > {stats.EXACT_RANKS}""")  # fmt: skip
def _(spark, sf):
    """Relations of more differences than an exact test takes; the tests hold the exact one."""
    return rounded(stats.signed_rank(gaps(spark, sf), "relation").filter(F.col("n") > stats.EXACT_RANKS))


@query("ag35_seed_variance", f"WITH {ARMS}, s AS (SELECT relation, count(*) AS n, avg(a) AS mean, coalesce(stddev_samp(a), 0) AS sd FROM arm GROUP BY relation) SELECT relation, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS sem, round(mean - 1.96::DOUBLE * (sd / sqrt(n)), 6) AS lo, round(mean + 1.96::DOUBLE * (sd / sqrt(n)), 6) AS hi FROM s")
def _(spark, sf):
    return rounded(stats.seed_variance(arms(spark, sf), "a", "relation"))


@query("ag36_auc", "WITH r AS (SELECT label, rank() OVER (ORDER BY p_yes) + (count(*) OVER (PARTITION BY p_yes) - 1) / 2.0::DOUBLE AS r FROM scored), s AS (SELECT sum(r) FILTER (label = 1) AS rs, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg FROM r) SELECT n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos * n_neg, 0), 6) AS auc FROM s")
def _(spark, sf):
    return rounded(metrics.auc(base.scored(spark, sf)))


@query("ag37_best_threshold", "WITH g AS (SELECT p_yes, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM scored GROUP BY p_yes), c AS (SELECT p_yes, (sum(p) OVER w / (SELECT sum(p) FROM g)::DOUBLE + 1 - sum(q) OVER w / (SELECT sum(q) FROM g)::DOUBLE) / 2 AS bal FROM g WINDOW w AS (ORDER BY p_yes DESC ROWS UNBOUNDED PRECEDING)) SELECT round(p_yes, 6) AS threshold, round(bal, 6) AS balanced_accuracy FROM c ORDER BY bal DESC, p_yes DESC LIMIT 1")
def _(spark, sf):
    return rounded(metrics.best_threshold(base.scored(spark, sf)))


@query("ag42_sampled_agreement", "WITH s AS (SELECT conv_id AS qid, turn AS i, role AS t FROM conversations), n AS (SELECT qid, t, count(*) AS n, min(i) AS f FROM s GROUP BY ALL), p AS (SELECT *, n / (sum(n) OVER (PARTITION BY qid))::DOUBLE AS p FROM n), m AS (SELECT qid, t AS mode FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, f, t DESC) AS k FROM n) WHERE k = 1) SELECT p.qid, any_value(m.mode) AS mode, round(max(p), 6) AS agreement, round(1 - max(p), 6) AS disagreement, count(*) AS n_distinct, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS entropy FROM p JOIN m USING (qid) GROUP BY p.qid")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("qid"), F.col("turn").alias("sample_idx"), F.col("role").alias("text"))
    return rounded(metrics.sampled_agreement(c))


#: Resamples of the bootstrap queries.
DRAWS = 400


def boot_sql(kinds: str, values: list[str]) -> str:
    """CTEs kinds, boots (grp, draw, n, values): the Poisson resamples; `kinds` selects grp, the values and m."""
    name = ", ".join(["'boot'", "CAST(draw AS VARCHAR)", "grp", *[f"CAST(CAST(round({v} * 1e6::DOUBLE) AS BIGINT) AS VARCHAR)" for v in values]])
    at = lambda i: f"((CAST(('0x' || substr(h, {i}, 13))::BIGINT AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE)"
    sums = ", ".join(f"sum(w * {v}) AS {v}" for v in values)
    return f"""kinds AS ({kinds}), cdf AS (SELECT m, j, sum(exp(-m + j * ln(m) - lgamma(j + 1))) OVER (PARTITION BY m ORDER BY j) AS upto FROM (SELECT DISTINCT m FROM kinds WHERE m <= {stats.SMALL_COUNT}), (SELECT unnest(range(0, 121)) AS j)),
  picks AS (SELECT *, sha256(concat_ws('|', {name})) AS h FROM kinds, (SELECT unnest(range(0, {DRAWS})) AS draw)),
  weights AS (SELECT d.*, CASE WHEN m <= {stats.SMALL_COUNT} THEN (SELECT count(*) FROM cdf WHERE cdf.m = d.m AND cdf.j < 120 AND {at(1)} > cdf.upto) ELSE greatest(0, floor(m + sqrt(m) * sqrt(-2 * ln({at(1)})) * cos(2 * pi() * {at(14)}) + 0.5::DOUBLE)) END AS w FROM picks d),
  boots AS (SELECT grp, draw, sum(w) AS n, {sums} FROM weights GROUP BY grp, draw)"""  # fmt: skip


_ARM_KINDS = "SELECT relation AS grp, a, b, count(*) AS m FROM arm GROUP BY ALL"


@query("ag45_bootstrap_interval", f"""WITH {ARMS}, {boot_sql("SELECT relation AS grp, a, 0 AS b, count(*) AS m FROM arm GROUP BY ALL", ["a", "b"])}, v AS (SELECT grp, list(round(a / n, 12) ORDER BY round(a / n, 12)) AS v FROM boots WHERE n > 0 GROUP BY grp)
  SELECT grp AS relation, n, round(mean, 6) AS mean, round(v[{int(0.025 * DRAWS) + 1}], 6) AS lo, round(v[least(len(v), {int(0.975 * DRAWS) + 1})], 6) AS hi FROM (SELECT grp, CAST(sum(m) AS BIGINT) AS n, sum(a * m) / sum(m)::DOUBLE AS mean FROM kinds GROUP BY grp) JOIN v USING (grp)""")  # fmt: skip
def _(spark, sf):
    one = arms(spark, sf).select("relation", "a", F.lit(0).alias("b"))
    return rounded(stats.paired_bootstrap(one, "relation", DRAWS).select("relation", "n", F.col("diff").alias("mean"), "lo", "hi"))


@query("ag46_paired_bootstrap", f"""WITH {ARMS}, {boot_sql(_ARM_KINDS, ["a", "b"])}, v AS (SELECT grp, list(round((a - b) / n, 12) ORDER BY round((a - b) / n, 12)) AS v FROM boots WHERE n > 0 GROUP BY grp),
  r AS (SELECT grp, CAST(sum(m) AS BIGINT) AS n, sum((a - b) * m) / sum(m)::DOUBLE AS diff, CAST(coalesce(sum(m) FILTER (a > b), 0) AS BIGINT) AS better, CAST(coalesce(sum(m) FILTER (a < b), 0) AS BIGINT) AS worse, CAST(coalesce(sum(m) FILTER (a = b), 0) AS BIGINT) AS tied FROM kinds GROUP BY grp),
  x AS (SELECT *, v[{int(0.025 * DRAWS) + 1}] AS lo, v[least(len(v), {int(0.975 * DRAWS) + 1})] AS hi, least(1, 2 * least(len(list_filter(v, lambda x: x <= 0)), len(list_filter(v, lambda x: x >= 0))) / len(v)::DOUBLE) AS p FROM r JOIN v USING (grp))
  SELECT grp AS relation, n, round(diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p, better, worse, tied, CASE WHEN lo > 0 THEN 'better' WHEN hi < 0 THEN 'worse' ELSE 'indistinguishable' END AS verdict FROM x""")  # fmt: skip
def _(spark, sf):
    return rounded(stats.verdict(stats.paired_bootstrap(arms(spark, sf), "relation", DRAWS)))


@query("ag48_detectable_effect", f"WITH {ARMS}, s AS (SELECT relation, count(*) AS n, stddev_samp(a) AS sd FROM arm GROUP BY relation) SELECT relation, n, round(sd, 6) AS sd, round(2.8015852::DOUBLE * sd / sqrt(n), 6) AS mde, round(sd / sqrt(n), 6) AS sem, CAST(CASE WHEN sd > 0 THEN ceil(pow(2.8015852::DOUBLE * sd / 0.02::DOUBLE, 2)) ELSE 0 END AS BIGINT) AS n_for_effect FROM s")
def _(spark, sf):
    return rounded(stats.detectable(arms(spark, sf), "a", "relation", effect=0.02))


# three arms of ranks on the same queries: real names, permuted ones, none

THREE = {"real": ("rank", 0.4), "permuted": ("rank-s", 0.25), "anonymised": ("rank-b", 0.1)}


def three_arms(spark, sf):
    """(qid, relation, n_way, real, permuted, anonymised): the gold's rank among the same candidates in each arm."""
    score = lambda x, salt, lean: F.lit(1 - lean) * unit(salt, "head", "relation", x["candidate"]) + F.lit(lean) * x["is_gold"]
    sets = sampling.with_gold(candidate_lists(spark, sf))
    scored = F.transform("c", lambda x: F.struct(x["candidate"].alias("candidate"), *[score(x, salt, lean).alias(f"_{k}") for k, (salt, lean) in THREE.items()]))
    sets = sets.select("qid", "relation", scored.alias("c")).withColumn("g", F.element_at("c", -1))  # the gold is the last
    before = lambda k: lambda x: (x[f"_{k}"] > F.col(f"g._{k}")) | ((x[f"_{k}"] == F.col(f"g._{k}")) & (x["candidate"] < F.col("g.candidate")))
    return sets.select("qid", "relation", F.size("c").alias("n_way"), *[(F.size(F.filter("c", before(k))) + 1).alias(k) for k in THREE])


THREE_ARMS = "three0 AS (SELECT c.*, " + ", ".join(f"{1 - lean}::DOUBLE * {U.format(number(salt, 'head', 'relation', 'candidate'))} + {lean}::DOUBLE * is_gold AS s_{k}" for k, (salt, lean) in THREE.items()) + " FROM candidates c), three AS (SELECT c.qid, c.relation, count(*) AS n_way, " + ", ".join(f"count(*) FILTER (c.s_{k} > g.s_{k} OR (c.s_{k} = g.s_{k} AND c.candidate < g.candidate)) + 1 AS {k}" for k in THREE) + " FROM three0 c JOIN three0 g ON g.qid = c.qid AND g.is_gold = 1 GROUP BY ALL)"
SHARES = {"binding": ("real", "permuted"), "readability": ("permuted", "anonymised"), "residual": ("anonymised", None), "memorisation": ("real", "anonymised")}
CHANCE = sum(1 / i for i in range(1, N_WAY + 1)) / N_WAY


@query("ag47_share_bootstrap", f"""WITH {THREE_ARMS}, {boot_sql('SELECT relation AS grp, 1.0::DOUBLE / "real" AS "real", 1.0::DOUBLE / permuted AS permuted, 1.0::DOUBLE / anonymised AS anonymised, count(*) AS m FROM three GROUP BY ALL', ['"real"', "permuted", "anonymised"])},
  total AS (SELECT grp, CAST(sum(m) AS BIGINT) AS n, sum(m * "real") AS "real", sum(m * permuted) AS permuted, sum(m * anonymised) AS anonymised FROM kinds GROUP BY grp),
  shares AS (SELECT unnest(['binding', 'readability', 'residual', 'memorisation']) AS share), part AS (SELECT grp, draw, share, n, (CASE share WHEN 'binding' THEN "real" - permuted WHEN 'readability' THEN permuted - anonymised WHEN 'residual' THEN anonymised - {CHANCE}::DOUBLE * n ELSE "real" - anonymised END) / nullif("real" - {CHANCE}::DOUBLE * n, 0) AS v FROM (SELECT grp, draw, n, "real", permuted, anonymised FROM boots UNION ALL SELECT grp, -1, n, "real", permuted, anonymised FROM total), shares),
  v AS (SELECT grp, share, list(round(v, 12) ORDER BY round(v, 12)) FILTER (draw >= 0 AND v IS NOT NULL) AS v, max(n) FILTER (draw = -1) AS n, max(v) FILTER (draw = -1) AS estimate FROM part GROUP BY grp, share)
  SELECT grp AS relation, CAST(n AS BIGINT) AS n, share, round(estimate, 6) AS estimate, round(v[{int(0.025 * DRAWS) + 1}], 6) AS lo, round(v[least(len(v), {int(0.975 * DRAWS) + 1})], 6) AS hi FROM v""")  # fmt: skip
def _(spark, sf):
    """Shares of MRR above chance, each with the interval of resamples that its numerator and denominator share."""
    rows = three_arms(spark, sf).select("relation", *[(1 / F.col(k)).alias(k) for k in THREE])
    chance = F.lit(CHANCE) * F.col("n")
    shares = {k: (F.col(a) - (F.col(b) if b else chance), F.col("real") - chance) for k, (a, b) in SHARES.items()}
    return rounded(stats.share_bootstrap(rows, "relation", shares, list(THREE), DRAWS))


@query("ag55_degree_regression", "SELECT round(regr_slope(p_yes, log10(d.degree)), 6) AS slope, round(regr_intercept(p_yes, log10(d.degree)), 6) AS intercept, round(regr_r2(p_yes, log10(d.degree)), 6) AS r2 FROM scored s JOIN degrees d ON d.entity = s.tail")
def _(spark, sf):
    d = graph.degrees(base.triples(spark, sf)).select(F.col("entity").alias("tail"), F.log10("degree").alias("x"))
    j = base.scored(spark, sf).join(d, "tail")
    return rounded(j.agg(F.regr_slope("p_yes", "x").alias("slope"), F.regr_intercept("p_yes", "x").alias("intercept"), F.regr_r2("p_yes", "x").alias("r2")))


@query("ag57_spearman", "WITH x AS (SELECT s.relation, s.p_yes, d.degree FROM scored s JOIN degrees d ON d.entity = s.tail), r AS (SELECT relation, rank() OVER (PARTITION BY relation ORDER BY p_yes) + (count(*) OVER (PARTITION BY relation, p_yes) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY relation ORDER BY degree) + (count(*) OVER (PARTITION BY relation, degree) - 1) / 2.0::DOUBLE AS b FROM x) SELECT relation, count(*) AS n, round(CASE WHEN count(*) >= 10 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS rho FROM r GROUP BY relation")
def _(spark, sf):
    d = graph.degrees(base.triples(spark, sf)).select(F.col("entity").alias("tail"), "degree")
    return rounded(ranking.spearman(base.scored(spark, sf).join(d, "tail"), "p_yes", "degree", "relation"))


@query("ag61_fit_diagnosis", "WITH c AS (SELECT user_id AS run, event_id AS step, value AS loss FROM events), d AS (SELECT run, arg_min(loss, step) AS first, arg_max(loss, step) AS last, min(loss) AS least, max(step) AS last_step FROM c GROUP BY run), b AS (SELECT run, min(step) AS best_step FROM c JOIN d USING (run) WHERE loss = least GROUP BY run) SELECT run, round(first, 6) AS first, round(last, 6) AS last, round(least, 6) AS least, best_step, last_step, CASE WHEN last > least * 1.1::DOUBLE THEN 'overfit' WHEN last > first * 0.95::DOUBLE THEN 'underfit' ELSE 'good' END AS verdict FROM d JOIN b USING (run)")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return rounded(metrics.fit_diagnosis(e))


# ------------------------------------------------------------------ windows, abstention

CURVE = "o AS (SELECT correct, row_number() OVER (ORDER BY conf DESC, id) AS k, sum(correct) OVER (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS hits FROM scored), n AS (SELECT count(*) AS n FROM o), pts AS (SELECT DISTINCT CAST(floor(1 + i * (n - 1) / CAST(least(50, n) - 1 AS DOUBLE)) AS BIGINT) AS k FROM n, range(0, 50) r(i)), curve AS (SELECT o.k, o.k / n::DOUBLE AS coverage, hits / o.k::DOUBLE AS precision, 1 - hits / o.k::DOUBLE AS risk FROM o JOIN pts USING (k), n)"


@query("wi4_risk_coverage", f"WITH {CURVE} SELECT k, {R('coverage', 'precision', 'risk')} FROM curve")
def _(spark, sf):
    return rounded(abstention.risk_coverage(base.scored(spark, sf)))


@query("wi6_aurc", f"WITH {CURVE}, l AS (SELECT coverage, risk, lag(coverage) OVER (ORDER BY coverage) AS pc, lag(risk) OVER (ORDER BY coverage) AS pr FROM curve) SELECT round(sum((coverage - pc) * (risk + pr) / 2) / (max(coverage) - min(coverage)), 6) AS aurc FROM l")
def _(spark, sf):
    return rounded(abstention.aurc(abstention.risk_coverage(base.scored(spark, sf))))


@query("wi7_degree_percentile", "WITH n AS (SELECT degree, count(*) AS m FROM degrees GROUP BY degree), b AS (SELECT degree, coalesce(sum(m) OVER (ORDER BY degree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT count(*) FROM degrees)::DOUBLE AS s FROM n) SELECT entity, degree, round(s, 6) AS degree_percentile FROM degrees JOIN b USING (degree)")
def _(spark, sf):
    return rounded(routing.degree_percentiles(base.triples(spark, sf)))


@query("ab1_coverage_at_precision", f"WITH {CURVE}, g(target) AS (VALUES (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)), b AS (SELECT target, max(coverage) FILTER (precision >= target) AS coverage, max(k) FILTER (precision >= target) AS k FROM g, curve GROUP BY target) SELECT target, round(coverage, 6) AS coverage, k, coalesce(coverage < 0.05, true) AS degenerate FROM b")
def _(spark, sf):
    return rounded(abstention.coverage_at_precision(abstention.risk_coverage(base.scored(spark, sf)), [0.9, 0.95, 0.99]))


@query("ab2_precision_at_coverage", f"WITH {CURVE} SELECT 0.8::DOUBLE AS coverage, k, round(precision, 6) AS precision FROM curve ORDER BY abs(coverage - 0.8::DOUBLE), k LIMIT 1")
def _(spark, sf):
    return rounded(abstention.precision_at_coverage(abstention.risk_coverage(base.scored(spark, sf)), 0.8))


@query("ab3_abstention_at_threshold", "WITH a AS (SELECT count(*) AS n, count(*) FILTER (conf >= 0.7) AS answered, count(*) FILTER (conf >= 0.7 AND correct = 1) AS answered_right, count(*) FILTER (correct = 1) AS \"right\", count(*) FILTER (conf < 0.7 AND correct = 0) AS errors_avoided, count(*) FILTER (conf < 0.7 AND correct = 1) AS right_withheld FROM scored) SELECT *, round(answered / nullif(n, 0)::DOUBLE, 6) AS coverage, round(answered_right / nullif(answered, 0)::DOUBLE, 6) AS selective_accuracy, round(\"right\" / nullif(n, 0)::DOUBLE, 6) AS forced_accuracy, round(errors_avoided / nullif(n - answered, 0)::DOUBLE, 6) AS abstention_precision, round(answered_right / nullif(answered, 0)::DOUBLE - \"right\" / nullif(n, 0)::DOUBLE, 6) AS gain FROM a")
def _(spark, sf):
    return rounded(abstention.at_threshold(base.scored(spark, sf), 0.7))


# ------------------------------------------------------------------ routing, budget


def features(spark, sf):
    t = base.triples(spark, sf)
    s = types.signatures(t)
    return routing.element_features(base.entities(spark, sf), types.types_of(s), t, s.select("entity", "degree"))


FEATURES = f"id, kind, semantic_type, {L('label_len_chars', 'label_len_words', 'n_alpha_words')}, looks_opaque, has_description, {L('description_len', 'ambiguity', 'degree')}, round(degree_percentile, 6) AS degree_percentile, quality_band"


@query("rt1_element_features", f"SELECT {FEATURES} FROM features")
def _(spark, sf):
    return rounded(features(spark, sf))


@query("rt3_feature_report", "SELECT quality_band, count(*) AS n, round(avg(CAST(looks_opaque AS DOUBLE)), 6) AS opaque, round(avg(CAST(has_description AS DOUBLE)), 6) AS described, round(avg(CAST(ambiguity > 1 AS DOUBLE)), 6) AS ambiguous FROM features GROUP BY quality_band")
def _(spark, sf):
    f = features(spark, sf)
    rate = lambda c: F.avg(c.cast("double"))
    return rounded(f.groupBy("quality_band").agg(F.count("*").alias("n"), rate(F.col("looks_opaque")).alias("opaque"), rate(F.col("has_description")).alias("described"), rate(F.col("ambiguity") > 1).alias("ambiguous")))


L3 = "CASE WHEN looks_opaque THEN 'typed_neighbours' WHEN ambiguity > 3 THEN 'typed_neighbours' WHEN has_description AND quality_band = 'rich' THEN 'none' ELSE 'description_only' END"
PLANS = f"p3 AS (SELECT id, has_description, degree_percentile, semantic_type, {L3} AS l3 FROM features), plans AS (SELECT id, 'L0' AS level, 'full' AS action FROM p3 UNION ALL SELECT id, 'L1', 'description_only' FROM p3 UNION ALL SELECT id, 'L2', CASE WHEN semantic_type = 'OTHER' THEN 'typed_neighbours' ELSE 'description_only' END FROM p3 UNION ALL SELECT id, 'L3', l3 FROM p3 UNION ALL SELECT id, 'L4', CASE WHEN l3 = 'none' AND degree_percentile < 0.1 THEN 'typed_neighbours' WHEN l3 = 'description_only' AND degree_percentile > 0.9 AND has_description THEN 'none' ELSE l3 END FROM p3), costs AS (SELECT *, CASE action WHEN 'none' THEN 0 WHEN 'description_only' THEN 25 WHEN 'relation_description' THEN 20 WHEN 'exclusion_list' THEN 40 WHEN 'typed_neighbours' THEN 60 ELSE 145 END AS token_cost FROM plans)"


@query("rt4_routing", f"WITH {PLANS} SELECT id, level, action, CAST(token_cost AS BIGINT) AS token_cost FROM costs")
def _(spark, sf):
    return rounded(routing.routed(features(spark, sf)).drop("cited"))


@query("rt5_ladder", f"WITH {PLANS} SELECT level, count(*) AS n_elements, CAST(sum(token_cost) AS BIGINT) AS routed_tokens, count(*) * 145 AS baseline_tokens, round(avg(CAST(action = 'none' AS DOUBLE)), 6) AS skip_rate, round(1 - sum(token_cost) / (count(*) * 145)::DOUBLE, 6) AS savings_rate FROM costs GROUP BY level")
def _(spark, sf):
    return rounded(routing.plan_summary(routing.routed(features(spark, sf))))


@query("rt5_action_distribution", f"WITH {PLANS} SELECT level, action, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY level))::DOUBLE, 6) AS share FROM plans GROUP BY level, action")
def _(spark, sf):
    return rounded(routing.action_distribution(routing.routed(features(spark, sf))))


def _route_sql(changed: str = "", to: str = "") -> str:
    """The action at the last level in SQL, with one feature changed."""
    f = {name: f"({to})" if name == changed else name for name in ("kind", "looks_opaque", "ambiguity", "has_description", "quality_band", "degree_percentile")}
    l3 = "CASE WHEN {kind} = 'relation' THEN 'relation_description' WHEN {looks_opaque} OR {ambiguity} > 3 THEN 'typed_neighbours' WHEN {has_description} AND {quality_band} = 'rich' THEN 'none' ELSE 'description_only' END".format(**f)
    return f"CASE WHEN ({l3}) = 'none' AND {f['degree_percentile']} < 0.1 THEN 'typed_neighbours' WHEN ({l3}) = 'description_only' AND {f['degree_percentile']} > 0.9 AND {f['has_description']} THEN 'none' ELSE ({l3}) END"


CITED = "CASE WHEN kind = 'relation' THEN ['kind'] WHEN looks_opaque THEN ['kind', 'looks_opaque'] WHEN ambiguity > 3 THEN ['kind', 'ambiguity'] WHEN has_description AND quality_band = 'rich' THEN CASE WHEN degree_percentile < 0.1 THEN ['kind', 'has_description', 'quality_band', 'degree_percentile'] ELSE ['kind', 'has_description', 'quality_band'] END WHEN degree_percentile > 0.9 AND has_description THEN ['kind', 'has_description', 'degree_percentile'] ELSE ['kind', 'quality_band'] END"
CHANGES = {"kind": "CASE WHEN kind = 'entity' THEN 'relation' ELSE 'entity' END", "looks_opaque": "NOT looks_opaque", "ambiguity": "CASE WHEN ambiguity > 3 THEN 1 ELSE 10 END", "has_description": "NOT has_description", "quality_band": "CASE WHEN quality_band = 'rich' THEN 'poor' ELSE 'rich' END", "degree_percentile": "CASE WHEN degree_percentile > 0.9 THEN 0.05 ELSE 0.95 END"}
FLIPS = " + ".join(f"CAST(list_contains(cited, '{name}') AND ({_route_sql(name, to)}) <> action AS BIGINT)" for name, to in CHANGES.items())
FAITH = f"fa0 AS (SELECT *, {_route_sql()} AS action, {CITED} AS cited FROM features), fa1 AS (SELECT id, action, len(cited) AS n_cited, {FLIPS} AS n_flips FROM fa0), faith AS (SELECT *, CASE WHEN n_cited = 0 THEN 'none cited' WHEN n_flips = n_cited THEN 'faithful' WHEN n_flips > 0 THEN 'partially' ELSE 'unfaithful' END AS verdict FROM fa1)"


@query("rt7_faithfulness", f"WITH {FAITH} SELECT action, verdict, count(*) AS n FROM faith GROUP BY action, verdict")
def _(spark, sf):
    return routing.faithfulness(features(spark, sf)).groupBy("action", "verdict").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ audits


@query("se1_se11_audit", "SELECT 'duplicate_triples' AS \"check\", count(*) AS n FROM (SELECT 1 FROM train GROUP BY head, relation, tail HAVING count(*) > 1) UNION ALL SELECT 'test_in_train', count(*) FROM labelled l WHERE label = 1 AND EXISTS (SELECT 1 FROM train t WHERE t.head = l.head AND t.relation = l.relation AND t.tail = l.tail) UNION ALL SELECT 'negatives_in_train', count(*) FROM labelled l WHERE label <> 1 AND EXISTS (SELECT 1 FROM train t WHERE t.head = l.head AND t.relation = l.relation AND t.tail = l.tail) UNION ALL SELECT 'entities_without_text', count(*) FROM (SELECT head AS e FROM train UNION SELECT tail FROM train) WHERE e NOT IN (SELECT id FROM entities) UNION ALL SELECT 'test_entities_unseen', count(*) FROM (SELECT head AS e FROM labelled UNION SELECT tail FROM labelled) WHERE e NOT IN (SELECT head FROM train UNION SELECT tail FROM train) UNION ALL SELECT 'test_relations_unseen', count(*) FROM (SELECT DISTINCT relation FROM labelled WHERE relation NOT IN (SELECT relation FROM train)) UNION ALL SELECT 'self_loops', count(*) FROM train WHERE head = tail UNION ALL SELECT 'blank_texts', count(*) FROM entities WHERE trim(coalesce(text, '')) = ''")
def _(spark, sf):
    return audit.audit(base.split(spark, sf, "train"), base.labelled(spark, sf), base.entities(spark, sf))


@query("se6_label_skew", "SELECT relation, n, round(p, 6) AS positive_rate FROM (SELECT relation, count(*) AS n, avg(CAST(label = 1 AS DOUBLE)) AS p FROM labelled GROUP BY relation) WHERE n >= 30 AND abs(p - 0.5) > 0.15")
def _(spark, sf):
    return rounded(audit.label_skew(base.labelled(spark, sf)))


FLAGSHIP = ranking_by_relation
