"""Hubs, contained names, prefixes, probes, guards and subtotals against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.operators import audit, conditions, context, graph, joins, metrics, probes, reports, sampling, types

EDGE = "head string, relation string, tail string"


def hub_graph(spark, n=3000):
    rng = random.Random(7)
    rows = [("hub", "r", f"n{i}") for i in range(n // 2)] + [(f"n{i}", "s", "sink") for i in range(n // 2)]
    rows += [(f"n{rng.randrange(n)}", rng.choice("rs"), f"n{rng.randrange(n)}") for _ in range(n)]
    return rows, spark.createDataFrame(rows, EDGE).cache()


def test_two_hop_paths_through_hubs(spark):
    rows, edges = hub_graph(spark)
    rng = random.Random(8)
    q = [("hub", "sink"), ("hub", "sink"), ("hub", "hub"), ("n1", "sink"), ("hub", "n5"), ("none", "sink"), ("hub", "none")] + [(f"n{rng.randrange(3000)}", f"n{rng.randrange(3000)}") for _ in range(200)]
    queries = spark.createDataFrame([(str(i), *x) for i, x in enumerate(q)], "qid string, head string, tail string")
    out = {}
    for h, _, t in rows:
        out.setdefault(h, []).append(t)
    want = {str(i): sum(sum(x == t for x in out.get(m, ())) for m in out.get(h, ())) for i, (h, t) in enumerate(q)}
    got = {r["qid"]: r["n_paths"] for r in graph.two_hop_counts(edges, queries).collect()}
    assert got == want and want["0"] >= 1500


def test_a_hub_is_spread(spark):
    """No key of the join holds much more than the mean, although one node has half of the edges."""
    _, edges = hub_graph(spark, 20_000)
    near = edges.select("head", F.col("tail").alias("mid"))
    heavy = joins.heavy_keys(near, "head", near.count())
    assert [r["head"] for r in heavy.collect()] == ["hub"]
    many = spark.createDataFrame([("hub", i) for i in range(3)] + [("n1", 9)], "head string, q int")
    j = joins.spread_join(many, near, "head", heavy, "mid")
    assert j.count() == 3 * near.filter("head = 'hub'").count() + near.filter("head = 'n1'").count()
    salts = near.filter("head = 'hub'").groupBy(F.pmod(F.xxhash64("mid"), F.lit(joins.SALTS))).count().select("count").collect()
    assert len(salts) == joins.SALTS and max(r[0] for r in salts) < 2 * sum(r[0] for r in salts) / len(salts)


def test_safe_paths_through_hubs(spark):
    rows, edges = hub_graph(spark, 400)
    queries = spark.createDataFrame([("1", "hub", "asked", "sink"), ("2", "hub", "r", "sink"), ("3", "n3", "asked", "n4")], "qid string, head string, relation string, tail string")
    none = spark.createDataFrame([], "relation string, inverse string")
    names = spark.createDataFrame([("hub", "the hub")], "id string, text string")
    got = {r["qid"]: r["paths"] for r in graph.safe_paths(edges, queries, none, names).collect()}
    assert len(got["1"].split("; ")) == 3 and all(p.startswith("the hub ") and p.endswith(" sink") for p in got["1"].split("; "))
    assert all(" r " not in f" {p} " for p in got["2"].split("; ") if p)
    inverse = spark.createDataFrame([("asked", "r"), ("asked", "s")], "relation string, inverse string")
    assert {r["qid"]: r["paths"] for r in graph.safe_paths(edges, queries, inverse, names).collect()}["1"] == ""


def test_frontier_limit(spark):
    edges = spark.createDataFrame([("s", "r", f"a{i}") for i in range(6)] + [(f"a{i}", "r", f"b{i}") for i in range(6)], EDGE)
    seeds = spark.createDataFrame([("s",)], "entity string")
    reached = lambda **k: Counter(r["hop"] for r in graph.k_hop(edges, seeds, 2, 50, **k).collect())
    assert reached() == {0: 1, 1: 6, 2: 6} and reached(frontier=2) == {0: 1, 1: 6, 2: 2}


def test_contained_names(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abc-") for _ in range(k))
    names = [word(rng.randint(1, 12)) for _ in range(800)] + ["", None, "日本", "abcabcabc"]
    texts = [word(rng.randint(0, 40)) for _ in range(800)] + ["xx日本xx", "", None, "abcabcabcabc", "ab"]
    got = {tuple(r) for r in joins.contained(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {(n, t) for n in names if n for t in texts if t is not None and n in t}
    plan = joins.contained(spark.createDataFrame([("ab",)], "name string"), spark.createDataFrame([("xab",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joins.contained(spark.createDataFrame([], "name string"), spark.createDataFrame([("x",)], "text string")).count() == 0


def test_longest_prefix_of_most_ids_is_not_one_key(spark, monkeypatch):
    """Short prefixes that most ids start with are met by broadcast; the same results when only some are, or none."""
    ids = [f"k:{i}" for i in range(300)] + ["", "z"]
    table = [("", "all"), ("k:", "k"), ("k:1", "one"), ("k:1", "a"), *((f"k:{i}", f"own{i}") for i in range(10, 60))]
    df, pf = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(table, "prefix string, value string")
    want = {i: max((p for p, _ in table if i.startswith(p)), key=len) for i in ids}
    for most in (joins.BROADCAST_PREFIXES, 2, 0):
        monkeypatch.setattr(joins, "BROADCAST_PREFIXES", most)
        out = joins.longest_prefix(df, pf)
        if most > 2:
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert "strategy=broadcast" in plan
        got = {r["id"]: (r["prefix"], r["value"]) for r in out.collect()}
        assert {i: p for i, (p, _) in got.items()} == want and all(v == min(x for q, x in table if q == p) for p, v in got.values())


def test_longest_prefix(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("ab") for _ in range(k))
    table = [(word(rng.randint(1, 7)), f"v{i}") for i in range(60)] + [("é", "accent"), ("", "all")]
    ids = [word(rng.randint(0, 9)) for _ in range(300)] + ["éa", "zz", ""]
    for rows in (table, table[:-1]):
        best = {}
        for p, v in rows:
            best[p] = min(v, best.get(p, v))
        want = {i: max(((len(p), p, v) for p, v in best.items() if i.startswith(p)), default=None) for i in set(ids)}
        got = {r["id"]: (r["prefix"], r["value"]) for r in joins.longest_prefix(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(rows, "prefix string, value string")).collect()}
        assert got == {i: x[1:] for i, x in want.items() if x}
    assert joins.longest_prefix(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "prefix string, value string")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, vector array<double>")


def test_sliced_information(spark):
    rng = np.random.default_rng(5)
    apart = [(i, i % 2, [100.0 * (i % 2) + float(x) for x in rng.normal(size=4)]) for i in range(1200)]
    r = probes.sliced_information(vectors(spark, apart), 12, 10).first()
    assert abs(r["smi"] - math.log(2)) < 0.03 and (r["n"], r["directions"]) == (1200, 12)
    shuffled = [(i, int(rng.integers(2)), v) for i, _, v in apart]
    low = probes.sliced_information(vectors(spark, shuffled).repartition(5), 12, 10).first()
    assert low["smi"] < 0.02 and low["p95"] >= low["smi"]
    again = probes.sliced_information(vectors(spark, apart).repartition(7), 12, 10).first()
    assert math.isclose(again["smi"], r["smi"], rel_tol=1e-9)


def test_logistic_probe_is_newton(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 64))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=500) > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(500)], "id long, vector array<double>, y double").repartition(6)
    a, b = np.column_stack([x, np.ones(500)]), np.zeros(65)
    hold = np.r_[np.ones(64), 1e-9]
    for _ in range(8):
        p = 1 / (1 + np.exp(-a @ b))
        b = b + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold), a.T @ (y - p) - hold * b)
    w = probes.logistic(df)
    assert np.allclose(w, b, atol=1e-9) and w[0] > 1
    got = [r[0] for r in df.orderBy("id").select(probes.logistic_score(F.col("vector"), w)).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-a @ b))) and probes.logistic(df.limit(0)) == [0.0]


def test_context_without_inverses_never_leaks(spark):
    edges = spark.createDataFrame([("h", "r", "x"), ("g", "back", "h"), ("h", "s", "y"), ("h", "t", "g"), ("h", "back", "z")], EDGE)
    q = spark.createDataFrame([("1", "h", "r", "g")], "qid string, head string, relation string, tail string")
    inverses = spark.createDataFrame([("r", "back")], "relation string, inverse string")
    near = context.neighbours(edges, q, 3, inverses)
    assert [(r["via"], r["other"]) for r in near.orderBy("place").collect()] == [("r", "x"), ("s", "y")]
    fires = lambda df: context.neighbour_text(df).select(context.leaking(F.col("text"), F.lit("g"))).first()[0]
    assert not fires(near) and fires(context.neighbours(edges, q, 3))  # the guard notices what is not guarded


def test_gates_fire(spark):
    rows = [("a", "r", f"t{i}", 1 if i < 45 else -1) for i in range(50)] + [("a", "even", f"t{i}", 1 if i % 2 else -1) for i in range(50)] + [("a", "few", "t1", 1)]
    skew = audit.label_skew(spark.createDataFrame(rows, EDGE + ", label int")).collect()
    assert [(r["relation"], r["n"], r["positive_rate"]) for r in skew] == [("r", 50, 0.9)]
    floors = spark.createDataFrame([("r", "MODAL", 0.7, False), ("r", "RANGE", 0.9, True), ("s", "MODAL", 0.5, False)], "relation string, rule string, accuracy double, vacuous boolean")
    got = sorted(tuple(r) for r in conditions.blocked(floors).collect())
    assert got == [(c, "r", "MODAL", 0.7) for c in sorted(conditions.CONDITIONS) if conditions.CONDITIONS[c].tags]


def test_tag_leak_by_relation(spark):
    train = spark.createDataFrame([("a", "r", "x1"), ("a", "s", "y1")], EDGE)
    labelled = spark.createDataFrame([("a", "r", "x2", 1), ("a", "r", "y2", -1), ("a", "s", "y2", 1), ("a", "s", "y1", -1)], EDGE + ", label int")
    kinds = spark.createDataFrame([(i, i[0]) for i in ("x1", "x2", "y1", "y2")], "entity string, type string")
    got = {(r["relation"], r["rule"]): r["accuracy"] for r in types.tag_leak(train, labelled, kinds, "relation").collect()}
    assert got == {("r", "MODAL"): 1.0, ("r", "RANGE"): 0.5, ("s", "MODAL"): 0.5, ("s", "RANGE"): 0.0}


def test_looks_binary_reads_whole_answers(spark):
    rows = [("long", f"Yes, number {i}") for i in range(20)] + [("short", x) for x in ("Yes", " Yes ", "No", "No.") * 5]
    got = {r["k"]: (r["n_distinct"], r["looks_binary"]) for r in reports.looks_binary(spark.createDataFrame(rows, "k string, a string"), "a", "k").collect()}
    assert got == {"long": (20, False), "short": (3, True)}


def test_condition_rows_are_aligned_by_row(spark):
    rows = [("A", i, f"p{i}") for i in range(6)] + [("B", i, f"p{i}" if i < 4 else "q") for i in range(6)] + [("C", i + 3, "z") for i in range(6)]
    got = {(r["a"], r["b"]): (r["aligned"], r["n_both"], r["n_same_prompt"]) for r in conditions.aligned(spark.createDataFrame(rows, "condition string, id long, prompt string")).collect()}
    assert got == {("A", "B"): (True, 6, 4), ("A", "C"): (False, 3, 0), ("B", "C"): (False, 3, 0)}


def test_pairs_need_coverage(spark):
    a = spark.createDataFrame([("x", i) for i in range(100)] + [("y", i) for i in range(10)], "k string, q int")
    got = {r["k"]: (r["n_both"], r["coverage"], r["paired"]) for r in reports.pair_coverage(a, a.filter("k = 'y' OR q < 89"), "q", "k").collect()}
    assert got == {"x": (89, 0.89, False), "y": (10, 1.0, True)}


def test_subtotals(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["both", "one", None]), rng.choice("rs"), rng.random(), rng.randint(0, 1)) for _ in range(400)]
    got = {(r["bucket"], r["relation"], r["level"]): r["n"] for r in metrics.subtotals(spark.createDataFrame(rows, "bucket string, relation string, conf double, correct int"), "bucket", "relation").collect()}
    want = Counter(k for b, r, _, _ in rows for k in ((b, r, 0), (b, "all", 1), ("all", r, 2), ("all", "all", 3)))
    assert got == want
    df = spark.createDataFrame([r for r in rows if r[0]], "bucket string, relation string, conf double, correct int")
    whole = metrics.calibration_error(df, "conf", "correct").first()
    r = {x["bucket"]: x for x in metrics.calibration_subtotals(df, "conf", "correct", "bucket", 20).collect()}
    assert set(r) == {"both", "one", "all"} and all(math.isclose(r["all"][c], whole[c]) for c in ("ece", "mce", "brier"))


def test_confusion_summary(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] * 2 + [("b", "a")] * 2 + [("c", "b")] + [("b", "b")]
    r = reports.confusion_summary(spark.createDataFrame(rows, "g string, p string"), "g", "p").first()
    assert (r["top_gold"], r["top_pred"], r["top_n"], r["n_observed"]) == ("a", "b", 2, 3) and math.isclose(r["micro_f1"], 4 / 9) and math.isclose(r["accuracy"], 4 / 9)


@pytest.mark.parametrize(("ppl", "reading"), [(10.5, "preserved"), (12.5, "degraded"), (12.6, "substantial forgetting")])
def test_forgetting_bands(spark, ppl, reading):
    df = spark.createDataFrame([("base", 10.0), ("m", ppl)], "method string, perplexity double")
    assert reports.forgetting(df, "base").first()["reading"] == reading


def test_relation_candidates(spark):
    q = spark.createDataFrame([("1", "r3"), ("2", "r0")], "qid string, relation string")
    rel = spark.createDataFrame([(f"r{i}",) for i in range(6)], "relation string")
    every = sampling.relation_candidates(q, rel, 6)
    assert every.count() == 12
    few = {}
    for r in sampling.relation_candidates(q, rel, 3).collect():
        few.setdefault(r["qid"], []).append(r["candidate"])
    assert all(len(set(v)) == 3 for v in few.values()) and "r3" in few["1"] and "r0" in few["2"]
    with pytest.raises(ValueError, match="1,000"):
        sampling.relation_candidates(q, spark.range(1001).select(F.col("id").cast("string").alias("relation")), 3)


def test_many_typed_negatives(spark):
    known = spark.createDataFrame([(f"h{i}", "r", f"t{i % 7}") for i in range(40)] + [("h", "one", "t")], EDGE)
    got = sampling.typed_negatives(known, known, many=6).collect()
    assert len(got) == 6 * 41 and all(r["neg_tail"] != r["tail"] for r in got if r["relation"] == "r") and all(r["neg_tail"] is None for r in got if r["relation"] == "one")
    assert len({r["neg_tail"] for r in got if r["head"] == "h1"}) > 1


def test_pools_by_salt(spark, monkeypatch):
    known = spark.createDataFrame([(f"h{i}", "r", f"t{i % 7}") for i in range(40)], EDGE)
    want = sorted(map(tuple, sampling.typed_negatives(known, known).collect()))
    monkeypatch.setattr(sampling, "BROADCAST_POOL", 0)
    assert sorted(map(tuple, sampling.typed_negatives(known, known).collect())) == want


def test_features_from_one_count_of_the_edges(spark):
    from graphlens.operators import routing, types

    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c"), ("a", "s", "b"), ("b", "s", "c")], "head string, relation string, tail string")
    s = types.signatures(edges)
    assert {r["entity"]: (r["degree"], [(-x["m"], x["sig"]) for x in r["sigs"]]) for r in s.collect()} == {"a": (3, [(2, "r::out"), (1, "s::out")]), "b": (3, [(1, "r::in"), (1, "s::in"), (1, "s::out")]), "c": (2, [(1, "r::in"), (1, "s::in")])}
    assert {tuple(r) for r in types.types_of(s, 64, 2).collect()} == {("a", "OTHER"), ("b", "r::in"), ("c", "r::in")}
    ents = spark.createDataFrame([("a", "Aa, x"), ("z", None)], "id string, text string")
    want, got = routing.element_features(ents, types.types_of(s), edges), routing.element_features(ents, types.types_of(s), edges, s.select("entity", "degree"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_tail_pool_numbers_tails_alone(spark):
    known = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c"), ("b", "s", "c"), ("c", "r", "d")], "head string, relation string, tail string")
    want = sampling.side_index(known).filter("side = 'tail'").select("relation", "idx", "entity")
    pool = sampling.tail_pool(known)
    assert sorted(map(tuple, pool.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, sampling.typed_negatives(known, known, pool=pool).collect())) == sorted(map(tuple, sampling.typed_negatives(known, known).collect()))


def test_condition_rows_are_made_once(spark):
    rows = spark.range(6).selectExpr("if(id % 2 = 0, 'A', 'B') AS condition", "id div 2 AS id", "if(id < 4, 'x', concat('p', id)) AS prompt")
    out = conditions.aligned(rows)
    assert [tuple(r) for r in out.collect()] == [("A", "B", 3, 3, True, 3, 2)]
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()  # all from one table by id


def test_audits_count_in_one_pass_over_triples_and_ends(spark):
    """Leaks of an inductive split and of a test, each counted with its copies; a triple with a null is no leak."""
    from graphlens.operators import audit

    rows = [("a", "r", "b", "train"), ("b", "r", "c", "train"), ("a", "r", "c", "query"), ("x", "s", "b", "query"), ("x", "s", "b", "query"), ("x", "r", "y", "query"), ("b", "r", "z", "support")]
    got = {r["check"]: r["n"] for r in audit.inductive_checks(spark.createDataFrame(rows, "head string, relation string, tail string, part string")).collect()}
    assert got == {"query_heads_seen": 1, "query_tails_orphan": 1, "relations_unknown": 1, "fully_seen": 1, "duplicates": 1}
    train = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), (None, "r", "b")], "head string, relation string, tail string")
    test = spark.createDataFrame([("a", "r", "b", 1), ("a", "r", "b", 1), ("a", "r", "b", -1), (None, "r", "b", 1), ("q", "r", "b", None)], "head string, relation string, tail string, label int")
    out = audit.audit(train, test, spark.createDataFrame([("a", "A")], "id string, text string"))
    assert {r["check"]: r["n"] for r in out.collect()} == {"duplicate_triples": 1, "test_in_train": 2, "negatives_in_train": 1, "entities_without_text": 2, "test_entities_unseen": 2, "test_relations_unseen": 0, "self_loops": 0, "blank_texts": 0}
