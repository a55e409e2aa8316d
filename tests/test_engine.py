"""Operators of the engine: known values, properties, files on disk, and planted defects."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphlens.functions import text as tx
from graphlens.functions.hashing import det_index, det_key
from graphlens.functions.ordering import with_dense_index, with_dense_offsets
from graphlens.operators import abstention, audit, budget, conditions, context, graph, joins, metrics, prompts, ranking, reports, routing, sampling, stats, types
from graphlens.sources import kg
from graphlens.streaming import scores


def one(df):
    return df.collect()[0].asDict()


# ------------------------------------------------------------------ files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "entity2text.txt").write_text("a\tAnna, a person\nb\tBo\nshort\na\tAnna again\n")
    (tmp_path / "relation2text.txt").write_text("r\tknows\n")
    (tmp_path / "train.tsv").write_text("a\tr\tb\nb\tr\n  b\tr\ta  \n")
    (tmp_path / "test.tsv").write_text("a\tr\ta\t1\nb\tr\tb\t-1\na\tr\tb\tx\n")
    return str(tmp_path)


def test_load_graph(spark, folder):
    g = kg.load_graph(spark, folder)
    assert {r["id"]: r["text"] for r in g.entities.collect()} == {"a": "Anna again", "b": "Bo"}
    assert g.split("train").count() == 2 and g.split("valid").count() == 0
    assert sorted((r["head"], r["tail"], r["label"]) for r in g.split("test").collect()) == [("a", "a", 1), ("a", "b", None), ("b", "b", -1)]
    assert g.all_true().count() == 4
    assert {r["part"]: r["n"] for r in g.describe().collect()} == {"train": 2, "test": 3, "entities": 2, "relations": 1}


def test_load_graph_without_a_file(spark, folder, tmp_path):
    (tmp_path / "train.tsv").unlink()
    with pytest.raises(FileNotFoundError, match="train.tsv"):
        kg.load_graph(spark, folder)


def test_scan_problems_and_delimiter(spark, folder):
    assert {r["problem"]: r["n"] for r in kg.scan_problems(spark, f"{folder}/test.tsv", has_label=True).collect()} == {"short": 0, "repeated_key": 0, "bad_label": 1}
    assert {r["problem"]: r["n"] for r in kg.scan_problems(spark, f"{folder}/entity2text.txt", columns=2).collect()} == {"short": 1, "repeated_key": 1, "bad_label": 0}
    assert kg.sniff_delimiter(spark, f"{folder}/train.tsv") == "\t"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "b", 1), ("b", "r", None, -1)], "head string, relation string, tail string, label int")
    kg.write_tsv(df.coalesce(1), str(tmp_path / "t"), "head", "relation", "tail", "label")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a\tr\tb\t1", "b\tr\t\t-1"]
    kg.write_results(df, str(tmp_path / "j"), {"seed": "1"})
    back = kg.read_results(spark, str(tmp_path / "j")).collect()
    assert len(back) == 2 and back[0]["config"]["seed"] == "1" and back[0]["file"].endswith(".json")


def test_ranking_blocks(spark):
    rows = [(i, "h", "r", f"t{i}") for i in range(4)] + [(4 + i, f"h{i}", "r", "t") for i in range(4)]
    got = kg.scan_rankings(spark.createDataFrame(rows, "pos long, head string, relation string, tail string"), 4).orderBy("block").collect()
    assert [(r["n_rows"], r["slot"]) for r in got] == [(4, "tail"), (4, "head")]


# ------------------------------------------------------------------ functions


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = with_dense_index(df, "x").collect()
    assert all(r["x"] == r["idx"] for r in got) and len(got) == 1000
    assert with_dense_index(df.limit(0), "x").count() == 0


def test_hash_choice(spark):
    r = one(spark.range(1).select(det_key("s", F.lit("a")).alias("k"), det_index(F.lit(0), "s", F.lit("a")).alias("none"), det_index(F.lit(7), "s", F.lit("a")).alias("i")))
    import hashlib

    assert r["k"] == hashlib.sha256(b"s|a").hexdigest() and r["none"] is None and r["i"] == int(r["k"][:15], 16) % 7


def test_parsers(spark):
    rows = ["Yes, this is true.", "No, this is not true.", "I know it well.", "I cannot verify that.", "I don't know", "Another one", "", "yes.", " Yes and No"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    a = F.col("t")
    got = {r["i"]: r for r in df.select("i", tx.strict_verdict(a).alias("s"), tx.lenient_verdict(a).alias("l"), tx.category(a).alias("c"), tx.clean_verdict(a).alias("v")).collect()}
    assert [got[i]["s"] for i in range(9)] == [1, 0, None, None, None, None, None, None, 1]
    assert [got[i]["l"] for i in range(9)] == [1, 0, 0, 0, 0, 0, None, None, 1]
    assert [got[i]["c"] for i in range(9)] == ["answered_yes", "answered_no", "spurious_substring", "refusal_scored_as_no", "refusal_scored_as_no", "spurious_substring", "unparseable", "unparseable", "answered_yes"]
    assert [got[i]["v"] for i in range(9)] == [1, 0, None, None, None, None, None, 1, 0]


def test_name_functions(spark):
    r = one(spark.createDataFrame([("dog_NN_2", "/people/person/born", "  A  b . ", "/m/0f8l9c")], "a string, b string, c string, d string").select(tx.pos_suffix(F.col("a")).alias("pos"), tx.path_parts(F.col("b")).alias("path"), tx.normalise(F.col("c")).alias("norm"), tx.looks_opaque(F.col("d")).alias("opaque"), tx.truncate_words(F.col("c"), F.lit(1)).alias("cut")))
    assert r["pos"] == "NN" and (r["path"]["domain"], r["path"]["property"]) == ("people", "born") and r["norm"] == "a b " and r["opaque"] and r["cut"] == "A"


# ------------------------------------------------------------------ ranking and metrics


def test_ranking_metrics(spark):
    r = one(ranking.ranking_metrics(spark.createDataFrame([(1,), (2,), (10,), (50,)], "rank int")))
    assert math.isclose(r["mrr"], (1 + 0.5 + 0.1 + 0.02) / 4) and (r["hits_1"], r["hits_3"], r["hits_10"], r["mr"]) == (0.25, 0.5, 0.75, 15.75)


def test_gold_rank_breaks_ties_by_candidate(spark):
    c = spark.createDataFrame([("q", "r", "b", 1, 0.5), ("q", "r", "a", 0, 0.5), ("q", "r", "c", 0, 0.5), ("q", "r", "d", 0, 0.9)], "qid string, relation string, candidate string, is_gold int, score double")
    assert one(ranking.gold_ranks(c))["rank"] == 3
    assert one(ranking.top_and_margin(c)) == {"qid": "q", "top": "d|a|b|c", "margin": pytest.approx(0.4)}


SCORED = "label int, p_yes double"


def test_confusion_and_null_or_zero(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (-1, 0.7), (-1, 0.1), (-1, 0.2), (1, 0.3)], SCORED)
    r = one(metrics.confusion(df))
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 2, 1) and math.isclose(r["balanced_accuracy"], 2 / 3)
    none = df.filter("label = 1 AND p_yes < 0.5")
    assert one(metrics.confusion(none))["precision"] == 0.0 and one(metrics.confusion(none, empty=None))["precision"] is None


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.30000000000000004, 0.3, 1.0)], "c double")
    assert [r[0] for r in df.select(metrics.bin_of(F.col("c"))).collect()] == [0, 0, 2, 2, 9]


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (-1, 0.5), (-1, 0.1)], SCORED)
    assert one(metrics.auc(df))["auc"] == 0.875
    assert one(metrics.auc(df.filter("label = 1")))["auc"] is None


def test_fit_diagnosis(spark):
    rows = [("over", s, v) for s, v in enumerate((1.0, 0.6, 0.5, 0.8))] + [("good", s, v) for s, v in enumerate((1.0, 0.7, 0.5))] + [("under", s, v) for s, v in enumerate((1.0, 0.99, 0.98))]
    got = {r["run"]: (r["verdict"], r["best_step"]) for r in metrics.fit_diagnosis(spark.createDataFrame(rows, "run string, step int, loss double")).collect()}
    assert got == {"over": ("overfit", 2), "good": ("good", 2), "under": ("underfit", 2)}


def test_isotonic(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "conf double, y int")
    assert [(r["conf"], r["fit"]) for r in stats.isotonic(df, "conf", "y").orderBy("conf").collect()] == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0)]


def test_mcnemar_exact(spark):
    df = spark.createDataFrame([(1, 0)] * 9 + [(0, 1)] * 2 + [(1, 1)] * 5, "a int, b int")
    r = one(stats.mcnemar(df))
    want = 2 * sum(math.comb(11, k) for k in range(3)) / 2**11
    assert (r["n10"], r["n01"]) == (9, 2) and math.isclose(r["p_exact"], want) and math.isclose(r["chi2"], 36 / 11)
    assert one(stats.mcnemar(df.filter("a = b")))["p_exact"] == 1.0


def test_bootstrap_interval(spark):
    rows = [("x", float(i % 4 == 0), 0.0) for i in range(400)] + [("same", 1.0, 1.0)] * 50
    got = {r["arm"]: r for r in stats.verdict(stats.paired_bootstrap(spark.createDataFrame(rows, "arm string, a double, b double"), "arm", 500)).collect()}
    assert got["x"]["verdict"] == "better" and got["x"]["better"] == 100 and got["x"]["lo"] < 0.25 < got["x"]["hi"]
    assert got["same"]["verdict"] == "indistinguishable" and got["same"]["tied"] == 50


def test_risk_coverage_of_a_perfect_order(spark):
    df = spark.createDataFrame([(str(i), 1 - i / 10, int(i < 5)) for i in range(10)], "id string, conf double, correct int")
    curve = abstention.risk_coverage(df, None)
    rows = curve.orderBy("k").collect()
    assert [r["risk"] for r in rows[:5]] == [0.0] * 5 and math.isclose(rows[-1]["risk"], 0.5)
    assert one(abstention.coverage_at_precision(curve, [0.99]))["coverage"] == 0.5
    assert one(abstention.at_threshold(df, 0.55))["selective_accuracy"] == 1.0


def test_response_breakdown_keeps_empty_categories(spark):
    got = metrics.response_breakdown(spark.createDataFrame([("Yes",)], "t string"), "t").collect()
    assert {r["category"]: r["n"] for r in got} == {"answered_yes": 1, "answered_no": 0, "refusal_scored_as_no": 0, "spurious_substring": 0, "unparseable": 0}


# ------------------------------------------------------------------ graph, samples, types


def toy(spark, n=60):
    rows = [(f"p:{i}", "knows", f"p:{(i * 7 + 1) % n}") for i in range(n)] + [(f"p:{i}", "livesIn", f"c:{i % 5}") for i in range(n)]
    rows += [(t, "knownBy", h) for h, r, t in rows if r == "knows"]
    return spark.createDataFrame(rows, "head string, relation string, tail string")


def test_inverse_relations_need_support(spark):
    t = toy(spark)
    assert graph.inverse_relations(t).count() == 0  # fewer than 100 edges each
    got = {(r["relation"], r["inverse"]) for r in graph.inverse_relations(t, min_support=50).collect()}
    assert {("knows", "knownBy"), ("knownBy", "knows")} <= got and ("livesIn", "knows") not in got


def test_guard_blocks_planted_leaks_and_leaves_others(spark):
    t = toy(spark)
    q = t.filter("relation = 'knows'").withColumn("qid", F.concat_ws("|", "head", "tail"))
    inv = graph.inverse_relations(t, min_support=50)
    open_ = graph.guarded_neighbours(t, q, inv.limit(0), 10)
    shut = graph.guarded_neighbours(t, q, inv, 10)
    leaks = lambda df: df.join(q, "qid").filter(F.array_contains(F.split("neighbours", r"\|"), F.col("tail"))).count()
    assert leaks(open_) > 0 and leaks(shut) == 0 and shut.count() > 0


def test_permutation_is_a_derangement(spark):
    e = spark.createDataFrame([(str(i), f"name {i}") for i in range(57)], "id string, text string")
    got = {r["id"]: r["text"] for r in sampling.permute(e).collect()}
    assert sorted(got.values()) == sorted(f"name {i}" for i in range(57)) and all(got[str(i)] != f"name {i}" for i in range(57))


def test_stratified_sample_has_a_floor(spark):
    t = toy(spark)
    got = {r["relation"]: r["count"] for r in sampling.stratified_sample(t, 40, 8).groupBy("relation").count().collect()}
    assert sum(got.values()) == 40 and min(got.values()) >= 8 and len(got) == 3
    assert sampling.stratified_sample(t, 10, 8).count() == 10


def test_safe_neighbours(spark):
    edges = [("h", "ask", "a"), ("b", "ask", "h"), ("h", "other", "t"), ("h", "loop", "h"), ("h", "r1", "c"), ("h", "r2", "c"), ("h", "r1", "d"), ("e", "inv", "h"), ("h", "r3", "f")]
    t = spark.createDataFrame(edges, "head string, relation string, tail string")
    q = spark.createDataFrame([("1", "h", "ask", "t")], "qid string, head string, relation string, tail string")
    inv = spark.createDataFrame([("ask", "inv")], "relation string, inverse string")
    names = spark.createDataFrame([("c", "Same"), ("d", "Same")], "id string, text string")
    got = graph.safe_neighbours(t, q, inv, names, 2).first()["neighbours"]
    assert sorted(got.split("|")) == ["Same", "f"]


def test_safe_paths(spark):
    edges = [("h", "r1", "hub"), ("t", "r2", "hub"), ("h", "ask", "m"), ("m", "r3", "t"), ("h", "inv", "n"), ("n", "r3", "t"), *[("hub", "r4", f"x{i}") for i in range(50)]]
    t = spark.createDataFrame(edges, "head string, relation string, tail string")
    q = spark.createDataFrame([("1", "h", "ask", "t"), ("2", "h", "ask", "none")], "qid string, head string, relation string, tail string")
    inv = spark.createDataFrame([("ask", "inv")], "relation string, inverse string")
    names = spark.createDataFrame([("hub", "The Hub")], "id string, text string")
    got = {r["qid"]: r["paths"] for r in graph.safe_paths(t, q, inv, names).collect()}
    assert got == {"1": "h r1 The Hub r2 t", "2": ""}


def test_whole_negatives(spark):
    full = [(h, "full", t) for h in "ab" for t in "xy"]  # all pairs known: no negative
    t = spark.createDataFrame([*full, ("a", "one", "z")], "head string, relation string, tail string")
    got = {(r["head"], r["relation"], r["tail"]): r for r in sampling.whole_test_negatives(t, t, t, sampling.entity_index(t)).collect()}
    assert len(got) == 5
    assert all(got[x]["skipped"] == 1 and got[x]["neg_head"] is None and got[x]["accidental"] == 60 for x in full)
    r = got["a", "one", "z"]
    assert r["skipped"] == 0 and (r["neg_head"], r["neg_tail"]) != ("a", "z") and r["neg_head"] != r["neg_tail"]


def test_negatives(spark):
    t = toy(spark)
    known = {tuple(r) for r in t.collect()}
    ents = sampling.entity_index(t)
    rand = sampling.random_negatives(t, ents).collect()
    assert len(rand) == t.count() and all((r["neg_head"] != r["head"]) != (r["neg_tail"] != r["tail"]) for r in rand)
    tested = sampling.test_negatives(t, t, 6).collect()
    assert tested and all((r["neg_head"], r["relation"], r["neg_tail"]) not in known and r["neg_head"] != r["neg_tail"] for r in tested)
    single = spark.createDataFrame([("a", "only", "x"), ("b", "only", "x")], "head string, relation string, tail string")
    assert all(r["neg_tail"] is None for r in sampling.typed_negatives(single, single).collect())
    typed = sampling.typed_negatives(t, t).collect()
    assert all(r["neg_tail"] != r["tail"] for r in typed if r["neg_tail"] is not None) and len(typed) == t.count()


def test_candidates_do_not_depend_on_other_queries(spark):
    t = toy(spark)
    q = t.filter("relation = 'knows'").withColumn("qid", F.concat_ws("|", "head", "tail"))
    ents = sampling.entity_index(t)
    every = {(r["qid"], r["candidate"]) for r in sampling.candidate_sets(q, t, ents, 8).collect()}
    some = {(r["qid"], r["candidate"]) for r in sampling.candidate_sets(q.limit(5), t, ents, 8).collect()}
    assert some <= every
    known = {(f"{h}|{x}", c) for h, r, x in map(tuple, q.select("head", "relation", "tail").collect()) for c in [y[2] for y in t.filter("relation = 'knows'").collect() if y[0] == h]}
    gold = {(r["qid"], r["tail"]) for r in q.collect()}
    assert gold <= every and not (every - gold) & known


def test_induced_types_and_leak(spark):
    t = toy(spark)
    ty = {r["entity"]: r["type"] for r in types.induced_types(t).collect()}
    assert ty["c:1"] == "livesIn::in" and len(ty) == 65
    labelled = t.withColumn("label", F.lit(1)).unionByName(t.select("head", "relation", F.when(F.col("relation") == "livesIn", F.col("head")).otherwise(F.lit("c:0")).alias("tail"), F.lit(-1).alias("label")))
    by_id = types.types_by_identifier(t.select(F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("text", F.lit("")))
    got = {r["rule"]: r for r in types.tag_leak(t, labelled, by_id).collect()}
    assert got["MODAL"]["verdict"] == "leak" and not got["MODAL"]["vacuous"]


# ------------------------------------------------------------------ routing, budget, audits


def test_routing_and_faithfulness(spark):
    rows = [("a", "entity", "X", False, True, 1, "rich", 0.5, 3), ("b", "entity", "OTHER", True, False, 1, "poor", 0.0, 0), ("c", "entity", "X", False, True, 9, "moderate", 0.5, 2), ("d", "entity", "X", False, True, 1, "moderate", 0.95, 2)]
    f = spark.createDataFrame(rows, "id string, kind string, semantic_type string, looks_opaque boolean, has_description boolean, ambiguity long, quality_band string, degree_percentile double, n_alpha_words int")
    got = {(r["id"], r["level"]): r["action"] for r in routing.routed(f).collect()}
    assert got["a", "L3"] == "none" and got["b", "L3"] == "typed_neighbours" and got["c", "L3"] == "typed_neighbours" and got["d", "L4"] == "none" and got["a", "L0"] == "full"
    v = {r["id"]: r for r in routing.faithfulness(f, "L3").collect()}
    assert v["a"]["verdict"] == "faithful" and routing.faithfulness(f, "L0").filter("verdict = 'none cited'").count() == 4
    saved = {r["level"]: r["savings_rate"] for r in routing.plan_summary(routing.routed(f)).collect()}
    assert saved["L0"] == 0 and saved["L3"] > 0


BLOCK = "qid string, blocks array<struct<kind:string,target:string,text:string,tokens:int,priority:double>>"


@pytest.mark.parametrize("most", [0, 1, 3, 5, 100])
def test_budget_is_never_overspent(spark, most):
    blocks = [("entity_description", "t", "one two three four", 4, 2.0), ("neighbours", "t", "a b c d e f", 6, 1.0), ("type_tag", "t", "tag", 1, 0.5), ("exclusions", "t", "never", 1, None)]
    r = one(budget.fill(spark.createDataFrame([("q", blocks)], BLOCK), F.lit(most)))
    kept = {k["kind"]: k for k in r["kept"]}
    assert r["spent"] == sum(k["tokens"] for k in r["kept"]) <= most and "exclusions" not in kept
    assert all(len(k["text"].split()) == k["tokens"] for k in r["kept"])
    if most == 3:
        assert set(kept) == {"neighbours"}  # the atomic block does not fit, the next is cut
    if most == 5:
        assert set(kept) == {"entity_description", "neighbours"}
    if most == 100:
        assert r["spent"] == 11


def test_spearman_equals_ranks_by_hand(spark):
    values = [("a", i % 7, (i * i) % 5) for i in range(60)] + [("b", i, -i) for i in range(12)] + [("few", 1, 2), ("flat", None, 1), (None, 1, 1)] + [("flat", 3, i) for i in range(11)]
    got = {r["g"]: (r["n"], r["rho"]) for r in ranking.spearman(spark.createDataFrame(values, "g string, x int, y int"), "x", "y", "g").collect()}
    xs = pd.DataFrame([v for v in values if v[0] == "a"], columns=["g", "x", "y"])
    want = xs["x"].rank().corr(xs["y"].rank())
    assert got["a"][0] == 60 and abs(got["a"][1] - want) < 1e-9
    assert got["b"] == (12, pytest.approx(-1.0)) and got["few"] == (1, None) and got["flat"] == (11, None) and None not in got


def test_markdown_lines(spark):
    t = spark.createDataFrame([("b", None), ("a", 2)], "k string, n int")
    lines = [r["line"] for r in reports.markdown(t, "k", {"Key": "k", "N": "n"}).orderBy("place").collect()]
    assert lines == ["| Key | N |", "|-|-|", "| a | 2 |", "| b |  |"] and reports.markdown(t.limit(0), "k", {"Key": "k", "N": "n"}).count() == 2


def test_validation_part_is_three_tenths(spark):
    parts = [r["part"] for r in sampling.validation_part(spark.range(11).withColumn("idx", F.lit("kept")), "id").select("part").collect()]
    assert parts.count("validation") == 3 and len(parts) == 11
    assert sampling.validation_part(spark.range(0), "id").count() == 0


TRAITED = "qid string, kind string, target string, text string, tokens int, described boolean, words int, bits double, depth int, idf double, senses long"


def test_policies_give_priorities_and_reasons(spark):
    rows = [("q", k, "t", "a b", 2, *traits) for k in budget.KINDS for traits in [(True, 3, 1.0, 3, None, 1), (False, 1, 2.5, 9, 5.0, 3), (None, None, None, None, None, None)]]
    j = budget.judged(spark.createDataFrame(rows, TRAITED)).collect()
    known = {(r["policy"], r["kind"], r["described"]): r["priority"] for r in j}
    assert [known["S0", k, True] for k in budget.KINDS] == [0, -1, -2, -3, -4, -5] and all(r["reason"] for r in j)
    assert known["S1", "neighbours", True] == 0.5 and known["S1", "entity_description", False] is None and known["S1", "exclusions", None] == 1
    assert known["S2", "type_tag", True] == 3 and known["S2", "neighbours", False] == 2.5 and known["S2", "type_tag", None] == 3
    assert known["S3", "entity_description", True] == 3 and known["S3", "entity_description", False] == 1 and known["S3", "entity_description", None] is None
    assert known["S4", "neighbours", True] == 1 and known["S4", "neighbours", False] == 4.5 and known["S4", "type_tag", None] == 0.8
    assert known["S5", "neighbours", False] == 3.5 and known["S5", "neighbours", True] == 0.5 and known["S5", "demonstrations", None] == 2 and known["S5", "type_tag", True] == 2.5
    assert all(0 <= known["R", k, True] < 1 for k in budget.KINDS)
    with pytest.raises(ValueError, match="unknown policy"):
        budget.priority("S9")
    filled = {r["policy"]: r for r in budget.allocated(spark.createDataFrame(rows[::3], TRAITED), F.lit(3)).collect()}
    assert set(filled) == set(budget.POLICIES) and all(r["spent"] <= 3 for r in filled.values())
    assert [k["kind"] for k in filled["S0"]["kept"]] == ["type_tag", "exclusions"] and budget.allocated(spark.createDataFrame([], TRAITED), F.lit(3)).count() == 0


def test_audit_finds_planted_defects(spark):
    train = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("b", "r", "b"), ("b", "s", "c")], "head string, relation string, tail string")
    test = spark.createDataFrame([("a", "r", "b", 1), ("b", "s", "c", -1), ("z", "t", "a", 1)], "head string, relation string, tail string, label int")
    ents = spark.createDataFrame([("a", "A"), ("b", " "), ("z", None)], "id string, text string")
    assert {r["check"]: r["n"] for r in audit.audit(train, test, ents).collect()} == {"duplicate_triples": 1, "test_in_train": 1, "negatives_in_train": 1, "entities_without_text": 1, "test_entities_unseen": 1, "test_relations_unseen": 1, "self_loops": 1, "blank_texts": 2}
    assert {r["head"]: r["bucket"] for r in audit.familiarity(train, test).collect()} == {"a": "both", "b": "both", "z": "one"}


def test_prompt_lengths(spark):
    df = spark.createDataFrame([(" ".join("w" * n),) for n in range(1, 101)], "t string")
    assert one(prompts.lengths(df, "t")) == {"min": 1, "median": 51, "p95": 96, "p99": 100, "max": 100}


# ------------------------------------------------------------------ streaming


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 3}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    out = scores.windowed_values(scores.event_stream(spark, str(tmp_path / "e")), late="10 hours")
    q = out.writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = df.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest")).select(F.col("window.start").alias("start"), "event_type", "n", "largest")
    assert spark.table("windowed").select("start", "event_type", "n", "largest").exceptAll(want).count() == 0 and spark.table("windowed").count() == want.count()


# ------------------------------------------------------------------ conditions, contexts, reports


def test_conditions_refuse_what_they_do_not_know():
    assert conditions.check_condition("S").names == "permuted"
    with pytest.raises(ValueError, match="unknown condition"):
        conditions.check_condition("Z")
    conditions.check_flags({"types": True, "neighbours": False}, ["types"])
    for flags, columns in (({"types": True}, []), ({"types": False}, ["types"])):
        with pytest.raises(ValueError, match="types"):
            conditions.check_flags(flags, columns)


def test_flag_audit_tells_missing_unused_and_unknown_blocks(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "", None), ("c", None, "y")], "head string, meaning string, neighbours string")
    got = {(r["variant"], r["block"]): (r["asked"], r["n"], r["n_filled"], r["n_missing"], r["n_unused"], r["status"]) for r in conditions.flag_audit(rows, ("meaning", "neighbours", "paths")).collect()}
    assert len(got) == 3 * len(conditions.VARIANTS)
    assert got["P5", "meaning"] == (True, 3, 1, 2, 0, "missing") and got["P6", "meaning"] == (False, 3, 1, 0, 1, "unused")
    assert got["P7", "paths"] == (True, 3, 0, 3, 0, "no_column") and got["P0", "paths"] == (False, 3, 0, 0, 0, "ok")
    none = conditions.flag_audit(rows.limit(0), ("meaning",)).collect()
    assert {(r["n"], r["status"]) for r in none} == {(0, "ok")}


def test_candidates_after_a_second_pass_are_as_without_one(spark):
    """Heads that know most entities need the later draws and the fill; the rows equal plain loops over all draws."""
    names = [f"e{i:02d}" for i in range(30)]
    entities = spark.createDataFrame(list(enumerate(names)), "idx long, entity string")
    facts = [("hub", "r", x) for x in names[:22]] + [("thin", "r", "e05")] + [("whole", "r", x) for x in names]
    known = spark.createDataFrame(facts, "head string, relation string, tail string")
    asked = [(f"q{i}", h, "r", "e05") for i, h in enumerate(["hub", "thin", "whole", "thin"])]
    queries = spark.createDataFrame(asked + asked[:1], "qid string, head string, relation string, tail string")
    rows = sampling.candidate_sets(queries, known, entities, 6).collect()
    number = lambda *p: int(__import__("hashlib").sha256("|".join(p).encode()).hexdigest()[:15], 16)
    want, true = set(), set(facts)
    for qid, head, relation, tail in asked:
        mine = []
        places = [number("cand", qid, str(d)) % 30 for d in range(12)] + [(number("cand-fill", qid) + s) % 30 for s in range(30)]
        for x in (names[i] for i in places):
            if x != tail and x not in mine and (head, relation, x) not in true and len(mine) < 5:
                mine.append(x)
        want |= {(qid, x, 0) for x in mine} | {(qid, tail, 1)}
    assert len(rows) == len(want) and {(r["qid"], r["candidate"], r["is_gold"]) for r in rows} == want


def test_context_leaves_the_answer_out(spark):
    edges = spark.createDataFrame([("h", "r", "g"), ("h", "r", "x"), ("g", "back", "h"), ("h", "s", "y"), *[("hub", "r", f"t{i}") for i in range(50)]], "head string, relation string, tail string")
    q = spark.createDataFrame([("1", "h", "r", "g"), ("2", "hub", "r", "t0"), ("3", "none", "r", "g")], "qid string, head string, relation string, tail string")
    near = context.neighbours(edges, q, 3).collect()
    assert [(r["via"], r["other"]) for r in sorted(near, key=lambda r: (r["qid"], r["place"])) if r["qid"] == "1"] == [("back", "g"), ("r", "x"), ("s", "y")]
    assert [r["other"] for r in sorted(near, key=lambda r: r["place"]) if r["qid"] == "2"] == ["t1", "t10", "t11"]
    leak = spark.createDataFrame([("back g; r x", "g"), ("r x", "g"), ("", "g")], "t string, gold string").select(context.leaking(F.col("t"), F.col("gold")).alias("x"))
    assert [r["x"] for r in leak.collect()] == [True, False, False]


def test_candidates_are_never_short(spark):
    """A query with nearly all entities known still gets every other there is."""
    ids = [f"e{i:02d}" for i in range(40)]
    known = spark.createDataFrame([("h", "r", i) for i in ids[:33]] + [("k", "r", ids[0])], "head string, relation string, tail string")
    q = spark.createDataFrame([("1", "h", "r", ids[0]), ("2", "k", "r", ids[0])], "qid string, head string, relation string, tail string")
    entities = spark.createDataFrame(list(enumerate(ids)), "idx long, entity string")
    got = sampling.candidate_sets(q, known, entities, 10).collect()
    assert {r["candidate"] for r in got if r["qid"] == "1"} == {ids[0], *ids[33:]}
    assert len({r["candidate"] for r in got if r["qid"] == "2"}) == 10 == sum(r["qid"] == "2" for r in got)


def test_offsets_over_range_partitions(spark):
    df = spark.createDataFrame([(i, i % 3, i % 5) for i in range(200)], "k int, a int, b int").repartition(7)
    got = {r["k"]: (r["before_a"], r["before_b"]) for r in with_dense_offsets(df, F.desc("k"), "a", "b").collect()}
    assert got == {k: (sum(i % 3 for i in range(k + 1, 200)), sum(i % 5 for i in range(k + 1, 200))) for k in range(200)}
    assert with_dense_offsets(df.limit(0), F.desc("k"), "a").count() == 0


def test_reports(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "x double")
    verdict = [r["v"] for r in df.select(reports.interval_verdict(F.col("x") - 0.5, F.col("x") + 0.5).alias("v")).collect()]
    assert verdict == ["better", "worse", "indistinguishable"]
    assert one(spark.range(1).select(reports.detectable_from_n(F.lit(400)).alias("d")))["d"] == pytest.approx(0.042)
    ranks = spark.createDataFrame([("real", 1, 2), ("permuted", 2, 2), ("anonymised", 2, 2)], "arm string, rank int, n_way int")
    assert one(reports.mrr_terms(ranks)) == pytest.approx({"real": 1.0, "permuted": 0.5, "anonymised": 0.5, "chance": 0.75, "binding": 0.5, "names": 0.0, "residual": -0.25})
    lines = spark.createDataFrame([("<id_1>\t<Anna>\trdf:type\t<wordnet_person_1>",), ("<http://x/Bo> <http://w3/ns#type> <http://schema.org/Person> .",), ("<Bo>\trdfs:label\tBo",), ("",)], "line string")
    assert [tuple(r) for r in kg.type_lines(lines).collect()] == [("Anna", "wordnet_person_1"), ("Bo", "Person")]


# ------------------------------------------------------------------ work that grows no faster than the input


def test_stratified_sample_limits_before_the_shuffle(spark):
    rows = [(f"h{i % 40}", "many" if i % 50 else "few", f"t{i % 7}") for i in range(900)]  # with copies
    df = spark.createDataFrame(rows, "head string, relation string, tail string")
    got = sampling.stratified_sample(df, 300, 60)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    h = sorted((hashlib.sha256("|".join(("strat", *r)).encode()).hexdigest(), r) for r in rows)
    floor = [x for rel in ("many", "few") for x in [y for y in h if y[1][1] == rel][:60]]
    rest = h.copy()
    for x in floor:
        rest.remove(x)
    want = sorted(x[1] for x in (sorted(floor) + rest)[:300])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_whole_test_negatives_try_again_only_where_needed(spark, monkeypatch):
    t = spark.createDataFrame([(f"h{i}", "r", f"t{i % 90}") for i in range(300)], "head string, relation string, tail string")
    made, real = [], sampling.fetch

    def counted(rows, *args):
        made.append(rows.count())
        return real(rows, *args)

    monkeypatch.setattr(sampling, "fetch", counted)
    got = sorted(map(tuple, sampling.whole_test_negatives(t, t, t, sampling.entity_index(t)).collect()), key=str)
    assert sum(made) < 5 * 300  # 60 tries of each before
    monkeypatch.setattr(sampling, "FIRST_TRIES", ())
    assert got == sorted(map(tuple, sampling.whole_test_negatives(t, t, t, sampling.entity_index(t)).collect()), key=str) and len(got) == 300


def test_k_hop_orders_neighbours_of_its_front_only(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i}", "r", f"n{i + 1}") for i in range(500)], "head string, relation string, tail string")
    made, real = [], graph.first_per_group

    def counted(df, *args):
        made.append(df.count())
        return real(df, *args)

    monkeypatch.setattr(graph, "first_per_group", counted)
    got = {(r["entity"], r["hop"]) for r in graph.k_hop(edges, spark.createDataFrame([("n5",)], "entity string"), 2, 9).collect()}
    assert got == {("n5", 0), ("n4", 1), ("n6", 1), ("n3", 2), ("n7", 2)} and sum(made) < 20  # 1,000 before


def test_candidates_travel_as_hashes_and_lists(spark):
    """Known triples are found by hashes and compared in full, nulls never match, and a query's candidates are one row."""
    known = spark.createDataFrame([(f"h{i % 7}", "r", f"t{i % 11}") for i in range(60)] + [("h0", None, "t0")], "head string, relation string, tail string")
    rows = spark.createDataFrame([(f"h{i % 9}", r, f"t{i % 13}") for i in range(100) for r in ("r", "s", None)], "head string, relation string, tail string")
    want = sorted(map(tuple, rows.join(known, ["head", "relation", "tail"], "left_semi").collect()))
    assert want and sorted(map(tuple, sampling.known_among(rows, known, "head", "relation", "tail").collect())) == want
    q = known.filter("relation = 'r'").distinct().withColumn("qid", F.concat_ws("|", "head", "tail"))
    lists = sampling.candidate_lists(q.unionByName(q.limit(3)), known, sampling.entity_index(known), 6)
    assert lists.count() == q.count() == lists.filter(F.size("others") == 5).count()
    sets = sampling.with_gold(lists).withColumn("c", F.transform("c", lambda x: F.struct(F.length(x["candidate"]).alias("score"), x["candidate"].alias("candidate"), x["is_gold"].alias("is_gold"))))
    rows = sets.select("qid", "relation", F.explode("c").alias("x")).select("qid", "relation", "x.*")
    assert sorted(map(tuple, ranking.gold_ranks_of_sets(sets).collect())) == sorted(map(tuple, ranking.gold_ranks(rows).collect()))


def test_neighbours_and_blocks_stay_in_the_row_of_a_query(spark):
    """Copies of an edge take no place of another neighbour, and the sets hold what the rows do."""
    edges = spark.createDataFrame([("h", "r", "a"), ("h", "r", "a"), ("h", "r", "b"), ("h", "r", "c"), ("c", "r", "h"), ("b", "inv", "h"), ("a", "inv", "h"), ("h", "h2", "h")], "head string, relation string, tail string")
    q = spark.createDataFrame([("1", "h", "r", "b"), ("2", "none", "r", "b")], "qid string, head string, relation string, tail string")
    sets = {r["qid"]: [tuple(x) for x in r["near"]] for r in context.near_sets(edges, q, 4).collect()}
    assert sets == {"1": [("h2", "h"), ("inv", "a"), ("inv", "b"), ("r", "a")], "2": []}
    inverses = spark.createDataFrame([("r", "inv")], "relation string, inverse string")
    assert {r["qid"]: [tuple(x) for x in r["near"]] for r in context.near_sets(edges, q, 4, inverses).collect()}["1"] == [("h2", "h"), ("r", "a"), ("r", "c")]
    entities = spark.createDataFrame([("h", "one two"), ("h", "three")], "id string, text string")
    got = sorted((r["qid"], r["kind"], r["text"], r["tokens"]) for r in context.blocks(q, edges, entities, 4, 1, inverses).collect())
    assert [x[1] for x in got if x[0] == "2"] == ["demonstrations", "relation_description", "type_tag"] and [x[2:] for x in got if x[:2] == ("1", "entity_description")] == [("one two", 2), ("three", 1)]
    # by the join of edges with those that go back: (h r a) twice and (h r b) with inv, (h r c) with (c r h), the loop with itself
    back = {(r["relation"], r["inverse"]): (round(r["rate"], 6), round(r["rate_back"], 6)) for r in graph.inverse_relations(edges, 1, 0).collect()}
    assert back == {("r", "inv"): (0.6, 1.0), ("inv", "r"): (1.0, 0.6), ("r", "r"): (0.4, 0.4), ("h2", "h2"): (1.0, 1.0)}


def test_chains_by_one_join(spark):
    """Chains between ends are those of a plain self-join, copies of an edge and hubs included."""
    edges = [(f"n{i % 5}", "rs"[i % 2], f"n{(i * 3 + 1) % 17}") for i in range(40)] + [("hub", "r", f"n{i}") for i in range(17)] + [("hub", "r", "n1")] * 3
    df = spark.createDataFrame([(*x,) for h, r, t in edges for x in ((h, r, t), (t, r, h)) if h != t], "entity string, relation string, other string")
    pairs = [("n0", "n1"), ("hub", "n3"), ("n3", "hub"), ("n16", "n2"), ("n1", "nobody")]
    rows = set(map(tuple, df.collect()))
    want = sorted({(h, t, via, m, last) for h, t in pairs for e, via, m in rows if e == h for x, last, y in rows if x == t and y == m})
    got = [tuple(r) for r in joins.meet_any(spark.createDataFrame(pairs, "head string, tail string"), df, least=5).select("head", "tail", "via", "mid", "last").distinct().collect()]
    assert want and sorted(got) == want
