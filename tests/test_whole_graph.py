"""Graph queries over all neighbours: nothing is capped, and what is shuffled stays in the row of a query."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphlens.operators import budget, conditions, graph, ranking, sampling

SF = "/root/testdata/sf0.001"
EDGE = "head string, relation string, tail string"


def test_two_hops_reach_every_neighbour(spark):
    edges = spark.createDataFrame([("s", "r", f"a{i}") for i in range(6)] + [(f"a{i}", "r", f"b{i}{j}") for i in range(6) for j in range(5)] + [("s", "r", "a0")], EDGE)
    got = sorted(map(tuple, graph.k_hop(edges, spark.createDataFrame([("s",)], "entity string"), 2).collect()))
    assert got == sorted([("s", 0)] + [(f"a{i}", 1) for i in range(6)] + [(f"b{i}{j}", 2) for i in range(6) for j in range(5)])


def test_two_hop_query_has_no_cap(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    near, seeds = {}, set()
    for h, r, t in entry.queries()["sc3_load_triples"](spark, SF).select("head", "relation", "tail").collect():
        near.setdefault(h, set()).add(t)
        near.setdefault(t, set()).add(h)
        seeds |= {h} if r == "basedIn" else set()
    hops, front = dict.fromkeys(seeds, 0), seeds
    for hop in (1, 2):
        front = {o for e in front for o in near[e]} - hops.keys()
        hops |= dict.fromkeys(front, hop)
    got = {r["entity"]: r["hop"] for r in entry.queries()["gr3_two_hop_neighbourhood"](spark, SF).collect()}
    assert got == hops and "row_number" not in entry.oracle_sql()["gr3_two_hop_neighbourhood"]


def test_inverses_shuffle_edges_once(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("b", "s", "a"), ("c", "r", "c"), ("a", "r", "d")], EDGE)
    out = graph.inverse_relations(edges, 1, 0)
    assert "hashpartitioning(lo" not in out._jdf.queryExecution().executedPlan().toString()  # twice before: now counted once, then read
    # the copies of (a r b) meet s each, s meets r once, the loop meets itself
    assert {(r["relation"], r["inverse"]): (r["rate"], r["rate_back"]) for r in out.collect()} == {("r", "s"): (0.5, 1.0), ("s", "r"): (1.0, 0.5), ("r", "r"): (0.25, 0.25)}


def by_query(frame):
    return "hashpartitioning(qid" in frame._jdf.queryExecution().executedPlan().toString()


def test_guarded_neighbours_stay_in_a_row(spark):
    rows = [("h", f"r{i % 3}", f"t{i}") for i in range(30)] + [(f"t{i}", "back", "h") for i in range(9)] + [("h", "r1", "t1")] * 2
    edges = spark.createDataFrame(rows, EDGE)
    asked = [(f"{i}", "h", f"r{i % 4}", f"t{i}") for i in range(12)] + [("0", "h", "r0", "t0"), ("x", "alone", "r0", "t0")]
    queries = spark.createDataFrame(asked, "qid string, " + EDGE)
    banned = {("r0", "back"), ("r0", "r2"), ("r1", "r0")}
    out = graph.guarded_neighbours(edges, queries, spark.createDataFrame(sorted(banned), "relation string, inverse string"), 4)
    near = {(h, r, t) for h, r, t in rows} | {(t, r, h) for h, r, t in rows}
    key = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    want = {}
    for qid, h, r, t in asked:
        kept = sorted((key("nbr", h, via, o), o) for e, via, o in near if e == h and not (o == t and via == r) and (r, via) not in banned)[:4]
        want |= {qid: "|".join(o for _, o in kept)} if kept else {}
    got = [tuple(x) for x in out.collect()]
    assert sorted(got) == sorted(want.items()) and not by_query(out)


def test_safe_neighbours_stay_in_a_row(spark):
    """Texts that several neighbours share, the gold tail among them, count once and stay as long as another has them."""
    rows = [("h", f"r{i % 3}", f"t{i}") for i in range(30)] + [(f"t{i}", "back", "h") for i in range(9)] + [("h", "r1", "t1")] * 2 + [("h", "r2", "h")]
    texts = {f"t{i}": f"text {i % 11}" for i in range(25)}
    asked = [(f"{i}", "h", f"r{i % 4}", f"t{i}") for i in range(30)] + [("0", "h", "r0", "t0")]
    banned = {("r0", "back"), ("r0", "r2"), ("r1", "r0")}
    out = graph.safe_neighbours(spark.createDataFrame(rows, EDGE), spark.createDataFrame(asked, "qid string, " + EDGE), spark.createDataFrame(sorted(banned), "relation string, inverse string"), spark.createDataFrame(list(texts.items()), "id string, text string"), 3)
    near = {(h, r, t) for h, r, t in rows} | {(t, r, h) for h, r, t in rows}
    key = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    want = {}
    for qid, h, r, t in asked:
        kept = sorted({(key("nbr", h, texts.get(o, o)), texts.get(o, o)) for e, via, o in near if e == h and o not in (h, t) and via != r and (r, via) not in banned})[:3]
        want |= {qid: "|".join(o for _, o in kept)} if kept else {}
    assert sorted(tuple(x) for x in out.collect()) == sorted(want.items()) and not by_query(out)


def test_alike_queries_are_filled_once(spark):
    """The shapes of queries give the fillings that the queries give, with all policies, ties and missing traits."""
    rng = random.Random(5)
    kinds = [*budget.KINDS, "other"]
    rows = []
    for i in range(200):
        blocks = [(rng.choice(kinds), f"t{rng.randint(0, 3)}", "w " * n, n) for n in (rng.randint(1, 6) for _ in range(rng.randint(0, 6)))]
        traits = [rng.choice([None, True, False]), rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([None, 1.0, 2.0, 7.0]), rng.choice([None, 3, 4, 5]), rng.choice([None, 1.9, 2.0, 4.0]), rng.choice([None, 2, 3, 50])]
        rows += [(str(i), blocks, *traits), (f"{i}b", blocks, *traits)]
    sets = spark.createDataFrame(rows, "qid string, blocks array<struct<kind:string,target:string,text:string,tokens:bigint>>, " + ", ".join(f"{c} {t}" for c, t in budget.TRAITS.items()))
    kinds_of = lambda r: (r["policy"], r["spent"], tuple((k["kind"], k["tokens"]) for k in r["kept"]))
    want = Counter(map(kinds_of, budget.allocated_sets(sets, F.lit(9)).collect()))
    got, seen = Counter(), 0
    for r in budget.allocated_shapes(sets, F.lit(9)).collect():
        got[kinds_of(r)] += r["n"]
        seen += 1
    assert got == want and seen <= 200 * len(budget.POLICIES)
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(budget.spent_by_kind(budget.allocated_sets(sets, F.lit(9)), "policy")) == plain(budget.spent_by_kind(budget.allocated_shapes(sets, F.lit(9)), "policy", times="n"))


def test_paths_open_no_banned_edges(spark, monkeypatch):
    """Chains are those of a plain self-join; edges of the asked relation and its inverses are not opened, however many an end has."""
    rows = [("hub", "asked", f"t{i}") for i in range(40)] + [(f"t{i}", "inv", "hub") for i in range(40)] + [("hub", "r", f"m{i}") for i in range(5)]
    rows += [(f"m{i % 5}", "s", f"t{i}") for i in range(40)] + [(f"t{i}", "r", f"m{(i + 1) % 5}") for i in range(40)] + [("m0", "s", "t0")] * 2 + [("hub", "r", "hub"), ("t1", "s", "m1")]
    asked = [(f"q{i}", "hub", "asked", f"t{i}") for i in range(30)] + [("q0", "hub", "asked", "t0"), ("y", "t3", "s", "hub"), ("z", "hub", "asked", "none")]
    banned = {("asked", "inv"), ("inv", "asked")}
    opened, real = [], graph.spread_join

    def counted(*args, **named):
        out = real(*args, **named)
        opened.append(out.count())
        return out

    monkeypatch.setattr(graph, "spread_join", counted)
    names = spark.createDataFrame([("hub", "the hub")], "id string, text string")
    out = graph.safe_paths(spark.createDataFrame(rows, EDGE), spark.createDataFrame(asked, "qid string, " + EDGE), spark.createDataFrame(sorted(banned), "relation string, inverse string"), names, 2)
    key = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    near = {(h, r, t) for h, r, t in rows if h != t} | {(t, r, h) for h, r, t in rows if h != t}
    show, want = {"hub": "the hub"}, []
    for qid, h, r, t in asked:
        ok = lambda via: via != r and (r, via) not in banned  # noqa: B023, E731
        chains = {}
        for e, via, m in near:
            lasts = [x for f, x, y in near if f == t and y == m and ok(x)] if e == h and ok(via) and m != t else []
            chains |= {(key("path", qid, via, m), via, m): min(lasts, key=lambda x: key("path", x))} if lasts else {}
        want.append((qid, "; ".join(f"{show.get(h, h)} {via} {m} {last} {show.get(t, t)}" for (_, via, m), last in sorted(chains.items())[:2])))
    assert sorted(tuple(x) for x in out.collect()) == sorted(want) and sum(p != "" for _, p in want) > 20
    assert sum(opened) < 200  # some 30 times 3 or less, not 30 times 80


def test_drawn_pools_are_not_copied(spark, monkeypatch):
    """Small groups of a pool are broadcast, large ones meet their draws by a plain shuffle, and no entry is copied."""
    monkeypatch.setattr(sampling, "BROADCAST_POOL", 10)
    pool = spark.createDataFrame([(r, "head", i, f"{r}{i}") for r, n in (("a", 3), ("b", 7), ("c", 500)) for i in range(n)], "relation string, side string, idx long, own string")
    rows = spark.createDataFrame([("h", r, f"t{i}", "head", i % n) for r, n in (("a", 3), ("b", 7), ("c", 500)) for i in range(900)], EDGE + ", side string, idx long")
    out = sampling.fetch_drawn(rows, pool, ["relation", "side"])
    assert sorted((r["relation"], r["idx"], r["own"]) for r in out.collect()) == sorted((r, i % n, f"{r}{i % n}") for r, n in (("a", 3), ("b", 7), ("c", 500)) for i in range(900))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan and "explode" not in plan and "hashpartitioning(relation" in plan


def test_aligned_keeps_sums_only(spark, monkeypatch):
    """Nothing of the rows' number is written by the comparison: before, a row for each id was."""
    kept, real = [], conditions.checkpointed

    def counted(df):
        out = real(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(conditions, "checkpointed", counted)
    rows = [(c, i, f"p{i % 3}{c if i % 5 == 0 else ''}") for c in "ABC" for i in range(300) if c != "C" or i < 250] + [("A", 7, "p1")]
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in conditions.aligned(spark.createDataFrame(rows, "condition string, id long, prompt string")).collect()}
    assert got == {("A", "B"): (301, 300, False, 300, 240), ("A", "C"): (301, 250, False, 250, 200), ("B", "C"): (300, 250, False, 250, 200)} and sum(kept) < 20


def test_margins_in_the_row_of_a_query(spark):
    rng = random.Random(2)
    sets = spark.createDataFrame([(str(i), [(rng.randint(0, 4) / 4, f"c{j}") for j in range(n)]) for i, n in enumerate([1, 2, 4, 5, 9, 12])], "qid string, c array<struct<score:double,candidate:string>>")
    rows = sets.select("qid", F.explode("c").alias("x")).select("qid", "x.*")
    out = ranking.top_and_margin_of_sets(sets)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, ranking.top_and_margin(rows).collect()))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
