"""Graph operators on (head, relation, tail) edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.hashing import det_key
from graphlens.functions.ordering import checkpointed
from graphlens.operators.joins import HEAVY_LEAST, HEAVY_SHARE, meet, spread_join


def incident(edges: DataFrame) -> DataFrame:
    """(entity, relation, other, side): each edge from both its ends, in one scan."""
    both = F.explode(F.array(F.struct(F.col("head").alias("entity"), F.col("tail").alias("other"), F.lit("out").alias("side")), F.struct(F.col("tail").alias("entity"), F.col("head").alias("other"), F.lit("in").alias("side"))))
    return edges.select("relation", both.alias("x")).select("x.entity", "relation", "x.other", "x.side")


def degrees(edges: DataFrame) -> DataFrame:
    return incident(edges).groupBy("entity").agg(F.count_if(F.col("side") == "in").alias("n_in"), F.count_if(F.col("side") == "out").alias("n_out"), F.count("*").alias("degree"))


def relation_sides(edges: DataFrame) -> DataFrame:
    """(relation, side, entity), distinct: the domain (head) and range (tail) of each relation."""
    both = F.explode(F.array(F.struct(F.lit("head").alias("side"), F.col("head").alias("entity")), F.struct(F.lit("tail").alias("side"), F.col("tail").alias("entity"))))
    return edges.select("relation", both.alias("x")).select("relation", "x.side", "x.entity").distinct()


def relation_profile(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("head").alias("n_heads"), F.count_distinct("tail").alias("n_tails"))


def inverse_relations(edges: DataFrame, min_support: int = 100, min_rate: float = 0.5) -> DataFrame:
    """(relation, inverse, rate, rate_back): pairs that mirror each other both ways.

    Edges meet those of the other direction in the group of their two ends, so a hub is no hot key and edges are shuffled once;
    groups that hold the same relations are counted before their pairs are made. An edge counts as often as it is there, one that
    goes back once for each relation.
    """
    support = edges.groupBy("relation").agg(F.count("*").alias("support"))
    ends = edges.select(F.least("head", "tail").alias("lo"), F.greatest("head", "tail").alias("hi"), "relation", (F.col("head") <= F.col("tail")).alias("on")).filter(edges["head"].isNotNull() & edges["tail"].isNotNull())
    each = ends.repartition("lo", "hi").groupBy("lo", "hi", "relation", "on").agg(F.count("*").alias("m"))
    both = each.groupBy("lo", "hi").agg(F.sort_array(F.collect_list(F.struct("relation", "on", "m"))).alias("r"))  # an entry a relation and direction
    both = both.select("r", (F.col("lo") == F.col("hi")).alias("loop")).filter((F.size("r") > 1) | F.col("loop"))
    alike = checkpointed(both.groupBy("r", "loop").agg(F.count("*").alias("w")))  # read twice
    against = lambda x: F.filter("r", lambda y: (x["on"] != y["on"]) | F.col("loop"))
    met = F.flatten(F.transform("r", lambda x: F.transform(against(x), lambda y: F.struct(x["relation"].alias("relation"), y["relation"].alias("inverse"), (x["m"] * F.col("w")).alias("m")))))
    co = alike.select(F.explode(met).alias("x")).select("x.*").groupBy("relation", "inverse").agg(F.sum("m").alias("n"))
    rate = co.join(support, "relation").filter(F.col("support") >= min_support).select("relation", "inverse", (F.col("n") / F.col("support")).alias("rate"))
    other = rate.select(F.col("inverse").alias("relation"), F.col("relation").alias("inverse"), F.col("rate").alias("rate_back"))
    return rate.join(other, ["relation", "inverse"]).filter((F.col("rate") >= min_rate) & (F.col("rate_back") >= min_rate))


def first_per_group(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def few_by_hash(near: DataFrame, k: int, h: Column) -> DataFrame:
    """The rows of the first k hashes of each (head, via), and those that share 48 bits with them.

    Limited before the shuffle; no more than these bits of a hash are shuffled.
    """
    place = F.dense_rank().over(Window.partitionBy("head", "via").orderBy(F.unhex(F.substring(h, 1, 12))))
    return near.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")


def with_banned(queries: DataFrame, inverses: DataFrame) -> DataFrame:
    """(qid, head, relation, tail, banned), distinct: each query with the inverses of its relation."""
    return banned_too(queries.select("qid", "head", "relation", "tail").repartition("head").distinct(), inverses)


def banned_too(rows: DataFrame, inverses: DataFrame) -> DataFrame:
    """Add banned: the inverses of each row's relation."""
    banned = inverses.groupBy("relation").agg(F.collect_set("inverse").alias("banned"))
    return rows.join(F.broadcast(banned), "relation", "left").withColumn("banned", F.coalesce("banned", F.array().cast("array<string>")))  # at most relations squared


def guarded_neighbours(edges: DataFrame, queries: DataFrame, inverses: DataFrame, k: int, seed: str = "nbr") -> DataFrame:
    """(qid, neighbours): k neighbours of each query's head that do not give its tail away.

    Left out: edges to the gold tail by the asked relation or its inverses, and the query itself.
    Neighbours are ordered by hash of head and edge, so a hub is ranked once and not for each query: a query
    leaves out whole relations and one edge, so the first k + 1 of each (head, relation) are enough. They are in one row
    a head, in order, where its queries meet them.
    """
    near = incident(edges).select(F.col("entity").alias("head"), F.col("relation").alias("via"), "other")
    near = few_by_hash(near, k + 1, det_key(seed, "head", "via", "other"))
    each = near.groupBy("head", "via").agg(F.collect_set("other").alias("others"))
    lists = each.groupBy("head").agg(F.collect_list(F.struct("via", "others")).alias("l"))  # an entry a relation
    item = lambda x: lambda o: F.struct(det_key(seed, "head", x["via"], o).alias("h"), x["via"].alias("via"), o.alias("other"))
    lists = lists.select("head", F.sort_array(F.flatten(F.transform("l", lambda x: F.transform(x["others"], item(x))))).alias("near"))
    mine = lambda x: ~F.array_contains("banned", x["via"]) & ~((x["other"] == F.col("tail")) & (x["via"] == F.col("relation")))
    kept = with_banned(queries, inverses).join(lists, "head").select("qid", F.slice(F.filter("near", mine), 1, k).alias("near"))
    return kept.filter(F.size("near") > 0).select("qid", F.array_join(F.transform("near", lambda x: x["other"]), "|").alias("neighbours"))


def safe_neighbours(edges: DataFrame, queries: DataFrame, inverses: DataFrame, entities: DataFrame, k: int, seed: str = "nbr") -> DataFrame:
    """(qid, neighbours): the texts of up to k neighbours of each query's head, by hash, each text once.

    Left out: every edge of the asked relation or its inverses, the head itself, and the gold tail by any relation.
    Texts are ranked once for each (head, relation): a query leaves out whole relations and one neighbour, and with
    it at most one text, so the first k + 1 are enough. They are in one row a head, in order, where its queries meet them.
    """
    near = incident(edges).select(F.col("entity").alias("head"), F.col("relation").alias("via"), "other").filter(F.col("other") != F.col("head"))
    near = near.join(entities.select(F.col("id").alias("other"), "text"), "other", "left").select("head", "via", F.coalesce("text", "other").alias("text"), "other")
    near = few_by_hash(near, k + 1, det_key(seed, "head", "text"))
    near = near.groupBy("head", "via", "text").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    lists = near.groupBy("head").agg(F.collect_list(F.struct("via", "text", "lo", "hi")).alias("l"))  # at most k + 1 texts a relation
    item = lambda x: F.struct(det_key(seed, "head", x["text"]).alias("h"), x["text"].alias("text"), x["via"].alias("via"), x["lo"].alias("lo"), x["hi"].alias("hi"))
    lists = lists.select("head", F.sort_array(F.transform("l", item)).alias("near"))
    mine = lambda x: ~F.array_contains("banned", x["via"]) & (x["via"] != F.col("relation")) & ((x["lo"] != F.col("tail")) | (x["hi"] != F.col("tail")))
    texts = F.array_distinct(F.transform(F.filter("near", mine), lambda x: x["text"]))
    kept = with_banned(queries, inverses).join(lists, "head").select("qid", F.slice(texts, 1, k).alias("near"))
    return kept.filter(F.size("near") > 0).select("qid", F.array_join("near", "|").alias("neighbours"))


def leaks(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """The queries whose answer is an edge of the evidence in either direction."""
    asked = queries.select("qid", "head", "tail")
    there = edges.select("head", "tail").distinct()
    back = there.select(F.col("tail").alias("head"), F.col("head").alias("tail"))
    return asked.join(there.unionByName(back).distinct(), ["head", "tail"], "left_semi")


def two_hop_counts(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n_paths): directed paths of two edges from each query's head to its tail, through any middle.

    Equal queries are counted once, and each is opened at its end of smaller degree.
    """
    w = checkpointed(edges.groupBy("head", "tail").agg(F.count("*").alias("w")))  # met six times
    pairs = queries.select("head", "tail").distinct()
    paths = meet(pairs, w.select("head", F.col("tail").alias("mid"), F.col("w").alias("a")), w.select("tail", F.col("head").alias("mid"), F.col("w").alias("b")))
    n = paths.groupBy("head", "tail").agg(F.sum(F.col("a") * F.col("b")).alias("n"))
    return queries.select("qid", "head", "tail").join(n, ["head", "tail"], "left").select("qid", F.coalesce("n", F.lit(0).cast("long")).alias("n_paths"))


def safe_paths(edges: DataFrame, queries: DataFrame, inverses: DataFrame, entities: DataFrame, k: int = 3, seed: str = "path") -> DataFrame:
    """(qid, paths): up to k rendered chains head, middle, tail of edges in any direction, whatever the middle's degree.

    Edges of the asked relation and its inverses are left out; of several last edges the first by hash is taken. Each query is
    opened at the end that has fewer edges of the relations left, by these edges alone, so a hub of banned edges is never opened;
    it is met at the other end by an equi-join on that end and the middle, for which each edge is shuffled once.
    """
    near = incident(edges).filter(F.col("entity") != F.col("other"))
    own = near.groupBy("entity", "relation", "side").agg(F.count("*").alias("n"))
    degree = checkpointed(own.groupBy("entity").agg(F.collect_list(F.struct("relation", "side", "n")).alias("_d")))  # two entries a relation
    at = lambda end: degree.select(F.col("entity").alias(end), F.col("_d").alias(f"_{end}"))
    free = lambda x: (x["relation"] != F.col("relation")) & ~F.array_contains("banned", x["relation"])
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    sized = with_banned(queries, inverses)
    for end in ("head", "tail"):
        sized = sized.join(at(end), end).withColumn(f"_{end}", F.filter(f"_{end}", free)).filter(F.size(f"_{end}") > 0)
    sized = sized.withColumn("_on", size("_head") <= size("_tail"))
    either = lambda a, b: F.when(F.col("_on"), F.col(a)).otherwise(F.col(b))
    asked = sized.select("qid", "relation", "_on", either("head", "tail").alias("open"), either("tail", "head").alias("far"), F.explode(either("_head", "_tail")).alias("x"))
    asked = checkpointed(asked.select("qid", "relation", "_on", "far", F.struct("open", "x.relation", "x.side").alias("_open")))
    each = degree.select("entity", F.explode("_d").alias("x")).select(F.struct(F.col("entity").alias("open"), "x.relation", "x.side").alias("_open"), "x.n")
    heavy = checkpointed(each.filter(F.col("n") > max(HEAVY_LEAST, (each.agg(F.sum("n")).first()[0] or 0) // HEAVY_SHARE)).select("_open"))
    kinds = F.broadcast(asked.select("_open.relation", "_open.side").distinct())  # two rows a relation: edges of others open nothing
    firsts = near.join(kinds, ["relation", "side"], "left_semi").select(F.struct(F.col("entity").alias("open"), "relation", "side").alias("_open"), F.col("other").alias("mid"))
    ordered = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    opened = spread_join(asked, firsts, "_open", heavy, "mid").filter(F.col("mid") != F.col("far")).select("*", *ordered("mid", "far"))
    ends = edges.filter(F.col("head") != F.col("tail")).select(*ordered("head", "tail"), F.col("relation").alias("_second")).repartition("lo", "hi").distinct()
    met = banned_too(opened.join(ends, ["lo", "hi"]), inverses).filter((F.col("_second") != F.col("relation")) & ~F.array_contains("banned", F.col("_second")))
    met = met.withColumns({"_first": F.col("_open.relation"), "_end": F.col("_open.open")})
    j = met.select("qid", either("_end", "far").alias("head"), either("far", "_end").alias("tail"), either("_first", "_second").alias("via"), "mid", either("_second", "_first").alias("last"))
    j = j.groupBy("qid", "head", "tail", "via", "mid").agg(F.min_by("last", det_key(seed, "last")).alias("last")).withColumn("h", det_key(seed, "qid", "via", "mid"))
    few = first_per_group(j, ["qid"], ["h"], k)
    for end_of in ("head", "mid", "tail"):
        names = entities.select(F.col("id").alias(end_of), F.col("text").alias(f"{end_of}_text"))
        few = few.join(names, end_of, "left").withColumn(f"{end_of}_text", F.coalesce(f"{end_of}_text", end_of))
    few = few.withColumn("path", F.concat_ws(" ", "head_text", "via", "mid_text", "last", "tail_text"))
    paths = few.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "path"))), lambda x: x["path"]), "; ").alias("paths"))
    return queries.select("qid").join(paths, "qid", "left").select("qid", F.coalesce("paths", F.lit("")).alias("paths"))


#: Most nodes of a step that are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_NODES = 500_000


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, limit: int | None = None, seed: str = "hop", frontier: int | None = None) -> DataFrame:
    """(entity, hop): what lies within so many steps; with `limit`, at most so many neighbours of each node, by hash.

    With `frontier`, only so many of the nodes of a step, by hash, are the start of the next one; all are reported.
    Neighbours are ordered for the nodes that a step starts from alone, and only where they are limited.
    """
    ends = incident(edges).select("entity", "other")
    seen = seeds.select("entity").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        start = front.select("entity")
        if frontier is not None and hop > 1:
            start = start.withColumn("h", det_key(seed, "entity")).orderBy("h", "entity").limit(frontier).select("entity")
        start = checkpointed(start)
        few = F.broadcast(start) if start.count() <= BROADCAST_NODES else start
        near = ends.join(few, "entity", "left_semi")
        if limit is not None:
            near = first_per_group(near.distinct().withColumn("h", det_key(seed, "entity", "other")), ["entity"], ["h"], limit)
        reached = near.select(F.col("other").alias("entity")).distinct().join(seen, "entity", "left_anti")
        front = checkpointed(reached.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def entropy(df: DataFrame, group: list[str], value: str, out: str = "entropy") -> DataFrame:
    """Entropy in bits of `value` within each group."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*group))
    return n.withColumn("p", p).groupBy(*group).agg((F.lit(0.0) - F.sum(F.col("p") * F.log2("p"))).alias(out))  # 0.0, never -0.0


def touching_unseen(train: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts with an end that training never saw: two anti joins, no OR in a join condition."""
    seen = relation_sides(train).select("entity").distinct()
    marked = facts.join(seen.select(F.col("entity").alias("head"), F.lit(1).alias("h")), "head", "left").join(seen.select(F.col("entity").alias("tail"), F.lit(1).alias("t")), "tail", "left")
    return marked.filter(F.col("h").isNull() | F.col("t").isNull()).select(*facts.columns)
