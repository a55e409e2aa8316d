"""Samples, splits, negatives and candidates by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.hashing import det_index, det_key, det_number
from graphlens.functions.ordering import checkpointed, with_dense_index
from graphlens.operators.graph import degrees, first_per_group, relation_sides

TRIPLE = ["head", "relation", "tail"]


def uniform_sample(df: DataFrame, n: int, seed: str, *key: str) -> DataFrame:
    return df.withColumn("_h", det_key(seed, *key)).orderBy("_h").limit(n).drop("_h")


def stratified_sample(triples: DataFrame, n: int, floor: int, seed: str = "strat") -> DataFrame:
    """At least `floor` triples of each relation, then others by hash up to n; floors beyond n are cut by hash.

    The floors of each relation and the first n of all are limited before the shuffle; copies of a row are numbered,
    so that one which is in both counts once.
    """
    own = triples.columns
    h = triples.withColumns({"_h": det_key(seed, *TRIPLE), "_t": F.xxhash64(*own)})
    copy = F.row_number().over(Window.partitionBy(*own).orderBy("_h"))
    marked = lambda df, is_floor: df.withColumns({"_copy": copy, "_floor": F.lit(is_floor)})
    both = marked(first_per_group(h, ["relation"], ["_h", "_t"], floor), True).unionByName(marked(h.orderBy("_h", "_t").limit(n), False))
    each = both.groupBy(*own, "_h", "_t", "_copy").agg(F.bool_or("_floor").alias("_floor"))
    return each.orderBy(F.desc("_floor"), "_h", "_t").limit(n).select(*own)


def entity_subset(triples: DataFrame, n: int, top_share: float = 0.7, seed: str = "subset") -> DataFrame:
    """The triples among n entities: the best connected share, the rest by hash."""
    d = degrees(triples).select("entity", "degree")
    top = d.orderBy(F.desc("degree"), "entity").limit(int(n * top_share))
    rest = uniform_sample(d.join(top, "entity", "left_anti"), n - int(n * top_share), seed, "entity")
    keep = top.unionByName(rest).select("entity")
    return triples.join(keep.withColumnRenamed("entity", "head"), "head", "left_semi").join(keep.withColumnRenamed("entity", "tail"), "tail", "left_semi").select(*triples.columns)


def entity_index(triples: DataFrame) -> DataFrame:
    """(idx, entity) over all entities, in order."""
    both = F.explode(F.array("head", "tail")).alias("entity")
    return with_dense_index(triples.select(both).distinct(), "entity").select("idx", "entity")


def side_index(triples: DataFrame, side: str | None = None) -> DataFrame:
    """(relation, side, idx, entity, n): the ends of each relation, numbered in order; with `side`, those of it alone."""
    ends = relation_sides(triples) if side is None else triples.select("relation", F.lit(side).alias("side"), F.col(side).alias("entity")).distinct()
    every = with_dense_index(ends, "relation", "side", "entity", name="_at")
    groups = every.groupBy("relation", "side").agg(F.min("_at").alias("_from"), F.count("*").alias("n"))
    out = every.join(F.broadcast(groups), ["relation", "side"])  # two rows a relation
    return out.select("relation", "side", (F.col("_at") - F.col("_from")).alias("idx"), "entity", "n")


def random_negatives(triples: DataFrame, entities: DataFrame, seed: str = "neg") -> DataFrame:
    """Each triple with one end replaced by another entity, chosen by hash; no check against what is known."""
    n = entities.agg(F.count("*")).first()[0]
    side = F.when(det_number(seed + "-side", *TRIPLE) % 2 == 0, "head").otherwise("tail")
    t = triples.select(*TRIPLE).withColumn("side", side).withColumn("idx", det_index(F.lit(n), seed, *TRIPLE))
    old = F.when(F.col("side") == "head", F.col("head")).otherwise(F.col("tail"))
    e = entities.select("idx", F.col("entity").alias("new"))
    nxt = entities.select(((F.col("idx") + n - 1) % n).alias("idx"), F.col("entity").alias("next"))
    j = t.join(e.join(nxt, "idx"), "idx")
    new = F.when(F.col("new") == old, F.col("next")).otherwise(F.col("new"))
    j = j.withColumn("put", new)
    return j.select("head", "relation", "tail", "side", F.when(F.col("side") == "head", F.col("put")).otherwise(F.col("head")).alias("neg_head"), F.when(F.col("side") == "tail", F.col("put")).otherwise(F.col("tail")).alias("neg_tail"))


#: Most pool entries that are broadcast (some 100 bytes each); larger pools are met by salted keys.
BROADCAST_POOL, POOL_SALTS = 200_000, 32


def fetch(rows: DataFrame, pool: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join many rows with a pool on keys of which a few can hold most rows: by broadcast, or with the pool in each of POOL_SALTS salts."""
    if pool.count() <= BROADCAST_POOL:
        return rows.join(F.broadcast(pool), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*TRIPLE), F.lit(POOL_SALTS)).cast("int"))
    return salted.join(pool.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(POOL_SALTS - 1)))), [*keys, "_salt"], how).drop("_salt")


def fetch_drawn(rows: DataFrame, pool: DataFrame, group: list[str]) -> DataFrame:
    """Inner join of rows with a pool (group, idx, ..) where idx is drawn evenly from the pool's groups.

    A key of a large group is drawn by few rows, so such groups are met by a plain shuffle; the smallest groups, up to
    BROADCAST_POOL entries in all, are broadcast. One row a group goes to the driver.
    """
    sizes = sorted((tuple(r)[-1], tuple(r)[:-1]) for r in pool.groupBy(*group).agg(F.count("*")).collect())
    small, total = [], 0
    for n, key in sizes:
        total += n
        if total > BROADCAST_POOL:
            break
        small.append(key)
    if len(small) == len(sizes):
        return rows.join(F.broadcast(pool), [*group, "idx"])
    table = F.broadcast(pool.sparkSession.createDataFrame(small, ", ".join(f"{g} string" for g in group)))
    near = rows.join(table, group, "left_semi").join(F.broadcast(pool.join(table, group, "left_semi")), [*group, "idx"])
    return near.unionByName(rows.join(table, group, "left_anti").join(pool.join(table, group, "left_anti"), [*group, "idx"]))


def tail_pool(known: DataFrame) -> DataFrame:
    """(relation, idx, new): the range of each relation, numbered in order."""
    return checkpointed(side_index(known, "tail").select("relation", "idx", F.col("entity").alias("new")))


def typed_negatives(triples: DataFrame, known: DataFrame, seed: str = "typed", many: int | None = None, pool: DataFrame | None = None) -> DataFrame:
    """Each triple with another tail of its relation's range; null where the range has no other. With `many`, so many draws, numbered in `draw`.

    pool: what tail_pool(known) gave, if it is there.
    """
    pool = tail_pool(known) if pool is None else pool
    size = F.broadcast(pool.groupBy("relation").agg(F.count("*").alias("n")))  # one row a relation
    gold = pool.select("relation", F.col("new").alias("tail"), F.col("idx").alias("gold"))
    t = fetch(triples.select(*TRIPLE).join(size, "relation", "left"), gold, ["relation", "tail"], "left")
    draw = [] if many is None else [F.col("draw").cast("string")]
    if many is not None:
        t = t.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    others = F.col("n") - F.when(F.col("gold").isNotNull(), 1).otherwise(0)
    t = t.withColumn("pick", det_index(others, seed, *TRIPLE, *draw))
    t = t.withColumn("idx", F.col("pick") + F.when(F.col("gold").isNotNull() & (F.col("pick") >= F.col("gold")), 1).otherwise(0))
    return fetch(t, pool, ["relation", "idx"], "left").select(*TRIPLE, F.col("new").alias("neg_tail"), *([] if many is None else ["draw"]))


def test_negatives(test: DataFrame, known: DataFrame, tries: int, seed: str = "tneg") -> DataFrame:
    """(head, relation, tail, neg_head, neg_tail, try): the first of so many tries that is no known triple and no loop."""
    pool = side_index(known).select("relation", "side", "idx", F.col("entity").alias("new"))
    size = pool.groupBy("relation", "side").agg(F.count("*").alias("n"))
    side = F.when(det_number(seed + "-side", *TRIPLE) % 2 == 0, "head").otherwise("tail")
    t = test.select(*TRIPLE).withColumn("side", side).join(F.broadcast(size), ["relation", "side"])  # two rows a relation
    t = t.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    t = t.withColumn("idx", det_index(F.col("n"), seed, *TRIPLE, F.col("try").cast("string")))
    j = fetch(t, checkpointed(pool), ["relation", "side", "idx"])
    j = j.withColumn("neg_head", F.when(F.col("side") == "head", F.col("new")).otherwise(F.col("head"))).withColumn("neg_tail", F.when(F.col("side") == "tail", F.col("new")).otherwise(F.col("tail")))
    k = known.select(F.col("head").alias("neg_head"), "relation", F.col("tail").alias("neg_tail")).distinct()
    ok = j.filter(F.col("neg_head") != F.col("neg_tail")).join(k, ["neg_head", "relation", "neg_tail"], "left_anti")
    best = ok.groupBy(*TRIPLE).agg(F.min(F.struct("try", "neg_head", "neg_tail")).alias("x"))
    return best.select(*TRIPLE, "x.neg_head", "x.neg_tail", F.col("x.try").alias("try"))


#: Where the first tries end, and those for what these leave.
FIRST_TRIES = (2, 8)


def whole_test_negatives(test: DataFrame, train: DataFrame, known: DataFrame, entities: DataFrame, tries: int = 60, seed: str = "tneg") -> DataFrame:
    """(head, relation, tail, neg_head, neg_tail, try, accidental, skipped): every test triple, with its first good try.

    Each try draws its side. A pool of fewer than two entities gives way to all entities. accidental counts the tries
    before the good one that were known triples; skipped is 1, and the negative null, where no try is good.
    Known triples are found among the tries by hashes and compared in full where these meet.
    """
    pool = checkpointed(side_index(train).select("relation", "side", "idx", F.col("entity").alias("own")))
    size = pool.groupBy("relation", "side").agg(F.count("*").alias("n"))
    n = entities.agg(F.count("*")).first()[0]
    known = known.select(F.col("head").alias("neg_head"), "relation", F.col("tail").alias("neg_tail"))

    def tried(left: DataFrame, first: int, last: int) -> DataFrame:
        """left with its good one (x) of the tries from the first to before the last, and accidental counted on."""
        t = left.select(*TRIPLE).withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        no = F.col("try").cast("string")
        t = t.withColumn("side", F.when(det_number(seed + "-side", *TRIPLE, no) % 2 == 0, "head").otherwise("tail")).join(F.broadcast(size), ["relation", "side"], "left")  # two rows a relation
        t = t.withColumn("tiny", F.coalesce("n", F.lit(0)) < 2).withColumn("idx", det_index(F.when(F.col("tiny"), F.lit(n)).otherwise(F.col("n")), seed, *TRIPLE, no))
        own = fetch_drawn(t.filter(~F.col("tiny")), pool, ["relation", "side"]).select(*TRIPLE, "try", "side", F.col("own").alias("new"))
        j = own.unionByName(t.filter("tiny").join(entities.select("idx", F.col("entity").alias("new")), "idx").select(*TRIPLE, "try", "side", "new"))
        j = j.withColumn("neg_head", F.when(F.col("side") == "head", F.col("new")).otherwise(F.col("head"))).withColumn("neg_tail", F.when(F.col("side") == "tail", F.col("new")).otherwise(F.col("tail"))).filter(F.col("neg_head") != F.col("neg_tail"))
        j = checkpointed(j.select(*TRIPLE, "try", "neg_head", "neg_tail"))
        hits = known_among(j, known, "neg_head", "relation", "neg_tail").groupBy(*TRIPLE).agg(F.collect_set("try").alias("hits"))
        each = j.groupBy(*TRIPLE).agg(F.collect_list(F.struct("try", "neg_head", "neg_tail")).alias("made"))
        out = left.join(each, TRIPLE, "left").join(hits, TRIPLE, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>")))
        out = out.withColumn("x", F.array_min(F.filter("made", lambda m: ~F.array_contains("hits", m["try"])))).withColumn("end", F.coalesce("x.try", F.lit(last)))
        return out.select(*TRIPLE, "x", (F.col("accidental") + F.size(F.filter("hits", lambda h: h < F.col("end")))).alias("accidental"))

    # most triples are settled by their first tries: the others are made only for those that are not
    left, settled, first = test.select(*TRIPLE).distinct().withColumn("accidental", F.lit(0)), None, 0
    for last in (*(t for t in FIRST_TRIES if t < tries), tries):
        stage = checkpointed(tried(left, first, last))
        left, first = stage.filter("x IS NULL").drop("x"), last
        part = stage if last == tries else stage.filter("x IS NOT NULL")
        settled = part if settled is None else settled.unionByName(part)
    out = test.select(*TRIPLE).join(settled, TRIPLE, "left")
    return out.select(*TRIPLE, "x.neg_head", "x.neg_tail", F.col("x.try").alias("try"), F.coalesce("accidental", F.lit(0)).alias("accidental"), F.col("x").isNull().cast("int").alias("skipped"))


def validation_part(rows: DataFrame, *key: str, share: float = 0.3, seed: str = "perm-split") -> DataFrame:
    """Add part: the first floor(share * n) rows in the order of a hash of the key are validation, the rest test."""
    ring = with_dense_index(rows.withColumn("_h", det_key(seed, *key)), "_h", *key, name="_i")
    most = F.floor(ring.agg(F.count("*")).scalar() * share)
    return ring.withColumn("part", F.when(F.col("_i") < most, "validation").otherwise("test")).drop("_h", "_i")


def inductive_split(triples: DataFrame, share: float, seed: str = "ind") -> DataFrame:
    """Add part: train (both ends seen), query (head unseen), support (others that touch an unseen entity)."""
    unseen = lambda c: det_number(seed, c) % 10000 < int(share * 10000)
    return triples.withColumn("part", F.when(~unseen("head") & ~unseen("tail"), "train").when(unseen("head"), "query").otherwise("support"))


#: Draws beyond the wanted ones of a first pass; as few draws are known triples, few queries need the second.
SPARE_DRAWS = 2


def known_among(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are a row of `known`, where few are: only hashes of 8 bytes are shuffled, and what they find is compared in full."""
    h = F.xxhash64(*keys).alias("_h")
    found = checkpointed(rows.select(h).join(known.select(h), "_h", "left_semi").distinct())
    few = F.broadcast(found) if found.count() <= BROADCAST_POOL else found
    there = known.select(*keys, h).join(few, "_h", "left_semi")
    return rows.withColumn("_h", h).join(few, "_h", "left_semi").join(there, ["_h", *keys], "left_semi").drop("_h")


def candidate_lists(queries: DataFrame, known: DataFrame, entities: DataFrame, n_way: int, seed: str = "cand") -> DataFrame:
    """(qid, head, relation, tail, others): one row for each query with n_way - 1 others that are not known to be true.

    Draw number d of a query is an index into the entities, so an equi-join fetches it: no cross
    join, and a query's candidates do not depend on the other queries. A query's own are the first n_way - 1
    good ones of 2 * n_way draws, but the last of these are made only where the first do not do. A query that
    still finds fewer is filled up with the entities from a place on that a hash gives, in a ring: as many as
    cannot all be excluded, so only a query with too few others is short. Equal queries count once.
    """
    n, need, most = entities.agg(F.count("*")).first()[0], n_way - 1, 2 * n_way
    q = queries.select("qid", *TRIPLE)
    at = entities.select("idx", F.col("entity").alias("candidate"))

    def drawn(q: DataFrame, draws: int) -> DataFrame:
        """Each query with its good candidates in the order of draws. Draws carry the qid alone and meet the query's triples in its group."""
        own = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: det_index(F.lit(n), seed, "qid", d.cast("string")))
        d = q.select("qid", F.posexplode(F.array_distinct(own)).alias("draw", "idx")).join(at, "idx").select("qid", "draw", "candidate")
        both = d.unionByName(q.withColumn("q", F.struct(*TRIPLE)).select("qid", "q"), allowMissingColumns=True).repartition("qid")
        g = both.groupBy("qid").agg(F.collect_set("q").alias("q"), F.collect_set(F.when(F.col("draw").isNotNull(), F.struct("draw", "candidate"))).alias("d"))
        order = F.array_sort(F.filter("d", lambda x: x["candidate"] != F.col("q.tail")))["candidate"]
        sets = checkpointed(g.select("qid", F.explode("q").alias("q"), "d").select("qid", "q.*", order.alias("d")))
        true = known_among(sets.select("head", "relation", "tail", F.explode("d").alias("candidate")), known.select("head", "relation", F.col("tail").alias("candidate")), "head", "relation", "candidate")
        true = checkpointed(true.groupBy(*TRIPLE).agg(F.collect_set("candidate").alias("true")))
        true = F.broadcast(true) if true.count() <= BROADCAST_POOL // draws else true
        good = F.array_except("d", F.coalesce("true", F.array().cast("array<string>")))
        return sets.join(true, TRIPLE, "left").select("qid", *TRIPLE, F.slice(good, 1, need).alias("others"))

    sets = drawn(q, min(need + SPARE_DRAWS, most))
    few = checkpointed(sets.filter(F.size("others") < need).select("qid", *TRIPLE))
    if few.isEmpty():
        return sets
    again = checkpointed(drawn(few, most))
    short = again.withColumn("need", need - F.size("others")).filter("need > 0")
    known = known.select("head", "relation", F.col("tail").alias("candidate")).distinct()
    excluded = known.join(short.select("head", "relation").distinct(), ["head", "relation"], "left_semi").groupBy("head", "relation").agg(F.count("*").alias("excluded"))
    short = short.join(excluded, ["head", "relation"], "left")
    steps = F.least(F.lit(n), F.col("need") + F.coalesce("excluded", F.lit(0)) + most + 1)
    f = short.filter(F.lit(n) > 0).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)))
    f = f.withColumn("idx", F.pmod(det_index(F.lit(n), seed + "-fill", "qid") + F.col("step"), F.lit(max(n, 1)))).join(at, "idx")
    f = f.filter((F.col("candidate") != F.col("tail")) & ~F.array_contains("others", F.col("candidate"))).join(known, ["head", "relation", "candidate"], "left_anti")
    f = f.withColumn("k", F.row_number().over(Window.partitionBy("qid", *TRIPLE).orderBy("step"))).filter(F.col("k") <= F.col("need"))
    filled = again.withColumn("x", F.lit(None).cast("struct<step:bigint,candidate:string>")).unionByName(f.select("qid", *TRIPLE, "others", F.struct("step", "candidate").alias("x")))
    filled = filled.groupBy("qid", *TRIPLE).agg(F.first("others").alias("others"), F.array_sort(F.collect_list("x"))["candidate"].alias("more"))
    return sets.filter(F.size("others") == need).unionByName(filled.select("qid", *TRIPLE, F.concat("others", "more").alias("others")))


def candidate_sets(queries: DataFrame, known: DataFrame, entities: DataFrame, n_way: int, seed: str = "cand") -> DataFrame:
    """(qid, head, relation, candidate, is_gold): the lists of candidate_lists() and each query's gold tail, one row each."""
    return listed(candidate_lists(queries, known, entities, n_way, seed))


def with_gold(lists: DataFrame) -> DataFrame:
    """(qid, head, relation, tail, c): a query's candidates in its row, an array of (candidate, is_gold)."""
    each = F.concat(F.transform("others", lambda c: F.struct(c.alias("candidate"), F.lit(0).alias("is_gold"))), F.array(F.struct(F.col("tail").alias("candidate"), F.lit(1).alias("is_gold"))))
    return lists.select("qid", *TRIPLE, each.alias("c"))


def listed(lists: DataFrame) -> DataFrame:
    return with_gold(lists).select("qid", "head", "relation", F.explode("c").alias("x")).select("qid", "head", "relation", "x.*")


def relation_candidates(queries: DataFrame, relations: DataFrame, cap: int, seed: str = "relcand") -> DataFrame:
    """(qid, candidate): all relations where there are no more than the cap, else the gold one and others by a hash of the query.

    The names are a catalogue: up to 1,000 go to the driver and become an array that each query orders in its row;
    more raise an error, as candidate_sets() draws from catalogues of any size.
    """
    names = [r[0] for r in relations.select("relation").distinct().orderBy("relation").limit(max(cap, 1000) + 1).collect()]
    if len(names) <= cap:
        return queries.select("qid", F.explode(F.array(*map(F.lit, names))).alias("candidate")) if names else queries.select("qid", F.lit("").alias("candidate")).limit(0)
    if len(names) > 1000:
        raise ValueError("more than 1,000 relations: draw candidates with candidate_sets()")
    every = F.transform(F.array(*map(F.lit, names)), lambda r: F.struct((r != F.col("relation")).alias("other"), det_key(seed, "qid", r).alias("h"), r.alias("r")))
    return queries.select("qid", F.explode(F.transform(F.slice(F.array_sort(every), 1, cap), lambda x: x["r"])).alias("candidate"))


def fingerprint(candidates: DataFrame) -> DataFrame:
    """(n_queries, fingerprint): sums of hashes, so that the order of rows and tasks does not matter."""
    per_query = candidates.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("candidate")), ",").alias("c"))
    number = F.conv(F.substring(F.sha2(F.concat_ws("|", "qid", "c"), 256), 1, 8), 16, 10).cast("long")
    return per_query.agg(F.count("*").alias("n_queries"), F.sum(number).alias("fingerprint"))


def preference_pairs(triples: DataFrame, yes: str, no: str, question: Column) -> DataFrame:
    """Two rows a triple: the true statement and its negative, with the answer to prefer."""
    kinds = F.explode(F.array(F.struct(F.lit("positive").alias("kind"), F.lit(yes).alias("chosen"), F.lit(no).alias("rejected")), F.struct(F.lit("negative").alias("kind"), F.lit(no).alias("chosen"), F.lit(yes).alias("rejected"))))
    return triples.select(*TRIPLE, question.alias("prompt"), kinds.alias("x")).select(*TRIPLE, "prompt", "x.kind", "x.chosen", "x.rejected")


def anonymise(entities: DataFrame) -> DataFrame:
    """(id, text) with the texts entity0, entity1, ... in the order of ids."""
    return with_dense_index(entities.select("id"), "id").select("id", F.concat(F.lit("entity"), F.col("idx").cast("string")).alias("text"))


def permute(entities: DataFrame, seed: str = "perm") -> DataFrame:
    """(id, text) with each entity named after the next one in a ring of hash order: nobody keeps its own row."""
    ring = with_dense_index(entities.select("id", "text").withColumn("_h", det_key(seed, "id")), "_h", "id")
    n = ring.agg(F.count("*")).first()[0]
    after = ring.select(F.pmod(F.col("idx") - 1, F.lit(max(n, 1))).alias("idx"), F.col("text").alias("next"))
    return ring.select("id", "idx").join(after, "idx").select("id", F.col("next").alias("text"))
