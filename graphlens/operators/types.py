"""Types of entities: from identifiers, from the graph, and what a type tag gives away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.ordering import checkpointed
from graphlens.functions.text import id_prefix, pos_suffix
from graphlens.operators.graph import first_per_group, incident

OTHER = "OTHER"
VOCABULARY, MIN_ENTITIES = 64, 5


def signatures(edges: DataFrame) -> DataFrame:
    """(entity, degree, sigs): how many edges each entity has, and their relations with sides, an array (m, sig) with the most frequent first, m its negative count."""
    n = incident(edges).groupBy("entity", F.concat_ws("::", "relation", "side").alias("sig")).agg(F.count("*").alias("n"))
    return checkpointed(n.groupBy("entity").agg(F.sum("n").alias("degree"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "sig"))).alias("sigs")))  # an entry a relation and side


def induced_types(edges: DataFrame, vocabulary: int = VOCABULARY, least: int = MIN_ENTITIES) -> DataFrame:
    """(entity, type): the most frequent relation and side of each entity that is in the vocabulary.

    The vocabulary is the `vocabulary` signatures that dominate most entities, less those that
    dominate fewer than `least`. Ties go to the smaller signature.
    """
    return types_of(signatures(edges), vocabulary, least)


def types_of(s: DataFrame, vocabulary: int = VOCABULARY, least: int = MIN_ENTITIES) -> DataFrame:
    """The types of induced_types() from what signatures() gives: each entity's are in its row, so only counts are shuffled."""
    best = s.groupBy(F.get("sigs", F.lit(0))["sig"].alias("sig")).agg(F.count("*").alias("c"))
    top = best.orderBy(F.desc("c"), "sig").limit(vocabulary).filter(F.col("c") >= least)
    names = [r["sig"] for r in top.select("sig").collect()]  # at most `vocabulary`
    typed = F.get(F.filter("sigs", lambda x: x["sig"].isin(names)), F.lit(0))["sig"]
    return s.select("entity", F.coalesce(F.when(F.col("entity").isNotNull(), typed), F.lit(OTHER)).alias("type"))


def types_by_identifier(entities: DataFrame, how: str = "prefix") -> DataFrame:
    found = {"prefix": id_prefix(F.col("id")), "pos": F.coalesce(pos_suffix(F.col("id")), pos_suffix(F.col("text")))}[how]
    return entities.select(F.col("id").alias("entity"), F.coalesce(found, F.lit(OTHER)).alias("type"))


def one_class_each(classes: DataFrame, tier: Column) -> DataFrame:
    """(entity, class) -> one class for each entity: lowest tier, then most frequent overall, then by name."""
    freq = classes.groupBy("class").agg(F.count("*").alias("n"))
    j = classes.join(freq, "class").withColumn("tier", tier)
    return j.groupBy("entity").agg(F.min(F.struct("tier", (-F.col("n")).alias("m"), "class"))["class"].alias("class"))


def type_coverage(types: DataFrame, top: int = 5) -> DataFrame:
    n = types.groupBy("type").agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, top)  # one number for each type
    return n.agg(F.count("*").alias("n_types"), F.sum("n").alias("n_entities"), F.coalesce(F.sum(F.when(F.col("type") == OTHER, F.col("n"))), F.lit(0)).alias("n_other"), F.max("n").alias("largest"), F.aggregate(best, F.lit(0).cast("long"), lambda a, x: a + x).alias("top_sum"))


def modal_tail_types(train: DataFrame, types: DataFrame) -> DataFrame:
    n = train.join(types.withColumnRenamed("entity", "tail"), "tail").groupBy("relation", "type").agg(F.count("*").alias("n"))
    return first_per_group(n, ["relation"], [F.desc("n"), "type"], 1).select("relation", F.col("type").alias("modal"))


def tag_leak(train: DataFrame, labelled: DataFrame, types: DataFrame, *by: str) -> DataFrame:
    """(rule, fires_pos, fires_neg, accuracy, vacuous), also by columns of the labelled triples: how well a type tag alone answers.

    MODAL: the tail's type is its relation's most frequent one in training. RANGE: the tail was seen
    as one. A rule that fires over 98 % or under 2 % in both classes says nothing.
    """
    modal = modal_tail_types(train, types)
    seen = train.select("relation", "tail").distinct().withColumn("in_range", F.lit(1))
    j = labelled.join(types.withColumnRenamed("entity", "tail"), "tail", "left").join(F.broadcast(modal), "relation", "left").join(seen, ["relation", "tail"], "left")
    fires = F.explode(F.array(F.struct(F.lit("MODAL").alias("rule"), F.coalesce(F.col("type") == F.col("modal"), F.lit(False)).alias("fires")), F.struct(F.lit("RANGE").alias("rule"), F.col("in_range").isNotNull().alias("fires"))))
    r = j.select(*by, "label", fires.alias("x")).select(*by, "label", "x.rule", "x.fires")
    true = F.col("label") == 1
    out = r.groupBy(*by, "rule").agg(F.avg(F.when(true, F.col("fires").cast("double"))).alias("fires_pos"), F.avg(F.when(~true, F.col("fires").cast("double"))).alias("fires_neg"), F.avg((F.col("fires") == true).cast("double")).alias("accuracy"))
    flat = lambda lo, hi: F.coalesce((F.col("fires_pos") > hi) & (F.col("fires_neg") > hi) | (F.col("fires_pos") < lo) & (F.col("fires_neg") < lo), F.lit(True))
    out = out.withColumn("vacuous", flat(0.02, 0.98))
    return out.withColumn("verdict", F.when(F.col("vacuous"), "vacuous").when(F.col("accuracy") < 0.55, "clean").when(F.col("accuracy") < 0.75, "material").otherwise("leak"))
