"""Features of elements, the ladder of routing levels, and whether cited features decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.text import before_comma, looks_opaque, n_label_words, strip
from graphlens.operators.graph import degrees
from graphlens.operators.metrics import ratio
from graphlens.operators.types import OTHER

# Cost in tokens of each action.
COSTS = {"none": 0, "description_only": 25, "relation_description": 20, "exclusion_list": 40, "typed_neighbours": 60, "full": 145}
LEVELS = ("L0", "L1", "L2", "L3", "L4")


def quality_band(opaque: Column, words: Column, described: Column, ambiguity: Column) -> Column:
    return (
        F.when(opaque | (words == 0), "poor")
        .when((ambiguity > 3) & ~described, "poor")
        .when(described & (words >= 2) & (ambiguity <= 3), "rich")
        .otherwise("moderate")
    )


def degree_percentiles(edges: DataFrame) -> DataFrame:
    """(entity, degree, degree_percentile): share of entities of a smaller degree; degrees are counted before they are ranked."""
    return percentiles(degrees(edges).select("entity", "degree"))


def percentiles(d: DataFrame) -> DataFrame:
    """(entity, degree, degree_percentile) from (entity, degree)."""
    n = d.groupBy("degree").agg(F.count("*").alias("m"))
    below = F.coalesce(F.sum("m").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = n.select("degree", (below / F.sum("m").over(Window.partitionBy())).alias("degree_percentile"))
    return d.join(share, "degree").select("entity", "degree", "degree_percentile")


def element_features(entities: DataFrame, types: DataFrame, edges: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """One row for each entity; those without edges have degree 0 and percentile 0. Edges are not counted again where (entity, degree) is given."""
    text = F.coalesce("text", F.lit(""))
    name = strip(before_comma(text))
    e = entities.select("id", text.alias("text"), name.alias("name"))
    shared = e.groupBy(F.lower(strip(F.col("text"))).alias("_key")).agg(F.count("*").alias("ambiguity"))
    f = e.withColumn("_key", F.lower("name")).join(shared, "_key", "left").drop("_key")
    f = f.join(types.withColumnRenamed("entity", "id"), "id", "left").join((degree_percentiles(edges) if degree is None else percentiles(degree)).withColumnRenamed("entity", "id"), "id", "left")
    f = f.select(
        "id", F.lit("entity").alias("kind"), F.coalesce("type", F.lit(OTHER)).alias("semantic_type"), F.length("name").alias("label_len_chars"),
        F.when(F.col("name") == "", 0).otherwise(F.size(F.split("name", r"\s+"))).alias("label_len_words"), n_label_words(F.col("name")).alias("n_alpha_words"), looks_opaque(F.col("name")).alias("looks_opaque"),
        (F.length("text") > F.length("name") + 3).alias("has_description"), F.greatest(F.lit(0), F.length("text") - F.length("name")).alias("description_len"), F.coalesce("ambiguity", F.lit(1)).cast("long").alias("ambiguity"),
        F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("degree_percentile", F.lit(0.0)).alias("degree_percentile"),
    )
    return f.withColumn("quality_band", quality_band(F.col("looks_opaque"), F.col("n_alpha_words"), F.col("has_description"), F.col("ambiguity")))


def _choice(action: str, *cited: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.array(*[F.lit(c) for c in cited]).cast("array<string>").alias("cited"))


def route(level: str, get=F.col) -> Column:
    """(action, cited features) of an element at a level; get(name) fetches a feature."""
    relation = get("kind") == "relation"
    if level == "L0":
        return _choice("full")
    if level == "L1":
        return F.when(relation, _choice("relation_description", "kind")).otherwise(_choice("description_only", "kind"))
    if level == "L2":
        return F.when(relation, _choice("relation_description", "kind")).when(get("semantic_type") == OTHER, _choice("typed_neighbours", "kind", "semantic_type")).otherwise(_choice("description_only", "kind", "semantic_type"))
    l3 = (
        F.when(relation, _choice("relation_description", "kind"))
        .when(get("looks_opaque"), _choice("typed_neighbours", "kind", "looks_opaque"))
        .when(get("ambiguity") > 3, _choice("typed_neighbours", "kind", "ambiguity"))
        .when(get("has_description") & (get("quality_band") == "rich"), _choice("none", "kind", "has_description", "quality_band"))
        .otherwise(_choice("description_only", "kind", "quality_band"))
    )
    if level == "L3":
        return l3
    pct = get("degree_percentile")
    return (
        F.when((l3["action"] == "none") & (pct < 0.1), _choice("typed_neighbours", "kind", "has_description", "quality_band", "degree_percentile"))
        .when((l3["action"] == "description_only") & (pct > 0.9) & get("has_description"), _choice("none", "kind", "has_description", "degree_percentile"))
        .otherwise(l3)
    )


def cost(action: Column) -> Column:
    return F.coalesce(*[F.when(action == a, F.lit(c)) for a, c in COSTS.items()])


def routed(features: DataFrame, levels=LEVELS) -> DataFrame:
    """(id, level, action, cited, token_cost) at all levels in one pass."""
    every = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), route(x).alias("d")) for x in levels]))
    return features.select("id", every.alias("x")).select("id", "x.level", "x.d.action", "x.d.cited", cost(F.col("x.d.action")).alias("token_cost"))


def plan_summary(plans: DataFrame) -> DataFrame:
    n, spent = F.count("*"), F.sum("token_cost")
    return plans.groupBy("level").agg(n.alias("n_elements"), spent.alias("routed_tokens"), (n * COSTS["full"]).alias("baseline_tokens"), F.avg((F.col("action") == "none").cast("double")).alias("skip_rate"), (1 - spent / (n * COSTS["full"])).alias("savings_rate"))


def action_distribution(plans: DataFrame) -> DataFrame:
    n = plans.groupBy("level", "action").agg(F.count("*").alias("n"))
    return n.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("level"))))


#: What a cited feature is changed to, and from; the quality band is not computed again.
COUNTERFACTUALS = {
    "kind": lambda c: F.when(c == "entity", "relation").otherwise("entity"),
    "semantic_type": lambda c: F.when(c == OTHER, "KNOWN").otherwise(OTHER),
    "looks_opaque": lambda c: ~c,
    "ambiguity": lambda c: F.when(c > 3, 1).otherwise(10).cast("long"),
    "has_description": lambda c: ~c,
    "quality_band": lambda c: F.when(c == "rich", "poor").otherwise("rich"),
    "degree_percentile": lambda c: F.when(c < 0.1, 0.95).when(c > 0.9, 0.05).otherwise(0.95),
}


def faithfulness(features: DataFrame, level: str = "L4") -> DataFrame:
    """(id, action, n_cited, n_flips, verdict): whether changing each cited feature changes the decision."""
    d = features.withColumn("d", route(level))
    flips = F.lit(0)
    for name, change in COUNTERFACTUALS.items():
        changed = route(level, lambda f, name=name, change=change: change(F.col(f)) if f == name else F.col(f))
        flips = flips + F.when(F.array_contains("d.cited", name) & (changed["action"] != F.col("d.action")), 1).otherwise(0)
    d = d.select("id", F.col("d.action").alias("action"), F.size("d.cited").alias("n_cited"), flips.alias("n_flips"))
    return d.withColumn("verdict", F.when(F.col("n_cited") == 0, "none cited").when(F.col("n_flips") == F.col("n_cited"), "faithful").when(F.col("n_flips") > 0, "partially").otherwise("unfaithful"))
