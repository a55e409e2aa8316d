"""Labelled graphs: TSV scans and sinks, the loader, and the canonical graph of the tables."""

from __future__ import annotations

import platform
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.hashing import det_number
from graphlens.functions.ordering import checkpointed
from graphlens.sources.lines import scan_lines

REQUIRED = ("entity2text.txt", "relation2text.txt", "train.tsv", "test.tsv")


def _parts(delimiter: str = "\t"):
    return F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), delimiter)


def scan_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a two-column file; shorter lines are skipped, the last line of an id wins."""
    p = F.split("value", "\t")
    rows = scan_lines(spark, path).filter(F.size(p) >= 2).select("pos", p[0].alias("id"), p[1].alias("text"))
    return rows.groupBy("id").agg(F.max_by("text", "pos").alias("text"))


def scan_triples(spark: SparkSession, path: str, has_label: bool = False, problems: bool = False) -> DataFrame:
    """(pos, head, relation, tail, label): pos counts the lines of three columns or more, others are skipped.

    With problems, pos counts all lines, none is skipped, and a column `problem` says what is wrong with one: short or bad_label.
    """
    p = _parts()
    text = F.get(p, F.lit(3))
    label = text.try_cast("int") if has_label else F.lit(None).cast("int")
    what = F.when(F.size(p) < 3, "short").when(text.isNotNull() & text.try_cast("int").isNull() & F.lit(has_label), "bad_label")
    lines = scan_lines(spark, path, None if problems else F.size(p) >= 3)
    return lines.select("pos", p[0].alias("head"), F.get(p, F.lit(1)).alias("relation"), F.get(p, F.lit(2)).alias("tail"), label.alias("label"), *([what.alias("problem")] if problems else []))


def scan_problems(spark: SparkSession, path: str, columns: int = 3, has_label: bool = False) -> DataFrame:
    """(problem, n): short lines, repeated first columns of a map, labels that are no number."""
    p = _parts()
    rows = spark.read.text(path).select(F.size(p).alias("n"), p[0].alias("key"), F.get(p, F.lit(3)).alias("label"))
    found = rows.agg(
        F.count_if(F.col("n") < columns).alias("short"),
        (F.count("*") - F.count_distinct("key")).alias("repeated_key") if columns == 2 else F.lit(0).cast("long").alias("repeated_key"),
        F.count_if(F.col("label").isNotNull() & F.col("label").try_cast("int").isNull()).alias("bad_label") if has_label else F.lit(0).cast("long").alias("bad_label"),
    )
    return found.unpivot([], ["short", "repeated_key", "bad_label"], "problem", "n")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Tab or comma, whichever the first lines hold more of."""
    head = [r[0] for r in spark.read.text(path).limit(3).collect()]
    return "\t" if sum(x.count("\t") for x in head) >= sum(x.count(",") for x in head) else ","


def convert_delimited(spark: SparkSession, path: str, out: str, delimiter: str | None = None) -> None:
    """Write the first three columns of a file with tabs or commas as a triple file; shorter lines are left out."""
    p = F.transform(F.split("value", delimiter or sniff_delimiter(spark, path)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    spark.read.text(path).filter(F.size(p) >= 3).select(F.array_join(F.slice(p, 1, 3), "\t")).write.text(out)


def _slot() -> Column:
    return F.when((F.col("n_heads") == 1) & (F.col("n_tails") > 1), "tail").when((F.col("n_tails") == 1) & (F.col("n_heads") > 1), "head").otherwise("mixed")


def scan_rankings(triples: DataFrame, n: int) -> DataFrame:
    """Blocks of n consecutive candidate rows: (block, n_rows, n_heads, n_tails, slot); slot: what varies. `pos` has to be dense, as scan_triples() gives it."""
    block = F.floor(F.col("pos") / n).alias("block")
    out = triples.groupBy(block).agg(F.count("*").alias("n_rows"), F.count_distinct("head").alias("n_heads"), F.count_distinct("tail").alias("n_tails"))
    return out.withColumn("slot", _slot())


def ranking_slot(triples: DataFrame, n: int) -> str:
    """What a ranking file varies, from its first block and never from its name: tail, head or mixed."""
    first = scan_rankings(triples.filter(F.col("pos") < n), n).filter(F.col("n_rows") == n).first()
    return first["slot"] if first else "mixed"


def convert_rankings(triples: DataFrame, queries: DataFrame, n: int, slot: str) -> DataFrame:
    """Whole blocks of n candidate rows with the queries of their places: (pos, head, relation, tail, candidates, status).

    A block belongs to its query if every row holds the query's relation and its fixed end, else it is a
    `block_mismatch`; a block without the query's answer is `gold_missing`; else `ok`. Blocks and queries
    without a partner are left out.
    """
    q = queries.select(F.col("pos").alias("block"), F.col("head").alias("q_head"), F.col("relation").alias("q_relation"), F.col("tail").alias("q_tail"))
    fixed, varied = ("head", "tail") if slot == "tail" else ("tail", "head")
    rows = triples.select(F.floor(F.col("pos") / n).alias("block"), "pos", "head", "relation", "tail").join(q, "block")
    own = (F.col(fixed) == F.col(f"q_{fixed}")) & (F.col("relation") == F.col("q_relation"))
    blocks = rows.groupBy("block", "q_head", "q_relation", "q_tail").agg(F.bool_and(own).alias("own"), F.array_sort(F.collect_list(F.struct("pos", varied))).alias("rows")).filter(F.size("rows") == n)
    candidates = F.col(f"rows.{varied}")
    status = F.when(~F.col("own"), "block_mismatch").when(~F.array_contains(candidates, F.col(f"q_{varied}")), "gold_missing").otherwise("ok")
    return blocks.select(F.col("block").alias("pos"), F.col("q_head").alias("head"), F.col("q_relation").alias("relation"), F.col("q_tail").alias("tail"), candidates.alias("candidates"), status.alias("status"))


@dataclass
class Graph:
    name: str
    entities: DataFrame
    relations: DataFrame
    triples: DataFrame  # pos, head, relation, tail, label, split

    def split(self, name: str) -> DataFrame:
        return self.triples.filter(F.col("split") == name)

    def all_true(self) -> DataFrame:
        """All distinct triples, those labelled as false included."""
        return self.triples.select("head", "relation", "tail").distinct()

    def describe(self) -> DataFrame:
        parts = self.triples.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n"))
        ents = self.entities.agg(F.lit("entities").alias("part"), F.count("*").alias("n"))
        return parts.unionByName(ents).unionByName(self.relations.agg(F.lit("relations").alias("part"), F.count("*").alias("n")))


def load_graph(spark: SparkSession, folder: str, name: str = "graph") -> Graph:
    """Read a graph's folder; a missing required file raises, valid.tsv may be missing."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda f: fs_path(f"{folder}/{f}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path(f"{folder}/{f}"))
    if missing := [f for f in REQUIRED if not exists(f)]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    parts = [scan_triples(spark, f"{folder}/{s}.tsv", s == "test").withColumn("split", F.lit(s)) for s in ("train", "valid", "test") if s != "valid" or exists("valid.tsv")]
    triples = parts[0]
    for p in parts[1:]:
        triples = triples.unionByName(p)
    return Graph(name, scan_map(spark, f"{folder}/entity2text.txt"), scan_map(spark, f"{folder}/relation2text.txt"), triples)


def write_tsv(df: DataFrame, path: str, *columns: str) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.text(path)


def _config(config: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in sorted(config.items()) for x in (F.lit(k), F.lit(v))]) if config else F.lit(None).cast("map<string,string>")


def environment(spark: SparkSession) -> dict[str, str]:
    """What a result depends on besides its configuration."""
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "java": spark._jvm.java.lang.System.getProperty("java.version"), "master": spark.sparkContext.master}


def write_results(df: DataFrame, path: str, config: dict[str, str]) -> None:
    """JSON rows that carry the configuration they come from."""
    df.withColumn("config", _config(config)).write.json(path)


def write_result_files(df: DataFrame, path: str, config: dict[str, str], name: str = "run") -> None:
    """One indented JSON document for each value of the column `name`, below a folder of that value, with configuration and environment.

    A row is a run; rows of one name are documents of one file only if they are repeated, which raises.
    """
    if df.groupBy(name).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{name} names more than one result")
    payload = [F.col(c) for c in df.columns if c != name]
    doc = F.to_json(F.struct(_config(config).alias("config"), _config(environment(df.sparkSession)).alias("env"), *payload), {"pretty": "true"})
    df.select(F.col(name), doc.alias("value")).write.partitionBy(name).text(path)


def read_results(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """Rows of result files with the file's name, whether a file holds JSON rows or one indented document; what can't be read is left out.

    A file below a folder `<name>=<value>` is named `<value>.json`. The list of files goes to the driver, as for any scan.
    """
    line = F.try_parse_json(F.col("value"))
    lines = spark.read.option("recursiveFileLookup", "true").text(pattern).filter(F.trim("value") != "")
    kinds = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.bool_or(line.isNotNull() & F.col("value").rlike(r"^\s*\{.*\}\s*$") & (F.length("value") > 2)).alias("rows")).collect()
    out = None
    for rows in (True, False):
        if paths := sorted(r["path"] for r in kinds if r["rows"] == rows):
            read = spark.read.option("columnNameOfCorruptRecord", "_unread")
            df = (read.option("mode", "DROPMALFORMED") if rows else read.option("multiLine", "true").option("mode", "PERMISSIVE")).json([unquote(p) for p in paths])
            path = F.url_decode(F.col("_metadata.file_path"))
            folder = F.regexp_extract(path, "/[^/=]+=([^/]*)/[^/]*$", 1)
            df = df.withColumn("file", F.when(folder != "", F.concat(folder, F.lit(".json"))).otherwise(F.element_at(F.split(path, "/"), -1)))
            if "_unread" in df.columns:
                df = checkpointed(df).filter(F.col("_unread").isNull()).drop("_unread")  # such a column can't be asked for alone before
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], "file string") if out is None else out


# ------------------------------------------------------------- the canonical graph of the tables

RELATIONS = ("isLocatedIn", "isCitizenOf", "basedIn", "placedBy", "contains", "suppliedBy", "supplies", "hasSegment", "hasType", "performs")


def canonical_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head, relation, tail), distinct. Only the many-to-many relations need a shuffle to be so."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def edges(df: DataFrame, relation: str, head, tail, distinct: bool = False) -> DataFrame:
        out = df.select(head.alias("head"), F.lit(relation).alias("relation"), tail.alias("tail"))
        return out.distinct() if distinct else out

    customer, lines = t("customer"), t("lineitem")
    part_of = lines.select("l_partkey", "l_suppkey").distinct()
    out = [
        edges(t("nation"), "isLocatedIn", node("nation", "n_nationkey"), node("region", "n_regionkey")),
        edges(customer, "isCitizenOf", node("customer", "c_custkey"), node("nation", "c_nationkey")),
        edges(t("supplier"), "basedIn", node("supplier", "s_suppkey"), node("nation", "s_nationkey")),
        edges(t("orders"), "placedBy", node("order", "o_orderkey"), node("customer", "o_custkey")),
        edges(lines.select("l_orderkey", "l_partkey").distinct(), "contains", node("order", "l_orderkey"), node("part", "l_partkey")),
        edges(part_of, "suppliedBy", node("part", "l_partkey"), node("supplier", "l_suppkey")),
        edges(part_of, "supplies", node("supplier", "l_suppkey"), node("part", "l_partkey")),
        edges(customer, "hasSegment", node("customer", "c_custkey"), node("segment", "c_mktsegment")),
        edges(t("part"), "hasType", node("part", "p_partkey"), node("ptype", "p_type")),
        edges(t("events").select("user_id", "event_type").distinct(), "performs", node("user", "user_id"), node("etype", "event_type")),
    ]
    triples = out[0]
    for x in out[1:]:
        triples = triples.unionByName(x)
    return triples


def canonical_split(triples: DataFrame) -> DataFrame:
    """Add split: 80 % train, 10 % valid, 10 % test by the hash of the triple."""
    b = det_number("split", "head", "relation", "tail") % 10
    return triples.withColumn("split", F.when(b < 8, "train").when(b == 8, "valid").otherwise("test"))


def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of the entities with a name of their own."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    named = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))
    out = None
    for kind, key, text in named:
        rows = t(kind).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(text).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def canonical_graph(spark: SparkSession, sf_dir: str) -> Graph:
    triples = canonical_split(canonical_triples(spark, sf_dir)).withColumns({"pos": F.lit(None).cast("long"), "label": F.lit(None).cast("int")})
    relations = spark.createDataFrame([(r, r) for r in RELATIONS], "id string, text string")
    return Graph("canonical", canonical_entities(spark, sf_dir), relations, triples)


#: A line that gives a subject its class: with a fact number or without, names in full or short.
TYPE_LINE = r"<(?:[^<>]*/)?([^<>/]+)>\s+(?:rdf:type|<[^<>]*#type>)\s+<(?:[^<>]*/)?([^<>/]+)>"


def type_lines(lines: DataFrame) -> DataFrame:
    """(subject, class) of the lines that have one, whatever their layout; other lines are left out."""
    part = lambda i: F.regexp_extract("line", TYPE_LINE, i)
    return lines.select(part(1).alias("subject"), part(2).alias("class")).filter("subject <> ''")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(parent, file, bytes) of the files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return f.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("parent"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"))
