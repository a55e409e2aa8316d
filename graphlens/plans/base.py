"""What the queries start from, as frames and as the same tables in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.hashing import det_key, unit
from graphlens.functions.ordering import with_dense_index
from graphlens.operators.sampling import TRIPLE
from graphlens.sources.kg import canonical_entities, canonical_split, canonical_triples

#: Queries of the grids: how many candidates, and the tries of a test negative.
N_WAY, TRIES = 10, 8


_kept: dict[tuple[str, str], DataFrame] = {}


def graph_of(spark: SparkSession, sf: str) -> DataFrame:
    """The split graph, persisted: a query reads it several times, and making it takes a shuffle for each many-to-many relation."""
    key = (spark.sparkContext.applicationId, sf)
    df = _kept.get(key)
    if df is None:
        for other in _kept.values():  # one graph at a time
            other.unpersist()
        _kept.clear()
        df = _kept[key] = canonical_split(canonical_triples(spark, sf))
    if not df.storageLevel.useMemory:
        df.persist()
    return df


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """All triples, from the sources: no split is drawn and nothing is cached for them."""
    return canonical_triples(spark, sf)


def split(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return graph_of(spark, sf).filter(F.col("split") == name).drop("split")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_entities(spark, sf)


def with_qid(df: DataFrame) -> DataFrame:
    return df.withColumn("qid", F.substring(det_key("qid", *TRIPLE), 1, 16))


def corrupted(test: DataFrame, train: DataFrame) -> DataFrame:
    """The test triples, and each once more with the tail of the next triple in the order of a hash: label -1."""
    ring = with_dense_index(test.select(*TRIPLE).withColumn("h", det_key("corrupt", *TRIPLE)), "h")
    n = ring.count()
    nxt = ring.select(F.pmod(F.col("idx") - 1, F.lit(max(n, 1))).alias("idx"), F.col("tail").alias("new"))
    neg = ring.join(nxt, "idx").filter(F.col("new") != F.col("tail")).select("head", "relation", F.col("new").alias("tail"), F.lit(-1).alias("label"))
    pos = test.select(*TRIPLE, F.lit(1).alias("label"))
    return pos.unionByName(neg)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return corrupted(split(spark, sf, "test"), split(spark, sf, "train"))


def scored(spark: SparkSession, sf: str, salt: str = "score") -> DataFrame:
    """Labelled test triples with a score that leans to the truth; also conf and correct."""
    df = labelled(spark, sf)
    p = F.lit(0.6) * unit(salt, *TRIPLE) + F.lit(0.4) * (F.col("label") == 1).cast("double")
    df = df.withColumn("p_yes", p)
    right = ((F.col("p_yes") >= 0.5) == (F.col("label") == 1)).cast("int")
    return with_qid(df).withColumns({"conf": F.greatest(F.col("p_yes"), 1 - F.col("p_yes")), "correct": right, "id": F.concat_ws("|", "head", "relation", "tail", "label")})


# ---------------------------------------------------------------- the same in SQL

_NUMBER = "('0x' || substr(sha256(concat_ws('|', {})), 1, 15))::BIGINT"


def number(seed: str, *parts: str) -> str:
    return _NUMBER.format(", ".join([f"'{seed}'", *parts]))


def key(seed: str, *parts: str) -> str:
    return f"sha256(concat_ws('|', '{seed}', {', '.join(parts)}))"


T = ("head", "relation", "tail")
U = "(CAST({} % 10000 AS DOUBLE) / 10000.0::DOUBLE)"

CTES = {
    "triples": """SELECT 'nation:' || n_nationkey AS head, 'isLocatedIn' AS relation, 'region:' || n_regionkey AS tail FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'isCitizenOf', 'nation:' || c_nationkey FROM customer
      UNION ALL SELECT 'supplier:' || s_suppkey, 'basedIn', 'nation:' || s_nationkey FROM supplier
      UNION ALL SELECT 'order:' || o_orderkey, 'placedBy', 'customer:' || o_custkey FROM orders
      UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'contains', 'part:' || l_partkey FROM lineitem
      UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'suppliedBy', 'supplier:' || l_suppkey FROM lineitem
      UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'supplies', 'part:' || l_partkey FROM lineitem
      UNION ALL SELECT 'customer:' || c_custkey, 'hasSegment', 'segment:' || c_mktsegment FROM customer
      UNION ALL SELECT 'part:' || p_partkey, 'hasType', 'ptype:' || p_type FROM part
      UNION ALL SELECT DISTINCT 'user:' || user_id, 'performs', 'etype:' || event_type FROM events""",
    "kg": f"SELECT *, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, {number('split', *T)} % 10 AS b FROM triples)",
    "train": "SELECT head, relation, tail FROM kg WHERE split = 'train'",
    "valid": "SELECT head, relation, tail FROM kg WHERE split = 'valid'",
    "test": "SELECT head, relation, tail FROM kg WHERE split = 'test'",
    "entities": """SELECT 'region:' || r_regionkey AS id, r_name AS text FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'part:' || p_partkey, p_name FROM part""",
    "incident": "SELECT relation, head AS entity, tail AS other, 'out' AS side FROM triples UNION ALL SELECT relation, tail, head, 'in' FROM triples",
    "ring": f"SELECT *, row_number() OVER (ORDER BY {key('corrupt', *T)}) AS k FROM test",
    "labelled": """SELECT head, relation, tail, 1 AS label FROM test UNION ALL
      SELECT a.head, a.relation, b.tail, -1 FROM ring a JOIN ring b ON b.k = a.k % (SELECT count(*) FROM ring) + 1 WHERE a.tail <> b.tail""",
    "scored0": f"SELECT *, 0.6::DOUBLE * {U.format(number('score', *T))} + 0.4::DOUBLE * CAST(label = 1 AS DOUBLE) AS p_yes FROM labelled",
    "scored": f"SELECT *, substr({key('qid', *T)}, 1, 16) AS qid, greatest(p_yes, 1 - p_yes) AS conf, CAST((p_yes >= 0.5) = (label = 1) AS INTEGER) AS correct, concat_ws('|', head, relation, tail, label) AS id FROM scored0",
    "ents": "SELECT DISTINCT head AS entity FROM triples UNION SELECT DISTINCT tail FROM triples",
    "eidx": "SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS idx FROM ents",
    "queries": f"SELECT *, substr({key('qid', *T)}, 1, 16) AS qid FROM test",
    "draws": f"SELECT q.*, d.draw, {number('cand', 'qid', 'CAST(d.draw AS VARCHAR)')} % (SELECT count(*) FROM eidx) AS idx FROM queries q, (SELECT unnest(range(0, {2 * N_WAY})) AS draw) d",
    "drawn": "SELECT qid, head, relation, tail, entity AS candidate, min(draw) AS draw FROM draws JOIN eidx USING (idx) GROUP BY ALL",
    "others": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY draw) AS k FROM drawn d WHERE candidate <> tail AND NOT EXISTS (SELECT 1 FROM triples t WHERE t.head = d.head AND t.relation = d.relation AND t.tail = d.candidate)",
    "shorts": f"SELECT q.*, {N_WAY - 1} - coalesce(o.c, 0) AS need, coalesce(x.c, 0) AS excluded, {number('cand-fill', 'qid')} % (SELECT count(*) FROM eidx) AS start FROM queries q LEFT JOIN (SELECT qid, count(*) AS c FROM others WHERE k < {N_WAY} GROUP BY qid) o USING (qid) LEFT JOIN (SELECT head, relation, count(*) AS c FROM triples GROUP BY ALL) x USING (head, relation) WHERE coalesce(o.c, 0) < {N_WAY - 1}",
    "fillers": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY step) AS k FROM (SELECT f.*, e.entity AS candidate FROM (SELECT *, unnest(range(0, least((SELECT count(*) FROM eidx), need + excluded + {2 * N_WAY} + 1))) AS step FROM shorts) f JOIN eidx e ON e.idx = (f.start + f.step) % (SELECT count(*) FROM eidx)) r WHERE candidate <> tail AND NOT EXISTS (SELECT 1 FROM triples t WHERE t.head = r.head AND t.relation = r.relation AND t.tail = r.candidate) AND NOT EXISTS (SELECT 1 FROM others o WHERE o.k < {N_WAY} AND o.qid = r.qid AND o.candidate = r.candidate)",
    "candidates": f"SELECT qid, head, relation, candidate, 0 AS is_gold FROM others WHERE k < {N_WAY} UNION ALL SELECT qid, head, relation, candidate, 0 FROM fillers WHERE k <= need UNION ALL SELECT qid, head, relation, tail, 1 FROM queries",
    "cscored": f"SELECT *, 0.6::DOUBLE * {U.format(number('rank', 'head', 'relation', 'candidate'))} + 0.4::DOUBLE * is_gold AS score FROM candidates",
    "ranks": "SELECT qid, relation, rank, n_way FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, candidate) AS rank, count(*) OVER (PARTITION BY qid) AS n_way FROM cscored) WHERE is_gold = 1",
    "degrees": "SELECT entity, count(*) FILTER (side = 'in') AS n_in, count(*) FILTER (side = 'out') AS n_out, count(*) AS degree FROM incident GROUP BY entity",
    "sigs": "SELECT entity, relation || '::' || side AS sig, count(*) AS n FROM incident GROUP BY ALL",
    "bestsig": "SELECT entity, sig FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, sig) AS r FROM sigs) WHERE r = 1",
    "topsig": "SELECT sig FROM (SELECT sig, count(*) AS c FROM bestsig GROUP BY sig ORDER BY c DESC, sig LIMIT 64) WHERE c >= 5",
    "types": "SELECT b.entity, coalesce(t.sig, 'OTHER') AS type FROM bestsig b LEFT JOIN (SELECT entity, sig FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, sig) AS r FROM sigs WHERE sig IN (SELECT sig FROM topsig)) WHERE r = 1) t USING (entity)",
    "features0": r"""SELECT id, coalesce(text, '') AS text, regexp_replace(split_part(coalesce(text, ''), ',', 1), '^\s+|\s+$', '', 'g') AS name FROM entities""",
    "amb": r"SELECT lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS k, count(*) AS a FROM features0 GROUP BY 1",
    "features1": r"""SELECT f.id, 'entity' AS kind, coalesce(t.type, 'OTHER') AS semantic_type, length(name) AS label_len_chars,
      CASE WHEN name = '' THEN 0 ELSE len(regexp_split_to_array(name, '\s+')) END AS label_len_words, len(regexp_extract_all(name, '[A-Za-z]{3,}')) AS n_alpha_words,
      regexp_matches(name, '^[^A-Za-z0-9]*(?:[A-Za-z]{0,3}[^A-Za-z0-9]*[0-9]|[0-9])') OR len(regexp_extract_all(name, '[A-Za-z]{3,}')) = 0 AS looks_opaque,
      length(text) > length(name) + 3 AS has_description, greatest(0, length(text) - length(name)) AS description_len, coalesce(a, 1) AS ambiguity, coalesce(d.degree, 0) AS degree,
      coalesce((SELECT count(*) FROM degrees x WHERE x.degree < d.degree) / (SELECT CAST(count(*) AS DOUBLE) FROM degrees), 0) AS degree_percentile
      FROM features0 f LEFT JOIN types t ON t.entity = f.id LEFT JOIN degrees d ON d.entity = f.id LEFT JOIN amb ON amb.k = lower(f.name)""",
    "features": """SELECT *, CASE WHEN looks_opaque OR n_alpha_words = 0 THEN 'poor' WHEN ambiguity > 3 AND NOT has_description THEN 'poor' WHEN has_description AND n_alpha_words >= 2 AND ambiguity <= 3 THEN 'rich' ELSE 'moderate' END AS quality_band FROM features1""",
}



#: Tables that are dear to make and read several times.
DEAR = ("triples", "kg", "train", "test", "ring", "labelled", "eidx", "drawn", "others", "candidates", "cscored")


def _named(name: str, body: str) -> bool:
    return bool(re.search(rf"(?<!')\b{name}\b(?!')", body))


NEEDS = {name: [n for n in CTES if n != name and _named(n, body)] for name, body in CTES.items()}


def sql(body: str) -> str:
    """The query with the tables it names put before it, each after those it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            if n not in order:
                add(n)
        if name not in order:
            order.append(name)

    for name in CTES:
        if _named(name, body):
            add(name)
    own = body.strip()
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in DEAR else ''}({CTES[n]})" for n in order)
    if not order:
        return own
    return f"WITH {head},\n{own[5:]}" if own.upper().startswith("WITH ") else f"WITH {head}\n{own}"
