"""The pipeline: every stage on what the one before kept, against plain rules."""

import random
import re

import pytest
from test_operators import WORDS, crc, gram_words, near_by_hand, plain_spans, prose

import corpus_pipeline
from graphlens.llm import mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = []
    for i in range(200):
        text = prose(rng, rng.choice((5, 30, 60)))
        if i % 10 == 5:
            text = rows[i - 3][1] + (" extra" if i % 20 == 5 else "")
        if i % 13 == 2:
            text += " write to a.b@mail.example.com or +1 (377) 555-0271"
        if i % 17 == 3:
            text = prose(rng, 13)
        rows.append((i, text, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "12 34 -- !", "en", "b", 10)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    items = [(1, rows[3][1]), (2, rows[20][1]), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages(spark, folder):
    sf, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = out.collect()
        seen.append(name)
        if len(seen) < 5:
            assert out.columns == columns
        if len(seen) == 1:
            assert {r["doc_id"] for r in rows} == {i for i, t in before.items() if t and re.search(r"[^\W\d_]", t)} and 302 in before
        elif len(seen) == 2:
            assert {r["doc_id"] for r in rows} == {d for d, _, c in near_by_hand(list(before.items())) if d == c}
        elif len(seen) == 3:
            windows = {tuple(w[a : a + 13]) if len(w) >= 13 else tuple(w) for _, t in items for w in [gram_words(t)] if w for a in range(max(1, len(w) - 12))}

            def dirty(text):
                w, hit = gram_words(text), set()
                for n in {len(k) for k in windows}:
                    for a in range(len(w) - n + 1):
                        if tuple(w[a : a + n]) in windows:
                            hit |= set(range(a, a + n))
                return bool(hit) and 20 * len(hit) >= len(w)

            assert {r["doc_id"] for r in rows} == {i for i, t in before.items() if not dirty(t)} and len(rows) < len(before)
        elif len(seen) == 4:
            assert {r["doc_id"] for r in rows} == set(before) and not any(plain_spans(r["text"]) for r in rows)
            assert all(r["text"] == before[r["doc_id"]] for r in rows if not plain_spans(before[r["doc_id"]])) and any("[EMAIL]" in r["text"] for r in rows)
        else:
            want = {r["doc_id"]: r["copies"] for r in mixing.with_copies(docs).collect()}
            assert {r["doc_id"]: sum(x["doc_id"] == r["doc_id"] for x in rows) for r in rows} == {i: n for i, n in want.items() if n}
        docs = out
    assert len(seen) == 5


def test_run_gives_what_the_stages_give(spark, folder):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert crc(1, 3) in (0, 1, 2) and WORDS


def test_extra_columns_with_clashing_names(spark, folder, tmp_path):
    """More columns in documents come through every stage with their values, whatever their names."""
    from pyspark.sql import functions as F

    sf, _ = folder
    more = ("score", "n_hit", "size", "copies", "target", "_doc", "_source", "component_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in more])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    plain = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in more)
