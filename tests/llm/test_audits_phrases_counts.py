"""Filter audit, collocations and token counts against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from graphlens.llm import collocations, filter_audit, token_counts

DOCS = "doc_id long, text string, lang string, n_tokens string, digest int, part string, mask string, n long"
WORDS = "the of und Haus è straße ß x-1 |".split()


def prose(rng, n, sep=(" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b")):
    return "".join(rng.choice(WORDS) + rng.choice(sep) for _ in range(n))


def table(spark, n=150, seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice((0, 2, 40, 120, 160))), rng.choice(("en", "de", None))) for i in range(n)]
    rows += [(n + i, rows[rng.randrange(n)][1], rng.choice(("en", "fr"))) for i in range(40)]
    rows += [(n + 50, None, "en"), (n + 51, "", None), (None, "", "en"), (None, rows[3][1], "en"), (3, rows[3][1], "en"), (3, rows[3][1], "de"), (4, "ABC def", ""), (n + 60, "A" * 200 + " b" * 150, "en"), (n + 61, prose(rng, 30_000), "de")]
    return spark.createDataFrame([(*r, "s", 1, "p", "m", 2) for r in rows], DOCS), rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11: filter interaction audit


def failed(rows):
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    for doc, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and doc > least[text]}
        yield doc, lang or "", {k for k, v in bad.items() if v}


def brute_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in range(2))
    parts = defaultdict(list)
    for doc, part, bad in failed(rows):
        parts[part].append((doc, bad))
    out = {}
    for part, mine in parts.items():
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("few", [True, False])
def test_audit_is_every_order_run_through(spark, docs, monkeypatch, few):
    if not few:
        monkeypatch.setattr(filter_audit, "BROADCAST_LABELS", 0)
    df, rows = docs
    rng = random.Random(4)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 190, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit.audit(df, spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] == want[r["part"], r["filter_order"], r["step"]], r


def test_audit_edges(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and {r["shapley"] for r in one if r["filter_order"][r["step"] - 1] == "A"} == {120}


def test_polynomial_corners_and_shapley():
    rng = random.Random(1)
    for _ in range(20):
        counts = {m: rng.randrange(5) for m in range(32)}
        poly = filter_audit.polynomial(counts, 5)
        for s in range(32):
            assert filter_audit.corner(poly, s) == sum(n for m, n in counts.items() if m & s)
        assert sum(filter_audit.shapley(poly, i) for i in range(5)) == sum(n for m, n in counts.items() if m)


# 12: collocations


def brute_phrases(rows, least, longest, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    found = defaultdict(list)
    inside = defaultdict(int)
    for (lang, p), v in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], v)
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * inside[lang, p] < 100 * a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, x in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize(("least", "block", "bucket", "top"), [(20, 1 << 24, 1 << 18, 2000), (6, 4_000, 500, 50), (2, 300, 2_000, 10_000)])
def test_collocations_brute_force(docs, least, block, bucket, top):
    df, rows = docs
    got = sorted(tuple(r) for r in collocations.collocations(df.repartition(3), least, top=top, block_bytes=block, bucket_positions=bucket).collect())
    want = brute_phrases(rows, least, 5, top)
    assert got == want and len(want) > 20


def test_collocation_drops_what_a_longer_phrase_holds(spark):
    rows = [(i, "alpha beta gamma. beta delta; zeta" if i % 2 else "alpha beta gamma! eta theta", "en") for i in range(40)]
    got = collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20).collect()
    assert {r["phrase"]: r["a"] for r in got} == {"alpha beta gamma": 40, "beta delta": 20, "eta theta": 20}


def test_collocation_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, n = 10**12, 10**14
    rows = [("en", 1, "x", a), ("en", 1, "y", a + 7), ("en", 2, "x y", a - 1)]
    f = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    n_all = spark.createDataFrame([("en", n)], "lang string, n long")
    real = collocations.frequent
    collocations.frequent = lambda *a, **k: (f, n_all)
    try:
        got = collocations.collocations(f.withColumn("text", F.lit(""))).collect()
    finally:
        collocations.frequent = real
    assert [r["score"] for r in got] == [1000 * (a - 1) * n // (a * (a + 7))]


def test_collocation_edges(spark, empty):
    assert collocations.collocations(empty).count() == 0
    some = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " .,", "en"), (4, "a b", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(some).count() == 0
    assert [tuple(r) for r in collocations.collocations(some, 1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_inverted_lists():
    rng = np.random.default_rng(1)
    for big in (1, 1 << 40):
        codes, positions = rng.integers(0, 5, 60) * big, rng.permutation(60)
        kinds, lengths, lists = collocations.inverted(codes, positions)
        want = [(k, sorted(positions[codes == k].tolist())) for k in sorted(set(codes.tolist()))]
        assert list(zip(kinds.tolist(), [x.tolist() for x in np.split(lists, np.cumsum(lengths)[:-1])], strict=True)) == want


# 13: token counts

HARD = ["", " ", "  a", "a  b", "a \n b", "a\t b", "a\x1c b", "a\x85 b", "a  b", "it's  we'll", "x <|endoftext|> y", "<|endoftext|>", " <|endoftext|>  <|endoftext|>", "\n\n  \n word", "a" * 5000, "日本語 のテキスト", "ß" * 300 + " é", "1 2  3   4", "!! ??   z", "end ", "end  ", "tab\t", "🙂 🙂🙂"]


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_word_counts_are_the_library_s():
    rng = random.Random(2)
    alphabet = ["a", "B", "'s", "é", "1", "!", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1d", " ", "　", "<|endoftext|>", "​", "日"]
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    got = token_counts.counter(token_counts.TOKENIZER)
    assert isinstance(got, token_counts.WordCounter) and got.counts(texts) == library_counts(texts)


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    t = token_counts.WordCounter(lambda texts: [[0] * len(x) for x in texts])
    assert t.counts(["a b c d e", "a b", "x" * 500 + " y", "z a"]) == [9, 3, 502, 3] and max(map(len, t.known)) <= token_counts.LONGEST_REMEMBERED


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(name):
    got = token_counts.counter(name)
    assert isinstance(got, token_counts.TextCounter)
    if name.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path(name))
        assert got.counts(HARD) == [len(s.encode(x)) for x in HARD]
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(token_counts.tokenizer_path(name))
        assert got.counts(HARD) == [len(t.encode(x, add_special_tokens=False).ids) for x in HARD]


@pytest.mark.parametrize("few", [True, False])
def test_counts_and_cache(spark, docs, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    df, rows = docs
    cache = token_counts.TokenCache(spark, str(tmp_path))
    out = token_counts.with_token_counts(df, cache, limit=100)
    assert set(out.columns) == set(df.columns) | {"n_bytes", "over_limit"}
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    want = [(d, len((t or "").encode()), n) for (d, t, _), n in zip(rows, library_counts([t for _, t, _ in rows]), strict=True)]
    assert got == Counter((d, b, n, n > 100) for d, b, n in want)
    texts = {t or "" for _, t, _ in rows}
    stored = {bytes(r["digest"]): r["n_tokens"] for r in cache.read().collect()}
    assert stored.keys() == {hashlib.sha256(t.encode()).digest() for t in texts} and len(cache.appends()) == 1
    token_counts.with_token_counts(df, cache).count()
    assert len(cache.appends()) == 1  # nothing was missing
    more = df.select("doc_id", "text").limit(5).unionByName(spark.createDataFrame([(7000, "new text"), (7001, "new text")], "doc_id long, text string"))
    assert token_counts.with_token_counts(more, cache).filter("doc_id >= 7000").select("n_tokens").distinct().collect()[0][0] == library_counts(["new text"])[0]
    assert [spark.read.parquet(p).count() for p in cache.appends() if p != cache.appends()[0]] in ([1], [len(texts)])  # only the distinct miss


def test_stored_counts_are_used(spark, tmp_path):
    cache = token_counts.TokenCache(spark, str(tmp_path))
    stored = [(hashlib.sha256(b"a b").digest(), 77)]
    for name in ("append=x", "append=y"):  # two runs that stored the same
        spark.createDataFrame(stored, token_counts.COUNTS).write.parquet(f"{cache.path}/{name}")
    spark.createDataFrame([(hashlib.sha256(b"c").digest(), 99)], token_counts.COUNTS).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{cache.path}/append=unfinished")
    got = token_counts.with_token_counts(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (3, None)], "doc_id long, text string"), cache).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(1, 77), (1, 77), (2, 1), (3, 0)]
    assert token_counts.tokenizer_digest("byte_bpe_50k.json") != token_counts.tokenizer_digest("word_bpe_49k.json")


def test_hot_texts_are_spread(spark, tmp_path, monkeypatch):
    rows = [(i, "same text here" if i % 2 else f"text {i}") for i in range(4000)]
    got = token_counts.with_token_counts(spark.createDataFrame(rows, "doc_id long, text string"), token_counts.TokenCache(spark, str(tmp_path))).collect()
    assert len(got) == 4000 and {r["n_tokens"] for r in got if r["doc_id"] % 2} == {3}


def test_count_edges(spark, empty, tmp_path):
    cache = token_counts.TokenCache(spark, str(tmp_path))
    assert token_counts.with_token_counts(empty, cache).count() == 0 and cache.appends() == []
