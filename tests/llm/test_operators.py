"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphlens.llm import components, decontam, dedup_suffix, html_extract, language_id, lm_score, mixing, near_dup, pii, quality, topk

WORDS = [f"{a}{b}{c}" for a in ("lo", "mi", "Ta", "é") for b in ("ra", "no", "ß", "ti") for c in ("", "n", "sk")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, key int, copies int, pii string, n_hit long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice((1, 3, 30, 80)))
        if i % 7 == 3 and i > 20:
            base = rows[i - 11][1] or ""
            text = base if i % 2 else base + " nova"
        if i % 9 == 4:
            text += " a.b@mail.example.com 4111 1111 1111 1111 +1 (377) 555-0271 10.0.0.1 999.1.1.1 GB82WEST12345698765432"
        rows.append((i, text, rng.choice(("en", "fr", None)), rng.choice(("a", "b", "é", None))))
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n", "en", "b"), (n + 3, "1 2 ... !", None, "a"), (None, "lone row", "en", "a"), (5, rows[5][1], "en", "a"), (6, "other text for six", "fr", None), (n + 4, prose(rng, 40_000), "en", "a"), (n + 5, "x" * 30_000, "en", "a"), (n + 6, "one", "en", "b"), (n + 7, "one", "en", "b")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1.0, "s", 7, 2, "p", 3) for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def crc(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


# 1: HTML extraction


def test_html_pages():
    model = html_extract.train()
    page = '<html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/x>menu</a></ul></nav><div class="ad">Buy now.</div><article><h1>Head &amp; line</h1><p>First   text\nof it.<p><b>Second, longer text of the page.<br>Same block</article><div id="comments"><p>I liked it.</p></div><footer>&copy; x</footer>'
    assert html_extract.main_text(page, model) == "Head & line First text of it. Second, longer text of the page. Same block"


@pytest.mark.parametrize(("page", "text"), [
    ("<nav><a href=/>Home</a></nav><article><header><h1>The title</h1></header><p>The first paragraph of this article is here for the reader.</p><p>Another one follows it.</p></article><footer>x</footer>", "The title The first paragraph of this article is here for the reader. Another one follows it."),
    ("<nav><a href=/>Home</a><a href=/b>News</a></nav><h1>The title</h1><p>The first paragraph of this page is rather long and has many words, so that nobody can doubt that it is text.</p><p>More text.</p><footer>All rights reserved</footer>", "The title The first paragraph of this page is rather long and has many words, so that nobody can doubt that it is text. More text."),
    ('<nav><a href=/>Home</a></nav><article><h1>T one</h1><p>The first paragraph of this article.</p><div class="read-more"><p>And here is the rest of the text, which one reads after a click.</p></div></article><footer>x</footer>', "T one The first paragraph of this article. And here is the rest of the text, which one reads after a click."),
    ('<body><header><h1>Site name</h1></header><main><h1>Title</h1><p>Text here it is.</p><div class="more-stories"><ul><li><a href=/1>One story</a><li><a href=/2>Two story</a></ul></div></main></body>', "Title Text here it is."),
    ('<div id="header"><p>Daily paper</p></div><div class="menu"><a href=/a>One</a> <a href=/b>Two</a></div><div class="post"><h2>A day out</h2><p>We went to the sea &amp; came back.</p><ul><li>bread</li><li>salt</li></ul></div><div class="sidebar"><p>Most read today and every day.</p></div><div id="disqus"><p>Nice post, thank you for it.</p></div>', "A day out We went to the sea & came back. bread salt"),
    ('<main><section><h2>Part</h2><p>Some words are said here, and then some more.</p></section><form><label>Mail</label><button>Send</button></form></main><div class="cookie-banner"><p>We use cookies on this site.</p></div>', "Part Some words are said here, and then some more."),
])
def test_html_layouts(page, text):
    assert html_extract.main_text(page, html_extract.train()) == text


@pytest.mark.parametrize(("page", "text"), [
    ('<div class="post-header-image-on"><article><h1>T</h1><p>One text here.</p></article></div>', "T One text here."),
    ('<div class="story-header-wrap"><div class="story"><h1>T</h1><p>One text here.</p><p>More of it.</p></div></div>', "T One text here. More of it."),
    ('<article class="post popular-science"><h1>T one</h1><p>First of it is here.</p><p>Second of it.</p></article>', "T one First of it is here. Second of it."),
    ('<article><h1>T one</h1><p>First of it is here.</p><div class="entry-comments"><p>I liked it very much.</p><p>Me too.</p></div></article>', "T one First of it is here."),
    ('<article><div class="banner"><h1>The title</h1></div><p>First of it is here.</p></article>', "The title First of it is here."),
    ('<article><h1>T</h1><p>Text one.</p><div class="post-share"><a href=x>Share</a></div><div class="article-footer"><p>Filed under stuff</p></div></article>', "T Text one."),
    ('<main><article><h1>T</h1><p>Text one.</p></article><section id="comments"><article class="comment"><div class="comment-body"><p>Nice text, friend.</p></div></article></section></main>', "T Text one."),
    ('<body class="has-sidebar"><div id="wrapper" class="has-sidebar"><div id="content"><h1>T</h1><p>Text one is this.</p><p>And two.</p></div><div id="sidebar"><div class="content"><p>Old stuff of the year that was.</p></div></div></div></body>', "T Text one is this. And two."),
    ('<div class="container"><div class="header"><div class="container"><p>Daily paper</p></div></div><div class="article-body"><p>Text one is this.</p></div></div>', "Text one is this."),
])
def test_html_places_of_hints(page, text):
    assert html_extract.main_text(page, html_extract.train()) == text


def test_html_an_article_is_never_empty():
    """Whatever wraps an <article> that is not a list of comments, links or teasers, and whatever its own classes say."""
    model = html_extract.train()
    words = [w for g in ("head", "foot", "ad", "nav", "side", "related", "share", "notice", "form", "meta") for w in html_extract.HINTS[g].split()]
    lost = []
    for w in words:
        for around, own in ((f"post-{w}-on", ""), (f"has-{w}", ""), (f"story-{w}-wrap", ""), ("", f"post {w}-stuff"), ("", f"post tag-{w}")):
            page = f'<div class="{around}"><article class="{own}"><h1>Title of it</h1><p>The first paragraph is here, for all who read.</p><p>Another one.</p></article></div>'
            if html_extract.main_text(page, model) != "Title of it The first paragraph is here, for all who read. Another one.":
                lost.append((around, own))
    assert not lost


def test_html_gradient_brute_force():
    """Differences of the log likelihood, summed over all paths of a page."""
    rng = np.random.default_rng(3)
    pages = [[(rng.choice(list("abcd"), rng.integers(1, 4), replace=False).tolist(), int(rng.integers(2))) for _ in range(k)] for k in (1, 3, 4)]
    names, rows, cols, y = html_extract.design(pages)
    w, trans = rng.normal(size=len(names)), rng.normal(size=(2, 2))

    def likelihood(w, trans):
        out = 0.0
        for p in pages:
            value = lambda s: sum(sum(w[names[f]] for f in fs) for (fs, _), x in zip(p, s) if x) + sum(trans[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
            out += value([x for _, x in p]) - np.logaddexp.reduce([value([i >> k & 1 for k in range(len(p))]) for i in range(1 << len(p))])
        return out

    grad_w, grad_t = html_extract.gradient(w, trans, rows, cols, y)
    for value, grad in ((w, grad_w), (trans, grad_t)):
        for at in np.ndindex(value.shape):
            old = value[at]
            value[at] = old + 1e-6
            up = likelihood(w, trans)
            value[at] = old - 1e-6
            down = likelihood(w, trans)
            value[at] = old
            assert math.isclose((up - down) / 2e-6, grad[at], abs_tol=1e-6)


def test_html_held_out_blocks():
    weights, trans = html_extract.train()
    seen = wrong = 0
    for page in html_extract.labelled_pages(150, 5):
        states = html_extract.viterbi([sum(weights.get(f, 0) for f in fs) for fs, _ in page], trans)
        seen += len(page)
        wrong += sum(s != label for s, (_, label) in zip(states, page, strict=True))
    assert wrong < 0.01 * seen


def test_viterbi_is_the_best_path():
    rng = random.Random(2)
    for _ in range(50):
        u, t = [rng.gauss(0, 2) for _ in range(rng.randint(1, 7))], tuple(rng.gauss(0, 1) for _ in range(4))
        value = lambda s: sum(x for x, y in zip(u, s) if y) + sum(t[2 * a + b] for a, b in zip(s, s[1:]))  # noqa: E731, B023
        paths = [[i >> k & 1 for k in range(len(u))] for i in range(1 << len(u))]
        assert math.isclose(value(html_extract.viterbi(u, t)), max(map(value, paths)))


def test_html_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "a < b"), (4, "u", "a < b"), (None, "u", "<b>" * 3000 + "x"), (5, "u", "<!-- <p>x"), (6, "u", "<article><p>" + "long text here. " * 20_000 + "</p></article>")]
    got = html_extract.extract(spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows) and got[0]["text"] == "" and got[1]["n_chars"] == 0 and got[7]["n_chars"] == len(("long text here. " * 20_000).strip())
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2: language identification


def test_language_held_out(spark, tmp_path):
    rng = random.Random(3)
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "éßüghi"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[x]) for _ in range(5)) for _ in range(12)), x) for i in range(300) for x in [rng.choice(list(alphabets))]]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 -- 3", "bb"), (903, rows[0][1], None), (904, "abcd " * 300_000, None)]
    got = language_id.with_language(spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, score double")).collect()
    held = [r for r in got if crc(r["doc_id"], 3) == 1 and r["doc_id"] < 900]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    at = {r["doc_id"]: r for r in got}
    assert [at[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and at[900]["score"] == 0 and at[904]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_brute_force(docs):
    langs, model = language_id.train(docs)
    train = [r for r in docs.collect() if r["text"] is not None and r["lang"] is not None and crc(r["doc_id"], 3) != 1]
    assert langs == sorted({r["lang"] for r in train})
    counts = Counter(g for r in train if r["lang"] == "fr" for p in language_id.pieces(r["text"]) for g in language_id.grams(p).tolist())
    total = sum(counts.values()) + language_id.SMOOTHING * language_id.BUCKETS
    some = counts.most_common(5) + [(next(b for b in range(language_id.BUCKETS) if b not in counts), 0)]
    for bucket, n in some:
        assert math.isclose(model[langs.index("fr"), bucket], math.log((n + language_id.SMOOTHING) / total))


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_language_pieces_lose_no_gram(chunk):
    text = "Eins, zwei -- drei 4 vier;;fünf  \tsechs!"
    whole = Counter(language_id.grams(" " + language_id.GAP.sub(" ", text.lower()) + "  ").tolist())
    assert sum((Counter(language_id.grams(p).tolist()) for p in language_id.pieces(text, chunk)), Counter()) == whole


def test_language_scores_brute_force(docs):
    langs, model = language_id.train(docs)
    texts = [r["text"] for r in docs.collect()]
    pred, score = language_id.score_texts(texts, langs, model)
    for text, p, s in zip(texts, pred, score, strict=True):
        if not text or not re.search(r"[^\W\d_]", text):
            assert (p, s) == ("und", 0.0)
            continue
        g = language_id.grams(" " + language_id.GAP.sub(" ", text.lower()) + "  ").tolist()
        z = [float(row[language_id.BUCKETS]) + math.fsum(row[b] for b in g) for row in model]
        assert p == langs[z.index(max(z))] and math.isclose(s, 1 / sum(math.exp(x - max(z)) for x in z), rel_tol=1e-6)


CLASH = ["lang_pred", "score", "n_hit", "n_words", "items", "contaminated", "size", "source_size", "target", "copies", "_source", "_doc", "_key", "_text", "pii", "quality", "draw", "component_id"]


def test_clashing_columns_keep_their_values(spark, docs):
    """The operators that keep rows or multiply them leave every other column as it is."""
    from pyspark.sql import functions as F

    base = docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(c + " "), F.xxhash64("text").cast("string")).alias(c) for c in CLASH])
    rows = Counter(tuple(r) for r in base.collect())
    bench = spark.createDataFrame([(1, rows.most_common(1)[0][0][1] or "x")], "item_id long, text string")
    for out in (language_id.reject(base), decontam.decontaminate(base, bench), near_dup.deduplicate(base)):
        assert out.columns == base.columns and not Counter(tuple(r) for r in out.collect()) - rows
    assert pii.redact(base).select(*CLASH).exceptAll(base.select(*CLASH)).count() == 0
    mixed = mixing.mix(base.withColumn("copy", F.lit("mine")))
    assert mixed.columns == [*base.columns, "copy"] and {tuple(r)[:-1] for r in mixed.collect()} <= set(rows)
    assert pii.find(base).drop("pii").exceptAll(base.drop("pii")).count() == 0


def test_language_without_rows_or_labels(spark, empty):
    assert language_id.with_language(empty).count() == 0
    bare = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.with_language(bare).first()["lang_pred"] == "und"
    assert language_id.reject(bare).columns == bare.columns


# 3: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def confirmed(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def plain_spans(text):
    return sorted((m.start(), r, k, m.end()) for r, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if confirmed(k, m[0]))


def test_pii_brute_force(spark, docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice("01239 -+.@aZé().\n%") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["1.2.3.4.5.6.7.8", "a@b.c+x@y.z", "a@b.c@d.e", "+1 23456789 0.", "1" * 20_000, "a" * 20_000, "+1" + "." * 20_000, "a@b" + ".c" * 10_000, " a@b.c" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in pii.find(df).collect():
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["pii"] if s["rank"] < 4] == plain_spans(r["text"])


def test_pii_iban_context_and_redaction(spark, docs, empty):
    df = spark.createDataFrame([(1, "my iban GB82WEST12345698765432 not GB83WEST12345698765432"), (2, None), (3, "call +1 (377) 555-0271 or a@b.example é")], "doc_id long, text string")
    found = {r["doc_id"]: r["pii"] for r in pii.find(df).collect()}
    assert [(s["kind"], s["start"], s["score"]) for s in found[1]] == [("iban", 8, 1.0)] and found[2] == []
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["my iban [IBAN] not GB83WEST12345698765432", None, "call [PHONE] or [EMAIL] é"]
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("n_chars <> length(text)").count() == 0
    assert pii.find(empty).count() == 0


# 4: exact top-k


def test_topk_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-0.5, 0.25, 0.1, 1.0)) for _ in range(4)]) for i in range(400)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0]), (1100, [1.0, float("nan"), 0.0, 0.0]), (1150, [1.0, float("inf"), 0.0, 0.0]), (1200, [0.5]), (1201, [0.5]), (1250, []), (None, [1.0] * 4), (50, rows[50][1]), (7, rows[7][1]), (1300, [1e18, -1e18, 1e18, 1.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int")
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in use if i % 50 == 0}):
        v = min(v for i, v in use if i == q)
        best = sorted((-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63) + 1), i) for i, w in use if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = sorted(tuple(r) for r in topk.search(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == want


def test_topk_plan_is_bounded(spark, monkeypatch):
    for blocks, shards in ((1, 1), (3, 8), (10**4, 10**4), (1, 10**7), (10**6, 400)):
        n, partitions = topk.pair_plan(blocks, shards)
        assert 1 <= n <= shards and 1 <= partitions <= topk.MAX_PARTITIONS and partitions <= blocks * n
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)], "vec_id long, embedding array<double>")
    once = sorted(topk.search(df, df.filter("vec_id % 50 = 0")).collect())
    monkeypatch.setattr(topk, "MAX_PARTITIONS", 4)  # several pairs in a task
    assert sorted(topk.search(df, df.filter("vec_id % 50 = 0"), block_bytes=64, shard_bytes=64).collect()) == once


def test_decontamination_of_string_ids(spark):
    long = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([("b", long), ("a", long), ("c", "two words"), (None, "one")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, "has two words here"), (3, "one"), (4, "none at all"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], sorted(r["items"])) for r in decontam.with_contamination(docs, bench).collect()}
    assert got == {1: (20, ["a", "b"]), 2: (2, ["c"]), 3: (1, []), 4: (0, []), 5: (0, [])}


def test_near_duplicates_just_above_the_bound(spark):
    """Pairs of similarity 0.80 to 0.83, each in words of its own: the forest and its sketches lose none of them."""
    rng, rows, want = random.Random(6), [], []
    for i in range(400):
        base = [f"p{i}w{k}" for k in range(rng.randint(60, 140))]
        other = list(base)
        a = set(zip(base, base[1:], strict=False))
        while True:
            k = rng.randrange(len(other))
            tried = [*other[:k], f"q{i}x{rng.random()}", *other[k + 1 :]]
            b = set(zip(tried, tried[1:], strict=False))
            if 100 * len(a & b) < 80 * len(a | b):
                break
            other = tried
        b = set(zip(other, other[1:], strict=False))
        if 100 * len(a & b) <= 83 * len(a | b):
            rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
            want.append(2 * i)
    kept = {r["doc_id"] for r in near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 250 and kept == set(want)


def test_topk_in_blocks_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i % 13), float(i % 7)]) for i in range(300)], "vec_id long, embedding array<float>")
    once = sorted(topk.search(df, df.filter("vec_id % 50 = 0")).collect())
    assert sorted(topk.search(df, df.filter("vec_id % 50 = 0"), block_bytes=32, shard_bytes=64).collect()) == once  # two levels of merging
    assert topk.search(df.limit(0), df.limit(0)).count() == 0 and topk.search(df, df.limit(0)).count() == 0


# 5: repeated substrings


def cut_by_hand(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[key] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def repeated_texts():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(400)) for _ in range(5)]
    out = []
    for _ in range(150):
        t = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 380)
            t += rng.choice(base)[a : rng.randint(a, 400)] + rng.choice(("", "x", "a" * rng.randint(0, 260), "ab" * rng.randint(0, 90)))
        out.append(t)
    return [*out, None, "", "a" * 99, "a" * 100, "b" * 101, "b" * 500, base[0] * 3]


@pytest.mark.parametrize("hot, frequent, piece", [(20_000, 64, 1 << 20), (20, 3, 1 << 20), (20_000, 64, 300)])
def test_repeats_brute_force(spark, monkeypatch, hot, frequent, piece):
    for name, value in (("HOT", hot), ("FREQUENT", frequent), ("PIECE", piece)):
        monkeypatch.setattr(dedup_suffix, name, value)
    rows = list(enumerate(repeated_texts()))
    rows += rows[:3]  # repeated rows
    got = dedup_suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = cut_by_hand(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_repeats_edges(spark):
    rng = random.Random(1)
    long = "q" + "".join(rng.choice("abcdefghij") for _ in range(300))
    rows = [(None, long), (3, long), (3, "other"), (2, long + "!")]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in dedup_suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 301): 0, (3, 301): 301, (3, 5): 0, (2, 302): 301}
    assert dedup_suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 6: language-model scores


def test_lm_base_score(spark, docs):
    rows = [(r["doc_id"], [*words(r["text"]), None]) for r in docs.collect()]
    c = Counter(t for i, ts in rows if crc(i, 5) != 1 for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, crc(i, 5) == 1, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 4)) for i, ts in rows)
    got = lm_score.score(docs, 500).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def by_doc(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_lm_does_not_depend_on_the_layout(spark, docs, parts):
    few = docs.filter("doc_id < 100").select("doc_id", "text").dropDuplicates(["doc_id"])
    a, b = by_doc(lm_score.score(few.coalesce(1))), by_doc(lm_score.score(few.repartition(parts), 200))
    assert a.keys() == b.keys()
    for i, r in a.items():
        assert all(math.isclose(r[c], b[i][c], rel_tol=1e-6) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))


def test_lm_learns_the_order_of_words(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{(s + k) % 12}" for k in range(60))) for i in range(400) for s in [rng.randint(0, 11)]]
    got = [r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.2 * sum(r["base_score"] for r in got)  # log probabilities: nearer to 0 is better


def test_lm_learns_the_order_of_thousands_of_words(spark):
    """Two of three words follow from the one before (n-gram) or from the one before that (skip), among 3,000."""
    rng = random.Random(9)
    rows = []
    for i in range(500):
        ws = [rng.randrange(3000), rng.randrange(3000)]
        while len(ws) < 240:
            ws.append((ws[-1] * 7 + 1) % 3000 if len(ws) % 3 else (ws[-2] * 11 + 5) % 3000 if rng.random() < 0.7 else rng.randrange(3000))
        rows.append((i, " ".join(f"w{x}" for x in ws)))
    got = [r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.75 * sum(r["base_score"] for r in got)


def test_lm_brute_force(spark):
    """Training and scoring with plain loops and dictionaries."""
    import xxhash

    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice((1, 2, 9, 14)))) for i in range(30)] + [(40, None), (41, "")]
    m = (1 << 64) - 1
    m1, m2, m3, start = (int(x) for x in (lm_score.M1, lm_score.M2, lm_score.M3, lm_score.START))
    texts = {i: [*(w.encode() for w in words(t)), b""] for i, t in rows}
    num = {w: int.from_bytes(xxhash.xxh3_128_digest(w)[8:12], "big") for ws in texts.values() for w in ws}
    cell = {w: ((h * m2 & m) >> 40) % 512 for w, h in num.items()}
    c = Counter(w for i, ws in texts.items() if crc(i, 5) != 1 for w in ws)
    total, in_cell, kinds = sum(c.values()), Counter(), Counter()
    for w, n in c.items():
        in_cell[cell[w]] += n
        kinds[cell[w]] += 1

    def digits(w):
        d = [cell[w] >> 6, cell[w] >> 3 & 7, cell[w] & 7]
        return zip(d, (0, 1 + d[0], 9 + d[0] * 8 + d[1]), strict=True)

    def steps(ws):
        """(digit, node, rows of weights) of each level for each token."""
        for k, w in enumerate(ws):
            one, two = num[ws[k - 1]] if k > 0 else start, num[ws[k - 2]] if k > 1 else start
            feats = [one * m1 & m, ((one * m1 & m) ^ (two + m3 & m)) * m2 & m, (two ^ m3) * m2 & m]
            for digit, node in digits(w):
                yield w, digit, node, [((f ^ (node * m3 & m)) * m1 & m) >> 47 for f in feats]

    bias = defaultdict(lambda: [0.5] * 8)
    for w, n in c.items():
        for digit, node in digits(w):
            bias[node] = [x + n * (k == digit) for k, x in enumerate(bias[node])]
    weight = defaultdict(float)

    def probs(node, rs):
        z = [math.log(bias[node][k] / sum(bias[node])) + sum(weight[r, k] for r in rs) for k in range(8)]
        total = sum(map(math.exp, z))
        return [math.exp(x) / total for x in z]

    for _ in range(lm_score.PASSES):
        seen, expected = Counter(), Counter()
        for i, ws in texts.items():
            for _, digit, node, rs in steps(ws) if crc(i, 5) != 1 else ():
                p = probs(node, rs)
                for r in rs:
                    seen[r, digit] += 1
                    for k in range(8):
                        expected[r, k] += p[k]
        for key in expected:
            weight[key] += math.log((seen[key] + lm_score.SMOOTHING) / (expected[key] + lm_score.SMOOTHING)) / 3
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()}
    for i, ws in texts.items():
        want = sum(math.log10((c[w] + 0.5) / (in_cell[cell[w]] + 0.5 * (kinds[cell[w]] + 1))) for w in ws)
        want += sum(math.log10(probs(node, rs)[digit]) for _, digit, node, rs in steps(ws))
        assert math.isclose(got[i], want, abs_tol=1e-3)


def test_lm_edges(spark, empty):
    assert lm_score.score(empty).count() == 0
    only_held_out = next(i for i in range(50) if crc(i, 5) == 1)
    r = lm_score.score(spark.createDataFrame([(only_held_out, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3) and math.isclose(r["base_score"], 3 * math.log10(0.5 / 0.5))


# 7: quality


def test_quality_held_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        text = prose(rng, 60) if good else " ".join(rng.choice(WORDS) + rng.choice(("###", "$$$", " |")) for _ in range(60))
        rows.append((i, text, "clash"))
        labels.append((i, int(good)))
    rows += [(900, None, "c"), (901, "", "c"), (902, prose(rng, 30_000), "c"), (5, rows[5][1], "c")]
    labels += [(5, None), (None, 1), (7, 0), (7, 1), (9999, 1)]
    got = quality.with_quality(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels[:400])
    held = [r for r in got if r["doc_id"] < 900 and crc(r["doc_id"], 3) == 1]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_quality_brute_force(spark, monkeypatch):
    """Dictionaries, sizes and the calibrated score, in plain Python."""
    import zlib as z

    import numpy as np
    import zstandard

    rng = random.Random(12)
    rows = [(i, prose(rng, 50) if i % 2 else " ".join(rng.choice(WORDS)[::-1] for _ in range(50))) for i in range(120)] + [(500, None)]
    got = {r["doc_id"]: r["score"] for r in quality.with_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")).collect()}
    draw = lambda i: int(hashlib.md5(f"quality:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    parts = {q: sorted((draw(i), i) for i, _ in rows if i % 2 == q and z.crc32(str(i).encode()) % 3 != 1) for q in (0, 1)}
    text = {i: (t or "").encode() for i, t in rows}
    dicts = {q: sorted(text[i] for n, (_, i) in enumerate(parts[q], 1) if n % 2 == 0 and text[i]) for q in (0, 1)}
    packed = {q: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(quality.build_dictionary(dicts[q])), level=3, write_content_size=False, write_checksum=False, write_dict_id=False) for q in (0, 1)}

    def diff(i):
        good, bad = (len(packed[q].compress(text[i])) if text[i] else 0 for q in (1, 0))
        return (bad - good) / (bad + good) if good + bad else 0.0

    fit = [(diff(i), q) for q in (0, 1) for n, (_, i) in enumerate(parts[q], 1) if n % 2]
    x, y = np.array([f for f, _ in fit]), np.array([q for _, q in fit], float)
    mean, sd = x.mean(), x.std() + 1e-9
    a = b = 0.0
    for _ in range(20_000):  # plain gradient descent to the same optimum
        p = 1 / (1 + np.exp(-(a + b * (x - mean) / sd)))
        a, b = a - 2 * ((p - y).mean() + 1e-3 * a), b - 2 * (((p - y) * (x - mean) / sd).mean() + 1e-3 * b)
    for i in text:
        assert math.isclose(got[i], 1 / (1 + math.exp(-(a + b * (diff(i) - mean) / sd))), abs_tol=1e-4)


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.with_quality(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.with_quality(docs, ones).collect())
    assert quality.with_quality(empty, ones).count() == 0


# 8: decontamination


def gram_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_decontamination_brute_force(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 13, 14, 5, 1, 20, 0))] + [(90, None), (91, "  .. "), (None, prose(rng, 15)), (2, "Zwei zu eins"), (5, prose(rng, 18))]
    rows = []
    for i in range(150):
        t = prose(rng, rng.randint(0, 60))
        if i % 3 == 0:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            t += " " + ", ".join(w[a : a + rng.randint(10, 20)]).upper() + "; " + prose(rng, 3)
        rows.append((i, t))
    rows += [(200, None), (201, ""), rows[0], rows[3], (None, items[0][1])]
    windows = defaultdict(set)
    for i, t in items:
        w = gram_words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1) if n else ():
            windows[tuple(w[a : a + n])].add(i)
    want = []
    for i, t in rows:
        w, hit, ids = gram_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    ids |= windows[tuple(w[a : a + n])] - {None}
        want.append((-1 if i is None else i, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.with_contamination(df, bench).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in got) == sorted(want)
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not x[4] for x in want)


def test_decontamination_by_shuffle_and_empty(spark, docs, empty, monkeypatch):
    bench = spark.createDataFrame([(1, docs.filter("doc_id = 8").first()["text"])], "item_id long, text string")
    view = lambda: sorted((r["doc_id"] or -1, r["n_hit"], len(r["items"])) for r in decontam.with_contamination(docs, bench).collect())
    once = view()
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert view() == once
    assert decontam.with_contamination(empty, bench).count() == 0
    assert decontam.with_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


# 9: mixing


def test_mixing_targets_and_copies(spark, docs, empty):
    out = mixing.with_copies(docs).collect()
    assert len(out) == docs.count()
    size = defaultdict(int)
    for r in docs.collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    target |= part
    for r in out:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]]) and 0 <= r["copies"] <= 2
    assert {(r["doc_id"], r["copies"]) for r in mixing.with_copies(docs).collect()} == {(r["doc_id"], r["copies"]) for r in out}
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy"] and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_the_targets(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 20), rng.choice("abcd")) for i in range(3000)]
    got = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"target": "max"}).collect()
    taken = {r[0]: r[1] for r in mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).selectExpr("source", "size * copies AS t").groupBy("source").sum("t").collect()}
    for s, target in got:
        assert abs(taken[s] - target) < 0.1 * target


# 10: near duplicates


def near_by_hand(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w] if w else [])))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if (c := least.get(find(i))) is None else c) for i, (d, _) in enumerate(rows))


def check_near(spark, rows):
    got = near_dup.set_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got.collect()) == near_by_hand(rows)


def test_near_duplicates_brute_force(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 8)):
            t = [rng.choice(vocabulary) if rng.random() < 0.03 else w for w in base]
            rows.append(" ".join(t).title() if rng.random() < 0.2 else " ".join(t))
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(500, None), (501, ""), (502, "one"), (503, "One"), (504, " \t"), (505, "one one"), (3, rows[3]), (4, rows[9]), (None, rows[2]), (None, "alone here now")]
    check_near(spark, rows)


def test_near_duplicates_in_a_dense_region(spark, monkeypatch):
    rng = random.Random(14)
    base = [f"w{k}" for k in range(120)]
    rows = [" ".join(base)]
    for _ in range(260):  # copies that are near the base, and less near to each other
        t = list(base)
        for k in rng.sample(range(120), rng.randint(1, 6)):
            t[k] = f"x{rng.randint(0, 10**6)}"
        rows.append(" ".join(t))
    check_near(spark, list(enumerate(rows)))


def test_near_duplicates_of_one_family_make_few_candidates(spark, monkeypatch):
    """Copies of one text are linked by a few orders; the others name their groups, and no candidates inside a component."""
    made = []

    def counted(df, real=near_dup.materialize):
        out = real(df)
        if out.columns == near_dup.NAMES:
            made.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    rng = random.Random(17)
    rows = []
    for _ in range(400):
        t = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), 2):
            t[k] = f"x{rng.randint(0, 10**9)}"
        rows.append(" ".join(t))
    check_near(spark, list(enumerate(rows)))
    assert made and sum(made) < 8 * len(rows)  # two in each of 16 orders before


def test_near_duplicates_below_the_bound_are_screened_out(spark, monkeypatch):
    """Texts of similarity about 0.7 to each other: their screens leave few pairs, where sketches left nearly all of a window."""
    made = []

    def counted(df, real=near_dup.materialize):
        out = real(df)
        if out.columns == near_dup.NAMES:
            made.append(out.filter("a IS NOT NULL").count())
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    rng = random.Random(18)
    rows = []
    for _ in range(300):
        t = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), 6):
            t[k] = f"x{rng.randint(0, 10**9)}"
        rows.append(" ".join(t))
    check_near(spark, list(enumerate(rows)))
    assert made and sum(made) < 4 * len(rows)


def test_screens_keep_every_similar_pair():
    """Sets of all sizes, those near PARITY_MOST too: no pair of 0.8 or more is lost, in rows or in tiles, and a far one is."""
    import numpy as np

    rng = np.random.default_rng(19)
    for n in (1, 2, 5, 40, 300, 790, 850, 990, 1000, 1010, 1200, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
            gone = int(rng.integers(0, n // 9 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 64, max(0, n // 9 - gone), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            near = 100 * both >= 80 * (len(a) + len(b) - both)
            far = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            x, y, z = (near_dup.screen(s, near_dup.signature(s), (80, 100))[None] for s in (a, b, far))
            for other, want in ((y, near), (z, False)):
                found = near_dup._similarities(x, other, (80, 100))[0] >= 0
                i, _ = near_dup._agreeing(x, other, np.array([1]), np.array([2]), (80, 100), False)
                assert found == (len(i) == 1) and (found or not want)
                assert not (found and other is z and n > 2)


def near_by_matrix(texts):
    """The least index of each text's component, by products of the shingles that two texts or more have."""
    import numpy as np

    sets = [set(zip(w, w[1:])) for w in map(str.split, texts)]
    count = Counter(g for s in sets for g in s)
    at = {g: k for k, g in enumerate(g for g, n in count.items() if n > 1)}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[g] for g in s if g in at]] = 1
    both, n = (m @ m.T).astype(np.int64), np.array([len(s) for s in sets])
    least = list(range(len(sets)))
    near = 100 * both >= 80 * (n[:, None] + n - both)
    for i in range(len(sets)):
        if least[i] == i:
            seen, front = {i}, [i]
            while front:
                new = set(np.nonzero(near[front].any(axis=0))[0].tolist()) - seen
                seen |= new
                front = list(new)
            for j in seen:
                least[j] = i
    return least


@pytest.mark.parametrize("chain", [False, True])
def test_near_duplicates_in_an_unlinked_family(spark, monkeypatch, chain):
    """Thousands of texts of similarity about 0.73 and a few pairs, or one chain, of 0.8 or more among them."""
    monkeypatch.setattr(near_dup, "BLOCK", 512)
    rng = random.Random(16)

    def changed(t, k):
        t = list(t)
        for p in rng.sample(range(len(t)), k):
            t[p] = f"x{rng.randint(0, 10**9)}"
        return t

    base = [f"w{k}" for k in range(120)]
    family = [changed(base, 5) for _ in range(2000)]
    if chain:
        for _ in range(60):
            family.append(changed(family[-1], 5))
    else:
        family += [changed(family[k], 5) for k in range(60)]
    rng.shuffle(family)
    texts = list(map(" ".join, family))
    got = near_dup.set_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == near_by_matrix(texts)


def test_near_duplicates_across_range_partitions(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "ROWS_PER_TASK", 60)
    rng = random.Random(15)
    rows = []
    for _ in range(20):
        base = [f"w{rng.randint(0, 500)}" for _ in range(60)]
        rows += [" ".join(base), " ".join([*base[:30], "new", *base[30:]]), " ".join(base[1:])]
    check_near(spark, list(enumerate(rows)))


def test_near_duplicates_stage(spark, docs, empty):
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {d for d, _, c in near_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()]) if d == c and d >= 0}
    assert {i for i in ids if i is not None} == want
    assert near_dup.deduplicate(empty).count() == 0


def test_components(spark):
    rng = random.Random(16)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(40)] + [(7, 7), (None, 3), (5, 4)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
