"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions are used. The patterns are written so that Java's matcher needs time
linear in the text: a run of characters is entered at its start only (the look-behind, or \\G where
an earlier match ends inside it) and loops are possessive; they match what the plain patterns match.
Offsets come from splitting the text at the matches and summing the lengths of the pieces.

Kinds: email, ip (parts at most 255), card (12 to 19 digits passing Luhn), phone (9 to 15 digits)
are the base kinds; iban (mod-97) is added to them.

Defined results: null and empty texts have no spans; repeated rows get the same result each; spans
of different kinds may overlap, and redact() then replaces the first kind listed; texts of any
length are scanned whole; an empty table gives an empty result; find() replaces a column `pii`, other
columns pass through both, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import fresh, read_table

LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> (pattern, characters without which a text has no match, words that raise the score)
KINDS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|kontakt|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", "ip|host|server|address|login"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", "", "card|visa|pay|credit|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax|anruf"),
    "iban": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])", "", "iban|bank|konto|account|cuenta|compte"),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a span that its validator confirms, and what a context word within CONTEXT characters before it adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT_BONUS = 0.2
CONTEXT = 40
BLOCK = 128
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """The remainder of an IBAN: first four characters moved to the end, letters as 10 to 35."""
    chars = F.split(F.concat(F.substr(m, F.lit(5)), F.substring(m, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.array_remove(chars, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))


def valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (n >= 12) & (n <= 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return _mod97(m) == 1


def pieces(kind: str, text: Column) -> tuple[Column, Column]:
    """(gaps, matches): the text is gap 0, match 0, gap 1, ..., the last gap."""
    pattern, need, _ = KINDS[kind]
    some = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")
    return F.when(some, F.split(text, pattern, -1)).otherwise(F.array(text)), F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once a row: a lambda's variable isn't evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(kind: str, gaps: Column, matches: Column) -> Column:
    """The valid spans of one kind. Offsets are sums over blocks, so that many matches stay cheap."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    rank, score = list(KINDS).index(kind), SCORES[kind]
    lens = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    sums = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
    before = lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), zero, add))

    def all_spans(n: Column, base: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            end = F.get(base, F.floor(i / BLOCK).cast("int")) + F.aggregate(F.slice(n, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK + 1), zero, add)
            near = F.lower(F.right(F.get(gaps, i), F.lit(CONTEXT))).rlike(KINDS[kind][2])
            found = F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), (F.lit(score) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))).alias("score"))
            return F.when(valid(kind, m), found)

        return F.transform(matches, span)

    found = _let(lens, lambda n: _let(sums(n), lambda s: _let(before(s), lambda base: all_spans(n, base))))
    return F.when(F.size(matches) == 0, F.array().cast(SPAN)).otherwise(F.filter(found, lambda x: x.isNotNull()))


def _pair_spans(kind: str):
    return lambda p: _spans(kind, p["g"], p["m"])


def find(docs: DataFrame) -> DataFrame:
    """Add `pii`, the spans of all kinds by start and kind; every span carries a score."""
    keep = [c for c in docs.columns if c.lower() != "pii"]
    text = fresh(docs, "_text")
    out = docs.select(*keep, F.coalesce("text", F.lit("")).alias(text))
    spans = []
    for k in KINDS:
        gaps, matches = pieces(k, F.col(text))
        spans.append(_let(F.struct(gaps.alias("g"), matches.alias("m")), _pair_spans(k)))
    return out.select(*keep, F.array_sort(F.concat(*spans)).alias("pii"))


def _replaced(kind: str):
    tag = lambda m: F.when(valid(kind, m), F.lit(f"[{kind.upper()}]")).otherwise(m)
    return lambda p: F.array_join(F.zip_with(p["g"], F.concat(F.transform(p["m"], tag), F.array(F.lit(""))), lambda g, t: F.concat(g, t)), "")


def redact(docs: DataFrame) -> DataFrame:
    """Replace the valid spans of every kind in `text` by [KIND]; null stays null. Columns are kept; n_chars follows."""
    text = F.col("text")
    out = docs
    for k in KINDS:
        gaps, matches = pieces(k, text)
        out = out.withColumn("text", F.when(text.isNotNull(), _let(F.struct(gaps.alias("g"), matches.alias("m")), _replaced(k))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return out.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("best_score"))
