"""Scalar functions on answers, names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a refusal, a sign of negation, and the categories of answers.
REFUSALS = (
    r"\bi don'?t know\b", r"\bi do not know\b",
    r"\bcannot (verify|confirm|determine|answer|provide)\b",
    r"\bcan'?t (verify|confirm|determine|answer|tell)\b",
    r"\bnot (enough|sufficient) information\b",
    r"\bno information\b", r"\bunable to (verify|determine|confirm|answer)\b",
    r"\bas an ai\b", r"\bi'?m sorry\b", r"\bi am sorry\b",
    r"\bnot sure\b", r"\bunclear\b", r"\bi couldn'?t find\b",
)
REFUSAL_PATTERN = "(?i)" + "|".join(REFUSALS)
MARKERS = ("No", "not", "n't", "no")
CATEGORIES = ("answered_yes", "answered_no", "refusal_scored_as_no", "spurious_substring", "unparseable")
YES_PATTERN = r"(?i)\b(yes|true|correct)\b"
NO_PATTERN = r"(?i)\b(no|not|n't|never|false|incorrect)\b"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def normalise(c: Column) -> Column:
    """Outer space and full stops off, inner space single, lower case."""
    return F.lower(F.regexp_replace(collapse(c), r"^\.+|\.+$", ""))


def normalise_name(c: Column) -> Column:
    """The part before a comma, underscores as spaces, lower case."""
    return F.lower(strip(F.replace(F.split_part(c, F.lit(","), F.lit(1)), F.lit("_"), F.lit(" "))))


def before_comma(c: Column) -> Column:
    return F.split_part(c, F.lit(","), F.lit(1))


def strict_verdict(c: Column) -> Column:
    """1 for "Yes", else 0 for "No", else null; upper and lower case differ."""
    return F.when(F.contains(c, F.lit("Yes")), 1).when(F.contains(c, F.lit("No")), 0)


def _says_yes(c: Column) -> Column:
    return F.contains(c, F.lit("Yes")) | F.contains(c, F.lit(" yes"))


def _marked(c: Column) -> Column:
    out = F.lit(False)
    for m in MARKERS:
        out = out | F.contains(c, F.lit(m))
    return out


def lenient_verdict(c: Column) -> Column:
    """1 for "Yes" or " yes"; else 0 for any sign of negation, even inside a word; else null."""
    return F.when(_says_yes(c), 1).when(_marked(c), 0)


def negation_inside_words_only(c: Column) -> Column:
    """Whether the lenient rule reads a negation that is never a word of its own."""
    alone = c.rlike("(?<![A-Za-z])(No|not|n't|no)(?![A-Za-z])")
    return ~_says_yes(c) & _marked(c) & ~alone


def is_refusal(c: Column) -> Column:
    return c.rlike(REFUSAL_PATTERN)


def category(c: Column) -> Column:
    """Why an answer gets its verdict: one of CATEGORIES, the first that fits."""
    return (
        F.when(_says_yes(c), "answered_yes")
        .when(is_refusal(c), "refusal_scored_as_no")
        .when(negation_inside_words_only(c), "spurious_substring")
        .when(_marked(c), "answered_no")
        .otherwise("unparseable")
    )


def constrained_verdict(c: Column) -> Column:
    return F.startswith(F.lower(strip(c)), F.lit("y")).cast("int")


def clean_verdict(c: Column) -> Column:
    """Null for a refusal; then 0 for a negating word, 1 for an affirming word, else null."""
    return F.when(is_refusal(c), None).when(c.rlike(NO_PATTERN), 0).when(c.rlike(YES_PATTERN), 1)


def verdict_from_scores(p_yes: Column, p_no: Column) -> Column:
    return (p_yes >= p_no).cast("int")


def confidence_from_scores(p_yes: Column, p_no: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(p_yes - p_no), p_yes + p_no), F.lit(0.0))


def pos_suffix(c: Column) -> Column:
    """Part of speech at the end of an identifier, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"_(NN|VB|JJ|RB)_?[0-9]*$", 1), F.lit(""))


def id_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([A-Za-z]+):", 1), F.lit(""))


def path_parts(c: Column) -> Column:
    """(domain, property) of a relation written as a path."""
    parts = F.filter(F.split(c, "/"), lambda x: x != "")
    return F.struct(F.get(parts, F.lit(0)).alias("domain"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("property"))


def n_label_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit("[A-Za-z]{3,}"), F.lit(0)))


def truncate_words(c: Column, n: Column) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(F.split(strip(c), r"\s+"), F.lit(1), n), " ")


def looks_opaque(c: Column) -> Column:
    """An identifier rather than a label: digits early on, or no word of three letters."""
    return c.rlike(r"^[^A-Za-z0-9]*(?:[A-Za-z]{0,3}[^A-Za-z0-9]*[0-9]|[0-9])") | (n_label_words(c) == 0)


def rank_verdict(rank: Column) -> Column:
    return F.when(rank == 1, "first").when(rank <= 3, "top 3").when(rank <= 10, "top 10").otherwise("missed")


def correctness(verdict: Column, gold: Column) -> Column:
    """1 or 0; no verdict counts as wrong."""
    return F.coalesce(verdict.cast("int") == gold, F.lit(False)).cast("int")


def wordnet_id(c: Column) -> Column:
    """(lemma, pos, sense) of `stool_NN_2` or `__east_indian_1`; null if it is neither."""
    tagged, plain = r"^(.+?)_(NN|VB|JJ|RB)_?([0-9]+)$", r"^_*(.+?)_([0-9]+)$"
    part = lambda p, i: F.regexp_extract(c, p, i)
    pos = F.element_at(F.create_map(*[F.lit(x) for x in ("NN", "n", "VB", "v", "JJ", "a", "RB", "r")]), part(tagged, 2))
    a = F.struct(part(tagged, 1).alias("lemma"), pos.alias("pos"), part(tagged, 3).cast("int").alias("sense"))
    b = F.struct(part(plain, 1).alias("lemma"), F.lit(None).cast("string").alias("pos"), part(plain, 2).cast("int").alias("sense"))
    return F.when(c.rlike(tagged), a).when(c.rlike(plain), b)


# Endings of plural words and what takes their place, the first that fits.
PLURALS = (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("zes", "z"), ("ses", "s"), ("s", ""))
ARTICLES = ("and", "or", "the", "a", "an")


def singular(c: Column) -> Column:
    out = c
    for end, put in reversed(PLURALS):
        out = F.when(F.endswith(c, F.lit(end)), F.concat(F.left(c, F.length(c) - len(end)), F.lit(put))).otherwise(out)
    return F.when(F.endswith(c, F.lit("ss")) | (F.length(c) <= 3), c).otherwise(out)


# Words that end the head of a category, and the forms of class names.
PREPOSITIONS = "_(?:in|of|from|by|at|for|about|with|during)_"
WORDNET_CLASS, SCHEMA_CLASS, WIKI_CLASS = r"^wordnet_([a-z][a-z_]*?)_[0-9]+$", r"^https?://(?:schema\.org|yago-knowledge\.org/schema)/(\w+)$", "^wikicat(?:egory)?_(.+)$"


def category_head(c: Column) -> Column:
    """The head noun of a category: `English_male_film_actors` gives actor, `Cities_in_Texas` gives city."""
    head = F.get(F.split(c, PREPOSITIONS, 2), F.lit(0))
    toks = F.filter(F.split(head, "_"), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))
    keep = lambda t: ~(F.endswith(t, F.lit("ed")) | F.lower(t).isin(*ARTICLES))
    last = F.coalesce(F.element_at(F.filter(toks, keep), -1), F.get(toks, F.lit(0)))
    return singular(F.lower(last))


def class_name(c: Column) -> Column:
    """(kind, name) of a class atom: wordnet, schema or wikicat; null if it is none."""
    v = F.regexp_replace(F.regexp_replace(strip(c), r"^\.+|\.+$", ""), "^[<>]+|[<>]+$", "")
    part = lambda p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    wordnet, schema = part(WORDNET_CLASS), part(SCHEMA_CLASS)
    wiki = category_head(part(WIKI_CLASS))
    pair = lambda k, n: F.struct(F.lit(k).alias("kind"), n.alias("name"))
    return F.when(wordnet.isNotNull(), pair("wordnet", wordnet)).when(schema.isNotNull(), pair("schema", F.lower(schema))).when(wiki.isNotNull(), pair("wikicat", wiki))


def cell_name(c: Column) -> Column:
    """(policy, budget, direction) of a result's name such as `S1_B200_tail`."""
    p = r"^([A-Z][A-Za-z0-9]*)_B([0-9]+)_(head|tail|relation)$"
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("policy"), F.regexp_extract(c, p, 2).cast("int").alias("budget"), F.regexp_extract(c, p, 3).alias("direction")))


def p_yes_share(p_yes: Column, p_no: Column) -> Column:
    s = p_yes + p_no
    return p_yes / F.when(s == 0, 1.0).otherwise(s)


def answer_name(text: Column) -> Column:
    """A name as answers are compared: up to the first comma, white space as one blank, without points or blanks at the ends, in lower case."""
    first = F.regexp_replace(F.split(text, ",")[0], r"\s+", " ")
    return F.lower(F.regexp_replace(first, r"^[ .]+|[ .]+$", ""))


def same_answer(reply: Column, gold: Column) -> Column:
    """Whether a reply names the gold answer; an empty reply never does."""
    return (answer_name(reply) == answer_name(gold)) & (answer_name(reply) != "")
