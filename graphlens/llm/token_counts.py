"""Token counts through a cache by digests.

A text's count is stored under the sha256 of its normalised content, in a folder named by the digest of
the tokenizer (its file, library, version and options). A run joins the digests of its texts to the
stored counts, encodes each distinct text without a count once, appends those counts to the cache, and
joins the cache to all rows. An append writes a folder of its own, so a run that fails or loses
executors leaves nothing half written, runs at the same time do no harm, and later runs only encode
what is new. Rows of a text that many rows share are spread over salts before the join.

Defined results: a null text is the empty text and has no tokens; repeated rows are counted each and
encoded once; an empty table gives an empty result and appends nothing; texts of any length are whole;
strings of special tokens in a text are treated as the library does by default; extra columns pass
through with_token_counts(), but for those named n_bytes, n_tokens and over_limit, which are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bound_batches, fresh, materialize, read_table, shared_dir

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Most missing digests that are broadcast to fetch their texts (some 40 bytes each); more meet the texts by shuffle.
BROADCAST_DIGESTS = 200_000
#: A text that more than one in so many rows hold is spread over as many salts.
HOT_SHARE = 500
#: Words whose counts a worker remembers; then it starts anew.
REMEMBERED = 1 << 19
#: Characters of the longest word that is remembered.
LONGEST_REMEMBERED = 100

COUNTS = "digest binary, n_tokens long"
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file, or of any file given with its path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_digest(name: str) -> str:
    """Names what a count depends on besides the text: the vocabulary file, the library and its version."""
    kind = "tokenizers" if name.endswith(".json") else "sentencepiece"
    version = __import__(kind).__version__
    return hashlib.sha256(Path(tokenizer_path(name)).read_bytes() + f"|{kind}|{version}|no special tokens added".encode()).hexdigest()


class WordCounter:
    """Tokens of texts by a tokenizer whose tokens never reach over a blank that follows a visible character.

    Such a text's tokens are those of its pieces, cut before these blanks; pieces repeat, so their counts are remembered.
    """

    def __init__(self, encode) -> None:
        self.encode, self.known = encode, {}

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Cut before each blank after a character that is no white space."""
        parts = re.split(r"(?<=\S) ", text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts, known = self.pieces(text), self.known
            if new := list({p for p in parts if p not in known}):
                if len(known) > REMEMBERED:
                    known.clear()
                    new = list(set(parts))
                known.update(zip(new, map(len, self.encode(new)), strict=True))
            out.append(sum(map(known.__getitem__, parts)))
            for p in new:
                if len(p) > LONGEST_REMEMBERED:
                    del known[p]
        return out


class TextCounter:
    """Tokens of whole texts, some at a time."""

    def __init__(self, encode, some: int = 64) -> None:
        self.encode, self.some = encode, some

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for i in range(0, len(texts), self.some) for x in self.encode(texts[i : i + self.some])]


def cuts_at_blanks(tokenizer: dict) -> bool:
    """Whether a tokenizer's file says that no token reaches over a blank after a visible character: byte-level words, nothing rewritten, no token that takes blanks."""
    pre = tokenizer.get("pre_tokenizer") or {}
    plain = all(tokenizer.get(k) is None for k in ("normalizer", "truncation", "padding"))
    own = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in tokenizer.get("added_tokens", []))
    return plain and own and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


def counter(name: str):
    """Loads a tokenizer once for each Python worker."""
    if name not in _LOADED:
        path = tokenizer_path(name)
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            encode = lambda texts: t.encode_batch_fast(texts, add_special_tokens=False)
            _LOADED[name] = (WordCounter if cuts_at_blanks(json.loads(Path(path).read_text())) else TextCounter)(encode)
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[name] = TextCounter(lambda texts: s.encode(texts, num_threads=1))
    return _LOADED[name]


def _encoder(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter(name).counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


class TokenCache:
    """Stored counts of one tokenizer: (digest, n_tokens) below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> None:
        self.spark, self.tokenizer = spark, tokenizer
        self.path = f"{folder}/tokenizer={tokenizer_digest(tokenizer)}"

    def appends(self) -> list[str]:
        """The folders of finished appends."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/append=*/_SUCCESS")
        found = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(jpath)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def read(self) -> DataFrame:
        """One row a digest, also where two runs have stored the same."""
        paths = self.appends()
        if not paths:
            return self.spark.createDataFrame([], COUNTS)
        return self.spark.read.schema(COUNTS).parquet(*paths).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, texts: DataFrame) -> None:
        """Encode (digest, text) rows, each digest once, and store their counts."""
        bound_batches(self.spark)
        counts = texts.mapInArrow(_encoder(self.tokenizer), COUNTS)
        counts.write.option("compression", "zstd").parquet(f"{self.path}/append={uuid.uuid4().hex}")


def normalised(text):
    """What a digest is taken of: the text, null as empty. Other changes of a text can change its count."""
    return F.coalesce(text, F.lit(""))


def with_token_counts(docs: DataFrame, cache: TokenCache, limit: int = LIMIT) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to documents; encodes what the cache lacks and stores it there."""
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256))
    keyed = docs.select(digest.alias("digest"), normalised(F.col("text")).alias("text"))
    copies = materialize(keyed.groupBy("digest").agg(F.count("*").alias("copies")))
    missing = materialize(copies.join(cache.read(), "digest", "left_anti").select("digest"))
    n_missing = missing.count()
    if n_missing > BROADCAST_DIGESTS:
        cache.append(keyed.dropDuplicates(["digest"]).join(missing, "digest", "left_semi"))
    elif n_missing:
        cache.append(keyed.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"]))
    # at most HOT_SHARE texts can be hot; their rows are dealt to salts, and their counts to each salt
    least = max(1000, (copies.agg(F.sum("copies").alias("n")).first()["n"] or 0) // HOT_SHARE)
    hot = copies.filter(F.col("copies") > least).select("digest", F.lit(True).alias("hot"))
    d, s, n = (fresh(docs, c) for c in ("_digest", "_salt", "_n"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_SHARE - 1))).otherwise(F.array(F.lit(0)))
    counts = cache.read().join(copies.select("digest"), "digest", "left_semi").join(F.broadcast(hot), "digest", "left")
    counts = counts.select(F.col("digest").alias(d), F.explode(salts).alias(s), F.col("n_tokens").alias(n))
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*kept, digest.alias(d), F.octet_length(normalised(F.col("text"))).cast("long").alias("n_bytes"))
    rows = rows.join(F.broadcast(hot.select(F.col("digest").alias(d), F.col("hot").alias(n + "h"))), d, "left")
    deal = F.pmod(F.monotonically_increasing_id(), F.lit(HOT_SHARE)).cast("int")
    rows = rows.withColumn(s, F.when(F.col(n + "h"), deal).otherwise(0)).drop(n + "h")
    return rows.join(counts, [d, s]).select(*kept, "n_bytes", F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a cache that starts empty, so that every distinct text of the table is encoded once here."""
    cache = TokenCache(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    out = with_token_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
