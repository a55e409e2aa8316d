"""Phrase collocations by vertical positional inverted lists.

Documents are cut into blocks of some megabytes. A block keeps inverted lists: for each word that is
frequent in its language the sorted positions in the block, later the same for each frequent phrase. A
phrase of k words is extended by merging the positions after its occurrences with the postings of the
adjacent words, so the length of the new list is the exact frequency in the block. Block frequencies
are summed by key over all blocks, in buckets of bounded size; what reaches the least frequency gets a
number and goes back to the blocks that hold it, the rest is dropped (no longer phrase can need it).
Nothing is broadcast by this module and nothing but counts of rows goes to the driver.

Defined results: null and empty texts have no words; a null language is the language `und`; repeated
rows count each; an empty table, or one without frequent phrases, gives an empty result; texts of any
length are whole (a text is never cut between blocks); ties are broken by the phrase's UTF-8 bytes;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import LOWER, UPPER, bound_batches, discard, materialize, read_table

#: A phrase is a candidate from this frequency on.
LEAST = 100
#: Most words of a phrase.
LONGEST = 5
#: Phrases reported for each language.
TOP = 2000
#: Bytes of text from which a block is full.
BLOCK_BYTES = 8 << 20
#: Positions of candidates that share a bucket of the frequency sums.
BUCKET_POSITIONS = 1 << 18
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 256
#: Pieces end at these characters; words end at blanks.
PIECE_END = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans((UPPER + "\t" + PIECE_END).encode(), (LOWER + " ").encode() + b"\n" * len(PIECE_END))
_BREAK = b"\n"

#: Rows that blocks and buckets exchange; binary columns hold packed numbers, or words joined by line ends.
INDEX = "block long, n_words long, words binary, counts binary, positions binary"
STATE = "block long, n_positions long, phrases binary, lengths binary, positions binary, words binary, word_lengths binary, word_positions binary"
WORD_SUMS = "bucket int, block long, words binary, codes binary, counts binary"
SUMS = "bucket int, block long, keys binary, counts binary"
FOUND = "block long, keys binary, ids binary, totals binary"


def pack(numbers: np.ndarray) -> bytes:
    """Differences, byte by byte, compressed: lists of positions and sorted keys take few bytes each."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = steps.view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T.tobytes()
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(value: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(value[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(value[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel(), dtype=kind)


def pack_words(words: list[bytes]) -> bytes:
    """Words with their language: neither holds a line end."""
    whole = b"\n".join(words)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def unpack_words(value: bytes) -> list[bytes]:
    return pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True).split(b"\n")


def named(word: bytes, lang: str) -> bytes:
    """A word with its language, which is in hexadecimal, as it may hold any character; a word holds no blank."""
    return word + b" " + lang.encode().hex().encode()


def _rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def split_words(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """Codes of all words of the texts in order, -1 where a piece ends, and the words by code."""
    joined = "\n".join(texts).encode().translate(_TABLE).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([joined], pa.large_binary()), " ").flatten().dictionary_encode()
    words, codes = tokens.dictionary.to_pylist(), tokens.indices.to_numpy(zero_copy_only=False)
    codes = codes[codes != words.index(b"")] if b"" in words else codes
    real = [w for w in words if w not in (b"", _BREAK)]
    new = np.full(len(words), -1, np.int32)
    new[[i for i, w in enumerate(words) if w not in (b"", _BREAK)]] = np.arange(len(real), dtype=np.int32)
    return new[codes], real


def inverted(codes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, lengths, positions list by list) of occurrences in any order."""
    if int(codes.max(initial=0)) < 1 << 31:  # both in one number sort much faster
        both = np.sort(codes.astype(np.int64) << 32 | positions)
        codes, positions = both >> 32, both & 0xFFFFFFFF
    else:
        order = np.lexsort((positions, codes))
        codes, positions = codes[order], positions[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.diff(starts, append=len(codes)).astype(np.int32), positions.astype(np.int32)


def index_block(by_lang: dict[str, list[str]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a block with their languages, the lengths of their lists, and the lists one after the other."""
    words, lengths, positions, offset = [], [], [], 0
    for lang in sorted(by_lang):
        codes, vocabulary = split_words(by_lang[lang])
        at = np.flatnonzero(codes >= 0)
        _, n, lists = inverted(codes[at], at + offset)
        words += [named(w, lang) for w in vocabulary]
        lengths.append(n)
        positions.append(lists)
        offset += len(codes) + 1
    return words, np.concatenate([np.zeros(0, np.int32), *lengths]), np.concatenate([np.zeros(0, np.int32), *positions])


def _indexer(schema: pa.Schema, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, {}, 0

        def flush():
            words, counts, positions = index_block(held)
            return _rows(schema, {"block": [number], "n_words": [len(words)], "words": [pack_words(words)], "counts": [pack(counts)], "positions": [pack(positions)]})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= block_bytes:
                    yield flush()
                    number, held, size = number + 1, {}, 0
        if held:
            yield flush()

    return run


def by_bucket(bucket: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    return (p for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p))


def _sent(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 256)):
        yield _rows(schema, dict(zip(schema.names, zip(*some, strict=True), strict=True)))


def _word_sums(schema: pa.Schema, buckets: int):
    """The lengths of a block's word lists, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["n_words"]:
                    words, counts = unpack_words(row["words"]), unpack(row["counts"], np.int32)
                    bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int32)
                    yield from _sent(schema, ((int(bucket[p[0]]), row["block"], pack_words([words[i] for i in p.tolist()]), pack(p.astype(np.int32)), pack(counts[p])) for p in by_bucket(bucket)))

    return run


def _word_totals(schema: pa.Schema, least: int, buckets: int):
    """Frequencies of a bucket's words over all blocks.

    Rows: the frequent words with their numbers and frequencies (block null), the languages with all their words
    counted (block -1), and for each block the codes and numbers of its frequent words.
    """

    def run(table: pa.Table) -> pa.Table:
        lists = [unpack_words(x.as_py()) for x in table["words"]]
        every = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        at, words = every.indices.to_numpy(), every.dictionary.to_pylist()
        totals = np.zeros(len(words), np.int64)
        np.add.at(totals, at, np.concatenate([unpack(x.as_py(), np.int32) for x in table["counts"]]))
        known = np.flatnonzero(totals >= least)
        ids = np.full(len(words), -1, np.int64)
        ids[known] = np.arange(len(known), dtype=np.int64) * buckets + table["bucket"][0].as_py()
        langs: dict[bytes, int] = {}
        for w, n in zip(words, totals.tolist(), strict=True):
            lang = w[w.index(b" ") :]
            langs[lang] = langs.get(lang, 0) + n
        rows = [(-1, pack_words(list(langs)), None, pack(np.array(list(langs.values()), np.int64)))]
        if len(known):
            rows.append((None, pack_words([words[i] for i in known.tolist()]), pack(ids[known]), pack(totals[known])))
        start = 0
        for block, mine, codes in zip(table["block"].to_pylist(), lists, table["codes"], strict=True):
            own = ids[at[start : start + len(mine)]]
            start += len(mine)
            if (own >= 0).any():
                rows.append((block, pack(unpack(codes.as_py(), np.int32)[own >= 0]), pack(own[own >= 0]), None))
        return pa.Table.from_batches(list(_sent(schema, iter(rows))))

    return run


def _unpacked_words(schema: pa.Schema):
    """Packed words as rows: a number (null for a language), the language, the word, a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = [w.split(b" ") for w in unpack_words(row["keys"])]
                ids = unpack(row["ids"], np.int64).tolist() if row["ids"] else [None] * len(words)
                yield _rows(schema, {"id": ids, "lang": [bytes.fromhex(x.decode()).decode() for _, x in words], "word": [w.decode() for w, _ in words], "f": unpack(row["totals"], np.int64)})

    return run


def _state(schema: pa.Schema, block: int, phrases: tuple, words: tuple) -> pa.Table:
    """A row of inverted lists: those of the phrases, and the postings of words that can still be adjacent."""
    lists = [pack(x) for kinds, lengths, positions in (phrases, words) for x in (kinds.astype(np.int64), lengths, positions)]
    return pa.Table.from_batches([_rows(schema, {k: [v] for k, v in zip(schema.names, [block, len(phrases[2]), *lists], strict=True)})])


def _both(right: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """All keys and numbers that buckets sent to a block, by key."""
    keys, ids = (np.concatenate([unpack(x.as_py(), k) for x in right[c]]) for c, k in (("keys", kind), ("ids", np.int64)))
    order = np.argsort(keys)
    return keys[order], ids[order]


def _first_state(schema: pa.Schema):
    """The block's lists of frequent words, under the numbers that these have in the whole table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        lengths, positions = unpack(row["counts"], np.int32), unpack(row["positions"], np.int32)
        codes, ids = _both(right, np.int32)
        number = np.full(len(lengths), -1, np.int64)
        number[codes] = ids
        each = np.repeat(number, lengths)
        lists = inverted(each[each >= 0], positions[each >= 0])
        return _state(schema, row["block"], lists, lists)

    return run


def extend(state: dict, k: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of k-1 frequent words, merged with the postings of the adjacent words: (start, key, word)."""
    start = unpack(state["positions"], np.int32)
    word_positions, words = unpack(state["word_positions"], np.int32), np.repeat(unpack(state["words"], np.int64), unpack(state["word_lengths"], np.int32))
    after = np.full(int(max(start.max(initial=-1), word_positions.max(initial=-1))) + k + 1, -1, np.int64)
    after[word_positions] = words
    word = after[start + (k - 1)]
    hit = word >= 0
    phrase = np.repeat(unpack(state["phrases"], np.int64), unpack(state["lengths"], np.int32))[hit]
    if len(phrase) and int(phrase.max()) >= (1 << 62) // n_words:
        raise OverflowError("numbers of phrases and words together pass 62 bits")
    return start[hit], phrase * n_words + word[hit], word[hit]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _candidates(schema: pa.Schema, k: int, n_words: int, buckets: int):
    """Lengths of the new lists of each block, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.to_pylist():
                keys, counts = np.unique(extend(state, k, n_words)[1], return_counts=True)
                bucket = bucket_of(keys, buckets)
                yield from _sent(schema, ((int(bucket[p[0]]), state["block"], pack(keys[p]), pack(counts[p].astype(np.int32))) for p in by_bucket(bucket)))

    return run


def _totals(schema: pa.Schema, least: int, buckets: int):
    """Frequencies of a bucket's keys over all blocks; those that reach the least are numbered (block null) and sent to their blocks."""

    def run(table: pa.Table) -> pa.Table:
        lists = [unpack(x.as_py(), np.int64) for x in table["keys"]]
        every, counts = np.concatenate(lists), np.concatenate([unpack(x.as_py(), np.int32) for x in table["counts"]]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        totals = np.add.reduceat(counts[order], first)
        keys, totals = keys[totals >= least], totals[totals >= least]
        if not len(keys):
            return schema.empty_table()
        ids = np.arange(len(keys), dtype=np.int64) * buckets + table["bucket"][0].as_py()
        rows = [(None, pack(keys), pack(ids), pack(totals))]
        for block, mine in zip(table["block"].to_pylist(), lists, strict=True):
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            at = at[keys[at] == mine]
            if len(at):
                rows.append((block, pack(keys[at]), pack(ids[at]), None))
        return pa.Table.from_batches(list(_sent(schema, iter(rows))))

    return run


def _next_state(schema: pa.Schema, k: int, n_words: int):
    """The block's lists of frequent phrases of k words, and the postings of words that can still be adjacent."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        state = left.to_pylist()[0]
        start, key, word = extend(state, k, n_words)
        keys, ids = _both(right, np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        start, number, word = start[hit], ids[at[hit]], word[hit]
        return _state(schema, state["block"], inverted(number, start), inverted(word, start + (k - 1)))  # a longer phrase must end in a last word of these

    return run


def _unpacked(schema: pa.Schema, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpack(row["keys"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unpack(row["ids"], np.int64)), pa.array(keys // n_words), pa.array(keys % n_words), pa.array(unpack(row["totals"], np.int64))], schema=schema)

    return run


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES, bucket_positions: int = BUCKET_POSITIONS) -> tuple[DataFrame, DataFrame]:
    """(lang, text) -> phrases (lang, k, phrase, f) of 1 to `longest` words with f >= least, and (lang, n) with all words counted."""
    spark = docs.sparkSession
    bound_batches(spark)
    some = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").filter(F.octet_length("text") > 0)
    index = materialize(some.mapInArrow(_indexer(_schema(INDEX), block_bytes), INDEX))
    buckets = 2 * (index.agg(F.sum("n_words").alias("n")).first()["n"] or 0) // bucket_positions + 1
    found = index.select("block", "n_words", "words", "counts").mapInArrow(_word_sums(_schema(WORD_SUMS), buckets), WORD_SUMS).groupBy("bucket")
    found = materialize(found.applyInArrow(_word_totals(_schema(FOUND), least, buckets), FOUND))
    words = "id long, lang string, word string, f long"
    unpacked = lambda rows: found.filter(rows).select("keys", "ids", "totals").mapInArrow(_unpacked_words(_schema(words)), words)
    n_all = materialize(unpacked("block = -1").groupBy("lang").agg(F.sum("f").alias("n")))
    known = materialize(unpacked("block IS NULL"))
    n_words = (known.agg(F.max("id").alias("n")).first()["n"] or 0) + 1
    state = materialize(index.select("block", "counts", "positions").groupBy("block").cogroup(found.filter("block >= 0").groupBy("block")).applyInArrow(_first_state(_schema(STATE)), STATE))
    level = known.select("id", "lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "f")
    levels, last = [level], level.select("id", F.col("phrase").alias("word"))
    old = index
    for k in range(2, longest + 1):
        buckets = (state.agg(F.sum("n_positions").alias("n")).first()["n"] or 0) // bucket_positions + 1
        sums = state.mapInArrow(_candidates(_schema(SUMS), k, n_words, buckets), SUMS)
        found = materialize(sums.groupBy("bucket").applyInArrow(_totals(_schema(FOUND), least, buckets), FOUND))
        numbers = found.filter(F.col("block").isNull()).select("keys", "ids", "totals").mapInArrow(_unpacked(_schema("id long, phrase_id long, word_id long, f long"), n_words), "id long, phrase_id long, word_id long, f long")
        longer = numbers.join(level.select(F.col("id").alias("phrase_id"), "lang", "phrase"), "phrase_id").join(last.select(F.col("id").alias("word_id"), "word"), "word_id")
        level = materialize(longer.select("id", "lang", F.lit(k).alias("k"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "f"))
        levels.append(level)
        discard(old)
        if k == longest or not level.count():
            break
        old = state
        state = materialize(state.groupBy("block").cogroup(found.filter(F.col("block").isNotNull()).groupBy("block")).applyInArrow(_next_state(_schema(STATE), k, n_words), STATE))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("lang", "k", "phrase", "f"), n_all


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, **sizes) -> DataFrame:
    """(lang, text) -> lang, rank, phrase, a, l, r, n, score: the highest phrases of each language."""
    f, n_all = frequent(docs, least, longest, **sizes)
    part = lambda first, last: F.array_join(F.slice(F.split("phrase", " "), first, last), " ")
    phrases = f.filter("k > 1")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", part(F.lit(1), F.col("cut"))).withColumn("right", part(F.col("cut") + 1, F.col("k") - F.col("cut")))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(n_all), "lang") if n_all.count() <= 100_000 else cuts.join(n_all, "lang")  # one row a language
    # up to 28 digits: over 64 bits, so decimals; the quotient is at most 1000 n / a
    score = F.expr("CAST(CAST(1000 * CAST(a AS DECIMAL(19, 0)) AS DECIMAL(22, 0)) * CAST(n AS DECIMAL(15, 0)) AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: part(i, m)))))
    covered = phrases.filter("k > 2").select("lang", F.col("f").alias("longer"), inside.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    # a language's phrases are ranked in parts first, so that none meets whole in one task
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM t, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.cut, c.a, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > 2 AND f.k > len(string_split(b.phrase, ' ')) AND f.f >= b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM z QUALIFY rank <= 2000
"""
