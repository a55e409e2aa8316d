"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The hash of a token names its cell, one of CELLS, by LEVELS digits of WIDTH values: its class, its
class within that, and so on. P(token | history) = P(digit | history) * P(next digit | history, digits
before) * ... * P(token | cell). Each digit has a softmax of its own, with features of the history and
of the digits before it: the word before, the two words before (n-grams) and the second word before
alone (skip); within a cell tokens have smoothed relative frequencies. Weights are hashed into 2**bits
numbers, one for about 2**SPARE training tokens (BITS bounds them, and so what is broadcast).

Training is PASSES gradient updates, each over every training token: each task sends the expected
counts of its blocks (the observed ones once), Spark sums them, and a weight moves along its gradient,
observed minus expected, divided by TEMPLATES and by the logarithmic mean of both counts (the step of
iterative scaling). Nothing depends on how the rows are laid out, but for rounding.

Texts are cut into blocks of about BLOCK_TOKENS tokens as they are read. A block is one row of token
numbers, local to it and packed, with one row for each of its distinct tokens (as a 96-bit hash); a
window by token sums the counts over all blocks, and the sums go back to the blocks. So what is
shuffled is the blocks' vocabularies, and no vocabulary is ever broadcast or collected.

Defined results: null and empty texts have the end token only; without training documents N is 0,
no token is known, and the base score follows its formula; rows that repeat a doc_id are scored and
counted each; an empty table gives an empty result; texts of any length are scored whole (a text
longer than a block is a block of its own); a null doc_id counts as the empty text in the split;
other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.ipc  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import bound_batches, discard, doc_part, materialize, read_table

#: The token after the last word; no word is empty.
END = b""
BLOCK_TOKENS = 3_000_000
#: Blocks of a task, and tokens of a block, that the sort key has room for.
TASK_BLOCKS, LID_BITS = 1 << 12, 27
LEVELS, WIDTH = 3, 8
CELLS = WIDTH**LEVELS
#: Numbers of the first softmax of each level; a level has one for each value of the digits before.
FIRST_NODE = [sum(WIDTH**k for k in range(level)) for level in range(LEVELS + 1)]
#: Least and most bits of a weight's number, and training tokens for a weight, as a power of 2.
BITS, SPARE = (20, 24), 7
TEMPLATES = 3
PASSES = 3
#: Added to observed and expected counts.
SMOOTHING = 2.0
#: Training tokens for each weight that a gradient task sends, and weights in one row of what it sends.
TOKENS_PER_SENT, CHUNK = 4, 1 << 16
#: Tokens whose softmax is computed at once.
SLICE = 1 << 13
START = np.uint64(0x51_7C_C1_B7_27_22_0A_95)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

#: Logits are kept within these bounds, so that no sum of exponentials is 0 or infinite.
LOGIT = 60.0

#: A block's documents (body) come before its tokens in the order of `at`.
BLOCK = "at long, h long, g int, n long, body binary"
NAMES = ["at", "h", "g", "n", "body"]


def pack(ids: np.ndarray) -> bytes:
    """Token numbers byte by byte, compressed: small numbers leave the high bytes empty."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and their number in each text."""
    split = pa.compute.ascii_split_whitespace(pa.compute.fill_null(pa.compute.ascii_lower(text), ""))
    flat, lens = split.flatten(), split.value_lengths().to_numpy()
    some = pa.compute.greater(pa.compute.binary_length(flat), 0)
    return flat.filter(some), np.bincount(np.repeat(np.arange(len(lens)), lens), weights=some.to_numpy(zero_copy_only=False), minlength=len(lens)).astype(np.int64)


def _block(number: int, docs: tuple[pa.Array, ...], parts: tuple[np.ndarray, ...], words: tuple[pa.Array, ...], counts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """A row with a block's documents as token numbers, then one for each of its tokens with its training count."""
    coded = pa.concat_arrays(words).dictionary_encode()
    vocab = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
    lens, parts, n = np.concatenate(counts) + 1, np.concatenate(parts), len(vocab)
    ids = np.full(lens.sum(), n - 1)
    ids[np.arange(len(coded)) + np.repeat(np.arange(len(lens)), lens - 1)] = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(ids, minlength=n), kind="stable")  # frequent tokens get small numbers
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ids = place[ids]
    counts = np.bincount(ids[np.repeat(parts != 1, lens)], minlength=n)
    body = pa.record_batch([pa.array([x], pa.list_(t)) for x, t in ((pa.concat_arrays(docs).to_pylist(), pa.int64()), (parts, pa.int32()), (lens, pa.int64()))] + [pa.array([pack(ids)], pa.binary())], names=["docs", "parts", "lens", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema) as out:
        out.write_batch(body)
    at = number << LID_BITS
    if n >= (1 << LID_BITS) - 1 or at >= 1 << 62:
        raise ValueError("too many blocks or tokens for the sort key")
    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([0]), pa.array([0], pa.int32()), pa.array([0]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=NAMES)
    keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocab)), ">u8").reshape(n, 2).astype(np.uint64)[order]
    yield pa.RecordBatch.from_arrays([pa.array(at + 1 + np.arange(n)), pa.array(keys[:, 1].copy().view(np.int64)), pa.array((keys[:, 0] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(counts), pa.nulls(n, pa.binary())], names=NAMES)


def _blocks(block_tokens: int):
    """The rows of _block() for all blocks of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        for b in batches:
            words, n = _words(b.column("text"))
            held.append((b.column("doc_id"), b.column("part").to_numpy(zero_copy_only=False), words, n))
            size += len(words) + len(n)
            if size >= block_tokens:
                if made == TASK_BLOCKS:
                    raise ValueError("too many blocks of a task for the sort key")
                yield from _block(task * TASK_BLOCKS + made, *zip(*held, strict=True))
                held, made, size = [], made + 1, 0
        if held:
            yield from _block(task * TASK_BLOCKS + made, *zip(*held, strict=True))

    return run


def _features(h: np.ndarray, since: np.ndarray) -> list[np.ndarray]:
    """Hash of each template's history; h: token hashes, two before the first, since: tokens of its document before each."""
    one, two = np.where(since >= 1, h[1:-1], START), np.where(since >= 2, h[:-2], START)
    return [one * M1, (one * M1 ^ (two + M3)) * M2, (two ^ M3) * M2]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h * M2 >> np.uint64(40)).astype(np.int64) % CELLS


def _digit(cells: np.ndarray, level: int) -> np.ndarray:
    return cells // WIDTH ** (LEVELS - 1 - level) % WIDTH


def _node(cells: np.ndarray, level: int) -> np.ndarray:
    """Number of the softmax that gives a cell's digit of a level."""
    return FIRST_NODE[level] + cells // WIDTH ** (LEVELS - level)


def _rows(feature: np.ndarray, node: np.ndarray, weights: int) -> np.ndarray:
    """The row of WIDTH weights of each feature at its node."""
    bits = (weights // WIDTH).bit_length() - 1
    return ((feature ^ node.astype(np.uint64) * M3) * M1 >> np.uint64(64 - bits)).astype(np.int64)


def _probs(w: np.ndarray, bias: np.ndarray, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = np.take(bias, node, axis=0)
    for r in rows:
        z += np.take(w, r, axis=0)
    np.clip(z, -LOGIT, LOGIT, out=z)
    np.exp(z, out=z)
    z /= (z @ np.ones(WIDTH, np.float32))[:, None]
    return z


READY = "body binary, c binary, h binary, own binary"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by `at`: one row for each block, its documents and its vocabulary as packed arrays."""
    body, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if body is not None:
            c, h = (np.concatenate([x[i] for x in held]) for i in range(2))
            packed = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((c >> 1, "<i8"), (h, "<i4"), (c & 1, "?"))]
            yield pa.RecordBatch.from_arrays([body, *packed], names=["body", "c", "h", "own"])

    for b in batches:
        starts = np.nonzero(b.column("body").is_valid().to_numpy(zero_copy_only=False))[0].tolist()
        for lo, hi in zip([0, *starts], [*starts, b.num_rows], strict=True):
            if lo == hi:
                continue
            if lo in starts:
                yield from flush()
                body, held = pa.array([b.column("body")[lo].as_py()], pa.binary()), []
                lo += 1
            if hi > lo:
                held.append(tuple(b.column(x).slice(lo, hi - lo).to_numpy(zero_copy_only=False).copy() for x in ("c", "h")))
    yield from flush()


def _vocabulary(b: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, hashes, whether the token is counted for this block) by token number."""
    c, h, own = (np.frombuffer(b.column(n)[row].as_buffer(), t) for n, t in (("c", "<i8"), ("h", "<u4"), ("own", "?")))
    return c, h.astype(np.uint64), own


def _documents(b: pa.RecordBatch, row: int) -> dict:
    """A block's document ids, parts, numbers of tokens, and packed token numbers."""
    t = pa.ipc.open_stream(b.column("body")[row].as_buffer()).read_next_batch()
    return {"docs": t.column("docs")[0].values, "parts": t.column("parts")[0].values.to_numpy(), "lens": t.column("lens")[0].values.to_numpy(), "ids": t.column("ids")[0].as_py()}


def _slices(b: pa.RecordBatch, training: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], dict[str, np.ndarray]]]:
    """(row, document of each token, token numbers, features, vocabulary) of SLICE tokens at a time, of training documents only or of all."""
    for row in range(b.num_rows):
        d = _documents(b, row)
        ids, lens = unpack(d["ids"]), d["lens"]
        c, h, _ = _vocabulary(b, row)
        vocab = {"c": c, "cell": _cells(h)}
        docs = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        begin = np.cumsum(lens) - lens
        for lo in range(0, len(ids), SLICE):
            here, doc = ids[lo : lo + SLICE], docs[lo : lo + SLICE]
            before = np.concatenate([np.full(max(0, 2 - lo), START), h[ids[max(0, lo - 2) : lo + SLICE]]])
            feats = _features(before, np.arange(lo, lo + len(here)) - begin[doc])
            if training:
                use = d["parts"][doc] != 1
                doc, here, feats = doc[use], here[use], [f[use] for f in feats]
            if len(here):
                yield row, doc, here, feats, vocab


def _summary_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the tokens counted for a block: their count and number in each cell."""
    for b in batches:
        for row in range(b.num_rows):
            c, h, own = _vocabulary(b, row)
            mine = own & (c > 0)
            cell = _cells(h[mine])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(np.bincount(cell, weights=c[mine], minlength=CELLS).astype(np.int64)), pa.array(np.bincount(cell, minlength=CELLS))], names=["cell", "c", "n"])


def weight_bits(total: int) -> int:
    return min(max(total.bit_length() - SPARE, BITS[0]), BITS[1])


def biases(in_cell: np.ndarray) -> np.ndarray:
    """Log relative frequency of each digit at each node, from the training tokens of the cells."""
    out = np.zeros((FIRST_NODE[LEVELS], WIDTH), np.float32)
    for level in range(LEVELS):
        n = in_cell.reshape(WIDTH ** (level + 1), -1).sum(axis=1).reshape(-1, WIDTH) + 0.5
        out[FIRST_NODE[level] : FIRST_NODE[level + 1]] = np.log(n / n.sum(axis=1, keepdims=True))
    return out


COUNTS = "chunk int, salt int, expected binary, observed binary"


def expected_counts(slices, w: np.ndarray, bias: np.ndarray, observe: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums over the tokens of the probabilities of every digit, and of the digits there are, by weight."""
    pairs = np.arange(WIDTH // 2)  # numbers are added two at a time, as the parts of complex ones
    expected, observed = np.zeros(w.size), np.zeros(w.size) if observe else None
    for _, _, ids, feats, x in slices:
        cells = x["cell"][ids]
        for level in range(LEVELS):
            node, digit = _node(cells, level), _digit(cells, level)
            rows = [_rows(f, node, w.size) for f in feats]
            p = _probs(w, bias, node, rows).astype(np.float64).ravel().view(np.complex128)
            for r in rows:
                np.add.at(expected.view(np.complex128), (r[:, None] * (WIDTH // 2) + pairs).ravel(), p)
                if observe:
                    np.add.at(observed, r * WIDTH + digit, 1.0)
    return expected, observed


def _counts_task(shared, salts: int, observe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        sums = expected_counts((s for b in batches for s in _slices(b, training=True)), w, bias, observe)
        n = w.size // CHUNK
        cut = [pa.array([part.astype(np.float32).tobytes() for part in np.split(x, n)], pa.binary()) if x is not None else pa.nulls(n, pa.binary()) for x in sums]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, TaskContext.get().partitionId() % salts, np.int32)), *cut], names=["chunk", "salt", "expected", "observed"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    def add(name: str) -> pa.Array:
        some = [np.frombuffer(x.as_buffer(), np.float32) for x in group.column(name) if x.is_valid]
        return pa.array([np.add.reduce(some, dtype=np.float64).astype(np.float32).tobytes() if some else None], pa.binary())

    return pa.table({"chunk": group.column("chunk")[:1], "salt": group.column("salt")[:1], "expected": add("expected"), "observed": add("observed")})


def step(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """What is added to the weights: the gradient, observed - expected, over TEMPLATES times the logarithmic mean of both."""
    return np.log((observed + SMOOTHING) / (expected + SMOOTHING)) / TEMPLATES


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = zip(b.column("observed"), b.column("expected"), strict=True)
        steps = [step(*(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in r)).astype(np.float32).tobytes() for r in both]
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(steps, pa.binary())], names=["chunk", "step"])


def train(blocks: DataFrame, bias: np.ndarray, total: int) -> np.ndarray:
    """The weights, in rows of WIDTH, after PASSES updates over all training tokens."""
    sc = blocks.sparkSession.sparkContext
    w = np.zeros((1 << weight_bits(total)) // WIDTH * WIDTH, np.float32).reshape(-1, WIDTH)
    tasks = max(sc.defaultParallelism, total // (TOKENS_PER_SENT * w.size))  # so that the counts sent stay a share of a large input
    salts = int(tasks**0.5) + 1
    seen = None
    for turn in range(PASSES):
        shared = sc.broadcast((w, bias))
        parts = blocks.coalesce(tasks).mapInArrow(_counts_task(shared, salts, turn == 0), COUNTS).groupBy("chunk", "salt").applyInArrow(_summed, COUNTS)
        whole = parts.groupBy("chunk").applyInArrow(_summed, COUNTS)
        if seen is None:
            whole = seen = materialize(whole)
        else:
            whole = whole.drop("observed").join(seen.select("chunk", "observed"), "chunk")
        for r in whole.select("chunk", "expected", "observed").mapInArrow(_steps, "chunk int, step binary").collect():  # the size of the weights
            w.ravel()[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["step"], np.float32)
        shared.destroy()
    discard(seen)
    return w


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, total, in_cell, kinds = shared.value
        distinct = kinds.sum()
        for b in batches:
            each = [_documents(b, row) for row in range(b.num_rows)]
            sums = [np.zeros((3, len(d["lens"]))) for d in each]
            for row, doc, ids, feats, x in _slices(b, training=False):
                c, cells = x["c"][ids], x["cell"][ids]
                logp = np.log10((c + 0.5) / (in_cell[cells] + 0.5 * (kinds[cells] + 1)))
                for level in range(LEVELS):
                    node = _node(cells, level)
                    p = _probs(w, bias, node, [_rows(f, node, w.size) for f in feats])
                    logp += np.log10(p[np.arange(len(ids)), _digit(cells, level)].astype(np.float64))
                n = sums[row].shape[1]
                base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
                for at, v in enumerate((base, logp, (c > 0).astype(np.float64))):
                    sums[row][at] += np.bincount(doc, weights=v, minlength=n)
            for d, (base, logp, known) in zip(each, sums, strict=True):
                yield pa.RecordBatch.from_arrays([d["docs"], pa.array(d["parts"] == 1), pa.array(d["lens"]), pa.array(known.astype(np.int64)), pa.array(np.full(len(base), total)), pa.array(base), pa.array(logp)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document."""
    src = docs.select("doc_id", doc_part(F.col("doc_id"), 5).cast("int").alias("part"), "text")
    bound_batches(docs.sparkSession)
    raw = materialize(src.mapInArrow(_blocks(block_tokens), BLOCK))
    vocab = raw.filter(F.col("body").isNull()).select("at", "h", "g", "n")
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = Window.partitionBy("h", "g")  # one row for each block at most
    own = F.col("at") == F.min("at").over(same)
    summed = vocab.select("at", F.shiftright("h", 32).cast("int").alias("h"), (F.sum("n").over(same) * 2 + own.cast("int")).alias("c"), F.lit(None).cast("binary").alias("body"))
    texts = raw.filter(F.col("body").isNotNull()).select("at", F.lit(0).alias("h"), F.lit(0).cast("long").alias("c"), "body")
    # twice as many partitions as blocks, so that few hold several
    rows = texts.unionByName(summed).repartition(2 * max(1, texts.count()), F.shiftright("at", LID_BITS)).sortWithinPartitions("at")
    blocks = materialize(rows.mapInArrow(_assemble, READY))
    discard(raw)
    summary = blocks.select("c", "h", "own").mapInArrow(_summary_task, "cell long, c long, n long").groupBy("cell").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    in_cell, kinds = np.zeros(CELLS), np.zeros(CELLS)
    for r in summary.collect():  # CELLS rows
        in_cell[r["cell"]], kinds[r["cell"]] = r["c"], r["n"]
    bias = biases(in_cell)
    w = train(blocks, bias, total)
    shared = blocks.sparkSession.sparkContext.broadcast((w, bias, total, in_cell, kinds))
    return blocks.mapInArrow(_score_task(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
