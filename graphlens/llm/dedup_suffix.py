"""Duplicate substrings of at least LENGTH bytes, by ranks of sampled positions at growing lengths.

This is not prefix doubling over all positions, as the README says with figures.

Ranking every byte position in Spark would sort about one row for each byte of the corpus at every
offset; here the positions are sampled first without losing a repeat. Ranks are names of equal
strings, and the rows sorted are (rank, rank of the longer string, position):

1. A position is sampled if its GRAM-byte string is the minimum, by hash, of some window of
   LENGTH - GRAM + 1 positions. So every LENGTH-byte string holds a sampled position, at the same
   place in each of its copies (about one byte in 35 is sampled).
2. Offset GRAM: Spark sorts (rank of the GRAM-byte string, rank of the whole context, document,
   position). Ranks that are unique are done. A context is all bytes of the LENGTH-byte strings
   around the position, up to the ends of the document; positions whose whole context has come
   before are done as well, and what they cover is removed.
3. Offset LENGTH: positions whose GRAM-byte string repeats in different contexts are ranked again
   by each LENGTH-byte string around them; strings that start earlier elsewhere are removed. Groups
   of more than HOT positions are ranked by Spark, one row for each string.

A group is never gathered: sorted rows stream through the tasks, each task sends only the first of
equal (string, context) pairs, and a string that is frequent within a task goes straight to step 3.

Strings are compared by hashes: contexts by 64 bits of the GRAM-byte string and 64 of the context,
LENGTH-byte strings by 128 bits and more, so that none is expected to be removed by chance.

Defined results: null and empty texts have no bytes and the hash of nothing; a text shorter than
LENGTH keeps all; documents come in the order of (doc_id, hash of the text), null ids first; rows
that repeat both are one document and get the same result; texts of any length are taken whole; an
empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bound_batches, materialize, read_table

LENGTH = 100
GRAM = 24
#: Text is hashed in pieces of so many bytes, so that memory does not follow the longest text.
PIECE = 1 << 20
#: Documents of so many bytes together are sampled at once; a larger one alone.
SAMPLE_BYTES = 4 << 20
#: A string in so many contexts within a task is not sent to be sorted but ranked again at once.
FREQUENT = 64
#: Positions of one string that a task ranks together; larger groups are spread by Spark.
HOT = 20_000
BATCH_POSITIONS = 6_000
INPUT_BYTES_PER_TASK = 8 << 20

_rng = np.random.default_rng(77)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_LIMIT = PIECE + 4 * LENGTH
POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_LIMIT, BASE, np.uint64)]), dtype=np.uint64)
INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_LIMIT, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)

#: The same of a second hash, for strings that are ranked again.
BYTE_2 = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE_2 = 0xC2B2AE3D27D4EB4F | 1
POWER_2 = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * LENGTH, BASE_2, np.uint64)]), dtype=np.uint64)
INVERSE_2 = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * LENGTH, pow(BASE_2, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: -(w - k)], x[w - k :]) if k < w else x


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * POWER[: len(data)], out=out[1:])
    return out


def sampled(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, ranks of their grams, ranks of their contexts) of a text of at least `length` bytes."""
    w = length - gram + 1
    out = []
    # pieces overlap, so that every position sees the whole of its windows and of its context
    for at in range(0, len(data), PIECE):
        lo, hi = max(0, at - 2 * length), min(len(data), at + PIECE + 2 * length)
        if hi - lo < length:
            continue
        d = data[lo:hi]
        p = _prefix(d)
        h = _mix((p[gram:] - p[:-gram]) * INVERSE[: len(d) - gram + 1])
        least = _sliding_min(h, w)
        pad = np.zeros(w - 1, np.uint64)
        most = ~_sliding_min(~np.concatenate([pad, least, pad]), w)
        a = np.nonzero(most == h)[0]
        a = a[(a + lo >= at) & (a + lo < at + PIECE)]
        s, e = np.maximum(a - (w - 1), 0), np.minimum(a + length, len(d))
        c = _mix(_mix((p[e] - p[s]) * INVERSE[s]) + ((e - a) * 256 + (a - s)).astype(np.uint64))
        out.append((a + lo, h[a], c))
    if not out:
        return tuple(np.zeros(0, x) for x in (np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def context(raw: bytes, at: int, length: int = LENGTH, gram: int = GRAM) -> bytes:
    """The bytes around a position: length - gram before it and length from it, cut at the ends."""
    return raw[max(0, at - (length - gram)) : at + length]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


#: kind 0: a sampled position to sort; 1: covered bytes [pos, end); 2: a position to rank again, with its context
ROW = "kind int, g long, c long, doc long, th long, pos long, end long, ctx binary"
NAMES = ["kind", "g", "c", "doc", "th", "pos", "end", "ctx"]


def _batch(kind: int, g, c, doc, th, pos, end, ctx=None) -> pa.RecordBatch:
    n = len(pos)
    asint = lambda x: pa.array(np.asarray(x).astype(np.int64)) if not isinstance(x, pa.Array) else x
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), asint(g), asint(c), asint(doc), asint(th), asint(pos), asint(end), pa.array(ctx, pa.binary()) if ctx is not None else pa.nulls(n, pa.binary())], names=NAMES)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each row starts a run of equal keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(doc, th, bytes) of the documents that can hold a repeat, some SAMPLE_BYTES at a time."""
    keys, datas, size = [], [], 0
    for b in batches:
        for doc, th, text in zip(b.column("doc").to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False), b.column("text"), strict=True):
            data = _bytes(text.as_py())
            if len(data) < LENGTH:
                continue
            keys.append((doc, th))
            datas.append(data)
            size += len(data)
            if size >= SAMPLE_BYTES:
                yield *(np.array(x, np.int64) for x in zip(*keys, strict=True)), datas
                keys, datas, size = [], [], 0
    if datas:
        yield *(np.array(x, np.int64) for x in zip(*keys, strict=True)), datas


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled positions of the documents; of equal (gram, context) pairs in a batch only the first is sent on."""
    for docs, ths, datas in _portions(batches):
        parts = []
        for row, data in enumerate(datas):
            pos, g, c = sampled(data)
            parts.append((np.full(len(pos), row), pos, g, c, np.full(len(pos), len(data))))
        row, pos, g, c, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, ths[row], docs[row], c, g))
        row, pos, g, c, size = (x[order] for x in (row, pos, g, c, size))
        new_g, new_c = _runs(g), _runs(g, c)
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(g)), 0))
        same = (docs[row] == docs[row[first]]) & (ths[row] == ths[row[first]]) & (pos == pos[first])
        covered = ~new_c & ~same
        start, end = np.maximum(pos - (LENGTH - GRAM), 0), np.minimum(pos + LENGTH, size)
        wide = covered & (end - start >= LENGTH)
        if wide.any():
            yield _batch(1, g[wide], c[wide], docs[row[wide]], ths[row[wide]], start[wide], end[wide])
        send = np.nonzero(new_c)[0]
        group = np.cumsum(new_g[send]) - 1
        count = np.bincount(group)
        frequent = count[group] > FREQUENT
        # a frequent string still sends two of its contexts, so that others find out that it has several
        rank_in = np.arange(len(send)) - np.maximum.accumulate(np.where(_runs(group), np.arange(len(send)), 0))
        plain = send[~frequent | (rank_in < 2)]
        yield _batch(0, g[plain], c[plain], docs[row[plain]], ths[row[plain]], pos[plain], end[plain])
        again = send[frequent & (rank_in >= 2)]
        if len(again):
            raw = {r: datas[r].tobytes() for r in np.unique(row[again]).tolist()}
            ctx = [context(raw[r], p) for r, p in zip(row[again].tolist(), pos[again].tolist(), strict=True)]
            yield _batch(2, g[again], c[again], docs[row[again]], ths[row[again]], pos[again], end[again], ctx)


def _sorted_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, g, c, doc, th, pos): covered bytes of repeated contexts, and positions to rank again.

    State between batches is one row and whether its string already has several contexts. Rows of
    other kinds pass through.
    """
    last = None  # (g, c, doc, th, pos, end) of the first row of the current (g, c); sent: it was passed on
    sent = False
    for b in batches:
        to_rank = pa.array(b.column("kind").to_numpy(zero_copy_only=False) == 0)
        if b.num_rows and not to_rank[-1].as_py():
            yield b.filter(pa.compute.invert(to_rank))
            b = b.filter(to_rank)
        if not b.num_rows:
            continue
        cols = [b.column(x).to_numpy(zero_copy_only=False) for x in ("g", "c", "doc", "th", "pos", "end")]
        if last is not None:
            cols = [np.concatenate([[v], x]) for v, x in zip(last, cols, strict=True)]
        g, c, doc, th, pos, end = cols
        new_g, new_c = _runs(g), _runs(g, c)
        at = np.arange(len(g))
        first = np.maximum.accumulate(np.where(new_c, at, 0))
        same = (doc == doc[first]) & (th == th[first]) & (pos == pos[first])
        covered = ~new_c & ~same
        start = np.maximum(pos - (LENGTH - GRAM), 0)
        wide = covered & (end - start >= LENGTH)
        if wide.any():
            yield _batch(1, g[wide], c[wide], doc[wide], th[wide], start[wide], end[wide])
        heads = np.nonzero(new_c)[0]
        group = np.cumsum(new_g[heads]) - 1
        several = np.bincount(group)[group] > 1
        if last is not None and sent:
            several[group == 0] = True
        if last is not None and sent:
            fresh = several & (heads > 0)
        else:
            fresh = several
        pick = heads[fresh]
        if len(pick):
            yield _batch(2, g[pick], c[pick], doc[pick], th[pick], pos[pick], end[pick])
        sent = bool(several[-1])
        last = tuple(int(x[heads[-1]]) for x in (g, c, doc, th, pos, end))


def _with_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context bytes of the positions (packed with their strings) of each document."""
    for b in batches:
        for doc, th, text, at, gs in zip(*(b.column(x) for x in ("doc", "th", "text", "at", "gs")), strict=True):
            raw, at = (text.as_py() or "").encode("utf-8", "surrogatepass"), at.values.to_numpy()
            for i in range(0, len(at), BATCH_POSITIONS):
                p = at[i : i + BATCH_POSITIONS]
                yield _batch(2, gs.values.to_numpy()[i : i + BATCH_POSITIONS], np.zeros(len(p)), np.full(len(p), doc.as_py()), np.full(len(p), th.as_py()), p, np.minimum(p + LENGTH, len(raw)), [context(raw, x) for x in p.tolist()])


def _windows(ctx: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, valid) of the LENGTH-byte strings around positions; column j is the string that starts LENGTH - GRAM - j bytes before."""
    w, left = LENGTH - GRAM + 1, LENGTH - GRAM
    width = left + LENGTH
    m = np.zeros((len(ctx), width), np.uint8)
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    shift = left - before
    row = np.repeat(np.arange(len(ctx)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(shift, size)
    m[row, col] = flat
    p = np.zeros((len(ctx), width + 1), np.uint64)
    hashes = []
    for table, power, inverse in ((BYTE, POWER, INVERSE), (BYTE_2, POWER_2, INVERSE_2)):
        np.cumsum(table[m] * power[:width], axis=1, out=p[:, 1:])
        hashes.append(_mix((p[:, LENGTH : LENGTH + w] - p[:, :w]) * inverse[:w]))
    starts = np.arange(w)
    return *hashes, (starts >= shift[:, None]) & (starts + LENGTH <= (shift + size)[:, None])


def _spans(earlier: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes covered by the marked strings of each row, as maximal runs of starts."""
    edge = np.diff(np.pad(earlier, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    base = pos[row] - (LENGTH - GRAM)
    return row, base + lo, base + hi - 1 + LENGTH


def _ranked_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, doc, th, pos), with contexts: bytes covered by strings that start earlier."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        g, doc, th, pos = (t.column(x).to_numpy() for x in ("g", "doc", "th", "pos"))
        h, h2, ok = _windows(t.column("ctx").to_pylist(), np.minimum(pos, LENGTH - GRAM))
        key = _mix(h + _mix(g.astype(np.uint64))[:, None] * np.uint64(3) + np.arange(h.shape[1], dtype=np.uint64) * np.uint64(BASE))
        rows = np.broadcast_to(np.arange(len(g))[:, None], key.shape)[ok]
        k, k2 = key[ok], h2[ok]
        order = np.lexsort((k2, k))  # stable: rows ascend within equal keys
        k, k2, rows = k[order], k2[order], rows[order]
        new = _runs(k, k2)
        first = rows[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))] if len(k) else rows
        again = (doc[rows] != doc[first]) | (th[rows] != th[first]) | (pos[rows] != pos[first])
        marked = np.zeros(ok.sum(), bool)
        marked[order] = again
        earlier = np.zeros(ok.shape, bool)
        earlier[ok] = marked
        row, start, end = _spans(earlier, pos)
        if len(row):
            yield _batch(1, g[row], np.zeros(len(row)), doc[row], th[row], start, end)

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < BATCH_POSITIONS:
            continue
        t = pa.Table.from_batches(held)
        g = t.column("g").to_numpy()
        stop = int(np.nonzero(_runs(g))[0][-1])  # the last string may go on
        yield from flush(t.slice(0, stop))
        held, size = t.slice(stop).to_batches(), t.num_rows - stop
    if held:
        yield from flush(pa.Table.from_batches(held))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each LENGTH-byte string around the positions of a hot string."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            x = b.slice(at, 2000)
            pos = x.column("pos").to_numpy(zero_copy_only=False)
            h, h2, ok = _windows(x.column("ctx").to_pylist(), np.minimum(pos, LENGTH - GRAM))
            row, col = np.nonzero(ok)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([x.column("g").take(take), pa.array(h[ok].astype(np.int64)), pa.array(h2[ok].astype(np.int64)), x.column("doc").take(take), x.column("th").take(take), pa.array(pos[row] - (LENGTH - GRAM) + col)], names=["g", "h", "h2", "doc", "th", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document, from its text and its covered spans."""
    for b in batches:
        out = []
        for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            s = spans.values.to_numpy().reshape(-1, 2) if spans.is_valid else np.zeros((0, 2), np.int64)
            s = s[np.lexsort((s[:, 1], s[:, 0]))]
            runs, kept, at = [], hashlib.sha256(), 0
            if len(s):
                reach = np.maximum.accumulate(s[:, 1])
                starts = np.concatenate([[True], s[1:, 0] > reach[:-1]])
                first = np.nonzero(starts)[0]
                runs = list(zip(s[first, 0].tolist(), np.maximum.reduceat(s[:, 1], first).tolist(), strict=True))
            for lo, hi in runs:
                kept.update(raw[at:lo])
                at = hi
            kept.update(raw[at:])
            out.append((len(raw), sum(hi - lo for lo, hi in runs), len(runs), kept.hexdigest(), [x for r in runs for x in r]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def covered_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, spans): flat [start, end, ...] of the bytes to remove, for documents that have any."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(1, -(-size // INPUT_BYTES_PER_TASK))
    by = ["kind", "g", "c", "doc", "th", "pos"]
    place = F.when(F.col("kind") == 0, F.col("g")).otherwise(F.xxhash64("doc", "pos"))
    ranked = docs.mapInArrow(_sample_task, ROW).repartition(tasks, place).sortWithinPartitions(*by).mapInArrow(_sorted_task, ROW)
    second = materialize(ranked)
    asked = second.filter("kind = 2 AND ctx IS NULL").groupBy("doc", "th").agg(F.collect_list(F.struct("pos", "g")).alias("x")).select("doc", "th", F.col("x.pos").alias("at"), F.col("x.g").alias("gs"))
    # rows that repeat a document ask once each; the rows they give are the same positions
    given = docs.join(asked, ["doc", "th"]).mapInArrow(_with_context, ROW)
    again = materialize(given.unionByName(second.filter("kind = 2 AND ctx IS NOT NULL")).select("g", "doc", "th", "pos", "ctx"))
    hot = materialize(again.groupBy("g").count().filter(F.col("count") > HOT).select("g"))
    some_hot = not hot.isEmpty()
    usual = again.join(hot, "g", "left_anti") if some_hot else again
    third = usual.repartition(tasks, "g").sortWithinPartitions("g", "doc", "th", "pos").mapInArrow(_ranked_again, ROW)
    spans = [x.filter("kind = 1").select("doc", "th", "pos", "end") for x in (second, third)]
    if some_hot:
        rows = again.join(hot, "g", "left_semi").mapInArrow(_exploded, "g long, h long, h2 long, doc long, th long, start long")
        here = F.struct("doc", "th", "start")
        least = rows.groupBy("g", "h", "h2").agg(F.min(here).alias("first"))
        spans.append(rows.join(least, ["g", "h", "h2"]).filter(here != F.col("first")).select("doc", "th", F.col("start").alias("pos"), (F.col("start") + LENGTH).alias("end")))
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    return every.groupBy("doc", "th").agg(F.flatten(F.collect_list(F.array("pos", "end"))).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("th"), "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each document; removed: flat byte spans."""
    bound_batches(docs.sparkSession)
    d = keyed(docs)
    out = d.join(covered_spans(d.select("doc", "th", "text")), ["doc", "th"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")


def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).drop("removed")
