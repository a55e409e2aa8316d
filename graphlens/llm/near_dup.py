"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every distinct shingle set is a node. TREES signature orders of LEVELS 16-bit min-hashes each are
sorted by Spark (range partitions, so that no key and no group is one task). In each order a node's
candidates are its WINDOW predecessors that share the longest prefixes with it, of MIN_DEPTH levels
at least: the depth adapts to the region, shallow where it is sparse, deep where it is dense.
Candidates are screened, and full sets confirm links. Sets of up to PARITY_MOST shingles hold the
parities of PARITY_BITS buckets of shingles: each parity that differs takes a shingle of one set
alone, so two sets are left out only if they cannot be similar. Longer sets are screened by 4-bit
sketches of their signatures.

Confirmed links join nodes into components, so candidates inside a component need no check. An early
pass over EARLY of the orders takes the best candidate of each node and order, which makes a chain of
each dense group, and of these, as in Boruvka's method, each node's best is confirmed before the rest.
A pass over all orders then takes every candidate between different components, so none is dropped.
Groups denser than the window are named by their prefix, not node by node. Regions
denser than the window are then sorted again with only a few nodes of each component left (the dense
groups thinned out), which links most of what a component's own nodes have kept apart. At last the
groups that share MIN_DEPTH levels and are larger than the window are finished exactly: all their
pairs between different components are compared, in tiles of two blocks. A tile of few candidates
gives these to be confirmed; one of many is settled on the full sets and gives only links that join
components. So every pair that shares MIN_DEPTH levels in an order is compared, however dense its region.

Defined results: null and empty texts and texts without words have no shingles, link with nothing
and are their own component; a text of fewer words than a shingle has its whole sequence as the one
shingle; repeated rows and rows of one doc_id are rows of one document and get their own set's
component; a null doc_id never names a component that has another id; an empty table gives an empty
result; extra columns pass through deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.llm.common import LOWER_BYTES, bound_batches, discard, fresh, materialize, read_table
from graphlens.llm.components import connected_components

SHINGLE = 2
#: Link if SIMILARITY[1] * intersection >= SIMILARITY[0] * union.
SIMILARITY = (80, 100)
TREES, LEVELS = 16, 8
HASHES = TREES * LEVELS
MIN_DEPTH = 3
#: Bits of a row's first four levels that are below MIN_DEPTH.
PREFIX = np.int64(16 * (4 - MIN_DEPTH))
WINDOW = 20
#: A pair whose sketches agree less than this share below the threshold's expectation is no candidate (over 4 standard deviations).
SLACK = 0.17
#: Buckets of the parities, and most shingles of a set that has them; near it a set has a sketch, too.
PARITY_BITS, PARITY_MOST = 512, 1000
#: 8-byte words of a screen: the set's size, its parities, its sketch.
WORDS = 1 + PARITY_BITS // 64 + HASHES // 16
PARITY, SKETCH = slice(1, 1 + PARITY_BITS // 64), slice(1 + PARITY_BITS // 64, WORDS)
ROWS_PER_TASK = 40_000
#: Nodes of each component that stay when a dense region is thinned, to link most of it cheaply; _finished() takes the rest.
HUBS = 4
MAX_THINNINGS = 6
#: Nodes of a block of a dense group, of which each two are compared as one tile.
BLOCK = 1024
#: A tile with more candidates than this for each of its nodes is settled on full sets at once, not pair by pair.
RICH = 8
#: Parts of a group's rows when these meet the group's size.
SALTS = 32
#: Shingles that a tile multiplies at once.
COLUMNS = 2048
#: Orders of the early pass, which takes one candidate of a node in each.
EARLY = 4
#: Most node ids that are broadcast to pick out texts; beyond it Spark joins by shuffle.
BROADCAST_NODES = 500_000
CHUNK = 4096

_rng = np.random.default_rng(20240607)
XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ODD = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The lowest bit of each 4 bits.
LOWEST = np.uint64(0x1111111111111111)


class TokenHashes(dict):
    """64-bit hash of each token, kept for the tokens seen lately."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, hashes: TokenHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    t = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(size, len(t))
    out = np.full(len(t) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * M2 + t[k : len(t) - size + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES min-hashes of 32 bits."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), CHUNK):
        np.minimum(out, ((h[at : at + CHUNK, None] ^ XOR) * ODD).min(axis=0), out=out)
    return out


def screen(shingles: np.ndarray, sig: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """WORDS numbers: the size, the parities of a set of up to PARITY_MOST shingles, the sketch of one that may be similar to a larger one."""
    out = np.zeros(WORDS, np.uint64)
    out[0] = len(shingles)
    if len(shingles) <= PARITY_MOST:
        odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
        out[PARITY] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    if similarity[1] * len(shingles) >= similarity[0] * PARITY_MOST:
        low = (sig & np.uint32(15)).astype(np.uint8)
        out[SKETCH] = (low[0::2] | low[1::2] << 4).view(np.uint64)
    return out


def _sketched(similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for b in batches:
            keys, counts, screens, orders = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, hashes)
                counts.append(len(s))
                if not len(s):
                    keys.append(None)
                    screens.append(None)
                    orders.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s)
                screens.append(screen(s, sig, similarity).tobytes())
                orders.append((sig >> np.uint32(16)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(screens, pa.binary()), pa.array(orders, pa.binary())], names=["doc_id", "text_key", "n_shingles", "key", "screen", "orders"])

    return run


def _least(similarity: tuple[int, int]) -> int:
    """Fewest agreements of two sketches that make a candidate."""
    share = similarity[0] / similarity[1] - SLACK
    return int(HASHES * (share + (1 - share) / 16))


def _similarities(x: np.ndarray, y: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """For each two rows of screens their similarity as the screens tell it, in thousandths; -1 for no candidate."""
    num, den = similarity
    nx, ny = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
    low, high = np.minimum(nx, ny), np.maximum(nx, ny)
    out = np.full(len(x), -1, np.int32)
    fit = den * low >= num * high
    at = np.nonzero(fit & (high <= PARITY_MOST))[0]
    if len(at):
        odd = np.bitwise_count(x[at, PARITY] ^ y[at, PARITY]).sum(axis=1, dtype=np.int64)
        both = nx[at] + ny[at]
        keep = odd * (den + num) <= both * (den - num)
        at, odd, both = at[keep], odd[keep], both[keep]
        differ = np.minimum(-PARITY_BITS / 2 * np.log1p(-2 * np.minimum(odd, PARITY_BITS // 2 - 1) / PARITY_BITS), both)
        out[at] = 1000 * (both - differ) / (both + differ)
    at = np.nonzero(fit & (high > PARITY_MOST))[0]
    if len(at):
        d = x[at, SKETCH] ^ y[at, SKETCH]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        n = HASHES - np.bitwise_count(d & LOWEST).sum(axis=1, dtype=np.int64)
        keep = n >= _least(similarity)
        out[at[keep]] = 1000 * (16 * n[keep] / HASHES - 1) / 15
    return out


def _orders(nodes: DataFrame, trees: int) -> DataFrame:
    """(tree, k0, k1, key, comp, screen): one row for each node and each of the first trees, sorted over range partitions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = np.frombuffer(b"".join(b.column("orders").to_pylist()), ">i8").reshape(n, TREES, 2)[:, :trees].astype(np.int64).reshape(-1, 2)
            each = pa.array(np.repeat(np.arange(n), trees))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), *(b.column(c).take(each) for c in ("key", "comp", "screen"))], names=["tree", "k0", "k1", "key", "comp", "screen"])

    rows = nodes.select("key", "comp", "screen", "orders").mapInArrow(cut, "tree int, k0 long, k1 long, key binary, comp binary, screen binary")
    tasks = max(1, -(-nodes.count() * trees // ROWS_PER_TASK))
    by = ["tree", "k0", "k1", "key"]
    return rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)


OUT = "a binary, b binary, agree int, part int, tree int, k0 long, k1 long, key binary, comp binary, screen binary"
NAMES = ["a", "b", "agree", "part", "tree", "k0", "k1", "key", "comp", "screen"]


def _neighbours(tree: np.ndarray, k0: np.ndarray, comp: np.ndarray, screens: np.ndarray, similarity: tuple[int, int], most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows i, rows j, agreements) of the candidates i before j in different components, the best `most` of a row j,
    and rows of the groups that reach beyond the window, one at least of each."""
    left, right, agree = [], [], []
    wide = np.zeros(0, np.int64)
    for o in range(1, min(WINDOW, len(k0) - 1) + 1):
        at = np.nonzero((tree[o:] == tree[:-o]) & ((k0[o:] ^ k0[:-o]) >> PREFIX == 0))[0]
        if not len(at):
            break
        if o == WINDOW:
            wide = at
        at = at[(comp[at] != comp[at + o]).any(axis=1)]
        for c in range(0, len(at), 1 << 16):
            i = at[c : c + (1 << 16)]
            n = _similarities(screens[i], screens[i + o], similarity)
            keep = n >= 0
            left.append(i[keep])
            right.append(i[keep] + o)
            agree.append(n[keep])
    if not left:
        none = np.zeros(0, np.int64)
        return none, none, none, wide
    i, j, n = map(np.concatenate, (left, right, agree))
    if most is not None and len(i):
        order = np.lexsort((-i, -n, j))
        i, j, n = i[order], j[order], n[order]
        start = np.maximum.accumulate(np.where(np.concatenate([[True], j[1:] != j[:-1]]), np.arange(len(j)), 0))
        few = np.arange(len(j)) - start < most
        i, j, n = i[few], j[few], n[few]
    return i, j, n, wide


def _candidates(similarity: tuple[int, int], most: int | None):
    """Candidates of a range partition, its dense groups, and the rows at its ends for _across()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        part = TaskContext.get().partitionId()
        yield from _emit(t, similarity, most)
        n, w = t.num_rows, min(WINDOW, t.num_rows)
        for rows, p in ((t.slice(0, w), part - 1), (t.slice(n - w, w), part)):
            rows = rows.combine_chunks()
            none = [pa.nulls(w, x) for x in (pa.binary(), pa.binary(), pa.int32())]
            cols = [rows.column(c).combine_chunks() for c in NAMES[4:]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(w, p, np.int32)), *cols], names=NAMES)

    return run


def _across(similarity: tuple[int, int], most: int | None):
    """Candidates between the last rows of a range partition and the first of the next; whole parts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if sum(b.num_rows for b in got):
            yield from _emit(pa.Table.from_batches(got), similarity, most)

    return run


def _halves(column: pa.ChunkedArray) -> np.ndarray:
    """Keys of 16 bytes as two numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, 2)


def _emit(t: pa.Table, similarity: tuple[int, int], most: int | None) -> Iterator[pa.RecordBatch]:
    tree = own = t.column("tree").to_numpy().astype(np.int64)
    if "part" in t.column_names:
        tree = tree + t.column("part").to_numpy().astype(np.int64) * TREES
    keys = np.array(t.column("key").to_pylist(), object)
    screens = np.frombuffer(b"".join(t.column("screen").to_pylist()), np.uint64).reshape(-1, WORDS)
    k0 = t.column("k0").to_numpy()
    left, right, agree, wide = _neighbours(tree, k0, _halves(t.column("comp")), screens, similarity, most)
    pairs = {(x, y) if x < y else (y, x): m for x, y, m in zip(keys[left], keys[right], agree.tolist(), strict=True) if x != y}
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    groups = sorted(set(zip(own[wide].tolist(), (k0[wide] >> PREFIX).tolist(), strict=True)))
    n, g = len(a), len(groups)
    cols = [pa.array(a + [None] * g, pa.binary()), pa.array(b + [None] * g, pa.binary()), pa.array([*pairs.values(), *[None] * g], pa.int32()), pa.nulls(n + g, pa.int32())]
    named = [pa.array([None] * n + [x[c] for x in groups], kind) for c, kind in enumerate((pa.int32(), pa.int64()))]
    rest = [*named, *(pa.nulls(n + g, x) for x in (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
    yield pa.RecordBatch.from_arrays([*cols, *rest], names=NAMES)


def _prefixes(nodes: DataFrame, kinds: str) -> DataFrame:
    """(tree, prefix, ..): one row for each node and tree, with its first MIN_DEPTH levels and the columns of the kinds."""
    names = [x.split()[0] for x in kinds.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = np.frombuffer(b"".join(b.column("orders").to_pylist()), ">i8").reshape(n * TREES, 2)[:, 0].astype(np.int64) >> PREFIX
            each = pa.array(np.repeat(np.arange(n), TREES))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(k), *(b.column(c).take(each) for c in names)], names=["tree", "prefix", *names])

    return nodes.select(*names, "orders").mapInArrow(cut, f"tree int, prefix long, {kinds}")


def candidates(nodes: DataFrame, comp: DataFrame | None, similarity: tuple[int, int], most: int | None = None, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """((a, b, agree) with a < b in different components, the nodes that have one or may have more), by the first trees.

    With `most`, the best so many of a node in each tree; what it leaves out is for a later call.
    """
    if comp is None:
        named = nodes.withColumn("comp", F.col("key"))
    else:
        named = nodes.join(comp.select(F.col("node").alias("key"), F.col("component").alias("comp")), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    found = materialize(_orders(named, trees).mapInArrow(_candidates(similarity, most), OUT))
    ends = found.filter(F.col("part").isNotNull()).select(*NAMES[3:])
    across = ends.repartition("part").sortWithinPartitions("part", "tree", "k0", "k1", "key").mapInArrow(_across(similarity, most), OUT)
    each = ["a", "b", "tree", "k0"]
    both = found.filter(F.col("part").isNull()).select(*each, "agree").unionByName(across.select(*each, "agree"))
    both = materialize(both.groupBy(*each).agg(F.max("agree").alias("agree")))
    discard(found)
    pairs = both.filter(F.col("a").isNotNull()).select("a", "b", "agree")
    dense = _ends(pairs)
    groups = both.filter(F.col("a").isNull()).select("tree", F.col("k0").alias("prefix"))
    if n := groups.count():
        few = F.broadcast(groups) if n <= BROADCAST_NODES else groups
        dense = dense.unionByName(_prefixes(nodes, "key binary").join(few, ["tree", "prefix"], "left_semi").select("key"))
    return pairs, dense.distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    num, den = similarity

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if den * len(x) < num * len(y):
                    keep.append(False)
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    s = sets.select("key", "shingles")
    j = pairs.select("a", "b").join(s.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(s.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    return j.mapInArrow(check, "a binary, b binary")


def _renamed(comp: DataFrame | None, good: DataFrame) -> DataFrame:
    """Components after more links. Links are taken between components, so that few rounds settle them."""
    if comp is None:
        return materialize(connected_components(good))
    merged = connected_components(_between(good.withColumn("agree", F.lit(0)), comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    old = comp.select("node", F.col("component").alias("c")).join(merged.select(F.col("node").alias("c"), "component"), "c", "left").select("node", F.coalesce("component", "c").alias("component"))
    new = merged.join(comp.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new.select("node", "component")))


def _between(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components, with these as ca and cb."""
    if comp is None:
        return pairs.select("a", "b", "agree", F.col("a").alias("ca"), F.col("b").alias("cb"))
    for end in ("a", "b"):
        c = comp.select(F.col("node").alias(end), F.col("component").alias("_c"))
        pairs = pairs.join(c, end, "left").withColumn(f"c{end}", F.coalesce("_c", end)).drop("_c")
    return pairs.filter(F.col("ca") != F.col("cb")).select("a", "b", "agree", "ca", "cb")


def _best(pairs: DataFrame) -> DataFrame:
    """The best pair of each node."""
    each = pairs.select(F.col("a").alias("c"), F.struct("agree", "a", "b").alias("x")).unionByName(pairs.select(F.col("b").alias("c"), F.struct("agree", "a", "b").alias("x")))
    return each.groupBy("c").agg(F.max("x").alias("x")).select("x.a", "x.b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, comp: DataFrame | None, similarity: tuple[int, int]) -> DataFrame | None:
    """The components after the pairs have been confirmed."""
    good = materialize(_confirm(pairs, sets, similarity))
    return comp if good.isEmpty() else _renamed(comp, good)


def _linked_best(pairs: DataFrame, sets: DataFrame, comp: DataFrame | None, similarity: tuple[int, int]) -> DataFrame | None:
    """As _linked(), each node's best pair before the rest, of which only those that are still between components are confirmed."""
    best = materialize(_best(pairs))
    comp = _linked(best, sets, comp, similarity)
    return _linked(_between(pairs.join(best, ["a", "b"], "left_anti"), comp), sets, comp, similarity)


def _planes(sketches: np.ndarray) -> np.ndarray:
    """The four bit planes of each sketch, as (4, words, rows)."""
    n = len(sketches)
    bits = np.unpackbits(sketches, axis=1).reshape(n, HASHES, 4)
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2)).view(np.uint64).transpose(1, 2, 0).copy()


def _agreeing(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, similarity: tuple[int, int], half: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y in different components that their screens make candidates, as in _similarities(); i < j if x and y are one block."""
    num, den = similarity
    nx, ny = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
    any_short, any_long = min(nx.min(), ny.min()) <= PARITY_MOST, max(nx.max(), ny.max()) > PARITY_MOST
    odd_x, odd_y = x[:, PARITY], y[:, PARITY].T.copy()
    px, py = (_planes(np.ascontiguousarray(s[:, SKETCH]).view(np.uint8)) for s in (x, y)) if any_long else (None, None)
    left, right = [], []
    for at in range(0, len(x), 128):
        end = min(at + 128, len(x))
        n = nx[at:end, None]
        high = np.maximum(n, ny)
        keep = (cx[at:end, None] != cy) & (den * np.minimum(n, ny) >= num * high)
        if any_short:
            odd = np.zeros(keep.shape, np.uint16)
            for w in range(odd_x.shape[1]):
                odd += np.bitwise_count(odd_x[at:end, w, None] ^ odd_y[w])
            keep &= (high > PARITY_MOST) | (odd.astype(np.int64) * (den + num) <= (n + ny) * (den - num))
        if any_long:
            differ = np.zeros(keep.shape, np.uint16)
            for w in range(px.shape[1]):
                d = px[0, w, at:end, None] ^ py[0, w]
                for bit in range(1, 4):
                    d |= px[bit, w, at:end, None] ^ py[bit, w]
                differ += np.bitwise_count(d)
            keep &= (high <= PARITY_MOST) | (differ <= HASHES - _least(similarity))
        if half:
            keep &= np.arange(at, end)[:, None] < np.arange(len(y))
        i, j = np.nonzero(keep)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _similar(x: list[np.ndarray], y: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Whether the sets of x and of y are similar enough, each with each: intersections by matrix products of the shingles on both sides."""
    num, den = similarity
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    fx, fy = np.concatenate(x), np.concatenate(y)
    if x is y:
        values, n = np.unique(fx, return_counts=True)
        both = values[n > 1]
    else:
        both = np.intersect1d(fx, fy)
    shared = np.zeros((len(x), len(y)), np.int64)
    if len(both):
        at = []
        for f, n in ((fx, nx), (fy, ny)):
            col = np.minimum(np.searchsorted(both, f), len(both) - 1)
            hit = both[col] == f
            order = np.argsort(col[hit], kind="stable")
            at.append((np.repeat(np.arange(len(n)), n)[hit][order], col[hit][order]))
        for c in range(0, len(both), COLUMNS):
            parts = []
            for (row, col), n in zip(at, (len(x), len(y)), strict=True):
                lo, hi = np.searchsorted(col, [c, c + COLUMNS])
                m = np.zeros((n, min(COLUMNS, len(both) - c)), np.float32)
                m[row[lo:hi], col[lo:hi] - c] = 1
                parts.append(m)
            shared += (parts[0] @ parts[1].T).astype(np.int64)
    return den * shared >= num * (nx[:, None] + ny - shared)


def _joins(ca: np.ndarray, cb: np.ndarray) -> list[int]:
    """The places of those pairs that join components which the pairs before have not."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for k, (a, b) in enumerate(zip(ca.tolist(), cb.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[a] = b
            out.append(k)
    return out


TILES = "a binary, b binary, tree int, prefix long, x int, y int"


def _screened(similarity: tuple[int, int]):
    """(a, b) of the tiles with few candidates; (tree, prefix, x, y) of those with many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                half = r["x"] == r["y"]
                kx, ky = r["kx"], r["ky"]
                sx, sy = (np.frombuffer(b"".join(r[c]), np.uint64).reshape(-1, WORDS) for c in ("sx", "sy"))
                i, j = _agreeing(sx, sy, np.array(r["cx"]), np.array(r["cy"]), similarity, half)
                rich = len(i) > RICH * (len(kx) + len(ky))
                pairs = [] if rich else [(min(p), max(p)) for p in zip((kx[m] for m in i), (ky[m] for m in j), strict=True)]
                n = len(pairs) + rich
                name = [[None] * len(pairs) + [r[c]] * rich for c in ("tree", "prefix", "x", "y")]
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs] + [None] * rich, pa.binary()), pa.array([p[1] for p in pairs] + [None] * rich, pa.binary()), pa.array(name[0], pa.int32()), pa.array(name[1], pa.int64()), pa.array(name[2], pa.int32()), pa.array(name[3], pa.int32())], names=["a", "b", "tree", "prefix", "x", "y"])

    return run


def _settled(similarity: tuple[int, int]):
    """(a, b): links of a tile, by full sets, as many as join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = [np.frombuffer(s, np.uint64) for s in r["sx"]]
                y = x if r["x"] == r["y"] else [np.frombuffer(s, np.uint64) for s in r["sy"]]
                cx, cy = np.array(r["cx"]), np.array(r["cy"])
                i, j = np.nonzero(_similar(x, y, similarity) & (cx[:, None] != cy))
                keep = _joins(cx[i], cy[j])
                pairs = [(min(p), max(p)) for p in ((r["kx"][i[k]], r["ky"][j[k]]) for k in keep)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    return run


def _dense_rows(nodes: DataFrame, open_: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(tree, prefix, pure, part, c, key, screen): the open nodes of groups that share MIN_DEPTH levels, have more nodes than
    the window and several components. A component of a block or more has blocks of its own, with itself as pure."""

    if comp is None:
        named = nodes.withColumn("component", F.col("key"))
    else:
        named = nodes.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = named.join(open_.select("key", F.lit(True).alias("open")), "key", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    rows = materialize(_prefixes(named.withColumn("c", F.xxhash64("component")), "key binary, c long, screen binary, open boolean"))
    group = ["tree", "prefix"]
    each = materialize(rows.groupBy(*group, "c").agg(F.count("*").alias("all"), F.count_if("open").alias("n")))
    sizes = each.groupBy(*group).agg(F.sum("all").alias("size"), F.count_if(F.col("n") > 0).alias("comps"), F.sum(F.when(F.col("n") < BLOCK, F.col("n"))).alias("rest")).filter((F.col("size") > WINDOW) & (F.col("comps") > 1))
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    large = each.filter(F.col("n") >= BLOCK).select(*group, "c", F.col("n").alias("own")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = [*group, "salt"]
    j = rows.filter("open").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, salt).join(large, [*salt, "c"], "left")
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    spread = lambda n: F.pmod(F.xxhash64(F.lit(1), "key"), n)
    # mixed blocks first; those of a large component after them, told apart by the component
    own = F.col("own").isNotNull()
    return j.withColumn("pure", F.when(own, F.col("c"))).withColumn("part", F.when(own, spread(parts(F.col("own")))).otherwise(spread(parts(F.col("rest"))))).select(*group, "pure", "part", "c", "key", "screen")


def _finished(base: DataFrame, nodes: DataFrame, open_: DataFrame, pairs: DataFrame, sets: DataFrame | None, comp: DataFrame | None, similarity: tuple[int, int]) -> DataFrame | None:
    """The components after all pairs of the dense groups between different components have been compared."""
    group = ["tree", "prefix"]
    rows = materialize(_dense_rows(nodes, open_, comp))
    packed = materialize(rows.groupBy(*group, "pure", "part").agg(F.collect_list(F.struct("key", "c", "screen")).alias("r")))
    if packed.isEmpty():
        return comp
    # few rows a group: one for each block
    block = (F.row_number().over(Window.partitionBy(*group).orderBy("pure", "part")) - 1).cast("int")
    named = materialize(packed.select(*group, "pure", "part").withColumn("block", block).withColumn("blocks", F.count("*").over(Window.partitionBy(*group)).cast("int")))
    blocks = materialize(packed.withColumn("_p", F.coalesce("pure", F.lit(0))).join(named.withColumn("_p", F.coalesce("pure", F.lit(0))).withColumn("_own", F.col("pure").isNotNull()).drop("pure"), [*group, "part", "_p"]).filter(F.col("_own") == F.col("pure").isNotNull()).select(*group, "block", "r"))
    other = named.select(*group, F.col("block").alias("y"), F.col("pure").alias("py"))
    tiles = named.select(*group, F.col("block").alias("x"), F.col("pure").alias("px")).join(other, group).filter((F.col("x") <= F.col("y")) & (F.col("px").isNull() | F.col("py").isNull() | (F.col("px") != F.col("py")))).select(*group, "x", "y")

    def filled(tiles: DataFrame, blocks: DataFrame, field: str) -> DataFrame:
        side = lambda e: blocks.select(*group, F.col("block").alias(e), F.col("r.key").alias(f"k{e}"), F.col("r.c").alias(f"c{e}"), F.col(f"r.{field}").alias(f"s{e}"))
        return tiles.join(side("x"), [*group, "x"]).join(side("y"), [*group, "y"]).select(*group, "x", "y", "kx", "cx", "sx", "ky", "cy", "sy")

    found = materialize(filled(tiles, blocks, "screen").mapInArrow(_screened(similarity), TILES))
    few = materialize(found.filter(F.col("a").isNotNull()).select("a", "b").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    rich = found.filter(F.col("a").isNull()).select(*group, "x", "y")
    links = None
    if not rich.isEmpty():
        ends = rich.select(*group, F.col("x").alias("block")).unionByName(rich.select(*group, F.col("y").alias("block"))).distinct()
        members = blocks.join(ends, [*group, "block"], "left_semi").select(*group, "block", F.explode("r").alias("m")).select(*group, "block", "m.key", "m.c")
        keys = members.select("key").distinct()
        sets = _sets_of(base, nodes, keys.select(F.col("key").alias("a"), F.col("key").alias("b")), sets)
        whole = materialize(members.join(sets, "key").groupBy(*group, "block").agg(F.collect_list(F.struct("key", "c", "shingles")).alias("r")))
        links = materialize(filled(rich, whole, "shingles").mapInArrow(_settled(similarity), "a binary, b binary").distinct())
    if links is not None and not links.isEmpty():
        comp = _renamed(comp, links)
    if not few.isEmpty():
        few = _between(few.withColumn("agree", F.lit(0)), comp)
        comp = _linked(few, _sets_of(base, nodes, few, sets), comp, similarity)
    return comp


def set_components(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id), one row for each row of documents."""
    bound_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = materialize(base.mapInArrow(_sketched(similarity), "doc_id long, text_key long, n_shingles long, key binary, screen binary, orders binary"))
    full = rows.filter(F.col("key").isNotNull())
    nodes = materialize(full.groupBy("key").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("screen").alias("screen"), F.first("orders").alias("orders")))
    pairs, _ = candidates(nodes, None, similarity, 1, EARLY)
    sets = _sets_of(base, nodes, pairs, None)
    comp = _linked_best(pairs, sets, None, similarity)
    here = wide = nodes
    for turn in range(1 + MAX_THINNINGS):
        if turn:
            if comp is None or dense.isEmpty():
                break
            named = dense.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
            few = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("key")))
            thin = materialize(named.withColumn("n", few).filter(F.col("n") <= HUBS).select("key"))
            if thin.count() > 0.9 * dense.count():
                break
            here = nodes.join(thin, "key", "left_semi")
        more, dense = candidates(here, comp, similarity)
        dense = materialize(dense)
        wide = wide if turn else dense
        more = materialize(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
        if not more.isEmpty():
            sets = _sets_of(base, nodes, more, sets)
            pairs = pairs.unionByName(more)
            comp = _linked_best(more, sets, comp, similarity)
    comp = _finished(base, nodes.join(wide, "key", "left_semi"), wide, pairs, sets, comp, similarity)
    if comp is None:
        named = nodes.select("key", F.col("first").alias("component_id"))
    else:
        at = nodes.select("key", "first").join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        named = at.join(at.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("key", "component_id")
    out = rows.select("doc_id", "text_key", "n_shingles", "key").join(named, "key", "left")
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets_of(base: DataFrame, nodes: DataFrame, pairs: DataFrame, have: DataFrame | None) -> DataFrame:
    """(key, shingles) of the nodes in the pairs, each text read once, besides those there are."""
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    if have is not None:
        ends = ends.join(have.select("key"), "key", "left_anti")
    wanted = materialize(nodes.join(ends, "key", "left_semi").select("key", F.col("row.doc_id").alias("_doc"), F.col("row.text_key").alias("_text")))
    if have is not None and wanted.isEmpty():
        return have
    made = materialize(_sets(base, wanted))
    return made if have is None else have.unionByName(made)


def _sets(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted nodes, from the text of their first row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([shingle_set(t, hashes).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["key", "shingles"])

    w = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    j = base.join(w, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text")))
    return j.select("key", "text").mapInArrow(build, "key binary, shingles binary").dropDuplicates(["key"])


def deduplicate(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents with the smallest doc_id of their component, as they are."""
    doc, key = fresh(docs, "_doc"), fresh(docs, "_key")
    kept = set_components(docs, similarity).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_semi")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = set_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id, n.doc_id = min(reach) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
