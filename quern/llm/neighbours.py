"""The most similar vectors of every vector, by a hash-prefix forest.

Each tree gives every vector a long hash string of 63 bits: a cross-polytope symbol (the signed axis nearest to the
randomly rotated vector – 7 bits in 64 dimensions) followed by the signs of further random projections. A tree is
the *sorted array* of these strings. The vectors that share the first ``x`` bits with a given one, its cell at
depth ``x``, are a run of that array.

*Descent.* In each tree the cells of every vector are measured from the deepest depth on, by comparing the strings
that stand next to each other: the longest prefix it shares with any other, and how many share each shorter one.

*Ascent.* All trees ascend in step. From the deepest depth on, the candidates that the cells of all trees hold
are added up, and the first depth at which they are ``CANDIDATES`` is the vector's own: deep where vectors are crowded,
shallow where they are sparse. In every tree it meets its cell at that depth, and is scored against it by matrix
products; pairs above the least cosine go on. At last the trees' candidates are merged and their cosines computed
exactly from the vectors as stored.

A tree is cut into blocks of even size at the quantiles of a bounded sample, by provider, string and class, so that
blocks are even however the vectors cluster. A cell that reaches over the end of its block is looked up in the
next one too, so what is found doesn't depend on the blocks. Exact copies are searched once, as one class.

How many candidates it takes depends on how near the neighbours are: those of a high cosine stand in the deepest cells, while
unrelated vectors that happen to be nearest are met only near the root. So the ascent of a stated set of vectors
(``asked``) goes on until the trees together hold twice as many candidates – with repeats – as there are vectors, and
that of all vectors ends at ``CANDIDATES``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.keys import written_provider
from quern.session import materialise

#: Length of the vectors: longer ones are cut, shorter ones filled with zeros (fixed by the data's description).
DIMENSIONS = 64
#: Trees of the forest, candidates at which the ascent ends, and strings scored at once.
TREES, CANDIDATES, TILE = 12, 1024, 256
#: Strings on either side that a vector meets at most in one tree, where a cell is larger even at the greatest depth.
REACH = 640
#: Depths at which cells are measured, in bits.
DEPTHS = (0, 4, 6, *range(7, 25), 28, 36, 63)
#: Rows of a block, blocks of a tree at most, and vectors sampled for their ends at most.
BLOCK_ROWS, MOST_BLOCKS, SAMPLE_ROWS = 100_000, 2_000, 100_000
#: Providers whose vectors aren't compared.
EXCLUDED = ("legacy:unknown",)
#: Tasks over which a class of exact copies is spread.
SALTS = 32
#: Tolerance of the scores of 8-bit vectors against the least cosine; what it lets through is scored again exactly.
SLACK = 0.015

_CODE_SCHEMA = "block int, space long, code long, node long, ask boolean"
_TREE_SCHEMA = "block int, space long, code long, node long, depth int, own boolean, ask boolean, vector binary"
#: Counts of this many depths are packed into a long: four or, for more candidates, two.
_PACK_SMALL, _PACK_LARGE = 4, 2


def usable_vectors(rows: DataFrame, key: str = "id", vector: str = "embedding", provider: str = "embed_provider") -> DataFrame:
    """``key, provider, vector`` of the rows that take part: a known provider and a vector that isn't zero.

    The provider is compared without case and surrounding blanks; null, empty and excluded ones are left out.
    Null elements count as 0, and vectors of another length are cut or filled up.
    """
    fitted = F.transform(
        F.slice(F.concat(F.col(vector), F.array_repeat(F.lit(0.0).cast("float"), DIMENSIONS)), 1, DIMENSIONS),
        lambda x: F.coalesce(F.nanvl(x, F.lit(0.0).cast("float")), F.lit(0.0).cast("float")),
    )
    return (
        rows.select(F.col(key).cast("string").alias("key"), written_provider(F.col(provider)).alias("provider"), fitted.alias("vector"))
        .where(F.col("key").isNotNull() & F.col("provider").isNotNull() & ~F.col("provider").isin(*EXCLUDED) & F.col("vector").isNotNull())
        .where(F.exists("vector", lambda x: x != 0))
    )


def classes(usable: DataFrame) -> DataFrame:
    """``key, provider, node, vector``: ``node`` is the class of exact copies within a provider."""
    return usable.withColumn("node", F.xxhash64("provider", "vector"))


class Forest:
    """The random directions of the trees, the same for a seed wherever they are made."""

    def __init__(self, trees: int = TREES, seed: int = 7):
        self.rotations, self.planes = [], []
        for t in range(trees):
            g = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(f"{seed}/{t}".encode()).digest()[:8], "big")))
            q, _ = np.linalg.qr(g.standard_normal((DIMENSIONS, DIMENSIONS)))
            self.rotations.append(q.astype(np.float32))
            self.planes.append(g.standard_normal((DIMENSIONS, 56)).astype(np.float32))

    def codes(self, unit: np.ndarray, tree: int) -> np.ndarray:
        """Hash strings of 63 bits, as integers whose order is that of the strings."""
        rotated = unit @ self.rotations[tree]
        axis = np.abs(rotated).argmax(1)
        symbol = axis * 2 + (rotated[np.arange(len(unit)), axis] > 0)
        bits = (unit @ self.planes[tree]) > 0
        code = symbol.astype(np.int64)
        packed = np.packbits(bits, axis=1).astype(np.int64)
        for b in range(7):
            code = (code << 8) | packed[:, b]
        return code


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(-1, DIMENSIONS)


def _bytes(unit: np.ndarray) -> pa.Array:
    """Vectors in 8 bits a dimension, each scaled to its largest element."""
    data = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8).tobytes()
    return pa.Array.from_buffers(pa.binary(DIMENSIONS), len(unit), [None, pa.py_buffer(data)]).cast(pa.binary())


def _unit_rows(column: pa.Array) -> np.ndarray:
    m = _matrix(column)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps the squares of very long or short vectors finite
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _keys(space: np.ndarray, code: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Byte strings whose order is that of (space, code, node)."""
    wide = np.stack([space, code, node], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(wide.astype(">u8")).view("S24").reshape(-1)


def block_ends(sample: pa.Table, trees: int, blocks: int) -> list[np.ndarray]:
    """For each tree the keys at which its blocks end, from the quantiles of a sample of vectors."""
    forest, ends = Forest(trees), []
    column = sample.column("vector").combine_chunks() if sample.num_rows else None
    unit = _unit_rows(column) if sample.num_rows else np.empty((0, DIMENSIONS), np.float32)
    space, node = (sample.column(c).to_numpy().astype(np.int64) for c in ("space", "node"))
    for t in range(trees):
        keys = np.sort(_keys(space, forest.codes(unit, t), node))
        ends.append(keys[[len(keys) * i // blocks for i in range(1, blocks)]] if len(keys) else np.empty(0, "S24"))
    return ends


def _strings(ends: list[np.ndarray]):
    """The hash strings of all trees, each with the block it belongs to."""

    def run(batches):
        forest, blocks = Forest(len(ends)), len(ends[0]) + 1
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit_rows(b.column("vector"))
            space, node = b.column("space").to_numpy(), b.column("node").to_numpy()
            for t, cut in enumerate(ends):
                code = forest.codes(unit, t)
                block = t * blocks + np.searchsorted(cut, _keys(space, code, node), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), b.column("space"), pa.array(code), b.column("node"), b.column("ask")], names=["block", "space", "code", "node", "ask"])

    return run


def cell_sizes(space: np.ndarray, code: np.ndarray, depth: int) -> np.ndarray:
    """For each string of a sorted array, how many others share its first ``depth`` bits."""
    same = (space[1:] == space[:-1]) & ((code[1:] ^ code[:-1]) >> np.int64(63 - depth) == 0) if depth else space[1:] == space[:-1]
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    sizes = np.diff(np.append(starts, len(code)))
    return np.repeat(sizes - 1, sizes)


def _read_all(batches, names: list[str]) -> list:
    held = [b for b in batches if b.num_rows]
    table = pa.Table.from_batches(held) if held else None
    return [table.column(n).combine_chunks() for n in names] if table is not None else []


def packing(pack: int, trees: int) -> tuple[int, int]:
    """Bits of each of ``pack`` counts in a long, and what one tree counts at most: sums over the trees keep apart and below the sign."""
    bits = 63 // pack
    return bits, ((1 << bits) - 1) // trees


def _descend(pack: int, trees: int):
    """The cell sizes of a block's strings that ask, at all depths, packed."""
    bits, most = packing(pack, trees)

    def run(batches):
        columns = _read_all(batches, ["space", "code", "node", "ask"])
        if not columns:
            return
        space, code, node, ask = (c.to_numpy(zero_copy_only=False) for c in columns)
        packed = [np.zeros(int(ask.sum()), np.int64) for _ in range(len(DEPTHS) // pack)]
        for i, depth in enumerate(DEPTHS):
            packed[i // pack] += np.minimum(cell_sizes(space, code, depth)[ask], most) << (bits * (i % pack))
        yield pa.RecordBatch.from_arrays([pa.array(node[ask]), *map(pa.array, packed)], names=["node", *(f"c{i}" for i in range(len(packed)))])

    return run


def depths(strings: DataFrame, blocks: int, candidates: int, trees: int = TREES) -> DataFrame:
    """``node, depth``: the depth at which the cells of all trees together first hold ``candidates`` others."""
    pack = _PACK_SMALL if candidates <= packing(_PACK_SMALL, trees)[1] else _PACK_LARGE
    bits, columns = packing(pack, trees)[0], [f"c{i}" for i in range(len(DEPTHS) // pack)]
    ordered = strings.repartitionById(blocks, "block").sortWithinPartitions("space", "code", "node")
    counts = ordered.mapInArrow(_descend(pack, trees), "node long, " + ", ".join(f"{c} long" for c in columns))
    sums = counts.groupBy("node").agg(*(F.sum(c).alias(c) for c in columns))
    at = lambda i: F.shiftright(F.col(columns[i // pack]), bits * (i % pack)).bitwiseAND(F.lit((1 << bits) - 1))
    steps = [F.when(at(i) >= candidates, F.lit(DEPTHS[i])) for i in reversed(range(len(DEPTHS)))]
    return sums.select("node", F.coalesce(*steps, F.lit(DEPTHS[0])).alias("depth"))


def _cells(space: np.ndarray, code: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest code of each string's cell."""
    rest = np.where(depth > 0, (np.int64(1) << np.minimum(63 - depth, 62).astype(np.int64)) - np.int64(1), np.iinfo(np.int64).max)
    return code & ~rest, code | rest


def _plant(ends: list[np.ndarray]):
    """The rows of all trees, each in its block, and once more in a neighbouring block into which its cell reaches."""
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def run(batches):
        forest, blocks = Forest(len(ends)), len(ends[0]) + 1
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            unit = _unit_rows(b.column("vector"))
            small = _bytes(unit)
            space, node, depth, ask = (b.column(c).to_numpy(zero_copy_only=False) for c in ("space", "node", "depth", "ask"))
            for t, cut in enumerate(ends):
                code = forest.codes(unit, t)
                own = np.searchsorted(cut, _keys(space, code, node), side="right")
                low, high = _cells(space, code, depth)
                before = np.flatnonzero((np.searchsorted(cut, _keys(space, low, np.full(n, least)), side="right") < own) & ask)
                after = np.flatnonzero((np.searchsorted(cut, _keys(space, high, np.full(n, most)), side="right") > own) & ask)
                at = np.concatenate([np.arange(n), before, after])
                block = t * blocks + np.concatenate([own, own[before] - 1, own[after] + 1])
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int32)), b.column("space").take(take), pa.array(code[at]), b.column("node").take(take),
                     b.column("depth").take(take), pa.array(np.arange(len(at)) < n), b.column("ask").take(take), small.take(take)],
                    names=["block", "space", "code", "node", "depth", "own", "ask", "vector"],
                )

    return run


def _score(k: int, least: float, reach: int):
    """Scores each string of a block against the block's part of its cell: pairs of nodes at or above ``least``, for
    each the ``k`` best and what is within ``SLACK`` of the ``k``-th, as the scores aren't exact."""

    def run(batches):
        columns = _read_all(batches, ["space", "code", "node", "depth", "own", "ask", "vector"])
        if not columns:
            return
        space, code, node, depth, own, ask = (c.to_numpy(zero_copy_only=False) for c in columns[:6])
        m = np.frombuffer(b"".join(columns[6].to_pylist()), np.int8).reshape(-1, DIMENSIONS)
        scale = 1 / np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.int32).astype(np.float32))
        here = np.flatnonzero(own)  # what the block holds; the other rows only ask
        place = np.cumsum(own) - own
        low, high = _cells(space, code, depth)
        first, last = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
        held_space, held_code = space[here], code[here]
        for s in np.unique(space):  # sorted, so each space is a run
            a, b = np.searchsorted(held_space, [s, s + 1] if s < np.iinfo(np.int64).max else [s, s], side="left")
            b = len(held_space) if s == np.iinfo(np.int64).max else b
            mine = np.flatnonzero(space == s)
            first[mine] = a + np.searchsorted(held_code[a:b], low[mine], side="left")
            last[mine] = a + np.searchsorted(held_code[a:b], high[mine], side="right")
        first, last = np.maximum(first, place - reach), np.minimum(last, place + reach + 1)
        held, nodes, weight = m[here], node[here], scale[here]
        asking = np.flatnonzero(ask)
        for lo in range(0, len(asking), TILE):
            of = asking[lo : lo + TILE]
            a, b = int(first[of].min()), int(last[of].max())
            if a >= b:
                continue
            g = (m[of].astype(np.float32) * scale[of, None]) @ (held[a:b].astype(np.float32) * weight[a:b, None]).T
            columns = np.arange(a, b)
            g[(columns < first[of, None]) | (columns >= last[of, None]) | (nodes[a:b] == node[of, None])] = -2.0
            bound = np.partition(g, -k, axis=1)[:, -k] - SLACK if b - a > k else np.full(len(of), -2.0)
            i, j = np.nonzero(g >= np.maximum(bound, max(least, -1.5))[:, None])
            i, j = of[i], j + a
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(nodes[j])], names=["a", "b"])

    return run


def similar_pairs(vectors: DataFrame, n: int, k: int, min_cosine: float, trees: int = TREES, candidates: int = CANDIDATES, reach: int = REACH) -> DataFrame:
    """Candidate pairs of nodes ``a, b`` (``b`` for ``a``) from the whole forest.

    ``vectors``: ``node, space, vector, ask``, ``n`` rows, one for each node; partners are looked for of those that ask.
    """
    blocks = max(1, min(MOST_BLOCKS, -(-n // BLOCK_ROWS)))
    sampled = min(SAMPLE_ROWS, 4_000 * blocks)
    some = vectors if n <= sampled else vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.lit(int((1 << 20) * 0.9 * sampled / n)))
    ends = block_ends(some.select("space", "node", "vector").toArrow() if blocks > 1 else some.limit(0).select("space", "node", "vector").toArrow(), trees, blocks)
    asked = depths(vectors.select("space", "node", "vector", "ask").mapInArrow(_strings(ends), _CODE_SCHEMA), trees * blocks, candidates, trees)
    deep = vectors.join(asked, "node", "left").withColumn("depth", F.coalesce("depth", F.lit(DEPTHS[-1])))
    planted = deep.select("space", "node", "vector", "ask", "depth").mapInArrow(_plant(ends), _TREE_SCHEMA)
    ordered = planted.repartitionById(trees * blocks, "block").sortWithinPartitions("space", "code", "node")
    return ordered.mapInArrow(_score(k, min_cosine - SLACK, reach), "a long, b long").distinct()


def nearest(rows: DataFrame, k: int = 10, min_cosine: float = -1.0, trees: int = TREES, candidates: int = CANDIDATES, reach: int = REACH, key: str = "id", vector: str = "embedding", provider: str = "embed_provider", asked: Column | None = None) -> DataFrame:
    """For every key its ``k`` most similar keys of the same provider with a cosine of at least ``min_cosine``.

    Returns ``key_a, key_b, cosine, rank``: ``key_b`` is the ``rank``-th most similar of ``key_a``. Repeated keys
    count once; equal cosines rank by key. A key with vectors of several providers is searched in each. What
    other columns there are is ignored; null and zero vectors and unknown providers take no part.

    Copies: the members of a class of exact copies are each other's nearest, in order of key; they are linked
    through the class, ``k`` neighbours for each member, and never all pairs.

    ``asked``: a condition on ``key``; only for keys that meet it are neighbours looked for, among all. Their ascent ends where
    the trees together hold twice as many candidates as there are vectors.
    """
    asks = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    members = materialise(classes(usable_vectors(rows, key, vector, provider)).select("key", "provider", "node", "vector", asks.alias("ask")), "members")
    keys = members.select("key", "node").distinct()
    wanted = keys if asked is None else members.where("ask").select("key", "node").distinct()
    # Bucketed by node, so that what joins to it shuffles no vectors.
    one = members.groupBy("node").agg(F.xxhash64(F.first("provider")).alias("space"), F.first("vector").alias("vector"), F.max("ask").alias("ask"))
    distinct = materialise(one, "distinct_vectors", bucket_by=(max(12, members.count() // 500_000), ["node"]))
    n = distinct.count()
    if asked is not None:
        candidates, reach = max(candidates, 2 * n), max(reach, n)
    pairs = similar_pairs(distinct, n, k, min_cosine, trees, candidates, reach)

    # Exact cosines of the candidate pairs, from the vectors as stored.
    side = lambda n: distinct.select(F.col("node").alias(n), F.col("vector").alias(f"v_{n}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0).cast("double"), lambda s, p: s + p)
    cosine = F.expr("1D") * dot(F.col("v_a"), F.col("v_b")) / F.sqrt(dot(F.col("v_a"), F.col("v_a")) * dot(F.col("v_b"), F.col("v_b")))
    exact = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cosine", cosine).where(F.col("cosine") >= min_cosine).select("a", "b", "cosine")

    # Of each class at most k + 1 keys, the least, can be among the k nearest of anything. Found in two steps, so
    # that a class of any number of copies is spread over tasks.
    salted = Window.partitionBy("node", F.pmod(F.xxhash64("key"), F.lit(SALTS))).orderBy("key")
    some = keys.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = some.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("key"))).where(F.col("n") <= k + 1)
    own = (
        wanted.select(F.col("key").alias("key_a"), "node")
        .join(few.select(F.col("key").alias("key_b"), "node"), "node")
        .where("key_a <> key_b")
        .select("key_a", "key_b", F.lit(1.0).alias("cosine"))
    )
    other = (
        exact.join(wanted.select(F.col("key").alias("key_a"), F.col("node").alias("a")), "a")
        .join(few.where(F.col("n") <= k).select(F.col("key").alias("key_b"), F.col("node").alias("b")), "b")
        .where("key_a <> key_b")
        .select("key_a", "key_b", "cosine")
    )
    best = own.unionByName(other).groupBy("key_a", "key_b").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("key_a").orderBy(F.desc("cosine"), "key_b")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_pairs(rows: DataFrame, k: int = 10, min_cosine: float = -1.0, **options) -> DataFrame:
    """Distinct unordered pairs ``id_a < id_b`` of which one at least is among the ``k`` nearest of the other."""
    found = nearest(rows, k, min_cosine, **options)
    return found.select(F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b")).distinct()
