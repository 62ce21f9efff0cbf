"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, recomputed in double precision where needed.

Equal vectors are one class first (a number, smallest vec_id, count), so a vector repeated in a third of all rows is one
row. The classes are scaled to length 1 (by a power of two first, so that no square under- or overflows), ordered by their
angle to a fixed direction and cut into tiles. A vector v is stored as an int8 vector q and a scale s; e = |v - s q| is
computed per vector. Then |u.v - su sv qu.qv| <= eu |sv qv| + ev |su qu| + eu ev. Integer products are sums of blocks of
``EXACT`` columns, within which single precision holds every partial sum exactly, so the bound holds in any dimension.

Tiles that follow each other form groups, and two groups meet in one task if their angles to the direction leave room for
a link (the triangle inequality on angles); so a tile travels once for each partner group, not for each partner tile, and
as one byte a component. There each tile meets those in reach. Pairs whose bound clears the threshold are links, pairs
whose bound stays below it are none, and the vectors of all other pairs are named: only these are sent again, in double
precision, to the same two groups, where exactly those pairs are decided.

A task emits the number of links of each class, and a spanning forest of the links, never the pairs.

Defined results: a row is a vector of its own, also where rows share a vec_id, and equal rows link with each other; vectors
that are null, zero, or hold null or non-finite components link with nothing and are their own component; vectors of
different lengths never link; a null vec_id is no smallest vec_id, so a component without any other has a null component_id
and such rows are kept; very long vectors are as any; extra columns are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm.components import components
from ionframe.llm.unionfind import Forest
from ionframe.storage import Scratch, partitions, table

THRESHOLD, TILE, STRIP = 0.95, 1024, 512
#: 127 * 127 * EXACT is below 2 ** 24.
EXACT = 1040
#: Rows of a tile times its columns at most, and bytes of a group about.
TILE_VALUES, GROUP_BYTES = 1 << 22, 1 << 24
#: Far more than the roundings of double precision in any of the sums here.
ROUNDING = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -exponent[:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, |s q|, e) of unit vectors, the last two rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.clip(np.rint(x / scale[:, None]), -127, 127)
    near = q * scale[:, None]
    up = 1 + 1e-12
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", near, near)) * up, np.sqrt(np.einsum("ij,ij->i", x - near, x - near)) * up + 1e-12


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The integer products of two int8 matrices' rows."""
    out = np.zeros((len(q), len(r)))
    for a in range(0, q.shape[1], EXACT):
        out += q[:, a : a + EXACT].astype(np.float32) @ r[:, a : a + EXACT].astype(np.float32).T
    return out


def sorted_pairs(qx: tuple, qy: tuple, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Strip by strip of x: its first row, the pairs (i, j) that surely link, and those that may."""
    (q, s, norm, err), (r, t, norm2, err2) = qx, qy
    for a in range(0, len(q), STRIP):
        b = min(a + STRIP, len(q))
        near = products(q[a:b], r) * (s[a:b, None] * t[None, :])
        slack = err[a:b, None] * norm2[None, :] + err2[None, :] * norm[a:b, None] + err[a:b, None] * err2[None, :] + ROUNDING
        sure = near - slack >= threshold
        i, j = np.nonzero(sure)
        k, o = np.nonzero((near + slack >= threshold) & ~sure)
        yield a, i + a, j, k + a, o


TILES = "size int, tile long, low double, high double, nodes binary, counts binary, q binary, bounds binary"


def _tile(tile: int):
    """Packs the rows of a sorted partition, (size, angle, node, n, v), into tiles; a tile's number is its task's and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table, last: bool) -> Iterator[tuple[int, pa.RecordBatch]]:
            """Whole tiles, and the rows up to which they go."""
            size = np.asarray(rows.column("size"))
            cuts = np.flatnonzero(np.r_[True, size[1:] != size[:-1], True])
            for x, y in zip(cuts, cuts[1:], strict=False):
                step = max(1, min(tile, TILE_VALUES // int(size[x])))
                for a in range(x, y, step):
                    b = min(a + step, y)
                    if b == len(size) and b - a < step and not last:
                        return
                    part = rows.slice(a, b - a).combine_chunks()
                    values = np.asarray(part.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(b - a, -1)
                    angle = np.asarray(part.column("angle"))
                    q, *bounds = quantised(unit(values))
                    cells = [int(size[a]), number, float(angle.min()), float(angle.max()), *[np.asarray(part.column(c), dtype=np.int64).tobytes() for c in ("node", "n")], q.tobytes(), np.stack(bounds).tobytes()]
                    yield b, pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=[c.split()[0] for c in TILES.split(", ")])

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            rows, to = pa.Table.from_batches(held), 0
            for to, one in packed(rows, last):
                yield one.set_column(1, "tile", pa.array([number], pa.int64()))
                number += 1
            held = rows.slice(to).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * tile:
                yield from emit(False)
        if held:
            yield from emit(True)

    return run


class Side:
    """One group's classes in the order of its tiles, or those of them that are named for double precision."""

    def __init__(self, tiles: list[dict] | None = None, nodes: np.ndarray | None = None, counts: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.tiles, self.vectors = sorted(tiles or [], key=lambda r: r["tile"]), vectors
        each = [np.frombuffer(r["nodes"], np.int64) for r in self.tiles]
        self.first = np.r_[0, np.cumsum([len(n) for n in each])].astype(int)
        none = [np.zeros(0, np.int64)]
        self.nodes = np.concatenate(each + none) if nodes is None else nodes
        self.counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in self.tiles] + none) if counts is None else counts

    def quantised(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row = self.tiles[i]
        n = self.first[i + 1] - self.first[i]
        return np.frombuffer(row["q"], np.int8).reshape(n, -1), *np.frombuffer(row["bounds"], np.float64).reshape(3, n)


FOUND = "g1 long, g2 long, node long, links long, other long, doubt boolean"


class Links:
    """What a task finds of two groups: links per class, a forest, and the classes of undecided pairs."""

    def __init__(self, left: Side, right: Side | None):
        self.left, self.same = left, right is None
        self.right = left if right is None else right
        self.shift = 0 if self.same else len(left.nodes)
        self.nodes = left.nodes if self.same else np.r_[left.nodes, self.right.nodes]
        self.counts = left.counts if self.same else np.r_[left.counts, self.right.counts]
        self.links = np.zeros(len(self.nodes), np.int64)
        self.doubt = np.zeros(len(self.nodes), dtype=bool)
        self.forest = Forest(len(self.nodes))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of places in left and right; each pair of a group with itself comes once, as i < j."""
        j = j + self.shift
        for a, b in ((i, j), (j, i)):
            self.links += np.bincount(a, weights=self.counts[b], minlength=len(self.links)).astype(np.int64)
        self.forest.link(i, j)

    def rows(self, g1: int, g2: int) -> Iterator[pa.RecordBatch]:
        root = self.forest.labels()
        some = np.flatnonzero((self.links > 0) | self.doubt)
        for a in range(0, len(some), 10_000):
            at = some[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g1)), pa.array(np.full(len(at), g2)), pa.array(self.nodes[at]), pa.array(self.links[at]), pa.array(self.nodes[root[at]]), pa.array(self.doubt[at])], names=[c.split()[0] for c in FOUND.split(", ")])


def _once(same: bool, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = i < j if same else slice(None)
    return i[keep], j[keep]


def meet(left: Side, right: Side | None, threshold: float, reach: float) -> Links:
    """The sure links of two groups (or of one with itself, right None), and who stands in a pair that the bounds leave open."""
    found = Links(left, right)
    other = found.right
    for x, a in enumerate(left.tiles):
        qx = left.quantised(x)
        for y, b in enumerate(other.tiles):
            if found.same and y < x or a["low"] - reach > b["high"] or b["low"] - reach > a["high"]:
                continue
            for _, i, j, k, o in sorted_pairs(qx, other.quantised(y), threshold):
                found.link(*_once(found.same, i + left.first[x], j + other.first[y]))
                k, o = _once(found.same, k + left.first[x], o + other.first[y])
                found.doubt[k] = True
                found.doubt[o + found.shift] = True
    return found


def decide(left: Side, right: Side | None, threshold: float) -> Links:
    """The links among the pairs that the bounds leave open, in double precision; the vectors are the groups' named ones."""
    found = Links(left, right)
    other = found.right
    xs, ys = left.vectors, other.vectors
    for a in range(0, len(xs), TILE):
        qx = quantised(xs[a : a + TILE])
        for b in range(0, len(ys), TILE):
            if found.same and b < a:
                continue
            for _, _, _, k, o in sorted_pairs(qx, quantised(ys[b : b + TILE]), threshold):
                for c in range(0, len(k), 1 << 16):
                    i, j = _once(found.same, k[c : c + (1 << 16)] + a, o[c : c + (1 << 16)] + b)
                    near = np.einsum("ij,ij->i", xs[i], ys[j]) >= threshold
                    found.link(i[near], j[near])
    return found


def _of_tiles(rows: pa.Table) -> Side:
    return Side(tiles=rows.to_pylist())


def _of_vectors(rows: pa.Table) -> Side:
    node, n = (np.asarray(rows.column(c), dtype=np.int64) for c in ("node", "n"))
    values = np.asarray(rows.column("v").combine_chunks().flatten(), dtype=np.float64)
    return Side(nodes=node, counts=n, vectors=unit(values.reshape(len(node), -1)) if len(node) else np.zeros((0, 1)))


def _groups(side_of, work):
    """Runs ``work`` on the two sides of each (g1, g2) of a sorted partition."""

    def told(key: tuple[int, int], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        side = np.asarray(rows.column("side"))
        left, right = (side_of(rows.take(np.flatnonzero(side == k))) for k in (0, 1))
        yield from work(left, None if key[0] == key[1] else right).rows(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            g1, g2 = (np.asarray(batch.column(c)) for c in ("g1", "g2"))
            cuts = np.flatnonzero(np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1]), True])
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = int(g1[a]), int(g2[a])
                if here != key and held:
                    yield from told(key, held)
                    held = []
                key = here
                held.append(batch.slice(a, b - a))
        if held:
            yield from told(key, held)

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, node) of the classes in tiles."""
    for batch in batches:
        for g, nodes in zip(batch.column("g").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
            own = np.frombuffer(nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g)), pa.array(own)], names=["g", "node"])


def linked_pairs(x: np.ndarray, y: np.ndarray, qx: tuple, qy: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of unit vectors with a cosine of ``threshold`` or more, strip by strip of x."""
    for _, i, j, k, o in sorted_pairs(qx, qy, threshold):
        near = np.einsum("ij,ij->i", x[k], y[o]) >= threshold
        yield np.r_[i, k[near]], np.r_[j, o[near]]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row of (vec_id, embedding): vec_id, n_links, component_id, kept. Tiles hold ``tile`` rows at most."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(usable, F.transform("v", lambda x: x + 0.0)).alias("v"))  # -0.0 becomes 0.0
    hashed = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    keyed = scratch.table(hashed.select("vec_id", "h1", "h2"), "vector-keys")
    classes = hashed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    # the direction is the alternating unit vector of the row's own length: a rule, not data
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = classes.withColumn("w", F.transform("v", lambda x: x / most))
    dot = F.aggregate(F.transform("w", lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x)
    cosine = dot / F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x) * F.size("w"))
    angled = scaled.select("node", "n", "v", F.size("v").alias("size"), F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))).alias("angle"))
    # so many groups that their pairs keep all tasks busy, and more where a group would be large; a group is one task's tiles
    total = classes.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0
    groups = max(math.ceil(math.sqrt(4 * partitions(spark))), math.ceil(total / GROUP_BYTES))
    tiles = scratch.table(angled.repartitionByRange(groups, "size", "angle", "node").sortWithinPartitions("size", "angle", "node").mapInArrow(_tile(tile), TILES), "vector-tiles")
    grouped = tiles.withColumn("g", F.shiftright("tile", 32) * F.lit(1 << 32) + F.col("size"))
    spans = scratch.table(grouped.groupBy("g", "size").agg(F.min("low").alias("low"), F.max("high").alias("high")), "vector-groups")
    reach = float(np.arccos(threshold)) + 1e-7
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.size") == F.col("b.size")) & (F.col("a.g") <= F.col("b.g")) & (F.col("a.low") - reach <= F.col("b.high")) & (F.col("b.low") - reach <= F.col("a.high"))
    pairs = scratch.table(a.join(b, near).select(F.col("a.g").alias("g1"), F.col("b.g").alias("g2")), "group-pairs")
    left = pairs.select("g1", "g2", F.col("g1").alias("g"), F.lit(0).alias("side"))
    ends = scratch.table(left.unionByName(pairs.where("g1 <> g2").select("g1", "g2", F.col("g2").alias("g"), F.lit(1).alias("side"))), "group-ends")

    def met(rows: DataFrame, side_of, work) -> DataFrame:
        return rows.repartition(4 * partitions(spark), "g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_groups(side_of, work), FOUND)

    work = ends.join(grouped, "g").select("g1", "g2", "side", "tile", "low", "high", "nodes", "counts", "q", "bounds")
    sure = scratch.table(met(work, _of_tiles, lambda x, y: meet(x, y, threshold, reach)), "vector-links")
    # the vectors of undecided pairs, once for each pair of groups
    owner = scratch.table(grouped.select("g", "nodes").mapInArrow(_owners, "g long, node long"), "vector-owners")
    named = sure.where("doubt").select("g1", "g2", "node").join(owner.hint("merge"), "node").join(classes.select("node", "n", "v").hint("merge"), "node")
    named = named.select("g1", "g2", F.when(F.col("g") == F.col("g1"), 0).otherwise(1).alias("side"), "node", "n", "v")
    decided = scratch.table(met(named, _of_vectors, lambda x, y: decide(x, y, threshold)), "vector-decisions")
    found = sure.where("links > 0").unionByName(decided)

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    member = scratch.table(
        classes.select("h1", "h2", "first", "n", "node").join(counts, "node", "left").join(roots, "node", "left")
        .select("h1", "h2", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "vector-members",
    )
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = scratch.table(member.join(least, "component").select("h1", "h2", "n_links", "component_id"), "vector-results")
    scratch.drop_all_but("vector-keys", "vector-results")
    of = per_class.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n_links", "component_id")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return keyed.join(of.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v
  WHERE e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}
), r(node, reach) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.node AS vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.node = c.component_id AS kept
FROM c LEFT JOIN n ON c.node = n.a
"""
