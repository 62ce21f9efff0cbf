"""Vector code compression: product quantisation with exact integer codebooks.

A component x becomes the integer floor(1024 x); a vector is cut into ``PARTS`` equal consecutive parts. The codebook of a
part starts as that part of the ``ENTRIES`` vectors of smallest vec_id. A round gives every part to its nearest entry
(squared distance, ties to the lower index) and replaces each entry by the floor of its parts' mean; unused entries stay.

The driver holds the codebooks only (``ENTRIES`` times the dimension). Each round it builds a kd-tree for each codebook and
broadcasts the trees. Tasks search branch and bound: every part first goes down to its own leaf, which gives a first
nearest entry; then the tree is walked once for all parts of a batch, and a node is visited by the parts whose distance to
the node's box is no more than their best so far. Equal bounds are visited too, so a lower index that is as near is found.
Tasks add up counts and sums by entry and emit them once; Spark sums them as decimals.

Doubles hold every integer of a search up to 2 ** 53; batches and codebooks with larger values are searched in Python's
integers, so results are exact for any finite component.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; the dimension is that of
the first kept vector (smallest vec_id, null last, then smallest vector), rows of another are dropped; a dimension that
``PARTS`` does not divide is filled up with zeros; of equal vec_ids the smaller vector comes first; repeated rows are rows
of their own; fewer than ``ENTRIES`` vectors make a smaller codebook; errors, and sums of errors, that no long holds are the largest long; extra
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.storage import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 4, 256, 4, 1024, 8
#: Vectors that a task searches at once.
BATCH = 4096
LARGEST = (1 << 63) - 1
SUMS = "part int, entry int, place int, limb int, total decimal(38,0), n bigint"
SUM_NAMES = [c.split()[0] for c in SUMS.split(", ")]
SUM_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as doubles where they hold it exactly, as Python integers otherwise."""
    x = np.asarray(x, dtype=np.float64)
    if not x.size or np.abs(x).max() < (1 << 40):
        return np.floor(x * SCALE)
    out = np.empty(x.shape, dtype=object)
    out[...] = [[int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(v * SCALE) for v in row] for row in x.tolist()]
    return out


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """The same values as Python integers."""
    return values if values.dtype == object else values.astype(np.int64).astype(object)


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, value) with x = sum of value * 2 ** (60 * place): one for each long, more only beyond."""
    place = 0
    while not -LARGEST <= x <= LARGEST:
        yield place, x % (1 << 60)
        x >>= 60
        place += 1
    yield place, x


def _exact(*arrays: np.ndarray) -> bool:
    """Whether doubles hold every sum of squared differences of these values."""
    if any(a.dtype == object for a in arrays):
        return False
    top = max((float(np.abs(a).max()) for a in arrays if a.size), default=0.0)
    return 4 * top * top * max(1, arrays[-1].shape[-1]) < 1 << 52


@dataclass(eq=False)
class Node:
    """A node of a kd-tree: the box of its entries, and its two children or, of a leaf, its entries' indexes."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    axis: int = -1
    cut: float = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """Cuts the widest side of a node's box at the middle entry until a node has ``LEAF`` entries or one place."""
    entries = np.arange(len(book)) if entries is None else entries
    held = book[entries]
    node = Node(held.min(axis=0), held.max(axis=0), entries)
    if len(entries) <= LEAF or not held.shape[1] or (node.low == node.high).all():
        return node
    node.axis = int(np.argmax(node.high - node.low))
    values = held[:, node.axis]
    order = np.argsort(values, kind="stable")
    node.cut = values[order[len(order) // 2]]
    if node.cut == node.low[node.axis]:  # what equals the cut goes right, and left must not be empty
        node.cut = values[values > node.cut].min()
    node.left, node.right = kd_tree(book, entries[values < node.cut]), kd_tree(book, entries[values >= node.cut])
    return node


def _take(book: np.ndarray, entries: np.ndarray, parts: np.ndarray, of: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
    """Tries a leaf's entries for the parts ``of``."""
    for e in entries:
        gap = parts[of] - book[e]
        far = (gap * gap).sum(axis=1)
        better = (far < best[of]) | ((far == best[of]) & (e < index[of]))
        best[of[better]], index[of[better]] = far[better], e


def nearest(tree: Node, book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part, the lowest index of equally near ones."""
    exact = _exact(parts, book)
    if not exact:
        book, parts = whole_numbers(book), whole_numbers(parts)
    best = np.full(len(parts), np.inf, dtype=np.float64 if exact else object)
    index = np.full(len(parts), len(book), dtype=np.int64)
    home = np.empty(len(parts), dtype=object)
    down = [(tree, np.arange(len(parts)))]
    while down:
        node, of = down.pop()
        if not len(of):
            continue
        if node.left is None:
            home[of] = node
            _take(book, node.entries, parts, of, best, index)
        else:
            less = parts[of, node.axis] < node.cut
            down += [(node.left, of[less]), (node.right, of[~less])]
    walk = [(tree, np.arange(len(parts)))]
    while walk:
        node, of = walk.pop()
        low, high = (x if exact else whole_numbers(x) for x in (node.low, node.high))
        out = np.maximum(np.maximum(low - parts[of], parts[of] - high), 0)
        of = of[(out * out).sum(axis=1) <= best[of]]
        if node.left is not None:
            if len(of):
                walk += [(node.left, of), (node.right, of)]
        else:
            of = of[home[of] != node]
            if len(of):
                _take(book, node.entries, parts, of, best, index)
    return index, best


@dataclass
class Codebooks:
    """One array of entries and one kd-tree for each part."""

    books: list[np.ndarray]

    def __post_init__(self):
        self.trees = [kd_tree(b) for b in self.books]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each vector and part."""
        width = self.books[0].shape[1]
        found = [nearest(t, b, vectors[:, p * width : (p + 1) * width]) for p, (t, b) in enumerate(zip(self.trees, self.books, strict=True))]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for row in b for x in row).encode()).hexdigest()


def kept_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vector) without null vectors and those with null or non-finite components."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select("vec_id", "label", vector.alias("vector")).where(F.col("vector").isNotNull() & ~bad)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, width))
    short = width - values.shape[1]
    return np.concatenate([values, np.zeros((len(values), short), values.dtype)], axis=1) if short else values


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _sums(books: Codebooks, width: int):
    step = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), step), dtype=object) for b in books.books]
        counts = np.zeros((PARTS, len(books.books[0])), dtype=np.int64)
        for batch in _pieces(batches):
            vectors = _matrix(batch.column("vector"), width)
            codes, _ = books.codes(vectors)
            for p in range(PARTS):
                part, code = vectors[:, p * step : (p + 1) * step], codes[:, p]
                counts[p] += np.bincount(code, minlength=counts.shape[1])
                if part.dtype != object and _exact(part):
                    # below 2 ** 26 each, so the sums of a piece are exact in doubles
                    held = np.zeros((counts.shape[1], step))
                    np.add.at(held, code, part)
                    total[p] += held.astype(np.int64).astype(object)
                else:
                    np.add.at(total[p], code, whole_numbers(part))
        rows = [(p, e, i, limb, value, n if not limb else 0) for p in range(PARTS) for e, n in enumerate(counts[p].tolist()) if n for i, x in enumerate(total[p][e].tolist()) for limb, value in limbs(x)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), SUM_KINDS, strict=True)], names=SUM_NAMES)

    return run


def _coded(books: Codebooks, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            codes, far = books.codes(_matrix(batch.column("vector"), width))
            error = [min(int(x), LARGEST) for x in whole_numbers(far).sum(axis=1)]
            names = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def fitted(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[Codebooks, int, int] | None:
    """(codebooks, dimension, dimension filled up) of ``kept_vectors``; None of an empty table."""
    in_order = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    head = in_order.limit(1).collect()
    if not head:
        return None
    size = len(head[0].vector)
    width = -(-size // PARTS) * PARTS
    step = width // PARTS
    same = vectors.where(F.size("vector") == size).select("vector")
    first = in_order.where(F.size("vector") == size).limit(ENTRIES).collect()
    start = scaled(np.array([r.vector for r in first]).reshape(len(first), size))
    start = np.concatenate([start, np.zeros((len(first), width - size), start.dtype)], axis=1)
    books = Codebooks([start[:, p * step : (p + 1) * step] for p in range(PARTS)])
    for _ in range(rounds):
        sums = same.mapInArrow(_sums(books, width), SUMS).groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        totals: dict[tuple[int, int, int], list[int]] = {}
        for part, entry, place, limb, total, n in sums.collect():  # ENTRIES times the dimension, if sums are longs
            held = totals.setdefault((part, entry, place), [0, 0])
            held[0] += int(total) << (60 * limb)
            held[1] += n
        new = [whole_numbers(b).copy() for b in books.books]
        for (part, entry, place), (total, n) in totals.items():
            new[part][entry, place] = total // n
        books = Codebooks([_narrow(b) for b in new])
    return books, size, width


def _narrow(book: np.ndarray) -> np.ndarray:
    """Doubles where they hold the values of a codebook, Python integers otherwise."""
    return book.astype(np.float64) if not book.size or max(map(abs, book.ravel().tolist())) < 1 << 50 else book


CODED = "code string, error bigint"


def coded(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error) of every kept vector, the final codebooks)."""
    vectors = kept_vectors(rows)
    kinds = dict(rows.select("vec_id", "label").dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, {CODED}"
    found = fitted(vectors, rounds)
    if found is None:
        none = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in CODED.split(", ")]
        return vectors.select("vec_id", "label", *none).limit(0), None
    books, size, width = found
    return vectors.where(F.size("vector") == size).mapInArrow(_coded(books, width), schema), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = coded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = Scratch(spark).table(found, "vector-codes")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LARGEST)).cast("long").alias("label_error"))
    # one row for each label: Spark broadcasts them only below its own threshold, and can split a label of many rows
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB's form: a table of entries for each round, every part against every entry."""
    entry_rows = f"range(1, {PARTS} + 1)"
    parts = [
        "v AS (SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) for x in embedding] AS x, len(embedding) // 4 AS w FROM embeddings "
        "WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, k, x[(k - 1) * w + 1 : k * w] AS y FROM (SELECT *, unnest({entry_rows}) AS k FROM v))",
        f"b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, y AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS + 1):
        far = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(y, c)])"
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, label, k, any_value(y) AS y, min(CAST({far} AS BIGINT)) AS d, arg_min(e, CAST({far} AS HUGEINT) * {ENTRIES} + e) AS e "
            f"FROM p JOIN b{r} USING (k) GROUP BY vec_id, label, k)"
        )
        if r < ROUNDS:
            parts.append(
                f"s{r} AS (SELECT k, e, i, CAST(floor_sum AS BIGINT) AS m FROM (SELECT k, e, i, (sum(t) - ((sum(t) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum "
                f"FROM (SELECT k, e, unnest(y) AS t, generate_subscripts(y, 1) AS i FROM a{r}) GROUP BY k, e, i))"
            )
            parts.append(f"m{r} AS (SELECT k, e, list(m ORDER BY i) AS c FROM s{r} GROUP BY k, e)")
            parts.append(f"b{r + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.k = m.k AND b.e = m.e)")
    parts.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    parts.append(f"z AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM z, h"


ORACLE_SQL = _oracle()
