r"""N-gram Jaccard self-join by signature trees, as connected components of the links.

A document's set is its distinct shingles of ``k`` words (A-Z lower-cased, words ``[^\x20\x09-\x0D]+``), as 64-bit hashes.
Two documents link when den * intersection >= num * union. Nothing below drops a link; all bounds are rigorous.

1. Equal sets are one class from here on (a node named by their digest), so copies of one text are one row however many.
2. If A and B link, each holds at least ceil(num * size / den) of the other's shingles. So of the smallest hashes of A, a
   prefix as long as what B may miss plus l(A), at least min(l(A), l(B)) also stand in B's prefix. Prefix hashes meet by
   hash in packed rows; a document fewer of whose prefix hashes are in any other's is out. Documents of one batch meet
   before the shuffle, which then gets two of them for a hash that several have, so a hash of a third of all documents is
   a few rows. The number of parts follows the number of hashes, so a task's share stays bounded.
3. Of the documents left, prefix hashes are counted again; each document takes its rarest ones, as many as its prefix has
   beyond what it must share there, plus one (those it has alone need no bucket), and sends the bitmap and size of its
   whole set to the bucket of each. A bucket of more than ``CHUNK`` documents is cut in chunks, and each pair of chunks is
   a bucket of its own in a task of its own.
4. The documents of a bucket form a signature tree: sorted by size, eight to a node, a node holding the OR of its bitmaps,
   its range of sizes, and the most hashes that share bits. A dual traversal from the root against itself skips pairs of
   nodes whose largest possible overlap, bits in common plus shared-bit hashes, is too small for their smallest sizes,
   and pairs already in one set. Pairs of leaves that pass are candidates; a task emits a spanning forest of them.
5. Components of the candidates are small groups (large ones again pairs of chunks). In each the overlaps are counted
   exactly, as products of 0/1 matrices, and a spanning forest of the true links is emitted; its components are the result.

Defined results: null, empty and blank texts have 0 shingles and are their own component; a text of fewer than k words
has its word sequence as its one shingle; a very long text is one document with all its shingles; repeated rows are copies;
rows with one doc_id and different texts are documents of their own; a null doc_id is no smallest doc_id, so such rows have
a null component only if no row with an id is in it; ties cannot arise, as component ids are minima; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.llm.components import components
from ionframe.llm.textscan import LOWER, as_long, buffers, mix64, pieces, span_hashes, words
from ionframe.llm.unionfind import Forest
from ionframe.storage import Scratch, materialise, partitions, table

K, NUM, DEN = 4, 85, 100
WORD = r"[^\x20\x09-\x0D]"
WORDS = 16  # 64-bit words of a bitmap
CHUNK, FAN, PAIRS, COLUMNS = 4096, 8, 1 << 16, 4096
PART_HASHES = 4_000_000  # prefix hashes of a part, about
GROUP, SMALL, SPREAD = 1024, 128, 10  # documents of a chunk in step 5: at most, and where up to SPREAD chunks share a group
SURPLUS = 0.12  # l(n) / n in step 2
_SIZE = np.uint64(0xFFFFF)


# Sizes: what a partner must share, the prefix of step 2 and the shared hashes it asks for.


def must_share(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-num * n // den)


def surplus(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, (SURPLUS * n).astype(np.int64))


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.minimum(n, n - must_share(n, num, den) + surplus(n))


def shingle_sets(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each row, piece by piece of a batch."""
    data, offsets = buffers(column.cast(pa.large_string()))
    for a, b in pieces(offsets):
        starts, ends, bounds = words(data, offsets[a : b + 1])
        h = span_hashes(data, starts, ends, LOWER)
        count = np.diff(bounds)
        fold = np.full(len(h), np.uint64(k))
        for i in range(k):
            moved = np.concatenate([h[i:], np.zeros(min(i, len(h)), np.uint64)])
            fold = mix64(fold * np.uint64(0x9DDFEA08EB382D69) + moved)
        out = []
        for i in range(b - a):
            first, n = int(bounds[i]), int(count[i])
            if n >= k:
                own = np.sort(fold[first : first + n - k + 1])
                out.append(own[np.r_[True, own[1:] != own[:-1]]])
            elif n:
                whole = np.full(1, np.uint64(n))
                for x in h[first : first + n]:
                    whole = mix64(whole * np.uint64(0x9DDFEA08EB382D69) + x)
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    if not len(own):
        return 0, 0
    return int(as_long(np.add.reduce(mix64(own), keepdims=True))[0]), int(as_long(np.add.reduce(mix64(own ^ np.uint64(0xA0761D6478BD642F)), keepdims=True))[0])


SKETCH = "doc_id long, th long, n long, d1 long, d2 long, prefix binary"


def _sketch(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column("text"), k):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                keys = [digest(s) for s in sets]
                cut = prefix_length(n, num, den)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(sets)), batch.column("th").slice(at, len(sets)), pa.array(n), pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()), pa.array([s[:c].tobytes() for s, c in zip(sets, cut, strict=True)], pa.binary())],
                    names=["doc_id", "th", "n", "d1", "d2", "prefix"],
                )
                at += len(sets)

    return run


# Packed rows: many numbers for one part of the hash space in one row.


def packed(part: np.ndarray, names: list[str], columns: list[np.ndarray], absent: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """One row (part, column...) for each part that occurs; the columns ``absent`` are null."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[first[1:], len(part)]
    moved = [np.ascontiguousarray(c[order]) for c in columns]
    cells = [pa.array([m[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()) for m in moved]
    cells += [pa.nulls(len(first), pa.binary()) for _ in absent]
    yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *cells], names=["part", *names, *absent])


def unpacked(batches: Iterator[pa.RecordBatch], types: dict[str, type]) -> dict[str, np.ndarray]:
    """All numbers of a task's packed rows; parts are as many as bounds them."""
    found: dict[str, list[bytes]] = {name: [] for name in types}
    for batch in batches:
        for name in types:
            found[name] += [x for x in batch.column(name).to_pylist() if x is not None]
    return {name: np.frombuffer(b"".join(found[name]), dtype=t) for name, t in types.items()}


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


MET = {"hash": np.uint64, "ref": np.uint64, "seen": np.uint8, "who": np.uint64, "met": np.int64}
MET_ROWS = "part int, hash binary, ref binary, seen binary, who binary, met binary"


def meetings(h: np.ndarray, r: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (hash, ref) rows: distinct ones in order; whether a hash has several refs; whether a row was counted before."""
    order = np.lexsort((r, h))
    h, r, seen = h[order], r[order], seen[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    counted = np.maximum.reduceat(seen, first)
    h, r = h[first], r[first]
    beside = h[1:] == h[:-1]
    return np.stack([h, r]), np.r_[False, beside] | np.r_[beside, False], counted.astype(bool)


def _prefix_rows(parts: int):
    """Rows (hash, ref, seen) for the shuffle by hash, and (who, met): how many hashes a ref shares with others of its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n"))
            ref = (np.asarray(batch.column("d1")).view(np.uint64) & ~_SIZE) | np.minimum(n, int(_SIZE)).astype(np.uint64)
            found = batch.column("prefix").to_pylist()
            hashes = np.frombuffer(b"".join(found), np.uint64)
            if not len(hashes):
                continue
            (h, r), several, _ = meetings(hashes, np.repeat(ref, [len(x) // 8 for x in found]), np.zeros(len(hashes), np.uint8))
            who, met = np.unique(r[several], return_counts=True)
            # two refs of a hash are enough for other batches' refs to find a partner there
            again = np.r_[False, h[1:] == h[:-1]]
            third = again & np.r_[False, again[:-1]]
            sent = ~third
            yield from packed(part_of(h[sent], parts), ["hash", "ref", "seen"], [h[sent], r[sent], several[sent].astype(np.uint8)], ("who", "met"))
            yield from packed(part_of(who, parts), ["who", "met"], [who, met.astype(np.int64)], ("hash", "ref", "seen"))

    order = [x.split()[0] for x in MET_ROWS.split(", ")]

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select(order)

    return ordered


def _met(parts: int):
    """In how many hashes each ref meets another, as far as one task or batch sees it: (ref, met) by ref."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, MET)
        yield from packed(part_of(x["who"], parts), ["ref", "met"], [x["who"], x["met"]])
        if len(x["hash"]):
            (_, r), several, counted = meetings(x["hash"], x["ref"], x["seen"])
            refs, n = np.unique(r[several & ~counted], return_counts=True)
            yield from packed(part_of(refs, parts), ["ref", "met"], [refs, n.astype(np.int64)])

    return run


def _enough(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, {"ref": np.uint64, "met": np.int64})
        refs, inverse = np.unique(x["ref"], return_inverse=True)
        met = np.bincount(inverse, weights=x["met"], minlength=len(refs))
        n = (refs & _SIZE).astype(np.int64)
        kept = refs[met >= surplus(must_share(n, num, den))]
        for i in range(0, len(kept), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(as_long(kept[i : i + 10_000]))], names=["ref"])

    return run


def bitmap(own: np.ndarray) -> np.ndarray:
    bits = np.zeros(WORDS * 64, dtype=bool)
    bits[(own & np.uint64(WORDS * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


SETS = "node long, n long, own binary, bits binary"


def _sets(k: int):
    """The whole sets of the classes' rows, once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nodes, emitted = 0, batch.column("d1").to_pylist(), set()
            for sets in shingle_sets(batch.column("text"), k):
                rows = []
                for node, own in zip(nodes[at : at + len(sets)], sets, strict=True):
                    if node not in emitted:
                        emitted.add(node)
                        rows.append((node, own))
                at += len(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([bitmap(r[1]).tobytes() for r in rows], pa.binary())],
                    names=["node", "n", "own", "bits"],
                )

    return run


def _set_rows(parts: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = prefix_length(np.asarray(batch.column("n")), num, den)
            hashes = np.frombuffer(b"".join(x[: 8 * c] for x, c in zip(batch.column("own").to_pylist(), cut, strict=True)), np.uint64)
            yield from packed(part_of(hashes, parts), ["hash", "doc"], [hashes, np.repeat(np.asarray(batch.column("node")), cut)])

    return run


def doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return part_of(mix64(doc.view(np.uint64)), parts)


def _frequencies(parts: int):
    """Sends each hash that several documents have back to them with its number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, {"hash": np.uint64, "doc": np.int64})
        if len(x["hash"]):
            _, inverse, n = np.unique(x["hash"], return_inverse=True, return_counts=True)
            df = n[inverse]
            keep = df > 1
            doc = x["doc"][keep]
            yield from packed(doc_part(doc, parts), ["doc", "hash", "df"], [doc, x["hash"][keep], df[keep].astype(np.int32)])

    return run


def _part_column(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = np.asarray(batch.column("node")), np.asarray(batch.column("n"))
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(doc), WORDS)
            yield from packed(doc_part(doc, parts), ["own_doc", "own_n", "own_bits"], [doc, n, bits])

    return run


def _buckets(parts: int, num: int, den: int):
    """Each document's rarest hashes as buckets, with its size and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, {"doc": np.int64, "hash": np.uint64, "df": np.int32, "own_doc": np.int64, "own_n": np.int64, "own_bits": np.uint64})
        if not len(x["doc"]):
            return
        docs, by = np.unique(x["own_doc"], return_index=True)
        n, bits = x["own_n"][by], x["own_bits"].reshape(-1, WORDS)[by]
        order = np.lexsort((x["hash"], x["df"], x["doc"]))
        again = (np.diff(x["doc"][order], prepend=-1) == 0) & (np.diff(x["hash"][order], prepend=np.uint64(0)) == 0)
        order = order[~again]
        doc, h, df = x["doc"][order], x["hash"][order], x["df"][order]
        at = np.searchsorted(docs, doc)
        first = np.searchsorted(doc, docs)
        shared = np.searchsorted(doc, docs, side="right") - first
        # of the prefix a partner has as many at least as step 2 asks for; hashes a document has alone are its rarest
        wanted = shared - surplus(must_share(n, num, den)) + 1
        keep = np.arange(len(doc)) - first[at] < wanted[at]
        at, h, df = at[keep], h[keep], df[keep]
        chunks = -(-df // CHUNK)
        plain = chunks == 1
        rows, keys = [at[plain]], [mix64(h[plain])]
        for i in np.flatnonzero(~plain):  # a hot bucket: every pair of chunks is one
            c, own = int(chunks[i]), int(mix64(docs[at[i] : at[i] + 1].view(np.uint64))[0] % np.uint64(chunks[i]))
            pair = np.array([min(own, j) * c + max(own, j) for j in range(c)], dtype=np.uint64)
            rows.append(np.full(c, at[i]))
            keys.append(mix64(mix64(h[i : i + 1]) + pair + np.uint64(1)))
        row, key = np.concatenate(rows), np.concatenate(keys)
        for a in range(0, len(row), 200_000):
            r = row[a : a + 200_000]
            yield from packed(part_of(key[a : a + 200_000], parts), ["key", "doc", "n", "bits"], [key[a : a + 200_000], docs[r], n[r], bits[r]])

    return run


class Tree:
    """Signature trees of all buckets of a task, level by level; items stand sorted by bucket and size."""

    def __init__(self, key: np.ndarray, n: np.ndarray, bits: np.ndarray):
        slack = n - np.bitwise_count(bits).sum(axis=1)
        self.bits, self.low, self.high, self.slack = [bits], [n], [n], [slack]
        self.first: list[np.ndarray] = [np.arange(len(n) + 1)]
        while True:
            heads_of = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            if len(heads_of) == len(key) and len(self.bits) > 1:
                return
            size = np.diff(np.r_[heads_of, len(key)])
            within = np.arange(len(key)) - np.repeat(heads_of, size)
            heads = np.flatnonzero(within % FAN == 0)
            self.first.append(np.r_[heads, len(key)])
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], heads, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], heads))
            self.high.append(np.maximum.reduceat(self.high[-1], heads))
            self.slack.append(np.maximum.reduceat(self.slack[-1], heads))
            key = key[heads]

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether documents under x and y can link."""
        low, high = self.low[level], self.high[level]
        sizes = (den * high[x] >= num * low[y]) & (den * high[y] >= num * low[x])
        most = np.bitwise_count(self.bits[level][x] & self.bits[level][y]).sum(axis=1) + np.minimum(self.slack[level][x], self.slack[level][y])
        return sizes & ((num + den) * most >= num * (low[x] + low[y]))


def candidates(tree: Tree, doc: np.ndarray, forest: Forest, num: int, den: int) -> None:
    """Links in ``forest`` (over ``doc`` numbers) all pairs of items that may link, by dual traversal of each bucket's tree."""
    top = len(tree.bits) - 1
    roots = np.arange(len(tree.bits[top]))
    stack = [(top, roots, roots)]
    while stack:
        level, x, y = stack.pop()
        if len(x) > PAIRS:
            for a in range(0, len(x), PAIRS):
                stack.append((level, x[a : a + PAIRS], y[a : a + PAIRS]))
            continue
        if level == 0:
            root = forest.labels()
            apart = root[doc[x]] != root[doc[y]]
            x, y = x[apart], y[apart]
            near = tree.possible(0, x, y, num, den)
            forest.link(doc[x[near]], doc[y[near]])
            continue
        # nodes under which all documents are in one set already
        least, most = _spread(tree, level, forest.labels()[doc])
        live = ~((least[x] == most[x]) & (least[y] == most[y]) & (least[x] == least[y]))
        x, y = x[live], y[live]
        near = tree.possible(level, x, y, num, den)
        x, y = x[near], y[near]
        first = tree.first[level]
        nx, ny = first[x + 1] - first[x], first[y + 1] - first[y]
        total = nx * ny
        step = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        wide = np.repeat(ny, total)
        cx, cy = np.repeat(first[x], total) + step // wide, np.repeat(first[y], total) + step % wide
        ordered = (cx < cy) if level == 1 else (cx <= cy)
        stack.append((level - 1, cx[ordered], cy[ordered]))


def _spread(tree: Tree, level: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    least = most = labels
    for k in range(1, level + 1):
        heads = tree.first[k][:-1]
        least, most = np.minimum.reduceat(least, heads), np.maximum.reduceat(most, heads)
    return least, most


def _forest_rows(ids: np.ndarray, forest: Forest) -> Iterator[pa.RecordBatch]:
    root = forest.labels()
    some = np.flatnonzero(root != np.arange(len(root)))
    for i in range(0, len(some), 10_000):
        part = some[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ids[root[part]])], names=["a", "b"])


def _traverse(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = unpacked(batches, {"key": np.uint64, "doc": np.int64, "n": np.int64, "bits": np.uint64})
        if not len(x["key"]):
            return
        order = np.lexsort((x["doc"], x["n"], x["key"]))
        key = x["key"][order]
        twin = np.r_[False, key[1:] == key[:-1]]
        order = order[twin | np.r_[twin[1:], False]]  # a bucket of one has no pair
        if not len(order):
            return
        ids, doc = np.unique(x["doc"][order], return_inverse=True)
        forest = Forest(len(ids))
        candidates(Tree(x["key"][order], x["n"][order], x["bits"].reshape(-1, WORDS)[order]), doc, forest, num, den)
        yield from _forest_rows(ids, forest)

    return run


def linked(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets that link, counted exactly."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = den * both >= num * (n[0] + n[1] - both)
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = int(column[-1]) + 1
    for a in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, width - a)), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        overlap += x @ x.T
    i, j = np.nonzero(np.triu(den * overlap >= num * (n[:, None] + n[None, :] - overlap), 1))
    return i, j


def _verify(num: int, den: int):
    """Per group of a sorted partition, (comp, i, j): a spanning forest of the true links."""

    def links(ids: list[int], owned: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            forest = Forest(len(ids))
            forest.link(*linked([np.frombuffer(b, np.uint64) for b in owned], num, den))
            yield from _forest_rows(np.array(ids, dtype=np.int64), forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, owned = None, [], []
        for batch in batches:
            for key, doc, own in zip(zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j")), strict=True), batch.column("node").to_pylist(), batch.column("own").to_pylist(), strict=True):
                if key != group:
                    yield from links(ids, owned)
                    group, ids, owned = key, [], []
                ids.append(doc)
                owned.append(own)
        yield from links(ids, owned)

    return run


def _parts(sketch: DataFrame, num: int, den: int) -> int:
    """How many parts the hash space is dealt in: as many as the session's partitions, and more where hashes are many."""
    prefix = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * num / den) + F.greatest(F.lit(1), F.col("n") * SURPLUS))
    total = sketch.agg(F.sum(prefix)).first()[0] or 0
    return max(partitions(sketch.sparkSession), int(total) // PART_HASHES)


def _rows_and_classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n, d1, d2), and per class (d1, d2, n) its component, that component's least doc_id, and the least row of the class."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    sketch = scratch.table(texts.mapInArrow(_sketch(k, num, den), SKETCH), "sketch")
    parts = _parts(sketch, num, den)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = scratch.table(sketch.where("n > 0").groupBy("d1", "d2", "n").agg(least.alias("x")).select("d1", "d2", "n", F.col("x.doc_id").alias("rep"), F.col("x.th").alias("rep_th")), "set-classes")

    meet = sketch.where("n > 0").select("n", "d1", "prefix").mapInArrow(_prefix_rows(parts), MET_ROWS)
    met = meet.repartition(parts, "part").mapInArrow(_met(parts), "part int, ref binary, met binary")
    left = scratch.table(met.repartition(parts, "part").mapInArrow(_enough(num, den), "ref long"), "set-survivors")

    size = int(_SIZE)
    ref = F.col("d1").bitwiseAND(F.lit(~size)).bitwiseOR(F.least("n", F.lit(size)))
    reps = scratch.table(classes.withColumn("_ref", ref).join(left, F.col("_ref") == F.col("ref"), "left_semi").select("rep", "rep_th", "d1"), "set-reps")
    # one strategy at every size: texts meet the chosen rows by a shuffle, never by a broadcast of what grows
    chosen = texts.join(reps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))).select("text", "d1")
    sets = scratch.table(chosen.mapInArrow(_sets(k), SETS), "sets")

    returned = sets.select("node", "n", "own").mapInArrow(_set_rows(parts, num, den), "part int, hash binary, doc binary").repartition(parts, "part").mapInArrow(_frequencies(parts), "part int, doc binary, hash binary, df binary")
    owners = sets.select("node", "n", "bits").mapInArrow(_part_column(parts), "part int, own_doc binary, own_n binary, own_bits binary")
    buckets = returned.unionByName(owners, allowMissingColumns=True).repartition(parts, "part").mapInArrow(_buckets(parts, num, den), "part int, key binary, doc binary, n binary, bits binary")
    maybe = scratch.table(buckets.repartition(parts, "part").mapInArrow(_traverse(num, den), "a long, b long"), "candidates")

    groups = components(maybe).withColumnRenamed("node", "doc")
    sizes = groups.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.least(F.lit(SPREAD), F.ceil(F.count(F.lit(1)) / SMALL))).cast("int").alias("chunks"))
    placed = scratch.table(groups.join(sizes, "component").select("doc", F.col("component").alias("comp"), "chunks"), "candidate-groups")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = sets.join(placed.hint("merge"), F.col("node") == F.col("doc")).withColumn("own_chunk", own).select("node", "own", "comp", "own_chunk", other.alias("other")).select("node", "own", "comp", F.least("own_chunk", "other").alias("i"), F.greatest("own_chunk", "other").alias("j"))
    true = scratch.table(tiles.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node").select("comp", "i", "j", "node", "own").mapInArrow(_verify(num, den), "a long, b long"), "jaccard-links")

    found = components(true).withColumnRenamed("node", "doc")
    member = scratch.table(classes.join(found, F.col("d1") == F.col("doc"), "left").select("d1", "d2", "n", F.coalesce("component", "d1").alias("component"), "rep", "rep_th"), "set-members")
    ids = scratch.table(member.groupBy("component").agg(F.min("rep").alias("least")), "set-least")
    named = scratch.table(member.join(ids, "component"), "set-components")
    rows = scratch.table(sketch.select("doc_id", "th", "n", "d1", "d2"), "set-rows")
    scratch.drop_all_but("set-components", "set-rows")
    return rows, named


def jaccard_components(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id."""
    rows, named = _rows_and_classes(docs, k, num, den)
    classes = named.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("en"), "least")
    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("en"))
    return rows.join(classes.hint("merge"), same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def first_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` per component, with its own columns: the smallest doc_id (a null one last), of rows with that id and
    different texts the one with the smaller text hash, of equal rows one. Texts without words link with nothing and all stay."""
    _, named = _rows_and_classes(docs, k, num, den)
    rank = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_th"))
    kept = materialise(named.groupBy("component").agg(rank.alias("x")).select(F.col("x.rep").alias("_kept_id"), F.col("x.rep_th").alias("_kept_th")), "kept-rows")
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_worded"))
    named_rows = whole.where("_worded").join(kept.hint("merge"), F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_th") == F.col("_kept_th")), "left_semi")
    place = F.row_number().over(W.partitionBy("_id", "_th").orderBy(F.to_json("_row")))
    one = named_rows.withColumn("_place", place).where("_place = 1").select("_row")
    return one.unionByName(whole.where("NOT _worded").select("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {K} THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i : i + {K - 1}], ' ') FOR i IN range(1, len(w) - {K - 2})] END)) AS s FROM w
), n AS (
  SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n p ON o.a = p.doc_id JOIN n q ON o.b = q.doc_id WHERE {DEN} * o >= {NUM} * (p.n + q.n - o)
), r(node, reach) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON n.doc_id = r.node GROUP BY n.doc_id, n.n
"""
