"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and their beginnings of 4, 5 and 6 bytes (a crude stem). A bounded sample of labelled rows
makes the example vectors, over every term of their texts: tf-idf times the root of the term's chi-square against the label
(1 at least, so no term is dropped), scaled to length 1 over all terms of the text. A text's vector is scaled over all its
terms too; one that no example has weighs as a term of no document. Examples with one and the same vector are one entry
with its label counts. Entries stand in blocks. Terms of at most ``COMMON`` entries have postings, from which their part of
the cosine is summed exactly; of the other terms the largest weight in each block bounds the rest. A text first opens its
``FIRST`` blocks of the highest bounds, then every block whose bound reaches the k-th best cosine found there. Texts are
taken ``BATCH`` at a time, and a block's single-precision product is one for all texts that open it. It picks entries,
double precision decides, so these are the k nearest entries exactly. They vote with weight cosine squared; a logistic
curve fitted on leave-one-out votes of the examples turns the vote into a probability. Where the sample draws the labels
at different shares, examples count by the inverse of their label's share, so a score means the same at every size. The
nearest examples' doc_ids are the evidence.

The driver receives at most ``max_examples`` sparse vectors, as large as these examples' texts, however often a labelled
doc_id is repeated; executors get the index. Every document is scored over its whole text.

Defined results: a text without any term of an example (also an empty or null one) gets the smoothed share of label 1
among examples without a term; without a labelled row, or with one label only, every score is the smoothed share of label 1 (0 of
0: 0); of several labels of one doc_id the largest counts; labelled rows with one doc_id and one text are one example, with
different texts several; examples of equal cosine count in the order of their entries; a null doc_id is not held out and
never trains; repeated rows are scored alike; a very long text is scored over all its terms; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm.langid import held_out
from ionframe.llm.textscan import buffers, pieces, span_hashes, words
from ionframe.storage import materialise, table

MAX_EXAMPLES, TOXIC_SHARE = 6000, 1 / 3
NEAREST, BLOCK, SMOOTHING = 15, 64, 0.5
STEMS = (4, 5, 6)
#: Terms of more entries have rows instead of postings, the ROWS most frequent of them at most.
COMMON, ROWS = 400, 2048
FIRST, BATCH = 4, 64
#: Bytes that end a word: ASCII but letters and digits.
NO_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def terms_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row of each term, hash of each term) over bounded pieces of a batch."""
    data, offsets = buffers(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    for a, b in pieces(offsets):
        starts, ends, bounds = words(data, offsets[a : b + 1], NO_WORD)
        row = np.repeat(np.arange(b - a), np.diff(bounds))
        rows, hashes = [row], [span_hashes(data, starts, ends)]
        for n in STEMS:
            longer = ends - starts > n
            rows.append(row[longer])
            hashes.append(span_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n))
        yield a, b, np.concatenate(rows), np.concatenate(hashes)


def counts_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted terms, counts) of each row."""
    for a, b, row, hashes in terms_of(column):
        order = np.argsort(row, kind="stable")
        hashes, bounds = hashes[order], np.searchsorted(row[order], np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, .. of each span, one span after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    narrow = np.int32 if total < 1 << 30 and (not len(first) or int(first.max()) < 1 << 30) else np.int64
    return np.repeat((first - ends + size).astype(narrow), size) + np.arange(total, dtype=narrow)


@dataclass
class Index:
    """Terms, entries in blocks, and what scores a vote."""

    terms: np.ndarray  # sorted hashes
    idf: np.ndarray  # times the label's part in the weight
    prior: float  # of a text without terms
    unseen: float = 1.0  # idf of a term of no example
    entry_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # postings by term: entry, weight
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # row of a common term, -1 of others
    rows: np.ndarray | None = field(default_factory=lambda: np.zeros((0, 0, BLOCK), np.float32))  # by block, common term, entry
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # by common term, block
    common_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # common terms by entry: row, weight
    common_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    common_first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    ones: np.ndarray = field(default_factory=lambda: np.zeros(0))
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    evidence: list[list[int]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, columns: np.ndarray, counts: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
        """Weights of ``columns``; ``others`` are the counts of the text's terms that no example has."""
        x = (1 + np.log(counts)) * self.idf[columns]
        square = (x * x).sum()
        if others is not None and len(others):
            square += (((1 + np.log(others)) * self.unseen) ** 2).sum()
        return x / np.sqrt(square)

    @property
    def slack(self) -> float:
        """No single-precision cosine over the common terms is off by more: (terms + 8) roundings of sums below 1."""
        return (len(self.block_max) + 8) * 2.0**-24 * 1.1

    def lay_rows(self) -> None:
        """The common terms' weights as one matrix a block; laid out where it is used, from the entries' own lists."""
        blocks = self.block_max.shape[1]
        self.rows = np.zeros((blocks, len(self.block_max), BLOCK), dtype=np.float32)
        entry = np.repeat(np.arange(blocks * BLOCK), np.diff(self.common_first))
        self.rows[entry // BLOCK, self.common_of, entry % BLOCK] = self.common_weight

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per text (columns, weights): (entries, cosines) of the k nearest with a cosine above 0, ties by entry; and the number of blocks opened."""
        if self.rows is None:
            self.lay_rows()
        n, blocks = len(texts), self.block_max.shape[1]
        text = np.repeat(np.arange(n), [len(c) for c, _ in texts])
        columns, x = (np.concatenate(a) for a in zip(*texts, strict=True))
        slot = self.slot[columns]
        common = slot >= 0
        y = np.zeros((n, len(self.block_max)))
        y[text[common], slot[common]] = x[common]
        part = np.zeros((n, blocks, BLOCK))
        for i, (own, weights) in enumerate(texts):  # one by one, as the postings of a text fit into a processor's cache
            far = self.slot[own] < 0
            size = self.first[own[far] + 1] - self.first[own[far]]
            at = spans(self.first[own[far]], size)
            product = self.weight.take(at)
            product *= np.repeat(weights[far], size)
            part[i] = np.bincount(self.entry_of.take(at), weights=product, minlength=blocks * BLOCK).reshape(blocks, BLOCK)
        bound = part.max(axis=2) + y @ self.block_max
        rough = np.full((n, blocks, BLOCK), -1.0)
        small = y.astype(np.float32)
        open_now = np.zeros((n, blocks), dtype=bool)
        np.put_along_axis(open_now, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        open_now &= bound > 0
        opened = np.zeros_like(open_now)
        for last in (False, True):
            for b in np.flatnonzero(open_now.any(axis=0)):
                some = np.flatnonzero(open_now[:, b])
                rough[some, b] = part[some, b] + small[some] @ self.rows[b]
            opened |= open_now
            if not last:
                worst = self._kth(rough.reshape(n, -1), k)
                open_now = (bound > 0) & (bound * (1 + 1e-12) >= worst[:, None] - self.slack) & ~opened
        flat, part = rough.reshape(n, -1), part.reshape(n, -1)
        chosen = (flat > -self.slack) & (flat >= self._kth(flat, k)[:, None] - 2 * self.slack) & np.repeat(opened, BLOCK, axis=1)
        text, entry = np.nonzero(chosen)
        size = self.common_first[entry + 1] - self.common_first[entry]
        at = spans(self.common_first[entry], size)
        pair = np.repeat(np.arange(len(entry)), size)
        score = part[text, entry] + np.bincount(pair, weights=y[text[pair], self.common_of[at]] * self.common_weight[at], minlength=len(entry))
        cuts = np.searchsorted(text, np.arange(n + 1))
        found = []
        for i in range(n):
            own, cosine = entry[cuts[i] : cuts[i + 1]], score[cuts[i] : cuts[i + 1]]
            best = np.lexsort((own, -cosine))[:k]
            best = best[cosine[best] > 0]
            found.append((own[best], cosine[best], int(opened[i].sum())))
        return found

    @staticmethod
    def _kth(rough: np.ndarray, k: int) -> np.ndarray:
        """The k-th largest of each row, 0 at least."""
        if rough.shape[1] <= k:
            return np.zeros(len(rough))
        return np.maximum(np.partition(rough, rough.shape[1] - k, axis=1)[:, -k], 0.0)

    def vote(self, found: np.ndarray, cosines: np.ndarray, ones: np.ndarray, total: np.ndarray, base: float) -> float:
        w = cosines * cosines
        share = (w @ ones[found] + SMOOTHING * base) / (w @ total[found] + SMOOTHING)
        return float(np.log(share / (1 - share)))

    @property
    def base(self) -> float:
        return float((self.ones.sum() + 0.5) / (self.total.sum() + 1))

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """(score, evidence) of each text given as columns, counts and the counts of its terms that no example has."""
        out: list[tuple[float, list[int]]] = [(self.prior, [])] * len(texts)
        some = [i for i, t in enumerate(texts) if len(t[0])] if len(self.total) else []
        base = self.base
        for a in range(0, len(some), BATCH):
            part = some[a : a + BATCH]
            for i, (found, cosines, _) in zip(part, self.nearest([(texts[i][0], self.vector(*texts[i])) for i in part]), strict=True):
                if len(found):
                    v = self.vote(found, cosines, self.ones, self.total, base)
                    out[i] = float(1 / (1 + np.exp(-(self.slope * v + self.shift)))), [e for x in found[:3] for e in self.evidence[x]][:3]
        return out


def _logistic(x: np.ndarray, ones: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through smoothed label shares, by Newton's method with a weak pull to (1, 0)."""
    n1, n = ones.sum(), total.sum()
    high, low = (n1 + 1) / (n1 + 2), 1 / (n - n1 + 2)
    target = ones * high + (total - ones) * low
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (total * p - target) + 1e-2 * (w - [1, 0])
        h = (design * (total * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.05), float(w[1])


def build(terms: np.ndarray, df: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], counted: tuple[float, float] = (1.0, 1.0)) -> Index:
    """The index over (doc_id, label, columns, counts); an example of label 0 or 1 counts as so many in shares and votes."""
    by = np.argsort(terms)
    renamed = np.empty(len(terms), dtype=np.int32)
    renamed[by] = np.arange(len(terms))
    n, n1 = len(examples), sum(e[1] for e in examples)
    bare = [e for e in examples if not len(e[2])]
    examples = sorted((e for e in examples if len(e[2])), key=lambda e: e[0])
    rows, ones = np.zeros(len(terms)), np.zeros(len(terms))
    for _, y, columns, _ in examples:  # one by one here and below: temporary arrays over all examples would be large
        rows[columns] += 1
        ones[columns] += y
    rows, ones = rows[by], ones[by]
    spread = rows * (n - rows) * n1 * (n - n1)
    chi2 = np.divide(n * (n * ones - rows * n1) ** 2, spread, out=np.zeros(len(terms)), where=spread > 0)
    idf = (np.log((1 + n) / (1 + df[by])) + 1) * np.sqrt(np.maximum(1, chi2))
    bare_ones = sum(e[1] * counted[1] for e in bare)
    index = Index(terms[by], idf, (bare_ones + 0.01) / (sum(counted[e[1]] for e in bare) + 1) if n else 0.0, float(np.log(1 + n) + 1))
    groups: dict[bytes, list] = {}
    for doc_id, y, columns, counts in examples:
        own = renamed[columns]
        order = np.argsort(own)
        own = own[order]
        x = index.vector(own, counts[order])
        key = hashlib.blake2b(own.tobytes() + np.round(x, 12).tobytes(), digest_size=16).digest()
        g = groups.setdefault(key, [own, x, 0, 0, []])
        g[2] += y * counted[1]
        g[3] += counted[y]
        if len(g[4]) < 3:
            g[4].append(doc_id)
    del examples
    entries = sorted(groups.values(), key=lambda g: (g[0][np.argmax(g[1])], len(g[0]), g[4]))
    index.ones, index.total = np.array([g[2] for g in entries], dtype=float), np.array([g[3] for g in entries], dtype=float)
    index.evidence = [g[4] for g in entries]
    if not entries:
        return index
    blocks = (len(entries) + BLOCK - 1) // BLOCK
    held = np.zeros(len(terms), dtype=np.int64)  # entries with a term
    for own, *_ in entries:
        held[own] += 1
    common = np.sort(np.argsort(-held, kind="stable")[:ROWS])
    common = common[held[common] > COMMON]
    index.slot = np.full(len(terms), -1, dtype=np.int32)
    index.slot[common] = np.arange(len(common))
    index.common_first = np.r_[0, np.cumsum([(index.slot[own] >= 0).sum() for own, *_ in entries], dtype=np.int64)]
    index.common_first = np.r_[index.common_first, np.full(blocks * BLOCK - len(entries), index.common_first[-1])]
    index.common_of, index.common_weight = np.zeros(index.common_first[-1], np.int32), np.zeros(index.common_first[-1])
    index.block_max = np.zeros((len(common), blocks))
    index.first = np.r_[0, np.cumsum(np.where(index.slot >= 0, 0, held))]
    index.entry_of, index.weight = np.zeros(index.first[-1], np.int32), np.zeros(index.first[-1])
    place = index.first[:-1].copy()
    for i, (own, x, *_) in enumerate(entries):
        slot = index.slot[own]
        near, far = slot >= 0, own[slot < 0]
        here = slice(index.common_first[i], index.common_first[i + 1])
        index.common_of[here], index.common_weight[here] = slot[near], x[near]
        index.block_max[slot[near], i // BLOCK] = np.maximum(index.block_max[slot[near], i // BLOCK], x[near])
        index.entry_of[place[far]], index.weight[place[far]] = i, x[~near]
        place[far] += 1
    index.lay_rows()
    votes, base = [], index.base
    for first in range(0, len(entries), BATCH):
        some = range(first, min(first + BATCH, len(entries)))
        near = index.nearest([(entries[i][0], entries[i][1]) for i in some], NEAREST + 1)
        for i, (found, cosines, _) in zip(some, near, strict=True):  # leave one example of the entry out, of its more frequent label
            total, ones = index.total[found], index.ones[found]
            one = entries[i][2] * 2 >= entries[i][3]
            own = found == i
            votes.append(index.vote(np.arange(len(found)), cosines, ones - own * (counted[1] if one else 0), total - own * counted[one], base))
    index.slope, index.shift = _logistic(np.array(votes), index.ones, index.total)
    return index


class Scorer:
    """The index in one Python worker, with a memory of vectors met before."""

    def __init__(self, index: Index):
        self.index = index
        self.known: dict[bytes, tuple[float, list[int]]] = {}

    def scores(self, column: pa.Array) -> Iterator[tuple[float, list[int]]]:
        terms = self.index.terms
        keys: list[bytes] = []
        new: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for hashes, counts in counts_of(column):
            keys.append(hashlib.blake2b(hashes.tobytes() + counts.tobytes(), digest_size=16).digest())
            if keys[-1] not in self.known and keys[-1] not in new:
                at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                hit = terms[at] == hashes if len(terms) else np.zeros(len(at), dtype=bool)
                new[keys[-1]] = at[hit], counts[hit], counts[~hit]
            if len(new) == 4 * BATCH:
                yield from self._told(keys, new)
                keys, new = [], {}
        yield from self._told(keys, new)

    def _told(self, keys: list[bytes], new: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        if len(self.known) > 100_000:
            here = set(keys)
            self.known = {k: v for k, v in self.known.items() if k in here}
        self.known |= zip(new, self.index.scores(list(new.values())), strict=True)
        return [self.known[k] for k in keys]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(counts_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in found], pa.binary())],
            names=["doc_id", "toxic", "terms", "counts"],
        )


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index learned from the labelled rows of (doc_id, text); labels is (doc_id, toxic)."""
    clean = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic IN (0, 1)")
    hashed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    labelled = materialise(hashed.join(clean, "id").distinct(), "toxicity-labelled")
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {1: int(max_examples * TOXIC_SHARE), 0: max_examples - int(max_examples * TOXIC_SHARE)}
    shares = [min(1.0, wanted[y] / max(1, sizes.get(y, 0))) for y in (0, 1)]
    # the rows of the smallest hashes of each label, at most max_examples of two numbers: small enough to broadcast
    first = [labelled.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit("toxicity"), "id", "th"), "id", "th").limit(wanted[y]) for y in (0, 1)]
    chosen = materialise(first[0].unionByName(first[1]), "toxicity-chosen").withColumnsRenamed({"id": "_id", "th": "_th"})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")))
    vectors = sample.groupBy("doc_id", "_th").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")).orderBy("doc_id", "_th").mapInArrow(_vectors, "doc_id long, toxic int, terms binary, counts binary")
    found, terms, recent = [], np.zeros(0, np.uint64), []
    for r in materialise(vectors, "toxicity-vectors").toLocalIterator():  # part by part, so that the driver never holds them twice
        found.append((r["doc_id"], r["toxic"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.uint32)))
        recent.append(found[-1][2])
        if len(recent) == 256:
            terms, recent = np.unique(np.concatenate([terms, *recent])), []
    terms, found = np.unique(np.concatenate([terms, *recent])), sorted(found, key=lambda r: r[0])
    n1, n = sum(r[1] for r in found), len(found)
    if not n1 or n1 == n:
        return Index(np.zeros(0, np.uint64), np.zeros(0), (n1 + 0.01) / (n + 1) if n else 0.0)
    df = np.zeros(len(terms), dtype=np.int64)
    for i, (doc_id, y, hashes, counts) in enumerate(found):
        columns = np.searchsorted(terms, hashes).astype(np.int32)
        df[columns] += 1
        found[i] = doc_id, y, columns, counts
    stands = [1 / x for x in shares]  # labelled rows that an example stands for; on average 1, so that smoothing stays
    mean = (n1 * stands[1] + (n - n1) * stands[0]) / n
    return build(terms, df, found, (stands[0] / mean, stands[1] / mean))


def _score(index, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index.value)
        for batch in batches:
            found = list(scorer.scores(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=names)

    return run


def score(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # MAX_EXAMPLES entries at most
    index.rows = None  # executors lay theirs out
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared, ["doc_id", "score", "evidence"]), "doc_id long, score double, evidence array<bigint>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels")
    index = fit(docs.where("doc_id IS NOT NULL"), labels.where(~held_out(F.col("doc_id").cast("long"), 5, 0)))
    fold = held_out(F.col("doc_id"), 5, 0)
    return score(docs, index).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
