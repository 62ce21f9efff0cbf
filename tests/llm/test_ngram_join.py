"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ionframe.llm import ngram_join as J
from ionframe.llm.unionfind import Forest


def brute(rows, k=4, num=85, den=100):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and den * o >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, len(sets[n]), least.get(find(n))) for n, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=12, size=8, length=(1, 160)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(*length))]
        for _ in range(rng.randrange(1, size)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = passage + own
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(own)))
            i += 1
    return rows


EDGE = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (905, "one two three"), (None, "one two three"), (None, "nobody else has this text here"), (906, "a a a a a a a a"), (907, "a a a a"), (908, "ÀÉ à b c d"), (909, "x " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, node string")


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_matches_brute_force(spark, k, num):
    rows = near_copies(k) + EDGE
    found = J.jaccard_components(frame(spark, rows), k, num, 100)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == brute(rows, k, num)


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w[:n]


@pytest.mark.parametrize("k", [4, 5])
@pytest.mark.parametrize("n", range(7))
def test_few_words_in_a_whole_piece(k, n):
    """A piece whose rows have fewer words than a shingle in all."""
    text = " ".join(["one", "two", "three", "four", "five", "six"][:n])
    (one,) = next(J.shingle_sets(pa.array([text]), k))
    assert len(one) == min(n, max(1, n - k + 1))
    same, upper, none = next(J.shingle_sets(pa.array([text, text.upper(), None]), k))
    assert same.tolist() == upper.tolist() == one.tolist() and not len(none)


def test_a_table_of_two_words(spark):
    assert J.jaccard_components(frame(spark, [(1, "hello world")])).collect() == [(1, 1, 1)]


def test_links_through_rows_without_an_id(spark):
    base = [f"v{i}" for i in range(100)]
    change = lambda *at: " ".join("changed" if i in at else w for i, w in enumerate(base))
    rows = [(5, change()), (None, change(99)), (None, change(99)), (9, change(99, 98, 97, 96)), (11, change(0, 1, 2, 3))]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert found == brute(rows) and found[-1] == (None, 97, 5)
    assert [r.doc_id for r in J.first_of_each(frame(spark, rows)).collect()] == [5]
    alone = J.first_of_each(frame(spark, rows[1:3])).collect()
    assert [(r.doc_id, r.text) for r in alone] == [rows[1]]


def test_rows_of_one_id_with_unlike_texts_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "h i j k l m n"), (2, "h i j k l m n"), (3, ""), (3, "")]
    kept = sorted((r.doc_id, r.text) for r in J.first_of_each(frame(spark, rows)).collect())
    assert kept == [(1, "a b c d e f g"), (1, "h i j k l m n"), (3, ""), (3, "")]


def test_words_that_swap_letters_regularly_differ(spark):
    rows = [(i, t) for i, n in enumerate((1024, 2048, 4096)) for t in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    found = J.jaccard_components(frame(spark, rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == [(i, 1, i) for i in range(6)]


def test_pieces_of_a_batch(monkeypatch):
    """Sets do not depend on how a batch is cut, down to one row a piece."""
    texts = pa.array([t for _, t in near_copies(3)[:40] + EDGE[:12]])
    whole = [s.tolist() for sets in J.shingle_sets(texts, 4) for s in sets]
    real = J.pieces
    monkeypatch.setattr(J, "pieces", lambda offsets: real(offsets, 1))
    assert [s.tolist() for sets in J.shingle_sets(texts, 4) for s in sets] == whole


def test_batches_meet_before_the_shuffle():
    """A hash of all documents of a batch is sent twice, and no document loses a meeting."""
    parts = 2
    own = [np.sort(np.r_[np.uint64(7), np.uint64(1000 + i), np.uint64(2000 + i // 2)].astype(np.uint64)) for i in range(20)]
    batches = [pa.RecordBatch.from_pylist([{"n": 3, "d1": (i + 1) << 20, "prefix": own[i].tobytes()} for i in some]) for some in (range(12), range(12, 19), [19])]
    sent = [r for b in batches for x in J._prefix_rows(parts)(iter([b])) for r in x.to_pylist()]
    assert sum(np.count_nonzero(np.frombuffer(r["hash"], np.uint64) == 7) for r in sent if r["hash"]) == 5
    kinds = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in J.MET]])
    met = [r for p in range(parts) for b in J._met(parts)(iter([pa.RecordBatch.from_pylist([r for r in sent if r["part"] == p], schema=kinds)])) for r in b.to_pylist()]
    total = {}
    for r in met:
        for ref, n in zip(np.frombuffer(r["ref"], np.uint64).tolist(), np.frombuffer(r["met"], np.int64).tolist(), strict=True):
            total[ref >> 20] = total.get(ref >> 20, 0) + n
    assert total == {i + 1: 2 for i in range(20)}


def test_empty_and_first_of_each(spark):
    assert J.jaccard_components(frame(spark, [])).count() == 0
    rows = near_copies(1)[:30] + [(2, near_copies(1)[2][1])]
    kept = J.first_of_each(frame(spark, rows))
    groups = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in groups})
    assert kept.columns == ["doc_id", "text", "n", "node"]


def test_bounds_are_rigorous():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 63, int(rng.integers(0, 30))).astype(np.uint64)])
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 85 * (len(a) + len(b) - shared):
            continue
        sizes = np.array([len(a), len(b)])
        assert shared >= J.must_share(sizes, 85, 100).max()
        cut = J.prefix_length(sizes, 85, 100)
        both = len(np.intersect1d(a[: cut[0]], b[: cut[1]]))
        assert both >= J.surplus(J.must_share(sizes, 85, 100)).max()
        tree = J.Tree(np.zeros(2, np.uint64), np.sort(sizes), np.stack([J.bitmap(x) for x in sorted((a, b), key=len)]))
        assert tree.possible(0, np.array([0]), np.array([1]), 85, 100).all()
        assert tree.possible(1, np.array([0]), np.array([0]), 85, 100).all()


def test_hot_buckets_in_chunks(monkeypatch):
    """Chunk pairs of a hot bucket find what one bucket finds."""
    monkeypatch.setattr(J, "CHUNK", 3)
    monkeypatch.setattr(J, "PAIRS", 8)
    sets = [s for t in [r[1] for r in near_copies(7, groups=2, size=30, length=(60, 90))] for s in next(iter(J.shingle_sets(pa.array([t]), 4)))]
    n = np.array([len(s) for s in sets])
    sets_batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), pa.array(n), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([J.bitmap(s).tobytes() for s in sets], pa.binary())], names=["node", "n", "own", "bits"])

    def shuffled(batches, parts):
        rows = [r for b in batches for r in b.to_pylist()]
        return [[pa.RecordBatch.from_pylist([r]) for r in rows if r["part"] == p] for p in range(parts)]

    parts = 3
    back = [b for part in shuffled(J._set_rows(parts, 85, 100)([sets_batch]), parts) for b in J._frequencies(parts)(part)]
    owners = list(J._part_column(parts)([sets_batch]))
    names = ["part", "doc", "hash", "df", "own_doc", "own_n", "own_bits"]
    kinds = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in names[1:]]])
    wide = [pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in b.to_pylist()], schema=kinds) for b in [*back, *owners]]
    rows = [row for w in wide for row in w.to_pylist()]
    buckets = [b for p in range(parts) for b in J._buckets(parts, 85, 100)([pa.RecordBatch.from_pylist([row for row in rows if row["part"] == p], schema=kinds)])]
    edges = [(e["a"], e["b"]) for part in shuffled(buckets, parts) for b in J._traverse(85, 100)(part) for e in b.to_pylist()]
    forest = Forest(len(sets))
    forest.link(np.array([e[0] for e in edges], dtype=int), np.array([e[1] for e in edges], dtype=int))
    i, j = J.linked(sets, 85, 100)
    root = forest.labels()
    assert len(i) > 20 and (root[i] == root[j]).all()
