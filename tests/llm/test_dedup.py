"""Exact dedup, line dedup and connected components against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from ionframe.llm import components, exact_dedup, line_dedup
from ionframe.llm.unionfind import Forest
from ionframe.storage import new_path

BLANK = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, digest string, keep_id string"


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((i, len(t or "")))
    out = []
    for i, t in rows:
        g = groups[BLANK.sub("", t or "")]
        keep = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(BLANK.sub("", t or "").encode()).hexdigest()))
    return sorted(out, key=str)


EDGE = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "é\u00a0x"), (8, "éx"), (9, "x" * 200_000), (9, "x" * 200_000), (None, "ab"), (None, "only")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def test_exact_dedup(spark):
    found = exact_dedup.exact_dedup(frame(spark, EDGE))
    assert sorted(map(tuple, found.collect()), key=str) == brute_dedup(EDGE)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_digest_index_keeps_earlier_batches(spark):
    path = new_path(spark, "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.exact_dedup(frame(spark, [(1, "a"), (2, "b")]), index).collect()
    again = exact_dedup.DigestIndex(spark, path, 4)  # opened anew from its files
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(3, "a  "), (4, "c"), (5, "c ")]), again).collect()}
    assert found[3].keep_id == 3 and found[3].kept and found[3].group_size == 2  # longer than the indexed row
    assert found[4].keep_id == 5 and found[5].kept
    assert again.files().count() == 3


@pytest.mark.parametrize("batches", [1, 3])
def test_batches_of_one_index_make_whole_groups(spark, batches):
    """Groups that reach over batches, and over calls, have the sizes and kept rows of all rows together."""
    rng = random.Random(batches)
    calls = [[(100 * c + i, "".join(rng.choice(["a", "b", " ", "\t"]) for _ in range(rng.randrange(6)))) for i in range(40)] for c in range(3)]
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    for c in range(3):
        found = exact_dedup.exact_dedup(frame(spark, calls[c]), index, batches)
        whole = brute_dedup([r for rows in calls[: c + 1] for r in rows])
        assert sorted(map(tuple, found.collect()), key=str) == [r for r in whole if r[0] // 100 == c]
    assert index.entries().count() == index.entries().select("digest").distinct().count() == len({r[4] for r in whole})


def test_a_batch_appended_twice_counts_once(spark):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    for number, rows in ((1, [(1, "a")]), (2, [(2, "a  "), (3, "b")]), (2, [(2, "a  "), (3, "b")])):
        index.append(exact_dedup.groups_of(exact_dedup.digests(frame(spark, rows))), number)
    assert sorted((r.keep_id, r.group_size) for r in index.groups().collect()) == [(2, 2), (3, 1)]


def brute_lines(rows, least=20, docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(line) for line in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].append((n, i))
    last = {k: max((i for _, i in v if i is not None), default=None) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in last and last[key(x)] is not None and last[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    common = ["This line stands in many documents %d" % i for i in range(6)]
    rows = [(i, "\n".join(rng.choice([rng.choice(common), rng.choice(common).upper() + " \r", "own line number %d of a document" % rng.randrange(10**6), "short", ""]) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, common[0] + "\n" + common[0]), (103, common[0] + "\n" + common[0]), (None, common[1]), (104, "ß" * 20), (105, "ß" * 20), (106, " " + "ß" * 20)]


def test_line_dedup(spark):
    found = line_dedup.dedup_lines(frame(spark, line_rows()))
    assert found.columns[:4] == ["doc_id", "text", "digest", "keep_id"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=str) == brute_lines(line_rows())
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


LONG = "a line of more than twenty letters that three texts hold"


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "short")],
        [(1, None)],
        [(1, "")],
        [(1, None), (2, ""), (3, "\n"), (4, "x\ny")],
        [(i, "word %d" % i) for i in range(40)] + [(50 + i, LONG) for i in range(3)],
        [(1, "\n".join(f"w{i % 977}" for i in range(400_000))), (2, LONG), (3, LONG), (4, LONG + "\nshort"), (5, "é" * 19)],
    ],
    ids=["short", "null", "empty", "none keyed", "mixed", "2 MB of short lines"],
)
def test_line_dedup_where_few_lines_have_a_key(spark, rows):
    """Pieces of a batch without any line of enough code points: one row, many, or a long text by itself."""
    for parts in (1, 3):
        found = line_dedup.dedup_lines(frame(spark, rows).repartition(parts))
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=str) == brute_lines(rows)


@pytest.mark.parametrize("batches", [1, 3])
def test_runs_hold_each_key_once(spark, batches):
    """Only what the anti-join lets through enters a run, so every key stands in one run, however often batches hold it."""
    runs = line_dedup.LineRuns(spark, new_path(spark, "runs"), 4, fanout=10)
    found = line_dedup.dedup_lines(frame(spark, line_rows()), runs=runs, batches=batches)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=str) == brute_lines(line_rows())
    assert len(runs.runs()) == batches
    keys = [r.key for name in runs.runs() for r in spark.table(runs.tables[name]).collect()]
    assert len(keys) == len(set(keys)) > 100
    assert (runs._files(runs.runs(), "seen-").count() > 0) == (batches > 1)


def test_line_keys_are_hashes_of_bare_lines():
    import pyarrow as pa

    texts = [" \tSome Line of Twenty letters\r\n\nsome line OF twenty letters\n" + "É" * 19 + "\n" + "é" * 20, None, "", "\n\n" + "x" * 100_000]
    found = [(int(r), int(p), bool(f), k) for row, place, first, keys in line_dedup.line_keys(pa.array(texts), 20) for r, p, f, k in zip(row, place, first, keys.to_pylist(), strict=True)]
    assert [(r, p, f) for r, p, f, _ in found] == [(0, 0, True), (0, 2, False), (0, 4, True), (3, 2, True)]
    assert found[0][3] == found[1][3] and len({k for *_, k in found}) == 3 and all(len(k) == 32 for *_, k in found)


def test_line_runs_compact_and_reopen(spark):
    path = new_path(spark, "runs")
    runs = line_dedup.LineRuns(spark, path, 4, fanout=2)
    for b in range(5):
        keys = spark.createDataFrame([(f"k{k}", 1, b) for k in range(b, b + 3)], "key string, n_docs long, last_doc long")
        runs.append(keys)
    assert [line_dedup.LineRuns._parts(n)[0] for n in runs.runs()] == [2, 0]
    totals = {r.key: (r.n_docs, r.last_doc) for r in line_dedup.LineRuns(spark, path, 4, fanout=2).totals().collect()}
    assert totals == {"k0": (1, 0), "k1": (2, 1), "k2": (3, 2), "k3": (3, 3), "k4": (3, 4), "k5": (2, 4), "k6": (1, 4)}


def test_drop_seen_lines(spark):
    runs = line_dedup.LineRuns(spark, new_path(spark, "runs"), 4)
    a, b = "the first line that is long enough", "the second line that is long enough"
    first = line_dedup.drop_seen_lines(frame(spark, [(1, f"{a}\n{b}\n{a}")]), runs)
    assert first.first().kept_text == f"{a}\n{b}\n{a}"
    second = line_dedup.drop_seen_lines(frame(spark, [(2, f"new\n{a.upper()}\nthe third line that is long enough")]), runs)
    assert second.first().kept_text == "new\nthe third line that is long enough"


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)]])
def test_components(spark, edges):
    rng = random.Random(len(edges))
    edges = edges + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(35)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {x: find(x) for x in root}


def test_forest():
    import numpy as np

    f = Forest(8)
    f.link(np.array([7, 5, 3]), np.array([5, 3, 1]))
    assert f.labels().tolist() == [0, 1, 2, 1, 4, 1, 6, 1]
