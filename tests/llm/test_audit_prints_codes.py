"""Source divergence, fingerprints and vector codes against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from ionframe.llm import divergence, fingerprints, vector_codes
from ionframe.storage import Scratch

# --- divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, min_docs=3, top=200):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for t, lang, s in rows:
        terms = [x.translate(FOLD) for x in TERM.findall(t)]
        counts[lang, s].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, s in {(lang, s) for _, lang, s in rows}:
        kept = [x for x, n in docs[lang].items() if n >= min_docs]
        sources = sorted({b for _, a, b in rows if a == lang})
        whole = Counter()
        for b in sources:
            whole.update(counts[lang, b])
        total = lambda c: sum(c[x] for x in kept)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (total(c) + len(kept)) for x in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        p, q = share(counts[lang, s]), share(whole)
        pairs = []
        for other in sources:
            if other != s:
                r = share(counts[lang, other])
                pairs.append((sum(f(p[x], r[x]) for x in kept), other))
        terms = [(f(p[x], q[x]), x) for x in kept if counts[lang, s][x] and p[x] > q[x]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            for i, (value, item) in enumerate(sorted(items, key=lambda y: (-y[0], y[1].encode()))[:limit]):
                out.append((lang, s, part, item, value, i + 1))
    return sorted(out)


AUDIT = "text string, lang string, source string, term string, n int, p int, value string, item string"


def audit_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "clash", "clash") for r in rows], AUDIT)


def audit_rows(seed, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("alpha", "BETA", "ümlaut", "Ω", "日本") for b in ("", "x", "yy", "É", "𝒜")]
    rows = []
    for _ in range(n):
        source = rng.choice(["s0", "s0", "s0", "s1", "é", "𝒜", None, ""])
        text = " ".join(rng.choice(words[: 25 if source == "s0" else 12]) + rng.choice(["", ".", "7x", "-q"]) for _ in range(rng.randrange(0, 20)))
        rows.append((rng.choice([text, text, None, ""]), rng.choice(["en", "en", "de", None]), source))
    return [*rows, ("only here", "xx", "alone"), (None, "yy", "a"), ("", "yy", "b"), ("long " * 60_000, "en", "s0"), ("w" * 300_000, "en", "s1"), ("1 2 3 ...", "zz", "c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_audit(spark, seed):
    rows = audit_rows(seed)
    found = divergence.divergence_audit(audit_frame(spark, rows))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_audit(rows)


def test_divergence_of_hot_terms_and_small_tops(spark):
    """Many terms of one value: the last place lies among ties, which the terms' bytes decide."""
    rng = random.Random(5)
    own = ["common" + "é" * 3 + "".join(rng.choice("abé𝒜") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    rows = [(" ".join(own), "en", "s0")] * 3 + [(" ".join(rng.sample(own, 150)), "en", "s1") for _ in range(6)] + [("nothing else", "en", "s2")] * 3
    for top in (1, 7, 200):
        assert sorted(map(tuple, divergence.divergence_audit(audit_frame(spark, rows), top=top).collect())) == brute_audit(rows, top=top)


def test_divergence_of_empty_tables_and_single_groups(spark):
    assert divergence.divergence_audit(audit_frame(spark, [])).count() == 0
    assert sorted(map(tuple, divergence.divergence_audit(audit_frame(spark, [("a b", "en", "x")] * 4)).collect())) == brute_audit([("a b", "en", "x")] * 4)
    two = [(None, "en", "x"), (None, "en", None)]
    assert sorted(map(tuple, divergence.divergence_audit(audit_frame(spark, two)).collect())) == brute_audit(two)


def test_top_items_by_radix(spark):
    """Values over all 63 bits, many of them equal, and groups smaller and larger than the limit."""
    rng = random.Random(9)
    rows = []
    for g, n in (("a", 3), ("b", 60), ("c", 300)):
        values = [rng.choice([0, 1, 5, 2**31, 2**62, rng.randrange(2**63)]) for _ in range(n)]
        rows += [("x", g, f"i{rng.randrange(10)}{k}", v) for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    for k in (1, 20, 60):
        want = [r for g in "abc" for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2]))[:k]]
        assert sorted(map(tuple, divergence.top_items(frame, k, Scratch(spark)).collect())) == sorted(want)


# --- fingerprints


def spark_hash(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little"), seed)
    return seed


def brute_marks(text, gram=4, window=8):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,32}", text)
    hashes = [spark_hash([t]) for t in tokens]
    grams = [spark_hash(hashes[i : i + gram]) >> 28 for i in range(max(len(hashes) - gram + 1, 1 if hashes else 0))]
    picked = []
    for end in range(len(grams)):
        best = min(range(max(0, end - window + 1), end + 1), key=lambda i: (grams[i], -i))
        if (grams[best], best) not in picked[-1:]:
            picked.append((grams[best], best))
    return picked


def brute_prints(rows):
    order = sorted(((2**63 - 1 if i is None else i, spark_hash([t or ""]) - (2**64 if spark_hash([t or ""]) >= 2**63 else 0)), i, t or "") for i, t in rows)
    out = []
    for k, (_, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + after[:quarter]
        sets = [{h for h, _ in brute_marks(x)} for x in (t, edited, after)]
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), tuple(brute_marks(t)), tuple(brute_marks(edited)), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, marks string, bucket int, guest string, h int, id int, n int, times int"


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 1, 1, 1, 1) for r in rows], DOCS)


def found_prints(docs):
    found = fingerprints.edited_fingerprints(docs)
    out = []
    for r in found.collect():
        marks = [[(m >> 27, 2**27 - 1 - m % 2**27) for m in x] for x in (r.marks, r.edited_marks, r.next_marks)]
        sets = [{h for h, _ in x} for x in marks]
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        out.append((r.doc_id, len(r.text), hashlib.sha256(r.edited_text.encode()).hexdigest(), tuple(marks[0]), tuple(marks[1]), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return sorted(out, key=str)


def doc_rows(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(50)] + ["é", "日本語", "x" * 70]
    rows = [(rng.randrange(10**6) if rng.random() < 0.9 else rng.choice([None, 5, 5]), rng.choice([" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))), None, ""] if rng.random() < 0.2 else [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))])) for _ in range(n)]
    return [*rows, *rows[:20], (7, "word " * 40_000), (8, "z" * 200_000), (9, " \n\t"), (10, "𝒜b" * 50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprints(spark, seed):
    rows = doc_rows(seed)
    assert found_prints(doc_frame(spark, rows).repartition(5)) == brute_prints(rows)


@pytest.mark.parametrize("rows", [[(1, "a b c d e f")], [(None, None)], [(1, "x"), (2, None)], [(3, "same text here")] * 3 + [(4, "other")]])
def test_fingerprints_of_few_rows(spark, rows):
    assert found_prints(doc_frame(spark, rows)) == brute_prints(rows)


def test_fingerprints_of_one_hot_row(spark):
    """A third of all rows alike: one row with a count meets the others, and all come back."""
    rows = [(i, f"text number {i} of many words that differ {i % 7}") for i in range(2600)] + [(None, "one row that comes again and again")] * 1300 + [(77, f"one id {i}") for i in range(300)]
    assert found_prints(doc_frame(spark, rows)) == brute_prints(rows)


def test_fingerprint_query_and_empty_table(spark, tmp_path):
    rows = doc_rows(3, 40)
    doc_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = fingerprints.op12_fingerprints(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    show = lambda marks: " ".join(f"{h:X}@{p}" for h, p in marks)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, n, s, show(a), show(b), x, y) for i, n, s, a, b, x, y in brute_prints(rows)), key=str)
    assert fingerprints.edited_fingerprints(doc_frame(spark, [])).count() == 0


def test_match_guarantee(spark):
    """Texts that share window + gram - 1 tokens in a row share a mark inside them, and the places say where."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        shared = [f"shared{i}x{j}" for j in range(fingerprints.GRAM + fingerprints.WINDOW - 1)]
        for side in (0, 1):
            before, after = ([f"{i}-{side}-{rng.randrange(99)}" for _ in range(rng.randrange(30))] for _ in range(2))
            rows.append((2 * i + side, " ".join([*before, *shared, *after]), len(before)))
    prints = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, begin int"))
    begin = {r[0]: r[2] for r in rows}
    common = {}
    for h, d, p in fingerprints.shared_marks(prints).collect():
        if begin[d] <= p < begin[d] + fingerprints.WINDOW:
            common.setdefault(h, set()).add((d, p - begin[d]))
    for i in range(60):
        assert any({d for d, _ in at} == {2 * i, 2 * i + 1} and len({o for _, o in at}) == 1 for at in common.values())


# --- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    kept, order = ([r for r in x if len(r[1]) == size] for x in (kept, order))
    width = -(-size // parts)
    whole = lambda v: [math.floor(Fraction(x) * 1024) for x in v] + [0] * (width * parts - size)
    books = [[whole(v)[p * width : (p + 1) * width] for _, v, _ in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def coded(v):
        return [min((far(v[p * width : (p + 1) * width], c), e) for e, c in enumerate(books[p])) for p in range(parts)]

    vectors = [whole(v) for _, v, _ in kept]
    for _ in range(rounds):
        codes = [coded(v) for v in vectors]
        for p in range(parts):
            for e in range(len(books[p])):
                members = [v[p * width : (p + 1) * width] for v, c in zip(vectors, codes, strict=True) if c[p][1] == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    out = []
    for (i, _, k), v in zip(kept, vectors, strict=True):
        c = coded(v)
        out.append((i, k, "".join(f"{e:02x}" for _, e in c), min(sum(d for d, _ in c), 2**63 - 1)))
    return sorted(out, key=str), digest


VECTORS = "vec_id long, embedding array<double>, label int, code string, error int, part int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], VECTORS)


def vector_rows(seed, n=320, dim=8):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.0, 0.125, -0.125]) for _ in range(dim)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    bad = [(n, None, 1), (n + 1, [1.0, None, *[0.0] * (dim - 2)], 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [float("-inf")] * dim, 2), (n + 4, [1.0] * (dim + 4), 2)]
    return [*rows, *bad, *rows[:30], (None, [0.5] * dim, None), (3, [-0.0001] * dim, 7)]


@pytest.mark.parametrize("rows", [vector_rows(1), vector_rows(2, 40), vector_rows(3, 30, 6), [(1, [], 1), (2, [], 1)], [(i, [0.25] * 4, 0) for i in range(300)]], ids=["many", "few", "filled up", "no dimension", "all alike"])
def test_vector_codes(spark, rows):
    found, books = vector_codes.coded(vector_frame(spark, rows).repartition(3))
    want, digest = brute_codes(rows)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert books.sha256() == digest


def test_vector_codes_of_huge_components(spark):
    """Sums and distances that neither doubles nor longs hold."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e300, -1e300, 3.0, 2.0**70 + 2.0**20, rng.gauss(0, 1e6)]) for _ in range(4)], i % 2) for i in range(280)]
    found, books = vector_codes.coded(vector_frame(spark, rows))
    want, digest = brute_codes(rows)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert books.sha256() == digest


def test_vector_code_query_and_empty_table(spark, tmp_path):
    rows = vector_rows(4, 60)
    vector_frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, digest = brute_codes(rows)
    sums = defaultdict(int)
    for _, k, _, e in want:
        sums[k] += e
    found = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, c, e, sums[k], digest) for i, k, c, e in want), key=str)
    vector_frame(spark, []).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vector_codes.op13_vector_codes(spark, f"{tmp_path}/none").count() == 0


def test_equal_bounds_are_visited():
    """Entries at one distance on both sides of a cut: the lowest index wins, whichever leaf the part is in."""
    rng = np.random.default_rng(3)
    book = rng.integers(-2, 3, (200, 3)).astype(float)
    parts = rng.integers(-2, 3, (500, 3)).astype(float)
    index, far = vector_codes.nearest(vector_codes.kd_tree(book), book, parts)
    all_far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert np.array_equal(index, all_far.argmin(axis=1)) and np.array_equal(far, all_far.min(axis=1))
