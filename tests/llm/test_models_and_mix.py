"""Mixing against brute-force apportionment; language ID and toxicity against plain versions and held-out rows."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionframe.llm import langid, mixing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight; what a cap leaves over is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] = left * weight[s] / total
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = float(most * sizes[s])
            capped.add(s)
            left -= target[s]


def brute_seats(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max((v for v in votes), key=lambda k: (votes[k] / (2 * got[k] + 1), [-ord(c) for c in str(k)]))
        got[best] += 1
    return got


def mix_rows(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 200]))), rng.choice(["hot", "hot", "hot", "b", "c", "Z", "é", None])) for i in range(n)]
    return [*rows, (1000, None, "only-null"), (1001, "a\tb\nc\x0bd", "tiny"), (1002, "w " * 5000, "long"), (5, "x y", "b"), (5, "x y", "b"), (None, "x", "c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mix_rows(seed)
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    found = mixing.mix(frame, block_words=8, shard_docs=40).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
    quota = brute_seats({s: target[s] for s in sizes}, round(sum(sizes.values()) / 8))
    for s in sizes:
        assert abs(taken[s] - min(8 * quota[s], 3 * sizes[s])) <= 8 * 12, s  # a block a shard at most is lost to a cap
    again = mixing.mix(frame.repartition(7), block_words=8, shard_docs=40).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_sainte_lague(spark):
    rng = random.Random(9)
    rows = [(g, f"p{i}", rng.choice([0, 1, 3, 10, 1000, 12345]), 97) for g in range(6) for i in range(rng.randrange(1, 30))]
    frame = spark.createDataFrame(rows, "g int, p string, v long, seats long")
    got = {(r.g, r.p): r.quota for r in mixing.sainte_lague(frame, ["g"], ["p"], "v", "seats").collect()}
    for g in range(6):
        votes = {p: v for h, p, v, _ in rows if h == g}
        want = brute_seats(votes, 97) if sum(votes.values()) else dict.fromkeys(votes, 0)
        assert sum(want.values()) == sum(got[g, p] for p in votes)
        # equal quotients may go to either party, so compare by votes
        assert sorted((votes[p], want[p]) for p in votes) == sorted((votes[p], got[g, p]) for p in votes)


def test_many_parties_list_few_quotients(spark):
    """8,000 parties of equal votes, 1.4 seats each: the work is in proportion to the parties."""
    frame = spark.range(8000).selectExpr("1 AS g", "id AS p", "100L + id % 2 AS v", "11200L AS seats")
    began = time.perf_counter()
    got = {r.p: (r.v, r.quota) for r in mixing.sainte_lague(frame, ["g"], ["p"], "v", "seats").collect()}
    assert time.perf_counter() - began < 15
    assert sum(q for _, q in got.values()) == 11200
    assert {q for v, q in got.values() if v == 101} == {1} | ({2} if any(q == 2 for v, q in got.values() if v == 101) else set())
    assert min(v / (2 * q - 1) for v, q in got.values()) >= max(v / (2 * q + 1) for v, q in got.values())


def test_the_seed_selects_blocks(spark):
    """Part of a shard is taken: blocks that follow each other from a seeded one, and other ones under another seed."""
    frame = spark.createDataFrame([(i, "w " * 10, s) for i in range(200) for s in ("a", "b")], "doc_id long, text string, source string")
    taken = {seed: {(r.source, r.doc_id): r.taken for r in mixing.mix(frame, weights=(1, 3), block_words=10, shard_docs=200, seed=seed).collect()} for seed in ("x", "y")}
    for found in taken.values():
        a = [v for (s, _), v in found.items() if s == "a"]
        assert sum(a) == 1000 and sorted(set(a)) in ([0, 10], [0, 5, 10]) and sum(v for (s, _), v in found.items() if s == "b") == 3000
    assert taken["x"] != taken["y"]


def test_rows_alike_are_mixed_together(spark):
    """A row repeated in most of the table is one entry; its copies are taken one behind the other, and come back as rows."""
    rows = [(i, f"w{i} " * 4, "a") for i in range(30)] + [(None, "x y z w", "a")] * 500 + [(7, "p q r s", "b")] * 60
    frame = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, source string, _each int")
    found = mixing.mix(frame, shard_docs=40).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 12 for r in found)
    for s, target in brute_targets({"a": 4 * 530, "b": 240}).items():
        assert abs(sum(r.taken for r in found if r.source == s) - target) <= 16 * 14
    whole = defaultdict(int)
    for r in mixing.mix(frame).collect():
        whole[r.doc_id, r.source] += int(r.taken / r.size + 0.5)
    out = defaultdict(int)
    for r in mixing.mixed_documents(frame).collect():
        out[r.doc_id, r.source] += 1
    assert out == {k: v for k, v in whole.items() if v}


def test_mixed_documents(spark):
    frame = spark.createDataFrame([(i, "w " * 10, "s" + str(i % 3), 1) for i in range(120)], "doc_id long, text string, source string, taken int")
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["s0"] - 20) <= 3 and abs(counts["s1"] - 40) <= 3 and abs(counts["s2"] - 60) <= 3
    assert mixing.mixed_documents(frame.limit(0)).count() == 0


LANGUAGES = {"aa": "the quick of and was to", "bb": "der und schön für nicht", "cc": "que los año ción pero"}


def language_rows(n=240):
    rng = random.Random(0)
    return [(i, " ".join(rng.choice(LANGUAGES[k].split()) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(3, 60))), k) for i in range(n) for k in [rng.choice(list(LANGUAGES))]]


def test_language_id(spark):
    rows = [*language_rows(), (900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (903, "the und " * 20_000, None), (903, "the und " * 20_000, None), (None, "nicht schön", "bb")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(frame.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    found = langid.predict(frame, model).collect()
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in found if r.lang and r.doc_id is not None and r.doc_id < 900)
    assert len(found) == len(rows) and by[None].lang_pred == "bb"
    # the same probabilities from a plain computation of one document's features
    text = rows[0][1]
    counts = defaultdict(int)
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    for n in langid.ORDERS:
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if gram.strip():
                code = (n * 0x27D4EB2F) & 0xFFFFFFFF
                for c in gram:
                    code = ((code ^ ord(c)) * 0x9E3779B1) & 0xFFFFFFFF
                    code ^= code >> 15
                counts[code & (langid.DIMENSIONS - 1)] += 1
    x = {k: (1 + np.log(v)) * model.idf[k] for k, v in counts.items()}
    norm = np.sqrt(sum(v * v for v in x.values()))
    logits = sum(v / norm * model.weights[k] for k, v in x.items()) * model.sharpness
    p = np.exp(logits - logits.max())
    assert abs(by[0].score - (p / p.sum()).max()) < 1e-5
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_language_id_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(empty) is None
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert langid.predict(one, None).first().lang_pred == "und"
    assert langid.predict(one.limit(0), None).count() == 0


def test_all_of_many_languages_are_learned(spark):
    """600 language values, of few and of many rows; the sample has a row of each, and no row with one id and text twice."""
    rows = [(i, f"{chr(0x4E00 + i % 600)}{chr(0x5E00 + i % 600)} " * 5 + str(i), f"l{i % 600:03}") for i in range(1800)]
    rows += [(5000 + i, "the quick of and was to", "l000") for i in range(500)] + [(9000, "the quick", "l001")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, 100)
    assert model.languages == sorted({r[2] for r in rows})
    taught = []
    langid_train, langid.train = langid.train, lambda rows, _: taught.extend(rows)
    try:
        langid.fit(frame, 3000)
    finally:
        langid.train = langid_train
    assert len({r[0] for r in taught}) == 600 and len(taught) == 3 * 598 + 5 + 4  # five a language at most


@pytest.mark.parametrize("l1", [langid.L1, 0.6])
def test_training_matches_plain_ftrl(monkeypatch, l1):
    """Weights and temperatures from one-coordinate-at-a-time FTRL-proximal with an elastic net, and a search about the fitted line."""
    monkeypatch.setattr(langid, "L1", l1)
    rng = random.Random(8)
    rows = []
    for i in range(45):
        k = i % 3
        columns = np.array(sorted(rng.sample(range(k * 12, k * 12 + 20), 7)))
        rows.append((f"l{k}", columns, np.array([float(rng.randrange(1, 5)) for _ in columns])))
    model = langid.train(rows)
    fit, hold = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    df = defaultdict(int)
    for _, columns, _ in fit:
        for c in columns:
            df[c] += 1
    idf = lambda c: np.float32(np.log((1 + len(fit)) / (1 + df[c])) + 1)

    def vector(row):
        x = {c: (1 + np.log(n)) * idf(c) for c, n in zip(row[1].tolist(), row[2].tolist(), strict=True)}
        norm = np.sqrt(sum(v * v for v in x.values()))
        return {c: v / norm for c, v in x.items()}

    z, n = defaultdict(float), defaultdict(float)

    def weight(c, k):
        if abs(z[c, k]) <= langid.L1:
            return 0.0
        return -(z[c, k] - np.sign(z[c, k]) * langid.L1) / ((langid.BETA + np.sqrt(n[c, k])) / langid.ALPHA + langid.L2)

    def shares(x, sharp=1.0):
        e = [np.exp(sum(v * weight(c, k) for c, v in x.items()) * sharp) for k in range(3)]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(fit)):
            x = vector(fit[i])
            p = shares(x)
            w = {(c, k): weight(c, k) for c in x for k in range(3)}
            for (c, k), old in w.items():
                g = x[c] * (p[k] - (fit[i][0] == f"l{k}"))
                z[c, k] += g - (np.sqrt(n[c, k] + g * g) - np.sqrt(n[c, k])) / langid.ALPHA * old
                n[c, k] += g * g
    for c in range(langid.DIMENSIONS):
        for k in range(3):
            if c < 50 or model.weights[c, k]:
                assert abs(model.weights[c, k] - weight(c, k)) < 1e-5
    assert any(z[c, k] and not weight(c, k) for c in range(50) for k in range(3)) == (l1 > 0.5)  # the L1 penalty makes zeros

    def loss(sharp):
        told = [(shares(vector(r), sharp), int(r[0][1])) for r in hold]
        n = len(hold) + 2
        return -sum(np.log(x) * ((n - 1) / n if i == k else 1 / n / 2) for t, k in told for i, x in enumerate(t))

    assert all(loss(model.sharpness) <= loss(model.sharpness + step) + 1e-9 for step in (-1, -0.1, -1e-3, 1e-3, 0.1, 1))


def test_short_texts_are_told_less_surely(spark):
    """The error of calibration on held-out texts of one to eight words, some of which occur in two languages."""
    rng = random.Random(4)
    words = {"aa": ["the", "quick", "of", "and", "was", "to", "in", "an"], "bb": ["der", "und", "schön", "für", "nicht", "in", "an", "was"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.choice((1, 2, 4, 8, 40)))), k) for i in range(1200) for k in [rng.choice("ab") * 2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame.where("doc_id < 600"))
    found = langid.predict(frame.where("doc_id >= 600"), model).collect()
    bins = defaultdict(list)
    for r in found:
        bins[min(int(r.score * 10), 9)].append((r.score, r.lang_pred == r.lang))
    assert sum(abs(sum(s - hit for s, hit in b)) for b in bins.values()) / len(found) < 0.06
    by = {r.text: r.score for r in found}
    assert by["in"] < 0.75 < 0.95 < min(r.score for r in found if len(r.text.split()) == 40)


def test_calibration_without_examples_and_with_faultless_ones():
    assert langid.calibrated(np.zeros((0, 3)), np.zeros(0, dtype=int)) == 1.0
    assert langid.calibrated(np.zeros((4, 1)), np.zeros(4, dtype=int)) == 1.0
    assert langid.calibrated(np.zeros((4, 2)), np.zeros(4, dtype=int)) == 1.0
    faultless = np.array([[0.2, 0.0], [0.0, 0.2]] * 2)
    assert abs(1 / (1 + np.exp(-0.2 * langid.calibrated(faultless, np.array([0, 1, 0, 1])))) - 5 / 6) < 1e-6
    assert langid.calibrated(faultless * 1e-3, np.array([0, 1, 0, 1])) > 1000
    assert langid.calibrated(faultless, np.array([1, 0, 1, 0])) == langid.LEAST_SHARPNESS


def test_language_stage_without_languages(spark):
    frame = spark.createDataFrame([(1, "abc", None), (2, "12 3", None), (3, None, None), (3, "é", None)], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.text) for r in langid.identified(frame).collect()) == [(1, "abc"), (3, "é")]


def test_language_stage_keeps_columns(spark):
    rows = [*language_rows(100), (900, "12", "aa")]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    kept = langid.identified(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {900}


def toxic_rows(n=400):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(200)]
    bad = ["scumbag", "grobian", "grobiane", "idiotic"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.25)
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if y:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad).title())
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    extra = [(900, None), (901, ""), (902, "Scumbag, idiotic!"), (902, "Scumbag, idiotic!"), (903, "word1 " * 50_000 + " grobian scumbag"), (None, "word2")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(5, 0, "x"), (None, 1, "x"), (77777, None, "x")], "doc_id long, toxic int, score string")
    index = toxicity.fit(docs.where("doc_id IS NOT NULL"), labels.where(~toxicity.held_out(F.col("doc_id"), 5, 0)))
    found = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    assert all(0 <= r.score <= 1 for r in found.values())
    wrong = [i for i, _, y in rows if (found[i].score >= 0.5) != bool(y)]
    assert len(wrong) <= 4, wrong
    assert found[902].score >= 0.5 and found[903].score >= 0.5 and found[900].score == found[901].score == index.prior < 0.5
    assert found[902].evidence and all(rows[i][2] for i in found[902].evidence)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    examples = []
    for i in range(700):
        columns = np.unique(rng.integers(0, 40, int(rng.integers(1, 6))))
        examples.append((i, int(rng.integers(0, 2)), columns, rng.integers(1, 4, len(columns))))
    index = toxicity.build(np.arange(40, dtype=np.uint64) * 3 + 1, rng.integers(1, 300, 40), examples)
    dense = np.zeros((len(index.total), 40))
    for t in range(40):
        part = slice(index.first[t], index.first[t + 1])
        dense[index.entry_of[part], t] = index.weight[part]
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    opened = 0
    for _ in range(150):
        columns = np.unique(rng.integers(0, 40, int(rng.integers(1, 6))))
        x = index.vector(columns, rng.integers(1, 4, len(columns)))
        (entries, cosines, blocks), *others = index.nearest([(columns, x), (columns[:1], np.ones(1))])
        assert len(others) == 1
        full = dense[:, columns] @ x
        want = np.sort(full[full > 0])[::-1][: toxicity.NEAREST]
        assert np.allclose(np.sort(cosines)[::-1], want) and np.allclose(full[entries], cosines)
        opened += blocks
    assert opened < 150 * index.block_max.shape[1]  # some blocks stayed shut


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_toxicity_of_one_label(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, index).collect())


def test_terms_cover_the_whole_text():
    long = "filler " * 400_000 + "needle"
    rows = [h for _, _, _, hashes in toxicity.terms_of(pa.array([long])) for h in hashes.tolist()]
    assert set(h for _, _, _, hashes in toxicity.terms_of(pa.array(["needle"])) for h in hashes.tolist()) <= set(rows)


def weighed(texts, labels):
    """Term weights of labelled texts and a function text -> unit vector, from plain words."""
    terms = lambda t: [w for word in re.findall(r"[a-z0-9]+", t.lower()) for w in [word, *[(n, word[:n]) for n in toxicity.STEMS if len(word) > n]]]
    n, n1 = len(texts), sum(labels)
    ones, zeros = defaultdict(int), defaultdict(int)
    for t, y in zip(texts, labels, strict=True):
        for term in set(terms(t)):
            (ones if y else zeros)[term] += 1
    weight = {}
    for t in {*ones, *zeros}:
        a, b = ones[t], zeros[t]
        spread = (a + b) * (n - a - b) * n1 * (n - n1)
        weight[t] = (np.log((1 + n) / (1 + a + b)) + 1) * np.sqrt(max(1, n * (a * n - (a + b) * n1) ** 2 / spread if spread else 0))

    def vector(text):
        found = terms(text)
        x = {t: (1 + np.log(found.count(t))) * weight.get(t, np.log(1 + n) + 1) for t in set(found)}
        norm = np.sqrt(sum(v * v for v in x.values()))
        return {t: v / norm for t, v in x.items()}

    return vector


@pytest.mark.parametrize("common", [3, 400])
def test_toxicity_neighbours_over_whole_texts(spark, monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = random.Random(4)
    plain = lambda n: " ".join(f"word{rng.randrange(90)}" for _ in range(n))
    rows = [(i, plain(rng.randrange(5, 40)), 0) for i in range(400)]
    rows += [(400 + i, f"{plain(8)} scumbag grobian", 1) for i in range(60)]
    rows += [(460 + i, f"rareslur{i} oddinsult{i} vilename{i}", 1) for i in range(20)]  # words of one toxic row each
    copies = [(900 + i, rows[460 + i][1], 1) for i in range(20)]
    queries = [*copies, (950, plain(3000) + " scumbag", 0), (951, "nothing known here but word7", 0), (952, plain(30), 0), (953, "unheard", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows + queries], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(index.block_max) > (9 if common == 3 else 0)
    vector = weighed([t for _, t, _ in rows], [y for _, _, y in rows])
    known = {frozenset((t, round(v, 9)) for t, v in e.items()): e for e in (vector(t) for _, t, _ in rows)}.values()  # equal vectors are one entry
    asked = list(toxicity.counts_of(pa.array([t for _, t, _ in queries])))
    for (_, text, _), (hashes, counts) in zip(queries, asked, strict=True):
        hit = np.isin(hashes, index.terms)
        columns = np.searchsorted(index.terms, hashes[hit])
        if not len(columns):
            continue
        ((_, cosines, _),) = index.nearest([(columns, index.vector(columns, counts[hit], counts[~hit]))])
        q = vector(text)
        want = sorted((c for e in known if (c := sum(v * e[t] for t, v in q.items() if t in e)) > 0), reverse=True)[: toxicity.NEAREST]
        assert np.allclose(cosines, want)
    found = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    assert all(found[i].evidence[0] == i - 440 for i, _, _ in copies)  # an exact copy of a labelled text finds it
    assert min(found[i].score for i, _, _ in copies) > max(found[i].score for i in (950, 951, 952, 953))
    assert found[950].score < 0.5
    assert found[953].score == index.prior and not found[953].evidence


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    """A labelled doc_id repeated in most rows fills no more than its share of the sample; all terms of the sample count."""
    kept = []
    real = toxicity.build
    monkeypatch.setattr(toxicity, "build", lambda terms, df, examples, counted: kept.append((terms, examples)) or real(terms, df, examples, counted))
    rows = [(i, f"clean{i} word a{i} b{i} c{i}") for i in range(900)] + [(1000 + i, f"bad{i} awful d{i} e{i}") for i in range(60)]
    many = spark.range(20_000).selectExpr("1000L AS doc_id", "concat('bad word', id % 7000) AS text").unionByName(spark.createDataFrame([(2, "same text here")] * 3000, "doc_id long, text string"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(many)
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    toxicity.fit(docs, labels, max_examples=1500)
    terms, examples = kept[0]
    assert len(examples) <= 1500 and len({(e[0], e[2].tobytes()) for e in examples}) == len(examples)
    assert sum(e[1] for e in examples) == 500 and sum(1 - e[1] for e in examples) == 901
    assert len(terms) > 4096


def test_toxicity_scores_keep_the_share_of_labels(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"word{rng.randrange(60)}" for _ in range(8)), int(i % 10 == 0)) for i in range(3000)]  # labels say nothing of texts
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, max_examples=600)  # a third of the examples are toxic, a tenth of the rows
    assert abs(index.base - 0.1) < 0.02
    assert abs(np.mean([r.score for r in toxicity.score(docs.limit(600), index).collect()]) - 0.1) < 0.05
