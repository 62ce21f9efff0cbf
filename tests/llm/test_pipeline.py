"""The pipeline against a brute-force version on a small corpus, and the registry."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from ionframe.llm import langid, mixing, registry, sentencepiece_codec
from tests.llm.test_dedup import brute_lines
from tests.llm.test_models_and_mix import language_rows
from tests.llm.test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(8)
    common = "a common line that many documents hold somewhere"
    rows = []
    for i, t, k in language_rows(150):
        lines = [t, *([common] if rng.random() < 0.3 else []), " ".join(f"own{rng.randrange(10**6)}" for _ in range(30))]
        rows.append((i, "\n".join(lines), k, rng.choice(["a", "b", "c", None]), 0))
    for i in range(150, 170):  # near copies
        old = rows[i - 150]
        rows.append((i, old[1] + " extra", old[2], "b", 0))
    rows += [(300, "1 2 3", "aa", "a", 0), (301, None, "bb", "a", 0), (302, rows[0][1], "aa", "c", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_pipeline_is_its_stages_by_brute_force(spark, corpus):
    folder, rows = corpus
    found = corpus_pipeline.run(spark, folder).collect()
    # language ID: the model is the operator's own; what it must do here is drop the two rows without letters
    docs = [r for r in rows if r[0] not in (300, 301)]
    kept = {r.doc_id for r in langid.identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {r[0] for r in docs}
    text = {i: t for i, _, _, t in brute_lines([(r[0], r[1]) for r in docs])}
    near = brute([(r[0], text[r[0]]) for r in docs], 5, 80)
    firsts = {c for _, _, c in near}
    assert len(firsts) < len(docs) - 10
    rest = [(r[0], text[r[0]], r[2], r[3], len(text[r[0]])) for r in docs if r[0] in firsts]
    plan = mixing.mix(spark.createDataFrame(rest, SCHEMA)).collect()
    copies = Counter({r.doc_id: int(r.taken / r.size + 0.5) for r in plan if r.size})
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = []
    for i, n in copies.items():
        ids = library.encode(text[i])
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] * n
    assert sorted(map(tuple, found)) == sorted(want)


def test_stages_keep_the_columns(spark, corpus):
    folder, rows = corpus
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows[:40]], SCHEMA + ", kept_text string, component_id int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_short_texts_go_through_every_stage(spark, corpus):
    """No line has the 20 code points of a key, no text the five words of a shingle."""
    folder, _ = corpus
    docs = spark.createDataFrame([(i, f"one w{i}" if i % 2 else f"x{i}", "aa", "a", 0) for i in range(60)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() > 0


def test_registry():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, len(registry.QUERIES) + 1))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
