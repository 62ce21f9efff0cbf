"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased whole text (anything but letters counts as one space), hashed to
``DIMENSIONS`` columns, weighted (1 + ln tf) * idf and scaled to length 1. The model is trained with
follow-the-regularised-leader (FTRL-proximal) under L1 and L2 penalties, which leaves most weights zero. A temperature
fitted on a part of the training rows kept apart, and on pieces of ``PIECE_WORDS`` words from anywhere in them, calibrates
its probabilities; the pieces are there because whole texts alone are all told rightly and would draw it to nothing.

Training rows are a bounded sample: at most ``max_docs`` documents (one of each language where languages are more),
equally many of each language where there are enough, chosen by a hash of doc_id and text. Every language is learned. The
feature vectors are made by the executors; the driver receives at most that many vectors of at most ``DIMENSIONS``
entries. Every document is then scored over its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without a training row every document is
``und``; of languages with equal probabilities the first by name is told; rows with one doc_id and text train once;
repeated rows are judged alike; a very long text is one document with all its n-grams; a null doc_id is not held out and
never trains; other columns pass through, but those with the names of the results are replaced; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionframe.llm.textscan import buffers, pieces
from ionframe.storage import materialise, table

DIMENSIONS, ORDERS = 1 << 13, (1, 2, 3)
MAX_TRAIN_DOCS, PIECE_ROWS, PIECE_WORDS = 3000, 256, (1, 2, 4, 8)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
#: The least inverse temperature: where examples contradict the weights altogether, languages keep their order.
LEAST_SHARPNESS = 1e-3
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def counts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, n-gram counts by row and column, whether a row has a letter) over bounded pieces of a batch."""
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    data, offsets = buffers(column)
    for first, last in pieces(offsets):
        for a in range(first, last, PIECE_ROWS):
            b = min(a + PIECE_ROWS, last)
            raw = data[offsets[a] : offsets[b]]
            ends = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][offsets[a : b + 1] - offsets[a]]
            points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
            letter = letters()[points]
            points = np.where(letter, points, np.uint32(32))
            row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(ends))
            stop = ends[1:][row] if len(row) else row
            total = np.zeros((b - a) * DIMENSIONS, dtype=np.int64)
            for n in ORDERS:
                size = len(points) - n + 1
                if size <= 0:
                    continue
                code = np.full(size, np.uint32(n) * np.uint32(0x27D4EB2F))
                some = np.zeros(size, dtype=bool)
                for k in range(n):
                    code = (code ^ points[k : k + size]) * np.uint32(0x9E3779B1)
                    code ^= code >> np.uint32(15)
                    some |= letter[k : k + size]
                some &= np.arange(n - 1, n - 1 + size) < stop[:size]
                total += np.bincount(row[:size][some] * DIMENSIONS + (code[some] & np.uint32(DIMENSIONS - 1)), minlength=len(total))
            has = np.zeros(b - a, dtype=bool)
            has[row[letter]] = True
            yield a, b, total.reshape(b - a, DIMENSIONS), has


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    sharpness: float  # the inverse temperature

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        x = scaled(counts, self.idf)
        return softmax(x @ self.weights * self.sharpness)


def scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape, dtype=np.float32)
    at = np.nonzero(counts)
    x[at] = (1 + np.log(counts[at])) * idf[at[-1]]
    norm = np.sqrt(np.einsum("...i,...i->...", x, x))
    return x / np.maximum(norm, 1e-12)[..., None]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """The inverse temperature under which the true languages are likeliest.

    The loss is convex in it, and Newton steps have no bounds. The truth counts (n + 1) / (n + 2) of each of n examples, the
    rest is dealt to the other languages, so that faultless examples do not sharpen it without end.
    """
    n, size = logits.shape
    if not n or size < 2:
        return 1.0
    wanted = np.full((n, size), 1 / (n + 2) / (size - 1))
    wanted[np.arange(n), truth] = (n + 1) / (n + 2)

    def loss(sharp: float) -> float:
        x = logits * sharp
        top = x.max(axis=1)
        return float((np.log(np.exp(x - top[:, None]).sum(axis=1)) + top - (wanted * x).sum(axis=1)).sum())

    sharp = 1.0
    for _ in range(100):
        p = softmax(logits * sharp)
        mean = (p * logits).sum(axis=1)
        slope, bend = (mean - (wanted * logits).sum(axis=1)).sum(), ((p * logits**2).sum(axis=1) - mean**2).sum()
        if bend <= 0 or abs(slope) <= 1e-9 * n:
            break
        step = slope / bend
        while loss(sharp - step) > loss(sharp) and abs(step) > 1e-9:
            step /= 2
        sharp -= step
    return max(float(sharp), LEAST_SHARPNESS)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], pieces_of: dict[int, list[tuple[np.ndarray, np.ndarray]]] | None = None) -> Model | None:
    """Fits the model to (language, columns, counts); every fifth row, with its pieces (by the row's place), only calibrates."""
    languages = sorted({r[0] for r in rows})
    if not rows:
        return None
    fit, hold = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    fit = fit or hold
    df = np.zeros(DIMENSIONS)
    for _, columns, _ in fit:
        df[columns] += 1
    idf = (np.log((1 + len(fit)) / (1 + df)) + 1).astype(np.float32)
    code = {k: i for i, k in enumerate(languages)}

    def vector(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * idf[columns]
        return (x / np.sqrt((x * x).sum())).astype(np.float64)

    data = [(code[k], c, vector(c, n)) for k, c, n in fit if len(c)]
    z, n = np.zeros((DIMENSIONS, len(languages))), np.zeros((DIMENSIONS, len(languages)))

    def current(columns: np.ndarray) -> np.ndarray:
        zc = z[columns]
        return np.where(np.abs(zc) <= L1, 0.0, -(zc - np.sign(zc) * L1) / ((BETA + np.sqrt(n[columns])) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(data)):
            y, columns, x = data[i]
            w = current(columns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[columns] + g * g) - np.sqrt(n[columns])) / ALPHA
            z[columns] += g - sigma * w
            n[columns] += g * g
    weights = current(np.arange(DIMENSIONS))
    apart = [(code[k], c, n) for i, (k, *whole) in enumerate(rows) if i % 5 == 0 for c, n in [whole, *(pieces_of or {}).get(i, [])] if len(c)]
    logits = np.array([vector(c, n) @ weights[c] for _, c, n in apart]).reshape(-1, len(languages))
    sharpness = calibrated(logits, np.array([k for k, *_ in apart], dtype=int))
    return Model(languages, idf, weights.astype(np.float32), sharpness)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = [batch.column(name) for name in ("lang", "parent", "words")]
        for a, b, counts, _ in counts_of(batch.column("text")):
            found = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [*[c.slice(a, b - a) for c in given], pa.array([f.astype(np.uint16).tobytes() for f in found], pa.binary()), pa.array([c[f].astype(np.uint32).tobytes() for c, f in zip(counts, found, strict=True)], pa.binary())],
                names=["lang", "parent", "words", "columns", "counts"],
            )


def fit(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model | None:
    """The model learned from the rows of (doc_id, text, lang) with a text and a language."""
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    th = F.xxhash64("text")
    alike = materialise(usable.select("lang", "doc_id", th.alias("th")).distinct(), "langid-rows")
    sizes = materialise(alike.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = sizes.count()
    if not languages:
        return None
    each = max(1, max_docs // languages)
    # the rows of a language's smallest hashes, of some four times as many that a hash lets through, so that no window is large
    place = F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("th"))
    near = alike.join(sizes, F.col("lang") == F.col("of")).where(F.pmod(place, F.lit(1_000_003)) * F.col("n") < F.lit(1_000_003.0 * (4 * each + 100)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(place, "doc_id", "th"))
    keys = near.withColumn("rank", rank).where(F.col("rank") <= each)
    keys = materialise(keys.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "langid-sample")
    same = (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_id")) & (th == F.col("_th"))
    sample = usable.join(F.broadcast(keys), same).groupBy("_lang", "_id", "_th").agg(F.first("text").alias("text")).select(F.col("_lang").alias("lang"), F.concat_ws("|", F.hex("_th"), "_id", "_lang").alias("parent"), "text")
    words = F.split("text", r"\s+")
    cut = [F.array_join(F.slice(words, F.pmod(F.xxhash64(F.lit(n), "text"), F.size(words) - n + 1).cast("int") + 1, n), " ") for n in PIECE_WORDS]
    parts = [F.struct(F.lit(n).alias("words"), F.when(F.size(words) > n, c).alias("text")) for n, c in zip(PIECE_WORDS, cut, strict=True)]
    pieced = sample.select("lang", "parent", F.explode(F.array(F.struct(F.lit(0).alias("words"), "text"), *parts)).alias("p")).select("lang", "parent", "p.words", "p.text").where("text IS NOT NULL")
    rows = pieced.mapInArrow(_sparse, "lang string, parent string, words int, columns binary, counts binary").collect()
    found = [(r["lang"], np.frombuffer(r["columns"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32).astype(np.float64), r["parent"], r["words"]) for r in rows]
    wholes = sorted((r for r in found if not r[4]), key=lambda r: (hash_of(r[1], r[2]), r[0], r[3]))
    place = {r[3]: i for i, r in enumerate(wholes)}
    pieces_of: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for _, columns, counts, parent, n in sorted(found, key=lambda r: r[4]):
        if n:
            pieces_of.setdefault(place[parent], []).append((columns, counts))
    return train([r[:3] for r in wholes], pieces_of)


def hash_of(columns: np.ndarray, counts: np.ndarray) -> int:
    """An order of training rows that no partitioning changes."""
    return int((columns * 2654435761 + counts.astype(np.int64) * 40503).sum() & 0xFFFFFFFF) * 2654435761 & 0xFFFFFFFF


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = model.value
        for batch in batches:
            for a, b, counts, has in counts_of(batch.column("text")):
                if m is None:
                    langs, scores = [UNDETERMINED] * (b - a), np.zeros(b - a)
                else:
                    p = m.probabilities(counts)
                    langs = [m.languages[k] if h else UNDETERMINED for k, h in zip(p.argmax(axis=1), has, strict=True)]
                    scores = np.where(has, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang", "score"])

    return run


def _judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, lang, score): each row of ``docs`` as one struct, with its language and probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x languages numbers at most
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.struct("*").alias("row"), "text").mapInArrow(_predict(shared), schema)


def predict(docs: DataFrame, model: Model | None, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The columns of ``docs`` with the predicted language and its probability."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in (lang_as, score_as)]
    return _judged(docs, model).select(*kept, F.col("lang").alias(lang_as), F.col("score").alias(score_as))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~fold))
    found = predict(docs.select("doc_id", fold.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is told with a probability of ``least`` or more; the model learns from the table's own lang
    column. Where that has no language at all, those with a letter stay."""
    model = fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = _judged(docs, model).where((F.col("lang") != UNDETERMINED) & (F.col("score") >= least))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
