r"""Source divergence audit: what each source of a language says more often than the language, and how far sources differ.

Terms are the runs of letters A-Z, a-z and of all code points above U+007F; only A-Z is lower-cased. A language keeps the V
terms in at least ``MIN_DOCS`` of its documents. A (language, source) group and a language give a kept term the share
p = 1 + floor(10^9 (n + 1) / (N + V)), n being its occurrences there and N those of all kept terms. The divergence of p
from q is f = floor((p - q)^2 / q). All of it is in integers.

* Terms are cut and counted batch by batch, with their bytes compared, and pre-aggregated before the shuffle; a marker with
  an empty term stands for each group, so that groups without terms are there too. The text is read once.
* Pairs of sources are sparse: a term that a group lacks has the group's base share there. The sum over all V terms is V
  times the divergence of the bases, plus corrections: for each share of the one group against the other's base (terms of
  one share are one row), the same with roles changed, and for the terms that both hold what these two miss. So only terms
  that two sources share meet, and their sums are pre-aggregated.
* The ``TOP`` terms of each group are selected by radix: a histogram over ``DIGIT`` bits of the values says in which digit
  the group's last place lies, the next one looks into that digit only, until the value of the last place is known. Ties
  there are refined by the bytes of the terms: two bytes at a time, from the first that differs. A histogram has at most
  2^16 digits a group, and only the selected rows are ordered.

Defined results: null text, lang and source count as empty; rows are documents, so repeated rows count one by one; doc_ids
are not read; a language without kept terms has pairs of value 0 and no terms; equal values stand in the order of their
items' UTF-8 bytes; very long texts and terms are read whole; extra columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.llm.textscan import LOWER, buffers, pieces, words
from ionframe.storage import Scratch, table

MIN_DOCS, TOP, UNIT, DIGIT = 3, 200, 1_000_000_000, 12
TERMS = "lang string, source string, term string, n bigint, docs bigint"
GROUP = ["lang", "source"]
#: Bytes outside a term (all but the letters A-Z, a-z and bytes above 0x7F).
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    held = column.cast(pa.string()).fill_null("").dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of pieces of (lang, source, text); each group has an empty term too."""
    names = [c.split()[0] for c in TERMS.split(", ")]
    for batch in batches:
        (lang, langs), (source, sources) = _codes(batch.column("lang")), _codes(batch.column("source"))
        group = lang * max(1, len(sources)) + source
        data, offsets = buffers(batch.column("text").cast(pa.large_string()))
        for a, b in pieces(offsets):
            bounds = offsets[a : b + 1]
            starts, ends, first = words(data, bounds, OUTSIDE)
            own = data[bounds[0] : bounds[-1]]
            letters, ends = LOWER[own[~OUTSIDE[own]]], np.r_[0, np.cumsum(ends - starts)]
            terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)).dictionary_encode()
            code, n_terms = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(terms.dictionary))
            row = np.repeat(np.arange(a, b), np.diff(first))
            in_row, times = np.unique(row * n_terms + code, return_counts=True)
            key, at = np.unique(group[in_row // n_terms] * n_terms + in_row % n_terms, return_inverse=True)
            marker = np.unique(group[a:b])
            of = np.r_[key // n_terms, marker]
            term = pa.concat_arrays([terms.dictionary.take(pa.array(key % n_terms)).cast(pa.string()), pa.array([""] * len(marker), pa.string())])
            none = np.zeros(len(marker), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(of // max(1, len(sources)))),
                    sources.take(pa.array(of % max(1, len(sources)))),
                    term,
                    pa.array(np.r_[np.bincount(at, times, len(key)).astype(np.int64), none]),
                    pa.array(np.r_[np.bincount(at, minlength=len(key)).astype(np.int64), none]),
                ],
                names=names,
            )


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + terms)), in decimals."""
    whole = lambda x: x.cast("decimal(20,0)")
    return (F.lit(1) + _div(whole(n + 1) * F.lit(UNIT).cast("decimal(10,0)"), whole(total + terms))).cast("long")


def _kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, one) of kept terms, and the empty term of every group; ``one`` marks a term's first group."""
    own = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    counts = own.mapInArrow(term_counts, TERMS).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = W.partitionBy("lang", "term")
    in_all = counts.withColumns({"lang_docs": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "place": F.row_number().over(of.orderBy("source"))})
    kept = in_all.where((F.col("term") == "") | (F.col("lang_docs") >= min_docs))
    return kept.select(*GROUP, "term", "n", "lang_n", ((F.col("place") == 1) & (F.col("term") != "")).alias("one"))


def shares(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms): (lang, source, terms, base), base null without terms; (lang, source, term, p, q, base) of occurring kept terms."""
    kept = scratch.table(_kept_terms(docs, min_docs), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("one").cast("long")).alias("terms"))
    groups = kept.groupBy(*GROUP).agg(F.sum("n").alias("total")).join(langs, "lang")
    base = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.nullif("terms", F.lit(0))))
    groups = scratch.table(groups.withColumn("base", base), "groups")
    held = kept.where("term <> ''").join(groups, GROUP)
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = scratch.table(held.select(*GROUP, "term", p.alias("p"), q.alias("q"), "base"), "term-shares")
    scratch.drop("kept-terms")
    return groups, terms


def pair_divergence(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source's shares from each other source's, over all kept terms."""
    ends = [groups.select("lang", F.col("source").alias(name), F.col("base").alias(f"{name}_base"), "terms") for name in ("source", "item")]
    pairs = ends[0].join(ends[1].drop("terms"), "lang").where("source <> item")
    bases = divergence(F.col("source_base"), F.col("item_base"))
    spread = terms.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("n"))
    by_item = spread.withColumnRenamed("source", "item")
    key = ["lang", "source", "item"]
    ground = pairs.select(*key, (F.col("terms") * bases).alias("value"))
    own = pairs.join(spread, GROUP).groupBy(*key).agg(F.sum(F.col("n") * (divergence(F.col("p"), F.col("item_base")) - bases)).alias("value"))
    other = pairs.join(by_item, ["lang", "item"]).groupBy(*key).agg(F.sum(F.col("n") * (divergence(F.col("source_base"), F.col("p")) - bases)).alias("value"))
    a, b = (terms.select("lang", "term", F.col("source").alias(f"{x}_source"), F.col("p").alias(f"{x}_p"), F.col("base").alias(f"{x}_base")) for x in "ab")

    def missed(x: str, y: str) -> Column:
        px, py, bx, by = (F.col(c) for c in (f"{x}_p", f"{y}_p", f"{x}_base", f"{y}_base"))
        return F.sum(divergence(px, py) - divergence(px, by) - divergence(bx, py) + divergence(bx, by))

    shared = a.join(b, ["lang", "term"]).where("a_source < b_source").groupBy("lang", "a_source", "b_source").agg(missed("a", "b").alias("there"), missed("b", "a").alias("back"))
    ways = F.array(*[F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item"), F.col(v).alias("value")) for x, y, v in (("a", "b", "there"), ("b", "a", "back"))])
    shared = shared.select("lang", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", "w.value")
    found = ground.unionByName(own).unionByName(other).unionByName(shared)
    return found.groupBy(*key).agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))


def _last_values(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(lang, source, last, need, ties): the k-th largest value of each group, how many of its ties have a place, how many there are.

    A group of at most k rows has last -1.
    """
    spans = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
    bits = F.length(F.bin(F.col("low").bitwiseXOR(F.col("high"))))
    state = spans.where(F.col("rows") > k).select(*GROUP, F.lit(k).cast("long").alias("need"), F.greatest(bits - DIGIT, F.lit(0)).cast("int").alias("shift"), F.lit(64).alias("before"), F.lit(0).cast("long").alias("digit"), F.col("rows").alias("ties"))
    state = scratch.table(state.withColumn("done", F.lit(False)), "selection")
    # a shift of 63 or more leaves nothing of a value that is no less than 0
    high = lambda value, by: F.when(F.col(by) >= 63, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", value, F.col(by)))
    while state.where(~F.col("done")).limit(1).count():
        inside = rows.join(state.where(~F.col("done")), GROUP).where(high(F.col("value"), "before") == F.col("digit"))
        counts = inside.groupBy(*GROUP, "need", "shift", high(F.col("value"), "shift").alias("next")).agg(F.count(F.lit(1)).alias("n"))
        above = F.coalesce(F.sum("n").over(W.partitionBy(*GROUP).orderBy(F.col("next").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("above", above).where((F.col("above") < F.col("need")) & (F.col("need") <= F.col("above") + F.col("n")))
        moved = placed.select(*GROUP, (F.col("need") - F.col("above")).alias("need"), F.greatest(F.col("shift") - DIGIT, F.lit(0)).cast("int").alias("shift"), F.col("shift").alias("before"), F.col("next").alias("digit"), F.col("n").alias("ties"), (F.col("shift") == 0).alias("done"))
        state = scratch.table(moved.unionByName(state.where("done")), "selection")
    every = spans.where(F.col("rows") <= k).select(*GROUP, F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("need"), F.lit(0).cast("long").alias("ties"))
    return scratch.table(state.select(*GROUP, F.col("digit").alias("last"), "need", "ties").unionByName(every), "last-values")


def _refined(ties: DataFrame, scratch: Scratch) -> DataFrame:
    """The ``need`` rows of each group of (lang, source, item, value, need) whose items have the smallest bytes; items of a group differ."""
    out = []
    ties = scratch.table(ties.withColumn("bytes", F.encode("item", "utf-8")), "ties")
    while ties.limit(1).count():
        spans = ties.groupBy(*GROUP).agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
        split = lambda c: F.regexp_extract_all(F.hex(c), F.lit(".."), F.lit(0))
        first = F.array_position(F.zip_with(split("low"), split("high"), lambda x, y: x.eqNullSafe(y)), False).cast("int")
        ties = ties.join(spans.select(*GROUP, first.alias("at")), GROUP).withColumn("digit", F.call_function("substring", F.col("bytes"), F.col("at"), F.lit(2)))
        counts = ties.groupBy(*GROUP, "need", "digit").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(*GROUP).orderBy("digit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        last = counts.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("n")))
        last = last.select(*GROUP, F.col("digit").alias("last"), (F.col("need") - F.col("before")).alias("left"), "n")
        sorted_out = ties.join(last, GROUP)
        keep = (F.col("digit") < F.col("last")) | ((F.col("digit") == F.col("last")) & (F.col("n") == F.col("left")))
        name = f"refined-{len(out)}"
        out.append(scratch.table(sorted_out.where(keep).select(*GROUP, "item", "value"), name))
        again = sorted_out.where((F.col("digit") == F.col("last")) & (F.col("n") > F.col("left")))
        ties = scratch.table(again.select(*GROUP, "item", "value", F.col("left").alias("need"), "bytes"), "ties")
    found = ties.select(*GROUP, "item", "value")  # none are left
    for more in out:
        found = found.unionByName(more)
    return found


def top_items(rows: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The k rows of each group of (lang, source, item, value) by value descending, then item; values are 0 or more, items of a group differ."""
    rows = scratch.table(rows, "ranked-values")
    placed = rows.join(_last_values(rows, k, scratch), GROUP)
    columns = [*GROUP, "item", "value"]
    sure = placed.where((F.col("value") > F.col("last")) | ((F.col("value") == F.col("last")) & (F.col("ties") == F.col("need")))).select(*columns)
    ties = placed.where((F.col("value") == F.col("last")) & (F.col("ties") > F.col("need"))).select(*columns, "need")
    return sure.unionByName(_refined(ties, scratch))


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source, part ``term`` the terms said more often."""
    scratch = Scratch(docs.sparkSession)
    groups, terms = shares(docs, scratch, min_docs)
    more = terms.where("p > q").select(*GROUP, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    parts = {"pair": pair_divergence(groups, terms), "term": top_items(more, top, scratch)}
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")).cast("int")
    ranked = [df.select(*GROUP, F.lit(part).alias("part"), "item", "value", rank.alias("rank")) for part, df in parts.items()]
    return ranked[0].unionByName(ranked[1])


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, lang, source, translate(w, '{UPPER_CASE}', '{LOWER_CASE}') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT x.lang, x.source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS BIGINT) AS p, CAST(1 + {UNIT}::HUGEINT * (k.n + 1) // (v.total + v.v) AS BIGINT) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q
), w AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= {TOP}
"""
