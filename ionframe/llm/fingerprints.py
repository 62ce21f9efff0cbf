r"""Document fingerprints by winnowing, with DataFrame and SQL functions only.

A text's tokens are its runs of ``[^\x20\x09-\x0D]``, runs longer than ``TOKEN_CHARS`` cut from their beginning. Every
``gram`` tokens that follow each other have a hash (fewer tokens: one hash of all). Of every ``window`` hashes that follow
each other the smallest is a mark, the rightmost of equal ones; the windows that the text's beginning cuts short count
too, so that short texts have more than one mark. A mark is kept with its hash and its place (the number of its first
token). Match guarantee: two texts that share ``window + gram - 1`` tokens in a row share a mark inside them.

The minimum of a window comes from minima of shorter ones (1, 2, 4, ... hashes), so a text costs a few passes over an
array whatever the window. A hash and its place are one long: 36 bits of hash, then the place counted down, so the
smallest long is the smallest hash and of equal hashes the rightmost.

``with_next`` pairs each document with the next by doc_id. Keys (doc_id, hash of the text) give bounds of buckets (about
``BUCKET_DOCS`` documents, at most ``MAX_BUCKETS`` bounds, from a sample; any bounds give the same result). A row finds
its bucket by binary search; the first row of a bucket goes to the bucket before it too, the very first to the last. So
whole texts are shuffled once and every row's next stands beside it. Rows alike in doc_id and text that are ``HOT`` or
more, and more than a bucket's share, become one row with a count before the shuffle.

Defined results: a null text is empty; a text without tokens has no marks, and two such texts have likeness 1; a null
doc_id counts as the largest; rows of one doc_id stand in the order of their texts' hashes, rows alike one behind the
other (all but the last are their own next, and so is a single row); very long texts, and tokens, are read whole (places
count modulo 2 ** 27); other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.storage import Scratch, table

GRAM, WINDOW, TOKEN_CHARS = 4, 8, 32
BUCKET_DOCS, MAX_BUCKETS, HOT, OVERSAMPLE = 128, 1 << 15, 1000, 4
PLACE_BITS, HASH_BITS = 27, 36
LAST_ID = (1 << 63) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN_CHARS), F.lit(0))


def _grams(hashes: Column, gram: int) -> Column:
    def packed(i: Column) -> Column:
        whole = F.xxhash64(*[F.get(hashes, i + j) for j in range(gram)])
        place = F.pmod(i.cast("long"), F.lit(1 << PLACE_BITS))
        return F.shiftleft(F.shiftrightunsigned(whole, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(F.lit((1 << PLACE_BITS) - 1) - place)

    places = F.sequence(F.lit(0), F.greatest(F.size(hashes) - gram, F.lit(0)))
    return F.when(F.size(hashes) > 0, F.transform(places, packed)).otherwise(F.array().cast("array<bigint>"))


def _least_of_two(step: int):
    return lambda values: F.transform(values, lambda x, i: F.least(x, F.get(values, i - F.lit(step))))


def _minima(values: Column, window: int) -> Column:
    """The minimum of each value and the ``window - 1`` before it."""
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        values = _let(values, _least_of_two(step))
        reach += step
    return values


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The marks of a text as longs, in the order of their places."""
    hashes = F.transform(tokens(text), lambda x: F.xxhash64(x))
    return _let(hashes, lambda h: F.array_distinct(_minima(_grams(h, gram), window)))


def hash_of(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, PLACE_BITS)


def place_of(mark: Column) -> Column:
    return (F.lit((1 << PLACE_BITS) - 1) - mark.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).cast("int")


def unpacked(found: Column) -> Column:
    """Marks as an array of (hash, place)."""
    return F.transform(found, lambda m: F.struct(hash_of(m).alias("hash"), place_of(m).alias("place")))


def as_text(found: Column) -> Column:
    """Marks as one string: ``hash@place`` in the order of their places, hashes in hex."""
    return F.array_join(F.transform(found, lambda m: F.concat(F.hex(hash_of(m)), F.lit("@"), place_of(m).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints, 1 if both have none."""
    one, other = (F.array_distinct(F.transform(x, hash_of)) for x in (a, b))
    both = F.size(F.array_intersect(one, other))
    every = F.size(one) + F.size(other) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, marks as an array of (hash, place)) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), unpacked(marks(F.coalesce("text", F.lit("")), gram, window)).alias("marks"))


def shared_marks(prints: DataFrame) -> DataFrame:
    """(hash, doc_id, place) of the marks that at least two rows of ``fingerprints`` hold; no pairs are listed."""
    flat = prints.select("doc_id", F.explode("marks").alias("m")).select("m.hash", "doc_id", "m.place")
    common = flat.groupBy("hash").agg(F.count_distinct(F.struct("doc_id")).alias("n")).where("n > 1").select(F.col("hash").alias("_hash"))
    return flat.join(common, F.col("hash") == F.col("_hash")).select("hash", "doc_id", "place")


def _bounds(keys: DataFrame) -> list[tuple[int, int]]:
    """The smallest key and, of larger tables, keys about a bucket apart: at most ``MAX_BUCKETS``."""
    n, least = keys.agg(F.count(F.lit(1)), F.min(F.struct("id", "h"))).first()
    buckets = min(MAX_BUCKETS, n // BUCKET_DOCS)
    if not n:
        return []
    if not buckets:
        return [tuple(least)]
    sample = sorted(map(tuple, keys.sample(False, min(1.0, OVERSAMPLE * buckets / n), 7).collect()))
    return sorted({tuple(least), *sample[OVERSAMPLE - 1 :: OVERSAMPLE]})


def _bucketed(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds bucket and guest: a row of (id, h) comes to its bucket, and a bound's row to the bucket before as a guest too."""
    n = len(bounds)
    ids, hashes = (f"array({','.join(f'{b[k]}L' for b in bounds)})" for k in (0, 1))
    steps = ",".join(str(1 << k) for k in reversed(range(n.bit_length())))
    at = f"get({ids}, acc + s - 1)"
    place = f"aggregate(array({steps}), 0, (acc, s) -> IF(acc + s <= {n} AND ({at} < id OR ({at} = id AND get({hashes}, acc + s - 1) <= h)), acc + s, acc)) - 1"
    own, before = F.struct(F.col("place").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("place") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("guest"))
    first = F.expr(f"get({ids}, place) = id AND get({hashes}, place) = h")
    placed = rows.withColumn("place", F.expr(place))
    return placed.select(*rows.columns, F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("at")).select(*rows.columns, "at.bucket", "at.guest")


def _rows(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.withColumn("id", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("h", F.xxhash64("text"))


def with_next(docs: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """(doc_id, text, next_text, times) and, for each name in ``extra``, the column of ``text`` and next_<name> of the next one.

    ``times`` counts rows alike in all of this.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = _rows(docs)
    keys = scratch.table(rows.select("id", "h"), "document-keys")
    bounds = _bounds(keys)
    share = max(HOT, keys.count() // MAX_BUCKETS)
    hot = scratch.table(keys.groupBy("id", "h").count().where(F.col("count") >= share).select("id", "h"), "hot-keys")
    scratch.drop("document-keys")
    counted = not hot.isEmpty()
    rows = rows.withColumn("n", F.lit(1).cast("long"))
    if counted:  # at most MAX_BUCKETS keys, or one for each HOT rows of a table below MAX_BUCKETS * HOT rows
        some = F.broadcast(hot)
        alike = rows.join(some, ["id", "h"], "left_semi").groupBy("doc_id", "text", "id", "h").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(some, ["id", "h"], "left_anti").select(*alike.columns).unionByName(alike)
    if bounds:
        rows = _bucketed(rows, bounds).repartition("bucket")
    else:
        rows = rows.withColumns({"bucket": F.lit(0), "guest": F.lit(False)})
    in_order = W.partitionBy("bucket").orderBy("guest", "id", "h", "text", "doc_id")
    rows = rows.withColumns(extra)
    names = ["text", *extra]
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(in_order) for c in names}).where(~F.col("guest"))
    once = rows.select("doc_id", *names, *[f"next_{c}" for c in names], F.lit(1).cast("long").alias("times"))
    if not counted:
        return once
    again = rows.where("n > 1").select("doc_id", *names, *[F.col(c).alias(f"next_{c}") for c in names], (F.col("n") - 1).alias("times"))
    return once.unionByName(again)


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, text, edited_text, marks, edited_marks, next_marks.

    The edited text has its last quarter (``floor(n / 4)`` code points) replaced by as many first ones of the next text.
    """
    pairs = with_next(docs, {"marks": marks(F.col("text"), gram, window)})
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - quarter), F.substr("next_text", F.lit(1), quarter))
    out = pairs.select("doc_id", "text", "marks", "next_marks", edited.alias("edited_text"), "times")
    out = out.withColumn("edited_marks", marks(F.col("edited_text"), gram, window))
    copies = F.explode(F.when(F.col("times") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("doc_id", "text", "edited_text", "marks", "edited_marks", "next_marks", copies.alias("_copy")).drop("_copy")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
