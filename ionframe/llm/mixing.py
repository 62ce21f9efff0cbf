r"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Each source gets a target: its weight's share of all words, capped at ``max_repeats`` times its own size; what a cap
   leaves over is shared again by weight (water filling, in closed form over the sources sorted by cap / weight).
2. The words of the mix are cut into blocks of ``block_words``. Blocks go to sources by the highest quotients
   target / (2k + 1), each source's blocks to its parts the same way, by size, and each part's to its shards: integer
   quotas. Parts are as many as the shards of each, so no level gives out more than the root of a source's shards at once.
3. Inside a shard the documents stand in an order seeded by md5; their words form a ring of blocks. A shard of L words
   that must give q blocks gives every document q * block_words div L times, and of the rest as many blocks as it holds,
   which follow each other on the ring from a block that the seed selects. So documents stay whole but for two a shard.

Only DataFrame functions run. Shards hold about ``shard_docs`` documents each, dealt by document and text, so a source, or
a doc_id, with a third of all rows is spread over many tasks. Rows alike are one entry with a count before any window.

Defined results: a null or empty text has size 0 and takes 0 words; a very long text is one document of its size; the null
source is a source, last in order; equal quotients go to the smaller name or number; rows alike in doc_id, source and text
count as documents of their own that stand one behind the other; a null doc_id is as any; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionframe.storage import materialise, table

#: Weights by the sources' order, repeated.
WEIGHTS = (1, 2, 3)
BLOCK_WORDS, SHARD_DOCS, MAX_REPEATS, SEED = 16, 500, 3, "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, text_md5: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("-"), text_md5))


def _number(digest: Column) -> Column:
    """A number from the first 7 hex digits."""
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Adds weight and target to (source, source_size), one row per source."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = (F.col("source_size") * max_repeats).cast("double")
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    return (
        ranked.withColumn("cap", cap)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the water level if this source and all later ones are not capped; the first source not above its cap sets it
        .withColumn("water", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("water", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(everything)["water"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "weight", "target")
    )


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each group, given to its parties by the highest quotients votes / (2k + 1).

    Rounding votes * seats / all votes gives each party's quota but for a difference of at most half the parties. It is met
    by the next (or the last) quotients, and those lie between the roundings for as many seats more (or fewer) as there
    are parties; listed are only these, in all at most three a party. Ties go to the smaller party.
    """
    of = W.partitionBy(*group)
    scaled = F.col(votes).cast("double") / F.nullif("_all", F.lit(0.0))
    base = (
        parties.withColumn("_all", F.sum(F.col(votes).cast("double")).over(of))
        .withColumn("_parties", F.count(F.lit(1)).over(of))
        .withColumn("_round", F.when(F.col("_all") > 0, F.floor(F.col(votes) * F.col(seats) / F.col("_all") + 0.5)).otherwise(0).cast("long"))
        .withColumn("_more", F.when(F.col("_all") > 0, F.col(seats) - F.sum("_round").over(of)).otherwise(0).cast("long"))
        .withColumn("_top", F.least(F.floor(scaled * (F.col(seats) + F.col("_parties")) + 0.5).cast("long"), F.col("_round") + F.col("_more") - 1))
        .withColumn("_low", F.greatest(F.floor(scaled * (F.col(seats) - F.col("_parties")) + 0.5).cast("long") - 1, F.col("_round") + F.col("_more"), F.lit(0).cast("long")))
    )
    steps = F.when((F.col("_more") > 0) & (F.col("_top") >= F.col("_round")), F.sequence("_round", "_top")).when(
        (F.col("_more") < 0) & (F.col("_round") > F.col("_low")), F.sequence(F.col("_low"), F.col("_round") - 1)
    )
    quotient = F.col(votes).cast("double") / (2 * F.col("_k") + 1)
    names = [F.col(p).asc_nulls_last() for p in party]
    last_names = [F.col(p).desc_nulls_first() for p in party]
    keys = [*group, *party]
    listed = base.select(*keys, votes, "_more", F.explode(steps).alias("_k")).withColumn("_q", quotient)
    place_up = F.row_number().over(of.orderBy(F.col("_q").desc(), *names, F.col("_k")))
    place_down = F.row_number().over(of.orderBy(F.col("_q").asc(), *last_names, F.col("_k").desc()))
    moved = (
        listed.withColumn("_place", F.when(F.col("_more") > 0, place_up).otherwise(place_down))
        .where(F.col("_place") <= F.abs("_more"))
        .groupBy(*keys)
        .agg(F.sum(F.signum("_more")).cast("long").alias("_moved"))
    )
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return base.alias("b").join(moved.alias("m"), cond, "left").select(
        *[F.col(f"b.{c}") for c in parties.columns], (F.col("b._round") + F.coalesce(F.col("m._moved"), F.lit(0))).alias("quota")
    )


def _overlap(a: Column, b: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(b, high) - F.greatest(a, low), F.lit(0))


def _entries(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """Per distinct (doc_id, source, text by md5): its size and count, its source's figures, its shard's ring and what that gives."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")]
    sized = materialise(docs.select(*own).groupBy("doc_id", "source", "text_md5").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n")), "sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("_docs"))
    per_source = source_targets(sources, weights, max_repeats)
    seats = F.round(F.sum("source_size").over(W.partitionBy()) / block_words).cast("long")
    quotas = sainte_lague(per_source.withColumn("_seats", seats).withColumn("_one", F.lit(1)), ["_one"], ["source"], "target", "_seats")
    shards = F.ceil(F.col("_docs") / shard_docs)
    wide = (
        quotas.alias("q")
        .join(sources.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")))
        .select("q.source", "q.source_size", "q.target", F.col("q.quota").alias("blocks"), shards.alias("shards"), F.ceil(F.sqrt(shards)).alias("parts"))
    )
    placed = (
        sized.withColumn("key", order_key(F.col("doc_id"), F.col("text_md5"), seed))
        .alias("d")
        .join(wide.alias("w"), F.col("d.source").eqNullSafe(F.col("w.source")))
        .select("d.*", "w.source_size", "w.target", "w.blocks", (_number(F.col("d.key")) % F.col("w.shards")).alias("shard"), "w.parts")
        .withColumn("part", F.col("shard") % F.col("parts"))
    )
    sizes = placed.groupBy("source", "part", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"), F.first("blocks").alias("blocks"))
    sizes = materialise(sizes, "shard-sizes")
    parts = sizes.groupBy("source", "part").agg(F.sum("shard_size").alias("part_size"), F.first("blocks").alias("blocks"))
    part_quotas = sainte_lague(parts, ["source"], ["part"], "part_size", "blocks").select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.col("quota").alias("part_blocks"))
    shard_votes = sizes.join(part_quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).select("source", "part", "shard", "shard_size", "part_blocks")
    quota = sainte_lague(shard_votes, ["source", "part"], ["shard"], "shard_size", "part_blocks").select("source", "part", "shard", "shard_size", "quota")
    length, words = F.col("shard_size"), F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeats)
    ring_blocks = F.ceil(length / block_words)
    first = _number(F.md5(F.concat(F.lit(f"{seed}-block-"), F.coalesce("source", F.lit("null")), F.lit("-"), F.col("shard").cast("string"))))
    plan = (
        quota.withColumn("rounds", F.when(length > 0, F.floor(words / length)).otherwise(0).cast("long"))
        .withColumn("ring_blocks", ring_blocks)
        .withColumn("rest_blocks", F.floor((words - F.col("rounds") * length + block_words / 2) / block_words).cast("long"))
        .withColumn("first_block", F.when(length > 0, first % F.greatest("ring_blocks", F.lit(1))).otherwise(0))
        .withColumnsRenamed({"source": "_s", "shard": "_h"})
        .drop("part")
    )
    ring = W.partitionBy("source", "shard").orderBy("key", "doc_id", "text_md5").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn("end", F.sum(F.col("size") * F.col("n")).over(ring))
        .join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
        .drop("_s", "_h", "blocks", "parts", "part")
    )


def _taken(copy: Column, block_words: int = BLOCK_WORDS) -> Column:
    """The words that the mix takes of an entry's copy number ``copy``: all of it each round, and what the selected blocks hold."""
    b = F.col("end") - F.col("size") * (F.col("n") - copy - 1)
    a = b - F.col("size")
    low, beyond = F.col("first_block"), F.col("first_block") + F.col("rest_blocks")
    tail = _overlap(a, b, low * block_words, F.least(beyond, F.col("ring_blocks")) * block_words)
    head = _overlap(a, b, F.lit(0), F.greatest(beyond - F.col("ring_blocks"), F.lit(0)) * block_words)
    return (F.col("rounds") * F.col("size") + tail + head).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and its shard."""
    entries = _entries(docs, weights, block_words, shard_docs, max_repeats, seed)
    copies = entries.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return copies.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("copy"), block_words).alias("taken"), "shard")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as its taken words hold it, rounded to whole copies.

    Only the two documents at the ends of a shard's run are taken in part, so rounding moves at most two documents a shard.
    Of rows alike in doc_id, source and text each comes as often as the least taken of them; what the others are taken more
    often comes as copies of the one that is first by its other columns.
    """
    whole = F.when(F.col("size") > 0, F.floor(_taken(F.col("copy")) / F.col("size") + 0.5)).otherwise(0)
    copies = _entries(docs).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("doc_id", "source", "text_md5", whole.cast("long").alias("times"))
    taken = copies.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_md5").alias("_md5")).agg(F.min("times").alias("_each"), (F.sum("times") - F.min("times") * F.count(F.lit(1))).alias("_more"))
    taken = materialise(taken.where("_each > 0 OR _more > 0"), "mix-copies")
    own = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_own_id"), F.col("source").alias("_own_source"), F.md5(F.coalesce("text", F.lit(""))).alias("_own_md5"))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_own_md5") == F.col("_md5"))
    each = own.join(taken.where("_each > 0").hint("merge"), same).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_each"))))
    more = own.join(taken.where("_more > 0").hint("merge"), same).groupBy("_own_id", "_own_source", "_own_md5").agg(F.min_by("_row", F.to_json("_row")).alias("_row"), F.first("_more").alias("_more"))
    more = more.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_more"))))
    return each.select("_row").unionByName(more.select("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '-' || md5(coalesce(text, ''))) AS key
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source
), s1 AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s0
), s2 AS (
  SELECT *, CAST(source_size * {MAX_REPEATS} AS DOUBLE) AS cap, source_size * {MAX_REPEATS} / weight AS level,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s1
), s3 AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS water0
  FROM s2 WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (
  SELECT *, (SELECT water0 FROM s3 WHERE water0 <= level ORDER BY level, water0 LIMIT 1) AS water FROM s3
), s5 AS (
  SELECT source, source_size, docs, coalesce(least(cap, water * weight), cap) AS target,
         CAST(round(total / {BLOCK_WORDS}) AS BIGINT) AS seats FROM s4
), s6 AS (
  SELECT *, CASE WHEN sum(target) OVER () > 0 THEN CAST(floor(target * seats / sum(target) OVER () + 0.5) AS BIGINT) ELSE 0 END AS r FROM s5
), s7 AS (SELECT *, CASE WHEN sum(target) OVER () > 0 THEN CAST(seats - sum(r) OVER () AS BIGINT) ELSE 0 END AS more FROM s6),
k1 AS (
  SELECT source, target, more, unnest(CASE WHEN more > 0 THEN range(r, r + more) WHEN more < 0 THEN range(greatest(r + more, 0), r) ELSE [] END) AS k FROM s7
), k2 AS (
  SELECT *, CASE WHEN more > 0 THEN row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k)
                 ELSE row_number() OVER (ORDER BY target / (2 * k + 1), source DESC NULLS FIRST, k DESC) END AS place FROM k1
), k3 AS (SELECT source, sum(sign(more)) AS moved FROM k2 WHERE place <= abs(more) GROUP BY source),
src AS (
  SELECT s7.source, s7.source_size, s7.target, CAST(s7.r + coalesce(k3.moved, 0) AS BIGINT) AS blocks,
         CAST(ceil(s7.docs / {SHARD_DOCS}) AS BIGINT) AS shards
  FROM s7 LEFT JOIN k3 ON s7.source IS NOT DISTINCT FROM k3.source
), p AS (
  SELECT d.*, src.source_size, src.target, src.blocks, CAST('0x' || substr(d.key, 1, 7) AS BIGINT) % src.shards AS shard,
         CAST('0x' || substr(d.key, 1, 7) AS BIGINT) % src.shards % CAST(ceil(sqrt(src.shards)) AS BIGINT) AS part
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), g0 AS (
  SELECT source, part, CAST(sum(size) AS BIGINT) AS part_size, any_value(blocks) AS blocks FROM p GROUP BY ALL
), g1 AS (
  SELECT *, CASE WHEN sum(part_size) OVER w > 0 THEN CAST(floor(part_size * blocks / CAST(sum(part_size) OVER w AS DOUBLE) + 0.5) AS BIGINT) ELSE 0 END AS r
  FROM g0 WINDOW w AS (PARTITION BY source)
), g2 AS (
  SELECT *, CASE WHEN sum(part_size) OVER w > 0 THEN CAST(blocks - sum(r) OVER w AS BIGINT) ELSE 0 END AS more FROM g1 WINDOW w AS (PARTITION BY source)
), i1 AS (
  SELECT source, part, part_size, more, unnest(CASE WHEN more > 0 THEN range(r, r + more) WHEN more < 0 THEN range(greatest(r + more, 0), r) ELSE [] END) AS k FROM g2
), i2 AS (
  SELECT *, CASE WHEN more > 0 THEN row_number() OVER (PARTITION BY source ORDER BY part_size / CAST(2 * k + 1 AS DOUBLE) DESC, part, k)
                 ELSE row_number() OVER (PARTITION BY source ORDER BY part_size / CAST(2 * k + 1 AS DOUBLE), part DESC, k DESC) END AS place FROM i1
), i3 AS (SELECT source, part, sum(sign(more)) AS moved FROM i2 WHERE place <= abs(more) GROUP BY ALL),
pt AS (
  SELECT g2.source, g2.part, CAST(g2.r + coalesce(i3.moved, 0) AS BIGINT) AS blocks FROM g2 LEFT JOIN i3 ON g2.source IS NOT DISTINCT FROM i3.source AND g2.part = i3.part
), h0 AS (
  SELECT p.source, p.part, p.shard, CAST(sum(p.size) AS BIGINT) AS shard_size, any_value(pt.blocks) AS blocks
  FROM p JOIN pt ON p.source IS NOT DISTINCT FROM pt.source AND p.part = pt.part GROUP BY ALL
), h1 AS (
  SELECT *, CASE WHEN sum(shard_size) OVER w > 0 THEN CAST(floor(shard_size * blocks / CAST(sum(shard_size) OVER w AS DOUBLE) + 0.5) AS BIGINT) ELSE 0 END AS r
  FROM h0 WINDOW w AS (PARTITION BY source, part)
), h2 AS (
  SELECT *, CASE WHEN sum(shard_size) OVER w > 0 THEN CAST(blocks - sum(r) OVER w AS BIGINT) ELSE 0 END AS more FROM h1 WINDOW w AS (PARTITION BY source, part)
), j1 AS (
  SELECT source, part, shard, shard_size, more, unnest(CASE WHEN more > 0 THEN range(r, r + more) WHEN more < 0 THEN range(greatest(r + more, 0), r) ELSE [] END) AS k FROM h2
), j2 AS (
  SELECT *, CASE WHEN more > 0 THEN row_number() OVER (PARTITION BY source, part ORDER BY shard_size / CAST(2 * k + 1 AS DOUBLE) DESC, shard, k)
                 ELSE row_number() OVER (PARTITION BY source, part ORDER BY shard_size / CAST(2 * k + 1 AS DOUBLE), shard DESC, k DESC) END AS place FROM j1
), j3 AS (SELECT source, shard, sum(sign(more)) AS moved FROM j2 WHERE place <= abs(more) GROUP BY ALL),
w AS (
  SELECT h2.source, h2.shard, h2.shard_size AS len, CAST(least((h2.r + coalesce(j3.moved, 0)) * {BLOCK_WORDS}, h2.shard_size * {MAX_REPEATS}) AS BIGINT) AS words,
         CAST('0x' || substr(md5('{SEED}-block-' || coalesce(h2.source, 'null') || '-' || h2.shard), 1, 7) AS BIGINT) AS seeded
  FROM h2 LEFT JOIN j3 ON h2.source IS NOT DISTINCT FROM j3.source AND h2.shard = j3.shard
), sh AS (
  SELECT source, shard, len, words // len AS rounds, (words % len + {BLOCK_WORDS // 2}) // {BLOCK_WORDS} AS m, (len + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS nb,
         seeded % ((len + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}) AS f
  FROM w WHERE len > 0
), e AS (
  SELECT p.*, sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS e FROM p
)
SELECT e.doc_id, e.size, e.source_size, e.target,
       CAST(CASE WHEN len > 0 THEN rounds * size + greatest(least(e, least(f + m, nb) * {BLOCK_WORDS}) - greatest(e - size, f * {BLOCK_WORDS}), 0)
                                 + greatest(least(e, greatest(f + m - nb, 0) * {BLOCK_WORDS}) - (e - size), 0) ELSE 0 END AS BIGINT) AS taken
FROM e LEFT JOIN sh ON e.source IS NOT DISTINCT FROM sh.source AND e.shard = sh.shard
"""
