r"""Line deduplication with levelled sorted runs of line hashes.

A line's key is a 128-bit hash of the line, stripped of ``[\x20\x09-\x0D]`` at both ends and with A-Z lower-cased. Runs hold
(key, n_docs, last_doc), sorted and bucketed by key, and each key stands in one run only: a new batch is merge-joined
against the runs, and the keys that an anti-join finds in none are the batch's own run, added at level 0. What the batch
says of keys that the runs hold goes to a list of sightings beside it. When a level has ``fanout`` runs they are merged
into one run of the next level, and so are their sightings. A run's name states the batches it covers, and a run covered
by a higher one is ignored, so a job lost between writing a merged run and deleting its parts leaves a right index.

``dedup_lines`` drops lines by what all batches say: keys of at least ``min_chars`` code points in at least ``min_docs``
documents lose all their lines except in the largest doc_id that holds them. Texts are cut and hashed once; their keys
are written with document and place, and the counts, the runs and the lines to drop all come from that table.
``drop_seen_lines`` is the incremental form: it drops the lines of a batch whose keys earlier batches hold.

Defined results: a null or empty text is one empty line; documents are rows, so repeated rows count one by one and
every row with the largest doc_id keeps its lines; a null doc_id is smaller than any other, and lines that only such rows
hold stay; a very long text, or line, is cut and hashed whole; extra columns pass through, but those with the names of
the results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm.textscan import BLANK, LOWER, buffers, pieces, span_hashes
from ionframe.storage import Scratch, new_path, partitions, remove, table

UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS, FANOUT, BATCHES = 20, 3, 4, 4
RUN = "key string, n_docs bigint, last_doc bigint"
KEYS = "batch int, doc_id long, th long, pos int, first boolean, key string"


def line_keys(column: pa.Array, min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(row, place, whether its row has the key for the first time, key) of the lines with a key, piece by piece of a batch."""
    data, offsets = buffers(column.cast(pa.large_string()))
    for a, b in pieces(offsets):
        bounds = offsets[a : b + 1]
        low, high = int(bounds[0]), int(bounds[-1])
        own = data[low:high]
        feeds = np.flatnonzero(own == 0x0A) + low
        # a line begins at each row's beginning and after each line feed; it ends at the next feed or the row's end
        starts = np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([bounds[1:], feeds]), kind="stable")
        row = np.repeat(np.arange(b - a), 1 + np.diff(np.searchsorted(feeds, bounds)))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        black = np.flatnonzero(~BLANK[own]) + low
        i, j = np.searchsorted(black, starts), np.searchsorted(black, ends) - 1
        some = np.flatnonzero(i <= j)
        starts, ends = black[i[some]], black[j[some]] + 1
        points = np.r_[0, np.cumsum((own & 0xC0) != 0x80)]
        long = points[ends - low] - points[starts - low] >= min_chars
        some, starts, ends = some[long], starts[long], ends[long]
        key = np.stack([span_hashes(data, starts, ends, LOWER, seed) for seed in (1, 2)], axis=1)
        by = np.lexsort((place[some], key[:, 1], key[:, 0], row[some]))
        same = np.zeros(len(by), dtype=bool)
        same[1:] = (np.diff(row[some][by]) == 0) & (key[by][1:] == key[by][:-1]).all(axis=1)
        first = np.ones(len(some), dtype=bool)
        first[by[same]] = False
        names = pa.StringArray.from_buffers(len(some), pa.py_buffer(np.arange(len(some) + 1, dtype=np.int32) * 32), pa.py_buffer(key.tobytes().hex().encode()))
        yield row[some] + a, place[some], first, names


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, first, names in line_keys(batch.column("text"), min_chars):
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in ("batch", "doc_id", "th")], pa.array(place, pa.int32()), pa.array(first), names], names=["batch", "doc_id", "th", "pos", "first", "key"])

    return run


def occurrences(docs: DataFrame, min_chars: int, batches: int = 1) -> DataFrame:
    """(batch, doc_id, th, pos, first, key) of every line with a key in (doc_id, text)."""
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    rows = docs.select(batch.alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(_keys(min_chars), KEYS)


def line_stats(found: DataFrame) -> DataFrame:
    """(key, n_docs, last_doc) of occurrences: per document each key counts once."""
    return found.where("first").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


class LineRuns:
    """The runs under ``path``; opened again by giving the path of an earlier one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.tables: dict[str, str] = {}
        for name in self._listed():
            self._register(name)

    def _listed(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        at = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("run-") and fs.exists(at(n)))

    def _register(self, name: str) -> None:
        self.tables[name] = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self.tables[name]} ({RUN}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    @staticmethod
    def _parts(name: str) -> tuple[int, int, int]:
        level, first, last = name.split("-")[1:]
        return int(level), int(first), int(last)

    def runs(self) -> list[str]:
        """Names of the runs that count, oldest first."""
        parts = {n: self._parts(n) for n in self.tables}
        covered = {a for a, x in parts.items() for y in parts.values() if y[0] > x[0] and y[1] <= x[1] and x[2] <= y[2]}
        return sorted((n for n in parts if n not in covered), key=lambda n: parts[n][1])

    def _write(self, new: DataFrame, seen: DataFrame, name: str) -> None:
        """A run with its sightings; the run's own mark of success, written last, makes both count."""
        seen.select("key", "n_docs", "last_doc").write.mode("overwrite").parquet(f"{self.path}/seen-{name}")
        self._register(name)
        new.select("key", "n_docs", "last_doc").repartition(self.buckets, "key").sortWithinPartitions("key").write.insertInto(self.tables[name])

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key no run holds: one merge anti-join per run."""
        for name in self.runs():
            keys = keys.join(self.spark.table(self.tables[name]).hint("merge"), "key", "left_anti")
        return keys

    def seen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key a run holds."""
        names = self.runs()
        return keys.join(self._files(names).select("key").hint("merge"), "key", "left_semi") if names else keys.limit(0)

    def _files(self, names: list[str], prefix: str = "") -> DataFrame:
        """The rows of some runs (or of their sightings), read together as plain files."""
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/{prefix}{n}" for n in names])

    def append(self, batch: DataFrame) -> None:
        """Adds (key, n_docs, last_doc), one row per key, as one more batch: new keys as its run, the others as sightings."""
        number = 1 + max((self._parts(n)[2] for n in self.tables), default=-1)
        self._write(self.unseen(batch), self.seen(batch), f"run-0-{number:06d}-{number:06d}")
        self._compact()

    def _compact(self) -> None:
        level = 0
        while True:
            at = [n for n in self.runs() if self._parts(n)[0] == level]
            if len(at) < self.fanout:
                if not any(self._parts(n)[0] > level for n in self.runs()):
                    return
                level += 1
                continue
            self._write(self._files(at), _summed(self._files(at, "seen-")), f"run-{level + 1}-{self._parts(at[0])[1]:06d}-{self._parts(at[-1])[2]:06d}")
            for n in at:
                self.spark.sql(f"DROP TABLE {self.tables.pop(n)}")
                remove(self.spark, f"{self.path}/{n}", f"{self.path}/seen-{n}")
            level += 1

    def totals(self) -> DataFrame:
        """(key, n_docs, last_doc) over all batches: each run's row with what later batches add to it."""
        names = self.runs()
        more = _summed(self._files(names, "seen-")).select(F.col("key").alias("_key"), F.col("n_docs").alias("_n"), F.col("last_doc").alias("_last"))
        return self._files(names).join(more.hint("merge"), F.col("key") == F.col("_key"), "left").select("key", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "_last").alias("last_doc"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def _without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_lines, n_dropped and kept_text, given the lines (doc_id, th, pos) to drop."""
    per_doc = drops.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("whole"))
    found = rows.join(per_doc.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th")), "left")
    lines, n_lines = F.split("whole", "\n"), (F.octet_length("whole") - F.octet_length(F.replace("whole", F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop")), lambda i: F.get(lines, i)), "\n")
    new = {"n_lines": n_lines, "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long"), "kept_text": F.when(F.col("drop").isNull(), F.col("whole")).otherwise(kept)}
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, runs: LineRuns | None = None, batches: int = BATCHES) -> DataFrame:
    """The columns of ``docs`` with n_lines, n_dropped and kept_text. The table enters the runs in ``batches`` parts."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    runs = runs or LineRuns(spark, new_path(spark, "line-runs"), partitions(spark))
    staged = new_path(spark, "line-keys")
    occurrences(docs, min_chars, batches).write.partitionBy("batch").parquet(staged)
    lines = spark.read.schema(", ".join([*KEYS.split(", ")[1:], "batch int"])).parquet(staged)
    for b in range(batches):
        stats = scratch.table(line_stats(lines.where(F.col("batch") == b)), "line-stats")
        runs.append(stats)
    scratch.drop("line-stats")
    # written first, so that both sides of the join are plain shuffles and Spark can split a line of many documents
    repeated = scratch.table(runs.totals().where((F.col("n_docs") >= min_docs) & F.col("last_doc").isNotNull()).select("key", "last_doc"), "repeated-lines")
    drops = lines.join(repeated.hint("merge"), "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    drops = scratch.table(drops.select("doc_id", "th", "pos"), "line-drops")
    scratch.drop("repeated-lines")
    remove(spark, staged)
    return _without(docs, drops)


def drop_seen_lines(docs: DataFrame, runs: LineRuns, min_chars: int = MIN_CHARS) -> DataFrame:
    """Drops the lines of this batch that earlier batches hold, then adds the batch to the runs."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.table(occurrences(docs, min_chars), "line-keys")
    drops = scratch.table(runs.seen(lines).select("doc_id", "th", "pos"), "line-drops")
    runs.append(line_stats(lines))
    scratch.drop("line-keys")
    return _without(docs, drops)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{UPPER_CASE}', '{LOWER_CASE}') AS key FROM l
), g AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), x AS (
  SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND g.last_doc <> k.doc_id AS dropped FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
