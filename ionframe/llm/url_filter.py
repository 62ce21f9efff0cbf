"""URL allow and block rules in a sorted digest array.

A rule is a host and a path prefix with a verdict; it fits its host and every subdomain of it when the URL's path starts
with the rule's path. The longest rule (host and path together, then host) wins.

The index is two memory-mapped arrays of sorted 64-bit xxhash keys, one of hosts and one of whole rules, beside the
stored strings. A batch of URLs probes them with vectorised binary search: first the suffixes of every distinct host,
then, for hosts that have rules, the path prefixes of the lengths those rules have. A digest found is confirmed against
the stored string, so a collision never decides. The index travels as files to each executor, where all Python
workers map the same pages; its size is checked against ``max_bytes`` first.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default
verdict; a rule with an empty host fits nothing. Repeated rows are judged alike; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import glob
import hashlib
import os
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.storage import table


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the op2 query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
DEFAULT, MAX_BYTES = "allow", 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)"


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _strings(path: str, values: list[str]) -> None:
    blobs = [v.encode("utf-8", "surrogatepass") for v in values]
    np.save(f"{path}.ends.npy", np.cumsum([len(b) for b in blobs], dtype=np.int64))
    with open(f"{path}.blob", "wb") as f:
        f.write(b"".join(blobs))


def build_index(rules: list[Rule] | tuple[Rule, ...], prefix: str) -> int:
    """Writes the index of ``rules`` as files named ``prefix``...; returns their bytes. Of two rules on one host and path the first counts."""
    unique = {(r.host, r.path): r for r in reversed(rules) if r.host}
    whole = sorted(unique.values(), key=lambda r: (digest(r.host + r.path), r.host, r.path))
    lengths: dict[str, set[int]] = {}
    for r in whole:
        lengths.setdefault(r.host, set()).add(len(r.path))
    hosts = sorted(lengths, key=lambda h: (digest(h), h))
    np.save(f"{prefix}rule_keys.npy", np.array([digest(r.host + r.path) for r in whole], dtype=np.uint64))
    np.save(f"{prefix}rule_host_len.npy", np.array([len(r.host) for r in whole], dtype=np.int32))
    np.save(f"{prefix}rule_block.npy", np.array([r.verdict == "block" for r in whole], dtype=bool))
    np.save(f"{prefix}host_keys.npy", np.array([digest(h) for h in hosts], dtype=np.uint64))
    np.save(f"{prefix}length_ends.npy", np.cumsum([len(lengths[h]) for h in hosts], dtype=np.int64))
    np.save(f"{prefix}lengths.npy", np.array([n for h in hosts for n in sorted(lengths[h])], dtype=np.int32))
    _strings(f"{prefix}rules", [r.host + r.path for r in whole])
    _strings(f"{prefix}hosts", hosts)
    return sum(os.path.getsize(f) for f in glob.glob(glob.escape(prefix) + "*"))


class DigestArray:
    """The mapped index in one Python worker."""

    def __init__(self, prefix: str):
        def mapped(name: str) -> np.ndarray:
            return np.load(f"{prefix}{name}.npy", mmap_mode="r")

        self.rule_keys, self.rule_host_len, self.rule_block = mapped("rule_keys"), mapped("rule_host_len"), mapped("rule_block")
        self.host_keys, self.length_ends, self.lengths = mapped("host_keys"), mapped("length_ends"), mapped("lengths")
        self.ends = {k: mapped(f"{k}.ends") for k in ("rules", "hosts")}
        self.blob = {k: np.memmap(f"{prefix}{k}.blob", dtype=np.uint8, mode="r") if os.path.getsize(f"{prefix}{k}.blob") else np.zeros(0, np.uint8) for k in ("rules", "hosts")}

    def string(self, kind: str, at: int) -> str:
        start = int(self.ends[kind][at - 1]) if at else 0
        return self.blob[kind][start : int(self.ends[kind][at])].tobytes().decode("utf-8", "surrogatepass")

    def find(self, kind: str, texts: list[str]) -> np.ndarray:
        """The place of each text in the sorted array, or -1."""
        keys = self.rule_keys if kind == "rules" else self.host_keys
        probe = np.array([digest(t) for t in texts], dtype=np.uint64)
        at = np.searchsorted(keys, probe)
        found = np.full(len(texts), -1, dtype=np.int64)
        inside = np.flatnonzero(at < len(keys))
        for i in inside[keys[at[inside]] == probe[inside]]:
            j = int(at[i])
            while j < len(keys) and keys[j] == probe[i]:  # equal digests stand side by side
                if self.string(kind, j) == texts[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each URL, or (None, None)."""
        suffixes: dict[str, int] = {}
        chains = {h: [h[i:] for i in range(len(h)) if i == 0 or h[i - 1] == "."] for h in set(hosts) if h}
        for chain in chains.values():
            for s in chain:
                suffixes.setdefault(s, len(suffixes))
        place = self.find("hosts", list(suffixes))
        ruled = {h: [(s, int(place[suffixes[s]])) for s in chain if place[suffixes[s]] >= 0] for h, chain in chains.items()}
        texts: list[str] = []
        owner: list[int] = []
        host_len: list[int] = []
        for row, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            for s, at in ruled.get(h, ()):
                for n in self.lengths[(self.length_ends[at - 1] if at else 0) : self.length_ends[at]]:
                    if n <= len(p):
                        texts.append(s + p[:n])
                        owner.append(row)
                        host_len.append(len(s))
        best: dict[int, tuple[int, int, int]] = {}
        for row, length, at in zip(owner, host_len, self.find("rules", texts) if texts else (), strict=True):
            if at >= 0 and self.rule_host_len[at] == length:
                best[row] = max(best.get(row, (-1, -1, -1)), (int(self.ends["rules"][at] - (self.ends["rules"][at - 1] if at else 0)), length, int(at)))
        return [(self.string("rules", best[i][2]), "block" if self.rule_block[best[i][2]] else "allow") if i in best else (None, None) for i in range(len(hosts))]


def _judge(name: str, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = index.judge(hosts, paths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] or default for f in found], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def filter_urls(pages: DataFrame, rules: list[Rule] | tuple[Rule, ...] = RULES, default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row of (page_id, url): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    name = f"url-rules-{hashlib.sha256(repr(sorted(rules)).encode()).hexdigest()[:16]}-"
    prefix = f"{tempfile.mkdtemp()}/{name}"
    size = build_index(rules, prefix)
    if size > max_bytes:
        raise ValueError(f"the rule index has {size} bytes; at most {max_bytes} are sent to each executor")
    sent = {os.path.basename(f) for f in spark.sparkContext.listFiles}
    for file in sorted(glob.glob(glob.escape(prefix) + "*")):
        if os.path.basename(file) not in sent:  # named by content: a rule set sent once is the same file
            spark.sparkContext.addFile(file)
    host = F.translate(F.regexp_extract("url", URL, 1), UPPER, LOWER)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract("url", URL, 2), F.lit("")).alias("path"))
    return parts.mapInArrow(_judge(name, default), "page_id long, host string, path string, rule string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH r(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), m AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""
