"""SentencePiece against the library; WARC round trips."""

import hashlib
import random
import time
import zlib

import pyarrow as pa
import pytest
import sentencepiece

from ionframe.llm import sentencepiece_codec as S
from ionframe.llm import warc
from ionframe.storage import materialise, new_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


def texts():
    rng = random.Random(4)
    alphabet = "ab eEé\n\t ▁ñ漢🙂\x00 .,1 2'\"!-_²"
    fixed = ["", " ", "  ", "a  b", " a", "▁x", "Ａ ﬁ\u00a0\t x\x00y", "\n", "\n a", "a ", "a.b , c", "don't stop... now!", "x" * 3000, "the end. " * 4000]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]


def test_codec_is_the_library(library):
    codec = S.Codec(S.default_model())
    for t, (n, csv, back) in zip(texts(), codec.rows(pa.array(texts())), strict=True):
        ids = library.encode(t)
        assert n == len(ids) and [int(x) for x in bytes(csv).split(b",")[:-1]] == ids, t
        assert bytes(back).decode("utf-8", "replace") == library.decode(ids), t


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w[:n]


def same_as_library(library, some):
    for t, (n, csv, back) in zip(some, S.Codec(S.default_model()).rows(pa.array(some)), strict=True):
        ids = library.encode(t)
        assert n == len(ids) and [int(x) for x in bytes(csv).split(b",")[:-1]] == ids, t[:80]
        assert bytes(back).decode("utf-8", "replace") == library.decode(ids), t[:80]


def test_regular_words_keep_their_own_ids(library):
    swap = str.maketrans("ab", "ba")
    same_as_library(library, [t for n in (64, 1024, 2048, 4096) for t in (thue_morse(n), thue_morse(n).translate(swap))])


def test_parts_of_one_hash_keep_their_own_ids(library, monkeypatch):
    real = S.span_hashes
    monkeypatch.setattr(S, "span_hashes", lambda *a: real(*a) % 5)
    same_as_library(library, texts()[:400])


@pytest.mark.parametrize("long", [0, 4, 10_000])
def test_both_kinds_of_rounds(library, monkeypatch, long):
    monkeypatch.setattr(S, "LONG", long)
    rng = random.Random(9)
    runs = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for letters in ("a", "ab", "the ", "aeiouth", "x0=/", "èé漢🙂a") for _ in range(25)]
    same_as_library(library, runs + texts()[:300])


def test_a_megabyte_without_spaces(library):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    word = "".join(rng.choices(letters, k=1_000_000))
    codec = S.Codec(S.default_model())
    began = time.perf_counter()
    ((n, csv, _),) = codec.rows(pa.array([word]))
    assert time.perf_counter() - began < 30
    assert [int(x) for x in bytes(csv).split(b",")[:-1]] == library.encode(word) and n > 100_000


def test_cache_bound(monkeypatch):
    monkeypatch.setattr(S, "CACHE_WORDS", 40)
    small, large = S.Codec(S.default_model()), S.Codec(S.default_model())
    batch = pa.array(texts()[:200])
    for i in range(0, 200, 10):
        part = batch.slice(i, 10)
        assert [bytes(x[1]) for x in small.rows(part)] == [bytes(x[1]) for x in large.rows(part)]


def test_codec_query(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x\ny")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    found = sorted(map(tuple, S.encode_digests(frame).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert found == sorted(want, key=str)
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in S.encode(frame).collect()} == {(i, tuple(library.encode(t or "")), t or "") for i, t in rows}
    assert S.encode_digests(frame.limit(0)).count() == 0


def pages():
    inner = b"".join(warc.record(90 + i, "http://inner/", b"inside %d" % i, hashlib.sha1(b"").hexdigest(), None, False) for i in range(3))
    html = ["<p>one</p>", "", None, "<p>one</p>", "x\r\n\r\ny", "é" * 50_000, "WARC/1.1 \x1f\x08", inner.decode("latin-1"), "<p>one</p>", ""]
    return [(i, f"http://h/{i}\r\nX: y" if i == 4 else None if i == 5 else f"http://h/{i}", h) for i, h in enumerate(html)] + [(9, "http://h/9", "")]


@pytest.mark.parametrize("split,least", [(37, 0), (1000, 0), (1 << 20, 0), (300, 5)])
def test_warc_round_trip(spark, split, least):
    frame = spark.createDataFrame([(*p, "x") for p in pages()], "page_id long, url string, html string, sha string")
    manifest = warc.write_archives(frame, new_path(spark, "warc"), least)
    records = materialise(warc.read_archives(manifest, split, whole=True), "records")
    found = sorted((tuple(r) for r in warc.resolved(records).collect()), key=str)
    want = []
    for i, _, h in pages():
        data = (h or "").encode()
        same = [j for j, _, g in pages() if (g or "").encode() == data]
        revisit = len(data) >= least and i != max(same)
        want.append((i, len(data), warc.base32(hashlib.sha1(data).hexdigest()), "revisit" if revisit else "response", max(same) if revisit else None))
    assert found == sorted(want, key=str)
    assert {bytes(r.payload) for r in records.where("record_type = 'response'").collect()} == {(h or "").encode() for _, _, h in pages()}


def test_warc_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_archives(frame, new_path(spark, "warc"))
    assert manifest.count() == 0 and warc.resolved(warc.read_archives(manifest)).count() == 0


def test_embedded_archive_is_no_record(spark, tmp_path):
    """A stored (not deflated) member with a whole archive in its payload: its records are not the file's."""
    inner = b"".join(warc.record(70 + i, "http://inner/", b"inside", hashlib.sha1(b"").hexdigest(), None, False) for i in range(4))
    body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n" % (len(warc.HTTP) + len(inner)) + warc.HTTP + inner + b"\r\n\r\n"
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    file = tmp_path / "a.warc.gz"
    file.write_bytes(stored.compress(body) + stored.flush() + warc.record(2, "", b"two", hashlib.sha1(b"two").hexdigest(), None, False))
    manifest = spark.createDataFrame([(f"file://{file}", file.stat().st_size)], "file string, bytes long")
    for step in (20, 111, 1 << 20):
        assert sorted(r.page_id for r in warc.read_archives(manifest, step).collect()) == [1, 2], step
