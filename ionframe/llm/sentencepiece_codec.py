"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read with the library (pieces, scores and kinds only); encoding and decoding are done here.

A text, with a space put before it and spaces written as U+2581, is cut where no piece of the vocabulary can span: before
a space that follows another character, around line feeds, and before punctuation that no piece has after an ASCII
letter or digit (derived from the vocabulary when the model is opened). Cutting and hashing the parts runs over the bytes
of a whole Arrow batch. The distinct parts of a batch are encoded together: one flat array of symbols, and in each round
the pairs of the smallest rank in each word, leftmost first and none overlapping, are merged in all words at once and the
array compacted, until no pair is left. A merge can make a pair that does not rank after it, which would then go before the
word's other pairs of the rank; so of several in a word those after the first such merge wait. Parts of more than ``LONG`` symbols would need a round for each rank over their whole length: they stay in place, linked by arrays of
neighbours, and a round touches only the pairs of its rank. Characters outside the vocabulary become byte pieces. A text
is then the sum of its parts: their ids and the bytes they decode to, gathered from a cache of bounded size in the Python
worker. A part is found there by hash and confirmed by its bytes, so parts with one hash never share ids.

Defined results: a null text is an empty text and gives no ids; a very long text, and a very long word, is encoded whole;
repeated rows are encoded alike; of equal ranks the leftmost pair goes first; extra columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ionframe.llm.textscan import buffers, pieces, span_hashes
from ionframe.storage import table

SPACE = "▁"
#: Punctuation before which a text may be cut.
PUNCTUATION = ".,;:!?|*#%&)]}\"'/"
ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
CACHE_WORDS, CHUNK_WORDS, ROWS = 400_000, 20_000, 4096
#: Symbols of a part beyond which its rounds go by rank over linked places; bytes of the cache after which it starts anew.
LONG, CACHE_BYTES = 256, 1 << 28


NEVER = np.iinfo(np.int64).max  # the rank of a pair that is no piece


def _every_other(joined: np.ndarray) -> np.ndarray:
    """Of places in order, where ``joined`` says that a place's pair overlaps the one before: the first, third.. of each chain."""
    place = np.arange(len(joined))
    head = np.maximum.accumulate(np.where(joined, 0, place))
    return (place - head) % 2 == 0


class PieceModel:
    """Vocabulary tables: symbols are pieces, then single characters that occur in pieces without being one."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i in range(size):
            if lib.is_byte(i):
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.unknown = lib.unk_id()
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", self.pieces[i]) for i in normal):
            raise ValueError("a piece of this model spans a word boundary")
        self.symbol: dict[str, int] = {self.pieces[i]: i for i in normal}
        for i in normal:
            for ch in self.pieces[i]:
                self.symbol.setdefault(ch, size + len(self.symbol))
        self.size = size
        self.base = size + len(self.symbol) + len(normal)  # symbols from here on are other characters
        lefts, rights, ranks, merged = [], [], [], []
        order = {i: r for r, i in enumerate(sorted(normal, key=lambda i: (-lib.get_score(i), i)))}
        for i in normal:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    lefts.append(a)
                    rights.append(b)
                    ranks.append(order[i])
                    merged.append(i)
        keys = np.array(lefts, dtype=np.int64) * self.base + np.array(rights, dtype=np.int64)
        by_key = np.argsort(keys)
        self.keys = keys[by_key]
        self.ranks = np.array(ranks, dtype=np.int64)[by_key]
        self.merged = np.array(merged, dtype=np.int64)[by_key]
        chars = {ord(c): s for c, s in self.symbol.items() if len(c) == 1}
        self.char_symbol = np.full(0x110000, -1, dtype=np.int32)
        self.char_symbol[list(chars)] = list(chars.values())
        self.decoded = [self._bytes(lib, i) for i in range(size)]
        self.csv = [b"%d," % i for i in range(size)]
        self.csv_len, self.decoded_len = (np.array([len(b) for b in x], dtype=np.int64) for x in (self.csv, self.decoded))
        self.free = self._free([self.pieces[i] for i in normal])

    @staticmethod
    def _free(pieces: list[str]) -> np.ndarray:
        """Which bytes are punctuation that no piece has after an ASCII letter or digit."""
        after = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a.isascii() and a.isalnum()}
        free = np.zeros(256, dtype=bool)
        free[[ord(c) for c in PUNCTUATION if c not in after]] = True
        return free

    def cuts(self, data: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
        """Where the parts of rows begin, each row beginning with its space; parts tile the bytes."""
        begin = np.zeros(len(data), dtype=bool)
        if len(data) > 1:
            space, feed = data == 0x20, data == 0x0A
            begin[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1] | (self.free[data[1:]] & ALNUM[data[:-1]])
        begin[row_starts[row_starts < len(data)]] = True
        return np.flatnonzero(begin)

    def _bytes(self, lib, i: int) -> bytes:
        if lib.is_byte(i):
            return bytes([int(self.pieces[i][1:-1], 16)])
        if lib.is_control(i):
            return b""
        return " ⁇ ".encode() if lib.is_unknown(i) else self.pieces[i].replace(SPACE, " ").encode()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; a pair that is no piece has the largest rank."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], np.iinfo(np.int64).max), self.merged[at]

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each word's ids) for words with spaces written as U+2581."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        symbols = self.char_symbol[points].astype(np.int64)
        other = symbols < 0
        symbols[other] = self.base - 1  # pairs with it are in no table
        plain = np.where(other, points, 0)
        word = np.repeat(np.arange(len(texts)), lengths)
        short = (lengths <= LONG)[word]
        done = self._rounds(word[short], symbols[short], plain[short])
        if not short.all():
            done.append(self._rounds_by_rank(word[~short], symbols[~short], plain[~short]))
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        word, symbols, plain = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbols, plain = word[order], symbols[order], plain[order]
        return self._with_bytes(word, symbols, plain, len(texts))

    def _pairs(self, word: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each symbol with the next one of its word."""
        rank, merged = np.full(len(symbols), NEVER), np.zeros(len(symbols), dtype=np.int64)
        if len(symbols) > 1:
            rank[:-1], merged[:-1] = self.ranks_of(symbols[:-1], symbols[1:])
            rank[:-1][word[:-1] != word[1:]] = NEVER
        return rank, merged

    def _in_turn(self, at: np.ndarray, left: np.ndarray, joined: np.ndarray, right: np.ndarray, word: np.ndarray, symbols: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Which of a round's merges go now: in each word all up to the first that makes a pair not ranking after it.

        ``left`` and ``right`` are the neighbours' places; where ``joined``, the left one is the product of the merge before.
        """
        n, made = len(symbols), merged[at]
        beside = np.maximum(left, 0)
        before = np.where(joined, np.r_[0, made[:-1]], symbols[beside])
        inside = np.minimum(right, n - 1)
        low = (left >= 0) & (word[beside] == word[at]) & (self.ranks_of(before, made)[0] <= rank[at])
        low |= (right < n) & (word[inside] == word[at]) & (self.ranks_of(made, symbols[inside])[0] <= rank[at])
        count = np.cumsum(low) - low
        first = np.flatnonzero(np.r_[True, word[at][1:] != word[at][:-1]])
        return count == np.repeat(count[first], np.diff(np.r_[first, len(at)]))

    def _rounds(self, word: np.ndarray, symbols: np.ndarray, plain: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge rounds over flat arrays: each word's pairs of its smallest rank, then compaction; words without a pair are done."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, merged = self._pairs(word, symbols)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            counts = np.diff(np.r_[first, len(word)])
            finished = np.repeat(lowest == NEVER, counts)
            if finished.any():
                done.append((word[finished], symbols[finished], plain[finished]))
                live = ~finished
                word, symbols, plain, rank, merged = word[live], symbols[live], plain[live], rank[live], merged[live]
                if not len(symbols):
                    break
                lowest, counts = lowest[lowest != NEVER], counts[lowest != NEVER]
            at = np.flatnonzero(rank == np.repeat(lowest, counts))
            if len(at) > len(counts):
                at = at[_every_other(np.r_[False, at[1:] == at[:-1] + 1])]
                at = at[self._in_turn(at, at - 1, np.r_[False, at[1:] == at[:-1] + 2], at + 2, word, symbols, rank, merged)]
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol went away for each pair before
            word, symbols, plain, rank, merged = word[keep], symbols[keep], plain[keep], rank[keep], merged[keep]
            for left in (at[at > 0] - 1, at):
                last = left + 1 >= len(word)
                beside = np.where(last, left, left + 1)
                rank[left], merged[left] = self.ranks_of(symbols[left], symbols[beside])
                rank[left[last | (word[left] != word[beside])]] = NEVER
        return done

    def _rounds_by_rank(self, word: np.ndarray, symbols: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same rounds for long words: the places of each rank wait under it, and a round takes those of the smallest."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # neighbours; n and -1: none
        alive = np.ones(n, dtype=bool)
        rank, merged = self._pairs(word, symbols)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != NEVER]
            if not len(at):
                return
            order = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
                r = int(rank[order[a]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(order[a:b])

        wait(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                every, at = at, at[_every_other(np.r_[False, at[1:] == after[at[:-1]]])]
                end = after[after[at]]
                turn = self._in_turn(at, before[at], np.r_[False, at[1:] == end[:-1]], end, word, symbols, rank, merged)
                at = at[turn]
                if not turn.all():
                    wait(np.setdiff1d(every, at, assume_unique=True))
            gone = after[at]
            symbols[at] = merged[at]
            alive[gone] = False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            changed = np.unique(np.r_[at, before[at][before[at] >= 0]])
            last = after[changed] >= n
            beside = np.where(last, changed, np.minimum(after[changed], n - 1))
            rank[changed], merged[changed] = self.ranks_of(symbols[changed], symbols[beside])
            rank[changed[last | (word[changed] != word[beside])]] = NEVER
            wait(changed)
        return word[alive], symbols[alive], plain[alive]

    def _with_bytes(self, word: np.ndarray, symbols: np.ndarray, plain: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece as the bytes of their characters."""
        lost = np.flatnonzero(symbols >= self.size)
        if len(lost):
            single = {s: c for c, s in self.symbol.items() if s >= self.size}
            widths = np.ones(len(symbols), dtype=np.int64)
            spelled = [(chr(plain[i]) if plain[i] else single.get(int(symbols[i]), "\0")).encode("utf-8", "replace") for i in lost]
            widths[lost] = [len(b) for b in spelled]
            out = np.repeat(symbols, widths)
            starts = np.cumsum(widths) - widths
            for i, b in zip(lost, spelled, strict=True):
                out[starts[i] : starts[i] + len(b)] = self.byte_ids[np.frombuffer(b, dtype=np.uint8)]
            symbols, word = out, np.repeat(word, widths)
        return symbols, np.searchsorted(word, np.arange(n), side="right")

def _gather(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``blob`` one after another, and where each begins (and the last ends)."""
    at = np.r_[0, np.cumsum(lengths)]
    return blob[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])], at


class Store:
    """Byte strings appended by batches into one growing array."""

    def __init__(self):
        self.blob, self.used = np.zeros(1 << 20, dtype=np.uint8), 0
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def append(self, data: bytes, lengths: np.ndarray) -> None:
        if self.used + len(data) > len(self.blob):
            grown = np.zeros(max(2 * len(self.blob), self.used + len(data)), dtype=np.uint8)
            grown[: self.used] = self.blob[: self.used]
            self.blob = grown
        self.blob[self.used : self.used + len(data)] = np.frombuffer(data, dtype=np.uint8)
        self.starts = np.r_[self.starts, self.used + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.used += len(data)

    def get(self, place: int) -> bytes:
        return self.blob[self.starts[place] : self.starts[place] + self.lengths[place]].tobytes()


class Codec:
    """A model with its cache of encoded parts, found by their 64-bit hash, in one Python worker."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.tokens = np.zeros(0, dtype=np.int64)
        self.raw, self.csv, self.back = Store(), Store(), Store()
        self.twins: dict[bytes, int] = {}  # places of parts whose hash is another part's

    def _places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each part in the cache; parts not seen before are encoded first."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > CACHE_WORDS or self.csv.used > CACHE_BYTES:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            spans = first[new]
            self.place = np.insert(self.place, at[new], len(self.tokens) + np.arange(len(new)))
            self._learn([data[s:e].tobytes() for s, e in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            at = np.searchsorted(self.hashes, distinct)
        found = self.place[at][inverse]
        for i in np.flatnonzero(~self._equal(found, data, starts, ends)):  # another part with this hash came first
            own = data[starts[i] : ends[i]].tobytes()
            if own not in self.twins:
                self.twins[own] = len(self.tokens)
                self._learn([own])
            found[i] = self.twins[own]
        return found

    def _equal(self, place: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the parts, which tile ``data``, have the bytes kept at their places."""
        size = ends - starts
        same = self.raw.lengths[place] == size
        if not same.all():
            return np.array([s and self.raw.get(p) == data[a:b].tobytes() for s, p, a, b in zip(same.tolist(), place.tolist(), starts.tolist(), ends.tolist(), strict=True)], dtype=bool)
        kept, at = _gather(self.raw.blob, self.raw.starts[place], size)
        differ = np.flatnonzero(kept != data)
        same[np.searchsorted(at, differ, side="right") - 1] = False
        return same

    def _learn(self, parts: list[bytes]) -> None:
        for i in range(0, len(parts), CHUNK_WORDS):
            raw = parts[i : i + CHUNK_WORDS]
            self.raw.append(b"".join(raw), np.array([len(x) for x in raw], dtype=np.int64))
            ids, ends = self.model.encode_words([x.decode("utf-8", "replace").replace(" ", SPACE) for x in raw])
            as_list = ids.tolist()
            ends = np.r_[0, ends]
            for store, spelling, width in ((self.csv, self.model.csv, self.model.csv_len), (self.back, self.model.decoded, self.model.decoded_len)):
                store.append(b"".join(map(spelling.__getitem__, as_list)), np.diff(np.r_[0, np.cumsum(width[ids])][ends]))
            self.tokens = np.r_[self.tokens, np.diff(ends)]

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """(number of ids, ids as decimals each followed by a comma, decoded bytes) of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        empty = pc.equal(pc.binary_length(texts), 0)
        texts = pc.binary_join_element_wise(pc.if_else(empty, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), texts, pa.scalar("", pa.large_string()))
        data, offsets = buffers(texts)
        for a, b in pieces(offsets):
            rows = offsets[a : b + 1] - offsets[a]
            part = data[offsets[a] : offsets[b]]
            starts = self.model.cuts(part, rows[:-1])
            ends = np.r_[starts[1:], len(part)][: len(starts)]
            bounds = np.searchsorted(starts, rows)
            place = self._places(span_hashes(part, starts, ends), part, starts, ends)
            tokens = np.r_[0, np.cumsum(self.tokens[place])][bounds].tolist()
            views, cuts = [], []
            for store in (self.csv, self.back):
                out, at = _gather(store.blob, store.starts[place], store.lengths[place])
                views.append(memoryview(out))
                cuts.append(at[bounds].tolist())
            for i in range(b - a):
                back = views[1][cuts[1][i] : cuts[1][i + 1]]
                yield tokens[i + 1] - tokens[i], views[0][cuts[0][i] : cuts[0][i + 1]], back[1:] if len(back) and back[0] == 0x20 else back


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                counts, ids, texts = [], [], []
                for n, csv, back in own.rows(part.column("text")):
                    counts.append(n)
                    ids.append(hashlib.sha256(csv[:-1]).hexdigest())
                    texts.append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, texts = [], []
                for _, csv, back in own.rows(part.column("text")):
                    ids.append([int(x) for x in bytes(csv).split(b",")[:-1]])
                    texts.append(bytes(back).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids themselves and the text they decode to."""
    return _texts(docs).mapInArrow(_tokens(model or default_model()), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; the ids never leave the worker."""
    return _texts(docs).mapInArrow(_digests(model or default_model()), DIGESTS)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
