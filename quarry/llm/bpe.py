"""Byte-level BPE by replaying merges over the words of the whole corpus.

Texts are cut into words by the tokenizer's pattern. Every task counts its
words, the counts of the corpus are added up, and the merges are replayed once
over the table of its most frequent words, part by part: the words of a part
lie one after the other, and an inverted index leads from each token that two
neighbours would merge into to the positions where such a pair stands. Merges
are applied in rank order; each touches only its two neighbours, whose new pairs
enter the index. The table of words and ids has a bounded size (TABLE_WORDS of
at most WORD_BYTES each) and is sent to the executors, where texts are looked up;
words that are not in it, the rare ones, are replayed in the same way where they
stand, a run of texts at a time. Words are independent of each other, so ids
do not depend on which words the table holds.

Defined results: a null text counts as empty; an empty text has no ids; a text
of any length is cut and encoded whole; repeated rows give repeated results;
other columns pass through, except those named like a result column; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, durable, extended, replacing, slices, small_batches, tidy

#: Words of the table that is sent out, and bytes of one of them: 64 MB with their ids at the very most.
TABLE_WORDS, WORD_BYTES = 200_000, 64
#: Words that a task counts before it hands the counts on.
COUNTED = 200_000
#: Bytes of text (or one longer text) whose words are held at once, each distinct one once; and rows of such a run.
RUN_BYTES, RUN_ROWS = 2 << 20, 1 << 14


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a .tiktoken file: base64 of a token's bytes, blank, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class MergeReplay:
    """Encodes lists of words by replaying all merges in rank order over an inverted index.

    The work on one rank is done for all its positions at once. A merge may
    bring up a pair of a lower rank, which then has to go first in that word;
    tokens that can do so are known beforehand, and of theirs no position of a
    word is merged after one that does, before the lower rank has had its turn.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        #: All pairs of tokens that make a token: the pair as one number, in order, and what they make.
        self.shift = max(self.token) + 2  # one more than any id: stands for no neighbour
        undercuts = np.zeros(self.shift, bool)
        pairs = []
        for token, made in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.shift + right, made))
                    undercuts[left] |= made < left
                    undercuts[right] |= made < right
        self.undercuts = undercuts.tolist()
        self.keys, self.made = (np.array(x) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.array([-1]), np.array([-1]))

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What neighbours merge into, or -1."""
        key = left * self.shift + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _in_order(self, rank: int, places: np.ndarray, ids: np.ndarray, after: np.ndarray, before: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which merges may be made now: in each word those up to the first that brings up a lower rank."""
        gone = after[places]
        left, right = before[places], after[gone]
        merged = gone[np.minimum(np.searchsorted(gone, left), len(gone) - 1)] == left  # the merge before it takes the left neighbour
        made = np.stack([self.merge_of(np.where(merged, rank, ids[left]), np.full(len(places), rank)), self.merge_of(np.full(len(places), rank), ids[right])])
        stops = ((made >= 0) & (made < rank)).any(0)
        before_it = np.cumsum(stops) - stops
        word = np.flatnonzero(np.append(True, owner[places[1:]] != owner[places[:-1]]))
        return before_it == np.repeat(before_it[word], np.diff(np.append(word, len(places))))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        whole = [self.ranks.get(w, -1) for w in words]
        split = [n for n, (w, r) in enumerate(zip(words, whole, strict=True)) if r < 0 and w]
        out = [r.to_bytes(4, "little") if r >= 0 else b"" for r in whole]
        if not split:
            return out
        # The words to split, laid out one after the other; the last place stands for no neighbour.
        data = np.frombuffer(b"".join([words[n] for n in split]), np.uint8)
        lengths = np.array([len(words[n]) for n in split])
        ends, none = np.cumsum(lengths), len(data)
        owner = np.repeat(np.arange(len(split)), lengths)
        ids = np.append(self.byte_ids[data], self.shift - 1)
        after, before = np.arange(1, none + 2), np.arange(-1, none)
        after[ends - 1] = after[none] = before[ends - lengths] = none
        # pending[p]: what the token at p and its right neighbour merge into now.
        pending = self.merge_of(ids, ids[after])
        alive = np.ones(none, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(places: np.ndarray) -> None:
            made = pending[places]
            places, made = places[made >= 0], made[made >= 0]
            if not len(places):
                return
            order = np.argsort(made, kind="stable")
            places, made = places[order], made[order]
            cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
            for rank, part in zip(made[np.append(0, cuts)].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        file(np.arange(none))
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            places = parts[0] if len(parts) == 1 else np.concatenate(parts)
            places = np.unique(places[pending[places] == rank])
            if not len(places):
                continue
            if len(places) > 1:
                # Of pairs that overlap in a row the first, the third and so on are merged.
                row = np.flatnonzero(np.append(True, places[1:] != after[places[:-1]]))
                nth = np.arange(len(places)) - np.repeat(row, np.diff(np.append(row, len(places))))
                now = nth % 2 == 0
                if self.undercuts[rank]:
                    now[now] = self._in_order(rank, places[now], ids, after, before, owner)
                    left_over = places[~now & ~np.isin(places, after[places[now]])]
                    if len(left_over):
                        index[rank] = [left_over]
                        heapq.heappush(heap, rank)
                places = places[now]
            gone = after[places]
            right = after[gone]
            ids[places], pending[gone], alive[gone] = rank, -1, False
            after[places] = right
            before[right] = places
            left = before[places]
            touched = np.concatenate([places, left[left != none]])
            pending[touched] = self.merge_of(ids[touched], ids[after[touched]])
            file(touched)
        kept = np.flatnonzero(alive)
        raw, last = ids[kept].astype("<u4").tobytes(), np.cumsum(np.bincount(owner[kept], minlength=len(split))) * 4
        for n, a, b in zip(split, [0, *last[:-1].tolist()], last.tolist(), strict=True):
            out[n] = raw[a:b]
        return out


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.cut = regex.compile(pattern)
        self.replay = MergeReplay(load_ranks(lines))

    def words(self, text: str) -> Iterator[list[str]]:
        if len(text) <= RUN_BYTES:
            yield self.cut.findall(text)
            return
        found = (m.group() for m in self.cut.finditer(text))
        while run := list(itertools.islice(found, RUN_BYTES // 4)):
            yield run

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from one replay over all of them."""
        return self.replay.encode_words([w.encode() for w in words])

    def encode_all(self, texts: list[str], table: dict[str, bytes] | None = None) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers. Words of the table are looked up, the others replayed together."""
        if sum(map(len, texts)) <= RUN_BYTES:
            number: dict[str, int] = {}  # texts become the numbers of their words: a word is held once, however often it stands there
            coded = [array("I", [number.setdefault(w, len(number)) for w in self.cut.findall(t)]) for t in texts]
            known = self._known(list(number), table or {})
            for codes in coded:
                yield b"".join([known[c] for c in codes])
            return
        for text in texts:
            parts = []
            for words in self.words(text):
                number = {w: n for n, w in enumerate(dict.fromkeys(words))}
                known = self._known(list(number), table or {})
                parts.append(b"".join([known[number[w]] for w in words]))
            yield b"".join(parts)

    def _known(self, words: list[str], table: dict[str, bytes]) -> list[bytes]:
        """The ids of each of these words."""
        known = [table.get(w) for w in words]
        rest = [n for n, ids in enumerate(known) if ids is None]
        for n, ids in zip(rest, self.ids_of([words[n] for n in rest]), strict=True):
            known[n] = ids
        return known

    def decode(self, ids: bytes) -> bytes:
        token = self.replay.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(1)
def _codec(lines: bytes, pattern: str) -> Codec:
    """A worker process keeps the merges from one task to the next, and no words."""
    return Codec(lines, pattern)


def _sharing(spark, path: str, pattern: str) -> Callable[[], Codec]:
    """A function that gives the codec in a Python worker; the file (under 1 MB) is sent once."""
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    return lambda: _codec(sent.value, pattern)


def word_counts(texts: DataFrame, codec: Callable[[], Codec]) -> DataFrame:
    """word and how often it stands in the texts (one column) of all documents; words that are a token of their own are left out."""

    @tidy
    def run(batches):
        coder = codec()
        cut, ranks = coder.words, coder.replay.ranks
        counts: Counter[str] = Counter()

        def told():
            rows = [(w, n) for w, n in counts.items() if len(e := w.encode()) <= WORD_BYTES and e not in ranks]
            for at in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + (1 << 14)]], t) for i, t in enumerate((pa.string(), pa.int64()))], ["word", "n"])
            counts.clear()

        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                for words in cut(text or ""):
                    counts.update(words)
            if len(counts) > COUNTED:
                yield from told()
        yield from told()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def replayed(words: DataFrame, codec: Callable[[], Codec]) -> DataFrame:
    """word and ids (binary) of a table of words: the merges are replayed over each part of it at once."""

    @tidy
    def run(batches):
        coder = codec()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.ids_of(batch.column(0).to_pylist()), pa.binary())], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids binary")


def _table(df: DataFrame, text: str, codec: Callable[[], Codec]):
    """The broadcast table of the corpus's most frequent words and their ids."""
    counted = durable(word_counts(df.select(F.col(text).cast("string")), codec).withColumn("class", F.floor(F.log2("n") * 16).cast("int")), "bpe-words")
    # A histogram of the counts (under 1,100 classes) says from which on the words fit; of the class on the border a share by hash.
    room, border, share = TABLE_WORDS, -1, 0.0
    for r in counted.groupBy("class").count().orderBy(F.col("class").desc()).collect():
        if r["count"] > room:
            border, share = r["class"], 0.9 * room / r["count"]
            break
        room -= r["count"]
    chosen = counted.where((F.col("class") > border) | ((F.col("class") == border) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))))
    made = durable(replayed(chosen.repartition(F.xxhash64("word")), codec), "bpe-table")
    rows = made.toArrow()
    sent = df.sparkSession.sparkContext.broadcast((rows.column("word").to_pylist(), rows.column("ids").to_pylist()))
    discard(counted)
    discard(made)
    return sent


def _encoder(df: DataFrame, path: str, pattern: str, text: str):
    """A function that gives, in a Python worker, the codec and the table of words."""
    small_batches(df.sparkSession)
    codec = _sharing(df.sparkSession, path, pattern)
    sent = _table(df, text, codec)
    return lambda: (codec(), dict(zip(*sent.value, strict=True)))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with ids (array<int>) and n_tokens (long): its texts encoded by the ranks in the file at path."""
    rest = replacing(df, ["ids", "n_tokens"])
    encoder, at = _encoder(rest, path, pattern, text), rest.columns.index(text)
    schema = extended(rest, ids="array<int>", n_tokens="bigint")

    @tidy
    def run(batches):
        coder, table = encoder()
        for batch in slices(batches, at, RUN_BYTES, RUN_ROWS):
            yield _with_ids(batch, list(coder.encode_all([t or "" for t in batch.column(at).to_pylist()], table)))

    return rest.mapInArrow(run, schema)


def _with_ids(batch: pa.RecordBatch, coded: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(coded), "<i4")
    counts = np.array([len(c) // 4 for c in coded], np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array(counts)]
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "ids", "n_tokens"])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary): the bytes its id lists stand for; null ids count as none."""
    small_batches(df.sparkSession)
    codec = _sharing(df.sparkSession, path, pattern)
    rest = replacing(df, ["decoded"])
    schema, at = extended(rest, decoded="binary"), rest.columns.index(ids)

    @tidy
    def run(batches):
        coder = codec()
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                made = [coder.decode(np.asarray(r.values.to_numpy(zero_copy_only=False), "<u4").tobytes()) if r.is_valid else b"" for r in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], schema.names)

    return rest.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""
    import hashlib

    rows = df.select(F.col("doc_id").cast("bigint"), "text")
    encoder = _encoder(rows, path, pattern, "text")

    @tidy
    def run(batches):
        coder, table = encoder()
        for batch in slices(batches, 1, RUN_BYTES, RUN_ROWS):
            out = []
            for ids in coder.encode_all([t or "" for t in batch.column(1).to_pylist()], table):
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            n, a, b = map(list, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
