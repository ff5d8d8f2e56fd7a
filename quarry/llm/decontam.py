"""Benchmark decontamination: BM25 over the test items, walked by block-max WAND, then overlap.

The test items are the indexed side; every passage of every training text is a
query. Items are filed by length, each class no more than CLASS times as long as
the one before; for a class, passages are windows of two segments, a segment as
long as its longest item, so each span of an item's length lies whole in some
passage, and a very long item does not make other items' passages long.

An item is retrieved for a passage if its BM25 score reaches SHARE of the score
that the item gets for its own words. Weights are divided by that threshold, so
1 is the threshold for every item. A term's postings lie in order of the items,
in blocks with their largest weight. A passage has a cursor in the postings of
each of its terms. The pivot is the first item at which the largest weights of
the terms whose cursors have come so far add up to 1; if the maxima of the
blocks that hold it do too, its exact score is taken and the cursors go behind
it, else behind the nearest end of those blocks. No item that reaches the
threshold is passed over, and what cannot reach it is never opened. Cursors run
only for terms that are not common; the common ones, which no item owes
REST to, lower what the others have to add up to. The walks of
many passages go step by step at once, as arrays; a passage without a pivot
is done.

A retrieved item counts as leaked if enough of its question (all but its last
sentence) is in the passage as runs of three words, and enough of its answer
(the last sentence) in order; an item of fewer than SHORT words, if all of them
stand in a row. Words are runs of letters and digits, lower case; in scripts
that are written without blanks each code point is a word.

The index is made from the whole item table in parts of bounded size, one pass
for each part; document frequencies are counted over all parts.

Defined results: null and empty texts hold no passage and leak nothing; items
without a word are no evidence; repeated items
are reported once each, repeated rows of documents get the same result; an item
of one sentence is its own question, its last quarter the answer; extra columns
pass through, except one named leaks; empty tables give empty lists.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import durable, extended, replacing, slices, small_batches, tidy

SHARE = 0.5
QUESTION = 0.5
ANSWER = 0.5
SHORT = 5
K1, B = 1.2, 0.75
#: Postings in a block.
BLOCK = 16
#: What common terms may add up to in an item, of the threshold 1.
REST = 0.8
#: Words of the items of the first class, and how many times as long those of the next ones are.
FIRST, CLASS = 64, 4
#: Characters of items in one part of the index.
PART_CHARS = 16 << 20
#: Bytes of text whose passages are walked at once.
RUN_BYTES = 1 << 20
#: Scripts without blanks: Thai and Lao, Myanmar, Khmer, kana, Han.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{ALONE}]+|[{ALONE}]")
SENTENCE = re.compile(r"[.!?]+(?:\s+|$)|[。！？]+\s*")
LEAK = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
EPSILON = 1e-9


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words up to its last sentence, and those of its last sentence."""
    sentences = [w for w in (words_of(s) for s in SENTENCE.split(text)) if w]
    if len(sentences) < 2:
        words = words_of(text)
        return words, words[-max(1, len(words) // 4) :]
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def item_words(items: DataFrame) -> DataFrame:
    """item_id, text and words of the items that have a word, cut as the texts are."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")

    @tidy
    def run(batches):
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["item_id", "text", "words"])

    return rows.mapInArrow(run, "item_id bigint, text string, words array<string>").where(F.size("words") > 0)


class Postings:
    """The postings of the items of one length class, with block maxima."""

    def __init__(self, weights: list[dict[int, float]], size: int, longest: int):
        self.items, self.longest = len(weights), longest
        term = np.array([t for row in weights for t in row], np.int64)
        item = np.repeat(np.arange(self.items), [len(row) for row in weights])
        weight = np.array([w for row in weights for w in row.values()])
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order], weight[order]
        #: A posting's place is found by its term and item in one sorted array.
        self.keys = term * (self.items + 1) + self.item
        counts = np.bincount(term, minlength=size)
        self.ends = np.cumsum(counts)
        starts = self.ends - counts
        self.most = np.zeros(size)
        np.maximum.at(self.most, term, self.weight)
        #: Terms of many items, as long as no item gets REST or more of them together: they only add to what the other terms find.
        self.common, self.rest = np.zeros(size, bool), 0.0
        held = np.zeros(self.items)
        for t in np.argsort(-counts, kind="stable").tolist():
            own = slice(int(starts[t]), int(self.ends[t]))
            more = held[self.item[own]] + self.weight[own]
            if counts[t] < 2 or more.max(initial=0.0) >= REST:
                break
            held[self.item[own]] = more
            self.common[t] = True
        self.rest = float(held.max(initial=0.0))
        # Blocks begin with each term's postings anew.
        first = (np.arange(len(term)) - starts[term]) % BLOCK == 0
        self.block = np.cumsum(first) - 1
        cuts = np.flatnonzero(first)
        self.block_most = np.maximum.reduceat(self.weight, cuts) if len(cuts) else np.zeros(0)
        self.block_last = self.item[np.append(cuts[1:], len(term)) - 1] if len(cuts) else np.zeros(0, np.int64)

    def seek(self, term: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's first posting of an item not before `item` stands, and whether there is one."""
        at = np.searchsorted(self.keys, term * (self.items + 1) + item)
        there = at < self.ends[term]
        return np.minimum(at, len(self.keys) - 1), there

    def walk(self, owner: np.ndarray, term: np.ndarray, passages: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, item, score) of all that reach 1; owner and term: the distinct terms of each passage, by passage.

        Cursors run in the lists of the terms that are not common; what the common
        ones of a passage can add at most is taken off what the others need.
        """
        rest = self.common[term]
        rest_owner, rest_term, owner, term = owner[rest], term[rest], owner[~rest], term[~rest]
        need = 1 - EPSILON - np.minimum(self.rest, np.bincount(rest_owner, self.most[rest_term], passages))
        going = (np.bincount(owner, self.most[term], passages) >= need)[owner]
        owner, term = owner[going], term[going]
        least = np.zeros(passages, np.int64)  # the first item that is still to be looked at
        while len(owner):
            at, there = self.seek(term, least[owner])
            owner, term, at = owner[there], term[there], at[there]
            if not len(owner):
                return
            cursor = self.item[at]
            order = np.argsort(owner * (self.items + 1) + cursor, kind="stable")
            owner, term, cursor = owner[order], term[order], cursor[order]
            head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(head, len(owner)))
            total = np.cumsum(self.most[term])
            total -= np.repeat(total[head] - self.most[term[head]], length)
            reach = np.flatnonzero(total >= need[owner])
            mine, nth = np.unique(owner[reach], return_index=True)
            pivot = np.full(passages, -1, np.int64)
            pivot[mine] = cursor[reach[nth]]
            going = pivot[owner] >= 0
            owner, term, cursor = owner[going], term[going], cursor[going]
            if not len(owner):
                return
            item = pivot[owner]
            within = cursor <= item
            at, there = self.seek(term[within], item[within])
            inside = owner[within]
            bound = np.bincount(inside, np.where(there, self.block_most[self.block[at]], 0.0), passages)
            score = np.bincount(inside, np.where(there & (self.item[at] == item[within]), self.weight[at], 0.0), passages)
            opened = (bound >= need) & (pivot >= 0)
            hits = np.flatnonzero(opened & (score >= need))
            if len(hits):
                asked = np.isin(rest_owner, hits)
                place, found = self.seek(rest_term[asked], pivot[rest_owner[asked]])
                score += np.bincount(rest_owner[asked], np.where(found & (self.item[place] == pivot[rest_owner[asked]]), self.weight[place], 0.0), passages)
                hits = hits[score[hits] >= 1 - EPSILON]
            if len(hits):
                yield hits, pivot[hits], score[hits]
            # Behind the pivot if it was opened, else behind the first block that ends, or to the next cursor.
            skip = np.full(passages, self.items, np.int64)
            np.minimum.at(skip, inside[there], self.block_last[self.block[at[there]]] + 1)
            np.minimum.at(skip, owner[~within], cursor[~within])
            least = np.where(opened, pivot + 1, np.maximum(skip, pivot + 1))


class Index:
    """One part of the items, with weights divided by each item's threshold."""

    def __init__(self, items: list[tuple[int, str, list[str]]], df: dict[str, int], total: int, mean: float):
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, _, w in items]
        self.split = [question_and_answer(t) for _, t, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.weights: list[dict[int, float]] = []
        for words in self.words:
            row = {}
            for term, tf in Counter(words).items():
                n = df[term]
                idf = math.log(1 + (total - n + 0.5) / (n + 0.5))
                row[self.vocabulary.setdefault(term, len(self.vocabulary))] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            full = sum(row.values()) * SHARE
            self.weights.append({t: w / full for t, w in row.items()})
        #: The numbers of the items of each class, and their postings.
        self.classes: list[tuple[list[int], Postings]] = []
        longest, rest = FIRST, list(range(len(items)))
        while rest:
            own = [n for n in rest if len(self.words[n]) <= longest]
            if own:
                self.classes.append((own, Postings([self.weights[n] for n in own], len(self.vocabulary), max(len(self.words[n]) for n in own))))
            rest = [n for n in rest if len(self.words[n]) > longest]
            longest *= CLASS

    def passages(self, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, begin and end of the windows of two segments."""
        lengths = np.diff(offsets)
        segments = -(-lengths // longest)
        windows = np.where(segments > 1, segments - 1, segments)
        document = np.repeat(np.arange(len(lengths)), windows)
        nth = np.arange(len(document)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = offsets[document] + nth * longest
        return document, begin, np.minimum(begin + 2 * longest, offsets[document + 1])

    def leaks(self, texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text the leaked items: number -> score, question overlap, answer overlap."""
        out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        known, unknown = self.vocabulary, len(self.vocabulary)
        rows = [[known.get(w, unknown) for w in words_of(t)] for t in texts]
        offsets = np.cumsum([0, *map(len, rows)])
        ids = np.fromiter((x for r in rows for x in r), np.int64, int(offsets[-1]))
        del rows
        for own, postings in self.classes:
            document, begin, end = self.passages(offsets, postings.longest)
            long = end - begin
            owner = np.repeat(np.arange(len(begin)), long)
            term = ids[np.repeat(begin - (np.cumsum(long) - long), long) + np.arange(len(owner))]
            held = (term < unknown) & (np.append(postings.most, 0.0)[np.minimum(term, unknown)] > 0)
            owner, term = np.divmod(np.unique(owner[held] * (unknown + 1) + term[held]), unknown + 1)
            for found in postings.walk(owner, term, len(begin)):
                for w, n, score in zip(*(x.tolist() for x in found), strict=True):
                    passage = ids[begin[w] : end[w]].tolist()
                    question, answer = self.overlap(own[n], passage)
                    if question >= QUESTION and answer >= ANSWER:
                        best = out[document[w]]
                        best[own[n]] = max(best.get(own[n], (0.0,)), (score * SHARE, question, answer))
        return out

    def overlap(self, n: int, passage: list[int]) -> tuple[float, float]:
        """The shares of an item's question and answer that a passage holds; of a short item, all or nothing."""
        of = self.vocabulary
        whole = [of[w] for w in self.words[n]]
        if len(whole) < SHORT:
            found = float(any(passage[k : k + len(whole)] == whole for k, x in enumerate(passage) if x == whole[0]))
            return found, found
        question, answer = ([of[w] for w in part] for part in self.split[n])
        own = list(zip(question, question[1:], question[2:], strict=False))
        held = set(zip(passage, passage[1:], passage[2:], strict=False))
        q = sum(g in held for g in own) / len(own) if own else in_order(question, passage)
        return q, in_order(answer, passage)


def in_order(part: list[int], whole: list[int]) -> float:
    """The share of part's words that stand in whole in the same order (longest common subsequence, a bit for each word of whole)."""
    places: dict[int, int] = {}
    for k, x in enumerate(whole):
        places[x] = places.get(x, 0) | 1 << k
    every = (1 << len(whole)) - 1
    left = every
    for x in part:
        met = left & places.get(x, 0)
        left = ((left + met) | (left - met)) & every
    return (len(whole) - left.bit_count()) / max(1, len(part))


def _parts(items: DataFrame) -> Iterator[tuple[list[tuple[int, str, list[str]]], dict[str, int], int, float]]:
    """The index in parts of bounded size: items, document frequencies of their terms, items in all, mean words."""
    cut = durable(item_words(items), "benchmark-words")
    total, chars, mean = cut.agg(F.count(F.lit(1)), F.sum(F.length("text")), F.avg(F.size("words"))).first()
    terms = lambda rows: rows.select(F.explode(F.array_distinct("words")).alias("term"))
    frequencies = terms(cut).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = max(1, -(-(chars or 0) // PART_CHARS))
    for part in range(parts if total else 0):
        own = cut.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = [(r["item_id"], r["text"], r["words"]) for r in own.orderBy("item_id", "text").collect()]
        yield rows, {r["term"]: r["df"] for r in frequencies.join(terms(own).distinct(), "term", "left_semi").collect()}, total, mean


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with leaks: the benchmark items that each whole text holds, by item_id, and how well.

    One part of the index is sent out and held at a time; where there are more, what a pass
    found is written before the next one begins.
    """
    small_batches(docs.sparkSession)
    rest = replacing(docs, ["leaks"])
    out = rest.withColumn("leaks", F.array().cast(LEAK))
    schema, at = extended(rest, leaks=LEAK), rest.columns.index("text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    for nth, part in enumerate(_parts(items)):
        out = (durable(out, "decontamination") if nth else out).mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(part), at, kind, schema), schema)
    return out


def _scan(sent, at: int, kind: pa.DataType, schema: T.StructType):
    @tidy
    def run(batches):
        index = Index(*sent.value)
        for batch in slices(batches, at, RUN_BYTES):
            rows = batch.column(batch.num_columns - 1).to_pylist()
            for row, found in zip(rows, index.leaks([t or "" for t in batch.column(at).to_pylist()]), strict=True):
                row += [{"item_id": index.ids[n], "score": s, "question_overlap": q, "answer_overlap": a} for n, (s, q, a) in sorted(found.items())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], schema.names)

    return run


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each item that a document leaks."""
    found = find_leaks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), items)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
