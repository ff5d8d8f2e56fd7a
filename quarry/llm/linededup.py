"""Line dedup that can be undone: exact reference counts behind sharded cuckoo filters.

A line's key is the line without ASCII white space at its ends and with A-Z
lower-cased. A key of at least min_chars code points that at least min_docs
documents hold loses its lines in all of them but the one with the largest id.

State, kept in tables under one path, so that another session can open it again:

* postings - one row for each document and key (digest of 128 bits), a table
  for each insertion, and the ids of each deletion;
* references - for each key how many documents hold it and the largest id, as a
  row of change for each insertion or deletion that touches the key;
* filters - for each shard of the key space a cuckoo filter of the keys whose
  count has reached min_docs;
* manifest - which of these tables count; its last row is written last, so
  an insertion or deletion that does not end leaves the state as it was.

insert() adds counts and delete() subtracts them, each only for the keys of its
own documents; keys that reach the threshold go into the filters, those that
fall below come out. So dedup() after a deletion gives what it would have given
had the documents never been there. dedup() sends line keys and filters to the
same tasks, however large either is; only what a filter lets through meets the
exact table.

Defined results: a null or empty text is one empty line; rows that share an id
are one document, rows without an id too; a null id is smaller than all
others and cannot be deleted; an empty table gives an empty result; extra columns pass
through, except those named like a result's.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ASCII_SPACE, discard, extended, replacing, shared_dir, slices, small_batches, tidy
from quarry.llm.cuckoo import CuckooFilter, build

#: Keys that one filter is made for; there are at least LEAST_SHARDS of them, and line keys of one shard go to SALTS places.
SHARD_KEYS, LEAST_SHARDS, SALTS = 1 << 20, 64, 32
#: Changes of the references that are read side by side before they are written as one.
GENERATIONS = 8


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key, or None if the key is too short."""
    key = line.strip(ASCII_SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def text_keys(text: str, min_chars: int) -> list[bytes | None]:
    return [line_key(x, min_chars) for x in text.encode().split(b"\n")]


def _key_rows(min_chars: int):
    """Rows (doc_id, key) of the distinct keys of each row's text."""

    @tidy
    def run(batches):
        for batch in slices(batches, 1):
            keys, counts = [], []
            for t in batch.column(1).to_pylist():
                own = set(text_keys(t or "", min_chars))
                own.discard(None)
                keys += own
                counts.append(len(own))
            rows = np.repeat(np.arange(batch.num_rows), counts)
            made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(b"".join(keys))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), made], ["doc_id", "key"])

    return run


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and key of every line that is long enough; a row's text gives each key once."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_key_rows(min_chars), "doc_id bigint, key binary")


def one_each(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """postings with each document and key once. Only ids that stand in several rows can bring a key twice, so only their rows move."""
    twice = docs.groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id")
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    return postings.join(twice, same, "left_anti").unionByName(postings.join(twice, same, "left_semi").distinct())


def shard_of(key, shards: int):
    """The shard of a key, from its first two bytes; shards is a power of two up to 65,536."""
    return F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int").bitwiseAND(shards - 1)


def count_references(postings: DataFrame) -> DataFrame:
    """Exact counts; each task counts its own rows first, so a key that is everywhere moves as a few rows."""
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("keeper"))


def _filters_of(keys: DataFrame, shards: int) -> DataFrame:
    def one(t: pa.Table) -> pa.Table:
        held = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint64).reshape(-1, 2)
        made = build(held[:, 1])
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "held": pa.array([len(held)], pa.int64()), "cells": pa.array([made.dumps()], pa.binary())})

    return keys.select(shard_of("key", shards).alias("shard"), "key").groupBy("shard").applyInArrow(one, "shard int, held bigint, cells binary")


def _screened(rows: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows (doc_id, key) that their shard's filter lets through.

    A shard's rows are dealt over SALTS places, to each of which its filter goes
    too, ahead of them; a task holds one filter at a time.
    """
    dealt = rows.select(shard_of("key", shards).alias("shard"), F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("binary").alias("cells"), "doc_id", "key")
    sent = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "cells", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("key"))
    met = sent.unionByName(dealt).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("cells").isNull())

    @tidy
    def run(batches):
        place, held = None, None
        for batch in batches:
            shard, salt = (batch.column(i).to_numpy() for i in range(2))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if place != (shard[a], salt[a]):
                    place, held = (shard[a], salt[a]), None
                part = batch.slice(a, b - a)
                if part.column(2)[0].is_valid:
                    held = CuckooFilter.loads(part.column(2)[0].as_py())
                    part = part.slice(1)
                if held is not None and part.num_rows:
                    keys = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint64).reshape(-1, 2)
                    out = part.filter(pa.array(held.contains(keys[:, 1])))
                    if out.num_rows:
                        yield pa.RecordBatch.from_arrays([out.column(3), out.column(4)], ["doc_id", "key"])

    return met.mapInArrow(run, "doc_id bigint, key binary")


#: A change of a key: documents more or less, the largest id that it brings, or (whole) the largest that is left.
CHANGE = "key binary, refs bigint, keeper bigint, whole boolean"
MANIFEST = "generation int, min_docs int, min_chars int, shards int, postings array<string>, deletions array<string>, changes array<string>, filters string"


class LineDedup:
    """The state of line dedup over a growing and shrinking set of documents, under one path of the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, path: str | None = None):
        small_batches(spark)
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.path = path or f"{shared_dir(spark)}/line-dedup-{uuid.uuid4().hex}"
        self.generation, self.shards = 0, LEAST_SHARDS
        self.postings: list[str] = []  # tables gen=..., each with the ids that the insertion brought
        self.deletions: list[str] = []
        self.changes: list[str] = []
        self.filters: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineDedup:
        """The state that was kept under path, in whatever session."""
        last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.col("generation").desc()).first()
        state = cls(spark, last["min_docs"], last["min_chars"], path)
        state.generation, state.shards, state.filters = last["generation"], last["shards"], last["filters"]
        state.postings, state.deletions, state.changes = (list(last[n]) for n in ("postings", "deletions", "changes"))
        return state

    def _keep(self, df: DataFrame, kind: str) -> str:
        """Write df as a table of this generation; what a run that broke off left there is replaced."""
        at = f"{kind}/generation-{self.generation}"
        df.write.mode("overwrite").parquet(f"{self.path}/{at}")
        return at

    def _read(self, at: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{at}")

    def _all(self, tables: list[str], schema: str) -> DataFrame:
        """The tables side by side, with the generation of each."""
        out = self.spark.createDataFrame([], f"{schema}, generation int")
        for at in tables:
            out = out.unionByName(self._read(at, schema).withColumn("generation", F.lit(int(at.rsplit("-", 1)[1]))))
        return out

    def _commit(self) -> LineDedup:
        row = (self.generation, self.min_docs, self.min_chars, self.shards, self.postings, self.deletions, self.changes, self.filters)
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self

    def _alive(self) -> DataFrame:
        """doc_id and key of all that was inserted and not deleted since."""
        rows = self._all(self.postings, "doc_id bigint, key binary")
        if not self.deletions:
            return rows.drop("generation")
        gone = self._all(self.deletions, "doc_id bigint").groupBy(F.col("doc_id").alias("__id")).agg(F.max("generation").alias("__gone"))
        return rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("generation") < F.col("__gone")), "left_anti").drop("generation")

    def references(self) -> DataFrame:
        """key, refs, keeper of every key that a document holds, from the changes."""
        if len(self.changes) == 1:
            return self._read(self.changes[0], CHANGE).select("key", "refs", "keeper").where("refs > 0")
        rows = self._all(self.changes, CHANGE).groupBy("key").agg(F.sum("refs").alias("refs"), F.collect_list(F.struct("generation", "whole", "keeper")).alias("c"))
        # A deletion says the largest id that is left; insertions after it can only raise it.
        since = F.coalesce(F.array_max(F.transform(F.filter("c", lambda c: c["whole"]), lambda c: c["generation"])), F.lit(-1))
        keeper = F.array_max(F.transform(F.filter("c", lambda c: c["generation"] >= F.col("__since")), lambda c: c["keeper"]))
        return rows.withColumn("__since", since).select("key", "refs", keeper.alias("keeper")).where("refs > 0")

    def repeated(self) -> DataFrame:
        """The keys that lose lines: key, refs, keeper."""
        return self.references().where(F.col("refs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> LineDedup:
        """Count the lines of new documents in. Their ids must not be counted already."""
        self.generation += 1
        new = self._read(self._keep(line_keys(docs, self.min_chars), "found"), "doc_id bigint, key binary")
        first = not self.changes
        self.postings = [*self.postings, self._keep(one_each(new, docs), "postings")]
        self._drop("found")
        own = self._read(self.postings[-1], "doc_id bigint, key binary")
        return self._change(count_references(own).withColumn("whole", F.lit(False)), first)

    def delete(self, ids: DataFrame) -> LineDedup:
        """Take documents (a table with doc_id) out again, exactly."""
        if not self.postings:
            return self
        self.generation += 1
        gone = self._read(self._keep(ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct(), "deletions"), "doc_id bigint")
        less = self._alive().join(gone, "doc_id", "left_semi").groupBy("key").agg((-F.count(F.lit(1))).alias("refs"))
        less = self._read(self._keep(less, "touched"), "key binary, refs bigint")
        self.deletions = [*self.deletions, f"deletions/generation-{self.generation}"]
        left = self._alive().join(less.select("key"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("keeper"))
        return self._change(less.join(left, "key", "left").withColumn("whole", F.lit(True)), False)

    def _change(self, change: DataFrame, first: bool) -> LineDedup:
        """Put a change of the references (key, refs, keeper, whole) on record and the filters in step with it."""
        at = self._keep(change.select("key", "refs", "keeper", "whole"), "changes")
        if first:
            self.changes = [at]
            return self._build_filters()._commit()
        touched = self._read(at, CHANGE).select("key")
        was, self.changes = self._over(touched), [*self.changes, at]
        now = self._over(touched)
        moved = was.join(now, "key", "left_anti").withColumn("gain", F.lit(False)).unionByName(now.join(was, "key", "left_anti").withColumn("gain", F.lit(True)))
        self._update_filters(moved.withColumn("shard", shard_of("key", self.shards)))
        if len(self.changes) > GENERATIONS:
            self.changes = [self._keep(self.references().withColumn("whole", F.lit(True)), "summed")]
        return self._commit()

    def _over(self, touched: DataFrame) -> DataFrame:
        """The touched keys that lose lines by the changes that count now."""
        return self.references().join(touched, "key", "left_semi").where(F.col("refs") >= self.min_docs).select("key")

    def _build_filters(self) -> LineDedup:
        held = self.repeated().count()
        self.shards = min(1 << 16, max(LEAST_SHARDS, 1 << max(1, held // SHARD_KEYS).bit_length()))
        self.filters = self._keep(_filters_of(self.repeated(), self.shards), "filters")
        return self

    def _update_filters(self, moved: DataFrame) -> None:
        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            shard = (left if left.num_rows else right).column("shard")[0].as_py()
            cuckoo, held = CuckooFilter.sized(0), 0
            if left.num_rows:
                cuckoo, held = CuckooFilter.loads(left.column("cells")[0].as_py()), left.column("held")[0].as_py()
            digests = np.frombuffer(b"".join(right.column("key").to_pylist()), np.uint64).reshape(-1, 2)[:, 1]
            gain = np.array(right.column("gain").to_pylist(), bool)
            cuckoo.delete(digests[~gain])
            full = not cuckoo.insert(digests[gain])
            row = {"shard": [shard], "held": [held + int(gain.sum()) - int((~gain).sum())], "cells": [cuckoo.dumps()], "full": [full]}
            return pa.Table.from_pydict(row, pa.schema([("shard", pa.int32()), ("held", pa.int64()), ("cells", pa.binary()), ("full", pa.bool_())]))

        kind = "shard int, held bigint, cells binary"
        updated = self._read(self._keep(self._read(self.filters, kind).groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, f"{kind}, full boolean"), "updated"), f"{kind}, full boolean")
        full = updated.where("full").select("shard")
        # A filter cannot grow in place: the shards that are full are built anew from the exact table.
        again = _filters_of(self.repeated().withColumn("shard", shard_of("key", self.shards)).join(full, "shard", "left_semi").select("key"), self.shards)
        self.filters = self._keep(updated.where("not full").drop("full").unionByName(again), "filters")

    def _drop(self, kind: str) -> None:
        discard(self.spark.read.schema("key binary").parquet(f"{self.path}/{kind}/generation-{self.generation}"))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs with their texts less the dropped lines; n_lines and n_dropped (long) beside them."""
        return self._without(docs, line_keys(docs, self.min_chars))

    def _without(self, docs: DataFrame, keys: DataFrame) -> DataFrame:
        """docs less the lines that go, by the keys (doc_id, key) that they hold."""
        rows = _screened(keys, self._read(self.filters, "shard int, held bigint, cells binary"), self.shards)
        drops = rows.join(self.repeated().select("key", "keeper"), "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("__drops")).withColumnRenamed("doc_id", "__id")
        rest = replacing(docs, ["n_lines", "n_dropped"])
        joined = rest.join(drops, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")), "left").drop("__id")
        schema = extended(rest, n_lines="bigint", n_dropped="bigint")
        at, min_chars = rest.columns.index("text"), self.min_chars

        @tidy
        def run(batches):
            for batch in slices(batches, at):
                texts, lines, dropped = [], [], []
                for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    n = (text or "").count("\n") + 1
                    if drop:
                        gone, split = set(drop), text.split("\n")
                        kept = [x for x, k in zip(split, text_keys(text, min_chars), strict=True) if k not in gone]
                        text = "\n".join(kept)
                        dropped.append(n - len(kept))
                    else:
                        dropped.append(0)
                    texts.append(text)
                    lines.append(n)
                columns = [*batch.columns[:-1], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs less the lines that they repeat among themselves: one insertion, then one dedup by the keys that it found."""
    state = LineDedup(docs.sparkSession, min_docs, min_chars).insert(docs)
    return state._without(docs, state._alive())


def digests(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each document."""
    out = dedup_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
