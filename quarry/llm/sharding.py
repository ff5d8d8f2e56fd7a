"""Even shards by histogram sort: count below candidate keys, refine, exchange once.

All rows have an order: the digest of the text, then the id; equal texts are
neighbours. Splitters are the keys at which equal shares of the bytes end. Each
round sends the candidate keys out, every partition counts the bytes and rows
between them exactly, and the intervals that hold a wanted share are probed
anew, until each splitter meets the tolerance (0: it is the exact row). As the
counts are exact, a row's place in its shard follows from its range, and the
rows move once. A shard may be cut into many ranges, so that no task has to
hold a whole shard; a group of equal texts, however large, is cut like any
other stretch of the order.

Defined results: a null text has no bytes (size 8) and crc32 0; a null id
comes before all others; rows that are alike in text and id stand next to each
other and each has its own slot; an empty table gives an empty result; other
columns pass through, except those named like a result column.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, durable, extended, replacing, small_batches

WIDTH = 25  # bytes of a key: digest 16, null mark 1, id 8
RANGE_BYTES = 256 << 20
MAX_RANGES = 1 << 16
PROBES = 1 << 14


def _key_bytes(digest: pa.Array, ids: pa.Array) -> np.ndarray:
    """Keys that compare as bytes: hex digest, id with its sign turned."""
    n = len(digest)
    out = np.zeros((n, WIDTH), np.uint8)
    if n:
        out[:, :16] = np.frombuffer(b"".join(digest.to_pylist()), np.uint8).reshape(n, 16)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 16] = valid
        out[:, 17:] = np.where(valid, numbers, 0).astype(">u8").view(np.uint8).reshape(n, 8)
    return out


def _as_text(keys: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings; a closing byte keeps trailing zeros significant."""
    if not len(keys):
        return np.empty(0, f"S{WIDTH + 1}")
    closed = np.concatenate([keys, np.ones((len(keys), 1), np.uint8)], axis=1)
    return np.ascontiguousarray(closed).view(f"S{WIDTH + 1}").reshape(-1)


def _probe_array(probes: list[int]) -> np.ndarray:
    raw = b"".join(p.to_bytes(WIDTH, "big") for p in probes)
    return _as_text(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH))


def _histogram(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(bucket, bytes, rows, smallest key, largest key); bucket b holds keys from probe b-1 up to probe b."""
    spark = keys.sparkSession
    sent = spark.sparkContext.broadcast(probes)

    def run(batches):
        at = _probe_array(sent.value)
        bytes_, rows = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        least: dict[int, bytes] = {}
        most: dict[int, bytes] = {}
        for batch in batches:
            text = _as_text(_key_bytes(batch.column(0), batch.column(1)))
            bucket = np.searchsorted(at, text, "right")
            bytes_ += np.bincount(bucket, batch.column(2).to_numpy(zero_copy_only=False), len(at) + 1).astype(np.int64)
            rows += np.bincount(bucket, minlength=len(at) + 1)
            order = np.lexsort((text, bucket))
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            for first, last in zip([0, *edges], [*edges, len(order)], strict=True):
                if first < last:
                    b, low, high = int(bucket[order[first]]), bytes(text[order[first]])[:WIDTH], bytes(text[order[last - 1]])[:WIDTH]
                    least[b], most[b] = min(least.get(b, low), low), max(most.get(b, high), high)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(bytes_[full]), pa.array(rows[full]), pa.array([least[b] for b in full.tolist()], pa.binary()), pa.array([most[b] for b in full.tolist()], pa.binary())], ["bucket", "bytes", "n", "least", "most"])

    counted = keys.mapInArrow(run, "bucket int, bytes bigint, n bigint, least binary, most binary")
    merged = counted.groupBy("bucket").agg(F.sum("bytes"), F.sum("n"), F.min("least"), F.max("most")).orderBy("bucket").collect()
    sent.destroy()
    return [(r[0], r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in merged]


def find_splitters(keys: DataFrame, weights: list[int], total: int, tolerance: int) -> list[tuple[int, int]]:
    """For each wanted weight the first key with at least that many bytes before it (within tolerance), and the rows before that key.

    A wanted weight is bracketed by keys low <= splitter <= high with exact counts before low.
    """
    space = 1 << (8 * WIDTH)
    found: dict[int, tuple[int, int]] = {}
    bracket = {i: (0, space - 1) for i in range(len(weights))}
    while bracket:
        fan = max(1, PROBES // len(bracket))
        probes = sorted({low + (high - low) * j // (fan + 1) for low, high in bracket.values() for j in range(1, fan + 1)} | {x for low, high in bracket.values() for x in (low, high, min(high + 1, space - 1))})
        buckets = _histogram(keys, probes)
        before = list(accumulate((b[1] for b in buckets), initial=0))
        rows = list(accumulate((b[2] for b in buckets), initial=0))
        for i in list(bracket):
            want = weights[i]
            # The bucket in which the bytes before a key pass the wanted weight.
            k = int(np.searchsorted(np.array(before[1:]), want, "left"))
            if k >= len(buckets):
                found[i] = (space - 1, rows[-1])
                del bracket[i]
                continue
            _, _, _, least, most = buckets[k]
            if want - before[k] <= tolerance:
                found[i] = (least, rows[k])
                del bracket[i]
            elif before[k + 1] - want <= tolerance or least == most:
                after = buckets[k + 1][3] if k + 1 < len(buckets) else space - 1
                found[i] = (after, rows[k + 1])
                del bracket[i]
            else:
                bracket[i] = (least + 1, most)
    return [found[i] for i in range(len(weights))]


def shard_by_bytes(df: DataFrame, shards: int, tolerance: int = 0, range_bytes: int = RANGE_BYTES, text: str = "text", ids: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """df (or just its columns in carry) with size, text_crc32, law, shard, slot and grown_shard (null: that is for the law `key`)."""
    small_batches(df.sparkSession)
    rest = replacing(df, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    rows = rest.select(F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("__digest"), F.col(ids).cast("bigint").alias("__id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"), *(rest.columns if carry is None else carry))
    carried = rows.columns[4:]
    keys = durable(rows.select("__digest", "__id", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = max(1, min(MAX_RANGES // shards, -(-total // (shards * range_bytes))))
    ranges = shards * cuts
    weights = [-(-total * i // ranges) for i in range(1, ranges)]  # the least whole number of bytes that reaches the share
    splitters = find_splitters(keys, weights, total, tolerance) if total else [(1 << 8 * WIDTH, 0)] * (ranges - 1)
    discard(keys)
    firsts = [0, *(n for _, n in splitters)]  # rows before each range
    sent = df.sparkSession.sparkContext.broadcast(([min(k, (1 << 8 * WIDTH) - 1) for k, _ in splitters], firsts))
    names = [c for c in rows.columns if c not in ("__digest", "__id")]
    schema = extended(rows.select("__digest", "__id", *names), __range="int", shard="int", __first="bigint")

    def place(batches):
        at, first = _probe_array(sent.value[0]), np.array(sent.value[1], np.int64)
        for batch in batches:
            r = np.searchsorted(at, _as_text(_key_bytes(batch.column(0), batch.column(1))), "right")
            shard = r // cuts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r.astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(first[r] - first[shard * cuts])], schema.names)

    placed = rows.select("__digest", "__id", *names).mapInArrow(place, schema)
    order = Window.partitionBy("__range").orderBy("__digest", F.col("__id").asc_nulls_first())
    slot = F.col("__first") + F.row_number().over(order) - 1
    return placed.select(*carried, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """The shards as folders shard=0, 1, ... of Parquet, rows in slot order within each file."""
    shard_by_bytes(df, shards, **options).write.partitionBy("shard").parquet(path)
