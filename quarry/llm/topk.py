"""Exact top-k by inner product, with columnar branch and bound.

Vectors become whole numbers, floor(scale * x). Candidates lie in blocks in
vertical layout (one run of memory for each dimension). A query takes the
dimensions in order of its own magnitudes, a block of them at a time, adds to
the partial scores of the candidates that are left, and drops those whose
partial score plus the most that the remaining dimensions can add (the product
of the remaining lengths, Cauchy-Schwarz) stays below its k-th best score. The
survivors are packed together before the next block.

Queries come in blocks too. Every candidate block meets every query block once
(a stated query set against all rows). They meet by a key made of the query
block and a small group of candidate blocks, so no task has to read more than
its share of either side. A task keeps the best k of its queries over all blocks
that it sees, so later blocks are cut sooner, and the last step takes the best k
of what the tasks found.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; vectors are compared only with those
of their own number of dimensions, those of none with a score of 0; rows that
share an id all count, as candidates and as queries of one result, and of those
that share id and vector one; equal scores go to the smaller id; a query never finds its own id; scores beyond a long are held at
its limits; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, tidy

CANDIDATES = 2048
QUERIES = 8192
GROUP = 4  # candidate blocks that share a join key
STEP = 8
EXACT = 1 << 53
LONG = (1 << 63) - 1


def scaled(df: DataFrame, scale: int, ids: str, vector: str) -> DataFrame:
    """id (long), v (array<double>, whole numbers) and dims of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(ids).isNotNull() & x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    floor = F.transform(x, lambda e: _floor(e * float(scale)))
    return df.where(sound).select(F.col(ids).cast("bigint").alias("id"), floor.alias("v"), F.size(x).alias("dims"))


def _floor(x):
    """floor() as a double; beyond 2^52 a double is whole already, and a long would overflow."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _pack(rows: DataFrame, blocks: int, label: str) -> DataFrame:
    """One row for each block: dims, block, ids, and the vertical matrix in the least wide kind of number that holds it."""

    def one(t: pa.Table) -> pa.Table:
        dims = t.column("dims")[0].as_py()
        ids = t.column("id").to_numpy()
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), dims)
        most = np.abs(v).max(initial=0)
        kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
        data = np.ascontiguousarray(v.T.astype(kind)).tobytes()
        return pa.table({"dims": pa.array([dims], pa.int32()), label: pa.array([t.column("block")[0].as_py()], pa.int32()), f"{label}_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), f"{label}_kind": pa.array([kind]), f"{label}_data": pa.array([data], pa.binary())})

    # Equal rows meet in the tasks that read them first, and an id with very many vectors is spread over all blocks.
    dealt = rows.distinct().withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dims", "block").applyInArrow(one, f"dims int, {label} int, {label}_ids binary, {label}_kind string, {label}_data binary")


class _Best:
    """The best k of one query so far: scores and ids, best first."""

    __slots__ = ("ids", "k", "least", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = float(self.scores[-1])


def search_block(best: _Best, qid: int, q: np.ndarray, ids: np.ndarray, columns: np.ndarray, squares: np.ndarray) -> None:
    """Branch and bound of one query over one block; columns is dims x candidates, squares the squared lengths."""
    order = np.argsort(-np.abs(q), kind="stable")
    left = float(q @ q)
    alive, score, mass = None, np.zeros(len(ids)), squares
    for at in range(0, len(q), STEP):
        dims = order[at : at + STEP]
        part = columns[dims] if alive is None else columns[np.ix_(dims, alive)]
        score = score + q[dims] @ part
        left -= float(q[dims] @ q[dims])
        if at + STEP >= len(q):
            break
        mass = mass - np.einsum("ij,ij->j", part, part)
        if best.least == -np.inf:
            continue
        keep = np.flatnonzero(score + np.sqrt(np.maximum(mass, 0) * max(left, 0)) * (1 + 1e-9) + 1 >= best.least)
        if len(keep) < len(score):
            score, mass, alive = score[keep], mass[keep], keep if alive is None else alive[keep]
            if not len(keep):
                return
    found = ids if alive is None else ids[alive]
    keep = (score >= best.least) & (found != qid)
    if keep.any():
        score, found = score[keep], found[keep]
        if len(score) > 4 * best.k:  # all that reach the k-th, ties included
            kth = np.partition(score, len(score) - best.k)[len(score) - best.k]
            score, found = score[score >= kth], found[score >= kth]
        best.add(found, score.astype(np.int64))


def search_wide(best: _Best, qid: int, q: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
    """For numbers whose products doubles cannot hold: bounds from doubles with their error, whole numbers for what they leave."""
    far = max(np.frexp(np.abs(q).max(initial=0))[1] + np.frexp(np.abs(columns).max(initial=0))[1] - 900, 0)
    near = np.ldexp(columns, -int(far))
    score, error = q @ near, (np.abs(q) @ np.abs(near)) * (len(q) + 2) * 2.0**-51
    other = np.flatnonzero(ids != qid)
    low = score[other] - error[other]
    kth = np.partition(low, len(low) - best.k)[len(low) - best.k] if len(low) > best.k else -np.inf
    left = other[score[other] + error[other] >= kth]
    whole = [int(x) for x in q]
    exact = [max(-LONG, min(LONG, sum(a * int(b) for a, b in zip(whole, columns[:, c].tolist(), strict=True)))) for c in left.tolist()]
    best.add(ids[left], np.array(exact, np.int64))


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, the candidate's id and score: the k highest inner products of each query with other rows of df."""
    small_batches(df.sparkSession)
    rows, asked = scaled(df, scale, ids, vector), scaled(queries, scale, ids, vector)
    sizes = rows.groupBy().count().first()[0], asked.groupBy().count().first()[0]
    blocks, groups = (max(1, -(-n // m)) for n, m in zip(sizes, (CANDIDATES, QUERIES), strict=True))
    candidates, wanted = _pack(rows, blocks, "c"), _pack(asked, groups, "q")
    dealt = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("g", F.floor(F.col("c") / GROUP).cast("int"))
    wanted = wanted.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // GROUP))))
    pairs = dealt.join(wanted, ["dims", "q", "g"]).select("dims", "q_ids", "q_kind", "q_data", "c_ids", "c_kind", "c_data")

    @tidy
    def run(batches):
        best: dict[tuple[int, int], _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dims, q_ids, q_kind, q_data, c_ids, c_kind, c_data = (c[row].as_py() for c in batch.columns)
                qi, ci = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
                q = np.frombuffer(q_data, q_kind).astype(float).reshape(dims, len(qi)).T
                c = np.frombuffer(c_data, c_kind).astype(float).reshape(dims, len(ci))
                small = dims * (np.abs(q).max(initial=0) + 1) * (np.abs(c).max(initial=0) + 1) < EXACT and dims * (np.abs(c).max(initial=0) + 1) ** 2 < EXACT
                squares = np.einsum("ij,ij->j", c, c)
                for n, qid in enumerate(qi.tolist()):
                    mine = best.setdefault((dims, qid), _Best(k))
                    if small:
                        search_block(mine, qid, np.ascontiguousarray(q[n]), ci, c, squares)
                    else:
                        search_wide(mine, qid, q[n], ci, c)
        flat = [(qid, b) for (_, qid), b in best.items() if len(b.ids)]
        for at in range(0, len(flat), 1024):
            part = flat[at : at + 1024]
            yield _rows(np.repeat([qid for qid, _ in part], [len(b.ids) for _, b in part]), np.concatenate([b.ids for _, b in part]), np.concatenate([b.scores for _, b in part]))

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(qids, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])
