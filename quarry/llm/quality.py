"""A quality classifier by compression.

Two zstandard dictionaries are built, one of labelled good and one of labelled
bad text. A text is cut into pieces, each piece is compressed with either
dictionary, and the difference of the two sums of sizes, over the bytes of the
text, tells which of the two it is more like. A one-dimensional logistic curve,
fitted on labelled texts under dictionaries that do not hold them, makes a score of it.

Training reads a bounded sample of the labelled rows (SAMPLE of each label,
in the order of a hash of the id), each with its whole text: the dictionaries
take turns through the texts, each time another piece at a hashed offset, until
they are full, and the curve is fitted on whole texts. The sampled texts stay
on the executors. Every row is scored over its whole text.

Defined results: a null text counts as empty; an empty text gets the share of
good labels as its score; labels other than 0 and 1 are left out;
an id that is labelled both ways is left out; without labels of both kinds each
score is that share (0.5 without any); repeated rows get the same score; extra
columns pass through, except those named like a result column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, durable, extended, replacing, slices, small_batches, tidy

#: Labelled documents of each label that training reads at most; of those it reads all of the text.
SAMPLE = 1500
DICTIONARY = 256 << 10
#: Bytes that a dictionary takes from one place of a text.
SHARE = 256
PIECE = 512
LEVEL = 6
#: So many bytes of average text are taken as added to each: a few words alone prove little.
SMOOTH = 256


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float
    usual: float = 0.0  # the mean difference a byte

    def compressors(self):
        """Functions that compress with the good dictionary and with the bad one."""
        import zstandard

        kinds = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            kinds.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False).compress)
        return kinds

    def scorer(self):
        """A function from a text's bytes to its score."""
        if not (self.good and self.bad):
            return lambda data: self.prior
        good, bad = self.compressors()

        def score(data: bytes) -> float:
            if not data:
                return self.prior
            x = (excess(data, good, bad) + SMOOTH * self.usual) / (len(data) + SMOOTH)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * x + self.offset))))

        return score


def excess(data: bytes, good, bad) -> int:
    """Bytes that the bad dictionary needs more than the good one."""
    more = 0
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE]
        more += len(bad(piece)) - len(good(piece))
    return more


def _dictionary(texts: DataFrame) -> bytes:
    """Raw content for a dictionary, from the whole of each text (__id, __text): every text gives
    a piece at a hashed offset, then every text another one, so that no long one fills it."""
    most = DICTIONARY // SHARE
    data = F.col("__text").cast("binary")
    places = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("__text") / SHARE).cast("int") - 1), lambda k: F.struct(F.xxhash64("__id", k).alias("h"), k.alias("k")))
    pieces = texts.select("__id", data.alias("data"), F.posexplode(F.slice(F.array_sort(places), 1, most)).alias("turn", "place"))
    pieces = pieces.select("turn", F.xxhash64("__id").alias("h"), "__id", F.substring("data", F.col("place.k") * SHARE + 1, F.lit(SHARE)).alias("piece"))
    # Only a text's last piece may be short, so that so many pieces fill the dictionary if anything does.
    taken, size = [], 0
    for r in pieces.orderBy("turn", "h", "__id").limit(most + SAMPLE).collect():
        if size < DICTIONARY:
            taken.append(bytes(r["piece"]))
            size += len(taken[-1])
    # The end of a dictionary is the cheapest to refer to: it gets the first turns, in which all texts take part.
    return b"".join(reversed(taken))[-DICTIONARY:]


def _excesses(texts: DataFrame, model: Model) -> list[tuple[int, int, int]]:
    """Label, excess and bytes of each whole text (__id, __y, __text), in the order of the ids."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches):
        kinds = sent.value.compressors()
        for batch in batches:
            data = [t.encode() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([excess(t, *kinds) for t in data], pa.int64()), pa.array([len(t) for t in data], pa.int64())], ["id", "y", "more", "n"])

    rows = texts.select("__id", "__y", "__text").mapInArrow(run, "id bigint, y int, more bigint, n bigint").collect()
    sent.destroy()
    return [(r["y"], r["more"], r["n"]) for r in sorted(rows)]


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak pull of the slope to 0; the labels weigh as in all labelled rows."""
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + np.array([0.02 * w[0], 0])
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([0.02, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, target: str) -> tuple[float, DataFrame | None]:
    """The share of label 1 in all labelled rows, and __id, __y and the whole __text of up to SAMPLE labelled rows of each label.

    Only the sample's ids, a bounded list, are sent to the scan of the texts.
    """
    spark = docs.sparkSession
    sound = labels.where(F.col(target).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.min(target).cast("int").alias("__y"), F.max(target).cast("int").alias("__z")).where("__y = __z")
    mixed = F.xxhash64("__id")
    rows = [r for y in (0, 1) for r in sound.where(F.col("__y") == y).orderBy(mixed, "__id").limit(SAMPLE).select("__id", "__y").collect()]
    count = {r["__y"]: r["count"] for r in sound.groupBy("__y").count().collect()}
    prior = count.get(1, 0) / sum(count.values()) if count else 0.5
    if not rows:
        return prior, None
    chosen = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in rows], "__id bigint, __y int"))
    found = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.coalesce("text", F.lit("")).alias("__text")).join(chosen, "__id")
    return prior, found.groupBy("__id", "__y").agg(F.min("__text").alias("__text")).where("__text <> ''")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """The whole sample makes the dictionaries; the curve is fitted on the differences of each
    third of it under dictionaries that the other two thirds make."""
    prior, texts = sample(docs, labels, target)
    if texts is None:
        return Model(b"", b"", 0.0, 0.0, prior)
    texts = durable(texts, "quality-sample")
    of = {y: [] for y in (0, 1)}
    for r in texts.select("__id", "__y").orderBy(F.xxhash64("__id"), "__id").collect():
        of[r["__y"]].append(r["__id"])
    if min(map(len, of.values())) < 2:
        discard(texts)
        return Model(b"", b"", 0.0, 0.0, prior)
    third = docs.sparkSession.createDataFrame([(i, k % 3) for y in of for k, i in enumerate(of[y])], "__id bigint, __third int")
    parted = texts.join(F.broadcast(third), "__id")
    rows = []
    for k in range(3):
        others = parted.where(F.col("__third") != k)
        rows += _excesses(parted.where(F.col("__third") == k), Model(*(_dictionary(others.where(F.col("__y") == y)) for y in (1, 0)), 0.0, 0.0, prior))
    model = Model(*(_dictionary(texts.where(F.col("__y") == y)) for y in (1, 0)), 0.0, 0.0, prior)
    discard(texts)
    y, more, n = np.array(rows, float).T
    plain = more / (n + SMOOTH)
    model.usual = float(prior * plain[y == 1].mean() + (1 - prior) * plain[y == 0].mean())
    model.slope, model.offset = _logistic((more + SMOOTH * model.usual) / (n + SMOOTH), y, prior)
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 of each whole text. The model (two dictionaries of 256 KB at most) is sent once."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = replacing(docs, [name])
    schema, at = extended(rest, **{name: "double"}), rest.columns.index("text")

    @tidy
    def run(batches):
        judge = sent.value.scorer()
        for batch in slices(batches, at):
            made = pa.array([judge((t or "").encode()) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], schema.names)

    return rest.mapInArrow(run, schema)


def fold(ids: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(4))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those of ids that are not held out."""
    return labels.where(fold(F.col("doc_id").cast("bigint")) != 2)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels are learned only from ids that are not held out."""
    model = train(docs, learnable(labels))
    out = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(fold(F.col("doc_id").cast("bigint")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
