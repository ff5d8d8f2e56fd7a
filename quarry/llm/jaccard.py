"""Exact Jaccard join of shingle sets in their metric space, as connected components.

The distance of two sets is 1 - Jaccard; it obeys the triangle inequality. Two
sets link if it is at most THETA = 1 - threshold.

1. Equal sets are one point of the space. From here on there are only points.
2. Cells. The hashed shingles are dealt into k parts, k more than two linked
   sets can differ in; so some parts of theirs are equal. Each part of a set is
   a pivot of its own, and the region round it (radius 0 in that part's own
   space) holds all sets with just this part. Linked sets share a region.
   Sizes are dealt into classes, each with its own k; a set near a border is
   replicated into the next class (the window that the size bound leaves open).
   Shingles that very many documents hold are counted beforehand and left out
   of the parts, where enough others remain. Regions that overlap are joined to
   groups; groups are mostly families of near copies, and no link crosses from
   one to another. Groups of more than two are parted again, by the shingles that
   are rare in them.
3. Regions. Within a group pivots are sets, drawn from it. Each set goes to the
   Voronoi region of its nearest pivot (or to the rest, if all are far), and as a replica to every region whose
   pivot is no more than 2 THETA farther: by the triangle inequality whatever links
   to it meets it there. Sets within THETA of a pivot link to it. A set is settled
   once it is linked to some pivot and every pivot within 2 THETA of it is in its
   component: a set that links to it is within 2 THETA of the pivot that set
   belongs to. Regions with sets that are not settled are joined in the same way,
   with pivots of their own, until a task can hold them. There the pivots go
   one by one, with the same rule, which joins the region exactly.

Pivots drawn from the corpus alone would not do for step 2: random texts share
next to no shingles, so all distances are near 1 and every window would hold
the whole corpus.

Defined results: a null text, or one without words, has an empty set and links
with nothing; a text with fewer words than a shingle has one shingle, its whole
sequence; repeated rows and copies share a component; a null id is ignored when
the smallest id of a component is sought, and a set that only rows without an
id hold links with nothing; empty tables give empty results; shingles are told
apart by 64 bits, sets by 128, and the sets of one group, links among them included, by 64;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, durable, slices, tidy
from quarry.llm.components import components
from quarry.llm.cuckoo import CuckooFilter, build

RUN_CHARS = 1_000_000
REMEMBERED = 150_000
#: Rows of parts that a task sorts at once, to send each of them once.
HELD = 1 << 19
#: How rarely a set may have more empty parts than are spare.
DEVIATIONS = 3
#: Bits of the table in which shingles are counted, by the number of documents; a bucket is heavy if so many deviations over the mean.
COUNT_BITS, HEAVY = (16, 22), 8
#: Shingles of a region that one task settles.
GROUP_SHINGLES = 1_000_000
#: Filters of ids of up to this size are sent to all executors, in so many parts.
SCREEN_BYTES = 64 << 20
SCREEN_SHARDS = 16
#: Pivots of a larger region in the first round; each later round takes twice as many.
PIVOTS = 64
#: Places over which a region's sets are dealt; regions that one set may lie in or near.
SALTS, WINDOWS = 32, 64
#: Stands for a pivot: the region of the sets that are far from all pivots.
REST = -1


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Measure:
    """Words of a shingle, and the threshold as a fraction of whole numbers: link if bottom * common >= top * union."""

    width: int
    top: int
    bottom: int

    def linked(self, common, a, b, times: int = 1):
        """Whether sets of a and b shingles with so many in common are within times * THETA."""
        return self.bottom * common >= (self.bottom - times * (self.bottom - self.top)) * (a + b - common)

    def classes(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least sizes of the classes up to one above largest, their numbers of parts, and how many may be empty."""
        return _classes(self, 1 << max(4, int(largest).bit_length() + 1))


@lru_cache(8)
def _classes(m: Measure, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, least, parts, spare = 1, [], [], []
    while True:
        least.append(low)
        following = max(low + 1, low * 3 // 2, low * m.bottom // m.top + 1)
        differ = 2 * (following - 1) * (m.bottom - m.top) // (m.bottom + m.top)
        # Parts of two linked sets that differ: at most `differ`. More of them are equal than are
        # likely to be empty, so that an equal one with shingles is almost always among them.
        # Of those tried, the first that is so many deviations off, else the one that is farthest off.
        tried = []
        for slack in range(2, max(6, differ + 2)):
            k = differ + slack
            empty = k * np.exp(-(low * m.top / m.bottom) / k)
            tried.append(((slack - empty) / np.sqrt(empty + 0.1), slack))
            if tried[-1][0] >= DEVIATIONS:
                break
        slack = max(tried)[1] if tried[-1][0] < DEVIATIONS else tried[-1][1]
        k = differ + slack
        parts.append(k if differ else 0)
        spare.append(slack)
        if low > largest:
            return np.array(least), np.array(parts), np.array(spare)
        low = following


def factor(k: int) -> np.uint64:
    """The odd factor of a shingle's word k, another one for each."""
    return mix(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)


class Shingler:
    """Shingle sets of many texts as sorted arrays of 64-bit hashes."""

    def __init__(self, measure: Measure):
        self.measure = measure
        self.known: dict[bytes, int] = {}

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts one after the other, and each text's offset."""
        rows = [(t or "").encode().lower().split() for t in texts]  # both only touch ASCII
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = [w for r in rows for w in r]
        words = set(flat)
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        known = self.known
        for w in words - known.keys():
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        coded = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        width = self.measure.width
        counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(rows)), counts)
        begin = np.cumsum(lengths) - lengths
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
        # All runs of `width` words of the whole stretch at once; those that begin at a shingle's first word are kept.
        padded = np.concatenate([coded, np.zeros(width, np.uint64)])
        every = np.zeros(len(coded), np.uint64)
        for k in range(width):
            every += padded[k : k + len(coded)] * factor(k)
        hashes = mix(every)[at]
        for row in np.flatnonzero((lengths > 0) & (lengths < width)):  # a whole short text as one
            value = lengths[row : row + 1].astype(np.uint64)
            for word in coded[begin[row] : begin[row] + lengths[row]]:
                value = mix(value * factor(0) + word)
            hashes[np.searchsorted(owner, row)] = value[0]
        ends = np.cumsum(counts)
        for first, last in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            if last - first > 1:
                hashes[first:last].sort()
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]).astype(np.int64)


def digests(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits for each set; None for empty ones."""
    raw = memoryview(hashes.tobytes())
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64)


def part_keys(m: Measure, hashes: np.ndarray, offsets: np.ndarray, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set number, region) of each region that each set lies in.

    heavy: for each bucket of shingles whether it is frequent. Parts are first made of the
    other shingles alone (linked sets differ in no more of them), so that texts which have
    just a passage in common share no region. A set with too many empty parts then also
    gets the regions of all its shingles; so does each set that shares only empty parts with it.
    """
    sizes = np.diff(offsets)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least, parts, spare = m.classes(int(sizes.max()))
    own = np.searchsorted(least, sizes, "right") - 1
    found = []
    for step in (0, 1):
        cls = own + step
        emits = (sizes > 0) & (parts[cls] > 0)
        if step:
            emits &= sizes * m.bottom // m.top >= least[cls]
        rows = np.flatnonzero(emits)
        if heavy is not None:
            rare = ~heavy[bucket_of(hashes, (len(heavy) - 1).bit_length())]
            ends = np.concatenate([[0], np.cumsum(rare)])[offsets]
            region, owner, empty, count = _regions(hashes[rare], ends, rows, cls[rows], parts)
            found.append((rows[owner[count > 0]], region[count > 0]))
            rows = rows[empty >= spare[cls[rows]]]
        region, owner, empty, count = _regions(hashes, offsets, rows, cls[rows] + 512, parts)
        kept = (count > 0) | (empty >= spare[cls[rows]])[owner]
        found.append((rows[owner[kept]], region[kept]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _regions(hashes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, space: np.ndarray, parts: np.ndarray):
    """Of the sets in rows: each part's region, its owner (a place in rows), each owner's empty parts, each part's shingles."""
    k = parts[space % 512]
    first = np.cumsum(k) - k
    n = np.diff(offsets)[rows]
    at = np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    h = hashes[at]
    cell = np.repeat(first, n) + (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.repeat(k, n).astype(np.uint64)).astype(np.int64)
    cells = int(k.sum())
    held = np.zeros(cells, np.uint64)
    np.add.at(held, cell, mix(h + np.uint64(0x632BE59BD9B4E019)))
    count = np.bincount(cell, minlength=cells)
    owner = np.repeat(np.arange(len(rows)), k)
    number = np.arange(cells) - first[owner]
    region = mix(mix(held + np.uint64(0x9E3779B97F4A7C15) * (count + 1).astype(np.uint64)) + (space[owner] * (1 << 40) + number).astype(np.uint64))
    return region, owner, np.bincount(owner, count == 0, len(rows)), count


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= RUN_CHARS):
            size += len(texts[stop] or "")
            stop += 1
        yield start, stop
        start = stop


def set_table(docs: DataFrame, m: Measure, bits: int) -> DataFrame:
    """doc_id, n_shingles and digest (binary, null for empty sets) of each document; and rows with a bucket, in which n_shingles counts the task's shingles of that bucket."""

    def rows(doc_id, n, digest, bucket):
        return pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), digest, bucket], ["doc_id", "n_shingles", "digest", "bucket"])

    @tidy
    def run(batches):
        shingler, counts = Shingler(m), np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _runs(texts):
                hashes, offsets = shingler.sets(texts[a:b])
                counts += np.bincount(bucket_of(hashes, bits), minlength=1 << bits)
                yield rows(batch.column(0).slice(a, b - a), np.diff(offsets), pa.array(digests(hashes, offsets), pa.binary()), pa.nulls(b - a, pa.int32()))
        full = np.flatnonzero(counts)
        for at in range(0, len(full), 1 << 16):
            part = full[at : at + (1 << 16)]
            yield rows(pa.nulls(len(part), pa.int64()), counts[part], pa.nulls(len(part), pa.binary()), pa.array(part, pa.int32()))

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bucket int")


def heavy_buckets(table: DataFrame, bits: int) -> np.ndarray:
    """The mask of frequent buckets, from counts over all documents (4 million buckets at most)."""
    counts = table.where("bucket is not null").groupBy("bucket").agg(F.sum("n_shingles").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    mask = np.zeros(1 << bits, bool)
    if total:
        # Counts of rare shingles spread like a Poisson variable; frequent ones stand out from them.
        mean = total / (1 << bits)
        mask[[r[0] for r in counts.where(F.col("n") > mean + HEAVY * (mean**0.5 + 1)).select("bucket").collect()]] = True
    return mask


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def region_edges(docs: DataFrame, m: Measure, heavy: np.ndarray) -> DataFrame:
    """a, b: sets (64 bits of their digests) that share a region, each with the first of its region; they may not link.

    A task sends each region once, with the first set that it saw there, and the
    other sets of it as edges to that one; so a region that very many sets share
    moves as a row from each task.
    """

    sent_mask = docs.sparkSession.sparkContext.broadcast(np.packbits(heavy).tobytes())
    buckets = len(heavy)

    @tidy
    def run(batches):
        shingler, mask = Shingler(m), np.unpackbits(np.frombuffer(sent_mask.value, np.uint8))[:buckets].astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _runs(texts):
                hashes, offsets = shingler.sets(texts[a:b])
                rows, region = part_keys(m, hashes, offsets, mask)
                nodes = np.array([_node(d) if d else 0 for d in digests(hashes, offsets)], np.int64)
                held.append((region, nodes[rows]))
                size += len(rows)
                if size >= HELD:
                    yield from _first_of_regions(held)
                    held, size = [], 0
        yield from _first_of_regions(held)

    return _meet(docs.mapInArrow(run, "region bigint, a bigint, b bigint"))


def _first_of_regions(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of (region, set) rows that a task holds: each region once with its first set, and edges from that set to the others."""

    def send(region, node, other):
        return pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(node), pa.array(other)], ["region", "a", "b"])

    if not held:
        return
    region, node = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.lexsort((node, region))
    region, node = region[order], node[order]
    head = np.ones(len(region), bool)
    head[1:] = region[1:] != region[:-1]
    first = node[np.maximum.accumulate(np.where(head, np.arange(len(region)), 0))] if len(region) else node
    for at in range(0, int(head.sum()), 1 << 16):
        r, n = region[head][at : at + (1 << 16)], node[head][at : at + (1 << 16)]
        yield send(r, n, n)
    edge = np.unique(np.stack([first, node], 1)[first != node], axis=0)
    if len(edge):
        yield send(mix(edge[:, 0].copy().view(np.uint64) ^ mix(edge[:, 1].copy().view(np.uint64))), edge[:, 0].copy(), edge[:, 1].copy())


def _meet(rows: DataFrame) -> DataFrame:
    """a, b: the edges that rows (region, a, b) hold, and one from each region's first set to each other set of it."""

    @tidy
    def run(batches):
        last, first = None, None
        for batch in batches:
            region, a, b = (batch.column(i).to_numpy() for i in range(3))
            if not len(region):
                continue
            head = np.ones(len(region), bool)
            head[1:] = region[1:] != region[:-1]
            head[0] = last is None or region[0] != last
            start = np.maximum.accumulate(np.where(head, np.arange(len(region)), -1))
            lead = np.where(start >= 0, a[np.maximum(start, 0)], first if first is not None else 0)
            last, first = region[-1], lead[-1]
            x, y = np.concatenate([lead, a]), np.concatenate([a, b])
            edge = np.unique(np.stack([x, y], 1)[x != y], axis=0)
            if len(edge):
                yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0].copy()), pa.array(edge[:, 1].copy())], ["a", "b"])

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a bigint, b bigint").distinct()


def refined_edges(texts: DataFrame, m: Measure, heavy: np.ndarray) -> DataFrame:
    """Edges within the groups of texts (root, node, text): sets that share one of the shingles that are rarest in their group.

    Linked sets share one of the first n - ceil(t n) + 1 shingles of each, in any order that holds for
    both; here frequent shingles (see heavy) come last and the others by how many sets of the group
    hold them. Sets whose first shingles reach into the frequent ones keep together.
    """
    sent_mask = texts.sparkSession.sparkContext.broadcast(np.packbits(heavy).tobytes())
    buckets = len(heavy)
    names = ["key", "node", "root", "sizes"]

    @tidy
    def shingles(batches):
        shingler, mask = Shingler(m), np.unpackbits(np.frombuffer(sent_mask.value, np.uint8))[:buckets].astype(bool)
        for batch in batches:
            rows = batch.column(2).to_pylist()
            for a, b in _runs(rows):
                hashes, offsets = shingler.sets(rows[a:b])
                root, node = (batch.column(i).to_numpy()[a:b] for i in (0, 1))
                n = np.diff(offsets)
                # A representative's id may stand beside other texts, whose sets are not asked for.
                asked = np.array([d is not None and _node(d) == x for d, x in zip(digests(hashes, offsets), node.tolist(), strict=True)], bool)
                hashes, root, node, n = hashes[np.repeat(asked, n)], root[asked], node[asked], n[asked]
                rare = ~mask[bucket_of(hashes, (buckets - 1).bit_length())]
                owner = np.repeat(np.arange(len(n)), n)[rare]
                key = mix(hashes[rare] ^ mix(root.view(np.uint64))[owner]).view(np.int64)
                none = np.zeros(len(key), np.int64)
                sizes = (n << 32) | np.bincount(owner, minlength=len(n))
                for x, y, z, w in ((key, node[owner], none, none), (mix(node.view(np.uint64)).view(np.int64), node, root, sizes)):
                    for at in range(0, len(x), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (x, y, z, w)], names)

    @tidy
    def shared(batches):
        """Rows sorted by key: those that stand alone go; df beside the others, -1 beside the rows with the sizes."""
        held: list[np.ndarray] = []

        def out(c):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in c], ["node", "df", "key", "root", "sizes"])

        def told(c):
            key, node, root, sizes = c
            info = sizes > 0
            cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            df = np.repeat(np.diff(np.append(cuts, len(key))), np.diff(np.append(cuts, len(key))))
            kept = info | (df > 1)
            return out([node[kept], np.where(info, -1, df)[kept], key[kept], root[kept], sizes[kept]])

        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            held = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)] if held else now
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            if cut:
                yield told([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield told(held)

    @tidy
    def first(batches):
        """Rows sorted by set, df and key, the one with the sizes ahead: the regions of each set's rarest shingles."""
        rows: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def regions(c):
            node, df, key, root, sizes = c
            cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            count = np.diff(np.append(cuts, len(node))) - 1
            n, rare = sizes[cuts] >> 32, sizes[cuts] & 0xFFFFFFFF
            prefix = n + (-n * m.top) // m.bottom + 1  # n - ceil(t n) + 1
            wanted = prefix - (rare - count)
            place = np.arange(len(node)) - np.repeat(cuts, count + 1)
            kept = (place > 0) & (place <= np.repeat(wanted, count + 1))
            deep = prefix > rare
            together = mix(root[cuts][deep].view(np.uint64) ^ np.uint64(0xC2B2AE3D27D4EB4F))
            return np.concatenate([key[kept].view(np.uint64), together]), np.concatenate([node[kept], node[cuts][deep]])

        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(5)]
            rows = [np.concatenate([x, y]) for x, y in zip(rows, now, strict=True)] if rows else now
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                found.append(regions([c[:cut] for c in rows]))
                held += len(found[-1][0])
                rows = [c[cut:] for c in rows]
                if held >= HELD:
                    yield from _first_of_regions(found)
                    found, held = [], 0
        if rows and len(rows[0]):
            found.append(regions(rows))
        yield from _first_of_regions(found)

    sent = texts.mapInArrow(shingles, "key bigint, node bigint, root bigint, sizes bigint")
    counted = sent.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "node bigint, df bigint, key bigint, root bigint, sizes bigint")
    return _meet(counted.repartition("node").sortWithinPartitions("node", "df", "key").mapInArrow(first, "region bigint, a bigint, b bigint"))


class Group:
    """Sets of one group, with an index from shingle to sets."""

    def __init__(self, m: Measure, sets: list[np.ndarray]):
        self.m, self.n = m, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, self.ids = np.unique(flat, return_inverse=True)
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])
        self.df = np.bincount(self.ids)
        order = np.argsort(self.ids, kind="stable")
        self.postings = np.repeat(np.arange(len(sets)), self.n)[order]
        self.starts = np.concatenate([[0], np.cumsum(self.df)])

    def near(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """The other sets within 2 THETA of set p, and whether they link to it.

        A set as near as that holds one of any n - ceil(t n) + 1 shingles of p; the rarest are asked.
        """
        m, n = self.m, int(self.n[p])
        own = self.ids[self.offsets[p] : self.offsets[p + 1]]
        t = m.bottom - 2 * (m.bottom - m.top)
        if t <= 0:
            candidates = np.arange(len(self.n))
        else:
            rare = own[np.argsort(self.df[own], kind="stable")[: n - -(-t * n // m.bottom) + 1]]
            candidates = np.unique(np.concatenate([self.postings[self.starts[s] : self.starts[s + 1]] for s in rare.tolist()]))
        candidates = candidates[(candidates != p) & (self.n[candidates] * m.bottom >= t * n) & (n * m.bottom >= t * self.n[candidates])]
        if not len(candidates):
            return candidates, np.empty(0, bool)
        inside = np.zeros(len(self.df), bool)
        inside[own] = True
        n_c = self.n[candidates]
        first = np.cumsum(n_c) - n_c
        at = np.repeat(self.offsets[candidates] - first, n_c) + np.arange(int(n_c.sum()))
        common = np.add.reduceat(inside[self.ids[at]].astype(np.int64), first)
        close = m.linked(common, n, n_c, 2)
        return candidates[close], m.linked(common, n, n_c)[close]


def settle(m: Measure, sets: list[np.ndarray]) -> np.ndarray:
    """The component (its smallest set number) of each set of a group."""
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, 0 if m.linked(common, len(sets[0]), len(sets[1])) else 1])
    group, parent = Group(m, sets), list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pivots_near: list[list[int]] = [[] for _ in sets]
    balls, done = [False] * len(sets), [False] * len(sets)
    waiting = list(range(len(sets)))
    while waiting:
        for p in waiting:
            if done[p] or (balls[p] and all(find(q) == find(p) for q in pivots_near[p])):
                continue
            done[p] = True
            others, linked = group.near(p)
            for x, link in zip(others.tolist(), linked.tolist(), strict=True):
                pivots_near[x].append(p)
                if link:
                    balls[x] = balls[p] = True
                    a, b = find(x), find(p)
                    parent[max(a, b)] = min(a, b)
        waiting = [x for x in range(len(sets)) if not done[x] and not (balls[x] and all(find(q) == find(x) for q in pivots_near[x]))]
    return np.array([find(x) for x in range(len(sets))])


def _texts(docs: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of chosen, and the text of each of its representatives; the same join at every size."""
    return _screened(docs, chosen).join(chosen.hint("merge"), F.col("doc_id") == F.col("rep")).select(*columns, "text")


def _screened(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """docs, less most of those that are not in chosen (rep): so that few texts move in the join that follows.

    A cuckoo filter of the ids is sent to all executors, if it is small enough; else nothing is left out here.
    """
    ids = chosen.select("rep").where("rep is not null").distinct()
    if ids.count() * 4 > SCREEN_BYTES:
        return docs
    shards = ids.select(F.pmod(F.xxhash64("rep"), F.lit(SCREEN_SHARDS)).cast("int").alias("shard"), "rep").groupBy("shard").applyInArrow(lambda t: pa.table({"shard": t.column("shard").slice(0, 1), "cells": pa.array([build(_id_hash(t.column("rep").to_numpy())).dumps()], pa.binary())}), "shard int, cells binary")
    sent = docs.sparkSession.sparkContext.broadcast([r["cells"] for r in shards.collect()])

    @tidy
    def run(batches):
        filters = [CuckooFilter.loads(c) for c in sent.value]
        for batch in batches:
            hashes = _id_hash(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            hit = np.zeros(batch.num_rows, bool)
            for f in filters:
                hit |= f.contains(hashes)
            yield batch.filter(pa.array(hit))

    return docs.mapInArrow(run, docs.schema)


def _id_hash(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _candidate_sets(docs: DataFrame, chosen: DataFrame, m: Measure) -> DataFrame:
    """root, digest, rep and hashes (binary) of the representatives in chosen (rep, root, digest).

    Rows with a representative's id and another text are left out.
    """
    texts = _texts(docs, chosen, ["root", "digest", "rep"])

    @tidy
    def run(batches):
        shingler = Shingler(m)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in _runs(texts):
                hashes, offsets = shingler.sets(texts[a:b])
                raw = [hashes[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                asked = pa.array([x == y for x, y in zip(digests(hashes, offsets), batch.column(1).slice(a, b - a).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(raw, pa.binary())], ["root", "digest", "rep", "hashes"]).filter(asked)

    return texts.mapInArrow(run, "root bigint, digest binary, rep bigint, hashes binary")


def _settle_small(sets: DataFrame, m: Measure) -> DataFrame:
    """digest and component_id; the rows of a group come one after the other."""

    def one(rows):
        # A representative's row may be repeated; a set counts once.
        own = {d: (rep, np.frombuffer(h, np.uint64)) for _, d, rep, h in rows}
        if len(own) < 2:
            return []
        reps = np.array([rep for rep, _ in own.values()])
        found = settle(m, [s for _, s in own.values()])
        least = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(least, found, reps)
        return list(zip(own, least[found].tolist(), strict=True))

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["digest", "component_id"])

    @tidy
    def run(batches):
        held, ready = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    ready += one(held)
                    held = []
                    if len(ready) > 4096:
                        yield out(ready)
                        ready = []
                held.append(row)
        yield out(ready + (one(held) if held else []))

    return sets.repartition("root").sortWithinPartitions("root").mapInArrow(run, "digest binary, component_id bigint")


NEAR = "array<struct<pivot:bigint,linked:boolean>>"


def _to_pivots(rows: DataFrame, chosen: DataFrame, m: Measure) -> DataFrame:
    """rows (region, digest, node, hashes, near, done) with home, the nearest pivot, and windows, the pivots whose regions the set lies in or near.

    A set whose nearest pivot is so far that its window would reach pivots which share no shingle with it
    belongs to the rest, a region of its own; sets not more than THETA nearer lie there too, as what links
    to a set is at most THETA nearer to any pivot. near gains the pivots within 2 THETA, done is true for those that were pivots. A region's sets are
    dealt over SALTS places, to each of which its pivots go ahead of them, so that a region of any size is
    spread; a task holds one region's pivots at a time, under an index from shingle to pivot.
    """
    own = ["region", "salt", "pivot", "digest", "node", "hashes", "near", "done"]
    sent = chosen.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), "pivot": F.lit(True)}).select(own)
    dealt = rows.withColumns({"salt": F.pmod(F.col("node"), F.lit(SALTS)).cast("int"), "pivot": F.lit(False)}).select(own)
    met = sent.unionByName(dealt).repartition("region", "salt").sortWithinPartitions("region", "salt", ~F.col("pivot"))
    theta = (m.bottom - m.top) / m.bottom
    far = 1 - 2 * theta - 1e-6
    schema = f"region bigint, digest binary, node bigint, hashes binary, near {NEAR}, done boolean, home bigint, windows array<bigint>, n_windows bigint"
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.struct([("pivot", pa.int64()), ("linked", pa.bool_())])), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.int64()]

    @tidy
    def run(batches):
        place, ahead, index = None, [], None
        for batch in slices(batches, own.index("hashes")):
            out = []
            for region, salt, pivot, digest, node, raw, near, done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (region, salt):
                    place, ahead, index = (region, salt), [], None
                if pivot:
                    ahead.append((node, np.frombuffer(raw, np.uint64)))
                    continue
                if index is None:
                    index = Pivots(ahead)
                common, size = index.common(hashes := np.frombuffer(raw, np.uint64)), len(hashes)
                if not len(index.nodes):  # none was drawn here: the set waits for the next round
                    out.append((region, digest, node, raw, near, done, None, [], WINDOWS + 1))
                    continue
                distance = 1 - common / (size + index.sizes - common)
                itself = index.nodes == node
                close = np.flatnonzero(m.linked(common, size, index.sizes, 2) & ~itself)
                linked = m.linked(common[close], size, index.sizes[close])
                near = [*near, *({"pivot": p, "linked": x} for p, x in zip(index.nodes[close].tolist(), linked.tolist(), strict=True))]
                least = distance.min()
                # Beyond `far` a window would hold the pivots that share nothing with the set: such sets are the rest's.
                window = index.nodes[distance <= least + 2 * theta + 1e-9].tolist() if least <= far else []
                window += [REST] if least > far - theta - 1e-9 else []
                home = int(index.nodes[np.argmin(distance)]) if least <= far else REST
                out.append((region, digest, node, raw, near, done or bool(itself.any()), home, window if len(window) <= WINDOWS else [], len(window)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=pa.schema(list(zip([x.split()[0] for x in schema.split(", ")], kinds, strict=True))))

    return met.mapInArrow(run, schema)


class Pivots:
    """The pivots of a region under an index from shingle to pivots."""

    def __init__(self, pivots: list[tuple[int, np.ndarray]]):
        self.nodes = np.array([n for n, _ in pivots], np.int64)
        self.sizes = np.array([len(s) for _, s in pivots], np.int64)
        flat = np.concatenate([s for _, s in pivots]) if pivots else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owner = flat[order], np.repeat(np.arange(len(pivots)), self.sizes)[order]

    def common(self, hashes: np.ndarray) -> np.ndarray:
        """How many shingles a set has in common with each pivot."""
        first, last = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[at], minlength=len(self.nodes))


def _settle_large(sets: DataFrame, m: Measure, leaf: int, pivots: int) -> DataFrame:
    """digest and component_id of groups that no task should hold, by recursion over the cluster.

    Each region gets pivots, drawn from its sets; every set of it goes to the region of the nearest one and
    to those that its window reaches. A region in which every set is settled is done, one that a task can
    hold is settled there, the others get pivots of their own. Where windows reach so far that
    regions would overlap more than twofold, the region stays whole for a round with twice the pivots.
    """
    sets = durable(sets.dropDuplicates(["digest"]).withColumn("node", F.xxhash64("digest")), "jaccard-large")
    rows = sets.select(F.col("root").alias("region"), "digest", "node", "hashes", F.array().cast(NEAR).alias("near"), F.lit(False).alias("done"))
    links, leaves, level = None, None, 0
    while True:
        sizes = rows.groupBy("region").agg(F.sum(F.octet_length("hashes") / 8).alias("shingles"), F.count(F.when(~F.col("done"), 1)).alias("open"))
        sizes = durable(sizes, "jaccard-regions")
        fits = sizes.where(F.col("shingles") <= leaf).select("region")
        own = rows.join(fits, "region", "left_semi").select(F.col("region").alias("root"), "digest", F.col("node").alias("rep"), "hashes")
        leaves = durable(own, "jaccard-leaves") if leaves is None else leaves.unionByName(durable(own, "jaccard-leaves"))
        large = rows.join(sizes.where(F.col("shingles") > leaf).select("region", "open"), "region")
        # So many of the sets that have not been pivots, by a draw; all of them if they are few.
        wanted = F.lit(pivots << min(level, 8))
        drawn = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) < wanted * F.lit(float(1 << 30)) / F.col("open")
        large = durable(large, "jaccard-rows")
        if large.isEmpty():
            break
        found = durable(_to_pivots(large.drop("open"), large.where(~F.col("done") & drawn).drop("open"), m), "jaccard-found")
        discard(large)
        near = found.select("region", "node", "done", F.explode("near").alias("p")).select("region", "node", F.col("p.pivot").alias("pivot"), F.col("p.linked").alias("linked"))
        fresh = durable(near.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "jaccard-links")
        links = fresh if links is None else links.unionByName(fresh)
        labels = durable(components(links).withColumnRenamed("root", "own"), "jaccard-labels")
        other = labels.select(F.col("node").alias("pivot"), F.col("own").alias("theirs"))
        told = near.join(labels, "node").join(other, "pivot").groupBy("region", "node").agg(F.max("linked").alias("ball"), F.min(F.col("own") == F.col("theirs")).alias("alone"))
        settled = told.where("ball and alone").select("region", "node")
        waiting = durable(found.where("not done").select("region", "node", "home").join(settled, ["region", "node"], "left_anti"), "jaccard-waiting")
        apart = found.groupBy("region").agg(F.sum("n_windows").alias("w"), F.count(F.lit(1)).alias("n"), F.max("n_windows").alias("most"))
        apart = apart.where((F.col("w") <= 2 * F.col("n")) & (F.col("most") <= WINDOWS)).select("region")
        kept = ["digest", "node", "hashes", "near", "done"]
        whole = found.join(waiting.select("region").distinct(), "region", "left_semi").join(apart, "region", "left_anti").select("region", *kept)
        inside = lambda pivot: F.xxhash64("region", pivot)
        homes = waiting.join(apart, "region", "left_semi").select(inside("home").alias("region")).distinct()
        parted = found.join(apart, "region", "left_semi").select("region", F.explode("windows").alias("pivot"), *kept).select(inside("pivot").alias("region"), *kept).join(homes, "region", "left_semi")
        rows = durable(whole.unionByName(parted), "jaccard-rows")
        for step in (found, waiting, labels, sizes):
            discard(step)
        level += 1
    # A leaf's components, each as edges from its sets to the smallest node among them.
    within = _settle_small(leaves, m).select(F.xxhash64("digest").alias("a"), F.col("component_id").alias("b"))
    edges = within if links is None else within.unionByName(links)
    labels = durable(sets.select("digest", "node", "rep").join(components(edges), "node", "left").select("digest", "rep", F.coalesce("root", "node").alias("component")), "jaccard-labels")
    least = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
    return labels.join(least, "component").select("digest", "component_id")


def jaccard_components(docs: DataFrame, width: int, top: int, bottom: int = 100, group_shingles: int = GROUP_SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles and component_id of each document; sets link if bottom * common >= top * union."""
    m = Measure(width, top, bottom)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low, high = COUNT_BITS
    bits = max(low, min(high, (docs.count() // 4).bit_length()))
    both = durable(set_table(docs, m, bits), "jaccard-sets")
    table = both.where("bucket is null").drop("bucket")
    points = table.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    heavy = heavy_buckets(both, bits)
    groups = components(region_edges(docs, m, heavy), "jaccard-groups")
    every = member = durable(_with_node(points).join(groups, "node"), "jaccard-members")
    sized = lambda rows: rows.groupBy("root").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    # Groups of more than a pair are parted first by the shingles that are rare in them.
    big = durable(member.join(sized(member).where("sets > 2"), "root", "left_semi"), "jaccard-big")
    finer = components(refined_edges(_texts(docs, big, ["root", "node"]), m, heavy), "jaccard-finer")
    parted = big.drop("root").join(finer, "node").select(member.columns)
    member = durable(member.join(big.select("root").distinct(), "root", "left_anti").unionByName(parted), "jaccard-parted")
    sizes = durable(sized(member), "jaccard-sizes")
    large = F.col("shingles") > group_shingles
    labels = _settle_small(_candidate_sets(docs, member.join(sizes.where(~large), "root", "left_semi"), m), m)
    if not sizes.where(large).isEmpty():
        labels = labels.unionByName(_settle_large(_candidate_sets(docs, member.join(sizes.where(large), "root", "left_semi"), m), m, group_shingles, pivots))
    # Written first, so that the join below has a plain exchange on either side, which Spark can split where a set has very many copies.
    label = durable(points.join(labels, "digest", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id")), "jaccard-labelled")
    for step in (groups, every, big, finer, member, sizes):  # nothing reads them any more
        discard(step)
    out = table.join(label.hint("merge"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_node(points: DataFrame) -> DataFrame:
    """points with node: the first eight bytes of the digest as _node() reads them."""
    turned = F.reverse(F.hex(F.substring("digest", 1, 8)))
    # Reversing the hex digits also turns each byte's two digits round; swap them back.
    swapped = F.regexp_replace(turned, "(.)(.)", "$2$1")
    return points.withColumn("node", F.conv(swapped, 16, -10).cast("bigint"))
