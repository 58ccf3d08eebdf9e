"""SimHash near-duplicate classes, found by covering the fingerprint space with anchors.

The 64 bits of a fingerprint are cut into blocks of three bits and single bits.
A block of three is covered by the code {000, 111} (covering radius 1: the
nearest word is the majority), a single bit by itself (radius 0). Anchors are
the words of the product code. If two fingerprints differ in at most t bits,
some point z lies within ceil(t/2) bits of both, and both are within reach of
the anchor of z. So each fingerprint is replicated to every anchor that holds a
point within ceil(t/2) of it - all of them lie inside the covering radius plus
the threshold - and is compared per anchor only. No pair can be missed.

More blocks of three mean fewer anchors and fewer replicas; the layout follows
the number of distinct fingerprints so that an anchor holds a few of them.

Inside an anchor no pairs are written: what leaves a task are the links from
each fingerprint to the first of its local class, which keep all connections.
A crowded anchor is resolved without comparing pairs, by sorting the points
within reach of its fingerprints.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, carry, materialize, pick, shuffle_partitions, tidy, unpack
from .components import connected_components

BITS = 64
SEED = 42
#: Fingerprints that differ in at most so many bits are linked.
MAX_BITS = 2
#: Up to so many fingerprints of an anchor are compared pair by pair.
PAIRWISE = 256


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of a text's word shingles, repeats included.

    A-Z are lowered; a text with fewer words is one shingle, one without words
    has fingerprint 0.
    """
    import xxhash

    h = xxhash.xxh64_intdigest
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < width:
        return h(b" ".join(w), seed)
    count, total = np.zeros(BITS, np.int64), len(w) - width + 1
    for at in range(0, total, 1 << 16):
        part = w[at : at + (1 << 16) + width - 1]
        hashes = np.fromiter((h(b" ".join(s), seed) for s in zip(*(part[i:] for i in range(width)))), ">u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row, nulls included."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class AnchorCode:
    """The product code: `triples` blocks of three bits, then single bits."""

    def __init__(self, triples: int, bits: int = BITS):
        self.triples, self.bits = triples, bits
        self.singles = bits - 3 * triples

    @classmethod
    def for_count(cls, n: int, bits: int = BITS) -> AnchorCode:
        """A few fingerprints to an anchor if they were spread evenly: bits - 2 * triples >= log2(n)."""
        return cls(max(0, min(bits // 3, (bits - math.ceil(math.log2(max(n, 2)))) // 2)), bits)

    def anchor(self, fp: np.ndarray) -> np.ndarray:
        """The anchor whose cell holds each fingerprint, packed into 64 bits."""
        out = fp >> np.uint64(3 * self.triples) if self.triples < 22 else np.zeros_like(fp)
        one, three = np.uint64(1), np.uint64(7)
        for i in range(self.triples):
            block = (fp >> np.uint64(3 * i)) & three
            major = ((block & (block >> one)) | (block & (block >> np.uint64(2))) | ((block >> one) & (block >> np.uint64(2)))) & one
            out = (out << one) | major
        return out

    def replicas(self, fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of fingerprint, anchor), each once: anchors with a point within reach bits."""
        idx, anchors = [], []
        for n in range(reach + 1):
            for flips in itertools.combinations(range(self.bits), n):
                mask = np.uint64(sum(1 << b for b in flips))
                anchors.append(self.anchor(fp ^ mask))
                idx.append(np.arange(len(fp)))
        idx, anchors = np.concatenate(idx), np.concatenate(anchors)
        order = np.lexsort((anchors, idx))
        idx, anchors = idx[order], anchors[order]
        new = np.ones(len(idx), bool)
        new[1:] = (idx[1:] != idx[:-1]) | (anchors[1:] != anchors[:-1])
        return idx[new], anchors[new]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's class under links a-b, by repeated least labels and pointer jumps."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _hubs(root: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each node the one of its class with the least rep: a crowd has the same hub at most of its anchors."""
    order = np.lexsort((rep, root))
    head = np.flatnonzero(np.diff(root[order], prepend=-1))
    out = np.empty(len(root), np.int64)
    out[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    return out


def _links_of_group(fp: np.ndarray, bits: int, width: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links whose classes are those of all pairs within `bits` bits; at most a row per reachable point."""
    n = len(fp)
    if n <= PAIRWISE:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        return i[near], j[near]
    # pairs within 2 * (bits // 2) meet at a point within bits // 2 of both; an odd bit more: one of them goes a bit further
    half, rest = bits // 2, bits - bits // 2
    idx, point, far = [], [], []
    for k in range(rest + 1):
        for flips in itertools.combinations(range(width), k):
            point.append(fp ^ np.uint64(sum(1 << b for b in flips)))
            idx.append(np.arange(n))
            far.append(np.full(n, k > half))
    idx, point, far = np.concatenate(idx), np.concatenate(point), np.concatenate(far)
    order = np.lexsort((far, point))
    idx, point, far = idx[order], point[order], far[order]
    head = np.ones(len(idx), bool)
    head[1:] = point[1:] != point[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(idx)), 0))
    # a point's near ones are linked to each other; its far ones to a near one, if there is one
    keep = ~head & ~far[first]
    return idx[first[keep]], idx[keep]


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> links between representatives; holds one batch and one anchor at a time."""
    kept = None

    def links(anchor, fp, rep):
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(anchor)))
        out = []
        small = (size > 1) & (size <= 16)
        # small anchors together: the k-th row of each against the row d places on
        first = np.repeat(start, size)
        end = np.repeat(start + size, size)
        rows = np.flatnonzero(np.repeat(small, size))
        for d in range(1, 16):
            i = rows[rows + d < end[rows]]
            if not len(i):
                break
            near = np.bitwise_count(fp[i] ^ fp[i + d]) <= bits
            out.append((i[near], i[near] + d))
        del first
        for s, n in zip(start[size > 16], size[size > 16]):
            a, b = _links_of_group(fp[s : s + n], bits)
            hub = _hubs(_roots(n, a, b), rep[s : s + n])
            moved = np.flatnonzero(hub != np.arange(n))
            out.append((s + hub[moved], s + moved))
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([rep[a], rep[b]], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for b in batches:
        cols = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        whole = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        if whole:
            yield links(*(c[:whole] for c in cols))
        kept = [c[whole:] for c in cols]
    if kept is not None and len(kept[0]):
        yield links(*kept)


def near_links(fps: DataFrame, bits: int = MAX_BITS, n: int | None = None) -> DataFrame:
    """fps (fp, rep: one row per distinct fingerprint) -> links (u, v) between reps.

    Their connected components are those of all pairs of fingerprints within `bits` bits.
    """
    spark = fps.sparkSession
    code = AnchorCode.for_count(fps.count() if n is None else n)
    reach = (bits + 1) // 2

    def spread(batches):
        for b in batches:
            fp, rep = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for at in range(0, len(fp), 4096):
                idx, anchor = code.replicas(fp[at : at + 4096], reach)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[at:][idx].view(np.int64)), pa.array(rep[at:][idx])], names=["anchor", "fp", "rep"])

    placed = fps.select("fp", "rep").mapInArrow(spread, "anchor long, fp long, rep long")
    grouped = placed.repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "fp")
    return grouped.mapInArrow(lambda it: _compare(it, bits), "u long, v long")


def simhash_classes(docs: DataFrame, text: str = "text", width: int = 3, bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id reachable over links of at most `bits` bits).

    Empty and null texts have fingerprint 0 and are linked like any other.
    Copies share a fingerprint, which enters the search once with its least
    doc_id; equal rows give equal rows. A null doc_id takes part but is never
    the least, unless its whole class has none. An empty table gives no rows.
    """
    all_fp = materialize(fingerprints(docs, text, width, seed), "simhash")
    reps = materialize(all_fp.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "simhash-distinct")
    parts = connected_components(near_links(reps, bits))
    named = reps.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    return all_fp.join(named, F.col("fp") == F.col("__fp"), "left").select("doc_id", "fp", "component_id")


#: Near-duplicates of whole documents: words in a shingle, least similarity of shingle sets,
#: pieces of the long fingerprint, and the bits of all of them in which candidates may differ
#: (at similarity 0.8 about 57 of 384, with a deviation of 7).
SHINGLE, SIMILARITY, PIECES, PIECE_BITS, FAR_BITS = 5, 0.8, 12, 32, 88


def _shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order; a shorter text is one shingle, one without words the empty one."""
    import xxhash

    h = xxhash.xxh64_intdigest
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < width:
        return np.array([h(b" ".join(w), seed)], np.uint64)
    return np.fromiter((h(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(width)))), np.uint64)


def _sketched(text: str | None, width: int, seed: int) -> np.ndarray:
    """The shingles that a text's long fingerprint is made of: each once, for sets decide."""
    return np.unique(_shingle_hashes(text, width, seed))


def _long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """384 majority bits as 12 pieces of 32: four words of bits are mixed from each hash."""
    out = []
    for k in range(PIECES * PIECE_BITS // 64):
        count = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            x = hashes[at : at + (1 << 16)] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            count += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u4"))
    return np.concatenate(out).astype(np.int64)


def _piece_links(reps: DataFrame, bits: int) -> DataFrame:
    """reps (rep, pieces) -> links (u, v), u < v, each once, between reps that some piece connects within `bits` bits."""
    spark = reps.sparkSession
    code = AnchorCode.for_count(reps.count(), PIECE_BITS)
    reach = (bits + 1) // 2

    def spread(batches):
        for b in batches:
            rep = b.column(0).to_numpy()
            pieces = b.column(1).values.to_numpy().reshape(-1, PIECES)
            for at in range(0, len(rep), 4096):
                for p in range(PIECES):
                    fp = pieces[at : at + 4096, p].astype(np.uint64)
                    idx, anchor = code.replicas(fp, reach)
                    key = anchor | np.uint64(p << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[idx].view(np.int64)), pa.array(rep[at : at + 4096][idx])], names=["anchor", "fp", "rep"])

    placed = reps.select("rep", "pieces").mapInArrow(spread, "anchor long, fp long, rep long")
    grouped = placed.repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor", "fp", "rep")
    links = grouped.mapInArrow(tidy(lambda it: _compare(it, bits)), "u long, v long").where("u <> v")
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


#: The exact search: of the documents one in so many is looked at for common shingles, the most of these that are kept,
#: how many documents make a shingle hot, the rows of a group that are compared with each other, and the rows of a
#: bucket's largest class in one part. They set the order of work, never which pairs are found.
LOOK, COMMON, HOT, SMALL, PART = 32, 200_000, 1000, 16, 4000

#: Rows of a bucket are compared about so many pairs at a time.
TOGETHER = 1 << 18

#: Min-hashes in a band, and the chance at most that a pair at the least similarity shares no band.
BAND, MISS = 6, 1e-12


def _common_shingles(rows: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, and about how many do; from one document in LOOK of a large table."""
    share = LOOK if rows.count() > 10_000 else 1
    some = rows.where(F.pmod(F.xxhash64("doc_id", "stamp"), F.lit(share)) == 0).select("text")

    def each(batches):
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_shingle_hashes(t.as_py(), width, seed)).view(np.int64))], names=["h"])

    seen = some.mapInArrow(each, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    found = seen.orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("c").to_numpy()[order] * share


def _times(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """About how many documents hold each shingle; 0 for those that are not common."""
    if not len(common[0]):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
    return np.where(common[0][at] == h, common[1][at], 0)


def _head(h: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's shingles, rare ones before common ones: two sets that are similar enough share one of them."""
    least = max(1, math.ceil(similarity * len(h) - 1e-9))
    return h[np.lexsort((h, _times(h, common)))[: len(h) - least + 1]]


def _parity(h: np.ndarray) -> np.ndarray:
    """1,024 bits: whether an odd number of a set's shingles falls on each. Two sets differ in at least as many shingles as bits."""
    odd = np.bincount((h >> np.uint64(7) & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first two columns -> columns of whole groups, about a batch at a time; lists of longs become rows of a matrix."""
    kept = None
    for b in batches:
        cols = [c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy() for c in b.columns]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        if not len(cols[0]):
            continue
        whole = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
        if whole:
            yield [c[:whole] for c in cols]
        kept = [c[whole:] for c in cols]
    if kept is not None and len(kept[0]):
        yield kept


def _bounds(h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group starts, and its size."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(h)))


def _may_match(i, j, cls, n, at, similarity: float) -> np.ndarray:
    """Pairs of unlike classes that can be similar, if this is the first shingle they share.

    The shingles from this one on must be enough in either set; sizes that are too unlike fail that too.
    """
    left = np.minimum(n[i] - at[i], n[j] - at[j])
    return (cls[i] != cls[j]) & (left * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6)


def _pairs(rep: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Pairs of reps, the lesser first, each once."""
    if not out:
        return np.zeros((0, 2), np.int64)
    a, b = (rep[np.concatenate(x)] for x in zip(*out))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


#: What the documents of one shingle give: the pairs of a small group, or the rows of a crowd.
MET = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("rep", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])


def _meet(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle and heat -> pairs that can be similar from small groups, and the rows of crowds of unlike classes, hot ones too, as they are."""

    def made(count, /, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(count, f.type) for f in MET], schema=MET)

    for h, hot, rep, cls, n, at in _groups(batches):
        start, size = _bounds(h, hot)
        mixed = np.minimum.reduceat(cls, start) != np.maximum.reduceat(cls, start)
        out = []
        end = np.repeat(start + size, size)
        rows = np.flatnonzero(np.repeat(mixed & (size <= SMALL), size) & (hot == 0))
        for d in range(1, SMALL):
            rows = rows[rows + d < end[rows]]
            if not len(rows):
                break
            ok = _may_match(rows, rows + d, cls, n, at, similarity)
            out.append((rows[ok], rows[ok] + d))
        both = _pairs(rep, out)
        yield made(len(both), u=both[:, 0], v=both[:, 1])
        k = np.flatnonzero(np.repeat(mixed & (size > SMALL), size) | (hot == 1))
        yield made(len(k), rep=rep[k], cls=cls[k], n=n[k], at=at[k])


def _bands(h: np.ndarray, similarity: float, seed: int) -> np.ndarray:
    """A set's bands of min-hashes: so many that a pair at the least similarity shares none with chance MISS at most."""
    count = max(1, math.ceil(math.log(MISS) / math.log1p(-min(similarity**BAND, 1 - 1e-9))))
    rng = np.random.default_rng(seed)
    flip, times = rng.integers(0, 1 << 64, (2, count * BAND), np.uint64)
    least = np.full(count * BAND, ~np.uint64(0))
    for x in range(0, len(h), 1024):
        mixed = (h[x : x + 1024, None] ^ flip) * (times | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(axis=0))
    key = np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND):
        key = (key ^ least[k::BAND]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _meet_buckets(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by band and part -> pairs of unlike classes that sizes, places and parities (if there) allow, and the bits `apart`.

    Each row that is not of the bucket's largest class looks up the sizes that
    it can be similar to; the largest class is never compared with itself.
    `left` is how many shingles are not before the first that a crowd shares.
    Only pairs that can be similar leave a task: near copies of one text that
    are just too unlike share bands, and would make a square of rows.
    """
    for key, part, lead, rep, cls, n, left, *parity in _groups(batches):
        start, size = _bounds(key, part)
        of = np.repeat(np.arange(len(start)), size)
        order = np.lexsort((n, of))
        part, lead, rep, cls, n, left, *parity = (c[order] for c in (part, lead, rep, cls, n, left, *parity))
        n = n.astype(np.int64)
        most = np.floor(left * (1 + similarity) / similarity - n + 1e-6).astype(np.int64)  # the largest set that each can be similar to
        place = (of << 32) + n
        x = np.flatnonzero(lead == 0)
        lo = np.searchsorted(place, (of[x] << 32) + np.ceil(similarity * n[x] - 1e-6).astype(np.int64), "left")
        hi = np.searchsorted(place, (of[x] << 32) + np.clip(most[x], 0, np.floor(n[x] / similarity + 1e-6).astype(np.int64)), "right")
        many = np.maximum(hi - lo, 0)
        upto = np.cumsum(many)
        at = 0
        while at < len(x):
            # so many comparisons at a time
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, "right")))
            i = np.repeat(x[at:to], many[at:to])
            j = np.arange(len(i)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to]) + np.repeat(lo[at:to], many[at:to])
            # two that are both not of the largest class meet in the first part only, or in those below it
            ok = (cls[i] != cls[j]) & (n[i] <= most[j]) & ((lead[j] == 1) | (part[i] <= 0))
            i, j = i[ok], j[ok]
            apart = np.zeros(len(i), np.int64)
            for p in parity:
                # of signed numbers bitwise_count takes the absolute value
                for bits in p.view(np.uint64).T:
                    apart += np.bitwise_count(bits[i] ^ bits[j])
                near = apart * (1 + similarity) <= (n[i] + n[j]) * (1 - similarity) + 1e-6
                i, j, apart = i[near], j[near], apart[near]
            both = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), apart], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(both[:, 2], pa.int32())], names=["u", "v", "apart"])
            at = to


def _crowd_pairs(crowd: DataFrame, rows: DataFrame, reps: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """crowd (rep, cls, n, left, parity) -> pairs (u, v) of unlike classes whose sets share a band of min-hashes and can be similar, and the bits `apart`.

    A bucket's largest class is dealt over parts; the rows of others go to each
    of these. Where these are many they are cut into blocks: each block has
    parts of its own with the largest class, and one with each block. So no
    task gets a whole hot bucket.
    """
    spark = rows.sparkSession

    def banded(batches):
        for b in (whole.slice(x, 512) for whole in batches for x in range(0, whole.num_rows, 512)):
            found = [_bands(_sketched(t.as_py(), width, seed), similarity, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["rep", "keys"])

    parities, crowd = crowd.select("rep", "parity"), crowd.drop("parity")
    need = crowd.select("rep").join(reps.select(F.col("same").alias("rep"), F.col("doc_id").alias("__d"), F.col("stamp").alias("__s")), "rep")
    need = bounded(materialize(need, "near-crowd-texts"))
    texts = rows.join(need, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("stamp") == F.col("__s"))).select("rep", "text").dropDuplicates(["rep"])
    bands = texts.mapInArrow(tidy(banded), "rep long, keys array<long>").join(crowd, "rep")
    keyed = materialize(bands.select(F.explode("keys").alias("key"), "rep", "cls", "n", "left"), "near-bands")
    classes = keyed.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("c"))
    mixed = classes.groupBy("key").agg(F.max_by("cls", F.struct("c", "cls")).alias("most"), F.max("c").alias("c"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("unlike")).where("unlike > 1")
    parts, blocks = F.ceil(F.col("c") / PART).cast("int"), F.ceil((F.col("all") - F.col("c")) / PART).cast("int")
    leads = F.col("cls") == F.col("most")
    part, block = (F.pmod(F.xxhash64("rep"), x).cast("int") for x in (parts, blocks))
    few = F.when(leads, F.array(part)).otherwise(F.sequence(F.lit(0), parts - 1))
    # parts from 1 on: a part of the largest class and a block; below 0: two blocks, or one
    with_lead = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: 1 + k * blocks + block)
    with_block = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: -1 - F.least(k, block) * blocks - F.greatest(k, block))
    many = F.when(leads, F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: 1 + part * blocks + k)).otherwise(F.concat(with_lead, with_block))
    dealt = F.when(blocks == 1, few).otherwise(many)
    placed = keyed.join(mixed.select("key", "most", "c", "all"), "key").select("key", F.explode(dealt).alias("part"), leads.cast("int").alias("lead"), "rep", "cls", "n", "left")
    placed = placed.join(parities, "rep").select("key", "part", "lead", "rep", "cls", "n", "left", "parity")
    grouped = placed.repartition(shuffle_partitions(spark), "key", "part").sortWithinPartitions("key", "part")
    return grouped.mapInArrow(tidy(lambda it: _meet_buckets(it, similarity)), "u long, v long, apart int").distinct()


def _exact_links(made: DataFrame, rows: DataFrame, reps: DataFrame, parts: DataFrame, width: int, similarity: float, common: tuple[np.ndarray, np.ndarray], seed: int) -> DataFrame:
    """made (doc_id, stamp, same, head), rows (doc_id, stamp, text), reps (same, doc_id, stamp, n, parity), parts (node, component) -> pairs (u, v), u < v, of unlike components, and apart.

    All that are similar are there (but for a chance of MISS each in crowds), and some more; they differ in `apart` shingles at least.

    The documents of a rare shingle are compared with each other. Those of a
    crowd meet by further evidence: bands of min-hashes of the whole sets, so
    candidates follow similar pairs and not the size of the crowd.
    """
    spark = reps.sparkSession

    def spread(batches):
        # few rows at a time: workers go on to other stages and keep what they once held
        for b in (whole.slice(x, 512) for whole in batches for x in range(0, whole.num_rows, 512)):
            rep, cls, n = (b.column(k).to_numpy() for k in range(3))
            heads = b.column(3)
            size = np.diff(heads.offsets.to_numpy())
            h = heads.flatten().to_numpy()
            of = np.repeat(np.arange(len(rep)), size)
            at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            hot = _times(h.view(np.uint64), common) >= HOT
            # of hot shingles the first of a document stands for all, in no group of its shingle
            first = np.flatnonzero(hot)
            first = first[np.unique(of[first], return_index=True)[1]]
            for k, heat in ((np.flatnonzero(~hot), 0), (first, 1)):
                cols = [rep[of[k]] if heat else h[k], np.full(len(k), heat), rep[of[k]], cls[of[k]], n[of[k]], at[k]]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                for x in range(0, len(k), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[x : x + (1 << 16)], t) for c, t in zip(cols, types)], names=["h", "hot", "rep", "cls", "n", "at"])

    named = reps.join(bounded(parts), F.col("same") == F.col("node"), "left").select(F.col("same").alias("rep"), F.col("doc_id").alias("__d"), F.col("stamp").alias("__s"), F.coalesce("component", "same").alias("cls"))
    placed = made.join(bounded(named), (F.col("same") == F.col("rep")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("stamp") == F.col("__s"))).select("rep", "cls", "n", "head")
    placed = placed.mapInArrow(tidy(spread), "h long, hot int, rep long, cls long, n int, at int")
    grouped = placed.repartition(shuffle_partitions(spark), "h", "hot").sortWithinPartitions("h", "hot")
    met = materialize(grouped.mapInArrow(tidy(lambda it: _meet(it, similarity)), "u long, v long, rep long, cls long, n int, at int"), "near-met")
    crowd = met.where("rep is not null").groupBy("rep").agg(F.first("cls").alias("cls"), F.first("n").alias("n"), (F.first("n") - F.min("at")).alias("left"))
    crowd = materialize(crowd.join(reps.select(F.col("same").alias("rep"), "parity"), "rep"), "near-crowd")
    pairs = met.where("u is not null").select("u", "v").distinct()
    a = reps.select(F.col("same").alias("u"), F.col("parity").alias("pu"), F.col("n").alias("nu"))
    b = reps.select(F.col("same").alias("v"), F.col("parity").alias("pv"), F.col("n").alias("nv"))
    apart = F.aggregate(F.zip_with("pu", "pv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, k: acc + k)
    near = F.col("apart") * (1 + similarity) <= (F.col("nu") + F.col("nv")) * (1 - similarity) + 1e-6
    pairs = pairs.join(a, "u").join(b, "v").withColumn("apart", apart).where(near).select("u", "v", "apart")
    return pairs.unionByName(_crowd_pairs(crowd, rows, reps, width, similarity, seed)).distinct()


def _near_nodes(docs: DataFrame, text: str, width: int, similarity: float, bits: int, seed: int) -> DataFrame:
    """doc_id, stamp (of the text), node: equal nodes are one class.

    A node is the hash of a shingle set, so texts meet by what they say,
    whatever their ids, and texts with equal sets enter the search once.
    """
    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long"), F.xxhash64(F.col(text)).alias("stamp"), F.col(text).alias("text"))
    common = _common_shingles(rows, width, seed)

    def sketch(batches):
        import xxhash

        # a part of a batch at a time: a worker holds what one of them takes
        for b in (whole.slice(x, 512) for whole in batches for x in range(0, whole.num_rows, 512)):
            cols = [[] for _ in range(5)]
            for t in b.column(2):
                once = _sketched(t.as_py(), width, seed)
                made = (xxhash.xxh64_intdigest(once.tobytes()) - (1 << 63), _long_fingerprint(once), len(once), _parity(once), _head(once, similarity, common).view(np.int64))
                for c, x in zip(cols, made):
                    c.append(x)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), longs, pa.int32(), longs, longs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["doc_id", "stamp", "same", "pieces", "n", "parity", "head"])

    made = materialize(rows.mapInArrow(tidy(sketch), "doc_id long, stamp long, same long, pieces array<long>, n int, parity array<long>, head array<long>"), "near-sketch")
    # pieces, size and parity follow from the set; of its texts the one with the least id stands for it
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "stamp")).alias("at")
    reps = made.groupBy("same").agg(at, *[F.first(c).alias(c) for c in ("pieces", "n", "parity")])
    reps = materialize(reps.select("same", "at.doc_id", "at.stamp", "pieces", "n", "parity"), "near-reps")
    links = _piece_links(reps.select(F.col("same").alias("rep"), "pieces"), bits)
    a = reps.select(F.col("same").alias("u"), F.col("pieces").alias("pu"))
    b = reps.select(F.col("same").alias("v"), F.col("pieces").alias("pv"))
    apart = F.aggregate(F.zip_with("pu", "pv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    links = materialize(links.join(a, "u").join(b, "v").where(apart <= FAR_BITS).select("u", "v"), "near-links")

    def sets(batches):
        for b in (whole.slice(x, 512) for whole in batches for x in range(0, whole.num_rows, 512)):
            found = [np.unique(_shingle_hashes(t.as_py(), width, seed)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["n", "s"])

    def sets_of(some):
        """The shingle sets of all ends of some links."""
        ends = some.select(F.explode(F.array("u", "v")).alias("need")).distinct().join(reps.select(F.col("same").alias("need"), F.col("doc_id").alias("__d"), F.col("stamp").alias("__s")), "need")
        need = bounded(materialize(ends, "near-need"))
        texts = rows.join(need, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("stamp") == F.col("__s"))).select("need", "text").dropDuplicates(["need"])
        return materialize(texts.mapInArrow(tidy(sets), "n long, s array<long>"), "near-sets")

    def similar(some, shingles):
        """The links that hold."""
        both = some.join(shingles.select(F.col("n").alias("u"), F.col("s").alias("su")), "u").join(shingles.select(F.col("n").alias("v"), F.col("s").alias("sv")), "v")
        common = F.size(F.array_intersect("su", "sv"))
        return both.where(common >= similarity * (F.size("su") + F.size("sv") - common)).select("u", "v")

    def hold(links, first, held):
        """The links that hold, besides those that do already: first one a document, then those between the classes that these make; others can tell nothing new."""
        links, shingles = links.select("u", "v"), sets_of(links)
        held = materialize(held.unionByName(similar(first, shingles)) if held is not None else similar(first, shingles), "near-first")
        parts = connected_components(held)
        of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        rest = links.join(first.select("v", F.col("u").alias("__tried")), "v").where(F.col("u") != F.col("__tried"))
        rest = rest.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
        rest = materialize(rest, "near-rest")
        return materialize(held.unionByName(similar(rest, shingles)), "near-held")

    held = hold(links, links.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), None)
    # what the pieces and the stars have left apart
    more = materialize(_exact_links(made, rows, reps, connected_components(held), width, similarity, common, seed), "near-more")
    held = hold(more, more.groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u")).select("u", "v"), held)
    parts = connected_components(held)
    return made.join(parts, F.col("same") == F.col("node"), "left").select("doc_id", "stamp", F.coalesce("component", "same").alias("node"))


def near_duplicate_classes(docs: DataFrame, text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, component_id: classes of documents whose sets of word shingles are similar, a row per row of docs.

    Documents have 384-bit SimHash fingerprints of their sets, in twelve pieces of 32 bits.
    Two that agree in one piece but for `bits` bits - all pairs within 35 of
    384 bits do, and most pairs at the least similarity - meet at an anchor of
    that piece's covering code. Of each local class links to its least member
    go on; those of at most FAR_BITS bits are verified by the exact similarity
    of the shingle sets, one a document first, then all that lie between the
    classes these have made. This joins crowds at little cost, but not all.
    Then an exact search takes every pair of unlike classes that shares one of
    the shingles with which both sets begin, rare ones first (no pair at the
    least similarity does without). Where a crowd shares that shingle its sets
    must share a band of min-hashes too, of so many that a similar pair has none
    in common with chance 1e-12 at most. What sizes, places and parities allow
    is verified: no pair is missed otherwise.

    A-Z are lowered; null texts, and texts without words, are alike; a text with fewer
    words than a shingle is one shingle; texts may be of any length. Rows are
    told apart by text, so texts that share a doc_id are judged for themselves.
    A null doc_id takes part and is never the least, unless its whole class has
    none. Extra columns don't matter; an empty table gives no rows.
    """
    nodes = materialize(_near_nodes(docs, text, width, similarity, bits, seed), "near-nodes")
    least = nodes.groupBy(F.col("node").alias("__n")).agg(F.min("doc_id").alias("component_id"))
    return nodes.join(least, F.col("node") == F.col("__n")).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row of each class of near_duplicate_classes stays, with all its columns: that with the least doc_id.

    Different texts with one doc_id are judged for themselves, and if one class
    holds several of its least doc_id that with the least hash of its text
    stays; of rows with the same text and doc_id one stays. Rows without a
    doc_id take part, after all others. Texts without words, null ones too, are
    one class; texts may be of any length; extra columns, whatever their names,
    don't matter; an empty table stays empty.
    """
    nodes = materialize(_near_nodes(docs, text, width, similarity, bits, seed), "near-nodes")
    stays = nodes.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "stamp")).alias("at"))
    stays = stays.select(F.col("at.doc_id").alias("__d"), F.col("at.stamp").alias("__s"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("stamp") == F.col("__s"))
    gone = nodes.select("doc_id", "stamp").distinct().join(stays, same, "left_anti").select(F.col("doc_id").alias("__d"), F.col("stamp").alias("__s"))
    rows = carry(docs, "doc_id", text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("stamp", F.xxhash64(F.col(text)))
    kept = rows.join(bounded(materialize(gone, "near-gone")), same, "left_anti")
    twice = nodes.groupBy(F.col("doc_id").alias("__d"), F.col("stamp").alias("__s")).count().where("count > 1").join(gone, ["__d", "__s"], "left_anti").select("__d", "__s")
    twice = materialize(twice, "near-twice")
    if not twice.isEmpty():
        twice = bounded(twice)
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "stamp"]))
    return unpack(kept, docs)
