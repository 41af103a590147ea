"""Exact n-gram Jaccard join with set-relation skipping, and its components.

A document's set holds the hashes (64 bits) of its distinct word n-grams. Documents
with 100 * |x & y| >= threshold * |x | y| link. No link between different sets is lost:

1. Sets. One pass makes each set's size, a 128-bit digest and a few min-hash band
   keys. Equal sets become one class, represented by one row, whose marker (not the
   document's id, which may repeat) stands for it; from here on there are only
   representatives, whose texts go into one table bucketed by marker.
2. Leaders. Representatives with a band key in common are each checked against one
   leader of the key's group, its most typical member (a star, not all pairs). Of large
   groups, the sets left without a link get further leaders, in a few rounds. A set
   that links to leaders follows the one with the most links, and the exact number of its
   elements outside the leader is kept. Which sets get which leader only matters for speed. The pairs
   of a set that has many are dealt to blocks, and its text travels once to each. Of crowds that
   share half of a leader but do not link with it, all sets follow it loosely, so that they
   do not lead themselves and make pairs by the square of their number.
3. Index. Every set puts its prefix, rarest elements first, into lists by element:
   (leader, size, position). Two linked sets share an element of their prefixes.
   Lists keep one entry per leader and size, that of the smallest position, as the
   position filter passes no other if that one fails. Entries of a size form a block
   sorted by position, and a probe skips the rest of a block at the first position
   that is too late, or the whole block if its own position is. A list yields pairs of
   leaders, never pairs of one leader's followers: those are linked through it, or meet in blocks.
4. Answers. Pairs of leaders are checked by exact overlap. If they link, or other
   links connect them, that connects their followers too. If not, their followers'
   answers are derived: |y & z| <= |x & w| + |y - x| + |z - w| for followers y of x and
   z of w rules most out, and the others visit blocks of the other leader's followers,
   which are held as differences from what the block shares, so that a set's overlaps
   with all of a block follow from its overlap with that. Loose followers have blocks of their own;
   they visit all of their leader's, and no link of leaders spares them or their blocks a visit.
5. Components of all links found.

``link_counts`` gives the join itself, with no link left out: every class's exact number of
linked classes. There each set visits the blocks of its own leader and of all leaders
that its leader is a candidate with, linked or connected or not, and a visit counts on both sides.

"Rarest first" is any fixed order, so an estimate does: elements that repeat within
an Arrow batch are counted, and the most frequent of them, ``HEAVY`` at most, are broadcast
and come last. An element in D of the corpus's documents goes unnoticed only
if D is about the square root of the number of batches or less.

Edge cases: null texts and texts without words have empty sets (n_shingles 0) and link
with nothing; fewer words than n make one element of the whole sequence; a null doc_id
links with nothing and has a null component; rows that repeat an id with different texts
are matched each on its own; an empty table gives an empty result; further columns of the
input, of any name, are ignored, or carried by ``keep_one_each``. The input must come in the
same partitions each time it is read, as files do.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, fresh_names, join_groups, map_arrow, row_marker, shuffle_partitions
from textloom.llm.components import connected_components

WORDS = 5
THRESHOLD = 75
BANDS, BAND_ROWS = 6, 2
#: Frequent elements that are broadcast with their counts, 12 bytes each.
HEAVY = 500_000
#: Entries of the index that one bucket should hold.
BUCKET_ENTRIES = 500_000
#: Followers of one leader in a block that others visit, and partners of a set in a block that its text travels to.
BLOCK = 1024
#: Sets that no leader links with get HEADS more per group of over CROWD of them, in ROUNDS rounds at most, if their leader
#: linked with a FRUITFUL-th of its group. This only matters for speed.
CROWD, HEADS, ROUNDS, FRUITFUL = 64, 4, 6, 16
#: Rows of the table that one partition of texts should hold.
PARTITION_ROWS = 100_000
_CACHED_WORDS = 300_000
_PAIRS = "a long, b long"
_CHECKED = "a long, b long, n_a long, n_b long, overlap long"


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(64)]
_ODD = _spread(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sets of n-gram hashes; a word is hashed once as long as it is cached."""

    def __init__(self, n: int = WORDS) -> None:
        self.n, self.words = n, _WordHashes()

    def _ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > _CACHED_WORDS:
            self.words.clear()
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))

    def elements(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes. bytes.lower() and bytes.split() know ASCII only, as the definition of a word does."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        ids = self._ids(words)
        n = min(self.n, len(ids))
        h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            h += ids[k : len(ids) - n + 1 + k] * _POWERS[k % 64]
        h = np.sort(_spread(h + np.uint64(n)))
        fresh = np.ones(len(h), dtype=bool)
        np.not_equal(h[1:], h[:-1], out=fresh[1:])
        return h[fresh]


def band_keys(elements: np.ndarray) -> list[int]:
    mins = (elements[None] * _ODD[:, None]).min(axis=1) if len(elements) < 50_000 else np.array([(elements * odd).min() for odd in _ODD])
    keys = np.zeros(BANDS, dtype=np.uint64)
    for r in range(BAND_ROWS):
        keys = _spread(keys ^ mins[r::BAND_ROWS]) + np.arange(BANDS, dtype=np.uint64)
    return keys.astype(np.int64).tolist()


def least_overlap(a, b, threshold: int):
    """The smallest overlap with which sets of sizes a and b link."""
    return -(-threshold * (a + b) // (100 + threshold))


def _sets(n: int):
    names = ["row", "doc", "n", "d1", "d2", "bands", "element", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)

        def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values, times = values[times > 1], times[times > 1]
            none = [pa.nulls(len(values), t) for t in (*[pa.int64()] * 5, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*none, pa.array(values.astype(np.int64)), pa.array(times.astype(np.int64))], names=names)

        held, size, seen = [], 0, set()
        for batch in batches:
            rows = []
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                e = shingler.elements(text)
                digest = hashlib.blake2b(e.tobytes(), digest_size=16).digest()
                d1, d2 = np.frombuffer(digest, dtype=np.int64).tolist()
                rows.append((row, doc, len(e), d1, d2, band_keys(e) if len(e) else []))
                if digest not in seen:  # copies do not make an element frequent
                    seen.add(digest)
                    held.append(e)
                    size += len(e)
                    if size > 1_000_000:
                        yield frequent(held)
                        held, size, seen = [], 0, set()
            if rows:
                columns = list(zip(*rows, strict=True))
                types = (*[pa.int64()] * 5, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
        if held:
            yield frequent(held)

    return run


def _check(n: int):
    """Exact overlaps of pairs that come with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, kept = Shingler(n), {}

        def elements(key: int, text: pa.Scalar) -> np.ndarray:
            if key not in kept:
                if len(kept) >= 32:
                    kept.clear()
                kept[key] = shingler.elements(text.as_py())
            return kept[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            rows = []
            for i in range(len(a)):
                x, y = elements(a[i], ta[i]), elements(b[i], tb[i])
                rows.append((a[i], b[i], len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n_a", "n_b", "overlap"])

    return run


def _check_dealt(n: int):
    """As _check, for rows sorted by (hub, block), the hub's text before those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, own = Shingler(n), None, None
        for batch in batches:
            rows = []
            for hub, block, guest, sid, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()), strict=True):
                x = shingler.elements(text.as_py())
                if not guest:
                    now, own = (hub, block), x
                elif now == (hub, block):
                    rows.append((sid, hub, len(x), len(own), len(np.intersect1d(x, own, assume_unique=True))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n_a", "n_b", "overlap"])

    return run


def prefix(elements: np.ndarray, heavy: np.ndarray, times: np.ndarray, threshold: int) -> np.ndarray:
    """The elements of the prefix in the fixed order: those not known as frequent by hash, then the others by count."""
    size = len(elements)
    take = size - -(-threshold * size // 100) + 1
    if not len(heavy):
        return elements[:take]
    at = np.searchsorted(heavy, elements)
    at[at == len(heavy)] = 0
    known = heavy[at] == elements
    rare = elements[~known]
    if len(rare) >= take:
        return rare[:take]
    others, count = elements[known], times[at[known]]
    return np.concatenate([rare, others[np.lexsort((others, count))][: take - len(rare)]])


def _index_entries(n: int, threshold: int, heavy, buckets: int):
    """(bucket, entries): an element's bucket is given by its upper bits, and its lower 32 bits stand for it there.
    Two elements that agree in those make a list in common, which can only add pairs to check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        frequent, times = heavy.value
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            element = np.concatenate([p for p, _, _ in held])
            lengths = np.array([len(p) for p, _, _ in held])
            entries = np.zeros(len(element), dtype=[("e", "<u4"), ("leader", "<i8"), ("size", "<i4"), ("pos", "<i4")])
            entries["e"] = (element & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            entries["leader"] = np.repeat(np.array([x for _, x, _ in held], dtype=np.int64), lengths)
            entries["size"] = np.repeat(np.array([s for _, _, s in held], dtype=np.int32), lengths)
            entries["pos"] = np.arange(len(element)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            bucket = ((element >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, entries = bucket[order], entries[order]
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
            parts = [b"".join(np.ascontiguousarray(entries[f][i:j]).tobytes() for f in entries.dtype.names) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(parts, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            leaders = batch.column(0).to_pylist()
            for leader, text in zip(leaders, batch.column(1).cast(pa.binary()), strict=True):
                e = shingler.elements(text.as_py())
                own = prefix(e, frequent, times, threshold)
                held.append((own, leader, len(e)))
                size += len(own)
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for part in parts:
        k, at = len(part) // 20, 0
        for column, kind in zip(columns, ("<u4", "<i8", "<i4", "<i4"), strict=True):
            width = np.dtype(kind).itemsize
            column.append(np.frombuffer(part, dtype=kind, count=k, offset=at))
            at += k * width
    return tuple(np.concatenate(c) for c in columns)


def list_pairs(leader: np.ndarray, size: np.ndarray, pos: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Leader pairs of one list whose entries are sorted by (size, position), by skipping over blocks of equal size."""
    starts = np.r_[0, np.flatnonzero(size[1:] != size[:-1]) + 1]
    ends = np.r_[starts[1:], len(size)]
    sizes = size[starts].astype(np.int64)
    left, right = [], []
    for i in range(len(size)):
        a = int(size[i])
        first = np.searchsorted(sizes, -(-threshold * a // 100))
        last = np.searchsorted(sizes, a, side="right")
        need = least_overlap(a, sizes[first:last], threshold)
        for k in np.flatnonzero(a - pos[i] >= need) + first:  # blocks of which some entry may pass
            b, e = starts[k], ends[k]
            stop = b + np.searchsorted(pos[b:e], sizes[k] - need[k - first], side="right")
            if k == last - 1 and sizes[k] == a:
                stop = min(stop, i)  # each pair once
            found = leader[b:stop]
            found = found[found != leader[i]]
            left.append(np.full(len(found), leader[i]))
            right.append(found)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def bucket_pairs(e: np.ndarray, leader: np.ndarray, size: np.ndarray, pos: np.ndarray, threshold: int) -> np.ndarray:
    """Distinct pairs of leaders, smaller first, that the lists of a bucket yield."""
    order = np.argsort(e, kind="stable")
    e = e[order]
    run = np.r_[True, e[1:] != e[:-1]]
    alone = run & np.r_[run[1:], True]
    order, e = order[~alone], e[~alone]
    if not len(e):
        return np.zeros((0, 2), dtype=np.int64)
    leader, size, pos = leader[order], size[order], pos[order]
    order = np.lexsort((pos, size, leader, e))
    e, leader, size, pos = e[order], leader[order], size[order], pos[order]
    first = np.r_[True, (e[1:] != e[:-1]) | (leader[1:] != leader[:-1]) | (size[1:] != size[:-1])]
    e, leader, size, pos = e[first], leader[first], size[first], pos[first]
    order = np.lexsort((leader, pos, size, e))
    e, leader, size, pos = e[order], leader[order], size[order], pos[order]
    starts = np.r_[0, np.flatnonzero(e[1:] != e[:-1]) + 1]
    counts = np.diff(np.r_[starts, len(e)])
    two = starts[counts == 2]
    a, b = size[two + 1].astype(np.int64), size[two].astype(np.int64)
    need = least_overlap(a, b, threshold)
    good = (leader[two] != leader[two + 1]) & (100 * b >= threshold * a) & (a - pos[two + 1] >= need) & (b - pos[two] >= need)
    left, right = [leader[two[good]]], [leader[two[good] + 1]]
    for s, k in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
        own = leader[s : s + k]
        if (own != own[0]).any():
            x, y = list_pairs(own, size[s : s + k], pos[s : s + k], threshold)
            if len(x) > 10_000:
                x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            left.append(x)
            right.append(y)
    x, y = np.concatenate(left), np.concatenate(right)
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)


class Block:
    """Sets held as differences from what most of them share, so that the overlaps of one set with all of
    them follow from its overlap with that: less what a set lacks of it, plus what a set has besides."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.sizes = np.array(ids, dtype=np.int64), np.array([len(x) for x in sets])
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        self.common = values[2 * counts > len(sets)]
        self.more = self._lists([np.setdiff1d(x, self.common, assume_unique=True) for x in sets])
        self.less = self._lists([np.setdiff1d(self.common, x, assume_unique=True) for x in sets])

    @staticmethod
    def _lists(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(element, kind="stable")
        return element[order], owner[order]

    def _hits(self, lists: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        begin, end = np.searchsorted(lists[0], x, side="left"), np.searchsorted(lists[0], x, side="right")
        at = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange((end - begin).sum())
        return np.bincount(lists[1][at], minlength=len(self.ids))

    def overlaps(self, x: np.ndarray) -> np.ndarray:
        shared = len(np.intersect1d(x, self.common, assume_unique=True))
        return shared - self._hits(self.less, x) + self._hits(self.more, x)


def _visit(n: int, threshold: int):
    """Rows sorted by (host, block), its sets before the guests: of the links between a block's sets and its guests, no more than
    connect what they connect. The sets of blocks from 0 on are connected through the host, those of others are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        now, ids, sets, block, root = None, [], [], None, {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            links = []
            for host, number, guest, sid, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()), strict=True):
                if now != (host, number):
                    now, ids, sets, block, root = (host, number), [], [], None, {}
                x = shingler.elements(text.as_py())
                if not guest:
                    ids.append(sid)
                    sets.append(x)
                    continue
                if not ids:
                    continue
                block = block or Block(ids, sets)
                linked = block.overlaps(x) >= least_overlap(len(x), block.sizes, threshold)
                found = np.sort(block.ids[linked]).tolist()
                for other in found[:1] if number >= 0 else found:
                    u, v = find(sid), find(other)
                    if u != v:
                        root[u] = v
                        links.append((sid, other))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return run


def _count(n: int, threshold: int):
    """Rows as in _visit: sid and its links, in part. A block counts the links among its own sets, and each
    visit counts for the guest and for the block's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        now, ids, sets, block, counts = None, [], [], None, None

        def linked(x: np.ndarray) -> np.ndarray:
            return block.overlaps(x) >= least_overlap(len(x), block.sizes, threshold)

        def closed() -> tuple[Block, np.ndarray]:
            nonlocal block
            block = Block(ids, sets)
            return block, np.array([int(linked(x).sum()) - 1 for x in sets], dtype=np.int64)

        for batch in batches:
            rows: list[tuple[np.ndarray, np.ndarray]] = []
            for host, number, guest, sid, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4).cast(pa.binary()), strict=True):
                if now != (host, number):
                    if ids:
                        block, counts = (block, counts) if block else closed()
                        rows.append((block.ids, counts))
                    now, ids, sets, block, counts = (host, number), [], [], None, None
                x = shingler.elements(text.as_py())
                if not guest:
                    ids.append(sid)
                    sets.append(x)
                    continue
                if not ids:
                    continue
                if not block:
                    block, counts = closed()
                found = linked(x)
                counts += found
                rows.append((np.array([sid]), np.array([int(found.sum())])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["sid", "links"])
        if ids:
            block, counts = (block, counts) if block else closed()
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(counts)], names=["sid", "links"])

    return run


def _probe(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(bucket, []).append(entries)
        for bucket in sorted(parts):
            pairs = bucket_pairs(*_unpack(parts.pop(bucket)), threshold)
            for begin in range(0, len(pairs), 100_000):
                own = pairs[begin : begin + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[:, 0])), pa.array(np.ascontiguousarray(own[:, 1]))], names=["a", "b"])

    return run


def _blocks(followers: str = "k") -> Column:
    """The number of a host's blocks, by its followers k, or of those of its loose ones w."""
    return (F.col(followers) / BLOCK).cast("int") + 1


def _block_of(followers: str = "k") -> Column:
    return F.pmod(F.xxhash64("sid"), _blocks(followers).cast("long")).cast("int")


class JaccardJoin:
    """The join's tables, each written to the shared folder: sets, classes, links."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> None:
        if not 0 < threshold <= 100:
            raise ValueError("threshold is a percentage")
        self.spark, self.words, self.threshold = docs.sparkSession, words, threshold
        self.scratch = Scratch(self.spark, "jaccard")
        self.table = None
        self.rows = docs.select(row_marker().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        schema = "row long, doc long, n long, d1 long, d2 long, bands array<long>, element long, times long"
        both = self.scratch.keep(map_arrow(self.rows, _sets(words), schema), "sets")
        self.sets = both.filter("n IS NOT NULL").select("row", "doc", "n", "d1", "d2", "bands")
        self.frequent = both.filter("times IS NOT NULL").select("element", "times")
        self.partitions = max(shuffle_partitions(self.spark), -(-both.count() // PARTITION_ROWS))
        some = self.sets.filter("n > 0 AND doc IS NOT NULL")
        classes = some.groupBy("d1", "d2").agg(F.min("row").alias("sid"), F.min("doc").alias("least"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        #: One row per distinct set: d1, d2, sid (the row that represents it), least (its smallest id), size, n, bands.
        self.classes = self.scratch.keep(classes, "classes")

    def _texts(self) -> DataFrame:
        """sid, text of the representatives, bucketed by sid: texts are shuffled this once."""
        name = f"textloom_texts_{uuid.uuid4().hex}"
        dealt = self.rows.select(F.col("row").alias("sid"), "text").repartition(self.partitions, "sid")
        own = dealt.join(self.classes.select("sid").hint("shuffle_hash"), "sid", "left_semi")
        self.table = name
        own.write.bucketBy(self.partitions, "sid").option("path", self.scratch.path("texts")).saveAsTable(name)
        return self.spark.table(name)

    def _close(self) -> None:
        """Removes the texts, whatever has happened before."""
        if self.table is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None
        self.scratch.drop("texts")

    def check(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """a, b, n_a, n_b, overlap of the pairs (a, b, k), a written table, where b has k pairs. Only one text of a pair is shuffled."""
        few = pairs.filter(F.col("k") <= BLOCK).select("a", "b")
        one = few.hint("shuffle_hash").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
        two = one.hint("shuffle_hash").join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
        out = map_arrow(two.select("a", "b", "text_a", "text_b"), _check(self.words), _CHECKED)
        many = pairs.filter(F.col("k") > BLOCK)
        if many.isEmpty():
            return out
        hubs = many.groupBy("b").agg(F.first("k").alias("k"))
        host = hubs.select(F.col("b").alias("host"), F.explode(F.sequence(F.lit(0), _blocks() - 1)).alias("block"), F.lit(0).alias("guest"), F.col("b").alias("sid"))
        guest = many.select(F.col("b").alias("host"), F.pmod(F.xxhash64("a"), _blocks().cast("long")).cast("int").alias("block"), F.lit(1).alias("guest"), F.col("a").alias("sid"))
        return out.unionByName(map_arrow(self._dealt(host, guest, texts), _check_dealt(self.words), _CHECKED))

    def _oriented(self, pairs: DataFrame) -> DataFrame:
        """a, b, k of pairs of sets: b is the one with more pairs, k. No set is the a of more pairs than about the root of
        twice their number, as each of its partners has as many."""
        ends = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).groupBy("s").agg(F.count(F.lit(1)).alias("k"))
        for s in ("a", "b"):
            pairs = pairs.join(ends.select(F.col("s").alias(s), F.col("k").alias(f"k_{s}")), s)
        first = F.col("k_a") > F.col("k_b")
        return pairs.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("k_a", "k_b").alias("k"))

    def _linked(self, checked: DataFrame) -> DataFrame:
        return checked.filter(F.col("overlap") * (100 + self.threshold) >= self.threshold * (F.col("n_a") + F.col("n_b")))

    def _star_pairs(self, among: DataFrame, crowd: int, heads: int) -> DataFrame:
        """a, b, k: each set a of among (sid, bands; a written table) with leaders b of its band keys' groups, if of more than
        ``crowd`` members (k: b's pairs). Of each of ``heads`` parts of a group, the member leads whose keys are the most
        common, so that a group of near copies of one text is led by that text, or by one that hardly differs from it."""
        keep, key = self.scratch.keep, ["band", "key"]
        keys = among.select("sid", F.posexplode("bands").alias("band", "key"))
        groups = keep(keys.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd), "groups")
        shared = keep(join_groups(keys, groups, key, "k"), "keys")
        common = shared.groupBy("sid").agg(F.sum("k").alias("common"))
        part = F.pmod(F.xxhash64("sid"), F.lit(heads)).alias("part")
        tops = shared.join(common, "sid").groupBy(*key, part).agg(F.max(F.struct("common", (-F.col("sid")).alias("s"))).alias("m"), F.first("k").alias("size"))
        tops = keep(tops.groupBy(*key).agg(F.collect_list(-F.col("m.s")).alias("heads"), F.first("size").alias("size")), "heads")
        led = join_groups(shared.select("sid", *key), tops, key, "size").select(F.col("sid").alias("a"), F.explode("heads").alias("b"))
        led = keep(led.filter("a <> b").distinct(), "led")
        hubs = keep(led.groupBy("b").agg(F.count(F.lit(1)).alias("k")), "hubs")
        return keep(join_groups(led, hubs, ["b"], "k"), "star-pairs")

    def _stars(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """a, b, n_a, n_b, overlap of the links of sets with leaders, and sid, leader, n, outside of loose followers.

        A leader that is not typical enough leaves much of its group alone, and sets left alone lead themselves, so that pairs of
        leaders would grow with the square of their number. Those left by a leader that others did link to get further leaders,
        chosen among them, for as long as a group of more than ``CROWD`` of them is left, ``ROUNDS`` times at most. Sets without any
        link that share half with a leader follow it loosely if more than ``CROWD`` do; of several leaders, that of the most."""
        keep = self.scratch.keep
        among, found = self.classes.select("sid", "bands"), []
        for i in range(1 + ROUNDS):
            pairs = self._star_pairs(among, CROWD if i else 1, HEADS if i else 1)
            found.append(keep(self.check(pairs, texts), f"stars-{i}"))
            if i == ROUNDS or pairs.isEmpty():
                break
            own = self._linked(found[-1])
            led = pairs.groupBy("b").agg(F.first("k").alias("k")).join(own.groupBy("b").agg(F.count(F.lit(1)).alias("linked")), "b")
            good = keep(led.filter(F.col("linked") * FRUITFUL >= F.col("k")).select("b", "k"), f"good-{i}")
            asked = join_groups(pairs.select("a", "b"), good, ["b"], "k").select(F.col("a").alias("sid")).distinct()
            attached = own.select(F.col("a").alias("sid")).unionByName(own.select(F.col("b").alias("sid"))).distinct()
            rest = asked.join(attached, "sid", "left_anti")
            among = keep(among.join(rest, "sid", "left_semi"), f"rest-{i}")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        stars = keep(self._linked(out), "stars")
        attached = stars.select("a").unionByName(stars.select(F.col("b").alias("a"))).distinct()
        near = out.filter(2 * F.col("overlap") >= F.greatest("n_a", "n_b")).join(attached, "a", "left_anti")
        near = keep(near.select("a", "b", F.col("n_a").alias("n"), (F.col("n_a") - F.col("overlap")).alias("outside")), "near")
        crowds = keep(near.groupBy("b").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD), "crowds")
        choice = F.struct((-F.col("k")).alias("k"), "b", "n", "outside")
        loose = join_groups(near, crowds, ["b"], "k").groupBy(F.col("a").alias("sid")).agg(F.min(choice).alias("x"))
        loose = keep(loose.select("sid", F.col("x.b").alias("leader"), "x.n", "x.outside"), "loose")
        self.scratch.drop("groups", "keys", "heads", "led", "hubs", "star-pairs", "near", "crowds", *(f"{x}-{i}" for x in ("stars", "good", "rest") for i in range(1 + ROUNDS)))
        return stars, loose

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted frequent elements and their counts: all above the least power of two that at most HEAVY exceed."""
        counted = self.frequent.groupBy("element").agg(F.sum("times").alias("times"))
        level = F.floor(F.log2("times")).cast("int")
        levels = sorted(map(tuple, counted.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # 64 at most
        least, taken = 64, 0
        for at, k in levels:
            if taken + k > HEAVY:
                break
            least, taken = at, taken + k
        top = counted.filter(level >= least).toPandas()
        values = top["element"].to_numpy(dtype=np.int64).astype(np.uint64)
        order = np.argsort(values)
        return values[order], top["times"].to_numpy(dtype=np.int64)[order].astype(np.int32)

    def _candidates(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The representatives' texts, the links of the stars, the followers, and the checked pairs of leaders: a link between
        sets of different leaders is between sets of one of these pairs."""
        keep = self.scratch.keep
        texts = self._texts()
        stars, loose = self._stars(texts)
        # Of several leaders a set follows the one with the most links, so that a group is not split among its leaders.
        leads = keep(stars.groupBy("b").agg(F.count(F.lit(1)).alias("k")), "leads")
        choice = F.struct((-F.col("k")).alias("k"), "b", F.col("n_a").alias("n"), (F.col("n_a") - F.col("overlap")).alias("outside"))
        followers = join_groups(stars, leads, ["b"], "k").groupBy(F.col("a").alias("sid")).agg(F.min(choice).alias("x"))
        followers = followers.select("sid", F.col("x.b").alias("leader"), "x.n", "x.outside", F.lit(False).alias("loose"))
        followers = keep(followers.unionByName(loose.withColumn("loose", F.lit(True))), "followers")

        heavy = self.spark.sparkContext.broadcast(self._frequent())
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        buckets = max(4 * self.partitions, total * (100 - self.threshold) // 100 // BUCKET_ENTRIES)
        led = texts.join(followers.select("sid", "leader").hint("shuffle_hash"), "sid", "left").select(F.coalesce("leader", "sid").alias("leader"), "text")
        entries = map_arrow(led, _index_entries(self.words, self.threshold, heavy, buckets), "bucket long, entries binary")
        found = map_arrow(entries.repartition(max(self.partitions, buckets // 4), "bucket"), _probe(self.threshold), _PAIRS).distinct()
        pairs = keep(self._oriented(keep(found, "found")), "pairs")
        return texts, stars, followers, keep(self.check(pairs, texts), "answers")

    def links(self) -> DataFrame:
        """u, v: links between representatives, enough to connect what links connect."""
        keep = self.scratch.keep
        try:
            texts, stars, followers, answers = self._candidates()
            direct = self._linked(answers)
            edges = [x.select(F.col("a").alias("u"), F.col("b").alias("v")) for x in (stars, direct)]
            sure = keep(edges[0].unionByName(edges[1]), "sure")
            derived = keep(self._derived(answers, followers, connected_components(sure, self.scratch), texts), "derived")
            out = keep(sure.unionByName(derived.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
        finally:
            self._close()
        self.scratch.drop("found", "pairs", "answers", "derived", "stars", "sure")
        return out

    def _groups(self, followers: DataFrame) -> DataFrame:
        """leader, k and w (its followers that link with it, and loose ones), out (the most elements of one outside of it), least (size)."""
        loose = F.col("loose").cast("long")
        return followers.groupBy("leader").agg(F.sum(1 - loose).alias("k"), F.sum(loose).alias("w"), F.max("outside").alias("out"), F.min("n").alias("least"))

    def _derived(self, answers: DataFrame, followers: DataFrame, components: DataFrame, texts: DataFrame) -> DataFrame:
        """a, b: links between sets whose leaders do not link, and are not connected otherwise either, and all of loose followers.

        Of two leaders, the one with more followers is the host: they and it are dealt to blocks. The other and its
        followers visit every block of the host, unless the bound from the leaders' overlap, the followers' most
        elements outside of their leader and their least size rules out a link. If the leaders are connected, only loose
        followers visit, and the others the blocks of loose ones."""
        led = self.scratch.keep(self._groups(followers), "led")
        known = components.select("node", "component").join(led.withColumnRenamed("leader", "node"), "node", "full")
        pairs = answers
        for s in ("a", "b"):
            pairs = pairs.join(known.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}"), *(F.col(x).alias(f"{x}_{s}") for x in ("k", "w", "out", "least"))), s, "left")
        pairs = pairs.na.fill(0, [f"{x}_{s}" for x in ("k", "w", "out") for s in ("a", "b")]).withColumn("joined", F.coalesce("c_a", "a") == F.coalesce("c_b", "b"))
        guests = self._guests(pairs.filter(F.when(F.col("joined"), F.col("w_a") + F.col("w_b")).otherwise(F.col("k_a") + F.col("w_a") + F.col("k_b") + F.col("w_b")) > 0), followers)
        guests = guests.groupBy("host", "sid").agg(F.max("k").alias("k"), F.max("w").alias("w"), F.bool_or(F.col("loose") | ~F.col("joined")).alias("all"))
        guests = self.scratch.keep(guests.withColumn("from", -_blocks("w")), "guests")
        # A loose follower visits its own block and the later ones of its leader's loose followers: each pair of blocks meets once.
        own = followers.filter("loose").join(led.select("leader", "k", "w"), "leader")
        own = own.select(F.col("leader").alias("host"), "sid", "k", "w", F.lit(True).alias("all"), (-1 - _block_of("w")).alias("from"))
        guests = guests.unionByName(own)
        hosted = self._hosted(guests.groupBy("host").agg(F.max("k").alias("k"), F.max("w").alias("w")), followers)
        numbers = F.sequence(F.when(F.col("w") > 0, F.col("from")).otherwise(F.lit(0)), F.when(F.col("all"), _blocks() - 1).otherwise(F.lit(-1)))
        visits = guests.filter(F.col("all") | (F.col("w") > 0)).select("host", F.explode(numbers).alias("block"), F.lit(1).alias("guest"), "sid")
        return map_arrow(self._dealt(hosted, visits, texts), _visit(self.words, self.threshold), _PAIRS)

    def _guests(self, pairs: DataFrame, followers: DataFrame) -> DataFrame:
        """host, guest, sid, loose, joined, k and w (the host's followers) of the sets that the bound lets visit, for pairs of leaders
        with their overlap, what is known of their followers, and whether they are connected."""
        t, no = self.threshold, pairs
        first = F.col("k_a") + F.col("w_a") >= F.col("k_b") + F.col("w_b")

        def of(name: str, host: bool):
            return F.when(first, F.col(f"{name}_{'a' if host else 'b'}")).otherwise(F.col(f"{name}_{'b' if host else 'a'}"))

        calls = no.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest"), of("n", False).alias("n_guest"), of("k", True).alias("k"), of("w", True).alias("w"), of("out", True).alias("out"), F.least(of("n", True), of("least", True)).alias("least"), "overlap", "joined")
        calls = self.scratch.keep(calls, "calls")
        alone = calls.select("host", "guest", F.col("guest").alias("sid"), F.col("n_guest").alias("n"), F.lit(0).cast("long").alias("outside"), F.lit(False).alias("loose"), "joined", "k", "w", "out", "least", "overlap")
        company = calls.join(followers.select(F.col("leader").alias("guest"), "sid", "n", "outside", "loose"), "guest").select(*alone.columns)
        bound = F.least(F.col("overlap") + F.col("outside") + F.col("out"), F.col("n"))
        return alone.unionByName(company).filter(bound * (100 + t) >= t * (F.col("n") + F.col("least"))).select("host", "guest", "sid", "loose", "joined", "k", "w")

    def _hosted(self, hosts: DataFrame, followers: DataFrame) -> DataFrame:
        """The sets of the hosts (host, k, w), dealt to blocks: loose followers to those before 0, if counted in w."""
        hosted = hosts.join(followers.select(F.col("leader").alias("host"), "sid", "loose"), "host").unionByName(hosts.select("*", F.col("host").alias("sid"), F.lit(False).alias("loose")))
        block = F.when(F.col("loose") & (F.col("w") > 0), -1 - _block_of("w")).otherwise(_block_of())
        return hosted.select("host", block.alias("block"), F.lit(0).alias("guest"), "sid")

    def _dealt(self, hosted: DataFrame, visits: DataFrame, texts: DataFrame) -> DataFrame:
        rows = hosted.unionByName(visits).hint("shuffle_hash").join(texts, "sid").select("host", "block", "guest", "sid", "text")
        return rows.repartition(self.partitions, "host", "block").sortWithinPartitions("host", "block", "guest")

    def counts(self) -> DataFrame:
        """sid, links: the exact number of other sets that each representative links with, where there are any."""
        try:
            return self._counts()
        finally:
            self._close()

    def _counts(self) -> DataFrame:
        keep, t = self.scratch.keep, self.threshold
        texts, _, followers, answers = self._candidates()
        # A leader may follow another in turn, and then is in that one's group only: each set is in one group, as in the index.
        follows = followers.select("sid")

        def members(rows: DataFrame, leader: str) -> DataFrame:
            return rows.filter(F.col("sid") != F.col(leader)).unionByName(rows.filter(F.col("sid") == F.col(leader)).join(follows, "sid", "left_anti"))

        # Loose followers are counted as the others are: here nothing follows from a link with a leader.
        led = self._groups(followers).select("leader", (F.col("k") + F.col("w")).alias("k"), F.lit(0).cast("long").alias("w"), "out", "least")
        led = keep(led, "led")
        pairs = answers
        for s in ("a", "b"):
            pairs = pairs.join(led.select(F.col("leader").alias(s), *(F.col(x).alias(f"{x}_{s}") for x in ("k", "w", "out", "least"))), s, "left")
        pairs = keep(pairs.na.fill(0, [f"{x}_{s}" for x in ("k", "w", "out") for s in ("a", "b")]).withColumn("joined", F.lit(False)), "counted")
        direct = self._linked(pairs.filter("k_a + k_b = 0"))
        guests = keep(members(self._guests(pairs.filter("k_a + k_b > 0"), followers), "guest"), "guests")
        hosted = keep(members(self._hosted(led.select(F.col("leader").alias("host"), "k", "w"), followers), "host"), "hosted")
        visits = guests.select("host", F.explode(F.sequence(F.lit(0), _blocks() - 1)).alias("block"), F.lit(1).alias("guest"), "sid")
        wide = led.select(F.col("leader").alias("host"), "k").filter(_blocks() > 1)
        later = hosted.join(wide, "host").filter(F.col("block") < _blocks() - 1)  # each pair of a leader's blocks meets once
        later = later.select("host", F.explode(F.sequence(F.col("block") + 1, _blocks() - 1)).alias("block"), F.lit(1).alias("guest"), "sid")
        found = map_arrow(self._dealt(hosted, visits.unionByName(later), texts), _count(self.words, t), "sid long, links long")
        one = F.lit(1).cast("long").alias("links")
        for s in ("a", "b"):
            found = found.unionByName(direct.select(F.col(s).alias("sid"), one))
        out = keep(found.groupBy("sid").agg(F.sum("links").alias("links")), "counts")
        self.scratch.drop("found", "pairs", "answers", "stars", "counted", "guests", "hosted", "led")
        return out

    def _labelled(self, labels: DataFrame, alone: list[Column]) -> DataFrame:
        """row, doc, n of every row with what labels (d1, d2, size and more) has for its class, or with ``alone``."""
        some = F.col("doc").isNotNull() & (F.col("n") > 0)
        narrow = self.sets.select("row", "doc", "n", "d1", "d2")
        linked = join_groups(narrow.filter(some), labels, ["d1", "d2"], "size").drop("d1", "d2", "size")
        return linked.unionByName(narrow.filter(~some).select("row", "doc", "n", *alone))

    def rows_by_component(self) -> DataFrame:
        """row, doc, n, component (null where nothing can link), label (its smallest id; null for a null doc) of every row."""
        keep = self.scratch.keep
        nodes = connected_components(self.links(), self.scratch).withColumnRenamed("node", "sid")
        known = self.classes.select("d1", "d2", "sid", "size", "least").join(nodes, "sid", "left")
        known = keep(known.select("d1", "d2", "size", "least", F.coalesce("component", "sid").alias("component")), "known")
        whole = keep(known.groupBy("component").agg(F.min("least").alias("label"), F.count(F.lit(1)).alias("members")), "components")
        labels = join_groups(known.drop("least"), whole, ["component"], "members").select("d1", "d2", "size", "component", "label")
        return self._labelled(keep(labels, "labels"), [F.lit(None).cast("long").alias("component"), F.col("doc").alias("label")])

    def rows_by_links(self) -> DataFrame:
        """row, doc, n, class_id, links of every row."""
        labels = self.classes.select("d1", "d2", "size", "sid", F.col("least").alias("class_id")).join(self.counts(), "sid", "left")
        labels = labels.select("d1", "d2", "size", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
        return self._labelled(self.scratch.keep(labels, "labels"), [F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("links")])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    found = JaccardJoin(docs, id_col, text_col, words, threshold).rows_by_component()
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id (the smallest id with an equal set), n_links (the exact
    number of other classes that its class links with). A null doc_id and an empty set link with nothing."""
    found = JaccardJoin(docs, id_col, text_col, words, threshold).rows_by_links()
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", F.col("links").alias("n_links"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, less all but one row of each component: that of the smallest id, and of
    rows that repeat it the first. Rows that link with nothing stay, those of a null id or of no words among them."""
    join = JaccardJoin(docs, id_col, text_col, words, threshold)
    rows = join.rows_by_component()
    linked = F.col("doc").isNotNull() & (F.col("n") > 0)
    # Rows of different components may share a label if ids repeat, so the first row goes by component, not by label.
    first = rows.filter(linked).groupBy("component").agg(F.min(F.struct("doc", "row")).alias("first")).select(F.col("first.row").alias("row"))
    (marker,) = fresh_names(("marker",), docs.columns)
    stay = first.unionByName(rows.filter(~linked).select("row")).withColumnRenamed("row", marker)
    return docs.withColumn(marker, row_marker()).join(stay.hint("shuffle_hash"), marker, "left_semi").select(*docs.columns)
