"""Line dedup by range-partitioned line hashes.

1. Every line's key (ASCII white space stripped, A-Z lower-cased) becomes a
   128-bit BLAKE2b hash: rows (hash, document, position), never text.
2. Rows are range-partitioned by (hash, document) and sorted within partitions
   by (hash, document, position). As the document is part of the range, a hot
   line spreads over as many partitions as its rows need.
3. One streaming pass per partition decides every run of equal hashes that lies
   within the partition. Only the first and the last run of a partition can go
   on in a neighbour; their rows stay undecided and each leaves one summary row
   (two per partition), which are summed by hash and joined back.
4. The dropped positions of a document become one zlib-compressed bitmap (bit 1:
   keep), joined to the document to give its result.

Two rules: ``rule="common"`` drops every line whose key is in at least
``min_docs`` documents; ``rule="first"`` keeps a key's first occurrence by
(document, position) and drops the others.

Edge cases: a null or empty text is one empty line; keys under ``min_chars``
code points (so empty ones) always stay; rows that share a doc_id count as one
document, each with a result of its own; rows with a null doc_id count together as
one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, map_arrow

#: Stands for a null doc_id where documents are counted.
NO_ID = -(2**63)
_LINES = "h1 long, h2 long, doc long, rid long, pos long"
_STREAMED = "kind string, h1 long, h2 long, doc long, rid long, pos long, n long"


def line_key(line: bytes) -> bytes:
    """bytes.strip() and bytes.lower() know ASCII only, as the contract asks."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            digests, pos, owner = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for j, line in enumerate((text or b"").split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        pos.append(j)
                        owner.append(i)
            if digests:
                h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                owner = np.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], docs[owner], rids[owner], np.array(pos, dtype=np.int64))], names=["h1", "h2", "doc", "rid", "pos"])

    return run


def _rows(kind: str, h1, h2, doc, rid, pos, n) -> pa.RecordBatch:
    k = len(h1)
    return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.string()), *(pa.array(np.broadcast_to(np.asarray(x, dtype=np.int64), k)) for x in (h1, h2, doc, rid, pos, n))], names=["kind", "h1", "h2", "doc", "rid", "pos", "n"])


class _Run:
    """The open run of one hash: its documents so far, and rows held until it is decided."""

    def __init__(self, key: tuple[int, int], edge: bool) -> None:
        self.key, self.edge, self.docs, self.last, self.held, self.first = key, edge, 0, None, [], None


def _stream(rule: str, min_docs: int):
    """Decides runs in sorted rows; holds rows of a run only until min_docs documents are seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: _Run | None = None
        started = False

        def add(r: _Run, doc: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
            r.docs += int(np.count_nonzero(doc[1:] != doc[:-1])) + int(r.last is None or r.last != doc[0])
            r.last = int(doc[-1])
            if rule == "first":
                if r.first is None:
                    r.first = (int(doc[0]), int(pos[0]))
                    if r.edge:  # perhaps not the first of all
                        yield _rows("u", [r.key[0]], r.key[1], doc[:1], rid[:1], pos[:1], 0)
                    doc, rid, pos = doc[1:], rid[1:], pos[1:]
                if len(doc):
                    yield _rows("d", np.full(len(doc), r.key[0]), r.key[1], doc, rid, pos, 0)
                return
            r.held.append((doc, rid, pos))
            if r.docs >= min_docs:
                for d, i, p in r.held:
                    yield _rows("d", np.full(len(d), r.key[0]), r.key[1], d, i, p, 0)
                r.held = []

        def close(r: _Run) -> Iterator[pa.RecordBatch]:
            if r.edge:
                for d, i, p in r.held:
                    yield _rows("u", np.full(len(d), r.key[0]), r.key[1], d, i, p, 0)
                first = r.first or (0, 0)
                yield _rows("c", [r.key[0]], r.key[1], first[0], 0, first[1], r.docs)

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, rid, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            starts = np.r_[0, np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1]
            ends = np.r_[starts[1:], len(h1)]
            begin = 0
            if open_run is not None and open_run.key == (int(h1[0]), int(h2[0])):
                yield from add(open_run, doc[: ends[0]], rid[: ends[0]], pos[: ends[0]])
                begin = 1
            if begin < len(starts):
                if open_run is not None:
                    yield from close(open_run)
                if not started:  # the partition's first run may have begun before it
                    open_run = _Run((int(h1[0]), int(h2[0])), edge=True)
                    started = True
                    yield from add(open_run, doc[: ends[0]], rid[: ends[0]], pos[: ends[0]])
                    begin = 1
                    if begin < len(starts):
                        yield from close(open_run)
                if begin < len(starts):
                    last = len(starts) - 1
                    a, b = starts[begin], starts[last]
                    if a < b:  # the runs that lie within this batch, all at once
                        fresh = np.r_[True, (doc[a + 1 : b] != doc[a : b - 1])]
                        fresh[starts[begin:last] - a] = True
                        owner = np.repeat(np.arange(last - begin), np.diff(starts[begin : last + 1]))
                        if rule == "first":
                            drop = np.ones(b - a, dtype=bool)
                            drop[starts[begin:last] - a] = False
                        else:
                            drop = np.bincount(owner, weights=fresh)[owner] >= min_docs
                        if drop.any():
                            at = np.flatnonzero(drop) + a
                            yield _rows("d", h1[at], h2[at], doc[at], rid[at], pos[at], 0)
                    open_run = _Run((int(h1[b]), int(h2[b])), edge=False)
                    yield from add(open_run, doc[b:], rid[b:], pos[b:])
        if open_run is not None:
            open_run.edge = True  # the last run may go on in the next partition; with rule "first" its own first row stays
            yield from close(open_run)

    return run


def _to_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for pos in batch.column(2).to_pylist():
            keep = np.ones((max(pos) + 8) // 8 * 8, dtype=np.uint8)  # whole bytes, as packbits pads with zeros
            keep[pos] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc", "rid", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "common", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc, rid, keep_bitmap of every row that loses a line; lines past a bitmap's end stay."""
    if rule not in ("common", "first"):
        raise ValueError(f"unknown rule: {rule}")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("rid"), text_col)
    hashed = map_arrow(rows, _hash_lines(min_chars), _LINES)
    ranged = hashed.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos", "rid")
    scratch = Scratch(docs.sparkSession, "lines")
    found = scratch.keep(map_arrow(ranged, _stream(rule, min_docs), _STREAMED), "streamed")
    edges = found.filter("kind = 'c'")
    undecided = found.filter("kind = 'u'")
    if rule == "common":
        whole = edges.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
        late = undecided.join(whole.select("h1", "h2"), ["h1", "h2"], "left_semi")
    else:
        whole = edges.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("head"))
        late = undecided.join(whole, ["h1", "h2"]).filter(F.struct("doc", "pos") != F.col("head"))
    dropped = found.filter("kind = 'd'").select("doc", "rid", "pos").unionByName(late.select("doc", "rid", "pos"))
    positions = dropped.groupBy("doc", "rid").agg(F.collect_set("pos").alias("pos"))
    return map_arrow(positions, _to_bitmaps, "doc long, rid long, keep_bitmap binary")


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, digests, texts = [], [], [], []
            for text, packed in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if packed is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))[: len(lines)]
                    gone = set(np.flatnonzero(keep == 0).tolist())
                    kept = [x for i, x in enumerate(lines) if i not in gone]
                out = b"\n".join(kept)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                digests.append(hashlib.sha256(out).hexdigest())
                texts.append(out)
            columns = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "common", min_docs: int = 10, min_chars: int = 1, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256, and the kept text if asked for."""
    maps = keep_bitmaps(docs, id_col, text_col, rule, min_docs, min_chars)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("rid"))
    joined = rows.join(maps.hint("shuffle_hash"), ["doc", "rid"], "left").select("doc_id", "text", "keep_bitmap")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    return map_arrow(joined, _apply(with_text), schema)
