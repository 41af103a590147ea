"""SentencePiece encoding by forward-filtering backward-sampling, and decoding.

A text is cut into units where its two neighbouring characters are side by side in no piece, so that no piece
can span a cut and the lattice of the text is that of its units in a row. The lattice has an edge for every
piece of the vocabulary that matches, and for characters without a piece an edge of the
pieces of their UTF-8 bytes. A piece of rank r has weight (r + 2) ** (-1 / temperature), as BPE
models give ranks only. The forward pass sums the weights of all paths to each position, as logarithms, as a unit may have any length;
sampling goes backwards, taking each edge with its share of the sum at its end, so that a
segmentation comes with exactly its share of all.

A worker runs the forward pass once per distinct unit it holds, for all new units of a batch
together, and lays the shares of all its units end to end, so that one binary search draws one edge for every open unit of a
batch. Draws come from a hash of (row key, seed, position in the text), so a row's
segmentation does not depend on partitions, batches or other rows.

Decoding joins the pieces' bytes and is lossless for every text: spaces are the piece
mark, and a mark that is in the text itself is written as bytes.

Edge cases: null and empty texts have no pieces and decode to the empty text; a null key counts as
-1; rows that repeat a key and a text get the same pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_arrow

MODEL = "piece_bpe_32k.model"
MARK = "▁"
TEMPERATURE = 1.0
SEED = 5
_HELD_UNITS = 500_000
_HELD_EDGES = 12_000_000
_RARE = 1e-6


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceModel:
    """Pieces, weights and bytes of a sentencepiece model file."""

    def __init__(self, path: str, temperature: float = TEMPERATURE) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = own.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_ids = [-1] * 256
        pieces: list[str] = []
        ids: list[int] = []
        for i in range(self.size):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
                pieces.append(piece.replace(MARK, " "))
                ids.append(i)
                self.bytes_of[i] = pieces[-1].encode()
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, pieces))
        keys = np.zeros(len(pieces), dtype=np.uint64)
        lengths = np.array([len(p) for p in pieces])
        self.joined = np.zeros(1 << 22, dtype=bool)  # by a pair of characters; two pairs in one place only leave a cut out
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            points = np.frombuffer("".join(pieces[k] for k in at).encode("utf-32-le"), dtype=np.uint32)
            keys[at] = span_keys(points, n)[::n]
            self.joined[_pairs(points)[np.arange(1, len(points)) % n > 0]] = True
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, dtype=np.int64)[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)  # by a key's upper bits; most spans are no pieces
        self.maybe[self.keys >> np.uint64(44)] = True
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a key")
        self.weights = (order + 2.0) ** (-1 / temperature)  # pieces come by rank


def _pairs(points: np.ndarray) -> np.ndarray:
    """The place in ``joined`` of each character and the next one."""
    codes = points.astype(np.uint64)
    return ((codes[:-1] << np.uint64(21) | codes[1:]) * _BASE) >> np.uint64(42)


def span_keys(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n code points from each position on (garbage where there are fewer)."""
    codes = _spread(points.astype(np.uint64) + np.uint64(1))
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(n):
        h[: len(h) - k] = h[: len(h) - k] * _BASE + codes[k:]
    return _spread(h + np.uint64(n))


class Sampler:
    """The lattices of the units met so far, end to end."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}
        self.nodes, self.filled = 0, 0
        self.shares, self.pieces, self.before = np.zeros(1 << 16), np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)
        self.first = np.zeros(1 << 16, dtype=np.int32)  # of each node, its first edge

    def _append(self, name: str, at: int, own: np.ndarray) -> None:
        """The arrays double when they are full."""
        array = getattr(self, name)
        while at + len(own) > len(array):
            array = np.concatenate([array, np.zeros_like(array)])
        array[at : at + len(own)] = own
        setattr(self, name, array)

    def _add(self, units: list[str]) -> None:
        """Forward pass of new units. A unit of n characters has n + 1 nodes in a row, one before each character and one
        after the last; edges lie by the node at their end, with the running share of its sum."""
        model = self.model
        lengths = np.array([len(u) for u in units])
        points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        offsets = np.cumsum(lengths) - lengths
        unit = np.repeat(np.arange(len(units)), lengths)
        place = np.arange(len(points)) - offsets[unit]
        first = np.cumsum(lengths + 1) - lengths - 1  # node of each unit's start
        left = lengths[unit] - place
        start, end, piece, weight = [], [], [], []
        codes = _spread(points.astype(np.uint64) + np.uint64(1))
        at, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, min(model.longest, int(lengths.max())) + 1):
            if n > 1:
                long = left[at] >= n
                at, h = at[long], h[long]
            h = h * _BASE + codes[at + (n - 1)]
            keys = _spread(h + np.uint64(n))
            found = model.maybe[keys >> np.uint64(44)]
            hit = np.zeros(len(keys), dtype=np.int64)
            hit[found] = np.searchsorted(model.keys, keys[found])
            hit[hit == len(model.keys)] = 0
            found &= model.keys[hit] == keys
            node = first[unit[at]] + place[at]
            if n == 1:
                start.append(node)
                piece.append(np.where(found, model.ids[hit], -1 - points[at].astype(np.int64)))
                weight.append(np.where(found, model.weights[hit], _RARE))
            else:
                start.append(node[found])
                piece.append(model.ids[hit[found]])
                weight.append(model.weights[hit[found]])
            end.append(start[-1] + n)
        start, end, piece, weight = map(np.concatenate, (start, end, piece, weight))
        order = np.argsort(end, kind="stable")
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        total = int((lengths + 1).sum())
        forward, weight = np.zeros(total), np.log(weight)
        base = np.repeat(first, lengths + 1)  # of each node
        depth = end - base[end]
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, int(lengths.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = by_depth[a:b]  # in the order of their ends
            at, paths = end[own], forward[start[own]] + weight[own]
            begin = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
            most = np.maximum.reduceat(paths, begin)
            forward[at[begin]] = most + np.log(np.add.reduceat(np.exp(paths - np.repeat(most, np.diff(np.r_[begin, len(at)]))), begin))
        share = np.exp(forward[start] + weight - forward[end])
        order = np.lexsort((-share, end))
        start, end, piece, share = start[order], end[order], piece[order], share[order]
        last = np.r_[end[1:] != end[:-1], True]
        run = np.cumsum(share)
        begin = np.r_[0.0, run[last][:-1]]
        run = np.minimum(run - np.repeat(begin, np.diff(np.r_[-1, np.flatnonzero(last)])), 1.0)
        run[last] = 1.0
        nodes, filled = self.nodes, self.filled
        self._append("shares", filled, run)
        self._append("pieces", filled, piece)
        self._append("before", filled, np.where(start == base[start], -1, nodes + start))
        self._append("first", nodes, filled + np.searchsorted(end, np.arange(total)))
        self.filled += len(run)
        self.last.update(zip(units, (nodes + first + lengths).tolist(), strict=True))
        self.nodes += total

    def _units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units of all texts, each one's text, and its end in it."""
        whole, ends = "".join(texts), np.cumsum([len(t) for t in texts])
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.r_[~self.model.joined[_pairs(points)], True]
        cut[ends[ends > 0] - 1] = True
        last = np.flatnonzero(cut) + 1
        begin = np.r_[0, last[:-1]]
        text = np.searchsorted(ends, begin, side="right")
        return [whole[a:b] for a, b in zip(begin.tolist(), last.tolist(), strict=True)], text, last - np.r_[0, ends[:-1]][text]

    def sample(self, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        """The piece ids of each text."""
        if len(self.last) > _HELD_UNITS or self.filled > _HELD_EDGES:
            self.clear()
        units, text_of, place = self._units(texts)
        new = list({u: None for u in units if u not in self.last})
        if new:
            self._add(new)
        shares, pieces, before, first = self.shares, self.pieces, self.before, self.first
        node = np.fromiter(map(self.last.__getitem__, units), dtype=np.int64, count=len(units))
        # a unit's nodes lie in a row, so that a stream and a node give the position in the text
        stream = _spread(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))[text_of] + (place - node).astype(np.uint64)
        unit, drawn, units = np.arange(len(node)), [], []
        while len(unit):
            u = (_spread(stream[unit] + node.astype(np.uint64)) >> np.uint64(24)).astype(np.float64) / 2.0**40
            edge = first[node]
            wrong = np.flatnonzero(shares[edge] <= u)
            while len(wrong):
                edge[wrong] += 1
                wrong = wrong[shares[edge[wrong]] <= u[wrong]]
            drawn.append(pieces[edge])
            units.append(unit)
            node = before[edge]
            unit, node = unit[node >= 0], node[node >= 0]
        if not drawn:
            return [np.zeros(0, np.int64) for _ in texts]
        steps = np.repeat(np.arange(len(drawn)), [len(x) for x in drawn])
        drawn, units = np.concatenate(drawn), np.concatenate(units)
        of_unit = np.bincount(units, minlength=len(stream))
        place = np.cumsum(of_unit)[units] - 1 - steps  # edges were drawn from the end
        ordered = np.empty(len(drawn), dtype=np.int64)
        ordered[place] = drawn
        drawn, text_of = ordered, np.repeat(text_of, of_unit)
        if (drawn < 0).any():
            drawn, text_of = self._bytes(drawn, text_of)
        return np.split(drawn, np.searchsorted(text_of, np.arange(1, len(texts))))

    def _bytes(self, drawn: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        kinds, at = np.unique(drawn[drawn < 0], return_inverse=True)
        codes = [np.array([self.model.byte_ids[b] for b in chr(-1 - k).encode()], dtype=np.int64) for k in kinds.tolist()]
        lengths = np.ones(len(drawn), dtype=np.int64)
        lengths[drawn < 0] = np.array([len(c) for c in codes])[at]
        out = np.repeat(drawn, lengths)
        out[np.repeat(drawn < 0, lengths)] = np.concatenate([codes[k] for k in at.tolist()])
        return out, np.repeat(text_of, lengths)


_models: dict[tuple, PieceModel] = {}


def piece_model(path: str, temperature: float) -> PieceModel:
    if (path, temperature) not in _models:
        _models[path, temperature] = PieceModel(path, temperature)
    return _models[path, temperature]


def decode_ids(model: PieceModel, ids: list[int]) -> bytes:
    return b"".join(map(model.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, temperature: float = TEMPERATURE, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (as little-endian unsigned 32-bit ids), decoded_sha256 (of the text decoded from
    the pieces, in UTF-8), lossless, and the ids if asked for."""
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path, temperature)
        sampler = Sampler(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                keys = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
                found = sampler.sample(texts, keys, seed)
                decoded = [decode_ids(model, ids.tolist()) for ids in found]
                columns = [
                    part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()), pa.array([d == t.encode() for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, schema)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text of encoded rows (doc_id, ids)."""
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path, TEMPERATURE)
        for batch in batches:
            texts = [decode_ids(model, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
