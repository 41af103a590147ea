"""Approximate nearest neighbours by NN-descent and greedy graph search.

Nodes are the distinct vectors, so copies of a vector are one node that knows its k + 1
smallest ids (no query needs more of them). Nodes are dealt by a hash to shards, whose nodes'
neighbours' vectors should fill ``SHARD_BYTES``; every step is one join of messages with shards:

1. First graph: random-projection trees, their splits fitted on a bounded sample of
   ``SAMPLE`` vectors, deal all nodes to leaves; rows are range-partitioned by leaf and
   cut into blocks of at most ``LEAF`` nodes; within a block neighbours are exact.
2. NN-descent: a node's neighbours and the nodes that name it as theirs (the nearest
   ``K`` of each kind, as the method does) are joined with each other: every pair of
   them that is nearer than one's K-th neighbour is proposed to it. A vector travels once
   to each shard that needs it, not once per edge, and proposals are cut to K per node
   before they travel.
3. Queries are nodes themselves and start from their own neighbours. Each round expands
   the ``EXPAND`` nearest nodes not yet expanded among the ``BEAM`` nearest found. A query's
   vector travels only to the shards that hold its new candidates, ``EXPAND`` x 2 ``K`` at most.
   Rounds end when no query has a node left to expand, or after ``STEPS``.
4. The nearest candidates are measured again in double precision on original vectors, and each
   node keeps its nearest rows, as one list, before the ids that share it are attached.

Edge cases: vectors that are null, zero, or hold a null or non-finite component, and rows
with a null id, take no part; nor do vectors whose length is not the most frequent one
(the smaller one in a tie); their number is logged. Ties in distance go to the smaller id. An id that repeats with
the same vector is one candidate; with different vectors, each is. Fewer candidates than
k give fewer rows, a single vector or an empty table none.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import Scratch, join_groups, map_arrow

K = 32
TREES, LEAF, SAMPLE = 6, 2048, 8192
ROUNDS, PROPOSALS = 3, 16
BEAM, EXPAND, STEPS = 200, 100, 5
#: Bytes of vectors that a shard's nodes may name, 2 K each.
SHARD_BYTES = 64 << 20
_log = logging.getLogger(__name__)
#: Candidates of a query that are measured again in double precision.
REFINED = 40

_MESSAGE = "shard int, kind string, a binary, b binary, c binary"
_GRAPH = "shard int, node long, ids binary, dist binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.int64).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _as_bytes(name: str):
    """A long column as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(name), 16, "0"))


def shard_of(nodes: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(nodes) % np.uint64(shards)).astype(np.int64)


def _stack(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    shard, kind, a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.string()), *(pa.array([None if x is None else x.tobytes() for x in col], pa.binary()) for col in (a, b, c))], names=["shard", "kind", "a", "b", "c"])


def _graph_rows(shard: int, nodes: np.ndarray, ids: list[np.ndarray], dist: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), shard), pa.int32()), pa.array(nodes, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in dist], pa.binary())], names=["shard", "node", "ids", "dist"])


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None] - 2 * (x @ y.T)
    return np.maximum(d, 0)


def nearest_per_key(key: np.ndarray, other: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key, other, dist), one per (key, other) and at most ``most`` nearest per key; sorted by key and distance."""
    order = np.lexsort((dist, other, key))
    key, other, dist = key[order], other[order], dist[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])] if len(key) else np.zeros(0, bool)
    key, other, dist = key[fresh], other[fresh], dist[fresh]
    order = np.lexsort((other, dist, key))
    key, other, dist = key[order], other[order], dist[order]
    if len(key):
        starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        key, other, dist = key[rank < most], other[rank < most], dist[rank < most]
    return key, other, dist


def _by_key(key: np.ndarray, *columns: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """key -> slices of the columns; rows are sorted by key."""
    if not len(key):
        return {}
    starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
    ends = np.r_[starts[1:], len(key)]
    return {int(key[s]): tuple(c[s:e] for c in columns) for s, e in zip(starts, ends, strict=True)}


class Forest:
    """Random projections with thresholds at the sample's medians, level by level."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.planes = [rng.standard_normal((sample.shape[1], depth + 1)).astype(np.float32) for _ in range(trees)]
        self.limits = []
        for planes in self.planes:
            y, code, own = sample.astype(np.float32) @ planes, np.zeros(len(sample), dtype=np.int64), []
            for level in range(depth):
                limit = np.zeros(2**level, dtype=np.float32)
                for leaf in np.unique(code):
                    limit[leaf] = np.median(y[code == leaf, level])
                own.append(limit)
                code = 2 * code + (y[:, level] > limit[code])
            self.limits.append(own)

    def leaves(self, tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf, and a last projection by which leaves that are too large are cut."""
        y, code = x.astype(np.float32) @ self.planes[tree], np.zeros(len(x), dtype=np.int64)
        for level in range(self.depth):
            code = 2 * code + (y[:, level] > self.limits[tree][level][code])
        return code, y[:, self.depth]


class NearestNeighbours:
    """The index over the vectors of a table, and the search in it."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> None:
        self.spark, self.k = vectors.sparkSession, k
        self.scratch = Scratch(self.spark, "neighbours")
        element = vectors.schema[vector_col].dataType.elementType
        self.kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
        v = F.col("v")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull())
        rows = rows.filter(finite & F.exists(v, lambda x: x != 0))
        lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        most = lengths.agg(F.max(F.struct("n", (-F.col("d")).alias("d"))).alias("m"), F.sum("n").alias("all")).first()
        self.width = -most["m"]["d"] if most["m"] else 0
        if not self.width:
            return
        if most["all"] > most["m"]["n"]:
            _log.warning("%d vectors are not of the most frequent length %d and take no part", most["all"] - most["m"]["n"], self.width)
        self.rows = rows.filter(F.size("v") == self.width)
        own = Window.partitionBy("v").orderBy("id")
        few = self.rows.distinct().withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k + 1)
        kind, width = self.kind, self.width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width) + 0  # no negative zeros
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in flat], pa.binary())], names=["node", "members", "vec"])

        grouped = few.groupBy("v").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("members")).select("node", "members", "v")
        self.nodes = self.scratch.keep(map_arrow(grouped, pack, "node long, members array<long>, vec binary"), "nodes")
        self.n = self.nodes.count()
        per_shard = max(64, SHARD_BYTES // (2 * K * self.width * np.dtype(self.kind).itemsize))
        self.shards = max(6, -(-self.n // per_shard))

    @property
    def _packed(self):
        """(id, vector) with the vector as bytes."""
        kind, width = self.kind, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width) + 0  # no negative zeros
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], names=["query_id", "vec"])

        return run

    def _dealt(self, messages: DataFrame) -> DataFrame:
        return messages.repartitionById(self.shards, F.col("shard"))

    def first_graph(self) -> DataFrame:
        depth = max(0, min(int(np.ceil(np.log2(max(1, self.n / LEAF)))), int(np.log2(SAMPLE / 8))))
        sample = self.nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").toPandas()["vec"]
        kind, width, shards = self.kind, self.width, self.shards
        forest = self.spark.sparkContext.broadcast(Forest(np.frombuffer(b"".join(sample), dtype=kind).reshape(-1, width), TREES, depth))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _stack(batch.column(1), kind, width) if batch.num_rows else np.zeros((0, width))
                for t in range(TREES):
                    code, y = forest.value.leaves(t, x)
                    yield pa.RecordBatch.from_arrays([pa.array(code + (t << 40)), pa.array(y.astype(np.float64)), batch.column(0), batch.column(1)], names=["leaf", "y", "node", "vec"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [b for b in batches if b.num_rows]
            if not found:
                return
            table = pa.Table.from_batches(found).combine_chunks()
            tree = table.column("leaf").to_numpy() >> 40
            nodes, x = table.column("node").to_numpy(), np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=kind).reshape(-1, width).astype(np.float32)
            for t in np.unique(tree):
                own = np.flatnonzero(tree == t)
                blocks = -(-len(own) // LEAF)
                for block in np.array_split(own, blocks):
                    d = squared_distances(x[block], x[block])
                    np.fill_diagonal(d, np.inf)
                    k = min(K, len(block) - 1)
                    if k < 1:
                        continue
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    a, b, dist = np.repeat(nodes[block], k), nodes[block][near].ravel(), np.take_along_axis(d, near, 1).ravel().astype(np.float32)
                    yield _messages(_split(a, b, dist, shards, "edge"))

        leaves = map_arrow(self.nodes.select("node", "vec"), deal, "leaf long, y double, node long, vec binary")
        ranged = leaves.repartitionByRange(max(6, -(-self.n * TREES // LEAF)), "leaf", "y").sortWithinPartitions("leaf", "y", "node")
        edges = map_arrow(ranged, join, _MESSAGE)
        own = self._own_nodes()
        return self.scratch.keep(map_arrow(self._dealt(edges.unionByName(own)), _merge_edges, _GRAPH), "graph-0")

    def _own_nodes(self) -> DataFrame:
        """A message per node to its shard, so that nodes without edges stay."""
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes = batch.column(0).to_numpy()
                where = shard_of(nodes, shards)
                if len(nodes):
                    yield _messages([(int(s), "node", nodes[where == s], None, None) for s in np.unique(where)])

        return map_arrow(self.nodes.select("node"), run, _MESSAGE)

    def both_ways(self, graph: DataFrame, label: str) -> DataFrame:
        """The graph's rows with the nearest K nodes that name each node as their neighbour added."""
        shards = self.shards

        def reverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _edges_of(batch)
                if len(rows[0]):
                    key, other, dist = nearest_per_key(rows[1], rows[0], rows[2], K)
                    yield _messages(_split(key, other, dist, shards, "reverse") + _split(*rows, shards, "edge"))
                nodes = batch.column(1).to_numpy()
                where = shard_of(nodes, shards)
                yield _messages([(int(s), "node", nodes[where == s], None, None) for s in np.unique(where)])

        return self.scratch.keep(map_arrow(self._dealt(map_arrow(graph, reverse, _MESSAGE)), _merge_both, _GRAPH), label)

    def improve(self, graph: DataFrame, turn: int) -> DataFrame:
        """One round of NN-descent: neighbours of each node are joined with each other."""
        shards, kind, width = self.shards, self.kind, self.width
        both = self.both_ways(graph, f"both-{turn}")

        def wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                for shard in set(batch.column(0).to_pylist()):
                    own = batch.filter(pa.array(np.asarray(batch.column(0).to_numpy() == shard)))
                    ids = np.unique(np.frombuffer(b"".join(own.column(2).to_pylist()), dtype=np.int64))
                    new = np.setdiff1d(ids, seen.get(shard, np.zeros(0, np.int64)))
                    seen[shard] = np.union1d(seen.get(shard, np.zeros(0, np.int64)), new)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), shard), pa.int32()), pa.array(new, pa.int64())], names=["shard", "node"])

        needed = map_arrow(both, wants, "shard int, node long").distinct()
        limit = F.when(F.octet_length("dist") < 4 * K, F.lit(None)).otherwise(F.expr(f"substring(dist, {4 * K - 3}, 4)"))
        known = self.nodes.select("node", "vec").join(graph.select("node", limit.alias("limit")), "node", "left")
        vectors = needed.join(known, "node").select("shard", F.lit("vec").alias("kind"), _as_bytes("node").alias("a"), F.col("vec").alias("b"), F.col("limit").alias("c"))
        lists = both.select("shard", F.lit("list").alias("kind"), _as_bytes("node").alias("a"), F.col("ids").alias("b"), F.lit(None).cast("binary").alias("c"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, nodes, vecs, limits = [], [], [], []
            for batch in batches:
                for kind_, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    if kind_ == "list":
                        lists.append(np.frombuffer(b, dtype=np.int64))
                    else:
                        nodes.append(int.from_bytes(a, "big", signed=True))
                        vecs.append(b)
                        limits.append(np.frombuffer(c, dtype=np.float32)[0] if c is not None else np.inf)
            if not nodes:
                return
            order = np.argsort(nodes)
            nodes = np.array(nodes, dtype=np.int64)[order]
            x = np.frombuffer(b"".join(vecs), dtype=kind).reshape(-1, width).astype(np.float32)[order]
            limits = np.array(limits, dtype=np.float32)[order]
            held: list[list[np.ndarray]] = [[], [], []]
            count = 0
            for ids in lists:
                at = np.searchsorted(nodes, ids)
                if len(at) < 2:
                    continue
                d = squared_distances(x[at], x[at])
                np.fill_diagonal(d, np.inf)
                m = min(PROPOSALS, len(at) - 1)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                dist = np.take_along_axis(d, near, 1)
                i, j = np.nonzero(dist < limits[at][:, None])
                for column, values in zip(held, (nodes[at[i]], nodes[at[near[i, j]]], dist[i, j].astype(np.float32)), strict=True):
                    column.append(values)
                count += len(i)
                if count > 4_000_000:
                    held = [[c] for c in nearest_per_key(*map(np.concatenate, held), K)]
                    count = 0  # what is held never exceeds K per node, nor 4 million besides
            if held[0]:
                proposals = nearest_per_key(*map(np.concatenate, held), K)
                if len(proposals[0]):
                    yield _messages(_split(*proposals, shards, "edge"))

        proposals = map_arrow(self._dealt(lists.unionByName(vectors)), join, _MESSAGE)
        merged = map_arrow(self._dealt(proposals.unionByName(self._as_messages(graph))), _merge_edges, _GRAPH)
        out = self.scratch.keep(merged, f"graph-{turn}")
        self.scratch.drop(f"both-{turn}", f"graph-{turn - 1}")
        return out

    def _as_messages(self, graph: DataFrame) -> DataFrame:
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _edges_of(batch)
                nodes = batch.column(1).to_numpy()
                where = shard_of(nodes, shards)
                yield _messages(_split(*rows, shards, "edge") + [(int(s), "node", nodes[where == s], None, None) for s in np.unique(where)])

        return map_arrow(graph, run, _MESSAGE)

    def build(self) -> DataFrame:
        graph = self.first_graph()
        for turn in range(1, ROUNDS + 1):
            graph = self.improve(graph, turn)
        return self.both_ways(graph, "both")

    def search(self, queries: DataFrame) -> DataFrame:
        """query, ids, dist: the nodes found for each query node (column ``query``), nearest first."""
        shards, kind, width = self.shards, self.kind, self.width
        graph = self.build()
        vectors = self.nodes.select(F.lit("vec").alias("kind"), _as_bytes("node").alias("a"), F.col("vec").alias("b"), F.col("node"))

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                where = shard_of(batch.column(3).to_numpy(), shards)
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), batch.column(0), batch.column(1), batch.column(2), pa.nulls(batch.num_rows, pa.binary())], names=["shard", "kind", "a", "b", "c"])

        vectors = self.scratch.keep(map_arrow(vectors, locate, _MESSAGE), "vectors")
        lists = graph.select("shard", F.lit("list").alias("kind"), _as_bytes("node").alias("a"), F.col("ids").alias("b"), F.lit(None).cast("binary").alias("c"))
        own = queries.join(self.nodes.select(F.col("node").alias("query"), "vec"), "query").select("query", "vec")
        state = own.join(graph.select(F.col("node").alias("query"), "ids", "dist"), "query").select("query", "vec", "ids", "dist", F.lit(None).cast("binary").alias("done"))
        state = self.scratch.keep(map_arrow(state, _first_state, "query long, vec binary, ids binary, dist binary, done binary"), "state-0")

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """To the shard of each node to expand: (node, query)."""
            for batch in batches:
                a, b = [], []
                for query, ids, done in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    front = _front(np.frombuffer(ids, dtype=np.int64), np.frombuffer(done, dtype=np.int64))
                    a.append(front)
                    b.append(np.full(len(front), query))
                if a and sum(map(len, a)):
                    node, query = np.concatenate(a), np.concatenate(b)
                    where = shard_of(node, shards)
                    yield _messages([(int(s), "ask", node[where == s], query[where == s], None) for s in np.unique(where)])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The expanded nodes' neighbours, to the neighbours' shards: (neighbour, query)."""
            lists, asked = {}, [[], []]
            for batch in batches:
                for kind_, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if kind_ == "list":
                        lists[int.from_bytes(a, "big", signed=True)] = np.frombuffer(b, dtype=np.int64)
                    else:
                        asked[0].append(np.frombuffer(a, dtype=np.int64))
                        asked[1].append(np.frombuffer(b, dtype=np.int64))
            if not asked[0]:
                return
            node, query = map(np.concatenate, asked)
            near = [lists[x] for x in node.tolist()]
            pairs = np.stack([np.concatenate(near), np.repeat(query, [len(x) for x in near])])
            pairs = np.unique(pairs, axis=1)
            where = shard_of(pairs[0], shards)
            yield _messages([(int(s), "pair", np.ascontiguousarray(pairs[0][where == s]), np.ascontiguousarray(pairs[1][where == s]), None) for s in np.unique(where)])

        def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The queries of each shard's new candidates."""
            for batch in batches:
                for shard, query in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = np.unique(np.frombuffer(query, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard), pa.int32()), pa.array(own)], names=["shard", "query"])

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Distances of the pairs whose nodes this shard holds."""
            nodes, vecs, queries, qvecs, pairs = [], [], [], [], [[], []]
            for batch in batches:
                for kind_, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if kind_ == "vec":
                        nodes.append(int.from_bytes(a, "big", signed=True))
                        vecs.append(b)
                    elif kind_ == "query":
                        queries.append(int.from_bytes(a, "big", signed=True))
                        qvecs.append(b)
                    else:
                        pairs[0].append(np.frombuffer(a, dtype=np.int64))
                        pairs[1].append(np.frombuffer(b, dtype=np.int64))
            if not pairs[0] or not nodes:
                return
            order, nodes = np.argsort(nodes), np.array(nodes, dtype=np.int64)
            nodes, x = nodes[order], np.frombuffer(b"".join(vecs), dtype=kind).reshape(-1, width).astype(np.float32)[order]
            order, queries = np.argsort(queries), np.array(queries, dtype=np.int64)
            queries, y = queries[order], np.frombuffer(b"".join(qvecs), dtype=kind).reshape(-1, width).astype(np.float32)[order]
            found = np.unique(np.stack(list(map(np.concatenate, pairs))), axis=1)
            out = [[], [], []]
            for part in np.array_split(found, max(1, found.shape[1] // 100_000), axis=1):
                diff = x[np.searchsorted(nodes, part[0])] - y[np.searchsorted(queries, part[1])]
                for column, values in zip(out, nearest_per_key(part[1], part[0], np.einsum("ij,ij->i", diff, diff), BEAM), strict=True):
                    column.append(values)
            key, node, dist = nearest_per_key(*map(np.concatenate, out), BEAM)
            groups = _by_key(key, node, dist)
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int64()), pa.nulls(len(groups), pa.binary()), *(pa.array([np.ascontiguousarray(g[i]).tobytes() for g in groups.values()], pa.binary()) for i in (0, 1)), pa.nulls(len(groups), pa.binary())], names=["query", "vec", "ids", "dist", "done"])

        schema = "query long, vec binary, ids binary, dist binary, done binary"
        for step in range(1, STEPS + 1):
            asks = map_arrow(state, expand, _MESSAGE)
            pairs = self.scratch.keep(map_arrow(self._dealt(lists.unionByName(asks)), answer, _MESSAGE), f"pairs-{step}")
            if pairs.isEmpty():
                break
            wanted = map_arrow(pairs.select("shard", "b"), shards_of, "shard int, query long").distinct()
            sent = wanted.join(state.select("query", "vec"), "query").select("shard", F.lit("query").alias("kind"), _as_bytes("query").alias("a"), F.col("vec").alias("b"), F.lit(None).cast("binary").alias("c"))
            found = map_arrow(self._dealt(vectors.unionByName(pairs).unionByName(sent)), measure, schema)
            state = self.scratch.keep(map_arrow(found.unionByName(state).repartition("query"), _merge_states, schema), f"state-{step}")
            self.scratch.drop(f"pairs-{step}", f"state-{step - 1}")
        return state.select("query", "ids", "dist")

    def query(self, is_query) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest found for every row where is_query(id column) holds."""
        schema = "query_id long, rank int, vec_id long, score double"
        if not self.width:
            return self.spark.createDataFrame([], schema)
        asked = self.rows.filter(is_query(F.col("id"))).distinct()
        first = self.nodes.select("node", "vec")
        asked = self.scratch.keep(map_arrow(asked, self._packed, "query_id long, vec binary").join(first, "vec").select("query_id", F.col("node").alias("query")), "asked")
        sizes = self.scratch.keep(asked.groupBy("query").agg(F.count(F.lit(1)).alias("ids")), "sizes")
        found = self.search(sizes.select("query"))
        kind, width, k = self.kind, self.width, self.k

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                query, node = [], []
                for q, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = np.unique(np.r_[np.frombuffer(ids, dtype=np.int64)[:REFINED], q])
                    query.append(np.full(len(own), q))
                    node.append(own)
                if query:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (query, node)], names=["query", "node"])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (_stack(batch.column(i), kind, width).astype(np.float64) for i in (2, 3))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sqrt(((x - y) ** 2).sum(axis=1)))], names=["query", "members", "score"])

        pairs = map_arrow(found.select("query", "ids"), nearest, "query long, node long")
        pairs = pairs.join(self.nodes.select("node", "members", "vec"), "node").join(self.nodes.select(F.col("node").alias("query"), F.col("vec").alias("query_vec")), "query")
        measured = map_arrow(pairs.select("query", "members", "vec", "query_vec"), exact, "query long, members array<long>, score double")
        # k + 1 rows of a node are enough for each id that shares it, as one of them may be that id itself.
        near = measured.select("query", F.explode("members").alias("vec_id"), "score").groupBy("query", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query").orderBy("score", "vec_id")
        near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
        lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("list"))
        lists = self.scratch.keep(lists.join(sizes, "query"), "lists")
        own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
        rows = join_groups(asked, lists, ["query"], "ids").select("query_id", F.posexplode(own).alias("place", "x"))
        return rows.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _split(a: np.ndarray, b: np.ndarray, dist: np.ndarray, shards: int, kind: str) -> list[tuple]:
    """Edges a -> b as one message to each shard of a."""
    where = shard_of(a, shards)
    order = np.argsort(where, kind="stable")
    a, b, dist, where = a[order], b[order], dist[order], where[order]
    starts = np.r_[0, np.flatnonzero(where[1:] != where[:-1]) + 1] if len(where) else []
    ends = np.r_[starts[1:], len(where)] if len(where) else []
    return [(int(where[s]), kind, np.ascontiguousarray(a[s:e]), np.ascontiguousarray(b[s:e]), np.ascontiguousarray(dist[s:e])) for s, e in zip(starts, ends, strict=True)]


def _edges_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = batch.column(1).to_numpy()
    ids, dist = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    counts = [len(x) // 8 for x in ids]
    return np.repeat(nodes, counts), np.frombuffer(b"".join(ids), dtype=np.int64), np.frombuffer(b"".join(dist), dtype=np.float32)


def _collect(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[str, list]]:
    """shard -> kind -> messages."""
    found: dict[int, dict[str, list]] = {}
    for batch in batches:
        for shard, kind, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            rest = None if b is None else (np.frombuffer(b, dtype=np.int64), np.frombuffer(c, dtype=np.float32))
            found.setdefault(shard, {}).setdefault(kind, []).append((np.frombuffer(a, dtype=np.int64), rest))
    return found


def _edge_arrays(messages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not messages:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate([m[0] for m in messages]), np.concatenate([m[1][0] for m in messages]), np.concatenate([m[1][1] for m in messages])


def _merge_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's graph: for each of its nodes the K nearest of all edges sent."""
    for shard, kinds in _collect(batches).items():
        nodes = np.unique(np.concatenate([m[0] for m in kinds["node"]]))
        groups = _by_key(*nearest_per_key(*_edge_arrays(kinds.get("edge", [])), K))
        none = (np.zeros(0, np.int64), np.zeros(0, np.float32))
        lists = [groups.get(x, none) for x in nodes.tolist()]
        yield _graph_rows(shard, nodes, [x[0] for x in lists], [x[1] for x in lists])


def _merge_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _merge_edges, but with the K nearest by either direction."""
    for shard, kinds in _collect(batches).items():
        nodes = np.unique(np.concatenate([m[0] for m in kinds["node"]]))
        parts = [nearest_per_key(*_edge_arrays(kinds.get(x, [])), K) for x in ("edge", "reverse")]
        groups = _by_key(*nearest_per_key(*(np.concatenate(c) for c in zip(*parts, strict=True)), 2 * K))
        none = (np.zeros(0, np.int64), np.zeros(0, np.float32))
        lists = [groups.get(x, none) for x in nodes.tolist()]
        yield _graph_rows(shard, nodes, [x[0] for x in lists], [x[1] for x in lists])


def _first_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [np.array([q], dtype=np.int64).tobytes() for q in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(done, pa.binary())], names=["query", "vec", "ids", "dist", "done"])


def _front(ids: np.ndarray, done: np.ndarray) -> np.ndarray:
    beam = ids[:BEAM]
    return beam[~np.isin(beam, done)][:EXPAND]


def _merge_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's beam and what its last round found; the nodes it expanded are done."""
    vecs, done, found = {}, {}, {}
    for batch in batches:
        for q, vec, ids, dist, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            ids, dist = np.frombuffer(ids, dtype=np.int64), np.frombuffer(dist, dtype=np.float32)
            found.setdefault(q, []).append((ids, dist))
            if vec is not None:
                vecs[q] = vec
                past = np.frombuffer(own, dtype=np.int64)
                done[q] = np.concatenate([past, _front(ids, past)])
    if not vecs:
        return
    rows = []
    for q, vec in vecs.items():
        ids, dist = (np.concatenate([x[i] for x in found[q]]) for i in (0, 1))
        other = ids != q
        _, ids, dist = nearest_per_key(np.zeros(int(other.sum()), np.int64), ids[other], dist[other], BEAM)
        rows.append((q, vec, ids.tobytes(), dist.tobytes(), done[q].tobytes()))
    columns = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["query", "vec", "ids", "dist", "done"])


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance for the rows where is_query(id) holds."""
    return NearestNeighbours(vectors, id_col, vector_col, k).query(is_query)
