"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard, searched by beams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table
from .vectors import usable

SHARD = 4096  # vectors of one graph, about
DEGREE = 24  # edges kept by pruning; a node may gather twice as many before it is pruned again
RELAX = 1.2  # an edge goes if another neighbour is nearer to its end by this factor
BUILD_BEAM, SEARCH_BEAM = 64, 160
PER_STEP = 4  # nodes of a beam expanded at once
TOGETHER = 256  # searches run side by side
QUERY_BLOCK = 4096  # queries that meet a shard at once, about
NONE = -1


def distances(points: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of targets[i] to the points ids[i, :]."""
    apart = points[ids] - targets[:, None, :]
    return np.einsum("qmd,qmd->qm", apart, apart)


class Graph:
    """A directed graph over the rows of ``points``, entered at the row nearest to their mean.

    ``edges`` has a row of neighbours per node, filled up with NONE. The last column is
    kept for bridges, so that every node can be reached from the entry.
    """

    def __init__(self, points: np.ndarray, degree: int = DEGREE, edges: np.ndarray | None = None, entry: int | None = None):
        self.points, self.degree = points, degree
        self.edges = np.full((len(points), 2 * degree + 1), NONE, np.int32) if edges is None else edges
        self.entry = int(distances(points, np.arange(len(points))[None], points.mean(axis=0)[None])[0].argmin()) if entry is None else entry

    def search(self, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each target the ids and squared distances of the ``beam`` nearest nodes met, nearest first; NONE and infinity at the end.

        A greedy search from the entry: the nearest nodes of the beam that were not expanded are, until all were.
        """
        n, rows = len(targets), np.arange(len(targets))[:, None]
        ids = np.full((n, beam), NONE, np.int64)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, len(self.points) + 1), bool)  # the last is for NONE
        seen[:, NONE] = True
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        dist[:, 0] = distances(self.points, ids[:, :1], targets)[:, 0]
        active = np.arange(n)
        while len(active):
            here = rows[: len(active)]
            place = np.argsort(done[active], axis=1, kind="stable")[:, :PER_STEP]  # beams are sorted by distance
            open_ = ~done[active[:, None], place]
            from_ = np.where(open_, ids[active[:, None], place], NONE)
            done[active[:, None], place] = True
            found = np.where(from_[:, :, None] == NONE, NONE, self.edges[from_]).reshape(len(active), -1).astype(np.int64)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = NONE
            found[seen[active[:, None], found]] = NONE
            found = -np.sort(-found, axis=1)
            found = found[:, : max(1, int((found != NONE).sum(axis=1).max()))]
            seen[active[:, None], found] = True
            far = np.where(found == NONE, np.inf, distances(self.points, found, targets[active]))
            all_ids, all_dist = np.concatenate([ids[active], found], axis=1), np.concatenate([dist[active], far], axis=1)
            all_done = np.concatenate([done[active], found == NONE], axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[active], dist[active], done[active] = all_ids[here, order], all_dist[here, order], all_done[here, order]
            active = active[~done[active].all(axis=1)]
        return ids, dist

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The edges kept for each node: the nearest candidate, then again the nearest of those to which no kept one is nearer by RELAX."""
        kept = np.full((len(nodes), self.degree), NONE, np.int64)
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = NONE
        candidates[candidates == nodes[:, None]] = NONE
        rows = np.arange(len(nodes))
        dist = np.where(candidates == NONE, np.inf, distances(self.points, candidates, self.points[nodes]))
        order = np.argsort(dist, axis=1, kind="stable")
        candidates, dist = candidates[rows[:, None], order], dist[rows[:, None], order]
        width = max(1, int(np.isfinite(dist).sum(axis=1).max(initial=0)))
        candidates, dist = candidates[:, :width], dist[:, :width]
        own = self.points[candidates]
        norm = np.einsum("bcd,bcd->bc", own, own)
        between = norm[:, :, None] + norm[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
        alive = np.isfinite(dist)
        for k in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            kept[some, k] = candidates[rows[some], first[some]]
            alive &= RELAX**2 * between[rows, first] > dist
            alive[rows, first] = False
        return kept

    def insert(self, nodes: np.ndarray, beam: int) -> None:
        """Link nodes with what a search for them meets, and back."""
        met, _ = self.search(self.points[nodes], beam)
        kept = np.concatenate([self.prune(nodes[k : k + 64], np.concatenate([met[k : k + 64], self.edges[nodes[k : k + 64]]], axis=1)) for k in range(0, len(nodes), 64)])
        self.edges[nodes] = NONE
        self.edges[nodes, : self.degree] = kept
        to, from_ = kept.ravel(), np.repeat(nodes, kept.shape[1])
        from_, to = from_[to != NONE], to[to != NONE]
        order = np.lexsort((from_, to))
        from_, to = from_[order], to[order]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        for k in range(0, len(ends), 64):
            self.gather(ends[k : k + 64], first[k : k + 64], count[k : k + 64], from_)

    def gather(self, ends: np.ndarray, first: np.ndarray, count: np.ndarray, from_: np.ndarray) -> None:
        """Add edges back to the nodes that asked; a node with too many is pruned."""
        new = np.full((len(ends), int(count.max())), NONE, np.int64)
        slot = np.arange(new.shape[1])[None] < count[:, None]
        new[slot] = from_[np.concatenate([np.arange(a, a + c) for a, c in zip(first, count, strict=True)])]
        old = self.edges[ends].astype(np.int64)
        new[(new[:, :, None] == old[:, None, :]).any(axis=2)] = NONE
        both = -np.sort(-np.concatenate([old, new], axis=1), axis=1)
        room = 2 * self.degree
        over = (both != NONE).sum(axis=1) > room
        self.edges[ends[~over], :room] = both[~over, :room] if both.shape[1] >= room else both[~over]
        if over.any():
            self.edges[ends[over]] = NONE
            self.edges[ends[over], : self.degree] = self.prune(ends[over], both[over])

    def reached(self) -> np.ndarray:
        seen = np.zeros(len(self.points), bool)
        seen[self.entry], front = True, np.array([self.entry])
        while len(front):
            front = np.unique(self.edges[front])
            front = front[(front != NONE)]
            front = front[~seen[front]]
            seen[front] = True
        return seen

    def bridge(self) -> None:
        """Link every node that the entry does not reach from a near node that has no bridge yet."""
        while not (seen := self.reached()).all():
            lost = int(np.flatnonzero(~seen)[0])
            near, _ = self.search(self.points[[lost]], BUILD_BEAM)
            near = near[0][near[0] != NONE]
            free = near[self.edges[near, -1] == NONE]
            at = free[0] if len(free) else np.flatnonzero(seen & (self.edges[:, -1] == NONE))[0]
            self.edges[at, -1] = lost

    @classmethod
    def build(cls, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
        """Insert all points in random order, in batches that double at first, then all once more."""
        graph = cls(points, degree)
        order = np.random.default_rng(0).permutation(len(points))
        order = order[order != graph.entry]
        at = 0
        while at < len(order):
            size = min(TOGETHER, at + 1)
            graph.insert(order[at : at + size], beam)
            at += size
        for at in range(0, len(order), TOGETHER):
            graph.insert(order[at : at + TOGETHER], beam)
        graph.bridge()
        return graph


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, most: int) -> DataFrame:
    """The distinct usable vectors: ``node``, ``dim``, ``v`` and ``ids``, the ``most`` smallest ids that have it."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= most)
    found = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return staged(found.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("dim"), "v", "ids"))


def build_index(classes: DataFrame, shard: int = SHARD, degree: int = DEGREE, beam: int = BUILD_BEAM) -> DataFrame:
    """One row per shard: ``dim``, ``shard``, the nodes, their ids, their vectors, the edges and the entry. Every node is in one shard."""
    # n distinct lengths need at least n * (n - 1) / 2 components, so even for 100 TB of vectors this table is small
    lengths = classes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("long").alias("shards"))
    shards = (
        classes.join(F.broadcast(lengths), "dim")
        .groupBy("dim", "shards", F.pmod(F.xxhash64("node"), "shards").alias("shard"))
        .agg(F.sort_array(F.collect_list(F.struct("node", "ids", "v"))).alias("rows"))
        .select("dim", "shards", "shard", F.col("rows.ids").alias("ids"), F.flatten("rows.v").alias("v"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                points = batch.column("v")[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, batch.column("dim")[k].as_py())
                graph = Graph.build(points, degree, beam)
                more = [pa.array([graph.edges.ravel()], pa.list_(pa.int32())), pa.array([graph.entry], pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *more], [*batch.schema.names, "edges", "entry"])

    vector = classes.schema["v"].dataType.simpleString()
    return staged(shards.mapInArrow(run, f"dim int, shards long, shard long, ids array<array<long>>, v {vector}, edges array<int>, entry int"))


def search_index(index: DataFrame, queries: DataFrame, most: int, beam: int = SEARCH_BEAM, degree: int = DEGREE) -> DataFrame:
    """queries: node, dim, v. Returns ``node`` and ``near``: structs of score and id, the ``most`` nearest ids, ties to smaller ids.

    Blocks of queries meet every shard of their dimension; each shard returns its nearest, which are merged.
    """
    lengths = index.select("dim", "shards").distinct().collect()  # MOST_LENGTHS at most
    number = F.coalesce(*[F.when(F.col("dim") == r["dim"], F.lit(r["shards"])) for r in lengths], F.lit(1)).cast("long")
    parts = F.lit(math.ceil(queries.count() / QUERY_BLOCK)).cast("long")
    blocks = queries.withColumn("shards", number).groupBy("dim", "shards", F.pmod(F.xxhash64("node"), parts).alias("block")).agg(F.sort_array(F.collect_list(F.struct("node", "v"))).alias("rows"))
    blocks = staged(blocks.select("dim", "shards", "block", F.col("rows.node").alias("nodes"), F.flatten("rows.v").alias("q")))
    pairs = blocks.select("dim", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    met = pairs.join(index.drop("shards"), ["dim", "shard"]).join(blocks.drop("shards"), ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                flat = lambda name: batch.column(name)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                dim = batch.column("dim")[k].as_py()
                points, targets = flat("v").astype(np.float64).reshape(-1, dim), flat("q").astype(np.float64).reshape(-1, dim)
                graph = Graph(points, degree, flat("edges").reshape(len(points), -1), batch.column("entry")[k].as_py())
                ids, nodes = batch.column("ids")[k].as_py(), flat("nodes")
                for at in range(0, len(targets), TOGETHER):
                    met, far = graph.search(targets[at : at + TOGETHER], beam)
                    rows = []
                    for i, (own, squares) in enumerate(zip(met, far, strict=True)):
                        score = np.sqrt(squares)
                        near = sorted((float(s), x) for m, s in zip(own, score, strict=True) if m != NONE for x in ids[m])[:most]
                        rows.extend((nodes[at + i], s, x) for s, x in near)
                    node, score, found = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(score, pa.float64()), pa.array(found, pa.int64())], ["node", "score", "id"])

    found = met.select("dim", "nodes", "q", "ids", "v", "edges", "entry").mapInArrow(run, "node long, score double, id long")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("score", "id"))).where(F.col("r") <= most)
    return best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest rows of vectors to each row of queries (rows of vectors, too) by Euclidean distance: ``query``, ``rank``, ``id``, ``score``.

    All rows are indexed and all shards searched; fewer than k come back only if there are fewer candidates.
    Equal vectors are one node of a graph and give their smallest ids, so ties between copies go to smaller
    ids. A query's own id is no candidate. Null and zero vectors, such with null or non-finite components and
    rows without an id take no part; vectors of different lengths are not compared.
    Rows that repeat an id and a vector count once, as candidates and as queries. Empty tables
    give none. Only the two named columns are read.
    """
    classes = classes_of(vectors, id_col, vector_col, k + 1)
    index = build_index(classes, shard)
    rows = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("query").isNotNull()).distinct()
    asked = staged(rows.join(classes, "v").select("query", "node"))
    found = staged(search_index(index, classes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "dim", "v"), k + 1, beam))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query")), 1, k)
    return asked.join(found, "node").select("query", F.posexplode(others).alias("place", "x")).select("query", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
