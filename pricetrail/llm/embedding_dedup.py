"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, staged, table
from .components import components
from .vectors import matrix, unit, usable

THRESHOLD = 0.93
BLOCK = 1024  # vectors that are multiplied at once, about
FIT_ROWS = 20_000  # vectors that the cells are fitted on, about
ROUNDS = 10


def fit_cells(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """The unit centres of k spherical k-means cells of unit vectors."""
    rng = np.random.default_rng(0)
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = vectors @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        empty = np.linalg.norm(sums, axis=1) < 1e-12
        sums[empty] = vectors[near.max(axis=1).argsort()[: empty.sum()]]  # the vectors that fit worst
        centres = unit(sums)
    return centres


def borders(vectors: np.ndarray, centres: np.ndarray, cell: int, threshold: float) -> np.ndarray:
    """For unit vectors of a cell and each cell: whether a partner at the threshold can lie there.

    A partner in cell b is nearer to centre b, so the path to it crosses the plane half-way
    between the centres; the vector's angle to the plane is then no more than the partner's.
    """
    apart = centres[cell] - centres
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) * np.linalg.norm(apart, axis=1)
    return vectors @ apart.T <= reach + 1e-9


def links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """classes: node (long, unique), n (rows it stands for), label, v (usable, distinct within a label).

    Returns ``node``, ``links`` and ``root``: of each linked node how many rows it is linked with by some pair
    of blocks, and the least node that it reaches inside those. All pairs of
    a label with a cosine of ``threshold`` or more are found. Vectors are compared within their
    cell, and with those of another cell if both lie near enough to the border between the
    cells; whole blocks away from it are left out before they meet.
    """
    total = classes.count()
    share = F.xxhash64(F.lit(3), "node") / F.lit(2.0**64) + 0.5 <= F.lit(min(1.0, fit_rows / max(total, 1)))
    drawn: dict[int, list] = {}
    for r in classes.where(share).select("v").collect():
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    cells = math.ceil(math.sqrt(total / block))
    centres = {dim: fit_cells(unit(np.array(rows, np.float64)), cells) for dim, rows in drawn.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x) for x in batch.column("v")], np.int64)
            cell = np.zeros(len(dims), np.int32)
            for dim in set(dims.tolist()) & centres.keys():
                own = np.flatnonzero(dims == dim)
                cell[own] = (unit(matrix(batch.column("v").take(pa.array(own)), dim)) @ centres[dim].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell)], [*batch.schema.names, "dim", "cell"])

    vector = classes.schema["v"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    placed = staged(classes.select("node", "n", "label", "v").mapInArrow(assign, f"node long, n long, label {label}, v {vector}, dim long, cell int"))
    where = ["label", "dim", "cell"]
    sizes = staged(placed.groupBy(*where).agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")))
    gathered = (
        placed.join(sizes, where)
        .groupBy(*where, F.pmod(F.xxhash64("node"), "blocks").alias("t"))
        .agg(F.collect_list(F.struct("node", "n", "v")).alias("rows"))
        .select(*where, "t", F.col("rows.node").alias("nodes"), F.col("rows.n").alias("counts"), F.flatten("rows.v").alias("v"))
    )

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                dim, cell = batch.column("dim")[k].as_py(), batch.column("cell")[k].as_py()
                if dim in centres:
                    rows = unit(batch.column("v")[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                    near = np.flatnonzero(borders(rows, centres[dim], cell, threshold).any(axis=0))
                else:
                    near = np.array([cell])
                found.append(near.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "reach"])

    blocks = gathered.mapInArrow(reach, f"label {label}, dim long, cell int, t long, nodes array<long>, counts array<long>, v {vector}, reach array<int>")
    blocks = staged(blocks.withColumn("block", F.monotonically_increasing_id()))
    here = blocks.select("label", "dim", F.col("cell").alias("to"), "t", "block", "reach")
    asked = blocks.select("label", "dim", "cell", F.col("t").alias("t1"), F.col("block").alias("b1"), F.explode("reach").alias("to")).where("cell <= to")
    pairs = asked.join(here, ["label", "dim", "to"]).where("(cell = to and t1 <= t) or (cell < to and array_contains(reach, cell))").select("b1", F.col("block").alias("b2"))
    side = lambda i: blocks.select(F.col("block").alias(f"b{i}"), F.col("dim").alias(f"d{i}"), F.col("cell").alias(f"c{i}"), F.col("nodes").alias(f"nodes{i}"), F.col("counts").alias(f"counts{i}"), F.col("v").alias(f"v{i}"))
    met = pairs.join(side(1), "b1").join(side(2), "b2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(name)[k].as_py()  # noqa: B023, E731
                flat = lambda name: batch.column(name)[k].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                dim, same = get("d1"), get("b1") == get("b2")
                x, y = (unit(flat(v).astype(np.float64).reshape(-1, dim)) for v in ("v1", "v2"))
                a, b = np.arange(len(x)), np.arange(len(y))
                if get("c1") != get("c2"):
                    a = np.flatnonzero(borders(x, centres[dim], get("c1"), threshold)[:, get("c2")])
                    b = np.flatnonzero(borders(y, centres[dim], get("c2"), threshold)[:, get("c1")])
                i, j = np.nonzero(x[a] @ y[b].T >= threshold)
                i, j = a[i], b[j]
                if same:
                    i, j = i[i != j], j[i != j]
                if not len(i):
                    continue
                shift = 0 if same else len(x)
                nodes = flat("nodes1") if same else np.concatenate([flat("nodes1"), flat("nodes2")])
                number = np.bincount(i, flat("counts2")[j], len(nodes))
                if not same:
                    number += np.bincount(j + shift, flat("counts1")[i], len(nodes))
                root = np.arange(len(nodes))
                item, low = forest(i, j + shift, len(nodes))
                root[item] = low
                linked = np.flatnonzero(number)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(number[linked].astype(np.int64)), pa.array(nodes[root[linked]])], ["node", "links", "root"])

    return met.select("b1", "b2", "d1", "c1", "c2", "nodes1", "nodes2", "counts1", "counts2", "v1", "v2").mapInArrow(compare, "node long, links long, root long")


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of vectors: ``id``, ``n_links``, ``component`` and ``kept``.

    Rows of one label link at a cosine of ``threshold`` or more; ``n_links`` counts the
    other rows a row is linked with, ``component`` is the least id its links reach,
    and ``kept`` marks the row that has it. Equal vectors of a label are one class: they are linked
    with each other and compared with others once. Null labels, null or zero vectors and such with null
    or non-finite components link with nothing; vectors of different lengths do not link.
    Rows that repeat an id are rows like others; a null id is linked but names no group and is
    not kept. An empty table gives none. Only the three named columns are read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    classes = staged(rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = staged(links(classes, threshold, block, fit_rows))
    roots = components(found.select("node", "root"), "node", "root")
    number = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = staged(classes.join(number, "node", "left").join(roots, "node", "left").select("label", "v", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    least = staged(named.groupBy("root").agg(F.min("first").alias("component")))
    of = staged(named.join(least, "root").select("label", "v", "n_links", "component"))
    linked = rows.where("ok").join(of, ["label", "v"]).select("id", "n_links", "component")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
