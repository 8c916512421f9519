"""Embedding whitening by shifted CholeskyQR over distributed Gram passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

COMPONENTS = 32
PASSES = 8  # Gram passes, at most; three do for vectors of full rank
ROUNDING = 2.0**-53
ORTHOGONAL = 1e-12  # how far a Gram matrix may be from the identity
SCALE, OFFSET = 64, 1_000_000  # of the whole numbers that the query whitens
LARGEST = float(1 << 45)
EXACT = 1 << 62

Step = Callable[[np.ndarray], np.ndarray]


@dataclass
class Model:
    """What is fitted on the vectors of one length."""

    n: int
    sums: list[int]
    spread: float = 0.0  # trace of the Gram matrix of the centred rows
    factors: tuple[np.ndarray, ...] = ()  # upper triangular; their product, the last first, is R
    vectors: np.ndarray | None = None  # unit components, a column each
    values: np.ndarray | None = None  # variances along them

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as double, from whole numbers as long as they fit."""
        if self.n * (max_abs(x) + 1) < EXACT:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over the dimensions of (n*x - S)^2 of each row, exactly; null where it does not fit into a long."""
        if self.n * (max_abs(x) + 1) < EXACT:
            apart = self.n * x - np.array(self.sums, np.int64)
            if max_abs(apart) ** 2 * x.shape[1] < EXACT:
                return (apart * apart).sum(axis=1).tolist()
        found = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [f if f < 1 << 63 else None for f in found]

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        """The centred rows times the inverse of R, by one triangular solve for each factor."""
        rows = self.centred(x)
        for r in self.factors:
            rows = solve(rows, r)
        return rows

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def max_abs(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q of Q R = rows for an upper triangular R, a column after the other."""
    q = np.empty_like(rows)
    for j in range(r.shape[0]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a batch by length: the length, their places in the batch, and the rows as int64."""
    column = batch.column("x")
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        if d:
            at = np.flatnonzero(lengths == d)
            yield int(d), at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def totals(vectors: DataFrame) -> dict[int, Model]:
    """The number and the exact sums of the vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                exact = x if max_abs(x) * len(x) < EXACT else x.astype(object)
                own = [len(x), *exact.sum(axis=0).tolist()]
                found[d] = [a + b for a, b in zip(found[d], own, strict=True)] if d in found else own
        for d, sums in found.items():
            columns = [pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array(sums, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "i", "total"])

    sums = vectors.select("x").mapInArrow(run, "d int, i int, total decimal(38,0)").groupBy("d", "i").agg(F.sum("total").alias("total"))
    by: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # one row for each dimension
        by.setdefault(r["d"], {})[r["i"]] = int(r["total"])
    return {d: Model(own[-1], [own[i] for i in range(d)]) for d, own in by.items()}


def added_up(vectors: DataFrame, steps: dict[int, Step]) -> dict[int, np.ndarray]:
    """The sum of a matrix that a step makes of the rows of each length.

    Every task adds up its own rows; the rows of the tasks' matrices are dealt out by their number and
    added in the order of the tasks, so that reruns agree. The driver gets one matrix a length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                if d in steps:
                    own = steps[d](x)
                    found[d] = found[d] + own if d in found else own
        task = TaskContext.get().partitionId()
        for d, own in found.items():
            columns = [pa.array([d] * len(own), pa.int32()), pa.array(range(len(own)), pa.int32()), pa.array([task] * len(own), pa.int32()), pa.array(list(own), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "i", "task", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, row in zip(batch.column("d").to_pylist(), batch.column("i").to_pylist(), batch.column("row"), strict=True):
                own = row.values.to_numpy()
                found[d, i] = found[d, i] + own if (d, i) in found else own
        columns = [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["d", "i", "row"])

    if not steps:
        return {}
    parts = vectors.select("x").mapInArrow(run, "d int, i int, task int, row array<double>")
    sums = parts.repartition("d", "i").sortWithinPartitions("d", "i", "task").mapInArrow(add, "d int, i int, row array<double>")
    by: dict[int, dict[int, list]] = {}
    for r in sums.collect():
        by.setdefault(r["d"], {})[r["i"]] = r["row"]
    return {d: np.array([own[i] for i in sorted(own)]) for d, own in by.items()}


def settled(gram: np.ndarray) -> bool:
    """Whether columns are orthonormal, but for those that depend on earlier ones and have vanished."""
    size = np.diag(gram)
    live = size > 0.5
    return bool(np.abs(gram[np.ix_(live, live)] - np.eye(live.sum())).max(initial=0) <= ORTHOGONAL and size[~live].max(initial=0) <= ORTHOGONAL)


def factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """R of a Gram matrix by Cholesky: shifted in the first pass, and later where it does not exist otherwise."""
    d = len(gram)
    if not first:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            n = 0
    shift = 11 * (n * d + d * (d + 1)) * ROUNDING * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def finish(model: Model, gram: np.ndarray, most: int) -> None:
    """Components from the SVD of R; what the last Gram matrix is off the identity is part of R."""
    size, turn = np.linalg.eigh(gram)
    r = (turn * np.sqrt(np.maximum(size, 0))) @ turn.T
    for f in reversed(model.factors):
        r = r @ f
    _, sigma, axes = np.linalg.svd(r)
    noise = 8 * ROUNDING * max(abs(s / model.n) for s in model.sums) * np.sqrt(model.n * len(r))
    rank = int((sigma > max(1e-10 * sigma[0], noise)).sum())
    model.vectors, model.values = axes[: min(rank, most)].T, sigma[: min(rank, most)] ** 2 / model.n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors (``x``: array of long without nulls).

    The first pass gives exact sums. Each further one solves the centred rows by the factors known so
    far and adds up the Gram matrix of what comes out; its Cholesky factor is the next, until the rows are
    orthonormal. The SVD of the factors' product gives the components. A pass holds d x d
    numbers a task; the driver holds as many, whatever the number of rows. Components without variance
    (below 1e-10 of the largest deviation) are left out, so equal vectors have none.
    """
    models = totals(vectors)
    open_ = dict(models)
    for k in range(PASSES):
        gram_of = lambda m: lambda x: (q := m.orthogonal(x)).T @ q
        for d, gram in added_up(vectors, {d: gram_of(m) for d, m in open_.items()}).items():
            model = open_[d]
            if not k:
                model.spread = float(np.trace(gram))
            if not model.spread:
                model.vectors, model.values = np.zeros((d, 0)), np.zeros(0)
            elif settled(gram) or k == PASSES - 1:
                finish(model, gram, components)
            else:
                model.factors += (factor(gram, model.n, not k),)
                continue
            del open_[d]
    return models


def identity_error(vectors: DataFrame, models: dict[int, Model]) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; 0 without components."""

    def step(model: Model) -> Step:
        return lambda x: np.vstack([(w := model.whitened(x)).T @ w, w.sum(axis=0)])

    worst = 0.0
    for d, own in added_up(vectors, {d: step(m) for d, m in models.items() if len(m.values)}).items():
        mean = own[-1] / models[d].n
        covariance = own[:-1] / models[d].n - np.outer(mean, mean)  # the mean is 0 but for rounding
        worst = max(worst, float(np.abs(covariance - np.eye(len(mean))).max()))
    return worst


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors: ``id`` and ``x`` (array of long without nulls). One row per row and component.

    ``component`` counts from 1 by falling variance; ``n`` is the number of vectors of that length,
    ``deviation`` the exact sum of (n*x - S)^2 (null beyond a long), ``whitened`` the centred vector along the component over its
    standard deviation, ``explained`` the component's part of all variance, ``identity_error`` see above. Every
    length of vectors is a fit of its own. Empty vectors, single ones and those that
    are all equal have no variance and hence no rows; repeated rows count and come out each; ids may be null;
    an empty table gives none.
    """
    models = fit(vectors, components)
    error = identity_error(vectors, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch):
                model = models[d]
                k = len(model.values)
                if not k:
                    continue
                each = np.repeat(at, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), model.n, np.int64)),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.values * model.n / model.spread, len(at))), pa.array(np.full(len(each), error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"id {vectors.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select("id", "x").mapInArrow(run, schema)


def whole_numbers(vector: Column) -> Column:
    """floor(64*c) + 1000000 of each component as a long; beyond 2^45 it stops there."""
    largest = F.lit(LARGEST)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, largest), -largest)) + F.lit(OFFSET).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; zero vectors count."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings that is finite, along 32 whitened components."""
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding")))
    vectors = staged(rows.select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding")).alias("x")))
    return whiten(vectors).withColumnRenamed("id", "vec_id")
