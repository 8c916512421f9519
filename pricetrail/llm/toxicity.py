"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, rows_of, slices, staged, table, text_bytes

POSITIVES = 3000  # confirmed toxic texts to learn from, about
UNLABELLED = 6000  # other texts to learn from, about
MIN_TEXTS = 3  # toxic texts that a feature must be in
MIN_Z = 5.0  # by how many standard errors it must be commoner there
STEPS, BATCH, RATE, DECAY = 400, 500, 0.05, 1e-4
REJECT = 0.5
WORDS = re.compile(r"\w+")
CACHE = 200_000  # words a task remembers at once


@dataclass(frozen=True)
class Model:
    """A linear model: a weight per feature, and what a text without any feature scores."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, features) -> float:
        z = self.bias + sum(self.weights[f] for f in features)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings together with its length."""
    names = [word] + [f"{word[:k]}|{len(word)}" for k in range(3, 9) if len(word) > k]
    return [xxhash.xxh32_intdigest(n) for n in names]


class Reader:
    """The distinct features of whole texts; remembers words. With ``only``, other features are left out."""

    def __init__(self, only=None):
        self.only, self.known = only, {}

    def __call__(self, text: bytes) -> set[int]:
        found: set[int] = set()
        if len(self.known) > CACHE:
            self.known.clear()
        for word in {w for part in slices(text) for w in WORDS.findall(part.decode(errors="replace").lower())}:
            features = self.known.get(word)
            if features is None:
                features = word_features(word)
                if self.only is not None:
                    features = [f for f in features if f in self.only]
                self.known[word] = features
            found.update(features)
        return found


def read_features(docs: DataFrame, only=None) -> DataFrame:
    """docs: columns id, text (binary), then others that are passed on; text becomes ``features``."""
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", features array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(only)
        for batch in batches:
            found = pa.array([sorted(reader(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, "features"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def share(bound: int, rows: int, salt: int, key: str):
    """Whether a row is among about ``bound`` of ``rows``, by a hash of its key."""
    return F.xxhash64(F.lit(salt), F.col(key)) / F.lit(2.0**64) + 0.5 <= F.lit(min(1.0, bound / max(rows, 1)))


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], scale: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled risk with the sigmoid loss.

    The risk is prior * loss(positives as toxic) + max(0, loss(unlabelled as clean) -
    prior * loss(positives as clean)); where the part in max() turns negative, its
    gradient is reversed. ``scale`` is the value that each feature has in a text.
    """
    size, rng = len(scale), np.random.default_rng(0)
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
    w[-1] = math.log(prior / (1 - prior))

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    for step in range(1, STEPS + 1):
        p_part, u_part = rng.choice(len(positive), min(BATCH, len(positive)), False), rng.choice(len(unlabelled), min(BATCH, len(unlabelled)), False)
        (fp, rp), (fu, ru) = flat([positive[i] for i in p_part]), flat([unlabelled[i] for i in u_part])
        out = [1 / (1 + np.exp(-np.clip(np.bincount(r, w[f] * scale[f], n) + w[-1], -30, 30))) for f, r, n in ((fp, rp, len(p_part)), (fu, ru, len(u_part)))]
        slope_p, slope_u = (o * (1 - o) / len(o) for o in out)
        if out[1].mean() - prior * out[0].mean() >= 0:
            grad_p, grad_u = -2 * prior * slope_p, slope_u
        else:
            grad_p, grad_u = prior * slope_p, -slope_u
        g = np.bincount(np.concatenate([fp, fu]), np.concatenate([grad_p[rp] * scale[fp], grad_u[ru] * scale[fu]]), size)
        g = np.append(g + DECAY * w[:-1], grad_p.sum() + grad_u.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w[:-1] * scale, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic); toxic if any label of the id is 1.

    Confirmed toxic texts and texts taken as unlabelled are drawn by a hash of their ids,
    about ``positives`` and ``unlabelled`` of them, at most twice as many rows where drawn ids repeat; the class prior is the share of toxic
    ids among the labelled. Features are kept that are in ``MIN_TEXTS`` toxic texts and
    commoner there by ``MIN_Z`` standard errors; a feature counts by its log ratio.
    Without toxic or unlabelled texts every text scores the prior, 0 if there is none.
    Rows with a null id or a null label teach nothing.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").where("doc_id is not null").join(known, "doc_id", "left")
    total, labelled, toxic = known.agg(F.count("*"), F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / labelled if labelled else 0.0
    if not 0 < prior < 1:
        return Model(math.log(prior / (1 - prior)) if 0 < prior < 1 else (-1e9 if prior == 0 else 1e9))
    marked = known.where("toxic = 1").where(share(positives, toxic, 1, "doc_id")).select("doc_id", F.lit(True).alias("positive")).distinct()
    # about `positives` ids: a bound that does not grow with the data
    drawn = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(marked), "doc_id", "left")
    drawn = drawn.select(F.coalesce("positive", F.lit(False)).alias("positive"), share(unlabelled, total, 2, "doc_id").alias("plain"), F.xxhash64("doc_id", "text").alias("h"), "text").where("positive or plain")
    sample = staged(read_features(drawn))
    n_pos, n_un = sample.agg(F.count_if("positive"), F.count_if("plain")).first()
    if not n_pos or not n_un:
        return Model(math.log(prior / (1 - prior)))
    counts = sample.select("positive", "plain", F.explode("features").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if("plain").alias("u"))
    a, b = F.col("p") / n_pos, F.col("u") / n_un
    q = (F.col("p") + F.col("u")) / (n_pos + n_un)
    error = F.sqrt(q * (1 - q) * (1 / n_pos + 1 / n_un) + 1e-12)
    kept = counts.where((F.col("p") >= MIN_TEXTS) & ((a - b) / error > MIN_Z)).orderBy("f").toPandas()
    place = {int(f): k for k, f in enumerate(kept["f"])}
    scale = np.log((kept["p"].to_numpy(float) + 0.5) / n_pos) - np.log((kept["u"].to_numpy(float) + 0.5) / n_un)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([[place[f] for f in row if f in place] for row in batch.column("features").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("plain"), batch.column("h"), own], ["positive", "plain", "h", "features"])

    rows = sample.mapInArrow(pick, "positive boolean, plain boolean, h long, features array<long>")
    texts: dict[str, list] = {"positive": [], "plain": []}
    # about positives + unlabelled rows, and however often a drawn id repeats no more than twice as many
    for r in rows.orderBy("h").limit(2 * (positives + unlabelled)).collect():
        own = np.array(sorted(r["features"]), np.int64)
        for kind in texts:
            if r[kind]:
                texts[kind].append(own)
    weights, bias = nnpu(texts["positive"], texts["plain"], scale, prior)
    return Model(bias, dict(zip(place, weights.tolist(), strict=True)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``id`` and ``score`` from 0 to 1 over the whole text.

    Null and empty texts score as a text without any learned feature. Rows that repeat
    come back each; an empty table gives none; only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.weights)
        for ids, texts in rows_of(batches, "id", "text"):
            found = [model.score(sorted(reader(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, "id long, score double")


def learned(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the table's documents that are not held out."""
    docs = table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id")))
    return fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), learned(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose whole text scores ``REJECT`` or more; columns and other rows stay as they are."""
    model = learned(spark, sf_dir)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    renamed = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.weights)
        for batch in batches:
            keep = [model.score(sorted(reader((t or "").encode()))) < REJECT for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
