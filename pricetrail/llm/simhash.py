"""SimHash near-duplicates: exact search over fingerprints in tiles, compared with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, rows_of, staged, table, text_bytes
from .components import components

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
TILE = 1024
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text.

    A-Z become lower case, words are split at ASCII white space, and every run of
    ``shingle_words`` words is hashed, repeats included; a shorter text is one shingle,
    a text without words has fingerprint 0. A bit is 1 if over half the hashes have it.
    """
    words = text.lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(first)
    for k in range(0, n, BLOCK):
        part = [digest(joined[i:j], SEED) for i, j in zip(first[k : k + BLOCK], last[k : k + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: its id and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "id", "text"):
            found = np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the fingerprints that differ in at most ``radius`` bits."""
    left, right = [], []
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        left.append(i + k)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` that join the distinct fingerprints ``fp`` just as all their pairs within the radius do.

    Fingerprints are sorted into cells by the bit counts of their two halves, and cells
    into tiles of about ``tile`` fingerprints. Two fingerprints within the radius have bit
    counts whose differences add up to no more than it, so only tiles of such cells meet;
    each pair of tiles is one row. A pair of tiles returns its links as a forest, so
    a group of very many near copies costs no more rows than it has members.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    cells = fps.select("fp", F.bit_count(low).cast("long").alias("lo"), F.bit_count(high).cast("long").alias("hi"))
    sizes = cells.groupBy("lo", "hi").agg(F.ceil(F.count("*") / F.lit(tile)).alias("tiles"))  # 33 x 33 cells at most
    tiles = staged(
        cells.join(F.broadcast(sizes), ["lo", "hi"])
        .groupBy("lo", "hi", F.pmod(F.xxhash64("fp"), "tiles").alias("t"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    key = (F.col("lo") * 64 + F.col("hi")) * (1 << 44) + F.col("t")
    here = tiles.select("lo", "hi", "t", key.alias("key"))
    steps = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x, y) >= (0, 0)]
    moves = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    asked = here.select("lo", "hi", F.col("t").alias("t1"), F.col("key").alias("k1"), moves.alias("to"))
    asked = asked.select((F.col("lo") + F.col("to.x")).alias("lo"), (F.col("hi") + F.col("to.y")).alias("hi"), "t1", "k1", ((F.col("to.x") == 0) & (F.col("to.y") == 0)).alias("same"))
    pairs = asked.join(here, ["lo", "hi"]).where(~F.col("same") | (F.col("t1") <= F.col("t"))).select("k1", F.col("key").alias("k2"))
    content = tiles.select(key.alias("key"), "fps")
    met = pairs.join(content.select(F.col("key").alias("k1"), F.col("fps").alias("fps1")), "k1").join(content.select(F.col("key").alias("k2"), F.col("fps").alias("fps2")), "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("fps1"), batch.column("fps2")
            for k in range(batch.num_rows):
                x, y = one[k].values.to_numpy(zero_copy_only=False), two[k].values.to_numpy(zero_copy_only=False)
                i, j = close_pairs(x.view(np.uint64), y.view(np.uint64), radius)
                both, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                a, b = forest(place[i], place[len(x) + j], len(both))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(both[a]), pa.array(both[b])], ["a", "b"])

    return met.select("fps1", "fps2").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: ``id``, ``fp`` and ``component``, the least id of its group.

    Documents belong to one group if links of at most ``radius`` differing bits lead from
    one to the other. Only distinct fingerprints are compared, so copies cost nothing more.
    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat
    an id come back each; a null id stays null and gives no group its name unless all are null.
    An empty table gives none. Only the two named columns are read.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle_words))
    distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(distinct.select("fp"), radius, tile), "a", "b")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = staged(named.groupBy("root").agg(F.min("first").alias("component")))
    of = staged(named.select("fp", "root").join(least, "root").select("fp", "component"))
    return rows.join(of, "fp").select("id", "fp", "component")


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16().alias("fingerprint"), F.col("component").alias("component_id"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: the one with the least id, rows without an id last, then by the hashes of text and row.

    Rows are told apart by a hash of all their columns, so rows that share an id or have none are chosen each by its own text; of rows
    that are equal in all columns one is kept. Empty and null texts are one group. Columns may have any names.
    """
    place = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    row = F.xxhash64(*[part for c in place.values() for part in (F.col(c), F.col(c).isNull())])
    keyed = docs.toDF(*place.values()).withColumn("row", row)
    groups = simhash_groups(keyed, "row", place["text"]).select(F.col("id").alias("row"), "component").distinct()
    doc_id = F.col(place["doc_id"])
    order = F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), F.xxhash64(place["text"]).alias("hash"), "row")
    least = keyed.select("row", order.alias("order")).distinct().join(groups, "row").groupBy("component").agg(F.min("order").alias("order"))
    kept = least.select(F.col("order.row").alias("row"))
    return keyed.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*place.values()).toDF(*docs.columns)
