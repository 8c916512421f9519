"""Helpers the training-data operators share."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrail.session import checkpoint_dir, settled, shuffles_go, staged

__all__ = ["WORD", "checkpointed", "forest", "held_out", "rows_of", "settled", "shuffles_go", "slices", "split", "staged", "table", "text_bytes", "uniform"]

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SLICE = 1 << 20  # bytes of a text that are split into words at once
MOST_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def text_bytes(name: str = "text") -> Column:
    """A text as its UTF-8 bytes, null as none: Python gets them without decoding."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5. A null id is nobody's training row, hence held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each batch, as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(n).to_pylist() for n in names)


def forest(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the items 0..size-1, reduced to one link from each linked item to the least item it reaches."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum(root, root[root], out=root)
        if np.array_equal(before, root):
            break
    item = np.flatnonzero(root != np.arange(size))
    return item, root[item]


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The whole text in pieces that end before white space, so that no word is cut."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def uniform(key: Column, seed: str) -> Column:
    """A number over 0 and up to 1 that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("-"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def bit_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A table of bits that are set for all keys and few others: 16 bits a key up to ``MOST_BITS`` (8 MB), so it may be broadcast."""
    bits = min(MOST_BITS, 1 << max(18, math.ceil(math.log2(16 * keys.count() + 1))))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")), bits


def split(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the keys, and those whose key certainly is not, without a shuffle."""
    filled, bits = bit_filter(keys, key)
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.bitmap_bit_position(place)
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(filled), "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("met", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return marked.where("met").select(*rows.columns), marked.where("not met").select(*rows.columns)
