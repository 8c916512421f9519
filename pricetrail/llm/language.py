"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, rows_of, table, text_bytes

SAMPLE_TEXTS = 128  # texts that a language's dictionary is made of, at most
SAMPLE_CHARS = 1000  # from each, starting anywhere in it
BLOCK = 2048  # bytes compressed at once: a text longer than that would soon be its own dictionary
LEVEL = 6
MIN_MATCH = 4
MIN_MARGIN = 0.01
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Dictionaries:
    """Raw dictionary content by language, the more frequent language first."""

    content: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        made = []
        for lang, content in self.content:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=BLOCK, dict_size=len(content), min_match=MIN_MATCH, write_checksum=0, write_content_size=0, write_dict_id=0
            )
            known.precompute_compress(compression_params=params)
            made.append((lang, zstandard.ZstdCompressor(dict_data=known, compression_params=params)))
        return made


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Dictionaries:
    """Dictionaries from rows with a language and a text that has more than white space.

    Each language's dictionary holds up to ``sample_texts`` stretches of up to
    ``sample_chars`` characters, from texts drawn by a hash of their ids. The driver
    gets about three times that many stretches per language, at most four times, whatever the table's size.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\S")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(9), F.col(id_col).cast("string"), F.length(text_col)).alias("h")
    )
    totals = {r["lang"]: r["n"] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Dictionaries(())
    # a share of each language's rows, by the place of their hash among all hashes
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 3 * sample_texts / n))) for lang, n in totals.items()])
    drawn = known.where(F.col("h") / F.lit(2.0**64) + 0.5 <= share)
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - sample_chars, F.lit(1))).cast("int") + 1
    by_lang: dict[str, list] = {}
    # a drawn id that repeats gives no more rows than this
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    drawn = drawn.withColumn("place", first).where(F.col("place") <= 4 * sample_texts)
    for r in drawn.select("lang", "h", F.substring("text", start, F.lit(sample_chars)).alias("part")).collect():
        by_lang.setdefault(r["lang"], []).append((r["h"], r["part"]))
    order = sorted(by_lang, key=lambda lang: (-totals[lang], lang))
    # zstandard wants 8 bytes at least; a few blanks teach it nothing
    return Dictionaries(tuple((lang, "\n".join(p for _, p in sorted(by_lang[lang])[:sample_texts]).lower().encode().ljust(8)) for lang in order))


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode(errors="replace")))


def classify(text: bytes, compressors: list) -> tuple[str, float, float]:
    """Language, score and margin of one UTF-8 text."""
    if not compressors or not has_letter(text):
        return UNKNOWN, 0.0, 0.0
    low = text.decode(errors="replace").lower().encode()
    blocks = [low[k : k + BLOCK] for k in range(0, len(low), BLOCK)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in compressors]
    best = min(sizes)
    rest = sorted(sizes)[1:]
    score = 1.0 / sum(2.0 ** -min(s - best, 60) for s in sizes)
    return compressors[sizes.index(best)][0], score, (rest[0] - best) / best if rest else 1.0


def identify(docs: DataFrame, dictionaries: Dictionaries, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of docs: ``id``, ``lang``, ``score``, ``margin`` and ``accepted``.

    The whole lower-cased text is compressed in blocks with each language's dictionary;
    the smallest sum names the language, the more frequent language wins a tie. The score
    halves with every byte that another language comes closer to the best. The margin is
    the distance of the second best as a part of the best; rows below ``min_margin`` are
    not accepted. Null and empty texts and texts without a letter are ``und`` with score 0,
    not accepted. Rows that repeat come back each; an empty table gives none; only
    the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = dictionaries.compressors()
        for ids, texts in rows_of(batches, "id", "text"):
            found = [classify(t, compressors) for t in texts]
            lang, score, margin = (list(c) for c in zip(*found, strict=True))
            ok = [name != UNKNOWN and m >= min_margin for name, m in zip(lang, margin, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(ok)], ["id", "lang", "score", "margin", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, "id long, lang string, score double, margin double, accepted boolean")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(~held_out(F.col("doc_id")))))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "margin", "accepted")
