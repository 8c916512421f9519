"""Main text of web pages: a conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, training_pages
from .blocks import Block, blocks
from .common import table

TRAINING_PAGES = 1500
SPLIT = re.compile(r"[^a-z]+")
PLAIN = frozenset(["html", "body", "div", "span", "p", "b", "i", "em", "strong", "a"])

LANDMARKS = frozenset(["article", "aside", "dialog", "footer", "form", "header", "main", "nav", "search"])


@functools.lru_cache(maxsize=10_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """Features of the elements around a block: their names, the words of their classes and ids, the nearest one with a meaning."""
    found = {f"in {name}" for name, _ in path}
    for _, names in path:
        found.update(f"named {w}" for w in SPLIT.split(names) if w)
    found.add(f"parent {path[-1][0]}" if path else "no parent")
    near = next((n for n, _ in reversed(path) if n not in PLAIN), "none")
    found.add(f"near {near}")
    landmark = next((n for n, _ in reversed(path) if n in LANDMARKS), "none")
    found.add(f"landmark {landmark}")
    inner = next((names for _, names in reversed(path) if names), "")
    found.update(f"nearest name {w}" for w in SPLIT.split(inner) if w)
    return tuple(sorted(found))


def features(block: Block, place: int, number: int) -> list[str]:
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    linked = 4 * min(block.linked, size) // size
    long_ = min(words.bit_length(), 8)
    out = [
        "any", f"words {long_}", f"linked {linked}", f"words {long_} linked {linked}", f"bold {2 * min(block.bold, size) // size}",
        f"ends {text[-1] if text[-1] in '.!?:…' else 'open'}", f"commas {min(text.count(','), 3)}", f"digits {4 * sum(map(str.isdigit, text)) // size}",
    ]
    if text[0] in "©®" or "©" in text:
        out.append("copyright")
    if place == 0:
        out.append("first")
    if place == number - 1:
        out.append("last")
    out.extend(path_features(block.path))
    return out


def sequence(found: list[Block]) -> list[list[str]]:
    return [features(b, k, len(found)) for k, b in enumerate(found)]


def fit(labelled: list[str]) -> crf.Chain:
    """Train on pages whose text is marked by data-label: main, or anything else."""
    found = [blocks(p) for p in labelled]
    return crf.train([(sequence(f), [int(b.label == "main") for b in f]) for f in found if f], 2)


@functools.cache
def model(number: int = TRAINING_PAGES) -> crf.Chain:
    return fit(training_pages.pages(number))


def main_text(page: str, chain: crf.Chain) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, chain.decode(sequence(found)), strict=True) if y)


def extract(pages: DataFrame, chain: crf.Chain, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of pages: ``id``, the columns in ``keep``, ``text``, ``main_blocks`` and ``blocks``, how many blocks it is made of and of how many.

    The whole page is read. A page without main blocks, or with null or empty html, has the text "".
    Rows that repeat come back each; an empty table gives none; columns that are not named are not read.
    """
    more = {f"kept{k}": c for k, c in enumerate(keep)}
    rows = pages.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(k) for k, c in more.items()], F.col(html_col).alias("html"))
    passed = [f for f in rows.schema if f.name != "html"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in passed) + ", text string, main_blocks long, blocks long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, main, number = [], [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page or "")
                own = [b.text for b, y in zip(found, chain.decode(sequence(found)), strict=True) if y]
                texts.append(" ".join(own))
                main.append(len(own))
                number.append(len(found))
            made = [pa.array(texts, pa.string()), pa.array(main, pa.int64()), pa.array(number, pa.int64())]
            names = [f.name for f in passed]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, "text", "main_blocks", "blocks"])

    found = rows.mapInArrow(run, schema)
    return found.select("id", *[F.col(k).alias(c) for k, c in more.items()], "text", "main_blocks", "blocks")


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), model(), keep=("url",))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "main_blocks", "blocks")
