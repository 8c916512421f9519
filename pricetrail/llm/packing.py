"""Packing tokenised texts into sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

TOKENIZER = "word_bpe_49k.json"
END = 2
TOKENS, SEGMENTS, LOSS = 4096, 256, 4096
POOL = 1024  # pieces a task chooses from at once
POOL_TOKENS = 1 << 20  # tokens that wait in the pool, but for its last piece
OUT_BYTES = 4 << 20  # ids in a batch of results, about
EMPTY = float(1 << 60)
KNOWN_BYTES = 100 << 20  # memory for the words that a task remembers
STAGE_BYTES = 24 << 20  # the same in the pipeline, whose workers also hold what earlier stages have left
WORD_BYTES = 200  # of that, what a word takes besides its letters and ids
READ_BYTES = 1 << 20  # text that is split into words at once
SCHEMA = "id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"

#: Words of lower-case letters, then ASCII marks but no apostrophe: their two runs are tokens of their own in any text.
TWO_RUNS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: How byte-level vocabularies write the bytes that are no visible character, in the order of the bytes (fixed values).
HIDDEN_BYTES = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_LETTERS = {byte: chr(0x100 + k) for k, byte in enumerate(HIDDEN_BYTES)}


class Encoder(dict):
    """Token ids of whole texts by a tokenizer that lower-cases and never joins over ASCII white space.

    Gives the ids that the tokenizer gives for the text: strings of special tokens are found in the
    raw text and stand for themselves. Remembers the ids of words, as little-endian unsigned 32-bit numbers;
    the letters of a new word go straight to the tokenizer's model, which is much quicker
    than the way through normalising and splitting that any other word takes.
    """

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        from tokenizers import Tokenizer

        self.most = known_bytes
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: special tokens that are more than their string are not supported")
        self.special = {t.content.encode(): struct.pack("<I", i) for i, t in added.items()}
        self.cuts = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")")
        # words come lower-cased, when "<|END|>" looks like "<|end|>": only the raw text can tell
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.marks: dict[bytes, bytes] = {b"": b""}
        self.held = 0

    def slowly(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        runs = TWO_RUNS(word)
        if runs is None:
            found = self.slowly(word)
        elif marks := runs[2]:
            if marks not in self.marks:
                self.marks[marks] = self.slowly(marks)
            found = self[runs[1]] + self.marks[marks]
        else:
            letters = word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in self.tokenize(letters)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        self.held += len(word) + len(found) + WORD_BYTES
        return found

    def ids(self, text: bytes) -> bytes:
        out = []
        for part in slices(text, READ_BYTES):
            if self.held > self.most:
                self.forget()
            # a special token holds no white space, so no slice cuts one
            for piece in self.cuts.split(part) if any(token in part for token in self.special) else (part,):
                if piece in self.special:
                    out.append(self.special[piece])
                else:
                    out.extend(map(self.__getitem__, piece.lower().split()))  # of bytes: only A-Z change, only ASCII white space splits
        return b"".join(out)


@functools.cache
def encoder(path: str, known_bytes: int) -> Encoder:
    """One for all tasks of a worker, so that words are learnt once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
    return Encoder(path, known_bytes)


@dataclass
class Piece:
    """What is left of a text to place: token ids, and how many of its first k tokens bear loss (None: all of them)."""

    id: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray | None
    total: int

    @property
    def loss_tokens(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss[-1] - self.loss[0])

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of its first tokens stay within both limits."""
        if self.loss is None:
            return min(len(self.ids), tokens, loss)
        return min(len(self.ids), tokens, int(np.searchsorted(self.loss, self.loss[0] + loss, "right")) - 1)

    def cut(self, n: int) -> tuple[Piece, Piece | None]:
        if n == len(self.ids):
            return self, None
        loss = (None, None) if self.loss is None else (self.loss[: n + 1], self.loss[n:])
        return Piece(self.id, self.start, self.ids[:n], loss[0], self.total), Piece(self.id, self.start + n, self.ids[n:], loss[1], self.total)


class Packer:
    """Fills one sequence after the other from a pool of pieces.

    The next piece of a sequence is, of those that fit, the one whose demand points most
    in the direction of what is left: the largest dot product of the two vectors (tokens,
    segments, loss tokens), each as a part of its limit. When no piece fits, the one with the
    largest product is cut. So a sequence ends short only when the segments or the loss
    tokens are used up, or when nothing is left.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, most: int = POOL_TOKENS):
        self.limits = tokens, segments, loss
        self.most, self.held = most, 0  # tokens in the pool
        self.pieces: list[Piece | None] = [None] * pool
        self.need = np.full((2, pool), EMPTY)  # tokens and loss tokens; an empty place needs too much
        self.open = list(range(pool))[::-1]

    def put(self, place: int, piece: Piece | None) -> None:
        self.held += (0 if piece is None else len(piece.ids)) - (0 if self.pieces[place] is None else len(self.pieces[place].ids))
        self.pieces[place] = piece
        self.need[:, place] = EMPTY if piece is None else (len(piece.ids), piece.loss_tokens)
        if piece is None:
            self.open.append(place)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while not self.open or self.held > self.most:
            yield self.sequence()
        self.put(self.open.pop(), piece)

    def rest(self) -> Iterator[list[Piece]]:
        while len(self.open) < len(self.pieces):
            yield self.sequence()

    def sequence(self) -> list[Piece]:
        tokens, segments, loss = self.limits
        left, left_loss, out = tokens, loss, []
        while left and len(out) < segments and len(self.open) < len(self.pieces):
            fits = (self.need[0] <= left) & (self.need[1] <= left_loss)
            product = self.need[0] * (left / tokens**2) + self.need[1] * (left_loss / loss**2)
            product[~fits if fits.any() else self.need[0] == EMPTY] = -1
            place = int(product.argmax())
            n = self.pieces[place].fitting(left, left_loss)
            if not n:
                break
            taken, rest = self.pieces[place].cut(n)
            self.put(place, rest)
            out.append(taken)
            left, left_loss = left - n, left_loss - taken.loss_tokens
        return out


def without_padding(sequence: list[Piece], tokens: int) -> Iterator[list[Piece]]:
    """The sequence itself if it is full, else cut into sequences whose lengths are powers of two, which need no padding."""
    total = sum(len(p.ids) for p in sequence)
    if total == tokens:
        yield sequence
        return
    todo = sequence[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            piece = todo.pop()
            taken, rest = piece.cut(min(size, len(piece.ids)))
            if rest:
                todo.append(rest)
            out.append(taken)
            size -= len(taken.ids)
        yield out


def pack(items: DataFrame, path: str, end: int = END, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """Tokenise and pack items: columns ``id``, ``texts`` (array of binary) and ``loss`` (array of boolean).

    An item's ids are those of its texts one after the other, then ``end``; a text's
    tokens bear loss where its ``loss`` is true, and ``end`` does as the last text does.
    Returns a row per piece: where it starts among the item's ids, its length, its ids (little-endian
    unsigned 32-bit), its loss tokens, the item's ids, its sequence and its place there. A sequence
    keeps within all three limits. Each input partition is packed by itself, with a pool of a bounded number of items and
    tokens, so nothing is shuffled and any number of rows of any length fits; its sequences have full
    length, or else lengths that are powers of two. Null texts are empty; an item without texts
    is ``end`` alone, bearing loss; repeated rows are packed each; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, packer = encoder(path, known_bytes).ids, Packer(tokens, segments, loss, pool)
        number = TaskContext.get().partitionId() << 40

        def rows(sequences: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal number
            for sequence in sequences:
                for part in without_padding(sequence, tokens):
                    at = 0
                    for p in part:
                        yield p.id, p.start, len(p.ids), p.ids.tobytes(), p.loss_tokens, p.total, number, at
                        at += len(p.ids)
                    number += 1

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        def all_rows() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    texts, marks = batch.column("texts")[k].as_py() or [], batch.column("loss")[k].as_py() or []
                    ids = [np.frombuffer(read(t or b""), "<u4") for t in texts]
                    ids.append(np.array([end], "<u4"))
                    marks = [bool(m) for m in marks] or [True]
                    marks.append(marks[-1])
                    counts = None if all(marks) else np.concatenate([[0], np.cumsum(np.repeat(marks, [len(x) for x in ids]))])
                    whole = np.concatenate(ids)
                    yield from rows(packer.add(Piece(batch.column("id")[k].as_py(), 0, whole, counts, len(whole))))
            yield from rows(packer.rest())

        made: list[tuple] = []
        size = 0
        for row in all_rows():
            made.append(row)
            size += len(row[3])
            if len(made) >= 2048 or size >= OUT_BYTES:
                yield batch_of(made)
                made, size = [], 0
        if made:
            yield batch_of(made)

    return items.select("id", "texts", "loss").mapInArrow(run, SCHEMA)


def as_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as items whose every token bears loss."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.array(F.col(text_col).cast("binary")).alias("texts"), F.array(F.lit(True)).alias("loss"))


def conversation_items(turns: DataFrame, speaker: Column) -> DataFrame:
    """Conversations (conv_id, turn, text) as items, turns in order; tokens of turns where ``speaker`` holds bear loss."""
    turn = F.struct("turn", F.col("text").cast("binary").alias("text"), F.coalesce(speaker, F.lit(False)).alias("loss"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(F.col("conv_id").cast("long").alias("id"), F.col("turns.text").alias("texts"), F.col("turns.loss").alias("loss"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(as_items(table(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what the stages before have kept; a row per piece with its ids."""
    return pack(as_items(docs), public_tokenizers.path(TOKENIZER), known_bytes=STAGE_BYTES).withColumnRenamed("id", "doc_id")
