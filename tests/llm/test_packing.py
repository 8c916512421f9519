from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricetrail.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
SCHEMA = "doc_id long, text string, start string, ids int, offset int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(8)
    odd = ["don't", "I'LL", '."\'s', "word.”", "a—b", "É", "été", "naïve,", "x y", "12a3", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "x<|endoftext|>'s", "日本語", "\U0001f600!", "ΣΑΣ", "it's)", "ﬁn", "İx", "a‍b", "\x1c", "under_score", "ñ.é", "ß!?", "x÷y", "--'--", "É.'"]
    made = []
    for n in [0, 1, 3, 40, 700, 3000] * 4:
        made.append("".join(rng.choice(odd + ["Plain", "words", "here."]) + rng.choice([" ", "\n", "\t ", "\x0b", " \x0c"]) for _ in range(n)))
    return made + [None, "", " ", "x" * 3000, "long text, " * 120_000, made[4], made[4]]


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "READ_BYTES", 5000)
    encoder = packing.Encoder(PATH, 6000)
    for text in texts():
        text = text or ""
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_sequences(pieces, tokens, segments, loss):
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] == len(p["ids"]) // 4 > 0
            at += p["length"]
        assert at <= tokens and len(own) <= segments and sum(p["loss_tokens"] for p in own) <= loss
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_documents_come_back(spark, tokenizer):
    rows = [(i, t, "clash", 1, 2) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id", None, None, None)]
    pieces = packing.pack(packing.as_items(spark.createDataFrame(rows, SCHEMA).repartition(3)), PATH).collect()
    assert check_sequences(pieces, 4096, 256, 4096) == 0
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["id"], []).append(p)
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    assert by_doc.keys() == want.keys()
    for i, copies in want.items():
        got = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(by_doc[i], key=lambda p: p["start"])])
        assert {p["doc_tokens"] for p in by_doc[i]} == {len(copies[0])}
        assert len(got) == sum(map(len, copies))
        if len(copies) == 1:
            assert got.tolist() == copies[0]
            assert sorted(p["start"] for p in by_doc[i]) == [0, *np.cumsum([p["length"] for p in sorted(by_doc[i], key=lambda p: p["start"])])[:-1]]


def test_all_three_limits(spark):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices("one two three four five".split(), k=rng.randint(0, 60)))) for c in range(300) for t in range(rng.randint(1, 6))]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pieces = packing.pack(packing.conversation_items(table, F.col("role") == "assistant").repartition(2), PATH, tokens=512, segments=6, loss=200, pool=64).collect()
    assert check_sequences(pieces, 512, 6, 200) == 0
    loss = {}
    for p in pieces:
        loss[p["id"]] = loss.get(p["id"], 0) + p["loss_tokens"]
    want = {}
    for c, t, role, text in sorted(turns):
        last = role == "assistant"
        want[c] = want.get(c, 0) + (len(text.split()) if last else 0)
    ends = {c: role == "assistant" for c, _, role, _ in sorted(turns)}
    assert loss == {c: n + ends[c] for c, n in want.items()}


def test_the_best_product_is_taken():
    packer = packing.Packer(tokens=10, segments=3, loss=10, pool=4)
    piece = lambda i, n, k: packing.Piece(i, 0, np.arange(n), np.minimum(np.arange(n + 1), k), n)
    for p in (piece(1, 6, 0), piece(2, 5, 5), piece(3, 4, 1), piece(4, 1, 1)):
        assert list(packer.add(p)) == []
    # 2 asks 5 and 5 of 10 and 10; then, with 5 and 5 left, 3 comes before 4, which then fills the rest
    assert [p.id for p in packer.sequence()] == [2, 3, 4]
    assert [p.id for p in packer.sequence()] == [1]


def test_special_tokens_stand_for_themselves():
    ids = lambda text: np.frombuffer(packing.Encoder(PATH).ids(text.encode()), "<u4").tolist()
    assert ids("hello <|endoftext|> world") == [3306, 49407, 1002]
    assert ids("a<|startoftext|><|endoftext|>") == [320, 49406, 49407]
    assert ids("<|ENDOFTEXT|>") == ids("<| endoftext |>")


def test_the_pool_is_bounded_by_tokens():
    packer, most, given = packing.Packer(tokens=10, segments=3, loss=10, pool=100, most=50), 0, 0
    for i in range(200):
        given += sum(len(p.ids) for own in packer.add(packing.Piece(i, 0, np.arange(7), None, 7)) for p in own)
        most = max(most, packer.held)
        assert given + packer.held == 7 * (i + 1)
    assert most <= 50 + 7
    assert sum(len(p.ids) for own in packer.rest() for p in own) + given == 1400 and packer.held == 0


def test_empty_table(spark):
    assert packing.pack(packing.as_items(spark.createDataFrame([], SCHEMA)), PATH).collect() == []


def test_query_on_table(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    got = packing.op6_packing(spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    parts = {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append(r)
    assert parts.keys() == text.keys()
    for i, t in text.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
