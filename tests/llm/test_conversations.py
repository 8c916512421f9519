from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from pricetrail.llm import conversations as conv

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, h int, place string"


def enumerated(rows):
    """All edits of few rows, judged by the pattern of the roles alone."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for row in rows:
        own = [("D", 3, "")]
        if row != "-":
            more = row.isupper()
            own.append(("K", int(more), row.lower()))
            own += [("R", 2 + more, "u"), ("R", 2 + more, "a")]
        choices.append(own)
    for picked in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            roles, edits, cost = put[0], "I" * len(put[0]), 2 * sum(map(len, put))
            for (edit, own, role), more in zip(picked, put[1:]):
                roles, edits, cost = roles + role + more, edits + edit + "I" * len(more), cost + own
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, edits) < best):
                best = cost, edits
    return best


def table_of_costs(rows):
    """Least cost and edits from each place on, one insertion at most between two other edits."""

    @lru_cache(None)
    def rest(i, state, may):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        steps = []
        if may:
            steps.append(("I", 2, i, 3 if state == 2 else 2, False))
        if i < len(rows):
            row, more = rows[i], rows[i].isupper()
            steps.append(("D", 3, i + 1, state, True))
            if row != "-":
                steps.append(("R", 2 + more, i + 1, 3 if state == 2 else 2, True))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(row.lower(), {}).get(state)
                if to is not None:
                    steps.append(("K", int(more), i + 1, to, True))
        for edit, cost, j, to, again in steps:
            own = rest(j, to, again)
            if own:
                found.append((cost + own[0], edit + own[1]))
        return min(found, default=None)

    for i in range(len(rows), -1, -50):  # so that calls do not nest deeply
        for state in range(4):
            rest(i, state, True)
    return rest(0, 0, True)


def test_cheapest_against_all_edits():
    for n in range(4):
        for rows in itertools.product("-souaSUA" if n < 3 else "-sUa", repeat=n):
            assert conv.cheapest("".join(rows), conv.START, conv.ENDS) == enumerated(rows), rows


def test_cheapest_against_a_table_of_costs_and_pieces():
    rng = random.Random(0)
    for _ in range(300):
        rows = "".join(rng.choices("-souaSUOA", [2, 1, 1, 6, 6, 1, 2, 1, 2], k=rng.randrange(4, 40)))
        want = table_of_costs(rows)
        assert conv.cheapest(rows, conv.START, conv.ENDS) == want
        fold, own, at = conv.Fold(), [], 0
        while at < len(rows):
            size = rng.randrange(0, 9)
            own += fold.add(at, conv.transfer(rows[at : at + size]))
            at += size
        cost, rest = fold.end()
        assert (cost, "".join(p[2] for p in own + rest)) == want


def plain(rows):
    by = {}
    for conv_id, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        own = by.setdefault(conv_id, [])
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        own += [(turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv_id, own in by.items():
        own.sort()
        turns = {t for there, t, *_ in own if there}
        letters, seen, counts = "", set(), [0, 0, 0]
        for _, _, role, _, text in own:
            bare = text.strip(SPACES)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "-" if fault in (0, 1) else first.upper() if fault == 2 else first
        firsts = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit = table_of_costs(letters)
        lines, i, state = [], 0, 0
        for edit in audit:
            if edit in "IR":
                role, state = ("assistant", 3) if state == 2 else ("user", 2)
                lines.append(f"{role}:{own[i][4] if edit == 'R' else ''}")
            elif edit == "K":
                lines.append(f"{own[i][2]}:{own[i][4]}")
                state = {"s": 1, "u": 2, "a": 3}[own[i][2][0]]
            i += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n=60, seed=1):
    rng = random.Random(seed)
    texts = ["Hello there.", "what?", "no end", " \t", "", None, "Fine!  \n", "a.b", "é中.", "x\ny.", "again.", "again."]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 14)):
            role = rng.choices(["user", "assistant", "system", None, "", "tool", "umpire", "User"], [8, 8, 2, 1, 1, 1, 1, 1])[0]
            turn = None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2])
            rows.append((c, turn, role, rng.choice(texts) if rng.random() < 0.6 else f"text {c} {t}.", "c", 1, "p"))
    rows += [(None, t, "user" if t else "assistant", "hm.", "c", 1, "p") for t in (0, 1, None, 7)]
    return rows


def run(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    found = conv.op11_conversations(spark, str(folder)).collect()
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[n] for n in names) for r in found), key=str)


def test_query_against_plain(spark, tmp_path):
    rows = made()
    rows += [(10**9, t, "user", "x.", "c", 1, "p") for t in range(100) if zlib.crc32(f"{10**9}:{t}".encode()) % 20 == 0]  # all dropped
    assert run(spark, rows, tmp_path) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("chunk", [3, 512])
def test_one_conversation_has_most_rows(spark, tmp_path, monkeypatch, chunk):
    """Its rows lie in many pieces and partitions; one of them is repeated very often."""
    monkeypatch.setattr(conv, "CHUNK", chunk)
    rng = random.Random(3)
    rows = made(20, 4)
    rows += [(77, t, rng.choice(["user", "assistant", "assistant", "system"]), f"t {t % 97}" + rng.choice([".", "", "!"]), "c", 1, "p") for t in range(700)]
    rows += [(77, 5, "user", "so often.", "c", 1, "p")] * 900 + [(78, None, None, None, "c", 1, "p")] * 40
    assert run(spark, rows, tmp_path) == plain(rows)


def test_extreme_turns(spark, tmp_path):
    rows = [(c, t, "user", "x.", "c", 1, "p") for c in range(40) for t in (-(2**63), 2**63 - 1)]
    found = {r[0]: r[1] for r in run(spark, rows, tmp_path)}
    assert max(found.values()) == 2**63 - 1


def test_repaired_rows(spark):
    rows = [("c", 1, "assistant", "Hi.", 1), ("c", 2, "tool", "out.", 1), ("d", 1, "user", "Q?", 1)]
    counts, repaired = conv.repair(spark.createDataFrame(rows, "conv string, turn long, role string, text string, copies long"))
    found = sorted((r["conv"], r["place"], r["edit"], r["role"], r["text"]) for r in repaired.collect())
    assert {r["conv"]: r["audit"] for r in counts.collect()} == {"c": "RR", "d": "KI"}  # two new roles cost 4
    assert found == [("c", 0, "R", "user", "Hi."), ("c", 1, "R", "assistant", "out."), ("d", 0, "K", "user", "Q?"), ("d", 1, "I", "assistant", "")]
