"""Repair of conversation structure: cheapest edits by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

# A repaired conversation reads (s?(ua)+)?, so far: nothing, s, up to u, up to a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
PAIRS = ("su", "ua", "au")  # roles that may follow each other
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: A row as one letter: whether it must go, or else the initial of its role (o: any other), in upper case if the row is truncated.
GONE, OTHER = "-", "o"
CHUNK = 512  # rows of a conversation that are one piece of the lattice
BATCH = 4096

Label = tuple[int, str]  # cost and edits


def steps_from(row: str, state: int) -> Iterator[tuple[str, int, int]]:
    """What can be done with a row after a state: the edit, its cost, the state then."""
    yield "D", DELETE, state
    if row != GONE:
        more = TRUNCATED if row.isupper() else 0
        if (state, row.lower()) in NEXT:
            yield "K", more, NEXT[state, row.lower()]
        yield "R", REROLE + more, spoken(state)


def spoken(state: int) -> int:
    """The state after a turn of the one who speaks next."""
    return ASSISTANT if state == USER else USER


@functools.cache
def steps_into(row: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """The same backwards: by the state after a row, the state before, the edit and its cost."""
    return tuple(tuple((a, edit, cost) for a in range(4) for edit, cost, b in steps_from(row, a) if b == to) for to in range(4))


@functools.cache
def steps_on(row: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    return tuple(tuple((b, edit, cost) for edit, cost, b in steps_from(row, a)) for a in range(4))


INSERTS_ON = tuple(spoken(a) for a in range(4))
INSERTS_INTO = tuple(tuple(a for a in range(4) if spoken(a) == b) for b in range(4))


@functools.lru_cache(1 << 14)
def cheapest(rows: str, entry: int, exits: tuple[int, ...]) -> Label | None:
    """The least cost from a state before the rows to one of the states after them, and the ASCII-least edits of that cost.

    Two heaps, one from the entry and one from the exits, settle nodes (rows done, state) by cost; edits
    that cost nothing move on by a row, so of equal costs the row decides and a settled node's edits are
    final. Each edge between a node that is settled forwards and one that is settled backwards is a
    crossing. Edits tell the path they take, so none is the beginning of another of equal cost to the same node, and
    the least edits up to a crossing and from it on make the least whole.
    The search ends when the heaps' least costs together are above the best crossing: until then all crossings
    of equal cost are finished, and their least edits are the answer.
    """
    n = len(rows)
    ahead: dict[tuple[int, int], Label] = {}
    back: dict[tuple[int, int], Label] = {}
    forward, reverse = [(0, 0, "", entry)], [(0, -n, "", e) for e in exits]
    heapq.heapify(reverse)
    best: Label | None = None

    def crossing(one: Label, edit: str, cost: int, two: Label) -> None:
        nonlocal best
        found = one[0] + cost + two[0], one[1] + edit + two[1]
        if best is None or found < best:
            best = found

    def pop_forward() -> None:
        cost, i, edits, state = heapq.heappop(forward)
        if (i, state) in ahead:
            return
        own = ahead[i, state] = cost, edits
        if (i, state) in back:
            crossing(own, "", 0, back[i, state])
        todo = [(i, INSERTS_ON[state], "I", INSERT)]
        if i < n:
            todo += [(i + 1, to, edit, more) for to, edit, more in steps_on(rows[i])[state]]
        for j, to, edit, more in todo:
            if (j, to) in back:
                crossing(own, edit, more, back[j, to])
            if (j, to) not in ahead:
                heapq.heappush(forward, (cost + more, j, edits + edit, to))

    def pop_reverse() -> None:
        cost, i, edits, state = heapq.heappop(reverse)
        i = -i
        if (i, state) in back:
            return
        own = back[i, state] = cost, edits
        if (i, state) in ahead:
            crossing(ahead[i, state], "", 0, own)
        todo = [(i, a, "I", INSERT) for a in INSERTS_INTO[state]]
        if i:
            todo += [(i - 1, a, edit, more) for a, edit, more in steps_into(rows[i - 1])[state]]
        for j, a, edit, more in todo:
            if (j, a) in ahead:
                crossing(ahead[j, a], edit, more, own)
            if (j, a) not in back:
                heapq.heappush(reverse, (cost + more, -j, edit + edits, a))

    pop_forward()
    for _ in exits:  # they are final at cost 0
        pop_reverse()
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best[0]):
        if (forward[0][0], len(ahead)) <= (reverse[0][0], len(back)):
            pop_forward()
        else:
            pop_reverse()
    return best


def transfer(rows: str) -> list[list[Label | None]]:
    """From each state before the rows to each state after them."""
    return [[cheapest(rows, a, (b,)) for b in range(4)] for a in range(4)]


def decoded(rows: str, entry: int, edits: str) -> Iterator[tuple[int | None, str, str | None, int]]:
    """What the edits put out, in order: the row (None: inserted), the edit, the new role (None: its own) and the state then."""
    i, state = 0, entry
    for edit in edits:
        if edit in "IR":
            state = spoken(state)
            yield (None if edit == "I" else i), edit, ROLES[state], state
        elif edit == "K":
            state = NEXT[state, rows[i].lower()]
            yield i, edit, None, state
        i += edit != "I"


class Fold:
    """Composes the pieces of one conversation in order, and gives out what all ways have in common as soon as it is known."""

    def __init__(self) -> None:
        self.ways: list[tuple[int, list[tuple[int, int, str]]] | None] = [(0, []), None, None, None]  # by state: cost, and (piece, entry, edits)

    def add(self, piece: int, own: list[list[Label | None]]) -> Iterator[tuple[int, int, str]]:
        def way(b: int) -> tuple[int, list] | None:
            found = [(one[0] + two[0], "".join(p[2] for p in one[1]) + two[1], a) for a, one in enumerate(self.ways) if one and (two := own[a][b])]
            if not found:
                return None
            cost, _, a = min(found)
            return cost, [*self.ways[a][1], (piece, a, own[a][b][1])]

        self.ways = [way(b) for b in range(4)]
        live = [w[1] for w in self.ways if w]
        same = 0
        while same < min(map(len, live)) and all(w[same] == live[0][same] for w in live):
            same += 1
        yield from live[0][:same]
        for w in live:
            del w[:same]

    def end(self) -> tuple[int, list[tuple[int, int, str]]]:
        cost, _, state = min((w[0], "".join(p[2] for p in w[1]), e) for e in ENDS if (w := self.ways[e]))
        return cost, self.ways[state][1]


PIECE_KEYS = "turns array<long>, roles array<string>, hashes array<binary>, copies array<long>"
PIECE_FACTS = "first_turn long, last_turn long, turns_seen long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
PIECE = f"conv string, part int, number int, alone boolean, rows string, {PIECE_FACTS}, {PIECE_KEYS}, entry int, cost long, edits string"
CHOSEN = "conv string, part int, number int, entry int, edits string, place long, last boolean, cost long"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    kind = lambda k: pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]
    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in ddl.split(", ")])


def batches_of(made: Iterator[tuple], ddl: str, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many rows."""
    schema, rows = arrow_schema(ddl), []
    for row in made:
        rows.append(row)
        if len(rows) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def rows_in(batches: Iterator[pa.RecordBatch], ddl: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c.split()[0]).to_pylist() for c in ddl.split(", ")], strict=True)


def letter(initial: str, blank: bool, truncated: bool, repeated: bool) -> str:
    if blank or repeated:
        return GONE
    own = initial if initial in ("s", "u", "a") else OTHER
    return own.upper() if truncated else own


ORDERED = "conv string, turn long, role string, h binary, n long, blank boolean, truncated boolean, duplicate boolean"


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows of a partition as pieces of at most about ``CHUNK`` rows, each of one conversation.

    A conversation that lies within one piece, and neither begins nor ends the partition, is whole here and
    solved at once; the other pieces are solved for all states before and after them later.
    """
    part = TaskContext.get().partitionId()
    held, number, in_front = None, 0, True

    def begun(conv: str) -> dict:
        return {"conv": conv, "rows": [], "keys": ([], [], [], []), "seen": 0, "turn": None, "first": None, "counts": [0, 0, 0, 0], "initials": [None, None]}

    def closed(own: dict, alone: bool) -> tuple:
        rows = "".join(own["rows"])
        found = cheapest(rows, START, ENDS) if alone else (None, None)
        facts = own["first"], own["turn"], own["seen"], *own["counts"], *own["initials"]
        return own["conv"], part, number, alone, rows, *facts, *own["keys"], START if alone else None, *found

    def add(own: dict, row: tuple, copy: int) -> None:
        _, turn, role, h, _, blank, truncated, duplicate = row
        keys = own["keys"]
        if copy and keys[3]:
            keys[3][-1] += 1
        else:
            for column, value in zip(keys, (turn, role, h, 1), strict=True):
                column.append(value)
        if turn is not None:
            own["seen"] += own["turn"] != turn
            own["first"] = turn if own["first"] is None else own["first"]
            own["turn"] = turn
        repeated, initial = duplicate or copy > 0, role[:1]
        own["rows"].append(letter(initial, blank, truncated, repeated))
        fault = 0 if blank else 1 if repeated else 2 if truncated else None
        if fault is not None:
            own["counts"][fault] += 1
        before = own["initials"][1]
        if before is None:
            own["initials"][0] = initial
        own["counts"][3] += before is not None and before + initial not in PAIRS
        own["initials"][1] = initial

    for row in rows_in(batches, ORDERED):
        if held is None:
            held = begun(row[0])
        elif held["conv"] != row[0]:
            yield closed(held, not number and not in_front)
            held, number, in_front = begun(row[0]), 0, False
        for copy in range(row[4]):
            if len(held["rows"]) == CHUNK:
                yield closed(held, False)
                held, number = begun(row[0]), number + 1
            add(held, row, copy)
    if held is not None:
        yield closed(held, False)


def chosen_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces in order (conversation, part, number) to the edits of each, the place of what it puts out, and the conversation's cost with its last piece."""
    conv, fold, place, waiting, many = None, None, 0, {}, 0

    def given(own: Iterator[tuple[int, int, str]], cost: int | None = None) -> Iterator[tuple]:
        nonlocal place
        own = list(own)
        for k, (piece, entry, edits) in enumerate(own):
            part, number = waiting.pop(piece)
            last = cost is not None and k == len(own) - 1
            yield conv, part, number, entry, edits, place, last, cost if last else None
            place += len(edits) - edits.count("D")

    def ended() -> Iterator[tuple]:
        cost, own = fold.end()
        if own:
            yield from given(own, cost)
        else:  # all was given out before: a row of its own tells the cost
            yield conv, None, None, None, "", place, True, cost

    for conv_, part, number, rows in rows_in(batches, "conv string, part int, number int, rows string"):
        if conv_ != conv or fold is None:
            if fold is not None:
                yield from ended()
            conv, fold, place, many = conv_, Fold(), 0, 0
        waiting[many] = part, number
        yield from given(fold.add(many, transfer(rows)))
        many += 1
    if fold is not None:
        yield from ended()


DECISION = "conv string, place long, edit string, turn long, role string, h binary, new_role string"


def decisions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, place, entry, edits, rows, *keys in rows_in(batches, f"conv string, place long, entry int, edits string, rows string, {PIECE_KEYS}"):
        of = [k for k, n in enumerate(keys[3]) for _ in range(n)]
        for row, edit, role, _ in decoded(rows, entry, edits):
            own = (None, None, None) if row is None else tuple(keys[c][of[row]] for c in range(3))
            yield conv, place, edit, *own, role
            place += 1


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))


def is_truncated(text: Column) -> Column:
    """Whether the last character that is no ASCII white space is none of . ! ?"""
    return ~F.regexp_like(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("~"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: ``conv`` (text), ``turn`` (long, may be null), ``role``, ``text`` and ``copies``, how often the row is there (0: it only names its conversation).

    Returns two tables. One row per conversation: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and
    ``audit``. One row per turn of the repaired conversations: ``conv``, ``place`` (from 0), ``edit`` (K kept, R given another role, I inserted), ``role`` and ``text``.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text. The rows of a
    conversation are dealt out by ranges of that order, so that one of any size is spread, and cut into pieces
    of about ``CHUNK`` rows; each piece is solved for all pairs of states, and the pieces are composed in order, with only their
    edits at hand. Equal rows are counted before they are moved, so copies of a row are one row with a number. A
    conversation's edits must fit into one cell, as the result has them in one. Null roles and texts are one space;
    an empty table gives two empty ones. ``gaps`` stops at the largest long.
    """
    space = F.lit(" ")
    rows = turns.select("conv", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "copies")
    rows = rows.withColumn("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    facts = rows.select("conv", "turn", "role", "h", "copies", is_blank(F.col("text")).alias("blank"), is_truncated(F.col("text")).alias("truncated"))
    facts = staged(facts.groupBy("conv", "turn", "role", "h", "blank", "truncated").agg(F.sum("copies").alias("n")))
    firsts = facts.where("n > 0 and not blank").groupBy("conv", "role", "h").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
    again = firsts.where("turns > 1").select("conv", "role", "h", F.col("first.turn").alias("first"), F.lit(True).alias("several"))
    facts = facts.join(again, ["conv", "role", "h"], "left")
    duplicate = F.coalesce(F.col("several") & ~F.col("turn").eqNullSafe(F.col("first")), F.lit(False))
    ordered = facts.select("conv", "turn", "role", "h", "n", "blank", "truncated", duplicate.alias("duplicate"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    dealt = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = staged(dealt.mapInArrow(lambda batches: batches_of(pieces_of(batches), PIECE, 64), PIECE))

    open_ = pieces.where("not alone").select("conv", "part", "number", "rows")
    open_ = open_.repartition("conv").sortWithinPartitions("conv", "part", "number")
    chosen = open_.mapInArrow(lambda batches: batches_of(chosen_of(batches), CHOSEN, 64), CHOSEN)
    solved = pieces.where("alone").select("conv", "part", "number", "entry", "edits", F.lit(0).cast("long").alias("place"), F.lit(True).alias("last"), "cost")
    chosen = staged(solved.unionByName(chosen))

    part = F.struct(F.coalesce("part", F.lit(1 << 30)).alias("part"), "number", "edits")
    audits = chosen.groupBy("conv").agg(F.max("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(part))["edits"], "").alias("audit"))
    counts = summed(pieces).join(audits, "conv")

    keys = pieces.select("conv", "part", "number", "rows", "turns", "roles", "hashes", "copies")
    decided = chosen.where("part is not null").select("conv", "part", "number", "entry", "edits", "place").join(keys, ["conv", "part", "number"])
    decided = decided.select("conv", "place", "entry", "edits", "rows", "turns", "roles", "hashes", "copies").mapInArrow(lambda batches: batches_of(decisions_of(batches), DECISION), DECISION)
    decided = staged(decided)
    inserted = decided.where("edit = 'I'").select("conv", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    # one row for each key on both sides, so no key is hot
    texts = rows.where("copies > 0").groupBy("conv", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("t"), "role", "h").agg(F.min("text").alias("text"))
    others = decided.where("edit <> 'I'").withColumn("t", F.coalesce(F.col("turn").cast("string"), F.lit("")))
    others = others.join(texts, ["conv", "t", "role", "h"]).select("conv", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    return counts, others.unionByName(inserted)


def summed(pieces: DataFrame) -> DataFrame:
    """The counts of the pieces' rows, and what lies between two pieces: a turn that both have, a pair of roles."""
    facts = [c.split()[0] for c in PIECE_FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            conv, own, turns, role = None, None, None, None
            for name, first, last, seen, *counts, first_role, last_role in rows_in(batches, f"conv string, {PIECE_FACTS}"):
                if own is None or name != conv:
                    if own is not None:
                        yield conv, *own, gaps(turns)
                    conv, own, turns, role = name, [0, 0, 0, 0], [None, None, 0], None
                own = [a + b for a, b in zip(own, counts, strict=True)]
                if first is not None:
                    turns = [first if turns[0] is None else turns[0], last, turns[2] + seen - (turns[1] == first)]
                if first_role is not None:
                    own[3] += role is not None and role + first_role not in PAIRS
                    role = last_role
            if own is not None:
                yield conv, *own, gaps(turns)

        yield from batches_of(out(), "conv string, blank long, duplicate long, truncated long, illegal long, gaps long")

    def gaps(turns: list) -> int:
        return 0 if turns[0] is None else min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1)

    sorted_ = pieces.select("conv", "part", "number", *facts).repartition("conv").sortWithinPartitions("conv", "part", "number")
    return sorted_.select("conv", *facts).mapInArrow(run, "conv string, blank long, duplicate long, truncated long, illegal long, gaps long")


def digests(repaired: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation's ``role:text`` lines, joined by line ends, as hex digits: ``conv`` and ``repaired_sha256``.

    A digest takes its input in order, so the lines of a conversation pass through one task, one after the other; none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            conv, own = None, None
            for name, line in rows_in(batches, "conv string, line binary"):
                if name != conv:
                    if own is not None:
                        yield conv, own.hexdigest()
                    conv, own = name, hashlib.sha256(line)
                else:
                    own.update(b"\n" + line)
            if own is not None:
                yield conv, own.hexdigest()

        yield from batches_of(out(), "conv string, repaired_sha256 string")

    lines = repaired.select("conv", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line").mapInArrow(run, "conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that the query repairs, by crc32 of ``conv_id:turn``: a dropped row stays with 0 copies, a repeated one has 2."""
    space = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select(
        conversation_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, F.lit(0)).when(code == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by rule, then repaired."""
    counts, repaired = repair(damaged(table(spark, sf_dir, "conversations")))
    found = counts.join(digests(repaired), "conv", "left")
    conv_id = F.when(F.col("conv") != "~", F.substring("conv", 2, 30)).cast("long")
    return found.select(
        conv_id.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
