"""Ordered work per key that stays spread out when one key is hot.

Price histories are read in order: "what was the last good offer before this
row", "how many failures in a row", "when was the last admitted request". A
plain window puts every row of a key into one task, and one listing or store
may hold a third of all rows. ``KeyedSequence`` therefore cuts the rows of such
keys into consecutive segments, runs the window inside each segment and passes
the state at the end of a segment on to the next one:

* cut points come from a hash sample, so their number is bounded
  (``MAX_SEGMENTS``) whatever the table size; keys below ``cut_rows`` rows are
  never cut and cost one shuffle, exactly as a plain window;
* the state per segment is an aggregate with map-side combine over the rows of
  the cut keys; it has one row per segment and is broadcast back.

The cut points only decide where the work runs. Results do not depend on them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import staged

SEGMENT = "__segment"
CUT_ROWS = 5_000_000
MAX_SEGMENTS = 20_000
SAMPLE_PER_SEGMENT = 64


def cut_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cut_rows: int | None = None
) -> DataFrame | None:
    """Cut points ``(keys, __cuts array<struct(order)>)`` of the keys above ``cut_rows``.

    None when no key needs cutting. ``order`` must be unique within a key. The
    result is a local relation of at most about ``MAX_SEGMENTS`` points, built
    once, so that every later use of it sees the same cuts.
    """
    spark = df.sparkSession
    if cut_rows is None:
        cut_rows = int(spark.conf.get("pricetrail.sequence.cutRows", str(CUT_ROWS)))
    total = df.count()
    if total <= cut_rows:
        return None
    cut_rows = max(cut_rows, total // MAX_SEGMENTS)
    every = min(SAMPLE_PER_SEGMENT, cut_rows)
    modulus = max(1, cut_rows // every)
    at = F.struct(*[F.col(c) for c in order])
    sample = df.select(*keys, at.alias("__at")).where(
        F.pmod(F.xxhash64(*[F.col(c) for c in keys], *[F.col(c) for c in order]), F.lit(modulus)) == 0
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))
    points = (
        sample.withColumn("__rank", rank)
        .where(F.col("__rank") % every == 0)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("__at")).alias("__cuts"))
    )
    rows = points.collect()
    if not rows:
        return None
    return spark.createDataFrame(rows, points.schema)


def with_segment(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """Add how many of a row's sorted ``__cuts``, at most ``most``, do not come after it, by halving steps."""
    at = F.struct(*[F.col(c) for c in order])
    df = df.withColumn(SEGMENT, F.lit(0))
    for k in reversed(range(most.bit_length())):
        passed = F.get("__cuts", F.col(SEGMENT) + F.lit((1 << k) - 1)) <= at
        df = df.withColumn(SEGMENT, F.col(SEGMENT) + F.when(passed, F.lit(1 << k)).otherwise(F.lit(0)))
    return df


class KeyedSequence:
    """Rows of each key in a total order, with state carried along it."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        cut_rows: int | None = None,
        within: DataFrame | None = None,
    ) -> None:
        """``within``: a table with the keys and order of all rows of df, from which cut points are chosen where it costs less to read."""
        self.keys = list(keys)
        self.order = list(order)
        cuts = cut_points(df if within is None else within, keys, order, cut_rows)
        self.cut = cuts is not None
        if cuts is None:
            self.df = df.withColumn(SEGMENT, F.lit(0))
        else:
            most = cuts.agg(F.max(F.size("__cuts"))).first()[0]
            marked = with_segment(df.join(F.broadcast(cuts), self.keys, "left"), order, most)
            self.df = marked.withColumn("__hot", F.col("__cuts").isNotNull()).drop("__cuts")

    def _window(self):
        keys = [*self.keys, SEGMENT] if self.cut else self.keys
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _at(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def _segments_before(self, summary: DataFrame) -> DataFrame:
        """Broadcast a per-segment summary (one row per segment of a cut key)."""
        return F.broadcast(summary)

    def with_columns(self, columns: Mapping[str, Column]) -> KeyedSequence:
        self.df = self.df.withColumns(dict(columns))
        return self

    def carry(self, values: Mapping[str, Column], inclusive: bool = False) -> KeyedSequence:
        """Add per name the last non-null value over the earlier rows of the key."""
        end = 0 if inclusive else -1
        frame = self._window().rowsBetween(Window.unboundedPreceding, end)
        held = {f"__v{i}": v for i, v in enumerate(values.values())}
        df = self.df.withColumns(held)
        result = {
            name: F.last(slot, ignorenulls=True).over(frame)
            for name, slot in zip(values, held, strict=True)
        }
        if self.cut:
            at = self._at()
            last = [
                F.max_by(F.col(slot), F.when(F.col(slot).isNotNull(), at)).alias(slot)
                for slot in held
            ]
            before = Window.partitionBy(*self.keys).orderBy(SEGMENT).rowsBetween(
                Window.unboundedPreceding, -1
            )
            entering = (
                df.where("__hot")
                .groupBy(*self.keys, SEGMENT)
                .agg(*last)
                .select(
                    *self.keys,
                    SEGMENT,
                    *[F.last(s, ignorenulls=True).over(before).alias(f"{s}_in") for s in held],
                )
            )
            df = df.join(self._segments_before(entering), [*self.keys, SEGMENT], "left")
            result = {
                name: F.coalesce(col, F.col(f"{slot}_in"))
                for (name, col), slot in zip(result.items(), held, strict=True)
            }
        df = df.withColumns(result)
        self.df = df.drop(*held, *[f"{s}_in" for s in held])
        return self

    def running(self, values: Mapping[str, Column]) -> KeyedSequence:
        """Add per name the running total over the rows up to and including this one."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        held = {f"__v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(values.values())}
        df = self.df.withColumns(held)
        result = {
            name: F.sum(slot).over(frame) for name, slot in zip(values, held, strict=True)
        }
        if self.cut:
            before = Window.partitionBy(*self.keys).orderBy(SEGMENT).rowsBetween(
                Window.unboundedPreceding, -1
            )
            entering = (
                df.where("__hot")
                .groupBy(*self.keys, SEGMENT)
                .agg(*[F.sum(s).alias(s) for s in held])
                .select(
                    *self.keys, SEGMENT, *[F.sum(s).over(before).alias(f"{s}_in") for s in held]
                )
            )
            df = df.join(self._segments_before(entering), [*self.keys, SEGMENT], "left")
            result = {
                name: col + F.coalesce(F.col(f"{slot}_in"), F.lit(0))
                for (name, col), slot in zip(result.items(), held, strict=True)
            }
        df = df.withColumns(result)
        self.df = df.drop(*held, *[f"{s}_in" for s in held])
        return self

    def streak(self, name: str, counts: Column, resets: Column) -> KeyedSequence:
        """Add the number of ``counts`` rows since the last ``resets`` row, this row included."""
        self.running({"__count": counts.cast("long")})
        self.carry({"__base": F.when(resets, F.col("__count"))}, inclusive=True)
        self.df = self.df.withColumn(
            name, F.col("__count") - F.coalesce(F.col("__base"), F.lit(0))
        ).drop("__count", "__base")
        return self

    def result(self) -> DataFrame:
        return self.df.drop(SEGMENT, "__hot")


class Recurrence:
    """A recurrence that no window expresses, as its new state depends on the previous *decision*.

    ``run`` takes the state before a block of consecutive rows of a key and gives the outputs of all its
    rows, by array operations, and the state after it. States are JSON values.

    A recurrence that can tell what a whole segment does to *any* state before it also has
    ``transfer``, which starts an account of a segment (``add`` takes its blocks, ``summary`` gives a JSON value), and
    ``apply``, which gives the state after the segment, or ``UNKNOWN``.
    """

    #: The columns that ``run`` reads.
    reads: tuple[str, ...] = ()
    initial: Any = None

    def run(self, state: Any, block: pa.RecordBatch) -> tuple[Any, list[pa.Array]]:
        raise NotImplementedError

    def transfer(self) -> Any:
        return None

    def apply(self, summary: Any, state: Any) -> Any:
        return UNKNOWN


UNKNOWN = object()


def key_blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch, bool]]:
    """The stretches of equal keys in sorted batches: the key, whether it is new, the rows, and whether they end their batch."""
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(batch.column(k)[int(start)].as_py() for k in keys)
            yield key, key != current, batch.slice(start, end - start), end == batch.num_rows
            current = key


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    recurrence: Recurrence,
    outputs: T.StructType,
    cut_rows: int | None = None,
) -> DataFrame:
    """Run a recurrence along each key and add its outputs to every row.

    Rows stream through in order, a block at a time, and only the small JSON state is held, never a group.
    Where keys are cut, one job sums up every segment of theirs by its transfer function; the states before
    the segments follow by applying these one after the other, a step per segment.
    Keys with a segment whose transfer does not tell the answer are walked in order once more,
    by the columns that the recurrence reads, in one further job. A last job gives all rows,
    segments side by side. So the number of jobs does not depend on how many segments there are,
    and the result is exact.
    """
    sequence = KeyedSequence(df, keys, order, cut_rows)
    columns = [f.name for f in df.schema.fields]
    names = [f.name for f in outputs.fields]
    start = json.dumps(recurrence.initial)
    row_schema = T.StructType([*df.schema.fields, *outputs.fields])

    def arranged(frame: DataFrame, dealt: Sequence[str]) -> DataFrame:
        return frame.repartition(*dealt).sortWithinPartitions(*keys, SEGMENT, *order)

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own, made = None, [], []
        for _, new, block, last in key_blocks(batches, [*keys, SEGMENT]):
            if new:
                state = json.loads(block.column("__enter")[0].as_py())
            state, out = recurrence.run(state, block)
            own.append(block.select(columns))
            made.append(out)
            if last:
                rows = pa.Table.from_batches(own).combine_chunks()
                added = [pa.concat_arrays([m[k] for m in made]) for k in range(len(names))]
                kept = [rows.column(c).chunk(0) if rows.column(c).num_chunks else pa.array([], rows.schema.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, *added], [*columns, *names])
                own, made = [], []

    base = sequence.df
    if not sequence.cut:
        return arranged(base.withColumn("__enter", F.lit(start)), [*keys, SEGMENT]).mapInArrow(rows_out, row_schema)

    spark = df.sparkSession
    base = staged(base)
    field = lambda name, kind=T.StringType(): T.StructField(name, kind)
    key_fields = [*[df.schema[k] for k in keys], field(SEGMENT, T.IntegerType())]
    narrow = list(dict.fromkeys([*keys, SEGMENT, *order, *recurrence.reads]))
    hot = base.where("__hot").select(*narrow)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per segment what it makes of the initial state, and its transfer."""
        held: list[tuple] = []
        kinds: list[pa.DataType] = []
        state = account = None
        for key, new, block, _ in key_blocks(batches, [*keys, SEGMENT]):
            kinds = [block.schema.field(k).type for k in keys]
            if new:
                state, account = recurrence.initial, recurrence.transfer()
                held.append(None)
            state, _ = recurrence.run(state, block)
            if account is not None:
                account.add(block)
            held[-1] = (*key, json.dumps(state), None if account is None else json.dumps(account.summary()))
        yield from ends_batch(held, kinds)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a key one after the other, from a known state before the first."""
        held: list[tuple] = []
        kinds: list[pa.DataType] = []
        current = state = None
        for key, new, block, _ in key_blocks(batches, [*keys, SEGMENT]):
            kinds = [block.schema.field(k).type for k in keys]
            if new and key[:-1] != current:
                current, state = key[:-1], json.loads(block.column("__enter")[0].as_py())
            state, _ = recurrence.run(state, block)
            if new:
                held.append(None)
            held[-1] = (*key, json.dumps(state), None)
        yield from ends_batch(held, kinds)

    def ends_batch(held: list[tuple], key_types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        if held:
            kinds = [*key_types, pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [*keys, SEGMENT, "__end", "__transfer"])

    end_schema = T.StructType([*key_fields, field("__end"), field("__transfer")])
    found = [tuple(r) for r in arranged(hot, [*keys, SEGMENT]).mapInArrow(summaries, end_schema).collect()]  # a row for each segment
    of_key: dict[tuple, list[tuple]] = {}
    for *key, segment, end, own in found:
        of_key.setdefault(tuple(key), []).append((segment, end, own))
    entering: dict[tuple, Any] = {}
    unsettled: dict[tuple, int] = {}
    for key, segments in of_key.items():
        segments.sort()
        state: Any = recurrence.initial
        for place, (segment, end, own) in enumerate(segments):
            entering[*key, segment] = state
            after = json.loads(end) if not place or state == recurrence.initial else UNKNOWN if own is None else recurrence.apply(json.loads(own), state)
            if after is UNKNOWN:
                unsettled[key] = segment
                break
            state = after
    if unsettled:
        begin = spark.createDataFrame([(*key, segment, json.dumps(entering[*key, segment])) for key, segment in unsettled.items()], T.StructType([*key_fields[:-1], field("__from", T.IntegerType()), field("__enter")]))
        part = hot.join(F.broadcast(begin), list(keys)).where(F.col(SEGMENT) >= F.col("__from")).drop("__from")
        ends = [tuple(r) for r in arranged(part, keys).mapInArrow(walked, end_schema).collect()]
        after_of = {(*key, segment): json.loads(end) for *key, segment, end, _ in ends}
        for key in unsettled:
            numbers = [segment for segment, *_ in of_key[key]]
            for before, segment in zip(numbers, numbers[1:], strict=False):
                if (*key, before) in after_of:
                    entering[*key, segment] = after_of[*key, before]
    entries = spark.createDataFrame([(*s, json.dumps(state)) for s, state in entering.items()], T.StructType([*key_fields, field("__enter")]))
    ready = base.join(F.broadcast(entries), [*keys, SEGMENT], "left").withColumn("__enter", F.coalesce(F.col("__enter"), F.lit(start)))
    return arranged(ready, [*keys, SEGMENT]).mapInArrow(rows_out, row_schema)
