"""Keyed state for streams: carried values, streaks and recurrences.

The Python side only moves small JSON texts along a key. Everything that
compares offers or counts events stays in column expressions, which are the same
ones the batch operators use, so that both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def prepare_streaming(spark: SparkSession) -> SparkSession:
    """State operators need the disk-backed store, whose changes are checkpointed per batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    return spark


def _sorted_rows(batches: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame | None:
    """The key's rows of one micro-batch in order. A trigger bounds how many there are."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return None
    return pd.concat(parts, ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


class JsonState:
    """One JSON text per key."""

    def __init__(self, handle: StatefulProcessorHandle, name: str = "state") -> None:
        self._value = handle.getValueState(name, T.StructType([T.StructField("json", T.StringType())]))

    def get(self, default: Any) -> Any:
        return json.loads(self._value.get()[0]) if self._value.exists() else default

    def set(self, value: Any) -> None:
        self._value.update((json.dumps(value),))


class Carry(StatefulProcessor):
    """Adds the last values and the streaks before and at each row."""

    def __init__(self, columns, order, carries, streaks) -> None:
        self.columns, self.order, self.carries, self.streaks = columns, order, carries, streaks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = JsonState(handle)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802 - Spark's name
        frame = _sorted_rows(rows, self.order)
        if frame is None:
            return
        held, counts = self.state.get([{}, {}])
        added: dict[str, list] = {f"prev_{n}": [] for n in self.carries}
        added |= {n: [] for n in self.streaks}
        values = {n: frame[f"held_{n}"].tolist() for n in self.carries}
        flags = {n: (frame[f"up_{n}"].tolist(), frame[f"reset_{n}"].tolist()) for n in self.streaks}
        for i in range(len(frame)):
            for n in self.carries:
                added[f"prev_{n}"].append(held.get(n))
                if values[n][i] is not None:
                    held[n] = values[n][i]
            for n in self.streaks:
                up, reset = flags[n]
                now = 0 if reset[i] else counts.get(n, 0)
                counts[n] = now + (1 if up[i] and not reset[i] else 0)
                added[n].append(counts[n])
        self.state.set([held, counts])
        out = frame[self.columns].copy()
        for name, column in added.items():
            out[name] = pd.Series(column, index=out.index, dtype=object)
        yield out

    def close(self) -> None:
        pass


def carry_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carries: Mapping[str, Column],
    streaks: Mapping[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Stream twin of ``KeyedSequence``: last non-null structs before a row, and streaks up to it.

    A streak counts ``counts`` rows since the last ``resets`` row; resets do not count.
    """
    streaks = streaks or {}
    kinds = {n: stream.select(c.alias("x")).schema["x"].dataType for n, c in carries.items()}
    columns = stream.columns
    staged = stream.withColumns(
        {
            **{f"held_{n}": F.when(c.isNotNull(), F.to_json(c, TIMES)) for n, c in carries.items()},
            **{f"up_{n}": F.coalesce(up, F.lit(False)) for n, (up, _) in streaks.items()},
            **{f"reset_{n}": F.coalesce(reset, F.lit(False)) for n, (_, reset) in streaks.items()},
        }
    )
    out = T.StructType(
        [
            *stream.schema.fields,
            *[T.StructField(f"prev_{n}", T.StringType()) for n in carries],
            *[T.StructField(n, T.LongType()) for n in streaks],
        ]
    )
    processor = Carry(columns, list(order), list(carries), list(streaks))
    made = staged.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None"
    )
    back = {n: F.from_json(F.col(f"prev_{n}"), kinds[n], TIMES) for n in carries}
    return made.withColumns(back).drop(*[f"prev_{n}" for n in carries])


class Fold(StatefulProcessor):
    """Runs the step function of a batch ``fold`` over a key's rows."""

    def __init__(self, columns, order, step, initial, names) -> None:
        self.columns, self.order, self.step, self.initial, self.names = columns, order, step, initial, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = JsonState(handle)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        frame = _sorted_rows(rows, self.order)
        if frame is None:
            return
        state = self.state.get(self.initial)
        made = []
        for row in frame.itertuples(index=False):
            state, out = self.step(state, row)
            made.append(out)
        self.state.set(state)
        extra = pd.DataFrame(made, columns=self.names, index=frame.index, dtype=object)
        yield pd.concat([frame[self.columns], extra], axis=1)

    def close(self) -> None:
        pass


def fold_stream(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, initial: Any, outputs: T.StructType
) -> DataFrame:
    """Stream twin of ``sequences.fold`` with the same step function."""
    out = T.StructType([*stream.schema.fields, *outputs.fields])
    processor = Fold(stream.columns, list(order), step, initial, [f.name for f in outputs.fields])
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None"
    )
