"""Sessions in the state of a stream: events become pieces, pieces become sessions, timers close them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PIECES = [T.StructField("start", T.LongType()), T.StructField("last", T.LongType()), T.StructField("n", T.LongType())]


def session_schema(key_fields: list[T.StructField], sums: list[str]) -> T.StructType:
    return T.StructType([*key_fields, *PIECES, *[T.StructField(s, T.DoubleType()) for s in sums], T.StructField("open", T.BooleanType()),
                         T.StructField("gone", T.BooleanType())])


def merge(parts: list[tuple], gap: int) -> list[tuple]:
    """Sessions (start, last, n, *sums) of parts; a part that starts within the gap after the last event belongs to it."""
    out: list[list] = []
    for p in sorted(parts):
        if out and p[0] - out[-1][1] < gap:
            held = out[-1]
            held[1] = max(held[1], p[1])
            held[2:] = [a + b for a, b in zip(held[2:], p[2:], strict=True)]
        else:
            out.append(list(p))
    return [tuple(s) for s in out]


def pieces(keys: list[str], gap: int, sums: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the events of a batch of rows (keys, __at, sums) into pieces of sessions, without a loop over rows."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            df = b.to_pandas()
            df = df.sort_values("__at", kind="stable").reset_index(drop=True)
            named = df.groupby(keys, dropna=False, sort=False).ngroup()
            fresh = ~(df["__at"] - df.groupby(named)["__at"].shift() < gap)
            df["__piece"] = fresh.groupby(named).cumsum()
            groups = df.groupby([named, "__piece"], sort=False)
            out = df.loc[groups.head(1).index, keys].reset_index(drop=True)
            firsts = groups.agg(start=("__at", "min"), last=("__at", "max"), n=("__at", "size"), **{s: (s, "sum") for s in sums}).reset_index(drop=True)
            types = [b.schema.field(k) for k in keys]
            schema = pa.schema([*types, ("start", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), *[(s, pa.float64()) for s in sums]])
            yield pa.RecordBatch.from_pandas(pd.concat([out, firsts], axis=1), schema=schema, preserve_index=False)

    return run


class SessionProcessor(StatefulProcessor):
    """Open sessions of a key by their start. Every change is emitted; a session that another one has taken in is emitted as gone.

    A batch emits a start once: what it has just extended ends after the watermark, so no timer of the same batch closes it. All open sessions of a key are
    one value with one timer, at the end of the first of them (due, in ms): a key costs a few calls a batch, however many sessions it has.
    """

    def __init__(self, keys: list[tuple[str, str]], gap: int, sums: list[str]):
        self.keys, self.gap, self.sums = keys, gap, sums

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ["start array<bigint>", "last array<bigint>", "n array<bigint>", *[f"{s} array<double>" for s in self.sums]]
        self.open = handle.getValueState("open", ", ".join(["due bigint", *columns]))

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [*[k for k, _ in self.keys], "start", "last", "n", *self.sums, "open", "gone"]
        return pd.DataFrame([(*key, *r) for r in rows], columns=names)

    def _held(self) -> tuple[int | None, list[tuple]]:
        held = self.open.get()
        return (None, []) if held is None else (held[0], list(zip(*held[1:], strict=True)))

    def _hold(self, due: int | None, sessions: list[tuple]) -> None:
        if not sessions:
            self.open.clear()
            return
        # the first millisecond at which a session is over
        first = -(-(min(s[1] for s in sessions) + self.gap) // 1000)
        if due is None or first < due:
            self.handle.registerTimer(first)
            due = first
        self.open.update((due, *[list(c) for c in zip(*sessions, strict=True)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, before = self._held()
        parts = [tuple(int(x) if i < 3 else float(x) for i, x in enumerate(r))
                 for df in rows for r in df[["start", "last", "n", *self.sums]].itertuples(index=False, name=None)]
        now = merge([*before, *parts], self.gap)
        starts = {s[0] for s in now}
        out = [(*s, False, True) for s in before if s[0] not in starts] + [(*s, True, False) for s in set(now) - set(before)]
        if out:
            self._hold(due, now)
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, held = self._held()
        done = [s for s in held if s[1] + self.gap <= passed * 1000]
        if done or (due is not None and due <= passed):
            self._hold(due if due is not None and due > passed else None, [s for s in held if s[1] + self.gap > passed * 1000])
        if done:
            yield self._frame(key, [(*s, False, False) for s in done])
