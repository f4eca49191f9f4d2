"""Folds over each key's rows in the order of their times, whatever order a stream brings them in, with kept state."""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Fold = Callable[[object, list[dict]], tuple[object, list[dict]]]
#: A fold over (time in microseconds, text) with texts as outputs.
TextFold = Callable[[object, list], tuple[object, list[str]]]

#: Rows travel through the state as JSON, with all of a timestamp's digits.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
FIRST = -(2**63)
#: Rows of a sorted run, of a stored block of one, and of a call of the fold.
RUN, BLOCK, CALL = 50_000, 500, 10_000


class InOrder(StatefulProcessor):
    """Holds a group's rows until the watermark has reached them, then folds them in order of their times.

    fold(state, rows) -> (state, outputs); the state is anything that JSON can hold, None before the first row. Rows of one
    time come in the order of their texts; rows at FIRST have no time and go through timeless as they come. Rows wait as
    sorted runs of blocks and are merged block by block: a task has a run and a block of each run at once, whatever waits.
    """

    def __init__(self, fold: TextFold, timeless: Callable[[list[str]], list[str]] | None = None, run: int = RUN, block: int = BLOCK):
        self.fold, self.timeless, self.run, self.block = fold, timeless, run, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "run long, block long", "rows string")
        # of each run: its number, its next block and the one past its last, its first time, its rows
        self.runs = handle.getValueState("runs", "held string")
        self.state = handle.getValueState("state", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, new = self._held(self.runs) or [], []
        for pdf in rows:
            found = [(int(at), row) for at, row in zip(pdf.iloc[:, 1], pdf.iloc[:, 2])]  # by place: Spark hands no names on
            if first := [row for at, row in found if at == FIRST]:
                yield pd.DataFrame({"_row": self.timeless(first)})
            new += [x for x in found if x[0] != FIRST]
            if len(new) >= self.run:
                self._keep(runs, new)
                new = []
        if new:
            self._keep(runs, new)
        if runs:
            self.runs.update((json.dumps(runs),))
            self._wake(min(r["first"] for r in runs))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        runs, state = self._held(self.runs) or [], self._held(self.state)
        merged = heapq.merge(*(self._read(r, now * 1000) for r in runs if r["first"] <= now * 1000))
        while part := list(islice(merged, CALL)):
            state, out = self.fold(state, part)
            if out:
                yield pd.DataFrame({"_row": out})
        self.state.update((json.dumps(state),))
        runs = [r for r in runs if r["next"] < r["end"]]
        self.runs.update((json.dumps(runs),))
        if runs:
            self._wake(min(r["first"] for r in runs), after=now)

    def _held(self, state):
        return json.loads(state.get()[0]) if state.exists() else None

    def _keep(self, runs: list[dict], new: list) -> None:
        """New rows as a run, together with the last ones that are no longer."""
        while runs and runs[-1]["rows"] <= len(new) < self.run:
            new = [*new, *self._read(runs.pop())]
        new.sort()
        run = 1 + max((r["run"] for r in runs), default=-1)
        starts = range(0, len(new), self.block)
        for k, i in enumerate(starts):
            self.blocks.updateValue((run, k), (json.dumps(new[i:i + self.block]),))
        runs.append({"run": run, "next": 0, "end": len(starts), "first": new[0][0], "rows": len(new)})

    def _read(self, run: dict, until: int = 2**63) -> Iterator[tuple[int, str]]:
        """The rows of a run up to a time, which are forgotten."""
        for k in range(run["next"], run["end"]):
            rows = [tuple(r) for r in json.loads(self.blocks.getValue((run["run"], k))[0])]
            n = bisect_right(rows, until, key=lambda r: r[0])
            run["rows"] -= n
            if n < len(rows):
                run.update(next=k, first=rows[n][0])
                self.blocks.updateValue((run["run"], k), (json.dumps(rows[n:]),))
                yield from rows[:n]
                return
            self.blocks.removeKey((run["run"], k))
            run["next"] = k + 1
            yield from rows

    def close(self) -> None:
        pass

    def _wake(self, at: int, after: int = -1) -> None:
        """The group's one timer stands at its first waiting row; no watermark is before 0."""
        when = max(0, -(-at // 1000))
        timers = [t for t in (int(t[0] if isinstance(t, (tuple, list)) else t) for t in self.handle.listTimers()) if t > after]
        if not timers or when < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(when)


def _parsed(fold: Fold, skipped: int) -> TextFold:
    def run(state, rows):
        state, out = fold(state, [json.loads(row[skipped:]) for _, row in rows])
        return state, [json.dumps(r) for r in out]

    return run


def in_order(rows: DataFrame, keys: Sequence[str], time: str, fold: Fold, schema: str, late: str = "1 minute", tie: str | None = None) -> DataFrame:
    """The fold's outputs (schema) over a stream's rows by key; rows without a time are dropped, as they have no place.

    Rows of one time come in the order of tie, a column of whole numbers, if it is given, and of their JSON text.

    A fold gets rows as dicts without their null fields, numbers as JSON has them. State lies in a store on disk, see
    identity.STORE.
    """
    group = F.to_json(F.struct(*keys), JSON)
    timed = rows.filter(F.col(time).isNotNull()).withWatermark(time, late)
    row = F.to_json(F.struct(*rows.columns), JSON)
    if tie:  # sixteen digits whose order is that of the numbers
        row = F.concat(F.lpad(F.hex(F.coalesce(F.col(tie).cast("long"), F.lit(FIRST)).bitwiseXOR(F.lit(FIRST))), 16, "0"), row)
    made = timed.select(group.alias("_key"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), row.alias("_row"), F.col(time).alias("_time"))
    out = made.groupBy("_key").transformWithStateInPandas(InOrder(_parsed(fold, 16 if tie else 0)), "_row string", "Append", "EventTime")
    return out.select(F.from_json("_row", schema).alias("r")).select("r.*")


def carrying(keys: Sequence[str], order: str, rate: str, seconds: int, least: int = 60) -> Fold:
    """The recurrence of operators.scan.carried: amounts under the least are carried to the key's next window."""

    def fold(state, rows):
        carry, out = state or 0, []
        for r in rows:
            amount = math.floor((max(r.get(rate, 0.0), 0.0) + carry) * seconds / 60)
            carry = amount if amount < least else 0
            out.append({**{k: r.get(k) for k in (*keys, order)}, "amount": amount, "sent": amount if amount >= least else 0})
        return carry, out

    return fold


def last_known(keys: Sequence[str], order: str, column: str) -> Fold:
    """The last value so far of a column that isn't in every row, as operators.sequence.carried."""

    def fold(state, rows):
        out = []
        for r in rows:
            state = r.get(column, state)
            out.append({**{k: r.get(k) for k in (*keys, order)}, column: state})
        return state, out

    return fold


def angles(keys: Sequence[str], order: str, size: int, column: str = "vector") -> Fold:
    """The angle of each vector to the mean of the size before it, as operators.sequence.sliding_angles."""

    def fold(state, rows):
        held, out = state or [], []
        for r in rows:
            v, angle = r.get(column) or [], None
            if len(held) == size:
                n = max(map(len, [*held, v]))
                past, now = (np.array([[*(y or 0.0 for y in x), *[0.0] * (n - len(x))] for x in xs]) for xs in (held, [v]))
                mean = past.mean(0)
                norm = np.linalg.norm(mean) * np.linalg.norm(now[0])
                angle = float(np.arccos(np.clip(mean @ now[0] / norm, -1, 1))) if norm > 0 else None
            held = [*held, v][-size:]
            out.append({**{k: r.get(k) for k in (*keys, order)}, "angle": angle})
        return held, out

    return fold
