"""Rows of a key in the order of their times, one step after the other, with a state: the same step on tables and on streams.

A step is a function (state, row) -> (state, outputs), with the state and
outputs as dicts (outputs None: no row). On a table each key's rows are folded
in order, in pieces that a pause cuts where the state forgets. On a stream rows
wait, as the key's state, until the watermark has passed them, are then taken
in order, and the step's own state stays for ``forget`` seconds of event time.
Rows later than the watermark are dropped, as everywhere on streams; all others
give what the table gives, however they come.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

Step = Callable[[dict[str, Any], dict[str, Any]], tuple[dict[str, Any], dict[str, Any] | None]]
_AT, _ROW = "at_us", "row_json"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def run_steps(step: Step, state: dict[str, Any], rows: Iterable[tuple[int, str]]) -> tuple[dict[str, Any], list[tuple[str, dict[str, Any]]]]:
    """(state, [(row, outputs)]) after rows (time, JSON) in order; equal times by their JSON."""
    out = []
    for at, text in sorted(rows):
        state, made = step(state, {**json.loads(text), "at": at})
        if made is not None:
            out.append((text, made))
    return state, out


def _frame(key: str, columns: list[str], made: list[tuple[str, dict[str, Any]]]) -> pd.DataFrame:
    listed = {"key": [key] * len(made), _ROW: [t for t, _ in made], **{c: [m[c] for _, m in made] for c in columns}}
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in listed.items()})


class InOrder(StatefulProcessor):
    """Rows wait until event time has passed them; state: waiting rows, and the step's state with the time of its last row."""

    def __init__(self, step: Step, columns: list[str], forget: float):
        self.step, self.columns, self.forget = step, columns, int(forget * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")
        self.now = handle.getValueState("now", "at long, state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due = set()
        for batch in rows:
            for at, row in zip(batch[_AT].tolist(), batch[_ROW], strict=True):
                self.waiting.appendValue((at, row))
                due.add(at // 1000 + 1)
        for t in due:
            self.handle.registerTimer(t)
        yield _frame(str(key[0]), self.columns, [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [(int(r[0]), str(r[1])) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < passed]
        last, state = (int(self.now.get()[0]), json.loads(self.now.get()[1])) if self.now.exists() else (None, {})
        if not ready:
            if last is not None and last // 1000 + self.forget < passed // 1000:
                self.now.clear()
            yield _frame(str(key[0]), self.columns, [])
            return
        left = [r for r in rows if r[0] >= passed]
        self.waiting.put(left) if left else self.waiting.clear()
        made = []
        for at, row in sorted(ready):
            if last is not None and at - last > self.forget * 1000:
                state = {}
            state, out = run_steps(self.step, state, [(at, row)])
            made += out
            last = at
        self.now.update((last, json.dumps(state)))
        self.handle.registerTimer(last // 1000 + self.forget + 1)
        yield _frame(str(key[0]), self.columns, made)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, step: Step, outputs: str, forget: float, late: str = "10 seconds") -> DataFrame:
    """``rows`` (key, ts, …) for which ``step`` gives outputs, with those (``outputs``: DDL of their columns).

    forget: seconds without a row after which a key's state is empty again; the step must give the
    same from an empty state then, which cuts a key's rows on a table into independent pieces. On a
    stream the session needs the RocksDB state store."""
    made = StructType.fromDDL(outputs)
    columns = made.names
    packed = rows.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias(_AT), F.to_json(F.struct(*rows.columns), _JSON | {"ignoreNullFields": "false"}).alias(_ROW)).where("key is not null and ts is not null")
    kind = f"key string, {_ROW} string, {outputs}"
    if rows.isStreaming:
        found = packed.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(InOrder(step, columns, forget), kind, "Append", "EventTime")
    else:
        w = Window.partitionBy("key").orderBy(_AT, _ROW)
        pause = F.coalesce(F.col(_AT) - F.lag(_AT).over(w) > int(forget * 1e6), F.lit(False)).cast("int")
        pieces = packed.withColumn("_new", pause).withColumn("_piece", F.sum("_new").over(w))

        def whole(group: pd.DataFrame) -> pd.DataFrame:
            _, out = run_steps(step, {}, zip(group[_AT].tolist(), group[_ROW], strict=True))
            return _frame(group["key"].iloc[0], columns, out)

        found = pieces.select("key", "_piece", _AT, _ROW).groupBy("key", "_piece").applyInPandas(whole, kind)
    names = [f.name for f in rows.schema.fields]
    back = F.from_json(_ROW, rows.schema, _JSON)
    return found.withColumn("_back", back).select(*(F.col("_back")[c].alias(c) for c in names), *columns)


# --- steps -------------------------------------------------------------------------------------


def cooldown(seconds: float = 1.0) -> Step:
    """A command is accepted if none was in the ``seconds`` before it."""
    gap = round(seconds * 1e6)

    def step(state: dict[str, Any], row: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any] | None]:
        last = state.get("last")
        return ({"last": row["at"]}, {"accepted": True}) if last is None or row["at"] - last >= gap else (state, None)

    return step


def running(state: dict[str, Any], row: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any] | None]:
    """Rows with ``paused`` (true or false) are controls; a chunk passes while the last control didn't pause its stream."""
    if row.get("paused") is not None:
        return {"paused": row["paused"]}, None
    return state, None if state.get("paused") else {"passed": True}


def gain(target: float = 0.1, least: float = 0.1, most: float = 10.0, share: float = 0.5) -> Step:
    """The smoothed gain after each chunk's ``volume``: it moves towards target / volume by ``share`` at most."""

    def step(state: dict[str, Any], row: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
        now, volume = state.get("gain", 1.0), row.get("volume") or 0.0
        if volume > 1e-4:
            want = min(max(target / volume, least), most)
            now *= min(want / now, 1 + share) if want > now else max(want / now, 1 - share)
        return {"gain": now}, {"gain": now}

    return step


def cache(hours: float = 24.0) -> Step:
    """Whether a key was asked for less than ``hours`` before."""
    span = hours * 3.6e9

    def step(state: dict[str, Any], row: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
        last = state.get("last")
        return {"last": row["at"]}, {"hit": last is not None and row["at"] - last < span}

    return step
