"""Utterances from levels of sound, commands, and a cache with a time limit; the same functions on streams and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import cache, cooldown, gain, in_order, running

LEVEL, GAP, LEAST, MOST = 0.025, "1 second", 0.5, 10.0
COOLDOWN = 1.0
#: Seconds after which a pause or a gain is forgotten.
FORGET = 24 * 3600.0
_SPELL = "stream_id string, start timestamp, stop timestamp, n long, mean_level double"


def utterances(levels: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(stream_id, start, stop, n, mean_level) of levels (stream_id, ts, level): loud spells that a second of silence ends.

    On a stream, rows later than ``late`` are dropped and a spell is told once it is over."""
    loud = levels.where(F.col("level") > LEVEL)
    loud = loud.withWatermark("ts", late) if levels.isStreaming else loud
    spells = loud.groupBy("stream_id", F.session_window("ts", GAP).alias("w")).agg(F.count("*").alias("n"), F.avg("level").alias("mean_level"), F.max("ts").alias("last"))
    long = (F.unix_micros("last") - F.unix_micros("w.start")) / 1e6 >= LEAST
    return spells.where(long).select("stream_id", F.col("w.start").alias("start"), F.col("last").alias("stop"), "n", "mean_level")


def _cut(times: pd.Series, levels: pd.Series, open_spell: tuple | None, gap: float, most: float) -> tuple[list[tuple], tuple | None]:
    """(ended spells, the open one): spells (start, stop, n, sum of levels) of loud chunks in order; a pause or the longest duration ends one."""
    out, now = [], open_spell
    for t, v in zip(times, levels, strict=True):
        if now and t - now[1] >= gap:
            out.append(now)
            now = None
        now = (now[0], t, now[2] + 1, now[3] + v) if now else (t, t, 1, v)
        if now[1] - now[0] > most:
            out.append(now)
            now = None
    return out, now


def _rows(key: str, spells: list[tuple]) -> pd.DataFrame:
    kept = [s for s in spells if s[1] - s[0] >= LEAST]
    stamp = lambda k: pd.to_datetime([round(s[k] * 1e6) for s in kept], unit="us")
    return pd.DataFrame({"stream_id": [key] * len(kept), "start": stamp(0), "stop": stamp(1), "n": [s[2] for s in kept], "mean_level": [s[3] / s[2] for s in kept]})


def cut_utterances(levels: DataFrame, most: float = MOST, gap: float = 1.0) -> DataFrame:
    """As ``utterances``, and a spell ends too once it is longer than ``most`` seconds; one ordered pass over each stream's loud chunks.

    On a stream the open spell is the key's state, given out when a second of event time passes without a chunk."""
    loud = levels.where(F.col("level") > LEVEL).select(F.col("stream_id").cast("string").alias("stream_id"), "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "level")
    if not levels.isStreaming:

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            done, last = _cut(rows["at"], rows["level"], None, gap, most)
            return _rows(rows["stream_id"].iloc[0], done + [last] * (last is not None))

        return loud.groupBy("stream_id").applyInPandas(whole, _SPELL)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _rows(key[0], [now] if now else [])
            return
        rows = pd.concat(list(batches)).sort_values("at")
        done, now = _cut(rows["at"], rows["level"], now, gap, most)
        if now:
            state.update(now)
            state.setTimeoutTimestamp(int((now[1] + gap) * 1000) + 1 if int((now[1] + gap) * 1000) + 1 > state.getCurrentWatermarkMs() else state.getCurrentWatermarkMs() + 1)
        elif state.exists:
            state.remove()
        yield _rows(key[0], done)

    return loud.withWatermark("ts", "10 seconds").groupBy("stream_id").applyInPandasWithState(step, _SPELL, "start double, stop double, n long, total double", "append", GroupStateTimeout.EventTimeTimeout)


def cooled(commands: DataFrame, seconds: float = COOLDOWN, late: str = "10 seconds") -> DataFrame:
    """Commands (stream_id, ts, …), of a table or a stream, without those that come less than ``seconds`` after the last one accepted.

    What is accepted depends on what was accepted before, so commands are taken in order; a pause of
    ``seconds`` starts anew, so a table's rows are folded in pieces between such pauses."""
    return in_order(commands, "stream_id", cooldown(seconds), "accepted boolean", seconds, late).drop("accepted")


def while_running(chunks: DataFrame, controls: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Chunks (stream_id, ts, …) that come while their stream isn't paused; controls: (stream_id, ts, paused), the latest at or before a chunk counts.

    On streams both are one stream of rows in order; a pause is forgotten after a day without any row."""
    if chunks.isStreaming:
        both = controls.select("stream_id", "ts", "paused", F.lit(0).alias("_kind")).unionByName(chunks.withColumns({"paused": F.lit(None).cast("boolean"), "_kind": F.lit(1)}), allowMissingColumns=True)
        # rows of one time are taken in the order of their columns: a control goes before a chunk
        return in_order(both.select("_kind", "paused", *chunks.columns), "stream_id", running, "passed boolean", FORGET, late).select(chunks.columns)
    both = chunks.withColumn("_paused", F.lit(None).cast("boolean")).unionByName(controls.select("stream_id", "ts", F.col("paused").alias("_paused")), allowMissingColumns=True)
    both = both.withColumn("_kind", F.col("_paused").isNull().cast("int"))  # a control goes before a chunk of its time
    w = Window.partitionBy("stream_id").orderBy("ts", "_kind")
    state = both.withColumn("_now", F.coalesce(F.last("_paused", ignorenulls=True).over(w), F.lit(False)))
    return state.where("_kind = 1 and not _now").select(chunks.columns)


def gains(volumes: DataFrame, target: float = 0.1, least: float = 0.1, most: float = 10.0, step: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """(stream_id, ts, volume, gain): the smoothed gain after each chunk (stream_id, ts, volume) of a table or a stream; it moves towards target / volume by a share of ``step`` at most, and is 1 again after a day without chunks."""
    rows = volumes.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("volume").cast("double").alias("volume"))
    return in_order(rows, "stream_id", gain(target, least, most, step), "gain double", FORGET, late)


def best_transcript(results: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, text) of results (id, model, text, confidence): the greatest length times confidence among the confident ones, else the most confident; of two alike the first model."""
    rank = Window.partitionBy("id").orderBy(F.desc(F.col("confidence") > least), F.desc(F.when(F.col("confidence") > least, F.length("text") * F.col("confidence")).otherwise(F.col("confidence"))), "model")
    return results.where("text <> ''").withColumn("_r", F.row_number().over(rank)).where("_r = 1").select("id", "text")


def last_entries(history: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each key of history (key, ts, …)."""
    return history.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts")))).where(F.col("_r") <= n).drop("_r")


def cache_hits(requests: DataFrame, hours: float = 24.0, late: str = "10 seconds") -> DataFrame:
    """(key, ts, hit) of requests (key, ts): whether the key was asked for less than ``hours`` before. On a stream a key is forgotten after that time."""
    rows = requests.select(F.lower(F.trim("key")).alias("key"), "ts")
    if requests.isStreaming:
        return in_order(rows, "key", cache(hours), "hit boolean", hours * 3600, late)
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts"))
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 3.6e9
    return rows.select("key", "ts", F.coalesce(age < hours, F.lit(False)).alias("hit"))
