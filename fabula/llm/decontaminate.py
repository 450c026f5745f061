"""Benchmark decontamination by template windows.

Texts become runs of letters and digits, lower-cased. Each text has two token
streams: the plain words, and its template, in which numbers, units and names
are typed placeholders (a number starts with a digit, a unit is a listed word,
a name is a capitalised word within a sentence). Windows of WIDTH tokens of
both are hashed. A bit table of fixed size over the benchmark's windows turns
away most windows of the documents as they are read; the rest is joined with
the benchmark's windows by hash. Windows of a document that lie on one
diagonal of an item (the same shift of positions) are put together; the tokens
they cover tell how much of the item the document holds.

A template match counts only if its slots are consistent: each value of the
item must stand for one value in the document wherever the diagonal has it, and
different values for different ones, up to SLOT_SHARE of the slots. That finds
questions with new numbers and names, and leaves texts alone that share little
but placeholders. Windows need LITERAL plain tokens at least.

A document is contaminated by an item if SHARE of the item's tokens are
covered on one diagonal, or LONG of them.

Defined results: null and empty texts match nothing, and an item without
tokens is in no document; an item shorter than a window is one window of its
own length; rows that repeat a doc_id are read as one document's parts; rows
with a null doc_id or item_id are left out of the matches (and stay in
``decontaminate``). Other columns never clash, as only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_long, fold_hashes, text_chunks, tidied
from .letters import Runs

WIDTH = 6
LITERAL = 3
SHARE = 0.5
LONG = 25
SLOT_SHARE = 0.75
#: Bits of the table that stands for the benchmark's windows (16 MB at most as bytes, whatever the benchmark's size).
TABLE_BITS = 24
#: Rows of benchmark windows up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 100_000
#: Units of measure and currencies that become a placeholder after a number.
UNITS = ("mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "mile", "miles", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "s", "ms", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "degree", "degrees", "w", "kw", "kwh", "v", "j", "n", "pa", "hz", "mph")
NUMBER, UNIT, NAME = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE72938495AB5), np.uint64(0xE6546B6485EBCA6B)
_STOPS = np.array([ord(c) for c in ".!?:;\n\"“”«»()[]|"], np.uint32)


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Runs(data, np.array([0, len(data)]), "alnum").hashes())


_units: list[np.ndarray] = []


def canonical(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(plain token hashes, template token hashes, row of each) of a chunk of texts."""
    runs = Runs(data, offs, "alnum")
    plain = runs.hashes()
    if not len(plain):
        return plain, plain, runs.rows
    if not _units:
        _units.append(_hash_words(UNITS))
    first = runs.raw[runs.starts]
    number = (first >= 48) & (first <= 57)
    after = np.r_[False, number[:-1] & (runs.rows[1:] == runs.rows[:-1])]
    unit = after & np.isin(plain, _units[0])
    stops = np.r_[0, np.cumsum(np.isin(runs.raw, _STOPS))]
    begins = np.r_[True, (runs.rows[1:] != runs.rows[:-1]) | (stops[runs.starts[1:]] > stops[runs.ends[:-1]])]
    name = ~begins & ~number & (first != runs.points[runs.starts])
    template = plain.copy()
    template[number], template[unit], template[name] = NUMBER, UNIT, NAME
    return plain, template, runs.rows


def windows(plain: np.ndarray, template: np.ndarray, rows: np.ndarray, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hash, first token, form) of the windows of both streams; form 0 is plain, 1 template. Shorter rows give one window."""
    n = len(plain)
    if not n:
        return
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    sizes = np.diff(np.r_[first, n])
    for form, tokens in enumerate((plain, template)):
        slot = plain != template
        for k in range(1, width + 1):
            if k < width:
                at = first[sizes == k]
            else:
                at = np.flatnonzero(rows[: n - width + 1] == rows[width - 1 :]) if n >= width else first[:0]
            if len(at) and form:
                filled = np.r_[0, np.cumsum(slot)]
                slots = filled[at + k] - filled[at]
                at = at[(slots > 0) & (k - slots >= min(LITERAL, k))]
            if len(at):
                yield fold_hashes([tokens[at + i] for i in range(k)], 2 * k + form), at, form


def _table(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _rows_of(batch: pa.RecordBatch, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(id, n, h, at, width, slots): windows of each text, all or those that the table knows."""
    for first, stop, data, offs in text_chunks(batch.column("text")):
        plain, template, rows = canonical(data, offs)
        if not len(plain):
            continue
        ids = batch.column("id").slice(first, stop - first).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.searchsorted(rows, np.arange(stop - first))
        count = np.bincount(rows, minlength=stop - first)
        slot = np.where(plain != template, plain, np.uint64(0))
        for h, at, form in windows(plain, template, rows):
            if table is not None:
                likely = table[_table(h)]
                h, at = h[likely], at[likely]
            if not len(h):
                continue
            row = rows[at]
            width = np.minimum(WIDTH, count[row])
            if form:
                sizes = np.r_[0, np.cumsum(width)].astype(np.int32)
                values = slot[np.arange(sizes[-1]) + np.repeat(at - sizes[:-1], width)]
            else:
                sizes, values = np.zeros(len(h) + 1, np.int32), slot[:0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(count[row].astype(np.int32)), pa.array(as_long(h)), pa.array((at - start[row]).astype(np.int32)), pa.array(width.astype(np.int32)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(as_long(values)))],
                ["id", "n", "h", "at", "width", "slots"],
            )


_ROWS = "id long, n int, h long, at int, width int, slots array<long>"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, template): each document and item that it holds.

    covered: the item's tokens on the best diagonal; template: whether only the template, not the plain words, holds so much."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")

    def all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows_of(batch, None)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            bits[_table(batch.column("h").to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(bits).astype(np.int32))], ["bit"])

    wanted = scratch.save(rows(benchmark, "item_id").mapInArrow(tidied(all_windows), _ROWS), "benchmark-windows")
    bits = np.zeros(1 << TABLE_BITS, bool)
    bits[wanted.select("h").mapInArrow(marks, "bit int").distinct().toPandas()["bit"].to_numpy(np.int64)] = True  # 2**TABLE_BITS rows at most
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def known_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            yield from _rows_of(batch, table)

    small = wanted.count() <= BROADCAST_WINDOWS
    item = wanted.select(F.col("id").alias("item_id"), F.col("n").alias("item_tokens"), "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    hits = rows(docs, "doc_id").mapInArrow(tidied(known_windows), _ROWS).join(F.broadcast(item) if small else item, "h")
    # a diagonal has a window for each of the item's tokens and form at most, if a document's text is one row
    pairs = F.transform(F.filter(F.arrays_zip(F.col("item_slots").alias("b"), F.col("slots").alias("d")), lambda s: (s["b"] != 0) & (s["d"] != 0)), lambda s: F.struct(s["b"].alias("b"), s["d"].alias("d")))
    tokens = lambda keep: F.size(F.array_distinct(F.flatten(F.collect_set(F.when(keep, F.sequence(F.col("item_at"), F.col("item_at") + F.col("width") - 1))))))
    literal = F.size("item_slots") == 0
    by_diagonal = hits.groupBy(F.col("id").alias("doc_id"), "item_id", "item_tokens", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        tokens(literal).alias("plain"), tokens(F.lit(True)).alias("any"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    one_to_one = F.greatest(F.size(F.array_distinct("pairs.b")), F.size(F.array_distinct("pairs.d"))) >= SLOT_SHARE * F.size("pairs")
    consistent = (F.size("pairs") == 0) | one_to_one & (F.least(F.size(F.array_distinct("pairs.b")), F.size(F.array_distinct("pairs.d"))) >= SLOT_SHARE * F.size("pairs"))
    enough = lambda covered: (covered >= SHARE * F.col("item_tokens")) | (covered >= LONG)
    scored = by_diagonal.withColumn("covered", F.when(enough(F.col("plain")), F.col("plain")).otherwise(F.when(consistent, F.col("any")).otherwise(F.lit(0))))
    held = scored.where(enough(F.col("covered")))
    best = F.max(F.struct(F.col("covered"), (~enough(F.col("plain"))).alias("template"))).alias("best")
    return held.groupBy("doc_id", "item_id", "item_tokens").agg(best).select("doc_id", "item_id", F.col("best.covered").cast("long").alias("covered"), F.col("item_tokens").cast("long").alias("item_tokens"), F.col("best.template").alias("template"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document holds an item of the benchmark."""
    gone = matches(docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
