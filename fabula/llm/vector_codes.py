"""Product codes of vectors: each part of a vector becomes the index of its nearest codebook entry.

Exponion search: a part starts at the entry that it had before, at squared
distance U. An entry nearer than that, or as near, lies within twice that
distance of the start, so of the start's list of other entries, sorted by
distance, only those with a squared distance of at most 4 U are looked at.
Distances are exact integers and ties go to the lower index. Between rounds
the codes are a table; sums for each entry are made in each task, then added
by Spark, so what reaches the driver is the codebooks alone, whose size is
fixed by the parameters.

Defined results: rows whose vector is null or holds null, NaN or infinite
components are dropped; vectors of another length than the first kept one's,
or of a length that the parts don't divide, get null codes and errors and no
say in the codebooks; rows of equal id are ordered by their vector. With
fewer kept rows than entries, the codebooks are as long as there are rows. An
empty table gives an empty result. Components of any finite size are exact;
an error beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components below this size are worked on as 64-bit numbers, larger ones as Python's.
SMALL = 1 << 22
#: Bits of the limbs that larger sums are cut into.
LIMB = 40
_LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly (scale is a power of two); int64 where all are small, else Python's integers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    exact = [top * scale // below for top, below in (float(v).as_integer_ratio() for v in values.ravel())]
    return np.array(exact, object).reshape(values.shape)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Codebook:
    """One part's entries, and for each entry the others by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squares(entries[:, None, :], entries[None, :, :])
        self.near = np.argsort(between, axis=1, kind="stable")
        self.distance = np.take_along_axis(between, self.near, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row of x, from ``start`` on."""
        at = start.copy()
        radius = squares(x, self.entries[start])
        best = radius.copy()
        rows = np.arange(len(x))
        for j in range(len(self.entries)):  # the j-th neighbour of each start that is still within reach
            rows = rows[self.distance[start[rows], j] <= 4 * radius[rows]]
            if not len(rows):
                break
            other = self.near[start[rows], j]
            d = squares(x[rows], self.entries[other])
            better = (d < best[rows]) | ((d == best[rows]) & (other < at[rows]))
            at[rows[better]], best[rows[better]] = other[better], d[better]
        return at, best


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have ``size`` components, their components)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    fit = lengths == size
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return fit, flat[np.repeat(fit, lengths)].reshape(-1, size)


def _codes(column: pa.Array, count: int, parts: int) -> np.ndarray:
    """Earlier codes as indexes, one row a vector; zeros where there are none."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(x or b"\0" * (2 * parts) for x in raw), ">u2").reshape(count, parts).astype(np.int64)


def _assign(books: list[np.ndarray], size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (vec_id, label, vector, code) to (vec_id, label, vector, code, error) by the codebooks' nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            fit, values = _vectors(batch.column("vector"), size)
            before = _codes(batch.column("code"), batch.num_rows, len(books))[fit]
            x = whole_numbers(values, scale).reshape(len(values), len(books), -1)
            found = [s.nearest(x[:, k], before[:, k]) for k, s in enumerate(search)]
            code = np.stack([f[0] for f in found], axis=1).astype(">u2")
            error = sum(f[1] for f in found)
            codes, errors, where = [None] * batch.num_rows, [None] * batch.num_rows, np.flatnonzero(fit)
            for i, c, e in zip(where.tolist(), code, error.tolist(), strict=True):
                codes[i], errors[i] = c.tobytes(), e if e < _LONG else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], ["vec_id", "label", "vector", "code", "error"])

    return run


def limbs(value: int) -> list[int]:
    """Numbers below 2**LIMB, lowest first and the last with the sign, whose sums are the value's sums."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(count: int, parts: int, size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (vector, code) to one task's (part, entry, place, limb, value); place -1 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = size // parts
        total = np.zeros((parts, count, width), object)
        number = np.zeros((parts, count), np.int64)
        for batch in batches:
            fit, values = _vectors(batch.column("vector"), size)
            x = whole_numbers(values, scale).reshape(len(values), parts, width)
            code = _codes(batch.column("code"), batch.num_rows, parts)[fit]
            for k in range(parts):
                number[k] += np.bincount(code[:, k], minlength=count)
                part = np.zeros((count, width), x.dtype)
                np.add.at(part, code[:, k], x[:, k])
                total[k] += part
        used = [(int(k), int(e)) for k, e in zip(*np.nonzero(number), strict=True)]
        rows = [(k, e, -1, 0, int(number[k, e])) for k, e in used]
        rows += [(k, e, i, at, v) for k, e in used for i in range(width) for at, v in enumerate(limbs(int(total[k, e, i])))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "limb", "value"])

    return run


def _moved(books: list[np.ndarray], coded: DataFrame, size: int, scale: int) -> list[np.ndarray]:
    """The codebooks with each used entry at the floor of its parts' mean."""
    parts = len(books)
    total: dict[tuple[int, int, int], int] = {}
    added = coded.where("code IS NOT NULL").select("vector", "code").mapInArrow(_sums(len(books[0]), parts, size, scale), "part long, entry long, place long, limb long, value long")
    for r in added.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():  # codebooks' size
        key = r["part"], r["entry"], r["place"]
        total[key] = total.get(key, 0) + (r["value"] << LIMB * r["limb"])
    out = []
    for k, book in enumerate(books):
        rows = [[total[k, e, i] // total[k, e, -1] for i in range(book.shape[1])] if (k, e, -1) in total else [int(v) for v in book[e]] for e in range(len(book))]
        out.append(_array(rows))
    return out


def _array(rows: list[list[int]]) -> np.ndarray:
    """Entries as 64-bit numbers where they are small, else as Python's."""
    small = all(abs(v) <= SMALL for r in rows for v in r)
    return np.array(rows, np.int64 if small else object)


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, vector, code, error) of the usable rows of (vec_id, label, vector), and each part's codebook.

    A code is two bytes for each part, the entry's index."""
    scratch = Scratch(vectors.sparkSession)
    kept = vectors.where(usable(F.col("vector"))).select("vec_id", "label", "vector")
    first = kept.where(F.size("vector") > 0).orderBy("vec_id", "vector").limit(entries).select("vector").collect()  # entries rows at most
    size = len(first[0]["vector"]) if first else 0
    if not size or size % parts:
        return kept.select("vec_id", "label", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), []
    start = kept.where(F.size("vector") == size).orderBy("vec_id", "vector").limit(entries).select("vector").collect()
    values = whole_numbers(np.array([r["vector"] for r in start], np.float64), scale).reshape(len(start), parts, -1)
    books = [_array([[int(v) for v in row] for row in values[:, k]]) for k in range(parts)]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields) + ", code binary, error long"
    coded = kept.withColumn("code", F.lit(None).cast("binary"))
    for n in range(rounds + 1):
        found = scratch.save(coded.select("vec_id", "label", "vector", "code").mapInArrow(_assign(books, size, scale), kind), f"codes{n}")
        if n:
            scratch.drop(coded)
        coded = found
        if n < rounds:
            books = _moved(books, coded, size, scale)
    return coded, books


def digests(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes as two hex digits a part, and each label's errors summed, nulls together."""
    at = lambda i: F.lower(F.hex(F.substring("code", 2 * i + 2, 1)))
    code = F.concat(*(at(i) for i in range(max(1, len(books)))))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
