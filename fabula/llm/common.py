"""What the training-data operators share: scratch tables, hash folds and text chunks.

Lineage is cut with tables written below ``spark.checkpoint.dir``, the folder
that a cluster names for the driver and all executors. Only where a session
has no such setting (tests, a laptop) do they go below the warehouse.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a single longer text is its own chunk.
CHUNK_BYTES = 1 << 20

#: Of a 64-bit sort key, the bits that hold a row's number within its chunk.
ROW_BITS = 17


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name for scratch tables, in the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/fabula-{uuid.uuid4().hex}"


class Scratch:
    """Tables written and read again within one operator; all in one folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self._n = spark, scratch_dir(spark), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table, whose plan is one scan."""
        self._n += 1
        path = f"{self.top}/{self._n}-{name}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        return saved

    def drop(self, saved: DataFrame) -> None:
        """Delete a table of ``save`` that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(saved.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, a function for mapInArrow; what it no longer uses goes back to the system at its end, since Spark's workers live on with what their allocators keep."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


#: Bits of the tables that filter rows before a join: 4 MB whatever the data. Where they fill up, more rows reach the join.
FILTER_BITS = 25


def _bitmaps(places: DataFrame) -> DataFrame:
    """(bucket, bits): the places p (1 to 2**FILTER_BITS) as bitmaps of 2**15 bits, 2**10 rows at most."""
    return places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``ids``, which has each ``key`` once; a bit table drops most other rows before the shuffle.

    The table has a 64-bit word for each 64 places, so 2**19 rows at most."""
    near = rows.withColumn("_p", _place(key)).join(F.broadcast(_words(ids, key)), F.shiftright("_p", 6) == F.col("_word"))
    near = near.where(F.getbit("_bits", _bit(F.col("_p"))) == 1).select(*rows.columns)
    return near.join(ids, key)  # a semi-join would be moved below the table


def parted(rows: DataFrame, id: Column, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose long ``id`` may be a ``key`` of ``ids``, all other rows), by such a bit table."""
    place = _place(id)
    marked = rows.join(F.broadcast(_words(ids, key)), F.shiftright(place, 6) == F.col("_word"), "left")
    may = F.coalesce(F.getbit("_bits", _bit(place)) == 1, F.lit(False))
    return marked.where(may).drop("_word", "_bits"), marked.where(~may).drop("_word", "_bits")


def _place(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))


def _bit(place: Column) -> Column:
    return place.bitwiseAND(63).cast("int")


def _words(ids: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): the places of the keys."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(_place(key)))
    return ids.select(F.shiftright(_place(key), 6).alias("_word"), one.alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))


def key_bits(keys: DataFrame, key: str) -> np.ndarray:
    """A bit table of 64-bit hashes by their first FILTER_BITS bits, of fixed size, for ``in_bits``."""
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in _bitmaps(keys.select((F.shiftrightunsigned(key, 64 - FILTER_BITS) + 1).alias("p"))).collect():
        out[(r["bucket"] - 1) << 12 : r["bucket"] << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the table."""
    place = keys >> np.uint64(64 - FILTER_BITS)
    return (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


# --- texts as byte arrays -------------------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offs = text_bytes(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        stop = min(stop, rows, row + (1 << ROW_BITS) - 1)
        yield row, stop, data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


# --- hashing --------------------------------------------------------------------------

_GAMMA = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_STEP_INV = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, from one running sum.

    A span's sum of value * STEP**position is brought to position 0 by the
    inverse power, so equal contents hash alike wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_STEP, len(values)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_STEP_INV, len(values) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_GAMMA))


#: A random 64-bit value for each byte, and the same with A-Z as a-z.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_GAMMA))
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each) of the runs of bytes other than ASCII white space; no run spans two rows."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of each text, lower-cased in A-Z."""
    starts, ends, rows = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    return span_hashes(LOWER_VALUES[data], starts, ends), rows


def fold_hashes(columns: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of the columns' values in order."""
    total = np.full(columns[0].shape, np.uint64((salt * _GAMMA + 0x5851F42D4C957F2D) % (1 << 64)), np.uint64)
    for i, c in enumerate(columns):
        total = (total ^ c) * np.uint64(0xFF51AFD7ED558CCD + 2 * i)
        total ^= total >> np.uint64(32)
    return mix(total)


def shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the runs of ``width`` words of each row; a row of fewer words gives its whole sequence as one."""
    n = len(words)
    if not n:
        return words, rows
    out, at = [], []
    if n >= width:
        inside = rows[: n - width + 1] == rows[width - 1 :]
        out.append(fold_hashes([words[i : n - width + 1 + i][inside] for i in range(width)], width))
        at.append(rows[: n - width + 1][inside])
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    sizes = np.diff(np.r_[first, n])
    for k in range(1, width):
        short = first[sizes == k]
        if len(short):
            out.append(fold_hashes([words[short + i] for i in range(k)], k))
            at.append(rows[short])
    return np.concatenate(out), np.concatenate(at)


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) without repeats, sorted by row and hash; hashes lose their last ROW_BITS bits."""
    bits = ROW_BITS
    keys = np.sort((rows.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return keys << np.uint64(bits), (keys >> np.uint64(64 - bits)).astype(np.int64)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def common_counts(left: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted array ``left`` each of the sets has."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.int64)
    if len(left) and sizes.sum():
        flat = np.concatenate(sets)
        hit = left[np.minimum(np.searchsorted(left, flat), len(left) - 1)] == flat
        ends = np.cumsum(np.r_[0, hit])[np.cumsum(np.r_[0, sizes])]
        out = np.diff(ends)
    return out
