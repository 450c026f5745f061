"""Line deduplication: fuzzy lines by MinHash, one line kept of each component.

Texts are split at line feeds. A line's set is its distinct WIDTH-character
shingles (A-Z lower-cased). One hash of each shingle picks a bucket, whose
least value is the signature's register there; bands of registers give
candidates, full shingle sets confirm those with a Jaccard similarity of
``percent`` or more, and union-find over the links keeps the first line of
each component (by doc_id, then by line). Equal lines are one set from the
start.

Defined results: lines of fewer than ``min_words`` words are always kept; so
are all lines of rows with a null doc_id. Null and empty texts stay as they
are, with 0 lines for null. Rows that repeat a doc_id are read as further
copies at the same place: a line of such rows is dropped in both or in none.
``deduplicate`` keeps all columns; names that clash with its own are not
touched, since joined columns have names of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bands import band_keys, few_filled, first_elements, links, packed
from .common import ROW_BITS, SPACE, Scratch, among, as_long, common_counts, mix, parted, span_hashes, text_bytes, text_chunks, tidied

WIDTH = 8  # characters of a shingle
M = 48  # buckets
BANDS = 12  # of 4 registers; a pair at 0.8 is missed with a chance of 0.002, at 0.9 of 0.00001
MIN_WORDS = 5
#: Of keys with so many lines at most, all pairs of different components are compared: a pair costs less than a line's first elements.
BLOCK = 22
#: Pairs of lines that are confirmed at once.
PAIRS = 2048
#: Lines whose signatures one sort makes.
MOST_ROWS = (1 << ROW_BITS) - 1
EMPTY = np.uint64((1 << 41) - 1)
#: Bytes of text that one step works on, so few that its arrays stay in a core's cache.
STEP_BYTES = 1 << 17
#: Lines that a task remembers, so as to make the keys of a repeated line once.
MET = 1 << 18
_STEP = 0xA0761D6478BD642F


#: A random 64-bit value for each code point below 65536, A-Z as a-z; those above are hashed where they stand.
_BMP = 1 << 16


def _value(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


_LOW = np.arange(_BMP)
_LOW[65:91] += 32
_VALUES = _value(_LOW)


def _points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


class Lines:
    """The lines of a chunk of texts that have ``min_words`` words or more."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, min_words: int):
        self.bytes = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # where each code point begins
        self.points, offs = _points(data), np.searchsorted(self.bytes, offs)
        n = len(self.points)
        feed = self.points == 10
        inner = offs[1:-1]
        breaks = np.flatnonzero(feed)
        starts = np.unique(np.r_[offs[:-1], breaks + 1])
        starts = starts[starts < n] if n else starts[:0]
        ends = np.r_[starts[1:], n][: len(starts)]
        ends = np.where(feed[np.maximum(ends - 1, 0)] & (ends > starts), ends - 1, ends) if n else ends
        rows = np.searchsorted(offs, starts, "right") - 1
        space = np.take(SPACE, self.points, mode="clip")
        begins = ~space
        begins[1:] &= space[:-1]
        if n:
            edge = inner[inner < n]
            begins[edge] = ~space[edge]
        words = np.flatnonzero(begins)
        keep = np.searchsorted(words, ends) - np.searchsorted(words, starts) >= min_words
        self.number = (np.searchsorted(breaks, starts) - np.searchsorted(breaks, offs[rows]))[keep]
        self.starts, self.ends, self.rows = starts[keep], ends[keep], rows[keep]
        self.values = np.take(_VALUES, self.points, mode="clip")
        high = np.flatnonzero(self.points >= _BMP)
        self.values[high] = _value(self.points[high])
        self.data = data

    def texts(self, which: np.ndarray) -> pa.Array:
        """The lines of ``which`` as they stand."""
        a, b = self.bytes[self.starts[which]], self.bytes[self.ends[which]]
        cuts = np.r_[0, np.cumsum(b - a)]
        flat = self.data[np.arange(cuts[-1]) + np.repeat(a - cuts[:-1], b - a)]
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(cuts), pa.py_buffer(flat)]).cast(pa.string())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.values, self.starts, self.ends)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into ``which``) of all shingles of those lines; a shorter line is one."""
        v, starts, size = self.values, self.starts[which], self.ends[which] - self.starts[which]
        h, k = v, 1
        while k < WIDTH and len(h) > k:  # of the runs of k characters, those of twice as many
            h = h[:-k] * np.uint64(pow(_STEP, k, 1 << 64)) + h[k:]
            k *= 2
        count = np.maximum(size - WIDTH + 1, 1)
        owner = np.repeat(np.arange(len(which)), count)
        at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(count) - count), count)
        out = h[np.minimum(at, len(h) - 1)] if len(h) else np.zeros(len(at), np.uint64)
        short = np.flatnonzero(size < WIDTH)
        if len(short):
            out[(np.cumsum(count) - count)[short]] = span_hashes(v, starts[short], self.ends[which][short])
        out ^= out >> np.uint64(32)
        return out, owner


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(registers of n x M, distinct shingles of each), from one sort: buckets are ranges of hashes, and a register holds the last bits of its least hash."""
    keys = owner.astype(np.uint64)
    keys <<= np.uint64(64 - ROW_BITS)
    keys |= hashes >> np.uint64(ROW_BITS)
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    size = np.bincount((keys[new] >> np.uint64(64 - ROW_BITS)).astype(np.int64), minlength=n)
    slot = keys >> np.uint64(23)  # line and 24 bits, so that one product gives line * M + bucket
    slot *= np.uint64(M)
    slot >>= np.uint64(24)
    np.not_equal(slot[1:], slot[:-1], out=new[1:])
    first = np.flatnonzero(new)
    regs = np.full(n * M, EMPTY, np.uint64)
    regs[slot[first].astype(np.int64)] = keys[first] & EMPTY
    return regs.reshape(n, M), size


def _lines(min_words: int, percent: int):
    """Rows (h, doc_id, line, n, keys, text); the last three only where a task meets a line the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.arange(MET, dtype=np.uint64) ^ np.uint64(1)  # at a hash's last bits, the last line that had these; at first none
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("text"), STEP_BYTES):
                lines = Lines(data, offs, min_words)
                h = lines.hashes()
                if not len(h):
                    continue
                fresh, where = np.unique(h, return_index=True)
                slots = (fresh & np.uint64(MET - 1)).astype(np.int64)
                where = where[met[slots] != fresh]
                met[slots] = fresh
                n, keys = np.zeros(len(h), np.int64), [np.zeros(0, np.uint64)]
                at = [np.zeros(0, np.int64)]
                for i in range(0, len(where), MOST_ROWS):  # one long text can hold more lines than a sort key can number
                    some = where[i : i + MOST_ROWS]
                    hashes, owner = lines.shingles(some)
                    regs, n[some] = signatures(hashes, owner, len(some))
                    few = few_filled(regs, n[some], EMPTY, BANDS, percent)
                    for r, k in (band_keys(regs, n[some], EMPTY, BANDS, percent), first_elements(hashes, owner, few, percent)):
                        at.append(some[r])
                        keys.append(k)
                at, keys = np.concatenate(at), np.concatenate(keys)
                order = np.argsort(at, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(at, minlength=len(h)))]
                ids = batch.column("id").slice(first, stop - first).to_numpy(zero_copy_only=False)
                places = np.full(len(h), -1)
                places[where] = np.arange(len(where))
                text = lines.texts(where).take(pa.array(places, mask=places < 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(h)), pa.array(ids[lines.rows].astype(np.int64)), pa.array(lines.number.astype(np.int32)), pa.array(n.astype(np.int32)), packed(keys[order], ends), text],
                    ["h", "doc_id", "line", "n", "keys", "text"],
                )

    return run


def line_set(data: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one line's bytes."""
    lines = Lines(data, np.array([0, len(data)]), 0)
    return np.unique(lines.shingles(np.arange(len(lines.starts)))[0])


def _sets(column: pa.Array) -> list[np.ndarray]:
    data, offs = text_bytes(column)
    lines = Lines(data, offs, 0)
    h, owner = lines.shingles(np.arange(len(lines.starts)))
    keys = np.sort((owner.astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (h >> np.uint64(ROW_BITS)))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    h, owner = keys << np.uint64(ROW_BITS), (keys >> np.uint64(64 - ROW_BITS)).astype(np.int64)
    cuts = np.searchsorted(owner, np.arange(len(lines.starts) + 1))
    by_row = {int(r): h[cuts[i] : cuts[i + 1]] for i, r in enumerate(lines.rows)}
    return [by_row.get(i, h[:0]) for i in range(len(column))]


def _confirmed(percent: int):
    """The (u, v) of rows (a, b, ta, tb) whose shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(k, PAIRS)
                (first, one), (second, other) = (np.unique(batch.column(c).to_numpy(), return_index=True, return_inverse=True)[1:] for c in "ab")
                left, right = _sets(batch.column("ta").take(pa.array(first))), _sets(batch.column("tb").take(pa.array(second)))
                keep = np.zeros(batch.num_rows, bool)
                order = np.argsort(one, kind="stable")
                cuts = np.searchsorted(one[order], np.arange(len(left) + 1))
                for i, x in enumerate(left):  # each line with all its partners at once
                    rows = order[cuts[i] : cuts[i + 1]]
                    sets = [right[j] for j in other[rows].tolist()]
                    both, n = common_counts(x, sets), np.array([len(y) for y in sets])
                    keep[rows] = 100 * both >= percent * (len(x) + n - both)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["u", "v"])

    return run


def _elements(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of lines, by row."""
    for k in range(0, len(column), 512):
        sets = _sets(column.slice(k, 512))
        yield np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(k, k + len(sets)), [len(s) for s in sets])


def repeated_lines(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines): of each document the numbers, from 0, of the lines that are not kept."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    found = scratch.save(texts.mapInArrow(tidied(_lines(min_words, percent)), "h long, doc_id long, line int, n int, keys binary, text string"), "lines")
    lines = scratch.save(found.select("h", "doc_id", "line"), "places")
    fresh = found.where("text is not null")

    texts_met: DataFrame
    steps = 0

    def ready(ids: DataFrame) -> None:
        """Keeps (h, n, text), a row for each line that shares a key; the texts of the others are deleted."""
        nonlocal texts_met
        texts_met = scratch.save(among(fresh.select("h", "n", "text"), ids.select(F.col("id").alias("h")), "h").dropDuplicates(["h"]), "member-texts")
        scratch.drop(found)

    def text_of(hs: DataFrame) -> DataFrame:
        """(h, n, text), a row for each line of ``hs``."""
        return among(texts_met, hs, "h")

    def confirm(pairs: DataFrame) -> DataFrame:
        nonlocal steps
        steps += 1
        wanted = texts_met
        if steps > 1:  # the first candidates are of all lines that share a key
            pairs = scratch.save(pairs, "pairs")
            ends = pairs.select(F.col("a").alias("h")).unionAll(pairs.select(F.col("b").alias("h"))).distinct()
            wanted = scratch.save(text_of(ends), "texts")
        side = lambda s: wanted.select(F.col("h").alias(s), F.col("n").alias(f"n{s}"), F.col("text").alias(f"t{s}"))
        both = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return both.select("a", "b", "ta", "tb").mapInArrow(tidied(_confirmed(percent)), "u long, v long")

    def texts_of(ids: DataFrame) -> DataFrame:
        return text_of(ids.select(F.col("id").alias("h"))).select(F.col("h").alias("id"), "text")

    linked = links(fresh.select(F.col("h").alias("id"), "keys"), confirm, texts_of, _elements, percent, scratch, ready, BLOCK)
    first = lines.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    known = first.join(linked.select(F.col("id").alias("h"), "component"), "h", "left").where("copies > 1 or component is not null")
    known = scratch.save(known.select("h", "first", F.coalesce("component", "h").alias("c")), "repeated")
    keeper = scratch.save(known.groupBy("c").agg(F.min("first").alias("keeper")), "keepers")
    known = scratch.save(known.join(keeper, "c").select("h", "c", "keeper"), "kept-places")
    places = among(lines, known, "h").repartition("doc_id").withColumn("first", F.min("line").over(Window.partitionBy("doc_id", "c")))
    gone = places.where("doc_id <> keeper or line <> first")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def deduplicate(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and _lines, _removed: each row's count of lines and of dropped ones."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.save(repeated_lines(docs, percent, min_words).select(F.col("doc_id").alias("_id"), F.col("lines").alias("_gone")), "gone")
    near, far = parted(docs, docs["doc_id"].cast("long"), gone, "_id")
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))
    parts = F.split("text", "\n", -1)
    joined = near.join(gone.hint("shuffle_hash"), near["doc_id"] == F.col("_id"), "left")
    removed = F.when(F.col("text").isNull() | F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
    # within a lambda the text is cut once, not once for each line
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(numbers, lambda i: F.get(p, i)), "\n"))[0]
    text = F.when(removed == 0, F.col("text")).otherwise(kept)
    cut = joined.withColumns({"_lines": size.cast("long"), "_removed": removed.cast("long")}).withColumn("text", text).drop("_id", "_gone")
    return cut.unionAll(far.withColumns({"_lines": size.cast("long"), "_removed": F.lit(0).cast("long")}))
