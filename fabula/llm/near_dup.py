"""MinHash near-duplicates by HyperMinHash.

Each document's distinct word shingles are hashed once; the hash picks one of
M buckets, and a bucket keeps of its smallest remainder only the count of
leading zeros and a few mantissa bits (16 bits in all). Bands of these
compressed registers give candidates, the registers' share of agreement,
corrected for chance collisions, drops the hopeless ones, and the full shingle
sets confirm the rest.

Defined results: null and empty texts, and texts of white space only, have no
shingles and are linked with nothing; a text of fewer words than a shingle is
one shingle; rows with one doc_id count as one document; a row with a null
doc_id is linked with nothing, its component is null and it is kept. Only
``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bands import band_keys, few_filled, first_elements, links, packed
from .common import Scratch, among, as_long, distinct_per_row, mix, shingles, text_bytes, text_chunks, tidied, word_hashes
from .graph import components

M = 128  # buckets
MANTISSA = 10  # bits; 6 more hold the leading zeros
EMPTY = 0xFFFF
BANDS = 32  # of 4 registers; a pair at 0.8 is missed with a chance of 5e-8
#: The estimate's standard error at 0.8 is 0.035 with 128 registers; pairs are dropped six of these below.
MARGIN = 6.0


def registers(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """n_rows x M registers: leading zeros and mantissa of each bucket's least value."""
    out = np.full(n_rows * M, np.iinfo(np.uint64).max, np.uint64)
    h = mix(hashes)
    at = rows * M + (h >> np.uint64(57)).astype(np.int64)
    np.minimum.at(out, at, h & np.uint64((1 << 57) - 1))
    none = out == np.iinfo(np.uint64).max
    _, exponent = np.frexp(np.maximum(out, np.uint64(1)).astype(np.float64))
    exponent = np.clip(exponent, MANTISSA + 1, 57)
    zeros = (57 - exponent).astype(np.uint64)
    mantissa = (out >> (exponent - 1 - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    packed = (np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA)) | mantissa
    packed[none] = EMPTY
    return packed.astype(np.uint16).reshape(n_rows, M)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that two unlike minima have one register: alike leading zeros, and alike mantissas."""
    z = np.arange(40)[:, None]

    def at(n):
        k = np.maximum(n / M, 1.0)
        return (1 - 2.0 ** -(z + 1)) ** k - (1 - 2.0**-z) ** k

    return (at(n_a) * at(n_b)).sum(axis=0) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, its registers) of pairs of register rows."""
    used = (a != EMPTY) | (b != EMPTY)
    count = np.maximum(used.sum(axis=1), 1)
    share = ((a == b) & used).sum(axis=1) / count
    by_chance = chance(n_a, n_b)
    return (share - by_chance) / (1 - by_chance), count


def sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row (uid, doc_id, text): uid, doc_id, shingle count n, s1 and s2, which stand for the set, registers and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("text")):
                k = stop - first
                h, rows = distinct_per_row(*shingles(*word_hashes(data, offs), width))
                n = np.bincount(rows, minlength=k)
                sums = []
                for salt in (1, 2):
                    total = np.r_[np.uint64(0), np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)]
                    ends = np.cumsum(n)
                    sums.append(as_long(total[ends] - total[ends - n]))
                regs = registers(h, rows, k)
                few = few_filled(regs, n, EMPTY, BANDS, percent)
                at, keys = (np.concatenate(x) for x in zip(band_keys(regs, n, EMPTY, BANDS, percent), first_elements(h, rows, few, percent), strict=True))
                order = np.argsort(at, kind="stable")
                cuts = np.r_[0, np.cumsum(np.bincount(at, minlength=k))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(first, k), batch.column("doc_id").slice(first, k), pa.array(n, pa.int64()), *map(pa.array, sums), pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(np.arange(0, (k + 1) * 2 * M, 2 * M, dtype=np.int32)), pa.py_buffer(regs)]), packed(keys[order], cuts)],
                    ["uid", "doc_id", "n", "s1", "s2", "regs", "keys"],
                )

    return docs.mapInArrow(tidied(run), "uid long, doc_id long, n long, s1 long, s2 long, regs binary, keys binary")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), M)


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                guess, used = estimate(_regs(batch.column("ra")), _regs(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                s = percent / 100
                keep = guess >= s - MARGIN * np.sqrt(s * (1 - s) / used)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def shingle_set(text: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's bytes."""
    return np.unique(shingles(*word_hashes(text, np.array([0, len(text)])), width)[0])


def _confirmed(width: int, percent: int):
    """The (u, v) of rows (a, b, ta, tb) whose shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)  # rows come in the order of a
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            (da, oa), (db, ob) = text_bytes(batch.column("ta")), text_bytes(batch.column("tb"))
            keep = np.zeros(len(a), bool)
            for k in range(len(a)):
                if a[k] != last:
                    last, x = a[k], shingle_set(da[oa[k] : oa[k + 1]], width)
                y = shingle_set(db[ob[k] : ob[k + 1]], width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)[keep]) for v in (a, b)], ["u", "v"])

    return run


def _elements(width: int):
    """The shingles of texts, by row."""

    def run(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, _, data, offs in text_chunks(column):
            h, rows = distinct_per_row(*shingles(*word_hashes(data, offs), width))
            yield h, first + rows

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links are 100 * intersection >= percent * union of the distinct
    ``width``-word shingles; component_id is the smallest doc_id reachable.
    What is linked are sets, told apart by a hash of their shingles (sid), so
    that copies are one from the start and rows that share a doc_id are not
    mistaken for each other; uid tells apart rows of unlike id or text."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text")
    made = sketch(texts, width, percent)
    sketches = scratch.save(made.select("uid", "doc_id", "n", F.xxhash64("s1", "s2", "n").alias("sid"), "regs", "keys"), "sketches")
    filled = sketches.where("n > 0 and doc_id is not null")

    def of(sids: DataFrame) -> DataFrame:
        """(sid, n, uid, regs), a row for each set of ``sids``."""
        return among(filled.select("sid", "n", "uid", "regs"), sids, "sid").dropDuplicates(["sid"])

    def text_of(rows: DataFrame) -> DataFrame:
        """(sid, text) of rows (sid, uid)."""
        return among(texts.select("uid", "text"), rows.select("sid", "uid"), "uid").dropDuplicates(["uid"]).select("sid", "text")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs, "pairs")
        rows = scratch.save(of(ends(pairs)), "sets")
        side = lambda s: rows.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
        sized = pairs.join(side("b"), "b").join(side("a"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        likely = scratch.save(sized.mapInArrow(tidied(_near(percent)), "a long, b long"), "likely")
        found = scratch.save(text_of(rows.join(ends(likely), "sid", "left_semi")), "texts")
        for done in (pairs, rows):
            scratch.drop(done)
        both = likely.join(found.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b").join(found.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
        return both.mapInArrow(tidied(_confirmed(width, percent)), "u long, v long")

    def texts_of(ids: DataFrame) -> DataFrame:
        return text_of(of(ids.select(F.col("id").alias("sid")))).select(F.col("sid").alias("id"), "text")

    found = links(filled.select(F.col("sid").alias("id"), "keys"), confirm, texts_of, _elements(width), percent, scratch)
    found = _same_id(filled, found, scratch)
    rows = sketches.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("id"))
    rows = scratch.save(rows.join(found, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("c")), "rows")
    least = scratch.save(rows.where("c is not null and doc_id is not null").groupBy("c").agg(F.min("doc_id").alias("least")), "least")
    scratch.drop(sketches)
    out = rows.join(least, "c", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _same_id(filled: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """``found``, with the sets of rows that share a doc_id united."""
    ids = filled.groupBy("doc_id").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("doc_id", "low")
    if ids.isEmpty():
        return found
    shared = filled.select("doc_id", "sid").join(ids, "doc_id").select(F.col("sid").alias("u"), F.col("low").alias("v"))
    return components(shared.unionAll(found.select(F.col("id").alias("u"), F.col("component").alias("v"))), scratch)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that near_duplicates() doesn't keep; of rows that repeat a kept doc_id all stay."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
