"""Candidate pairs from banded signatures, and the links that an exact check confirms.

Signatures are ``m`` bucket registers of a set (a min-hash per bucket, or
"empty"). A band is a run of registers; two sets are candidates where a whole
band agrees. How many bands a set gets depends on its size: a set of few
elements differs from a partner in fewer elements than it has bands, so that
some band must agree; a large set gets the most bands. The band that agrees may
hold no element and give no key: small sets whose filled bands are so few that
all of them could differ get their first elements in hash order as keys too
(prefix filter), so that no link of small sets can be missed.

Candidates are made in steps, each followed by a union, after which only keys
and elements go on that still hold several components:

1. each set of a key with the key's head, the one that shares keys with most
   others, which in a group of near copies is one of the least changed and the
   same for most keys (in proportion to the rows);
2. all pairs of different components in keys of ``block`` sets at most; sets of
   larger keys are matched by their first elements instead (prefix filter), in
   an order that puts elements of many sets last. Of those, only elements that
   sets of several components have count, as a link that is still missing joins
   two components. Each set is compared with the element's set that has the
   fewest first elements for itself;
3. all pairs of different components with a common first element whose places
   leave the similarity possible.

So a passage that very many sets share, or a large group of near copies, is not
compared pair by pair, and no pair of different components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_long, fold_hashes, in_bits, key_bits, tidied
from .graph import components

#: Of keys with so many sets at most, all pairs of different components are compared, unless an operator sets another bound.
BLOCK = 8
#: Elements that a task meets so often are frequent; so many of them, the most frequent, are told to all tasks. They only order elements.
OFTEN = 3
FREQUENT = 100_000
#: Keys that a task sorts at once.
GATHERED = 1 << 21
Elements = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]


def levels(m: int, most: int, percent: int) -> list[tuple[int, float]]:
    """(bands, largest set size) from few bands to ``most``; m is a multiple of each count.

    Two sets of at most b elements with a Jaccard similarity s differ in at
    most 2b(1-s)/(1+s) elements; fewer than the bands, so one band is spared."""
    out, n, s = [], 1, percent / 100
    while n < most:
        out.append((n, (n - 1e-9) * (1 + s) / (2 * (1 - s))))
        n *= 2
    return [*out, (most, np.inf)]


def band_keys(registers: np.ndarray, sizes: np.ndarray, empty: int, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bands of each row's registers.

    A partner can be larger by 100/percent, so a set also gets the bands of
    that size where those differ. Bands without any element give no key."""
    rows_out, keys_out = [], []
    steps = levels(registers.shape[1], most, percent)
    tops = np.array([top for _, top in steps])
    own = np.searchsorted(tops, sizes)
    more = np.searchsorted(tops, np.floor(sizes * 100 / percent))
    for k, (n, _) in enumerate(steps):
        rows = np.flatnonzero(((own == k) | (more == k)) & (sizes > 0))
        if not len(rows):
            continue
        bands = registers[rows].reshape(len(rows), n, -1)
        some = (bands != empty).any(axis=2)
        keys = fold_hashes([bands[:, :, i].astype(np.uint64) for i in range(bands.shape[2])], n)
        keys = fold_hashes([keys, np.broadcast_to(np.arange(n, dtype=np.uint64), keys.shape)], k) if n > 1 else keys
        r, b = np.nonzero(some)
        rows_out.append(rows[r])
        keys_out.append(keys[r, b])
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows_out), np.concatenate(keys_out)


def few_filled(registers: np.ndarray, sizes: np.ndarray, empty: int, most: int, percent: int) -> np.ndarray:
    """Which rows might differ from a partner in all their filled bands, at a level that promises a band that agrees."""
    out = np.zeros(len(sizes), bool)
    steps = levels(registers.shape[1], most, percent)
    tops = np.array([top for _, top in steps])
    larger = np.floor(sizes * 100 / percent)
    own, more = np.searchsorted(tops, sizes), np.searchsorted(tops, larger)
    for k, (n, top) in enumerate(steps[:-1]):
        rows = np.flatnonzero(((own == k) | (more == k)) & (sizes > 0))
        filled = (registers[rows].reshape(len(rows), n, registers.shape[1] // n) != empty).any(axis=2).sum(axis=1)
        differ = (sizes[rows] + np.minimum(larger[rows], np.floor(top))) * (100 - percent) // (100 + percent)
        out[rows] |= filled <= differ
    return out


def first_elements(hashes: np.ndarray, rows: np.ndarray, which: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the first n(1-s)+1 elements of each row in ``which`` (a mask); two sets of the similarity share one."""
    some = which[rows]
    hashes, rows = hashes[some], rows[some]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if len(rows):
        once = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]
        hashes, rows = hashes[once], rows[once]
    n = np.bincount(rows, minlength=len(which))
    place = np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
    keep = 100 * place <= (100 - percent) * n[rows]
    return rows[keep], fold_hashes([hashes[keep]], 64)


#: Bytes that are kept of a key. What they don't tell apart gives more candidates, no links.
KEY_BYTES = 5


def packed(keys: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: of each row's keys, keys[ends[i]:ends[i + 1]], the first KEY_BYTES bytes."""
    data = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * KEY_BYTES).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, their count in each row) of a column of ``packed``; the bytes that were not kept are 0."""
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, offs = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].reshape(-1, KEY_BYTES) if data is not None else np.zeros((0, KEY_BYTES), np.uint8)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :KEY_BYTES] = raw
    return out.reshape(-1).view(">u8").astype(np.uint64), np.diff(offs) // KEY_BYTES


def _gathered(batches: Iterator[pa.RecordBatch], most: int = GATHERED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, their ids) of runs of rows (id, keys) of about ``most`` keys."""
    keys, ids, size = [], [], 0
    for batch in batches:
        k, count = _unpacked(batch.column("keys"))
        keys.append(k)
        ids.append(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), count))
        size += len(k)
        if size >= most:
            yield np.concatenate(keys), np.concatenate(ids)
            keys, ids, size = [], [], 0
    if size:
        yield np.concatenate(keys), np.concatenate(ids)


def _ends(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, least id, greatest id) of each key, in the order of keys."""
    if len(keys) < 1 << 24:  # the place takes the bytes that are 0
        keys = np.sort(keys | np.arange(len(keys), dtype=np.uint64))
        order = (keys & np.uint64(0xFFFFFF)).astype(np.int64)
        keys &= np.uint64(0xFFFFFFFFFF000000)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)


def _dealt(buckets: int):
    """Rows (bucket, rest): of each key at most two ids of each run, the least and the greatest.

    ``buckets`` is a multiple of 256, so a bucket fixes a key's first byte; of
    each pair ``rest`` holds the key's other four and 32 bits of a hash of both,
    by which two ids are told apart in each key anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _gathered(batches):
            key, low, high = _ends(keys, ids)
            two = low != high
            rows = np.repeat(np.arange(len(key)), 1 + two)
            out = low[rows]
            out[(np.cumsum(1 + two) - 1)[two]] = high[two]
            bucket = ((key[rows] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)  # keys are in order, so buckets are too
            rest = (key[rows] << np.uint64(8)) & np.uint64(0xFFFFFFFF00000000)
            rest |= fold_hashes([key[rows], out.view(np.uint64)]) >> np.uint64(32)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = 8 * np.r_[cuts, len(bucket)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(rest)])], ["bucket", "rest"])

    return run


def _shared(buckets: int):
    """(key): the keys of several ids; rows come in the order of buckets, of which one is held at a time."""

    def of(bucket: int, rest: list[bytes]) -> pa.RecordBatch:
        x = np.sort(np.frombuffer(b"".join(rest), np.uint64))
        again = (x[1:] >> np.uint64(32) == x[:-1] >> np.uint64(32)) & (x[1:] != x[:-1])
        key = np.unique(x[1:][again] >> np.uint64(32)) << np.uint64(24)
        return pa.RecordBatch.from_arrays([pa.array(as_long(key | np.uint64((bucket * 256 // buckets) << 56)))], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest = None, []
        for batch in batches:
            for bucket, x in zip(batch.column("bucket").to_pylist(), batch.column("rest"), strict=True):
                if bucket != now and rest:
                    yield of(now, rest)
                    rest = []
                now = bucket
                rest.append(x.as_py())
        if rest:
            yield of(now, rest)

    return run


def members_of(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows (key, id) of the keys that several ids have, (key, head)); head is the one of those that has most such keys.

    Keys are dealt out in runs, with two ids of each at most from each run, so
    that a key that very many sets have is small before the shuffle. Sets with a
    shared key are found by a bit table of fixed size and then joined."""
    spark = keyed.sparkSession
    buckets = 256 * -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // 256)
    dealt = keyed.mapInArrow(tidied(_dealt(buckets)), "bucket int, rest binary")
    shared = scratch.save(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_shared(buckets)), "key long"), "shared-keys")
    bits = spark.sparkContext.broadcast(key_bits(shared, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _gathered(batches):
            some = in_bits(bits.value, keys)
            pairs = np.unique(np.stack([ids[some], as_long(keys[some])], axis=1), axis=0)
            _, back, n = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 1])), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(n[back.ravel()].astype(np.int64))], ["key", "id", "n"])

    rows = scratch.save(keyed.mapInArrow(tidied(run), "key long, id long, n long").groupBy("key", "id").agg(F.max("n").alias("n")).join(shared, "key"), "members")
    weight = F.expr("n * 4294967296 + (xxhash64(id) & 4294967295)")
    heads = scratch.save(rows.groupBy("key").agg(F.max_by("id", weight).alias("head")), "heads")
    scratch.drop(shared)
    return rows.select("key", "id"), heads


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component c of each id."""
    return rows.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _several(rows: DataFrame, key: str) -> DataFrame:
    """(key, sets) of the keys with rows of several components."""
    return rows.groupBy(key).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("sets")).where("low < high").select(key, "sets")


def _blocks(labelled: DataFrame, split: DataFrame, block: int) -> DataFrame:
    """Pairs of different components in small keys; of two sets one is the head and was compared."""
    few = labelled.join(split.where(f"sets between 3 and {block}"), "key")
    lists = few.groupBy("key").agg(F.collect_list(F.struct("id", "c")).alias("m"))
    pairs = lists.selectExpr("inline(flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.id as a, x.c as ca, y.id as b, y.c as cb)))))")
    return pairs.where("ca <> cb").select("a", "b")


def _frequent(elements: Elements):
    """(x, f): the elements that a run of texts has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, f = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in elements(batch.column("text")))]), return_counts=True)
            x, f = x[f >= OFTEN], f[f >= OFTEN]
            yield pa.RecordBatch.from_arrays([pa.array(as_long(x)), pa.array(f.astype(np.int64))], ["x", "f"])

    return run


def _first_rare(elements: Elements, often: np.ndarray, times: np.ndarray, percent: int):
    """(x, id, n, i, c): of each text (id, text, c) the first n(1-s)+1 of its n elements, the least frequent first; i is the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, c = batch.column("id").to_numpy(), batch.column("c").to_numpy()
            for h, rows in elements(batch.column("text")):
                f = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    f = np.where(often[at] == h, times[at], 0)
                order = np.lexsort((h, f, rows))
                h, rows = h[order], rows[order]
                n = np.bincount(rows, minlength=0)
                i = np.arange(len(h)) - (np.cumsum(n) - n)[rows] + 1
                keep = 100 * (n[rows] - i + 1) >= percent * n[rows]
                h, rows, i = h[keep], rows[keep], i[keep]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(ids[rows]), pa.array(n[rows].astype(np.int64)), pa.array(i.astype(np.int32)), pa.array(c[rows])], ["x", "id", "n", "i", "c"])

    return run


def _rare_elements(texts: DataFrame, elements: Elements, percent: int, scratch: Scratch) -> DataFrame:
    """(x, id, n, i, gap, c): the first elements of each text that texts of several components have among theirs.

    Two sets of the similarity share one of the first n(1-s)+1 elements of each,
    whatever the order, as long as it is one for all. gap: how many first elements
    a text has that no other component has among its own."""
    counted = texts.select("text").mapInArrow(tidied(_frequent(elements)), "x long, f long").groupBy("x").agg(F.sum("f").alias("f"))
    most = counted.orderBy(F.desc("f"), "x").limit(FREQUENT).toArrow()
    often = most.column("x").to_numpy().view(np.uint64)
    order = np.argsort(often)
    rows = texts.mapInArrow(tidied(_first_rare(elements, often[order], most.column("f").to_numpy()[order], percent)), "x long, id long, n long, i int, c long")
    rows = scratch.save(rows, "first-elements")
    held = scratch.save(_several(rows, "x").select("x"), "open-elements")
    gap = F.floor((100 - percent) * F.col("n") / 100) + 1 - F.count("*").over(Window.partitionBy("id"))
    found = scratch.save(rows.join(held, "x").select("x", "id", "n", "i", gap.cast("long").alias("gap"), "c"), "rare-elements")
    scratch.drop(rows)
    scratch.drop(held)
    return found


def _possible(percent: int, common: str) -> str:
    """Whether so many common elements are enough for the similarity."""
    return f"{100 + percent} * {common} >= {percent} * (n_a + n_b)"


def _hubs(keys: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of each element, each set with the one that has the least gap, unless gaps make a link unlikely."""
    gap = F.expr("gap * 4294967296 + (xxhash64(id) & 4294967295)")
    hub = scratch.save(keys.groupBy("x").agg(*(F.min_by(v, gap).alias(f"{v}_b") for v in ("id", "n", "gap", "c"))), "hubs")
    pairs = keys.join(hub, "x").where("c <> c_b").withColumnsRenamed({"n": "n_a", "gap": "gap_a"})
    return pairs.where(_possible(percent, "least(n_a - gap_a, n_b - gap_b)")).select(F.col("id").alias("a"), F.col("id_b").alias("b"))


def _all(keys: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that share an element, and have after it as many as the similarity asks for.

    The bound holds at a pair's first common element, so no link is missed. A
    pair is left out where an element of the two before is common too: it stands
    there. Of the smaller set's elements the first n(1-s)/(1+s)+1 are enough."""
    a, b = (keys.select("x", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "i", "c", "p", "o"))) for s in "ab")
    b = b.where(f"{100 + percent} * (i_b - 1) <= {100 - percent} * n_b")
    fits = f"c_a <> c_b and (n_a > n_b or (n_a = n_b and id_a <> id_b)) and {_possible(percent, '(1 + least(n_a - i_a, n_b - i_b))')}"
    again = "coalesce(p_a = p_b, false) or coalesce(p_a = o_b, false) or coalesce(o_a = p_b, false) or coalesce(o_a = o_b, false)"
    pairs = a.join(b, "x").where(f"{fits} and not ({again})")
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _joined(found: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The components of ``found`` (which is deleted) and of further edges; only whole components are united."""
    for end in "uv":
        edges = edges.join(found.select(F.col("id").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    new = components(scratch.save(edges.distinct(), "component-edges"), scratch)
    old = found.join(new.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    whole = scratch.save(old.unionAll(new.join(found, "id", "left_anti")), "components")
    scratch.drop(found)
    return whole


def links(keyed: DataFrame, confirm: Callable[[DataFrame], DataFrame], texts_of: Callable[[DataFrame], DataFrame], elements: Elements, percent: int, scratch: Scratch, ready: Callable[[DataFrame], None] | None = None, block: int = BLOCK) -> DataFrame:
    """(id, component) of all ids that some confirmed link joins to another.

    keyed: (id, keys), keys as ``packed``, rows may repeat; confirm: distinct (a, b) candidates to
    the true links among them, as (u, v); texts_of: (id) to (id, text), a row
    for each; elements: a column of texts to (elements, row of each) without
    repeats, in parts; ready: called once, with all ids (id) that candidates
    will be made of, after which ``keyed`` is not read again."""
    members, heads = members_of(keyed, scratch)
    if ready:
        ready(members.select("id").distinct())
    found: DataFrame | None = None

    def unite(pairs: DataFrame) -> None:
        nonlocal found
        edges = scratch.save(confirm(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "links")
        if found is None:
            found = components(edges, scratch)
        elif not edges.isEmpty():
            found = _joined(found, edges, scratch)
        scratch.drop(edges)

    unite(members.join(heads, "key").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")))
    labelled = scratch.save(_labelled(members, found), "labelled")
    split = scratch.save(_several(labelled, "key"), "split")
    left = scratch.save(labelled.join(split.where(f"sets > {block}").select("key"), "key", "left_semi").select("id", "c").distinct(), "left")
    scratch.drop(heads)
    if left.isEmpty():
        unite(_blocks(labelled, split, block))
        return found
    texts = scratch.save(texts_of(left.select("id")).join(left, "id").select("id", "text", "c"), "texts")
    keys = _rare_elements(texts, elements, percent, scratch)
    scratch.drop(texts)
    unite(_blocks(labelled, split, block).unionAll(_hubs(keys, percent, scratch)))
    for done in (labelled, split, left):
        scratch.drop(done)
    w = Window.partitionBy("id").orderBy("i")
    now = scratch.save(_labelled(keys.drop("c", "gap"), found).withColumns({"p": F.lag("x", 1).over(w), "o": F.lag("x", 2).over(w)}), "rare-elements")
    scratch.drop(keys)
    unite(_all(now, percent))
    scratch.drop(now)
    return found
