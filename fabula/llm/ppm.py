"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts: a word's bytes, the blank after it and
the text's end after the last blank are predicted from up to ORDER bytes
before them, TAIL of them before the last blank. At each byte the longest
known context predicts; with c the byte's count and T all of the context's, a
byte has (c - 1/2) / T and the rest of T is the chance to escape to the next
shorter context (method D), where the bytes that the longer one knows are
excluded from the total. Below order 0 all bytes left are alike.

Only a word's first HEAD symbols look across the blank, and they depend on the
word's head: these symbols and TAIL bytes before the blank, eight bytes in all.
So each chunk of text is counted by its distinct heads, and the rest of a word
once for each distinct word of the corpus. Counts of all branches, of which
none is dropped, and the (context, symbol) pairs that are asked for are summed
within a task, packed by shard and shuffled once. Contexts of ROOT bytes or more
that end alike are one shard, of which a task holds one at a time, and whose
distinct pairs have a bound that doesn't depend on the data: a chance and all
its escapes lie in one shard and in the shorter contexts, which all tasks hold (their number has a bound that
doesn't depend on the data). So each distinct pair is scored exactly once, in
its shard. The CACHED pairs that are asked most are shared with all tasks and
summed where texts are read, as are words with a share of FREQUENT_SHARE of all
tokens; all other pairs and words are joined by hash.

Words are told apart by 64-bit hashes. Defined results: null and empty texts
hold their end only; ids can be null, rows can repeat; without training rows
all bytes are alike. Only doc_id and text are read, so other columns never
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, LOWER_VALUES, Scratch, as_long, mix, span_hashes, text_chunks, word_spans
from .letters import Lookup

#: Bytes of the longest context, and how many of them may lie before the last blank.
ORDER = 6
TAIL = 3
#: Symbols at a word's beginning whose contexts can look across the blank.
HEAD = ORDER - 1
#: Contexts of fewer bytes are shared with all tasks; the others are told apart in shards by their last ROOT bytes.
ROOT = 3
#: Tokens of the corpus for each shard's task, about, and rows that a task sums before it passes them on.
SHARD_TOKENS = 2_000_000
SUMMED_ROWS = 1_500_000
#: Answers that are shared with all tasks, those asked most; all others are joined.
CACHED = 1_500_000
#: Words with this share of all tokens are shared with all tasks; 5e5 at most.
FREQUENT_SHARE = 2e-6
#: Bytes of text that are counted at once.
CHUNK = 1 << 21
BLANK, END = 0x20, 0x0A  # neither is in a word
#: Symbols: bytes but for six kinds of white space, the blank and the end.
SYMBOLS = 252
#: Stands in a head for a byte that is not there; it is white space, so in no word.
NONE = 0x09
#: A context is its bytes, the nearest first, at the top of 48 bits, below its order + 1; a pair has the symbol between those.
_CONTEXT = np.uint64((1 << 48) - 1)
_MASKS = np.array([((1 << (8 * k)) - 1) << (48 - 8 * k) for k in range(ORDER + 1)], np.uint64)
_EIGHT, _SYMBOL_AT, _ORDER_AT = np.uint64(8), np.uint64(48), np.uint64(56)


def pairs(packed: np.ndarray, order: int | np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """One key of each context (bytes left-aligned in 48 bits) of an order and symbol."""
    return (np.asarray(order + 1, np.uint64) << _ORDER_AT) | (symbol.astype(np.uint64) << _SYMBOL_AT) | (packed & _MASKS[order])


def unpaired(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context key, symbol, order) of pairs."""
    tag = q >> _ORDER_AT
    return (tag << _SYMBOL_AT) | (q & _CONTEXT), ((q >> _SYMBOL_AT) & np.uint64(255)).astype(np.int64), tag.astype(np.int64) - 1


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, the number of each value among them); no stable sort, as equal ones may stand for each other."""
    order = np.argsort(h)
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], order[new], back


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, h, word, n, n_train): the distinct words of each chunk; where root holds, h is a pair of fewer than ROOT bytes, with its count."""
    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for first, stop, data, offs in text_chunks(batch.column("text"), CHUNK):
            q, c = root_counts(Text(data, offs), train[first:stop])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(q), bool)), pa.array(as_long(q)), pa.array([b""] * len(q), pa.binary()), pa.array(np.zeros(len(q), np.int64)), pa.array(c)], ["root", "h", "word", "n", "n_train"])
            starts, ends, rows = word_spans(data, offs)
            if not len(starts):
                continue
            h, where, back = distinct(span_hashes(LOWER_VALUES[data], starts, ends))
            low = LOWER[data].astype(np.uint8)
            size = (ends - starts)[where]
            cuts = np.r_[0, np.cumsum(size)]
            flat = low[np.arange(cuts[-1]) + np.repeat(starts[where] - cuts[:-1], size)]
            words = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])
            n = np.bincount(back, minlength=len(h))
            t = np.bincount(back, weights=train[first:stop][rows], minlength=len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), bool)), pa.array(as_long(h)), words, pa.array(n.astype(np.int64)), pa.array(t)], ["root", "h", "word", "n", "n_train"])


def root_counts(text: Text, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of all contexts of fewer than ROOT bytes in the training texts."""
    s, size = text.stream, np.diff(np.r_[text.blanks, len(text.stream)])
    known = np.flatnonzero(np.bincount(s, minlength=256)).astype(np.uint8)
    code, k = np.searchsorted(known, np.arange(256))[s], len(known)
    key, use = code, np.repeat(train, size)
    out, counts = [], []
    for order in range(ROOT):
        if order:  # keys of the symbols from number ``order`` on
            key = key[1:] + code[: max(len(s) - order, 0)] * k**order
        short = max(order - 1, 0)  # a text's blank is no symbol; the one of this number has fewer bytes before it
        use[text.blanks[size > short] + short] = False
        c = np.bincount(key[use[order:]], minlength=1)
        hit = np.flatnonzero(c)
        packed = np.zeros(len(hit), np.uint64)
        for j in range(1, order + 1):
            packed |= known[hit // k**j % k].astype(np.uint64) << np.uint64(48 - 8 * j)
        if k:
            out.append(pairs(packed, order, known[hit % k]))
            counts.append(c[hit])
    return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of " word word ... ", place of each word's first symbol, symbols of each word with its blank)."""
    _, offsets, raw = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    size = np.diff(offs)
    out = np.full(len(data) + len(size) + 1, BLANK, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size) + 1] = data
    return out, offs[:-1] - offs[0] + np.arange(len(size)) + 1, size + 1


class Text:
    """A chunk of texts as " word word ... word END" each, and the place, size and text of each word and end."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, rows = word_spans(data, offs)
        k, size = len(offs) - 1, ends - starts
        self.words, self.word_rows = (starts, ends), rows
        text = np.arange(k)
        row = np.r_[rows, text]
        order = np.argsort(row, kind="stable")  # a text's end comes after its words
        self.rows, self.size = row[order], np.r_[size + 1, np.ones(k, np.int64)][order]
        ends_at = np.cumsum(self.size) + self.rows + 1
        self.first = ends_at - self.size
        self.blanks = np.r_[0, ends_at[np.searchsorted(self.rows, text, "right") - 1]][:-1]  # each text begins with one
        self.stream = np.full(ends_at[-1], BLANK, np.uint8)
        place = np.empty(len(row), np.int64)
        place[order] = self.first
        low = LOWER[data].astype(np.uint8)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.stream[np.repeat(place[: len(rows)], size) + inner] = low[np.repeat(starts, size) + inner]
        self.stream[place[len(rows) :]] = END

    @cached_property
    def heads(self) -> np.ndarray:
        """Of each word and end the bytes before the blank, then its first symbols."""
        begin, end = self.blanks[self.rows], len(self.stream) - 1
        out = np.zeros(len(self.rows), np.uint64)
        for j in (*range(TAIL, 0, -1), *range(-1, -HEAD - 1, -1)):
            at = self.first - 1 - j
            there = at >= begin if j > 0 else -j <= self.size
            out = out << _EIGHT | np.where(there, self.stream[np.clip(at, 0, end)], NONE).astype(np.uint64)
        return out


def head_contexts(heads: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By place in the word: (place, which heads have a symbol there, the symbol, the bytes before it, how many of them there are)."""
    byte = [(heads >> np.uint64(8 * (7 - j))) & np.uint64(255) for j in range(8)]
    tail = sum((byte[j] != NONE).astype(np.int64) for j in range(TAIL))
    before = np.uint64(BLANK) << np.uint64(40)
    for j in range(TAIL):  # the last of them is the nearest
        before = before | np.where(byte[j] != NONE, byte[j], np.uint64(0)) << np.uint64(40 - 8 * (TAIL - j))
    for i in range(HEAD):
        symbol = byte[TAIL + i]
        which = np.flatnonzero(symbol != NONE)
        count = np.minimum(i + 1 + tail[which], ORDER)
        yield i, which, symbol[which], before[which] & _MASKS[count], count
        before = (symbol << np.uint64(40)) | (before >> _EIGHT)


def _contexts(stream: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the bytes before each symbol at positions 1.. of the stream, its word, its place there)."""
    n = len(stream) - 1
    word = np.repeat(np.arange(len(starts)), size)
    packed = np.zeros(n, np.uint64)
    for k in range(1, ORDER + 1):
        packed[k - 1 :] |= stream[: n - k + 1].astype(np.uint64) << np.uint64(48 - 8 * k)
    return packed, word, np.arange(1, n + 1) - starts[word]


def summed(q: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns' sums by pair, in the order of pairs."""
    order = np.argsort(q)
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    return q[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in columns)


def by_order(packed: np.ndarray, symbol: np.ndarray, n: np.ndarray, counted: np.ndarray, asked: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, counts, asked) of all orders from one sort: a symbol counts n times in its contexts of ``counted`` (least, greatest) bytes, and is asked for in that of ``at`` bytes."""
    key = (symbol.astype(np.uint64) << _SYMBOL_AT) | packed
    order = np.argsort(key)
    key, n, asked, at, low, high = key[order], n[order], asked[order], at[order], counted[0][order], counted[1][order]
    for k in range(1, ORDER + 1):
        counts, asks = (low <= k) & (k <= high), at == k
        some = np.flatnonzero((counts & (n > 0)) | (asks & (asked > 0)))
        if len(some):
            short = key[some] >> np.uint64(48 - 8 * k)
            first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
            whole = key[some[first]]
            sums = [np.add.reduceat(v[some] * use[some], first) for v, use in ((n, counts), (asked, asks))]
            yield pairs(whole & _CONTEXT, k, whole >> _SYMBOL_AT), *sums


class Sums:
    """Branches that a task has met, summed by pair, and passed on packed by shard."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.rows = shards, [], 0

    def add(self, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            self.parts.append(part)
            self.rows += len(part[0])
        if self.rows > SUMMED_ROWS:
            yield from self.end(SUMMED_ROWS // 2)

    def end(self, hold: int = 0) -> Iterator[pa.RecordBatch]:
        """Pass on what there is, if it is more than ``hold`` rows once summed."""
        if not self.parts:
            return
        q, n, asked = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.rows = [(q, n, asked)], len(q)
        if len(q) > hold:
            shard = (mix((q & _CONTEXT) >> np.uint64(48 - 8 * ROOT)) % np.uint64(self.shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            shard = shard[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            ends = pa.array(np.r_[cuts, len(shard)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (as_long(q), n.astype(np.int64), asked.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), *lists], ["shard", "q", "n", "asked"])
            self.parts, self.rows = [], 0


def word_parts(column: pa.Array, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Branches of ROOT bytes or more within words, each as often as the word; asked for by the word beyond its head."""
    stream, starts, size = _stream(column)
    packed, word, inside = _contexts(stream, starts, size)
    deep = inside >= HEAD
    high = np.minimum(inside + 1, ORDER)
    yield from by_order(packed, stream[1:], times[word], (np.full(len(word), ROOT), high), deep.astype(np.int64), np.where(deep, ORDER, 0))


def head_parts(heads: np.ndarray, times: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Branches of ROOT bytes or more that look across a blank; the head's symbols are asked for in their longest context."""
    for i, which, symbol, packed, count in head_contexts(heads):
        yield from by_order(packed, symbol, times[which], (np.full(len(which), max(ROOT, i + 2)), count), asked[which], count)


def _branches(shards: int):
    """Rows (shard, q, n, asked) of words (word, n_train) or of texts (text, train)."""

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shards)
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(k, 1 << 15)
                yield from sums.add(word_parts(part.column("word"), part.column("n_train").to_numpy()))
        yield from sums.end()

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shards)
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for first, stop, data, offs in text_chunks(batch.column("text"), CHUNK):
                text = Text(data, offs)
                heads, back, n = np.unique(text.heads, return_inverse=True, return_counts=True)
                times = np.bincount(back, weights=train[first:stop][text.rows], minlength=len(heads)).astype(np.int64)
                yield from sums.add(head_parts(heads, times, n))
        yield from sums.end()

    return of_words, of_texts


@dataclass
class Trie:
    """Contexts and branches in sorted arrays; logs are to base 10."""

    contexts: np.ndarray  # sorted keys
    total: np.ndarray  # T of each context
    escape: np.ndarray  # of T, what is left for an escape
    excluded: np.ndarray  # what its bytes hold of the next shorter context's total
    branches: np.ndarray  # sorted context index << 8 | symbol
    weight: np.ndarray  # count less 1/2
    alike: float  # the chance of each byte that order 0 doesn't know

    @classmethod
    def build(cls, q: np.ndarray, n: np.ndarray) -> Trie:
        """From distinct pairs and their counts."""
        context, symbol, order = unpaired(q)
        put = np.lexsort((symbol, context))
        context, symbol, order, n = context[put], symbol[put], order[put], n[put].astype(np.float64)
        keys, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(keys))
        weight = n - 0.5
        escape = total - np.bincount(inverse, weights=weight, minlength=len(keys))
        branches = inverse.astype(np.int64) << 8 | symbol
        excluded = np.zeros(len(keys))
        t = cls(keys, total, escape, excluded, branches, weight, 1.0 / SYMBOLS)
        for k in range(1, ORDER + 1):
            mine = np.flatnonzero(order == k)
            if len(mine):
                at = t.branch(t.find(shorter(context[mine], np.full(len(mine), k))), symbol[mine])
                excluded += np.bincount(inverse[mine], weights=np.where(at >= 0, weight[np.maximum(at, 0)], 0), minlength=len(keys))
        t.alike = 1.0 / max(SYMBOLS - int((order == 0).sum()), 1)
        return t

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.contexts):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.contexts, keys), len(self.contexts) - 1)
        return np.where(self.contexts[at] == keys, at, -1)

    def branch(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.branches):
            return np.full(len(context), -1)
        key = context << 8 | symbol
        at = np.minimum(np.searchsorted(self.branches, key), len(self.branches) - 1)
        return np.where(self.branches[at] == key, at, -1)

    def log_chance(self, keys: np.ndarray, order: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the chance of each symbol after a context (key) of each order."""
        out = np.zeros(len(keys))
        live, key, k = np.arange(len(keys)), keys.copy(), order.copy()
        less = np.zeros(len(keys))  # of the next context's total, what a longer one excludes
        while len(live):
            at = self.find(key)
            has = at >= 0
            safe = np.maximum(at, 0)
            b = self.branch(safe, symbol[live])
            hit = has & (b >= 0)
            if len(self.contexts):
                rest = np.where(has, self.total[safe] - less, 1.0)
                out[live[hit]] += np.log10(self.weight[b[hit]] / rest[hit])
                miss = has & ~hit
                out[live[miss]] += np.log10(self.escape[safe[miss]] / rest[miss])
                less = np.where(has, self.excluded[safe], less)
            last = ~hit & (k == 0)
            out[live[last]] += np.log10(self.alike)
            go = ~hit & (k > 0)
            key, live, less = shorter(key[go], k[go]), live[go], less[go]
            k = k[go] - 1
        return out


def shorter(keys: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Keys of contexts of k bytes without the oldest byte."""
    return (keys & _MASKS[k - 1]) | (k.astype(np.uint64) << _SYMBOL_AT)


def word_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pair, word) of each word's symbols from number HEAD on, the blank after it included."""
    stream, starts, size = _stream(column)
    packed, word, inside = _contexts(stream, starts, size)
    at = np.flatnonzero(inside >= HEAD)
    return pairs(packed[at], ORDER, stream[1:][at]), word[at]


def head_pairs(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, head) of the symbols of each head, a text's end among them."""
    out, rows = [], []
    for _, which, symbol, packed, count in head_contexts(heads):
        out.append(pairs(packed, count, symbol))
        rows.append(which)
    return np.concatenate(out), np.concatenate(rows)


def counted_per_row(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[pa.Array, pa.Array]:
    """(keys, times), one list of each for every row."""
    put = np.lexsort((keys, rows))
    keys, rows = keys[put], rows[put]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.r_[new, len(keys)])
    cuts = pa.array(np.r_[0, np.cumsum(np.bincount(rows[new], minlength=n_rows))].astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(as_long(keys[new]))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))


def answered(keys: np.ndarray, known: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the known chances of pairs, else 0; which ones are known)."""
    if not len(known):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    one, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, one), len(known) - 1)
    hit = known[at] == one
    return np.where(hit, chance[at], 0.0)[back], hit[back]


def answers(words: DataFrame, texts: DataFrame, root: tuple[np.ndarray, np.ndarray], tokens: int, scratch: Scratch) -> DataFrame:
    """(q, asked, p): the log10 chance of every pair that ``words`` (word, n_train) or ``texts`` (text, train) ask for; root: pairs of fewer than ROOT bytes and their counts."""
    spark, kinds = words.sparkSession, "shard int, q array<long>, n array<long>, asked array<long>"
    tasks = max(1, -(-tokens // SHARD_TOKENS))
    of_words, of_texts = _branches(8 * tasks)
    branches = words.select("word", "n_train").mapInArrow(of_words, kinds).unionAll(texts.select("text", "train").mapInArrow(of_texts, kinds))
    shared = spark.sparkContext.broadcast(root)

    def of_shard(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        q, n, asked = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        parts.clear()
        q = q.view(np.uint64)
        mine = (n > 0) & (q >> _ORDER_AT > ROOT)
        trie = Trie.build(*(np.concatenate(x) for x in zip(shared.value, (q[mine], n[mine]), strict=True)))
        some = np.flatnonzero(asked)
        q, asked = q[some], asked[some]
        for k in range(0, len(q), 1 << 18):
            part = slice(k, k + (1 << 18))
            context, symbol, order = unpaired(q[part])
            yield pa.RecordBatch.from_arrays([pa.array(as_long(q[part])), pa.array(asked[part]), pa.array(trie.log_chance(context, order, symbol))], ["q", "asked", "p"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None
        for batch in batches:  # in the order of shards, of which one is held at a time
            for i, shard in enumerate(batch.column("shard").to_pylist()):
                if shard != now and parts:
                    yield from of_shard(parts)
                now = shard
                parts.append(tuple(batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in ("q", "n", "asked")))
        if parts:
            yield from of_shard(parts)

    return scratch.save(branches.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(scored, "q long, asked long, p double"), "answers")


def most_asked(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted pairs, their chances) of at most CACHED answers."""
    least, held = 1, 0
    size = F.floor(F.log2("asked") * 8).cast("int")
    for r in sorted(found.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):  # 504 rows at most
        held += r["count"]
        if held > CACHED:
            least = int(np.ceil(2 ** ((r["size"] + 1) / 8)))
            break
    some = found.where(F.col("asked") >= least).select("q", "p").toArrow()
    q = some.column("q").to_numpy().view(np.uint64)
    order = np.argsort(q)
    return q[order], some.column("p").to_numpy()[order]


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` (of doc_id) tells which rows nothing is learnt from."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("train", ~held_out)
    counted = rows.select("text", "train").mapInArrow(_words, "root boolean, h long, word binary, n long, n_train long")
    both = scratch.save(counted.groupBy("root", "h").agg(F.first("word").alias("word"), F.sum("n").alias("n"), F.sum("n_train").alias("n_train")), "words")
    words = both.where("not root").drop("root")
    root = both.where("root").select("h", "n_train").toArrow()
    root = (root.column("h").to_numpy().view(np.uint64), root.column("n_train").to_numpy())
    ends = rows.where("train").count()
    sums = words.agg(F.sum("n"), F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1))).first()
    every, n_train, v = (sums[0] or 0), (sums[1] or 0) + ends, (sums[2] or 0) + (ends > 0)
    chances = answers(words, rows.select("text", "train"), root, every, scratch)
    cached = spark.sparkContext.broadcast(most_asked(chances))
    asks = chances.select(F.col("q").alias("ask"), "p")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(k, 1 << 15)
                c = part.column("n_train").to_numpy()
                base = np.log10((c + 1) / (n_train + v + 1))
                q, word = word_pairs(part.column("word"))
                p, known = answered(q, *cached.value)
                ppm = np.bincount(word, weights=p, minlength=part.num_rows)
                ask, ask_times = counted_per_row(q[~known], word[~known], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("n"), pa.array((c > 0).astype(np.int32)), pa.array(base), pa.array(ppm), ask, ask_times], ["h", "n", "known", "base", "ppm", "ask", "ask_times"])

    def joined(rows: DataFrame, key: str) -> DataFrame:
        """(key, p): the summed chances of the pairs that each row still asks for."""
        each = rows.select(key, F.explode(F.arrays_zip("ask", "ask_times")).alias("x")).select(key, F.col("x.ask").alias("ask"), F.col("x.ask_times").alias("times"))
        return each.join(asks, "ask").select(key, (F.col("times") * F.col("p")).alias("p"))

    partly = scratch.save(words.select("h", "word", "n", "n_train").mapInArrow(scored, "h long, n long, known int, base double, ppm double, ask array<long>, ask_times array<int>"), "word-parts")
    whole = joined(partly, "h").groupBy("h").agg(F.sum("p").alias("p"))
    table = scratch.save(partly.join(whole, "h", "left").select("h", "n", "known", "base", (F.col("ppm") + F.coalesce("p", F.lit(0.0))).alias("ppm")), "word-scores")
    often = table.where(F.col("n") >= FREQUENT_SHARE * max(every, 1)).orderBy("h").toPandas()
    order = np.argsort(often["h"].to_numpy(np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast((often["h"].to_numpy(np.int64).view(np.uint64)[order], often[["known", "base", "ppm"]].to_numpy(np.float64)[order]))
    end = (int(ends > 0), float(np.log10((ends + 1) / (n_train + v + 1))))

    def text_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h0, values = frequent.value
        look = Lookup(h0) if len(h0) else None
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("text")):
                k = stop - first
                text = Text(data, offs)
                of = text.word_rows
                h = span_hashes(LOWER_VALUES[data], *text.words) if len(of) else np.zeros(0, np.uint64)
                at = look.find(h) if look else np.full(len(h), -1)
                hit = at >= 0
                heads, back = np.unique(text.heads, return_inverse=True)
                q, head = head_pairs(heads)
                p, known = answered(q, *cached.value)
                whole = np.bincount(text.rows, weights=np.bincount(head, weights=p, minlength=len(heads))[back], minlength=k)
                q, head = q[~known], head[~known]
                q = q[np.argsort(head, kind="stable")]  # of each head the pairs to be joined, for all its occurrences
                many = np.bincount(head, minlength=len(heads))
                begin = np.cumsum(many) - many
                size = many[back]
                each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[back], size)
                ask, ask_times = counted_per_row(q[each], np.repeat(text.rows, size), k)
                parts = [np.bincount(of[hit], weights=values[at[hit], j], minlength=k) + more for j, more in enumerate((*end, whole))]
                rest, times = counted_per_row(h[~hit], of[~hit], k)
                ids = [batch.column(c).slice(first, k) for c in ("uid", "doc_id", "held_out")]
                n = np.bincount(of, minlength=k) + 1
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(n.astype(np.int64)), pa.array(np.rint(parts[0]).astype(np.int64)), pa.array(parts[1]), pa.array(parts[2]), rest, times, ask, ask_times],
                    ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "ppm", "rest", "times", "ask", "ask_times"],
                )

    texts = rows.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", (~F.col("train")).alias("held_out"), "text")
    sums = scratch.save(texts.mapInArrow(text_sums, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, ppm double, rest array<long>, times array<int>, ask array<long>, ask_times array<int>"), "sums")
    each = sums.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("h"), F.col("x.times").alias("times"))
    found = each.join(table.select("h", F.col("known").alias("k"), F.col("base").alias("b"), F.col("ppm").alias("p")), "h")
    found = found.select("uid", *((F.col("times") * F.col(c)).alias(c) for c in "kbp")).unionAll(joined(sums, "uid").select("uid", F.lit(0).alias("k"), F.lit(0.0).alias("b"), "p"))
    more = found.groupBy("uid").agg(*(F.sum(c).alias(c) for c in "kbp"))
    copies = sums.groupBy("uid").agg(F.count("*").alias("copies"))  # equal rows have one uid, under which all their words were added
    out = sums.drop("rest", "times", "ask", "ask_times").join(more.join(copies, "uid"), "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b) / F.col("copies"), F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", F.round(plus("known", "k")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("ppm", "p").alias("score"))
