"""Language identification by word-first backoff.

A word (a run of letters, lower-cased) that training met is scored by its log
frequency in each language. A word it never met is scored by its character
n-grams, word boundaries included: by those of length 5 that training met, or
if there are none by those of length 4, and so on down to single characters. A
text's language is the one with the greatest sum.

Defined results: a null text or one without any letter is ``und`` with score
0; rows without text or language teach nothing; without any training row
everything is ``und``; ties go to the name that sorts first. Rows may repeat
and carry any other columns, which are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_long, fold_hashes, text_chunks
from .letters import Lookup, Runs

#: Training reads about so many documents at most, spread over all by a hash of their id; the model holds all their words and n-grams.
TRAIN_DOCS = 12_000
ORDERS = (5, 4, 3, 2, 1)
#: A text's mean log ratio counts as this many words' at most when the score is formed.
SCORE_WORDS = 8
_EDGE = np.uint64(0x632BE59BD9B4E019)


def _grams(runs: Runs, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index into ``which``) of the words' n-grams, a boundary mark before and after each word."""
    size = runs.ends[which] - runs.starts[which] + 2
    owner = np.repeat(np.arange(len(which)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(owner)) - first[owner]
    inner = (at > 0) & (at < size[owner] - 1)
    values = np.full(len(owner), _EDGE, np.uint64)
    values[inner] = runs.values[(runs.starts[which][owner] + at - 1)[inner]]
    if len(values) < order:
        return np.zeros(0, np.uint64), owner[:0]
    n = len(values) - order + 1
    whole = owner[:n] == owner[order - 1 :]
    return fold_hashes([values[i : n + i][whole] for i in range(order)], order), owner[:n][whole]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, h, c): words (kind 0) and n-grams (kind = length) of each batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            mine = batch.filter(pa.array(langs == lang))
            for _, _, data, offs in text_chunks(mine.column("text")):
                runs = Runs(data, offs)
                h, where, count = np.unique(runs.hashes(), return_index=True, return_counts=True)
                parts = [(0, h, count)]
                for order in ORDERS:
                    g, owner = _grams(runs, where, order)
                    keys, back = np.unique(g, return_inverse=True)
                    parts.append((order, keys, np.bincount(back, weights=count[owner], minlength=len(keys)).astype(np.int64)))
                for kind, k, c in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(np.full(len(k), kind, np.int32)), pa.array(as_long(k)), pa.array(c.astype(np.int64))], ["lang", "kind", "h", "c"])


@dataclass
class Model:
    langs: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]  # of words and of each order in ORDERS: sorted hashes, log frequencies by language

    def prepared(self) -> list[tuple[Lookup, np.ndarray]]:
        return [(Lookup(h), v) for h, v in self.tables]


def train(docs: DataFrame, usable: Column, train_docs: int = TRAIN_DOCS) -> Model:
    """A model of the rows where ``usable`` holds and text and lang are not null."""
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = rows.count()
    share = min(1.0, train_docs / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
    counts = picked.mapInArrow(_counts, "lang string, kind int, h long, c long").groupBy("lang", "kind", "h").agg(F.sum("c").alias("c"))
    totals = counts.groupBy("kind", "h").agg(F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
    tables, kept = [], []
    langs = sorted(r[0] for r in picked.select("lang").distinct().collect())
    wide = totals.select("kind", "h", *(F.coalesce(F.element_at("by", F.lit(x)), F.lit(0)).alias(f"c{i}") for i, x in enumerate(langs)))
    wide = wide.persist()
    for kind in (0, *ORDERS):
        part = wide.where(F.col("kind") == kind).drop("kind").toArrow()
        kept.append((part.column("h").to_numpy().view(np.uint64), np.stack([part.column(f"c{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.float32) if langs else np.zeros((0, 0), np.float32)))
    wide.unpersist()
    for h, c in kept:
        order = np.argsort(h)
        total = c.sum(axis=0, dtype=np.float64) + 0.1 * (len(c) + 1)
        tables.append((h[order], np.log((c[order] + 0.1) / total.astype(np.float32))))
    return Model(langs, tables)


def score_chunk(data: np.ndarray, offs: np.ndarray, n_langs: int, tables: list[tuple[Lookup, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of log frequencies by text and language, count of words by text)."""
    runs = Runs(data, offs)
    k = len(offs) - 1
    words = np.bincount(runs.rows, minlength=k)
    h = runs.hashes()
    lookup, values = tables[0]
    at = lookup.find(h)
    sums = np.zeros((k, n_langs))
    known = at >= 0
    for j in range(n_langs):
        sums[:, j] += np.bincount(runs.rows[known], weights=values[at[known], j], minlength=k)
    strange = np.flatnonzero(~known)
    if len(strange):
        _, first, back = np.unique(h[strange], return_index=True, return_inverse=True)
        which = strange[first]
        own = np.zeros((len(which), n_langs))
        todo = np.arange(len(which))
        for (look, value), order in zip(tables[1:], ORDERS, strict=True):
            if not len(todo):
                break
            g, owner = _grams(runs, which[todo], order)
            at = look.find(g)
            hit = at >= 0
            n = np.bincount(owner[hit], minlength=len(todo))
            for j in range(n_langs):
                own[todo, j] = np.bincount(owner[hit], weights=value[at[hit], j], minlength=len(todo)) / np.maximum(n, 1)
            todo = todo[n == 0]
        for j in range(n_langs):
            sums[:, j] += np.bincount(runs.rows[strange], weights=own[back, j], minlength=k)
    return sums, words


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the posterior share of the language found)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready: dict[int, list] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = ready.setdefault(0, m.prepared())
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("text")):
                sums, words = score_chunk(data, offs, len(m.langs), tables)
                k = stop - first
                best, p = np.full(k, len(m.langs)), np.zeros(k)
                if m.langs:
                    mean = sums / np.maximum(words, 1)[:, None] * np.minimum(words, SCORE_WORDS)[:, None]
                    e = np.exp(mean - mean.max(axis=1, keepdims=True))
                    some = words > 0
                    best[some] = sums.argmax(axis=1)[some]
                    p[some] = (e.max(axis=1) / e.sum(axis=1))[some]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, k), pa.array(names[best].tolist(), pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
