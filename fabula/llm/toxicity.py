"""Toxicity from a learnt lexicon, misspellings included.

Training documents give the lexicon: words, and beginnings of words, that
toxic documents use far oftener than others. All of them form one trie, which is
intersected with Levenshtein automata: a word of FUZZY_1 letters or more is met
within distance 1, one of FUZZY_2 or more within distance 2, a beginning and a
shorter word at distance 0 only. The product becomes one deterministic
automaton, made as far as words lead, which all words of a text run through at
once; it is the only way to a hit. A misspelling weighs what the training
documents with its term or a misspelling of it say, so that short terms, which
many words are near to, weigh little. Hits within quotation marks, or near a
word that reports speech, are summed apart from plain ones. A logistic
regression on these sums gives the score.

Defined results: null and empty texts get the score of a text without hits;
without toxic training rows every score is 0. Labels of documents that are
missing, and label rows whose toxic is null, teach nothing; of several labels
of a document the largest counts. Rows may repeat. Other columns are kept out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_long, span_hashes, text_chunks, tidied
from .letters import Lookup, Runs

#: Training uses about so many labelled documents of either label at most, spread over all by a hash.
TRAIN_DOCS = 6_000
#: A lexicon entry occurs in so many toxic documents at least, and so many times oftener (natural log) than elsewhere.
MIN_DOCS = 3
MIN_WEIGHT = 2.0
#: Letters of a lexicon word from which on it is met within distance 1, and within 2.
FUZZY_1 = 4
FUZZY_2 = 9
#: The weight of a misspelling as a share of what its documents say.
FUZZY_SHARE = 0.8
PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 3
#: Words on either side that can mark a hit as reported speech.
WINDOW = 6
#: Words that report speech or name a word as such (lower case, several languages).
REPORTS = ("said", "says", "wrote", "called", "calls", "quote", "quoted", "word", "term", "insult", "slur", "means", "sagte", "schrieb", "wort", "nannte", "dit", "mot", "écrit", "appelle", "dijo", "palabra", "escribió", "llamó")
QUOTES = "\"«»„“”"


def errors_allowed(term: str) -> int:
    """The Levenshtein distance within which a lexicon word is met."""
    return (len(term) >= FUZZY_1) + (len(term) >= FUZZY_2)


#: States that a worker holds, about 500 bytes each.
MOST_STATES = 200_000


class Automaton:
    """A trie of words and beginnings, run with Levenshtein automata and made deterministic by subsets.

    States are sets of (trie node, errors) with the heaviest beginning that was
    passed, made when a word first leads to them; of 832 terms and 168 million
    characters there were 63,000 states. A worker that has made MOST_STATES of
    them begins anew with its next chunk; column 0 stands for characters
    of no term. ``exact``, ``stem`` and ``near`` have by state the weight of the
    term that it accepts without errors, of the beginning, and with errors."""

    def __init__(self, words: list[str], beginnings: list[str], word_weights: np.ndarray, beginning_weights: np.ndarray):
        nodes: list[dict[int, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.begins: dict[int, int] = {}
        self.slack: list[int] = [0]  # of each node, the most errors that a word below it allows
        self.limit = [errors_allowed(w) for w in words]
        self.words, self.word_weights, self.beginning_weights = words, word_weights, beginning_weights
        self.near_weights = np.zeros(len(words))
        self.alphabet = np.array(sorted({ord(c) for t in (*words, *beginnings) for c in t}), np.uint32)
        symbol = {int(c): i + 1 for i, c in enumerate(self.alphabet)}
        for k, t in enumerate((*words, *beginnings)):
            at, more = 0, self.limit[k] if k < len(words) else 0
            for c in t:
                self.slack[at] = max(self.slack[at], more)
                s = symbol[ord(c)]
                if s not in nodes[at]:
                    nodes.append({})
                    self.slack.append(0)
                    nodes[at][s] = len(nodes) - 1
                at = nodes[at][s]
            self.slack[at] = max(self.slack[at], more)
            if k < len(words):
                self.ends[at] = k
            else:
                self.begins[at] = k - len(words)
        self.nodes = nodes
        self._begin()

    def _begin(self) -> None:
        """Only the dead state and the first one."""
        self.index: dict[tuple[bytes, int], int] = {}
        self.states: list[tuple[bytes, int]] = []
        self.found: list[tuple[tuple[int, int], ...]] = []  # of each state, the (word, errors) that it accepts
        self.table = np.full((2, len(self.alphabet) + 1), -1, np.int32)
        self.weights = np.zeros((2, 3))
        self._number(b"", -1)
        self._number(self._closed({(0, 0)}), -1)
        self.table[0] = 0

    def learn_misspellings(self, weights: np.ndarray) -> None:
        """Set the weight of each word's misspellings."""
        self.near_weights = weights
        for k in range(len(self.states)):
            self._weigh(k)

    def _closed(self, pairs: set[tuple[int, int]]) -> bytes:
        """With letters of the term left out, and without what a pair of fewer errors holds already; packed, node << 2 | errors."""
        todo, least = list(pairs), {}
        while todo:
            n, e = todo.pop()
            if e <= self.slack[n] and e < least.get(n, 9):
                least[n] = e
                todo += [(c, e + 1) for c in self.nodes[n].values()]
        return array("i", sorted(n << 2 | e for n, e in least.items())).tobytes()

    def _step(self, state: tuple[bytes, int], s: int) -> tuple[bytes, int]:
        out, passed = set(), state[1]
        for x in array("i", state[0]):
            n, e = x >> 2, x & 3
            if s in self.nodes[n]:
                out.add((self.nodes[n][s], e))
            out.add((n, e + 1))
            out.update((c, e + 1) for c in self.nodes[n].values())
            if e == 0 and n in self.begins and (passed < 0 or self.beginning_weights[self.begins[n]] > self.beginning_weights[passed]):
                passed = self.begins[n]
        return self._closed(out), passed

    def _weigh(self, k: int) -> None:
        passed = self.states[k][1]
        exact = max((self.word_weights[t] for t, e in self.found[k] if e == 0), default=0.0)
        near = max((self.near_weights[t] for t, e in self.found[k] if e), default=0.0)
        self.weights[k] = (exact, self.beginning_weights[passed] if passed >= 0 and not exact else 0.0, 0.0 if exact else near)

    def _number(self, pairs: bytes, passed: int) -> int:
        state = (pairs, passed)
        if state not in self.index:
            self.index[state] = len(self.states)
            self.states.append(state)
            ends = ((self.ends[x >> 2], x & 3) for x in array("i", pairs) if x >> 2 in self.ends)
            self.found.append(tuple(sorted((t, e) for t, e in ends if e <= self.limit[t])))
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
            self._weigh(len(self.states) - 1)
        return self.index[state]

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state in which each word leaves the automaton; 0 accepts nothing."""
        if len(self.states) > MOST_STATES:
            self._begin()
        where = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1) if len(self.alphabet) else np.zeros(len(points), np.int64)
        symbols = np.where(self.alphabet[where] == points, where + 1, 0) if len(self.alphabet) else where
        state = np.ones(len(starts), np.int32)
        live, at = np.arange(len(starts)), starts.copy()
        while len(live):
            go = (at < ends[live]) & (state[live] != 0)
            live, at = live[go], at[go]
            old, s = state[live], symbols[at]
            new = np.flatnonzero(self.table[old, s] < 0)
            for x, y in np.unique(np.c_[old[new], s[new]], axis=0).tolist():
                to = self._number(*self._step(self.states[x], y))
                self.table[x, y] = to
            state[live] = self.table[old, s]
            at = at + 1
        return state

    def terms(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, word) of all lexicon words that the words which left in these states are, or are near to."""
        lists = [[t for t, _ in self.found[x]] for x in state.tolist()]
        return np.repeat(np.arange(len(state)), [len(x) for x in lists]), np.array([t for x in lists for t in x], np.int64)


@dataclass
class Model:
    lexicon: Automaton | None = None
    reports: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    theta: np.ndarray | None = None


def prefix_hashes(runs: Runs, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position in ``which``) of the first ``length`` characters of the words that are longer."""
    longer = np.flatnonzero(runs.ends[which] - runs.starts[which] > length)
    s = runs.starts[which[longer]]
    h = span_hashes(runs.values, s, s + length) if len(s) else np.zeros(0, np.uint64)
    return h ^ np.uint64(0x517CC1B727220A95), longer


def hits(runs: Runs, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its weight as a lexicon word, as one with a lexicon beginning, and as a misspelt one."""
    _, first, back = np.unique(runs.hashes(), return_index=True, return_inverse=True)
    if m.lexicon is None:
        return (np.zeros(len(back)),) * 3
    state = m.lexicon.run(runs.points, runs.starts[first], runs.ends[first])
    exact, stem, near = m.lexicon.weights[state][back].T
    return exact, stem, near


def reported(runs: Runs, reports: Lookup) -> np.ndarray:
    """For each word whether it stands in quotation marks or within WINDOW words of a reporting word of its text."""
    mark = np.isin(runs.raw, np.array([ord(c) for c in QUOTES], np.uint32))
    marks = np.r_[0, np.cumsum(mark)]
    inside = (marks[runs.starts] - marks[runs.offs[runs.rows]]) % 2 == 1
    cue = np.flatnonzero(reports.find(runs.hashes()) >= 0)
    for d in range(-WINDOW, WINDOW + 1):
        to = cue + d
        ok = (to >= 0) & (to < len(inside))
        ok[ok] = runs.rows[to[ok]] == runs.rows[cue[ok]]
        inside[to[ok]] |= True
    return inside


def features(data: np.ndarray, offs: np.ndarray, m: Model, reports: Lookup) -> np.ndarray:
    """By text: logs of the summed weights of plain hits, of reported ones, and of both by length; a word counts once a text."""
    runs = Runs(data, offs, "alnum")
    k = len(offs) - 1
    out = np.zeros((k, FEATURES))
    if not len(runs.starts):
        return out
    weight = np.maximum.reduce(hits(runs, m))
    told = reported(runs, reports) & (weight > 0)
    some = np.flatnonzero(weight > 0)
    some = some[np.argsort(told[some], kind="stable")]  # a plain hit of a word goes before its reported ones
    once = some[np.unique(np.c_[runs.rows[some].astype(np.uint64), runs.hashes()[some]], axis=0, return_index=True)[1]] if len(some) else some
    for j, w in enumerate((weight[once] * ~told[once], weight[once] * told[once])):
        out[:, j] = np.bincount(runs.rows[once], weights=w, minlength=k)
    n = np.bincount(runs.rows, minlength=k)
    out[:, 2] = 10 * out[:, :2].sum(axis=1) / np.sqrt(np.maximum(n, 100))
    return np.log1p(out)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, prefix length or 0, toxic, n, example): in how many documents of a batch each word and beginning occurs."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for first, stop, data, offs in text_chunks(batch.column("text")):
            runs = Runs(data, offs, "alnum")
            if not len(runs.starts):
                continue
            y = toxic[first:stop]
            _, one, back = np.unique(runs.hashes(), return_index=True, return_inverse=True)
            for length in (0, *PREFIXES):
                if length:
                    p, owner = prefix_hashes(runs, one, length)
                    code = np.full(len(one), -1, np.int64)
                    keys, at, inv = np.unique(p, return_index=True, return_inverse=True)
                    code[owner] = inv
                    sample = one[owner[at]] if len(owner) else one[:0]
                else:
                    keys, sample, code = runs.hashes()[one], one, np.arange(len(one))
                if not len(keys):
                    continue
                c = code[back]
                pairs = np.unique(c[c >= 0] * np.int64(1 << 20) + runs.rows[c >= 0])
                n1 = np.bincount(pairs >> 20, weights=y[pairs & ((1 << 20) - 1)], minlength=len(keys)).astype(np.int64)
                n0 = np.bincount(pairs >> 20, minlength=len(keys)) - n1
                text = [runs.word(i)[: length or None] if n1[j] else None for j, i in enumerate(sample)]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(np.full(len(keys), length, np.int32)), pa.array(n1), pa.array(n0), pa.array(text, pa.string())], ["h", "length", "n1", "n0", "term"])


def _near_documents(automaton):
    """Rows (term, n1, n0): in how many toxic and other documents of a chunk a term or a misspelling of it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for first, stop, data, offs in text_chunks(batch.column("text")):
                runs = Runs(data, offs, "alnum")
                if not len(runs.starts):
                    continue
                _, one, back = np.unique(runs.hashes(), return_index=True, return_inverse=True)
                at, term = automaton.value.terms(automaton.value.run(runs.points, runs.starts[one], runs.ends[one]))
                pairs = np.unique(back.astype(np.int64) << 20 | runs.rows)  # each word of each text once
                word, row = pairs >> 20, pairs & ((1 << 20) - 1)
                lo, hi = np.searchsorted(word, at), np.searchsorted(word, at, "right")
                where = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange((hi - lo).sum()) if len(at) else lo
                hit = np.unique(np.repeat(term, hi - lo) << 20 | row[where])
                y = toxic[first:stop][hit & ((1 << 20) - 1)]
                found, inv = np.unique(hit >> 20, return_inverse=True)
                n1 = np.bincount(inv, weights=y, minlength=len(found)).astype(np.int64)
                n0 = np.bincount(inv, minlength=len(found)) - n1
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n1), pa.array(n0)], ["term", "n1", "n0"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on rows of weight ``w``, the constant last, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    theta, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (w * (p - y)) + penalty * theta
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), g)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return theta


def train(docs: DataFrame, labels: DataFrame, usable: Column, train_docs: int = TRAIN_DOCS) -> Model:
    """Lexicon, automaton and weights from the labelled documents where ``usable`` (of doc_id) holds."""
    y = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    if not count.get(1):
        return Model()
    spread = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    share = {k: int(min(1.0, train_docs / n) * 1_000_000) for k, n in count.items()}
    # a bounded number of rows, so that the texts needn't be shuffled to find theirs
    picked = y.where(F.when(F.col("toxic") == 1, spread < share.get(1, 0)).otherwise(spread < share.get(0, 0)))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    rows = rows.persist()
    n1, n0 = (rows.where(F.col("toxic") == k).count() for k in (1, 0))
    # the log ratio less its standard error, so that chance finds weigh little
    weight = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0)) - F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    terms = rows.select("text", "toxic").mapInArrow(tidied(_document_terms), "h long, length int, n1 long, n0 long, term string").groupBy("h", "length").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("term").alias("term"))
    # as many as the bounded sample has
    kept = terms.where(F.col("n1") >= MIN_DOCS).withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT).select("length", "term", "w").orderBy("length", "term").toPandas()
    m = Model(reports=_hash_terms(REPORTS))
    whole = kept["length"] == 0
    words, word_weights = list(kept["term"][whole]), kept["w"][whole].to_numpy(np.float64)
    m.lexicon = Automaton(words, list(kept["term"][~whole]), word_weights, kept["w"][~whole].to_numpy(np.float64))
    near = rows.select("text", "toxic").mapInArrow(tidied(_near_documents(docs.sparkSession.sparkContext.broadcast(m.lexicon))), "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    near = near.withColumn("w", weight).toPandas()
    near_weights = np.zeros(len(words))
    near_weights[near["term"].to_numpy(np.int64)] = near["w"].to_numpy(np.float64)
    m.lexicon.learn_misspellings(FUZZY_SHARE * np.clip(near_weights, 0, word_weights))
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        reports = Lookup(shared.value.reports)
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("text")):
                f = features(data, offs, shared.value, reports)
                yield pa.RecordBatch.from_arrays([*(pa.array(f[:, j]) for j in range(FEATURES)), batch.column("toxic").slice(first, stop - first)], [*"abc", "toxic"])

    xy = rows.select("text", "toxic").mapInArrow(tidied(run), "a double, b double, c double, toxic int").toPandas()
    rows.unpersist()
    of = xy["toxic"].to_numpy(np.float64)
    stands_for = np.where(of == 1, count[1] / max(n1, 1), count.get(0, 0) / max(n0, 1))  # sampled labels keep their share
    m.theta = _fit(xy[[*"abc"]].to_numpy(), of, stands_for)
    return m


def _hash_terms(terms: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    return np.unique(Runs(data, np.array([0, len(data)]), "alnum").hashes())


def score(docs: DataFrame, m: Model) -> DataFrame:
    """Per row: doc_id, score (0 to 1); repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reports = Lookup(m.reports)
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("text")):
                k = stop - first
                p = np.zeros(k)
                if m.theta is not None:
                    f = features(data, offs, m, reports)
                    p = 1 / (1 + np.exp(-np.clip(f @ m.theta[:-1] + m.theta[-1], -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, k), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, score double")


def reject(docs: DataFrame, m: Model, limit: float) -> DataFrame:
    """``docs`` without the rows whose score is ``limit`` or more; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reports = Lookup(m.reports)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            for first, stop, data, offs in text_chunks(text):
                part = batch.slice(first, stop - first)
                if m.theta is None:
                    yield part
                    continue
                z = features(data, offs, m, reports) @ m.theta[:-1] + m.theta[-1]
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < limit))

    return docs.mapInArrow(tidied(run), docs.schema)
