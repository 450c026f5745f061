"""BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

A text's words (the pieces of the pre-tokenizer) are looked up in a cache of
words met before. New words go through three steps, many at once: greedy
longest match over a trie proposes tokens; a vectorised check tests every
adjacent pair of tokens; words in which all pairs are compatible are done, as
BPE of a word is the one token sequence whose neighbours all stay apart when
merged. Only the other words are merged by rank.

Two neighbours l, r are compatible if merging "l r" from characters gives
[l, r] again. The check runs the merges of both backwards: with L the token at
l's right edge and R that at r's left edge, the pair (L, R) would have merged
if its rank lies before the merges that swallowed L and R (of equal ranks the
left one comes first); then the younger of L and R is undone.

Files of the ``tokenizers`` library for word-level lower-cased BPE with a
word-end suffix are read (normaliser NFC, white space, lower case; a split
into words; byte-level letters; no decoder). Special tokens are found in the
raw text, as the library does.

Defined results: null and empty texts have no tokens and decode to ''. Rows
may repeat and have any other columns; those are kept out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: Words in a worker's cache at most; when it is full it starts anew.
CACHE_WORDS = 150_000
#: New words that are encoded at once.
BLOCK_WORDS = 20_000
#: Words of more bytes than this are merged one by one, with a heap.
STEP_BYTES = 32
_NEVER = np.int32(2**31 - 1)
#: White space as the library's patterns have it.
_SPACE = "\t\n\v\f\r \u0085   -     　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Arrays over token ids, and the merges by packed pair."""

    text: list[str]  # of each id
    first: np.ndarray  # ids of bytes 0..255 within a word
    final: np.ndarray  # ids of bytes 0..255 at a word's end
    left: np.ndarray  # of each id the token it was merged from, or itself
    right: np.ndarray
    rank: np.ndarray  # of each id's merge; -1 for bytes
    pairs: np.ndarray  # sorted left << 32 | right
    pair_rank: np.ndarray
    pair_id: np.ndarray
    edges: np.ndarray  # sorted trie state << 9 | symbol
    edge_to: np.ndarray
    token_at: np.ndarray  # of each trie state, or -1
    special: dict[str, int]
    pattern: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or model["dropout"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError(f"{path}: no lower-cased word BPE with a word-end suffix")
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        text = [""] * size
        for t, i in vocab.items():
            text[i] = t
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in special.items():
            text[i] = t
        letters = byte_letters()
        first = np.array([vocab[c] for c in letters], np.int32)
        final = np.array([vocab[c + suffix] for c in letters], np.int32)
        left, right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        rank = np.full(size, -1, np.int32)
        merges: dict[int, tuple[int, int]] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            to = vocab[a + b]
            merges.setdefault(vocab[a] << 32 | vocab[b], (k, to))
            if rank[to] < 0:
                left[to], right[to], rank[to] = vocab[a], vocab[b], k
        pairs = np.array(sorted(merges), np.int64)
        v = cls(text, first, final, left, right, rank, pairs, np.array([merges[p][0] for p in pairs.tolist()], np.int32), np.array([merges[p][1] for p in pairs.tolist()], np.int32), *(np.zeros(0, np.int32),) * 3, special, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        v._build_trie(suffix)
        return v

    def _build_trie(self, suffix: str) -> None:
        """A trie of the tokens that merging their own characters gives back."""
        symbol = {c: b for b, c in enumerate(byte_letters())}
        sound = np.zeros(len(self.text), bool)
        sound[self.first] = sound[self.final] = True
        order = np.argsort(self.rank, kind="stable")
        order = order[self.rank[order] >= 0]
        ok = self.compatible(self.left[order], self.right[order], self.rank[order])
        for i, good in zip(order.tolist(), ok.tolist(), strict=True):
            sound[i] = good and sound[self.left[i]] and sound[self.right[i]]
        edges: dict[int, int] = {}
        token_at = [-1]
        for i in np.flatnonzero(sound).tolist():
            t, ends = (self.text[i][: -len(suffix)], True) if self.text[i].endswith(suffix) and len(self.text[i]) > len(suffix) else (self.text[i], False)
            at = 0
            for k, c in enumerate(t):
                key = at << 9 | symbol[c] | (256 if ends and k == len(t) - 1 else 0)
                if key not in edges:
                    edges[key] = len(token_at)
                    token_at.append(-1)
                at = edges[key]
            token_at[at] = i
        self.edges = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[e] for e in self.edges.tolist()], np.int32)
        self.token_at = np.array(token_at, np.int32)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, or _NEVER."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair, known to merge, becomes."""
        return self.pair_id[np.searchsorted(self.pairs, a.astype(np.int64) << 32 | b)]

    def compatible(self, l: np.ndarray, r: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:  # noqa: E741
        """Whether each pair of neighbours stays apart (with ``before``: until the merge of that rank)."""
        l, r = l.astype(np.int32), r.astype(np.int32)  # noqa: E741
        out = np.ones(len(l), bool)
        live = np.arange(len(l))
        end_l = np.full(len(l), _NEVER, np.int32) if before is None else before.astype(np.int32)
        end_r = end_l - (before is not None)
        while len(live):
            m = self.merge_rank(l, r)
            bad = (m < end_l) & (m <= end_r) & (m != _NEVER)
            out[live[bad]] = False
            undo_r = self.rank[r] >= self.rank[l]
            done = bad | ((self.rank[l] < 0) & (self.rank[r] < 0))
            go = ~done
            live, l, r, end_l, end_r, undo_r = live[go], l[go], r[go], end_l[go], end_r[go], undo_r[go]  # noqa: E741
            end_r = np.where(undo_r, self.rank[r], end_r)
            end_l = np.where(undo_r, end_l, self.rank[l])
            l, r = np.where(undo_r, l, self.right[l]), np.where(undo_r, self.left[r], r)  # noqa: E741
        return out


class Encoder:
    """Encodes texts with one vocabulary; keeps what words came to."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.decimal = [str(i) for i in range(len(v.text))]
        self.words = regex.compile(v.pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) or r"(?!)")
        self.split = regex.compile(f"[{_SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.merges = dict(zip(v.pairs.tolist(), zip(v.pair_rank.tolist(), v.pair_id.tolist(), strict=True), strict=True))

    def pieces(self, text: str) -> list[str]:
        """The text cut at white space; special tokens stand alone with a mark before them."""
        if "<" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self.pieces(text[at : m.start()]), "\n" + m[0]]
                at = m.end()
            return out + self.pieces(text[at:])
        if self.odd.search(text):  # str.split() cuts there too
            return [x for x in self.split.split(text) if x]
        return text.split()

    def learn(self, new: list[str]) -> None:
        """Put pieces without white space into the cache."""
        words, owner = [], []
        for k, piece in enumerate(new):
            if piece[0] == "\n":
                i = self.v.special[piece[1:]]
                self.cache[piece] = (1, str(i), piece[1:])
                continue
            p = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            p = p.lower()
            for w in (p,) if p.isalpha() else self.words.findall(p):
                words.append(w.encode())
                owner.append(k)
        ids: list[list[int]] = []
        for k in range(0, len(words), BLOCK_WORDS):
            ids += self.encode_words(words[k : k + BLOCK_WORDS])
        parts: list[list[int]] = [[] for _ in new]
        for k, w in zip(owner, ids, strict=True):
            parts[k] += w
        text, decimal = self.v.text.__getitem__, self.decimal.__getitem__
        for piece, w in zip(new, parts, strict=True):
            if piece[0] != "\n":
                self.cache[piece] = (len(w), " ".join(map(decimal, w)), " ".join(map(text, w)))

    def propose(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, word of each) of all words by greedy longest match, in step."""
        v, n = self.v, len(starts)
        live, at, state = np.arange(n), starts.copy(), np.zeros(n, np.int64)
        best, best_end = np.full(n, -1, np.int32), starts.copy()
        toks, owners = [], []
        while len(live):
            inside = at < ends[live]
            key = state << 9 | symbols[np.minimum(at, len(symbols) - 1)]
            place = np.minimum(np.searchsorted(v.edges, key), len(v.edges) - 1)
            go = inside & (v.edges[place] == key)
            state = np.where(go, v.edge_to[place], 0).astype(np.int64)
            at = at + go
            hit = go & (v.token_at[state] >= 0)
            best[live[hit]], best_end[live[hit]] = v.token_at[state[hit]], at[hit]
            stop = np.flatnonzero(~go)
            if len(stop):
                w = live[stop]
                toks.append(best[w])
                owners.append(w)
                at[stop] = best_end[w]
                on = np.ones(len(live), bool)
                on[stop] = best_end[w] < ends[w]
                live, at, state = live[on], at[on], state[on]
        tok, own = np.concatenate(toks), np.concatenate(owners)
        put = np.argsort(own, kind="stable")  # a word's tokens were found in order
        return tok[put], own[put]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        tok, own = self.propose(symbols, ends - sizes, ends)
        near = np.flatnonzero(own[1:] == own[:-1])
        keys, back = np.unique(tok[near].astype(np.int64) << 32 | tok[near + 1], return_inverse=True)
        ok = self.v.compatible(keys >> 32, keys & 0xFFFFFFFF)[back] if len(keys) else np.zeros(0, bool)
        bad = np.zeros(len(words), bool)
        bad[own[near[~ok]]] = True
        cuts = np.searchsorted(own, np.arange(len(words) + 1)).tolist()
        flat = tok.tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        short = np.flatnonzero(bad & (sizes <= STEP_BYTES))
        for low in range(0, STEP_BYTES, 8):
            some = short[(sizes[short] > low) & (sizes[short] <= low + 8)]
            if len(some):
                for i, w in zip(some.tolist(), self.exact_many(symbols, (ends - sizes)[some], sizes[some]), strict=True):
                    out[i] = w
        for i in np.flatnonzero(bad & (sizes > STEP_BYTES)).tolist():
            out[i] = self.exact(words[i])
        return out

    def exact_many(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Merge all words in step by rank, leftmost first: a row of tokens for each word, closed up after each merge."""
        v, wide = self.v, int(sizes.max())
        column = np.arange(wide)
        base = np.r_[v.first, v.final]
        ids = np.where(column < sizes[:, None], base[symbols[np.minimum(starts[:, None] + column, len(symbols) - 1)]], -1).astype(np.int32)
        count, live = sizes.copy(), np.arange(len(sizes))
        rank = v.merge_rank(ids[:, :-1], ids[:, 1:])
        rank[ids[:, 1:] < 0] = _NEVER
        rank = np.c_[rank, np.full(len(ids), _NEVER, np.int32)]
        work = ids.copy()
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            go = rank[row, at] != _NEVER
            if not go.all():
                ids[live[~go]] = work[~go]
                live, work, rank, at = live[go], work[go], rank[go], at[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            to = v.merged(work[row, at], work[row, at + 1])
            source = np.minimum(column + (column > at[:, None]), wide - 1)
            work, rank = np.take_along_axis(work, source, 1), np.take_along_axis(rank, source, 1)
            work[:, -1], rank[:, -1] = -1, _NEVER
            work[row, at] = to
            count[live] -= 1
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = v.merge_rank(work[left, at[left] - 1], to[left])
            after = work[row, np.minimum(at + 1, wide - 1)]
            rank[row, at] = np.where((after >= 0) & (at + 1 < wide), v.merge_rank(to, after), _NEVER)
        return [w[:n] for w, n in zip(ids.tolist(), count.tolist(), strict=True)]

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first: a heap over a linked list of tokens."""
        ids = [*self.v.first[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.v.final[word[-1]])]
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = self.merges.get(ids[i] << 32 | ids[i + 1])
            if m:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            k = after[i] = after[j]
            if k < n:
                prior[k] = i
                m = self.merges.get(to << 32 | ids[k])
                if m:
                    heapq.heappush(heap, (m[0], i, to, ids[k], m[1]))
            p = prior[i]
            if p >= 0:
                m = self.merges.get(ids[p] << 32 | to)
                if m:
                    heapq.heappush(heap, (m[0], p, ids[p], to, m[1]))
        return [i for i in ids if i >= 0]

    def encode(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """Of each text its pieces' (count of ids, ids as decimals, decoded text); pieces without ids are left out."""
        cut = [self.pieces(t) for t in texts]
        met = set().union(*cut)
        new = met.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = met
        if new:
            self.learn(list(new))
        cache = self.cache
        for c in cut:
            yield [x for x in map(cache.__getitem__, c) if x[0]]


def _texts(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``limit`` characters; nulls are empty."""
    run, size, first = [], 0, 0
    for i in range(len(column)):
        run.append(column[i].as_py() or "")
        size += len(run[-1])
        if size >= limit:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def _mapped(docs: DataFrame, path: str, schema: str, make):
    """``docs`` through ``make``, which turns an encoded text into the values that follow doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    kinds = [pa.list_(pa.int32()) if t == "array<int>" else {"long": pa.int64(), "string": pa.string()}[t] for _, t in (x.strip().split(" ") for x in schema.split(","))]
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            for first, texts in _texts(batch.column("text")):
                rows = [make(x) for x in coder.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(rows)), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row of ``docs`` (doc_id, text) by the vocabulary file at ``path``."""
    return _mapped(docs, path, "n_tokens long, ids array<int>, decoded string", lambda w: (sum(x[0] for x in w), [int(i) for x in w for i in x[1].split(" ")], " ".join([x[2] for x in w])))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids): the tokens' texts, joined by one space; unknown ids are left out."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.read(path).text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shared.value
        for batch in batches:
            out = [" ".join([text[i] for i in ids if 0 <= i < len(text)]) if ids is not None else "" for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidied(run), "doc_id long, decoded string")


def _sha(parts: list[str]) -> str:
    return hashlib.sha256(" ".join(parts).encode()).hexdigest()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: hashes of the decimal ids and of the decoded text."""
    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda w: (sum(x[0] for x in w), _sha([x[1] for x in w]), _sha([x[2] for x in w])))
