"""Quality, manifest and vector codes against brute force, and their results for odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import merkle, quality, queries, vector_codes

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same_rows(got, cursor):
    columns = [x[0] for x in cursor.description]
    return sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, cursor.fetchall()))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_vector_codes"])
def test_rows_are_those_of_sql(spark, db, name):
    assert same_rows(queries.queries()[name](spark, FOLDER), db.execute(queries.oracle_sql()[name]))


# --- manifest ---------------------------------------------------------------------------

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
LEAF = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def climb(nodes, at, fan):
    """(root, steps before and after of the node at ``at``)."""
    proof = []
    while len(nodes) > 1:
        run = at - at % fan
        proof.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fan])))
        nodes, at = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)], at // fan
    return nodes[0], proof


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, pos int, digest string"


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest_of_odd_rows(spark, monkeypatch, fan):
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = [(i, "s", ["en", None, "é", "de"][i % 7 % 4], i, f"text {i}") for i in range(60)]
    rows += [(None, None, None, None, None), (3, "s", "xx", 1, ""), (3, "s", "en", None, None), (3, "s", "en", None, None), (2**63 - 1, "ü", "én", 2**63 - 1, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], DOCS).repartition(5)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    got = merkle.manifest(docs, fields, F.col("lang"), F.col("doc_id")).withColumn("f", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(((r[0] is not None, r[0] or 0), LEAF(r)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {t: [h for _, h in sorted(trees[t])] for t in names}
    subroots = [climb(leaves[t], 0, fan)[0] for t in names]
    want = []
    for k, t in enumerate(names):
        root, upper = climb(subroots, k, fan)
        want += [(h, subroots[k], root, climb(leaves[t], i, fan)[1] + upper) for i, h in enumerate(leaves[t])]
    seen = [(r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), [(s["before"].hex(), s["after"].hex()) for s in r["proof"]]) for r in got]
    assert sorted(seen) == sorted(want) and all(r["f"] == r["root"].hex() for r in got)


def test_manifests_of_nothing_and_of_one_row(spark):
    docs = spark.createDataFrame([(7, None)], "doc_id long, text string")
    make = lambda rows: merkle.manifest(rows, [F.col("doc_id"), F.col("text")], F.col("text"), F.col("doc_id"))
    assert make(docs.limit(0)).collect() == []
    only = make(docs).first()
    assert only["leaf"] == only["root"] == only["subroot"] and only["proof"] == [] and only["leaf"].hex() == H("1:7-")


def test_what_is_changed_is_seen(spark):
    got = queries.op12_merkle_manifest(spark, FOLDER).collect()
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in got)


# --- vector codes -----------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """(codes, errors, codebooks) by Python's integers and all distances."""
    whole = [[int(np.float64(x).as_integer_ratio()[0] * 256 // np.float64(x).as_integer_ratio()[1]) for x in v] for v in rows]
    width = len(whole[0]) // parts
    cut = [[v[k * width : (k + 1) * width] for v in whole] for k in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for n in range(rounds + 1):
        found = [[nearest(x, books[k]) for x in cut[k]] for k in range(parts)]
        if n < rounds:
            for k in range(parts):
                for e in range(len(books[k])):
                    if own := [x for x, (_, i) in zip(cut[k], found[k], strict=True) if i == e]:
                        books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [[found[k][i][1] for k in range(parts)] for i in range(len(rows))], [sum(found[k][i][0] for k in range(parts)) for i in range(len(rows))], books


@pytest.mark.parametrize(("kind", "scale"), [("float", 1.0), ("double", 1e15)])
def test_codes_are_those_of_all_distances(spark, kind, scale):
    r = np.random.default_rng(1)
    vectors = [[float(np.float32(x)) for x in v] for v in np.r_[r.normal(0, scale, (150, 8)), np.round(r.normal(0, 2, (80, 8))) / 256, np.zeros((30, 8))]]
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [float("-inf")] + [0.0] * 7, 1), (903, [None] + [0.0] * 7, 1)]
    odd = [(950, [1.0], 2), (951, [], None)]
    df = spark.createDataFrame(rows + bad + odd, f"vec_id long, vector array<{kind}>, label int").repartition(6)
    coded, books = vector_codes.encode(df, parts=4, entries=20, rounds=2)
    codes, errors, want = brute_codes(vectors, 4, 20, 2)
    assert [[[int(x) for x in e] for e in b] for b in books] == want
    got = {x["vec_id"]: x for x in vector_codes.digests(coded, books).collect()}
    assert sorted(got) == [*range(len(rows)), 950, 951] and got[950]["code"] is None and got[951]["error"] is None
    fits = lambda v: v if v < 1 << 63 else None
    for i, (c, e) in enumerate(zip(codes, errors, strict=True)):
        assert (got[i]["code"], got[i]["error"]) == ("".join(f"{x:02x}" for x in c), fits(e))
    if scale == 1.0:
        of = defaultdict(int)
        for i, e in enumerate(errors):
            of[rows[i][2]] += e
        assert all(got[i]["label_error"] == of[rows[i][2]] for i in range(len(rows)))
    text = ",".join(str(v) for b in want for e in b for v in e)
    assert {x["codebooks_sha256"] for x in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}


def test_few_vectors_repeated_ids_and_none(spark):
    df = spark.createDataFrame([(1, [0.5, -0.25], 1, "x"), (1, [0.5, -0.25], 1, "y"), (None, [9.0, 9.0], None, "z")], "vec_id long, vector array<double>, label int, code string")
    coded, books = vector_codes.encode(df, parts=2)
    assert sorted((x["vec_id"] or 0, x["code"], x["error"]) for x in vector_codes.digests(coded, books).collect()) == [(0, "0000", 0), (1, "0101", 0), (1, "0101", 0)]
    assert vector_codes.digests(*vector_codes.encode(df.limit(0))).collect() == []


def test_only_neighbours_within_reach_are_needed():
    r = np.random.default_rng(2)
    book = vector_codes.Codebook(r.integers(-50, 50, (64, 4)))
    x = r.integers(-60, 60, (4000, 4))
    d = vector_codes.squares(x[:, None, :], book.entries[None, :, :])
    for start in (np.zeros(4000, np.int64), r.integers(0, 64, 4000)):
        at, best = book.nearest(x, start)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


# --- quality ----------------------------------------------------------------------------


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def brute_kept(rows):
    """doc_id -> (distance, kept) by the definition, group after group, all in memory."""
    c = {i: brute_counts(t) for i, _, _, t in rows}
    failed = {i: x[0] < 50 or 100 * x[4] > 50 * x[0] for i, x in c.items()}
    v = {i: quality.vectors(np.array([[x[0], x[1], x[2], x[5], x[3], x[4]]]))[0] for i, x in c.items()}
    groups = defaultdict(list)
    for i, lang, source, _ in rows:
        if not failed[i]:
            groups[lang, source].append(i)
    small = defaultdict(list)
    for key in [k for k, x in groups.items() if len(x) < quality.LEAST]:
        small[key[0]] += groups.pop(key)
    rest = [i for x in small.values() if len(x) < quality.LEAST for i in x]
    sets = [*groups.values(), *(x for x in small.values() if len(x) >= quality.LEAST), *([rest] if len(rest) >= quality.LEAST else [])]
    out = {i: (None, not failed[i]) for i, *_ in rows}
    for ids in sets:
        x = np.array([v[i] for i in ids], float)
        for i, d in zip(ids, robust_distances(x), strict=True):
            out[i] = (d, d <= quality.CUTOFF)
    return out


def robust_distances(x):
    n, p = x.shape
    floor = np.diag(quality.FLOOR**2)
    klass = lambda d: np.floor(np.log2(np.maximum(d, 2.0**-20)) * quality.CLASSES)
    away = lambda m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    nearer_half = lambda d: klass(d) <= np.sort(klass(d))[(n + p + 1) // 2 - 1]
    low = lambda a: np.sort(a, axis=0)[(n + 1) // 2 - 1]
    middle = low(x)
    unit = 1.4826 * low(np.abs(x - middle)) + quality.FLOOR
    u = (x - middle) / unit
    length = np.sqrt((u**2).sum(axis=1, keepdims=True))
    u = np.round(np.where(length > 0, u / np.where(length > 0, length, 1), 0) * 1e6)
    starts = [(middle, np.diag(unit**2)), (middle, np.outer(unit, unit) * (u.T @ u / n / 1e12) * p + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)]
    found = []
    for m, s in starts:
        for _ in range(quality.STEPS):
            half = x[nearer_half(away(m, s))]
            m, s = half.mean(0), np.cov(half.T, bias=True) + floor
        found.append((np.linalg.slogdet(s)[1], m, s))
    _, m, s = min(found, key=lambda f: f[0])
    scale = lambda d: 2 ** ((klass(d)[nearer_half(d)].max() + 0.5) / quality.CLASSES) / quality.MEDIAN
    d = away(m, s)
    inner = x[d / scale(d) <= quality.REWEIGHT]
    d = away(inner.mean(0), np.cov(inner.T, bias=True) + floor)
    return d / scale(d)


def test_outliers_are_those_of_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "lang", "source", "text").collect()]
    rows = [(i, lang, "s" if i % 3 else source, t) for i, lang, source, t in rows]  # large and small sources
    rows += [(5000 + i, None, None, t + f" word{i} " + ("## " * 400 if i % 50 == 0 else "")) for i, (_, _, _, t) in enumerate(rows[:120])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r for r in quality.assess(df.repartition(7)).collect()}
    want = brute_kept(rows)
    for i, (d, kept) in want.items():
        assert got[i]["kept"] == kept and (got[i]["distance"] is None) == (d is None)
        assert d is None or abs(got[i]["distance"] - d) <= 1e-3 * max(1, d)
    assert not any(got[5000 + i]["kept"] for i in range(0, 120, 50)) and sum(k for _, k in want.values()) > 0.7 * len(rows)
    for i, _, _, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t)[:5]


def test_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "é# é#\né# é#\n\né# é#", "x\n x\nx\r\nx", "w " * 200_000, "one", "\n".join(f"l{i}" for i in range(140_000))]
    df = spark.createDataFrame([(i, "v", None, t, 1) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string, v0 int")
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    for i, t in enumerate(texts):
        r, c = got[i], brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c[:5]
        assert r["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and r["kept"] == (not r["base_failed"])
    assert quality.assess(df.limit(0)).collect() == []
