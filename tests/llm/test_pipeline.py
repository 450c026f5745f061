"""Whole queries and pipeline stages against brute force on the smallest tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fabula.llm import bpe, langid, line_dedup, media, near_dup, queries, toxicity

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def groups(sets, percent=80):
    """The components of sets (a dict) linked by a Jaccard similarity, by an index of their elements."""
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = defaultdict(list)
    for k in sorted(sets):
        met = defaultdict(int)
        for x in sets[k]:
            for other in held[x]:
                met[other] += 1
            held[x].append(k)
        for other, both in met.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[other]) - both):
                a, b = sorted((root(k), root(other)))
                parent[b] = a
    return {k: root(k) for k in sets}


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]


def shingles(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(1, len(w))))}


def brute_lines(rows, percent=80, least=line_dedup.MIN_WORDS):
    """Each text without the lines that are not the first of their component."""
    sets, first = {}, {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if len(words_of(line)) >= least:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
                if line not in first or (i, k) < first[line]:
                    first[line] = (i, k)
                sets[line] = {low[j : j + line_dedup.WIDTH] for j in range(max(1, len(low) - line_dedup.WIDTH + 1))}
    of, keep = groups(sets), {}
    for line, root in of.items():
        keep[root] = min(keep.get(root, first[line]), first[line])
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if x not in of or keep[of[x]] == (i, k))
    return out


def test_lines_are_those_of_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs.select("doc_id", "text")).collect()}
    assert got == brute_lines(rows)


def test_lines_with_ties_repeats_and_chains(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    chain = [base.replace("one", x) for x in ("one", "onx", "oxx")] + [base + "!" * k for k in (1, 2)]
    rows = [(1, base), (2, f"short\n{base}\nshort"), (3, "\n".join(chain)), (4, None), (5, ""), (6, f"{base}\n{base}")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    got = {r["doc_id"]: (r["text"], r["_lines"], r["_removed"], r["h"]) for r in line_dedup.deduplicate(table).collect()}
    want = brute_lines(rows)
    assert {i: v[0] for i, v in got.items()} == want
    assert got[2] == ("short\nshort", 3, 1, "x") and got[4] == (None, 0, 0, "x") and got[5] == ("", 1, 0, "x")


@pytest.mark.parametrize("width", [4, 5])
def test_groups_are_those_of_brute_force(spark, docs, width):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: shingles(t, width) for i, t in rows.items()}
    of = groups({i: s for i, s in sets.items() if s})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, width).collect()}
    assert got == {i: (len(sets[i]), of.get(i, i), of.get(i, i) == i) for i in rows}


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "gamma alpha delta beta zeta epsilon"  # of one length
    table = spark.createDataFrame([(5, a), (5, b), (7, b), (3, a), (9, None), (9, "  "), (None, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table).collect())
    assert got == [(0, 2, None, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True), (9, 0, 9, True)]


def test_a_hot_passage_joins_nothing(spark):
    """Many texts share half their words; a few are near copies of each other."""
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"{common} " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 300, 50)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(300)}, **{1000 + i: i for i in range(0, 300, 50)}}


def test_digests_and_decoding_are_the_library_s(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rows = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = lambda ids: library.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, VOCABULARY).collect()}
    assert got == {i: (len(ids), sha(" ".join(map(str, ids))), sha(text(ids))) for i, ids in rows.items()}
    encoded = bpe.encode(docs, VOCABULARY)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == rows
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, VOCABULARY).collect()} == {i: text(ids) for i, ids in rows.items()}


def test_media_digests_are_those_of_the_payload(spark, docs):
    got = {r["doc_id"]: r for r in media.digests(media.encode(docs)).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got[r["doc_id"]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_languages_of_odd_texts(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    table = spark.createDataFrame([*rows, (90, None, "en"), (91, "123 !!", None), (92, "", "de"), (93, "zzzzqqq", None), (None, "the cat", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(table, langid.train(table, F.col("doc_id") < 20)).collect()}
    assert got[90] == ("und", 0) and got[91] == ("und", 0) and got[92] == ("und", 0) and got[None][0] == "en"
    assert all(got[i][0] == x for i, _, x in rows) and got[93][0] in ("de", "en")
    assert {r["lang_pred"] for r in langid.predict(table, langid.train(table, F.lit(False))).collect()} == {"und"}


def test_stages_keep_the_columns_and_what_brute_force_keeps(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = corpus_pipeline.reject_toxic(spark, docs, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.train(docs, labels, corpus_pipeline.crc_fold(F.col("doc_id"), 3) != 1)
    bad = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= queries.TOXIC}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(rows) - bad
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, FOLDER)
    assert lines.schema == docs.schema and {r["doc_id"]: r["text"] for r in lines.collect()} == brute_lines(list(rows.items()))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.where("text is not null").collect())
    of = groups({i: s for i, t in rows.items() if (s := shingles(t, 5))})
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, FOLDER)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in rows if of.get(i, i) == i}
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    held = {i for i, t in rows.items() if any(" ".join(words_of(b["text"])) in " ".join(words_of(t)) for b in bench)}
    left = {r["doc_id"] for r in corpus_pipeline.drop_benchmark_items(spark, docs, FOLDER).collect()}
    assert not held & left and len(left) >= len(rows) - 2 * len(held) - 2


def test_stages_take_odd_tables(spark):
    odd = [(1, None, "en", "s", 0, "x"), (2, "", None, None, 0, "y"), (2, "", None, None, 0, "y"), (None, "a text without an id of six words", "en", "s", 33, None), (3, "z" * 50_000, "en", "s", 50_000, "z")]
    table = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, h string")
    for rows in (table, table.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, rows, FOLDER)
            assert got.columns == rows.columns and sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
        assert corpus_pipeline.tokenize(spark, rows, FOLDER).count() == rows.count()


def test_the_whole_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert 0 < len(got) < 200 and all(r["n_tokens"] == len(r["ids"]) for r in got)
