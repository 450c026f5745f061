import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fabula.llm import bands, bpe, common, decontaminate, graph, html_text, langid, line_dedup, media, near_dup, pii, ppm, queries, toxicity
from fabula.llm.common import text_chunks

KIND = "doc_id long, text string, id string, key int"
ODD = [(1, None, "a", 1), (2, "", "b", 2), (3, "one two three four five six", None, None), (3, "one two three four five six", None, None), (None, "null id text", "c", 3), (4, "x" * 200_000, "d", 4)]
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


def test_odd_rows_and_empty_tables(spark, odd):
    bench = spark.createDataFrame([(1, None), (None, "x"), (2, "three four five six")], "item_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("id").alias("url"), F.col("text").alias("html"), "key")
    for rows in (odd, odd.limit(0)):
        n = rows.count()
        page = pages if n else pages.limit(0)
        assert html_text.main_text(page).count() == n
        assert decontaminate.decontaminate(rows, bench).count() <= n
        assert bpe.digests(rows, VOCABULARY).count() == n
        assert ppm.score(rows, F.coalesce(F.col("doc_id"), F.lit(0)) == 2).count() == n
        assert line_dedup.deduplicate(rows).count() == n
        assert toxicity.score(rows, toxicity.train(rows, labels, F.lit(True))).count() == n
        assert langid.predict(rows, langid.train(rows.withColumn("lang", F.lit("en")), F.lit(True))).count() == n
        assert near_dup.near_duplicates(rows).count() == n
        assert pii.find(rows).count() == n
        assert media.digests(media.encode(rows)).count() == n


def test_main_text():
    page = '<nav>m</nav><article><h1>T&amp;t</h1><p>a<b>b</b> c<div class="ad">buy</div><section id="comments">hi</section></article><footer>f</footer>'
    assert " ".join(t for t, k in html_text.blocks(page) if k == html_text.ARTICLE) == "T&t ab c"


def test_repeated_text_of_a_host_goes(spark):
    nav = "<div>Home About Us Contact Press Jobs Help Center</div>"
    rows = [(i, f"http://a.com/{i}", f"{nav}<p>word{i} other{i} stuff{i} here{i}") for i in range(4)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"word{i} other{i} stuff{i} here{i}" for i in range(4)}


def brute_main_text(rows):
    """Main texts of unmarked pages: tokens covered by a substring of DEPTH tokens or more that a page of other content on the host has go."""
    streams = {}
    for i, url, page in rows:
        blocks = html_text.blocks(page)
        tokens = [(w, k if kind == html_text.OPEN else None) for k, (t, kind) in enumerate(blocks) if kind != html_text.ARTICLE for w in t.split()]
        streams[i] = (url.split("/")[2], tuple(sorted(t for t, _ in blocks)), tokens)
    out = {}
    for i, (host, content, tokens) in streams.items():
        own, covered = [w.lower() for w, _ in tokens], set()
        for host_b, content_b, tokens_b in streams.values():
            if host_b == host and content_b != content:
                other = [w.lower() for w, _ in tokens_b]
                for a in range(len(own)):
                    for b in range(len(other)):
                        n = 0
                        while a + n < len(own) and b + n < len(other) and own[a + n] == other[b + n]:
                            n += 1
                        if n >= html_text.DEPTH:
                            covered.update(range(a, a + n))
        out[i] = " ".join(w for k, (w, block) in enumerate(tokens) if block is not None and k not in covered)
    return out


def test_repeats_of_random_hosts_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(html_text, "ARRAY_TOKENS", 60)
    r = random.Random(9)
    rows = []
    for i in range(40):
        parts = [" ".join(r.choice("abcd") for _ in range(r.randint(1, 14))) for _ in range(r.randint(0, 4))]
        rows.append((i, f"http://h{r.randint(0, 3)}.com/{i}", "".join(r.choice(["<div>{}</div>", "<p>{}", "<nav>{}</nav>"]).format(p) for p in parts)))
    rows += [(40 + i, url, page) for i, (_, url, page) in enumerate(rows[:5])]  # copies don't remove each other
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    assert {x["page_id"]: x["text"] for x in got} == brute_main_text(rows)


def test_new_numbers_and_names_are_found(spark):
    items = spark.createDataFrame([(1, "Tom has 5 apples and gives 3 apples to Anna. How many apples does Tom have after 2 days?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "we say that Maria has 7 apples and gives 4 apples to John. How many apples does Maria have after 9 days? yes"), (2, "nothing of the kind with 5 apples and 7 days at all")], "doc_id long, text string")
    assert [(r["doc_id"], r["template"]) for r in decontaminate.matches(docs, items).collect()] == [(1, True)]


def test_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary.read(VOCABULARY))
    r = random.Random(1)
    letters = "abcdeéÉßİΣσς'’stre lldvm  \u001c\u0085 \n\t12½²一가<|startoftext|> <|endoftext|>!?$…“😀Ａ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)] + ["<|endoftext|>a", "x" * 3000, "ab" * 2000, "ΑΣ ΑΣΑ", ""]
    for text, words in zip(texts, coder.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for w in words for i in w[1].split(" ")] == ids
        assert " ".join(w[2] for w in words) == library.decode(ids, skip_special_tokens=False)


def test_chances_after_a_context_sum_to_one():
    parts = list(ppm.word_parts(pa.array([b"the", b"then", b"a"], pa.binary()), np.array([5, 2, 3])))
    q, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    data = np.frombuffer(b"the the the the the then then a a a", np.uint8)
    root, times = ppm.root_counts(ppm.Text(data, np.array([0, len(data)])), np.array([True]))
    trie = ppm.Trie.build(np.r_[root, q], np.r_[times, n])
    symbols = np.array([*(s for s in range(256) if s not in (9, 11, 12, 13))])
    for past in (b"", b"ht", b"q", b" ", b"eht "):
        packed = sum(c << (40 - 8 * i) for i, c in enumerate(past))
        key = np.uint64((len(past) + 1) << 48 | packed)
        assert abs((10 ** trie.log_chance(np.full(len(symbols), key), np.full(len(symbols), len(past)), symbols)).sum() - 1) < 1e-9


def test_near_lines_go(spark):
    line = "the quick brown fox jumps over the lazy dog while the sun goes down behind the hills"
    docs = spark.createDataFrame([(1, f"{line}\nown words of the first text here"), (2, f"{line}!\nquite other words of the second text")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs).collect()}
    assert got == {1: f"{line}\nown words of the first text here", 2: "quite other words of the second text"}


def test_groups_are_those_of_sql(spark):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got = queries.op8_minhash_near_dedup(spark, folder).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert {tuple(r) for r in got} == set(c.execute(queries.OP8_SQL).fetchall())


def test_base_spans(spark):
    def brute(t):
        out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(x) for x in m[0] if x.isdigit()][::-1]
            if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
                out.append(("card", m))
        out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)

    r = random.Random(2)
    texts = ["".join(r.choice("aB1 2.-@é+()😀%_0 3") for _ in range(r.randint(0, 80))) for _ in range(600)] + ["4111 1111 1111 1111 a.b@c.de_d@e.fg 1.2.3.4.5 999.1.1.1"]
    got = pii.digests(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert all(x["base_sha256"] == hashlib.sha256(brute(texts[x["doc_id"]]).encode()).hexdigest() for x in got)


def test_films_go_round():
    r = random.Random(3)
    texts = ["", "x", "a" * 64, "b" * 65, "ÿ" * 5000] + ["".join(chr(r.randint(1, 0x2FF)) for _ in range(r.randint(0, 3000))) for _ in range(30)]
    for first, stop, data, offs in text_chunks(pa.array(texts)):
        for i, (samples, _) in enumerate(media.decode_films(media.encode_chunk(data, offs))):
            raw = texts[first + i].encode()
            assert samples.tobytes() == raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert media.decode_films([None, b"abc"]) == [None, None]


def test_languages_and_toxic_words_are_learnt(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op7_language_id(spark, folder).collect() if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = [(toxic[r["doc_id"]], r["predicted"]) for r in queries.op6_toxicity(spark, folder).collect() if r["doc_id"] in toxic and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(p for t, p in seen if t == 0) <= 2 and sum(p for t, p in seen if t) >= 0.7 * sum(t for t, _ in seen)


def brute_scores(train, times, held):
    """op4's model by its definition, one symbol after the other."""
    def symbols(text):
        words = text.lower().split()
        for j, w in enumerate([*words, None]):
            s = "\n" if w is None else w + " "
            before = " " + "".join(x + " " for x in words[:j])
            for i, c in enumerate(s):
                past = before + s[:i]
                yield past[-min(len(past), ppm.ORDER, i + 1 + ppm.TAIL) :] if i < ppm.HEAD else past[-ppm.ORDER :], c, i

    count = {}
    for text, n in zip(train, times, strict=True):
        for past, c, _ in symbols(text):
            for k in range(len(past) + 1):
                of = count.setdefault(past[len(past) - k :], {})
                of[c] = of.get(c, 0) + n

    def chance(past, c):
        p, out = 1.0, set()
        for k in range(len(past), -1, -1):
            of = count.get(past[len(past) - k :])
            if of:
                rest = sum(n for s, n in of.items() if s not in out) + sum(0.5 for s in of if s in out)
                if c in of:
                    return p * (of[c] - 0.5) / rest
                p *= 0.5 * len(of) / rest
                out = set(of)
        return p / (ppm.SYMBOLS - len(count.get("", {})))

    return [sum(np.log10(chance(past, c)) for past, c, _ in symbols(text)) for text in held]


@pytest.mark.parametrize("cached", [500_000, 20])
def test_lm_scores_are_those_of_the_whole_model(spark, monkeypatch, cached):
    monkeypatch.setattr(ppm, "CACHED", cached, raising=False)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 12)))
    rare = [" ".join(word() for _ in range(30)) for _ in range(3)]
    train, times = ["common words fill the corpus " * 40, *rare], [4000, 1, 1, 1]  # over 4 MB, where counts of one and two were dropped
    held = [rare[0], rare[1][5:60] + " " + word(), "", "common zq words", word()]
    rows = spark.range(4000).select((F.col("id") * 2).alias("doc_id"), F.lit(train[0]).alias("text"))
    rows = rows.unionAll(spark.createDataFrame([(10_000 + 2 * i, t) for i, t in enumerate(rare)] + [(2 * i + 1, t) for i, t in enumerate(held)], "doc_id long, text string"))
    got = {x["doc_id"]: x["score"] for x in ppm.score(rows, F.col("doc_id") % 2 == 1).where("held_out").collect()}
    assert [got[2 * i + 1] for i in range(len(held))] == pytest.approx(brute_scores(train, times, held), abs=1e-8)


def test_no_link_of_small_sets_is_missed():
    r = np.random.default_rng(5)
    lost = 0
    for m, most, of, empty in ((near_dup.M, near_dup.BANDS, near_dup.registers, near_dup.EMPTY), (line_dedup.M, line_dedup.BANDS, lambda h, rows, n: line_dedup.signatures(h, rows, n)[0], line_dedup.EMPTY)):
        top = int(bands.levels(m, most, 80)[-2][1])
        for a in range(1, top + 1):
            for b in range(a, min(top, a * 5 // 4) + 1):
                both = -(-4 * (a + b) // 9)
                if both > a:
                    continue
                for _ in range(40 if a < 20 else 4):
                    x = r.integers(0, 1 << 63, a + b - both).astype(np.uint64)
                    h, rows, n = np.r_[x[:a], x[a - both :]], np.r_[np.zeros(a, np.int64), np.ones(b, np.int64)], np.array([a, b])
                    regs = of(h, rows, 2)
                    at, key = (np.concatenate(v) for v in zip(bands.band_keys(regs, n, empty, most, 80), bands.first_elements(h, rows, bands.few_filled(regs, n, empty, most, 80), 80), strict=True))
                    lost += not len(np.intersect1d(key[at == 0], key[at == 1]))
    assert lost == 0


def test_short_near_duplicates_are_those_of_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):  # 8 and 7 words: 4 and 3 of 5 shingles; 4 of 5 is the limit
        words = [f"w{r.randrange(10**9)}" for _ in range(r.choice([8, 9, 13, 17]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1]))]
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    assert got == {i: i - 1 if i % 2 and 5 * len(sets[i] & sets[i - 1]) >= 4 * len(sets[i] | sets[i - 1]) else i for i in sets}


def test_a_text_of_very_many_lines_gets_all_its_keys():
    count = (1 << 17) + 50
    text = "\n".join(f"line {i * 7919 % 1_000_003} of a long text {i}" for i in range(count))
    run = line_dedup._lines(line_dedup.MIN_WORDS, 80)
    got = next(run(iter([pa.record_batch({"id": pa.array([1]), "text": pa.array([text])})])))
    lines = text.split("\n")
    sizes = [len({x[k : k + 8] for k in range(len(x) - 7)}) for x in lines]
    assert got.num_rows == count and got.column("n").to_pylist() == sizes
    last = next(run(iter([pa.record_batch({"id": pa.array([1]), "text": pa.array(["\n".join(lines[-40:])])})])))
    assert got.column("keys").to_pylist()[-40:] == last.column("keys").to_pylist()


def toxic_fixture(spark):
    terms = ["pathetic", "worthless", "disgusting", "stupid"]
    plain = [f"the house number{i} stands near the river and the old bridge" for i in range(300)]
    docs = [(i, f"{x} {terms[i % 4]}" if i < 100 else x) for i, x in enumerate(plain)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, toxic int")
    return terms, toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True))


def toxic_hits(words, m):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return toxicity.hits(toxicity.Runs(data, np.array([0, len(data)]), "alnum"), m)


def test_misspellings_of_all_lexicon_words_are_found(spark):
    terms, m = toxic_fixture(spark)
    words = [v for t in terms for i in range(len(t)) for v in (t[:i] + t[i + 1 :], t[:i] + "q" + t[i + 1 :], t[:i] + "q" + t[i:])]
    assert dict(zip(words, toxic_hits(words, m)[2] > 0)) == dict.fromkeys(words, True)
    twice = ["diqgustinq", "wqrthleqs", "dsgustin", "wworthlesss"]
    assert (toxic_hits(twice, m)[2] > 0).all()
    exact, stem, near = toxic_hits([*terms, "stupidity"], m)
    assert (exact[:4] > 0).all() and not near[:4].any() and exact[4] == 0 and stem[4] > 0
    far = ["the", "river", "qpathetiqqc", "stqqpid", "house", "wqrqhleqs"]
    assert not toxic_hits(far, m)[2].any() and not toxic_hits(far, m)[0].any()


def test_the_automaton_finds_what_edit_distance_says():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    terms = sorted({word(r.randint(2, 11)) for _ in range(30)})
    begins = sorted({word(4) for _ in range(8)})
    a = toxicity.Automaton(terms, begins, np.ones(len(terms)), np.arange(1.0, len(begins) + 1))
    asked = [word(r.randint(1, 13)) for _ in range(400)] + terms
    points = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in asked])
    ends = np.cumsum([len(w) for w in asked])
    state = a.run(points, ends - [len(w) for w in asked], ends)
    at, term = a.terms(state)
    assert set(zip(at.tolist(), term.tolist())) == {(i, k) for i, w in enumerate(asked) for k, t in enumerate(terms) if distance(t, w) <= toxicity.errors_allowed(t)}
    stem = [max((k + 1.0 for k, b in enumerate(begins) if w.startswith(b) and len(w) > 4), default=0.0) * (w not in terms) for w in asked]
    assert a.weights[state][:, 1].tolist() == stem


def test_quoted_terms_are_summed_apart(spark):
    _, m = toxic_fixture(spark)
    texts = ["you are worthless", 'they said "worthless" once', "nothing here", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    f = toxicity.features(data, np.cumsum([0, *map(len, texts)]), m, toxicity.Lookup(m.reports))
    assert f[0, 0] > 0 == f[0, 1] and f[1, 1] > 0 == f[1, 0] and not f[2:].any()


def test_keys_of_several_sets_are_found_in_eight_bytes_a_pair():
    r = np.random.default_rng(9)
    ids = r.integers(-(1 << 63), 1 << 63, 3000)
    keys = r.integers(0, 1 << 64, 9000, np.uint64)[r.integers(0, 9000, 12_000)] & np.uint64(0xFFFFFFFFFF000000)
    rows = np.r_[np.arange(3000), r.integers(0, 3000, 500)]  # some sets twice
    batch = pa.record_batch({"id": pa.array(ids[rows]), "keys": bands.packed(keys, np.arange(0, 12_001, 4)).take(pa.array(rows))})
    dealt = pa.Table.from_batches(bands._dealt(512)(iter([batch]))).sort_by("bucket").combine_chunks()
    got = np.concatenate([b.column("key").to_numpy() for b in bands._shared(512)(iter(dealt.to_batches()))]).view(np.uint64)
    of = {}
    for k, i in zip(keys.tolist(), np.repeat(ids, 4).tolist(), strict=True):
        of.setdefault(k, set()).add(i)
    assert sorted(got.tolist()) == sorted(k for k, v in of.items() if len(v) > 1)
    assert sum(map(len, dealt.column("rest").to_pylist())) == 8 * sum(min(2, len(v)) for v in of.values())


def test_further_links_unite_whole_components(spark):
    scratch, schema = common.Scratch(spark), "u long, v long"
    old, new = [(5, 2), (7, 5), (9, 8), (30, 31)], [(7, 9), (40, 41), (41, 30), (2, 5)]
    first = graph.components(spark.createDataFrame(old, schema), scratch)
    got = {tuple(x) for x in bands._joined(first, spark.createDataFrame(new, schema), scratch).collect()}
    assert got == {tuple(x) for x in graph.components(spark.createDataFrame(old + new, schema), scratch).collect()}


def test_only_texts_that_lose_lines_are_shuffled(spark):
    line = "the quick brown fox jumps over the lazy dog while the sun goes down behind the hills"
    rows = spark.createDataFrame([(1, line), (2, line), (None, line), *((i, f"own words {i * 7919} of text {i * 104729} alone") for i in range(3, 60))], "doc_id long, text string")
    gone = spark.createDataFrame([(2, [0])], "_id long, _gone array<int>")
    near, far = common.parted(rows, F.col("doc_id"), gone, "_id")
    assert [x["doc_id"] for x in near.collect()] == [2] and far.count() == 59
    plan = line_dedup.deduplicate(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    got = {x["doc_id"]: (x["text"], x["_lines"], x["_removed"]) for x in line_dedup.deduplicate(rows).collect()}
    assert got[1] == (line, 1, 0) and got[2] == ("", 1, 1) and got[None] == (line, 1, 0) and len(got) == 60
