"""Languages, benchmark items, films and odd rows against plain definitions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import bpe, decontaminate, html_text, langid, media, pii, ppm, quality, toxicity

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


# --- languages ---------------------------------------------------------------------------


def words_of(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def grams(word, n):
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def brute_language(train, text):
    """(language, score) by counts in dicts."""
    langs = sorted({lang for _, lang in train})
    words = words_of(text)
    if not words:
        return "und", 0.0
    tables = []
    for n in (0, *langid.ORDERS):
        count = {}
        for t, lang in train:
            for w in words_of(t):
                for g in [w] if n == 0 else grams(w, n):
                    count.setdefault(g, Counter())[lang] += 1
        total = {x: sum(c[x] for c in count.values()) + 0.1 * (len(count) + 1) for x in langs}
        tables.append({g: np.array([np.log((c[x] + 0.1) / total[x]) for x in langs]) for g, c in count.items()})
    sums = np.zeros(len(langs))
    for w in words:
        if w in tables[0]:
            sums += tables[0][w]
            continue
        for table, n in zip(tables[1:], langid.ORDERS, strict=True):
            known = [table[g] for g in grams(w, n) if g in table]
            if known:
                sums += np.mean(known, axis=0)
                break
    mean = sums / len(words) * min(len(words), langid.SCORE_WORDS)
    e = np.exp(mean - mean.max())
    return langs[int(sums.argmax())], e.max() / e.sum()


def test_languages_are_those_of_plain_counts(spark):
    r = random.Random(1)
    speak = {"aa": "abcde", "bb": "bcdfgé", "cc": "aefghü"}
    say = lambda lang: " ".join("".join(r.choice(speak[lang]) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 12)))
    train = [(say(lang), lang) for lang in speak for _ in range(15)]
    asked = [say(lang) for lang in speak for _ in range(15)] + ["", "12 !", "Zzz qqq", "ABC abc", None]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(train)] + [(900, None, "aa"), (901, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    got = {x["doc_id"]: x for x in langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(asked):
        lang, score = brute_language(train, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4


# --- benchmark items ----------------------------------------------------------------------


def brute_matches(docs, items):
    """{(doc, item): covered} of plain lower-case words: on each diagonal the item's tokens within runs of WIDTH equal ones."""
    out = {}
    for d, a in docs:
        for k, b in items:
            x, y = a.split(), b.split()
            width = min(decontaminate.WIDTH, len(y))
            if len(y) < decontaminate.WIDTH and len(x) != len(y):
                continue  # a short item is only found as a whole text
            best = 0
            for shift in range(-len(y), len(x)):
                covered = set()
                for j in range(len(y) - width + 1):
                    if 0 <= j + shift <= len(x) - width and x[j + shift : j + shift + width] == y[j : j + width]:
                        covered.update(range(j, j + width))
                best = max(best, len(covered))
            if best and (best >= decontaminate.SHARE * len(y) or best >= decontaminate.LONG):
                out[d, k] = best
    return out


def test_items_are_those_of_all_diagonals(spark):
    r = random.Random(2)
    word = lambda: "w" + "".join(r.choice("abcd") for _ in range(2))
    items = [(k, " ".join(word() for _ in range(r.randint(3, 40)))) for k in range(25)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(r.randint(0, 30))]
        own = r.choice(items)[1].split()
        if d % 3:
            own = [w if r.random() < 0.97 else word() for w in own[: r.randint(1, len(own))]]
            at = r.randint(0, len(text))
            text[at:at] = own
        docs.append((d, " ".join(text if d % 7 else own)))
    docs += [(59, docs[59][1])]  # a repeated row counts once
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["covered"] for x in got} == brute_matches(docs, items) and not any(x["template"] for x in got)
    assert len(got) > 10


# --- films --------------------------------------------------------------------------------


def brute_shots(frames):
    hist = [[Counter(x >> 3 for x in f)[b] / max(len(f), 1) for b in range(media.BINS)] for f in frames]
    cuts, since = [0], 0
    change = [sum(abs(a - b) for a, b in zip(hist[i], hist[i + 1], strict=True)) / 2 for i in range(len(frames) - 1)]
    for i, c in enumerate(change):
        past = change[max(since, i - media.MEMORY) : i]
        mean = sum(past) / len(past) if past else 0
        most = max(media.FLOOR, mean + media.DEVIATIONS * (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5) if past else 2 * media.FLOOR
        if c > most + 1e-12:
            cuts.append(i + 1)
            since = i + 1
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(frames)], strict=True)]


def test_shots_and_clips_are_those_of_plain_histograms(spark):
    r = random.Random(3)
    scene = lambda: [r.randrange(256) for _ in range(r.randint(2, 6))]
    for _ in range(20):
        frames = [[r.choice(s) for _ in range(128)] for s in (scene() for _ in range(4)) for _ in range(r.randint(1, 9))]
        samples = np.array([x for f in frames for x in f], np.uint8)
        assert media.shots(samples, [len(f) for f in frames]) == brute_shots(frames)
    texts = ["a" * 9000 + "Ж" * 9000 + "0123456789" * 900, "short", "", None]
    films = media.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stored = {x["doc_id"]: bytes(x["media"]) for x in films.collect()}
    clips = {}
    for x in media.clips(films).collect():
        clips.setdefault(x["doc_id"], []).append((x["clip"], x["first_frame"], x["last_frame"], x["start_ms"], x["end_ms"]))
    for x in media.digests(films).collect():
        raw = (texts[x["doc_id"]] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        (samples, sizes), film = media.decode_films([stored[x["doc_id"]]])[0], stored[x["doc_id"]]
        want = media.shots(samples, sizes)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(film), hashlib.sha256(film).hexdigest())
        assert x["feature"] == f"frames={len(sizes)};shots=" + ",".join(f"{a}-{b}" for a, b in want)
        assert sorted(clips[x["doc_id"]]) == [(k, a, b, a * 1000 // media.RATE, (b + 1) * 1000 // media.RATE) for k, (a, b) in enumerate(want)]


# --- odd rows -----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["html", "bpe", "lm", "toxicity", "language", "pii", "media", "quality"])
def test_null_texts_are_empty_ones_and_repeated_rows_are_alike(spark, name):
    rows = [(1, None, "a"), (2, "", "b"), (3, "call +380 44 123 45 67 or a@b.cd, pathetic word", None), (3, "call +380 44 123 45 67 or a@b.cd, pathetic word", None), (None, "null id, text", "c"), (4, "long " * 50_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    run = {
        "html": lambda: html_text.main_text(docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
        "bpe": lambda: bpe.digests(docs, VOCABULARY),
        "lm": lambda: ppm.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) == 2).drop("held_out"),
        "toxicity": lambda: toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))),
        "language": lambda: langid.predict(docs, langid.train(docs.withColumn("lang", F.lit("xx")), F.lit(True))),
        "pii": lambda: pii.digests(pii.find(docs)),
        "media": lambda: media.digests(media.encode(docs)),
        "quality": lambda: quality.assess(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})),
    }[name]()
    got = {}
    for x in run.collect():
        got.setdefault(x["doc_id"], []).append(tuple(v for k, v in x.asDict().items() if k != "doc_id"))
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 2, None: 1, 4: 1}
    assert got[1] == got[2] and got[3][0] == got[3][1]


def test_counts_of_short_contexts_and_distinct_words():
    """Against a loop over texts; what only a text's heads need is not made for counts."""
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("abЇ  \n"), r.integers(0, 12))) for _ in range(60)] + ["", " ", "a"]
    train = r.random(len(texts)) < 0.6
    raw = [t.encode() for t in texts]
    text = ppm.Text(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    q, n = ppm.root_counts(text, train)
    assert "heads" not in vars(text)
    want = Counter()
    for t, learnt in zip(raw, train, strict=True):
        s = b" " + b"".join(w + b" " for w in t.split()) + b"\n"
        for i in range(1, len(s)):
            for order in range(min(i, ppm.ROOT - 1) + 1):
                packed = sum(s[i - j] << (48 - 8 * j) for j in range(1, order + 1))
                want[(order + 1) << 56 | s[i] << 48 | packed] += int(learnt)
    assert dict(zip(q.tolist(), n.tolist(), strict=True)) == {k: v for k, v in want.items() if v}
    h = r.integers(0, 50, 400).astype(np.uint64)
    values, where, back = ppm.distinct(h)
    assert values.tolist() == sorted(set(h.tolist())) and (h[where] == values).all() and (values[back] == h).all()
