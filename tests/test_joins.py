"""Joins that are not on equal keys, rows in order on tables and streams, legends of any shape and sound rules, against brute force."""

import json
import random
import re
import time
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fabula.operators import chunks, effects, folds, joins, legend, mentions, split_merge
from fabula.plans import attribution_plan
from fabula.sources import text as sources
from fabula.streaming import utterances as U


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_names_within_some_edits_are_those_of_brute_force(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    names, forms = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    left = spark.createDataFrame([(n, 1) for n in [*names, names[0], None]], "name string, distance int")
    right = spark.createDataFrame([(f,) for f in [*forms, None]], "form string")
    for most in (1, 2):
        got = {tuple(x) for x in joins.fuzzy_join(left, right, most).collect()}
        assert got == {(a, b, edits(a, b)) for a in names for b in forms if edits(a, b) <= (most if len(a) >= joins.TWO_EDITS else 1)}
    assert joins.fuzzy_join(left.limit(0), right).count() == 0


def test_the_nearest_earlier_row_is_that_of_brute_force(spark):
    r = random.Random(2)
    rows = [(d, i, r.choice("FM"), r.choice(["#g2", "#g3", None])) for d in range(5) for i in range(60) if r.random() < 0.6]
    asked = [(d, i, r.choice("FM"), f"x{i}") for d in range(5) for i in range(0, 60, 3)]
    got = joins.nearest_earlier(spark.createDataFrame(asked, "doc_id int, line_no int, g string, note string"), spark.createDataFrame(rows, "doc_id int, line_no int, g string, gid string"), ["g"], 4, "gid").collect()
    for x in got:
        near = max(((i, v) for d, i, g, v in rows if d == x["doc_id"] and g == x["g"] and i < x["line_no"] and v), default=None)
        assert (x["at"], x["gid"]) == (near if near and x["line_no"] - near[0] <= 4 else (None, None)) and x["note"] == f"x{x['line_no']}"
    assert len(got) == len(asked)


def test_lines_within_spans_are_those_of_brute_force(spark):
    r = random.Random(3)
    lines = [(d, i) for d in range(3) for i in range(200)]
    spans = [(d, a, a + r.randint(-2, 90), f"s{k}") for k in range(30) for d, a in [(r.randrange(4), r.randrange(180))]]
    got = joins.within_spans(spark.createDataFrame(lines, "doc_id int, line_no int"), spark.createDataFrame(spans, "doc_id int, start_line int, end_line int, label string"), bin_size=16)
    want = sorted((d, i, s) for d, i in lines for e, a, b, s in spans if d == e and a <= i <= b)
    assert sorted((x["doc_id"], x["line_no"], x["label"]) for x in got.collect()) == want


def test_mentions_of_each_document_s_own_names(spark):
    texts = spark.createDataFrame([(1, 0, "Тато і маленька Мама, мамин тато"), (2, 0, "Тато"), (1, 1, None), (3, 0, "x")], "doc_id long, line_no int, text string")
    names = spark.createDataFrame([(1, "тато", "#g3"), (1, "мама", "#g2"), (1, "маленька мама", "#g4"), (2, "інший", "#g5"), (1, "", "#g6")], "doc_id long, alias string, gid string")
    got = sorted(tuple(x) for x in mentions.mentions(texts, names).collect())
    assert got == [(1, 0, 0, 4, "тато", "#g3"), (1, 0, 7, 20, "маленька мама", "#g4"), (1, 0, 28, 32, "тато", "#g3")]
    assert mentions.mentions(texts.limit(0), names).count() == 0


def test_legends_of_any_shape(spark):
    rows = {
        1: json.dumps({"#g2": {"names": ["Мама", ""], "aliases": ["мати"], "gender": "F"}, "#g3": {"names": None, "gender": "x"}, "#g4": 7}),
        2: json.dumps({"#g2": ["Мама", None, "Ма"], "#g3": "Тато"}),
        3: json.dumps({"gid_to_names": {"#g1": ["Хтось"], "#g2": []}, "narrator_gid": "#g1", "name_to_gid": {}}),
        4: "#g2 - Мама, мила (дівчинка; онучка, мама)\nслова\n#G3: Тато (m)\n#g2: Мати (жінка)",
        5: "[1, 2]", 6: "", 7: None,
    }
    got = legend.legend_records(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    want = [
        (1, "#g2", ["Мама"], ["мати"], "F"), (1, "#g3", [], [], None), (1, "#g4", [], [], None),
        (2, "#g2", ["Мама", "Ма"], [], None), (2, "#g3", ["Тато"], [], None),
        (3, "#g1", ["Хтось"], ["наратив", "оповідач", "оповідачка"], None), (3, "#g2", [], [], None),
        (4, "#G3", ["Тато"], ["m"], "M"), (4, "#g2", ["Мама", "Мати"], ["дівчинка", "онучка", "жінка"], None),
    ]
    assert sorted(tuple(x) for x in got.collect()) == want


def test_sound_rules_of_both_forms(spark):
    text = """
structural:
  - {tag: "#r", keywords: '^\\s*ГЛАВА\\b.*$', flags: MULTILINE|IGNORECASE, post_tag: "#p2", position: precede_line, confidence: 1.0}
actions:
  - {tag: "#x", keywords: 'грім', flags: IGNORECASE, position: after_match}
  - {tag: "#y", pattern: '(', position: after_match}
  - {tag: "#z", keywords: 'a', position: nowhere}
  - {keywords: 'b', position: after_match}
"""
    rules, dropped = effects.checked_rules(text)
    assert [r[0] for r in rules] == ["#r", "#x"] and [d[0] for d in dropped] == ["#y", "#z", "None"]
    assert effects.tag_text("Глава 1\nБув Грім. Далі.", rules)[0] == "#r\nГлава 1\n#p2\nБув Грім.\n#x\n Далі.\n"


def test_sounds_of_a_table_are_those_of_each_text(spark):
    r = random.Random(4)
    parts = ["Падає дощ", "Хтось відчинив двері.", "багаття", "\n\n", "\n", " ", "Глава 2", "word  word", " .", "#rain", "ГЛАВА 3\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)] + [None, ""]
    got = {x["doc_id"]: x for x in effects.tag_sounds(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = effects.tag_text(t or "", effects.default_rules())
        assert (got[i]["text"], got[i]["n_tags"]) == (want if t else ("", 0))


def test_chunks_go_through_a_function_and_back(spark):
    r = random.Random(8)
    sentence = lambda: "".join(r.choice("аб в") for _ in range(r.randint(1, 30))).strip() + r.choice(".!?")
    texts = {i: "".join(sentence() + r.choice([" ", "\n", "  "]) for _ in range(r.randint(0, 40))) for i in range(40)} | {90: None, 91: ""}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id int, text string, made string")
    got = {x["doc_id"]: x["text"] for x in chunks.two_stages(docs, lambda ts: [t + "+" for t in ts], lambda ts: [t.upper() for t in ts], most=50, batch=7).collect()}

    def cut(text):
        out = []
        for s in [p for p in re.split(r"(?<=[.!?])\s+|\n+", text or "") if p]:
            if out and len(out[-1]) + 1 + len(s) <= 50:
                out[-1] += " " + s
            else:
                out.append(s)
        return out

    assert got == {i: " ".join(c.upper() for c in cut(" ".join(c + "+" for c in cut(t)))) for i, t in texts.items()}
    with pytest.raises(Exception, match="0 texts for"):
        chunks.map_chunks(docs, lambda ts: []).collect()


def test_results_with_foreign_letters_are_made_again():
    f = chunks.retried(lambda ts: [t + "ыы" if "a" in t else t for t in ts], lambda ts: [t + ("ы" if "b" in t else "эээ") for t in ts])
    assert f(["x", "ab", "ac"]) == ["x", "abы", "acыы"] and f([]) == []


def test_files_are_written_as_they_were_read(spark, tmp_path):
    files = {"a.txt": b"\xef\xbb\xbf\xd1\x82\r\n\xd0\xba\n", "b.txt": "так\rні".encode("cp1251"), "c.txt": "\ufeffї\n".encode("utf-16-le"), "d.txt": "\ufeffї".encode("utf-16-be"), "f.txt": "ok\n".encode()}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    read = sources.read_encoded(spark, f"{tmp_path}/in").repartition(3)
    out = tmp_path / "out"
    sources.write_encoded(read, str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir()} == files  # and nothing temporary is left
    with pytest.raises(Exception, match="there already"):
        sources.write_encoded(read.limit(1), str(out))
    edited = read.withColumn("text", sources.with_line_ends(F.concat("text", F.lit("\n!")), F.col("eol")))
    sources.write_encoded(edited.where("path like '%a.txt' or path like '%b.txt'"), str(out), overwrite=True)
    assert (out / "a.txt").read_bytes() == b"\xef\xbb\xbf\xd1\x82\r\n\xd0\xba\r\n\r\n!" and (out / "b.txt").read_bytes() == "так\rні\r!".encode("cp1251")
    with pytest.raises(Exception, match="no name"):
        sources.write_encoded(read.withColumn("name", F.lit("")).unionByName(read.withColumn("name", F.lit("z"))).repartition(1), str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted(files)


# --- rows in order -----------------------------------------------------------------------------


def stream_of(spark, rows, folder, name, late):
    """``rows`` as a stream of several files, not in the order of time, and what comes of it."""
    table = spark.createDataFrame(rows, "stream_id string, ts timestamp, event_id long, volume double, paused boolean")
    for k in range(5):  # the last file moves event time on
        table.where((F.col("event_id") % 4 == k) & (F.col("event_id") < 1000) | (F.lit(k) == 4) & (F.col("event_id") >= 1000)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return table, stream


def results(spark, made, folder, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name)


@pytest.fixture(scope="module")
def signals():
    r = random.Random(6)
    rows = [(f"s{r.randrange(3)}", pd.Timestamp(1_700_000_000_000 + r.randrange(60_000), unit="ms").to_pydatetime(), i, r.choice([0.0, 0.02, 0.5]), None) for i in range(400)]
    end = [(f"s{k}", pd.Timestamp(1_700_000_900_000, unit="ms").to_pydatetime(), 1000 + k, 0.1, None) for k in range(3)]  # event time goes on, so that all others are past
    return rows, end


def brute_cooled(rows):
    out, last = [], {}
    for s, ts, i, *_ in sorted(rows, key=lambda x: (x[0], x[1], str(x[2]))):
        if s not in last or (ts - last[s]).total_seconds() >= 1:
            last[s] = ts
            out.append(i)
    return sorted(out)


def test_commands_cool_down_on_tables_and_streams(spark, tmp_path, signals):
    rows, end = signals
    table, stream = stream_of(spark, rows + end, tmp_path, "cooled", "2 minutes")
    ids = sorted(x["event_id"] for x in U.cooled(table.where("event_id < 1000")).collect())
    assert ids == brute_cooled(rows)
    got = results(spark, U.cooled(stream, late="2 minutes"), tmp_path, "cooled")
    assert sorted(x["event_id"] for x in got.where("event_id < 1000").collect()) == ids


def test_chunks_pass_while_their_stream_runs(spark, tmp_path, signals):
    rows, end = signals
    rows = [(s, t, i, v, (i % 20 == 0) if i % 10 == 0 else None) for s, t, i, v, _ in rows]
    table, stream = stream_of(spark, rows + end, tmp_path, "running", "2 minutes")
    split = lambda t: (t.where("paused is null").select("stream_id", "ts", "event_id"), t.where("paused is not null").select("stream_id", "ts", "paused"))
    want = sorted(x["event_id"] for x in U.while_running(*split(table)).where("event_id < 1000").collect())
    got = results(spark, U.while_running(*split(stream), late="2 minutes"), tmp_path, "running")
    assert sorted(x["event_id"] for x in got.where("event_id < 1000").collect()) == want and 0 < len(want) < 360


def test_gain_and_cache_are_the_same_on_streams(spark, tmp_path, signals):
    rows, end = signals
    table, stream = stream_of(spark, rows + end, tmp_path, "gain", "2 minutes")
    past = pd.Timestamp(1_700_000_800_000, unit="ms").to_pydatetime()
    loud = lambda t: t.select("stream_id", "ts", "volume")
    seen = lambda t: sorted((x["stream_id"], x["ts"], round(x["gain"], 9)) for x in t.where(F.col("ts") < F.lit(past)).collect())
    assert seen(results(spark, U.gains(loud(stream), late="2 minutes"), tmp_path, "gain")) == seen(U.gains(loud(table)))
    asked = lambda t: t.select(F.concat(F.lit(" K"), "stream_id").alias("key"), "ts")
    hits = lambda t: sorted((x["key"], x["ts"], x["hit"]) for x in t.where(F.col("ts") < F.lit(past)).collect())
    assert hits(results(spark, U.cache_hits(asked(stream), hours=0.0003, late="2 minutes"), tmp_path, "cache")) == hits(U.cache_hits(asked(table), hours=0.0003))


def test_words_one_edit_apart_without_a_broadcast(spark):
    """All pairs of short words against the distance itself, each once; no side goes through the driver, however small it looks."""
    from itertools import product

    words = ["".join(w) for n in range(4) for w in product("ab", repeat=n)] + ["bcd", "bd", "xbcdy", "xbcy"]
    names, forms = (spark.createDataFrame([(w,) for w in [*ws, None, ws[-1]]], f"{c} string") for c, ws in (("name", words), ("form", words[::-1])))
    plan = joins.fuzzy_join(names, forms, most=1)
    got = sorted((r["name"], r["form"], r["distance"]) for r in plan.collect())
    near = spark.createDataFrame(list(product(words, words)), "name string, form string").withColumn("d", F.levenshtein("name", "form")).where("d <= 1")
    assert got == sorted((r["name"], r["form"], r["d"]) for r in near.collect())
    for most in (1, 2):
        rows = joins.fuzzy_join(names, forms, most)._jdf.queryExecution()
        assert "BroadcastHashJoin" not in rows.executedPlan().toString() and "SortMergeJoin" in rows.executedPlan().toString()


def test_best_products_pair_no_vectors_on_disk(spark, monkeypatch):
    """Nulls, NaN, vectors of other lengths and none, over many groups, against sums of pairs; the plan joins no vectors."""
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([None, rnd.uniform(-1, 1), rnd.uniform(-1, 1)]) for _ in range(rnd.choice([3, 5, 8]))], rnd.choice([None, 1, 2, 3])) for i in range(300)]
    rows[7], rows[20], rows[40], rows[100] = (7, None, 1), (20, [], 2), (40, [None, None, None], 3), (100, [0.5, float("nan"), 1.0], 2)
    table = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    monkeypatch.setattr(joins, "GROUP", 200)  # forty groups or so
    plan = joins.best_products(table.where("id % 10 = 0").drop("label"), table)
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["label"]): r["score"] for r in plan.collect()}
    part = table.select("id", "label", F.posexplode("vector").alias("k", "x"))
    asked = part.where("id % 10 = 0").select(F.col("id").alias("a"), "k", F.col("x").alias("y"))
    pairs = part.join(asked, "k").where("id <> a").groupBy("a", "id", "label").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("s"))
    want = {(r["a"], r["label"]): r["s"] for r in pairs.groupBy("a", "label").agg(F.max("s").alias("s")).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k], nan_ok=True) if want[k] is not None else got[k] is None for k in want)


def test_best_tag_of_scores(spark):
    from fabula.operators import speaker_model

    rows = [(1, None, 3.0), (1, "#g1", 2.0), (2, "#g2", float("nan")), (2, "#g1", 9.0), (3, "#g5", None), (3, "#g1", 0.1), (4, None, 1.0), (5, "#g2", 1.0), (5, "#g1", 1.0)]
    got = {r["id"]: r["decision"] for r in speaker_model.best_by_text(spark.createDataFrame(rows, "id long, gid string, score double"), 0.05).collect()}
    assert got == {1: "#g1", 2: "#g2", 3: "#g1", 4: None, 5: "#g1"}


def test_sounds_of_whole_texts_are_searched_only_where_a_rule_can_match(spark):
    """The strings that a rule needs never hide a hit; a text without them costs no search; rules without Cyrillic letters see all texts."""
    rules = effects.default_rules()
    assert all(effects.needed(r[1]) for r in rules)
    texts = ["ВІТЕР дув.", "Він розсміявся. Тиша", "Б'ЄТЬСЯ його серце", "нічого тут", "plain", "падає ᲁощ", "Розділ 3\nтекст", "почув шипіння. Так", "він і вона відчинили двері", "зробив  кроки", ""]
    for t in texts:
        hits = {r for r in rules if re.search(r[1], t, re.IGNORECASE)}
        assert hits <= set(effects.possible(t, rules))
    assert effects.possible("нічого тут", rules) == [] and len(effects.possible("ᲁ", rules)) == len(rules)
    own = effects.rules_from("actions: [{tag: '#n', pattern: '\\d{3}', position: after_match}, {tag: '#k', pattern: '(?:дзвін|bell)', position: after_match}]")
    rows = spark.createDataFrame([(1, "a 123 b"), (2, "no bell"), (3, "x"), (4, "дзвін")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_tags"]) for r in effects.tag_sounds(rows, own).collect()}
    assert got == {1: ("a 123\n#n\n b\n", 1), 2: ("no bell\n#k\n", 1), 3: ("x\n", 0), 4: ("дзвін\n#k\n", 1)}
    began = time.time()
    effects.tag_text("слово за словом " * 200_000, rules)  # 3.2 million letters, some 3 s with each pattern
    assert time.time() - began < 1.5


def test_folds_take_many_documents_in_a_batch(spark):
    """Documents of many lengths that begin and end anywhere in batches of seven rows, against each on its own; no group of rows is made for each document."""
    from fabula.operators import folds

    rnd = random.Random(3)
    docs = [[(rnd.choice(["#g?", "#g2", "#g3", None]), rnd.choice(["— Мамо, так?", "— ні", "він каже", ""])) for _ in range(rnd.choice([1, 2, 6, 7, 8, 30]))] for _ in range(40)]
    rows = spark.createDataFrame([(d, i, g, b) for d, x in enumerate(docs) for i, (g, b) in enumerate(x)], "doc_id long, line_no int, gid string, body string")
    named = spark.createDataFrame([(d, f"#g{k}", n, k) for d in range(0, 40, 2) for k, n in ((2, "Мама (F)"), (3, "Тато (M)"))], "doc_id long, gid string, name string, ord int")
    lines = legend.attach(rows, legend.cast(named))

    def odd(s):
        if len(s.gid) == 7:
            raise ValueError("seven")

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        out = folds.fold(lines, (*folds.RULES, odd))
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["doc_id"], r["line_no"]): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    casts = {r["doc_id"]: r["cast"].asDict(True) for r in legend.cast(named).collect()}
    assert len(got) == sum(map(len, docs))
    for d, x in enumerate(docs):
        s = folds.Script(pd.DataFrame(x, columns=["gid", "body"]), {k: v for k, v in casts.get(d, {}).items() if k in ("alias", "gender", "me", "vocatives", "allowed", "forbidden")})
        folds.apply_rules(s, folds.RULES)
        assert [got[d, i]["gid"] for i in range(len(x))] == s.gid
        assert [[tuple(f) for f in got[d, i]["faults"] or []] for i in range(len(x))] == [[("odd", "ValueError: seven")] * (i == 0 and len(x) == 7) for i in range(len(x))]


def test_documents_with_one_legend_share_its_cast(spark):
    a, b = "#g1 - Оповідач\n#g2 - Мама (F)", "#g1 - Автор\n#g3 - Тато (M)"
    legends = spark.createDataFrame([(1, a), (2, b), (3, a), (4, None), (5, a), (5, b)], "doc_id long, text string")
    as_text = lambda casts: {r["doc_id"]: json.loads(r["c"] or "null") for r in casts.select("doc_id", F.to_json("cast").alias("c")).collect()}
    got, each = as_text(attribution_plan.casts_of(legends)), as_text(legend.cast(legend.parse_legend(legends)))
    assert {k: v for k, v in got.items() if v} == each and set(each) == {1, 2, 3, 5}
    # the legend is parsed once a text: no more rows reach the cast than texts
    seen = []
    whole = legend.parse_legend
    try:
        legend.parse_legend = lambda t: (seen.append(t.select("doc_id").distinct().count()), whole(t))[1]
        attribution_plan.casts_of(spark.createDataFrame([(i, a) for i in range(50)], "doc_id long, text string"))
    finally:
        legend.parse_legend = whole
    assert seen == [1]


def test_merging_takes_many_documents_in_a_batch(spark, capfd):
    rows = [(d, i, g, b) for d in range(200) for i, (g, b) in enumerate([("#g2", "«Так»"), ("#g1", "сказала вона."), ("#g2", "«Ні»")])]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, gid string, body string").withColumn("cast", F.lit(None).cast("string"))
    out = split_merge.merge_dialogs(lines.repartition(3))
    assert {(r["line_no"], r["gid"], r["body"]) for r in out.collect()} == {(0, "#g2", "«Так» Ні")} and out.count() == 200
    out.explain()
    assert "FlatMapGroupsInPandas" not in capfd.readouterr().out


def test_patterns_of_the_parts_of_a_line_are_searched_once(spark):
    lines = spark.createDataFrame([(1, 0, "#g3", "«Так» — сказав «тато", None)], "doc_id long, line_no int, gid string, body string, cast string")
    for rule in (split_merge.extract_attribution, split_merge.split_mixed):
        plan = rule(lines)._jdf.queryExecution().optimizedPlan().toString()
        assert not any("size(" in part and "Filter" in part for part in plan.splitlines())
    assert [(r["gid"], r["body"]) for r in split_merge.extract_attribution(lines).orderBy("line_no").collect()] == [("#g3", "«Так»"), ("#g1", "сказав"), ("#g1", "тато")]


def test_whole_words_without_regard_to_case():
    words = folds._words("він|вона")
    for text, found in (("І ВІН каже", True), ("Вона", True), ("вінок", False), ("\u1c80ін", True), ("мо\u1c81", False), ("İ він", True)):
        assert bool(words.search(text)) is found is bool(words.any_case.search(text))
    for body in ("  Ма́мо, де ти?", "й" * 300, "", "   " * 100 + "Тато, а"):
        whole = "".join(c for c in unicodedata.normalize("NFD", body) if not unicodedata.combining(c)).lstrip()[:90]
        assert folds._start(body) == whole


def test_queries_and_names_search_each_line_once(spark):
    from fabula.operators import classify, speaker_model

    rows = [(1, 0, "#g2", "— Так"), (1, 1, "#g?", "— Мамо"), (1, 2, "#g?", ""), (1, 3, "#g1", "  "), (1, 4, None, "ні"), (1, 5, "#g3", "— Ой")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, gid string, body string")
    got = {r["line_no"]: r["text"] for r in speaker_model.queries(lines, 3).collect()}
    assert got == {1: "— Мамо — Так", 2: "— Так — Ой"}
    forms = spark.createDataFrame([(1, "мамо", "#g2")], "doc_id long, form string, gid string")
    assert [(r["at"], r["k"], r["gid"]) for r in speaker_model.named_in(lines, forms).collect()] == [(1, 0, "#g2")]
    texts = spark.createDataFrame([("a", "так"), ("b", "-"), ("c", None)], "id string, text string")
    assert [(r["id"], r["token"]) for r in classify.tfidf(texts).collect()] == [("a", "так")]
    for rows in (speaker_model.named_in(lines, forms), classify.tfidf(texts)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not any("size(regexp_extract_all" in part for part in plan.splitlines())
