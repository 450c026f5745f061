"""The script operators against SQL over the same tables, and hand-made cases of the rules."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fabula import queries, script_queries, script_sql
from fabula.functions import text as T
from fabula.lines import parse_lines
from fabula.operators import attribution, effects, folds, legend, mentions, metrics, normalize, speaker_model, split_merge, thoughts
from fabula.plans import attribution_plan
from fabula.plans.registry import Registry
from fabula.sources import text as sources
from fabula.streaming import utterances as U

FOLDER = "/root/testdata/sf0.001"
LINES = "doc_id long, line_no int, gid string, body string, raw string, indent string"


def lines_of(spark, *rows):
    return spark.createDataFrame([(1, i, g, b, b, "") for i, (g, b) in enumerate(rows)], LINES)


def gids(lines):
    return [r["gid"] for r in lines.orderBy("line_no").collect()]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("nation", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["collapse_same_tags", "mark_blocks", "thoughts_to_tag", "first_person_leadin", "merge_around_attribution", "leadin_sayer", "legend_aliases", "morph_aliases", "cut_utterances", "cooled_commands", "while_running", "routed_commands", "speaker_candidates", "speaker_queries"])
def test_rows_are_those_of_sql(spark, db, name):
    got = script_queries.QUERIES[name](spark, FOLDER)
    want = db.execute(script_sql.SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_legends_of_characters_have_the_service_token(spark, db, monkeypatch):
    """It is read and dropped from the roles; with fewer service tokens it is a role."""
    rows = lambda: sorted(map(repr, (tuple(r) for r in script_queries.QUERIES["legend_characters"](spark, FOLDER).collect())))
    want = db.execute(script_sql.SQL["legend_characters"]).fetchall()
    assert rows() == sorted(map(repr, want))
    monkeypatch.setattr(legend.L, "SERVICE_TOKENS", ("m", "f"))
    assert rows() == sorted(repr((d, g, n, "головний герой|" * hero + roles, gender, hero)) for d, g, n, roles, gender, hero in want)


def test_the_hero_is_told_by_all_roles_without_service_tokens(spark):
    text = "#g2 - Мама (F, мати)\n#g3 - Той (M, головний герой, друг)\n#g4 - Ада (F, головна героїня)\n#g5 - Ян (M, головний, друг, герой)\n#g6 - Ор (M, герой)\n#g7 - Ні"
    chars = legend.characters(legend.parse_legend(spark.createDataFrame([(1, text), (2, text[: text.index("\n#g4")]), (3, "#g3 - Ян (M, головний, герой)\n#g2 - Мама")], "doc_id long, text string")))
    got = {r["gid"]: ("|".join(r["roles"]), r["first_person"]) for r in chars.where("doc_id = 1").collect()}
    assert got == {"#g2": ("мати", False), "#g3": ("друг", False), "#g4": ("головна героїня", True), "#g5": ("головний|друг|герой", True), "#g6": ("герой", False), "#g7": ("", False)}
    assert {r["doc_id"]: r["first_person_gid"] for r in legend.first_person(chars).collect()} == {1: "#g4", 2: "#g2", 3: "#g3"}


@pytest.fixture(scope="module")
def cast(spark):
    return legend.cast(legend.parse_legend(spark.createDataFrame([(1, queries.LEGEND)], "doc_id long, text string")))


def test_no_rule_of_the_plan_fails(spark):
    got = {r["body"]: r["gid"] for r in attribution_plan.attribute(*queries._scripts(spark)).collect()}
    assert attribution_plan.RULES.log == []
    assert got['"Пеґ."'] == "#g3" and got["сказав тато."] == "#g1" and got["— Ні."] == "#g3" and got["— Так, Горас, — сказала Пеґґі."] == "#g4"


def test_a_rule_that_can_t_be_planned_changes_nothing(spark, cast):
    r = Registry()
    r.rule(2, name="second")(lambda x: x.withColumn("gid", F.concat("gid", F.lit("b"))))
    r.rule(1, name="first")(lambda x: x.withColumn("gid", F.lit("a")))
    r.rule(1, 5, "broken")(lambda x: x.select("nothing"))
    lines = lines_of(spark, ("#g1", "x"))
    assert gids(r.run(lines, cast)) == ["ab"] and r.log[0].startswith("broken")
    assert gids(r.run(lines, cast, skip=["second"])) == ["a"]


def test_a_rule_that_raises_leaves_its_document_as_it_was(spark):
    def picky(s):
        s.gid[0] = "#g9"
        if "bad" in s.body[0]:
            raise ValueError("no such body")

    def later(s):
        s.gid[-1] = "#g7"

    lines = spark.createDataFrame([(d, i, "#g?", b, b, "") for d, bodies in ((1, ("ok", "x")), (2, ("bad", "y"))) for i, b in enumerate(bodies)], LINES)
    casts = legend.cast(legend.parse_legend(spark.createDataFrame([(1, queries.LEGEND), (2, queries.LEGEND)], "doc_id long, text string")))
    r = Registry()
    r.rule(1, name="one")(lambda x: folds.fold(x, (picky,)))
    r.rule(2, name="two")(lambda x: folds.fold(x, (later,)))
    out = r.run(lines, casts).cache()
    assert [x["gid"] for x in out.orderBy("doc_id", "line_no").collect()] == ["#g9", "#g7", "#g?", "#g7"]
    assert [tuple(x) for x in folds.failures(out).collect()] == [(2, "picky", "ValueError: no such body")]


def test_the_legend_s_narrator_tells(spark):
    docs = spark.createDataFrame([(1, "Звичайний текст.")], "doc_id long, text string")
    legends = spark.createDataFrame([(1, "#g1 - Мама (F)\n#g7 - Оповідач (M, оповідач)")], "doc_id long, text string")
    assert gids(attribution_plan.attribute(docs, legends)) == ["#g7"]


def test_names_of_several_words(spark):
    legends = legend.parse_legend(spark.createDataFrame([(1, "#g4 - Пеґґі (F, маленька Пеґґі)\n#g5 - Маленька (F)")], "doc_id long, text string"))
    lines = lines_of(spark, ("#g?", "— Так! — сказала маленька Пеґґі."), ("#g?", "— Ні! — сказала Маленька."))
    from fabula.operators import attribution as A

    assert gids(A.inline_verb_name(legend.attach(lines, legend.cast(legends)))) == ["#g4", "#g5"]


def test_titles_and_voices(spark, cast):
    lines = lines_of(spark, (None, "Тато зайшов."), ("#g?", "— Так?"), (None, "Чути голос Мама"), ("#g1", "— Хто там?"))
    lines = legend.attach(lines, cast)
    assert gids(thoughts.rank_title_leadin(lines))[:2] == [None, "#g3"]
    assert gids(thoughts.narrator_dialogs(lines))[3] == "#g2"


def test_first_person_lead_in_holds_for_one_speech(spark, cast):
    lines = lines_of(spark, (None, "Я кажу:"), (None, ""), ("#g?", "— Раз."), ("#g?", "— Два."), ("#g?", "— Три, — сказала я."))
    assert gids(thoughts.first_person_leadin(legend.attach(lines, cast))) == [None, None, "#g2", "#g?", "#g2"]


ABOUT = {"alias": {"тато": "#g3", "мама": "#g2", "мамо": "#g2"}, "gender": {"#g2": "F", "#g3": "M"}, "vocatives": {"тато": ["#g3"], "тату": ["#g3"], "мама": ["#g2"], "мамо": ["#g2"]}}


def folded(rule, *rows, block=None, scene=None, **about):
    table = pd.DataFrame({"gid": [g for g, _ in rows], "body": [b for _, b in rows]})
    if block:
        table["block_id"] = block
    if scene:
        table["scene"] = scene
    s = folds.Script(table, ABOUT | about)
    rule(s)
    return s


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("#g2", "— Так."), (None, ""), ("#g?", "— Ні, тато."), ("#g1", "— Чому?"), ("#g?", "— Бо.")], ["#g2", None, "#g2", "#g3", "#g2"]),
        ([("#g2", "— Тато, де?"), ("#g?", "— Тут.")], ["#g2", "#g3"]),
        ([(None, "Тато сказав Мамо нічого."), ("#g?", "— Так."), (None, "Далі."), ("#g2", "— Ні.")], [None, "#g2", None, "#g2"]),
        ([(None, "Тато спав."), ("#g?", "— Так."), (None, "Мама спала."), ("#g?", "— Ні.")], [None, "#g?", None, "#g?"]),
    ],
)
def test_the_pair_takes_turns(rows, want):
    assert folded(folds.pair_lock, *rows).gid == want


def test_the_first_person_speaks_where_there_is_no_pair():
    assert folded(folds.pair_lock, ("#g?", "— Я тут."), me="#g2").gid == ["#g2"]


@pytest.mark.parametrize(
    ("rows", "want", "why"),
    [
        ([("#g2", "— Так! — сказав хтось.")], ["#g?"], "verb_gender_conflict->demote"),
        ([("#g2", "— Так! — Тато, сказав він.")], ["#g3"], "verb_gender_conflict->best"),
        ([(None, "Тато каже:"), ("#g5", "— Так.")], [None, "#g3"], "consensus 2>0+2"),
        ([(None, "Тато спав."), ("#g5", "— Так.")], [None, "#g5"], None),
        ([("#g3", "— А."), ("#g5", "— Він прийшов.")], ["#g3", "#g5"], None),
    ],
)
def test_votes_decide(rows, want, why):
    s = folded(folds.consensus, *rows)
    assert s.gid == want and (s.audit[0][3] if s.audit else None) == why


def test_who_is_shut_out_of_a_scene_gives_way():
    shut = {"forbidden": {"#g2": ["пролог"]}, "allowed": {}}
    s = folded(folds.consensus, ("#g2", "— Так."), (None, "Тато каже:"), ("#g2", "— Ні."), scene=["Пролог"] * 3, **shut)
    assert s.gid == ["#g?", None, "#g3"] and [a[3] for a in s.audit] == ["forbidden->demote", "forbidden->best"]
    assert folded(folds.consensus, ("#g2", "— Так."), scene=["Глава 1"], **shut).gid == ["#g2"]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("#g3", "— Тату, годі!"), ("#g2", "— Ні.")], ["#g?", "#g2"]),
        ([("#g2", "— Ні."), ("#g?", "— Мамо, йди сюди.")], ["#g2", "#g?"]),
        ([("#g2", "— Ні."), ("#g?", "— Тату, йди сюди.")], ["#g2", "#g2"]),
        ([("#g2", "— Ні."), ("#g?", "— " + "так " * 30 + "Тату, йди.")], ["#g2", "#g?"]),
        ([("#g5", "— Ні."), ("#g2", "— Ні."), ("#g?", "— Тату, йди.")], ["#g5", "#g2", "#g?"]),
    ],
)
def test_who_is_called_does_not_speak(rows, want):
    assert folded(folds.vocatives, *rows).gid == want


def test_pronouns_look_into_their_own_block_first():
    rows = (("#g3", "— А."), ("#g2", "— Б."), ("#g?", "— В, — мовила вона."))
    assert folded(folds.pronoun_coreference, *rows).gid[2] == "#g2"
    assert folded(folds.pronoun_coreference, ("#g2", "— А."), ("#g?", "вона тут є"), block=[1, 2]).gid[1] == "#g?"
    assert folded(folds.pronoun_coreference, ("#g2", "— А."), ("#g?", "йде вона."), block=[1, 2]).gid[1] == "#g2"


def test_flips_and_turns():
    say = lambda *g: [(x, "— а") for x in g]
    assert folded(folds.fix_flips, *say("#g2", "#g3", "#g?", "#g3")).gid == ["#g2", "#g3", "#g2", "#g3"]
    assert folded(folds.fix_flips, *say("#g2", "#g3", "#g2", "#g5", "#g2", "#g3", "#g2", "#g3")).gid[3] == "#g5"  # no turn of the other one follows
    assert folded(folds.fix_flips, *say("#g2", "#g3", "#g2", "#g5", "#g3", "#g2", "#g3")).gid[3] == "#g3"
    assert folded(folds.alternate, *say("#g2", "#g?", "#g?", "#g3")).gid == ["#g2", "#g3", "#g2", "#g3"]
    assert folded(folds.alternate, *say("#g2", "#g3", "#g3", "#g2")).gid == ["#g2", "#g3", "#g2", "#g2"]


@pytest.mark.parametrize(("lead", "gid"), [("Тоя кричить голос Тоя:", "#g5"), ("Чути голос Мамою:", "#g2"), ("Чути голос Мсма:", "#g2"), ("Чути голос Чужий:", "#g?"), ("Тут голос Пеґґіи:", "#g4"), ("Чути голос Велісандер:", "#g6"), ("Чути голос Велсинда:", "#g6")])
def test_heard_voices_are_found_by_fuzzy_names(spark, lead, gid):
    who = legend.parse_legend(spark.createDataFrame([(1, queries.LEGEND + "\n#g5 - Той (M)\n#g6 - Велісанда (F)")], "doc_id long, text string"))
    lines = legend.attach(lines_of(spark, (None, lead), (None, ""), ("#g?", "— Так.")), legend.cast(who))
    if lead.endswith("сандер:"):
        gid = "#g6"
    assert gids(attribution.heard_voice(lines))[2] == gid


def test_lead_ins_with_a_colon(spark, cast):
    far = "Тато повідомив" + " слово" * 30 + ":"
    lines = lines_of(spark, (None, "Мама глянула, а Тато повідомив усім:"), ("#g?", "— Раз."), (None, far), ("#g?", "— Два."), ("#g1", "Мама спитала:"), ("#g3", "— Три."), (None, "Тато сказав:"), ("#g?", "— Так, — Мама пішла."), (None, "Почувся його, тата… Мама, її голос:"), ("#g?", "— Е!"))
    lines = legend.attach(lines, cast)
    got = gids(attribution.named_leadin(lines))
    assert [got[i] for i in (1, 3, 5, 7)] == ["#g3", "#g?", "#g2", "#g?"]
    assert gids(attribution.possessive_voice(lines))[9] == "#g2"


def test_narration_before_speech_names_its_speaker(spark, cast):
    rows = ((None, "Тато повільно каже:"), ("#g?", "— Ні."), (None, "Інші гукають:"), ("#g?", "— Ні."), (None, "Мама тихо сказав:"), ("#g?", "— Ні."), ("#g?", "Тато каже: — Так."), (None, "Мама сказала."), (None, ""), ("#g?", "— Ні."))
    got = gids(attribution.leadin_sayer(legend.attach(lines_of(spark, *rows), cast)))
    assert [got[i] for i in (1, 3, 5, 6, 9)] == ["#g3", "#g?", "#g?", "#g3", "#g2"]


def by_text(rows):
    """The merging rule on plain lists, from the last line to the first: what follows is merged before what stands before it."""
    out, i = [], 0
    rows = [[k, *r] for k, r in enumerate(rows)]
    has = lambda r, g: r[1] == g and any(q in r[2] for q in "«\"“")
    while rows:
        k, gid, body = head = rows.pop(0)
        if not (gid and gid != "#g?" and has(head, gid)):
            out.append((k, gid, body))
            continue
        while rows:
            if has(rows[0], gid):
                part = rows.pop(0)[2]
            elif rows[0][1] == "#g1" and len(rows) > 1 and has(rows[1], gid):
                rows.pop(0)
                part = rows.pop(0)[2]
            elif rows[0][1] == "#g1" and any(q in rows[0][2] for q in "«\"“") and rows[0][2][0] not in "«\"“":
                at, _, told = rows.pop(0)
                cut = next(i for i, c in enumerate(told) if c in "«\"“")
                words, part = told[:cut].strip().lstrip(",—–- ").rstrip(",—–- ."), told[cut:].strip()
                out += [(at, "#g1", words)] * bool(words)
            else:
                break
            if body[-1:] and body[-1] in "»\"”" and part[:1] and part[0] in "«\"“":
                part = part[1:]
            if body[-1:] == "»" and part[-1:] == "»":
                part = part[:-1]
            body = (body + " " + part).strip()
        out.append((k, gid, body))
    return out


def test_merging_is_that_of_the_rule(spark):
    r = random.Random(3)
    rows = [(r.choice(["#g1", "#g1", "#g2", "#g2", "#g3", "#g?", None]), r.choice(["«а»", "«б", "в»", "— г «ґ»", "д, «е» — є", "слово", "", "\"ж\"", "- и - «і»"])) for _ in range(4000)]
    for at in range(0, len(rows), 20):
        part = rows[at : at + 20]
        assert split_merge.merged_runs([g for g, _ in part], [b for _, b in part]) == by_text(part)
    lines = spark.createDataFrame([(i // 50, i % 50, g, b, b, "") for i, (g, b) in enumerate(rows)], LINES)
    got = split_merge.merge_dialogs(lines).orderBy("doc_id", "line_no").collect()
    want = [(d, k, g, b) for d in range(80) for k, (_, g, b) in enumerate(by_text(rows[50 * d : 50 * d + 50]))]
    assert [(x["doc_id"], x["line_no"], x["gid"], x["body"]) for x in got] == want


def test_names_are_those_of_a_naive_scan():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("аб ") for _ in range(n)).strip()
    for _ in range(300):
        names = {w: "#g2" for w in {word(r.randint(1, 4)) for _ in range(5)} if w}
        text, whole = word(30), r.random() < 0.5
        inside = lambda i: 0 <= i < len(text) and text[i].isalnum()
        want, at = [], 0
        while at < len(text):
            fits = [w for w in names if text.startswith(w, at) and not (whole and (inside(at - 1) or inside(at + len(w))))]
            if fits:
                w = max(fits, key=len)
                want.append((at, at + len(w), w))
            at += max(map(len, fits), default=1)
        assert mentions.Names(names).find(text, whole) == want


def test_the_speaker_model_s_ladder(spark):
    chars = spark.createDataFrame([(1, "#g2", 0, ["Мама"], [], "F", False), (1, "#g3", 1, ["Тато"], [], "M", False)], "doc_id long, gid string, ord int, names array<string>, roles array<string>, gender string, first_person boolean")
    forms = legend.name_forms(legend.parse_legend(spark.createDataFrame([(1, "#g2 - Мама\n#g3 - Тато")], "doc_id long, text string")))
    lines = lines_of(spark, ("#g?", "— сказала Мама."), ("#g2", "— Так."), ("#g?", "— Тато, іди сюди!"), ("#g?", "— Я тут, мама знає."))
    got = {r["line_no"]: (r["decision"], r["reason"]) for r in speaker_model.classify(lines, chars, forms).collect()}
    assert got[0] == ("#g2", "explicit_verb_name")
    assert got[2][0] == "#g2"  # who is called doesn't speak
    assert got[3] == ("#g2", "lexical_hit")


def test_loose_tags_and_gids(spark):
    rows = spark.createDataFrame([("#g2 Текст",), (" #g?: — Так",), ("без тега",)], "raw string")
    assert [(r["gid"], r["body"]) for r in speaker_model.with_loose_tag(rows).collect()] == [("#g2", "Текст"), ("#g?", "— Так"), (None, "без тега")]
    got = spark.createDataFrame([("#g12",), ("#narrator",), ("x",), (None,)], "g string").select(speaker_model.normalize_gid(F.col("g")).alias("g")).collect()
    assert [r["g"] for r in got] == ["#g12", "#g1", "#g?", "#g?"]


def test_sound_rules_are_read_and_checked(spark):
    rules = effects.rules_from("actions:\n - {tag: '#x', pattern: 'грім', position: after_paragraph, confidence: 1}\n - {tag: '#y', pattern: '(', position: after_match}\n - {tag: '#z', pattern: 'a', position: nowhere}")
    assert [r[0] for r in rules] == ["#x"]
    assert effects.tag_text("Був грім. Далі.\n\nКінець.", rules)[0] == "Був грім. Далі.\n#x\n\nКінець.\n"
    assert len(effects.default_rules()) == 18
    once = effects.tag_text("Горіло багаття. Ніч.", effects.default_rules())
    assert once == ("Горіло багаття.\n#fire\n Ніч.\n", 1) and effects.tag_text(once[0], effects.default_rules())[1] == 1


def test_text_helpers(spark):
    row = spark.range(1).select(
        normalize.correct_recognized(F.lit("вікрий нотатки"), {"вікрий": "відкрий"}).alias("fixed"),
        normalize.prepare_speech(F.lit('"Ａ" – так - ні')).alias("speech"),
        T.is_audible(F.array(F.lit(0.01), F.lit(-0.02))).alias("loud"),
        T.softmax(F.array(F.lit(0.0), F.lit(0.0)))[0].alias("p"),
        legend.without_accents(F.lit("їжак й")).alias("plain"),
    ).first()
    assert row["fixed"] == "Відкрий нотатки" and row["speech"] == "A: так: ні" and row["loud"] and row["p"] == 0.5 and row["plain"] == "іжак и"


def test_gain_follows_the_volume(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.01, 0.01, 0.0, 0.5])], "stream_id string, ts long, volume double").withColumn("ts", F.timestamp_seconds("ts"))
    assert [round(r["gain"], 4) for r in U.gains(rows).orderBy("ts").collect()] == [1.5, 2.25, 2.25, 1.125]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    sources.write_manuscripts(docs, f"{tmp_path}/out")
    back = spark.read.text(f"{tmp_path}/out", wholetext=True)
    assert {(r["doc_id"], r["value"]) for r in back.collect()} == {(1, "a\nb\n"), (2, "c\n")}
    assert sources.write_version(docs, docs, f"{tmp_path}/v", "1") is False
    assert sources.write_version(docs, docs.where("doc_id = 1"), f"{tmp_path}/v", "1") is True
    sources.write_predictions(spark.createDataFrame([(1, [("#g2", 0.5), ("#g3", 0.25)])], "line int, top array<struct<gid:string,score:double>>"), f"{tmp_path}/log")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/log").first()["top"] == "#g2:0.500;#g3:0.250"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("﻿так\r\nні".encode())
    (tmp_path / "in/b.txt").write_bytes("так".encode("cp1251"))
    assert {(r["text"], r["bom"], r["eol"]) for r in sources.read_encoded(spark, f"{tmp_path}/in").collect()} == {("так\r\nні", "utf-8-sig", "\\r\\n".encode().decode("unicode_escape")), ("так", "", "\n")}


def test_rule_hits_and_orders(spark):
    logs = spark.createDataFrame([("[074 pair_lock] retagged:3",), ("[074 pair_lock] retagged: 4",), ("nothing",)], "text string")
    assert [tuple(r) for r in metrics.rule_hits(logs).collect()] == [("074 pair_lock", 7)]


def test_odd_lines(spark, cast):
    empty = lines_of(spark, ("#g?", None), (None, None), ("#g2", "")).limit(0)
    odd = lines_of(spark, ("#g?", ""), (None, ""), ("#g2", "«»"))
    for lines in (empty, odd):
        n = lines.count()
        assert attribution_plan.RULES.run(lines, cast).count() <= n
        assert parse_lines(lines.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 0
