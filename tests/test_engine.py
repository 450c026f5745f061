import duckdb
import pytest

from fabula import queries as Q
from fabula.lines import parse_lines, render
from fabula.operators import effects, folds, legend, normalize, split_merge
from fabula.plans import attribution_plan

DATA = "/root/testdata/sf0.001"


def cells(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 5) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    cur = duck.execute(Q.SQL[name])
    want = cur.fetchall()
    assert cells(df.collect(), df.columns) == cells(want, [x[0] for x in cur.description])


def lines_of(spark, text):
    return parse_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_text_goes_round(spark):
    for text in ("a\n\nb", "#g1: x\n  #g?: y", "«q»"):
        assert render(lines_of(spark, text)).first()["text"] == text
    assert parse_lines(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


def test_attribution_of_a_script(spark):
    got = {r["line_no"]: r for r in attribution_plan.attribute(*Q._scripts(spark)).collect()}
    assert [got[i]["gid"] for i in (4, 5, 7, 9, 10, 14)] == ["#g3", "#g1", "#g2", "#g3", "#g2", "#g4"]
    assert not any("[[" in r["body"] for r in got.values()) and len(got) == 15


@pytest.mark.parametrize("name", ["attribute", "attribute_all"])
def test_no_boundary_is_left_in_any_manuscript(spark, name):
    rows = Q.QUERIES[name](spark, DATA)
    assert rows.where("body like '%[[%'").count() == 0 and rows.where("gid is not null").count() > 0


def test_speaker_and_verb_must_agree(spark):
    docs = spark.createDataFrame([(1, "— Так, — сказав Мама.")], "doc_id long, text string")
    legends = spark.createDataFrame([(1, Q.LEGEND)], "doc_id long, text string")
    named = legend.parse_legend(legends)
    from fabula.operators import attribution

    lines = normalize.reset_dialogs(parse_lines(docs))
    assert attribution.inline_sayer(legend.attach(lines, legend.cast(named))).first()["gid"] == "#g?"


def test_same_tags_collapse_over_blank_lines(spark):
    got = [r["gid"] for r in normalize.collapse_same_tags(lines_of(spark, "#g1: a\n\n#g1: b\n#g2: c")).orderBy("line_no").collect()]
    assert got == ["#g1", None, None, "#g2"]


def test_quotations_keep_the_speaker(spark):
    got = split_merge.extract_attribution(lines_of(spark, '#g3: "Пеґ", — сказав тато.')).orderBy("line_no").collect()
    assert [(r["gid"], r["body"]) for r in got] == [("#g3", '"Пеґ"'), ("#g1", "сказав тато.")]


def test_flips_are_filled():
    import pandas as pd

    s = folds.Script(pd.DataFrame({"gid": ["#g2", "#g3", "#g?", "#g3"], "body": ["— а"] * 4}), {})
    folds.fix_flips(s)
    assert s.gid == ["#g2", "#g3", "#g2", "#g3"]


def test_sounds_and_chunks(spark):
    assert effects.tag_text("Хтось відчинив двері. Тиша.", effects.default_rules()) == ("Хтось відчинив двері.\n#d\n Тиша.\n", 1)
    row = spark.createDataFrame([("aa. bbbb. c. dd.",)], "text string").select(effects.sentence_chunks(effects.F.col("text"), 8).alias("c")).first()
    assert row["c"] == ["aa.", "bbbb. c.", "dd."]


def test_emotions_follow_keywords(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("стиснув кулак", {"Anger": 0.3, "None": 0.7})], "text string, s map<string,double>").select(effects.correct_emotions(F.col("text"), F.col("s")).alias("s")).first()
    assert row["s"] == {"Anger": 0.95, "None": 0.1}


def test_stream_of_levels_gives_what_the_table_gives(spark, tmp_path):
    from pyspark.sql import functions as F

    from fabula.streaming import utterances

    rows = spark.range(60).select(F.lit("a").alias("stream_id"), F.timestamp_millis(F.col("id") * 100 + F.when(F.col("id") >= 30, 5000).otherwise(0)).alias("ts"), F.lit(0.5).alias("level"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert utterances.utterances(rows).count() == 2
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = utterances.utterances(stream, "1 second").writeStream.format("memory").queryName("u").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("u").count() == 1  # the second is not over yet


def test_process_renders(spark):
    docs, legends = Q._scripts(spark)
    assert "#g2: — Я забула" in attribution_plan.process(docs, legends).first()["text"]


@pytest.mark.parametrize(("name", "whole", "key"), [("characters", "legend_characters", ("doc_id", "gid", "gender")), ("aliases", "legend_aliases", ("doc_id", "alias", "gid"))])
def test_legends_of_conversations_hold_all_of_a_region(spark, name, whole, key):
    """What the nations' legends give, each conversation of that region has too, and the four characters besides."""
    rows = lambda q: {tuple(r[c] for c in key) for r in Q.QUERIES[q](spark, DATA).collect()}
    got, nations = rows(name), rows(whole)
    docs = {r[0] for r in got}
    assert {(d, *r[1:]) for d in docs for r in nations if r[0] == d % 5} <= got and len(docs) == spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
