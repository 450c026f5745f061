"""Queries over the given tables and inline manuscripts, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import script_queries, script_sql
from .lines import parse_lines, tagged_text
from .operators import attribution, classify, effects, folds, legend, metrics, normalize, scenes
from .plans import attribution_plan
from .sources.text import read_table
from .streaming import utterances

LEGEND = "#g1 - Оповідач (M, оповідач, новачок загону)\n#g2 - Мама (F, мати, мама)\n#g3 - Тато (M, батько, тато, Горас)\n#g4 - Пеґґі (F, дівчинка, Пеґ)"
SCRIPT = "Пролог\n\nЯ забув.\n\n«Пеґ», — сказав тато.\n\n— Я забула, — сказала Мама.\nТато повільно каже:\n— Ні.\n— Чому? — спитала вона.\n\nКінець прологу\nГлава 2\n— Так, Горас, — сказала Пеґґі."


def _scripts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A short manuscript and its legend, for tests."""
    kind = "doc_id long, text string"
    return spark.createDataFrame([(1, SCRIPT)], kind), spark.createDataFrame([(1, LEGEND)], kind)


def _manuscripts(spark: SparkSession, d: str, tagged: bool) -> tuple[DataFrame, DataFrame]:
    """All conversations as manuscripts, with or without their tags, and a legend for each."""
    lines = script_queries.script(spark, d)
    text = tagged_text(F.col("indent"), F.col("gid"), F.col("body")) if tagged else F.col("body")
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return docs, docs.select("doc_id", F.lit(LEGEND).alias("text"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as tagged lines: a document for each, a speaker for each role."""
    gid = F.when(F.col("role") == "system", "#g1").when(F.col("role") == "user", "#g2").when(F.col("role") == "assistant", "#g3").otherwise("#g?")
    return read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("line_no"), gid.alias("gid"), F.concat(F.lit("— "), F.coalesce("text", F.lit(""))).alias("body"), F.col("text").alias("raw"), F.lit("").alias("indent"))


def q_parse_lines(spark, d):
    return parse_lines(read_table(spark, d, "documents")).select("doc_id", "line_no", "raw")


def q_lookalikes(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.md5(normalize.fix_lookalikes(F.col("text"))).alias("h"))


def q_normalize_body(spark, d):
    return parse_lines(read_table(spark, d, "documents")).select("doc_id", "line_no", normalize.normalize_body(F.col("body")).alias("body"))


def q_narrator_fallback(spark, d):
    return normalize.narrator_fallback(parse_lines(read_table(spark, d, "documents"))).groupBy("doc_id").agg(F.count("gid").alias("n_tagged"), F.count("*").alias("n_lines"))


def q_tag_roles(spark, d):
    return _turns(spark, d).groupBy("gid").agg(F.count("*").alias("n"))


def q_dialog_blocks(spark, d):
    return scenes.dialog_blocks(_turns(spark, d)).select("doc_id", "start_line", "end_line", "n_lines")


def q_dominant_pair(spark, d):
    out = scenes.dominant_pairs(_turns(spark, d))
    return out.select("doc_id", "block_id", "first", "second", F.round("share", 6).alias("share"))


def q_previous_speaker(spark, d):
    return attribution.previous_speakers(_turns(spark, d)).select("doc_id", "line_no", "previous", "following")


def q_first_seen(spark, d):
    return legend.with_first_seen(_turns(spark, d)).select("doc_id", "gid", "first_line")


def q_coverage(spark, d):
    return metrics.coverage(_turns(spark, d).withColumn("scene", F.lit(None).cast("string"))).where("scene is null").select("doc_id", "dialogs", "assigned", "unknown", "coverage")


def _judged(spark, d):
    return read_table(spark, d, "labels").where("quality is not null and toxic is not null").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"))


def q_confusion(spark, d):
    return metrics.confusion(_judged(spark, d))


def q_prf(spark, d):
    return metrics.precision_recall(_judged(spark, d), None)


def q_cache_hits(spark, d):
    rows = read_table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key"), "ts").agg(F.count("*").alias("n"))
    return utterances.cache_hits(rows).groupBy("key").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("asked"))


def q_topk_decision(spark, d):
    """Customers per nation and segment, as scores, through the decision ladder."""
    rows = read_table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("gid")).agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    scores = rows.select("id", "gid", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("id")), 6).alias("score"))
    return classify.decide(scores).select("id", "decision", "best_score", F.round("margin", 6).alias("margin"))


def q_sentence_chunks(spark, d):
    rows = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(effects.sentence_chunks(F.col("text"), 500)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


def q_attribute(spark, d):
    """All rules over the conversations as manuscripts that are tagged already."""
    return attribution_plan.attribute(*_manuscripts(spark, d, tagged=True)).select("doc_id", "line_no", "gid", "body")


def q_characters(spark, d):
    """The characters of every conversation's legend."""
    return legend.characters(script_queries.named_by_region(spark, d)).select("doc_id", "gid", "gender", F.array_join("names", "/").alias("names"))


def q_aliases(spark, d):
    """The names of every conversation's legend."""
    return legend.aliases(script_queries.named_by_region(spark, d)).select("doc_id", "alias", "gid")


def q_scene_spans(spark, d):
    return scenes.scene_spans(script_queries.script(spark, d))


def q_fold(spark, d):
    """The ordered rules over all conversations, each with its characters."""
    return folds.fold(script_queries.told(spark, d)).select("doc_id", "line_no", "gid")


def q_attribute_all(spark, d):
    """All rules over the conversations as manuscripts without tags."""
    return attribution_plan.attribute(*_manuscripts(spark, d, tagged=False)).select("doc_id", "line_no", "gid", "body")


def q_sounds(spark, d):
    return effects.tag_sounds(read_table(spark, d, "documents")).select("doc_id", "n_tags", F.length("text").alias("n_chars"))


QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")} | script_queries.QUERIES

_TURNS = "turns AS (SELECT conv_id AS doc_id, turn::INT AS line_no, CASE role WHEN 'system' THEN '#g1' WHEN 'user' THEN '#g2' WHEN 'assistant' THEN '#g3' ELSE '#g?' END AS gid FROM conversations)"
_BLOCKS = f"""{_TURNS},
d AS (SELECT *, gid <> '#g1' AS d FROM turns),
s AS (SELECT *, (d AND NOT coalesce(lag(d) OVER w, false))::INT AS st FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
b AS (SELECT *, CASE WHEN d THEN sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) END AS block_id FROM s)"""
_LINES = r"""pieces AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM pieces),
lines AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1))::INT AS line_no, unnest(p) AS raw FROM kept)"""

SQL = {
    "parse_lines": f"WITH {_LINES} SELECT doc_id, line_no, raw FROM lines",
    "lookalikes": "SELECT doc_id, md5(translate(text, 'aceopxyiACEOPXYI', 'асеорхуіАСЕОРХУІ')) AS h FROM documents",
    "tag_roles": f"WITH {_TURNS} SELECT gid, count(*) AS n FROM turns GROUP BY gid",
    "dialog_blocks": f"WITH {_BLOCKS} SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM b WHERE block_id IS NOT NULL GROUP BY doc_id, block_id",
    "dominant_pair": f"""WITH {_BLOCKS},
g AS (SELECT doc_id, block_id, gid, count(*) AS n, min(line_no) AS seen FROM b WHERE block_id IS NOT NULL AND gid NOT IN ('#g?', '#g1') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY n DESC, seen, gid) AS k, sum(n) OVER (PARTITION BY doc_id, block_id) AS total FROM g)
SELECT x.doc_id, x.block_id::BIGINT AS block_id, x.gid AS first, y.gid AS second, round((x.n + y.n) / x.total, 6)::DOUBLE AS share FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.block_id = y.block_id AND x.k = 1 AND y.k = 2""",
    "previous_speaker": f"""WITH {_TURNS}, p AS (SELECT *, last_value(CASE WHEN gid NOT IN ('#g?', '#g1') THEN gid END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous FROM turns)
SELECT doc_id, line_no, previous, lead(previous) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM p""",
    "first_seen": f"WITH {_TURNS} SELECT doc_id, gid, min(line_no) AS first_line FROM turns WHERE gid <> '#g?' GROUP BY ALL",
    "coverage": f"WITH {_TURNS} SELECT doc_id, count(*) AS dialogs, count(*) FILTER (gid <> '#g?') AS assigned, count(*) FILTER (gid = '#g?') AS unknown, round(count(*) FILTER (gid <> '#g?') / count(*), 6) AS coverage FROM turns GROUP BY doc_id",
    "confusion": "SELECT quality::VARCHAR AS gold, toxic::VARCHAR AS pred, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL",
    "prf": """WITH j AS (SELECT quality::VARCHAR AS gold, toxic::VARCHAR AS pred FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
l AS (SELECT gold AS label FROM j UNION SELECT pred FROM j),
t AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label AND gold <> label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM l, j GROUP BY label)
SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM t""",
    "topk_decision": """WITH n AS (SELECT c_nationkey AS id, c_mktsegment AS gid, count(*) AS n FROM customer GROUP BY ALL),
s AS (SELECT id, gid, round(n / sum(n) OVER (PARTITION BY id), 6) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, gid) AS k, count(*) OVER (PARTITION BY id) AS many FROM s),
x AS (SELECT a.id, a.gid, a.score, CASE WHEN a.many > 1 THEN round(a.score - b.score, 6) ELSE 0.0 END AS margin, a.many FROM r a LEFT JOIN r b ON a.id = b.id AND b.k = 2 WHERE a.k = 1)
SELECT id, CASE WHEN many = 1 OR (score >= 0.25 AND margin >= 0.01) THEN gid ELSE '#g?' END AS decision, score AS best_score, margin FROM x""",
    "cache_hits": """WITH r AS (SELECT DISTINCT user_id::VARCHAR AS key, ts FROM events),
a AS (SELECT key, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY key ORDER BY ts)) < 24 * 3600000000, false) AS hit FROM r)
SELECT key, sum(hit::BIGINT)::BIGINT AS hits, count(*) AS asked FROM a GROUP BY key""",
    "normalize_body": f"WITH {_LINES} SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(translate(CASE WHEN regexp_matches(raw, '^\\s*#g(\\d+|\\?)\\s*:') THEN regexp_replace(raw, '^\\s*#g(\\d+|\\?)\\s*:\\s*', '') ELSE raw END, chr(160) || '«»„“”′ʼ''' || chr(8203) || chr(8204) || chr(8205) || chr(65279), ' \"\"\"\"\"’’’'), '\\.{{3,}}', '…', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+$', '') AS body FROM lines",
    "narrator_fallback": f"""WITH {_LINES}, p AS (SELECT *, trim(raw, ' ') <> '' AND NOT regexp_matches(raw, '^[\\s ]*[-‒–—―«\"„“”''’]') AS plain FROM lines),
l AS (SELECT *, coalesce(lag(plain) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS before FROM p)
SELECT doc_id, count(*) FILTER (plain AND NOT before) AS n_tagged, count(*) AS n_lines FROM l GROUP BY doc_id""",
} | script_sql.SQL
