"""Queries of the script operators over tables: manuscripts made of conversations, legends made of nations, levels made of events; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import attribution, chunks, classify, effects, joins, legend, mentions, metrics, normalize, scenes, speaker_model, split_merge, thoughts
from .sources.text import read_table
from .streaming import utterances as U


def script(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a manuscript: every turn, its whole text on one line, in one of ten forms; without text only blank lines and headings."""
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s]+", " "))
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(10))
    by = lambda *xs: F.element_at(F.array(*xs), (k + 1).cast("int"))
    text = lambda a, b="": F.concat(F.lit(a), t, F.lit(b))
    gid = by(*(F.lit(x) for x in ("#g2", "#g?", "#g3", None, "#g?", None, "#g3", "#g1", None, "#g4")))
    body = by(text("— "), text("«", "», — сказав тато."), text("— ", ", — сказала Мама."), text("Тато повільно, ", ", каже:"), text("— Мамо, ", "?"), F.lit(""), text("«", "» — подумав хтось"), text("думка: "), F.concat(F.lit("Глава "), F.col("turn").cast("string")), text("«", "»"))
    return read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("line_no"), gid.alias("gid"), body.alias("body")).withColumns({"raw": F.col("body"), "indent": F.lit("")})


def legends(spark: SparkSession, d: str, hero: str = "головна героїня") -> DataFrame:
    """(doc_id, text): a legend for each region, its nations being the characters, every third with ``hero`` among its attributes."""
    rows = read_table(spark, d, "nation")
    attrs = F.element_at(F.array(F.lit("F, мати"), F.lit("M, дід"), F.lit(f"{hero}, друг")), (F.pmod("n_nationkey", F.lit(3)) + 1).cast("int"))
    line = F.concat(F.lit("#g"), (F.col("n_nationkey") + 1).cast("string"), F.lit(" - "), F.initcap("n_name"), F.lit(" / "), F.concat("n_name", F.lit("o")), F.lit(" ("), attrs, F.lit(")"))
    return rows.groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


LEGEND = "#g1 - Оповідач\n#g2 - Мама (F)\n#g3 - Тато (M)\n#g4 - Думки"


def named(spark: SparkSession, d: str) -> DataFrame:
    """The parsed legend of each manuscript of ``script``: the same four characters in each."""
    docs = read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return legend.parse_legend(docs.withColumn("text", F.lit(LEGEND)))


def named_by_region(spark: SparkSession, d: str) -> DataFrame:
    """The parsed legend of each conversation: the four characters of ``named``, then the nations of one region (its id modulo 5), each with two names, a role and what it is called."""
    docs = read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.pmod("conv_id", F.lit(5)).alias("region")).distinct()
    nations = legends(spark, d).withColumnsRenamed({"doc_id": "region", "text": "nations"})
    return legend.parse_legend(docs.join(nations, "region", "left").select("doc_id", F.concat_ws("\n", F.lit(LEGEND), "nations").alias("text")))


def told(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """The lines of ``script``, or others, with their legend's cast."""
    return legend.attach(script(spark, d) if lines is None else lines, legend.cast(named(spark, d)))


def levels(spark: SparkSession, d: str) -> DataFrame:
    """Events as levels of ten streams, an hour being a fifth of a second; the loud ones are those with an even user."""
    ts = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 18000).cast("long"))
    level = F.when(F.col("user_id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.01))
    return read_table(spark, d, "events").select((F.floor(F.col("user_id") / 2) % 10).cast("string").alias("stream_id"), ts.alias("ts"), level.alias("level"), "event_id")


_OUT = ("doc_id", "line_no", "gid", "body")


def q_reset_dialogs(spark, d):
    return normalize.reset_dialogs(script(spark, d)).select(*_OUT)


def q_pretag(spark, d):
    return normalize.pretag(script(spark, d)).select(*_OUT)


def q_demote_narrator_dialogs(spark, d):
    lines = script(spark, d).withColumn("gid", F.when(F.col("gid") == "#g3", "#g1").otherwise(F.col("gid")))
    return normalize.demote_narrator_dialogs(lines).select("doc_id", "line_no", "gid")


def q_collapse_separators(spark, d):
    lines = script(spark, d).withColumn("body", F.when(F.col("line_no") % 3 == 0, F.lit("***")).otherwise(F.col("body"))).withColumn("gid", F.when(F.col("line_no") % 3 == 0, F.lit(None)).otherwise(F.col("gid")))
    return normalize.collapse_separators(lines).select(*_OUT)


def q_collapse_same_tags(spark, d):
    lines = script(spark, d).withColumn("gid", F.when(F.col("gid").isin("#g3", "#g4"), "#g1").otherwise(F.col("gid"))).withColumn("body", F.regexp_replace("body", "^[—«] ?", ""))
    return normalize.collapse_same_tags(lines).select(*_OUT)


def q_lead_and_spaces(spark, d):
    body = F.col("body")
    return script(spark, d).select("doc_id", "line_no", normalize.normalize_dialog_lead(body).alias("lead"), normalize.normalize_punctuation_ascii(body).alias("ascii"), normalize.normalize_for_embedding(body).alias("embed"), normalize.normalize_spaces(body).alias("spaces"))


def q_clean_dialog_punctuation(spark, d):
    return normalize.clean_dialog_punctuation(script(spark, d)).select(*_OUT)


def q_remove_block_markers(spark, d):
    """Boundaries set by one rule, punctuation cleaned around them, and taken away."""
    marked = normalize.clean_dialog_punctuation(thoughts.mark_blocks(scenes.with_block(script(spark, d))))
    return normalize.remove_block_markers(marked).select(*_OUT)


def q_mark_blocks(spark, d):
    return thoughts.mark_blocks(scenes.with_block(script(spark, d))).select(*_OUT)


def q_demote_thoughts(spark, d):
    return thoughts.demote_thoughts(told(spark, d)).select("doc_id", "line_no", "gid")


def q_thoughts_to_tag(spark, d):
    return thoughts.thoughts_to_tag(told(spark, d)).select("doc_id", "line_no", "gid")


def q_demote_near_aphorism(spark, d):
    return thoughts.demote_near_aphorism(script(spark, d)).select("doc_id", "line_no", "gid")


def q_rank_title_leadin(spark, d):
    return thoughts.rank_title_leadin(told(spark, d)).select("doc_id", "line_no", "gid")


def q_first_person_leadin(spark, d):
    lines = script(spark, d).withColumn("body", F.regexp_replace("body", "^Тато повільно, (.*), каже:$", "$1. Тоді я кажу:"))
    return thoughts.first_person_leadin(told(spark, d, lines)).select("doc_id", "line_no", "gid")


def q_block_child_after_prologue(spark, d):
    lines = script(spark, d).withColumn("body", F.when(F.col("line_no") == 0, F.lit("Пролог")).otherwise(F.col("body")))
    return thoughts.block_child_after_prologue(lines).select("doc_id", "line_no", "gid")


def q_first_person_to_child(spark, d):
    lines = script(spark, d).withColumn("body", F.regexp_replace("body", "^— Мамо, ", "— Тато, де мій? "))
    return thoughts.first_person_to_child(told(spark, d, lines)).select("doc_id", "line_no", "gid")


def q_merge_around_attribution(spark, d):
    k = F.pmod("line_no", F.lit(4))
    lines = script(spark, d).withColumns({"gid": F.when(k % 2 == 1, "#g1").when(k == 0, "#g2").otherwise("#g2"), "body": F.when(k % 2 == 1, F.lit("— сказав він,")).otherwise(F.concat(F.lit("«"), F.col("line_no").cast("string"), F.lit("»")))})
    return split_merge.merge_around_attribution(lines).select(*_OUT)


def q_inline_sayer(spark, d):
    return attribution.inline_sayer(told(spark, d)).select("doc_id", "line_no", "gid")


def q_inline_verb_name(spark, d):
    return attribution.inline_verb_name(told(spark, d)).select("doc_id", "line_no", "gid")


def q_leadin_sayer(spark, d):
    return attribution.leadin_sayer(told(spark, d)).select("doc_id", "line_no", "gid")


def q_named_leadin(spark, d):
    return attribution.named_leadin(told(spark, d)).select("doc_id", "line_no", "gid")


def q_context_mentions(spark, d):
    return attribution.context_mentions(script(spark, d), legend.aliases(named(spark, d)))


def q_tag_counts(spark, d):
    return metrics.tag_counts(script(spark, d)).select("doc_id", "gid", "n", metrics.tag_order(F.col("gid")).alias("place"))


def q_scene_coverage(spark, d):
    """How much of each scene's and each manuscript's speech has a speaker."""
    return metrics.coverage(scenes.with_scene(script(spark, d)))


def q_prf_averages(spark, d):
    pairs = read_table(spark, d, "labels").where("quality is not null and toxic is not null").select(F.col("quality").cast("string").alias("gold"), F.col("toxic").cast("string").alias("pred"))
    return metrics.averages(metrics.precision_recall(pairs, None))


def q_gold_marks(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" {gold:#g"), (F.col("o_orderkey") % 7).cast("string"), F.lit("}"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" // GOLD: #g"), (F.col("o_orderkey") % 5).cast("string"))).otherwise(F.lit(""))).alias("body"))
    return rows.select("id", metrics.gold_of(F.col("body")).alias("gold"))


def q_legend_rows(spark, d):
    return legend.parse_legend(legends(spark, d))


def q_legend_characters(spark, d):
    """The characters of legends whose heroes have the service token of that meaning, which is no role, and a role that says the same."""
    return legend.characters(legend.parse_legend(legends(spark, d, "головний герой, головна героїня"))).select("doc_id", "gid", F.array_join("names", "|").alias("names"), F.array_join("roles", "|").alias("roles"), "gender", "first_person")


def q_legend_aliases(spark, d):
    return legend.aliases(legend.parse_legend(legends(spark, d))).select("doc_id", "alias", "gid")


def q_legend_fallback_aliases(spark, d):
    named = legend.parse_legend(legends(spark, d))
    return legend.aliases_or_fallback(named, legend.aliases(named).where("doc_id = 0")).where("doc_id <> 0").select("doc_id", "alias", "gid")


def q_legend_first_person(spark, d):
    return legend.first_person(legend.characters(legend.parse_legend(legends(spark, d))))


def q_legend_json(spark, d):
    rows = read_table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("#g"), F.col("n_nationkey").cast("string")), F.col("n_name"))))).alias("text"))
    return legend.parse_legend_json(rows)


def q_legend_in_text(spark, d):
    text = F.concat(F.lit("Перший рядок\nЛегенда:\n"), F.col("text"), F.lit("\n\n#g99 - Зайвий\nТекст"))
    return legend.legend_in_text(legends(spark, d).select("doc_id", text.alias("text"))).select("doc_id", "gid", "name")


def q_legend_records(spark, d):
    """Each region's nations as a legend of another shape: records, lists, names, the bridge form and plain text."""
    gid, name = F.concat(F.lit("#g"), F.col("n_nationkey").cast("string")), F.col("n_name")
    rows = read_table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", gid.alias("gid"), name.alias("name")))).alias("n"))
    as_map = lambda f: F.map_from_entries(F.transform("n", lambda x: F.struct(x["gid"], f(x))))
    record = lambda x: F.struct(F.array(x["name"], F.lit("")).alias("names"), F.array(F.lower(x["name"])).alias("aliases"), F.when(x["n_nationkey"] % 2 == 0, "F").otherwise("x").alias("gender"))
    lists = as_map(lambda x: F.array(x["name"]))
    bridge = F.to_json(F.struct(lists.alias("gid_to_names"), F.col("n")[0]["gid"].alias("narrator_gid")))
    plain = F.array_join(F.transform("n", lambda x: F.concat(x["gid"], F.lit(" - "), x["name"], F.lit(" (f; "), F.lower(F.substring(x["name"], 1, 3)), F.lit(")"))), "\n")
    k = F.col("doc_id") % 5
    text = F.when(k == 0, F.to_json(as_map(record))).when(k == 1, F.to_json(lists)).when(k == 2, F.to_json(as_map(lambda x: x["name"]))).when(k == 3, bridge).otherwise(plain)
    return legend.legend_records(rows.select("doc_id", text.alias("text"))).select("doc_id", "gid", F.array_join("names", "|").alias("names"), F.array_join("aliases", "|").alias("aliases"), "gender")


def q_morph_aliases(spark, d):
    return legend.morph_aliases(legend.parse_legend(legends(spark, d))).where("alias rlike '^[а-яіїєґ]+$'").select("doc_id", "alias", F.array_join("gids", "|").alias("gids"))


def q_name_forms(spark, d):
    return legend.name_forms(legend.parse_legend(legends(spark, d)))


def q_fuzzy_names(spark, d):
    """Distinct names one edit apart."""
    names = read_table(spark, d, "customer").select(F.col("c_name").alias("name"))
    pairs = joins.fuzzy_join(names, names.select(F.col("name").alias("form")), most=1).where("name < form")
    return pairs.select("name", F.col("form").alias("other"), F.round(T.similarity(F.col("name"), F.col("form")), 6).alias("similarity"))


def _long_words(spark, d, table: str, name: str) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit("")))
    return read_table(spark, d, table).select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}{6,})"), F.lit(1))).alias(name)).where(F.col(name).rlike("^[a-z]+$")).distinct()


def q_fuzzy_words(spark, d):
    """Words of six plain letters or more of the benchmark, and those of conversations that are at most two edits away."""
    return joins.fuzzy_join(_long_words(spark, d, "benchmark", "name"), _long_words(spark, d, "conversations", "form"))


def q_nearest_speaker(spark, d):
    """For each unknown line and gender the nearest speaker of it in the six lines before."""
    lines = script(spark, d)
    asked = lines.where("gid = '#g?'").select("doc_id", "line_no", F.explode(F.array(F.lit("F"), F.lit("M"))).alias("gender"))
    known = lines.where("gid in ('#g2', '#g3')").select("doc_id", "line_no", F.when(F.col("gid") == "#g2", "F").otherwise("M").alias("gender"), "gid")
    return joins.nearest_earlier(asked, known, ["gender"], 6, "gid")


def q_lines_in_scenes(spark, d):
    """Each line with the scenes whose span holds it."""
    lines = script(spark, d)
    return joins.within_spans(lines.select("doc_id", "line_no", "gid"), scenes.scene_spans(lines)).select("doc_id", "line_no", "gid", "label")


def q_name_mentions(spark, d):
    """How often each line of a conversation has each of the conversation's own names: the first long words of its turns."""
    rows = read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "text")
    first = rows.select("doc_id", "line_no", F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("alias")).where("alias <> ''")
    names = first.groupBy("doc_id", "alias").agg(F.concat(F.lit("#g"), F.min("line_no").cast("string")).alias("gid"))
    return mentions.mentions(rows, names).groupBy("doc_id", "line_no", "alias", "gid").agg(F.count("*").alias("n"))


def q_utterances(spark, d):
    out = U.utterances(levels(spark, d))
    return out.select("stream_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")


def q_cut_utterances(spark, d):
    out = U.cut_utterances(levels(spark, d))
    return out.select("stream_id", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")


def q_cooled_commands(spark, d):
    return U.cooled(levels(spark, d).where("level > 0.1").select("stream_id", "ts", "event_id")).select("stream_id", F.unix_micros("ts").alias("us"), "event_id")


def q_while_running(spark, d):
    rows = levels(spark, d)
    controls = rows.where("event_id % 10 = 0").select("stream_id", "ts", (F.col("event_id") % 20 == 0).alias("paused"))
    return U.while_running(rows.where("event_id % 10 <> 0"), controls.groupBy("stream_id", "ts").agg(F.max("paused").alias("paused"))).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def q_last_entries(spark, d):
    rows = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("ts"), "event_id")
    return U.last_entries(rows, 3).select("key", "event_id")


def q_best_transcript(spark, d):
    rows = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("string").alias("model")).agg(F.max(F.round(1 - F.col("l_discount") * 8, 2)).alias("confidence"), F.max(F.repeat(F.lit("x"), (F.col("l_quantity") % 9 + 1).cast("int"))).alias("text"))
    return U.best_transcript(rows)


def _commands(spark, d):
    """Every event as a command: a call or a word like one, or none, and its own words or those of a known command."""
    words = F.element_at(F.array(F.lit("відкрий блокнот"), F.lit("який зараз час"), F.lit("яка сьогодні дата"), F.lit("порахуй 2 + 3"), F.col("event_type"), F.col("props")), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    call = F.element_at(F.array(F.lit("maria "), F.lit("Marja "), F.lit("petra "), F.lit(""), F.lit("maria, "), F.lit("hey mariah! ")), (F.pmod(F.floor(F.col("event_id") / 6), F.lit(6)) + 1).cast("int"))
    return read_table(spark, d, "events").select("event_id", F.concat(call, words).alias("text"))


ROUTES = ((r"відкрий\s+(?:блокнот|notepad)", "open_program"), (r"порахуй\s+\d+\s*[+*−-]\s*\d+", "calculate"), (r"який\s+(?:зараз\s+)?час", "get_time"), (r"яка\s+(?:сьогодні\s+)?дата", "get_date"))


def q_routed_commands(spark, d):
    plain = T.without_call(F.col("text"), "maria")
    return _commands(spark, d).select("event_id", T.is_called(F.col("text"), "maria").alias("called"), plain.alias("command"), T.route(plain, F.col("event_id") % 11 == 0, ROUTES).alias("route"))


def q_answers_json(spark, d):
    text = F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` <|end|>"))
    return read_table(spark, d, "events").select("event_id", F.md5(T.extract_json(text)).alias("json_md5"))


def q_rewritten_documents(spark, d):
    """All documents through two functions, chunk by chunk."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    out = chunks.two_stages(docs, lambda texts: [t.replace("th", "TH") for t in texts], lambda texts: [t.replace("an", "AN") for t in texts], most=500)
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("h"))


def q_tagged_sounds(spark, d):
    added = F.element_at(F.array(F.lit(" Надворі падає дощ. Далі."), F.lit(" Пролунав крик і прогримів вибух!"), F.lit("")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    docs = read_table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), added).alias("text"))
    return effects.tag_sounds(docs).select("doc_id", F.col("n_tags").cast("long").alias("n_tags"), F.size(F.split("text", "#rain")).alias("rain"), F.size(F.split("text", "#v\n")).alias("v"))


def q_unknown_sound_tags(spark, d):
    docs = read_table(spark, d, "orders").select(F.concat(F.lit("text\n#s"), (F.col("o_orderkey") % 4).cast("string"), F.lit("\n#rain\n#p2")).alias("text"))
    return effects.unknown_tags(docs, effects.rule_table(spark))


def q_tfidf(spark, d):
    rows = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return classify.tfidf(rows).select("id", "token", F.round("w", 6).alias("w"))


def q_mean_vectors(spark, d):
    rows = read_table(spark, d, "part")
    w = classify.tfidf(rows.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")))
    return speaker_model.mean_vectors(w, rows.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("gid"))).select("gid", "token", F.round("w", 6).alias("w"))


def q_best_by_text(spark, d):
    """The labels nearest to each vector whose id is divisible by 100, by the greatest dot product over all others."""
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    tags = joins.best_products(rows.where("id % 100 = 0").drop("label"), rows).select("id", F.concat(F.lit("#g"), F.col("label").cast("string")).alias("gid"), "score")
    return speaker_model.best_by_text(tags, 0.35).select("id", "decision", F.round("score", 5).alias("score"))


def _speech(spark, d):
    who = named(spark, d)
    return script(spark, d), legend.characters(who), legend.aliases(who).select("doc_id", F.col("alias").alias("form"), "gid")


def q_speaker_queries(spark, d):
    out = speaker_model.queries(script(spark, d), 11)
    return out.select("doc_id", "line_no", F.md5("text").alias("h"))


def q_speaker_mentions(spark, d):
    lines, _, forms = _speech(spark, d)
    return speaker_model.mentions(lines, forms, 11).select("doc_id", "line_no", "gid", F.round("weight", 6).alias("weight"))


def q_speaker_candidates(spark, d):
    lines, chars, forms = _speech(spark, d)
    p = speaker_model.Parameters()
    return speaker_model.candidates(lines, chars, speaker_model.mentions(lines, forms, p.reach), speaker_model.addressees(lines, forms), p)


def q_speaker_neighbours(spark, d):
    return speaker_model.last_speakers(script(spark, d))


def q_speaker_decisions(spark, d):
    lines, chars, forms = _speech(spark, d)
    out = speaker_model.classify(lines, chars, forms)
    return out.select("doc_id", "line_no", "decision", F.round("best_score", 4).alias("best_score"), F.round("margin", 4).alias("margin"), "reason")


def q_first_texts(spark, d):
    """Characters' first six lines and their names, as the candidates of the smaller models."""
    lines, chars, _ = _speech(spark, d)
    texts = speaker_model.spoken_texts(lines, chars)
    return texts.groupBy("doc_id", "gid").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")).alias("sum"))


QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}
