"""The similarity classifier from end to end: which character speaks each unknown line.

Every unknown line is a query: its own text and that of the known lines around
it. Candidates are the characters named near by; their verbalisations are
compared with the query by TF-IDF, what stands around the line adds to the
score, and a ladder of conditions decides. All stages are joins on (doc_id,
line) or (doc_id, gid), so documents of any number are spread over all tasks;
no stage pairs a line with more than the characters of its own legend.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from .classify import similarities, tfidf
from .normalize import normalize_for_embedding


@dataclass(frozen=True)
class Parameters:
    threshold: float = 0.25
    margin: float = 0.01
    reach: int = 11
    top: int = 5
    mean_of: int = 1
    lexical: float = 0.35
    novelty: float = 0.08
    gender_filter: bool = True
    force_single: bool = True


_TOKEN = r"([A-Za-zА-Яа-яЇїІіЄєҐґ][\p{L}\p{N}_’']+)"
LOOSE_TAG = r"^(\s*)#g(\d+|\?)\s*:?\s*(.*)$"


def with_loose_tag(lines: DataFrame) -> DataFrame:
    """Columns indent, gid and body read from ``raw``, the colon after a tag being optional."""
    tagged = F.col("raw").rlike(LOOSE_TAG)
    part = lambda i: F.regexp_extract("raw", LOOSE_TAG, i)
    return lines.withColumns({"indent": F.when(tagged, part(1)).otherwise(F.lit("")), "gid": F.when(tagged, F.concat(F.lit("#g"), part(2))), "body": F.when(tagged, part(3)).otherwise(F.col("raw"))})


def valid_gid(gid: Column) -> Column:
    return F.coalesce(gid.rlike(r"^#g\d+$"), F.lit(False))


def normalize_gid(gid: Column, narrator: str = "#g1") -> Column:
    """A gid as it is, the narrator's for his other names, else the unknown one."""
    return F.when(valid_gid(gid), gid).when(F.lower(F.regexp_replace(gid, "^#", "")).isin("narrator", "оповідач", "наратор"), F.lit(narrator)).otherwise(F.lit("#g?"))


def verbalizers(chars: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, gid, text): for each name of a character the name, sentences that it speaks, and the name's case forms; without repeats."""
    verbs = F.when(F.col("gender") == "M", F.array(F.lit("Сказав"))).when(F.col("gender") == "F", F.array(F.lit("Сказала"))).otherwise(F.array(F.lit("Сказав"), F.lit("Сказала")))
    named = chars.select("doc_id", "gid", verbs.alias("verbs"), F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array("gid"))).alias("name"))
    said = F.concat(F.array("name", F.concat(F.lit("Це говорить "), "name", F.lit(".")), F.concat(F.lit("Репліка "), "name", F.lit("."))), F.transform("verbs", lambda v: F.concat(v, F.lit(" "), F.col("name"), F.lit("."))))
    texts = named.select("doc_id", "gid", F.explode(said).alias("text")).unionByName(forms.select("doc_id", "gid", F.col("form").alias("text")))
    return texts.select("doc_id", "gid", normalize_for_embedding(F.col("text")).alias("text")).where("text <> ''").distinct()


def unknown_lines(lines: DataFrame) -> DataFrame:
    return lines.where("gid = '#g?'").select("doc_id", "line_no", "body")


def queries(lines: DataFrame, reach: int) -> DataFrame:
    """(doc_id, line_no, text): each unknown line's text, then that of the lines of known speakers around it, in order."""
    unknown = F.col("gid") == "#g?"
    text = lines.where("gid is not null").select("doc_id", F.col("line_no").alias("at"), "gid", normalize_for_embedding(F.col("body")).alias("text"))
    # an unknown line's text goes to itself only
    spread = text.where(unknown | (F.col("text") != "")).withColumn("line_no", F.explode(F.when(unknown, F.array("at")).otherwise(F.sequence(F.col("at") - reach, F.col("at") + reach))))
    kept = spread.join(lines.where(unknown).select("doc_id", "line_no"), ["doc_id", "line_no"])
    order = F.struct((F.col("at") != F.col("line_no")).alias("o"), "at", "text")
    parts = kept.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(order)).alias("p"))
    return parts.select("doc_id", "line_no", F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda t: t != ""), " ").alias("text"))


def named_in(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, at, k, gid): the characters whose name forms a line has, k being the word's place."""
    words = lines.select("doc_id", F.col("line_no").alias("at"), F.posexplode_outer(F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit(_TOKEN), F.lit(1))).alias("k", "form"))  # outer, or a filter on their number searches them again
    return words.join(forms.select("doc_id", "form", "gid"), ["doc_id", "form"]).select("doc_id", "at", "k", "gid")


def mentions(lines: DataFrame, forms: DataFrame, reach: int) -> DataFrame:
    """(doc_id, line_no, gid, weight): every mention around an unknown line, by 1 / (1 + distance)."""
    hits = named_in(lines, forms).groupBy("doc_id", "at", "gid").agg(F.count("*").alias("n"))
    spread = hits.withColumn("line_no", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach))).join(unknown_lines(lines).drop("body"), ["doc_id", "line_no"])
    return spread.groupBy("doc_id", "line_no", "gid").agg(F.sum(F.col("n") / (1 + F.abs(F.col("at") - F.col("line_no")))).alias("weight"))


def explicit_speakers(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, line_no, gid): unknown lines that begin with a verb of speech and a character's name of one or two words."""
    pattern = rf"(?iuU)^\s*[—\-–]?\s*(?:{L.EXPLICIT_VERBS})\s+({L.NAME}(?:\s+{L.NAME})?)"
    name = F.lower(F.regexp_extract(normalize_for_embedding(F.col("body")), pattern, 1))
    return unknown_lines(lines).select("doc_id", "line_no", name.alias("form")).where("form <> ''").join(forms.select("doc_id", "form", "gid"), ["doc_id", "form"]).select("doc_id", "line_no", "gid")


def addressees(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, line_no, addressee): whom a line calls with its first word, a comma or an exclamation mark following."""
    form = F.lower(F.regexp_extract(normalize_for_embedding(F.col("body")), rf"(?U)^\s*[{L.DASHES}]?\s*({L.NAME})[,!]\s", 1))
    return unknown_lines(lines).select("doc_id", "line_no", form.alias("form")).where("form <> ''").join(forms.select("doc_id", "form", F.col("gid").alias("addressee")), ["doc_id", "form"]).drop("form")


def gender_hint(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    word = r"(?U)(?<![\p{L}])(?:%s)(?![\p{L}])"
    return F.when(low.rlike(word % L.HINT_M), "M").when(low.rlike(word % L.HINT_F), "F").when(low.contains("чоловічий голос"), "M").when(low.contains("жіночий голос"), "F")


def _guarded(rows: DataFrame, keep: Column) -> DataFrame:
    """Rows that ``keep`` holds for, of each line; all of a line's rows where it holds for none."""
    of = Window.partitionBy("doc_id", "line_no")
    return rows.withColumn("_keep", keep).withColumn("_any", F.max(F.col("_keep").cast("int")).over(of)).where("_keep or _any = 0").drop("_keep", "_any")


def candidates(lines: DataFrame, chars: DataFrame, near: DataFrame, called: DataFrame, p: Parameters) -> DataFrame:
    """(doc_id, line_no, gid): the characters named around a line, or all if none is; without the one it calls and those of the wrong gender, as long as others remain."""
    every = unknown_lines(lines).join(chars.select("doc_id", "gid"), "doc_id").select("doc_id", "line_no", "gid")
    pool = every.join(near.select("doc_id", "line_no", "gid", F.lit(True).alias("near")), ["doc_id", "line_no", "gid"], "left")
    pool = _guarded(pool, F.coalesce("near", F.lit(False))).select("doc_id", "line_no", "gid")
    pool = _guarded(pool.join(called, ["doc_id", "line_no"], "left"), ~F.coalesce(F.col("gid") == F.col("addressee"), F.lit(False))).drop("addressee")
    if not p.gender_filter:
        return pool
    raw = F.when(F.col("gid").isNotNull(), F.concat("gid", F.lit(": "), "body")).otherwise(F.col("body"))
    hints = lines.withColumn("_raw", raw).withColumn("_before", F.lag("_raw").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("gid = '#g?'")
    hints = hints.select("doc_id", "line_no", F.coalesce(gender_hint(F.col("_before")), gender_hint(F.col("body"))).alias("hint"))
    typed = pool.join(hints, ["doc_id", "line_no"]).join(chars.select("doc_id", "gid", "gender"), ["doc_id", "gid"], "left")
    return _guarded(typed, F.col("hint").isNull() | F.col("gender").isNull() | (F.col("gender") == F.col("hint"))).select("doc_id", "line_no", "gid")


def mean_of_best(scores: DataFrame, k: int) -> DataFrame:
    """(doc_id, line_no, gid, score): the mean of the ``k`` best scores of each candidate's texts."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "line_no", "gid").orderBy(F.desc("score")))
    return scores.withColumn("_r", rank).where(F.col("_r") <= max(k, 1)).groupBy("doc_id", "line_no", "gid").agg(F.avg("score").alias("score"))


def text_scores(lines: DataFrame, texts: DataFrame, pool: DataFrame, p: Parameters) -> DataFrame:
    """(doc_id, line_no, gid, score): similarity of each candidate's texts (doc_id, gid, text) with the line's query, by TF-IDF over both."""
    from ..plans.registry import checkpointed

    asked = queries(lines, p.reach).select(F.concat_ws("/", F.lit("q"), "doc_id", "line_no").alias("id"), "doc_id", "line_no", "text")
    told = texts.select(F.concat_ws("/", F.lit("v"), "doc_id", "gid", F.md5("text")).alias("id"), "doc_id", "gid", "text")
    asked, told = checkpointed(asked), checkpointed(told)  # each is read at several places
    weights = tfidf(asked.select("id", "text").unionAll(told.select("id", "text")))
    q = weights.join(asked.select("id", "doc_id", "line_no"), "id").join(pool, ["doc_id", "line_no"])
    v = weights.withColumnsRenamed({"id": "v", "w": "u"}).join(told.select(F.col("id").alias("v"), "doc_id", "gid"), "v")
    each = q.join(v, ["doc_id", "gid", "token"]).groupBy("doc_id", "line_no", "gid", "v").agg(F.sum(F.col("w") * F.col("u")).alias("score"))
    found = mean_of_best(each, p.mean_of)
    return pool.join(found, ["doc_id", "line_no", "gid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def last_speakers(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, before, after): the last known speaker up to a line, and up to the next tagged line if that follows at once."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    known = F.when(valid_gid(F.col("gid")) & (F.col("gid") != "#g1"), F.col("gid"))
    out = lines.withColumn("before", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("after", F.lead(F.when(F.col("gid").isNotNull(), F.col("before"))).over(w)).select("doc_id", "line_no", "before", "after")


def boosted(lines: DataFrame, scores: DataFrame, near: DataFrame, forms: DataFrame, called: DataFrame, p: Parameters) -> DataFrame:
    """(doc_id, line_no, gid, score, weight, lexical): scores with what stands around each line added, in the order of the rules."""
    own = named_in(lines.where("gid = '#g?'").withColumn("body", normalize_for_embedding(F.col("body"))), forms).withColumnRenamed("at", "line_no")
    hits = own.join(called, ["doc_id", "line_no"], "left").where("addressee is null or addressee <> gid")
    last = hits.groupBy("doc_id", "line_no").agg(F.max_by("gid", "k").alias("lexical"))
    # a character whom the line names is a candidate, near or not
    both = scores.unionByName(hits.select("doc_id", "line_no", "gid").distinct().join(scores, ["doc_id", "line_no", "gid"], "left_anti").withColumn("score", F.lit(0.0)))
    rows = both.join(hits.select("doc_id", "line_no", "gid", F.lit(True).alias("hit")).distinct(), ["doc_id", "line_no", "gid"], "left").join(near, ["doc_id", "line_no", "gid"], "left").join(last, ["doc_id", "line_no"], "left")
    rows = rows.join(last_speakers(lines), ["doc_id", "line_no"]).join(unknown_lines(lines), ["doc_id", "line_no"])
    seen = lines.where(valid_gid(F.col("gid")) & (F.col("gid") != "#g1")).groupBy("doc_id", "gid").agg(F.min("line_no").alias("seen"))
    rows = rows.join(seen, ["doc_id", "gid"], "left")
    weight = F.coalesce("weight", F.lit(0.0))
    verb = F.col("body").rlike(rf"(?iuU)(?<![\p{{L}}])(?:{L.HINT_M}|{L.HINT_F}|каже|говорить|питає)(?![\p{{L}}])")
    add = F.when(verb, 0.03).otherwise(0.0) + F.when(F.col("before") == F.col("gid"), 0.06).otherwise(0.0) + F.when(F.col("after") == F.col("gid"), 0.03).otherwise(0.0) + F.least(F.lit(0.30), 0.04 * weight)
    add = F.when(F.coalesce("hit", F.lit(False)), F.lit(p.lexical)).otherwise(add)
    spoken = F.coalesce(F.col("seen") < F.col("line_no"), F.lit(False))
    rows = rows.withColumns({"_add": add, "_spoken": spoken, "weight": weight})
    any_spoken = F.max(F.col("_spoken").cast("int")).over(Window.partitionBy("doc_id", "line_no")) == 1
    penalty = F.when(any_spoken & ~F.col("_spoken"), F.when(F.col("weight") > 0, p.novelty / 2).otherwise(F.lit(p.novelty))).otherwise(0.0)
    return rows.select("doc_id", "line_no", "gid", F.round(F.col("score") + F.col("_add") - penalty, 6).alias("score"), "weight", "lexical")


def decide(scores: DataFrame, p: Parameters) -> DataFrame:
    """(doc_id, line_no, decision, best_score, margin, reason, top): the ladder of conditions over a line's ranked candidates."""
    of = Window.partitionBy("doc_id", "line_no")
    ranked = scores.withColumns({"rank": F.row_number().over(of.orderBy(F.desc("score"), "gid")), "n": F.count("*").over(of), "mentioned": F.max(F.col("weight") > 0).over(of)}).where(F.col("rank") <= max(p.top, 2))
    rows = ranked.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("rank", "gid", "score"))).alias("t"), F.max("n").alias("n"), F.max("mentioned").alias("mentioned"), F.max("lexical").alias("lexical"))
    best = F.col("t")[0]
    gap = F.when(F.size("t") > 1, F.round(best["score"] - F.try_element_at("t", F.lit(2))["score"], 6)).otherwise(F.lit(0.0))
    reason = F.when(F.col("lexical") == best["gid"], "lexical_hit").when(F.lit(p.force_single) & (F.col("n") == 1), "force_single")
    reason = reason.when((best["score"] >= p.threshold) & (gap >= p.margin), "threshold").when(F.col("mentioned") & (best["score"] >= p.threshold - 0.02), "mention_boost").otherwise("low_conf")
    top = F.transform(F.slice("t", 1, p.top), lambda x: F.struct(x["gid"].alias("gid"), x["score"].alias("score")))
    return rows.select("doc_id", "line_no", F.when(reason == "low_conf", F.lit("#g?")).otherwise(best["gid"]).alias("decision"), best["score"].alias("best_score"), gap.alias("margin"), reason.alias("reason"), top.alias("top"))


def classify(lines: DataFrame, chars: DataFrame, forms: DataFrame, p: Parameters = Parameters(), texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, decision, best_score, margin, reason, top) of every unknown line. ``texts``: (doc_id, gid, text) in place of verbalisations."""
    near, called = mentions(lines, forms, p.reach), addressees(lines, forms)
    pool = candidates(lines, chars, near, called, p)
    scores = text_scores(lines, verbalizers(chars, forms) if texts is None else texts, pool, p)
    decided = decide(boosted(lines, scores, near, forms, called, p), p)
    said = explicit_speakers(lines, forms).select("doc_id", "line_no", F.col("gid").alias("_said"))
    out = decided.join(said, ["doc_id", "line_no"], "left")
    sure = F.col("_said").isNotNull()
    one = F.array(F.struct(F.col("_said").alias("gid"), F.lit(1.0).alias("score")))
    return out.select("doc_id", "line_no", F.coalesce("_said", "decision").alias("decision"), F.when(sure, 1.0).otherwise(F.col("best_score")).alias("best_score"), F.when(sure, 1.0).otherwise(F.col("margin")).alias("margin"), F.when(sure, "explicit_verb_name").otherwise(F.col("reason")).alias("reason"), F.when(sure, one).otherwise(F.col("top")).alias("top"))


def spoken_texts(lines: DataFrame, chars: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, gid, text): the first ``most`` lines that each character speaks, and the names; candidate texts of the smaller models."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "gid").orderBy("line_no"))
    said = lines.where(valid_gid(F.col("gid")) & (F.col("gid") != "#g1")).withColumn("_r", rank).where(F.col("_r") <= most).select("doc_id", "gid", normalize_for_embedding(F.col("body")).alias("text"))
    return said.unionByName(chars.select("doc_id", "gid", F.explode("names").alias("text"))).where("text <> ''").distinct()


def best_by_text(scores: DataFrame, threshold: float) -> DataFrame:
    """(id, decision, score): of rows (id, gid, score) the greatest score of each tag's texts; below the threshold nobody. NaN is the greatest of all, rows without tag or score decide nothing."""
    tags = scores.groupBy("id", "gid").agg(F.max("score").alias("score"))
    order = F.struct(F.col("gid").isNull() | F.col("score").isNull(), ~F.isnan("score"), -F.col("score"), F.col("gid"))
    best = tags.groupBy("id").agg(F.min_by("gid", order).alias("gid"), F.max("score").alias("score"))
    return best.select("id", F.when(F.col("score") >= threshold, F.col("gid")).otherwise(F.lit("#g?")).alias("decision"), "score")


def mean_vectors(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, token, w): the mean of the vectors (id, token, w) of each group (id, gid), brought to length 1."""
    sizes = groups.groupBy("gid").agg(F.count("*").alias("n"))
    mean = weights.join(groups, "id").groupBy("gid", "token").agg(F.sum("w").alias("s")).join(sizes, "gid").select("gid", "token", (F.col("s") / F.col("n")).alias("w"))
    norm = mean.groupBy("gid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return mean.join(norm, "gid").select("gid", "token", (F.col("w") / F.col("norm")).alias("w"))


def apply_decisions(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """``lines`` with the decided speakers."""
    d = decisions.select(F.col("doc_id").alias("_doc"), F.col("line_no").alias("_at"), "decision")
    return lines.join(d, (F.col("doc_id") == F.col("_doc")) & (F.col("line_no") == F.col("_at")), "left").withColumn("gid", F.when(F.col("gid") == "#g?", F.coalesce("decision", "gid")).otherwise(F.col("gid"))).drop("_doc", "_at", "decision")


__all__ = ["Parameters", "apply_decisions", "best_by_text", "classify", "mean_vectors", "similarities", "spoken_texts", "tfidf"]
