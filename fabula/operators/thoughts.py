"""Thoughts, aphorisms, titles and the first person: rules on a line and the lines around it, by windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lines import in_order, is_dialog, renumber
from .attribution import OWN_NAME
from .legend import alias_key

#: The text of a line between two blocks.
BOUNDARY = "[[DIALOG_BOUNDARY]]"
_WORDS = r"(?iuU)(?<![\p{L}])(?:%s)(?![\p{L}])"


def _tail(body: Column) -> Column:
    """What follows the dash after a closed quotation that starts a body; null without one."""
    pattern = rf"(?s)^\s*[{L.QUOTES}].+[{L.CLOSING}]\s*[, \t]*[{L.DASHES}]\s*(.+)$"
    return F.when(body.rlike(pattern), F.regexp_extract(body, pattern, 1))


def _pure_quote(body: Column) -> Column:
    return body.rlike(rf"^\s*[{L.QUOTES}].+[{L.CLOSING}]\s*[.!?…]*\s*$")


def _near_cue(cues: str) -> Column:
    """Whether one of the two lines before or after is untagged or the narrator's and has a cue."""
    w = in_order()
    told = F.when(F.col("gid").isNull() | (F.col("gid") == "#g1"), F.col("body")).otherwise(F.lit(""))
    hit = told.rlike(_WORDS % cues)
    out = F.lit(False)
    for k in (1, 2):
        out = out | F.coalesce(F.lag(hit, k).over(w), F.lit(False)) | F.coalesce(F.lead(hit, k).over(w), F.lit(False))
    return out


def demote_thoughts(lines: DataFrame) -> DataFrame:
    """Quoted speech with a thinking word after its dash, but no character's name there, becomes unknown."""
    tail = F.when(F.col("gid") != "#g1", _tail(F.col("body")))
    low = F.lower(tail)
    named = F.coalesce(F.exists("cast.names", lambda n: low.contains(n["alias"])), F.lit(False))
    return lines.withColumn("gid", F.when(tail.rlike(_WORDS % L.THOUGHT_VERBS) & ~named, F.lit("#g?")).otherwise(F.col("gid")))


def thought_character(chars: DataFrame) -> DataFrame:
    """(doc_id, thoughts): the character that stands for thoughts: #g20 if it is named so, else the first one named so, else #g20."""
    names, roles = F.lower(F.array_join("names", " ")), F.lower(F.array_join("roles", " "))
    order = F.when(names.contains("думки") | roles.contains("думк"), F.when(F.col("gid") == "#g20", -2).otherwise(F.lit(-1))).when(F.col("gid") == "#g20", F.lit(0))
    return chars.withColumn("_o", order).where("_o is not null").groupBy("doc_id").agg(F.min_by("gid", F.struct("_o", "ord")).alias("thoughts"))


def thoughts_to_tag(lines: DataFrame) -> DataFrame:
    """Quotations with a thinking word after their dash, or alone next to narration about a thought, go to the character of thoughts, if there is one."""
    thought = _tail(F.col("body")).rlike(_WORDS % f"{L.THOUGHT_VERBS}|{L.THOUGHT_PHRASES}")
    alone = _tail(F.col("body")).isNull() & _pure_quote(F.col("body")) & _near_cue(L.NEAR_THOUGHT)
    marked = lines.withColumn("_hit", (F.col("gid") != "#g1") & (F.coalesce(thought, F.lit(False)) | alone))
    return marked.withColumn("gid", F.when(F.col("_hit"), F.coalesce("cast.thoughts", "gid")).otherwise(F.col("gid"))).drop("_hit")


def demote_near_aphorism(lines: DataFrame) -> DataFrame:
    """A known speaker's quotation that stands alone next to narration about a saying or thought becomes unknown."""
    hit = ~F.col("gid").isin("#g1", "#g?") & _pure_quote(F.col("body")) & _near_cue(L.NEAR_APHORISM)
    return lines.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("gid", F.when(F.col("_hit"), F.lit("#g?")).otherwise(F.col("gid"))).drop("_hit")


def rank_title_leadin(lines: DataFrame) -> DataFrame:
    """Unknown speech without an own name gets the first character named in the narration two lines or one line before, or the chief where a title stands there.

    Names are found as substrings, as in the rule's text: the earliest legend entry wins."""
    lines = lines.withColumn("_told", F.when(F.col("gid").isNull() | (F.col("gid") == "#g1"), F.lower("body")))
    told = F.col("_told")
    named = F.filter("cast.names", lambda n: told.contains(n["alias"]))
    found = F.coalesce(F.try_element_at(named, F.lit(1))["gid"], F.when(told.rlike(_WORDS % L.TITLES), F.col("cast.chief")))
    w = in_order()
    marked = lines.withColumn("_found", found)
    marked = marked.withColumn("_lead", F.coalesce(F.lag("_found", 2).over(w), F.lag("_found", 1).over(w)))
    free = (F.col("gid") == "#g?") & is_dialog(F.col("body")) & ~F.col("body").rlike(OWN_NAME)
    return marked.withColumn("gid", F.when(free, F.coalesce("_lead", "gid")).otherwise(F.col("gid"))).drop("_found", "_lead", "_told")


def first_person_leadin(lines: DataFrame) -> DataFrame:
    """"I say:" hands the next speech within three lines to the first person, tagged or not; so does "— said I" at a line's end.

    The lead-in holds until the first speech after it: no earlier speech may lie between."""
    leads = F.col("body").rlike(r"(?U):\s*$") & F.col("body").rlike(rf"(?iuU)(?:{L.FIRST_PERSON_LEADIN})\s*:\s*$")
    speech = is_dialog(F.col("body"))
    free = speech & (F.col("gid").isNull() | (F.col("gid") == "#g?"))
    marked = lines.withColumns({"_lead": leads & ~speech, "_free": free})
    w = in_order()
    armed = F.lit(False)
    for k in (1, 2, 3):
        between = F.lit(False)
        for j in range(1, k):
            between = between | F.coalesce(F.lag("_free", j).over(w), F.lit(False))
        armed = armed | (F.coalesce(F.lag("_lead", k).over(w), F.lit(False)) & ~between)
    marked = marked.withColumn("_armed", armed)
    tail = (F.col("gid") == "#g?") & speech & F.col("body").rlike(rf"(?iuU)(?<![\p{{L}}])(?:{L.FIRST_PERSON_TAIL})(?![\p{{L}}])")
    hit = F.col("cast.me").isNotNull() & (F.coalesce(tail, F.lit(False)) | (F.col("_free") & F.col("_armed")))
    body = F.when(hit & F.col("gid").isNull(), F.trim("body")).otherwise(F.col("body"))
    return marked.withColumns({"_new": F.when(hit, F.col("cast.me")).otherwise(F.col("gid")), "body": body}).drop("gid").withColumnRenamed("_new", "gid").select(lines.columns)


def mark_blocks(lines: DataFrame) -> DataFrame:
    """A narrator's boundary line before each dialog block but the first, unless a blank or a narrator's line is there already; numbered anew.

    lines: with block_id, the blocks of the manuscript as it was read (``scenes.with_block``); a text without tags has none, and stays as it is."""
    w = in_order()
    start = (F.col("block_id") > 1) & ~F.col("block_id").eqNullSafe(F.lag("block_id").over(w))
    before = F.lag(F.coalesce(F.trim("body"), F.lit("")), 1, "").over(w)
    needed = start & ~((F.lag("gid").over(w).isNull() & (before == "")) | F.coalesce(F.lag("gid").over(w) == "#g1", F.lit(False)))
    marked = lines.withColumn("_mark", F.coalesce(needed, F.lit(False)))
    own = F.struct(F.col("gid").alias("gid"), F.col("body").alias("body"))
    parts = F.when(F.col("_mark"), F.array(F.struct(F.lit("#g1").alias("gid"), F.lit(BOUNDARY).alias("body")), own)).otherwise(F.array(own))
    out = marked.select("*", F.posexplode_outer(parts).alias("_k", "_part")).withColumns({"gid": F.col("_part.gid"), "body": F.col("_part.body")})
    return renumber(out, "_k").select(lines.columns)


def block_child_after_prologue(lines: DataFrame, gid: str = "#g4") -> DataFrame:
    """After the end of a prologue (its end mark or the next heading) a character that only it knows becomes unknown."""
    head = F.coalesce(F.col("body"), F.lit(""))
    begins = head.rlike(r"(?iuU)^\s*пролог\.?\s*$")
    ends = head.rlike(r"(?iuU)^\s*(?:кінець прологу\.?|(?:розділ|частина|глава)\s+\w+)\s*$")
    w = in_order()
    begun = F.max(begins.cast("int")).over(w.rowsBetween(-(1 << 31), -1))
    over = F.max(F.when(F.col("_ends") & (F.col("_begun") == 1), 1).otherwise(0)).over(w.rowsBetween(-(1 << 31), -1))
    marked = lines.withColumns({"_ends": ends, "_begun": begun}).withColumn("_over", over)
    return marked.withColumn("gid", F.when((F.col("gid") == gid) & (F.col("_over") == 1), F.lit("#g?")).otherwise(F.col("gid"))).drop("_ends", "_begun", "_over")


def first_person_to_child(lines: DataFrame, parent: str = "#g3") -> DataFrame:
    """Unknown speech in the first person that addresses the parent by name gets the first person (#g2 without a hint)."""
    low = F.lower("body")
    names = F.transform(F.filter("cast.names", lambda n: n["gid"] == parent), lambda n: F.element_at(F.split(n["alias"], " "), 1))
    addressed = F.exists(names, lambda n: F.regexp(F.concat(F.lit(" "), low), F.concat(F.lit("[\\s«\"'—–-]\\Q"), n, F.lit("\\E\\s*[,!?:]"))))
    hit = (F.col("gid") == "#g?") & is_dialog(F.col("body")) & low.rlike(_WORDS % L.CHILD_WORDS) & F.coalesce(addressed, F.lit(False))
    return lines.withColumn("gid", F.when(hit, F.coalesce("cast.me", F.lit("#g2"))).otherwise(F.col("gid")))


def narrator_dialogs(lines: DataFrame) -> DataFrame:
    """Speech tagged as the narrator's: #g2 with a first-person word; else whom "голос <Name>" in one of the three lines before names; else unknown."""
    mine = F.col("body").rlike(_WORDS % L.NARRATOR_FIRST_PERSON)
    name = F.regexp_extract("body", r"(?iuU)голос\s+(\p{L}[\p{L}\d’'\-]+)", 1)
    marked = lines.withColumn("_voice", F.when(name != "", F.try_element_at("cast.alias", alias_key(name))))
    near = F.coalesce(*(F.lag("_voice", k).over(in_order()) for k in (1, 2, 3)))
    marked = marked.withColumn("_near", near)
    hit = (F.col("gid") == "#g1") & is_dialog(F.col("body"))
    return marked.withColumn("gid", F.when(hit & mine, F.lit("#g2")).when(hit, F.coalesce("_near", F.lit("#g?"))).otherwise(F.col("gid"))).drop("_voice", "_near")
