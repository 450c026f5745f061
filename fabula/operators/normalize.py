"""Normalising operators on lines: characters, punctuation, tags."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import lexicon as L
from ..lines import in_order, is_dialog, renumber


def fix_lookalikes(text: Column) -> Column:
    """Latin letters that look like Cyrillic ones become those."""
    return F.translate(text, L.LOOKALIKE_LATIN, L.LOOKALIKE_CYRILLIC)


def normalize_spaces(text: Column) -> Column:
    """Narrow and fixed spaces become blanks; zero-width spaces go."""
    return F.translate(text, "\u00a0\u202f\u2009\u2007\u200a\u200b", "     ")


def normalize_body(text: Column) -> Column:
    """Quotation marks, apostrophes, ellipses and blanks in one form each."""
    out = F.translate(text, "\u00a0«»„“”′ʼ'\u200b\u200c\u200d\ufeff", ' """""’’’')
    for pattern, to in ((r"\.{3,}", "…"), (r"[ \t]{2,}", " "), (r"[ \t]+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def normalize_dialog_lead(body: Column) -> Column:
    """A leading dash becomes a long dash and one blank."""
    return F.regexp_replace(body, rf"^\s*[{L.DASHES}]\s*", "— ")


def normalize_for_embedding(text: Column) -> Column:
    out = F.translate(text, "\u00a0'ʼ′‘«»„“”", ' ’’’’"""""')
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def normalize_punctuation_ascii(text: Column) -> Column:
    return F.translate(normalize_spaces(text), "‐‑‒–—―«»„“”’ʼ′‘", "------\"\"\"\"\"''''")


def is_separator(body: Column) -> Column:
    """Blank, or a run of separator characters, or a page number."""
    return (F.trim(normalize_spaces(body)) == "") | body.rlike(L.SEPARATOR)


def collapse_separators(lines: DataFrame) -> DataFrame:
    """Runs of separators become one blank line; lines are numbered anew."""
    flag = F.col("gid").isNull() & is_separator(F.col("body"))
    marked = lines.withColumn("_sep", flag)
    kept = marked.withColumn("_before", F.lag("_sep", 1, False).over(in_order())).where("not (_sep and _before)")
    return renumber(kept.withColumn("body", F.when(F.col("_sep"), F.lit("")).otherwise(F.col("body"))).drop("_sep", "_before"))


def normalize_dialog_punct(lines: DataFrame) -> DataFrame:
    body = normalize_body(F.col("body"))
    return collapse_separators(lines.withColumn("body", F.when(F.col("gid").isNotNull(), normalize_dialog_lead(body)).otherwise(body)))


def reset_dialogs(lines: DataFrame) -> DataFrame:
    """Every line of speech gets the unknown speaker."""
    return lines.withColumn("gid", F.when(is_dialog(F.col("body")), F.lit("#g?")).otherwise(F.col("gid")))


def pretag(lines: DataFrame, narrator: str = "#g1") -> DataFrame:
    """Speech gets the unknown speaker, other text the narrator, blank lines nothing."""
    blank = F.trim(F.col("body")) == ""
    speech = is_dialog(F.col("body"))
    return lines.withColumns({"gid": F.when(blank, F.lit(None)).when(speech, F.lit("#g?")).otherwise(F.lit(narrator)), "indent": F.lit(""), "body": F.when(blank, F.lit("")).when(speech, F.trim("body")).otherwise(F.rtrim("body"))})


def demote_narrator_dialogs(lines: DataFrame) -> DataFrame:
    """Speech that the narrator got becomes unknown."""
    return lines.withColumn("gid", F.when((F.col("gid") == "#g1") & is_dialog(F.col("body")), F.lit("#g?")).otherwise(F.col("gid")))


def narrator_fallback(lines: DataFrame, narrator: str = "#g1") -> DataFrame:
    """The first line of each run of plain text (untagged, not blank, no speech) gets the narrator, that of its document's legend where lines have a ``cast``."""
    own = F.coalesce("cast.narrator", F.lit(narrator)) if "cast" in lines.columns else F.lit(narrator)
    plain = F.col("gid").isNull() & (F.trim("body") != "") & ~is_dialog(F.col("body"))
    before = F.lag("_plain", 1, False).over(in_order())
    marked = lines.withColumn("_plain", plain)
    return marked.withColumn("gid", F.when(F.col("_plain") & ~before, own).otherwise(F.col("gid"))).drop("_plain")


def collapse_same_tags(lines: DataFrame) -> DataFrame:
    """A tag that repeats the one in force goes; blank lines keep it in force, untagged text ends it; speech and unknown tags stay."""
    blank = F.trim(F.col("body")) == ""
    mark = F.when(F.col("gid").isNotNull(), F.col("gid")).when(blank, F.lit(None)).otherwise(F.lit(""))
    force = F.last("_mark", ignorenulls=True).over(in_order().rowsBetween(-(1 << 31), -1))
    marked = lines.withColumn("_mark", mark)
    same = F.col("gid").isNotNull() & (F.col("gid") == force) & (F.col("gid") != "#g?") & ~is_dialog(F.col("body"))
    marked = marked.withColumn("_same", F.coalesce(same, F.lit(False)))
    return marked.withColumns({"gid": F.when(F.col("_same"), F.lit(None)).otherwise(F.col("gid")), "body": F.when(F.col("_same"), F.concat(F.lit(" "), F.col("body"))).otherwise(F.col("body"))}).drop("_mark", "_same")


def clean_dialog_punctuation(lines: DataFrame) -> DataFrame:
    """Known speakers' and the narrator's lines without words go; so do blanks inside quotation marks; all end with a mark, speech with one inside a last quotation mark, whatever stands before it."""
    body, known = F.col("body"), F.col("gid").rlike(r"^#g\d+$") & (F.trim("body") != "[[DIALOG_BOUNDARY]]")
    tight = F.regexp_replace(F.regexp_replace(body, r"\s+([»”\"])", "$1"), r"([«\"“])\s+", "$1")
    told = F.regexp_replace(tight, r"^[,—–\-\s]+|[,—–\-\s]+$", "")
    told = F.when(told.rlike(r"[.!?…]$") | (told == ""), told).otherwise(F.concat(told, F.lit(".")))
    said = F.regexp_replace(tight, r"\s+", " ")
    said = F.when(said.rlike(r"[.!?…]$") | (said == ""), said).when(said.rlike(r"[»”\"]$"), F.regexp_replace(said, r"([»”\"])$", ".$1")).otherwise(F.concat(said, F.lit(".")))
    out = F.when(~F.coalesce(known, F.lit(False)), body).when(F.col("gid") == "#g1", told).otherwise(said)
    empty = F.coalesce(known & (F.trim(body).rlike(r"^[.,—–\-]?$") | ((F.col("gid") == "#g1") & (told == ""))), F.lit(False))
    return renumber(lines.withColumns({"body": out, "_empty": empty}).where("not _empty").drop("_empty"))


def remove_block_markers(lines: DataFrame) -> DataFrame:
    return renumber(lines.where("gid is null or gid <> '#g1' or trim(body) <> '[[DIALOG_BOUNDARY]]'"))


def mark_classifier_tags(lines: DataFrame) -> DataFrame:
    """Lines like "name_gid: text" become unknown speech."""
    pattern = r"(?U)^\s*\w+_gid\s*:\s*(.*)$"
    hit = F.col("gid").isNull() & F.col("body").rlike(pattern)
    return lines.withColumns({"gid": F.when(hit, F.lit("#g?")).otherwise(F.col("gid")), "body": F.when(hit, F.regexp_extract("body", pattern, 1)).otherwise(F.col("body"))})


def correct_recognized(text: Column, corrections: dict[str, str]) -> Column:
    """A recognised text with the wrong phrases replaced one after the other, and a capital first letter."""
    for wrong, right in corrections.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def prepare_speech(text: Column) -> Column:
    """A text for speech synthesis: no quotation marks, compatibility forms, plain dashes, a colon for a dash between blanks."""
    out = F.translate(compatibility_form(F.replace(text, F.lit('"'))), "‒–—―", "----")
    return F.replace(out, F.lit(" - "), F.lit(": "))


@F.pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """NFKC, which no built-in function has."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")
