"""Speaker attribution by patterns in a line and in the lines before it: expressions and windows, no Python and no join.

Rules take lines with ``cast`` (``legend.attach``), what their document's legend says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lines import in_order, is_dialog, is_speech
from .legend import alias_key, fuzzy_gid
from .normalize import fix_lookalikes

_D = f"[{L.DASHES}]"
_WORD = r"[\p{L}][\p{L}\d’'\-]+"
#: A name of up to three words; the longest part of it that the legend has counts.
_NAME = rf"{_WORD}(?:\s+{_WORD}){{0,2}}"
#: Speech that names its speaker after a dash.
OWN_NAME = rf"(?sU)^\s*[{L.DASHES}{L.QUOTES}].*?{L.END_PUNCTUATION}?\s*{_D}\s*{L.NAME}"


def gid_of(name: Column) -> Column:
    """The gid of an alias, but the narrator's."""
    gid = F.try_element_at("cast.alias", alias_key(name))
    return F.when(gid != "#g1", gid)


def matched(text: Column, before: str, after: str, group: int) -> Column:
    """A group of the pattern ``before``, the legend's names as a group, ``after``; null where it doesn't match."""
    pattern = F.concat(F.lit(f"{before}("), "cast.pattern", F.lit(f"){after}"))
    return F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(group)), F.lit(""))


def last_named(text: Column) -> Column:
    """The gid of the last of the legend's names in a text, but the narrator's."""
    found = F.regexp_extract_all(text, F.concat(F.lit("(?iu)"), "cast.pattern"), F.lit(0))
    return gid_of(F.try_element_at(found, F.lit(-1)))


def _assigned(lines: DataFrame, name: Column, allowed: Column) -> DataFrame:
    """Lines with the speaker whose alias ``name`` begins with, where ``allowed`` and the alias is not the narrator's."""
    part = lambda k: F.when(F.size("_name") >= k, gid_of(F.array_join(F.slice("_name", 1, k), " ")))
    named = lines.withColumn("_found", F.when(allowed, name))  # a column of its own, so that its patterns are searched once
    named = named.withColumn("_name", F.when(F.col("_found") != "", F.split(alias_key(F.col("_found")), r"\s+")))
    return named.withColumn("gid", F.when(F.col("_name").isNotNull(), F.coalesce(part(3), part(2), part(1), "gid")).otherwise(F.col("gid"))).drop("_found", "_name")


def _last_letter_gender(name: Column) -> Column:
    """The gender that a name's last letter suggests."""
    return F.when(name.rlike("(?iu)[аяеью]$"), "F").when(name.rlike("(?iu)[бвгґджзклмнпрстфхцчшщйо]$"), "M")


def inline_sayer(lines: DataFrame) -> DataFrame:
    """Unknown speech with "— said Name" or "— Name said" after a dash gets that speaker, if verb and name agree in gender; "said I" the first person."""
    say = f"({L.SAY_VERBS})"
    marks = r"[\s,—»\"“”'’]*"  # what may stand between the dash and the attribution
    verb_name = rf"(?iuU){_D}{marks}{say}\s+({_WORD}|я)(?![\p{{L}}])"
    name_verb = rf"(?iuU){_D}{marks}({_WORD})\s+{say}(?![\p{{L}}])"
    body = F.col("body")
    unknown = (F.col("gid") == "#g?") & is_dialog(body)
    marked = lines.withColumn("_after", F.when(unknown, F.regexp_extract(body, verb_name, 2)))
    vn = F.col("_after") != ""
    marked = marked.withColumn("_who", F.when(vn, F.col("_after")).otherwise(F.when(F.col("_after") == "", F.regexp_extract(body, name_verb, 1))))
    marked = marked.withColumn("_verb", F.lower(F.when(vn, F.regexp_extract(body, verb_name, 1)).otherwise(F.when(F.col("_who") != "", F.regexp_extract(body, name_verb, 2)))))
    verb, name = F.col("_verb"), F.col("_who")
    gender = F.when(verb.isin(*L.SAY_FEMININE), "F").when(verb.isin("кажу", "каже"), F.lit(None)).when(verb.isin(*L.SAY_MASCULINE), "M")
    agrees = gender.isNull() | _last_letter_gender(name).isNull() | (gender == _last_letter_gender(name))
    out = _assigned(marked.withColumn("_me", F.lower(name) == "я"), name, agrees & ~F.col("_me"))
    return out.withColumn("gid", F.when(F.col("_me"), F.coalesce("cast.me", F.lit("#g2"))).otherwise(F.col("gid"))).select(lines.columns)


def inline_no_verb(lines: DataFrame) -> DataFrame:
    """Unknown speech with "… — Name," or "… — Name:" after an end mark or a comma gets that speaker."""
    pattern = rf"(?iuU)^\s*{_D}.+?(?:{L.END_PUNCTUATION}|,)\s*{_D}\s*({_NAME})\s*[,:]"
    return _assigned(lines, F.regexp_extract("body", pattern, 1), F.col("gid") == "#g?")


def inline_verb_name(lines: DataFrame) -> DataFrame:
    """Speech with "— verb Name" or "— Name verb" after an end mark or a comma gets that speaker, whoever had it but the narrator."""
    lead = rf"(?iuU)(?:{L.END_PUNCTUATION}|,)\s*{_D}\s*"
    verb_name, name_verb = rf"{lead}(?:{L.VERBS_ANY})\s+({_NAME})", rf"{lead}({_NAME})\s*,?\s*(?:{L.VERBS_ANY})(?![\p{{L}}])"
    name = F.coalesce(F.nullif(F.regexp_extract("body", verb_name, 1), F.lit("")), F.regexp_extract("body", name_verb, 1))
    return _assigned(lines, name, F.col("gid").isNotNull() & (F.col("gid") != "#g1"))


def inline_first_person(lines: DataFrame) -> DataFrame:
    """Speech followed by a dash and a verb in the first person gets the first person."""
    pattern = rf"(?iuU)^\s*[{L.DASHES}{L.QUOTES}].+?\s*{_D}[^{L.DASHES}]*(?<![\p{{L}}])(?:{L.FIRST_PERSON_VERBS})(?![\p{{L}}])"
    hit = is_speech(F.col("gid"), F.col("body")) & F.col("body").rlike(pattern)
    return lines.withColumn("gid", F.when(hit, F.coalesce("cast.me", "gid")).otherwise(F.col("gid")))


def _spoken_gender(verb: Column) -> Column:
    low = F.lower(verb)
    return F.when(low.rlike(f"^(?:{L.VERBS_F})$"), "F").when(low.rlike(f"^(?:{L.VERBS_M})$"), "M")


def _with_leads(lines: DataFrame, to: str, text: Column) -> DataFrame:
    """Column ``to``: the gid of "Name … said": a name of the legend at the start, a verb of speech within 180 characters, both of one gender."""
    parts = lambda k: matched(F.col("_plain"), r"(?iuUs)^\s*", rf"\s+.{{0,180}}?(?<![\p{{L}}])({L.VERBS_ANY})(?![\p{{L}}])", k)
    out = lines.withColumn("_plain", F.trim(fix_lookalikes(text))).withColumn("_who", F.lower(parts(1)))
    out = out.withColumns({"_verb": F.when(F.col("_who").isNotNull(), parts(2)), "_gid": F.when(F.col("_who").isNotNull(), gid_of(F.col("_who")))})
    by_name = F.when(F.col("_who").rlike("[ая]$"), "F").when(F.col("_who").rlike("(?:о|ій|ий)$"), "M")
    have = F.coalesce(F.try_element_at("cast.gender", F.col("_gid")), by_name)
    return out.withColumn(to, F.when(F.coalesce(have == _spoken_gender(F.col("_verb")), F.lit(True)), F.col("_gid"))).drop("_plain", "_who", "_verb", "_gid")


def leadin_sayer(lines: DataFrame) -> DataFrame:
    """Unknown speech after "Name … said" in one of the two untagged lines before it, or before its own first dash, quotation mark or colon, gets that speaker.

    The nearer line counts; a crowd's noise in a line ends the search."""
    w = in_order()
    noise = F.coalesce(F.col("body").rlike(f"(?iuU){L.CROWD}.*:?$"), F.lit(False))
    preface = F.when(F.col("gid") == "#g?", F.element_at(F.split(F.coalesce("body", F.lit("")), rf"[—\-«\"„“”'’:]\s*", 2), 1))
    marked = lines.withColumns({"_free": F.col("gid").isNull(), "_noise": noise, "_preface": preface})
    marked = _with_leads(marked, "_lead", F.when(F.col("_free") & ~F.col("_noise"), F.col("body")))
    marked = _with_leads(marked, "_own", F.when(~F.col("_preface").rlike(f"(?iuU){L.CROWD}.*:?$"), F.col("_preface")))
    at = lambda c, k: F.lag(c, k).over(w)
    marked = marked.withColumns({"_f1": F.coalesce(at("_free", 1), F.lit(False)), "_n1": F.coalesce(at("_noise", 1), F.lit(False)), "_l1": at("_lead", 1), "_f2": F.coalesce(at("_free", 2), F.lit(False)), "_n2": F.coalesce(at("_noise", 2), F.lit(False)), "_l2": at("_lead", 2)})
    far = F.col("_f1") & F.col("_f2")
    stop = F.col("_n1") | (far & F.col("_n2") & F.col("_l1").isNull())
    found = F.when(~stop, F.coalesce(F.when(F.col("_f1"), F.col("_l1")), F.when(far, F.col("_l2")), F.col("_own")))
    return marked.withColumn("gid", F.when(F.col("gid") == "#g?", F.coalesce(found, "gid")).otherwise(F.col("gid"))).select(lines.columns)


def _hand_on(lines: DataFrame, lead: Column, guarded: bool) -> DataFrame:
    """The first speech within two lines after one with a ``lead`` gets it, the nearer lead first; if ``guarded``, not speech that names its own speaker."""
    w = in_order()
    told = F.col("gid").isNull() | (F.col("gid") == "#g1")
    marked = lines.withColumns({"_lead": F.when(told & (F.trim("body") != ""), lead), "_speech": F.coalesce(is_speech(F.col("gid"), F.col("body")), F.lit(False))})
    got = F.coalesce(F.lag("_lead", 1).over(w), F.when(~F.lag("_speech", 1, False).over(w), F.lag("_lead", 2).over(w)))
    free = ~F.col("body").rlike(OWN_NAME) if guarded else F.lit(True)
    marked = marked.withColumn("_got", got)
    return marked.withColumn("gid", F.when(F.col("_speech") & free, F.coalesce("_got", "gid")).otherwise(F.col("gid"))).select(lines.columns)


def heard_voice(lines: DataFrame) -> DataFrame:
    """"… голос Name:" hands the next speech to the character of that name, case endings and one wrong letter (two from six letters on) allowed."""
    name = F.regexp_extract(F.trim(fix_lookalikes(F.col("body"))), rf"(?iuU)\bголос\s+({L.NAME}(?:\s+{L.NAME})?)\s*:\s*$", 1)
    gid = F.when(name != "", fuzzy_gid(F.lower(name), F.col("cast.names")))
    return _hand_on(lines, F.when(gid != "#g1", gid), guarded=True)


def possessive_voice(lines: DataFrame) -> DataFrame:
    """"… Name … голос:" hands the next speech to the last character named before the voice."""
    plain = F.trim(fix_lookalikes(F.col("body")))
    pattern = r"(?iuUs)^(.*)\bголос\s*:\s*$"
    return _hand_on(lines, F.when(plain.rlike(pattern), last_named(F.regexp_extract(plain, pattern, 1))), guarded=False)


def named_leadin(lines: DataFrame) -> DataFrame:
    """"… Name … said … :" hands the next speech to the last character named before the last colon, if a verb of speech stands in the 120 characters before it."""
    before = F.regexp_extract(F.col("body"), r"(?s)^(.*):", 1)
    tail = F.substring(before, -120, 120)
    return _hand_on(lines, F.when(tail.rlike(f"(?iu)(?:{L.COLON_VERBS})"), last_named(before)), guarded=True)


def narrator_dialog_hint(lines: DataFrame) -> DataFrame:
    """Speech tagged as the narrator's becomes the first person's (#g2) with a first-person word, else unknown."""
    mine = F.col("body").rlike(rf"(?iuU)(?<![\p{{L}}])(?:{L.FIRST_PERSON_WORDS})(?![\p{{L}}])")
    hit = (F.col("gid") == "#g1") & is_dialog(F.col("body"))
    return lines.withColumn("gid", F.when(hit & mine, F.lit("#g2")).when(hit, F.lit("#g?")).otherwise(F.col("gid")))


def with_prologue(lines: DataFrame) -> DataFrame:
    """Column in_prologue: whether the line's scene is a prologue. lines: with scene."""
    return lines.withColumn("in_prologue", F.coalesce(F.lower("scene").startswith("пролог"), F.lit(False)))


def forbidden(gid: Column, scene: Column) -> Column:
    """Whether a scene's lists shut a character out."""
    low, allowed, shut = F.lower(scene), F.try_element_at("cast.allowed", gid), F.try_element_at("cast.forbidden", gid)
    out = ((F.size(allowed) > 0) & ~F.array_contains(allowed, low)) | F.array_contains(shut, low)
    return F.coalesce(scene.isNotNull() & out, F.lit(False))


def demote_forbidden(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Speakers that a scene's allow or forbid list shuts out become unknown; if ``strict``, so do grandfathers without any list outside the prologue.

    lines: with scene (if ``strict`` also in_prologue), which are dropped."""
    gid, scene = F.col("gid"), F.col("scene")
    out = forbidden(gid, scene)
    if strict:
        listed = F.coalesce(F.size(F.try_element_at("cast.allowed", gid)) > 0, F.lit(False)) | F.coalesce(F.size(F.try_element_at("cast.forbidden", gid)) > 0, F.lit(False))
        out = out | (~listed & F.coalesce(F.array_contains("cast.old", gid), F.lit(False)) & ~F.col("in_prologue") & scene.isNotNull())
    return lines.withColumn("gid", F.when(out & (gid != "#g1"), F.lit("#g?")).otherwise(gid)).drop("scene", "in_prologue")


def constraints(legend: DataFrame) -> DataFrame:
    """(doc_id, gid, allowed, forbidden, time_tags, locations) of legend attributes like "allow: Пролог" and "сцена: …"."""
    tokens = F.transform(F.split(F.regexp_extract("name", r"\(([^()]*)\)\s*$", 1), ","), lambda t: F.lower(F.trim(t)))

    def of(keys: str) -> Column:
        got = F.filter("t", lambda t: t.rlike(rf"^(?:{keys})\s*:"))
        return F.array_sort(F.array_distinct(F.transform(got, lambda t: F.trim(F.regexp_replace(t, r"^[^:]*:", "")))))

    return legend.select("doc_id", "gid", tokens.alias("t")).select("doc_id", "gid", of("allow|сцена|scene").alias("allowed"), of("forbid").alias("forbidden"), of("час|time").alias("time_tags"), of("локація|loc").alias("locations"))


def context_mentions(lines: DataFrame, aliases: DataFrame, reach: int = 11) -> DataFrame:
    """(doc_id, line_no, gid, weight): sums of 1 / (1 + distance) over mentions of each character within ``reach`` lines of unknown speech.

    A mention goes to the 2 * reach + 1 lines around it, so the join is on equal line numbers."""
    words = lines.select("doc_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(rf"({_WORD})"), F.lit(1)))).alias("w"))
    mentions = words.withColumn("alias", alias_key(F.col("w"))).join(aliases.select("doc_id", "alias", "gid"), ["doc_id", "alias"]).groupBy("doc_id", "line_no", "gid").agg(F.lit(1).alias("one"))
    near = mentions.select("doc_id", "gid", F.col("line_no").alias("at"), F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)).alias("line_no"))
    asked = lines.where("gid = '#g?'").select("doc_id", "line_no")
    return near.join(asked, ["doc_id", "line_no"]).groupBy("doc_id", "line_no", "gid").agg(F.round(F.sum(1 / (1 + F.abs(F.col("at") - F.col("line_no")))), 6).alias("weight"))


def previous_speakers(lines: DataFrame) -> DataFrame:
    """Columns previous and following: the known speaker in force at a line, and at the next one."""
    known = F.when(~F.col("gid").isin("#g?", "#g1"), F.col("gid"))
    out = lines.withColumn("previous", F.last(known, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("following", F.lead(F.when(F.col("gid").isNotNull(), F.col("previous"))).over(in_order()))
