"""Legends as dimension tables: characters, aliases, hints and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lines import split_lines
from .normalize import fix_lookalikes


def alias_key(name: Column) -> Column:
    """The form in which names are compared: look-alikes mapped, lower case, no punctuation at the ends."""
    return F.lower(F.regexp_replace(F.trim(fix_lookalikes(name)), r"^[\s.,:;!?»«”“’'—–\-()\[\]{}]+|[\s.,:;!?»«”“’'—–\-()\[\]{}]+$", ""))


def parse_legend(legends: DataFrame) -> DataFrame:
    """(doc_id, gid, name, ord) of legend texts (doc_id, text): lines "#gN - name", "#gN: name" or "name -> #gN"; of equal names the last counts."""
    rows = legends.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("ord", "line")).withColumn("line", F.trim("line"))
    tag_first, name_first = r"^(#g\d{1,2})\s*[:\-]\s*(.+)$", r"^(.+?)\s*->\s*(#g\d{1,2})$"
    get = lambda p, i: F.regexp_extract("line", p, i)
    first = F.col("line").rlike(tag_first)
    parsed = rows.where(first | F.col("line").rlike(name_first)).select("doc_id", F.when(first, get(tag_first, 1)).otherwise(get(name_first, 2)).alias("gid"), F.trim(F.when(first, get(tag_first, 2)).otherwise(get(name_first, 1))).alias("name"), "ord")
    return parsed.groupBy("doc_id", "name").agg(F.max_by("gid", "ord").alias("gid"), F.max("ord").alias("ord")).select("doc_id", "gid", "name", "ord")


def narrators(legend: DataFrame) -> DataFrame:
    """(doc_id, narrator): the first character whose name has a narrator's keyword, else #g1."""
    hit = F.lower("name").rlike(L.NARRATOR_KEYWORDS)
    return legend.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(hit, F.col("gid")), F.when(hit, F.col("ord"))), F.lit("#g1")).alias("narrator"))


def _attributes() -> tuple[Column, Column]:
    """(names, attribute tokens) of a legend name "A / B (x, y)"."""
    attrs = F.regexp_extract("name", r"\(([^()]*)\)\s*$", 1)
    names = F.filter(F.transform(F.split(F.regexp_replace("name", r"\([^()]*\)\s*$", ""), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return names, F.filter(F.transform(F.split(attrs, ","), lambda x: F.trim(x)), lambda x: x != "")


def characters(legend: DataFrame) -> DataFrame:
    """(doc_id, gid, ord, names, roles, gender, first_person)."""
    names, tokens = _attributes()
    rows = legend.select("doc_id", "gid", "ord", names.alias("names"), F.transform(tokens, F.lower).alias("tokens"))
    joined = F.array_join("tokens", ", ")
    gender = F.when(F.array_contains("tokens", "f"), "F").when(F.array_contains("tokens", "m"), "M").when(joined.rlike(L.FEMALE_STEMS), "F").when(joined.rlike(L.MALE_STEMS), "M")
    roles = F.filter("tokens", lambda t: ~t.isin(*L.SERVICE_TOKENS))
    said = F.array_join(roles, " ")  # all roles together, without the service token of that meaning
    hero = said.contains("головн") & said.contains("геро")
    return rows.select("doc_id", "gid", "ord", "names", roles.alias("roles"), gender.alias("gender"), F.coalesce(hero, F.lit(False)).alias("first_person"))


def aliases(legend: DataFrame) -> DataFrame:
    """(doc_id, alias, gid, ord): lower-cased names, attribute words and vocatives; of equal ones the first counts."""
    names, tokens = _attributes()
    rows = legend.select("doc_id", "gid", "ord", names.alias("names"), F.transform(tokens, F.lower).alias("tokens"))
    words = F.filter("tokens", lambda t: (F.length(t) >= 2) & ~t.isin(*L.ALIAS_STOPS) & t.rlike(r"^[\p{L}'’\- ]{2,}$"))
    joined = F.array_join("tokens", ", ")
    vocatives = F.concat(F.when(joined.contains("дід") | F.array_contains(F.transform("names", F.lower), "дідо"), F.array(F.lit("діду"))).otherwise(F.array().cast("array<string>")), F.when(joined.rlike("мати|мама"), F.array(F.lit("мамо"))).otherwise(F.array().cast("array<string>")))
    listed = rows.select("doc_id", "gid", "ord", F.posexplode(F.concat("names", words, vocatives)).alias("k", "alias"))
    keyed = listed.select("doc_id", "gid", "ord", "k", alias_key(F.col("alias")).alias("alias")).where("alias <> ''")
    return keyed.groupBy("doc_id", "alias").agg(F.min_by("gid", F.struct("ord", "k")).alias("gid"), F.min(F.struct("ord", "k"))["ord"].alias("ord"))


def alias_conflicts(legend: DataFrame) -> DataFrame:
    """(doc_id, alias, gids): names that several characters have."""
    names, _ = _attributes()
    listed = legend.select("doc_id", "gid", F.explode(names).alias("alias")).select("doc_id", "gid", alias_key(F.col("alias")).alias("alias"))
    return listed.groupBy("doc_id", "alias").agg(F.array_sort(F.collect_set("gid")).alias("gids")).where("size(gids) > 1")


def first_person(chars: DataFrame) -> DataFrame:
    """(doc_id, first_person_gid): the hero, else #g2 where the legend has it."""
    hero = F.min_by(F.when(F.col("first_person"), F.col("gid")), F.when(F.col("first_person"), F.col("ord")))
    return chars.groupBy("doc_id").agg(F.coalesce(hero, F.max(F.when(F.col("gid") == "#g2", F.lit("#g2")))).alias("first_person_gid"))


def relations(legend: DataFrame) -> DataFrame:
    """(doc_id, kind, src_gid, dst_gid): "mother of <name>" in the attributes."""
    names, tokens = _attributes()
    rows = legend.select("doc_id", "gid", names.alias("names"), F.explode(tokens).alias("token"))
    mothers = rows.select("doc_id", F.col("gid").alias("src_gid"), alias_key(F.regexp_extract("token", r"(?iu)(?:мати|мама)\s+(\p{L}[\p{L}’'\-]+)", 1)).alias("alias")).where("alias <> ''")
    return mothers.join(aliases(legend).select("doc_id", "alias", F.col("gid").alias("dst_gid")), ["doc_id", "alias"]).select("doc_id", F.lit("mother").alias("kind"), "src_gid", "dst_gid")


def name_forms(legend: DataFrame) -> DataFrame:
    """(doc_id, form, gid): each name with its case endings, lower-cased; of equal forms the last counts."""
    names, _ = _attributes()
    rows = legend.select("doc_id", "gid", "ord", F.explode(names).alias("name")).withColumn("name", F.lower("name"))
    stem = F.expr("substring(name, 1, length(name) - 1)")
    soft = F.array(*(F.concat(stem, F.lit(e)) for e in ("и", "і", "ю", "єю", "е", "є", "ою")))
    hard = F.array(*(F.concat(F.col("name"), F.lit(e)) for e in ("а", "у", "ом", "ові", "е", "ю", "і")))
    forms = F.concat(F.array("name"), F.when(F.col("name").rlike("[ая]$"), soft).otherwise(hard))
    return rows.select("doc_id", "gid", "ord", F.explode(forms).alias("form")).groupBy("doc_id", "form").agg(F.max_by("gid", "ord").alias("gid"))


def with_first_seen(lines: DataFrame) -> DataFrame:
    """(doc_id, gid, first_line): characters in order of appearance."""
    return lines.where("gid is not null and gid <> '#g?'").groupBy("doc_id", "gid").agg(F.min("line_no").alias("first_line")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")))


def parse_legend_json(legends: DataFrame) -> DataFrame:
    """(doc_id, gid, name, ord) of legends (doc_id, text) that are JSON objects: "#gN" to a name, or a name to "#gN"."""
    rows = legends.select("doc_id", F.explode(F.map_entries(F.from_json("text", "map<string,string>"))).alias("e"))
    key, value = F.trim("e.key"), F.trim("e.value")
    first, last = key.rlike(r"^#g\d+$"), value.rlike(r"^#g\d+$")
    kept = rows.where(first | last).select("doc_id", F.when(first, key).otherwise(value).alias("gid"), F.when(first, value).otherwise(key).alias("name"))
    order = Window.partitionBy("doc_id").orderBy(F.regexp_extract("gid", r"(\d+)", 1).cast("int"), "name")
    return kept.withColumn("ord", (F.row_number().over(order) - 1).cast("int"))


def legend_in_text(docs: DataFrame) -> DataFrame:
    """(doc_id, gid, name, ord) of legends inside manuscripts: the lines "#gN - name" after a line "Легенда" up to a blank one, else all such lines."""
    lines = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("ord", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    state = F.when(F.lower("line").rlike(r"^легенда\s*:?$"), 1).when(F.col("line") == "", 0)
    marked = lines.withColumn("_in", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0)))
    pattern = r"^(#g\d{1,2})\s*[-–—]\s*(.+)$"
    found = marked.where(F.col("line").rlike(pattern)).select("doc_id", F.regexp_extract("line", pattern, 1).alias("gid"), F.regexp_extract("line", pattern, 2).alias("name"), "ord", "_in")
    block = F.max("_in").over(Window.partitionBy("doc_id"))
    return found.withColumn("_block", block).where("_in = _block").groupBy("doc_id", "name").agg(F.max_by("gid", "ord").alias("gid"), F.max("ord").alias("ord")).select("doc_id", "gid", "name", "ord")


def aliases_or_fallback(legend: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (doc_id, alias, gid, ord), and for documents without any alias there plain ones: names, attribute words of three letters or more, vocatives."""
    names, tokens = _attributes()
    lower = F.transform(tokens, F.lower)
    words = F.filter(lower, lambda t: (F.length(t) >= 3) & t.rlike(r"^\p{L}+$"))
    joined = F.array_join(lower, ", ")
    none = F.array().cast("array<string>")
    more = F.concat(F.when(joined.contains("дід") | F.array_contains(F.transform(names, F.lower), "дідо"), F.array(F.lit("діду"))).otherwise(none), F.when(joined.rlike("мати|мама"), F.array(F.lit("мамо"))).otherwise(none))
    listed = legend.select("doc_id", "gid", "ord", F.explode(F.concat(names, words, more)).alias("alias")).withColumn("alias", F.lower(F.trim("alias"))).where("alias <> ''")
    plain = listed.groupBy("doc_id", "alias").agg(F.min_by("gid", "ord").alias("gid"), F.min("ord").alias("ord"))
    return found.select("doc_id", "alias", "gid", "ord").unionByName(plain.join(found.select("doc_id").distinct(), "doc_id", "left_anti"))


def without_accents(text: Column) -> Column:
    """Letters without combining marks, for the closed set of the alphabet."""
    return F.translate(F.translate(text, "\u0301\u0300\u0308\u0306", ""), "йїёЙЇЁґҐ", "иіеИІЕґҐ")


def morph_aliases(legend: DataFrame) -> DataFrame:
    """(doc_id, alias, gids): names, attribute words and their vocative forms, accents removed; kin words with all their forms."""
    base = F.trim(F.regexp_extract("name", r"^([^—–(]*)", 1))
    inside = F.split(F.regexp_extract("name", r"\(([^)]*)\)", 1), ",")
    parts = F.flatten(F.transform(F.concat(F.array(base, F.trim("name")), inside), lambda c: F.split(c, r"[/\\;|]")))
    keys = legend.select("doc_id", "gid", F.explode(F.array_distinct(F.transform(parts, lambda p: alias_key(without_accents(p))))).alias("t")).where("t <> ''")
    stem = F.expr("substring(t, 1, length(t) - 1)")
    kin = F.create_map(*(x for k, v in L.KIN_FORMS.items() for x in (F.lit(k), F.array(*(F.lit(f) for f in v)))))
    none = F.array().cast("array<string>")
    forms = F.concat(F.array("t"), F.when(F.col("t").endswith("о") & (F.length("t") >= 3), F.array(F.concat(stem, F.lit("у")), F.concat(stem, F.lit("е")))).otherwise(none), F.when(F.col("t").endswith("а"), F.array(F.concat(stem, F.lit("о")))).otherwise(none), F.coalesce(F.transform(F.try_element_at(kin, F.col("t")), lambda f: alias_key(without_accents(f))), none))
    return keys.select("doc_id", "gid", F.explode(forms).alias("alias")).groupBy("doc_id", "alias").agg(F.array_sort(F.collect_set("gid")).alias("gids"))


def fuzzy_equal(asked: Column, known: Column) -> Column:
    """Whether two lower-cased names are one: equal, but for a case ending, for a last "й" that became "я", or for one letter."""
    endings = F.array(*(F.lit(e) for e in L.CASE_ENDINGS))
    inflected = F.exists(endings, lambda e: (asked == F.concat(known, e)) | (known == F.concat(asked, e)))
    soft = known.endswith("й") & (asked == F.concat(F.regexp_replace(known, "й$", ""), F.lit("я")))
    return (asked == known) | soft | inflected | (F.levenshtein(asked, known, 1) >= 0)


def fuzzy_gid(name: Column, names: Column) -> Column:
    """The gid of a lower-cased name among ``names``, an array of (ord, alias, gid) in order: equal, else the first fuzzy one, else the nearest with two edits from six letters on."""
    pick = lambda test: F.try_element_at(F.filter(names, test), F.lit(1))["gid"]
    near = pick(lambda n: F.levenshtein(name, n["alias"], 2) >= 0)
    return F.coalesce(pick(lambda n: n["alias"] == name), pick(lambda n: fuzzy_equal(name, n["alias"])), F.when(F.length(name) >= 6, near))


def _quoted_alternatives(names: Column) -> Column:
    """A pattern of all aliases, longer ones first; one that matches nothing for a legend without names."""
    order = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n["alias"])).alias("l"), n["alias"].alias("a"))))
    return F.when(F.size(names) > 0, F.array_join(F.transform(order, lambda x: F.concat(F.lit("\\Q"), x["a"], F.lit("\\E"))), "|")).otherwise(F.lit("(?!)"))


def cast(named: DataFrame) -> DataFrame:
    """(doc_id, cast): all that rules ask of a document's legend, in one row.

    cast: alias (name to gid), names (ord, alias, gid by ord), pattern (all names, longer ones first),
    gender (gid to M or F), me, thoughts, chief, narrator, old (gids of grandfathers), allowed and
    forbidden (gid to scenes), vocatives (form to gids)."""
    from .attribution import constraints
    from .thoughts import thought_character

    chars = characters(named)
    old = F.exists(F.concat("roles", "names"), lambda r: F.lower(r).rlike("^(?:дід|дідо|дідус)"))
    by_doc = lambda t, *cols: t.groupBy("doc_id").agg(*cols)
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    listed = by_doc(aliases(named), pairs("alias", "gid").alias("alias"), F.array_sort(F.collect_list(F.struct("ord", "alias", "gid"))).alias("names"))
    listed = listed.withColumn("pattern", _quoted_alternatives(F.col("names")))
    people = by_doc(
        chars.groupBy("doc_id", "gid").agg(F.min_by("gender", "ord").alias("gender"), F.min("ord").alias("ord"), F.max(old).alias("old"), F.max(F.lower(F.array_join("roles", " ")).rlike(L.TITLE_STEMS)).alias("chief")),
        F.map_from_entries(F.collect_list(F.when(F.col("gender").isNotNull(), F.struct("gid", "gender")))).alias("gender"),
        F.min_by(F.when(F.col("chief"), F.col("gid")), F.when(F.col("chief"), F.col("ord"))).alias("chief"),
        F.array_sort(F.collect_list(F.when(F.col("old"), F.col("gid")))).alias("old"),
    )
    scenes = by_doc(constraints(named).groupBy("doc_id", "gid").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("allowed", "forbidden"))), pairs("gid", "allowed").alias("allowed"), pairs("gid", "forbidden").alias("forbidden"))
    parts = [listed, people, first_person(chars).withColumnRenamed("first_person_gid", "me"), thought_character(chars), narrators(named), scenes, by_doc(morph_aliases(named), pairs("alias", "gids").alias("vocatives"))]
    out = named.select("doc_id").distinct()
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out.select("doc_id", F.struct(*(c for c in out.columns if c != "doc_id")).alias("cast"))


def attach(lines: DataFrame, casts: DataFrame) -> DataFrame:
    """``lines`` with the ``cast`` of their document."""
    return lines.join(casts, "doc_id", "left")


#: Further names of the narrator in a legend of the form {gid_to_names: …}.
NARRATOR_ALIASES = ("наратив", "оповідач", "оповідачка")


def _records_of_text(rows: DataFrame) -> DataFrame:
    """(doc_id, gid, names, aliases, gender) of lines "#gN - name (aliases)"; gender by what the line holds, of a character's first line."""
    pattern = r"(?i)^\s*(#g\d+)\s*[:\-]\s*(.+?)\s*$"
    lines = rows.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("k", "line")).where(F.col("line").rlike(pattern))
    name = F.regexp_extract("line", pattern, 2)
    base = F.trim(F.regexp_extract(name, r"^([^(,]*)", 1))
    low = F.lower(name)
    has = lambda *parts: F.array_contains(F.transform(F.array(*map(F.lit, parts)), lambda p: low.contains(p)), True)
    gender = F.when(has(" жін", " f)", "(f", "female"), "F").when(has(" чол", " m)", "(m", "male"), "M")
    inside = F.flatten(F.transform(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1)), lambda p: F.split(p, "[;,，、]")))
    more = F.filter(F.transform(inside, lambda a: F.trim(a)), lambda a: (a != "") & (F.lower(a) != F.lower(base)))
    parsed = lines.select("doc_id", "k", F.regexp_extract("line", pattern, 1).alias("gid"), base.alias("base"), more.alias("more"), gender.alias("gender")).where("base <> ''")
    parts = parsed.groupBy("doc_id", "gid").agg(F.array_sort(F.collect_list(F.struct("k", "base", "more", "gender"))).alias("p"))
    return parts.select("doc_id", "gid", F.array_distinct(F.transform("p", lambda x: x["base"])).alias("names"), F.array_distinct(F.flatten(F.transform("p", lambda x: x["more"]))).alias("aliases"), F.col("p")[0]["gender"].alias("gender"))


def legend_records(legends: DataFrame) -> DataFrame:
    """(doc_id, gid, names, aliases, gender) of legends (doc_id, text) of any shape.

    JSON objects have, for each gid, a record (names, aliases, gender), a list of names or one name;
    or they are {gid_to_names: {gid: names}, narrator_gid}, whose narrator gets NARRATOR_ALIASES.
    Other texts are lines "#gN - name (aliases)". Empty names go; a value of another kind gives a
    character without names; JSON that is no object gives none, and so do null and empty texts."""
    rows = legends.where("trim(text) <> ''").withColumn("v", F.try_parse_json("text"))
    plain = _records_of_text(rows.where("v is null"))
    kind = lambda c: F.schema_of_variant(c)
    some = rows.where("v is not null").select("doc_id", "v").withColumn("kind", kind(F.col("v"))).where("kind like 'OBJECT%'")
    bridge = F.try_variant_get("v", "$.gid_to_names", "variant")
    bridged = bridge.isNotNull() | F.try_variant_get("v", "$.name_to_gid", "variant").isNotNull()
    some = some.withColumn("narrator", F.when(bridged, F.try_variant_get("v", "$.narrator_gid", "string"))).withColumn("bridged", bridged)
    some = some.withColumn("v", F.when(F.col("bridged"), F.coalesce(bridge, F.parse_json(F.lit("{}")))).otherwise(F.col("v"))).withColumn("entries", F.try_variant_get("v", "$", "map<string,variant>"))
    each = some.select("doc_id", "narrator", "bridged", F.explode("entries").alias("gid", "rec")).withColumn("kind", kind(F.col("rec")))
    strings = lambda path: F.filter(F.coalesce(F.try_variant_get("rec", path, "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))
    none = F.array().cast("array<string>")
    record, listed, text = F.col("kind").like("OBJECT%") & ~F.col("bridged"), F.col("kind").like("ARRAY%"), (F.col("kind") == "STRING") & ~F.col("bridged")
    names = F.when(record, strings("$.names")).when(listed, strings("$")).when(text, F.array(F.try_variant_get("rec", "$", "string"))).otherwise(none)
    extra = F.when(record, strings("$.aliases")).when(F.col("gid") == F.col("narrator"), F.array(*map(F.lit, NARRATOR_ALIASES))).otherwise(none)
    gender = F.when(record, F.try_variant_get("rec", "$.gender", "string"))
    found = each.select("doc_id", "gid", names.alias("names"), extra.alias("aliases"), F.when(gender.isin("M", "F"), gender).alias("gender"))
    return found.unionByName(plain)
