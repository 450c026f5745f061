"""Sound-effect tags, emotion correction, and chunks of text for models."""

from __future__ import annotations

import logging
import re
from functools import cache
from pathlib import Path
from re import _constants as op, _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L

#: Hits of one tag that lie nearer than this become one.
MERGE_GAP = 40
POSITIONS = ("precede_line", "after_punctuation_newline", "after_match", "after_paragraph", "before_match", "previous_punctuation", "replace_match")

#: (tag, pattern, position, tag after a heading or null, confidence)
Rule = tuple[str, str, str, str | None, float]


def checked_rules(text: str) -> tuple[tuple[Rule, ...], tuple[tuple[str, str], ...]]:
    """(rules, (tag, why) of those left out) of a YAML text: lists ``structural`` and ``actions`` of rules with a tag, a pattern (key ``pattern`` or ``keywords``) and a position.

    Patterns ignore case; of ``flags`` (names joined by |) those besides IGNORECASE are put before the pattern."""
    import yaml

    spec = yaml.safe_load(text) or {}
    out, dropped = [], []
    for r in [*(spec.get("structural") or []), *(spec.get("actions") or [])]:
        tag = str(r.get("tag")) if isinstance(r, dict) else str(r)
        try:
            flags = [f.strip() for f in str(r.get("flags") or "").split("|") if f.strip() not in ("", "IGNORECASE", "I")]
            letters = "".join({"MULTILINE": "m", "M": "m", "DOTALL": "s", "S": "s"}[f] for f in flags)
            pattern = (f"(?{letters}:" + r.get("pattern", r.get("keywords")) + ")") if letters else r.get("pattern", r.get("keywords"))
            re.compile(pattern)
            if r["position"] not in POSITIONS:
                raise ValueError(f"no position {r['position']}")
            if not re.fullmatch(r"#\w+", r["tag"]):
                raise ValueError("no tag")
            out.append((r["tag"], pattern, r["position"], r.get("post_tag"), float(r.get("confidence", 0.5))))
        except (KeyError, TypeError, ValueError, AttributeError, re.error) as e:
            dropped.append((tag, f"{type(e).__name__}: {e}"))
    return tuple(out), tuple(dropped)


def rules_from(text: str) -> tuple[Rule, ...]:
    """The rules of a YAML text; those that are left out are logged (``checked_rules``)."""
    rules, dropped = checked_rules(text)
    for tag, why in dropped:
        logging.getLogger(__name__).warning("sound rule %s left out: %s", tag, why)
    return rules


@cache
def default_rules() -> tuple[Rule, ...]:
    """The rules of the package's file."""
    return rules_from((Path(__file__).parent.parent / "rules" / "sounds.yaml").read_text(encoding="utf-8"))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(tag, pattern, position, post_tag, confidence, ord) of rules."""
    rows = [(*r, i) for i, r in enumerate(rules or default_rules())]
    return spark.createDataFrame(rows, "tag string, pattern string, position string, post_tag string, confidence double, ord int")


def unknown_tags(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(tag, n): the sound tags on lines of their own that no rule has."""
    tags = docs.select(F.explode(F.split("text", "\n")).alias("tag")).withColumn("tag", F.trim("tag")).where(r"tag rlike '^#[A-Za-z]\\w*$' and not tag rlike '^#g'")
    known = rules.select("tag").unionAll(rules.where("post_tag is not null").select("post_tag"))
    return tags.join(known, "tag", "left_anti").groupBy("tag").agg(F.count("*").alias("n"))


def _literals(parsed) -> tuple[str, ...]:
    """Strings in lower case one of which stands in whatever a parsed pattern matches; () if none is known."""
    runs, found = [""], []
    for kind, arg in parsed:
        if kind is op.LITERAL:
            runs[-1] += chr(arg)
            continue
        runs.append("")
        if kind is op.SUBPATTERN:
            found.append(_literals(arg[3]))
        elif kind is op.BRANCH:
            each = [_literals(b) for b in arg[1]]
            found.append(tuple(x for e in each for x in e) if all(each) else ())
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
            found.append(_literals(arg[2]))
    return max([*found, *((r.lower(),) for r in runs if r)], key=lambda f: min(map(len, f), default=0), default=())


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Strings with Cyrillic letters and no others, one of which a text in lower case has if it matches the pattern, whatever the case; () if none is known.

    Texts with other forms of these letters (U+1C80 to U+1C8F) may match without."""
    known = _literals(_parser.parse(pattern, re.IGNORECASE))
    return known if all(re.search("[\u0400-\u04ff]", k) and not re.search("[^\\W\u0400-\u04ff]", k) for k in known) else ()


_OTHER_FORMS = re.compile("[\u1c80-\u1c8f]")


def possible(text: str, rules: tuple[Rule, ...]) -> list[Rule]:
    """The rules that may match in a text: a search for plain strings, which costs little beside their patterns."""
    if not text.isascii() and _OTHER_FORMS.search(text):
        return list(rules)
    low = text.lower()
    return [r for r in rules if not needed(r[1]) or any(k in low for k in needed(r[1]))]


def _place(mode: str, text: str, m: re.Match) -> tuple[int, int]:
    """(start, point of insertion) of a hit."""
    if mode == "after_punctuation_newline":
        n = re.compile(r"[.,?!]|\n|\Z").search(text, m.end())
        return m.start(), n.end()
    if mode == "after_match":
        return m.start(), re.compile(r"[.,?!…]{0,3}").match(text, m.end()).end()
    if mode == "after_paragraph":
        return m.start(), len(text)
    if mode == "before_match":
        return m.start(), m.start()
    if mode == "previous_punctuation":
        return m.start(), max((text.rfind(c, 0, m.start()) for c in ".,?!"), default=-1) + 1
    return m.start(), m.end()


def spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, str, float]]:
    """(start, point, tag, confidence) of a paragraph's hits: near ones of a tag merged, of overlapping ones the surest kept."""
    found = []
    for tag, pattern, mode, _, sure in rules:
        if mode == "precede_line":
            continue
        last = None
        for m in re.finditer(pattern, text, re.IGNORECASE):
            start, point = _place(mode, text, m)
            if last and start - last[1] <= MERGE_GAP:
                last[1] = max(last[1], point)
            else:
                last = [start, point, tag, sure]
                found.append(last)
    out: list[list] = []
    for s in sorted(found, key=lambda s: (s[0], -s[3])):
        if out and s[0] < out[-1][1]:
            if s[3] > out[-1][3]:
                out[-1] = s
        else:
            out.append(s)
    return [tuple(s) for s in out]


def tag_text(text: str, rules: tuple[Rule, ...]) -> tuple[str, int]:
    """(text with tags on lines of their own, their number); tags that an earlier run put after sentences are made anew."""
    n, lines = 0, []
    for r in rules:
        if r[2] == "after_punctuation_newline":
            text = re.sub(rf"\n{re.escape(r[0])}(?=\n|$)", "", text)
    rules = possible(text, rules)
    for line in text.split("\n"):
        head = next((r for r in rules if r[2] == "precede_line" and re.match(rf"\s*(?:{r[1]})", line, re.IGNORECASE)), None)
        new = head and (not lines or lines[-1].strip() != head[0])
        if new:
            lines.append(head[0])
            n += 1
        lines.append(line)
        if new and head[3]:
            lines.append(head[3])
    parts = re.split(r"(\n\s*\n)", "\n".join(lines))
    for k in range(0, len(parts), 2):
        hits = spans(parts[k], rules)
        n += len(hits)
        for _, point, tag, _ in reversed(hits):
            parts[k] = f"{parts[k][:point]}\n{tag}\n{parts[k][point:]}"
    out = re.sub(r"^(#\w+)(?:\s*\n\1(?!\w))+", r"\1", "".join(parts), flags=re.MULTILINE)
    out = re.sub(r"[ \t]+([.,?!])", r"\1", out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", out)).strip() + "\n", n


def tag_sounds(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, text, n_tags) of documents (doc_id, text).

    Places of hits need offsets, so texts that may have a hit go to Python in Arrow batches; all others are
    only tidied, which built-in functions do. One scan; the test is for a letter that all rules need."""
    rules = rules or default_rules()

    @F.pandas_udf("text string, n_tags int")
    def tagged(texts: pd.Series) -> pd.DataFrame:
        got = [(None, None) if t is None else tag_text(t, rules) for t in texts]
        return pd.DataFrame({"text": pd.Series([g[0] for g in got], dtype=object), "n_tags": pd.array([g[1] for g in got], dtype="Int32")})

    text = F.coalesce("text", F.lit(""))
    any_rule = text.rlike("[\u0400-\u04ff\u1c80-\u1c8f]") if all(needed(r[1]) for r in rules) else F.lit(True)
    tidy = text
    for pattern, to in ((r"[ \t]+([.,?!])", "$1"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")):
        tidy = F.regexp_replace(tidy, pattern, to)
    plain = F.when(text == "", F.lit("")).otherwise(F.concat(tidy, F.lit("\n")))
    rows = docs.select("doc_id", "text").withColumn("_made", tagged(F.when(any_rule | text.rlike(r"(?m)^#\w"), text)))
    return rows.select("doc_id", F.coalesce("_made.text", plain).alias("text"), F.coalesce("_made.n_tags", F.lit(0)).alias("n_tags"))


def emotion_tag(scores: Column) -> Column:
    """The sound tag of the leading emotion, if it has one."""
    best = F.element_at(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1)["k"]
    tags = F.create_map(*(F.lit(x) for kv in L.EMOTION_TAGS.items() for x in kv))
    return F.try_element_at(tags, best)


def _without(scores: Column, emotion: str) -> Column:
    return F.map_filter(scores, lambda k, v: k != emotion)


def correct_emotions(text: Column, scores: Column) -> Column:
    """Scores (map) after the keyword rules, emotion by emotion: a keyword lifts a low score to 0.95 and lowers a leading Sadness and None."""
    out = scores
    low = F.lower(text)
    for emotion, words in L.EMOTION_KEYWORDS.items():
        hit = low.rlike("|".join(words)) & (F.coalesce(F.element_at(out, F.lit(emotion)), F.lit(0.0)) < 0.5)
        lift = F.transform_values(F.map_concat(_without(out, emotion), F.create_map(F.lit(emotion), F.lit(0.95))), lambda k, v: F.when((k == "Sadness") & (F.lit(emotion) != "Sadness") & (v > 0.5), F.lit(0.2)).when((k == "None") & (v > 0.5), F.lit(0.1)).otherwise(v))
        out = F.when(hit, lift).otherwise(out)
    return out


def sentence_chunks(text: Column, most: int = 2000) -> Column:
    """Sentences packed in order into chunks of at most ``most`` characters; a longer sentence is a chunk of its own."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last, s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sentences, F.array().cast("array<string>"), step)


def clean_grammar(text: Column) -> Column:
    """Plain apostrophes, no blank before punctuation, none between a digit and its mark."""
    out = F.translate(text, "’ʼ`", "'''")
    return F.regexp_replace(F.regexp_replace(out, r"\s+([.,!?;:])", "$1"), r"(\d)\s+([.,])", "$1$2")
