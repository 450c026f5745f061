"""Column functions on words and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; 0.8 at least where one holds the other; 1 for two empty texts."""
    most = F.greatest(F.length(a), F.length(b))
    plain = F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)
    return F.when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.greatest(plain, F.lit(0.8))).otherwise(plain)


def should_ignore(command: Column, stops: tuple[str, ...] = ()) -> Column:
    """Fewer than three letters, digits only, or a stop phrase."""
    text = F.lower(F.trim(command))
    return (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) < 3) | text.rlike(r"^\d+$") | (text.isin(*stops) if stops else F.lit(False))


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def is_called(text: Column, word: str, least: float = 0.75) -> Column:
    """Whether a command has the wake word, or a word of nearly its length that is similar enough."""
    low = F.lower(F.trim(text))
    near = F.exists(F.split(low, r"\s+"), lambda w: (w == word) | ((F.length(w) >= max(2, len(word) - 2)) & (similarity(w, F.lit(word)) >= least)))
    return (F.length(low) >= 2) & near


def without_call(text: Column, word: str, least: float = 0.75) -> Column:
    """A command without its wake word: cut off at the start, else all words like it left out; never empty if there are other words."""
    low = F.lower(text)
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[,.!?;:]+|[,.!?;:]+$", "")
    kept = F.array_join(F.filter(words, lambda w: (bare(w) != word) & (similarity(bare(w), F.lit(word)) < least)), " ")
    rest = F.when(kept != "", kept).when(F.size(words) > 1, F.array_join(F.slice(words, 2, 1 << 20), " ")).otherwise(text)
    return F.when(low.startswith(word + " ") | low.startswith(word + ","), F.trim(F.substring(text, len(word) + 2, 1 << 30))).otherwise(rest)


def route(command: Column, cached: Column, routes: tuple[tuple[str, str], ...], most_words: int = 6) -> Column:
    """What handles a command: the planner beyond ``most_words`` words, nothing below three letters, the cache, the first route (pattern, name) that matches, else the model."""
    text = F.lower(F.trim(command))
    out = F.when(F.size(F.split(text, r"\s+")) > most_words, "planner").when(F.length(text) < 3, "ignored").when(cached, "cache")
    for pattern, name in routes:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("model")


def is_audible(samples: Column, least: float = 0.003) -> Column:
    """Whether the mean of the samples' absolute values is above ``least``."""
    return F.coalesce(F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.nullif(F.size(samples), F.lit(0)) > least, F.lit(False))


def extract_json(text: Column) -> Column:
    """The outermost braces of an answer, without code fences and model tokens; null if there are none."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<\|[^|]*\|>", ""), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))


def softmax(scores: Column) -> Column:
    """The softmax of an array."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
