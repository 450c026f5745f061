"""Joins that are not on equal keys, made of equal keys: names one or two letters apart, the nearest earlier row, a line within spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of so many letters may differ by two edits.
TWO_EDITS = 6
#: So many vector components stand in one group of ``best_products``, on each side.
GROUP = 1 << 19


def _without_one(words: Column) -> Column:
    """All words that leaving out one letter of each word of an array gives."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1 << 20))))
    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), cut))


def deletions(word: Column, most: int) -> Column:
    """A word and all that it becomes without one letter, or up to two from TWO_EDITS letters on; two words within so many edits share one of these."""
    once = _without_one(F.array(word))
    twice = _without_one(F.array_distinct(once)) if most > 1 else F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(word), once, F.when(F.length(word) >= TWO_EDITS - 1, twice).otherwise(F.array().cast("array<string>"))))


def _keys_of_one(word: Column, others: Column, is_name: bool) -> Column:
    """Keys that a name and a form share just once if they are one edit apart: the word without its k-th letter and k, or the shorter word, which the longer one is without a letter; equal words share that too.

    others: the lengths of the other side's words, as only words of such a length need the second kind."""
    cut = F.transform(F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: i > 0), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1 << 20))))
    shorter = F.transform(F.array_distinct(_without_one(F.array(word))), lambda w: F.concat(F.lit("=" if is_name else "+"), w))
    none = F.array().cast("array<string>")
    keys = F.concat(F.array(F.concat(F.lit("="), word)), cut, F.when(F.array_contains(others, F.length(word) - 1), shorter).otherwise(none))
    return F.concat(keys, F.when(F.array_contains(others, F.length(word) + 1), F.array(F.concat(F.lit("+"), word))).otherwise(none)) if is_name else keys


def fuzzy_join(names: DataFrame, forms: DataFrame, most: int = 2) -> DataFrame:
    """(name, form, distance) of each distinct name (name) and form (form) at most one edit apart, or two if ``most`` is and the name has TWO_EDITS letters.

    An equi-join on deletion neighbourhoods, then the distance; nulls match nothing. It is a sort-merge join, as a planner takes the neighbourhoods for no larger than the words and may send one side through the driver."""
    words = lambda t, c: t.where(F.col(c).isNotNull()).select(c).distinct()
    lengths = lambda t, c: t.agg(F.collect_set(F.length(c)).alias("_lengths"))
    name, form = words(names, "name"), words(forms, "form")
    if most > 1:
        keyed = lambda t, c: t.select(c, F.explode(deletions(F.col(c), most)).alias("_key"))
        pairs = keyed(name, "name").hint("merge").join(keyed(form, "form"), "_key").select("name", "form").distinct()
    else:
        keyed = lambda t, c, o: t.crossJoin(F.broadcast(o)).select(c, F.explode(_keys_of_one(F.col(c), F.col("_lengths"), c == "name")).alias("_key"))
        pairs = keyed(name, "name", lengths(forms, "form")).hint("merge").join(keyed(form, "form", lengths(names, "name")), "_key")
        pairs = pairs.where(~F.col("_key").rlike("^[0-9]") | (F.col("name") != F.col("form"))).select("name", "form")
    distance = F.levenshtein("name", "form")
    allowed = F.when(F.length("name") >= TWO_EDITS, F.lit(most)).otherwise(F.lit(1))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= allowed)


def _matrix(vectors: pd.Series, there: pd.Series) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors as rows of one matrix, zeros where they have nothing, and where they have something (None: everywhere)."""
    sizes = vectors.map(len).to_numpy()
    out, full = np.zeros((len(sizes), sizes.max())), np.arange(sizes.max()) < sizes[:, None]
    out[full] = np.concatenate(vectors.to_list())
    for i, t in enumerate(there):
        if t is not None:
            full[i, : sizes[i]] = t
    out[~full] = 0
    return out, None if full.all() else full


def _products(a: pd.DataFrame, b: pd.DataFrame, keys: np.ndarray, wide: int = 256, high: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``a`` and each run of equal keys of ``b``: the greatest product, whether a product isn't null, whether there is another vector. Products are summed component by component, so equal vectors give equal products."""
    (x, x_full), (y, y_full) = (_matrix(t["vector"], t["there"]) for t in (a, b))
    width = min(x.shape[1], y.shape[1])
    starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    shape = (len(x), len(starts))
    best, some, other = np.full(shape, -np.inf), np.zeros(shape, bool), np.zeros(shape, bool)
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
    for i in range(0, len(x), wide):
        for j in range(0, len(y), high):
            at = slice(i, i + wide), slice(j, j + high)
            total, valid = np.zeros((len(x[at[0]]), len(y[at[1]]))), None if x_full is None and y_full is None else np.zeros((len(x[at[0]]), len(y[at[1]])), bool)
            for k in range(width):
                term = x[at[0], k, None] * y[None, at[1], k]
                if valid is not None:
                    both = (True if x_full is None else x_full[at[0], k, None]) & (True if y_full is None else y_full[None, at[1], k])
                    term = np.where(both, term, 0.0)
                    valid |= both
                total += term
            apart = a["id"].to_numpy()[at[0], None] != b["id"].to_numpy()[None, at[1]]
            valid = apart if valid is None else valid & apart
            total[~valid] = -np.inf
            first = np.r_[0, np.flatnonzero(np.diff(run[at[1]])) + 1]
            of = slice(i, i + wide), run[at[1]][first]
            best[of] = np.maximum(best[of], np.maximum.reduceat(total, first, axis=1))
            some[of] |= np.logical_or.reduceat(valid, first, axis=1)
            other[of] |= np.logical_or.reduceat(apart, first, axis=1)
    return best, some, other


def best_products(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, label, score): the greatest dot product of each vector asked for (id, vector) with the vectors of each label of ``rows`` (id, vector, label), those of its own id left out; ids are unique.

    Products are of the components that both have and are null where there is none; vectors without components match nothing.
    Both sides are dealt into groups of bounded size, each group of one side meets each of the other, and a pair of groups gives back one row for each id and label; no pair of vectors is ever written."""
    some = F.col("id").isNotNull() & (F.size(F.coalesce("vector", F.array().cast("array<float>"))) > 0)
    there = F.when(F.exists("vector", lambda v: v.isNull()), F.transform("vector", lambda v: v.isNotNull()))
    kept = [t.where(some).withColumn("there", there) for t in (asked, rows)]
    n, m = (-(-(t.agg(F.sum(F.size("vector"))).first()[0] or 0) // GROUP) or 1 for t in kept)
    group = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one, all_ = kept[0].withColumns({"p": group(n)}).withColumn("q", every(m)), kept[1].withColumns({"q": group(m)}).withColumn("p", every(n))
    kinds = dict(rows.dtypes)

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "label": [], "score": [], "nan": []})
        keys, labels = pd.factorize(b["label"], use_na_sentinel=False)
        order = np.argsort(keys, kind="stable")
        best, valid, other = _products(a, b.iloc[order], keys[order])
        i, k = np.nonzero(other)
        score = np.where(valid[i, k], best[i, k], np.nan)  # what is NaN here is null there
        return pd.DataFrame({"id": a["id"].to_numpy()[i], "label": pd.Series(labels, dtype=object)[k].to_numpy(), "score": score, "nan": valid[i, k] & np.isnan(score)})

    met_kinds = f"id {kinds['id']}, label {kinds['label']}, score double, nan boolean"
    parts = one.groupBy("p", "q").cogroup(all_.groupBy("p", "q")).applyInPandas(met, met_kinds)
    return parts.groupBy("id", "label").agg(F.max(F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("score"))).alias("score"))


def nearest_earlier(asked: DataFrame, rows: DataFrame, by: list[str], reach: int, value: str) -> DataFrame:
    """``asked`` (doc_id, line_no, by…, …) with ``value`` and ``at`` of the nearest row of ``rows`` (doc_id, line_no, by…, value) in an earlier line of the document with equal ``by``, at most ``reach`` lines before; null if there is none.

    Both are one table whose rows of a document are in order, so that a window carries the last value on."""
    there = rows.where(F.col(value).isNotNull()).select("doc_id", "line_no", *by, F.struct(F.col("line_no").alias("at"), F.col(value).alias("value")).alias("_last"))
    both = asked.withColumn("_asked", F.lit(1)).unionByName(there.withColumn("_asked", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("doc_id", *by).orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_found", F.last("_last", ignorenulls=True).over(before)).where("_asked = 1")
    near = F.col("line_no") - F.col("_found.at") <= reach
    return out.select(*asked.columns, F.when(near, F.col("_found.value")).alias(value), F.when(near, F.col("_found.at")).alias("at"))


def within_spans(lines: DataFrame, spans: DataFrame, bin_size: int = 64) -> DataFrame:
    """``lines`` (doc_id, line_no, …) with the columns of each span (doc_id, start_line, end_line, …) that holds them, both ends included.

    A span stands in each bin of lines that it touches, so the join is on (document, bin)."""
    cut = spans.where("start_line <= end_line").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_line") / bin_size), F.floor(F.col("end_line") / bin_size))))
    own = lines.withColumn("_bin", F.floor(F.col("line_no") / bin_size))
    return own.join(cut, ["doc_id", "_bin"]).where("line_no between start_line and end_line").drop("_bin")
