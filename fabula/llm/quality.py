"""Quality of documents: fixed limits, then outliers among a group's text statistics by robust Mahalanobis distances.

Each text gives counts of words, symbols, repeated lines and repeated words;
transformed (logarithms of sizes, square roots of shares) they are a vector of
whole numbers. A group is one language and source. Its location and scatter
are the minimum covariance determinant: the half of its rows whose scatter has
the least determinant, found by concentration steps from three starts (medians
and median deviations; signs of the centred rows; all rows), each of which
takes the half that lies nearest by the scatter before. Then, as usual, the
scatter is brought to the scale of a normal distribution's median distance and
estimated once more without the rows beyond its 97.5 % point, and rows beyond
CUTOFF are rejected.

All rows of a group take part in each step. A step is one aggregation of sums
by group, start and distance, the distances in classes of fixed relative width
(1.1 %), so a group of any size leaves its tasks as a few hundred rows; the
half is whole classes, the one that holds its last row included. Sums are
those of whole numbers, so neither order nor partitions change a result.
Groups of fewer than LEAST usable rows join the small ones of their language,
and these, if still too few, all small ones; a last group of fewer than LEAST
rejects nothing.

Defined results: null and empty texts have no words and fail the limits; rows
that fail them are no part of an estimate; null languages and sources are
values like others; repeated rows count as often as they stand; an empty table
gives an empty result. Words and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BYTE_VALUES, SPACE, Scratch, fold_hashes, span_hashes, text_chunks, word_spans

#: A document of fewer words fails, and one of which more than this percentage of words stand in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Words of a window.
WINDOW = 3
#: Rows that a group needs for an estimate of its own.
LEAST = 50
#: Vectors hold transformed statistics times UNIT.
UNIT = 1000
#: Least standard deviation of each statistic, in units: what differs by less is no outlier.
FLOOR = np.array([200.0, 50.0, 100.0, 150.0, 150.0])
#: Steps of concentration at most.
STEPS = 12
#: Squared distances for five statistics: the normal distribution's median, its 97.5 % point, and the limit of what is kept (ten deviations, as sizes and shares have longer tails than the normal distribution).
MEDIAN, REWEIGHT, CUTOFF = 4.351460, 12.832502, 100.0
#: Classes of squared distances: this many to a power of two.
CLASSES = 64
NAMES = ["words", "word_chars", "symbols", "dup_lines", "repeat_words"]
P = len(NAMES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether an equal one stands earlier in its row, whether another equal one stands anywhere in it)."""
    order = np.lexsort((np.arange(len(hashes)), hashes, rows))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    earlier, any_other = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    earlier[order[1:]] = same
    any_other[order[1:]] = same
    any_other[order[:-1]] |= same
    return earlier, any_other


def counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text: words, their code points, symbols, lines with a word, those equal to an earlier one, words in repeated windows."""
    n = len(offs) - 1
    starts, ends, rows = word_spans(data, offs)
    out = np.zeros((n, 6), np.int64)
    if not len(starts):
        return out
    out[:, 0] = np.bincount(rows, minlength=n)
    points = np.r_[0, np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])]
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    out[:, 1], out[:, 2] = (c[offs[1:]] - c[offs[:-1]] for c in (points, symbols))
    breaks = np.flatnonzero(data == 10)
    first, last = np.sort(np.r_[offs[:-1], breaks + 1]), np.sort(np.r_[breaks, offs[1:]])  # of all lines of all texts
    seen = np.r_[0, np.cumsum(~SPACE[data])]
    solid = seen[last] > seen[first]
    first, last = first[solid], last[solid]
    of = np.searchsorted(offs, first, "right") - 1
    out[:, 3] = np.bincount(of, minlength=n)
    values = BYTE_VALUES[data]
    out[:, 4] = np.bincount(of[_repeats(span_hashes(values, first, last), of)[0]], minlength=n)
    if len(starts) >= WINDOW:
        words = span_hashes(values, starts, ends)
        inside = rows[: len(rows) - WINDOW + 1] == rows[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        again = at[_repeats(fold_hashes([words[at + i] for i in range(WINDOW)]), rows[at])[1]]
        covered = np.zeros(len(words), bool)
        for i in range(WINDOW):
            covered[again + i] = True
        out[:, 5] = np.bincount(rows[covered], minlength=n)
    return out


def vectors(c: np.ndarray) -> np.ndarray:
    """Transformed statistics of ``counts``' rows, as whole numbers of 1 / UNIT."""
    words, chars, symbols, lines, dup, repeated = (c[:, i].astype(float) for i in range(6))
    some = np.maximum(words, 1)
    parts = [np.log(some), np.log(np.maximum(chars, 1) / some), np.sqrt(symbols / np.maximum(chars, 1)), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeated / some)]
    return np.round(UNIT * np.stack(parts, axis=1)).astype(np.int64)


def _measure(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("_text")):
                c = counts(data, offs)
                failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 5] > MAX_REPEATED * c[:, 0])
                v = vectors(c)
                rest = batch.slice(first, stop - first)
                columns = [rest.column(k) for k in keep] + [pa.array(c[:, i]) for i in (0, 1, 2, 4, 5)] + [pa.array(failed)] + [pa.array(v[:, i]) for i in range(P)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"v{i}" for i in range(P))])

    return run


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source; counts, base_failed and the vector v0 to v4 of each text."""
    kind = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind += "".join(f", {c} long" for c in longs) + ", base_failed boolean" + "".join(f", v{i} long" for i in range(P))
    return docs.select("doc_id", "lang", "source", F.col("text").alias("_text")).mapInArrow(_measure(["doc_id", "lang", "source"]), kind)


# --- estimates --------------------------------------------------------------------------

def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``g``: their language and source, or the small groups that they belong to; null where even these are too few."""
    sizes = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("own"))
    small = F.col("own") < LEAST
    in_lang = F.sum(F.when(small, F.col("own"))).over(Window.partitionBy("lang"))
    sizes = sizes.withColumn("lang_small", in_lang)
    rest = sizes.where(small & (F.col("lang_small") < LEAST)).agg(F.coalesce(F.sum("own"), F.lit(0)).alias("rest"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    level = F.when(~small, F.concat_ws("\x00", text("lang"), text("source"))).when(F.col("lang_small") >= LEAST, F.concat_ws("\x00", text("lang"), F.lit("small"))).when(F.col("rest") >= LEAST, F.lit("small"))
    keys = sizes.join(F.broadcast(rest)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), level.alias("g"))
    return rows.join(keys, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


_SUM_NAMES = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}{j}" for i, j in _PAIRS)]
_MODEL = "g string, start int, n long, logdet double, mean array<double>, inverse array<double>"


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"v{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}{j}") for i, j in _PAIRS)]


def scatter(row: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance by sums, exact until the last division; the least deviations are added to the diagonal."""
    n = int(row["n"])
    s = [int(row[f"s{i}"]) for i in range(P)]
    cov = np.zeros((P, P))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = (n * int(row[f"s{i}{j}"]) - s[i] * s[j]) / (n * n)
    return np.array([x / n for x in s]), cov + np.diag(FLOOR**2)


def fitted(mean: np.ndarray, cov: np.ndarray) -> dict[str, object]:
    """What distances need: the mean, and the inverse scatter's upper triangle with doubled sides."""
    inverse = np.linalg.inv(cov)
    return {"mean": mean.tolist(), "inverse": [float(inverse[i, j] * (1 + (i != j))) for i, j in _PAIRS], "logdet": float(np.linalg.slogdet(cov)[1])}


def distance() -> Column:
    """Squared Mahalanobis distance of v0 to v4 by the model's ``mean`` and ``inverse``."""
    d = [F.col(f"v{i}") - F.col("mean")[i] for i in range(P)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + F.col("inverse")[k] * d[i] * d[j]
    return total


def class_of(d2: Column) -> Column:
    """A distance's class; all below 2**-20 are one."""
    return F.floor(F.log2(F.greatest(d2, F.lit(2.0**-20))) * CLASSES).cast("int")


def _models(sums: DataFrame) -> DataFrame:
    """A model for each row of sums (g, start, n, ...)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"g": r["g"], "start": r["start"], "n": r["n"], **fitted(*scatter(r))} for r in part.to_dict("records")]
            yield pd.DataFrame(rows, columns=["g", "start", "n", "logdet", "mean", "inverse"])

    return sums.select("g", "start", *_SUM_NAMES).mapInPandas(run, _MODEL)


def _halves(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(g, start, class, c, ...): sums of the rows by classes of their distance, up to the class that holds the half's last row."""
    classes = rows.join(models, "g").withColumn("class", class_of(distance())).groupBy("g", "start", "class").agg(*_sums())
    by = Window.partitionBy("g", "start")
    total = classes.withColumn("before", F.sum("n").over(by.orderBy("class")) - F.col("n")).withColumn("total", F.sum("n").over(by))
    return total.where(F.col("before") < F.floor((F.col("total") + P + 1) / 2))


def _medians(rows: DataFrame, value: Column, key: list[str]) -> DataFrame:
    """The lower median of a whole number for each key, by its values' counts."""
    c = rows.select(*key, value.alias("x")).groupBy(*key, "x").agg(F.count("*").alias("c"))
    by = Window.partitionBy(*key)
    c = c.withColumn("upto", F.sum("c").over(by.orderBy("x"))).withColumn("half", (F.sum("c").over(by) + 1) / 2)
    return c.where(F.col("upto") >= F.floor("half")).groupBy(*key).agg(F.min("x").alias("x"))


def _per_group(medians: DataFrame, name: str) -> DataFrame:
    """(g, name): each statistic's median in an array."""
    return medians.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(name))


def _starts(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The three first models of each group."""
    tall = lambda r, f: r.select("g", F.posexplode(F.array(*(f(i) for i in range(P)))).alias("i", "y"))
    middle = scratch.save(_per_group(_medians(tall(rows, lambda i: F.col(f"v{i}")), F.col("y"), ["g", "i"]), "middle"), "middle")
    off = rows.join(middle, "g")
    spread = scratch.save(_per_group(_medians(tall(off, lambda i: F.abs(F.col(f"v{i}") - F.col("middle")[i])), F.col("y"), ["g", "i"]), "spread").join(middle, "g"), "spread")
    unit = lambda i: F.col("spread")[i] * 1.4826 + F.lit(float(FLOOR[i]))
    scaled = rows.join(spread, "g").select("g", *((((F.col(f"v{i}") - F.col("middle")[i]) / unit(i))).alias(f"u{i}") for i in range(P)))
    norm = F.sqrt(sum((F.col(f"u{i}") ** 2 for i in range(P)), F.lit(0.0)))
    signs = scaled.withColumn("norm", norm).select("g", *(F.coalesce(F.round(F.try_divide(f"u{i}", "norm") * 1_000_000), F.lit(0)).cast("long").alias(f"v{i}") for i in range(P)))
    found = signs.groupBy("g").agg(*_sums()).join(spread, "g")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                unit = 1.4826 * np.array(r["spread"], float) + FLOOR
                sign = np.zeros((P, P))
                for i, j in _PAIRS:
                    sign[i, j] = sign[j, i] = int(r[f"s{i}{j}"]) / int(r["n"]) / 1e12
                shape = np.outer(unit, unit) * sign * P + np.diag(FLOOR**2)
                out += [{"g": r["g"], "start": k, "n": r["n"], **fitted(np.array(r["middle"], float), c)} for k, c in ((0, np.diag(unit**2)), (1, shape))]
            yield pd.DataFrame(out, columns=["g", "start", "n", "logdet", "mean", "inverse"])

    whole = rows.groupBy("g").agg(*_sums()).withColumn("start", F.lit(2))
    return found.mapInPandas(run, _MODEL).unionByName(_models(whole))


def _rescaled(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``models`` with ``scale``: what their distances are divided by, so that their median is the normal distribution's."""
    last = _halves(rows, models).groupBy("g").agg(F.max("class").alias("class"))
    return models.join(last.select("g", (F.pow(F.lit(2.0), (F.col("class") + 0.5) / CLASSES) / MEDIAN).alias("scale")), "g")


def estimates(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(g, mean, inverse, scale, ...): the reweighted minimum covariance determinant of each group's rows (g, v0 to v4)."""
    models = scratch.save(_starts(scratch, rows), "starts")
    least = None
    for _ in range(STEPS):
        halves = _halves(rows, models).groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in _SUM_NAMES))
        models = scratch.save(_models(halves), "models")
        now = models.agg(F.sum(F.round("logdet", 9).cast("decimal(38,9)"))).first()[0]
        if now == least:  # no half has changed
            break
        least = now
    best = models.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))).where("place = 1").drop("place")
    best = scratch.save(_rescaled(rows, best), "best")
    inner = rows.join(best, "g").where(distance() / F.col("scale") <= REWEIGHT).groupBy("g", "start").agg(*_sums())
    again = scratch.save(_models(inner), "again")
    return scratch.save(_rescaled(rows, again), "estimates")


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, ``distance`` (of its group's estimate, null where there is none) and ``kept``."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.save(measured(docs), "counted")
    rows = scratch.save(grouped(counted), "grouped")
    scratch.drop(counted)
    usable = rows.where("NOT base_failed AND g IS NOT NULL").select("g", *(f"v{i}" for i in range(P)))
    found = rows.join(estimates(scratch, usable).select("g", "mean", "inverse", "scale"), "g", "left")
    d2 = F.when(~F.col("base_failed"), distance() / F.col("scale"))
    out = found.withColumn("distance", d2)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
