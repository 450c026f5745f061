"""Measures of an attribution: coverage, accuracy, confusion, precision and recall, tag counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lines import is_dialog


def _share(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), 6)


def coverage(lines: DataFrame) -> DataFrame:
    """(doc_id, scene, dialogs, assigned, unknown, coverage, unknown_share); scene is null in the row of the whole document. lines: with scene."""
    dialog = is_dialog(F.col("body")) & F.col("gid").isNotNull()
    rows = lines.where(dialog).select("doc_id", F.coalesce("scene", F.lit("(без сцени)")).alias("scene"), (F.col("gid") == "#g?").cast("int").alias("u"))
    out = rows.rollup("doc_id", "scene").agg(F.count("*").alias("dialogs"), F.sum("u").alias("unknown")).where("doc_id is not null")
    return out.select("doc_id", "scene", "dialogs", (F.col("dialogs") - F.col("unknown")).alias("assigned"), "unknown", _share(F.col("dialogs") - F.col("unknown"), F.col("dialogs")).alias("coverage"), _share(F.col("unknown"), F.col("dialogs")).alias("unknown_share"))


def gold_of(body: Column) -> Column:
    """The speaker that a gold mark in a body names, by the first kind of mark that is there."""
    return F.coalesce(*(F.nullif(F.lower(F.regexp_extract(body, p, 1)), F.lit("")) for p in L.GOLD_MARKS))


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, pred, n) of rows (gold, pred)."""
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def precision_recall(pairs: DataFrame, ignored: str | None = "#g1") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) by label; ``ignored`` counts neither as false hit nor as miss."""
    ok = (F.col("gold") == F.col("pred")).cast("int")
    counted = lambda c: (F.col("gold") != F.col("pred")) & (F.lit(True) if ignored is None else F.col(c) != ignored)
    tp = pairs.where("gold = pred").groupBy(F.col("gold").alias("label")).agg(F.sum(ok).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))
    fp = pairs.where(counted("pred")).groupBy(F.col("pred").alias("label")).agg(F.lit(0).alias("tp"), F.count("*").alias("fp"), F.lit(0).alias("fn"))
    fn = pairs.where(counted("gold")).groupBy(F.col("gold").alias("label")).agg(F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.count("*").alias("fn"))
    t = tp.unionByName(fp).unionByName(fn).groupBy("label").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return t.select("label", "tp", "fp", "fn", _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def tag_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, gid, n) of all tags."""
    return lines.where("gid is not null").groupBy("doc_id", "gid").agg(F.count("*").alias("n"))


def averages(per_label: DataFrame) -> DataFrame:
    """(kind, precision, recall, f1) of the rows of precision_recall: micro over all counts, macro over the labels that have all three."""
    counts = per_label.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    micro = counts.select(F.lit("micro").alias("kind"), _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    whole = per_label.where("precision is not null and recall is not null and precision + recall > 0")
    macro = whole.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1"))).select(F.lit("macro").alias("kind"), "precision", "recall", "f1")
    return micro.unionByName(macro)


def rule_hits(logs: DataFrame) -> DataFrame:
    """(rule, n) of log lines (text) like "[074 name] retagged:3": summed counts by rule."""
    rows = logs.select(F.regexp_extract("text", r"^\[([^\]]+)\]", 1).alias("rule"), F.explode(F.regexp_extract_all("text", F.lit(r"\w+:\s*(\d+)"), F.lit(1))).alias("n"))
    return rows.where("rule <> ''").groupBy("rule").agg(F.sum(F.col("n").cast("long")).alias("n"))


def tag_order(gid: Column) -> Column:
    """A sort key of tags: the unknown one first, the others by number."""
    return F.when(gid == "#g?", F.lit(-1)).otherwise(F.regexp_extract(gid, r"(\d+)", 1).cast("int"))
