"""Scenes and dialog blocks: islands over line order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lines import in_order, is_speech


def with_scene(lines: DataFrame) -> DataFrame:
    """Column scene: the label of the last heading so far; null before the first and after the prologue's end."""
    raw = F.when(F.col("gid").isNotNull(), F.concat(F.col("gid"), F.lit(": "), F.col("body"))).otherwise(F.col("body"))
    part = lambda i: F.regexp_extract(raw, L.SCENE_HEADING, i)
    label = F.when(part(1) != "", F.initcap(part(1))).otherwise(F.concat(F.initcap(part(2)), F.lit(" "), part(3)))
    mark = F.when(raw.rlike(L.SCENE_HEADING), label).when(raw.rlike(L.END_OF_PROLOGUE), F.lit(""))
    return lines.withColumn("_mark", mark).withColumn("scene", F.nullif(F.last("_mark", ignorenulls=True).over(in_order()), F.lit(""))).drop("_mark")


def scene_spans(lines: DataFrame) -> DataFrame:
    """(doc_id, label, start_line, end_line) of each scene, both lines included."""
    marked = with_scene(lines).withColumn("_new", (~F.col("scene").eqNullSafe(F.lag("scene").over(in_order()))).cast("int"))
    island = F.sum("_new").over(in_order())
    return marked.withColumn("_id", island).where("scene is not null").groupBy("doc_id", "_id", F.col("scene").alias("label")).agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("_id")


def with_block(lines: DataFrame) -> DataFrame:
    """Column block_id: the number, from 1, of the run of speech lines that a line is in; null for other lines."""
    speech = is_speech(F.col("gid"), F.col("body"))
    marked = lines.withColumn("_d", speech)
    starts = (F.col("_d") & ~F.lag("_d", 1, False).over(in_order())).cast("int")
    return marked.withColumn("_start", starts).withColumn("block_id", F.when(F.col("_d"), F.sum("_start").over(in_order()))).drop("_d", "_start")


def dialog_blocks(lines: DataFrame) -> DataFrame:
    return with_block(lines).where("block_id is not null").groupBy("doc_id", "block_id").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"))


def dominant_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, block_id, first, second, share): each block's two most frequent known speakers, ties by first appearance."""
    speakers = with_block(lines).where("block_id is not null and gid not in ('#g?', '#g1')").groupBy("doc_id", "block_id", "gid").agg(F.count("*").alias("n"), F.min("line_no").alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "seen", "gid")))
    ranked = speakers.groupBy("doc_id", "block_id").agg(listed.alias("s"), F.sum("n").alias("total"))
    two = F.size("s") >= 2
    return ranked.where(two).select("doc_id", "block_id", F.col("s")[0]["gid"].alias("first"), F.col("s")[1]["gid"].alias("second"), (-(F.col("s")[0]["order"] + F.col("s")[1]["order"]) / F.col("total")).alias("share"))
