"""Manuscripts as ordered line tables, and back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon as L


def split_lines(text: Column) -> Column:
    """Lines of a text without their breaks; a break at the end starts no further line."""
    parts = F.split(text, L.LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def with_tag(lines: DataFrame) -> DataFrame:
    """Columns indent, gid (null where untagged) and body, read from ``raw``."""
    tagged = F.col("raw").rlike(L.TAG)
    part = lambda i: F.regexp_extract("raw", L.TAG, i)
    return lines.withColumns({"indent": F.when(tagged, part(1)).otherwise(F.lit("")), "gid": F.when(tagged, F.concat(F.lit("#g"), part(2))), "body": F.when(tagged, part(3)).otherwise(F.col("raw"))})


def parse_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, raw, indent, gid, body) of each line of ``docs`` (doc_id, text); null and empty texts have none."""
    lines = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "raw")).where("raw is not null")
    return with_tag(lines)


def tagged_text(indent: Column, gid: Column, body: Column) -> Column:
    return F.when(gid.isNotNull(), F.concat(indent, gid, F.lit(": "), body)).otherwise(body)


def render(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of each document, joined by line feeds."""
    row = F.struct("line_no", tagged_text(F.col("indent"), F.col("gid"), F.col("body")).alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"]), "\n").alias("text"))


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def is_dialog(body: Column) -> Column:
    """Whether a body starts with a dash or a quotation mark."""
    return F.coalesce(body, F.lit("")).rlike(L.DIALOG)


def is_speech(gid: Column, body: Column) -> Column:
    """Whether a line is tagged, not the narrator's, and speech."""
    return gid.isNotNull() & (gid != "#g1") & is_dialog(body)


def renumber(lines: DataFrame, *parts: str) -> DataFrame:
    """Line numbers without gaps, after lines were dropped, or cut into parts that are numbered by the columns ``parts``."""
    return lines.withColumn("line_no", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", *parts)) - 1).cast("int"))
