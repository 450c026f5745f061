"""Operators that change the number of lines: splitting speech from its attribution, merging what was split."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..lines import in_order, is_dialog, renumber
from .folds import documents

_OPENING, _CLOSED = ("«", '"', "“"), ("»", '"', "”")


def _exploded(lines: DataFrame, parts) -> DataFrame:
    """Each line as its parts (struct<gid, body>), in order, numbered anew."""
    # parts are never empty; without "outer" the planner filters by their number first, which makes them several times
    out = lines.withColumn("_parts", parts).select("*", F.posexplode_outer("_parts").alias("_k", "_part"))
    out = out.withColumns({"gid": F.col("_part.gid"), "body": F.col("_part.body")})
    return renumber(out, "_k").select(lines.columns)


def split_mixed(lines: DataFrame) -> DataFrame:
    """Tagged speech followed by an end mark, a dash and an attribution that text follows: the text becomes a line of its own."""
    cut = rf"(?uU)^(.*?{L.END_PUNCTUATION}\s*[{L.DASHES}]\s*[^.!?…]*[.!?…])\s+(.+)$"
    tagged = F.col("gid").isNotNull() & (F.col("gid") != "#g1") & F.col("body").rlike(cut)
    first, rest = F.regexp_extract("body", cut, 1), F.regexp_extract("body", cut, 2)
    whole = F.array(F.struct(F.col("gid").alias("gid"), F.col("body").alias("body")))
    two = F.array(F.struct(F.col("gid").alias("gid"), first.alias("body")), F.struct(F.when(is_dialog(rest), F.lit("#g?")).otherwise(F.lit("#g1")).alias("gid"), rest.alias("body")))
    return _exploded(lines, F.when(F.coalesce(tagged, F.lit(False)), two).otherwise(whole))


def extract_attribution(lines: DataFrame) -> DataFrame:
    """Speech with closed quotations: each quotation keeps the speaker, the text between them becomes the narrator's."""
    quoted = "[«\"“][^«»\"“”]*[»\"”]"
    mixed = F.coalesce(F.col("gid").isNotNull() & (F.col("gid") != "#g1") & F.col("body").rlike(quoted), F.lit(False))
    marked = lines.withColumn("_mixed", mixed)
    pieces = F.when(F.col("_mixed"), F.regexp_extract_all("body", F.lit(rf"({quoted}|[^«\"“]+)"), F.lit(1))).otherwise(F.array("body"))
    each = marked.withColumn("_pieces", pieces).select("*", F.posexplode_outer("_pieces").alias("_k", "_piece"))
    # only a quotation holds an opening mark
    told = F.col("_mixed") & ~F.substring("_piece", 1, 1).isin(*_OPENING)
    text = F.when(told, F.trim(F.regexp_replace("_piece", rf"^[\s,{L.DASHES}]+|[\s,{L.DASHES}]+$", ""))).otherwise(F.col("_piece"))
    each = each.withColumns({"gid": F.when(told, F.lit("#g1")).otherwise(F.col("gid")), "body": text}).where("not _mixed or body <> ''")
    return renumber(each, "_k").select(lines.columns)


_SPEAKER = re.compile(r"#g\d+")


def joined(parts: list[str]) -> str:
    """Pieces of one speech as one text; where one ends and the next begins with a quotation mark, the latter goes."""
    out = parts[0]
    for part in parts[1:]:
        if out.endswith(_CLOSED) and part.startswith(_OPENING):
            part = part[1:]
        if out.endswith("»") and part.endswith("»"):
            part = part[:-1]
        out = f"{out} {part}".strip()
    return out


def merged_runs(gids: list[str | None], bodies: list[str]) -> list[tuple[int, str | None, str]]:
    """(line, gid, body) after merging; ``line`` is the one that a row comes from.

    A run starts at a speaker's line with an opening quotation mark and takes what follows it, from
    the left: more such lines of the speaker; a narrator's line that such a line follows, which is
    swallowed; a narrator's line that itself has a quotation after some words, which stand before the
    merged speech as the narrator's. Anything else ends it."""
    out: list[tuple[int, str | None, str]] = []
    quoted = lambda i, gid: i < len(gids) and gids[i] == gid and any(q in bodies[i] for q in _OPENING)
    i = 0
    while i < len(gids):
        gid = gids[i]
        if not gid or not _SPEAKER.fullmatch(gid) or not quoted(i, gid):
            out.append((i, gid, bodies[i]))
            i += 1
            continue
        parts, at = [bodies[i]], i + 1
        while at < len(gids):
            told = min((bodies[at].find(q) for q in _OPENING if q in bodies[at]), default=-1) if gids[at] == "#g1" else -1
            if quoted(at, gid):
                parts.append(bodies[at])
                at += 1
            elif gids[at] == "#g1" and quoted(at + 1, gid):
                parts.append(bodies[at + 1])
                at += 2
            elif told > 0:
                words = re.sub(r"[,—–\-\s.]+$", "", re.sub(r"^[,—–\-\s]+", "", bodies[at][:told].strip()))
                if words:
                    out.append((at, "#g1", words))
                parts.append(bodies[at][told:].strip())
                at += 1
            else:
                break
        out.append((i, gid, joined(parts)))
        i = at
    return out


def merge_dialogs(lines: DataFrame) -> DataFrame:
    """Speech that the narrator's lines or line breaks cut becomes one line (``merged_runs``), in one ordered pass over each document; numbered anew."""
    kinds = dict(lines.drop("cast").dtypes)
    plain = lines.drop("cast").repartition("doc_id")
    nested = [c for c, k in kinds.items() if k.startswith(("array", "struct", "map"))]
    for c in nested:  # as text through Arrow
        plain = plain.withColumn(c, F.to_json(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in documents(batches):
            gids, bodies = table.column("gid").to_pylist(), [b or "" for b in table.column("body").to_pylist()]
            new = {"line_no": [], "gid": [], "body": []}
            rows = []
            for start, end in zip(at, at[1:], strict=False):
                merged = merged_runs(gids[start:end], bodies[start:end])
                rows += [start + i for i, _, _ in merged]
                new["line_no"] += range(len(merged))
                new["gid"] += [g for _, g, _ in merged]
                new["body"] += [b for _, _, b in merged]
            kept = table.take(pa.array(rows, pa.int64()))
            yield from pa.table([pa.array(new[c], kept.column(c).type) if c in new else kept.column(c) for c in kinds], list(kinds)).to_batches()

    out = plain.sortWithinPartitions("doc_id", "line_no").mapInArrow(run, ", ".join(f"{c} {'string' if c in nested else k}" for c, k in kinds.items()))
    for c in nested:
        out = out.withColumn(c, F.from_json(c, kinds[c]))
    return out


def merge_around_attribution(lines: DataFrame, marks: str = "«»\"“”", tidy: bool = True) -> DataFrame:
    """Speech, the narrator's line and more speech of one speaker, both with a quotation mark of ``marks``: one line of speech, then the narrator's.

    Where speech goes on after a second attribution, lines pair up from the first on. ``tidy``: the
    narrator's line loses dashes and commas at its ends, and goes if nothing is left."""
    w = in_order()
    quoted = F.col("gid").rlike(r"^#g\d+$") & (F.col("gid") != "#g1") & F.col("body").rlike(f"[{marks}]")
    marked = lines.withColumn("_q", F.coalesce(quoted, F.lit(False)))
    starts = F.col("_q") & (F.lead("gid", 1).over(w) == "#g1") & (F.lead("gid", 2).over(w) == F.col("gid")) & F.lead("_q", 2).over(w)
    marked = marked.withColumn("_s", F.coalesce(starts, F.lit(False)))
    # starts that follow each other by two lines overlap: every other one of such a chain counts
    head = F.col("_s") & ~F.coalesce(F.lag("_s", 2).over(w), F.lit(False))
    first = F.last(F.when(head, F.col("_at")), ignorenulls=True).over(Window.partitionBy("doc_id", "_odd").orderBy("_at"))
    marked = marked.withColumn("_at", F.row_number().over(w)).withColumn("_odd", F.col("_at") % 2)
    marked = marked.withColumn("_take", F.col("_s") & ((F.col("_at") - first) % 4 == 0))
    one, two = F.trim("body"), F.trim(F.lead("body", 2).over(w))
    two = F.when(one.rlike("[»\"”]$") & two.rlike("^[«\"“]"), F.substring(two, 2, 1 << 30)).otherwise(two)
    gone = F.coalesce(F.lag("_take", 2).over(w), F.lit(False))
    told = F.coalesce(F.lag("_take", 1).over(w), F.lit(False))
    clean = F.regexp_replace(F.regexp_replace(F.trim("body"), r"[,—–\-\s.]+$", ""), r"^[,—–\-\s]+", "") if tidy else F.col("body")
    body = F.when(F.col("_take"), F.concat_ws(" ", one, two)).when(told, clean).otherwise(F.col("body"))
    out = marked.withColumns({"_body": body, "_gone": gone | (told & (clean == "")) if tidy else gone})
    return renumber(out.where("not _gone").drop("body").withColumnRenamed("_body", "body")).select(lines.columns)
