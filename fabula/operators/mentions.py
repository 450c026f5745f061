"""Names of a legend in text: one automaton for all of a legend's names, leftmost and longest first."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Names:
    """An Aho–Corasick automaton of lower-cased names."""

    def __init__(self, gid_of: dict[str, str]):
        self.gid_of = {a: g for a, g in gid_of.items() if a}
        self.automaton = ahocorasick.Automaton()
        for name in self.gid_of:
            self.automaton.add_word(name, name)
        if self.gid_of:
            self.automaton.make_automaton()

    def find(self, text: str, whole: bool = True) -> list[tuple[int, int, str]]:
        """(start, end, name) of the names in a lower-cased text; of those that overlap the leftmost, then the longest counts.

        ``whole``: no letter, digit or underscore may touch a name."""
        if not self.gid_of:
            return []
        hits = []
        for last, name in self.automaton.iter(text):
            start, end = last + 1 - len(name), last + 1
            if not whole or not (_in_word(text, start - 1) or _in_word(text, end)):
                hits.append((start, -end, name))
        out, free = [], 0
        for start, end, name in sorted(hits):
            if start >= free:
                out.append((start, -end, name))
                free = -end
        return out


def _in_word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


@lru_cache(maxsize=64)
def _names(spec: str) -> Names:
    return Names(json.loads(spec))


def mentions(texts: DataFrame, aliases: DataFrame, whole: bool = True) -> DataFrame:
    """(doc_id, line_no, start, stop, alias, gid) of all names of its document's legend in each text (doc_id, line_no, text), in code points.

    aliases: (doc_id, alias, gid), aliases in lower case. Null texts and documents without names have
    none. A legend is joined to its texts, which are spread over all tasks, so that no document is
    held together; a task makes each legend's automaton once."""
    spec = aliases.where("alias <> ''").groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", "gid"))))).alias("_names"))
    rows = texts.select("doc_id", "line_no", F.lower("text").alias("_text")).where("_text is not null").join(spec, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (text, legend) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_names").to_pylist(), strict=True)):
                names = _names(legend)
                for start, stop, name in names.find(text, whole):
                    at.append(i)
                    found.append((start, stop, name, names.gid_of[name]))
            rows = pa.array(at, pa.int64())
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "line_no")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "line_no", "start", "stop", "alias", "gid"])

    kind = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, line_no {texts.schema['line_no'].dataType.simpleString()}, start int, stop int, alias string, gid string"
    return rows.mapInArrow(run, kind)
