"""Texts through a function of limited input: cut into chunks, the function over batches of chunks of like length, and put together in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from .effects import sentence_chunks

#: From texts to as many texts; a model, or any other function.
BatchFunction = Callable[[list[str]], list[str]]


def map_chunks(docs: DataFrame, function: BatchFunction, most: int = 2000, batch: int = 64) -> DataFrame:
    """(doc_id, text): each document (doc_id, text) after the function, chunk by chunk, joined by blanks.

    Chunks of all documents are dealt out by their length, so that a batch holds like ones and a long
    document is spread over tasks; a document's results meet again in the order of its chunks. Null and
    empty texts become empty ones; rows of equal id are one document, their chunks by place and text. A
    function that returns another number of texts is an error."""
    chunks = docs.select("doc_id", F.posexplode(sentence_chunks(F.col("text"), most)).alias("chunk_no", "chunk")).withColumn("size", F.length("chunk"))
    dealt = chunks.repartitionByRange("size", "doc_id", "chunk_no").sortWithinPartitions("size")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), batch):
                rows = part.iloc[k : k + batch]
                made = function(rows["chunk"].tolist())
                if len(made) != len(rows):
                    raise ValueError(f"{len(made)} texts for {len(rows)} chunks")
                yield rows[["doc_id", "chunk_no"]].assign(made=pd.Series(made, index=rows.index, dtype=object))

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = dealt.mapInPandas(run, f"doc_id {kind}, chunk_no int, made string")
    whole = done.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "made"))), lambda x: x["made"]), " ").alias("made"))
    return docs.select("doc_id").distinct().join(whole, "doc_id", "left").select("doc_id", F.coalesce("made", F.lit("")).alias("text"))


def retried(function: BatchFunction, again: BatchFunction, letters: str = L.FOREIGN_LETTERS) -> BatchFunction:
    """``function``, and ``again`` for inputs whose result holds some of ``letters``; its result counts if it holds fewer."""
    count = lambda t: sum(c in letters for c in t.lower())

    def run(texts: list[str]) -> list[str]:
        out = list(function(texts))
        odd = [i for i, t in enumerate(out) if count(t)]
        for i, t in zip(odd, again([texts[i] for i in odd]) if odd else [], strict=True):
            if count(t) < count(out[i]):
                out[i] = t
        return out

    return run


def two_stages(docs: DataFrame, first: BatchFunction, second: BatchFunction, most: int = 2000, batch: int = 64) -> DataFrame:
    """(doc_id, text): the documents after the first function, then cut anew and after the second."""
    return map_chunks(map_chunks(docs, first, most, batch), second, most, batch)
