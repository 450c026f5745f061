"""Manuscripts and legends from folders of text files, parquet tables, and back to text."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType


def read_manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path) of whole UTF-8 files; the id is a hash of the path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "text", "path")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_manuscripts(docs: DataFrame, path: str) -> None:
    """Tagged texts as text files, one folder for each document; an existing folder is not overwritten."""
    docs.select("doc_id", F.col("text").alias("value")).write.mode("errorifexists").partitionBy("doc_id").text(path)


def classifier_text(text: Column, original: Column) -> Column:
    """A text for the classifier's file: no more than one blank line at a time, CRLF line ends where the original has any."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.when(F.contains(original, F.lit("\r\n")), F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))).otherwise(out)


def write_predictions(rows: DataFrame, path: str) -> None:
    """A tab-separated log with a header; the best candidates as "gid:0.000;…"."""
    if "top" in rows.columns:
        rows = rows.withColumn("top", F.array_join(F.transform("top", lambda x: F.concat(x["gid"], F.lit(":"), F.format_string("%.3f", x["score"]))), ";"))
    rows.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)


def write_version(new: DataFrame, old: DataFrame, path: str, version: str) -> bool:
    """Write ``new`` (doc_id, text) below ``path``/``version`` if it differs from ``old``; what was there stays as it was. Tells whether anything was written."""
    rows = lambda d: d.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    if rows(new).exceptAll(rows(old)).isEmpty() and rows(old).exceptAll(rows(new)).isEmpty():
        return False
    new.select("doc_id", "text").write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{version}")
    return True


@F.pandas_udf(StringType())
def _cyrillic(content: pd.Series) -> pd.Series:
    """Bytes in Windows-1251, which Spark's decode doesn't know."""
    return content.map(lambda b: bytes(b).decode("cp1251", "replace"))


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path, bom, encoding, eol) of files in UTF-8, with or without its mark, in UTF-16 with one, or else in Windows-1251; how to write them back (``encoded``) is kept. Spark reads no empty files."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    start = F.hex(F.substring("content", 1, 3))
    plain = F.is_valid_utf8(F.col("content").cast("string"))
    bom = F.when(start == "EFBBBF", "utf-8-sig").when(start.startswith("FFFE") | start.startswith("FEFF"), "utf-16").otherwise("")
    encoding = F.when(start.startswith("FFFE"), "utf-16-le").when(start.startswith("FEFF"), "utf-16-be").when(plain, "utf-8").otherwise("cp1251")
    text = F.when(bom == "utf-16", F.decode("content", "UTF-16")).when(plain, F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")).otherwise(_cyrillic("content"))
    eol = F.when(F.contains("text", F.lit("\r\n")), "\r\n").when(F.contains("text", F.lit("\r")), "\r").otherwise("\n")
    return rows.select(F.xxhash64("path").alias("doc_id"), text.alias("text"), "path", bom.alias("bom"), encoding.alias("encoding")).withColumn("eol", eol)


def with_line_ends(text: Column, eol: Column) -> Column:
    """A text with all line ends as ``eol``."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), eol)


def encoded(text: str | None, bom: str | None, encoding: str | None) -> bytes:
    """A file's bytes as it was read by ``read_encoded``; what Windows-1251 lacks becomes a question mark."""
    encoding = encoding or "utf-8"
    mark = "\ufeff".encode(encoding) if bom else b""
    return mark + (text or "").encode(encoding, "replace")


class EncodedFiles(DataSource):
    """Write-only source ``encoded_files``: a file below ``path`` for each row (name, text, bom, encoding), in its own encoding.

    Files are written under a temporary name by their tasks and moved by the commit; what a failed or
    repeated task has left goes. Paths are those that pyarrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "encoded_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _EncodedWriter(self.options["path"], overwrite)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _EncodedWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, top = self._system()
        folder = f"{top}/_temporary-{self.run}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        files = []
        for row in iterator:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"no name of a file: {row['name']!r}")
            with system.open_output_stream(f"{folder}/{len(files)}") as out:
                out.write(encoded(row["text"], row["bom"], row["encoding"]))
            files.append((f"{folder}/{len(files)}", row["name"]))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, top = self._system()
        files = [f for m in messages if m for f in m.files]
        twice = [n for n, c in Counter(n for _, n in files).items() if c > 1]
        there = [] if self.overwrite else [n for _, n in files if system.get_file_info(f"{top}/{n}").type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"names given twice or there already: {sorted({*twice, *there})[:5]}")
        for part, name in files:
            system.move(part, f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        system, top = self._system()
        if system.get_file_info(f"{top}/_temporary-{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/_temporary-{self.run}")


def write_encoded(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Each row (path or name, text, bom, encoding, …) as a file below ``path``, named like the one that it was read from."""
    files.sparkSession.dataSource.register(EncodedFiles)
    name = F.col("name") if "name" in files.columns else F.element_at(F.split("path", "/"), -1)
    files.select(name.alias("name"), "text", "bom", "encoding").write.format("encoded_files").option("path", path).mode("overwrite" if overwrite else "append").save()


def save_state(state: DataFrame, path: str) -> None:
    """A store of (key, value) rows, written anew; a reader sees the last whole version."""
    state.select("key", "value").write.mode("overwrite").parquet(path)
