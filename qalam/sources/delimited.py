"""Delimited text files with headers as a partitioned Python data source.

A partition is a file, or several small ones.  Its task opens each file once as a
stream, reads the header there, and gives the rows by column name: files whose
headers differ in columns or order are read together, and a missing column is
null.  The driver sees no header and no row.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "qalam_delimited"
PARTITION_BYTES = 64 << 20      # small files share a task up to this size
BATCH_BYTES = 8 << 20           # characters of fields in an Arrow batch, about


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _hidden(parts: list[str]) -> bool:
    return any(p.startswith(("_", ".")) for p in parts)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a file, a folder (its own files) or a glob names; as in Spark, names that
    start with ``_`` or ``.`` are not data."""
    parts = path.rstrip("/").split("/")
    wild = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), None)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    if wild is None:
        fs, base = _filesystem(path.rstrip("/"))
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.File:
            return [(scheme + base if scheme else base, info.size)]
        pattern = ["*"]
    else:
        fs, base = _filesystem("/".join(parts[:wild]) or "/")
        pattern = parts[wild:]
    found = fs.get_file_info(pafs.FileSelector(base, recursive=len(pattern) > 1, allow_not_found=True))
    out = []
    for f in found:
        below = f.path[len(base):].strip("/").split("/")
        if f.type == pafs.FileType.File and len(below) == len(pattern) and not _hidden(below) \
                and all(fnmatch.fnmatchcase(b, p) for b, p in zip(below, pattern)):
            out.append((scheme + f.path if scheme else f.path, f.size))
    return sorted(out)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _rows(path: str, sep: str) -> Iterator[list]:
    """The records of a file: header first; an empty field without quotes is None, blank lines drop out, fields may
    hold line breaks, bytes that are no UTF-8 become U+FFFD."""
    fs, name = _filesystem(path)
    csv.field_size_limit(sys.maxsize)
    with fs.open_input_stream(name) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="") as text:
        for record in csv.reader(text, delimiter=sep, quoting=csv.QUOTE_NOTNULL):
            if record:
                yield record


class DelimitedReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.paths, self.sep = json.loads(options["paths"]), options.get("sep", ",")
        self.need = json.loads(options.get("need", "[]"))
        self.header = options.get("header") == "true"
        self.names = names

    def partitions(self) -> list[InputPartition]:
        groups, room = [], 0
        for path, size in sorted({f for p in self.paths for f in list_files(p)}):
            if not groups or size > room:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append(path)
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        for path in partition.paths:
            records = _rows(path, self.sep)
            head = ["" if n is None else n for n in next(records, [])]
            if self.header:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([json.dumps(head)])], schema=schema)
                continue
            if not all(n in head for n in self.need):
                continue
            at = [head.index(n) if n in head else -1 for n in self.names]
            rows, held = [], 0
            for r in records:
                row = [r[i] if 0 <= i < len(r) else None for i in at]
                rows.append(row)
                held += 50 + sum(len(v) for v in row if v is not None)
                if held >= BATCH_BYTES:
                    yield self._batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


class DelimitedSource(DataSource):
    """Options: ``paths`` (JSON list), ``sep``, ``need`` (JSON list: a file without these columns is left out after its
    header), ``header`` (``true``: one row per file, its path and header, nothing else is read).
    The schema names the columns, all strings."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DelimitedReader(dict(self.options), schema.names)


def read_delimited(spark: SparkSession, paths, names: list[str], sep: str = ",", need=(), header: bool = False) -> DataFrame:
    """The named columns, as strings, of every file below ``paths`` (a path, a folder, a glob, or a list of them)."""
    spark.dataSource.register(DelimitedSource)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (spark.read.format(FORMAT).schema(schema).option("sep", sep).option("need", json.dumps(list(need)))
                 .option("header", str(header).lower()).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
                 .load())
