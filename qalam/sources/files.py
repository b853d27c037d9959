"""File sources and sinks (S1–S11) on Spark's readers and writers.

A directory or glob is one read, split over tasks; the file name, a language tag
or a line number become columns.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalam.functions.regex import S
from qalam.functions.text import py_strip
from qalam.plans.session import ensure_checkpoint_dir
from qalam.sources.delimited import read_delimited


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{tag}-{uuid.uuid4().hex[:12]}"


def pick_text_column(df: DataFrame, candidates) -> str:
    """First candidate column present in ``df``; plan-time error otherwise."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"None of {list(candidates)} found. Columns present: {df.columns}")


def column_names(spark: SparkSession, paths, sep: str = ",") -> list[str]:
    """The columns of all files, in the order in which the files (by path) bring them.  Each task reads the
    first record of its files; what reaches the driver is one row per distinct header."""
    heads = read_delimited(spark, paths, ["path", "header"], sep, header=True)
    first = heads.groupBy("header").agg(F.min("path").alias("path")).orderBy("path").collect()
    return list(dict.fromkeys(n for r in first for n in json.loads(r["header"])))


def read_glob_csv(spark: SparkSession, paths, schema: T.StructType | None = None) -> DataFrame:
    """Many CSV files, union by column name, missing columns null.

    ``paths`` is a file, a folder, a glob or a list of them.  One read of all files, whatever their headers
    (``delimited``); quoted fields may span lines.  ``schema`` names the columns and casts them: then nothing is read
    beforehand.  Without it every column is a string, and the headers are read first.
    """
    names = schema.names if schema is not None else column_names(spark, paths)
    if not names:
        raise ValueError(f"no file below {paths}")
    df = read_delimited(spark, paths, names)
    if schema is not None:
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def read_parallel_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Every TSV of a parallel corpus as one long table.

    ``(sent_id, split, lang, sent)``; a file without a ``sent`` column (index-only) is left
    after its header.  Fields may be quoted.
    """
    out = read_delimited(spark, path, ["sentID.BTEC", "split", "lang", "sent"], "\t", need=["sent"])
    return (out.select(F.col("`sentID.BTEC`").cast("long").alias("sent_id"), "split", "lang", "sent")
               .filter(F.col("sent").isNotNull()))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """S3: one document per blank-line-separated block; inner line breaks
    become spaces; stripped; blank documents dropped.  Lines end by line feed,
    carriage return or both: the reader splits at two line feeds, and what is
    left of files with other line ends is split here."""
    df = spark.read.text(path, lineSep="\n\n")
    unix = F.replace(F.replace(F.col("value"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    blocks = df.select(F.explode(F.split(unix, "\n\n")).alias("value"))
    text = py_strip(F.regexp_replace(F.col("value"), "\\n", " "))
    return blocks.select(text.alias("text")).filter(F.col("text") != "")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` (recursive) as ``(path, file_name, content)``;
    undecodable bytes are dropped like ``errors='ignore'``."""
    df = pack_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    raw = F.col("content").cast("string")
    # the replacement characters of valid input stay; in invalid input they are marked first
    marked = F.replace(F.col("content").cast("string"), F.lit("\ufffd"), F.lit("\ufdd0"))
    mended = F.regexp_replace(F.make_valid_utf8(marked), "\\x{FFFD}", "")
    content = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(mended, F.lit("\ufdd0"), F.lit("\ufffd")))
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(F.col("path"), name.alias("file_name"), content.alias("content"))


#: Splits of small files that one task reads; Spark counts each file as 4 MB, so a split has some thirty.
SPLITS_PER_TASK = 32


def pack_files(files: DataFrame) -> DataFrame:
    """Many small files in fewer tasks, but for one per slot at least; none is shuffled."""
    try:
        splits, slots = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001  (Spark Connect: leave placement to the server)
        return files
    want = max(slots, -(-splits // SPLITS_PER_TASK))
    return files.coalesce(want) if want < splits else files


_ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f" + "".join(map(chr, range(0x20))))


def escaped(name: str) -> str:
    """A name as a part of a path, as Spark's writers spell partition values."""
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in name)


def _write_files(root: str, batches):
    import pyarrow as pa
    from pyarrow.fs import FileSystem
    from pyspark import TaskContext
    fs, base = FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else FileSystem.from_uri(f"file://{root}")
    folder = f"{base.rstrip('/')}/part-{TaskContext.get().partitionId():05d}"
    fs.create_dir(folder, recursive=True)
    n = 0
    for batch in batches:
        for k in range(batch.num_rows):
            name = escaped(batch.column(0)[k].as_py())
            with fs.open_output_stream(f"{folder}/{batch.column(1)[k].as_py()}-{name}") as out:
                out.write(f"{batch.column(2)[k].as_py()}\n".encode())
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def write_files(df: DataFrame, path_col: str, text_col: str, path: str) -> int:
    """Text files below ``path``, named ``<part>-<escaped path_col>``; rows of a part that share a name are one file's
    lines.  A task writes its files itself: Spark's writers move every file through the driver, and on a local disk
    they start a process for each.  Rows without a name give no file.  Returns the number of files."""
    rows = (df.filter(F.col(path_col).isNotNull()).groupBy(path_col, F.spark_partition_id().alias("__part"))
              .agg(F.array_join(F.collect_list(F.coalesce(text_col, F.lit(""))), "\n").alias("__text")))
    return rows.select(path_col, "__part", "__text").mapInArrow(functools.partial(_write_files, path), "n long").agg(F.sum("n")).first()[0] or 0


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """``step split loss`` lines; other lines skipped."""
    return parse_run_log(spark.read.text(path).withColumnRenamed("value", "line"), "line")


def parse_run_log(df: DataFrame, line_col: str = "line") -> DataFrame:
    """S5 parser on a column of lines: whitespace split, exactly 3 fields,
    integer step and float loss (lines that do not cast are skipped)."""
    parts = F.split(py_strip(F.col(line_col)), f"{S}+")
    p = df.select(parts.alias("p")).filter(F.size("p") == 3)
    step = F.expr("try_cast(p[0] AS BIGINT)")
    loss = F.expr("try_cast(p[2] AS DOUBLE)")
    return (p.select(step.alias("step"), F.col("p")[1].alias("split"), loss.alias("loss"))
             .filter(F.col("step").isNotNull() & F.col("loss").isNotNull()))


def write_corpus_lines(df: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    """Non-null, stripped, non-empty texts, one per line.  A text with
    inner line breaks yields several lines, as in a plain-text file."""
    lines = (df.select(py_strip(F.col(text_col)).alias("line"))
               .filter(F.col("line").isNotNull() & (F.col("line") != ""))
               .select(F.explode(F.split("line", "\\n")).alias("line")))
    if path:
        lines.write.mode("overwrite").text(path)
    return lines


def write_paragraphs(df: DataFrame, text_col: str, path: str) -> None:
    """Documents joined by a blank line."""
    df.select(F.col(text_col)).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sep: str | None = None,
                partition_by=None) -> None:
    """Parquet, CSV or TSV sink."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    else:
        # RFC 4180: quotes doubled, values written as they are (no trimming)
        (w.option("header", True).option("sep", sep or ",").option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text",
                limit: int | None = None, order_col: str | None = None,
                streaming: bool = False, schema: T.StructType | None = None,
                max_files: int | None = None) -> DataFrame:
    """A tabular corpus with one text column (called ``text`` in the result), bounded or streamed.

    ``limit`` keeps the first N rows by ``order_col`` (top-k, no full sort);
    without ``order_col`` it is Spark's unordered limit.  On a stream it keeps the
    first N rows as they arrive, over all batches: a counter in the stream's state
    (append mode), behind a limit per task.  An order cannot be had there.
    """
    if limit is not None and streaming and order_col:
        raise ValueError("a stream's first rows are those that arrive first: no order_col")
    reader = spark.readStream if streaming else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if max_files is not None:      # files in a micro-batch
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.format(fmt).load(path)
    if text_col != "text":
        df = df.drop("text").withColumnRenamed(pick_text_column(df, [text_col]), "text")
    if limit is not None:
        df = (df.orderBy(order_col) if order_col else df).limit(limit)
    return df
