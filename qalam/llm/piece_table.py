"""Fill-in-middle transformation by a piece table (operator 12).

A document is a sequence of descriptors ``(buffer, start, length)`` over two
immutable buffers, its text and the sentinels; buffers are never copied or
changed.  Cutting splits a descriptor, an arrangement permutes descriptors, the
inverse permutation restores the document, and hashes run over the descriptors
one after the other.

Cuts stand between lines.  The draws come from the SHA-256 of ``seed:id``, so
every engine and every rerun makes the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
FIM_PERCENT = 100        # documents that are transformed
SPM_PERCENT = 50         # of these, suffix first
#: Prefix, suffix and middle sentinels.
MARKS = ("<P>", "<S>", "<M>")
#: Where the descriptors ``prefix, middle, suffix, <P>, <S>, <M>`` (0 to 5) stand in the output.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
_FLUSH = 16 << 20        # bytes of text in an outgoing batch, about


class PieceTable:
    """Descriptors over immutable buffers; starts as the whole first buffer."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, *buffers: bytes):
        self.buffers = [memoryview(b) for b in buffers]
        self.pieces = [(0, 0, len(buffers[0]))]

    def cut(self, piece: int, at: int) -> None:
        """Split a descriptor ``at`` bytes from its start; either part may be empty."""
        b, start, n = self.pieces[piece]
        self.pieces[piece:piece + 1] = [(b, start, at), (b, start + at, n - at)]

    def append(self, buffer: int, start: int, length: int) -> None:
        self.pieces.append((buffer, start, length))

    def arrange(self, order: Sequence[int]) -> None:
        """Descriptor ``order[k]`` moves to place ``k``."""
        self.pieces = [self.pieces[i] for i in order]

    def restore(self, order: Sequence[int]) -> None:
        """The inverse of ``arrange(order)``."""
        back = [0] * len(order)
        for place, piece in enumerate(order):
            back[piece] = place
        self.arrange(back)

    def view(self, piece: int) -> memoryview:
        b, start, n = self.pieces[piece]
        return self.buffers[b][start:start + n]

    def read(self) -> bytes:
        return b"".join(self.view(i) for i in range(len(self.pieces)))

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for i in range(len(self.pieces)):
            digest.update(self.view(i))
        return digest.hexdigest()


def _overlap(a: bytes, b: bytes) -> bool:
    """Whether two sentinels (or one and itself) could share bytes of a text."""
    return not a or a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b)))


def _chars(view: memoryview) -> int:
    """Code points: the bytes that continue none."""
    return int(np.count_nonzero((np.frombuffer(view, np.uint8) & 0xC0) != 0x80))


def _transform(marks: Sequence[bytes], fim: int, spm: int, text: bytes, draw: str) -> tuple:
    """``n, form, prefix_chars, middle_chars, output, output_sha256`` of one text."""
    h1, h2, h3, h4 = (int(draw[i:i + 8], 16) for i in (0, 8, 16, 24))
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if len(text) and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    n = len(ends)
    if not n or h3 % 100 >= fim or any(m in text for m in marks):
        return n, "plain", None, None, text, hashlib.sha256(text).hexdigest()
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(ends[k - 1]) if k else 0 for k in (low, high)]
    table = PieceTable(text, b"".join(marks))
    table.cut(0, at[0])
    table.cut(1, at[1] - at[0])
    prefix, middle = _chars(table.view(0)), _chars(table.view(1))
    start = 0
    for m in marks:
        table.append(1, start, len(m))
        start += len(m)
    form = "spm" if h4 % 100 < spm else "psm"
    table.arrange(ORDERS[form])
    return n, form, prefix, middle, table.read(), table.sha256()


def _restored(marks: Sequence[bytes], output: bytes, form: str) -> tuple[bytes, str]:
    """The text of an output and its SHA-256, from output and form alone.

    A transformed text holds no sentinel and no sentinel overlaps another's
    start, so each is found where the transformation put it."""
    if form == "plain":
        return output, hashlib.sha256(output).hexdigest()
    table, last, at = PieceTable(output), 0, 0
    for piece in ORDERS[form]:
        if piece >= 3:                                   # a sentinel: cut before and after it
            mark = marks[piece - 3]
            found = output.index(mark, at)
            if found or last:
                table.cut(last, found - at)
                last += 1
            table.cut(last, len(mark))
            last, at = last + 1, found + len(mark)
    table.restore(ORDERS[form])
    del table.pieces[3:]
    return table.read(), table.sha256()


def _mapped(row: Callable, wide: int, names: Sequence[str], types: Sequence[pa.DataType]):
    """Arrow batches with ``wide`` columns for ``row`` at the end, replaced by its results;
    batches are cut by the bytes they hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.num_columns - wide
            args, done, size, begin = [c.to_pylist() for c in batch.columns[keep:]], [], 0, 0
            for i in range(batch.num_rows):
                done.append(row(*(a[i] for a in args)))
                size += len(done[-1][names.index("bytes")])
                if size >= _FLUSH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(begin, i + 1 - begin) for c in batch.columns[:keep]),
                         *(pa.array(v, t) for v, t in zip(zip(*done), types))],
                        names=[*batch.schema.names[:keep], *names])
                    done, size, begin = [], 0, i + 1
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   marks: Sequence[str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n`` (lines), ``form`` (plain, psm or spm),
    ``prefix_chars, middle_chars`` (code points; null if plain), ``output`` and
    ``output_sha256``.

    A null text is empty; an empty text, and one that holds a sentinel, stays
    plain.  A null id draws as the id ``null``; repeated rows draw alike and
    stay repeated.  Whole texts of any length are cut: a task holds one Arrow
    batch and its outputs.  An empty table gives an empty result; other columns
    are ignored."""
    raw = tuple(m.encode() for m in marks)
    if len(set(raw)) != 3 or any(map(_overlap, raw * 3, [m for m in raw for _ in raw])):
        raise ValueError("three sentinels that do not overlap are needed")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                       F.substring(draw, 1, 32).alias("draw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n", "form", "prefix_chars", "middle_chars", "bytes", "output_sha256"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def row(text: bytes, draw: str) -> tuple:
        return _transform(raw, fim_percent, spm_percent, text, draw)

    out = rows.mapInArrow(_mapped(row, 2, names, types), f"doc_id {kind}, n long, form string, prefix_chars long, "
                                                         "middle_chars long, bytes binary, output_sha256 string")
    return out.withColumn("bytes", F.col("bytes").cast("string")).withColumnRenamed("bytes", "output")


def restore(transformed: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored`` and ``restored_sha256`` for ``output``:
    the text rebuilt from output and form alone."""
    raw = tuple(m.encode() for m in marks)
    rest = [c for c in transformed.columns if c not in ("output", "form")]
    rows = transformed.select(*rest, F.col("form").alias("kept_form"), F.col("output").cast("binary").alias("output"), "form")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])

    def row(output: bytes, form: str) -> tuple:
        return _restored(raw, output, form)

    out = rows.mapInArrow(_mapped(row, 2, ["bytes", "restored_sha256"], [pa.binary(), pa.string()]),
                          f"{kinds}, bytes binary, restored_sha256 string")
    return out.select(*rest, F.col("kept_form").alias("form"), F.col("bytes").cast("string").alias("restored"),
                      "restored_sha256")
