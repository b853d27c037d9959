"""Subtitle files to documents.

files (path, file_name, content) → first file per name (W4) → entity decode
(C21) → lines with their number → drop headers, cue timings, tag-only lines
(C22) → strip tags and markers (C23) → drop lines shorter than 2 (C24) → keep
each line's first occurrence per file and join in line order (C25/W3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.functions import regex as rx
from qalam.functions.html import unescape_html
from qalam.functions.text import py_splitlines_pattern, py_strip
from qalam.plans.session import spread

TAG_ONLY = f"^(?:\\[[^\\]]*+\\]{rx.S}*+)++\\z"
SOUND_TAG = "\\[[^\\]]*\\]"
INLINE_TIME = f"<{rx.D}{{2}}:{rx.D}{{2}}:{rx.D}{{2}}\\.{rx.D}+>"
CAPTION_TAG = "</?c>"
SPEAKER = f"^>>{rx.S}*"
ANY_TAG = "<[^>]+>"


def first_file_per_name(files: DataFrame) -> DataFrame:
    """For each file name the file with the smallest path (compared by path
    components, as Python sorts paths), with the number of skipped copies.
    A grouped min_by: partial aggregation, so a name with many copies is not
    one hot task."""
    return (files.groupBy("file_name")
                 .agg(F.min_by("path", F.split("path", "/")).alias("path"),
                      (F.count(F.lit(1)) - 1).cast("long").alias("duplicates")))


def clean_line(line):
    """C23 on one stripped line."""
    c = F.regexp_replace(line, SOUND_TAG, "")
    c = F.regexp_replace(c, INLINE_TIME, "")
    c = F.regexp_replace(c, CAPTION_TAG, "")
    c = F.regexp_replace(c, SPEAKER, "")
    c = F.regexp_replace(c, ANY_TAG, "")
    return py_strip(F.regexp_replace(c, f"{rx.S}+", " "))


def transcript_lines(files: DataFrame) -> DataFrame:
    """``(path, line_no, line)`` for every kept line."""
    parts = F.split(unescape_html(F.col("content")), py_splitlines_pattern())
    ln = spread(files).select("path", F.posexplode(parts).alias("line_no", "raw"))
    s = py_strip(F.col("raw"))
    keep = ((s != "") & ~s.startswith("WEBVTT") & ~s.startswith("Kind:") & ~s.startswith("Language:")
            & ~s.contains("-->") & ~s.rlike(TAG_ONLY))
    out = ln.filter(keep).select("path", "line_no", clean_line(s).alias("line"))
    return out.filter(F.length("line") >= 2)


def transcripts_to_docs(files: DataFrame) -> DataFrame:
    """One document per file: first occurrence of each line, in line
    order, joined by a space; files with no line left give no document."""
    first = (transcript_lines(files).groupBy("path", "line")
             .agg(F.min("line_no").alias("line_no")))
    return (first.groupBy("path")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                               lambda s: s["line"]), " ").alias("text")))
