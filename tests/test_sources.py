"""File sources on mixed headers, index-only files, quoting, line ends and damaged bytes."""

import os
import tempfile

import pytest
from pyspark.sql import types as T

from qalam.operators.merge import describe_text
from qalam.sources import delimited
from qalam.sources import files as f


def _write(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())
    return path


def test_csv_files_union_by_name_under_one_glob(spark):
    d = tempfile.mkdtemp()
    _write(d, "a.csv", 'id,title,selftext\n1,t1,s1\n2,"t,2","s ""2""\nmore"\n')
    _write(d, "b.csv", "id,selftext,title\n3,s3,t3\n")
    _write(d, "c.csv", "﻿selftext,id,score\r\ns4,4,9\r\n")
    got = {r.id: (r.title, r.selftext, r.score) for r in f.read_glob_csv(spark, f"{d}/*.csv").collect()}
    assert got == {"1": ("t1", "s1", None), "2": ("t,2", 's "2"\nmore', None), "3": ("t3", "s3", None), "4": (None, "s4", "9")}


def test_tsv_with_a_large_index_only_file_first(spark):
    d = tempfile.mkdtemp()
    _write(d, "a.index.tsv", "sentID.BTEC\tsplit\n" + "".join(f"{i}\tdev\n" for i in range(20_000)))
    _write(d, "b.tsv", 'sentID.BTEC\tsplit\tlang\tsent\n1\ttrain\tCAI\t"a ""b"" c"\n2\ttest\tCAI\tplain\n')
    _write(d, "c.tsv", "lang\tsent\tsentID.BTEC\tsplit\nALX\tother order\t3\tdev\n")
    got = sorted(map(tuple, f.read_parallel_tsv(spark, d).collect()))
    assert got == [(1, "train", "CAI", 'a "b" c'), (2, "test", "CAI", "plain"), (3, "dev", "ALX", "other order")]


def test_paragraphs_with_any_line_end(spark):
    d = tempfile.mkdtemp()
    _write(d, "a.txt", "one\ntwo\n\nthree\n\n\n\nfour\n")
    _write(d, "b.txt", "five\r\nsix\r\n\r\nseven\r\n")
    assert sorted(r.text for r in f.read_paragraphs(spark, d).collect()) == ["five six", "four", "one two", "seven", "three"]


def test_transcripts_keep_genuine_replacement_characters(spark):
    d = tempfile.mkdtemp()
    _write(d, "a.vtt", "a�b")
    _write(d, "b.vtt", "a�b".encode() + b"\xffc")
    got = {r.file_name: r.content for r in f.read_transcripts(spark, d).collect()}
    assert got == {"a.vtt": "a�b", "b.vtt": "a�bc"}


def test_an_ordered_limit_needs_a_bounded_read(spark):
    # a stream's first rows are those that arrive first (test_streaming); an order it cannot have
    with pytest.raises(ValueError):
        f.read_corpus(spark, "/root/testdata/sf0.001/documents.parquet", limit=3, streaming=True, order_col="doc_id")


def test_describe_text_ties(spark):
    df = spark.createDataFrame([(t,) for t in ["b", "a", "b", "a", "c", None]], "t string")
    assert tuple(describe_text(df, "t").first()) == (5, 3, "a", 2)


def test_delimited_files_of_every_kind(spark):
    """Ragged and blank lines, empty and quoted empty fields, damaged bytes, a header alone, an empty file, a repeated column;
    names that start with _ or . are no data; long quoted fields."""
    d = tempfile.mkdtemp()
    long = "x, \"\" \n" * 50_000
    _write(d, "a.csv", 'a,b,c\n1,,""\n\n2\n3,x,y,extra\n4,"' + long + '",z\n')
    _write(d, "b.csv", b"b,a\n\xff\xfeq,5\r\n\"l\r\nm\",6\r")
    _write(d, "c.csv", "a,b\n")
    _write(d, "d.csv", "")
    _write(d, "e.csv", "a,a,b\n7,8,9\n")
    _write(d, "_SUCCESS.csv", "a,zz\n0,0\n")
    _write(d, ".hidden.csv", "a,zz\n0,0\n")
    want = {("1", None, ""), ("2", None, None), ("3", "x", "y"), ("4", long.replace('""', '"'), "z"),
            ("5", "��q", None), ("6", "l\r\nm", None), ("7", "9", None)}
    for path in (d, f"{d}/*.csv", f"file://{d}/*.csv", f"file:{d}", [f"{d}/[ab].csv", f"{d}/[c-e].csv", f"{d}/a.csv"]):
        df = f.read_glob_csv(spark, path)
        assert df.columns == ["a", "b", "c"] and df.count() == 7 and set(map(tuple, df.collect())) == want
    typed = f.read_glob_csv(spark, d, T.StructType([T.StructField("c", T.StringType()), T.StructField("a", T.LongType()),
                                                    T.StructField("none", T.StringType())]))
    assert sorted((r.a, r.c, r.none) for r in typed.collect())[:3] == [(1, "", None), (2, None, None), (3, "y", None)]
    with pytest.raises(ValueError):
        f.read_glob_csv(spark, f"{d}/nothing*.csv")
    assert f.read_parallel_tsv(spark, tempfile.mkdtemp()).collect() == []


def test_small_files_share_a_task_and_large_ones_do_not(spark, monkeypatch):
    d = tempfile.mkdtemp()
    for i in range(10):
        _write(d, f"{i}.csv", "a\n" + f"{i}\n" * (1000 if i in (3, 4) else 1))
    monkeypatch.setattr(delimited, "PARTITION_BYTES", 1000)
    source = delimited.DelimitedReader({"paths": f'["{d}"]'}, ["a"])
    groups = [[os.path.basename(p) for p in part.paths] for part in source.partitions()]
    assert groups == [["0.csv", "1.csv", "2.csv"], ["3.csv"], ["4.csv"], ["5.csv", "6.csv", "7.csv", "8.csv", "9.csv"]]
    assert sum(b.num_rows for part in source.partitions() for b in source.read(part)) == 2008


def test_files_are_written_by_their_tasks(spark, tmp_path):
    """S9 → S4: odd names and texts come back; rows that share a name are one file's lines; few tasks read many files."""
    from pyspark.sql import functions as F
    from qalam.sources.files import read_transcripts, write_files
    rows = [(f"d{k % 3}/f {k}.vtt", f"a\n{k}") for k in range(200)] + [("x:y=%/[é].vtt", "ü"), ("null", None)]
    df = spark.createDataFrame(rows + [("two", "1"), ("two", "2")], "path string, content string").coalesce(1)
    for root in (str(tmp_path / "plain"), (tmp_path / "uri").as_uri(), f"file:{tmp_path / 'short'}"):
        assert write_files(df, "path", "content", root) == 203
        back = read_transcripts(spark, root)
        assert back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        name = F.url_decode(F.regexp_extract("file_name", "^[0-9]+-(.+)$", 1))
        want = {p: f"{t or ''}\n" for p, t in rows} | {"two": "1\n2\n"}
        assert {r.n: r.content for r in back.select(name.alias("n"), "content").collect()} == want
