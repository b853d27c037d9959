"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing names."""

SF = "/root/testdata/sf0.001"
CLASHES = ("size", "row", "block", "key", "shape", "words", "tokens", "digest", "b", "r", "kept", "kept_text",
           "dropped_lines", "features", "n", "sid", "shard", "copies", "ids", "out")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
PROSE = "The quick brown fox jumps over the lazy dog near the old stone bridge. It then runs home again."


def rows():
    long_text = " ".join(f"word{i % 977} flows" for i in range(20_000))
    texts = [(1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "a"), (3, None, "a"), (4, "", None), (5, "  \n\t ", "b"),
             (6, long_text, "b"), (7, "é漢😀 x@y.org 10.0.0.1\n\nsecond line here now", None), (None, PROSE + " More.", "c"),
             (None, None, None), (8, "one two", "c"), (9, PROSE, "zz"), (10, "x" * 30_000, "b")]
    return [(i, t, None if n % 3 else "en", s, None if t is None else len(t), *(["clash"] * len(CLASHES)))
            for n, (i, t, s) in enumerate(texts)]


def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
