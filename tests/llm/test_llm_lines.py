"""Line deduplication: short lines, lines of two documents, lines with digits."""

from qalam.llm import line_dedup


def kept(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept_text.split("\n") for r in line_dedup.dedup_lines(df, **options).collect()}
    return [got[i] for i in range(len(texts))]


def test_short_lines_go_too(spark):
    own = ["Red apples grow in my garden here", "Seven ships left port at dawn quietly", "No clock ran on that cold night",
           "Her brother paints old wooden doors blue"]
    got = kept(spark, [f"{o}\nAll rights reserved.\n\nThanks!\nOnly {o.split(' ')[0]}" for o in own])
    assert got[0] == [own[0], "All rights reserved.", "", "Thanks!", "Only Red"]
    for o, lines in zip(own[1:], got[1:]):
        assert lines == [o, "", f"Only {o.split(' ')[0]}"]


def test_two_documents_make_a_line_recurring(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = kept(spark, [f"The first page of all\n{passage}", f"Another page by someone else\n{passage}", "A third page without it"])
    assert got == [["The first page of all", passage], ["Another page by someone else"], ["A third page without it"]]
    # the same id twice is one document; the null id is one of its own
    df = spark.createDataFrame([(1, passage), (1, passage), (2, "x y"), (None, "x y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.dropped_lines) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (2, 0)]


def test_templates_of_two_documents(spark):
    """Constant tokens need three documents, a template two: the first two lines share theirs."""
    start = "User Ann wrote many good comments in"
    texts = [f"{start} {end}" for end in ("this old forum today", "this old forum now", "this old board here", "this new forum again")]
    assert kept(spark, texts) == [[texts[0]], [""], [texts[2]], [texts[3]]]


def test_lines_with_digits(spark):
    same = ["Copyright 2024 Acme Inc", "Page 3 of 10", "12:30:01 2024-05-06 GET", "1 2 3 4"]
    texts = ["\n".join([f"Own words of {name}", *same, f"{n} {n}"]) for name, n in (("Ann", 5), ("Bob", 6))]
    got = kept(spark, texts)
    assert got[0] == texts[0].split("\n") and got[1] == ["Own words of Bob", "6 6"]    # numbers alone: verbatim only
    # fields starred in the whole leaf count as agreed: 9 of 10 with them, 6 without
    texts = [f"On {i} at {i} from {i} user {name} wrote this" for i, name in enumerate(["Ann", "Bob", "Cid", "Dan"])]
    assert kept(spark, texts) == [[texts[0]], [""], [""], [""]]
