"""Spans the trees add where look-alikes are as common as strict matches."""

import collections
import random
import time

from qalam.llm import pii


def test_look_alikes_as_common_as_base_spans_are_added(spark):
    rng = random.Random(7)

    def number():
        return f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"

    def order():
        return f"order number {rng.randint(10**9, 10**10)} was shipped in {rng.randint(1000, 9999)}"

    texts = {0: lambda i: f"please call me on +1 {number()} today", 1: lambda i: f"please call me on 1 {number()} today",
             2: lambda i: f"you may write to bob{i}@corp{i}.org about it",
             3: lambda i: f"you may write to bob{i} (at) corp{i}.org about it", 4: lambda i: order()}
    rows = [(g * 1000 + i, text(i)) for g, text in texts.items() for i in range(300)]
    found = {r.doc_id: r.found for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for g, kind in ((1, 3), (3, 0)):
        hits = [found[g * 1000 + i] for i in range(300)]
        assert sum([(x.kind, x.base) for x in f] == [(kind, False)] for f in hits) >= 270
    assert not any(found[4000 + i] for i in range(300))


def test_only_rule_breaking_candidates_count_against_a_threshold():
    # kind, base, unlabelled, score: as many unlabelled as base spans, all at 0.5
    held = [(3, 1.0, False, 0.5)] * 50 + [(3, 0.0, True, 0.5)] * 50 + [(3, 0.0, False, 0.1)] * 50
    share, limit = pii._calibrated(held, 0.9)[3]
    assert share == 0.5 and 0.2 < limit <= 1.0
    held += [(3, 0.0, False, 0.5)] * 50
    share, limit = pii._calibrated(held, 0.9)[3]
    assert limit > 0.5 / share
    assert all(limit > 1 for _, limit in pii._calibrated([(1, 0.0, True, 0.9)], 0.9).values())


def test_the_sample_is_drawn_at_full_parallelism(spark, monkeypatch):
    plans, write = [], pii.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(pii, "materialize", seen)
    rows = [(i, f"mail a{i}@b.org or call 1 743 555 {1000 + i}") for i in range(40)]
    pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert len(plans) == 2 and not any("Repartition 4, false" in p for p in plans)


def test_written_out_and_separated_forms_are_found(spark):
    """Recall of each planted form is 0.9 or more, whole spans and the right kind; prose with "at", "dot", dates and
    numbers stays clean."""
    rng = random.Random(11)

    def ip(sep):
        return sep.join(str(rng.randint(11, 250)) for _ in range(4))

    def mail(at, dot):
        n = rng.randint(1, 999)
        return f"{rng.choice(['ann', 'bob.k', 'c_d'])}{n}{at}{rng.choice(['corp', 'my-site', 'uni'])}{n}{dot}{rng.choice(['org', 'com', 'net'])}"

    forms = {"mail": (0, lambda: mail("@", ".")), "brackets": (0, lambda: mail(" [at] ", " [dot] ")),
             "words": (0, lambda: mail(" at ", " dot ")), "capitals": (0, lambda: mail(" AT ", " DOT ")),
             "spaced": (0, lambda: mail(" @ ", " . ")), "half spaced": (0, lambda: mail("@", " . ")),
             "ip": (1, lambda: ip(".")), "dashes": (1, lambda: ip("-")), "ip spaced": (1, lambda: ip(" . ")),
             "defanged": (1, lambda: ip("[.]")), "ip words": (1, lambda: ip(" dot "))}
    rows, meant = [], {}
    for name, (kind, form) in forms.items():
        for i in range(1000 if name in ("mail", "ip") else 200):
            at = len(rows)
            before = rng.choice(["please write to ", "mail me: ", "contact "] if kind == 0 else ["the server at ", "ip address ", "log in to host "])
            span = form()
            rows.append((at, f"{before}{span} for more of it"))
            meant[at] = (name, len(before), len(before) + len(span), kind)
    clean = ["look at the dot on the map at noon", "we met at seven . then we left", f"on 2024-01-{rng.randint(10, 28)} it rained",
             "version 3.2 at last, section 4 . 5 of it", "order number 9912345678 was shipped in 2031", "she stared at it. Dot by dot it faded"]
    rows += [(10_000 + i, clean[i % len(clean)]) for i in range(120)]
    rows += [(20_000 + i, f"code {rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(1, 9)}.{i} and user{i}@local") for i in range(120)]
    found = {r.doc_id: r.found for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, of = collections.Counter(), collections.Counter()
    for at, (name, start, end, kind) in meant.items():
        of[name] += 1
        hit[name] += any((x.start, x.end, x.kind) == (start, end, kind) for x in found[at])
    assert all(hit[n] >= 0.9 * of[n] for n in of), " ".join(f"{n}:{hit[n]}" for n in of)
    assert not any(found[10_000 + i] for i in range(120)) and not any(found[20_000 + i] for i in range(120))


def test_generators_take_linear_time_on_long_runs():
    for part in ("a at ", "a at b dot ", "1-", "1 . ", "a@", "a @ ", "a . ", "a.", "(", "1 dot ", "@", "[dot]", "9"):
        text = part * 30_000
        begun = time.perf_counter()
        pii._proposed(text)
        assert time.perf_counter() - begun < 10, part


def test_trees_and_limits_take_every_candidate(spark, monkeypatch):
    """F8: no sample: beyond 20,000 candidates the trees still get all that are not held out."""
    class Seen(Exception):
        pass

    class Trees:
        def __init__(self, **_):
            pass

        def fit(self, rows):
            raise Seen(rows.count())
    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    text = " x ".join(f"10.0.{i % 256}.{i // 256} 999-1-1-{i % 90}" for i in range(400))
    rows = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string").repartition(4)
    try:
        pii.find_pii(rows)
        raise AssertionError("no training")
    except Seen as e:
        assert e.args[0] > 25_000
    held = [(1, 1.0, False, 0.9), (1, 1.0, False, 0.9), (1, 0.0, False, 0.4), (1, 1.0, False, 0.4), (1, 0.0, False, 0.1), (0, 1.0, True, 0.3)]
    counted = [(*r, held.count(r)) for r in dict.fromkeys(held)]
    for precision in (0.5, 0.7, 0.9):
        assert pii._calibrated(counted, precision) == pii._calibrated(held, precision)
