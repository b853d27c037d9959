"""Operators 3 and 10 as a whole against plain loops over documents."""

import collections
import math
import random
import re
import unicodedata

import numpy as np
from pyspark.ml.feature import HashingTF

from qalam.llm import line_dedup, quality
from qalam.sources.tables import read_table

WHITE = " \t\n\x0b\f\r"
FIELD = "<*>"


def _tokens(line):
    return [t for t in re.split(f"[{WHITE}]+", line) if t]


def _plain_normal(line):
    tokens = _tokens(line)
    if any(not re.search("[0-9]", t) for t in tokens):
        tokens = [FIELD if re.search("[0-9]", t) else t for t in tokens]
    return " ".join(tokens)


def _plain_lines(docs, least=3, leading=3, constant=0.75):
    """Kept text per document: the tree by nested dictionaries."""
    held = {d: {n for n in map(_plain_normal, (t or "").split("\n")) if n} for d, t in docs.items()}
    where = collections.defaultdict(set)
    for d, lines in held.items():
        for n in lines:
            where[n].add(d)
    stays = collections.defaultdict(set)           # line -> documents that may keep it, one per reason to drop
    for n, of in where.items():
        if len(of) > 1:
            stays[n].add(min(of))
    leaves = collections.defaultdict(list)
    for n in where:
        t = n.split(" ")
        leaves[(len(t), tuple(t[:leading]))].append(n)
    template = collections.defaultdict(set)
    for lines in leaves.values():
        total = sum(len(where[n]) for n in lines)
        if len(lines) < 2 or total < least:
            continue
        seen = collections.Counter()
        for n in lines:
            for at, t in enumerate(n.split(" ")):
                seen[(at, t)] += len(where[n])
        for n in lines:
            t = n.split(" ")
            fixed = [seen[(at, x)] >= least and (x != FIELD or seen[(at, x)] == total) for at, x in enumerate(t)]
            if sum(fixed) / len(t) > constant:
                template[tuple(x if f else FIELD for x, f in zip(t, fixed))].add(n)
    for lines in template.values():
        of = set().union(*(where[n] for n in lines))
        if len(of) > 1:
            for n in lines:
                stays[n].add(min(of))
    out = {}
    for d, t in docs.items():
        if t is not None:
            kept = [x for x in t.split("\n") if not any(keeper != d for keeper in stays.get(_plain_normal(x), ()))]
            out[d] = "\n".join(kept)
        else:
            out[d] = None
    return out


def test_line_templates_equal_the_plain_tree(spark):
    rng = random.Random(7)
    names, places = [f"N{c}" for c in "abcdefghij"], ["forum", "list", "board"]
    docs = {r.doc_id: r.text for r in read_table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for i in range(150):
        lines = [f"own line {i} of nothing else {'z' * i}"]
        for _ in range(rng.randint(0, 6)):
            lines.append(rng.choice([
                f"User {rng.choice(names)} wrote {rng.randint(1, 99)} comments in the {rng.choice(places)} of this old site today",
                f"Posted on the {rng.choice(names)} {rng.choice(names)} by {rng.choice(names)}",
                f"Copyright {rng.choice([2023, 2024])} Acme Inc", f"Page {rng.randint(1, 9)} of 10", f"{rng.randint(1, 3)} {rng.randint(1, 3)}",
                "All  rights\treserved.", "All rights reserved.", "", "   ", "short", rng.choice(names),
                f"the cat sat on {rng.choice(names)} mat and it slept very well there"]))
        rng.shuffle(lines)
        docs[10_000 + i] = rng.choice([None, "\n".join(lines), "\n".join(lines), "\n".join(lines)])
    want = _plain_lines(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {d: r.kept_text for d, r in got.items()} == want
    assert sum(r.dropped_lines for r in got.values()) == sum(
        len(t.split("\n")) - (len(want[d].split("\n")) if want[d] != "" or "" in t.split("\n") else 0)
        for d, t in docs.items() if t is not None)
    assert sum(r.dropped_lines for d, r in got.items() if d >= 10_000) > 200


def _kind(c):
    cat = unicodedata.category(c)
    return {"Nd": "0", "Lu": "2"}.get(cat, "1" if cat in ("Ll", "Lo", "Lm") or cat[0] == "M" else c)


def _plain_shape(text):
    zero = "".join(c for i, c in enumerate("".join("0" if unicodedata.category(c) == "Nd" else c for c in text))
                   if not (c == "0" and i and unicodedata.category(text[i - 1]) == "Nd"))
    parts = re.split(r"([ \n])", zero)               # words and the single marks between them
    for at in range(0, len(parts) - 2, 2):
        if parts[at] and parts[at + 1] == " " and parts[at] == parts[at + 2]:
            parts[at] = "4"
    out = "".join(_kind(c) if unicodedata.category(c) != "Nd" else c for c in "".join(parts))
    marked = []
    for at, c in enumerate("".join(parts)):
        k = out[at]
        if k == "1" and c != "1" and marked and marked[-1] == "a":
            continue
        if k == "2" and c != "2" and marked and marked[-1] in ("U", "V"):
            marked[-1] = "V"
            continue
        marked.append("a" if k == "1" and c != "1" else "U" if k == "2" and c != "2" else c)
    return "".join({"a": "1", "U": "2", "V": "3"}.get(c, c) for c in marked)


def _plain_votes(s):
    words = re.findall(r"[^ \n]+", s)
    n = len(words)

    def share(k):
        return k / max(n, 1)

    def bad(k, least):
        return 0 if share(k) >= least else 2
    plain = share(sum(re.fullmatch(r"[('\"]?2?1?(?:['-][12]+)*[.,;:!?)'\"]?", w) is not None for w in words))
    breaks, runs = share(len(re.findall(r"1[.!?]['\")]?[ \n]+2", s))), share(len(re.findall(r"1[,;]?[ \n](?=1)", s)))
    votes = [bad(s.count("3"), 0.2), bad(len(re.findall(r"[!?]{2,}", s)), 0.05), bad(len(re.findall(r"[*$%&#=~^<>]{2,}", s)), 0.1),
             bad(sum(not set(w) & set("01234") for w in words), 0.1),
             bad(len(re.findall("[^0-4 \t\n\x0b\f\r.,;:'\"()!?-]", s)), 0.15), bad(s.count("0"), 0.4), bad(s.count("4"), 0.2),
             1 if plain >= 0.9 else 0 if plain < 0.75 else 2,
             1 if breaks >= 0.02 else 0 if breaks < 0.005 and n >= 30 else 2,
             1 if runs >= 0.4 else 0 if runs < 0.2 else 2]
    return [2] * len(votes) if n < 3 else votes


def _plain_em(votes, rounds=200):
    """One document at a time, no counts of patterns."""
    m = len(votes[0])
    accuracy, good, post = [0.9] * m, 0.7, [0.5] * len(votes)
    for _ in range(rounds):
        new = []
        for v in votes:
            odds = math.log(good / (1 - good)) + sum(math.log(a / (1 - a)) * (1 if x == 1 else -1) for a, x in zip(accuracy, v) if x != 2)
            new.append(1 / (1 + math.exp(-odds)))
        done, post = max(abs(a - b) for a, b in zip(new, post)) < 1e-9, new
        good = min(max((sum(post) + 1) / (len(post) + 2), 0.01), 0.99)
        for j in range(m):
            right = [p if v[j] == 1 else 1 - p for p, v in zip(post, votes) if v[j] != 2]
            accuracy[j] = min(max((sum(right) + 1.8) / (len(right) + 2), 0.55), 0.995)
        if done:
            break
    return good, accuracy, post


def test_quality_equals_plain_em_and_a_plain_scorer(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    text |= {-1: "", -2: " \n ", -3: "one", -4: "A B ccc ccc ccc 12 34 éÉ ÉÉ", -5: "١٢ كتاب كتاب the 4 1 2 33", -6: "$$ %% !! ?? ##"}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    shaped = quality.prepare(df)
    shapes = {d: _plain_shape(t) for d, t in text.items()}
    rows = {r.doc_id: r for r in shaped.collect()}
    assert {d: r["shape"] for d, r in rows.items()} == shapes

    model, report = quality.fit(shaped)
    votes = {d: _plain_votes(s) for d, s in shapes.items()}
    counted = collections.Counter(tuple(v) for v in votes.values())
    assert {tuple(p): n for p, n, _ in report["patterns"]} == counted
    good, accuracy, post = _plain_em(list(votes.values()))
    assert abs(report["good"] - good) < 1e-6 and np.allclose(report["accuracy"], accuracy, atol=1e-6)
    of = {tuple(p): g for p, _, g in report["patterns"]}
    assert all(abs(of[tuple(v)] - p) < 1e-6 for v, p in zip(votes.values(), post))

    place = HashingTF(numFeatures=quality.FEATURES, inputCol="tokens", outputCol="tf")
    memo, weights = {}, model.coefficients.toArray()
    scored = {r.doc_id: r for r in quality.score(shaped, model).collect()}
    for d, s in shapes.items():
        tokens = re.findall(r"[^ \n]+", s)
        if not tokens:
            assert scored[d].score == 0.0 and not scored[d].kept
            continue
        tf = np.zeros(quality.FEATURES)
        for t in [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:])), tokens[-1]]:
            if t not in memo:
                memo[t] = place.indexOf(t)
            tf[memo[t]] += 1
        p = 1 / (1 + math.exp(-(weights @ (tf / np.sqrt(tf @ tf)) + model.intercept)))
        assert abs(scored[d].score - p) < 1e-9 and scored[d].kept == (scored[d].score >= quality.KEEP_FROM)
        assert scored[d].words == len(tokens)
