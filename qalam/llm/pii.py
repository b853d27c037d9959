"""Personal data by candidate gradient boosting (operator 2).

1. Generators with high recall propose overlapping spans: the strict patterns
   (their valid matches are the base spans), looser number runs offered as card,
   phone and address, addresses parted by dashes or by spaced, bracketed or written dots, mail
   addresses written out ("at", "dot", with or without brackets), spaced, or without a
   domain ending.
2. Each (span, kind) gets format and context features.  A valid base span is positive,
   a candidate that breaks its kind's rules is negative, any other is unlabelled (and
   left out where it touches a base span).
3. Boosted trees (Spark ML) learn to tell base spans from the others on all labelled
   candidates but those held out (three in ten).  That score is the chance of being real times the share of
   real spans that are base (positive and unlabelled learning), so it is divided by
   that share: the mean score of the held-out base spans of the kind.  Per kind, a
   threshold from ``REAL`` up is calibrated on all held-out labelled candidates so that at
   least ``PRECISION`` of those selected are positive; unlabelled ones count for nothing.
4. Candidates above their threshold that keep their kind's rules (digits, ranges,
   check sum) and touch no base span are added, best first, where no span
   overlaps them.  Base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.llm.common import materialize, seeded_key

KINDS = ("email", "ip", "card", "phone")
TASK_ROWS = 5_000        # candidates in a training task, about
STEPS = 1_000_000        # held-out scores are counted in steps of one over this
PRECISION = 0.9
REAL = 0.5               # corrected score from which a span is more likely real than not

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,3}[0-9]){6,}")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?[(\[{]at[)\]}][ ]?[A-Za-z0-9-]{1,63}"
                    r"(?:[ ]?(?:\.|[(\[{]dot[)\]}])[ ]?[A-Za-z0-9-]{1,63})+")
_WORDED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} (?i:at) [A-Za-z0-9-]{1,63}"
                     r"(?: (?i:dot) [A-Za-z0-9-]{1,63})*? (?i:dot) [A-Za-z]{2,63}(?![A-Za-z0-9-])(?! (?i:dot) )")
_SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: @ ?|@ )[A-Za-z0-9-]{1,63}(?:(?:\.| \. )[A-Za-z0-9-]{1,63})+"
                     r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?: \. [A-Za-z0-9-]{1,63})+")
_PARTED = re.compile(r"(?<![0-9])(?<![0-9]-)[0-9]{1,3}(-| \. |\[\.\]|\(\.\)| ?[(\[]dot[)\]] ?| dot )[0-9]{1,3}(?:\1[0-9]{1,3}){2}(?!-?[0-9])")
_AT = re.compile(r"[ ]?[(\[{]at[)\]}][ ]?|(?i: at )| ?@ ?")
_DOT = re.compile(r"[ ]?[(\[{]dot[)\]}][ ]?|(?i: dot )| \. ")
_PART = re.compile(r"-| \. |\[\.\]|\(\.\)| ?[(\[]dot[)\]] ?| dot ")
_BARE = re.compile(r"@[A-Za-z0-9-]++(?!\.[A-Za-z0-9-])")
_CUES = (re.compile(r"mail|contact|write|@", re.I), re.compile(r"\bip\b|host|addr|server", re.I),
         re.compile(r"card|visa|credit|pay|account|iban", re.I), re.compile(r"tel|phone|call|fax|mobile|whatsapp", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _local_start(text: str, at: int, least: int) -> int:
    i = at
    while i > least and text[i - 1] in _LOCAL:
        i -= 1
    return i


def _small(part: str) -> bool:
    return len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the strict patterns, valid matches only, by start then kind.

    A mail match starts at the run of local characters before its ``@`` (not
    before the previous match's end), which is where a leftmost search starts."""
    out, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = _local_start(text, m.start(), end)
            if start < m.start():
                end = m.end()
                out.append((start, end, 0))
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def _proposed(text: str) -> set[tuple[int, int, int]]:
    out = set()
    if "@" in text:
        for m in _BARE.finditer(text):
            if (start := _local_start(text, m.start(), 0)) < m.start():
                out.add((start, m.end(), 0))
        out |= {(*m.span(), 0) for m in _SPACED.finditer(text)}
    if "at" in text:
        out |= {(*m.span(), 0) for m in _SPELT.finditer(text)}
    if any(d in text for d in (" dot ", " DOT ", " Dot ")):
        out |= {(*m.span(), 0) for m in _WORDED.finditer(text)}
    if _DIGIT.search(text):
        out |= {(*m.span(), 1) for m in _PARTED.finditer(text)}
        for m in _RUN.finditer(text):
            out |= {(*m.span(), k) for k in ((1, 2, 3) if m.group().count(".") >= 3 else (2, 3))}
    return out


def _breaks_rules(body: str, kind: int) -> bool:
    digits = "".join(_DIGIT.findall(body))
    if kind == 0:
        return "." not in _DOT.sub(".", body)
    if kind == 1:
        parts = re.split(r"[^0-9]+", body.strip("+("))
        return len(parts) != 4 or not all(map(_small, parts))
    if kind == 2:
        return not (12 <= len(digits) <= 19 and luhn(digits))
    return not 9 <= len(digits) <= 15


def _place(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


FEATURES = 22


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    """Format and context of a span; whether it holds the strict pattern's own marks
    (the plus sign, "@" and "." against "at" and "dot", an address's dots against dashes) is left out, so that the trees
    look at the rest."""
    body = text[start:end].lstrip("+")
    if kind == 0:
        body = _DOT.sub(".", _AT.sub("@", body))
    elif kind == 1:
        body = _PART.sub(".", body)
    groups = [len(g) for g in re.findall("[0-9]+", body)]
    digits = sum(groups)
    around = text[max(0, start - 40):start] + " " + text[end:end + 20]
    flat = "".join(re.findall("[0-9]", body))
    return [float(kind), float(len(body)), float(digits), float(len(groups)), float(max(groups, default=0)),
            float(min(groups, default=0)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
            digits / len(body), float(body.count(" ")), float(body.count(".")), float(body.count("-")),
            float(body.count("(")), float(body.count("/")), float(sum(map(str.isalpha, body)) / len(body)),
            float(12 <= len(flat) <= 19 and luhn(flat)), _place(text[start - 1:start] if start else ""),
            _place(text[end:end + 1]), *[float(len(c.findall(around))) for c in _CUES]]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    kind_of = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                  ("base", pa.bool_()), ("open", pa.bool_()), ("wrong", pa.bool_()), ("x", pa.list_(pa.float64()))]))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part, rows = batch.slice(at, 512), []
            for text in part.column(part.num_columns - 1).to_pylist():
                base = [(s, e, order[k]) for s, e, k in base_spans(text)]
                got, strict = [], set(base)
                for s, e, k in sorted(strict | _proposed(text)):
                    wrong = (s, e, k) not in strict and _breaks_rules(text[s:e], k)
                    free = not (wrong or any(a < e and s < b for a, b, _ in base))
                    got.append({"kind": k, "start": s, "end": e, "base": (s, e, k) in strict, "open": free,
                                "wrong": wrong, "x": features(text, s, e, k)})
                rows.append(got)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, type=kind_of)],
                                             names=[*part.schema.names[:-1], "c"])


def _calibrated(held: list[tuple], precision: float) -> dict[int, tuple[float, float]]:
    """Per kind ``(share, limit)`` from held-out ``kind, label, unlabelled, score`` and how many
    there are of it (one, if left out).

    ``share`` is the mean score of base spans, ``limit`` the lowest score over it, from
    ``REAL`` up, from which on the precision among labelled candidates stays reached.  A
    kind without held-out base spans takes both from all kinds together."""
    out, held = {}, [(*r, 1)[:5] for r in held]
    for kind in range(len(KINDS)):
        own = [r for r in held if r[0] == kind]
        if not any(y for _, y, *_ in own):
            own = held
        base = [(p, n) for _, y, _, p, n in own if y]
        share = sum(p * n for p, n in base) / sum(n for _, n in base) if base else 1.0
        rows = sorted(((p / share, y, n) for _, y, free, p, n in own if not free), reverse=True)
        best, good, seen = 2.0 / share, 0.0, 0
        for i, (p, y, n) in enumerate(rows, 1):
            good, seen = good + y * n, seen + n
            if good / seen >= precision and (i == len(rows) or rows[i][0] < p):
                best = p if i < len(rows) else 0.0
        out[kind] = share, max(best, REAL)
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             precision: float = PRECISION, seed: int = 53) -> DataFrame:
    """One row per input row: ``doc_id`` and ``found``, an array of ``start, kind, end, base, score`` by
    start, then kind (0 email, 1 ip, 2 card, 3 phone).

    Positions count code points, the end is exclusive; base spans have score 1.  A
    null text counts as empty.  A text of any length is searched whole, in time
    that grows with its length.  Without both labels nothing is
    added.  Null ids, repeated rows and empty tables pass through; other columns
    are ignored."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(rows.mapInArrow(
        _candidates, f"row long, doc_id {id_type}, c array<struct<kind:int,start:int,end:int,base:boolean,"
                     "open:boolean,wrong:boolean,x:array<double>>>"))
    spans = rows.select("row", "doc_id", F.inline("c"))
    labelled = spans.filter("base or wrong or open").withColumn("label", F.col("base").cast("double")).withColumn("key", seeded_key(seed, F.col("doc_id"), F.col("start")))
    drawn = materialize(labelled.select(
        "kind", "label", "open", array_to_vector("x").alias("features"),
        (F.conv(F.substring("key", 9, 2), 16, 10).cast("int") < 77).alias("held")))
    drawn = drawn.coalesce(max(4, drawn.count() // TASK_ROWS))
    fit = drawn.filter(~F.col("held"))
    added = None
    if fit.select("label").distinct().count() == 2:
        model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(fit)
        p = vector_to_array("probability")[1]
        # equal scores are counted on the cluster; rounded down, so that a limit keeps what it was taken from
        score = (F.floor(p * STEPS) / STEPS).alias("p")
        held = [tuple(r) for r in model.transform(drawn.filter("held")).groupBy("kind", "label", "open", score)
                .agg(F.count(F.lit(1)).alias("n")).collect()]
        limits = _calibrated(held, precision)
        share, limit = (F.element_at(F.array(*[F.lit(limits[k][i]) for k in range(len(KINDS))]), F.col("kind") + 1)
                        for i in (0, 1))
        scored = model.transform(spans.filter("open").withColumn("features", array_to_vector("x")))
        added = (scored.withColumn("score", p / share).filter(F.col("score") >= limit)
                 .withColumn("score", F.least("score", F.lit(1.0))).groupBy("row")
                 .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "start", "end", "kind")))
                      .alias("more")))
    one = "struct<start:int,kind:int,end:int,base:boolean,score:double>"
    base = F.transform(F.filter("c", lambda x: x["base"]),
                       lambda x: F.struct(x["start"], x["kind"], x["end"], x["base"], F.lit(1.0).alias("score")).cast(one))
    if added is None:
        return rows.select("doc_id", base.alias("found"))
    # best first: an added span overlaps no span chosen before it
    free = F.aggregate(
        F.coalesce("more", F.expr("cast(array() as array<struct<s:double,start:int,end:int,kind:int>>)")),
        F.col("base_spans"),
        lambda acc, x: F.when(F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"])), acc)
        .otherwise(F.concat(acc, F.array(F.struct(x["start"], x["kind"], x["end"], F.lit(False).alias("base"),
                                                  (-x["s"]).alias("score")).cast(one)))))
    joined = rows.withColumn("base_spans", base).join(added, "row", "left")
    return joined.select("doc_id", F.sort_array(free).alias("found"))


def describe(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the digest of the base spans and the list of all spans."""
    def listed(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("found", lambda x: x["base"])
    def of(kind: int):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"),
                        (F.size("found") - F.size(base)).cast("long").alias("n_added"))
