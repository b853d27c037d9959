"""Registered queries of the package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.llm import (best_fit, bpe_prefix, filter_audit, fingerprint, id_files, line_dedup, mixing, ngram_join, pii,
                       piece_table, quality, sharding)
from qalam.llm import exact_dedup as ed
from qalam.llm.common import documents, fresh_folder
from qalam.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


# CRC-32 in SQL: the table by its rule, then one fold over the bytes.
_CRC = """
bytes AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
step0 AS (SELECT range AS i, range AS c FROM range(256)),
step8 AS (SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM step0),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM bytes, step8)"""


@query("op1_sharding", oracle=f"""
WITH {_CRC},
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, crc,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
    md5('17:' || doc_id) AS key FROM documents JOIN crc USING (doc_id)),
r AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY key, doc_id) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY src) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, src, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (pos * 8 // n)::INT AS shard,
    (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p""")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards that match the source mixture, sizes one row apart at most."""
    return sharding.shard_rows(documents(spark, sf_dir), shards=8)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: strict matches and the spans boosted trees add."""
    return pii.describe(pii.find_pii(documents(spark, sf_dir)))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs in other documents."""
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return out.select("doc_id", lines.alias("n_lines"), "dropped_lines", F.col("kept_text").alias("text"))


@query("op4_fingerprint")
def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses."""
    return fingerprint.fingerprint_edits(documents(spark, sf_dir))


@query("op5_ngram_join", oracle=r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x), deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low.y, s.doc_id)) AS component_id,
    CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN low ON low.x = s.doc_id LEFT JOIN deg ON deg.x = s.doc_id""")
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of the 4-gram Jaccard join at 0.85 and its links."""
    return ngram_join.link_documents(documents(spark, sf_dir), k=4, num=85, den=100)


@query("op6_exact_dedup", oracle="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    return ed.exact_dedup(documents(spark, sf_dir))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: id count and digests of ids and text."""
    both = bpe_prefix.decode_documents(bpe_prefix.encode_documents(documents(spark, sf_dir)))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("op8_id_files")
def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id files of all documents, written and read back: place, id count and CRC of each."""
    folder = fresh_folder(spark, "ids")
    id_files.write_ids(documents(spark, sf_dir), folder)
    return id_files.read_ids(spark, folder, ids_crc32=F.crc32("ids"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mixture of the sources by weights 5, 2, 1."""
    plan, uses = mixing.mix(documents(spark, sf_dir))
    used = uses.groupBy("row").agg(F.count(F.lit(1)).alias("uses"), F.min("shard").alias("first_shard"))
    return (plan.join(used, "row", "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("size") * F.coalesce("uses", F.lit(0))).alias("taken"), "first_shard"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and decision for every document, from weak labels."""
    shaped = quality.prepare(documents(spark, sf_dir))
    model, _ = quality.fit(shaped)
    return quality.score(shaped, model)


_MASKS = r"""
words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
     'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'),
     'E': coalesce(min(words.doc_id) OVER (PARTITION BY t) < words.doc_id, false)} AS f
    FROM words LEFT JOIN lab ON lab.doc_id = words.doc_id),
m AS (SELECT part, good, toxic, [f.A, f.B, f.C, f.D, f.E] AS f, count(*) AS n FROM fails GROUP BY ALL)"""


@query("op11_filter_audit", oracle=f"""
WITH {_MASKS},
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
x AS (SELECT part, good, toxic, n, o, step, f[o[step]] AS fails,
    coalesce(list_bool_or(list_transform(o[1:step - 1], lambda k: f[k])), false) AS gone,
    f[o[step]] AND len(list_filter(f, lambda y: y)) = 1 AS alone FROM m, s),
r AS (SELECT part, o, step,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost FROM x GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, step, kept::BIGINT AS kept,
    removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley FROM r""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from the documents in each order of the filters."""
    path = f"{sf_dir.rstrip('/')}/documents.parque[t]"       # a file or a folder
    return filter_audit.audit(spark, path, read_table(spark, sf_dir, "labels"))


@query("op12_fill_in_middle", oracle=r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1,
    ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi FROM u),
p AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid,
    array_to_string(units[hi + 1:n], '') AS suf, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
    OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, arranged, and restored."""
    back = piece_table.restore(piece_table.fill_in_middle(documents(spark, sf_dir)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op13_best_fit")
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    packed = best_fit.pack(documents(spark, sf_dir), ids_crc32=F.crc32("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
