"""Registered queries: subword vocabulary (M1–M4, A12–A14, A17) on the cleaned forum corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.operators.bpe import (decode, diagnose_roundtrip, encode, encode_places, fertility_and_roundtrip, initial_symbols, learn_bpe, tokenizer_report,
                                 vocab_report, word_frequencies)
from qalam.operators.bpe_learn import pair_counts
from qalam.operators.cleaning import kept
from qalam.operators.pack import cut_shards, doc_offsets, pack_accounting
from qalam.plans import duck as d
from qalam.plans.cleaning import (clean_to_table, forum_flagged, forum_flagged_sql, web_flagged, web_flagged_sql)
from qalam.plans.registry import query
from qalam.plans.session import materialize

VOCAB_SIZE = 200


def _corpus(spark, sf_dir):
    return kept(forum_flagged(spark, sf_dir)).select("id", F.col("clean").alias("text"))


_LEARNED: dict = {}


def _learned(spark, sf_dir, corpus=None, name="forum"):
    """Learn once per session and input; the result is two small tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name, VOCAB_SIZE)
    if key not in _LEARNED:
        corpus = _corpus(spark, sf_dir) if corpus is None else corpus
        _LEARNED[key] = learn_bpe(spark, corpus, vocab_size=VOCAB_SIZE, min_frequency=2)
    return _LEARNED[key]


WF_SQL = forum_flagged_sql() + f""", words AS (SELECT unnest({d.tokens('clean')}) AS word FROM f6 WHERE drop_reason IS NULL),
wf AS (SELECT word, count(*) AS freq FROM words GROUP BY word)
"""


@query("bpe_word_freq", WF_SQL + "SELECT word, CAST(freq AS BIGINT) AS freq FROM wf")
def bpe_word_freq(spark, sf_dir):
    """M2 + A17: pre-token frequencies of the cleaned corpus."""
    return word_frequencies(_corpus(spark, sf_dir))


@query("bpe_first_merge", WF_SQL + """, sy AS (SELECT freq, list_transform(regexp_extract_all(word, '.'),
    lambda x, i: CASE WHEN i = 1 THEN x ELSE '##' || x END) AS s FROM wf),
pr AS (SELECT freq, unnest(list_zip(s[1:len(s) - 1], s[2:len(s)])) AS p FROM sy WHERE len(s) > 1)
SELECT p[1] AS l, p[2] AS r, CAST(sum(freq) AS BIGINT) AS c FROM pr GROUP BY ALL ORDER BY c DESC, l, r LIMIT 1""")
def bpe_first_merge(spark, sf_dir):
    """M1 round 1: the best adjacent pair (count desc, left, right)."""
    w = word_frequencies(_corpus(spark, sf_dir)).select("freq", initial_symbols(F.col("word")).alias("sym"))
    return pair_counts(w).orderBy(F.desc("c"), "l", "r").limit(1)


# M1 one merge at a time: every step counts the pairs of all words and rewrites the words.
# Symbols stand between spaces of their own, so that neighbouring pairs are found.
LEARN_SQL = "WITH RECURSIVE " + WF_SQL.strip().removeprefix("WITH ") + f""", sy AS (SELECT word, freq, list_transform(
    regexp_extract_all(word, '.'), lambda x, i: CASE WHEN i = 1 THEN x ELSE '##' || x END) AS s FROM wf),
alpha AS (SELECT DISTINCT unnest(s) AS t FROM sy),
budget AS (SELECT {VOCAB_SIZE} - 5 - count(*) AS n FROM alpha),
st(step, word, freq, sym, l, r, c) AS (
  SELECT CAST(0 AS BIGINT), word, freq, ' ' || array_to_string(s, '  ') || ' ', NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT FROM sy
  UNION ALL
  SELECT st.step + 1, st.word, st.freq, replace(st.sym, ' ' || b.l || '  ' || b.r || ' ',
         ' ' || b.l || CASE WHEN starts_with(b.r, '##') THEN substr(b.r, 3) ELSE b.r END || ' '), b.l, b.r, b.c
  FROM st, (SELECT p[1] AS l, p[2] AS r, CAST(sum(freq) AS BIGINT) AS c
            FROM (SELECT freq, unnest(list_zip(t[1:len(t) - 1], t[2:len(t)])) AS p
                  FROM (SELECT freq, string_split(trim(sym), '  ') AS t FROM st) WHERE len(t) > 1)
            GROUP BY ALL ORDER BY c DESC, l, r LIMIT 1) b
  WHERE st.step < (SELECT n FROM budget) AND b.c >= 2),
merges AS (SELECT DISTINCT CAST(step - 1 AS INT) AS rank, l, r, c,
  l || CASE WHEN starts_with(r, '##') THEN substr(r, 3) ELSE r END AS m FROM st WHERE step > 0),
toks AS (SELECT 0 AS grp, i AS k, '' AS t0, t FROM (SELECT unnest(['<pad>', '<unk>', '<bos>', '<eos>', '<mask>']) AS t,
    unnest([0, 1, 2, 3, 4]) AS i)
  UNION ALL SELECT CASE WHEN starts_with(t, '##') THEN 2 ELSE 1 END, 0, t, t FROM alpha
  UNION ALL SELECT 3, min(rank), '', m FROM merges WHERE m NOT IN (SELECT t FROM alpha) GROUP BY m),
vocab AS (SELECT t AS token, CAST(row_number() OVER (ORDER BY grp, k, t0) - 1 AS INT) AS id FROM toks)
"""


@query("bpe_vocab", LEARN_SQL + "SELECT token, id FROM vocab")
def bpe_vocab(spark, sf_dir):
    """M1: learned vocabulary: specials, alphabet, merges in rank order."""
    return _learned(spark, sf_dir)[1]


@query("bpe_merges", LEARN_SQL + """SELECT rank, l AS "left", r AS "right", m AS merged, c AS count, true AS exact FROM merges""")
def bpe_merges(spark, sf_dir):
    """M1: merges in rank order with their counts (batched rounds equal one merge at a time)."""
    return _learned(spark, sf_dir)[0]


@query("bpe_vocab_report", LEARN_SQL + """, n AS (SELECT CAST(count(*) AS BIGINT) AS size,
  CAST(count(*) FILTER (WHERE regexp_matches(token, '[\\x{0600}-\\x{06FF}]')) AS BIGINT) AS arabic,
  CAST(count(*) FILTER (WHERE starts_with(token, '##')) AS BIGINT) AS subword,
  CAST(count(*) FILTER (WHERE regexp_matches(token, '[a-zA-Z]')) AS BIGINT) AS latin,
  CAST(count(*) FILTER (WHERE regexp_matches(token, '[\\x{064B}-\\x{065F}\\x{0670}]')) AS BIGINT) AS diacritic FROM vocab)
SELECT *, arabic / size AS arabic_share, subword / size AS subword_share, latin / size AS latin_share,
  diacritic / size AS diacritic_share FROM n""")
def bpe_vocab_report(spark, sf_dir):
    """Vocabulary statistics."""
    return vocab_report(_learned(spark, sf_dir)[1])


@query("bpe_roundtrip", LEARN_SQL + f""", fin AS (SELECT word, len(string_split(trim(sym), '  ')) AS n FROM st
  WHERE step = (SELECT max(step) FROM st)),
w AS (SELECT id, length(clean) AS chars, unnest({d.tokens('clean')}) AS word FROM f6 WHERE drop_reason IS NULL)
SELECT id, CAST(sum(n) AS BIGINT) AS n_tokens, sum(n) / greatest(any_value(chars), 1) AS fertility, CAST(0 AS INT) AS n_unk,
  'match' AS status FROM w JOIN fin USING (word) GROUP BY id""")
def bpe_roundtrip(spark, sf_dir):
    """M3 + M4 + A13 + A14: encode, decode, fertility, unk, round-trip status."""
    corpus = materialize(_corpus(spark, sf_dir))
    m, v = _learned(spark, sf_dir, corpus)
    enc = materialize(encode(corpus, m, v, ["id"]))
    dec = decode(enc, v, ["id"])
    return fertility_and_roundtrip(corpus, enc, dec, "id")


@query("bpe_decoded", forum_flagged_sql() + "SELECT id, clean AS text FROM f6 WHERE drop_reason IS NULL")
def bpe_decoded(spark, sf_dir):
    """M3 → M4 by value: every kept text, encoded and decoded again, is itself."""
    corpus = materialize(_corpus(spark, sf_dir))
    m, v = _learned(spark, sf_dir, corpus)
    return decode(materialize(encode(corpus, m, v, ["id"])), v, ["id"]).select("id", "text")


@query("bpe_report", LEARN_SQL + f""", fin AS (SELECT word, len(string_split(trim(sym), '  ')) AS n FROM st
  WHERE step = (SELECT max(step) FROM st)),
w AS (SELECT id, length(clean) AS chars, unnest({d.tokens('clean')}) AS word FROM f6 WHERE drop_reason IS NULL),
per AS (SELECT id, sum(n) / greatest(any_value(chars), 1) AS fertility FROM w JOIN fin USING (word) GROUP BY id)
SELECT CAST(count(*) AS BIGINT) AS n_texts, CAST(count(*) AS BIGINT) AS n_match, CAST(0 AS BIGINT) AS n_has_unk,
  CAST(0 AS BIGINT) AS n_mismatch, [0, 1, 2, 3, 4] AS special_ids, round(avg(fertility), 9) AS mean_fertility FROM per""")
def bpe_report(spark, sf_dir):
    """A13 + A14: texts per round-trip status, special ids, mean fertility."""
    corpus = materialize(_corpus(spark, sf_dir))
    m, v = _learned(spark, sf_dir, corpus)
    enc = materialize(encode(corpus, m, v, ["id"]))
    rep = tokenizer_report(fertility_and_roundtrip(corpus, enc, decode(enc, v, ["id"]), "id"), v)
    return rep.select("n_texts", "n_match", "n_has_unk", "n_mismatch", "special_ids",
                      F.round("mean_fertility", 9).alias("mean_fertility"))


# Every kept text as it is, with its spaces doubled, and with a Latin word at its end.
@query("bpe_roundtrip_places", LEARN_SQL + f""", k AS (SELECT id, clean, {d.tokens('clean')} AS toks FROM f6 WHERE drop_reason IS NULL),
new AS (SELECT count(*) AS n, min(i) AS first FROM (SELECT unnest(['x', '##y', '##z']) AS t, unnest([0, 1, 2]) AS i)
        WHERE t NOT IN (SELECT t FROM alpha)),
sp AS (SELECT *, length(clean) - length(replace(clean, ' ', '')) AS spaces, instr(clean, ' ') AS gap FROM k)
SELECT concat(id, '/plain') AS id, 'match' AS status, CAST(0 AS BIGINT) AS n_unk, CAST(0 AS BIGINT) AS unk_chars, CAST(NULL AS INT) AS first_unk,
  CAST(0 AS BIGINT) AS n_gaps, CAST(NULL AS INT) AS first_gap FROM sp
UNION ALL SELECT concat(id, '/spaced'), CASE WHEN spaces > 0 THEN 'mismatch' ELSE 'match' END, 0, 0, NULL, spaces,
  CASE WHEN spaces > 0 THEN gap - 1 END FROM sp
UNION ALL SELECT concat(id, '/latin'), CASE WHEN n > 0 THEN 'has_unk' ELSE 'match' END, n, n,
  CASE WHEN n > 0 THEN length(clean) + 1 + first END, 0, NULL FROM sp, new""")
def bpe_roundtrip_places(spark, sf_dir):
    """A14 with places: all three outcomes, each put down to unknown characters or to the decoder's spacing."""
    corpus = materialize(_corpus(spark, sf_dir))
    m, v = _learned(spark, sf_dir, corpus)
    t = F.col("text")
    kinds = {"plain": t, "spaced": F.replace(t, F.lit(" "), F.lit("  ")), "latin": F.concat(t, F.lit(" xyz"))}
    texts = corpus.select(F.col("id").alias("__id"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in kinds.items()])))
    texts = texts.select(F.concat("__id", F.lit("/"), "kind").alias("id"), "text")
    placed = encode_places(texts, m, v, ["id"])              # read once, row by row: places take more room than the texts
    return diagnose_roundtrip(texts, placed, v, "id").select("id", "status", "n_unk", "unk_chars", "first_unk", "n_gaps", "first_gap")


@query("bpe_merges_full")
def bpe_merges_full(spark, sf_dir):
    """M1 at its full size: up to 32,000 entries, merges in rank order (equal to a plain learner in the tests)."""
    return learn_bpe(spark, _corpus(spark, sf_dir), vocab_size=32_000, min_frequency=2)[0]


def _e2_sql(flagged: str) -> str:
    """E2 accounting: kept, filtered and characters per source and in total."""
    return flagged + """, per AS (SELECT source, CAST(count(*) FILTER (WHERE drop_reason IS NULL) AS BIGINT) AS docs_kept,
  CAST(0 AS BIGINT) AS docs_dropped, CAST(count(*) FILTER (WHERE drop_reason IS NOT NULL) AS BIGINT) AS docs_filtered,
  CAST(coalesce(sum(CASE WHEN drop_reason IS NULL THEN length(clean) END), 0) AS BIGINT) AS chars, true AS all_packed, false AS is_total
FROM f6 GROUP BY source)
SELECT * FROM per UNION ALL SELECT NULL, CAST(sum(docs_kept) AS BIGINT), CAST(sum(docs_dropped) AS BIGINT),
  CAST(sum(docs_filtered) AS BIGINT), CAST(sum(chars) AS BIGINT), true, true FROM per"""


E2_SHARD = 20_000


def _e2(spark, sf_dir, flagged, name, drop_empty):
    """Flagged rows written once → learned subwords → offsets → shards → accounting.

    ``chars`` is counted on the texts decoded from the packed ids; ``all_packed`` says that the pieces
    hold every id once."""
    rows = clean_to_table(flagged)
    corpus = kept(rows).select("id", "source", F.col("clean").alias("text"))
    m, v = _learned(spark, sf_dir, corpus, name)
    enc = materialize(encode(corpus, m, v, ["id", "source"], drop_empty=drop_empty).withColumn("n_tokens", F.size("ids")))
    pieces = materialize(cut_shards(doc_offsets(enc, order_col="id"), "ids", E2_SHARD))
    acc = pack_accounting(enc, pieces, filtered=rows.filter("drop_reason is not null"))
    text = decode(enc, v, ["id", "source"]).groupBy("source").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    ids = enc.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    more = text.join(ids, "source")
    more = more.unionByName(more.agg(F.sum("chars").cast("long").alias("chars"), F.sum("n").alias("n"))
                            .withColumn("source", F.lit(None).cast("string")))
    j = acc.join(more.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    return j.select("source", "docs_kept", "docs_dropped", "docs_filtered", F.coalesce("chars", F.lit(0).cast("long")).alias("chars"),
                    (F.col("tokens") == F.coalesce("n", F.lit(0))).alias("all_packed"), "is_total")


@query("e2_forum", _e2_sql(forum_flagged_sql()))
def e2_forum(spark, sf_dir):
    """E2 with the forum profile: clean → learned subwords → offsets → shards, with the accounting of A15."""
    return _e2(spark, sf_dir, forum_flagged(spark, sf_dir), "forum", False)


@query("e2_web", _e2_sql(web_flagged_sql()))
def e2_web(spark, sf_dir):
    """E2 with the web profile, whose encoder drops documents without subwords."""
    return _e2(spark, sf_dir, web_flagged(spark, sf_dir), "web", True)
