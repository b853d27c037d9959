"""Registered queries: run logs (S5), perplexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from qalam.functions.regex import S
from qalam.operators.lm import bigram_losses, group_perplexity
from qalam.plans import duck as d
from qalam.plans.packing import STREAM_SQL, _vocab_and_encoded
from qalam.plans.registry import query
from qalam.sources.files import parse_run_log
from qalam.sources.fixtures import fixture, fixture_sql


@query("run_log", f"""WITH rl AS ({fixture_sql('run_log')}),
p AS (SELECT string_split_regex({d.strip('line')}, {d.q(S + '+')}) AS p FROM rl)
SELECT TRY_CAST(p[1] AS BIGINT) AS step, p[2] AS split, TRY_CAST(p[3] AS DOUBLE) AS loss FROM p
WHERE len(p) = 3 AND TRY_CAST(p[1] AS BIGINT) IS NOT NULL AND TRY_CAST(p[3] AS DOUBLE) IS NOT NULL""")
def run_log(spark, sf_dir):
    """Parse ``step split loss`` lines, skip the rest."""
    return parse_run_log(fixture(spark, sf_dir, "run_log"), "line")


@query("group_perplexity", f"""WITH ls AS ({fixture_sql('losses')})
SELECT dialect, round(exp(sum(loss * n_tokens) / sum(n_tokens)), 9) AS perplexity, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
  CAST(count(*) AS BIGINT) AS n_sequences FROM ls WHERE n_tokens >= 2 GROUP BY dialect""")
def group_perplexity_q(spark, sf_dir):
    """Token-weighted perplexity per dialect, short sequences skipped."""
    g = group_perplexity(fixture(spark, sf_dir, "losses"), "dialect")
    return g.withColumn("perplexity", F.round("perplexity", 9))


@query("bigram_perplexity", STREAM_SQL + """,
st AS (SELECT source, doc_id, gpos, id FROM stream),
bi AS (SELECT b.source, b.doc_id, a.id AS a, b.id AS b FROM st b JOIN st a ON a.doc_id = b.doc_id AND a.source = b.source AND a.gpos = b.gpos - 1),
cab AS (SELECT a, b, count(*) AS cab FROM bi GROUP BY a, b),
ca AS (SELECT a, count(*) AS ca FROM bi GROUP BY a),
v AS (SELECT count(DISTINCT id) AS v FROM stream),
sc AS (SELECT bi.source, bi.doc_id, -ln((cab.cab + 1.0) / (ca.ca + 1.0 * v.v)) AS nll
       FROM bi JOIN cab USING (a, b) JOIN ca USING (a), v),
per AS (SELECT source, doc_id, avg(nll) AS loss, count(*) AS n FROM sc GROUP BY source, doc_id)
SELECT source, round(exp(sum(loss * n) / sum(n)), 4) AS perplexity, CAST(sum(n) AS BIGINT) AS n_tokens,
  CAST(count(*) AS BIGINT) AS n_sequences FROM per WHERE n >= 2 GROUP BY source""")
def bigram_perplexity(spark, sf_dir):
    """M7 + A11: add-1 bigram model over word ids; perplexity per source."""
    vocab, enc = _vocab_and_encoded(spark, sf_dir)
    v = vocab.count() + 2            # word ids plus <bos> and <eos>
    losses = bigram_losses(enc, ["doc_id"], "source", k=1.0, vocab_size=v)
    # perplexities near 1e4: 4 decimals is far inside double precision for any summation order
    return group_perplexity(losses, "source").withColumn("perplexity", F.round("perplexity", 4))
