"""Line deduplication by a log-template tree (operator 3).

Lines are parsed to a fixed depth: token count, then the leading tokens (a token
with a digit is a variable field and reads ``<*>``).  Inside a leaf of the tree a
token is constant when it stands at its position in enough documents, else the
position is a variable field; lines of up to three tokens have no such position.  The line with its variable fields starred is its
template.  A line that stands in two documents, or whose template does, is dropped
everywhere but in the document with the smallest id.

Everything is counted over distinct lines with their document counts, so a line
of a third of all documents is one row; leaves of a single distinct line or of
fewer than ``MIN_DOCS`` documents leave the work after the first, text-free count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalam.llm.common import materialize

MIN_DOCS = 3           # documents that make a token constant at its position
LEADING = 3            # leading tokens in the tree
CONSTANT = 0.75        # a template needs a larger share of constant tokens (or fields starred in the whole leaf)
FIELD = "<*>"
SALTS = 16             # parts of a leaf when its lines are looked up


def normal_line(line: Column) -> Column:
    """The line's tokens with fields that hold a digit starred, one space between; a line
    of such fields alone keeps them, as two numbers are not the same line.  Most
    lines hold neither digits nor odd white space and are only trimmed."""
    starred = F.when(line.rlike(r"(?<!\S)[^\s0-9]++(?!\S)"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD)) \
        .otherwise(line)
    full = F.trim(F.regexp_replace(starred, r"\s+", " "))
    return F.when(line.rlike(r"[0-9\t\x0B-\r]|  "), full).otherwise(F.trim(line))


def line_id(normal: Column) -> Column:
    return F.unhex(F.md5(normal.cast("binary")))


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
              leading: int = LEADING, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """``(lines, recurring)``: ``lines`` has ``doc, id`` per document and distinct line;
    ``recurring`` has ``id, first`` for lines that recur, by themselves or by their template
    (such a line may stand there twice; each document but a ``first`` drops it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1      # tokens
    lines = (docs.select(F.col(id_col).alias("doc"),
                         F.explode(F.array_distinct(F.transform(F.split(text, "\n"), normal_line))).alias("line"))
             .filter(F.col("line") != "").withColumn("count", count)
             .withColumn("leaf", F.xxhash64("count", F.substring_index("line", " ", leading)))
             .withColumn("id", line_id(F.col("line"))).drop("count"))
    keyed = materialize(lines.select("doc", "leaf", "id"))
    per = materialize(keyed.groupBy("leaf", "id").agg(
        F.count(F.lit(1)).alias("docs"), F.count("doc").alias("named"), F.min("doc").alias("first"), F.max("doc").alias("last")))
    # two documents or more: two ids, or one and the null id
    several = (F.col("first") < F.col("last")) | ((F.col("named") > 0) & (F.col("named") < F.col("docs")))
    equal = per.filter(several).select("id", "first")
    # a leaf of one distinct line has nothing to generalise
    leaves = (per.groupBy("leaf").agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("kinds"))
              .filter((F.col("n") >= min_docs) & (F.col("kinds") > 1))
              .select("leaf", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc", "id"), F.lit(SALTS)).cast("int"))
    known = materialize(salted.join(leaves, ["leaf", "salt"]).groupBy("leaf", "id", "line")
                        .agg(F.count(F.lit(1)).alias("docs"), F.first("n").alias("of")))
    tokens = known.select("leaf", "id", "docs", "of", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    # a position starred in the whole leaf is agreed upon like a constant one
    agreed = (F.col("token") != FIELD) | (F.col("n") == F.col("of"))
    often = (tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n"), F.first("of").alias("of"))
             .filter((F.col("n") >= min_docs) & agreed).select("leaf", "pos", "token", F.lit(True).alias("fixed")))
    shown = F.when(F.col("fixed"), F.col("token")).otherwise(FIELD)
    made = (tokens.join(often, ["leaf", "pos", "token"], "left")
            .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("t")))).alias("ts"),
                               F.avg(F.coalesce(F.col("fixed").cast("int"), F.lit(0))).alias("share"))
            .filter(F.col("share") > constant)
            .select("id", line_id(F.concat_ws(" ", F.col("ts.t"))).alias("template")))
    made = materialize(made)
    alike = per.join(made, "id").groupBy("template").agg(
        F.sum("docs").alias("docs"), F.sum("named").alias("named"), F.min("first").alias("first"), F.max("last").alias("last"))
    alike = made.join(alike.filter(several), "template").select("id", "first")
    return keyed.select("doc", "id"), materialize(equal.unionByName(alike))


def _set(line: Column, sets: Column) -> Column:
    return F.pmod(F.xxhash64(line), sets).cast("int")


def _kept(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``docs`` with ``__text`` (kept lines) and ``__dropped`` (their number)."""
    lines, recurring = templates(docs, id_col, text_col, **options)
    drops = (lines.join(recurring.select("id", "first"), "id").filter(~F.col("doc").eqNullSafe(F.col("first")))
             .groupBy("doc").agg(F.collect_set("id").alias("ids")))
    # a document's dropped lines in as many sets as each set has lines: a look-up reads one set
    sets = F.ceil(F.sqrt(F.size("ids"))).cast("int")
    drops = drops.select(F.col("doc").alias("__doc"), F.transform(
        F.sequence(F.lit(0), sets - 1), lambda k: F.filter("ids", lambda x: _set(x, sets) == k)).alias("__drop"))
    joined = docs.join(drops, docs[id_col].eqNullSafe(F.col("__doc")), "left")
    parts = F.split(F.col(text_col), "\n")
    named = F.transform(parts, lambda x: F.struct(x.alias("line"), line_id(normal_line(x)).alias("id")))
    kept = F.transform(F.filter(named, lambda x: ~F.array_contains(
        F.get("__drop", _set(x["id"], F.size("__drop"))), x["id"])), lambda x: x["line"])
    out = joined.withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
    none = F.col("__drop").isNull() | F.col(text_col).isNull()
    return (out.withColumn("__text", F.when(none, F.col(text_col)).otherwise(F.array_join("__kept", "\n")))
            .withColumn("__dropped", F.when(none, F.lit(0)).otherwise(F.size(parts) - F.size("__kept")))
            .drop("__doc", "__drop", "__kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with two more columns: ``kept_text`` and ``dropped_lines``.

    Lines are what stands between line feeds; the kept ones stay as they were, in
    order.  Blank lines are never dropped; any other may be, however short.  A text of n
    lines, d of them dropped, takes n times the root of d look-ups.  A null text
    stays null with 0 dropped lines.  Rows with the same id are one document; null ids together are one document too.  An empty
    table gives an empty result.  Columns of ``docs`` with the new names are
    replaced."""
    out = _kept(docs, id_col, text_col, **options).drop("kept_text", "dropped_lines")
    return out.withColumnsRenamed({"__text": "kept_text", "__dropped": "dropped_lines"})


def keep_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A filtering stage: the columns of ``docs`` with repeated lines gone; documents
    that lost all their words go.  ``n_chars`` follows the text where it is present."""
    out = _kept(docs, id_col, text_col, **options)
    blank = F.trim(F.regexp_replace("__text", r"\s+", " ")) == ""
    out = out.filter(~((F.col("__dropped") > 0) & F.coalesce(blank, F.lit(False))))
    new = {text_col: F.col("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__dropped") > 0, F.length("__text").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(F.col("n_chars"))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
