"""Subword vocabulary learning and use.

``learn_bpe`` learns the merges one at a time in few passes (``bpe_learn``), or in
fast mode several at once.  Words are cut, counted and encoded in Arrow functions, all
words of a slice of texts at once (``bpe_encode``): no token is shuffled, none is a Python object.

Ids: specials 0–4, sorted alphabet (initial then ``##`` pieces), merges in rank order.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.operators.bpe_encode import ArrayEncoder, WordEncoder, cut_words, offsets as _offsets, sliced as _by_bytes, spans  # noqa: F401
from qalam.operators.bpe_learn import MOST_RUNS, joined, learn_merges, pair_counts
from qalam.operators.pack import BOS, EOS, SPECIALS, UNK
from qalam.plans.session import materialize

PRETOKEN = "(?U)\\w+|[^\\w\\s]+"   # the Whitespace pre-tokenizer: \w+|[^\w\s]+
MAX_BROADCAST_VOCAB = 1_000_000   # subword vocabularies are 32k-64k; refuse anything unbounded
# Of these and spaces the words are what stands between the spaces: cut without the pattern.
# The whole text is asked in one run: trying each place for a character outside takes Java ten times as long.
PLAIN = "\\A[A-Z0-9_a-z \\x{0641}-\\x{064A}\\x{0621}-\\x{063A}]*+\\z"
SLICE = 256                       # rows that are decoded at a time


def pretokenize(text_col: str = "text") -> F.Column:
    """M2: word and punctuation runs."""
    c = F.col(text_col)
    return F.when(c.rlike(PLAIN), F.array_remove(F.split(c, " "), "")).otherwise(F.regexp_extract_all(c, F.lit(PRETOKEN), 0))


def _other_words(text_col: str) -> F.Column:
    """The words of a text that spaces alone do not tell, null for all others: those are cut in the task (``cut_words``)."""
    c = F.col(text_col)
    return F.when(~c.rlike(PLAIN), F.regexp_extract_all(c, F.lit(PRETOKEN), 0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _by_bytes(batches, 0):
        found = pc.value_counts(cut_words(batch.column(0), batch.column(1))[0])
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "freq"])


def word_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, freq)`` of pre-tokens, counted per slice of texts before the shuffle."""
    rows = df.select(F.col(text_col).alias("__text"), _other_words(text_col).alias("__words"))
    return rows.mapInArrow(_counted, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


def initial_symbols(word: F.Column, prefix: str = "##") -> F.Column:
    chars = F.regexp_extract_all(word, F.lit("(?s)."), 0)
    return F.array_join(F.transform(chars, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(prefix), c))), " ")


def _java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _apply(sym: F.Column, merges) -> F.Column:
    for l, r, m in merges:
        pat = f"(?<![^ ]){_java_quote(l)} {_java_quote(r)}(?![^ ])"
        sym = F.regexp_replace(sym, pat, m.replace("\\", "\\\\").replace("$", "\\$"))
    return sym


def disjoint_pairs(ranked: list[tuple[str, str, int]], existing: set[str], prefix: str) -> list[tuple[str, str, int]]:
    """The merges of a round in fast mode: every pair of the ranked list that shares no symbol with a better one."""
    taken, used, made = [], set(), set()
    for l, r, c in ranked:
        m = joined(l, r, prefix)
        if l in used or r in used or l == r or m in existing or m in made:
            continue
        taken.append((l, r, c))
        used |= {l, r}
        made.add(m)
    return taken or [ranked[0]]


def _fast_merges(spark: SparkSession, words: DataFrame, alphabet: list[str], budget: int, min_frequency: int, prefix: str,
                 batch: int, checkpoint_every: int = 10):
    """Rounds that merge all symbol-disjoint pairs among the ``batch`` best."""
    existing, merges, rounds, prev = set(SPECIALS) | set(alphabet), [], [], None
    words = words.persist()
    while len(merges) < budget:
        ranked = [(r["l"], r["r"], r["c"]) for r in pair_counts(words).orderBy(F.desc("c"), "l", "r").limit(batch).collect()]
        if not ranked or ranked[0][2] < min_frequency:
            break
        take = [t for t in disjoint_pairs(ranked, existing, prefix) if t[2] >= min_frequency][: budget - len(merges)]
        step = [(l, r, joined(l, r, prefix)) for l, r, _ in take]
        merges += [(l, r, m, c) for (l, r, m), (_, _, c) in zip(step, take)]
        existing |= {m for _, _, m in step}
        rounds.append(len(step))
        if prev is not None:
            prev.unpersist()      # the table it fed is cached by now (last job)
        prev, words = words, words.select("freq", _apply(F.col("sym"), step).alias("sym"))
        words = (materialize(words) if len(rounds) % checkpoint_every == 0 else words).persist()
    for one in (words, prev):
        if one is not None:
            one.unpersist()
    return merges, rounds


def learn_bpe(spark: SparkSession, corpus: DataFrame, text_col: str = "text", vocab_size: int = 32000,
              min_frequency: int = 2, prefix: str = "##", batch: int = 64, exact: bool = True,
              most_runs: int = MOST_RUNS):
    """M1: returns ``(merges, vocab)`` DataFrames:
    ``merges(rank, left, right, merged, count, exact)`` and ``vocab(token, id)``.

    ``exact=True`` gives the one-merge-at-a-time result (``most_runs`` bounds what a
    pass brings to the driver); ``exact=False`` merges all symbol-disjoint pairs
    among the ``batch`` best of a round, a slightly different order (flagged in
    the ``exact`` column)."""
    words = word_frequencies(corpus, text_col).select(initial_symbols(F.col("word"), prefix).alias("sym"), "freq")
    words = materialize(words)
    alpha = (words.select(F.explode(F.split("sym", " ")).alias("t")).distinct()
                  .agg(F.collect_list("t")).first()[0])
    alphabet = sorted(a for a in alpha if not a.startswith(prefix)) + sorted(a for a in alpha if a.startswith(prefix))
    budget = vocab_size - len(SPECIALS) - len(alphabet)
    if exact:
        merges, log = learn_merges(spark, words, alphabet, budget, min_frequency, prefix, most_runs)
    else:
        merges, log = _fast_merges(spark, words, alphabet, budget, min_frequency, prefix, batch)
    learn_bpe.last_rounds = log
    mdf = spark.createDataFrame([(i, l, r, m, c, exact) for i, (l, r, m, c) in enumerate(merges)],
                                "rank int, left string, right string, merged string, count long, exact boolean")
    tokens = list(dict.fromkeys([*SPECIALS, *alphabet, *(m for _, _, m, _ in merges)]))
    vdf = spark.createDataFrame(list(enumerate(tokens)), "id int, token string").select("token", "id")
    return mdf, vdf


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: what a worker holds as Python objects does not grow with Spark's batches."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)


def _encoded(tables, prefix: str, drop_empty: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = ArrayEncoder(*tables(), prefix)
    for batch in _by_bytes(batches, -2):
        words, ends = cut_words(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
        flat, _, sizes = coder.of_all(words)
        before = np.concatenate([[0], np.cumsum(sizes)])[ends]
        ids = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(flat, pa.int32()))
        out = pa.RecordBatch.from_arrays([*batch.columns[:-2], ids], names=[*batch.schema.names[:-2], "ids"])
        yield out.filter(pa.array(np.diff(before) > 0)) if drop_empty else out


def _tables(spark: SparkSession, merges: DataFrame, vocab: DataFrame):
    """Merge ranks and ids for the tasks, behind the check of their size."""
    n_vocab = vocab.count()
    if n_vocab > MAX_BROADCAST_VOCAB:
        raise ValueError(f"vocabulary of {n_vocab} entries is too large to broadcast (limit {MAX_BROADCAST_VOCAB})")
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}
    ids_of = {r["token"]: r["id"] for r in vocab.collect()}
    for s in ("<bos>", "<eos>", "<unk>"):
        if s not in ids_of:
            raise ValueError(f"{s} not found in vocabulary")
    try:
        held = spark.sparkContext.broadcast((ranks, ids_of))
        return lambda: held.value
    except Exception:  # noqa: BLE001  (Spark Connect: ship the bounded tables with the function)
        return lambda: (ranks, ids_of)


def encode(docs: DataFrame, merges: DataFrame, vocab: DataFrame, key_cols, text_col: str = "text",
           prefix: str = "##", add_bos_eos: bool = True, drop_empty: bool = False) -> DataFrame:
    """M3: token ids per document; with ``drop_empty`` (the web profile's rule) a document
    without any subword is dropped.  One pass, no shuffle: an Arrow function cuts the words of
    a slice of texts and encodes the distinct ones together by merge rank (``ArrayEncoder``).
    Merges and vocabulary are broadcast; both are bounded by ``vocab_size``."""
    tables = _tables(docs.sparkSession, merges, vocab)
    keys = list(key_cols)
    rows = docs.select(*keys, F.col(text_col).alias("__text"), _other_words(text_col).alias("__words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    out = rows.mapInArrow(functools.partial(_encoded, tables, prefix, drop_empty), f"{kinds}, ids array<int>")
    ids = F.concat(F.array(F.lit(BOS)), F.col("ids"), F.array(F.lit(EOS))) if add_bos_eos else F.col("ids")
    return out.select(*keys, ids.alias("ids"))


def _placed(tables, prefix: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = ArrayEncoder(*tables(), prefix)
    for batch in _by_bytes(batches, -2):
        texts = batch.column(batch.num_columns - 2)
        words, ends = cut_words(texts, batch.column(batch.num_columns - 1))
        ids, lengths, sizes = coder.of_all(words)
        before = np.concatenate([[0], np.cumsum(sizes)])
        rows = before[ends]                                  # where each text's pieces begin
        chars, starts, inside = spans(texts, words, ends, lengths, rows)
        stops = starts + lengths
        # a word after a known piece of its text: the decoder puts one space between them
        first = np.zeros(len(ids), dtype=bool)
        first[before[:-1][sizes > 0]] = True
        first[rows[:-1][np.diff(rows) > 0]] = False
        at = np.flatnonzero(first & (ids != UNK))
        at = at[ids[at - 1] != UNK]
        gap = at[(starts[at] - stops[at - 1] != 1) | (chars[np.minimum(stops[at - 1], len(chars) - 1)] != ord(" "))] - 1
        cuts = pa.array(rows, pa.int32())
        cols = [pa.ListArray.from_arrays(cuts, pa.array(c, pa.int32())) for c in (ids, starts - inside, stops - inside)]
        gaps = pa.ListArray.from_arrays(pa.array(np.searchsorted(gap, rows), pa.int32()), pa.array((stops - inside)[gap], pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *cols, gaps],
                                         names=[*batch.schema.names[:-2], "ids", "starts", "ends", "gaps"])


def encode_places(docs: DataFrame, merges: DataFrame, vocab: DataFrame, key_cols, text_col: str = "text",
                  prefix: str = "##") -> DataFrame:
    """M3 with places: ``ids``, the span ``[starts, ends)`` of the text that each id stands for (code points from 0), and
    ``gaps``: the ends of pieces after which the text goes on otherwise than the decoder does (nothing before a
    ``##`` piece, one space before a word), where neither side is unknown.  A null text has no ids."""
    held = _tables(docs.sparkSession, merges, vocab)
    keys = list(key_cols)
    rows = docs.select(*keys, F.coalesce(text_col, F.lit("")).alias("__text"), _other_words(text_col).alias("__words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    four = ", ".join(f"{c} array<int>" for c in ("ids", "starts", "ends", "gaps"))
    return rows.mapInArrow(functools.partial(_placed, held, prefix), f"{kinds}, {four}" if kinds else four)


def diagnose_roundtrip(texts: DataFrame, placed: DataFrame, vocab: DataFrame, key: str, text_col: str = "text",
                       unk: int = UNK) -> DataFrame:
    """A14 with places, per text: ``status`` (``match``, ``has_unk``, ``mismatch`` as in A14), and what it comes from:
    unknown loss (``n_unk`` ids over ``unk_chars`` characters, the first at ``first_unk``), decode errors (``n_gaps`` places
    where the decoder's spacing is not the text's, the first at ``first_gap``), and ``cleanup``: the decoder's
    clean-up rewrote the text.  ``placed`` comes from ``encode_places``, one row per key; places are code points from 0, null
    where there is none."""
    lost = F.filter(F.arrays_zip("ids", "starts", "ends"), lambda x: x["ids"] == unk)
    p = placed.withColumn("lost", lost)
    first = lambda a: F.try_element_at(a, F.lit(1))
    found = {"n_tokens": F.size("ids").cast("long"), "n_unk": F.size("lost").cast("long"),
             "unk_chars": F.aggregate("lost", F.lit(0).cast("long"), lambda a, x: a + (x["ends"] - x["starts"])),
             "first_unk": first(F.col("lost"))["starts"], "n_gaps": F.size("gaps").cast("long"), "first_gap": first(F.col("gaps"))}
    p = p.select(key, "ids", F.struct(*[c.alias(n) for n, c in found.items()]).alias("found"))
    # a text stands for itself by its digest: what is joined is small
    src = texts.select(key, _digest(F.coalesce(text_col, F.lit(""))).alias("src"))
    token = _pieces_by_id(vocab, True)
    # each row decoded where it is; if no key comes again, that is all
    own = materialize(_compared(_decoded_rows(p, token, [key, "found"], "ids", "##", False, [key])))
    again = _repeated(own, [key])
    out = own.join(src, key)
    if again is not None:
        shared = p.join(again, key, "left_semi")
        raw = _compared(_decoded_groups(shared, token, [key], "ids", "##", False))
        out = out.join(again, key, "left_anti").unionByName(shared.select(key, "found").join(src, key).join(raw, key))
    n_unk = F.col("found.n_unk")
    status = F.when(F.col("dec") == F.col("src"), "match").when(n_unk > 0, "has_unk").otherwise("mismatch")
    rest = [F.col(f"found.{c}").alias(c) for c in list(found)[1:]]
    return out.select(key, F.col("found.n_tokens").alias("n_tokens"), status.alias("status"), *rest, "cleanup")


def _digest(text: F.Column) -> F.Column:
    from qalam.functions.text import py_strip
    return F.sha2(py_strip(text), 256)


def _compared(raw: DataFrame) -> DataFrame:
    """Decoded texts as the digest of the cleaned-up text and whether clean-up changed it."""
    dec = F.col("text")
    for a, b in CLEANUP:
        dec = F.replace(dec, F.lit(a), F.lit(b))
    x = raw.withColumn("__dec", dec)
    return x.select(*[c for c in raw.columns if c != "text"], _digest(F.col("__dec")).alias("dec"), (F.col("__dec") != F.col("text")).alias("cleanup"))


# The subword decoder's tokenization clean-up replacements.
CLEANUP = [(" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"),
           (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re")]


def _decoded(tokens, prefix: str, cleanup: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(keys…, id lists, rows)``, one per key, into as many rows ``(keys…, text)`` as the key has."""
    token = tokens()
    most = max(token, default=-1) + 1
    # " ##" goes where pieces are joined, so a piece brings its own space or none; a text's first piece stays as it is
    sign, glue = " " + prefix, len(prefix)
    later = pa.array([None if (t := token.get(i)) is None else
                      (t[glue:] if t.startswith(prefix) else " " + t).replace(sign, "") for i in range(most)], pa.large_string())
    start = pa.array([None if i not in token else token[i].replace(sign, "") for i in range(most)], pa.large_string())
    for batch in _sliced(batches):
        keys, rows = batch.columns[:-2], np.asarray(batch.column(batch.num_columns - 1))
        no_key = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            no_key |= np.asarray(k.is_null())
        lists = batch.column(batch.num_columns - 2)
        outer = _offsets(lists)
        one = lists.flatten()
        at = _offsets(one)[outer]
        flat = pc.fill_null(one.flatten(), -1).to_numpy()
        known = (flat >= 0) & (flat < most)
        known[known] = np.asarray(later.is_valid())[flat[known]]
        ends = np.concatenate([[0], np.cumsum(known)])[at]
        ids = flat[known]
        pieces = later.take(pa.array(ids))
        first = ends[:-1][np.diff(ends) > 0]
        if len(first):
            mask = np.zeros(len(ids), dtype=bool)
            mask[first] = True
            pieces = pc.replace_with_mask(pieces, pa.array(mask), start.take(pa.array(ids[first])))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), pa.scalar("", pa.large_string()))
        for a, b in CLEANUP if cleanup else ():
            texts = pc.replace_substring(texts, a, b)
        shared = np.flatnonzero(np.diff(outer) > 1)         # rows that share a key are put together by place
        if len(shared) or no_key.any():
            texts = texts.to_pylist()
            for i in shared.tolist():
                put = " ".join(token[x] for _, _, x in sorted((j, token[x], x) for ids in lists[i].as_py()
                                                              for j, x in enumerate(ids) if x in token)).replace(sign, "")
                for a, b in CLEANUP if cleanup else ():
                    put = put.replace(a, b)
                texts[i] = put
            texts = pa.array(["" if gone else t for t, gone in zip(texts, no_key.tolist())], pa.large_string())
        take = pa.array(np.repeat(np.arange(batch.num_rows), rows))
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in keys), texts.take(take).cast(pa.string())],
                                         names=[*batch.schema.names[:-2], "text"])


def decode(ids: DataFrame, vocab: DataFrame, key_cols, ids_col: str = "ids", prefix: str = "##",
           cleanup: bool = True, skip_special: bool = True) -> DataFrame:
    """M4: ids → text: pieces joined by spaces, ``" ##"`` glued to the previous piece; ids without a piece are left out.

    An Arrow function decodes each list whole, no token is a row of its own.  Rows are decoded where they are; only
    those of keys that come again are shuffled, to be put together.  The keys are read beforehand, so
    ``ids`` should be a table, not a long plan."""
    keys = list(key_cols)
    token = _pieces_by_id(vocab, skip_special)
    again = _repeated(ids, keys)
    if again is None:
        return _decoded_rows(ids, token, keys, ids_col, prefix, cleanup, keys)
    alone, shared = ids.join(again, keys, "left_anti"), ids.join(again, keys, "left_semi")
    return (_decoded_rows(alone, token, keys, ids_col, prefix, cleanup, keys)
            .unionByName(_decoded_groups(shared, token, keys, ids_col, prefix, cleanup)))


MOST_REPEATED = 1_000_000        # keys that come again, up to which they go to the tasks


def _repeated(rows: DataFrame, keys: list) -> DataFrame | None:
    """The keys that stand in several rows, if there are any.  A key with a null is a text of its own (``_decoded``)."""
    found = materialize(rows.select(*keys).dropna("any").groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").drop("__rows"))
    n = found.count()
    return (F.broadcast(found) if n <= MOST_REPEATED else found) if n else None


def _decoded_rows(ids: DataFrame, token, keep: list, ids_col: str, prefix: str, cleanup: bool, keys: list) -> DataFrame:
    """``(keep…, text)``, every row decoded alone; without a key it has no text."""
    there = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    lists = F.when(there, F.array(ids_col)).otherwise(F.array().cast(f"array<{ids.schema[ids_col].dataType.simpleString()}>"))
    per = ids.select(*keep, lists.alias("__ids"), F.lit(1).cast("long").alias("__rows"))
    return _run_decoder(per, token, prefix, cleanup)


def _decoded_groups(ids: DataFrame, token, keys: list, ids_col: str, prefix: str, cleanup: bool) -> DataFrame:
    """``(keys…, text)``, the rows of a key put together."""
    per = ids.groupBy(*keys).agg(F.collect_list(ids_col).alias("__ids"), F.count(F.lit(1)).alias("__rows"))
    return _run_decoder(per, token, prefix, cleanup)


def _run_decoder(per: DataFrame, token, prefix: str, cleanup: bool) -> DataFrame:
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in per.schema.fields[:-2])
    return per.mapInArrow(functools.partial(_decoded, token, prefix, cleanup), f"{kinds}text string")


def _pieces_by_id(vocab: DataFrame, skip_special: bool):
    """The bounded vocabulary for the tasks: pieces by id, without the specials if they are to be skipped."""
    found = vocab.select(F.col("id").cast("int"), "token").limit(MAX_BROADCAST_VOCAB + 1).collect()
    if len(found) > MAX_BROADCAST_VOCAB:
        raise ValueError(f"vocabulary of more than {MAX_BROADCAST_VOCAB} entries is too large to broadcast")
    token = {i: t for i, t in found if t is not None and not (skip_special and t in SPECIALS)}
    try:
        held = vocab.sparkSession.sparkContext.broadcast(token)
        return lambda: held.value
    except Exception:  # noqa: BLE001  (Spark Connect: ship the bounded table with the function)
        return lambda: token


def vocab_report(vocab: DataFrame) -> DataFrame:
    """Vocabulary size and Arabic / ``##`` / Latin / diacritic token shares."""
    t = F.col("token")
    out = vocab.agg(F.count(F.lit(1)).cast("long").alias("size"),
                    F.count_if(t.rlike("[\\x{0600}-\\x{06FF}]")).cast("long").alias("arabic"),
                    F.count_if(t.startswith("##")).cast("long").alias("subword"),
                    F.count_if(t.rlike("[a-zA-Z]")).cast("long").alias("latin"),
                    F.count_if(t.rlike("[\\x{064B}-\\x{065F}\\x{0670}]")).cast("long").alias("diacritic"))
    for c in ("arabic", "subword", "latin", "diacritic"):
        out = out.withColumn(f"{c}_share", F.col(c) / F.greatest(F.col("size"), F.lit(1)))
    return out


def fertility_and_roundtrip(texts: DataFrame, encoded: DataFrame, decoded: DataFrame, key: str,
                            text_col: str = "text", unk: int = UNK) -> DataFrame:
    """A13 + A14 per text: tokens, fertility (tokens per character), unk
    count, and round-trip status ``match`` / ``has_unk`` / ``mismatch``."""
    kept_ids = F.filter("ids", lambda x: ~x.isin(BOS, EOS))
    # a text stands for itself by its digest: what is joined is small
    e = encoded.select(key, kept_ids.alias("ids")).select(key, F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x == unk)).alias("n_unk"))
    j = (texts.select(key, F.length(text_col).alias("chars"), _digest(F.col(text_col)).alias("src")).join(e, key)
              .join(decoded.select(key, _digest(F.col("text")).alias("dec")), key))
    n, n_unk = F.col("n"), F.col("n_unk")
    status = F.when(F.col("dec") == F.col("src"), "match").when(n_unk > 0, "has_unk").otherwise("mismatch")
    return j.select(key, n.cast("long").alias("n_tokens"), (n / F.greatest(F.col("chars"), F.lit(1))).alias("fertility"),
                    "n_unk", status.alias("status"))


def tokenizer_report(per_text: DataFrame, vocab: DataFrame) -> DataFrame:
    """A13 + A14 in one row: texts, mean fertility, texts per round-trip status, special token ids
    (in the order of ``SPECIALS``)."""
    per = per_text.agg(F.count(F.lit(1)).alias("n_texts"), F.avg("fertility").alias("mean_fertility"),
                       *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("match", "has_unk", "mismatch")])
    ids = vocab.filter(F.col("token").isin(SPECIALS)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "token"))), lambda x: x["id"].cast("int")).alias("special_ids"))
    return per.withColumn("__k", F.lit(1)).join(ids.withColumn("__k", F.lit(1)), "__k").drop("__k")   # one row each
