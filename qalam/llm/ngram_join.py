"""Exact Jaccard self-join of documents on word n-grams (operator 5), with set-relation skipping.

Sets are the distinct 64-bit hashes of a document's word n-grams.  Equal sets
are one class from the start.  The join keeps two relations between sets:

*Index lists skip by position.*  A count sketch over all documents orders
tokens, rare ones first.  A set of n tokens enters the lists of its prefix: n less
the tokens any partner shares with it, plus an extra of ``SHARED * n``; a pair
that links shares as many prefix tokens as the smaller extra.  Sets live in
blocks of similar sets (equal minimum hash); lists hold blocks with their sizes
and positions, and a pair of blocks whose sizes or positions cannot reach the
threshold is skipped whole.

*Answers come from a similar set's answers.*  Of two blocks left, the smaller
one's sets travel to the larger one.  There the overlaps of a set with the whole
block are those of the set before it, less the lists of the tokens that went,
plus the lists of those that came.

Blocks return link counts and spanning edges, never pairs; components come from
star rounds.  Lists of heavy tokens and lists of more than ``LONG`` rows are joined
by Spark with skew handling, the others in one pass over the sorted postings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.llm.common import materialize
from qalam.llm.components import components

BLOCK_SETS = 256           # sets of a block, about
SHARED = 0.05              # share of a set by which its prefix is longer, so that a pair shares as many prefix tokens
LEAST = 3                  # and this many at least
PART_SETS = 1024           # sets that travel to one copy of a block, about
BITS = 18                  # the sketch has 2 ** BITS counters at every size of the input
SALTS = 16                 # parts of a minimum hash when its chunks are looked up
LONG = 8192                # rows of a list that one task holds
HEAVY = 5                  # counters this many (robust) deviations above the median are heavy
_MULT = np.uint64(0x9E3779B97F4A7C15)
WORDS_KEPT = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word k-grams: words between ASCII white
    space, A-Z lower-cased; fewer words than k are one gram, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = out * _MULT + h[i:i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if n > 1 else out


def _extra(n: int, num: int, den: int) -> int:
    """Prefix tokens beyond the first that a set of n tokens gets and must share; grows with n."""
    return min(-(-num * n // den), max(LEAST, int(SHARED * n)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, part.column(part.num_columns - 1).to_pylist()


def _count(k: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, total = np.zeros(1 << bits, dtype=np.int64), 0
    for _, texts in _texts(batches):
        sets = [shingles(t, k) for t in texts]
        all_ = np.concatenate(sets)
        total += len(all_)
        counts += np.bincount((all_ >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    used = np.flatnonzero(counts)
    for at in range(0, len(used), 65536):
        part = used[at:at + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["c", "n"])


def _order(tokens: np.ndarray, heavy: np.ndarray, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the global order (light by hash, then heavy by count) and whether each is heavy."""
    if not len(heavy):
        return tokens, np.zeros(len(tokens), dtype=bool)
    c = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    at = np.minimum(np.searchsorted(heavy, c), len(heavy) - 1)
    lev = np.where(heavy[at] == c, level[at], 0)
    by = np.argsort(lev, kind="stable")
    return tokens[by], lev[by] > 0


def _prefixes(k: int, num: int, den: int, bits: int, heavy, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    counters, level = heavy.value
    for part, texts in _texts(batches):
        n, sid, low, tok, big = [], [], [], [], []
        for t in texts:
            s = shingles(t, k)
            n.append(len(s))
            sid.append(xxhash.xxh3_128_digest(s.tobytes()))
            low.append(int((s * _MULT).min().view(np.int64)) if len(s) else 0)
            p = len(s) - -(-num * len(s) // den) + _extra(len(s), num, den)
            ordered, is_heavy = _order(s, counters, level, bits)
            tok.append(ordered[:p].view(np.int64))
            big.append(is_heavy[:p])
        yield pa.RecordBatch.from_arrays(
            [*part.columns[:-1], pa.array(n, pa.int32()), pa.array(sid, pa.binary()), pa.array(low, pa.int64()),
             pa.array(tok, pa.list_(pa.int64())), pa.array(big, pa.list_(pa.bool_()))],
            names=[*part.schema.names[:-1], "n", "sid", "low", "tokens", "heavy"])


def _listed(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``token, block, n, pos`` come sorted by token.  Lists of up to ``LONG`` rows give
    block pairs ``a, b`` with the number of lists they share and the number they need;
    the rows of longer lists pass through as ``token, a`` (block), ``lists`` (n), ``need`` (pos)."""
    held: list[np.ndarray] = []
    found: dict[tuple[int, int], tuple[int, int]] = {}
    long_token = None

    def skip(run: np.ndarray) -> None:
        """``run``: the rows of one token."""
        blocks, first, of = np.unique(run[:, 1], return_index=True, return_inverse=True)
        if len(blocks) < 2:
            return
        if len(blocks) == len(run):
            lo = hi = run[first, 2]
            pos = run[first, 3]
            rest = lo - pos - 1
        else:
            lo = np.full(len(blocks), 1 << 62)
            hi, pos, rest = (np.zeros(len(blocks), np.int64) for _ in range(3))
            np.minimum.at(lo, of, run[:, 2])
            np.maximum.at(hi, of, run[:, 2])
            np.maximum.at(pos, of, run[:, 3])
            np.maximum.at(rest, of, run[:, 2] - run[:, 3] - 1)
        for i in range(len(blocks) - 1):
            j = slice(i + 1, None)
            ok = _can(lo[i], hi[i], pos[i], rest[i], lo[j], hi[j], pos[j], rest[j], num, den)
            for x in np.flatnonzero(ok).tolist():
                key = (int(blocks[i]), int(blocks[i + 1 + x]))
                need = _extra(min(int(lo[i]), int(lo[i + 1 + x])), num, den)
                had = found.get(key)
                found[key] = (1, need) if had is None else (had[0] + 1, min(had[1], need))

    def batch_of(token, a, b, lists, need) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (token, a, b, lists, need)],
                                          names=["token", "a", "b", "lists", "need"])

    def passed(rows: np.ndarray) -> pa.RecordBatch:
        return batch_of(rows[:, 0], rows[:, 1], [None] * len(rows), rows[:, 2], rows[:, 3])

    def flush() -> Iterator[pa.RecordBatch]:
        if found:
            a, b = zip(*found)
            n, need = zip(*found.values())
            found.clear()
            yield batch_of([None] * len(a), a, b, n, need)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if long_token is not None and len(rows):
            more = int(np.searchsorted(rows[:, 0], long_token, side="right"))
            if more:
                yield passed(rows[:more])
            rows = rows[more:]
            if len(rows):
                long_token = None
        if not len(rows):
            continue
        rows = np.concatenate([*held, rows])
        cut = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]))
        tail = int(cut[-2])                                    # the last token's list may go on
        for s, e in zip(cut[:-2], cut[1:-1]):
            if e - s > LONG:
                yield passed(rows[s:e])
            elif e - s > 1:
                skip(rows[s:e])
        held = [rows[tail:]]
        if len(held[0]) > LONG:
            yield passed(held[0])
            long_token, held = held[0][0, 0], []
        if len(found) > 200_000:
            yield from flush()
    if held and len(held[0]) > 1:
        skip(held[0])
    yield from flush()


def _can(lo_a, hi_a, pos_a, rest_a, lo_b, hi_b, pos_b, rest_b, num: int, den: int):
    """Whether sets of two blocks can share enough, seen from this list: sizes within the
    threshold, and enough tokens before, at and behind their positions."""
    sizes = (num * lo_b <= den * hi_a) & (num * lo_a <= den * hi_b)
    need = num * (lo_a + lo_b)      # (num + den) * overlap must reach it
    most = np.minimum(pos_a, pos_b) + 1 + np.minimum(rest_a, rest_b)
    return sizes & ((num + den) * most >= need)


def _can_columns(num: int, den: int):
    """``_can`` and the lists needed as Columns over the aliases x and y."""
    c = F.col
    sizes = (num * c("y.lo") <= den * c("x.hi")) & (num * c("x.lo") <= den * c("y.hi"))
    most = F.least("x.pos", "y.pos") + 1 + F.least("x.rest", "y.rest")
    low = F.least("x.lo", "y.lo")
    need = F.least(F.ceil(num * low / den), F.greatest(F.lit(LEAST), F.floor(SHARED * low)))
    return sizes & ((num + den) * most >= num * (c("x.lo") + c("y.lo"))), need


class _Cell:
    """Overlaps between the sets of two blocks, one set's answers from the one before."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        sizes = [len(s) for s in sets]
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(self.n), sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[by], owner[by]
        first = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        self.vocab = tokens[first]
        self.start = np.concatenate((np.flatnonzero(first), [len(tokens)]))
        self.before, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(self.n, dtype=np.int64)

    def _hits(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocab, tokens)
        at = at[self.vocab.take(at, mode="clip") == tokens]
        if not len(at):
            return np.zeros(self.n, dtype=np.int64)
        begin, size = self.start[at], self.start[at + 1] - self.start[at]
        offset = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return np.bincount(self.owner[np.arange(int(size.sum())) + offset], minlength=self.n)

    def overlaps(self, x: np.ndarray) -> np.ndarray:
        gone = np.setdiff1d(self.before, x, assume_unique=True)
        if 2 * len(gone) < len(self.before):
            come = np.setdiff1d(x, self.before, assume_unique=True)
            self.counts = self.counts - self._hits(gone) + self._hits(come)
        else:
            self.counts = self._hits(x)
        self.before = x
        return self.counts


def _homes(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``home, part, side, block, row, copies, tokens`` sorted so: first the sets of a
    block (side 0, in each of its parts), then those that travelled to it (side 1).  Returns
    ``row, links, root`` of the sets that link; the root is one of their component."""
    now, home, cell, out = None, [], None, []
    links: dict[int, int] = {}
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def match(row: int, mine: int, tokens: np.ndarray, until: int) -> None:
        over = cell.overlaps(tokens)
        js = np.flatnonzero(den * over[:until] >= num * (len(tokens) + sizes[:until] - over[:until]))
        if len(js):
            links[row] = links.get(row, 0) + int(copies[js].sum())
            a = find(row)
            for j in js.tolist():
                other = home[j][0]
                links[other] = links.get(other, 0) + mine
                b = find(other)
                if a != b:
                    root[max(a, b)] = a = min(a, b)

    def open_home() -> None:
        nonlocal cell, sizes, copies
        cell = _Cell([t for *_, t in home])
        sizes = np.array([len(t) for *_, t in home])
        copies = np.array([c for _, c, _ in home])
        if now[1] == 0:               # the block with itself, in its first part only
            for i, (row, mine, tokens) in enumerate(home):
                if i:
                    match(row, mine, tokens, i)

    sizes = copies = None

    def close_home() -> None:
        nonlocal cell, home
        if home and cell is None:
            open_home()
        out.extend((r, n, find(r)) for r, n in links.items())
        links.clear()
        root.clear()
        home, cell = [], None

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            cols = list(zip(*out))
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "links", "root"])

    for batch in batches:
        key, part, side, row, mine = (batch.column(n).to_pylist() for n in ("home", "part", "side", "row", "copies"))
        for i, raw in enumerate(batch.column("tokens")):
            if (key[i], part[i]) != now:
                close_home()
                now = (key[i], part[i])
            tokens = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
            if side[i] == 0:
                home.append((row[i], mine[i], tokens))
            else:
                if cell is None:
                    open_home()
                match(row[i], mine[i], tokens, len(home))
        if len(out) > 50_000:
            yield from flush()
    close_home()
    yield from flush()


def _full_sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    for part, texts in _texts(batches):
        sets = [shingles(t, k) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
             pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "tokens"])


def link_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                   text_col: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, n_links``.

    Two documents link when ``den * shared >= num * union`` of their sets of word
    ``k``-grams.  ``component_id`` is the smallest id reachable by links, itself
    included; ``n_links`` counts the rows linked.  Null, empty and blank texts
    have an empty set, no links and their own id.  Rows with equal texts link.
    Null ids never become a component id unless the component has no other.  An
    empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    bits = BITS
    sketch = materialize(given.select("text").mapInArrow(functools.partial(_count, k, bits), "c int, n long")
                         .groupBy("c").agg(F.sum("n").alias("n")))           # <= 2 ** bits rows
    median = sketch.agg(F.percentile_approx("n", F.lit(0.5)).alias("m")).first()["m"] or 0
    spread = sketch.agg(F.percentile_approx(F.abs(F.col("n") - median), F.lit(0.5)).alias("m")).first()["m"] or 0
    top = sketch.filter(F.col("n") >= max(32, median + HEAVY * spread)).orderBy("c").collect()   # <= 2 ** bits rows
    heavy = spark.sparkContext.broadcast((np.array([r["c"] for r in top], dtype=np.int64),
                                          np.array([r["n"] for r in top], dtype=np.int64)))

    marked = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    sets = materialize(marked.mapInArrow(
        functools.partial(_prefixes, k, num, den, bits, heavy),
        f"row long, doc_id {id_type}, n int, sid binary, low long, tokens array<long>, heavy array<boolean>"))

    classes = (sets.filter("n > 0").groupBy("sid").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc"),
                                                        F.count(F.lit(1)).alias("copies"), F.min("low").alias("low"),
                                                        F.min("n").alias("n")))
    # blocks: sets with one minimum hash, dealt into chunks where there are many
    parts = (classes.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / block_sets).alias("parts")).filter("parts > 1")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = classes.withColumn("salt", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(SALTS)).cast("int"))
    classes = materialize(salted.join(parts, ["low", "salt"], "left").withColumn(
        "block", F.xxhash64("low", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))))).drop("low", "parts", "salt"))

    post = (sets.select("row", "tokens", "heavy").join(classes.select("row", "block", "n"), "row")
            .select("block", "n", F.posexplode(F.arrays_zip("tokens", "heavy")).alias("pos", "t"))
            .select(F.col("t.tokens").alias("token"), "block", F.col("n").cast("long").alias("n"),
                    F.col("pos").cast("long").alias("pos"), F.col("t.heavy").alias("heavy")))
    light = materialize(post.filter("not heavy").select("token", "block", "n", "pos").repartition("token")
                        .sortWithinPartitions("token").mapInArrow(
                            functools.partial(_listed, num, den), "token long, a long, b long, lists long, need long"))
    crowded = post.filter("heavy").select("token", "block", "n", "pos").unionByName(light.filter("b is null").select(
        "token", F.col("a").alias("block"), F.col("lists").alias("n"), F.col("need").alias("pos")))
    hot = materialize(crowded.groupBy("token", "block").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("pos").alias("pos"), F.max(F.col("n") - F.col("pos") - 1).alias("rest")))
    can, need = _can_columns(num, den)
    pairs = hot.alias("x").join(hot.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.block") < F.col("y.block")) & can) \
        .select(F.col("x.block").alias("a"), F.col("y.block").alias("b"), F.lit(1).cast("long").alias("lists"), need.alias("need"))
    cells = (light.filter("b is not null").drop("token").unionByName(pairs).groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.min("need").alias("need"))
             .filter("lists >= need").select("a", "b"))

    # the sets of the smaller block travel to the larger one's home; a home with many guests has parts
    counts = classes.groupBy("block").agg(F.count(F.lit(1)).alias("sets"))
    ca, cb = (counts.select(F.col("block").alias(n), F.col("sets").alias(f"n{n}")) for n in ("a", "b"))
    trips = materialize(cells.join(ca, "a").join(cb, "b").select(
        F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("home"),
        F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("guest"),
        F.least("na", "nb").alias("sets")))
    homes = trips.groupBy("home").agg(F.ceil(F.sum("sets") / PART_SETS).alias("parts"))
    homes = homes.unionByName(counts.filter("sets > 1").select(F.col("block").alias("home"), F.lit(1).cast("long").alias("parts"))) \
        .groupBy("home").agg(F.max("parts").alias("parts"))
    homes = materialize(homes)

    ends = homes.select(F.col("home").alias("block")).unionByName(trips.select(F.col("guest").alias("block"))).distinct()
    wanted = materialize(classes.join(ends, "block", "left_semi").select("sid", "row", "copies", "block"))
    asked = sets.join(wanted.select("row"), "row", "left_semi").select(F.col("doc_id").alias("__id")).distinct()
    texts = given.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    full = texts.select("text").mapInArrow(functools.partial(_full_sets, k), "sid binary, tokens binary")
    members = materialize(full.join(wanted, "sid").select("block", "row", "copies", "tokens").dropDuplicates(["row"]))
    at_home = members.join(homes.withColumnRenamed("home", "block"), "block").select(
        F.col("block").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("side"), "block", "row", "copies", "tokens")
    guests = (members.join(trips.select("home", F.col("guest").alias("block")), "block").join(homes, "home")
              .select("home", F.pmod(F.xxhash64("block"), F.col("parts")).alias("part"), F.lit(1).alias("side"),
                      "block", "row", "copies", "tokens"))
    dealt = at_home.unionByName(guests).repartition("home", "part") \
        .sortWithinPartitions("home", "part", "side", "block", "row")
    found = materialize(dealt.mapInArrow(functools.partial(_homes, num, den), "row long, links long, root long"))

    roots = components(found.select(F.col("row").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    group = classes.select("sid", "row", "doc", "copies").join(roots.withColumnRenamed("node", "row"), "row", "left") \
        .withColumn("root", F.coalesce("root", "row"))
    least = group.groupBy("root").agg(F.min("doc").alias("component"))
    answer = materialize(group.join(least, "root").join(counts, "row", "left").select(
        "sid", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(answer, "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """A filtering stage: of each component the row with the smallest id stays (every row
    with a null id that links with no other id too); columns as they were."""
    linked = link_documents(docs, **options).filter(F.col("doc_id") != F.col("component_id")) \
        .select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(linked, F.col("doc_id") == F.col("__gone"), "left_anti")
