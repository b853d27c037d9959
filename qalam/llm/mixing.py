"""Mixing sources to target weights (operator 9).

A multivariate-hypergeometric splitting tree.  The documents of each source
are permuted by a seeded key and cut into blocks (ranges of the key).  The
target of a source says how often each of its blocks is used: whole passes
first, then the first blocks of the permutation up to the target, the rest of
the room filled document by document.  The tree then deals these block uses to output
shards: a node holds the block count of every source and draws the counts of
its left half without replacement, exactly, down to single shards.  Each shard
takes a disjoint run of every source's permuted blocks and shuffles locally.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalam.llm.common import buckets_for, count_words, key_bucket, materialize, running_offsets, source_key, spread_key

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
ROWS_PER_BLOCK = 256
BLOCKS_AT_ONCE = 4
#: One row per source reaches the driver; more sources than this are refused, never cut.
MOST_SOURCES = 100_000


def targets(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its size and
    its excess goes to the others by weight, until none is above."""
    cap = [float(most * s) for s in sizes]
    fixed: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, w = total - sum(cap[i] for i in fixed), sum(weights[i] for i in free)
        share = {i: left * weights[i] / w for i in free} if w else {}
        over = [i for i in free if share[i] > cap[i]]
        if not over:
            return [cap[i] if i in fixed else share[i] for i in range(len(sizes))]
        fixed.update(over)


def split_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """``[shard, source]`` block quotas: every source's count is dealt out in full,
    shards differ by one block at most in the number they get."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def node(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, whole = (lo + hi) // 2, int(have.sum())
        take = whole * (mid - lo) // (hi - lo)
        left = np.zeros_like(have)
        rest, need = whole, take
        for i, c in enumerate(have):     # conditional draws: one source after the other
            rest -= int(c)
            if need and c:
                left[i] = rng.hypergeometric(int(c), rest, need) if rest else min(int(c), need)
                need -= int(left[i])
        node(left, lo, mid)
        node(have - left, mid, hi)

    node(np.asarray(counts, dtype=np.int64), 0, shards)
    return out


def _fitting(rows: DataFrame, edges: list[tuple[str, int, int]]) -> DataFrame:
    """Documents that fill what whole blocks leave: ``src, row``.

    ``edges`` has for each source with room its name, the room and its first unused
    block.  Each round goes, for all such sources at once, to the next block that
    holds a document within the room, and takes documents of that block and a few
    after it while they fit, in permuted order; it ends when no unused document
    fits.  Last, one too many is nearer than one too few where the smallest unused
    document exceeds the room by less than the room."""
    spark, open_now = rows.sparkSession, edges
    used = spark.createDataFrame([], "src string, row long")
    while open_now:
        at = spark.createDataFrame(open_now, "src string, room long, edge long")
        near = rows.join(F.broadcast(at), "src").filter("block >= edge AND size > 0 AND size <= room")
        hops = [(r["src"], r["room"], r["edge"]) for r in
                near.groupBy("src", "room").agg(F.min("block").alias("edge")).collect()]     # <= MOST_SOURCES rows
        if not hops:
            break
        at = spark.createDataFrame(hops, "src string, room long, edge long")
        some = rows.join(F.broadcast(at), "src").filter(
            f"block >= edge AND block < edge + {BLOCKS_AT_ONCE} AND size > 0 AND size <= room")
        docs = F.array_sort(F.collect_list(F.struct("key", "row", "size")))
        start = F.struct(F.col("room"), F.array().cast("array<long>").alias("rows"))
        taken = some.groupBy("src", "room", "edge").agg(docs.alias("docs")).withColumn("took", F.aggregate(
            "docs", start, lambda a, d: F.when(d["size"] <= a["room"], F.struct(
                (a["room"] - d["size"]).alias("room"), F.concat(a["rows"], F.array(d["row"])).alias("rows"))).otherwise(a)))
        taken = materialize(taken.select("src", "took.*", (F.col("edge") + BLOCKS_AT_ONCE).alias("edge")))
        used = used.unionByName(taken.select("src", F.explode("rows").alias("row")))
        rooms = {r["src"]: (r["room"], r["edge"]) for r in taken.select("src", "room", "edge").collect()}
        open_now = [(s, *rooms[s]) for s, _, _ in hops if rooms[s][0] > 0]
    filled = used.join(rows.select("row", "size"), "row").groupBy("src").agg(F.sum("size").alias("filled"))
    left = spark.createDataFrame(edges, "src string, room long, edge long").join(filled, "src", "left") \
        .withColumn("room", F.col("room") - F.coalesce("filled", F.lit(0)))
    rest = rows.filter("size > 0").join(F.broadcast(left), "src").filter("block >= edge") \
        .join(used.select("row"), "row", "left_anti")
    least = rest.groupBy("src", "room").agg(F.min(F.struct("size", "key", "row")).alias("least"))
    return used.unionByName(least.filter("least.size - room < room").select("src", "least.row"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS, shards: int = 8, seed: int = 29,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        row_col: str | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(plan, uses)``.  ``plan`` has one row per input row: ``row`` (its number),
    ``doc_id, source, size, source_size, target, copies``.  ``uses`` has one row per
    use of a document: ``row, pass, shard, order`` (shuffled position key).

    ``size`` counts the words of the text (null: 0).  Sources are ordered by code
    point, null last, and weigh ``weights`` in turn.  A document without words
    is used once for each whole pass over its source.  A null id is an id like
    any other, spread by the text and the row; repeated rows are used independently.
    Texts of any length are counted whole.  Each source's used words end nearer to
    its target than its smallest unused document.  ``row_col`` names a column of
    unique row numbers; without it rows are numbered here.  An empty table gives
    empty results.  Other columns are ignored.
    """
    k = buckets_for(docs.count(), rows_per_block)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       text.alias("text"))
    rows = materialize(rows.select(
        "row", "doc_id", "source", source_key(F.col("source")).alias("src"), count_words(F.col("text")).alias("size"),
        spread_key(seed, F.col("doc_id"), F.col("text"), F.col("row")).alias("key"))
        .withColumn("block", key_bucket(F.col("key"), k)))

    blocks = rows.groupBy("src", "block").agg(F.sum("size").alias("words"))
    blocks = materialize(running_offsets(blocks, ["src"], "block", "words", "before"))
    table = (blocks.groupBy("src").agg(F.sum("words").alias("of"), F.count(F.lit(1)).alias("blocks"))
             .limit(MOST_SOURCES + 1).collect())
    if len(table) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    # code point order of the names (UTF-8 bytes), the null source last
    table.sort(key=lambda r: (r["src"][0] == "n", r["src"].encode("utf-8", "surrogatepass")))
    of = [int(r["of"]) for r in table]
    goal = targets(of, [weights[i % len(weights)] for i in range(len(of))], float(sum(of)), most)
    passes = [int(g // s) if s else 1 for g, s in zip(goal, of)]
    spark = docs.sparkSession
    plan_rows = [(r["src"], s, g, p, g - p * s if s else 0.0) for r, s, g, p in zip(table, of, goal, passes)]
    plan = spark.createDataFrame(plan_rows, "src string, source_size long, target double, passes int, room double")

    # whole blocks up to the room, then documents of the blocks after them
    dealt = materialize(blocks.join(F.broadcast(plan), "src")       # <= MOST_SOURCES rows
                        .withColumn("extra", ((F.col("room") > 0) & (F.col("before") + F.col("words") <= F.col("room"))).cast("int"))
                        .drop("before"))
    edges = dealt.groupBy("src").agg(F.min(F.when(F.col("extra") == 0, F.col("block"))).alias("edge"),
                                     F.floor(F.max("room") - F.sum(F.col("words") * F.col("extra"))).alias("room"))
    edges = [(r["src"], r["room"], r["edge"]) for r in edges.filter("edge IS NOT NULL AND room > 0").collect()]
    out = rows.join(dealt.drop("words", "room"), ["src", "block"]).withColumn("one", F.lit(0))
    if edges:
        one = _fitting(rows, edges).select("row", F.lit(1).alias("one"))
        out = out.drop("one").join(one, "row", "left").withColumn("one", F.coalesce("one", F.lit(0)))
    out = materialize(out.withColumn("copies", F.col("passes") + F.col("extra") + F.col("one")).select(
        "row", "doc_id", "source", "src", "block", "key", "size", "source_size", "target", "copies"))

    # block uses: (pass, block) in order; the tree deals their numbers to the shards
    used = out.filter("copies > 0").select("src", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"))
    used = used.groupBy("src", "pass", "block").agg(F.lit(1).alias("one")) \
        .withColumn("at", (F.col("pass") - 1) * F.lit(k) + F.col("block"))
    numbered = materialize(running_offsets(used, ["src"], "at", "one", "number"))
    counts = {r["src"]: r["n"] for r in numbered.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [r["src"] for r in table]
    quota = split_tree([int(counts.get(s, 0)) for s in names], shards, seed)
    ends = np.cumsum(quota, axis=0)
    spans = spark.createDataFrame([(s, [int(x) for x in ends[:, i]]) for i, s in enumerate(names)],
                                  "src string, ends array<long>")
    placed = (numbered.join(F.broadcast(spans), "src")
              .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("number"))))
              .select("src", "block", "pass", "shard"))
    uses = (out.filter("copies > 0").select("row", "src", "block", "key", "copies")
            .join(placed, ["src", "block"]).filter(F.col("pass") <= F.col("copies"))
            .select("row", "pass", "shard", F.md5(F.concat("key", F.lit(":"), F.col("pass").cast("string"))).alias("order")))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies"), uses


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as the mix uses it,
    with the columns of ``docs``; inside a partition ordered by shard, then by the
    shard's local shuffle (texts are shuffled once, by the join)."""
    names = docs.columns
    tagged = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
                                     F.monotonically_increasing_id().alias("row")))
    _, uses = mix(tagged.select("doc.*", F.col("row").alias("__row")), row_col="__row", **options)
    return tagged.join(uses, "row").sortWithinPartitions("shard", "order").select("doc.*")
