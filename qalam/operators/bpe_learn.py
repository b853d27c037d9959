"""Learning a subword vocabulary (M1): exactly one merge at a time, few passes over the words.

Merging one pair at a time needs the pair counts of all words before every
merge.  A Spark pass per merge would be 32,000 passes; here a pass serves many:

1. Spark counts the adjacent pairs of the distinct words.  Pairs above a floor
   are active.  No pair at or below the floor can be merged while a better one
   is left, as counts only fall; so until then merges happen inside the maximal
   runs of active pairs only.
2. Spark cuts every word into its runs and adds up the words' frequencies per
   distinct run.  Runs are short and repeat, and the floor is set so that at
   most ``most_runs`` of them are left (``HEAVY`` times as many while symbols are
   few).  That table, whatever the corpus, goes to the driver.
3. The driver merges inside the runs, pair counts kept by differences.  While
   symbols are few and a pair stands in many runs, all runs are one array and a
   merge is a few array steps (``Flat``); then an index from a pair to the runs
   that hold it and a heap of the best pairs take over.  A merge touches only
   the runs with its pair.  It stops at the floor.
4. Spark applies the merges to the words, in order, and the next pass begins.

A merge that makes a symbol which exists already can raise the counts of pairs
outside the runs, so it is the last of its pass unless the runs are whole words.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.operators.pack import SPECIALS
from qalam.plans.session import materialize

MOST_RUNS = 200_000      # distinct runs that reach the driver in a pass
MOST_PAIRS = 100_000     # active pairs in a pass
HEAVY = 10               # times as many runs while they are merged as one array
MOST_SYMBOLS = 1024      # symbols up to which they are
LIGHT = 4096             # places of a pair below which the index is faster, if there are
MANY = 1000              # merges left to pay for it


def joined(left: str, right: str, prefix: str) -> str:
    return left + (right[len(prefix):] if right.startswith(prefix) else right)


def merge_symbols(symbols: list[str], rank: Callable, prefix: str) -> list[str]:
    """Merge neighbours, lowest rank first and left to right, in n log n steps.

    ``rank(left, right, now)`` is the rank of a pair or None; ``now`` is the rank
    of the merge at work (-1 before the first)."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank(sym[i], sym[i + 1], -1)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, left, right = heapq.heappop(heap)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right:
            continue                                     # one of the two was merged meanwhile
        sym[i], sym[j] = joined(left, right, prefix), None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (x := rank(sym[i], sym[k], r)) is not None:
                heapq.heappush(heap, (x, i, sym[i], sym[k]))
        if (h := before[i]) >= 0 and (x := rank(sym[h], sym[i], r)) is not None:
            heapq.heappush(heap, (x, h, sym[h], sym[i]))
    return [s for s in sym if s is not None]


def replayed(merges: list[tuple[str, str]], first: int) -> Callable:
    """Ranks for ``merge_symbols`` that replay merges in the order in which they were learned: a
    pair that comes up after its turn waits for its next one, if it was learned again."""
    turns = defaultdict(list)
    for k, pair in enumerate(merges):
        turns[pair].append(first + k)

    def rank(left: str, right: str, now: int) -> int | None:
        return next((r for r in turns.get((left, right), ()) if r > now), None)
    return rank


class Flat:
    """Runs as one array of symbol numbers, each run in a slot of its own that ends with -1."""

    def __init__(self, runs: pa.Array, freq: np.ndarray):
        lists = pc.split_pattern(runs, " ")
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64) + 1
        flat = lists.flatten().dictionary_encode()
        self.names: list[str] = flat.dictionary.to_pylist()
        self.number = {s: i for i, s in enumerate(self.names)}
        self.freq, self.sizes = np.asarray(freq, dtype=np.int64), sizes
        self.start = np.cumsum(sizes) - sizes
        self.run = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.sym = np.full(int(sizes.sum()), -1, dtype=np.int32)
        inside = np.ones(len(self.sym), dtype=bool)
        inside[self.start + sizes - 1] = False
        self.sym[inside] = np.asarray(flat.indices)

    def pairs(self, sym: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Frequency of every pair ``left * width + right`` of neighbours."""
        at = np.flatnonzero((sym[:-1] >= 0) & (sym[1:] >= 0))
        pair, cells = sym[at].astype(np.int64) * self.width + sym[at + 1], self.width ** 2
        # weights are added as doubles: halves below 2**32 keep the sums exact
        low, high = freq[at] & 0xFFFFFFFF, freq[at] >> 32
        out = np.bincount(pair, low, cells).astype(np.int64)
        return out + (np.bincount(pair, high, cells).astype(np.int64) << 32) if high.any() else out

    def merge(self, a: int, b: int, made: int) -> tuple[int, np.ndarray]:
        """Merge a pair everywhere, left to right; the places and the change of all pairs' frequencies."""
        at = np.flatnonzero(self.sym == a)
        hit = np.unique(self.run[at[self.sym[at + 1] == b]])
        sizes = self.sizes[hit]
        ends = np.cumsum(sizes)
        first = np.repeat(ends - sizes, sizes)               # of the run, in the part of the array that changes
        place = np.arange(int(ends[-1]))
        home = np.repeat(self.start[hit], sizes)
        freq = np.repeat(self.freq[hit], sizes)
        idx = home + place - first
        old = self.sym[idx]
        done = np.flatnonzero((old[:-1] == a) & (old[1:] == b))
        if a == b and len(done):                              # of neighbouring matches every second one
            chain = np.cumsum(np.diff(done, prepend=done[0]) != 1)
            done = done[(np.arange(len(done)) - np.searchsorted(chain, chain)) % 2 == 0]
        new, stays = old.copy(), np.ones(len(old), dtype=bool)
        new[done] = made
        stays[done + 1] = False
        rank = np.cumsum(stays) - 1
        rank -= rank[first]                                   # a run's first symbol always stays
        self.sym[idx] = -1
        self.sym[home[stays] + rank[stays]] = new[stays]
        return len(done), self.pairs(self.sym[idx], freq) - self.pairs(old, freq)

    def lists(self) -> Iterator[tuple[list[str], int]]:
        names = self.names
        for at, size, n in zip(self.start.tolist(), self.sizes.tolist(), self.freq.tolist()):
            yield [names[x] for x in self.sym[at:at + size].tolist() if x >= 0], n

    def learn(self, floor: int, budget: int, existing: set[str], prefix: str, whole: bool,
              most_runs: int) -> Iterator[tuple[str, str, int]]:
        """The first merges of ``learn_runs``: while symbols are few, and runs or places many."""
        self.width = min(MOST_SYMBOLS, len(self.names) + max(budget, 0))
        count = self.pairs(self.sym, self.freq[self.run])
        while budget > 0 and len(self.names) < MOST_SYMBOLS and (best := int(count.max())) > floor:
            a, b = min((divmod(int(x), self.width) for x in np.flatnonzero(count == best)),
                       key=lambda p: (self.names[p[0]], self.names[p[1]]))
            left, right = self.names[a], self.names[b]
            made = joined(left, right, prefix)
            to = self.number.setdefault(made, len(self.names))
            if to == len(self.names):
                self.names.append(made)
            places, change = self.merge(a, b, to)
            count += change
            again = made in existing
            existing.add(made)
            budget -= 1
            yield left, right, best
            if again and not whole:
                self.over = True
                return
            if places < LIGHT and budget > MANY and len(self.freq) <= most_runs:
                return

    over = False         # whether the pass must end: a merge made a symbol that existed


def learn_runs(runs: Flat | Iterable[tuple[list[str], int]], floor: int, budget: int, existing: set[str], prefix: str,
               whole: bool, most_runs: int = MOST_RUNS) -> Iterator[tuple[str, str, int]]:
    """Merges ``(left, right, count)`` of runs ``(symbols, frequency)``, best first (ties: smallest
    left, then right), while their count is above ``floor``.

    With ``whole`` the runs are whole words; else a merge to an existing symbol is the last.
    New symbols are added to ``existing``.  With more than ``most_runs`` runs it ends when
    there are ``MOST_SYMBOLS`` symbols."""
    flat = runs
    if not isinstance(runs, Flat):
        runs = list(runs)
        flat = Flat(pa.array([" ".join(s) for s, _ in runs], pa.large_string()), np.array([n for _, n in runs], dtype=np.int64))
    if len(flat.freq) == 0:
        return
    for merge in flat.learn(floor, budget, existing, prefix, whole, most_runs) if len(flat.names) < MOST_SYMBOLS else ():
        budget -= 1
        yield merge
    if flat.over or budget <= 0 or len(flat.freq) > most_runs:
        return
    runs = flat.lists()
    words, freq = [], []
    count: dict[tuple[str, str], int] = defaultdict(int)
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for symbols, n in runs:
        for pair in zip(symbols, symbols[1:]):
            count[pair] += n
            where[pair].add(len(words))
        words.append(symbols)
        freq.append(n)
    heap = [(-c, pair) for pair, c in count.items()]
    heapq.heapify(heap)
    while heap and budget > 0:
        c, pair = heapq.heappop(heap)
        now = count.get(pair, 0)
        if now != -c:
            if now > floor:                              # fell meanwhile: back in its place
                heapq.heappush(heap, (-now, pair))
            continue
        if now <= floor:
            return
        left, right = pair
        made, changed = joined(left, right, prefix), set()
        for w in where.pop(pair):
            old, new, i = words[w], [], 0
            while i < len(old):
                if i + 1 < len(old) and old[i] == left and old[i + 1] == right:
                    new.append(made)
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            if len(new) == len(old):
                continue                                 # no longer there
            n = freq[w]
            for p in zip(old, old[1:]):
                count[p] -= n
                changed.add(p)
            for p in zip(new, new[1:]):
                count[p] += n
                changed.add(p)
                where[p].add(w)
            words[w] = new
        for p in changed:
            if count[p] > floor:
                heapq.heappush(heap, (-count[p], p))
            elif not count[p]:
                del count[p]
        again = made in existing
        existing.add(made)
        budget -= 1
        yield left, right, now
        if again and not whole:
            return


def pair_counts(words: DataFrame) -> DataFrame:
    """``(l, r, c)``: frequency of every adjacent pair of ``words(sym, freq)``, symbols joined by spaces."""
    s = F.split("sym", " ")
    n = F.size(s)
    z = F.arrays_zip(F.slice(s, 1, n - 1).alias("l"), F.slice(s, 2, n - 1).alias("r"))
    return (words.filter(n > 1).select(F.explode(z).alias("p"), "freq")
                 .groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r"))
                 .agg(F.sum("freq").cast("long").alias("c")))


def _cut(active: set[tuple[str, str]] | None):
    """Words into their maximal runs of active pairs (None: all are)."""
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, int] = defaultdict(int)
            for word, n in zip(pdf["sym"], pdf["freq"]):
                if active is None:
                    out[word] += n
                    continue
                symbols, start = word.split(" "), 0
                for i in range(1, len(symbols) + 1):
                    if i == len(symbols) or (symbols[i - 1], symbols[i]) not in active:
                        if i - start > 1:
                            out[" ".join(symbols[start:i])] += n
                        start = i
            yield pd.DataFrame({"run": list(out), "n": list(out.values())}).astype({"run": str, "n": "int64"})
    return runs


def _apply(merges: list[tuple[str, str]], prefix: str):
    rank, held = replayed(merges, 0), {s for pair in merges for s in pair}

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["sym"] = [" ".join(merge_symbols(s.split(" "), rank, prefix)) if not held.isdisjoint(s.split(" ")) else s
                          for s in pdf["sym"]]
            yield pdf
    return apply


def _table(runs: pa.Table) -> Flat:
    return Flat(runs.column(0).cast(pa.large_string()).combine_chunks(), runs.column(1).to_numpy())


def learn_merges(spark: SparkSession, words: DataFrame, alphabet: list[str], budget: int, min_frequency: int = 2,
                 prefix: str = "##", most_runs: int = MOST_RUNS, most_pairs: int = MOST_PAIRS):
    """``(merges, passes)`` from ``words(sym, freq)``: merges ``(left, right, merged, count)`` as learned
    one at a time, and how many each pass gave.

    The driver holds at most ``most_runs`` runs (``HEAVY`` times as many as one array, while there
    are few symbols) and ``most_pairs`` pairs; the merges go back to the tasks.  A pass that would have more runs takes a higher floor."""
    existing, merges, passes = set(SPECIALS) | set(alphabet), [], []
    words = materialize(words.select("sym", "freq"))
    distinct = words.count()
    while len(merges) < budget:
        room = most_runs * HEAVY if len(existing) < MOST_SYMBOLS // 2 else most_runs
        if distinct <= room:
            table = words.toArrow()
            got = list(learn_runs(_table(table), min_frequency - 1, budget - len(merges), existing, prefix, True, most_runs))
            if got:
                passes.append(len(got))
                merges += [(l, r, joined(l, r, prefix), c) for l, r, c in got]
            if not got or distinct <= most_runs or len(merges) >= budget:            # learned to the end
                break
            words = materialize(words.mapInPandas(_apply([m[:2] for m in got], prefix), "sym string, freq long"))
            continue
        words = words.persist()
        counted = pair_counts(words).filter(F.col("c") >= min_frequency).persist()
        top = [(r["l"], r["r"], r["c"]) for r in counted.orderBy(F.desc("c"), "l", "r").limit(most_pairs + 1).collect()]
        if not top:
            break
        take, runs = min(len(top), most_pairs), None
        while runs is None:
            most = budget - len(merges)
            # the floor is the count of the first pair left out
            floor = top[take][2] if take < len(top) else min_frequency - 1
            if not (active := {(l, r) for l, r, c in top[:take] if c > floor}):
                active, floor, most = {top[0][:2]}, top[0][2] - 1, 1     # many pairs tie at the top: the first alone
            cut = words.mapInPandas(_cut(active), "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))
            found = cut.limit(room + 1).toArrow()
            if found.num_rows <= room:
                runs = _table(found)
            elif len(active) == 1:
                raise ValueError(f"more than {room} runs of one pair")
            else:
                take = max(1, len(active) // 4)
        counted.unpersist()
        got = list(learn_runs(runs, floor, most, existing, prefix, False, most_runs))
        if not got:
            break
        passes.append(len(got))
        merges += [(l, r, joined(l, r, prefix), c) for l, r, c in got]
        if len(merges) >= budget:                            # no pass follows
            break
        done, words = words, materialize(words.mapInPandas(_apply([m[:2] for m in got], prefix), "sym string, freq long"))
        done.unpersist()
    words.unpersist()
    return merges, passes
