"""Encoding words by merge rank (M3), all words of a slice of texts at once.

Words are arrays of symbol numbers.  A round finds the lowest rank among each word's
neighbours and merges that pair everywhere in the word, left to right; words without
a pair of the merges are done.  A word takes as many rounds as it has different merges,
so long ones go to ``WordEncoder``, whose heap takes n log n steps.  So do the few for which the order of the
two could differ: a pair that comes up again, whose merge can make a pair of a lower rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from qalam.operators.bpe_learn import joined, merge_symbols
from qalam.operators.pack import UNK

WORD_BYTES = 64 << 20    # encoded words that WordEncoder remembers, about; it starts over when full
SLICE_BYTES = 2 << 20    # bytes of text that a worker cuts into words at a time: its arrays take some forty times as much
LONG = 64                # characters from which a word is merged by the heap
MOST_CELLS = 1 << 22     # pairs of symbols up to which ranks are a table


def offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flat values, and their end; a null list is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return np.concatenate([[0], np.cumsum(sizes)])


def sliced(batches: Iterator[pa.RecordBatch], text: int, most: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows with about ``most`` bytes of text at a time, a larger text alone."""
    most = most or SLICE_BYTES
    for batch in batches:
        at = text if text >= 0 else batch.num_columns + text
        part = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def cut_words(texts: pa.Array, others: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and where each text's begin: what stands between spaces, or the words given for a text."""
    at = np.arange(len(texts), dtype=np.int32)
    given = others.null_count < len(others)
    if given:                                                # no if_else: it is wrong on slices of strings
        at = np.flatnonzero(np.asarray(others.is_null())).astype(np.int32)
        texts = texts.take(pa.array(at))
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    row = np.repeat(at, np.diff(offsets(lists)))
    real = pc.not_equal(words, "")
    words, row = words.filter(real), row[np.asarray(real)]
    if given:
        more = np.repeat(np.arange(len(others), dtype=np.int32), np.diff(offsets(others)))
        words, row = pa.concat_arrays([words, others.flatten().cast(words.type)]), np.concatenate([row, more])
        order = np.argsort(row, kind="stable")
        words, row = words.take(pa.array(order)), row[order]
    return words, np.searchsorted(row, np.arange(len(others) + 1))


def code_points(texts: pa.Array) -> np.ndarray:
    """The characters of all texts in a row; a null has none."""
    texts = texts.drop_null()
    joint = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")
    return np.frombuffer(joint[0].as_py().encode("utf-32-le"), dtype=np.uint32)


#: Whether a character up to U+3000 is white space, as the pattern of the words has it; the last stands for all above.
_SPACES = np.zeros(0x3002, dtype=bool)
_SPACES[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def spans(texts: pa.Array, words: pa.Array, ends: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(characters of all texts, where each piece begins in them, where its text does)``.

    The words are the texts without white space, so the pieces' characters are those that are none, in order."""
    chars = code_points(texts)
    solid = np.flatnonzero(~_SPACES[np.minimum(chars, 0x3001)])
    sizes = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    before = np.concatenate([[0], np.cumsum(lengths)])
    if not np.array_equal(np.searchsorted(solid, begin), before[rows]):
        raise ValueError("words are not the texts without white space")
    return chars, solid[before[:-1]] if len(lengths) else before[:0], np.repeat(begin[:-1], np.diff(rows))


class WordEncoder(dict):
    """Ids of words, remembered up to about ``room`` bytes."""

    def __init__(self, ranks: dict[tuple[str, str], int], vocab: dict[str, int], prefix: str, room: int = WORD_BYTES):
        super().__init__()
        self.ranks, self.vocab, self.prefix, self.room, self.held = ranks, vocab, prefix, room, 0

    def rank(self, left: str, right: str, now: int) -> int | None:
        return self.ranks.get((left, right))

    def pieces(self, word: str) -> list[str]:
        return merge_symbols([c if i == 0 else self.prefix + c for i, c in enumerate(word)], self.rank, self.prefix)

    def __missing__(self, word: str) -> list[int]:
        ids = [self.vocab.get(s, UNK) for s in self.pieces(word)]
        size = 200 + 2 * len(word) + 8 * len(ids)
        if self.held + size > self.room:
            self.clear()
            self.held = 0
        if size <= self.room:
            self.held += size
            self[word] = ids
        return ids


class ArrayEncoder:
    """Ids of words, and how many characters each stands for."""

    def __init__(self, ranks: dict[tuple[str, str], int], vocab: dict[str, int], prefix: str):
        self.coder = WordEncoder(ranks, vocab, prefix, 0)
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        made = [joined(*pair, prefix) for pair, _ in by_rank]
        # number 0 is every symbol that neither the merges nor the vocabulary have
        names = ["", *dict.fromkeys([*(s for pair, _ in by_rank for s in pair), *made, *vocab])]
        number = {s: i for i, s in enumerate(names) if i}
        self.ids = np.array([UNK, *(vocab.get(s, UNK) for s in names[1:])], dtype=np.int32)
        self.first, self.later = np.zeros(0x110000, dtype=np.int32), np.zeros(0x110000, dtype=np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.first[ord(s)] = i
            if len(s) == len(prefix) + 1 and s.startswith(prefix):
                self.later[ord(s[-1])] = i
        self.width, self.none = len(names), len(by_rank)
        pairs = np.array([number[a] * self.width + number[b] for (a, b), _ in by_rank], dtype=np.int64)
        self.made = np.array([number[m] for m in made], dtype=np.int32)
        # the lowest rank of a pair that holds a symbol
        lowest = np.full(self.width, self.none, dtype=np.int64)
        for k, ((a, b), _) in reversed(list(enumerate(by_rank))):
            lowest[number[a]] = lowest[number[b]] = k
        self.early = np.append(lowest[self.made] < np.arange(self.none), False)
        if self.width ** 2 <= MOST_CELLS:
            self.table = np.full(self.width ** 2, self.none, dtype=np.int32)
            self.table[pairs] = np.arange(self.none)
        else:
            self.table, self.order = None, np.argsort(pairs)
            self.pairs = np.append(pairs[self.order], -1)

    def rank(self, pair: np.ndarray) -> np.ndarray:
        """Places of pairs among the merges; ``none`` where there is no merge."""
        if self.table is not None:
            return self.table[pair]
        at = np.searchsorted(self.pairs[:-1], pair)
        return np.where(self.pairs[at] == pair, np.append(self.order, 0)[at], self.none).astype(np.int32)

    def of_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of all words in order, and how many each word has; every distinct word is encoded once."""
        known = words.dictionary_encode()
        ids, lengths, sizes = self.encode(known.dictionary)
        at = np.asarray(known.indices).astype(np.int64)
        begin, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(n)
        take = np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return ids[take], lengths[take], n

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.asarray(pc.utf8_length(words)).astype(np.int64)
        chars = code_points(words)
        begin = np.cumsum(n) - n
        sym = self.later[chars]
        sym[begin[n > 0]] = self.first[chars[begin[n > 0]]]
        word = np.repeat(np.arange(len(n)), n)
        length = np.ones(len(sym), dtype=np.int64)
        alone = n >= LONG                                     # words for the heap
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if alone.any():
            stay = ~alone[word]
            sym, word, length = sym[stay], word[stay], length[stay]
        while len(sym):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            rank = np.full(len(sym), self.none, dtype=np.int32)
            rank[:-1] = self.rank(sym[:-1].astype(np.int64) * self.width + sym[1:])
            rank[start[1:] - 1] = self.none
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(sym)))
            mine = np.repeat(best, size)
            over = mine == self.none
            if over.any():
                done.append((sym[over], word[over], length[over]))
                sym, word, length, rank, mine = (x[~over] for x in (sym, word, length, rank, mine))
            at = np.flatnonzero(rank == mine)
            if not len(at):
                continue
            if (odd := self.early[mine[at]]).any():           # the heap would take a new pair before the next of these
                seen, times = np.unique(word[at[odd]], return_counts=True)
                if len(seen := seen[times > 1]):
                    alone[seen] = True
                    stay = ~alone[word]
                    sym, word, length = sym[stay], word[stay], length[stay]
                    continue
            chain = np.cumsum(np.diff(at, prepend=at[0]) != 1)    # of neighbouring matches every second one
            at = at[(np.arange(len(at)) - np.searchsorted(chain, chain)) % 2 == 0]
            sym[at] = self.made[mine[at]]
            length[at] += length[at + 1]
            stays = np.ones(len(sym), dtype=bool)
            stays[at + 1] = False
            sym, word, length = sym[stays], word[stays], length[stays]
        slow = np.flatnonzero(alone)
        for w, text in zip(slow.tolist(), words.take(pa.array(slow)).to_pylist()):
            got = self.coder.pieces(text)
            cut = len(self.coder.prefix)
            done.append((np.array([self.coder.vocab.get(s, UNK) for s in got], dtype=np.int32), np.full(len(got), w),
                         np.array([len(s) - (cut if i else 0) for i, s in enumerate(got)])))
        every = np.concatenate([w for _, w, _ in done]) if done else np.zeros(0, dtype=np.int64)
        sizes = np.bincount(every, minlength=len(n)).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        ids, lengths = np.empty(int(sizes.sum()), dtype=np.int32), np.empty(int(sizes.sum()), dtype=np.int64)
        last = len(done) - len(slow)
        for k, (s, w, l) in enumerate(done):                  # a word's symbols are all in one part
            start = np.flatnonzero(np.diff(w, prepend=-1))
            place = begin[w] + np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
            ids[place], lengths[place] = (s if k >= last else self.ids[s]), l
        return ids, lengths, sizes
