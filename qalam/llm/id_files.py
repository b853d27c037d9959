"""Token ids as compressed binary files (operator 8).

Documents are tokenised, ended by an end id, sorted by document id over range
partitions (the shards) and written as frames: whole documents of about
``FRAME`` ids, cut into blocks that ``id_coder`` codes independently.  A frame
is one row of a Parquet file: ``shard, frame, doc_ids, n_tokens`` and the
``payload`` (its blocks one after the other, each with id count, word count and
CRC-32).  Parquet gives committed, retryable writes on any shared storage.

Reading decodes blocks, checks their checksums and cuts the documents out.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.llm.bpe_prefix import PIECES, byte_letters, default_path
from qalam.llm.common import buckets_for, running_offsets
from qalam.llm.id_coder import BLOCK, HEADER, decode_blocks, encode_blocks

FRAME = 1 << 17            # ids in a frame, about
LANES = 4096               # blocks coded in step
DOCS_PER_SHARD = 6144
#: The blocks' plain ids have 16 bits; a larger vocabulary takes more.
ID_BITS = 16
TEXTS = 32 << 20           # bytes of text whose words are encoded together, about
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array of texts that holds any, and the places between them."""
    raw = texts.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def _after_word(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place (1 or more) is surely no white space.

    Characters that share their first bytes with white space (U+0080, U+1680, U+2000
    and U+3000, 64 or 128 from each) count as white space."""
    last = data[ends - 1]
    sure = ~_SPACE[last]
    wide = np.flatnonzero(last >= 0x80)
    two, three = data[ends[wide] - 2], data[ends[wide] - 3]
    sure[wide] = ~((two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
                   | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))))
    return sure


class LibraryEncoder:
    """Ids as the tokenizers library gives them.

    tiktoken encodes ordinary text faster by the same merges when the file's ids
    are in merge order.  Its character classes may differ from the library's, so
    every non-ASCII character is tried once in both; texts with one that
    differs, or with an added token's string, go to the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.specials = [a["content"] for a in spec.get("added_tokens", [])]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        self.fast, self.alike, self.other = None, set(), set()
        if merged == sorted(merged) and spec["pre_tokenizer"] == {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} \
                and not spec["normalizer"]:
            import tiktoken
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.specials}
            self.fast = tiktoken.Encoding("ids", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)     # bytes of each id
            self.lengths[list(ranks.values())] = list(map(len, ranks))

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def quick(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def try_characters(self, text: str) -> None:
        if not text.isascii():
            for c in set(text) - self.alike - self.other:
                probe = f"a{c}1!{c} {c}{c}"
                (self.alike if np.array_equal(self.quick(probe), self.slow(probe)) else self.other).add(c)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.specials):
            return self.slow(text)
        self.try_characters(text)
        if self.other and not self.other.isdisjoint(text):
            return self.slow(text)
        return self.quick(text)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and the number of ids of each.

        Words that start with white space and end without need no space of their
        own to stay apart, so they are encoded as one text."""
        data, ends = _parts(words)
        apart = _SPACE[data[ends[:-1]]] & _after_word(data, ends[1:])
        counts, ids = np.zeros(len(words), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        if apart.any():
            joined, stops = _parts(words.filter(pa.array(apart)))
            ids = self.quick(joined.tobytes().decode("utf-8"))
            at = np.cumsum(self.lengths[ids])
            until = np.searchsorted(at, stops[1:])
            if not np.array_equal(at[until], stops[1:]):
                raise ValueError("an id over the end of a word")
            counts[apart] = np.diff(until + 1, prepend=0)
        single = np.flatnonzero(~apart)
        alone = [self.quick(w.decode("utf-8")) for w in words.take(pa.array(single)).to_pylist()]
        counts[single] = list(map(len, alone))
        out = np.empty(counts.sum(), dtype=np.uint32)
        mine = np.repeat(apart, counts)
        out[mine], out[~mine] = ids, np.concatenate([*alone, np.zeros(0, np.uint32)])
        return out, counts

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, as by a call for each; none may be null, and
        together they must be less than 2 GiB.

        No piece of the pattern goes on from a character that is no white space
        into white space, and none looks back, so a text may be cut there: each
        distinct word between these places is encoded once."""
        if self.fast is None or not len(texts):
            return [self.slow(t) for t in texts.to_pylist()]
        data, bounds = _parts(texts)
        if not len(data):
            return [np.zeros(0, dtype=np.uint32)] * len(texts)
        if len(texts) == 1 and len(data) > TEXTS:           # its words would take several times its room
            return [self(texts[0].as_py())]
        space = _SPACE[data]
        places = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[places[_after_word(data, places)]] = True
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        del space, places, cut
        coded = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [
            None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        word = np.asarray(coded.indices)
        ids, counts = self.words(coded.dictionary)
        ends = np.append(0, np.cumsum(counts[word]))
        # the place of every id among the words' ids: one after the last, or a jump to the next word's first
        after = np.cumsum(counts)
        steps = np.ones(ends[-1], dtype=np.int32)
        steps[ends[:-1]] = (after - counts)[word]
        steps[ends[1:-1]] -= (after - 1)[word[:-1]]
        flat = ids.take(np.cumsum(steps, out=steps))
        at = ends[np.searchsorted(starts, bounds)]
        out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        whole, characters = data.tobytes(), _parts(coded.dictionary)[0].tobytes().decode("utf-8")
        self.try_characters(characters)
        if any(s.encode() in whole for s in self.specials) or not self.other.isdisjoint(characters):
            for i, text in enumerate(texts.to_pylist()):
                if any(s in text for s in self.specials) or not self.other.isdisjoint(text):
                    out[i] = self.slow(text)
        return out


_OPEN: dict[str, LibraryEncoder] = {}


def _tokenised(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document ids with their token ids, the end id last."""
    if path not in _OPEN:
        _OPEN[path] = LibraryEncoder(path)
    encode = _OPEN[path]
    for batch in batches:
        size, at = np.cumsum(np.asarray(pc.binary_length(batch.column(1))), dtype=np.int64), 0
        while at < batch.num_rows:
            until = (size[at - 1] if at else 0) + TEXTS
            part = batch.slice(at, max(1, int(np.searchsorted(size, until, side="right")) - at))
            at += part.num_rows
            for doc, text in zip(part.column(0).to_pylist(), encode.encode_all(part.column(1))):
                ids = np.append(text, np.uint32(end_id))
                if int(ids.max()) >> ID_BITS:
                    raise ValueError(f"ids of more than {ID_BITS} bits")
                yield doc, ids.astype(np.uint16)


def _frames(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of one shard: tokenises and gathers documents, codes ``LANES`` blocks at a time."""
    from pyspark import TaskContext
    shard, frame = TaskContext.get().partitionId(), 0
    held: list[tuple[list, list]] = [([], [])]       # per frame: document ids, id arrays
    size = blocks = 0

    def coded() -> Iterator[pa.RecordBatch]:
        nonlocal frame, held, size, blocks
        full = [h for h in held if h[0]]
        if full:
            ids = [np.concatenate(h[1]) for h in full]
            base = np.cumsum([0, *map(len, ids)])
            starts = [np.arange(0, len(x), BLOCK) for x in ids]
            sizes = [np.minimum(BLOCK, len(x) - s) for x, s in zip(ids, starts)]
            out = encode_blocks(np.concatenate(ids), np.concatenate([s + b for s, b in zip(starts, base)]),
                                np.concatenate(sizes), ID_BITS)
            ends = np.cumsum([len(s) for s in starts])
            rows = [(shard, frame + i, h[0], [len(x) for x in h[1]], b"".join(out[e - len(s):e]))
                    for i, (h, s, e) in enumerate(zip(full, starts, ends))]
            frame += len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows), (
                    pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()))],
                names=["shard", "frame", "doc_ids", "n_tokens", "payload"])
        held, size, blocks = [([], [])], 0, 0

    for doc, ids in _tokenised(path, end_id, batches):
        held[-1][0].append(doc)
        held[-1][1].append(ids)
        size += len(ids)
        if size >= FRAME:
            blocks += -(-size // BLOCK)
            held.append(([], []))
            size = 0
            if blocks >= LANES - FRAME // BLOCK:
                yield from coded()
    yield from coded()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the frames: decodes ``LANES`` blocks at a time and checks them."""
    def cut(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        blocks: list[bytes] = []
        counts = []
        for r in rows:
            payload, at, before = r["payload"], 0, len(blocks)
            while at < len(payload):
                end = at + HEADER.itemsize + 2 * int(np.frombuffer(payload, HEADER, 1, at)["words"][0])
                blocks.append(payload[at:end])
                at = end
            counts.append(len(blocks) - before)
        ids, first = decode_blocks(blocks, ID_BITS), 0
        for r, n in zip(rows, counts):
            whole, lens = np.concatenate(ids[first:first + n]), np.array(r["n_tokens"], dtype=np.int64)
            first += n
            ends = np.cumsum(lens)
            if ends[-1] != len(whole):
                raise ValueError("a frame's documents do not fill its blocks")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]] * len(lens), pa.int32()), pa.array([r["frame"]] * len(lens), pa.int32()),
                 pa.array(r["doc_ids"], pa.int64()), pa.array(ends - lens), pa.array(lens),
                 pa.array([whole[e - c:e].tobytes() for e, c in zip(ends, lens)], pa.binary())],
                names=["shard", "frame", "doc_id", "at", "n_tokens", "ids"])

    rows, blocks = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            rows.append({n: batch.column(n)[i].as_py() for n in batch.schema.names})
            blocks += -(-sum(rows[-1]["n_tokens"]) // BLOCK)
            if blocks >= LANES:
                yield from cut(rows)
                rows, blocks = [], 0
    if rows:
        yield from cut(rows)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text") -> None:
    """Tokenise ``docs`` and write the id files into ``folder`` (shared storage).

    Every row gives one document, ended by ``end_id``; a null text is empty and
    holds the end id only.  Documents stand in ascending id order, null ids
    first, repeated ids in the order of their texts.  An empty table writes
    no frames.  Other columns are ignored."""
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = buckets_for(docs.count(), DOCS_PER_SHARD)
    # sorted before tokenising: Spark runs the plan below a range partitioning twice, once to sample it
    (rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
     .mapInArrow(functools.partial(_frames, path, end_id),
                 "shard int, frame int, doc_ids array<long>, n_tokens array<int>, payload binary")
     .write.option("compression", "none").parquet(folder))


def read_ids(spark: SparkSession, folder: str, **keep: Column) -> DataFrame:
    """Documents of id files: ``doc_id, start`` (ids of all documents before it),
    ``n_tokens`` (with the end id) and ``ids`` (little-endian unsigned 32-bit).
    ``keep`` names columns made of ``ids`` to return instead, computed before the
    starts are joined."""
    keep = keep or {"ids": F.col("ids")}
    frames = spark.read.schema("shard int, frame int, doc_ids array<long>, n_tokens array<int>, payload binary") \
        .parquet(folder)
    sizes = frames.select("shard", "frame", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
                          .alias("ids"))
    shards = running_offsets(sizes.groupBy("shard").agg(F.sum("ids").alias("ids")), [], "shard", "ids", "shard_start")
    starts = running_offsets(sizes, ["shard"], "frame", "ids", "frame_start").drop("ids") \
        .join(shards.drop("ids"), "shard")
    docs = frames.mapInArrow(_documents, "shard int, frame int, doc_id long, at long, n_tokens long, ids binary")
    docs = docs.select("shard", "frame", "doc_id", "at", "n_tokens", *[c.alias(n) for n, c in keep.items()])
    return (docs.join(starts, ["shard", "frame"])
            .select("doc_id", (F.col("shard_start") + F.col("frame_start") + F.col("at")).alias("start"),
                    "n_tokens", *keep))
