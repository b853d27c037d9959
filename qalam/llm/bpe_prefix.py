"""BPE encoding and decoding by dynamic programming over prefixes (operator 7).

For a text piece the merge procedure gives every prefix exactly one last token.
An automaton over the vocabulary lists the tokens that end at each position
(the suffix matches); the last token of a prefix is the one that is compatible
with the last token of what stands before it.  Two neighbours are compatible
when no merge would have crossed their seam: a crossing merge joins a node of
the left token's right spine with a node of the right token's left spine, at a
time when both exist.  Following the stored last tokens backwards gives the ids.

Pieces repeat, so each worker keeps a bounded memory of encoded pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text into pieces for this vocabulary family.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY = 150_000     # encoded pieces a worker remembers, in two halves; the older one goes when both are full


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself,
    the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memory(dict):
    def __init__(self, encode, room: int):
        super().__init__()
        self.encode, self.room, self.older = encode, max(1, room // 2), {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.room:                     # pieces used again come over from the older half
            self.older = dict(self)
            self.clear()
        out = self.older.get(piece)
        if out is None:
            out = self.encode(piece)
        self[piece] = out
        return out


class PrefixBpe:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str, memory: int = MEMORY):
        import ahocorasick
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" \
                or not spec["pre_tokenizer"].get("use_regex") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without a normaliser are read")
        letters, model = byte_letters(), spec["model"]
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.token = {i: raw[t] for t, i in model["vocab"].items()}
        self.specials = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        for a in spec.get("added_tokens", []):
            if a["single_word"] or a["lstrip"] or a["rstrip"]:
                raise ValueError(f"added token {a['content']!r}: options are not supported")
            self.token[a["id"]] = a["content"].encode()
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (model["vocab"][a], model["vocab"][b]), model["vocab"][a + b]
            if made in parts:
                raise ValueError("a token with two merges")
            self.rank[pair], parts[made] = r, pair
        never = len(model["merges"]) + 1
        self.right, self.left = {}, {}
        for t in model["vocab"].values():
            for spine, side in ((self.right, 1), (self.left, 0)):
                out, node, until = [], t, never
                while True:
                    out.append((node, until))
                    if node not in parts:
                        break
                    until, node = self.rank[parts[node]], parts[node][side]
                spine[t] = out
        self._fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.single = {self.token[t].decode("latin-1"): t for t in model["vocab"].values()
                       if t not in parts or self._reached(*parts[t])}
        for piece, t in self.single.items():
            self.automaton.add_word(piece, (len(piece), t))
        self.automaton.make_automaton()
        self.packed = {t: t.to_bytes(4, "little") for t in self.token}
        self.tokens = pa.array([self.token.get(i) for i in range(max(self.token) + 1)], pa.large_binary())
        self.pattern = regex.compile(PIECES)
        self.path, self.alike, self.other = path, set(), set()
        self._letters, self._library = letters, None
        order = sorted(self.specials, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, order)) + ")") if order else None
        self.memory = _Memory(self._piece, memory)

    def _reached(self, a: int, b: int) -> bool:
        """Whether merging really makes the token of (a, b): nothing crosses the seam earlier."""
        goal = self.rank[(a, b)]
        return not any((r := self.rank.get((x, y))) is not None and r < goal and r < ux and r <= uy
                       for x, ux in self.right[a] for y, uy in self.left[b])

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart: no merge crosses their seam.  A crossing merge
        must come before the left node is used up (merges run left to right, so at the
        same rank the left side goes first) and not after the right node is."""
        key = (a, b)
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) > 250_000:
                self._fits.clear()
            rank = self.rank
            got = self._fits[key] = not any(
                (r := rank.get((x, y))) is not None and r < ux and r <= uy
                for x, ux in self.right[a] for y, uy in self.left[b])
        return got

    def _piece(self, piece: str) -> bytes:
        text = piece.encode("utf-8").decode("latin-1")
        whole = self.single.get(text)
        if whole is not None:
            return self.packed[whole]
        last, size, known = [-1] * (len(text) + 1), [0] * (len(text) + 1), self._fits.get
        for end, (n, t) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if n != end:
                before = last[end - n]
                if before < 0:
                    continue
                ok = known((before, t))
                if not (self.fits(before, t) if ok is None else ok):
                    continue
            last[end], size[end] = t, n
        ids, at, packed = [], len(text), self.packed
        while at:
            ids.append(packed[last[at]])
            at -= size[at]
        ids.reverse()
        return b"".join(ids)

    def _cut(self, text: str) -> list[str]:
        """Pieces by the tokenizers library itself."""
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [bytes(self._letters[c] for c in p).decode("utf-8") for p, _ in self._library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The pattern's pieces.  Its character classes follow a Unicode version, so each
        character is tried once in both libraries; a text with one that they class
        differently is cut by the tokenizers library."""
        if not text.isascii():
            for c in set(text) - self.alike - self.other:
                probe = f"a{c}1!{c} "
                (self.alike if self.pattern.findall(probe) == self._cut(probe) else self.other).add(c)
            if self.other and not self.other.isdisjoint(text):
                return self._cut(text)
        return self.pattern.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        find, memory = self.pieces, self.memory
        if self.cut is None or not any(s in text for s in self.specials):
            return b"".join([memory[p] for p in find(text)])
        out = []
        for part in self.cut.split(text):
            special = self.specials.get(part)
            out.append(special.to_bytes(4, "little") if special is not None
                       else b"".join([memory[p] for p in find(part)]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")

    def encode_all(self, texts: pa.Array) -> pa.Array:
        return pa.array([self.encode(x) for x in texts.to_pylist()], pa.binary())

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """``decode`` of many rows: their tokens are taken and joined by Arrow."""
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(ids)).astype(np.int64) // 4)])
        flat = np.frombuffer(b"".join(ids.to_pylist()), dtype="<u4")
        taken = self.tokens.take(pa.array(flat))
        if taken.null_count:
            raise KeyError("an id without a token")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken), pa.scalar(b"", pa.large_binary()))
        try:
            return texts.cast(pa.string())             # valid UTF-8, most often
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


_OPEN: dict[str, PrefixBpe] = {}


def encoder(path: str) -> PrefixBpe:
    """The worker's encoder of a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = PrefixBpe(path)
    return _OPEN[path]


def _mapped(path: str, method: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = getattr(encoder(path), method)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = work(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], names=[*part.schema.names[:-1], "out"])
    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids`` (``ids`` binary: little-endian
    unsigned 32-bit).  A null text counts as empty and has no ids; ids of added tokens
    stand where their strings occur.  Null ids, repeated rows and empty tables pass
    through; other columns are ignored."""
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_mapped(path, "encode_all"), f"doc_id {id_type}, out binary")
    return out.select("doc_id", (F.octet_length("out") / 4).cast("long").alias("n_tokens"), F.col("out").alias("ids"))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``text``, the decoded ids, to rows of ``doc_id, n_tokens, ids``; ids that
    are not UTF-8 together decode with replacement characters."""
    path = path or default_path()
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    pairs = encoded.select("doc_id", "n_tokens", "ids", F.col("ids").alias("copy"))
    out = pairs.mapInArrow(_mapped(path, "decode_all"),
                           f"doc_id {id_type}, n_tokens long, ids binary, out string")
    return out.withColumnRenamed("out", "text")
