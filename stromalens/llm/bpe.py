"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is what the merges give exactly if every neighbouring pair is: a pair
fits if no merge across its border would have come before the merges that built its two
sides. So the encoder needs no merge loop. It takes the longest token at each place, found
for all places by one Aho-Corasick pass, falls back to the next shorter token where a pair
does not fit, and steps back from places that nothing can follow; each place is given up at
most once, so time is linear in the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memo, binaries, byte_letters, lists, slices

#: Fixed value: how byte-level vocabularies cut text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space other than single blanks and line ends, or the mark used in cutting.
_RUNS = re.compile(rb"[ \n]{2}|[\x01\t\x0b-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Scripts whose letters every Unicode version knows alike; others are cut by the library.
_SETTLED = re.compile("[\x00-ԯ]*")
#: Entries of a worker's pair table and of each generation of its memo of words.
PAIRS_KEPT, CHUNKS_KEPT = 200_000, 200_000
ENCODED_SCHEMA = "doc_id long, n_tokens long, ids array<int>"


class BytePairCoder:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        model = spec["model"]
        if spec["normalizer"] or spec.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level vocabulary is needed")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.byte_of = byte_of
        as_bytes = lambda name: bytes(byte_of[c] for c in name)
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t, a, b = vocab[a + b], vocab[a], vocab[b]
            self.merge.setdefault((a, b), r)
            if self.left[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        # offset table of the decoder: one blob, and where each token's bytes start
        content = [b""] * size
        for name, t in vocab.items():
            content[t] = as_bytes(name)
        own = dict(enumerate(content))
        for name, t in self.special.items():
            content[t] = name.encode()
        self.blob = np.frombuffer(b"".join(content), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(c) for c in content])]).astype(np.int64)
        # tokens that the merges can produce at all, longest match first
        self.id_of = {c: t for t, c in own.items() if c and (self.left[t] < 0 and len(c) == 1 or self.left[t] >= 0 and self._fits(self.left[t], self.right[t], self.rank[t]))}
        self.size = [len(own[t]) for t in range(size)]
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for c, t in self.id_of.items():
            self.automaton.add_word(c[::-1].decode("latin-1"), t)
            self.shorter[t] = next((self.id_of[c[:k]] for k in range(len(c) - 1, 0, -1) if c[:k] in self.id_of), -1)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.memo = Memo(lambda chunks: [self._chunk(c) for c in chunks], CHUNKS_KEPT)
        self.cut_special = re.compile(b"(" + b"|".join(re.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self._library, self._path = None, path

    def _fits(self, a: int, b: int, bound: float = float("inf")) -> bool:
        """Whether no merge below ``bound`` crosses the border of ``a`` and ``b``.

        The sides are taken apart from the last merge on. A crossing merge beats a later merge
        of the left side, and one of the right side also at equal rank, as the leftmost goes first.
        """
        rank, merge = self.rank, self.merge
        while True:
            crossing = merge.get((a, b))
            if crossing is not None and crossing < bound:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                bound, a = rank[a], self.right[a]
            else:
                bound, b = rank[b] + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        """``_fits`` from the table of pairs met before."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of a piece that no merge leaves."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter = len(piece), self.size, self.shorter
        longest = [-1] * n
        for end, t in self.automaton.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0 or size[t] > size[longest[at]]:
                longest[at] = t
        out: list[int] = []
        dead = bytearray(n + 1)
        at, t = 0, longest[0]
        while True:
            end = at + size[t]
            if not dead[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                if end == n:
                    return out
                at, t = end, longest[end]
                continue
            t = shorter[t]
            while t < 0:
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                t = shorter[last]

    def _cut(self, text: str) -> list[bytes]:
        if _SETTLED.fullmatch(text):
            return [p.encode() for p in PIECES.findall(text)]
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [bytes(self.byte_of[c] for c in p) for p, _ in self._library.pre_tokenize_str(text)]

    def _chunk(self, chunk: bytes) -> bytes:
        out: list[int] = []
        for p in self._cut(chunk.decode("utf-8", "replace")):
            ids = self.pieces.get(p)
            if ids is None:
                if len(self.pieces) >= PAIRS_KEPT // 2:
                    self.pieces.clear()
                ids = self.pieces[p] = self.encode_piece(p)
            out += ids
        return np.array(out, "<i4").tobytes()

    def _plain(self, text: bytes) -> bytes:
        if _RUNS.search(text):
            return self._chunk(text)
        # between single blanks and line ends nothing joins, so words can be remembered
        chunks = text.replace(b" ", b"\x01 ").replace(b"\n", b"\x01\n\x01").split(b"\x01")
        return self.memo.joined(chunks)

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian 32-bit numbers; special tokens' strings give their ids."""
        if self.cut_special is None or not any(x.encode() in text for x in self.special):
            return self._plain(text)
        parts = self.cut_special.split(text)
        return b"".join(np.array([self.special[p.decode()]], "<i4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of sequences laid end to end; ids outside the vocabulary give nothing."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.offsets[ids + 1] - self.offsets[ids], 0)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.blob[np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)].tolist()
        return [data[i:j].decode("utf-8", "replace") for i, j in zip(stops, stops[1:])]


_CODERS: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """The worker's coder of this file."""
    if path not in _CODERS:
        _CODERS[path] = BytePairCoder(path)
    return _CODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text, one row per row; a null text is empty.

    Other columns are not read. The ids are those of the tokenizers library without added
    special tokens, truncation or padding.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [c.encode(t) for t in binaries(part, "text")]
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), lists(np.frombuffer(b"".join(ids), "<i4"), lengths, pa.int32())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, ENCODED_SCHEMA)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add the text of each row's ``ids``, special tokens included; null ids give an empty text."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = list(tokens.columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                col = part.column(part.schema.get_field_index("ids"))
                lengths = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
                texts = c.decode(np.asarray(col.flatten(), np.int64), lengths)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "text"])

    return tokens.mapInArrow(rows, StructType([*tokens.schema.fields, StructField("text", StringType())]))
