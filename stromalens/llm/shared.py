"""Helpers of the text operators: batch slicing, word splitting, token look-up."""

from __future__ import annotations

import contextlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker takes into lists at a time.
SLICE_BYTES = 2 << 20
#: Entries of a generation of a worker's memo of words.
MEMO_ENTRIES = 250_000


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``size`` bytes per piece (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def binaries(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
    return [x or b"" for x in col.to_pylist()]


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column over flat values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class Memo:
    """Values of words, kept in a worker in two generations of bounded size."""

    def __init__(self, compute: Callable[[list], list], entries: int = MEMO_ENTRIES):
        """``compute`` gives the values of several words at once."""
        self.compute, self.entries = compute, entries
        self.young: dict = {}
        self.old: dict = {}

    def values(self, words: list) -> list:
        got = list(map(self.young.get, words))
        missing = [w for w, v in zip(words, got) if v is None]
        if missing:
            self._learn(missing)
            got = list(map(self.young.__getitem__, words))
            self._age()
        return got

    def joined(self, words: list) -> bytes:
        """The values of all words, which are bytes, one after the other."""
        with contextlib.suppress(KeyError):
            return b"".join(map(self.young.__getitem__, words))
        self._learn(words)
        out = b"".join(map(self.young.__getitem__, words))
        self._age()
        return out

    def _learn(self, words: list) -> None:
        young, old = self.young, self.old
        missing = [w for w in set(words) if w not in young]
        young.update([(w, old[w]) for w in missing if w in old])
        new = [w for w in missing if w not in young]
        young.update(zip(new, self.compute(new)))

    def _age(self) -> None:
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young


#: Settings under which a tokenizer drops white space and never joins across it, so that the ids
#: of a text are those of its words in order (fixed values, as in the tokenizer's file).
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: Characters for which the settings above amount to lower case and this pattern.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The same for words that stand in lines of their own.
_PLAIN_LINES = re.compile("[!-~À-ÖØ-öø-ÿ\n]+")
_LINE_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^a-zß-öø-ÿ0-9\n]+")
#: Stands between words among their ids; ids below 1 << 24 end in a zero byte, so it is found nowhere else.
_BETWEEN = b"\xff\xff\xff\xff"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in kept}
    rest = [b for b in range(256) if b not in names]
    names.update((b, chr(256 + i)) for i, b in enumerate(rest))
    return [names[b] for b in range(256)]


class LibraryTokens:
    """Ids of texts by the tokenizers library, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.model = self.tok.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_word = all(spec[k] == v for k, v in _BY_WORD.items()) and not any(set(t) & set(" \t\n\v\f\r") for t in self.special)
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.by_line = self.by_word and max(self.tok.get_vocab().values(), default=0) < 1 << 24
        self.pieces: dict[str, bytes] = {}
        self.known = Memo(lambda pieces: [_BETWEEN if p == "\n" else self._piece(p) for p in pieces], MEMO_ENTRIES // 2)
        self.memo = Memo(self._words)

    def _whole(self, text: bytes) -> bytes:
        return np.asarray(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text) or any(t in text for t in self.special):
            return self._whole(word)
        pieces = _PLAIN_PIECES.findall(text.lower())
        known = self.pieces
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            if len(known) > MEMO_ENTRIES // 2:
                known.clear()
            return b"".join([known.get(p) or known.setdefault(p, self._piece(p)) for p in pieces])

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of several words, cut into pieces all at once where they are plain."""
        text = b"\n".join(words).decode("utf-8", "replace")
        if not self.by_line or not _PLAIN_LINES.fullmatch(text) or any(t in text for t in self.special):
            return [self._word(w) for w in words]
        return self.known.joined(_LINE_PIECES.findall(text.lower())).split(_BETWEEN)

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes) -> bytes:
        return self.memo.joined(text.split()) if self.by_word else self._whole(text)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and how many each has; null is empty.

        Each different word is looked up once.
        """
        texts = texts.fill_null("")
        if not self.by_word:
            ids = [self._whole(t) for t in texts.cast(pa.large_binary()).to_pylist()]
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        words = pc.ascii_split_whitespace(texts)
        places = words.flatten().dictionary_encode()
        known = self.memo.values(places.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table, at = np.frombuffer(b"".join(known), "<u4"), np.asarray(places.indices)
        counts = sizes[at]
        ends = np.cumsum(counts)
        first = (np.cumsum(sizes) - sizes)[at] - (ends - counts)
        values = table[np.repeat(first, counts) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[np.append(0, np.cumsum(np.asarray(pc.list_value_length(words), np.int64)))]
        return values, np.diff(cuts)


_LIBRARIES: dict[str, LibraryTokens] = {}


def library_tokens(path: str) -> LibraryTokens:
    """The worker's tokenizer of this file."""
    if path not in _LIBRARIES:
        _LIBRARIES[path] = LibraryTokens(path)
    return _LIBRARIES[path]
