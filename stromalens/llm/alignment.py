"""Alignment of the tokens of two tokenizers by an associative monoid of text fragments.

Both tokenizers read the same bytes. Byte offsets at which a token of each ends cut a text
into groups; all tokens of a group are linked with each other. What is known of a byte range
is a ``Fragment``: the tokens up to its first common end (an open prefix, since its group may
have begun before), the groups closed inside, and the tokens after its last common end (an
open suffix). Two neighbouring fragments compose by closing the group that the suffix of the
one and the prefix of the other make together. This is associative, so the pieces of a very
long text are read by different tasks and composed as a tree; short texts compose
fragments of words that a worker remembers.

How often an id pair is linked corpus-wide is counted per document. Documents are handled in
blocks of bounded size: a block lists its distinct pairs once, asks for their counts in a
join, and each document refers to the list, so no pair is sent once per document.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .bpe import _SETTLED, PIECES
from .shared import binaries, byte_letters, slices

#: Bytes of a chunk of a long text, of a block of documents, and children of a node of the tree.
CHUNK_BYTES, BLOCK_BYTES, FAN = 1 << 16, 4 << 20, 8
#: Remembered words of a worker.
WORDS_KEPT = 300_000
#: A word with the blanks before it, or a part of one. Neither tokenizer joins across the border
#: before a run of blanks, nor across that of letters with ASCII digits or signs, but for
#: contractions; the last two cases take what is left.
_WORD = re.compile(
    rb"[ \t-\x0c]*(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+(?![A-Za-z\x80-\xff_])"
    rb"|[ \t-\x0c]*[!-@\[-^`{-~]+(?<!')(?![!-@\[-`{-~\x80-\xff])"
    rb"|[ \t-\x0c]*[^ \t-\x0c]+|[ \t-\x0c]+")
#: Carriage returns, which pieces join with others, and white space beyond ASCII: with them only
#: the borders between visible ASCII and other blanks are sure.
_ODD = re.compile(rb"[\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SURE = re.compile(rb"(?<=[!-~])(?=[ \t-\x0c])")
#: What no piece may hold for the above to be true of it.
_JOINED = re.compile("[^▁]▁|.[\t-\x0c]|[\t-\x0c].|[A-Za-zÀ-ÖØ-öø-ÿ][!-@\\[-^`{-~]|[!-@\\[-^`{-~][A-Za-zÀ-ÖØ-öø-ÿ]")


def _serialized(a: Iterable[int], b: Iterable[int]) -> bytes:
    return b"%s|%s" % (",".join(map(str, a)).encode(), ",".join(map(str, b)).encode())


def _codes(a: list[int], b: list[int]) -> list[int]:
    return [x << 32 | y for x in a for y in b]


@dataclass
class Fragment:
    """What a byte range tells: ``head`` before the first common end, closed groups, ``tail`` after the last.

    Without a common end (``cut`` false) all tokens are in the head. ``groups`` holds closed
    groups as text, ``pairs`` how often each pair code is linked in them. The empty fragment
    is neutral.
    """

    cut: bool = False
    a_head: list[int] = field(default_factory=list)
    b_head: list[int] = field(default_factory=list)
    groups: list[bytes] = field(default_factory=list)
    n_groups: int = 0
    pairs: dict[int, int] = field(default_factory=dict)
    a_tail: list[int] = field(default_factory=list)
    b_tail: list[int] = field(default_factory=list)

    def _close(self, a: list[int], b: list[int]) -> None:
        self.groups.append(_serialized(a, b))
        self.n_groups += 1
        for code in _codes(a, b):
            self.pairs[code] = self.pairs.get(code, 0) + 1

    def finished(self) -> Fragment:
        """A whole text: its two ends are borders of groups."""
        out = Fragment(True)
        if self.a_head or self.b_head:
            out._close(self.a_head, self.b_head)
        out.groups, out.n_groups = out.groups + self.groups, out.n_groups + self.n_groups
        for code, n in self.pairs.items():
            out.pairs[code] = out.pairs.get(code, 0) + n
        if self.a_tail or self.b_tail:
            out._close(self.a_tail, self.b_tail)
        return out


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges."""
    if not x.cut:
        return Fragment(y.cut, x.a_head + y.a_head, x.b_head + y.b_head, y.groups, y.n_groups, y.pairs, y.a_tail, y.b_tail)
    if not y.cut:
        return Fragment(True, x.a_head, x.b_head, x.groups, x.n_groups, x.pairs, x.a_tail + y.a_head, x.b_tail + y.b_head)
    out = Fragment(True, x.a_head, x.b_head, list(x.groups), x.n_groups, dict(x.pairs), y.a_tail, y.b_tail)
    out._close(x.a_tail + y.a_head, x.b_tail + y.b_head)
    out.groups += y.groups
    out.n_groups += y.n_groups
    for code, n in y.pairs.items():
        out.pairs[code] = out.pairs.get(code, 0) + n
    return out


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Fragment:
    """The fragment of tokens with the byte offsets at which they end, ascending on each side."""
    common = sorted(set(a_ends) & set(b_ends))
    if not common:
        return Fragment(False, list(a), list(b))
    a_at = [bisect_right(a_ends, e) for e in common]
    b_at = [bisect_right(b_ends, e) for e in common]
    out = Fragment(True, list(a[:a_at[0]]), list(b[:b_at[0]]), a_tail=list(a[a_at[-1]:]), b_tail=list(b[b_at[-1]:]))
    for i in range(1, len(common)):
        out._close(a[a_at[i - 1]:a_at[i]], b[b_at[i - 1]:b_at[i]])
    return out


class TokenPair:
    """Two tokenizers over the same bytes: a byte-level vocabulary (A) and a piece model (B)."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(byte_level)
        self.pre, self.model = tok.pre_tokenizer, tok.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.a_size = [len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())]
        spec = sentencepiece_model_pb2.ModelProto()
        with open(pieces, "rb") as f:
            spec.ParseFromString(f.read())
        spec.normalizer_spec.add_dummy_prefix = False  # the blank is part of what is read
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.by_word = not any(_JOINED.search(p) for i, p in enumerate(names) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i))
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        #: per word: tokens of A and B, groups, links, whether the pieces fail to give its bytes
        self.counts = [array("q") for _ in range(5)]
        self.codes = array("q")

    def words(self, whole: bytes) -> list[bytes]:
        if not self.by_word:
            return [whole]
        return _SURE.split(whole) if _ODD.search(whole) else _WORD.findall(whole)

    def _a_ids(self, text: str) -> list[int]:
        if _SETTLED.fullmatch(text):
            cut = [p.encode().decode("latin-1").translate(self.letters) for p in PIECES.findall(text)]
        else:
            cut = [p for p, _ in self.pre.pre_tokenize_str(text)]
        return [t.id for p in cut for t in self.model.tokenize(p)]

    def tokens(self, words: list[bytes]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of both sides for each word; None where the pieces do not give its bytes back."""
        texts = [w.decode("utf-8", "replace") for w in words]
        for word, text, b in zip(words, texts, self.b.encode(texts, num_threads=1)):
            yield (self._a_ids(text), b) if b"".join([self.b_bytes[t] for t in b]) == word else None

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        return list(accumulate([self.a_size[t] for t in a])), list(accumulate([len(self.b_bytes[t]) for t in b]))

    def _learn(self, words: list[bytes]) -> None:
        for word, got in zip(words, self.tokens(words)):
            self.known[word] = len(self.texts)
            if got is None:
                row, text, codes = (0, 0, 0, 0, 1), b"", []
            else:
                a, b = got
                text, codes, n = self._grouped(a, b)
                row = (len(a), len(b), n, len(codes), 0)
            self.texts.append(text)
            for column, value in zip(self.counts, row):
                column.append(value)
            self.codes.extend(codes)

    def _grouped(self, a: list[int], b: list[int]) -> tuple[bytes, list[int], int]:
        """``fragment(…).finished()`` of a word as text, codes and number of groups, without objects in between."""
        a_size, b_bytes, parts, codes = self.a_size, self.b_bytes, [], []
        i = j = a_end = b_end = 0
        while i < len(a):
            i0, j0 = i, j
            a_end += a_size[a[i]]
            b_end += len(b_bytes[b[j]])
            i, j = i + 1, j + 1
            while a_end != b_end:
                if a_end < b_end:
                    a_end += a_size[a[i]]
                    i += 1
                else:
                    b_end += len(b_bytes[b[j]])
                    j += 1
            if i - i0 == j - j0 == 1:
                parts.append(f"{a[i0]}|{b[j0]}")
                codes.append(a[i0] << 32 | b[j0])
            else:
                parts.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                codes += _codes(a[i0:i], b[j0:j])
        return ";".join(parts).encode(), codes, len(parts)

    def numbers(self, words: list[bytes]) -> list[int]:
        """The place of each word in this worker's tables."""
        got = list(map(self.known.get, words))
        if None in got:
            self._learn(list({w for w, n in zip(words, got) if n is None}))
            got = list(map(self.known.__getitem__, words))
        return got

    def forget(self) -> None:
        """Start anew once enough words are remembered; places given out before are void."""
        if len(self.texts) > WORDS_KEPT:
            self._reset()

    def ranged(self, whole: bytes, start: int, stop: int) -> Fragment | None:
        """The fragment of the tokens that end in (start, stop] of ``whole``, which starts and ends between words."""
        a, a_ends, b, b_ends, at = [], [], [], [], 0
        words = self.words(whole)
        for word, got in zip(words, self.tokens(words)):
            if got is None:
                return None
            a_at, b_at = self.ends(*got)
            a += got[0]
            a_ends += [at + e for e in a_at]
            b += got[1]
            b_ends += [at + e for e in b_at]
            at += len(word)
        i, j = np.searchsorted(a_ends, [start, stop], side="right").tolist()
        k, n = np.searchsorted(b_ends, [start, stop], side="right").tolist()
        return fragment(a[i:j], a_ends[i:j], b[k:n], b_ends[k:n])


_PAIRS: dict[tuple[str, str], TokenPair] = {}


def token_pair(byte_level: str, pieces: str) -> TokenPair:
    """The worker's tokenizers of these files."""
    if (byte_level, pieces) not in _PAIRS:
        _PAIRS[byte_level, pieces] = TokenPair(byte_level, pieces)
    return _PAIRS[byte_level, pieces]


BLOCK_SCHEMA = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                "refs binary, times binary, pairs array<long>, n_docs array<int>")
_BLOCK_NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "refs", "times", "pairs", "n_docs"]


def _block(block: int, doc_id: pa.Array, numbers: np.ndarray, digests: list[str], owner: np.ndarray, code: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Rows of a block; ``owner, code, times`` are each document's distinct pairs, by document."""
    n = len(digests)
    values, refs = np.unique(code, return_inverse=True)
    n_docs = np.bincount(refs, minlength=len(values)).astype(np.int32)
    bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
    ref_bytes, time_bytes = refs.astype("<u4").tobytes(), times.astype("<u4").tobytes()
    cut = lambda data: pa.array([data[4 * i:4 * j] for i, j in zip(bounds, bounds[1:])], pa.binary())
    first = np.zeros(n, np.int64)
    first[0] = len(values)
    mine = pa.array([True] + [False] * (n - 1))
    listed = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(first)), pa.int32()), pa.array(v, kind), mask=pa.compute.invert(mine))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, block)), doc_id, *[pa.array(c) for c in numbers], pa.array(digests, pa.string()),
        cut(ref_bytes), cut(time_bytes), listed(values, pa.int64()), listed(n_docs, pa.int32())], _BLOCK_NAMES)


def _block_ids(branch: int) -> Iterator[int]:
    at = branch << 62 | TaskContext.get().partitionId() << 31
    while True:
        yield at
        at += 1


def _short(docs: DataFrame, byte_level: str, pieces: str, chunk: int, block_bytes: int) -> DataFrame:
    """Block rows of the texts of at most ``chunk`` bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, ids = token_pair(byte_level, pieces), _block_ids(0)
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                pair.forget()
                places, groups, sizes = [], [], []
                for text in binaries(part, "text"):
                    got = pair.numbers(pair.words(b" " + text)) if text else []
                    places += got
                    sizes.append(len(got))
                    groups.append(got)
                places, sizes = np.array(places, np.int64), np.array(sizes, np.int64)
                counts = [np.array(c, np.int64) for c in pair.counts]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                per_doc = np.stack([np.bincount(owner, c[places], len(sizes)) for c in counts]).astype(np.int64)
                bad = per_doc[4] > 0
                per_doc[:, bad] = 0
                texts = pair.texts
                digests = ["" if b or not g else hashlib.sha256(b";".join([texts[i] for i in g])).hexdigest() for b, g in zip(bad.tolist(), groups)]
                used = places[~bad[owner]]
                # the pair codes of all words used, numbered densely
                values, dense = np.unique(np.array(pair.codes, np.int64), return_inverse=True)
                n = counts[3][used]
                last = np.cumsum(counts[3])[used]
                gathered = dense[np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())] if len(values) else np.zeros(0, np.int64)
                joint = np.repeat(owner[~bad[owner]], n) * max(len(values), 1) + gathered
                joint, times = np.unique(joint, return_counts=True)
                yield _block(next(ids), part.column(0), per_doc[:4], digests, joint // max(len(values), 1), values[joint % max(len(values), 1)] if len(values) else joint, times)

    size = F.octet_length("text")
    return docs.where(size.isNull() | (size <= chunk)).select("doc_id", "text").mapInArrow(rows, BLOCK_SCHEMA)


def _borders(whole: bytes, chunk: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop) of each byte range, and the bounds of the words that its tokens lie in."""
    step = _SURE if _ODD.search(whole) else re.compile(rb"(?<=[^ \t-\r])(?=[ \t-\r])")
    cuts = [m.start() for m in step.finditer(whole)]
    cuts = np.array([0, *cuts, len(whole)])
    for start in range(0, len(whole), chunk):
        stop = min(start + chunk, len(whole))
        low = int(cuts[np.searchsorted(cuts, start, side="right") - 1])
        high = int(cuts[np.searchsorted(cuts, stop, side="left")])
        yield start, stop, low, high


_FRAGMENT_SCHEMA = ("uid long, seq long, doc_id long, valid boolean, cut boolean, a_head binary, b_head binary, groups binary, n_groups long, n_a long, n_b long, "
                    "codes binary, times binary, a_tail binary, b_tail binary")
_FRAGMENT_NAMES = ["uid", "seq", "doc_id", "valid", "cut", "a_head", "b_head", "groups", "n_groups", "n_a", "n_b", "codes", "times", "a_tail", "b_tail"]


def _ids(values: list[int]) -> bytes:
    return np.array(values, "<i4").tobytes()


def _packed(uid: int, seq: int, doc_id: int | None, x: Fragment | None, n_a: int, n_b: int) -> pa.RecordBatch:
    f = x or Fragment()
    row = [uid, seq, doc_id, x is not None, f.cut, _ids(f.a_head), _ids(f.b_head), b";".join(f.groups), f.n_groups, n_a, n_b,
           np.array(list(f.pairs), "<i8").tobytes(), np.array(list(f.pairs.values()), "<i8").tobytes(), _ids(f.a_tail), _ids(f.b_tail)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * 3, pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], _FRAGMENT_NAMES)


def _unpacked(row: dict) -> Fragment:
    ids = lambda c: np.frombuffer(row[c], "<i4").tolist()
    pairs = dict(zip(np.frombuffer(row["codes"], "<i8").tolist(), np.frombuffer(row["times"], "<i8").tolist()))
    return Fragment(row["cut"], ids("a_head"), ids("b_head"), [row["groups"]] if row["n_groups"] else [], row["n_groups"], pairs, ids("a_tail"), ids("b_tail"))


def _fragments(docs: DataFrame, byte_level: str, pieces: str, chunk: int) -> DataFrame:
    """A fragment for each byte range of the texts longer than ``chunk`` bytes, read by tasks of their own."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for uid, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), binaries(part, "text")):
                    whole = b" " + text
                    for seq, (start, stop, low, high) in enumerate(_borders(whole, chunk)):
                        row = [uid, seq, doc, start - low, stop - low, whole[low:high]]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [*[pa.int64()] * 5, pa.binary()])], ["uid", "seq", "doc_id", "start", "stop", "bytes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(byte_level, pieces)
        for batch in batches:
            for row in batch.to_pylist():
                x = pair.ranged(row["bytes"], row["start"], row["stop"])
                yield _packed(row["uid"], row["seq"], row["doc_id"], x, *(_sizes(x) if x else (0, 0)))

    long = docs.where(F.octet_length("text") > chunk).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    chunks = materialize(long.mapInArrow(cut, "uid long, seq long, doc_id long, start long, stop long, bytes binary"))
    return materialize(chunks.repartition("uid", "seq").mapInArrow(read, _FRAGMENT_SCHEMA))


def _sizes(x: Fragment) -> tuple[int, int]:
    """Tokens of each side of a fragment that ``fragment`` made."""
    inner = [g.split(b"|") for g in x.groups]
    count = lambda k: sum(g[k].count(b",") + 1 for g in inner)
    return len(x.a_head) + len(x.a_tail) + count(0), len(x.b_head) + len(x.b_tail) + count(1)


def _reduced(frags: DataFrame, fan: int) -> DataFrame:
    """One fragment per text: each round composes up to ``fan`` neighbours in one task."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = _unpacked(row) if row["valid"] else None
                if (row["uid"], row["up"]) == key:
                    doc, y, n_a, n_b = held
                    held = doc, compose(y, x) if x is not None and y is not None else None, n_a + row["n_a"], n_b + row["n_b"]
                    continue
                if key is not None:
                    yield _packed(*key, *held)
                key, held = (row["uid"], row["up"]), (row["doc_id"], x, row["n_a"], row["n_b"])
        if key is not None:
            yield _packed(*key, *held)

    most = frags.agg(F.max("seq")).first()[0]
    while most:
        up = frags.withColumn("up", F.expr(f"seq div {fan}"))
        frags = materialize(up.repartition("uid", "up").sortWithinPartitions("uid", "up", "seq").mapInArrow(join, _FRAGMENT_SCHEMA))
        most //= fan
    return frags


def _long(frags: DataFrame, block_bytes: int) -> DataFrame:
    """Block rows of whole texts' fragments."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _block_ids(1)
        for batch in batches:
            for part in slices(batch, "groups", block_bytes):
                docs, numbers, digests, owner, codes, times = [], [], [], [], [], []
                for i, row in enumerate(part.to_pylist()):
                    x = _unpacked(row).finished() if row["valid"] else Fragment()
                    docs.append(row["doc_id"])
                    numbers.append((row["n_a"], row["n_b"], x.n_groups, sum(x.pairs.values())) if row["valid"] else (0, 0, 0, 0))
                    digests.append(hashlib.sha256(b";".join(x.groups)).hexdigest() if row["valid"] else "")
                    owner.append(np.full(len(x.pairs), i))
                    codes.append(np.array(list(x.pairs), np.int64))
                    times.append(np.array(list(x.pairs.values()), np.int64))
                yield _block(next(ids), pa.array(docs, pa.int64()), np.array(numbers, np.int64).T, digests, *map(np.concatenate, (owner, codes, times)))

    return frags.mapInArrow(rows, BLOCK_SCHEMA)


ALIGNED_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, byte_level: str, pieces: str, chunk: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Tokens, groups and links of each text of ``docs(doc_id, text)`` under two tokenizers, one row per row.

    ``byte_level`` (A) is a byte-level vocabulary file and reads a blank and the text; ``pieces``
    (B) is a piece model that puts the blank itself. Strings of special tokens are plain
    text. ``n_links`` counts the pairs of token occurrences that share a group. The count of a
    pair of ids is the number of rows that hold it linked; ``count_sum`` adds it over the
    links, ``n_best`` counts the links whose count is the highest of their A id. The digest
    is of ``a1,a2|b1;a3|b2,b3``: A ids, ``|``, B ids, and ``;`` between groups.

    A null or empty text, and one whose pieces do not give its bytes back, has zeros and an
    empty digest. Repeated rows are documents of their own; a null doc_id stays null; other
    columns are not read. Texts over ``chunk`` bytes are read in ranges by several tasks.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = _reduced(_fragments(docs, byte_level, pieces, chunk), fan)
    blocks = materialize(_short(docs, byte_level, pieces, chunk, block_bytes).unionByName(_long(long, block_bytes)))
    listed = blocks.where(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("ref", "p")).select("block", "ref", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n_docs"))
    counts = materialize(listed.groupBy("pair").agg(F.sum("n_docs").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    known = counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = listed.select("block", "ref", "pair").join(known, "pair").select(F.col("block").alias("asked"), "ref", "n", "best")

    def sums(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, answers = docs.combine_chunks(), answers.combine_chunks()
        ref = np.asarray(answers.column("ref"), np.int64)
        n, best = np.zeros(len(ref), np.int64), np.zeros(len(ref), np.int64)
        n[ref], best[ref] = np.asarray(answers.column("n"), np.int64), np.asarray(answers.column("best")).astype(np.int64)
        refs = [np.frombuffer(x, "<u4") for x in docs.column("refs").to_pylist()]
        flat, times = np.concatenate([np.zeros(0, "<u4"), *refs]), np.frombuffer(b"".join(docs.column("times").to_pylist()), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(refs)), [len(x) for x in refs])
        def per_doc(values):
            out = np.zeros(len(refs), np.int64)
            np.add.at(out, owner, values)
            return pa.array(out)
        made = {"n_best": per_doc(best[flat] * times), "count_sum": per_doc(n[flat] * times)}
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return pa.table([made.get(c, docs.column(c) if c in docs.column_names else None) for c in names], names)

    return blocks.drop("pairs", "n_docs").groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(sums, ALIGNED_SCHEMA)
