"""Exact removal of repeated passages, by prefix-partitioned suffix trees.

A passage repeats if ``width`` words in a row also occur earlier. The suffixes that start such
passages are found in a generalised suffix tree over the words of all texts: the leaves under a node
of depth ``width`` or more start with the same words. The tree is never built whole:

1. Most suffixes repeat nowhere. Each window of ``width`` words is told by an anchor, the run of
   ``ANCHOR`` words in it with the smallest hash, so equal windows have equal anchors. Anchors are
   a sixth of the words; only suffixes whose anchor occurs twice go on. What a task sees twice
   itself is settled there, so a passage in a third of all texts sends one row per task.
2. The suffixes that are left are dealt out by ranges of their words. A range ends wherever it has
   its share of suffixes, so the prefixes that part two neighbouring ranges are as long as needed:
   a word or two where suffixes are few, many words inside a popular passage. Of suffixes that
   agree in all ``width`` words a task sends on the earliest alone.
3. A sorted range is its subtree: neighbours that agree in ``width`` words hang under one deep node.
   All leaves of such a node but the earliest start a repeat.

Words are compared by hashes: 16 bits for each of the first ``LEAD`` words of a suffix, which
order the ranges, and 64 bits for all ``width`` words together. Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .shared import binaries, slices

#: Words of an anchor, and words of a suffix that its sort key holds one by one.
ANCHOR, LEAD = 10, 4
#: Words of the run that cuts a block, and runs on each side that it is compared with.
CUT_WORDS, REACH = 4, 16
#: Bytes of text that a task looks at together.
CHUNK_BYTES = 4 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _rolling(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``width`` neighbours; ``width`` multiplications per place."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * base + h[i:i + n]
    return _mix(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of ``width`` neighbours, by doubling."""
    span, out = 1, h
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:len(out) - step], out[step:])
        span += step
    return out


class Words:
    """Word codes of several texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.raw = raw
        # polynomial hash of each word: sum of letters times falling powers, by word length
        length = self.end - self.begin
        code = length.astype(np.uint64)
        order = np.argsort(length, kind="stable")
        at, left = self.begin[order], length[order]
        h = code[order]
        step = 0
        low = 0
        while low < len(order):
            low = int(np.searchsorted(left, step, side="right"))
            if low >= len(order):
                break
            h[low:] = h[low:] * _BASE[0] + _BYTE[raw[at[low:] + step]]
            step += 1
        code[order] = h
        self.code = _mix(code)
        self.bounds = np.searchsorted(self.begin, np.concatenate([[0], np.cumsum(sizes)]))  # words of each text
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def windows(self, width: int) -> np.ndarray:
        """Words that have ``width - 1`` more after them in their text."""
        start = np.arange(max(len(self.doc) - width + 1, 0))
        return start[self.doc[start] == self.doc[start + width - 1]] if len(start) else start


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts and the anchor hash of each; places of all anchors and the hash at each."""
    start = words.windows(width)
    if not len(start):
        return start, np.zeros(0, np.uint64), start, np.zeros(0, np.uint64)
    reach = width - ANCHOR + 1
    run = _rolling(words.code, ANCHOR, _BASE[1])
    least = _least(run, reach)
    inside = np.zeros(len(least), bool)
    inside[start] = True
    # a run is an anchor if it is the smallest of some window that holds it
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), np.where(inside, least, 0), np.zeros(reach - 1, np.uint64)])
    place = np.flatnonzero((~_least(~padded, reach) == run) & (run > 0))
    return start, least[start], place, run[place]


def _blocks(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the windows of each text into blocks at places that their own words determine.

    A cut is a run of ``CUT_WORDS`` whose hash is below all of the ``REACH`` before it and not above
    those after it, in one text. Returns the first window of each block, the window behind
    its last, and two hashes of the words that its windows hold.
    """
    start = words.windows(width)
    if not len(start):
        return start, start, start.view(np.uint64), start.view(np.uint64)
    n, top = len(words.doc), ~np.uint64(0)
    run = np.full(n, top)
    inside = words.windows(CUT_WORDS)
    run[inside] = _rolling(words.code, CUT_WORDS, _BASE[1])[inside]
    spread = np.arange(n) + (words.doc + 1) * REACH  # so that no text looks into another
    row = np.full(int(spread[-1]) + 1 + REACH, top)
    row[spread] = run
    least = _least(row, REACH)
    cut = (run < least[spread - REACH]) & (run <= least[spread + 1])
    cut[start[np.append(True, words.doc[start[1:]] != words.doc[start[:-1]])]] = True
    first = start[cut[start]]
    last = np.append(first[1:], start[-1] + 1)
    final = np.searchsorted(start, last)  # a block ends with the windows of its text
    last = np.minimum(last, start[final - 1] + 1)
    hashes = []
    for base in _BASE[1:]:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words.code * _powers(base, n), out=total[1:])
        back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)
        hashes.append(_mix((total[last + width - 1] - total[first]) * back[first] + (last - first).astype(np.uint64)))
    return first, last, *hashes


def _dealt(lead: np.ndarray, digest: np.ndarray, doc: np.ndarray, key: np.ndarray, begin: np.ndarray, settled: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """The earliest of what is equal in a task as rows; later ones, and what was ``settled`` (keys and
    places) before, as places per text."""
    order = np.lexsort((begin, key, doc, digest, lead))
    same = (lead[order][1:] == lead[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    head = np.append(True, ~same)[:len(order)]
    lead_row = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    # repeated rows are one document: their suffix at the same place is no repeat
    twin = (key[order] == key[order[lead_row]]) & (begin[order] == begin[order[lead_row]])
    keep, gone = order[head], order[~head & ~twin]
    gone_key, gone_at = key[gone], begin[gone]
    if settled is not None:
        gone_key, gone_at = np.concatenate([gone_key, settled[0]]), np.concatenate([gone_at, settled[1]])
    sort = np.lexsort((gone_at, gone_key))
    gone_key, gone_at = gone_key[sort], gone_at[sort]
    owner, cut = np.unique(gone_key, return_index=True)
    starts = [x.astype("<i4").tobytes() for x in np.split(gone_at, cut[1:])] if len(cut) else []
    blank = np.zeros(len(owner), np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([lead[keep], _mix(owner.view(np.uint64)).view(np.int64)])), pa.array(np.concatenate([digest[keep], blank])),
        pa.array(np.concatenate([doc[keep], blank])), pa.array(np.concatenate([key[keep], owner])),
        pa.array(np.concatenate([begin[keep], blank]).astype(np.int32)), pa.array([None] * len(keep) + starts, pa.binary())],
        ["lead", "digest", "doc_id", "key", "start", "starts"])


_DEALT_SCHEMA = "lead long, digest long, doc_id long, key long, start int, starts binary"


def _block_rows(docs: DataFrame, width: int) -> DataFrame:
    """The blocks of all texts as ``_leaves`` takes them."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                words = Words(binaries(part, "text"))
                first, _, one, two = _blocks(words, width)
                if len(first):
                    doc, key = (np.asarray(part.column(i), np.int64) for i in range(2))
                    owner = words.doc[first]
                    yield _dealt(one.view(np.int64), two.view(np.int64), doc[owner], key[owner], first - words.bounds[owner])

    return _texts(docs).select("doc_id", "key", "text").mapInArrow(rows, _DEALT_SCHEMA)


def _unpacked_slices(batch: pa.RecordBatch, at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column ``at``, compressed texts, gives about ``size`` bytes of text per piece."""
    ends = np.cumsum([zstandard.frame_content_size(x) for x in batch.column(at).to_pylist()])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _texts(docs: DataFrame) -> DataFrame:
    # null ids come before all others
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    return docs.select(doc.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def _shrunk(docs: DataFrame, extra: list[str]) -> DataFrame:
    """doc_id, key, and the text compressed; and other columns of ``docs`` in a struct."""
    other = F.struct(*[F.col(c) for c in extra]) if extra else F.lit(None).cast("struct<none:int>")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(doc.alias("doc_id"), F.xxhash64(doc, F.coalesce("text", F.lit(""))).alias("key"), "text", other.alias("other"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                packed = pa.array([z.compress(t) for t in binaries(part, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, part.column(3)], ["doc_id", "key", "z", "other"])

    return rows.mapInArrow(shrink, f"doc_id long, key long, z binary, other {rows.schema['other'].dataType.simpleString()}")


def _sightings(docs: DataFrame, width: int) -> DataFrame:
    """Rows (anchor, key, sure): an anchor of a text that its task saw once, or the first of
    several; and for each text, in ``sure``, all its anchors that the task saw more than once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                words = Words(binaries(part, "text"))
                keys = np.asarray(part.column(1), np.int64)
                _, _, place, anchor = _anchors(words, width)
                if not len(place):
                    continue
                owner = words.doc[place]
                values, first, back, n = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                shared = n[back] > 1
                sure_owner, at = np.unique(owner[shared], return_index=True)
                pieces = np.split(anchor[shared], at[1:]) if len(at) else []
                out_anchor = np.concatenate([values.view(np.int64), _mix(keys[sure_owner].view(np.uint64)).view(np.int64)])
                out_key = keys[np.concatenate([owner[first], sure_owner])]
                sure = [None] * len(values) + [np.unique(p).tobytes() for p in pieces]
                yield pa.RecordBatch.from_arrays([pa.array(out_anchor), pa.array(out_key), pa.array(sure, pa.binary())], ["anchor", "key", "sure"])

    return _texts(docs).select("text", "key").mapInArrow(rows, "anchor long, key long, sure binary")


def _suffixes(touched: DataFrame, width: int) -> DataFrame:
    """The suffixes of ``touched(doc_id, key, z, anchors, sure, blocks)`` that start with a known anchor's window.

    Rows (lead, digest, doc_id, key, start): the earliest suffix of its words in the task. Later
    ones, and all windows of repeated ``blocks``, are repeats already, given per text as ``starts``.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _unpacked_slices(batch, 2, CHUNK_BYTES):
                words = Words([z.decompress(x) for x in part.column(2).to_pylist()])
                doc, key = (np.asarray(part.column(i), np.int64) for i in range(2))
                start, anchor, _, _ = _anchors(words, width)
                flat = lambda i, kind: np.frombuffer(b"".join(x for xs in part.column(i).to_pylist() for x in xs or ()), kind)
                settled = np.zeros(len(words.doc) + 1, np.int64)
                repeated = [np.frombuffer(b"".join(xs or ()), "<i4") + words.bounds[i] for i, xs in enumerate(part.column(5).to_pylist())]
                if sum(map(len, repeated)):
                    first, last, _, _ = _blocks(words, width)
                    mine = np.searchsorted(first, np.concatenate(repeated))
                    np.add.at(settled, first[mine], 1)
                    np.add.at(settled, last[mine], -1)
                settled = np.cumsum(settled)[:-1] > 0
                known = np.unique(np.concatenate([np.array([x for xs in part.column(3).to_pylist() for x in xs or ()], np.int64).view(np.uint64), flat(4, np.uint64)]))
                at = start[known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor] if len(known) else start[:0]
                at, done = at[~settled[at]], np.flatnonzero(settled)
                if not len(at) and not len(done):
                    continue
                owner = words.doc[at]
                digest = _rolling(words.code, width, _BASE[2])[at].view(np.int64)
                lead = np.zeros(len(at), np.uint64)
                for i in range(LEAD):
                    lead = lead << np.uint64(16) | words.code[at + i] >> np.uint64(48)
                spot = words.doc[done]
                yield _dealt(lead.view(np.int64), digest, doc[owner], key[owner], at - words.bounds[owner], (key[spot], done - words.bounds[spot]))

    return touched.select("doc_id", "key", "z", "anchors", "sure", "blocks").mapInArrow(rows, _DEALT_SCHEMA)


def _leaves(suffixes: DataFrame) -> DataFrame:
    """Walk sorted ranges of suffixes: (key, starts) of all leaves of deep nodes but the earliest."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # lead, digest, key and start of the node that is open
        for batch in batches:
            settled = np.asarray(batch.column(5).is_valid())
            for part in (batch.filter(pa.array(settled)),):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(3), part.column(5)], ["key", "starts"])
            part = batch.filter(pa.array(~settled))
            if not part.num_rows:
                continue
            lead, digest, _, key, start = (np.asarray(part.column(i), np.int64) for i in range(5))
            if last is not None:
                lead, digest, key, start = (np.append(v, x) for v, x in zip(last, (lead, digest, key, start)))
            head = np.append(True, (lead[1:] != lead[:-1]) | (digest[1:] != digest[:-1]))
            node = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            leaf = np.flatnonzero(~((key == key[node]) & (start == start[node])))
            last = tuple(v[node[-1]] for v in (lead, digest, key, start))
            if len(leaf):
                leaf = leaf[np.lexsort((start[leaf], key[leaf]))]
                owner, cut = np.unique(key[leaf], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array([x.astype("<i4").tobytes() for x in np.split(start[leaf], cut[1:])], pa.binary())], ["key", "starts"])

    order = ["lead", "digest", "doc_id", "key", "start"]
    return suffixes.repartitionByRange("lead", "digest").sortWithinPartitions(*order).mapInArrow(rows, "key long, starts binary")


def repeats(docs: DataFrame, width: int) -> DataFrame:
    """key (hash of doc_id and text) and starts: places of the windows that also start earlier."""
    if width < ANCHOR + LEAD:
        raise ValueError(f"width must be at least {ANCHOR + LEAD}")
    blocks = materialize(_leaves(_block_rows(docs, width)).groupBy("key").agg(F.collect_list("starts").alias("blocks")))
    seen = _sightings(docs, width).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("n > 1 or sure is not null")
    per_text = seen.groupBy("key").agg(F.collect_list(F.when(F.col("sure").isNull(), F.col("anchor"))).alias("anchors"), F.collect_list("sure").alias("sure"))
    told = per_text.join(blocks, "key", "full_outer")
    touched = materialize(_shrunk(docs, []).join(told, "key").select("doc_id", "key", "z", "anchors", "sure", "blocks"))
    return _leaves(_suffixes(touched, width)).groupBy("key").agg(F.collect_list("starts").alias("starts"))


def remove_repeats(docs: DataFrame, width: int = 20, extra: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """Remove each word inside a window of ``width`` words that also starts earlier.

    Earlier is a smaller doc_id, or the same text at an earlier place; windows are judged on the
    input. One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept (the words
    that stay, joined by blanks; with ``as_is`` the unchanged text if all stay) and the ``extra``
    columns of ``docs``. A null text has no
    words; a null doc_id comes before all others. Rows that repeat a doc_id with the same text
    are one document, returned as often as they came; of different texts under one doc_id, the
    one with the smaller hash comes first.
    """
    extra = extra or []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _unpacked_slices(batch, 1, CHUNK_BYTES // 2):
                out = []
                for doc, packed, starts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text = z.decompress(packed)
                    words = text.split()
                    n = len(words)
                    if starts:
                        at = np.frombuffer(b"".join(starts), "<i4")
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, at, 1)
                        np.add.at(step, np.minimum(at + width, n), -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:n]) == 0).tolist()]
                    out.append((None if doc == -(1 << 63) else doc, n, n - len(words), (text if as_is and len(words) == n else b" ".join(words)).decode("utf-8", "replace")))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, part.column(3)], ["doc_id", "n_words", "n_removed", "kept", "other"])

    joined = _shrunk(docs, extra).join(repeats(docs, width), "key", "left").select("doc_id", "z", "starts", "other")
    kind = joined.schema["other"].dataType.simpleString()
    return joined.mapInArrow(rows, f"doc_id long, n_words long, n_removed long, kept string, other {kind}").select("doc_id", "n_words", "n_removed", "kept", *[F.col(f"other.{c}").alias(c) for c in extra])
