"""Packing token pieces into sequences of a fixed length by minimum bin slack.

Pieces of one length are interchangeable, so the search needs only how many pieces there are
of each length: at most as many numbers as a sequence has tokens, whatever the corpus. For
each bin, a bitset subset-sum over the lengths that are left finds the fullest combination
that holds the longest piece left; the same combination stays the fullest until one of its
lengths runs short, so it is taken as often as the counts allow. The plan (which ranks of
which length go where) is a small table; the pieces themselves find their place by their rank
within their length, which is counted in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import materialize
from .shared import binaries, library_tokens, slices

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"
RANK_SCHEMA = "_part int, _rank long"
_RANK = ["_part", "_rank"]


class _Ranks:
    """Numbers the pieces of each length that a task meets, from 0."""

    def __init__(self, capacity: int):
        self.part, self.seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

    def columns(self, lengths: np.ndarray) -> list[pa.Array]:
        """The task, and the rank of each piece within its length and task."""
        order = np.argsort(lengths, kind="stable")
        values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths)) - np.repeat(first, n) + self.seen[lengths[order]]
        self.seen[values] += n
        return [pa.array(np.full(len(lengths), self.part, np.int32)), pa.array(rank)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, ranked: bool = False) -> DataFrame:
    """Ids of every text, ended by ``end_id``, as pieces of at most ``capacity`` ids.

    Columns: doc_id, piece (from 0), start (ids of the document before it), length, ids
    (little-endian unsigned 32-bit numbers). Only documents longer than ``capacity`` are cut.
    A null text is empty and gives one piece of the end id alone; repeated rows give pieces each.
    With ``ranked`` the columns that ``pack_pieces`` counts by, _part and _rank, come first: a
    task then needs one Python worker, where cutting and ranking apart take two at once, any of
    which may come to hold the tokenizer and its memo.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = library_tokens(tokenizer), _Ranks(capacity)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), binaries(part, "text")):
                    ids = tokens.encode(text) + end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        x = ids[i:i + 4 * capacity]
                        out.append((doc, k, i // 4, len(x) // 4, x))
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                extra = ranks.columns(np.asarray(cols[3])) if ranked else []
                yield pa.RecordBatch.from_arrays([*extra, *cols], [*(_RANK if ranked else []), "doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, f"{RANK_SCHEMA}, {PIECE_SCHEMA}" if ranked else PIECE_SCHEMA)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> how many, for a fullest bin that holds the longest length left.

    A bit of ``reach`` is set for each sum that can be reached; the bitset after each
    binary-split group of equal lengths is kept, to walk back from the best sum.
    """
    order = sorted(counts, reverse=True)
    first = order[0]
    reach, steps = 1 << first, []
    full, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    for length in order:
        left = min(counts[length] - (length == first), (capacity - first) // length)
        group = 1
        while left > 0 and not reach & full:
            n = min(group, left)
            grown = reach | (reach << (n * length)) & mask
            if grown != reach:
                steps.append((length, n, reach))
                reach = grown
            left -= n
            group *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen = {first: 1}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + n
            total -= n * length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, ranks, per bin, first bin, offset in the bin) for all pieces."""
    counts = {k: v for k, v in histogram.items() if v}
    taken = dict.fromkeys(counts, 0)
    rows, bins = [], 0
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[k] // n for k, n in chosen.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            rows.append((length, taken[length], n * times, n, bins, offset))
            taken[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
            offset += n * length
        bins += times
    return np.array(rows, np.int64).reshape(-1, 6)


def pack_pieces(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to ``capacity`` tokens; other columns stay.

    The pieces are written once to the shared folder with their rank within their length and
    task, which is counted here unless they bring it (``token_pieces`` with ``ranked``). Only the counts by length, ``capacity`` numbers at most, reach the driver. Which of
    several equally long pieces goes where follows the order in which tasks read them.
    An empty table gives an empty result.
    """
    keep = [c for c in pieces.columns if c not in _RANK]
    empty = pieces.sparkSession.createDataFrame

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _Ranks(capacity)
        for batch in batches:
            x = np.asarray(batch.column(batch.schema.get_field_index(length)), np.int64)
            yield pa.RecordBatch.from_arrays([*ranks.columns(x), *batch.columns], [*_RANK, *keep])

    if not set(_RANK) <= set(pieces.columns):
        pieces = pieces.mapInArrow(rank, StructType(empty([], RANK_SCHEMA).schema.fields + pieces.schema.fields))
    held = materialize(pieces)
    by_part = held.groupBy("_part", F.col(length).alias("_length")).agg(F.count(F.lit(1)).alias("_n"))
    before = by_part.select("_part", "_length", (F.sum("_n").over(Window.partitionBy("_length").orderBy("_part")) - F.col("_n")).alias("_before"))
    histogram = {r["_length"]: r["n"] for r in held.groupBy(F.col(length).alias("_length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    plan = plan_bins(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    stride = int(plan[:, 1:3].sum(axis=1).max(initial=0)) + 1
    keys = plan[:, 0] * stride + plan[:, 1]
    out_fields = StructType([*(pieces.schema[c] for c in keep), *empty([], "sequence_id long, offset long").schema.fields])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            size, rank = np.asarray(col[length], np.int64), np.asarray(col["_rank"], np.int64) + np.asarray(col["_before"], np.int64)
            row = plan[np.searchsorted(keys, size * stride + rank, side="right") - 1]
            nth, lane = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*(col[c] for c in keep), pa.array(row[:, 4] + nth), pa.array(row[:, 5] + lane * size)], [*keep, "sequence_id", "offset"])

    joined = held.join(before, (held["_part"] == before["_part"]) & (held[length] == before["_length"])).select(*(held[c] for c in ["_rank", *keep]), "_before")
    return joined.mapInArrow(placed, out_fields)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, pieces joined in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h"))))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), "")).alias("ids"))
