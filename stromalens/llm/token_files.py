"""Token ids in a word-aligned binary format (Simple-8b) and back.

A data set is a folder of Parquet files that hold blocks in document order. A block packs
the ids of whole documents into 64-bit words: the top four bits select how many values of
which width the other sixty bits hold. Selector 0 is an escape: the next word is one value
of 64 bits as it is. ``lengths`` gives the ids of each document, so that any document is
found without decoding those before it, and the block's words decode in one vectorised pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir
from .shared import library_tokens, lists, slices

#: Fixed values of the format: selector -> values per word and bits per value.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
ESCAPE, DENSEST, WIDEST = 0, 1, 14
#: Bytes of text of which a worker looks up the different words at a time.
LOOKED_UP = 8 << 20
#: Ids of a block; a block ends with the first document that reaches it.
BLOCK_IDS = 1 << 16

BLOCK_SCHEMA = "part int, block int, first_doc long, start long, n_ids long, doc_ids array<long>, lengths array<long>, words binary"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as Simple-8b words, each as full as it can be."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return b""
    limits = np.array([(1 << int(w)) - 1 for w in WIDTHS[:15]], np.uint64)
    # the densest selector that takes each value alone
    need = (np.searchsorted(limits[1:15], values, side="left") + 1).astype(np.uint8)
    take = np.full(n, WIDEST, np.uint8)
    narrow = np.arange(n, dtype=np.int32)
    for selector in range(WIDEST - 1, DENSEST - 1, -1):
        narrow = narrow[need[narrow] <= selector]
        if not len(narrow):
            break
        # a value's run of narrow values must cover the count, or reach the end
        last = np.append(np.flatnonzero(np.diff(narrow) > 1), len(narrow) - 1)
        stop = np.repeat(narrow[last] + 1, np.diff(np.append(-1, last)))
        take[narrow[(stop - narrow >= COUNTS[selector]) | (stop == n)]] = selector
    take[values > limits[WIDEST]] = ESCAPE
    steps = COUNTS[take].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = take[starts]
    sizes = 1 + (chosen == ESCAPE)
    place = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    ends = np.append(starts[1:], n)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            words[place[mine] + 1] = values[starts[mine]]
            continue
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        lanes = np.arange(count)
        grid = padded[starts[mine][:, None] + lanes]
        grid[lanes >= (ends[mine] - starts[mine])[:, None]] = 0
        packed = np.bitwise_or.reduce(grid << (lanes * width).astype(np.uint64), axis=1)
        words[place[mine]] = packed | np.uint64(int(selector) << 60)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    words = np.frombuffer(data, "<u8").astype(np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if (selectors == ESCAPE).any():  # raw words that follow an escape are no selectors
        raw, skip = np.zeros(len(words), bool), False
        for i in np.flatnonzero(selectors == ESCAPE):
            skip = i > 0 and raw[i]
            if not skip:
                raw[i + 1] = True
        # a raw word may start with any four bits
        raw_at = np.flatnonzero(raw)
        head = ~raw
    else:
        raw_at, head = np.zeros(0, np.int64), np.ones(len(words), bool)
    counts = np.where(head, COUNTS[selectors], 0)
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) + 60, np.uint64)
    for selector in np.unique(selectors[head]):
        mine = np.flatnonzero(head & (selectors == selector))
        if selector == ESCAPE:
            out[ends[mine] - 1] = words[mine + 1]
            continue
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        lanes = np.arange(count)
        mask = np.uint64((1 << width) - 1)
        out[(ends[mine] - count)[:, None] + lanes] = (words[mine][:, None] >> (lanes * width).astype(np.uint64)) & mask
    return out[:n]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every text, in ascending ``doc_id`` order, to ``folder``.

    Documents are dealt by ranges of ``doc_id`` and sorted inside each range; each task writes
    the blocks of one range. A null text is empty; a null ``doc_id`` comes first; equal ids
    follow each other in the order of their texts.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = library_tokens(tokenizer), TaskContext.get().partitionId()
        ids, sizes, names, held, start, block = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, sizes, names, held, start, block
            lengths, values = np.concatenate(sizes), np.concatenate(ids)
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names[0]], pa.int64()), pa.array([start], pa.int64()),
                pa.array([len(values)], pa.int64()), pa.array([names], pa.list_(pa.int64())), lists(lengths, [len(lengths)], pa.int64()), pa.array([pack(values)], pa.binary())],
                ["part", "block", "first_doc", "start", "n_ids", "doc_ids", "lengths", "words"])
            start, block, ids, sizes, names, held = start + len(values), block + 1, [], [], [], 0
            return out

        for batch in batches:
            for piece in slices(batch, "text", LOOKED_UP):
                values, lengths = tokens.encode_all(piece.column(1))
                ends = np.cumsum(lengths + 1)
                values, lengths = np.insert(values, np.cumsum(lengths), end_id), lengths + 1
                docs_here, at, done = piece.column(0).to_pylist(), 0, 0
                while at < len(lengths):
                    # the document that fills the block is its last
                    stop = int(np.searchsorted(ends, done + block_ids - held)) + 1
                    full, stop = stop <= len(lengths), min(stop, len(lengths))
                    ids.append(values[done:ends[stop - 1]])
                    sizes.append(lengths[at:stop])
                    names += docs_here[at:stop]
                    held += int(ends[stop - 1]) - done
                    at, done = stop, int(ends[stop - 1])
                    if full:
                        yield flush()
        if ids:
            yield flush()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a written folder: doc_id, start (ids of all documents before it), n_tokens, and
    ids as little-endian unsigned 32-bit numbers.

    The files' own totals give the ids before each file. They are broadcast: 16 bytes per file
    of many megabytes, 25 MB for 100 TB in files of 64 MB.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                lengths = np.array(b["lengths"], np.int64)
                data, ends = unpack(b["words"], b["n_ids"]).astype("<u4").tobytes(), np.cumsum(lengths).tolist()
                ids = [data[4 * i:4 * j] for i, j in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(b["doc_ids"], pa.int64()), pa.array(b["before"] + b["start"] + np.cumsum(lengths) - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(F.broadcast(before), "part").select("before", "start", "n_ids", "doc_ids", "lengths", "words").mapInArrow(rows, ROW_SCHEMA)


def scratch_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
