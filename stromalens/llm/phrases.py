"""Collocations by Rabin-Karp fingerprints of word sequences.

Texts are laid end to end in numpy arrays. Prefix sums of letters times powers of a base give
the hash of every word at once, prefix sums of word hashes that of every run of words, all
modulo 2**64. Equal fingerprints are counted, first inside a task, then across a shuffle,
where a row is two fingerprints, a count, and a pointer to one occurrence: the number of a
row and a byte offset. Only what is counted often enough is followed back to the text
and becomes a phrase.

The second fingerprint, modulo a prime, tells apart what shares the first. A pointer must
lead to words with both fingerprints. Where it does not, because the rows were dealt out
anew in between, all runs with that fingerprint are read again and counted by their text.

Longer runs are counted where both runs one word shorter are frequent, as they cannot be
frequent otherwise. Which ones are is told by a bit set of fixed size, in which an
unfortunate bit costs a row and never a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import materialize
from .shared import binaries, slices

#: Bytes of text laid end to end, and of a part of a longer text.
BLOCK_BYTES, PART_BYTES = 1_000_000, 900_000
#: Bits of the broadcast set (8 MB), dealt out in pieces.
SET_BITS, PIECE_BITS = 1 << 26, 1 << 15
_LETTERS, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = re.compile(rb"[^ \t-\r.,;:!?]+")
_UPPER_TABLE = bytes(_LOWER)
_RNG = np.random.default_rng(11)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = _ODD(256)
_BASES = [int(x) for x in _ODD(2)]
_PRIME = (1 << 31) - 1
_CHECK_VALUE = _RNG.integers(1, _PRIME, 256, np.uint64)
_CHECK_BASES = [int(x) for x in _RNG.integers(1 << 20, _PRIME, 2)]
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, prime: int = 0) -> np.ndarray:
    """base ** i for i below n, modulo ``prime`` or 2**64; kept by the worker."""
    known = _POWERS.get((base, prime))
    if known is None:
        known = np.ones(1, np.uint64)
    while len(known) < n:
        step = np.uint64(pow(base, len(known), prime or 1 << 64))
        more = known * step
        known = np.concatenate([known, more % np.uint64(prime) if prime else more])
    _POWERS[base, prime] = known
    return known[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(values: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, from prefix sums modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return (total[stop] - total[start]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[start]


def _check_spans(values: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The same modulo a prime; sums of numbers below 2**31 do not overflow."""
    p = np.uint64(_PRIME)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values), _PRIME) % p, out=total[1:])
    return (total[stop] - total[start]) % p * _powers(pow(base, -1, _PRIME), len(values) + 1, _PRIME)[start] % p


def _parts(text: bytes, words: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length of its own, bytes) of the parts of a text, cut between words; the bytes go on for ``words`` more."""
    start = 0
    while len(text) - start > size:
        stop = start + size
        while stop < len(text) and _KIND[text[stop]] == _LETTERS:
            stop += 1
        more, left = stop, words
        while left and (m := _WORD.search(text, more)):
            more, left = m.end(), left - 1
        yield start, stop - start, text[start:more]
        start = stop
        if start >= len(text):
            return
    yield start, len(text) - start, text[start:]


class Runs:
    """Fingerprints of the runs of words of several texts."""

    def __init__(self, parts: list[tuple[int, int, int, bytes]], seeds: np.ndarray, bits: int = 64):
        """``parts`` are text number, offset in the text, length of its own, and bytes."""
        owner, offset, own, pieces = zip(*parts)
        raw = _LOWER[np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8)]
        lengths = np.array([len(x) + 1 for x in pieces], np.int64)
        begins = np.cumsum(lengths) - lengths
        kind = _KIND[raw]
        letters = np.concatenate([[False], kind == _LETTERS, [False]])
        edge = np.flatnonzero(letters[1:] != letters[:-1])
        self.start, self.stop = edge[0::2], edge[1::2]
        piece = np.searchsorted(begins, self.start, side="right") - 1
        self.text = np.array(owner, np.int64)[piece]
        self.at = self.start - begins[piece] + np.array(offset, np.int64)[piece]
        self.mine = self.start - begins[piece] < np.array(own, np.int64)[piece]
        breaks = np.cumsum(kind == _BREAK)
        self.clause = breaks[self.start] if len(self.start) else self.start
        self.seed = np.asarray(seeds, np.uint64)[self.text]
        self.bits = bits
        size = (self.stop - self.start).astype(np.uint64)
        self.code = _mix(_spans(_VALUE[raw], _BASES[0], self.start, self.stop) + size)
        check = _check_spans(_CHECK_VALUE[raw], _CHECK_BASES[0], self.start, self.stop)
        self.check = (check * np.uint64(_CHECK_BASES[1]) + size) % np.uint64(_PRIME)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, fingerprint and second fingerprint of each run of ``n`` words inside a clause."""
        first = np.arange(max(len(self.start) - n + 1, 0))
        stop = first + n
        keep = self.mine[first] & (self.clause[first] == self.clause[stop - 1])
        first, stop = first[keep], stop[keep]
        print_ = _mix(_spans(self.code, _BASES[1], first, stop) + self.seed[first] + np.uint64(n))
        if self.bits < 64:
            print_ &= np.uint64((1 << self.bits) - 1)
        return first, print_, _check_spans(self.check, _CHECK_BASES[1], first, stop)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 11)


def _read(batches: Iterator[pa.RecordBatch], longest: int, bits: int, part_bytes: int) -> Iterator[tuple[Runs, pa.RecordBatch, list[bytes]]]:
    """``Runs`` over slices of batches with lang and text."""
    seeds: dict[str, int] = {}
    for batch in batches:
        for piece in slices(batch, "text", BLOCK_BYTES):
            langs = piece.column(piece.schema.get_field_index("lang")).to_pylist()
            for lang in langs:
                if lang not in seeds:
                    if len(seeds) > 10_000:
                        seeds.clear()
                    seeds[lang] = _seed(lang)
            texts, seed = binaries(piece, "text"), np.array([seeds[x] if x in seeds else _seed(x) for x in langs], np.uint64)
            held, size = [], 0
            for i, text in enumerate(texts):
                for at, own, data in _parts(text, longest - 1, part_bytes):
                    if held and size + len(data) > BLOCK_BYTES:
                        yield Runs(held, seed, bits), piece, texts
                        held, size = [], 0
                    held.append((i, at, own, data))
                    size += len(data) + 1
            yield Runs(held, seed, bits), piece, texts


COUNT_SCHEMA = "print long, check int, n long, row long, place long"


def _hits(bits: np.ndarray, print_: np.ndarray) -> np.ndarray:
    """Whether both places of a fingerprint are set."""
    out = np.ones(len(print_), bool)
    for place in _places(print_):
        out &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _places(print_: np.ndarray) -> list[np.ndarray]:
    h = _mix(print_ ^ np.uint64(0x5851F42D4C957F2D))
    return [(h & np.uint64(SET_BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(SET_BITS - 1)).astype(np.int64)]


def _bit_set(prints: DataFrame) -> np.ndarray:
    """Both places of each fingerprint in a set of fixed size, put together piece by piece."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_places(np.asarray(batch.column(0), np.int64).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array((at // PIECE_BITS).astype(np.int32)), pa.array((at % PIECE_BITS).astype(np.int32))], ["piece", "bit"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, bit = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for p in np.unique(piece).tolist():
                held.setdefault(p, np.zeros(PIECE_BITS, bool))[bit[piece == p]] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["piece", "bits"])

    set_ = np.zeros(SET_BITS // 8, np.uint8)
    dealt = prints.select("print").mapInArrow(places, "piece int, bit int").distinct().repartition("piece").mapInArrow(pieces, "piece int, bits binary")
    for row in dealt.toLocalIterator():
        set_[row["piece"] * PIECE_BITS // 8:(row["piece"] + 1) * PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return set_


def _every_word(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of size 0, which are the words: one fingerprint per language."""
    first = np.flatnonzero(runs.mine)
    print_ = _mix(runs.seed[first])
    return first, print_ & np.uint64((1 << runs.bits) - 1), np.zeros(len(first), np.uint64)


def _counted(docs: DataFrame, sizes: list[int], longest: int, shorter, bits: int, part_bytes: int) -> DataFrame:
    """print, check (second fingerprint), n, and row and place of one occurrence, of the runs of the given sizes.

    ``place`` is the byte offset times eight and the size. ``shorter`` is the set of the frequent
    runs of one word less, of which a longer run must hold two, or None.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, piece, _ in _read(batches, longest, bits, part_bytes):
            row = np.asarray(piece.column(piece.schema.get_field_index("row")), np.int64)
            for size in sizes:
                first, print_, check = runs.runs(size) if size else _every_word(runs)
                if shorter is not None and len(first):
                    at, short, _ = runs.runs(size - 1)
                    hit = np.zeros(len(runs.start) + 1, bool)
                    hit[at] = _hits(shorter.value, short)
                    # the second half of the last run of a part starts in the next part: taken as known
                    keep = hit[first] & (hit[first + 1] | ~runs.mine[first + 1])
                    first, print_, check = first[keep], print_[keep], check[keep]
                if not len(first):
                    continue
                both, n = _distinct(print_, check)
                f = first[both]
                yield pa.RecordBatch.from_arrays([
                    pa.array(print_[both].view(np.int64)), pa.array(check[both].astype(np.int32)), pa.array(n), pa.array(row[runs.text[f]]), pa.array(runs.at[f] * 8 + size)],
                    ["print", "check", "n", "row", "place"])

    found = docs.select("lang", "row", "text").mapInArrow(rows, COUNT_SCHEMA)
    # both parts of a pointer are taken in step, from one row
    return found.groupBy("print", "check").agg(F.sum("n").alias("n"), F.first("row").alias("row"), F.first("place").alias("place"))


def _distinct(print_: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct pair of fingerprints, and how often it occurs."""
    order = np.lexsort((check, print_))
    p, c = print_[order], check[order]
    at = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (c[1:] != c[:-1])))
    return order[at], np.diff(np.append(at, len(p)))


def _read_back(docs: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """lang, size, phrase, n, print and sure of each frequent fingerprint, by its pointer."""
    wanted = frequent.groupBy("row").agg(F.collect_list(F.struct("place", "n", "print", "check")).alias("found"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", BLOCK_BYTES):
                out = []
                for lang, text, found in zip(piece.column(0).to_pylist(), binaries(piece, "text"), piece.column(2).to_pylist()):
                    lowered = text.translate(_UPPER_TABLE)
                    for f in found:
                        at, size = divmod(f["place"], 8)
                        words = []
                        for _ in range(size):
                            m = _WORD.search(lowered, at)
                            words.append(m[0] if m else b"")
                            at = m.end() if m else at
                        out.append((lang, size, b" ".join(words), f["n"], f["print"], f["check"]))
                if not out:
                    continue
                lang, size, phrase, n, print_, check = zip(*out)
                again = np.zeros((2, len(out)), np.int64)
                for k in set(size):
                    mine = np.array([i for i, s in enumerate(size) if s == k])
                    seeds = np.array([_seed(lang[i]) for i in mine], np.uint64)
                    if k:
                        runs = Runs([(j, 0, len(phrase[i]), phrase[i]) for j, i in enumerate(mine)], seeds, bits)
                        first, values, checks = runs.runs(k)
                        again[:, mine[runs.text[first]]] = values.view(np.int64), checks.view(np.int64)
                    else:
                        again[0, mine] = (_mix(seeds) & np.uint64((1 << bits) - 1)).view(np.int64)
                sure = (again == np.array([print_, check], np.int64)).all(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()), pa.array(n, pa.int64()), pa.array(print_, pa.int64()), pa.array(sure)],
                                                 ["lang", "size", "phrase", "n", "print", "sure"])

    joined = docs.join(wanted, "row", "right").select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), "found")
    return joined.mapInArrow(rows, "lang string, size int, phrase binary, n long, print long, sure boolean")


def _recounted(docs: DataFrame, doubtful: DataFrame, longest: int, bits: int, part_bytes: int) -> DataFrame:
    """lang, size, phrase, n of all runs with a doubtful fingerprint, counted by their words."""
    spark = docs.sparkSession
    chosen = spark.sparkContext.broadcast(_bit_set(doubtful))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, piece, texts in _read(batches, longest, bits, part_bytes):
            langs = piece.column(piece.schema.get_field_index("lang")).to_pylist()
            for size in range(longest + 1):
                first, print_, _ = runs.runs(size) if size else _every_word(runs)
                hit = _hits(chosen.value, print_)
                first, print_ = first[hit], print_[hit]
                counts: dict[tuple, int] = {}
                for f, p in zip(first.tolist(), print_.view(np.int64).tolist()):
                    t = int(runs.text[f])
                    words = [texts[t][runs.at[i]:runs.at[i] + runs.stop[i] - runs.start[i]].translate(_UPPER_TABLE) for i in range(f, f + size)]
                    k = langs[t], b" ".join(words), p
                    counts[k] = counts.get(k, 0) + 1
                if counts:
                    lang, phrase, print_ = zip(*counts)
                    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([size] * len(lang), pa.int32()), pa.array(phrase, pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array(print_, pa.int64())],
                                                     ["lang", "size", "phrase", "n", "print"])

    found = docs.select("lang", "text").mapInArrow(rows, "lang string, size int, phrase binary, n long, print long")
    found = found.join(doubtful.select("size", "print").distinct(), ["size", "print"], "left_semi")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 64, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, size (words), phrase (binary) and n of all runs of up to ``longest`` words that occur ``least`` times or more.

    The row of size 0 has the number of all words of its language, if there are ``least``. Of
    ``docs`` only lang and text are read; a null lang is ``und``, a null text empty. Repeated
    rows count as often as they come.
    """
    spark = docs.sparkSession
    if not 1 <= longest <= 7:
        raise ValueError("phrases of one to seven words can be counted")
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    last = frequent = materialize(_counted(docs, list(range(min(2, longest) + 1)), longest, None, bits, part_bytes).where(F.col("n") >= least))
    for size in range(3, longest + 1):
        shorter = spark.sparkContext.broadcast(_bit_set(last.where(F.col("place") % 8 == size - 1)))
        last = materialize(_counted(docs, [size], longest, shorter, bits, part_bytes).where(F.col("n") >= least))
        frequent = frequent.unionByName(last)
    told = materialize(_read_back(docs, frequent, bits))
    doubtful = told.where(~F.col("sure"))
    sure = told.where("sure").select("lang", "size", "phrase", "n")
    if doubtful.isEmpty():
        return sure
    return sure.unionByName(_recounted(docs, doubtful, longest, bits, part_bytes).where(F.col("n") >= least))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, keep: int = 2000, inside_percent: int = 50, bits: int = 64, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``keep`` highest-scoring phrases of 2 to ``longest`` words.

    A phrase of a occurrences, cut after its first words into parts with l and r, scores
    floor(1000000 * a * a / (l * r)) at its lowest cut, the earlier one on ties. Dropped are
    phrases inside a longer one that occurs in ``inside_percent`` % of their places or more.
    Order: score, then a, both descending, then the phrase by its UTF-8 bytes. Letters A-Z
    count as lower case; `.,;:!?` and line ends part clauses, which no phrase crosses. An empty table,
    or one without frequent phrases, gives no rows.
    """
    known = materialize(frequent_phrases(docs, longest, least, bits, part_bytes))
    parts = known.where("size > 0").select("lang", "phrase", "n")
    words = F.split(F.col("phrase").cast("string"), " ")
    several = known.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("w"))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ").cast("binary")
    cuts = several.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("a2", (big("a") * big("a")).cast("decimal(31,0)")).withColumn("lr", (big("l") * big("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("(a2 * cast(1000000 as decimal(7,0))) div lr"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")
    # what lies inside a longer phrase: all shorter runs of its words
    inner = several.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ").cast("binary"))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    total = known.where("size = 0").select("lang", F.col("n").alias("total"))
    best = left.withColumn("rank", rank).where(F.col("rank") <= keep).join(total, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
