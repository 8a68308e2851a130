"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the hashed letter n-grams of its words. A model averages the features'
embeddings and puts a linear softmax on top, trained by stochastic gradient descent in numpy
on a bounded sample of labelled documents; its temperature is fitted on the part of the
sample that the descent has not seen. As embedding, averaging and the linear layer are all
linear, prediction adds up one small vector per word, which workers remember.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import Memo, binaries, slices

UNKNOWN = "und"
#: Hash buckets, embedding size and n-gram lengths.
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 13, 16, 1, 4
#: Labelled documents that the model is fitted on, and languages it can learn, at most.
SAMPLE_DOCS, MAX_LANGUAGES = 2000, 200
#: Probability of the best language below which ``rejected`` is set.
REJECT_BELOW = 0.5
#: Runs of letters.
_RUNS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the word and the bucket of every n-gram.

    N-grams are bytes of the runs of letters in lower case, each run between ``<`` and ``>``;
    none reaches into the next run.
    """
    marked = ["".join(f"<{r}>" for r in _RUNS.findall(w.decode("utf-8", "replace").lower())).encode() for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(m) for m in marked])
    stops = np.flatnonzero(data == ord(">"))
    left = stops[np.searchsorted(stops, np.arange(len(data)))] - np.arange(len(data)) + 1 if len(stops) else np.zeros(0, np.int64)
    out, h = [], np.zeros(len(data), np.uint64)
    for n in range(1, LONGEST + 1):
        h = h[:len(data) - n + 1] * np.uint64(257) + data[n - 1:]
        if n >= SHORTEST:
            whole = left[:len(h)] >= n
            out.append((owner[:len(h)][whole], ((h[whole] * _MIX + np.uint64(n)) * _MIX >> np.uint64(40)).astype(np.int64) % BUCKETS))
    return out


@dataclass
class Model:
    languages: list[str]
    #: Contribution of each bucket to the score of each language, before averaging.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float


def _bag(words: list[bytes]) -> np.ndarray:
    x = sum(np.bincount(b, minlength=BUCKETS) for _, b in ngrams(words)).astype(np.float32)
    return x / max(x.sum(), 1)


def fit(texts: list[str], langs: list[str], least_steps: int = 1500, batch: int = 64, rate: float = 0.5, seed: int = 1) -> Model:
    """Train on whole texts and on stretches of them, so that short texts are known too."""
    languages = sorted(set(langs))
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0)
    rng = np.random.default_rng(seed)
    held = rng.random(len(texts)) < 0.15
    rows: dict[bool, list] = {False: [], True: []}
    for text, lang, h in zip(texts, langs, held):
        words = text.encode().split()
        n = min(len(words), int(rng.integers(1, 13)))
        at = int(rng.integers(0, len(words) - n + 1)) if words else 0
        y = languages.index(lang)
        rows[bool(h)] += [(_bag(words), y), (_bag(words[at:at + n]), y)]
    pick = lambda part: (np.stack([x for x, _ in part]), np.array([y for _, y in part]))
    x, y = pick(rows[False] or rows[True])
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    per_epoch = -(-len(x) // batch)
    epochs = max(10, -(-least_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            b = order[i:i + batch]
            hidden = x[b] @ embed
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p /= len(b)
            pace = rate * (1 - step / steps) + 0.01
            grad_hidden = p @ out.T
            out -= pace * hidden.T @ p
            bias -= pace * 0.1 * p.sum(axis=0)
            embed -= pace * 50 * (x[b].T @ grad_hidden)
            step += 1
    logits = (embed @ out).astype(np.float64)
    xh, yh = pick(rows[True] or rows[False])
    z = xh @ logits + bias
    losses = []
    grid = np.geomspace(0.1, 10, 41)
    for t in grid:
        s = z / t
        m = s.max(axis=1)
        losses.append(float((m + np.log(np.exp(s - m[:, None]).sum(axis=1)) - s[np.arange(len(yh)), yh]).mean()))
    return Model(languages, logits, bias.astype(np.float64), float(grid[int(np.argmin(losses))]))


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``; rows without text or language are left out.

    Each language gives about the same number of documents, those with the smallest hashes of
    their doc_id, ``sample_docs`` in all; of more than ``max_languages`` the most frequent are
    learned. Only this sample reaches the driver.
    """
    rows = labelled.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    each = sample_docs / len(counts)
    spin = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(each / n))])
    drawn = rows.select("text", "lang", spin.alias("spin"), "doc_id").where(F.col("spin") < share[F.col("lang")] * (1 << 30))
    sample = drawn.orderBy("spin", "doc_id", "text").limit(2 * sample_docs).collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


class _Scorer:
    """A worker's memo of what words add to the scores: one row of bytes per word."""

    def __init__(self, model: Model):
        self.model = model
        self.memo = Memo(self._words)

    def _words(self, words: list[bytes]) -> list[bytes]:
        sums = np.zeros((len(words), len(self.model.languages) + 1))
        for owner, bucket in ngrams(words):
            if len(owner):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                sums[owner[first], :-1] += np.add.reduceat(self.model.logits[bucket], first, axis=0)
                sums[:, -1] += np.bincount(owner, minlength=len(words))
        return [row.tobytes() for row in sums]

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        m = self.model
        rows = np.frombuffer(b"".join(self.memo.values(text.split())), np.float64).reshape(-1, len(m.languages) + 1)
        total = rows.sum(axis=0)
        if not total[-1] or not m.languages:
            return UNKNOWN, 0.0, True
        z = (total[:-1] / total[-1] + m.bias) / m.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return m.languages[best], float(p[best]), bool(p[best] < REJECT_BELOW)


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced.

    Only the text is looked at. A null text, or one without a letter, is ``und`` with score 0
    and rejected, and so is every text if nothing was learned. ``score`` is the calibrated
    probability of the prediction. One row per row.
    """
    carried = docs.drop("lang_pred", "score", "rejected")
    names = [*carried.columns, "lang_pred", "score", "rejected"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [scorer.predict(t) for t in binaries(part, "text")]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.float64(), pa.bool_())))], names)

    return carried.mapInArrow(rows, StructType([*carried.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of ``docs(doc_id, text)``, as ``annotate`` gives them."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
