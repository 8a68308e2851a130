"""Quality rules: plain counts per text, and a hashed n-gram likelihood ratio.

Each text is scored by the mean log ratio of its hashed words and word pairs under two
multinomials: one counted over trusted documents, one over all documents. Everything is
built-in functions; texts are never shuffled, and the counts per text stay in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialize

#: Buckets of the hashed n-grams; the table of their weights has this many rows at most.
BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is counted over, at most.
MAX_TRUSTED = 20_000
#: Pseudo-count of each bucket, and n-grams of weight zero that each text is given besides its own.
SMOOTHING, PRIOR_NGRAMS = 1.0, 20
#: Share of the trusted documents that the derived cut may reject, each scored by weights that
#: its own fold of them had no part in, as a document without a label is.
QUANTILE, FOLDS = 0.01, 5
#: Mean log ratio below which a text is rejected where no trusted document tells the cut.
THRESHOLD = -0.15
_SCALE = 1_000_000
#: Steps of the score, in millionths, by which the cut is found.
_STEP = 10
SPACE = "[\\x20\\x09-\\x0D]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Only a text with two equal ones is looked at
    further: its windows are sorted by hash, those next to an equal one are kept, and the gaps
    between their places, up to ``width``, add up to what they cover.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))

    def places(s: Column) -> Column:
        equal = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, equal), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(ordered, lambda s: _let(places(s), covered)))

    return F.when(F.size(words) < width + 1, 0).otherwise(_let(windows, count)).cast("long")


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbours."""
    bucket = lambda *w: F.pmod(F.xxhash64(*w), F.lit(buckets)).cast("int")
    pairs = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.transform(words, lambda w: bucket(w)), F.transform(pairs, lambda w, i: bucket(w, F.get(words, i + 1))))


def _fold() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """bucket, weight: log ratio of its smoothed share in trusted texts to that in all, in millionths;
    held: the same without the trusted texts of each fold.

    ``trusted(doc_id)`` names the trusted documents; of more than ``max_trusted``, those with
    the smallest hashes are used (8 bytes each, so they can be broadcast). All documents
    count towards the corpus.
    """
    names = F.broadcast(trusted.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("target", F.lit(1)))
    grams = (docs.select("doc_id", words_of(F.col("text")).alias("words")).join(names, "doc_id", "left")
             .select(F.coalesce("target", F.lit(0)).alias("target"), _fold().alias("fold"), F.explode(ngram_buckets(F.col("words"), buckets)).alias("bucket")))
    counts = materialize(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"),
                                                          *[F.sum(F.when(F.col("fold") == k, F.col("target")).otherwise(0)).alias(f"own{k}") for k in range(FOLDS)]))
    total = counts.agg(F.sum("target").alias("t"), F.sum("raw").alias("r"), *[F.sum(f"own{k}").alias(f"own{k}") for k in range(FOLDS)]).first()

    def weight(target: Column, n: int) -> Column:
        share = n / max(total["r"] or 0, 1)
        return F.round(F.log((target + SMOOTHING) / (F.col("raw") * F.lit(share) + SMOOTHING)) * _SCALE).cast("long")

    held = [weight(F.col("target") - F.col(f"own{k}"), (total["t"] or 0) - (total[f"own{k}"] or 0)) for k in range(FOLDS)]
    return counts.select("bucket", weight(F.col("target"), total["t"] or 0).alias("weight"), F.array(*held).alias("held"))


def trusted_cut(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> float:
    """The score below which a share of ``quantile`` of the trusted documents lie, at most.

    All trusted documents of ``scored(doc_id, base_failed, held)`` that pass the base rules
    count. Only how many there are at each step of the score reaches the driver.
    """
    steps = (scored.where(~F.col("base_failed")).select("doc_id", F.floor(F.col("held") * (_SCALE / _STEP)).alias("step"))
             .join(trusted.select("doc_id").dropna().distinct(), "doc_id", "left_semi").groupBy("step").agg(F.count(F.lit(1)).alias("n")))
    rows = sorted(map(tuple, steps.collect()))
    may_go = quantile * sum(n for _, n in rows)
    below = 0
    for step, n in rows:
        below += n
        if below > may_go:
            return step * _STEP / _SCALE
    return THRESHOLD


def judge(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED,
          min_words: int = 20, max_repeat_percent: int = 30, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its counts and verdict.

    Columns: doc_id, key (hash of doc_id and text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (under ``min_words`` words, or over ``max_repeat_percent`` % of them in repeated windows),
    score (mean weight of the n-grams, with ``PRIOR_NGRAMS`` of weight zero so that short texts
    need more evidence) and kept (not base_failed, and score at least ``threshold``; without one,
    at least the ``trusted_cut`` at ``quantile``). A null text has no words. Without trusted documents all weights are zero. Repeated rows are
    judged each; a table without rows gives none.

    The weights are broadcast: ``buckets`` rows at most, whatever the corpus. They are whole
    numbers, so a score does not depend on the order of adding.
    """
    weights = F.broadcast(bucket_weights(docs, trusted, buckets, max_trusted))
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), text.alias("text"), words_of(F.col("text")).alias("words"))
    counted = words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "key", _fold().alias("fold"), F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), ngram_buckets(F.col("words"), buckets).alias("grams"))
    base = ["doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = (counted.select("row", "fold", *base, F.explode_outer("grams").alias("bucket")).join(weights, "bucket", "left")
              .groupBy("row").agg(*[F.first(c).alias(c) for c in base], F.coalesce(F.sum("weight"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.get("held", F.col("fold"))), F.lit(0)).alias("held"), F.count("bucket").alias("n")))
    scored = scored.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    mean = lambda total: F.col(total) / (F.col("n") + PRIOR_NGRAMS) / _SCALE
    scored = scored.select(*base, "base_failed", mean("total").alias("score"), mean("held").alias("held"))
    if threshold is None:
        scored = materialize(scored)
        threshold = trusted_cut(scored, trusted, quantile)
    return scored.select(*base, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))


def keep_good(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns kept."""
    good = judge(docs, trusted, **options).where("kept").select(F.col("key").alias("_key")).distinct()
    return docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(good, "_key", "left_semi").drop("_key")
