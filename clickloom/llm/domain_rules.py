"""Quality rules: fixed text rules, and a hashed n-gram likelihood ratio of two corpora.

The ratio compares two multinomials over hashed unigrams and bigrams: one of trusted
target documents, one of the raw corpus. A document must reach one threshold with its mean
log ratio per n-gram, and another with the mean log ratio of its ``WORST`` worst words, as
a few toxic words do not move the mean of a long text. Words alone have weights of their
own, in which no pairs share the buckets.

Both thresholds come from labelled documents of one fold: the first is the one that gives
most right verdicts on trusted documents and those of low quality, the second on trusted
and toxic ones of good quality. These documents are judged by weights without the trusted documents of
their fold; the weights used for the corpus hold all trusted documents.

Everything is a DataFrame expression. Corpus counts need one pass with a partial aggregate
of at most ``BUCKETS`` rows per task; scoring is a projection without any shuffle, as
the weights are part of the expression.

Defined cases: a null text has no words; a text without words has ratio 0; equal rows
give equal results, one per input row; with no trusted document or no rows at all every
weight is 0, so only the fixed rules decide; without labelled documents of both kinds in
the fold the mean has the threshold ``THRESHOLD`` and the worst words have none; a text of
fewer than ``WORST`` words is judged by all its words; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import text as T

#: Hash buckets of both multinomials.
BUCKETS = 1 << 16
#: Weights are rounded to this fraction and summed as integers, so that no order of
#: addition can move a document over the threshold.
SCALE = 1_000_000
#: Added to the target count of a bucket and to the count expected from the raw corpus,
#: which draws the ratio of rarely seen buckets to 1.
PSEUDO_COUNT = 10
#: Least mean log ratio (nats per n-gram) of a document that is kept, where labels give none.
THRESHOLD = -0.1
#: A text is also judged by so many of its words, those of the lowest ratios.
WORST = 5
#: Trusted and untrusted documents of this fold of ``FOLDS`` give the thresholds, in steps
#: of 1 / ``STEPS`` nat.
FOLDS, THRESHOLD_FOLD, STEPS = 5, 1, 1000
#: Trusted ids up to this number are broadcast; more are joined by shuffle.
BROADCAST_IDS = 4_000_000

SYMBOLS = "#*$%&|<>"
#: The white space between words.
SPACES = " \t\n\v\f\r"
WINDOW = 5


def base_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with word, symbol, line and repetition counts and ``hashes`` of its words.

    A word counts as repeated if it lies in a window of five words that occurs at least
    twice in the text. Windows are compared by their 64-bit hash inside one text.
    """
    docs = T.pick(documents, doc_id=doc_id, text=text)
    has_word = T.WORD.removesuffix("+")
    docs = docs.select("doc_id", "text", pieces(F.col("text")).alias("pieces"))
    docs = docs.select(
        "doc_id",
        hashed("pieces").alias("hashes"),
        # between two pieces is one character
        F.coalesce(F.length("text") - F.size("pieces") + 1, F.lit(0)).cast("long").alias("word_chars"),
        F.coalesce(F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", "")), F.lit(0)).cast("long").alias("n_symbols"),
        F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line: line.rlike(has_word)).alias("lines"),
    )
    docs = docs.select(
        "doc_id", "hashes", "word_chars", "n_symbols",
        F.size("hashes").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        pair_hashes("hashes").alias("pairs"),
    )
    docs = docs.withColumn("windows", window_hashes("hashes", "pairs"))
    return docs.select(
        "doc_id", "hashes", "pairs", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), repeated_words("windows")).otherwise(F.lit(0))
        .cast("long").alias("n_repeat_words"),
    )


def pieces(text: Column) -> Column:
    """What lies between single white space characters, empty pieces included.

    All white space becomes one kind, by which a text is cut without a regular expression.
    """
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(F.coalesce(text, F.lit("")), " ", -1)


def hashed(column: str) -> Column:
    """64-bit hashes of all words among the pieces, in order."""
    return F.transform(F.array_remove(F.col(column), ""), lambda w: F.xxhash64(w))


def shifted(column: str, by: int, lost: int) -> Column:
    """The elements from place ``by`` on; ``lost`` fewer in all than the array has."""
    return F.slice(F.col(column), F.lit(by + 1), F.greatest(F.size(column) - lost, F.lit(0)))


def pair_hashes(hashes: str) -> Column:
    """Hashes of all runs of two words."""
    return F.zip_with(shifted(hashes, 0, 1), shifted(hashes, 1, 1), lambda a, b: F.xxhash64(a, b))


def window_hashes(hashes: str, pairs: str) -> Column:
    """Hashes of all runs of ``WINDOW`` = 5 words: of two pairs and a word."""
    fours = F.zip_with(shifted(pairs, 0, 2), shifted(pairs, 2, 2), lambda a, b: F.xxhash64(a, b))
    # one four fewer: the last has no word after it
    return F.transform(F.array(fours), lambda four: F.zip_with(
        F.slice(four, F.lit(1), F.greatest(F.size(four) - 1, F.lit(0))), shifted(hashes, WINDOW - 1, WINDOW - 1), lambda a, b: F.xxhash64(a, b)))[0]


def repeated_words(windows: str) -> Column:
    """Words inside the windows that occur twice or more.

    Sorting (hash, start) puts equal windows side by side; the covered words follow from
    the distances of the sorted starts.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one-element array and transform: the sorted array is computed once, then used in the lambda
    starts = F.transform(F.array(placed), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
                 | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))),
        lambda x: x["i"])))
    covered = F.transform(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x))
    return F.get(covered, F.lit(0))


def features(hashes: str, pairs: str, buckets: int = BUCKETS) -> Column:
    """Hash buckets of all words; those of pairs come after them, ``buckets`` higher."""
    one = F.transform(F.col(hashes), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(F.col(pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int") + F.lit(buckets))
    return F.concat(one, two)


class Rules(NamedTuple):
    """Scaled weights of all n-grams and of words alone, and their thresholds in nats."""

    weights: list[int]
    word_weights: list[int]
    threshold: float = THRESHOLD
    word_threshold: float | None = None


def judged_ids(labels: DataFrame) -> DataFrame:
    """``doc_id``, least ``quality`` and greatest ``toxic`` of all its labels; null ids do not count."""
    rows = T.pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").filter("doc_id is not null")
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids all of whose labels say good quality and not toxic; null ids and labels do not count."""
    return judged_ids(labels).filter("quality = 1 and toxic = 0").select("doc_id")


def count_grams(documents: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                buckets: int = BUCKETS) -> dict[str, np.ndarray]:
    """How often n-grams fall in each bucket: in all documents (``raw``), in trusted ones
    (``target``) and in trusted ones outside ``THRESHOLD_FOLD`` (``unseen``); words alone
    under the same names with ``word_``.

    Counts cover every n-gram of every document. At most six times ``buckets`` rows reach the driver.
    """
    docs = T.pick(documents, doc_id=doc_id, text=text)
    ids = T.broadcast_within(trusted.select(F.col("doc_id").alias("trusted_id")), BROADCAST_IDS)
    docs = docs.join(ids, docs["doc_id"] == ids["trusted_id"], "left")
    # 0 for all others, 1 for trusted documents of the fold, 2 for other trusted ones
    kind = F.when(F.col("trusted_id").isNull(), 0).when(T.fold(F.col("doc_id"), FOLDS) == THRESHOLD_FOLD, 1).otherwise(2)
    docs = docs.select(kind.alias("kind"), pieces(F.col("text")).alias("pieces")).select("kind", hashed("pieces").alias("hashes"))
    docs = docs.select("kind", "hashes", pair_hashes("hashes").alias("pairs"))
    grams = docs.select("kind", F.explode(features("hashes", "pairs", buckets)).alias("bucket"))
    # one plain count for each kind and bucket
    coded = grams.select((F.col("kind") * (2 * buckets) + F.col("bucket")).alias("code"))
    rows = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).toArrow()
    found = np.zeros(6 * buckets, dtype=np.int64)
    found[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    words, pairs = np.moveaxis(found.reshape(3, 2, buckets), 1, 0)
    out = {}
    for name, counted in (("", words + pairs), ("word_", words)):
        out |= {f"{name}raw": counted.sum(axis=0), f"{name}target": counted[1:].sum(axis=0), f"{name}unseen": counted[2]}
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> list[int]:
    """Scaled log ratio of trusted-target to raw-corpus probability for every bucket.

    Both multinomials are smoothed at the size of the target, so their totals cancel.
    """
    if not target.sum():
        return [0] * len(target)
    expected = raw * int(target.sum()) / int(raw.sum())
    return np.rint(SCALE * np.log((target + PSEUDO_COUNT) / (expected + PSEUDO_COUNT))).astype(np.int64).tolist()


def fit_weights(documents: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                buckets: int = BUCKETS) -> list[int]:
    """Scaled log ratios of the buckets of all n-grams."""
    counts = count_grams(documents, trusted, doc_id, text, buckets)
    return log_ratios(counts["target"], counts["raw"])


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> Rules:
    """Weights from all trusted documents, and thresholds from the labelled ones of ``THRESHOLD_FOLD``."""
    counts = count_grams(documents, trusted_ids(labels), doc_id, text, buckets)
    unseen = Rules(log_ratios(counts["unseen"], counts["raw"]), log_ratios(counts["word_unseen"], counts["word_raw"]))
    threshold, word_threshold = thresholds(documents, labels, unseen, doc_id, text)
    return Rules(
        log_ratios(counts["target"], counts["raw"]), log_ratios(counts["word_target"], counts["word_raw"]),
        THRESHOLD if threshold is None else threshold, word_threshold)


def thresholds(documents: DataFrame, labels: DataFrame, unseen: Rules, doc_id: str = "doc_id", text: str = "text") -> tuple[float | None, float | None]:
    """Thresholds of the mean and of the worst words, by weights that have not seen the fold.

    Only counts of documents by steps of the ratios reach the driver.
    """
    judged = judged_ids(labels).filter(T.fold(F.col("doc_id"), FOLDS) == THRESHOLD_FOLD).withColumnRenamed("doc_id", "judged_id")
    judged = T.broadcast_within(judged, BROADCAST_IDS)
    docs = T.pick(documents, doc_id=doc_id, text=text)
    docs = docs.join(judged.select("judged_id"), F.col("doc_id") == F.col("judged_id"), "left_semi")
    scores = apply_rules(docs, unseen.weights, word_weights=unseen.word_weights)
    scores = scores.join(judged, F.col("doc_id") == F.col("judged_id"))
    kinds = [("mean", "log_ratio", F.col("quality") == 0), ("worst", "worst_ratio", (F.col("quality") == 1) & (F.col("toxic") == 1))]
    # counted under a condition: a filter would move below the words and extract them again in every lambda
    scores = scores.select(
        "base_failed", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.floor(F.col(c) * STEPS).alias("step"), bad.alias("bad")) for k, c, bad in kinds])).alias("s"))
    rows = scores.groupBy("s.kind", "s.step").agg(
        F.count_if(F.col("trusted") & ~F.col("base_failed")).alias("trusted"), F.count_if(F.col("s.bad") & ~F.col("base_failed")).alias("bad")).collect()
    found = [best_step([(r["step"], r["trusted"], r["bad"]) for r in rows if r["kind"] == k]) for k, _, _ in kinds]
    mean, worst = [None if step is None else step / STEPS for step in found]
    return mean, worst


def best_step(counts: list[tuple[int, int, int]]) -> int | None:
    """The step below which bad documents outnumber trusted ones the most; the lowest of equals."""
    if not any(t for _, t, _ in counts):
        return None
    best, most, gain = None, 0, 0
    for step, trusted, bad in sorted(counts):
        gain += bad - trusted
        if gain > most:
            best, most = step + 1, gain
    return best


def apply_rules(documents: DataFrame, weights: list[int], threshold: float = THRESHOLD, doc_id: str = "doc_id",
                text: str = "text", word_weights: list[int] | None = None, word_threshold: float | None = None) -> DataFrame:
    """Base statistics, ``log_ratio`` (nats per n-gram), ``worst_ratio`` (nats per word), ``base_failed`` and ``kept`` per document.

    Without ``word_weights`` the worst words are not judged, and ``worst_ratio`` is 0.
    """
    docs = base_statistics(documents, doc_id, text)
    buckets = len(weights)
    table = lookup(weights)

    def weight(h: Column) -> Column:
        return F.get(table, F.pmod(h, F.lit(buckets)).cast("int"))

    zero = F.lit(0).cast("bigint")
    docs = docs.withColumn("total", F.aggregate("hashes", zero, lambda s, h: s + weight(h)) + F.aggregate("pairs", zero, lambda s, h: s + weight(h)))
    low = zero
    if word_weights is not None:
        word_table = lookup(word_weights)
        ratios = F.transform("hashes", lambda h: F.get(word_table, F.pmod(h, F.lit(buckets)).cast("int")))
        low = F.aggregate(F.slice(F.sort_array(ratios), 1, WORST), low, lambda s, w: s + w)
    docs = docs.withColumn("low", low)
    n, n_low = F.size("hashes") + F.size("pairs"), F.least(F.size("hashes"), F.lit(WORST))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.col("total") >= n * F.lit(round(threshold * SCALE)).cast("bigint"))
    if word_threshold is not None:
        kept = kept & (F.col("low") >= n_low * F.lit(round(word_threshold * SCALE)).cast("bigint"))
    return docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"),
        F.when(n > 0, F.col("total") / n / SCALE).otherwise(F.lit(0.0)).alias("log_ratio"),
        F.when(n > 0, F.col("low") / n_low / SCALE).otherwise(F.lit(0.0)).alias("worst_ratio"),
    )


def lookup(weights: list[int]) -> Column:
    """The weights as an array; their text is folded into one literal when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
