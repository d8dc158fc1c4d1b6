"""Benchmark decontamination: test n-grams found in training texts.

The windows of the test items form a broadcast hash set. Every document is scanned for
them in two steps. A window of L words contains, at every offset, a run of k = (L + 1) / 2
words that starts at a multiple of k, so a first scan looks up only the runs at such
starts. Documents with any hit are scanned again at every position and compared with the
whole windows as text, which verifies the hits. Everything is DataFrame expressions.

Defined cases: null texts have no words and are never hit; items with a null id or no
words are ignored; equal rows (same id and text) give one result row; rows that share an
id but not a text are kept apart; empty tables give no rows or no hits; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import text as T

WINDOW = 13
#: Benchmark words up to this number are broadcast; more are joined by shuffle.
BROADCAST_WORDS = 4_000_000


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``size`` words, their ``gram`` text and the ``items`` that hold them."""
    items = T.pick(benchmark, item_id=item_id, text=text).filter("item_id is not null")
    items = items.select("item_id", _words().alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    grams = F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("size") + 1),
        lambda i: F.concat_ws(" ", F.slice("words", i, F.col("size"))),
    )
    rows = items.select("item_id", "size", F.explode(grams).alias("gram"))
    return rows.groupBy("size", "gram").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _words() -> Column:
    return T.words(T.ascii_lower(F.coalesce(F.col("text"), F.lit(""))), T.ALNUM_WORD)


def _runs(words: str, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(F.col(words), i + k) for k in range(n)]))


def _windows(words: str, size: int) -> Column:
    """(start, size, text) of all windows of ``size`` words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("start"), F.lit(size).alias("size"),
        F.concat_ws(" ", *[F.get(F.col(words), i + k) for k in range(size)]).alias("gram")))


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
              text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per distinct (``doc_id``, text): ``text_hash``, ``n_words``, ``spans``, ``n_hit``, ``items``.

    ``spans`` are the disjoint word ranges (``start``, ``end`` exclusive) that hits cover.
    """
    small, sizes = _bounded(benchmark, window)
    windows = item_windows(benchmark, window, item_id, "text")
    mark = F.broadcast if small else (lambda df: df)

    docs = T.pick(documents, doc_id=doc_id, text=text)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words().alias("words"))

    # scan 1: aligned runs
    probes, keys = [], []
    for size in sizes:
        n = (size + 1) // 2
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)), F.lit(n))
        probes.append(F.when(F.size("words") >= size, _runs("words", starts, n)).otherwise(F.array().cast("array<bigint>")))
        own = windows.filter(F.col("size") == size).select(F.split("gram", " ").alias("words"))
        keys.append(own.select(F.explode(_runs("words", F.sequence(F.lit(0), F.lit(size - n)), n)).alias("run")))
    if not sizes:
        empty = docs.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words")).distinct()
        return empty.select("*", F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
                            F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<bigint>)").alias("items"))
    runs = keys[0]
    for more in keys[1:]:
        runs = runs.union(more)
    probed = docs.select("doc_id", "text_hash", F.explode(F.concat(*probes)).alias("run"))
    suspects = probed.join(mark(runs.distinct()), "run", "left_semi").select(
        F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash")).distinct()

    # scan 2: every window of the documents found, compared as text
    docs = docs.join(suspects, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left")
    every = F.concat(*[_windows("words", size) for size in sizes])
    scanned = docs.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
        F.explode_outer(F.when(F.col("s_hash").isNotNull(), every)).alias("w"),
    ).select("doc_id", "text_hash", "n_words", "w.start", "w.size", "w.gram")
    found = mark(windows.select(F.col("size").alias("b_size"), F.col("gram").alias("b_gram"), "items"))
    scanned = scanned.join(found, (F.col("gram") == F.col("b_gram")) & (F.col("size") == F.col("b_size")), "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    grouped = scanned.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(hit)).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    merged = F.aggregate("hits", F.expr("cast(array() as array<struct<start:int,end:int>>)"), _merge)
    grouped = grouped.withColumn("spans", F.when(F.size("hits") == 0, F.expr("cast(array() as array<struct<start:int,end:int>>)")).otherwise(merged))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return grouped.select("doc_id", "text_hash", "n_words", "spans", n_hit.alias("n_hit"), "items")


def _merge(spans: Column, hit: Column) -> Column:
    """Append a hit to sorted disjoint spans, or widen the last one."""
    last = F.get(spans, F.size(spans) - 1)
    joins = F.coalesce(hit["start"] <= last["end"], F.lit(False))
    wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], hit["end"]).alias("end"))
    kept = F.when(joins, F.slice(spans, 1, F.size(spans) - 1)).otherwise(spans)
    added = F.when(joins, wider).otherwise(F.struct(hit["start"].alias("start"), hit["end"].alias("end")))
    return F.concat(kept, F.array(added))


def _bounded(benchmark: DataFrame, window: int) -> tuple[bool, list[int]]:
    """Whether the benchmark is small enough to broadcast, and its window lengths (at most ``window``)."""
    items = T.pick(benchmark, item_id="item_id", text="text").filter("item_id is not null")
    n = F.size(_words())
    rows = items.select(n.alias("n")).filter("n > 0").groupBy(F.least("n", F.lit(window)).alias("size")).agg(F.sum("n").alias("n")).collect()
    return sum(r["n"] for r in rows) <= BROADCAST_WORDS, sorted(r["size"] for r in rows)


def contaminated(hits: DataFrame) -> DataFrame:
    """Verdict per document: hit words are at least a twentieth of all words."""
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns and repeats."""
    bad = contaminated(find_hits(documents, benchmark, window, doc_id, text)).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash"))
    ours = documents[doc_id].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(documents[text]) == bad["_bad_hash"])
    return documents.join(bad, ours, "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with hit words left out of ``text``; texts without hits stay as they are.

    A text with hits becomes its remaining words, joined by single spaces.
    """
    hits = find_hits(documents, benchmark, window, doc_id, text).filter("n_hit > 0")
    names = {"id": "_hit_id", "hash": "_hit_hash", "spans": "_hit_spans"}
    while set(names.values()) & set(documents.columns):
        names = {k: f"_{v}" for k, v in names.items()}
    spans = names["spans"]
    hits = hits.select(F.col("doc_id").alias(names["id"]), F.col("text_hash").alias(names["hash"]), F.col("spans").alias(spans))
    ours = documents[doc_id].eqNullSafe(hits[names["id"]]) & (F.xxhash64(documents[text]) == hits[names["hash"]])
    joined = documents.join(hits, ours, "left")
    words = T.words(F.col(f"`{text}`"), T.ALNUM_WORD)
    left = F.filter(words, lambda w, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.when(F.col(spans).isNotNull(), F.concat_ws(" ", left)).otherwise(F.col(f"`{text}`"))
    return joined.withColumn(text, cut).select(*[f"`{c}`" for c in documents.columns])
