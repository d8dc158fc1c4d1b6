"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import chat_format, ctw, decontaminate, domain_rules, feistel, heap_kmeans, metric_join, mil_quality, paragraph_dedup, simhash, source_mix, token_align, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mil_quality.score(documents, mil_quality.fit(documents, table(spark, sf_dir, "labels")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    size = source_mix.word_count(F.col("text"))
    rows = documents.select(
        F.struct("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).alias("row"),
        "source", size.alias("size"), source_mix.order_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    placed = source_mix.place(rows)
    taken = (F.col("size") * F.size("placements")).alias("taken")
    shards = F.concat_ws(",", F.transform("placements", lambda take: take["shard"].cast("string"))).alias("mix_shards")
    return placed.select("row.doc_id", "size", "source_size", "target", taken, shards)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contaminated(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    ids = F.concat_ws(",", F.sort_array(F.transform("items", lambda i: i.cast("string"))))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.find_repeats(table(spark, sf_dir, "documents"))


#: The contract's conversation -1, in the message layout.
CONTROL_RECORD = (
    '{"id": -1, "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, '
    '{"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}'
)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_row = chat_format.to_turns(table(spark, sf_dir, "conversations"))
    by_record = chat_format.json_to_turns(spark.createDataFrame([(CONTROL_RECORD,)], "record string")).drop("layout")
    return chat_format.read_back(chat_format.format_turns(by_row.unionByName(by_record)))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.lookup(warc.write_archive(pages), pages.select(warc.url_key(F.col("url")).alias("url_key"), "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = domain_rules.fit(documents, table(spark, sf_dir, "labels"))
    return domain_rules.apply_rules(
        documents, rules.weights, rules.threshold, word_weights=rules.word_weights, word_threshold=rules.word_threshold)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"),
    )
    placed = feistel.shard_rows(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.score(table(spark, sf_dir, "documents"))


def op12_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_kmeans.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_warc": op7_warc,
    "op8_context_tree": op8_context_tree,
    "op9_quality_rules": op9_quality_rules,
    "op10_shard": op10_shard,
    "op11_token_align": op11_token_align,
    "op12_metric_join": op12_metric_join,
    "op13_heap_kmeans": op13_heap_kmeans,
}
