"""The corpus operators as queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, importance, language_id, media, minhash, mixing, nbsvm, packing, phrases, quality_rules, sharding, sql, suffix_dedup, url_filter
from .common import Scratch, spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(_table(spark, sf_dir, name))


def op1_size_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies after two arrivals, short texts and long ones, and full compaction: its shard as the newest manifest has
    it, and a checksum of the text read from there.
    """
    docs = _table(spark, sf_dir, "documents")
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2048
    store, version = sharding.shard_documents([docs.where(short), docs.where(~short)], Scratch(spark, "shards").path("store"))
    rows = store.read(version)
    if rows.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_bytes long, text_crc32 long, shard string, shard_bytes long, shard_rows long, tier int, version long")
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.col("_metadata.file_path").alias("path"))
    live = store.manifest(version).select("path", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "tier")
    shard = F.regexp_extract("path", r"/shards/(.*)$", 1)
    return rows.join(live, "path").select("doc_id", "n_bytes", "text_crc32", shard.alias("shard"), "shard_bytes", "shard_rows", "tier", F.lit(version).cast("long").alias("version"))


def op2_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_quality(_texts(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_texts(spark, sf_dir), params=minhash.NearDupParams(shingle=4))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_texts(spark, sf_dir))


def op5_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_texts(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = language_id.fit_language_filter(docs.where(~language_id.held_out("doc_id")))
    found = language_id.identify_languages(docs, model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_texts(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_texts(spark, sf_dir))


def op9_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    model = nbsvm.train_quality(docs, _table(spark, sf_dir, "labels"))
    scored = nbsvm.score_quality(docs, model)
    return scored.select("doc_id", nbsvm.held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(_texts(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


#: Rules of the query: verdict, host and path.
URL_RULES = [url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"), url_filter.Rule("block", "example.com/de/"), url_filter.Rule("allow", "org/fr/")]


def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the document whose number its path has: bad if labelled of low quality or toxic."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "^/[^/]+/([0-9]{1,18})", 1).try_cast("long")
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages"), labels, number, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_size_tiered_sharding, op2_repetition_quality, op3_minhash_near_dedup, op4_best_fit_packing, op5_consensus_html, op6_language_id, op7_fair_queue_mixing, op8_suffix_array_dedup, op9_nbsvm_quality, op10_media_sequences, op11_phrase_collocations, op12_url_reputation, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op2_repetition_quality": sql.OP2, "op3_minhash_near_dedup": sql.OP3, "op7_fair_queue_mixing": sql.OP7, "op8_suffix_array_dedup": sql.OP8, "op11_phrase_collocations": sql.OP11, "op12_url_reputation": sql.op12(url_filter.Reputation.suffixes, url_filter.Reputation.limit, url_filter.Reputation.z), "op13_importance_resampling": sql.OP13}
