"""The registered queries of this subpackage: an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatledger.llm import (
    conversation_repair,
    decontaminate,
    epsilon_grid,
    hard_negatives,
    html_extract,
    jaccard_join,
    language_id,
    lm_scoring,
    mixing,
    secret_scan,
    substring_dedup,
    url_filter,
    warc,
)
from chatledger.llm.common import Scratch, ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by five-word shingles, similarity 0.75."""
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), percent=75)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat, with their clusters and what is kept."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), percent=75)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by rules, else by the list of unwanted URLs of the crawl."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.unwanted_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 13-word benchmark windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated"
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of the sources by weight takes."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return epsilon_grid.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.95)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, single ones and parts of linked credentials."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *secret_scan.digest(found))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, as read back from them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = Scratch(spark, "warc-archives").write(warc.write_archives(pages), "archives")
    found = warc.read_archives(archives, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after checksums have damaged its rows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = conversation_repair.repair(rows, conversation_repair.damage(rows))
    known = report.unionByName(conversation_repair.digests(repaired), allowMissingColumns=True)
    columns = [c for c in report.columns if c != "conv_id"]
    digest = F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256))
    return known.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns], digest.alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after some labels were moved on by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learned from those outside the held-out fold."""
    return lm_scoring.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_source_mixing": op6_source_mixing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_html_extraction": op9_html_extraction,
    "op10_warc_archives": op10_warc_archives,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lm_scoring": op13_lm_scoring,
}
#: DuckDB SQL where SQL can express the operator; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_join.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op6_source_mixing": mixing.oracle(),
    "op7_embedding_near_dedup": epsilon_grid.ORACLE,
    "op10_warc_archives": warc.ORACLE,
    "op11_conversation_repair": conversation_repair.oracle(),
    "op12_hard_negatives": hard_negatives.ORACLE,
}
