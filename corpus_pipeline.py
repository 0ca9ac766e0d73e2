"""The training-data pipeline: ``STAGES`` applied to ``documents`` one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from chatledger.llm import decontaminate, jaccard_join, language_id, mixing, secret_scan
from chatledger.llm.common import Scratch, ready

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A text whose language has a smaller share of its letters is rejected.
LEAST_SCORE = 1 / 3
#: So is a text with a smaller share of its letters in scripts of learned languages.
LEAST_SCRIPT = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mainly in one language that the labelled documents teach; those
    without letters, null texts among them, those in which no language has a third and
    those mostly in scripts that no learned language uses go."""
    fold = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~F.coalesce(fold, F.lit(False))).select("text", "lang"))
    found = language_id.identify(docs, model)
    kept = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("script_share") >= LEAST_SCRIPT)
    return found.where(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at 0.75, the one with the smallest doc_id.
    Rows that repeat a doc_id and a text are one document, the least row of them; other
    texts of a doc_id are documents of their own.  Rows without a doc_id all stay."""
    columns = docs.columns
    least = F.min(F.struct(*[F.col(c) for c in columns if c != "text"], "text")).alias("row_")
    named = docs.where("doc_id IS NOT NULL")
    sums = named.select("doc_id", F.xxhash64("text").alias("sum_")).groupBy("doc_id")
    if sums.agg(F.min("sum_").alias("a"), F.max("sum_").alias("b")).where("a != b").isEmpty():
        found = jaccard_join.jaccard_components(docs, percent=75)
        kept = found.where("doc_id = component_id").select("doc_id").distinct()
        named = named.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(least)
        return docs.where("doc_id IS NULL").union(named.select(*[f"row_.{c}" for c in columns]))
    # Some doc_id has several texts: texts are numbered, and components are those of numbers.
    scratch = Scratch(spark, "near-duplicates")
    texts = named.groupBy("doc_id", "text").agg(least).withColumn("number_", F.monotonically_increasing_id())
    texts = scratch.write(texts.select("number_", "row_"), "texts")
    found = jaccard_join.jaccard_components(texts.select(F.col("number_").alias("doc_id"), "row_.text"), percent=75)
    found = found.select(F.col("doc_id").alias("number_"), "component_id")
    place = F.struct("row_.doc_id", F.xxhash64("row_.text"), "number_")
    kept = texts.select("number_", place.alias("place_")).join(found, "number_").groupBy("component_id")
    kept = kept.agg(F.min("place_").alias("place_")).select("place_.number_")
    named = texts.join(kept, "number_", "left_semi").select(*[f"row_.{c}" for c in columns])
    return docs.where("doc_id IS NULL").union(named)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, benchmark)
    return found.where("NOT contaminated").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for every secret; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    length = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes words of, with how many it takes (``taken``)."""
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix(sized).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
]
#: SQL has no word for the trained language model of the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written to the shared folder and read by the next."""
    scratch = Scratch(ready(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        kept = scratch.write(stage(spark, docs, sf_dir), name)
        if number:
            scratch.drop(docs)
        docs = kept
    return docs
