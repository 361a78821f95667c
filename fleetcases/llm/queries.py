"""Thin queries over the operators of this subpackage, by name; their SQL is in ``sql``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcases.llm import (decontam, fixity, language, mixing, near_dedup, packing, periodic, pii, quality,
                            substring_dedup, suffix_dedup, toxicity, whitening)
from fleetcases.llm.common import table
from fleetcases.llm.sql import ORACLE_SQL  # noqa: F401  (read beside QUERIES)


def vocabulary() -> str:
    """Path of the tokenizer's vocabulary: $FLEETCASES_VOCABULARY, else the installed public one."""
    if path := os.environ.get("FLEETCASES_VOCABULARY"):
        return path
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_examples(table(spark, sf_dir, "documents"), vocabulary())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.phrase_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      decontam.contaminated().alias("contaminated"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages`` with faults told by the first digits of a hash of the url:
    bytes changed, records lost, records that were never written."""
    digits = F.substring(F.md5(F.col("url")), 1, 2)
    html = F.when(digits == "00", F.concat(F.col("html"), F.lit("\u0000"))).otherwise(F.col("html"))
    kept = pages.filter(F.coalesce(digits != "01", F.lit(True)))
    ghost = pages.filter(digits == "02").select("page_id", "url", F.lit("").alias("html"))
    return kept.select("page_id", "url", html.alias("html")).unionByName(ghost)


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(pages, damaged(pages))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != pii.FOUND_KIND)

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.span_lists(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts (told by a checksum of the id) with a loop: from word a
    on, their p words from a are said again and again up to the text's number of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    split = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(mixing.WORD), F.lit(0))).alias("words"))
    n = F.size("words").cast("long")
    a = F.col("g") % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8)).cast("long")
    loop = F.slice("words", (a + 1).cast("int"), p.cast("int"))
    tail = F.flatten(F.array_repeat(loop, F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")
    return split.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.periodic_runs(looped(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # runs come by start and period, so the first of equal exponents stays
    best = F.aggregate("runs", none, lambda x, r: F.when(
        x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return (got.withColumn("best", best).withColumn("listed", listed)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_near_dedup, op4_toxicity, op5_packing,
                                   op6_decontamination, op7_warc_fixity, op8_substring_dedup, op9_quality, op10_pii,
                                   op11_embedding_whitening, op12_periodic_runs, op13_source_mixing)}
