"""Corpus pipeline over ``documents``: toxicity, near duplicates, benchmark decontamination, personal
data, packing. Each stage applies one operator of ``fleetcases.llm`` to all that the stage before kept;
its rows are written to the shared folder and read back as the next one's documents.

Every stage handles what its operator's docstring states (nulls, empty and long texts, ties, repeated
rows, empty tables, further columns); all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcases.llm import decontam, near_dedup, packing, pii, queries, toxicity
from fleetcases.llm.common import keyed, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by benchmark passages."""
    hits = decontam.phrase_hits(docs, table(spark, sf_dir, "benchmark"), keys=True)
    bad = hits.filter(decontam.contaminated()).select("did", "th").distinct()
    return keyed(docs).join(bad, ["did", "th"], "left_anti").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences (see ``packing.SCHEMA``)."""
    # the stages before share the executors with this one: keep fewer words in memory
    return packing.pack_examples(docs, queries.vocabulary(), keep_words=150_000)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", redact_personal_data), ("packing", pack)]
#: the first, second and last stage are beyond SQL; tests/llm compares the rows that each stage keeps, the
#: redacted texts and the packed ids of run() with brute-force versions (toxicity with its operator's scores)
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
