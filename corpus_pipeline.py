"""A corpus pipeline over ``documents``: five stages, each applied to all that its predecessor kept.

What holds for all stages: empty tables give empty tables; ids may be null and
repeat, and rows that repeat are documents of their own but for ``near_dedup``;
extra columns are carried, whatever their names; very long texts are worked on
whole, by one task each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, langid, minhash, packing, substring
from sparkloom.llm.queries import table
from sparkloom.llm.scratch import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents whose language is less probable than this are rejected, with those that have no letter.
MIN_LANGUAGE_SCORE = 0.5
#: Near copies are texts whose sets of word shingles have a similarity of 0.8 or more. All bands
#: miss a pair at 0.8 with a probability of about 3e-7.
NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 80, 50, 6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a recognisable language; the model learns from the stage's own labelled rows.

    Null and empty texts go; of equally probable languages the first by name
    counts; without any labelled row all documents go.
    """
    got = langid.identify(docs, langid.fit(docs))
    return got.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the least id.

    Rows that repeat leave one; rows with a null id or without words all stay.
    """
    return minhash.keep_one(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat; a document of which nothing is left goes.

    All occurrences are cut, the first as well, and n_chars follows the text.
    Null and empty texts go.
    """
    cut = substring.remove_repeats(docs)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", chars).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, edited ones included; null and empty texts hold none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a null or empty text is one piece, its end."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A language model, alignments and a packing search are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
