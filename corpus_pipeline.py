"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and decides on its own input. All but the last return the columns of
``documents``; the last adds the token counts and digests. Empty tables pass through empty; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import bpe, decontaminate, jaccard, langid, substring_dedup
from spindle.llm.common import table
from spindle.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Dictionaries come from the labelled documents of this input (a bounded sample).
    NULL, empty and letterless texts and narrow margins go, and rows without an id, which no later result could name."""
    docs = docs.select(*COLUMNS).where("doc_id IS NOT NULL")
    dicts = langid.dictionaries(langid.sample(docs))
    return langid.identify(docs, dicts).where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the smallest id.
    Of repeated rows one stays; documents without words are no one's duplicate."""
    comp = jaccard.jaccard_components(docs, k=5, num=80)
    stay = comp.where("component_id = doc_id").select("doc_id")
    return docs.select(*COLUMNS).join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that occur earlier (whole characters go); documents left without a word go."""
    out = substring_dedup.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    out = out.withColumn("text", text).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    docs = docs.select(*COLUMNS)
    leaks = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark"), short=True).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``n_tokens`` and the digests of their token ids and of the text decoded from them."""
    return bpe.round_trip(docs.select(*COLUMNS))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings),
          ("decontamination", decontamination), ("bpe", tokens)]

#: Compression, suffix sorting and merges have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
