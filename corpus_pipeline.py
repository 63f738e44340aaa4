"""From raw documents to packed token sequences: line rules, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Run
one after another, each is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import prepare, read, settle
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.line_rules import clean_lines
from textloom.llm.mixing import mix, repeated
from textloom.llm.near_dedup import near_dedup
from textloom.llm.packing import pack

#: No SQL: near dedup by sketches, packing and the tokenizer have no SQL form. Tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that fail; n_chars follows a text that lost lines."""
    prepare(spark)
    out = clean_lines(docs).where("kept")
    changed = ~F.col("text").eqNullSafe(F.col("clean_text"))
    sized = {"n_chars": F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.withColumns(sized).withColumn("text", F.col("clean_text")).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id."""
    return exact_dedup(docs).where("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles: the least doc_id."""
    prepare(spark)
    return near_dedup(docs, words=5, num=4, den=5).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling to the sources' targets takes it."""
    return repeated(mix(docs)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document that the mix repeats is packed as often."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what stands between two stages is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
