"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages go, contaminated documents go, the rest is packed.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, with the columns of documents, and works
on all of docs. `run` writes every stage's result to the shared folder and reads it again for the next, so a lost executor
costs one stage's tasks at most; then it deletes what the stage before left there.

In all stages null and empty texts are texts without words, rows with a null or a repeated doc_id are rows of their own (the
docstrings of the operators say what becomes of them), columns of any other name pass through, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barwright.llm import decontamination, jaccard_join, packing, suffix_dedup, toxicity
from barwright.llm.store import drop_tables, files_for, noting, written

#: Documents in a file that a stage leaves, about: stages that drop rows would leave many small ones.
DOCS_A_FILE = 10_000
#: Bytes of a repeated passage that goes: passages of over 50 words are longer, at 4.8 bytes for a word and the blank after it.
PASSAGE = 240


def _files(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.coalesce(files_for(docs.count(), DOCS_A_FILE))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labelled ones among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _files(toxicity.without_toxic(docs, toxicity.learned(toxicity.labelled_training(docs, labels))), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, that of the least doc_id stays."""
    return _files(jaccard_join.deduplicated(docs).select(*docs.columns), docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of PASSAGE bytes that start earlier too go; the first copy stays."""
    return _files(suffix_dedup.deduplicated(docs, PASSAGE), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words one in twenty or more lies in a 13-word window of a benchmark item."""
    return _files(decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return _files(packing.pack(docs), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express the trained model of the first stage, nor the tokenizer of the last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES:
        on_the_way: list[str] = []
        with noting(on_the_way):
            result = stage(spark, docs, sf_dir)
        kept: list[str] = []
        with noting(kept):
            docs = written(result)
        drop_tables(spark, before)
        drop_tables(spark, on_the_way)
        before = kept
    return docs
