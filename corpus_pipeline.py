"""A corpus from raw documents to packed sequences, in stages that each read what the one before has kept.

Every stage takes a table with the columns of documents, of any content: columns
may be null, texts empty or very long (each is read whole, by one task), rows
repeated, ids missing or used twice, other columns named like a stage's own. An
empty table gives an empty result. Each stage says what it does with these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontam, jaccard_join, packing, quality, toxicity
from scriptorium.llm.common import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the base rules or the outlier test reject.

    Null and empty texts fail the base rules and go; null languages and sources
    are groups of their own; repeated rows share one verdict and stay or go
    together; every column is carried in one struct, so that no name can clash.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # as one value no column can clash
    judged = quality.judge_quality(docs.select("doc_id", "text", "lang", "source", whole), carry=("_row",))
    return judged.filter("kept").select("_row.*")


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows scored as toxic by a model learned from the labels of what is left.

    Null and empty texts have no toxic passage and stay unless most labels are
    toxic; without toxic or without clean labels every row has the labels' rate
    as its score; repeated rows are judged row by row; labels of null ids, null
    labels and those of one id that disagree are not learned from.
    """
    model = toxicity.learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of linked documents: that of the least id, then of the least set and text.

    Null, empty and blank texts are linked with nothing and all stay; of equal
    rows one stays; a row without id stays only where no row of its group has
    one; rows that share an id are judged each by its own text.
    """
    return jaccard_join.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a window of a benchmark item.

    Null and empty texts hold none and stay; an item without words has no
    window; with an empty benchmark all rows stay; repeated rows share one
    verdict.
    """
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept texts with their places in sequences of 4096 tokens.

    A null or empty text is a piece of its end id alone; a longer text than a
    sequence is cut; equal rows get places of their own; other columns are not
    returned.
    """
    # workers still hold what earlier stages left them, so they remember fewer pre-tokens here
    packed = packing.pack_pieces(packing.tokenise_pieces(docs, cache_size=150_000))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_passages),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed_sequences),
]

#: The model-based stages and the tokens cannot be stated in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
