"""The driver's tables as the engine's domain: history items, samples, rollouts, candidate pools.

history   every document is an item of its source's history: the first eight
          tokens are the title, the rest the abstract
samples   every conversation with a user turn is a sample of one of the users:
          its first user turn is the source text, the first eight tokens of its
          first assistant turn the hidden target
rollouts  a conversation's assistant turns are its responses, its last user
          turn is the hidden target
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import join_tokens, tokens

TITLE_TOKENS, USERS = 8, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, pos, id, title, abstract, words of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", tokens("text").alias("words"))
    return docs.select(
        F.coalesce("source", F.lit("")).alias("user_id"),
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("id"),
        join_tokens(F.slice("words", 1, TITLE_TOKENS)).alias("title"),
        join_tokens(F.slice("words", TITLE_TOKENS + 1, 2147483647)).alias("abstract"),
        "words",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, source_text, source (its tokens), target of every conversation with a user turn."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("source_text"))
    said = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    return asked.join(said, "conv_id", "left").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"),
        F.concat(F.lit("src"), F.pmod("conv_id", F.lit(USERS)).cast("string")).alias("user_id"),
        F.coalesce("source_text", F.lit("")).alias("source_text"),
        tokens("source_text").alias("source"),
        join_tokens(F.slice(tokens("answer"), 1, TITLE_TOKENS)).alias("target"),
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rollout_id, response_id, output, target: a row for each assistant turn."""
    turns = table(spark, sf_dir, "conversations")
    target = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("target"))
    said = turns.filter("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("r"), F.col("turn").cast("string")).alias("response_id"), F.col("text").alias("output")
    )
    return said.join(target, "conv_id").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("rollout_id"), "response_id", "output", "target"
    )
