"""Training-set compilers: prompts, response spans, weights, multitask and crossover examples, warm-up balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import hash_split, tokens


def base_prompt(source: Column, history: Column) -> Column:
    """The plain prompt: history titles, then the source text."""
    return F.concat(F.lit("History titles: "), F.coalesce(history, F.lit("")), F.lit("\nAbstract: "), source, F.lit("\nTitle:"))


def editor_prompt(source: Column, parent: Column, history: Column) -> Column:
    """The editing prompt as compact JSON with fixed field order."""
    return F.to_json(F.struct(F.lit("edit").alias("task"), source.alias("source_text"), parent.alias("parent"), history.alias("history")))


def history_titles(visible: DataFrame) -> DataFrame:
    """Visible history outputs of each id, in rank order, as one line."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "output")))
    return visible.groupBy("id").agg(listed.alias("h")).select("id", F.array_join(F.transform("h", lambda x: x["output"]), " ; ").alias("history"))


def response_spans(trace: Column, output: Column) -> tuple[Column, Column]:
    """A compact JSON response cut into the part before its output field and the rest: together they parse again."""
    head = F.to_json(F.struct(trace.alias("trace")))
    return F.left(head, F.length(head) - 1), F.concat(F.lit(',"output":'), F.substring(F.to_json(F.struct(output.alias("o"))), 6, 2147483647))


def output_only(pool: DataFrame, queries: DataFrame, most: int = 4, validation: float = 0.05) -> DataFrame:
    """Seed to target examples: ``most`` parents of each id, weighted so that every id counts the same, split by hash."""
    by = W.partitionBy("id")
    parents = pool.filter("parent_a IS NULL").withColumn("n", F.row_number().over(by.orderBy("pos"))).filter(F.col("n") <= most)
    return parents.join(queries.select("id", "target"), "id").filter("target <> ''").select(
        F.concat_ws(":", "id", "candidate_id").alias("example_id"),
        "id",
        F.col("text").alias("parent"),
        F.col("target").alias("output"),
        F.round(F.lit(1.0) / F.count("*").over(by), 8).alias("sample_weight"),
        hash_split("id", validation).alias("split"),
    )


def crossover_examples(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Merge the pair into the target, or keep the parent that equals it."""
    action = (
        F.when(F.col("a_text") == F.col("target"), "keep_a").when(F.col("b_text") == F.col("target"), "keep_b").otherwise("merge")
    )
    return pairs.join(queries.select("id", "target"), "id").filter("target <> ''").select(
        F.concat_ws(":", "id", "a_candidate_id", "b_candidate_id").alias("example_id"), action.alias("action"), F.col("target").alias("output")
    )


def dual_operator(mutation: DataFrame, crossover: DataFrame, mutation_weight: float = 0.5, crossover_weight: float = 0.5) -> DataFrame:
    """Both kinds of examples; ids without a crossover give all weight to mutations. Columns id, example_id, output."""
    both = crossover.groupBy("id").agg(F.count("*").alias("c"))
    m = mutation.join(both, "id", "left").withColumn("k", F.count("*").over(W.partitionBy("id"))).select(
        "example_id", "id", F.lit("mutation").alias("operation"), "output",
        F.round(F.when(F.col("c").isNull(), F.lit(1.0)).otherwise(F.lit(mutation_weight)) / F.col("k"), 8).alias("weight"),
    )
    c = crossover.withColumn("k", F.count("*").over(W.partitionBy("id"))).select(
        "example_id", "id", F.lit("crossover").alias("operation"), "output", F.round(F.lit(crossover_weight) / F.col("k"), 8).alias("weight")
    )
    return m.unionByName(c)


def multitask(examples: DataFrame, rationales: DataFrame, rationale_weight: float = 0.1) -> DataFrame:
    """A title row of weight 1 for each example, and a rationale row of small weight where there is a rationale."""
    titles = examples.select(F.concat(F.col("id"), F.lit(":title")).alias("example_id"), F.lit("title").alias("task"), "output", F.lit(1.0).alias("weight"))
    reasons = examples.join(rationales, "id").filter("rationale <> ''").select(
        F.concat(F.col("id"), F.lit(":rationale")).alias("example_id"),
        F.lit("rationale").alias("task"),
        F.col("rationale").alias("output"),
        F.lit(rationale_weight).alias("weight"),
    )
    return titles.unionByName(reasons)


def warmup_balance(traced: DataFrame, plain: DataFrame, ratio: float, seed: str) -> DataFrame:
    """All traced examples of each split and round(n ratio) plain ones, the first by the hash of seed and id."""
    wanted = traced.groupBy("split").agg(F.bround(F.count("*") * F.lit(ratio)).cast("long").alias("wanted"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), "example_id"), 256)
    ranked = plain.withColumn("n", F.row_number().over(W.partitionBy("split").orderBy(order, "example_id")))
    sampled = ranked.join(F.broadcast(wanted), "split").filter("n <= wanted")
    return traced.select("example_id", "split", F.lit("trace").alias("kind")).unionByName(
        sampled.select("example_id", "split", F.lit("output_only").alias("kind"))
    )


def length_diagnostics(rows: DataFrame, text: str, most: int) -> DataFrame:
    """Examples, mean tokens, share cut at ``most`` tokens."""
    n = F.size(tokens(text))
    return rows.agg(
        F.count("*").alias("examples"),
        F.round(F.avg(n), 6).alias("mean_tokens"),
        F.round(F.avg((n > most).cast("double")), 6).alias("truncated_share"),
    )
