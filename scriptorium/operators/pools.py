"""Candidate pools: mock generation, pair choice, scoring against targets and parents, fixed-width pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.rouge import rouge_1, rouge_l
from scriptorium.functions.text import INVALID_EXACT, INVALID_LEAK, jaccard, join_tokens, tokens


def half(words: Column, last: bool = False) -> Column:
    """First half of a token array, rounded up, or the rest."""
    n = F.ceil(F.size(words) / F.lit(2.0)).cast("int")
    return F.slice(words, n + 1, 2147483647) if last else F.slice(words, F.lit(1), n)


def seeds(queries: DataFrame, retrieved: DataFrame, items: DataFrame) -> DataFrame:
    """Two task seeds from the source text and the titles of the two best history items: id, pos, candidate_id, type, text."""
    task = queries.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("pos"), F.lit("task_0").alias("candidate_id"), F.slice("source", 1, 8).alias("words")),
                F.struct(
                    F.lit(1).alias("pos"),
                    F.lit("task_1").alias("candidate_id"),
                    F.filter(F.slice("source", 1, 16), lambda t, i: i % 2 == 1).alias("words"),
                ),
            )
        ).alias("c"),
    ).select("id", "c.pos", "c.candidate_id", F.lit("task_seed").alias("type"), join_tokens(F.col("c.words")).alias("text"))
    best = retrieved.filter("rank <= 2").select("id", "user_id", "rank", "pos")
    profile = best.join(items.select("user_id", "pos", "title"), ["user_id", "pos"]).select(
        "id",
        (F.col("rank") + 1).alias("pos"),
        F.concat(F.lit("profile_"), (F.col("rank") - 1).cast("string")).alias("candidate_id"),
        F.lit("profile_seed").alias("type"),
        F.col("title").alias("text"),
    )
    return task.unionByName(profile).filter(F.length("text") > 0)


def crossover_pairs(candidates: DataFrame, count: int) -> DataFrame:
    """Complementary pairs of each id: of different types first, then least similar, then by ids; ``count`` at most."""
    left = candidates.select("id", *(F.col(c).alias(f"a_{c}") for c in ("pos", "candidate_id", "type", "text")))
    right = candidates.select("id", *(F.col(c).alias(f"b_{c}") for c in ("pos", "candidate_id", "type", "text")))
    pairs = left.join(right, "id").filter("a_pos < b_pos").select(
        "id",
        "a_candidate_id",
        "b_candidate_id",
        "a_text",
        "b_text",
        (F.col("a_type") == F.col("b_type")).cast("int").alias("penalty"),
        F.round(jaccard(tokens("a_text"), tokens("b_text"), 1.0), 6).alias("similarity"),
    )
    by = W.partitionBy("id").orderBy("penalty", "similarity", "a_candidate_id", "b_candidate_id")
    return pairs.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= count)


def mutations(queries: DataFrame, parents: DataFrame) -> DataFrame:
    """One mock mutation of each seed: its first half and the last half of the source's first eight tokens."""
    joined = parents.join(queries.select("id", "source"), "id")
    words = F.concat(half(tokens("text")), half(F.slice("source", 1, 8), last=True))
    return joined.select(
        "id",
        (F.col("pos") + 4).alias("pos"),
        F.concat(F.lit("mutation_"), F.col("pos").cast("string")).alias("candidate_id"),
        F.lit("mutation").alias("type"),
        join_tokens(words).alias("text"),
        F.col("candidate_id").alias("parent_a"),
        F.lit(None).cast("string").alias("parent_b"),
    )


def crossovers(parents: DataFrame, count: int = 2) -> DataFrame:
    """A mock crossover of each chosen pair: first half of one, last half of the other."""
    pairs = crossover_pairs(parents, count)
    words = F.concat(half(tokens("a_text")), half(tokens("b_text"), last=True))
    return pairs.select(
        "id",
        (F.col("rank") + 7).alias("pos"),
        F.concat(F.lit("crossover_"), (F.col("rank") - 1).cast("string")).alias("candidate_id"),
        F.lit("crossover").alias("type"),
        join_tokens(words).alias("text"),
        F.col("a_candidate_id").alias("parent_a"),
        F.col("b_candidate_id").alias("parent_b"),
    )


def candidate_pool(queries: DataFrame, retrieved: DataFrame, items: DataFrame) -> DataFrame:
    """Seeds, mutations and crossovers: up to ten candidates of each id with their parents."""
    parents = seeds(queries, retrieved, items)
    none = F.lit(None).cast("string")
    return (
        parents.withColumn("parent_a", none)
        .withColumn("parent_b", none)
        .unionByName(mutations(queries, parents))
        .unionByName(crossovers(parents))
    )


def score_pool(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """ROUGE of every candidate against the hidden target, which stays out of the columns."""
    with_target = pool.join(queries.select("id", tokens("target").alias("_target")), "id")
    words = with_target.withColumn("_words", tokens("text"))
    return words.select(
        *pool.columns,
        F.round(rouge_1(F.col("_words"), F.col("_target")), 8).alias("rouge_1"),
        F.round(rouge_l(F.col("_words"), F.col("_target")), 8).alias("rouge_l"),
    )


def parent_deltas(scored: DataFrame) -> DataFrame:
    """Each child with its stronger parent (the first where equal) and the score it gains on it."""
    parents = scored.select("id", "candidate_id", "text", "rouge_l", "type")
    children = scored.filter("parent_a IS NOT NULL")

    def parent(side: str) -> DataFrame:
        return parents.select("id", *(F.col(c).alias(f"{side}_{c}") for c in ("candidate_id", "text", "rouge_l", "type")))

    joined = children.join(parent("a").withColumnRenamed("a_candidate_id", "parent_a"), ["id", "parent_a"]).join(
        parent("b").withColumnRenamed("b_candidate_id", "parent_b"), ["id", "parent_b"], "left"
    )
    second = F.coalesce(F.col("b_rouge_l") > F.col("a_rouge_l"), F.lit(False))

    def pick(name: str) -> Column:
        return F.when(second, F.col(f"b_{name}")).otherwise(F.col(f"a_{name}"))

    return joined.select(
        "id",
        "candidate_id",
        "type",
        "text",
        "rouge_l",
        F.when(second, F.col("parent_b")).otherwise(F.col("parent_a")).alias("parent_id"),
        pick("text").alias("parent_text"),
        pick("rouge_l").alias("parent_rouge_l"),
        pick("type").alias("parent_type"),
        F.round(F.col("rouge_l") - pick("rouge_l"), 8).alias("delta"),
    )


def fixed_width(pool: DataFrame, width: int = 5) -> DataFrame:
    """The first ``width`` different candidate texts of each id, padded with copies of the first."""
    listed = pool.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("c"))
    texts = F.array_distinct(F.transform("c", lambda x: x["text"]))
    kept = F.slice(texts, 1, width)
    unique = F.size(kept)
    padded = F.concat(kept, F.array_repeat(F.get(kept, F.lit(0)), F.lit(width) - unique))
    return listed.select("id", F.array_join(padded, "|").alias("parents"), unique.cast("long").alias("unique_count"))


def parent_issues(pool: DataFrame, least_words: int = 2, most_words: int = 40) -> DataFrame:
    """What is wrong with each candidate as a parent, as comma-joined names in a fixed order."""
    text, words = F.col("text"), F.size(tokens("text"))
    checks = {
        "empty": F.length(F.trim(text)) == 0,
        "exact": text.rlike(INVALID_EXACT),
        "leak": text.rlike(INVALID_LEAK),
        "bullet": F.ltrim(text).rlike(r"^(?:•|- |\* )"),
        "lines": text.contains("\n"),
        "long": F.length(text) > 300,
        "words": ~words.between(least_words, most_words),
    }
    names = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())))
    return pool.select("id", "candidate_id", F.array_join(names, ",").alias("issues"))


def combination_plan(parents: DataFrame, factors: DataFrame, most: int) -> DataFrame:
    """Round r gives parent p the factor (p + r) mod F; the first ``most`` by round and parent."""
    n = factors.groupBy("id").agg(F.count("*").cast("int").alias("n"))
    rounds = parents.select("id", F.col("pos").alias("p")).join(n, "id").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    planned = rounds.withColumn("factor", F.pmod(F.col("p") + F.col("r"), F.col("n")))
    by = W.partitionBy("id").orderBy("r", "p")
    return planned.withColumn("step", F.row_number().over(by)).filter(F.col("step") <= most).select("id", "step", "p", "r", "factor")
