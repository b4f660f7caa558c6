"""Choices among candidates and samples: hash samples, calibration splits, slates, complementary pairs and their gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.rouge import rouge_1, rouge_l
from scriptorium.functions.text import jaccard, spaced_key, title_tokens, tokens
from scriptorium.operators.ranking import bootstrap_means


def hash_sample(rows: DataFrame, identifier: str, count: int, seed: str) -> DataFrame:
    """The first ``count`` rows by the sha256 of seed and id."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(identifier).cast("string")), 256)
    return rows.orderBy(order, identifier).limit(count)


def calibration_split(rows: DataFrame, user: str, identifier: str, last: int) -> DataFrame:
    """The last ``last`` rows of each user by id are calibration."""
    n = F.row_number().over(W.partitionBy(user).orderBy(F.desc(identifier)))
    return rows.withColumn("part", F.when(n <= last, "calibration").otherwise("train"))


def changed_coverage(parent: Column, gold: Column, trace: Column) -> Column:
    """Share of the tokens in one of parent and gold only that the trace mentions; 1 where none changed."""
    a, b = F.array_distinct(tokens(parent)), F.array_distinct(tokens(gold))
    changed = F.array_except(F.array_union(a, b), F.array_intersect(a, b))
    return F.when(F.size(changed) == 0, 1.0).otherwise(F.size(F.array_intersect(changed, tokens(trace))) / F.size(changed))


def slate(candidates: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """First new texts of each type in the order of the quotas, as many as each allows.

    A text counts for the first type that has it. ``candidates(id, type, pos, text)``.
    """
    names = list(quotas)
    priority = F.array_position(F.array(*map(F.lit, names)), F.col("type"))
    ranked = candidates.withColumn("_p", priority).filter("_p > 0").withColumn("_key", spaced_key("text")).filter("_key <> ''")
    fresh = ranked.withColumn("_n", F.row_number().over(W.partitionBy("id", "_key").orderBy("_p", "pos"))).filter("_n = 1")
    placed = fresh.withColumn("place", F.row_number().over(W.partitionBy("id", "type").orderBy("pos")))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("type")]
    return placed.filter(F.col("place") <= quota).select("id", "type", "pos", "text", "place")


def complementary_pair(candidates: DataFrame, queries: DataFrame, least_words: int = 2, most_words: int = 40) -> DataFrame:
    """For each id its first candidate A and the B that adds most to it, without a look at the target.

    B's value: .50 of its word quality, .25 of up to three new words that the
    source text supports, .15 of the share of its words the source has, .10 of
    its distance from A; the first of equals wins.
    """
    words = candidates.select("id", "pos", "candidate_id", title_tokens("text").alias("w"), F.size(tokens("text")).alias("n"))
    joined = words.join(queries.select("id", title_tokens("source_text").alias("q")), "id")
    first = joined.groupBy("id").agg(F.min_by(F.struct("candidate_id", "pos", "w"), "pos").alias("a"))
    others = joined.join(first, "id").filter(F.col("pos") != F.col("a.pos"))
    grounded = F.size(F.array_intersect("w", "q"))
    fresh = F.size(F.array_except(F.array_intersect("w", "q"), F.col("a.w")))
    quality = F.col("n").between(least_words, most_words).cast("double")
    value = F.round(
        0.50 * quality
        + 0.25 * F.least(F.lit(1.0), fresh / F.lit(3.0))
        + 0.15 * F.when(F.size("w") > 0, grounded / F.size("w")).otherwise(0.0)
        + 0.10 * (1 - jaccard(F.col("w"), F.col("a.w"), 0.0)),
        6,
    )
    scored = others.select("id", F.col("a.candidate_id").alias("a_id"), "candidate_id", "pos", fresh.alias("fresh"), value.alias("value"))
    best = W.partitionBy("id").orderBy(F.desc("value"), "pos")
    return scored.withColumn("n", F.row_number().over(best)).filter("n = 1").select(
        "id", "a_id", F.col("candidate_id").alias("b_id"), F.col("fresh").cast("long").alias("fresh"), "value"
    )


def pair_gate(pairs: DataFrame, least_value: float = 0.6, least_fresh: int = 1) -> DataFrame:
    """What keeps a pair from being used, comma-joined; empty if nothing does."""
    reasons = F.concat_ws(
        ",", F.when(F.col("value") < least_value, "value"), F.when(F.col("fresh") < least_fresh, "fresh"), F.when(F.col("a_id") == F.col("b_id"), "same")
    )
    return pairs.select("id", "a_id", "b_id", reasons.alias("reasons"))


def context_text(mode: str, source: Column, titles: Column, factors: Column) -> Column:
    """A ranker's context by input mode."""
    parts = {
        "candidate_only": [],
        "task_only": [source],
        "factor_aware": [source, factors],
        "profile_aware": [source, titles],
        "provenance_aware": [source, titles, factors],
    }
    if mode not in parts:
        raise ValueError(f"no such input mode: {mode}")
    return F.concat_ws("\n", *parts[mode]) if parts[mode] else F.lit("")


def corpus_rouge(rows: DataFrame, prediction: str, target: str, draws: int, seed: str) -> DataFrame:
    """Mean ROUGE with the 2.5, 50 and 97.5 percentiles of resampled means."""
    words = rows.select("id", tokens(prediction).alias("p"), tokens(target).alias("t"))
    scored = words.select("id", F.round(rouge_1(F.col("p"), F.col("t")), 8).alias("r1"), F.round(rouge_l(F.col("p"), F.col("t")), 8).alias("rl"))
    means = bootstrap_means(scored, ("r1", "rl"), "id", draws, seed)
    limits = [
        F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{name}") for c in ("r1", "rl") for name, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))
    ]
    return means.agg(*limits)
