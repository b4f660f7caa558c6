"""Preferences: parent/child, ranker pairs, best against worst responses, gated pairs, pair flattening, DPO loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.rouge import rouge_l
from scriptorium.functions.text import tokens


def parent_child(deltas: DataFrame, margin: float = 0.02) -> DataFrame:
    """A preference for every child that differs from its parent by at least ``margin``."""
    better = F.col("delta") > 0
    return deltas.filter(F.abs("delta") >= margin).select(
        F.concat_ws(":", "id", "candidate_id").alias("pair_id"),
        F.when(better, F.col("candidate_id")).otherwise(F.col("parent_id")).alias("chosen_id"),
        F.when(better, F.col("parent_id")).otherwise(F.col("candidate_id")).alias("rejected_id"),
        F.abs("delta").alias("margin"),
    )


def ranker_pairs(scored: DataFrame, strategy: str, margin: float = 0.02, most: int = 12) -> DataFrame:
    """Pairs of candidates whose labels differ by at least ``margin``; ``most`` of each id (0: all).

    ``all_pairs`` takes the widest margins first, ``hard_negative`` the
    narrowest, ``top_pairs`` only pairs with a best candidate, the narrowest
    first; ties go by pair id.
    """
    best = F.max("rouge_l").over(W.partitionBy("id"))
    rows = scored.withColumn("_best", best).select("id", "pos", "candidate_id", "rouge_l", "_best")

    def side(name: str) -> DataFrame:
        return rows.select("id", *(F.col(c).alias(f"{name}_{c}") for c in ("pos", "candidate_id", "rouge_l", "_best")))

    pairs = side("a").join(side("b"), "id").filter("a_pos < b_pos")
    gap = F.round(F.abs(F.col("a_rouge_l") - F.col("b_rouge_l")), 8)
    first = F.col("a_rouge_l") > F.col("b_rouge_l")
    chosen = F.when(first, F.col("a_candidate_id")).otherwise(F.col("b_candidate_id"))
    rejected = F.when(first, F.col("b_candidate_id")).otherwise(F.col("a_candidate_id"))
    pairs = pairs.withColumn("margin", gap).filter(F.col("margin") >= margin)
    if strategy == "top_pairs":
        pairs = pairs.filter(F.greatest("a_rouge_l", "b_rouge_l") >= F.col("a__best") - F.lit(1e-8))
    out = pairs.select(
        "id",
        F.concat_ws(":", "id", chosen, rejected).alias("pair_id"),
        chosen.alias("chosen_id"),
        rejected.alias("rejected_id"),
        "margin",
    )
    order = F.desc("margin") if strategy == "all_pairs" else F.asc("margin")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(order, "pair_id")))
    return ranked if most == 0 else ranked.filter(F.col("rank") <= most)


def reward_rollouts(rollouts: DataFrame) -> DataFrame:
    """ROUGE-L reward of every whole response against the rollout's whole target."""
    reward = rouge_l(tokens("output"), tokens("target"))
    return rollouts.select("rollout_id", "response_id", F.round(reward, 8).alias("reward"))


def gold_preferences(rewards: DataFrame, least_responses: int = 2, margin: float = 0.03) -> DataFrame:
    """Per rollout the last response by (reward, id) against the first, and whether that is a preference.

    Ids compare as strings, so r10 comes before r2; where rewards tie the
    chosen one has the largest id, the rejected one the smallest.
    """
    order = F.struct("reward", "response_id")
    grouped = rewards.groupBy("rollout_id").agg(
        F.count("*").alias("responses"), F.max(order).alias("c"), F.min(order).alias("r")
    )
    gap = F.round(F.col("c.reward") - F.col("r.reward"), 8)
    status = (
        F.when(F.col("responses") < least_responses, "insufficient_responses")
        .when((F.col("c.response_id") == F.col("r.response_id")) | (gap < margin), "low_margin")
        .otherwise("accepted")
    )
    return grouped.select(
        "rollout_id",
        "responses",
        F.col("c.response_id").alias("chosen_id"),
        F.col("r.response_id").alias("rejected_id"),
        F.col("c.reward").alias("chosen_reward"),
        F.col("r.reward").alias("rejected_reward"),
        gap.alias("margin"),
        status.alias("status"),
    )


def gated_pairs(scored: DataFrame, margin: float = 0.03, improvement: float = 0.02) -> DataFrame:
    """Per id the best mutation against the worst, or the first reason not to pair them.

    Positions decide ties: the first of the worst, the last of the best. The
    parent is the first seed.
    """
    mutated = scored.filter("type = 'mutation'").groupBy("id").agg(
        F.count("*").alias("n"),
        F.max(F.struct("rouge_l", "pos", "candidate_id")).alias("c"),
        F.min(F.struct("rouge_l", "pos", "candidate_id")).alias("r"),
    )
    parent = scored.groupBy("id").agg(F.min_by("rouge_l", "pos").alias("parent_reward"))
    gap = F.round(F.col("c.rouge_l") - F.col("r.rouge_l"), 8)
    gain = F.round(F.col("c.rouge_l") - F.col("parent_reward"), 8)
    return parent.join(mutated, "id", "left").select(
        "id",
        F.col("c.candidate_id").alias("chosen_id"),
        F.col("r.candidate_id").alias("rejected_id"),
        gap.alias("margin"),
        gain.alias("improvement"),
        F.when(F.coalesce("n", F.lit(0)) < 2, "too_few_mutations")
        .when(gap < margin, "margin")
        .when(gain < improvement, "parent")
        .otherwise("accepted")
        .alias("status"),
    )


def dpo_pairs(preferences: DataFrame, responses: DataFrame) -> DataFrame:
    """Accepted preferences with both texts; pairs with a missing or empty text are left out."""
    chosen = responses.select("rollout_id", F.col("response_id").alias("chosen_id"), F.trim("output").alias("chosen"))
    rejected = responses.select("rollout_id", F.col("response_id").alias("rejected_id"), F.trim("output").alias("rejected"))
    return (
        preferences.filter("status = 'accepted'")
        .join(chosen, ["rollout_id", "chosen_id"])
        .join(rejected, ["rollout_id", "rejected_id"])
        .filter("chosen <> '' AND rejected <> ''")
        .select(
            F.concat(F.col("rollout_id"), F.lit(":preference")).alias("pair_id"), "chosen", "rejected", "chosen_reward", "rejected_reward", "margin"
        )
    )


def dpo_loss(policy_chosen: Column, policy_rejected: Column, reference_chosen: Column, reference_rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid(beta ((pc - pr) - (rc - rr))): ln 2 where the policy is the reference."""
    z = F.lit(beta) * ((policy_chosen - policy_rejected) - (reference_chosen - reference_rejected))
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
