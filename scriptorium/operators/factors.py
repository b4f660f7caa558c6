"""Factors of a user's history: quality gates, statistics, pruning, quota selection and greedy cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quality_reasons(stability: str = "stability", applicability: str = "applicability", risk: str = "risk") -> Column:
    """Why a factor is not eligible, comma-joined; empty if it is."""
    return F.concat_ws(
        ",",
        F.when(F.col(stability) < 0.65, "stability"),
        F.when(F.col(applicability) < 0.7, "applicability"),
        F.when(F.col(risk) > 0.35, "risk"),
    )


def factor_statistics(features: DataFrame) -> DataFrame:
    """Per sample and factor: support, its share of the sample's items, mean title tokens, first three items.

    ``features(id, item, factor, title_tokens)``; an item counts once for a factor.
    """
    totals = features.groupBy("id").agg(F.countDistinct("item").alias("items"))
    once = features.groupBy("id", "factor", "item").agg(F.max("title_tokens").alias("title_tokens"))
    by = W.partitionBy("id", "factor").orderBy("item")
    ranked = once.withColumn("n", F.row_number().over(by))
    grouped = ranked.groupBy("id", "factor").agg(
        F.count("*").alias("support"),
        F.round(F.avg("title_tokens"), 6).alias("mean_tokens"),
        F.sort_array(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "item")))).alias("first"),
    )
    return grouped.join(totals, "id").select(
        "id",
        "factor",
        "support",
        F.round(F.col("support") / F.col("items"), 6).alias("share"),
        "mean_tokens",
        F.array_join(F.transform("first", lambda x: x["item"].cast("string")), ",").alias("examples"),
    )


def prune(statistics: DataFrame, least: float, most: float, fallback: int = 4) -> DataFrame:
    """Factors whose share lies in the range; where none does, the ``fallback`` best supported of the sample."""
    inside = F.col("share").between(least, most)
    any_inside = F.max(inside.cast("int")).over(W.partitionBy("id")) == 1
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("support"), "factor"))
    return statistics.withColumn("_in", inside).withColumn("_any", any_inside).withColumn("_rank", rank).filter(
        F.col("_in") | (~F.col("_any") & (F.col("_rank") <= fallback))
    ).drop("_in", "_any", "_rank")


def quota_selection(factors: DataFrame, total: int, style: int) -> DataFrame:
    """By quality, at least ``style`` style factors where there are so many, and content up to ``total``."""
    by_type = W.partitionBy("id", "type").orderBy(F.desc("quality"), "factor")
    ranked = factors.withColumn("n", F.row_number().over(by_type))
    first = (F.col("type") == "style") & (F.col("n") <= style)
    order = W.partitionBy("id").orderBy(F.when(first, 0).otherwise(1), F.desc("quality"), "factor")
    return ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= total).drop("n")


def greedy_cover(matrix: DataFrame, limit: int = 8, overlap: float = 1.0, uncovered: float = 1.0) -> DataFrame:
    """Factors of each sample picked one by one: twice the newly covered less overlap, plus what stays uncovered.

    ``matrix(id, feature, factor)`` is a sample's own small matrix; the next
    pick depends on all before it, so each sample is one grouped map.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        sets = {f: set(g["feature"]) for f, g in frame.groupby("factor")}
        every, covered, chosen = set(frame["feature"]), set(), []
        while sets and len(chosen) < limit:
            def gain(f: str) -> float:
                new = sets[f] - covered
                return 2.0 * len(new) - overlap * len(sets[f] & covered) + uncovered * len(every - covered - new)

            best = max(sorted(sets), key=gain)
            if not sets[best] - covered:
                break
            covered |= sets.pop(best)
            chosen.append(best)
        return pd.DataFrame({"id": frame["id"].iloc[0], "factor": chosen, "step": range(1, len(chosen) + 1)})

    return matrix.groupBy("id").applyInPandas(pick, "id string, factor string, step int")


def assigned(features: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each feature's factors by item and name; those without are Unclassified."""
    return features.join(assignments, ["item", "feature"], "left").withColumn(
        "factors", F.coalesce("factors", F.array(F.lit("Unclassified")))
    )


def repair_ids(cited: DataFrame, valid: DataFrame) -> DataFrame:
    """Cited ids that are valid, or one edit from exactly one valid id of the sample; null where neither holds."""
    pairs = cited.join(valid.select("id", F.col("item").alias("known")), "id").filter(F.levenshtein("cited", "known", 1) >= 0)
    exact = F.max(F.when(F.col("cited") == F.col("known"), F.col("known")))
    near = F.when(F.count("*") == 1, F.min("known"))
    found = pairs.groupBy("id", "cited").agg(F.coalesce(exact, near).alias("repaired"))
    return cited.join(found, ["id", "cited"], "left")
