"""Reports of a ranker: method table, ranking metrics, comparisons, routes, checkpoints, and checks of their inputs.

Rows are (id, candidate_id, pos, type, score, label), one for each candidate of
a query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators import ranking
from scriptorium.operators.ranking import EPSILON, group, ranked, softplus, standardized

METHODS = ("ranker_top1", "task_seed_0", "profile_seed_0", "best_task_seed", "best_profile_seed", "pool_oracle")


def methods(scores: DataFrame) -> DataFrame:
    """id, method, candidate_id, fallback: the candidate that each method takes for each query.

    The first seed of a kind is the one named so, else the one in the lowest
    place; the best ones take the lowest place of equals, the oracle the least
    id. A query without profile seeds falls back to its task seeds.
    """
    rows = ranked(scores)
    place = F.struct("pos", "candidate_id")
    gain = F.struct("label", (-F.col("pos")).alias("p"), "candidate_id")

    def seed(kind: str) -> list[Column]:
        mine = F.col("type") == f"{kind}_seed"
        named = F.max(F.when(F.col("candidate_id") == f"{kind}_0", F.col("candidate_id")))
        first = F.min(F.when(mine, place))["candidate_id"]
        return [F.coalesce(named, first).alias(f"{kind}_0"), F.max(F.when(mine, gain))["candidate_id"].alias(f"{kind}_best")]

    chosen = rows.groupBy("id").agg(
        F.min_by("candidate_id", "rank").alias("top"),
        F.min(F.when(F.col("oracle"), F.col("candidate_id"))).alias("oracle"),
        *seed("task"),
        *seed("profile"),
    )
    none = F.col("profile_0").isNull()
    picks = {
        "ranker_top1": F.col("top"),
        "task_seed_0": F.col("task_0"),
        "profile_seed_0": F.coalesce("profile_0", "task_0"),
        "best_task_seed": F.col("task_best"),
        "best_profile_seed": F.coalesce("profile_best", "task_best"),
        "pool_oracle": F.col("oracle"),
    }
    rows = F.array(
        *(F.struct(F.lit(m).alias("method"), c.alias("candidate_id"), (none if "profile" in m else F.lit(False)).alias("fallback")) for m, c in picks.items())
    )
    return chosen.select("id", F.explode(rows).alias("m")).select("id", "m.*")


def method_table(scores: DataFrame, scored: DataFrame) -> DataFrame:
    """For each method its queries, fallbacks and mean ROUGE."""
    rows = methods(scores).join(scored.select("id", "candidate_id", "rouge_1", "rouge_l"), ["id", "candidate_id"])
    return rows.groupBy("method").agg(
        F.count("*").alias("queries"),
        F.count_if("fallback").alias("fallbacks"),
        F.round(F.avg("rouge_1"), 6).alias("rouge_1"),
        F.round(F.avg("rouge_l"), 6).alias("rouge_l"),
    )


def ranking_report(scores: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row of ranking metrics: means over queries, over the valid ones for correlations; 0 where none is valid.

    Pair accuracy is given over all pairs (micro) and as the mean of the
    queries that have pairs (macro).
    """
    hits = ranking.hit_mrr_ndcg(scores).join(ranking.regrets(scores), "id").join(ranking.listwise_kl(scores), "id")
    hits = hits.join(ranking.rank_correlations(scores), "id", "left").join(ranking.pair_accuracy(scores, margin), "id", "left")

    def mean(x: str) -> Column:
        return F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6)

    valid = [c for name in ("pearson", "spearman", "kendall") for c in (mean(name).alias(name), F.count(name).alias(f"{name}_queries"))]
    return hits.agg(
        F.count("*").alias("queries"),
        *(mean(f"hit_{k}").alias(f"hit_{k}") for k in (1, 3, 5, 10)),
        mean("reciprocal_rank").alias("mrr"),
        *(mean(f"ndcg_{k}").alias(f"ndcg_{k}") for k in (3, 5, 10)),
        mean("regret").alias("regret"),
        F.round(F.percentile("regret", F.lit(0.5)), 6).alias("regret_median"),
        F.round(F.percentile("regret", F.lit(0.9)), 6).alias("regret_p90"),
        mean("normalized_regret").alias("normalized_regret"),
        F.round(F.coalesce(F.sum("correct") / F.sum("pairs"), F.lit(0.0)), 6).alias("pair_accuracy_micro"),
        F.round(F.coalesce(F.avg(F.col("correct") / F.col("pairs")), F.lit(0.0)), 6).alias("pair_accuracy_macro"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        mean("kl").alias("listwise_kl"),
        *valid,
    )


def type_report(scores: DataFrame) -> DataFrame:
    """For each type its candidates and mean label, how often one is selected, and in how many queries one is an oracle."""
    rows = ranked(scores)
    n = scores.agg(F.countDistinct("id").alias("n"))
    per_type = rows.groupBy("type").agg(
        F.count("*").alias("candidates"),
        F.round(F.avg("label"), 6).alias("mean_label"),
        F.count_if(F.col("rank") == 1).alias("selected"),
        F.countDistinct(F.when(F.col("oracle"), F.col("id"))).alias("oracle_queries"),
    )
    share = (F.round(F.col(c) / F.col("n"), 6).alias(f"{c}_rate") for c in ("selected", "oracle_queries"))
    return per_type.crossJoin(F.broadcast(n)).select("type", "candidates", "mean_label", "selected", "oracle_queries", *share)


def against_baselines(scores: DataFrame, draws: int, seed: str, baselines: tuple[str, ...] = ("task_seed_0", "profile_seed_0", "pool_oracle")) -> DataFrame:
    """The ranker's choice against baselines: mean and median gain, wins, ties, losses, interval, and the oracle gap closed."""
    labels = methods(scores).join(scores.select("id", "candidate_id", "label"), ["id", "candidate_id"]).select("id", "method", "label")
    wide = labels.groupBy("id").pivot("method", list(METHODS)).agg(F.first("label"))
    rows = wide.select(
        "id",
        F.explode(F.array(*(F.struct(F.lit(b).alias("baseline"), F.col(b).alias("base")) for b in baselines))).alias("b"),
        F.col("ranker_top1").alias("top"),
        F.col("pool_oracle").alias("best"),
    ).select("id", "b.*", "best", "top", F.round(F.col("top") - F.col("base"), 8).alias("delta"))
    room = F.avg("best") - F.avg("base")
    plain = rows.groupBy("baseline").agg(
        F.count("*").alias("queries"),
        F.round(F.avg("delta"), 6).alias("mean_delta"),
        F.round(F.percentile("delta", F.lit(0.5)), 6).alias("median_delta"),
        F.count_if(F.col("delta") > EPSILON).alias("wins"),
        F.count_if(F.abs("delta") <= EPSILON).alias("ties"),
        F.count_if(F.col("delta") < -EPSILON).alias("losses"),
        F.round(F.when(F.abs(room) > EPSILON, (F.avg("top") - F.avg("base")) / room), 6).alias("gap_closed"),
    )
    means = ranking.bootstrap_means(rows, ("delta",), "id", draws, seed, ("baseline",))
    limits = means.groupBy("baseline").agg(
        F.round(F.percentile("delta", F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile("delta", F.lit(0.975)), 6).alias("ci_high")
    )
    return plain.join(limits, "baseline")


def intervals(means: DataFrame, value: str, draws: int) -> DataFrame:
    """The 95 % interval of resampled means by the four ways in use: interpolated, by a truncated place of the last index,
    by its floor and ceiling, and by a truncated place of the number of draws."""
    last = draws - 1
    ways = {"truncated": (int(0.025 * last), int(0.975 * last)), "outer": (math.floor(0.025 * last), math.ceil(0.975 * last)), "count": (int(0.025 * draws), int(0.975 * draws))}
    linear = [F.round(F.percentile(value, F.lit(q)), 6).alias(f"linear_{name}") for name, q in (("low", 0.025), ("high", 0.975))]
    rows = means.agg(*linear, F.sort_array(F.collect_list(value)).alias("_all"))  # as many numbers as draws
    at = [F.round(F.get("_all", F.lit(i)), 6).alias(f"{way}_{name}") for way, places in ways.items() for name, i in zip(("low", "high"), places, strict=True)]
    return rows.select("linear_low", "linear_high", *at)


def set_alignment(**tables: DataFrame) -> DataFrame:
    """How many ids each combination of tables has: one row, with all names, where the sets are equal."""
    marked = [t.select("id").distinct().withColumn("name", F.lit(name)) for name, t in tables.items()]
    rows = marked[0]
    for t in marked[1:]:
        rows = rows.unionByName(t)
    held = rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("held_by"))
    return held.groupBy("held_by").agg(F.count("*").alias("ids"))


def permutation_errors(predictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per query what is wrong with a ranking ``predictions(id, rank, candidate_id, selected_id)``, comma-joined.

    repeated: an id comes twice; unknown, missing: the ranked ids are not the
    candidates; top: the selected one is not the first.
    """
    ranks = predictions.groupBy("id").agg(
        F.count("*").alias("n"),
        F.collect_set("candidate_id").alias("ranked"),
        F.min_by("candidate_id", "rank").alias("first"),
        F.min("selected_id").alias("selected"),
    )
    known = candidates.groupBy("id").agg(F.collect_set("candidate_id").alias("known"))
    none = F.array().cast("array<string>")
    rows = known.join(ranks, "id", "full").withColumns({"known": F.coalesce("known", none), "ranked": F.coalesce("ranked", none)})
    tests = {
        "repeated": F.coalesce("n", F.lit(0)) > F.size("ranked"),
        "unknown": F.size(F.array_except("ranked", "known")) > 0,
        "missing": F.size(F.array_except("known", "ranked")) > 0,
        "top": ~F.coalesce(F.col("first") == F.col("selected"), F.lit(False)),
    }
    return rows.select("id", F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items()))), ",").alias("errors"))


def group_metrics(scores: DataFrame, label_temperature: float = 0.1) -> DataFrame:
    """Accuracy of the first best score against the first best label, mean listwise divergence, mean regret."""
    first = (-F.col("pos")).alias("p")
    best = scores.groupBy("id").agg(
        F.max_by(F.struct("pos", "label"), F.struct("score", first)).alias("s"), F.max_by("pos", F.struct("label", first)).alias("l"), F.max("label").alias("m")
    )
    rows = best.join(ranking.listwise_kl(scores, label_temperature), "id")
    return rows.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("s.pos") == F.col("l")).cast("double")), 6).alias("accuracy"),
        F.round(F.avg("kl"), 6).alias("loss"),
        F.round(F.avg(F.col("m") - F.col("s.label")), 6).alias("regret"),
    )


def pair_metrics(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Accuracy and softplus loss, weighted by the margin, of ``pairs(id, chosen_id, rejected_id, margin)``; ties are wrong."""
    values = scores.select("id", F.col("candidate_id"), "score")
    chosen = values.select("id", F.col("candidate_id").alias("chosen_id"), F.col("score").alias("c"))
    rejected = values.select("id", F.col("candidate_id").alias("rejected_id"), F.col("score").alias("r"))
    rows = pairs.join(chosen, ["id", "chosen_id"]).join(rejected, ["id", "rejected_id"]).withColumn("d", F.col("c") - F.col("r"))
    n = F.greatest(F.count("*"), F.lit(1))
    return rows.agg(
        F.count("*").alias("pairs"),
        F.round(F.count_if(F.col("d") > 0) / n, 6).alias("accuracy"),
        F.round(F.coalesce(F.sum(softplus(-F.col("d")) * (1 + F.col("margin"))), F.lit(0.0)) / n, 6).alias("loss"),
    )


def checkpoint_choice(epochs: DataFrame, objective: str, requested: str = "auto") -> DataFrame:
    """The epoch with the greatest key, the first of equals: ``epochs(epoch, pair_accuracy, pair_loss, accuracy, loss, regret)``.

    ``auto`` goes by pair accuracy for pairwise objectives, else by mean regret.
    """
    selection = requested if requested != "auto" else "pair_accuracy" if objective == "pairwise" else "mean_regret"
    keys = {
        "pair_accuracy": [F.col("pair_accuracy"), -F.col("pair_loss")],
        "group_accuracy": [F.col("accuracy"), -F.col("regret"), -F.col("loss")],
        "mean_regret": [-F.col("regret"), F.col("accuracy"), -F.col("loss")],
        "listwise_kl": [-F.col("loss"), -F.col("regret"), F.col("accuracy")],
    }
    if selection not in keys:
        raise ValueError(f"no such selection: {selection}")
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate([*keys[selection], -F.col("epoch")])))
    return epochs.agg(F.max_by("epoch", key).alias("epoch")).select(F.lit(objective).alias("objective"), F.lit(selection).alias("selection"), "epoch")


def group_pairwise(scores: DataFrame, strategy: str, margin: float = 0.02, most: int = 0, weight_scale: float = 1.0) -> DataFrame:
    """Per id the mean of softplus(-score gap) (1 + scale min(label gap, 1)) over its pairs.

    ``hard_negative`` takes the pairs of the narrowest score gaps first,
    ``top_pairs`` only those with a best label, the narrowest label gaps first,
    ``all_pairs`` the given order; ``most`` of them (0: all).
    """
    best = F.max("label").over(group())
    rows = scores.withColumn("best", best)

    def side(name: str) -> DataFrame:
        return rows.select("id", *(F.col(c).alias(f"{name}_{c}") for c in ("pos", "score", "label", "best")))

    pairs = side("a").join(side("b"), "id").filter("a_pos < b_pos").select(
        "id", "a_pos", "b_pos", (F.col("a_label") - F.col("b_label")).alias("gap"), (F.col("a_score") - F.col("b_score")).alias("delta"),
        (F.greatest("a_label", "b_label") >= F.col("a_best") - 1e-8).alias("top"),
    ).filter(F.abs("gap") >= margin)
    if strategy == "top_pairs":
        pairs = pairs.filter("top")
    gaps = [F.round(F.abs("delta"), 8), F.round(F.abs("gap"), 8)]
    order = {"all_pairs": [], "hard_negative": gaps, "top_pairs": gaps[::-1]}[strategy]
    if most:
        by = group().orderBy(*order, "a_pos", "b_pos")
        pairs = pairs.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most)
    signed = F.when(F.col("gap") < 0, -F.col("delta")).otherwise(F.col("delta"))
    weight = 1 + F.lit(weight_scale) * F.least(F.abs("gap"), F.lit(1.0))
    return pairs.groupBy("id").agg(F.round(F.avg(softplus(-signed) * weight), 6).alias("pairwise"))


def user_alphas(first: DataFrame, second: DataFrame, labels: DataFrame, users: DataFrame, grid: tuple[float, ...], standardize: bool = True) -> DataFrame:
    """For each user the alpha of the grid of least mean regret, then most hits, then least alpha: ``users(id, user_id)``.

    Scores are (1 - alpha) of the first and alpha of the second ranker,
    standardised within queries or raw; the first best candidate is taken.
    """
    rows = mixed_scores(first, second, labels, grid, standardize)
    taken = rows.groupBy("alpha", "id").agg(
        F.max("label").alias("best"), F.max_by("label", F.struct("score", (-F.col("pos")).alias("p"))).alias("got")
    )
    per_user = taken.join(users, "id").groupBy("user_id", "alpha").agg(
        F.round(F.avg(F.col("best") - F.col("got")), 6).alias("regret"),
        F.round(F.avg((F.col("best") - F.col("got") <= 1e-8).cast("double")), 6).alias("hit"),
        F.count("*").alias("queries"),
    )
    by = W.partitionBy("user_id").orderBy("regret", F.desc("hit"), "alpha")
    return per_user.withColumn("place", F.row_number().over(by)).filter("place = 1").drop("place")


def mixed_scores(first: DataFrame, second: DataFrame, labels: DataFrame, grid: tuple[float, ...], standardize: bool = True) -> DataFrame:
    """id, candidate_id, pos, label, alpha, score for every alpha of the grid."""
    value = standardized if standardize else F.col
    a = first.select("id", "candidate_id", value("score").alias("a"))
    b = second.select("id", "candidate_id", value("score").alias("b"))
    rows = a.join(b, ["id", "candidate_id"]).join(labels.select("id", "candidate_id", "pos", "label"), ["id", "candidate_id"])
    return rows.withColumn("alpha", F.explode(F.array(*map(F.lit, grid)))).select(
        "id", "candidate_id", "pos", "label", "alpha", F.round((1 - F.col("alpha")) * F.col("a") + F.col("alpha") * F.col("b"), 6).alias("score")
    )


def route_report(first: DataFrame, second: DataFrame, labels: DataFrame, users: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """Mean regret and hit rate of four routes: the first ranker, the second, one shared alpha, an alpha for each user."""
    rows = mixed_scores(first, second, labels, grid).join(users, "id")
    taken = rows.groupBy("alpha", "user_id", "id").agg(
        F.max("label").alias("best"), F.max_by("label", F.struct("score", (-F.col("pos")).alias("p"))).alias("got")
    ).withColumn("regret", F.col("best") - F.col("got"))
    summed = taken.groupBy("alpha").agg(F.round(F.avg("regret"), 6).alias("r"), F.round(F.avg((F.col("regret") <= 1e-8).cast("double")), 6).alias("h"))
    shared = summed.agg(F.min_by("alpha", F.struct("r", (-F.col("h")).alias("h"), "alpha")).alias("shared"))
    own = user_alphas(first, second, labels, users, grid).select("user_id", F.col("alpha").alias("own"))
    routed = taken.join(own, "user_id").crossJoin(F.broadcast(shared)).withColumn(
        "route",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("alpha") == min(grid), "global"), F.when(F.col("alpha") == max(grid), "user_only"),
                    F.when(F.col("alpha") == F.col("shared"), "shared_alpha"), F.when(F.col("alpha") == F.col("own"), "per_user_alpha"),
                )
            )
        ),
    )
    return routed.groupBy("route").agg(
        F.count("*").alias("queries"),
        F.round(F.avg("regret"), 6).alias("regret"),
        F.round(F.avg((F.col("regret") <= 1e-8).cast("double")), 6).alias("hit"),
    )


def paired_examples(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values of the ids that both have: id, left, right, delta. Both are (id, value)."""
    rows = left.select("id", F.col("value").alias("left")).join(right.select("id", F.col("value").alias("right")), "id")
    return rows.withColumn("delta", F.round(F.col("left") - F.col("right"), 8))


def operation_oracle(scored: DataFrame) -> DataFrame:
    """Per id the better of its best mutation and its best crossover; the mutation wins ties, and stands alone where there is no crossover."""
    best = scored.groupBy("id").agg(
        *(F.max(F.when(F.col("type") == t, F.struct("rouge_l", (-F.col("pos")).alias("p"), "candidate_id"))).alias(t) for t in ("mutation", "crossover"))
    ).filter("mutation IS NOT NULL")
    cross = F.coalesce(F.col("crossover.rouge_l") > F.col("mutation.rouge_l"), F.lit(False))
    return best.select(
        "id",
        F.when(cross, "crossover").otherwise("mutation").alias("operation"),
        F.when(cross, F.col("crossover.candidate_id")).otherwise(F.col("mutation.candidate_id")).alias("candidate_id"),
        F.when(cross, F.col("crossover.rouge_l")).otherwise(F.col("mutation.rouge_l")).alias("rouge_l"),
    )
