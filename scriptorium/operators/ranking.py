"""Ranking metrics, objectives, blending and statistics over rows (id, candidate_id, pos, score, label, type)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


EPSILON = 1e-12


def group() -> WindowSpec:
    return W.partitionBy("id")


def ranked(scores: DataFrame) -> DataFrame:
    """Rank by score, ties by candidate_id, and whether a candidate ties for the best label."""
    return scores.withColumn("rank", F.row_number().over(group().orderBy(F.desc("score"), "candidate_id"))).withColumn(
        "oracle", F.col("label") >= F.max("label").over(group()) - F.lit(EPSILON)
    )


def hit_mrr_ndcg(scores: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per id the first oracle rank, hits, reciprocal rank and NDCG (gain 2^label - 1; 0 where the ideal is 0)."""
    rows = ranked(scores).withColumn("ideal_rank", F.row_number().over(group().orderBy(F.desc("label"), "candidate_id")))
    gain = F.pow(F.lit(2.0), F.col("label")) - 1

    def dcg(rank: str, k: int) -> Column:
        return F.sum(F.when(F.col(rank) <= k, gain / F.log2(F.col(rank) + F.lit(1.0))).otherwise(0.0))

    grouped = rows.groupBy("id").agg(
        F.min(F.when(F.col("oracle"), F.col("rank"))).alias("first"),
        *(dcg("rank", k).alias(f"d{k}") for k in cutoffs),
        *(dcg("ideal_rank", k).alias(f"i{k}") for k in cutoffs),
    )
    return grouped.select(
        "id",
        F.col("first").cast("long").alias("first_rank"),
        F.round(1 / F.col("first"), 6).alias("reciprocal_rank"),
        *((F.col("first") <= k).cast("int").alias(f"hit_{k}") for k in cutoffs),
        *(F.round(F.when(F.col(f"i{k}") <= EPSILON, 0.0).otherwise(F.col(f"d{k}") / F.col(f"i{k}")), 6).alias(f"ndcg_{k}") for k in cutoffs),
    )


def regrets(scores: DataFrame) -> DataFrame:
    """Per id the best label, the selected one's, the regret and the regret as a share of the range."""
    grouped = ranked(scores).groupBy("id").agg(
        F.max("label").alias("best"), F.min("label").alias("worst"), F.min_by("label", "rank").alias("selected")
    )
    span = F.col("best") - F.col("worst")
    return grouped.select(
        "id",
        F.round("best", 6).alias("best"),
        F.round("selected", 6).alias("selected"),
        F.round(F.col("best") - F.col("selected"), 6).alias("regret"),
        F.round(F.when(span > EPSILON, (F.col("best") - F.col("selected")) / span).otherwise(0.0), 6).alias("normalized_regret"),
    )


def pairs(scores: DataFrame) -> DataFrame:
    """All i < j of each id with score and label differences."""
    def side(name: str) -> DataFrame:
        return scores.select("id", *(F.col(c).alias(f"{name}_{c}") for c in ("pos", "score", "label")))

    return side("a").join(side("b"), "id").filter("a_pos < b_pos").select(
        "id", (F.col("a_score") - F.col("b_score")).alias("ds"), (F.col("a_label") - F.col("b_label")).alias("dl")
    )


def pair_accuracy(scores: DataFrame, margin: float = 0.02) -> DataFrame:
    """Per id the pairs whose labels differ by ``margin`` and those the scores order alike; tied scores are wrong."""
    return pairs(scores).filter(F.abs("dl") >= margin).groupBy("id").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("ds") * F.col("dl") > 0).alias("correct")
    )


def average_rank(x: str) -> Column:
    by = group().orderBy(x)
    return F.rank().over(by) + (F.count("*").over(W.partitionBy("id", x)) - 1) / F.lit(2.0)


def _correlation(x: str, y: str) -> Column:
    guard = (F.count("*") < 2) | (F.stddev_pop(x) <= EPSILON) | (F.stddev_pop(y) <= EPSILON)
    return F.when(guard, F.lit(None)).otherwise(F.round(F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)), 6))


def rank_correlations(scores: DataFrame) -> DataFrame:
    """Per id Pearson, Spearman (average ranks) and Kendall tau-b of score and label; null where one is constant."""
    rows = scores.withColumn("rs", average_rank("score")).withColumn("rl", average_rank("label"))
    linear = rows.groupBy("id").agg(_correlation("score", "label").alias("pearson"), _correlation("rs", "rl").alias("spearman"))
    tie_s, tie_l = F.abs("ds") <= EPSILON, F.abs("dl") <= EPSILON
    counted = pairs(scores).groupBy("id").agg(
        F.count_if(~tie_s & ~tie_l & (F.col("ds") * F.col("dl") > 0)).alias("c"),
        F.count_if(~tie_s & ~tie_l & (F.col("ds") * F.col("dl") < 0)).alias("d"),
        F.count_if(tie_s & ~tie_l).alias("ts"),
        F.count_if(tie_l & ~tie_s).alias("tl"),
    )
    below = F.sqrt((F.col("c") + F.col("d") + F.col("ts")).cast("double") * (F.col("c") + F.col("d") + F.col("tl")))
    tau = counted.select("id", F.when(below > EPSILON, F.round((F.col("c") - F.col("d")) / below, 6)).alias("kendall"))
    return linear.join(tau, "id", "left").select("id", "pearson", "spearman", "kendall")


def softmax(x: str, temperature: float) -> Column:
    z = F.exp((F.col(x) - F.max(x).over(group())) / F.lit(temperature))
    return z / F.sum(z).over(group())


def listwise_kl(scores: DataFrame, label_temperature: float = 0.1) -> DataFrame:
    """Per id the divergence of the score softmax from the label softmax."""
    rows = scores.withColumn("p", softmax("label", label_temperature)).withColumn("q", softmax("score", 1.0))
    term = F.col("p") * (F.log(F.col("p") + EPSILON) - F.log(F.col("q") + EPSILON))
    return rows.groupBy("id").agg(F.round(F.sum(term), 6).alias("kl"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def losses(scores: DataFrame, tie: float = 1e-8) -> DataFrame:
    """Per id the training objectives as plain values.

    listmle (by tiers of equal labels), pointwise (smooth L1 of the sigmoid),
    expected_regret, oracle_set, top1_lambda.
    """
    e = F.exp(F.col("score") - F.max("score").over(group()))
    rows = scores.withColumn("e", e).withColumn("best", F.max("label").over(group())).withColumn("tier", F.round("label", 8))
    tiers = rows.groupBy("id", "tier").agg(F.sum("e").alias("own"))
    below = F.sum("own").over(W.partitionBy("id").orderBy("tier"))
    listmle = tiers.withColumn("rest", below).groupBy("id").agg(F.round(F.avg(F.log("rest") - F.log("own")), 6).alias("listmle"))
    gap = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("score"))) - F.col("label"))
    smooth = F.when(gap < 1, F.lit(0.5) * gap * gap).otherwise(gap - 0.5)
    plain = rows.groupBy("id").agg(
        F.round(F.avg(smooth), 6).alias("pointwise"),
        F.round(F.max("label") - F.sum(F.col("e") * F.col("label")) / F.sum("e"), 6).alias("expected_regret"),
        F.round(F.log(F.sum("e")) - F.log(F.sum(F.when(F.col("label") >= F.col("best") - tie, F.col("e")).otherwise(0.0))), 6).alias("oracle_set"),
    )
    top = rows.groupBy("id").agg(F.max_by(F.struct("pos", "score", "label"), F.struct("score", (-F.col("pos")).alias("p"))).alias("t"))
    other = rows.join(top, "id").filter(F.col("pos") != F.col("t.pos"))
    gain = F.col("label") - F.col("t.label")
    delta = F.when(gain > 0, F.col("score") - F.col("t.score")).otherwise(F.col("t.score") - F.col("score"))
    lam = other.filter(F.abs(gain) > tie).groupBy("id").agg(F.round(F.avg(softplus(-delta) * F.abs(gain)), 6).alias("top1_lambda"))
    return listmle.join(plain, "id").join(lam, "id", "left").fillna(0.0, ["top1_lambda"])


def standardized(x: str) -> Column:
    """Within-group z-score by the population deviation; a zero deviation counts as 1."""
    scale = F.stddev_pop(x).over(group())
    return (F.col(x) - F.avg(x).over(group())) / F.when(scale <= EPSILON, F.lit(1.0)).otherwise(scale)


def blend(first: DataFrame, second: DataFrame, alpha: float) -> DataFrame:
    """alpha of one ranker's standardised score and the rest of another's, ranked anew."""
    a = first.select("id", "candidate_id", standardized("score").alias("a"))
    b = second.select("id", "candidate_id", standardized("score").alias("b"))
    mixed = a.join(b, ["id", "candidate_id"]).select(
        "id", "candidate_id", F.round(F.lit(alpha) * F.col("a") + F.lit(1 - alpha) * F.col("b"), 6).alias("score")
    )
    return mixed.withColumn("rank", F.row_number().over(group().orderBy(F.desc("score"), "candidate_id")))


def select_alpha(first: DataFrame, second: DataFrame, labels: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """For each alpha of the grid the mean regret and hit rate of the first best candidate; the best alpha has place 1.

    Lower regret, then more hits, then the smaller alpha.
    """
    spark = first.sparkSession
    alphas = spark.range(len(grid)).select(F.element_at(F.array(*map(F.lit, grid)), (F.col("id") + 1).cast("int")).alias("alpha"))
    a = first.select("id", "candidate_id", standardized("score").alias("a"))
    b = second.select("id", "candidate_id", standardized("score").alias("b"))
    rows = a.join(b, ["id", "candidate_id"]).join(labels.select("id", "candidate_id", "pos", "label"), ["id", "candidate_id"])
    mixed = rows.crossJoin(F.broadcast(alphas)).withColumn(
        "score", F.round(F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b"), 6)
    )
    groups = mixed.groupBy("alpha", "id").agg(
        F.max("label").alias("best"), F.max_by("label", F.struct("score", (-F.col("pos")).alias("p"))).alias("got")
    )
    summed = groups.groupBy("alpha").agg(
        F.round(F.avg(F.col("best") - F.col("got")), 6).alias("regret"),
        F.round(F.avg((F.col("got") >= F.col("best") - EPSILON).cast("double")), 6).alias("hit"),
    )
    return summed.withColumn("place", F.row_number().over(W.orderBy("regret", F.desc("hit"), "alpha")))


def summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, median, population deviation, 90th percentile, minimum and maximum; zeros where there is no value."""
    found = {
        "mean": F.avg(value),
        "median": F.percentile(value, F.lit(0.5)),
        "std": F.stddev_pop(value),
        "p90": F.percentile(value, F.lit(0.9)),
        "least": F.min(value),
        "most": F.max(value),
    }
    return rows.groupBy(*by).agg(F.count(value).alias("n"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for n, c in found.items()))


def win_tie_loss(rows: DataFrame, delta: str, significant: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Gains, ties and losses at 1e-12, and gains and losses of at least ``significant``."""
    d = F.col(delta)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(d > EPSILON).alias("wins"),
        F.count_if(F.abs(d) <= EPSILON).alias("ties"),
        F.count_if(d < -EPSILON).alias("losses"),
        F.count_if(d >= significant).alias("big_wins"),
        F.count_if(d <= -significant).alias("big_losses"),
        F.round(F.avg(d), 6).alias("mean_delta"),
    )


#: Steps of the Poisson(1) distribution; beyond the last the chance is below one in 10^9.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def multiplicities(*parts: Column) -> list[Column]:
    """How often a row counts in four draws: Poisson(1) of the 32-bit words of the md5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *parts))

    def count(k: int) -> Column:
        u = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
        return sum(((u >= F.lit(x)).cast("int") for x in POISSON), F.lit(0))

    return [count(k) for k in range(4)]


def bootstrap_means(rows: DataFrame, values: tuple[str, ...], key: str, draws: int, seed: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of ``values`` in ``draws`` resamples: ``by``, draw ``b`` and the means, rounded to 9 digits.

    Every row tells how often it counts in each draw by the hash of seed, four
    draws and key, independently of all others (Poisson(1), what drawing n of n
    rows tends to), so that draws are summed up before the shuffle and any
    engine can repeat them.
    """
    drawn = rows.select(*by, key, *values, F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))).alias("_q"))
    weights = multiplicities(F.lit(seed), F.col("_q").cast("string"), F.col(key).cast("string"))
    weighed = drawn.select(*by, *values, "_q", *(w.alias(f"_w{k}") for k, w in enumerate(weights)))
    sums = weighed.groupBy(*by, "_q").agg(
        *(F.sum(f"_w{k}").alias(f"_n{k}") for k in range(4)), *(F.sum(F.col(f"_w{k}") * F.col(v)).alias(f"_{v}{k}") for v in values for k in range(4))
    )
    four = F.array(
        *(F.struct((F.col("_q") * 4 + k).alias("b"), F.col(f"_n{k}").alias("_n"), *(F.col(f"_{v}{k}").alias(v) for v in values)) for k in range(4))
    )
    each = sums.select(*by, F.explode(four).alias("_d")).select(*by, "_d.*").filter((F.col("b") < draws) & (F.col("_n") > 0))
    return each.select(*by, "b", *(F.round(F.col(v) / F.col("_n"), 9).alias(v) for v in values))


def paired_bootstrap(rows: DataFrame, delta: str, order: str, draws: int, seed: str) -> DataFrame:
    """Mean delta with the 2.5 and 97.5 percentiles of the means of ``draws`` resamples."""
    means = bootstrap_means(rows, (delta,), order, draws, seed)
    limits = means.agg(
        F.round(F.percentile(delta, F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile(delta, F.lit(0.975)), 6).alias("ci_high")
    )
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(delta), 6).alias("mean_delta")).crossJoin(limits)


def average_heads(heads: DataFrame) -> DataFrame:
    """Element-wise mean of weight arrays ``heads(head, weights)``: place and weight."""
    return heads.select(F.posexplode("weights").alias("place", "w")).groupBy("place").agg(F.round(F.avg("w"), 6).alias("weight"))
