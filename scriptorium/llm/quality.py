"""Quality rules with robust multivariate outliers, in Spark expressions only.

Statistics of each whole text give a transformed vector. For every language
and source a minimum-covariance-determinant estimate is found by concentration
steps: keep the 75 % of the group that lie nearest, take their mean and
covariance, and repeat. Vectors standardised by medians and median absolute
deviations give four starts (their length, the length of their bounded values,
their largest entry, and the length by fixed deviations); after two steps each
group goes on from the start of the least determinant, until its determinant
falls by less than 2 %, twelve steps at most. A document is rejected when its squared Mahalanobis distance,
rescaled so that the group's median is that of the chi-square law, is beyond a
far quantile.

Quantiles of a group are read from counts in narrow bins, which are combined
before they are shuffled, so no task sees all rows of a large group.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Transformed statistics, and the least standard deviation that counts for each: many clean texts have none of
#: a thing at all, and a first few must not lie infinitely far away.
FEATURES = {
    "x_length": 0.5,
    "x_word": 0.25,
    "x_symbols": 0.05,
    "x_lines": 0.08,
    "x_repeats": 0.08,
    "x_capitals": 0.08,
    "x_marks": 0.15,
    "x_echoes": 0.08,
}
SHARE, LEAST_GROUP, TAIL = 0.75, 200, 1e-6
#: Starts of the estimate, the steps of each, the most steps in all, and a fall of the determinant's logarithm that counts.
STARTS, FIRST_STEPS, MOST_STEPS, FALL = 4, 2, 12, 0.02
#: Bins of a quantile: of a feature's least deviation, and of a factor e in distances.
FINE, FINE_LOG = 50, 500
#: From a median absolute deviation to a standard deviation, for the normal law.
NORMAL = 1.4826
#: The largest model that is broadcast: rows, of some 40 numbers each.
BROADCAST_GROUPS = 20_000


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


def word_array(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, ``carry``, the base statistics and the capitals and marks of every whole text."""
    keep = list(dict.fromkeys(["doc_id", "lang", "source", *carry]))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    base = docs.select(
        *keep,
        word_array(text).alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_marks"),
    )
    windows = F.transform(
        "_words", lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, 5)))
    )
    counted = base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_capitals",
        "n_marks",
        F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))).cast("long").alias("n_echoes"),
        F.when(F.size("_words") >= 5, F.slice(windows, F.lit(1), F.size("_words") - 4))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_grams"),
    )
    rest = [c for c in counted.columns if c != "_grams"]
    none = F.array().cast("array<struct<g:bigint,i:int>>")
    ordered = counted.select(
        *rest,
        F.when(
            F.size(F.array_distinct("_grams")) < F.size("_grams"),
            F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        )
        .otherwise(none)
        .alias("_ordered"),
    )
    twice = F.filter(
        "_ordered",
        lambda x, k: F.coalesce(F.get("_ordered", k - 1)["g"] == x["g"], F.lit(False))
        | F.coalesce(F.get("_ordered", k + 1)["g"] == x["g"], F.lit(False)),
    )
    places = ordered.select(*rest, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_places"))
    covered = F.transform(
        "_places", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_places", k + 1) - p, F.lit(5)))
    )
    repeats = F.aggregate(covered, F.lit(0).cast("long"), lambda a, c: a + c)
    return places.select(*rest, repeats.alias("n_repeat_words"))


def vector() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "x_length": F.log1p("n_words"),
        "x_word": F.log(chars / words),
        "x_symbols": F.sqrt(F.col("n_symbols") / words),
        "x_lines": F.col("n_dup_lines") / F.greatest(F.sqrt(words.cast("double")), F.lit(4.0)),
        "x_repeats": F.col("n_repeat_words") / words,
        "x_capitals": F.col("n_capitals") / chars,
        "x_marks": F.sqrt(F.col("n_marks") / words),
        "x_echoes": F.col("n_echoes") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_model(rows: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """Join a row of the model to each row of its group; the model is broadcast only while it is small."""
    return rows.join(F.broadcast(model) if small else model, "group", "left")


def groups(stats: DataFrame, least: int) -> tuple[DataFrame, bool]:
    """Add ``group``: language and source; for rare ones the language's rest; for rare languages one rest.

    Also tells whether there are few enough groups to broadcast a row for each.
    """

    def name(*parts: Column) -> Column:
        return F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))

    fine, coarse = name(F.col("lang"), F.col("source")), name(F.col("lang"))
    sizes = stats.groupBy(fine.alias("fine"), coarse.alias("coarse")).agg(F.count("*").alias("n"))
    rare = F.col("n") < least
    pooled = sizes.filter(rare).groupBy("coarse").agg(F.sum("n").alias("m"))
    named = sizes.join(pooled, "coarse", "left").select(
        "fine",
        F.when(~rare, F.col("fine")).when(F.col("m") >= least, F.col("coarse")).otherwise(F.lit("rest")).alias("group"),
    )
    named = materialize(named, "groups")
    small = named.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return stats.withColumn("fine", fine).join(F.broadcast(named) if small else named, "fine", "left").drop("fine"), small


def quantile(rows: DataFrame, by: list[str], bin_of: Column, share: float) -> DataFrame:
    """``by`` and the least ``bin`` that has ``share`` of the rows of its group at or below it."""
    counts = rows.select(*by, bin_of.cast("long").alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    group = W.partitionBy(*by)  # a row for each bin
    reached = counts.withColumns({"_sum": F.sum("n").over(group.orderBy("bin")), "_all": F.sum("n").over(group)})
    return reached.filter(F.col("_sum") >= F.lit(share) * F.col("_all")).groupBy(*by).agg(F.min("bin").alias("bin"))


def medians(points: DataFrame, name: str) -> DataFrame:
    """For each group the array ``name`` of the medians of the array ``v``, in bins of a share of the least deviations."""
    width = F.array(*(F.lit(x / FINE) for x in FEATURES.values()))
    long = points.select("group", F.posexplode("v").alias("i", "x"))
    found = quantile(long, ["group", "i"], F.round(F.col("x") / F.get(width, F.col("i"))), 0.5)
    value = F.struct("i", (F.col("bin") * F.get(width, F.col("i"))).alias("x"))
    return found.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(value)), lambda t: t["x"]).alias(name))


def edges(points: DataFrame, by: list[str], share: float) -> DataFrame:
    """For each group the distance within which ``share`` of its points lie."""
    found = quantile(points, by, F.floor(F.log(F.greatest(F.col("d"), F.lit(1e-9))) * FINE_LOG), share)
    return found.select(*by, F.exp((F.col("bin") + 1) / F.lit(float(FINE_LOG))).alias("edge"))


def estimate(points: DataFrame, origins: DataFrame, small: bool) -> DataFrame:
    """Of each group and start the mean (array ``center``), inverse covariance (array ``precision``, row by row) and its log determinant.

    ``points`` carry the array ``origin`` of their group and start, which
    ``origins`` lists too; sums are taken from there, so that products stay
    small. A variance counts for no less than that of the feature's least
    deviation.
    """
    names, d = list(FEATURES), len(FEATURES)
    floors = list(FEATURES.values())
    by = ["group", "start"]
    near = points.select(*by, *((F.col(x) - F.get("origin", F.lit(i))).alias(f"y{i}") for i, x in enumerate(names)))
    sums = near.groupBy(*by).agg(
        F.count("*").alias("n"),
        *(F.sum(f"y{i}").alias(f"s{i}") for i in range(d)),
        *(F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"s{i}_{j}") for i in range(d) for j in range(i + 1)),
    )

    def entry(i: int, j: int) -> Column:
        a, b = max(i, j), min(i, j)
        c = F.col(f"s{a}_{b}") / F.col("n") - F.col(f"s{a}") / F.col("n") * F.col(f"s{b}") / F.col("n")
        # a little more on the diagonal, so that features that go together leave an inverse
        return F.greatest(c, F.lit(floors[i] ** 2)) * 1.001 if i == j else c

    def sweep(state: Column, k: Column) -> Column:
        m = state["m"]
        pivot = F.get(m, k * d + k)

        def swept(v: Column, t: Column) -> Column:
            i, j = F.floor(t / d).cast("int"), t % d
            return (
                F.when((i == k) & (j == k), -1 / pivot)
                .when((i == k) | (j == k), v / pivot)
                .otherwise(v - F.get(m, i * d + k) * F.get(m, k * d + j) / pivot)
            )

        return F.struct(F.transform(m, swept).alias("m"), (state["logdet"] + F.log(pivot)).alias("logdet"))

    matrix = F.array(*(entry(i, j) for i in range(d) for j in range(d)))
    begin = F.struct(matrix.alias("m"), F.lit(0.0).alias("logdet"))
    swept = F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), begin, sweep)
    center = F.array(*(F.get("origin", F.lit(i)) + F.col(f"s{i}") / F.col("n") for i in range(d)))
    joined = sums.join(F.broadcast(origins) if small else origins, by)
    return joined.select(*by, center.alias("center"), swept.alias("_s")).select(
        *by, "center", F.transform("_s.m", lambda v: -v).alias("precision"), F.col("_s.logdet").alias("logdet")
    )


def starts(sound: DataFrame, spreads: DataFrame, small: bool) -> DataFrame:
    """group, start, origin, the features and the distances of the four starts, from medians and their deviations."""
    off = [F.col(x) - F.get("med", F.lit(i)) for i, x in enumerate(FEATURES)]
    least = list(FEATURES.values())
    z = [o / F.greatest(F.get("mad", F.lit(i)) * NORMAL, F.lit(f)) for i, (o, f) in enumerate(zip(off, least, strict=True))]
    distances = F.array(
        sum((x * x for x in z), F.lit(0.0)),
        sum((F.tanh(x) * F.tanh(x) for x in z), F.lit(0.0)),
        F.greatest(*(x * x for x in z)),
        sum(((o / F.lit(f)) ** 2 for o, f in zip(off, least, strict=True)), F.lit(0.0)),
    )
    rows = sound.join(F.broadcast(spreads) if small else spreads, "group")
    return rows.select("group", F.col("med").alias("origin"), *FEATURES, F.posexplode(distances).alias("start", "d"))


def concentrate(near: DataFrame, origins: DataFrame, share: float, small: bool) -> DataFrame:
    """A concentration step of every group and start: the model of the share of the points nearest by ``d``."""
    by = ["group", "start"]
    edge = materialize(edges(near, by, share), "edges")
    core = near.join(F.broadcast(edge) if small else edge, by).filter(F.col("d") <= F.col("edge"))
    out = materialize(estimate(core, origins, small), "model")
    discard(edge)
    return out


def measured(sound: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """The points of the model's groups with their distances by it; its centers are the origins of the next sums."""
    rows = sound.join(F.broadcast(model) if small else model, "group")
    return rows.select("group", "start", F.col("center").alias("origin"), *FEATURES, distance().alias("d"))


def determinant_estimates(sound: DataFrame, share: float, small: bool) -> DataFrame:
    """group, center and precision of the minimum-covariance-determinant estimate of every group of ``sound``."""
    points = sound.select("group", F.array(*FEATURES).alias("v"))
    center = materialize(medians(points, "med"), "medians")
    away = with_model(points, center, small).select("group", F.zip_with("v", "med", lambda x, m: F.abs(x - m)).alias("v"))
    spreads = materialize(center.join(medians(away, "mad"), "group"), "spreads")
    every = F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))).alias("start")
    origins = spreads.select("group", every, F.col("med").alias("origin"))
    model = concentrate(starts(sound, spreads, small), origins, share, small)
    for _ in range(1, FIRST_STEPS):
        model = step(sound, model, share, small)
    picked = F.min_by(F.struct("start", "center", "precision", "logdet"), F.struct("logdet", "start"))
    model = materialize(model.groupBy("group").agg(picked.alias("_m")).select("group", "_m.*"), "picked")
    done = []
    for k in range(FIRST_STEPS, MOST_STEPS):
        new = step(sound, model, share, small)
        before = model.select("group", F.col("logdet").alias("_before"))
        judged = materialize(new.join(before, "group").withColumn("falls", F.col("_before") - F.col("logdet") > FALL), "judged")
        last = k == MOST_STEPS - 1
        done.append((judged if last else judged.filter("not falls")).select("group", "center", "precision"))
        if last or judged.filter("falls").isEmpty():
            break
        model = judged.filter("falls").select("group", "start", "center", "precision", "logdet")  # only these go on
    return reduce(DataFrame.union, done)


def step(sound: DataFrame, model: DataFrame, share: float, small: bool) -> DataFrame:
    origins = model.select("group", "start", F.col("center").alias("origin"))
    return concentrate(measured(sound, model, small), origins, share, small)


def distance() -> Column:
    """Squared Mahalanobis distance to the joined model."""
    d = len(FEATURES)
    off = [F.col(x) - F.get("center", F.lit(i)) for i, x in enumerate(FEATURES)]
    rows = (
        sum((F.get("precision", F.lit(i * d + j)) * off[j] for j in range(d)), F.lit(0.0)) * off[i] for i in range(d)
    )
    return sum(rows, F.lit(0.0))


def judge_quality(
    docs: DataFrame,
    carry: tuple[str, ...] = (),
    share: float = SHARE,
    least_group: int = LEAST_GROUP,
    tail: float = TAIL,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, source)`` with its statistics, base_failed, distance and kept.

    A null or empty text has no words and fails the base rules; a very long one
    is counted whole in one task. Null languages and sources are groups of their
    own; groups of fewer than ``least_group`` rows are pooled by language, then
    together; a group whose every row fails the base rules has no estimate, and
    its rows no distance. Repeated rows are judged row by row; an empty table
    gives an empty result. Columns other than these and ``carry`` are not read.
    """
    stats = statistics(docs, carry).withColumn("base_failed", base_failed()).withColumns(vector())
    stats = materialize(stats, "statistics")
    grouped, small = groups(stats, least_group)
    sound = materialize(grouped.filter(~F.col("base_failed")).select("group", *FEATURES), "sound")
    model = materialize(determinant_estimates(sound, share, small), "estimates")
    typical = chi2_quantile(0.5, len(FEATURES))
    near = with_model(sound, model, small).select("group", distance().alias("d"))
    scale = edges(near, ["group"], 0.5).select("group", F.greatest(F.col("edge") / F.lit(typical), F.lit(1.0)).alias("scale"))
    model = materialize(model.join(scale, "group"), "scaled")
    discard(sound)
    far = chi2_quantile(1 - tail, len(FEATURES))
    judged = with_model(grouped, model, small).withColumn("distance", distance() / F.col("scale"))
    return judged.select(
        *dict.fromkeys(["doc_id", *carry]),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "distance",
        (~F.col("base_failed") & ~F.coalesce(F.col("distance") > far, F.lit(False))).alias("kept"),
    )
