"""Histories: cleaning, deduplication, leakage isolation, selection, splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import MISSING_ABSTRACTS, compact_key, hash_split, spaced_key
from scriptorium.sources.tables import materialize, number_parts

# The end of a style summary, and the summary of a history without titles.
STYLE_ADVICE = "Preserve these structural tendencies only when they fit the current abstract."
NO_STYLE = "No reliable historical-title style statistics are available."


def clean(items: DataFrame, drop_missing_abstracts: bool = True) -> DataFrame:
    """Items with a title and, if asked, a real abstract; id falls back to the position in the history."""
    at = F.row_number().over(W.partitionBy("user_id").orderBy("pos")) - 1
    kept = items.withColumn("id", F.coalesce("id", at.cast("string"))).filter(F.length(F.trim("title")) > 0)
    if drop_missing_abstracts:
        kept = kept.filter(~F.lower(F.trim(F.coalesce("abstract", F.lit("")))).isin(*MISSING_ABSTRACTS))
    return kept


def greedy_dedup(items: DataFrame) -> DataFrame:
    """First items whose abstract key and title key are both new among the kept ones of their user.

    The order decides, yet not all at once: an item that is the first
    undecided one of both its keys is kept, and all others of these keys are
    dropped; so it goes in rounds until none is undecided. Most items share no
    key and are decided in the first round. Keys travel as 64-bit hashes.
    """
    left = materialize(
        items.select("user_id", "pos", F.xxhash64(compact_key("abstract")).alias("a"), F.xxhash64(compact_key("title")).alias("t")),
        "undecided",
    )
    kept: DataFrame | None = None
    while kept is None or not left.isEmpty():
        first_a = left.groupBy("user_id", "a").agg(F.min("pos").alias("fa"))
        first_t = left.groupBy("user_id", "t").agg(F.min("pos").alias("ft"))
        marked = materialize(
            left.join(first_a, ["user_id", "a"]).join(first_t, ["user_id", "t"]).withColumn(
                "now", (F.col("pos") == F.col("fa")) & (F.col("pos") == F.col("ft"))
            ),
            "marked",
        )
        chosen = marked.filter("now")
        kept = chosen.select("user_id", "pos") if kept is None else kept.unionByName(chosen.select("user_id", "pos"))
        rest = marked.filter("NOT now").select("user_id", "pos", "a", "t")
        rest = rest.join(chosen.select("user_id", "a"), ["user_id", "a"], "left_anti")
        left = materialize(rest.join(chosen.select("user_id", "t"), ["user_id", "t"], "left_anti").select("user_id", "pos", "a", "t"), "undecided")
    return kept.distinct()


def greedy_dedup_array(items: Column, abstract: str = "abstract", title: str = "title") -> Column:
    """The same fold over an array of structs, for histories that fit in a row."""

    def step(kept: Column, x: Column) -> Column:
        seen = F.exists(
            kept, lambda y: (compact_key(y[abstract]) == compact_key(x[abstract])) | (compact_key(y[title]) == compact_key(x[title]))
        )
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(items, F.slice(items, 1, 0), step)


def first_by_key(rows: DataFrame, group: str, text: str, order: str, most: int | None = None) -> DataFrame:
    """First row of each normalised text in its group, in order, at most ``most``; empty keys are dropped."""
    keyed = rows.withColumn("_key", spaced_key(text)).filter("_key <> ''")
    first = keyed.withColumn("_n", F.row_number().over(W.partitionBy(group, "_key").orderBy(order))).filter("_n = 1")
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(order)))
    placed = placed.drop("_key", "_n")
    return placed if most is None else placed.filter(F.col("place") <= most)


def visible_history(retrieved: DataFrame, queries: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """The first ``most`` retrieved items, then without those whose title is empty or the target: fewer may be left.

    Abstracts are cut before items meet what retrieved them, so no whole text is exchanged.
    """
    shown = items.select("user_id", "pos", "title", F.rtrim(F.left("abstract", F.lit(500))).alias("input"))
    return (
        retrieved.filter(F.col("rank") <= most)
        .join(queries.select("id", "target"), "id")
        .join(shown, ["user_id", "pos"])
        .filter((F.length("title") > 0) & (compact_key("title") != compact_key("target")))
        .select("id", "rank", F.col("pos").alias("item"), "input", F.rtrim(F.left("title", F.lit(300))).alias("output"))
    )


def deny_targets(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Items whose title is no target of any of their user's queries."""
    forbidden = queries.select("user_id", compact_key("target").alias("_key")).distinct()
    return items.withColumn("_key", compact_key("title")).join(forbidden, ["user_id", "_key"], "left_anti").drop("_key")


def first_users(rows: DataFrame, users: int, per_user: int, user: str = "user_id", order: str = "id") -> DataFrame:
    """Of the first users by name, as strings, the first rows by id."""
    chosen = rows.select(user).distinct().orderBy(user).limit(users)
    by = W.partitionBy(user).orderBy(order)
    return rows.join(F.broadcast(chosen), user, "left_semi").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= per_user)


def user_split(rows: DataFrame, share: float, seed: str) -> DataFrame:
    """Per user the first max(5, round(n share)) rows, n - 1 at most, by the hash of seed, user and id are validation."""
    by = W.partitionBy("user_id")
    order = F.sha2(F.concat_ws(":", F.lit(seed), "user_id", "id"), 256)
    n = F.count("*").over(by)
    wanted = F.least(F.greatest(F.lit(5), F.bround(n * F.lit(share)).cast("int")), n - 1)
    return rows.withColumn(
        "split", F.when(F.row_number().over(by.orderBy(order, "id")) <= wanted, "validation").otherwise("train")
    )


def disjoint_splits(rows: DataFrame, identifier: str, share: float) -> DataFrame:
    """Rows per split and how many ids are in both: 0 where splits are disjoint."""
    split = rows.select(identifier, hash_split(identifier, share).alias("split"))
    shared = split.groupBy(identifier).agg(F.countDistinct("split").alias("k")).filter("k > 1").agg(F.count("*").alias("shared"))
    return split.groupBy("split").agg(F.count("*").alias("rows")).crossJoin(shared)


def contrast_rows(rows: DataFrame, user: str, order: str) -> DataFrame:
    """For each row the ``order`` of the nearest following row, cyclically, of another user; null if there is none.

    Rows are read in ranges of a unique ``order``. Of each range only its first
    row and the first row of another user than that one's go to the driver;
    they say where a range's last run of one user continues.
    """
    placed = number_parts(rows.select(F.col(user).alias("user"), F.col(order).cast("long").alias("order")), "order")
    heads = placed.filter("_place = 0").select("_part", F.col("user").alias("head"), F.col("order").alias("at"))
    other = (
        placed.join(F.broadcast(heads), "_part")
        .filter(~F.col("user").eqNullSafe(F.col("head")))
        .groupBy("_part")
        .agg(F.min(F.struct("order", "user")).alias("o"))
    )
    parts = sorted(heads.join(other, "_part", "left").collect(), key=lambda r: r["_part"])
    starts = [(r["_part"], [(r["at"], r["head"])] + ([(r["o"]["order"], r["o"]["user"])] if r["o"] else [])) for r in parts]

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values("_place", ascending=False)
            part = int(frame["_part"].iloc[0])
            at = next(i for i, (p, _) in enumerate(starts) if p == part)
            later = [x for _, two in starts[at + 1 :] + starts[: at + 1] for x in two]
            users, orders, out = frame["user"].tolist(), frame["order"].tolist(), []
            run_next = None
            for k, (u, o) in enumerate(zip(users, orders, strict=True)):
                if k and u == users[k - 1]:
                    pass
                elif k:
                    run_next = orders[k - 1]
                else:
                    run_next = next((o2 for o2, u2 in later if u2 != u), None)
                out.append(run_next)
            yield pd.DataFrame({"order": orders, "user": users, "contrast": pd.array(out, dtype="Int64")})

    kind = rows.schema[user].dataType.simpleString()
    found = placed.groupBy("_part").applyInPandas(lambda f: next(follow(iter([f]))), f"order long, user {kind}, contrast long")
    return found.select(F.col("order").alias(order), F.col("user").alias(user), "contrast")


def style_summary(rows: DataFrame, user: str, title: str) -> DataFrame:
    """Per user the number of non-empty titles, their median words, and how many have a colon, a question mark, an acronym; as a text too.

    A user of empty titles only has zeros, no median and a text that says so.
    """
    clean = rows.select(user, F.trim(F.coalesce(F.col(title), F.lit(""))).alias("_t"))
    words = F.regexp_extract_all("_t", F.lit("[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"), 0)
    acronym = F.exists(words, lambda w: (F.length(w) >= 2) & (F.upper(w) == w) & w.rlike("[A-Z]"))
    rate = {"colon": F.contains("_t", F.lit(":")), "question": F.contains("_t", F.lit("?")), "acronym": acronym}
    there = F.length("_t") > 0
    share = {n: F.coalesce(F.avg(F.when(there, c.cast("double"))), F.lit(0.0)) for n, c in rate.items()}
    found = clean.groupBy(user).agg(
        F.count(F.when(there, 1)).alias("titles"),
        F.round(F.percentile(F.when(there, F.size(words)), F.lit(0.5)), 6).alias("median_words"),
        *(c.alias(f"_{n}") for n, c in share.items()),
    )
    percent = {n: F.bround(F.col(f"_{n}") * 100).cast("int").cast("string") for n in rate}
    median = F.regexp_replace(F.col("median_words").cast("string"), r"\.0$", "")
    text = F.concat(
        F.lit("Historical titles typically contain "), median, F.lit(" words; "), percent["colon"], F.lit("% use a colon, "), percent["question"],
        F.lit("% are questions, and "), percent["acronym"], F.lit("% contain an uppercase acronym. " + STYLE_ADVICE),
    )
    rates = [F.round(F.col(f"_{n}"), 6).alias(f"{n}_rate") for n in rate]
    return found.select(user, "titles", "median_words", *rates, F.when(F.col("titles") > 0, text).otherwise(NO_STYLE).alias("summary"))
