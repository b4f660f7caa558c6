"""Words of one family found by a join on keys, and pairs of parents chosen by what the second one really adds.

Two words are of one family if they are equal, or both have five letters or more
and share the first six, or are alike by .72 in matching blocks. The last is no
equality, but such words always share two letters that stand next to each other
or one apart in both: of M matched letters, 2 M >= .72 (m + n), the m + n - 2 M
others are too few to part all M - 1 neighbours by more than one. Words are so
joined on these pairs of letters, within lengths that can be as alike, and only
what meets is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.similarity import word_ratio
from scriptorium.functions.text import compact_key, jaccard, tokens
from scriptorium.operators.compilers import content_tokens

SHORTEST, PREFIX, ALIKE = 5, 6, 0.72


def family_keys(word: Column) -> Column:
    """Keys one of which two words of a family share: the word, its first six letters, its letter pairs next to each other or one apart."""
    n = F.length(word)
    at = F.sequence(F.lit(1), n)

    def pairs_of(step: int) -> Column:
        return F.transform(at, lambda k: F.concat(F.substr(word, k, F.lit(1)), F.substr(word, k + step, F.lit(1))))

    pairs = [pairs_of(1), pairs_of(2)]
    whole = F.filter(F.concat(*pairs), lambda p: F.length(p) == 2)
    first = F.when(n >= PREFIX, F.array(F.concat(F.lit("^"), F.left(word, F.lit(PREFIX))))).otherwise(F.array().cast("array<string>"))
    other = F.when(n >= SHORTEST, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("="), word)), first, other)


def family_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, a, b of all words a of ``left(id, word)`` and b of ``right(id, word)`` of the same id and family, each once.

    Null and empty words have no family. A comparison is made once for two
    words, however many ids have them.
    """

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        words = rows.filter(F.length("word") > 0).select("id", F.col("word").alias(name)).distinct()
        return words.withColumn("key", F.explode(family_keys(F.col(name))))

    shorter, longer = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    near = (2 * shorter >= ALIKE * (shorter + longer)) | F.col("key").startswith("^")
    met = keyed(left, "a").join(keyed(right, "b"), ["id", "key"]).filter((F.col("a") == F.col("b")) | ((shorter >= SHORTEST) & near))
    pairs = met.select("id", "a", "b").distinct()
    same = (F.col("a") == F.col("b")) | ((shorter >= PREFIX) & (F.left("a", F.lit(PREFIX)) == F.left("b", F.lit(PREFIX))))
    compared = pairs.filter(~same).select("a", "b").distinct().filter(word_ratio("a", "b") >= ALIKE)
    return pairs.filter(same).unionByName(pairs.join(compared, ["a", "b"]).select("id", "a", "b"))


def complementary_pairs(parents: DataFrame, queries: DataFrame, gap: float = 1.5, least_new: int = 1, floor: float = -2.5, ceiling: float = -0.25, alike: float = 0.92) -> DataFrame:
    """id, a_id, b_id, new_words, score, eligible of every id: its first parent A and the B that adds most, without a look at the target.

    ``parents(id, pos, candidate_id, text, mean_logprob, issues)``; issues are
    empty for a sound parent. There is no pair (nulls, a score of null) where
    there are fewer than two parents with a text, A is not sound, or no other
    sound one has another text less than ``alike`` to A's, a log-probability
    within ``gap`` of A's where both are known, and ``least_new`` words that the
    source supports and A has no word of the family of. A score is .50 of the
    quality by log-probability (.5 where unknown), .25 of up to three new words,
    .15 of the share of its words that the source has, .10 of its distance from
    A; of equal ones the first wins.
    """
    known = F.when(F.isnan("mean_logprob") | (F.abs("mean_logprob") == float("inf")), None).otherwise(F.col("mean_logprob"))
    filled = parents.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    rows = filled.select("id", "pos", "candidate_id", "text", known.alias("p"), (F.coalesce("issues", F.lit("")) == "").alias("sound"), content_tokens("text").alias("w"))
    first = rows.groupBy("id").agg(F.min_by(F.struct("candidate_id", "pos", "text", "p", "sound", "w"), "pos").alias("a"), F.count("*").alias("n"))
    usable = first.filter("n > 1 AND a.sound")
    source = queries.select("id", content_tokens("source_text").alias("q"))
    joined = rows.join(usable, "id").join(source, "id")
    closeness = jaccard(tokens("text"), tokens(F.col("a.text")), 1.0)
    other = F.col("sound") & (F.col("pos") != F.col("a.pos")) & (compact_key("text") != compact_key(F.col("a.text"))) & (closeness < alike)
    likely = F.col("p").isNull() | F.col("a.p").isNull() | (F.col("p") >= F.col("a.p") - gap)
    open_rows = joined.filter(other & likely).withColumn("closeness", closeness)

    # words of B that the source supports, less those in a family with a word of A
    named = F.concat_ws("|", "id", "candidate_id")
    supported = open_rows.select(named.alias("id"), F.explode(F.array_intersect("w", "q")).alias("word"))
    had = open_rows.select(named.alias("id"), F.explode("a.w").alias("word"))
    families = family_pairs(supported, had).select("id", F.col("a").alias("word")).distinct()
    fresh = supported.distinct().join(families, ["id", "word"], "left_anti").groupBy("id").agg(F.sort_array(F.collect_list("word")).alias("new"))
    eligible = open_rows.withColumn("_k", named).join(fresh.withColumnRenamed("id", "_k"), "_k").filter(F.size("new") >= least_new)
    quality = F.when(F.col("p").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("p") - floor) / (ceiling - floor))))
    grounding = F.size(F.array_intersect("w", "q")) / F.greatest(F.size("w"), F.lit(1))
    score = 0.50 * quality + 0.25 * F.least(F.lit(1.0), F.size("new") / 3.0) + 0.15 * grounding + 0.10 * (1 - F.col("closeness"))
    ranked = eligible.withColumn("score", F.round(score, 6))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "pos"))
    many = F.count("*").over(W.partitionBy("id"))
    best = ranked.withColumn("_n", place).withColumn("eligible", many).filter("_n = 1")
    best = best.select("id", F.col("candidate_id").alias("b_id"), F.array_join("new", " ").alias("new_words"), "score", "eligible")
    ids = parents.select("id").distinct().join(first.select("id", F.col("a.candidate_id").alias("a_id")), "id", "left")
    return ids.join(best, "id", "left").select("id", F.when(F.col("b_id").isNotNull(), F.col("a_id")).alias("a_id"), "b_id", "new_words", "score", F.coalesce("eligible", F.lit(0)).cast("long").alias("eligible"))
