"""Ranker-visible views, isolated histories, selections of users, official splits, rollouts and training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.rouge import rouge_l
from scriptorium.functions.text import compact_key, join_tokens, spaced_key, title_tokens, tokens
from scriptorium.operators.cells import best_in_cells
from scriptorium.operators.profiles import greedy_dedup
from scriptorium.operators.retrieval import best, jaccard_kernel
from scriptorium.sources.tables import materialize, number_rows

# Words that do not show content beside the title stop words' own kind.
CONTENT_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "based", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the",
    "to", "using", "via", "with", "approach", "method", "novel", "paper", "study", "new", "results",
)


def content_tokens(text: Column | str) -> Column:
    """Set of tokens of three letters or more that are no function word."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(*CONTENT_STOP_WORDS)))


def query_fallback(text: Column | str) -> Column:
    """The first twelve words of a source text, or a fixed title where there are fewer than two."""
    column = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9'_-]*"), 0)
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 12), " ")).otherwise(F.lit("Research Study"))


def user_seed(seed: str, user: Column | str) -> Column:
    """The first 32 bits of the sha256 of seed:user."""
    column = F.col(user) if isinstance(user, str) else user
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), column), 256), 1, 8), 16, 10).cast("long")


def retrieval_text(name: Column, factors: Column, context: Column) -> Column:
    """``name [factors: a, b] [context: c]``, each bracket only where it has something."""
    some = F.when(F.size(factors) > 0, F.concat(F.lit(" [factors: "), F.array_join(factors, ", "), F.lit("]"))).otherwise(F.lit(""))
    where = F.when(F.length(F.coalesce(context, F.lit(""))) > 0, F.concat(F.lit(" [context: "), context, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(name, F.lit("")), some, where)


def permutation(rows: DataFrame, key: str, variant: str, seed: str) -> DataFrame:
    """The rows of each id in an order by the sha256 of seed, id, variant and key; ``place`` counts from 1."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id"), F.lit(variant), F.col(key)), 256)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(order, key)))


def group_views(queries: DataFrame, retrieved: DataFrame, items: DataFrame, pool: DataFrame) -> DataFrame:
    """What a ranker may see of a query: titles of its retrieved items without the target, how many were left out, candidates.

    Titles keep the order of retrieval, candidates that of the pool; neither
    targets nor scores are columns.
    """
    titled = retrieved.join(items.select("user_id", "pos", "title"), ["user_id", "pos"]).filter(F.length(F.trim("title")) > 0)
    keyed = titled.join(queries.select("id", spaced_key("target").alias("_key")), "id")
    same = (F.col("_key") != "") & (spaced_key("title") == F.col("_key"))
    seen = keyed.groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(~same, F.struct("rank", F.trim("title").alias("t"))))).alias("_t"), F.count_if(same).alias("filtered")
    )
    listed = pool.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "candidate_id"))).alias("_c"))
    rows = queries.select("id", "user_id").join(seen, "id", "left").join(listed, "id", "left")
    return rows.select(
        "id",
        "user_id",
        F.coalesce(F.array_join(F.transform("_t", lambda x: x["t"]), "|"), F.lit("")).alias("profile_titles"),
        F.coalesce("filtered", F.lit(0)).alias("filtered"),
        F.coalesce(F.array_join(F.transform("_c", lambda x: x["candidate_id"]), "|"), F.lit("")).alias("candidates"),
    )


def listwise_views(scored: DataFrame, label: str = "rouge_l") -> DataFrame:
    """id with its candidates and their labels, aligned by place in the pool."""
    listed = scored.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "candidate_id", label))).alias("_c"))
    return listed.select("id", F.transform("_c", lambda x: x["candidate_id"]).alias("candidate_ids"), F.transform("_c", lambda x: x[label]).alias("label_scores"))


def isolated_profiles(queries: DataFrame, items: DataFrame) -> DataFrame:
    """For each query how many items of its user's deduplicated history stay, and how many go: those with the
    target as title or the query as abstract, by compact keys. Only equal keys are joined."""
    kept = items.join(greedy_dedup(items).select("user_id", "pos"), ["user_id", "pos"], "left_semi")
    keyed = kept.select("user_id", "pos", compact_key("title").alias("t"), compact_key("abstract").alias("a"))
    asked = queries.select("id", "user_id", compact_key("target").alias("target"), compact_key("source_text").alias("query"))
    by_title = asked.filter("target <> ''").join(keyed.withColumnRenamed("t", "target"), ["user_id", "target"]).select("id", "pos")
    by_text = asked.filter("query <> ''").join(keyed.withColumnRenamed("a", "query"), ["user_id", "query"]).select("id", "pos")
    gone = by_title.union(by_text).distinct().groupBy("id").agg(F.count("*").alias("removed"))
    sizes = keyed.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = queries.select("id", "user_id").join(sizes, "user_id", "left").join(gone, "id", "left").fillna(0, ["n", "removed"])
    return rows.select("id", (F.col("n") - F.col("removed")).alias("retained"), "removed")


def safe_titles(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Per user the first item of each title that is none of the user's targets, by spaced keys."""
    forbidden = queries.select("user_id", spaced_key("target").alias("_key")).filter("_key <> ''").distinct()
    keyed = items.withColumn("_key", spaced_key("title")).filter("_key <> ''")
    first = keyed.groupBy("user_id", "_key").agg(F.min(F.struct("pos", F.trim("title").alias("title"))).alias("f"))
    return first.join(forbidden, ["user_id", "_key"], "left_anti").select("user_id", "f.pos", "f.title")


def safe_history(queries: DataFrame, retrieved: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """The first ``most`` retrieved items of a query with different titles that are none of its user's targets."""
    forbidden = queries.select("user_id", spaced_key("target").alias("_key")).filter("_key <> ''").distinct()
    keyed = retrieved.join(items.select("user_id", "pos", "title"), ["user_id", "pos"]).withColumn("_key", spaced_key("title")).filter("_key <> ''")
    allowed = keyed.join(forbidden, ["user_id", "_key"], "left_anti")
    first = allowed.groupBy("id", "_key").agg(F.min(F.struct("rank", "pos")).alias("f")).select("id", "f.rank", "f.pos")
    return first.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("rank"))).filter(F.col("place") <= most)


def first_of_users(rows: DataFrame, user: str, order: str, users: int) -> DataFrame:
    """The first row of each user in file order, for the ``users`` users that come first."""
    first = rows.groupBy(user).agg(F.min(order).alias(order))
    return rows.join(F.broadcast(first.orderBy(order).limit(users)), [user, order], "left_semi")


def eligible_users(items: DataFrame, least: int, count: int, seed: str) -> DataFrame:
    """Of the users with ``least`` items or more after deduplication, ``count`` by the hash of seed and user; in order of name."""
    sizes = greedy_dedup(items).groupBy("user_id").agg(F.count("*").alias("items")).filter(F.col("items") >= least)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("user_id")), 256)
    return sizes.orderBy(order, "user_id").limit(count).withColumn("place", F.row_number().over(W.orderBy("user_id")))


def seeded_subset(rows: DataFrame, identifier: str, order: str, count: int, seed: str) -> DataFrame:
    """``count`` rows by the hash of seed and id, with their places in the original order."""
    chosen = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string")), 256), identifier).limit(count)
    return chosen.withColumn("place", F.row_number().over(W.orderBy(order)))  # count rows


def joined_or_counted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many rows of ``left`` have a partner, and how many are skipped for want of one."""
    there = right.select(key).distinct().withColumn("_there", F.lit(1))
    rows = left.join(there, key, "left")
    return rows.agg(F.count("*").alias("rows"), F.count("_there").alias("joined"), F.count_if(F.col("_there").isNull()).alias("missing"))


def official_splits(scored: DataFrame, queries: DataFrame, margin: float = 0.02) -> DataFrame:
    """Groups, candidates and pairs of the train, dev and test sets under namespaced ids, and the users they share.

    Users go to a set by the hash of their name; test groups have no pairs.
    """
    ratio = F.conv(F.substring(F.sha2(F.col("user_id"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)
    split = F.when(ratio < 0.6, "train").when(ratio < 0.8, "dev").otherwise("test")
    named = queries.select("id", "user_id", split.alias("split")).withColumn("sample_id", F.concat("split", F.lit(":"), "id"))
    rows = scored.join(named, "id")
    best = rows.select("split", "sample_id", "pos", "rouge_l")
    other = best.select("sample_id", F.col("pos").alias("p"), F.col("rouge_l").alias("r"))
    pairs = best.filter("split <> 'test'").join(other, "sample_id").filter(F.col("pos") < F.col("p"))
    counted = pairs.filter(F.round(F.abs(F.col("rouge_l") - F.col("r")), 8) >= margin).groupBy("split").agg(F.count("*").alias("pairs"))
    sizes = rows.groupBy("split").agg(F.countDistinct("sample_id").alias("groups"), F.count("*").alias("candidates"))
    several = named.groupBy("user_id").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared_users"))
    return sizes.join(counted, "split", "left").fillna(0, ["pairs"]).crossJoin(F.broadcast(several))


def distinct_responses(responses: DataFrame) -> DataFrame:
    """Responses of a rollout without empty and repeated outputs (whatever their case), numbered r0, r1, ... in order."""
    keyed = responses.withColumn("_key", F.lower(F.trim("output"))).filter("_key <> ''")
    first = keyed.groupBy("rollout_id", "_key").agg(F.min(F.struct("turn", "output")).alias("f"))
    n = F.row_number().over(W.partitionBy("rollout_id").orderBy("f.turn")) - 1
    return first.select("rollout_id", F.concat(F.lit("r"), n.cast("string")).alias("response_id"), "f.turn", F.col("f.output").alias("output"))


def crossover_sources(responses: DataFrame, parents: DataFrame) -> DataFrame:
    """The two texts that a rollout crosses: its first two different responses, or the first two parents where it has fewer.

    ``responses(rollout_id, turn, output)``, ``parents(rollout_id, pos, text)``.
    """
    mine = distinct_responses(responses).groupBy("rollout_id").agg(F.sort_array(F.collect_list(F.struct("turn", "output"))).alias("m"))
    theirs = parents.groupBy("rollout_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"))
    rows = theirs.join(mine, "rollout_id", "left")
    own = F.coalesce(F.size("m") >= 2, F.lit(False))
    pick = lambda i: F.when(own, F.get("m", F.lit(i))["output"]).otherwise(F.get("p", F.lit(i))["text"])
    return rows.select("rollout_id", F.when(own, "mutations").otherwise("parents").alias("source"), pick(0).alias("left"), pick(1).alias("right"))


def warmup_groups(queries: DataFrame, items: DataFrame, negatives: DataFrame, most: int = 2) -> DataFrame:
    """id, place, type, text, label and margin of the warm-up candidates: the target, then negatives of the own profile, then others.

    Profile titles come by token similarity to the source text, each title once
    and never the target; ``negatives(id, rank, title)`` follow by rank. The
    label is ROUGE-L against the target, the margin what it lacks to 1. Queries
    meet the titles of their user in cells; no row for a pair exists.
    """
    asked = queries.filter("target <> ''").select("id", "user_id", "target", title_tokens("source_text").alias("q"), spaced_key("target").alias("gold"))
    titled = items.select("user_id", "pos", "title", title_tokens("title").alias("t"), spaced_key("title").alias("key")).filter("key <> ''")
    # titles of one key and the same tokens are alike to every query, so the first stands for them
    titled = titled.groupBy("user_id", "key", "t").agg(F.min(F.struct(F.col("pos").cast("long").alias("pos"), "title")).alias("f")).select("user_id", "key", "t", "f.*")
    titled = materialize(titled, "titled")
    # a key has as many rows as ways to cut it into tokens: so many times ``most`` hold the best ``most`` keys
    ways = titled.groupBy("user_id", "key").count().agg(F.max("count").alias("n")).first()["n"] or 1
    kernel = jaccard_kernel("q", "t", "gold", "key")
    near = best(best_in_cells(asked.select("id", "user_id", "gold", "q"), titled, ["user_id"], None, kernel, most * ways), most * ways)
    near = near.join(asked.select("id", "user_id"), "id").join(titled.select("user_id", "pos", "key", "title"), ["user_id", "pos"])
    first = near.groupBy("id", "key").agg(F.min(F.struct((-F.col("score")).alias("s"), "pos", "title")).alias("f"))
    own = first.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("f.s", "f.pos"))).filter(F.col("n") <= most)
    mine = own.select("id", F.lit(1).alias("kind"), "n", "key", F.col("f.title").alias("text"))
    other = negatives.withColumn("key", spaced_key("title")).join(asked.select("id", "gold"), "id").filter("key <> gold AND key <> ''")
    other = other.groupBy("id", "key").agg(F.min(F.struct("rank", "title")).alias("f")).join(mine.select("id", "key"), ["id", "key"], "left_anti")
    rest = other.select("id", F.lit(2).alias("kind"), F.col("f.rank").alias("n"), "key", F.col("f.title").alias("text"))
    gold = asked.select("id", F.lit(0).alias("kind"), F.lit(0).alias("n"), F.col("gold").alias("key"), F.col("target").alias("text"))
    rows = gold.unionByName(mine).unionByName(rest).join(asked.select("id", "target"), "id")
    label = F.round(rouge_l(tokens("text"), tokens("target")), 8)
    names = F.array(*map(F.lit, ("gold_positive", "profile_negative", "content_negative")))
    return rows.select(
        "id", (F.row_number().over(W.partitionBy("id").orderBy("kind", "n")) - 1).alias("place"), F.get(names, F.col("kind")).alias("type"), "text", label.alias("label"),
    ).withColumn("margin", F.round(1 - F.col("label"), 8))


def compact_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def editor_examples(pool: DataFrame, queries: DataFrame, kind: str, most: int = 5) -> DataFrame:
    """Seed to target examples of one kind: the trace part and the output part of the response that is trained on.

    An id with more than ``most`` parents fails the query.

    ``output_only`` has no trace and a JSON output, ``plain`` the bare title,
    ``gold_aware`` a decision before the output, ``atomic`` the operations
    (the words that the target adds), ``conditional`` a trace only where the
    target adds a word to the parent, otherwise the plain kind of response.
    """
    by = W.partitionBy("id")
    parents = pool.filter("parent_a IS NULL").withColumn("n", F.count("*").over(by))
    many = F.assert_true(F.col("n") <= most, F.concat(F.lit(f"more than {most} parents: "), "id")).isNull()
    rows = parents.withColumn("_ok", many).filter("_ok").join(queries.select("id", "target"), "id").filter("target <> ''")
    added = F.array_except(tokens("target"), tokens("text"))
    output = compact_json(output=F.col("target"))
    rest = F.concat(F.substring(output, 11, 1 << 30))
    plain = F.trim(F.replace(F.col("target"), F.lit("\n"), F.lit(" ")))
    decided = compact_json(decision=F.when(F.size(added) == 0, "keep").otherwise("revise"), edit_action=F.concat(F.lit("add "), join_tokens(added)))
    atomic = compact_json(task_operations=added)
    opened = lambda x: F.concat(F.left(x, F.length(x) - 1), F.lit(',"output":'))
    traced = F.size(added) > 0
    trace, text = {
        "output_only": (F.lit(""), output),
        "plain": (F.lit(""), plain),
        "gold_aware": (opened(decided), rest),
        "atomic": (opened(atomic), rest),
        "conditional": (F.when(traced, opened(atomic)).otherwise(F.lit("")), F.when(traced, rest).otherwise(plain)),
    }[kind]
    return rows.select(
        F.concat_ws(":", "id", "candidate_id", F.lit(kind)).alias("example_id"), trace.alias("trace_text"), text.alias("output_text"),
        F.round(F.lit(1.0) / F.count("*").over(by), 8).alias("sample_weight"),
    )


def multi_parent_examples(pool: DataFrame, queries: DataFrame, seed: str, least: int = 3) -> DataFrame:
    """A full example of each id with all its seeds, permuted, and for training ids of ``least`` seeds one without the last of another order."""
    seeds = pool.filter("parent_a IS NULL").select("id", "candidate_id", "text")
    targets = queries.filter("target <> ''").select("id", "target", F.when(user_seed(seed, "id") % 20 == 0, "validation").otherwise("train").alias("split"))

    def variant(name: str, drop: int) -> DataFrame:
        listed = permutation(seeds, "candidate_id", name, seed).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "candidate_id"))).alias("p"))
        rows = listed.join(targets, "id").filter((F.size("p") >= least) & (F.col("split") == "train")) if drop else listed.join(targets, "id")
        kept = F.transform(F.slice("p", F.lit(1), F.size("p") - drop), lambda x: x["candidate_id"])
        return rows.select(F.concat_ws(":", "id", F.lit(name)).alias("example_id"), "split", F.array_join(kept, "|").alias("parents"), F.col("target").alias("output"))

    return variant("full", 0).unionByName(variant("dropout", 1))


def recovered_output(text: Column | str) -> Column:
    """The title on the last ``output:`` line of a trace: one line of at most 300 characters without a closing brace; null if there is none."""
    column = F.col(text) if isinstance(text, str) else text
    lines = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(?im)^\s*output\s*:\s*(.+)$"), 1)
    last = F.trim(F.regexp_replace(F.trim(F.get(lines, F.size(lines) - 1)), r"\}+$", ""))
    return F.when((F.length(last) > 0) & (F.length(last) <= 300), last)


def plain_output(text: Column | str) -> Column:
    """A response that is a bare title: no JSON, one line, at most 300 characters; null otherwise."""
    column = F.col(text) if isinstance(text, str) else text
    t = F.trim(F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    ok = (t != "") & ~F.substring(t, 1, 1).isin("{", "[") & ~F.contains(t, F.lit("\n")) & (F.length(t) <= 300)
    return F.when(ok, t)


def json_output(text: Column | str) -> Column:
    """The string field ``output`` of a JSON response, inside fences or other text and with trailing commas; null otherwise."""
    column = F.col(text) if isinstance(text, str) else text
    body = F.regexp_extract(F.coalesce(column, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.get_json_object(F.regexp_replace(body, r",\s*([}\]])", "$1"), "$.output")


def pair_annotations(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """A plain judgement of each pair: merge where both texts have target words that the other lacks, else keep the better one (A where equal)."""
    rows = pairs.join(queries.select("id", tokens("target").alias("gold")), "id")
    a, b = tokens("a_text"), tokens("b_text")
    own = lambda x, y: F.size(F.array_except(F.array_intersect(x, F.col("gold")), y))
    merge = (own(a, b) > 0) & (own(b, a) > 0)
    score = lambda x: F.round(rouge_l(x, F.col("gold")), 8)
    scored = rows.withColumns({"a_score": score(a), "b_score": score(b), "merge": merge})
    decision = F.when(F.col("merge"), "merge").when(F.col("a_score") >= F.col("b_score"), "keep_a").otherwise("keep_b")
    return scored.select("id", "a_candidate_id", "b_candidate_id", decision.alias("decision"), "a_score", "b_score")


def eligible_preferences(rewards: DataFrame, responses: DataFrame, margin: float = 0.03) -> DataFrame:
    """The best against the worst of a rollout's eligible responses, as pairs with a prompt; one response alone is no pair.

    ``rewards(rollout_id, response_id, reward)``, ``responses(rollout_id,
    response_id, output, prompt, eligible)``. How many responses there are is
    not checked here.
    """
    rows = rewards.join(responses.filter("eligible"), ["rollout_id", "response_id"])
    order = F.struct("reward", "response_id", "output", "prompt")
    ends = rows.groupBy("rollout_id").agg(F.max(order).alias("c"), F.min(order).alias("r"))
    gap = F.round(F.col("c.reward") - F.col("r.reward"), 8)
    kept = ends.filter((F.col("c.response_id") != F.col("r.response_id")) & (gap >= margin) & (F.coalesce("c.prompt", F.lit("")) != ""))
    return kept.select(
        F.concat("rollout_id", F.lit(":"), "c.response_id", F.lit(">"), "r.response_id").alias("pair_id"),
        F.col("c.output").alias("chosen"),
        F.col("r.output").alias("rejected"),
        gap.alias("margin"),
    )


def size_check(rows: DataFrame, users: int, queries: int) -> DataFrame:
    """Different users (empty names left out) and rows, and whether both are the expected numbers."""
    found = rows.agg(F.countDistinct(F.when(F.trim("user_id") != "", F.trim("user_id"))).alias("users"), F.count("*").alias("queries"))
    return found.withColumn("as_expected", (F.col("users") == users) & (F.col("queries") == queries))


def case_selections(rows: DataFrame, value: str, order: str, each: int = 3) -> DataFrame:
    """The lowest, the middle and the highest rows by value, ``each`` of them, a row once: part and place."""
    rows = materialize(rows, "cases")  # read three times: for the ranges, in them, and counted
    numbered = number_rows(rows, value, order).withColumnRenamed("number", "_n").withColumn("_n", F.col("_n") + 1)
    ranked = numbered.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all"))))
    middle = F.floor((F.col("_all") - each) / 2)
    part = F.when(F.col("_n") <= each, "bottom").when(F.col("_n") > F.col("_all") - each, "top")
    part = part.when((F.col("_n") > middle) & (F.col("_n") <= middle + each), "middle")
    place = F.row_number().over(W.partitionBy("part").orderBy("_n"))
    return ranked.withColumn("part", part).filter(F.col("part").isNotNull()).withColumn("place", place).drop("_n", "_all")


def evidence_lost(visible: DataFrame, most: int) -> DataFrame:
    """Per id the tokens of its history in rank order, and how many of its items lie wholly or partly beyond ``most`` of them."""
    sizes = visible.select("id", "rank", F.size(tokens(F.concat_ws(" ", "input", "output"))).alias("n"))
    ends = sizes.withColumn("end", F.sum("n").over(W.partitionBy("id").orderBy("rank")))
    return ends.groupBy("id").agg(
        F.sum("n").alias("tokens"), F.count_if(F.col("end") > most).alias("cut"), F.count_if(F.col("end") - F.col("n") >= most).alias("lost")
    )


def payload_errors(kind: str, payload: Column) -> Column:
    """What is missing in a JSON payload of a stage, comma-joined: features with name and context, factors, assignments, reasoning, a predicted title."""
    some = lambda path: F.length(F.trim(F.coalesce(F.get_json_object(payload, path), F.lit("")))) > 0
    features = F.from_json(F.get_json_object(payload, "$.features"), "array<struct<feature_name:string,context:string>>")
    factors = F.from_json(F.get_json_object(payload, "$.factors"), "array<string>")
    tests = {
        "features": {
            "object": features.isNull(),
            "empty": F.size(features) == 0,
            "name": F.exists(features, lambda x: F.length(F.trim(F.coalesce(x["feature_name"], F.lit("")))) == 0),
            "context": F.exists(features, lambda x: x["context"].isNull()),
        },
        "factors": {"object": factors.isNull(), "empty": F.size(F.filter(factors, lambda x: F.length(F.trim(x)) > 0)) == 0},
        "assignment": {"assignments": F.get_json_object(payload, "$.assignments").isNull()},
        "reasoning": {"reasoning": ~some("$.reasoning")},
        "prediction": {"predicted_title": ~some("$.predicted_title")},
    }[kind]
    return F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items()))), ",")


def proposal_errors(factors: Column, visible: Column, types: tuple[str, ...], least: int, most: int, evidence: int = 1) -> Column:
    """What is wrong with a list of proposed factors (factor_id, type, evidence_ids, direction), comma-joined."""
    low = lambda x: F.lower(F.trim(F.coalesce(x["direction"], F.lit(""))))
    ids = F.transform(factors, lambda x: x["factor_id"])
    tests = {
        "count": ~F.size(factors).between(least, most),
        "type": F.exists(factors, lambda x: ~x["type"].isin(*types)),
        "evidence": F.exists(
            factors, lambda x: (F.size(F.array_distinct(x["evidence_ids"])) < evidence) | (F.size(F.array_except(x["evidence_ids"], visible)) > 0)
        ),
        "direction": F.exists(factors, lambda x: low(x).isin("", "high", "medium", "low")),
        "repeated": F.size(F.array_distinct(ids)) < F.size(ids),
    }
    return F.array_join(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items()))), ",")
