"""The engine's registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import rouge, similarity, text
from scriptorium.operators import datasets, factors, pools, preferences, profiles, ranking, retrieval, selection, user_heads, validate
from scriptorium.plans import fixtures
from scriptorium.sources.tables import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Frames:
    """The domain frames of one data folder, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship_package(spark)
        self.items = fixtures.history(spark, sf_dir)
        self.samples = fixtures.samples(spark, sf_dir)

    @cached_property
    def documents(self) -> DataFrame:
        return fixtures.table(self.spark, self.dir, "documents")

    @cached_property
    def embeddings(self) -> DataFrame:
        return fixtures.table(self.spark, self.dir, "embeddings")

    @cached_property
    def rollouts(self) -> DataFrame:
        return fixtures.rollouts(self.spark, self.dir)

    @cached_property
    def retrieved(self) -> DataFrame:
        return retrieval.bm25(self.samples.withColumn("terms", F.col("source")), self.items)

    @cached_property
    def seeds(self) -> DataFrame:
        return pools.seeds(self.samples, self.retrieved, self.items)

    @cached_property
    def pool(self) -> DataFrame:
        return pools.candidate_pool(self.samples, self.retrieved, self.items)

    @cached_property
    def scored(self) -> DataFrame:
        return pools.score_pool(self.pool, self.samples)

    @cached_property
    def deltas(self) -> DataFrame:
        return pools.parent_deltas(self.scored)

    @cached_property
    def scores(self) -> DataFrame:
        """The lexical ranker: similarity of candidate and source text against the hidden label."""
        rows = self.scored.join(self.samples.select("id", F.array_distinct("source").alias("s")), "id")
        return rows.select(
            "id", "candidate_id", "pos", "type", F.col("rouge_l").alias("label"),
            F.round(text.jaccard(text.tokens("text"), F.col("s"), 1.0), 6).alias("score"),
        )

    @cached_property
    def lengths(self) -> DataFrame:
        """The second ranker: the number of words."""
        return self.pool.select("id", "candidate_id", F.size(text.tokens("text")).cast("double").alias("score"))

    @cached_property
    def visible(self) -> DataFrame:
        return profiles.visible_history(self.retrieved, self.samples, self.items, retrieval.TOP_K)

    @cached_property
    def preferences(self) -> DataFrame:
        return preferences.gold_preferences(preferences.reward_rollouts(self.rollouts))

    @cached_property
    def top_titles(self) -> DataFrame:
        best = self.retrieved.filter("rank = 1").select("id", "user_id", "pos")
        titled = best.join(self.items.select("user_id", "pos", "title"), ["user_id", "pos"]).select("id", "title")
        return self.samples.select("id", "target").join(titled, "id", "left").withColumn("title", F.coalesce("title", F.lit("")))

    @cached_property
    def sft(self) -> DataFrame:
        return datasets.output_only(self.pool, self.samples)

    @cached_property
    def crossover_sft(self) -> DataFrame:
        return datasets.crossover_examples(pools.crossover_pairs(self.seeds, 2), self.samples)


def rag_top1_eval(f: Frames) -> DataFrame:
    a, b = text.tokens("title"), text.tokens("target")
    rows = f.top_titles.withColumns({"a": a, "b": b})
    return rows.agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("title") != "").alias("valid"),
        F.round(F.avg(rouge.rouge_1(F.col("a"), F.col("b"))), 6).alias("rouge_1"),
        F.round(F.avg(rouge.rouge_l(F.col("a"), F.col("b"))), 6).alias("rouge_l"),
    )


def pool_oracle(f: Frames) -> DataFrame:
    grouped = f.scored.groupBy("id").agg(
        F.min_by("rouge_l", "pos").alias("seed0"),
        F.max(F.when(F.col("parent_a").isNull(), F.col("rouge_l"))).alias("best_seed"),
        F.max("rouge_l").alias("oracle"),
        (F.countDistinct(F.lower(F.trim("text"))) / F.count("*")).alias("unique_rate"),
    )
    means = (F.round(F.avg(c), 6).alias(c) for c in ("seed0", "best_seed", "oracle", "unique_rate"))
    return grouped.agg(F.count("*").alias("samples"), *means)


def pool_similarity(f: Frames) -> DataFrame:
    words = f.pool.select("id", "pos", text.tokens("text").alias("w"))
    pairs = words.toDF("id", "pa", "wa").join(words.toDF("id", "pb", "wb"), "id").filter("pa < pb")
    return pairs.groupBy("id").agg(
        F.count("*").alias("pairs"), F.round(F.avg(F.round(rouge.rouge_l(F.col("wa"), F.col("wb")), 8)), 6).alias("similarity")
    )


def user_macro(f: Frames) -> DataFrame:
    best = f.scored.groupBy("id").agg(F.max("rouge_l").alias("best"))
    users = best.join(f.samples.select("id", "user_id"), "id").groupBy("user_id").agg(
        F.avg("best").alias("m"), F.sum("best").alias("s"), F.count("*").alias("n")
    )
    return users.agg(
        F.count("*").alias("users"), F.round(F.avg("m"), 6).alias("user_macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("query_macro")
    )


def gap_closure(f: Frames) -> DataFrame:
    rows = ranking.ranked(f.scores).groupBy("id").agg(
        F.min_by("label", "pos").alias("s"), F.min_by("label", "rank").alias("r"), F.max("label").alias("o")
    )
    means = rows.agg(F.avg("s").alias("seed"), F.avg("r").alias("selected"), F.avg("o").alias("oracle"))
    gap = F.col("oracle") - F.col("seed")
    return means.select(
        F.round("seed", 6).alias("seed"),
        F.round("selected", 6).alias("selected"),
        F.round("oracle", 6).alias("oracle"),
        F.when(F.abs(gap) > 1e-12, F.round((F.col("selected") - F.col("seed")) / gap, 6)).alias("closure"),
    )


def corpus_bleu(f: Frames) -> DataFrame:
    return rouge.corpus_bleu(f.top_titles.select("id", F.col("title").alias("prediction"), F.col("target").alias("reference")))


def style_summary(f: Frames) -> DataFrame:
    """The style of the first line of every whole document, by source."""
    raw = f.documents.select(F.coalesce("source", F.lit("")).alias("user_id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))
    return profiles.style_summary(raw, "user_id", "title")


def warmup_balance(f: Frames) -> DataFrame:
    traced = F.col("example_id").endswith("task_0")
    return datasets.warmup_balance(f.sft.filter(traced), f.sft.filter(~traced), 0.5, "3")


def prompts(f: Frames) -> DataFrame:
    rows = f.samples.join(datasets.history_titles(f.visible), "id", "left")
    return rows.select("id", datasets.base_prompt(text.join_tokens(F.col("source")), F.col("history")).alias("prompt"))


def multitask_rows(f: Frames) -> DataFrame:
    examples = f.samples.filter("target <> ''").select("id", F.col("target").alias("output"))
    return datasets.multitask(examples, datasets.history_titles(f.visible).withColumnRenamed("history", "rationale"))


def title_factors(f: Frames) -> DataFrame:
    """A factor of an item is the first letter of each title token: a small matrix of each user."""
    rows = f.items.select("user_id", "pos", F.slice("words", 1, fixtures.TITLE_TOKENS).alias("w"))
    return rows.select(
        F.col("user_id").alias("id"), F.col("pos").alias("item"), F.explode(F.array_distinct(F.transform("w", lambda t: F.left(t, F.lit(1))))).alias("factor"),
        F.size("w").alias("title_tokens"),
    )


def rewrite_categories(f: Frames) -> DataFrame:
    rows = f.deltas.select(F.col("parent_text").alias("p"), F.col("text").alias("t"), "type")
    return rows.withColumn("category", similarity.rewrite_category(F.col("p"), F.col("t"))).groupBy("type", "category").agg(F.count("*").alias("n"))


def head_pairs(f: Frames) -> DataFrame:
    """Each vector is preferred, by the user that its label names, to the mean vector of all other labels; a fifth validates."""
    vectors = f.embeddings.select(F.col("label").cast("string").alias("user_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("chosen"))
    rows = vectors.select("user_id", F.posexplode("chosen").alias("i", "v"))
    own = rows.groupBy("user_id", "i").agg(F.sum("v").alias("os"), F.count("*").alias("on"))
    sums = own.groupBy("i").agg(F.sum("os").alias("s"), F.sum("on").alias("n"))
    gap = ((F.col("s") - F.col("os")) / F.greatest(F.col("n") - F.col("on"), F.lit(1))).alias("m")
    others = own.join(sums, "i").select("user_id", "i", gap).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("o"))
    part = F.when(F.pmod("vec_id", F.lit(5)) == 0, "validation").otherwise("train").alias("part")
    return vectors.join(others, "user_id").select("user_id", part, "chosen", F.transform("o", lambda x: x["m"]).alias("rejected"), F.lit(1.0).alias("weight"))


def _heads(f: Frames, training: user_heads.Training) -> DataFrame:
    pairs = head_pairs(f)
    size = f.embeddings.select(F.max(F.size("embedding"))).first()[0] or 0
    start = [0.0 if training.kind == "linear" else 1.0 / (k + 1) for k in range(size)] + [0.0]
    return user_heads.fit_user_heads(pairs, start, training)


def linear_heads(f: Frames) -> DataFrame:
    """A head for each label, from zero."""
    fitted = _heads(f, user_heads.Training(steps=10))
    return fitted.select("user_id", "pairs", "validation", F.round("loss", 4).alias("loss"), F.round("accuracy", 4).alias("accuracy"))


def adapter_heads(f: Frames) -> DataFrame:
    """An adapter for each label on a given head, with the state that validates best."""
    fitted = _heads(f, user_heads.Training("adapter", steps=8, patience=3))
    return fitted.select("user_id", "pairs", F.round("first_loss", 4).alias("first_loss"), F.round("loss", 4).alias("loss"), F.round("accuracy", 4).alias("accuracy"))


def completed_rankings(f: Frames) -> DataFrame:
    """A partial ranking that names only the seeds, completed by the other candidates."""
    named = f.pool.filter("parent_a IS NULL").select("id", (-F.col("pos")).alias("place"), "candidate_id")
    return validate.complete_ranking(named, f.pool.select("id", "pos", "candidate_id")).select("id", "candidate_id", "rank", "ranker_score")


def loo_bm25(f: Frames) -> DataFrame:
    """Every item of a deduplicated history, searched with its whole abstract among the others of its user."""
    keyed = f.items.filter((text.compact_key("abstract") != "") & (text.compact_key("title") != ""))
    kept = profiles.greedy_dedup(keyed).select("user_id", "pos")
    large = kept.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_HISTORY).select("user_id")
    items = keyed.join(kept, ["user_id", "pos"], "left_semi").join(large, "user_id", "left_semi")
    return retrieval.leave_one_out(items, F.slice("words", fixtures.TITLE_TOKENS + 1, 2147483647))


#: Smaller histories are not searched.
LEAST_HISTORY = 10
#: Resamples of paired differences and of corpus ROUGE.
DRAWS, ROUGE_DRAWS = 5000, 1000
GRID = (0.0, 0.25, 0.5, 0.75, 1.0)

QUERIES: dict[str, Callable[[Frames], DataFrame]] = {
    "bm25_topk": lambda f: f.retrieved.select("id", "pos", "rank", "score"),
    "rouge_scores": lambda f: f.scored.select("id", "candidate_id", "rouge_1", "rouge_l"),
    "rag_top1_eval": rag_top1_eval,
    "profile_clean": lambda f: profiles.clean(f.items).select("user_id", "pos", "id"),
    "profile_greedy_dedup": lambda f: profiles.greedy_dedup(profiles.clean(f.items)),
    "first_occurrence_dedup": lambda f: profiles.first_by_key(f.items, "user_id", "title", "pos").select("user_id", "pos", "title", "place"),
    "visible_history": lambda f: f.visible,
    "target_denylist": lambda f: profiles.deny_targets(f.items, f.samples).select("user_id", "pos"),
    "loo_bm25": loo_bm25,
    "jaccard_profile_rank": lambda f: retrieval.jaccard_rank(f.samples, f.items),
    "content_negatives": lambda f: retrieval.content_negatives(f.samples, f.items).select("id", "pos", "rank", "score"),
    "dense_topk": lambda f: retrieval.dense_top(
        f.embeddings, f.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    ).select("id", "pos", "rank", "score"),
    "hash_split": lambda f: f.items.select("id", text.hash_split("id", 0.05).alias("split")),
    "user_split": lambda f: profiles.user_split(f.items, 0.2, "7").select("user_id", "id", "split"),
    "split_disjointness": lambda f: profiles.disjoint_splits(f.items, "id", 0.05),
    "first_users": lambda f: profiles.first_users(f.samples, 10, 3).select("user_id", "id", "n"),
    "candidate_pool": lambda f: f.pool,
    "crossover_pairs": lambda f: pools.crossover_pairs(f.seeds, 2).drop("a_text", "b_text"),
    "pool_deltas": lambda f: f.deltas.select("id", "candidate_id", "parent_id", "parent_type", "rouge_l", "parent_rouge_l", "delta"),
    "mutation_delta": lambda f: ranking.win_tie_loss(f.deltas, "delta", 0.02, ("type", "parent_type")),
    "pool_oracle": pool_oracle,
    "per_type_table": lambda f: ranking.summary(f.scored, "rouge_l", ("type",)),
    "pool_similarity": pool_similarity,
    "fixed_width_pool": lambda f: pools.fixed_width(f.pool),
    "parent_quality_flags": lambda f: pools.parent_issues(f.pool),
    "combination_plan": lambda f: pools.combination_plan(f.seeds, f.seeds, 6),
    "parent_child_prefs": lambda f: preferences.parent_child(f.deltas),
    "pairs_all": lambda f: preferences.ranker_pairs(f.scored, "all_pairs"),
    "pairs_hard_negative": lambda f: preferences.ranker_pairs(f.scored, "hard_negative"),
    "pairs_top": lambda f: preferences.ranker_pairs(f.scored, "top_pairs"),
    "gold_preferences": lambda f: f.preferences,
    "preference_status": lambda f: f.preferences.groupBy("status").agg(F.count("*").alias("n")),
    "dpo_pairs": lambda f: preferences.dpo_pairs(f.preferences, f.rollouts),
    "dpo_loss": lambda f: f.preferences.select(
        "rollout_id",
        F.round(
            preferences.dpo_loss(
                F.col("chosen_reward"), F.col("rejected_reward"), 0.5 * F.col("chosen_reward"), 0.5 * F.col("rejected_reward")
            ), 8
        ).alias("loss"),
    ),
    "gated_pairs": lambda f: preferences.gated_pairs(f.scored),
    "sft_output_only": lambda f: f.sft,
    "crossover_sft": lambda f: f.crossover_sft.select("example_id", "action", "output"),
    "dual_operator_sft": lambda f: datasets.dual_operator(
        f.sft, f.crossover_sft.withColumn("id", F.substring_index("example_id", ":", 1))
    ),
    "multitask_rows": multitask_rows,
    "warmup_balance": warmup_balance,
    "prompts": prompts,
    "prompt_head_tail": lambda f: f.documents.select("doc_id", text.tokens("text").alias("w")).select(
        "doc_id", text.join_tokens(text.head_tail("w", 64)).alias("kept"), (F.size("w") > 64).alias("cut")
    ),
    "length_diagnostics": lambda f: datasets.length_diagnostics(f.documents, "text", 512),
    "text_keys": lambda f: f.documents.select(
        "doc_id",
        F.md5(text.compact_key("text")).alias("compact_key"),
        F.md5(text.spaced_key("text")).alias("spaced_key"),
        F.size(text.title_tokens("text")).cast("long").alias("title_tokens"),
    ),
    "leak_flags": lambda f: f.documents.select("doc_id", F.coalesce("text", F.lit("")).rlike(text.FORBIDDEN_TERMS).alias("forbidden")),
    "hit_mrr_ndcg": lambda f: ranking.hit_mrr_ndcg(f.scores),
    "regret_summary": lambda f: ranking.regrets(f.scores),
    "pair_accuracy": lambda f: ranking.pair_accuracy(f.scores),
    "rank_correlations": lambda f: ranking.rank_correlations(f.scores),
    "listwise_kl": lambda f: ranking.listwise_kl(f.scores),
    "rank_losses": lambda f: ranking.losses(f.scores),
    "blend_rankers": lambda f: ranking.blend(f.scores, f.lengths, 0.7),
    "alpha_grid": lambda f: ranking.select_alpha(f.scores, f.lengths, f.scores, GRID),
    "user_macro": user_macro,
    "gap_closure": gap_closure,
    "score_summary": lambda f: ranking.summary(f.scored, "rouge_l"),
    "win_tie_loss": lambda f: ranking.win_tie_loss(f.deltas, "delta", 0.02),
    "paired_bootstrap": lambda f: ranking.paired_bootstrap(
        f.deltas.select(F.concat_ws(":", "id", "candidate_id").alias("k"), "delta"), "delta", "k", DRAWS, "11"
    ),
    "corpus_bleu": corpus_bleu,
    "style_summary": style_summary,
    "factor_statistics": lambda f: factors.factor_statistics(title_factors(f)),
    "factor_pruning": lambda f: factors.prune(factors.factor_statistics(title_factors(f)), 0.05, 0.5).select("id", "factor", "support"),
    "factor_cover": lambda f: factors.greedy_cover(
        title_factors(f).select("id", F.col("item").cast("string").alias("feature"), "factor")
    ),
    "rewrite_categories": rewrite_categories,
    "linear_heads": linear_heads,
    "adapter_heads": adapter_heads,
    "completed_rankings": completed_rankings,
    "clean_titles": lambda f: f.documents.select("doc_id", F.md5(text.clean_title("text")).alias("title")),
    "contrast_rows": lambda f: profiles.contrast_rows(f.items, "user_id", "pos").select("user_id", "pos", "contrast"),
    "hash_sample": lambda f: selection.hash_sample(f.items, "id", 100, "5").select("id"),
    "calibration_split": lambda f: selection.calibration_split(f.samples, "user_id", "id", 1).select("user_id", "id", "part"),
    "changed_coverage": lambda f: f.deltas.select(
        "id", "candidate_id", F.round(selection.changed_coverage(F.col("parent_text"), F.col("text"), F.col("text")), 6).alias("coverage")
    ),
    "slate": lambda f: selection.slate(f.pool, {"profile_seed": 2, "task_seed": 1, "crossover": 1, "mutation": 3}),
    "complementary_pair": lambda f: selection.complementary_pair(f.seeds, f.samples),
    "pair_gate": lambda f: selection.pair_gate(selection.complementary_pair(f.seeds, f.samples)),
    "corpus_rouge_ci": lambda f: selection.corpus_rouge(f.top_titles, "title", "target", ROUGE_DRAWS, "13"),
    "head_soup": lambda f: ranking.average_heads(f.embeddings.select(F.transform("embedding", lambda x: x.cast("double")).alias("weights"))),
}


def queries() -> dict[str, Query]:
    from scriptorium.plans import compilers, construction, evaluation

    every = QUERIES | evaluation.QUERIES | compilers.QUERIES | construction.QUERIES
    return {name: (lambda spark, sf_dir, build=build: build(Frames(spark, sf_dir))) for name, build in every.items()}
