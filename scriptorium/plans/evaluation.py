"""Registered queries of the ranker reports, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import rouge, text
from scriptorium.operators import evaluation as ev
from scriptorium.operators import preferences, ranking
from scriptorium.plans.oracles import _DCG, _WTL, _zscore, drawn, rouge_l, sql, tok
from scriptorium.sources.tables import materialize

GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
DRAWS = 5000


CTE = {
    "meth": """(SELECT id, unnest([{'m': 'ranker_top1', 'c': top, 'f': false}, {'m': 'task_seed_0', 'c': t0, 'f': false}, {'m': 'profile_seed_0', 'c': coalesce(p0, t0), 'f': p0 IS NULL},
        {'m': 'best_task_seed', 'c': tb, 'f': false}, {'m': 'best_profile_seed', 'c': coalesce(pb, tb), 'f': p0 IS NULL}, {'m': 'pool_oracle', 'c': best, 'f': false}]) AS u FROM (
        SELECT id, arg_min(candidate_id, rank) AS top, min(candidate_id) FILTER (oracle) AS best,
        coalesce(max(candidate_id) FILTER (candidate_id = 'task_0'), arg_min(candidate_id, pos) FILTER (type = 'task_seed')) AS t0,
        coalesce(max(candidate_id) FILTER (candidate_id = 'profile_0'), arg_min(candidate_id, pos) FILTER (type = 'profile_seed')) AS p0,
        arg_max(candidate_id, {'l': label, 'p': -pos}) FILTER (type = 'task_seed') AS tb, arg_max(candidate_id, {'l': label, 'p': -pos}) FILTER (type = 'profile_seed') AS pb FROM ranked GROUP BY id))""",
    "mixed": f"""(SELECT id, candidate_id, pos, label, alpha, round((1 - alpha) * a + alpha * b, 6) AS score FROM (SELECT id, candidate_id, pos, label, {_zscore('score')} AS a FROM sc)
        JOIN (SELECT id, candidate_id, {_zscore('score')} AS b FROM sc2) USING (id, candidate_id), (VALUES (0e0), (25e-2), (5e-1), (75e-2), (1e0)) g(alpha))""",
    "took": """(SELECT alpha, id, user_id, best - got AS regret FROM (SELECT alpha, id, max(label) AS best, arg_max(label, {'s': score, 'p': -pos}) AS got FROM mixed GROUP BY alpha, id) JOIN samp USING (id))""",
    "own": """(SELECT user_id, alpha, regret, hit, queries FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY regret, hit DESC, alpha) AS place FROM (
        SELECT user_id, alpha, round(avg(regret), 6) AS regret, round(avg(CASE WHEN regret <= 1e-8 THEN 1e0 ELSE 0e0 END), 6) AS hit, count(*) AS queries FROM took GROUP BY user_id, alpha)) WHERE place = 1)""",
}
BEFORE = {"meth": "ranked", "mixed": "sc sc2", "took": "sc sc2 samp", "own": "sc sc2 samp"}
CHAIN = {"took": "mixed", "own": "mixed took"}


def own_sql(uses: str, body: str, base: str = "") -> str:
    """``body`` after the named expressions of this module, those before them, and the shared ones."""
    names = [n for n in CTE if n in {*uses.split(), *(x for u in uses.split() for x in CHAIN.get(u, "").split())}]
    parts = "".join(f", {n} AS MATERIALIZED {CTE[n]}" for n in names)
    return sql(" ".join([base, *(BEFORE[n] for n in names)]), parts + " " + body)


def method_labels(f) -> DataFrame:
    return ev.methods(f.scores).join(f.scores.select("id", "candidate_id", "label"), ["id", "candidate_id"])


def predictions(f, broken: bool = False) -> DataFrame:
    """The ranker's rankings as a file of predictions; ``broken`` spoils some of them in every way that is checked."""
    rows = ranking.ranked(f.scores).select("id", "rank", "candidate_id")
    top = rows.filter("rank = 1").select("id", F.col("candidate_id").alias("selected_id"))
    rows = rows.join(top, "id")
    if not broken:
        return rows
    n = F.substring("id", 2, 20).cast("long") % 5
    spoiled = (
        F.when((n == 1) & (F.col("rank") == 2), F.lit("stranger")).when((n == 2) & (F.col("rank") == 2), F.col("selected_id")).otherwise(F.col("candidate_id"))
    )
    return rows.filter(~((n == 3) & (F.col("rank") == 1))).withColumn("candidate_id", spoiled)


def id_sets(f) -> DataFrame:
    """Predictions, groups, labels and a manifest of two thirds of the samples: whose ids agree."""
    manifest = f.samples.filter(F.substring("id", 2, 20).cast("long") % 3 != 0)
    return ev.set_alignment(predictions=predictions(f), groups=f.pool, labels=f.samples.filter("target <> ''"), manifest=manifest)


def epochs(f) -> DataFrame:
    """A checkpoint for each alpha of the grid: the metrics of the mixed scores."""
    mixed = materialize(ev.mixed_scores(f.scores, f.lengths, f.scores, GRID), "mixed")
    pairs = materialize(preferences.ranker_pairs(f.scored, "all_pairs").select("id", "chosen_id", "rejected_id", "margin"), "pairs")
    rows = None
    for k, alpha in enumerate(GRID):
        scores = mixed.filter(F.col("alpha") == alpha).select("id", "candidate_id", "pos", "label", "score")
        one = ev.group_metrics(scores).crossJoin(ev.pair_metrics(pairs, scores).select(F.col("accuracy").alias("pair_accuracy"), F.col("loss").alias("pair_loss")))
        one = one.select(F.lit(k).alias("epoch"), "pair_accuracy", "pair_loss", "accuracy", "loss", "regret")
        rows = one if rows is None else rows.unionByName(one)
    return materialize(rows, "epochs")


def checkpoint_choice(f) -> DataFrame:
    trained = epochs(f)
    return ev.checkpoint_choice(trained, "listwise").unionByName(ev.checkpoint_choice(trained, "pairwise"))


def hybrid_losses(f) -> DataFrame:
    """Listwise divergence, the three pairwise losses, and their hybrid: listwise plus half of all pairs."""
    out = ranking.listwise_kl(f.scores)
    for name, most in (("all_pairs", 0), ("hard_negative", 6), ("top_pairs", 6)):
        out = out.join(ev.group_pairwise(f.scores, name, 0.02, most).withColumnRenamed("pairwise", name), "id", "left")
    return out.withColumn("hybrid", F.round(F.col("kl") + 0.5 * F.coalesce("all_pairs", F.lit(0.0)), 6))


def mutation_factors(f) -> DataFrame:
    """Gains of mutations by their factor (the place of the seed that they edit)."""
    rows = f.deltas.filter("type = 'mutation'").withColumn("factor", F.substring_index("candidate_id", "_", -1))
    return ranking.win_tie_loss(rows, "delta", 0.02, ("factor",))


def missing_parents(f) -> DataFrame:
    """Children, and those whose parent is missing where the pool has lost its profile seeds."""
    parents = f.scored.filter("type <> 'profile_seed'").select("id", F.col("candidate_id").alias("parent_a"), F.lit(1).alias("there"))
    children = f.scored.filter("parent_a IS NOT NULL").join(parents, ["id", "parent_a"], "left")
    return children.groupBy("type").agg(F.count("*").alias("children"), F.count_if(F.col("there").isNull()).alias("missing"))


def raw_blend(f) -> DataFrame:
    """The lexical score with a small share of the raw length."""
    mixed = ev.mixed_scores(f.scores, f.lengths, f.scores, (0.05,), standardize=False)
    rank = F.row_number().over(ranking.group().orderBy(F.desc("score"), "candidate_id"))
    return mixed.select("id", "candidate_id", "score", rank.alias("rank"))


def history_pairs(f) -> DataFrame:
    """The ranker's choice against the best history title, query by query."""
    titles = f.top_titles.filter("title <> ''")
    right = titles.select("id", F.round(rouge.rouge_l(text.tokens("title"), text.tokens("target")), 8).alias("value"))
    left = method_labels(f).filter("method = 'ranker_top1'").select("id", F.col("label").alias("value"))
    return ev.paired_examples(left, right)


def bootstrap_intervals(f) -> DataFrame:
    rows = f.deltas.select(F.concat_ws(":", "id", "candidate_id").alias("k"), "delta")
    return ev.intervals(ranking.bootstrap_means(rows, ("delta",), "k", DRAWS, "11"), "delta", DRAWS)


QUERIES = {
    "method_table": lambda f: ev.method_table(f.scores, f.scored),
    "ranking_report": lambda f: ev.ranking_report(f.scores),
    "type_report": lambda f: ev.type_report(f.scores),
    "against_baselines": lambda f: ev.against_baselines(f.scores, DRAWS, "100"),
    "bootstrap_intervals": bootstrap_intervals,
    "id_alignment": id_sets,
    "permutation_errors": lambda f: ev.permutation_errors(predictions(f, broken=True), f.pool),
    "group_metrics": lambda f: ev.group_metrics(f.scores),
    "pair_metrics": lambda f: ev.pair_metrics(preferences.ranker_pairs(f.scored, "all_pairs"), f.scores),
    "checkpoint_choice": checkpoint_choice,
    "hybrid_losses": hybrid_losses,
    "user_alphas": lambda f: ev.user_alphas(f.scores, f.lengths, f.scores, f.samples.select("id", "user_id"), GRID),
    "route_report": lambda f: ev.route_report(f.scores, f.lengths, f.scores, f.samples.select("id", "user_id"), GRID),
    "raw_blend": raw_blend,
    "mutation_factors": mutation_factors,
    "missing_parents": missing_parents,
    "history_pairs": history_pairs,
    "operation_oracle": lambda f: ev.operation_oracle(f.scored),
}

def _pairwise(name: str, order: str, most: str, where: str = "") -> str:
    return f"""(SELECT id, round(avg(ln(1e0 + exp(-CASE WHEN gap < 0 THEN -delta ELSE delta END)) * (1 + least(abs(gap), 1e0))), 6) AS {name} FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order} pa, pb) AS n FROM gaps {where}) {most} GROUP BY id)"""


def oracle_sql() -> dict[str, str]:
    from scriptorium.plans.oracles import oracle_sql as shared

    pair_rows = shared()["pairs_all"]
    mean = lambda x: f"round(coalesce(avg({x}), 0), 6)"
    labelled = "(SELECT id, u.m AS method, u.f AS fallback, label FROM meth JOIN sc ON sc.id = meth.id AND sc.candidate_id = u.c)".replace("SELECT id", "SELECT meth.id AS id")
    epoch = """, mx AS (SELECT *, CAST(alpha * 4 AS INT) AS epoch FROM mixed),
        kl AS (SELECT epoch, id, sum(p * (ln(p + 1e-12) - ln(q + 1e-12))) AS kl FROM (SELECT epoch, id, ep / sum(ep) OVER (PARTITION BY epoch, id) AS p, eq / sum(eq) OVER (PARTITION BY epoch, id) AS q FROM (
          SELECT epoch, id, exp((label - max(label) OVER (PARTITION BY epoch, id)) / 1e-1) AS ep, exp(score - max(score) OVER (PARTITION BY epoch, id)) AS eq FROM mx)) GROUP BY epoch, id),
        gm AS (SELECT epoch, round(avg(CASE WHEN s = l THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(round(kl, 6)), 6) AS loss, round(avg(m - got), 6) AS regret FROM (
          SELECT epoch, id, arg_max(pos, {'s': score, 'p': -pos}) AS s, arg_max(label, {'s': score, 'p': -pos}) AS got, arg_max(pos, {'s': label, 'p': -pos}) AS l, max(label) AS m FROM mx GROUP BY epoch, id) JOIN kl USING (epoch, id) GROUP BY epoch),
        pm AS (SELECT epoch, round(count(*) FILTER (d > 0) / count(*)::DOUBLE, 6) AS pair_accuracy, round(sum(ln(1e0 + exp(-d)) * (1 + margin)) / count(*), 6) AS pair_loss FROM (
          SELECT c.epoch, margin, c.score - r.score AS d FROM prs12 JOIN mx c ON c.id = prs12.id AND c.candidate_id = chosen_id JOIN mx r ON r.id = prs12.id AND r.candidate_id = rejected_id AND r.epoch = c.epoch) GROUP BY epoch)"""
    routes = "(SELECT id, regret, unnest(list_filter([CASE WHEN alpha = 0 THEN 'global' END, CASE WHEN alpha = 1 THEN 'user_only' END, CASE WHEN alpha = shared THEN 'shared_alpha' END, CASE WHEN alpha = mine THEN 'per_user_alpha' END], lambda x: x IS NOT NULL)) AS route FROM took JOIN (SELECT user_id, alpha AS mine FROM own) USING (user_id), (SELECT arg_min(alpha, {'r': r, 'h': -h, 'a': alpha}) AS shared FROM (SELECT alpha, round(avg(regret), 6) AS r, round(avg(CASE WHEN regret <= 1e-8 THEN 1e0 ELSE 0e0 END), 6) AS h FROM took GROUP BY alpha)))"
    number = "CAST(substr(id, 2) AS BIGINT)"
    return {
        "method_table": own_sql(
            "meth",
            """SELECT u.m AS method, count(*) AS queries, count(*) FILTER (u.f) AS fallbacks, round(avg(rouge_1), 6) AS rouge_1, round(avg(rouge_l), 6) AS rouge_l
            FROM meth JOIN scored ON scored.id = meth.id AND scored.candidate_id = u.c GROUP BY u.m""",
            "scored",
        ),
        "ranking_report": sql(
            "ranked prs sc",
            f""", h AS (SELECT id, min(rank) FILTER (oracle) AS first, {_DCG} FROM ranked GROUP BY id),
            g AS (SELECT id, round(best - selected, 6) AS regret, round(CASE WHEN best - worst > 1e-12 THEN (best - selected) / (best - worst) ELSE 0e0 END, 6) AS nr FROM (
              SELECT id, max(label) AS best, min(label) AS worst, arg_min(label, rank) AS selected FROM ranked GROUP BY id)),
            p AS (SELECT id, count(*) AS pairs, count(*) FILTER (ds * dl > 0) AS correct FROM prs WHERE abs(dl) >= 2e-2 GROUP BY id),
            k AS (SELECT id, round(sum(p * (ln(p + 1e-12) - ln(q + 1e-12))), 6) AS kl FROM (SELECT id, ep / sum(ep) OVER (PARTITION BY id) AS p, eq / sum(eq) OVER (PARTITION BY id) AS q FROM (
              SELECT id, exp((label - max(label) OVER (PARTITION BY id)) / 1e-1) AS ep, exp(score - max(score) OVER (PARTITION BY id)) AS eq FROM sc)) GROUP BY id),
            l AS (SELECT id, CASE WHEN count(*) < 2 OR stddev_pop(score) <= 1e-12 OR stddev_pop(label) <= 1e-12 THEN NULL ELSE round(covar_pop(score, label) / (stddev_pop(score) * stddev_pop(label)), 6) END AS pearson,
              CASE WHEN count(*) < 2 OR stddev_pop(rs) <= 1e-12 OR stddev_pop(rl) <= 1e-12 THEN NULL ELSE round(covar_pop(rs, rl) / (stddev_pop(rs) * stddev_pop(rl)), 6) END AS spearman FROM (
              SELECT *, rank() OVER (PARTITION BY id ORDER BY score) + (count(*) OVER (PARTITION BY id, score) - 1) / 2e0 AS rs, rank() OVER (PARTITION BY id ORDER BY label) + (count(*) OVER (PARTITION BY id, label) - 1) / 2e0 AS rl FROM sc) GROUP BY id),
            t AS (SELECT id, CASE WHEN sqrt((c + d + ts)::DOUBLE * (c + d + tl)) > 1e-12 THEN round((c - d) / sqrt((c + d + ts)::DOUBLE * (c + d + tl)), 6) END AS kendall FROM (
              SELECT id, count(*) FILTER (abs(ds) > 1e-12 AND abs(dl) > 1e-12 AND ds * dl > 0) AS c, count(*) FILTER (abs(ds) > 1e-12 AND abs(dl) > 1e-12 AND ds * dl < 0) AS d,
              count(*) FILTER (abs(ds) <= 1e-12 AND abs(dl) > 1e-12) AS ts, count(*) FILTER (abs(dl) <= 1e-12 AND abs(ds) > 1e-12) AS tl FROM prs GROUP BY id))
            SELECT count(*) AS queries, {', '.join(f'{mean(f"CASE WHEN first <= {n} THEN 1e0 ELSE 0e0 END")} AS hit_{n}' for n in (1, 3, 5, 10))}, {mean('round(1e0 / first, 6)')} AS mrr,
            {', '.join(f'{mean(f"round(CASE WHEN i{n} <= 1e-12 THEN 0e0 ELSE d{n} / i{n} END, 6)")} AS ndcg_{n}' for n in (3, 5, 10))}, {mean('regret')} AS regret,
            round(quantile_cont(regret, 5e-1), 6) AS regret_median, round(quantile_cont(regret, 9e-1), 6) AS regret_p90, {mean('nr')} AS normalized_regret,
            round(coalesce(sum(correct) / sum(pairs)::DOUBLE, 0), 6) AS pair_accuracy_micro, round(coalesce(avg(correct / pairs::DOUBLE), 0), 6) AS pair_accuracy_macro, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs,
            {mean('kl')} AS listwise_kl, {', '.join(f'{mean(n)} AS {n}, count({n}) AS {n}_queries' for n in ('pearson', 'spearman', 'kendall'))}
            FROM h JOIN g USING (id) JOIN k USING (id) LEFT JOIN l USING (id) LEFT JOIN t USING (id) LEFT JOIN p USING (id)""",
        ),
        "type_report": sql(
            "ranked",
            """SELECT type, candidates, mean_label, selected, oracle_queries, round(selected / n::DOUBLE, 6) AS selected_rate, round(oracle_queries / n::DOUBLE, 6) AS oracle_queries_rate FROM (
            SELECT type, count(*) AS candidates, round(avg(label), 6) AS mean_label, count(*) FILTER (rank = 1) AS selected, count(DISTINCT id) FILTER (oracle) AS oracle_queries FROM ranked GROUP BY type),
            (SELECT count(DISTINCT id) AS n FROM ranked)""",
        ),
        "against_baselines": own_sql(
            "meth",
            f""", lab AS {labelled}, rows_ AS (SELECT b.id, b.method AS baseline, t.label AS top, b.label AS base, o.label AS best, round(t.label - b.label, 8) AS delta FROM lab b
              JOIN lab t ON t.id = b.id AND t.method = 'ranker_top1' JOIN lab o ON o.id = b.id AND o.method = 'pool_oracle' WHERE b.method IN ('task_seed_0', 'profile_seed_0', 'pool_oracle')),
            m AS (SELECT baseline, b, round(sum(w * delta) / sum(w), 9) AS m FROM (SELECT baseline, b, delta, {drawn('100', 'id')} AS w FROM rows_, range({DRAWS}) t(b)) GROUP BY baseline, b HAVING sum(w) > 0)
            SELECT baseline, queries, mean_delta, median_delta, wins, ties, losses, gap_closed, ci_low, ci_high FROM (
              SELECT baseline, count(*) AS queries, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 5e-1), 6) AS median_delta, count(*) FILTER (delta > 1e-12) AS wins,
              count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses,
              CASE WHEN abs(avg(best) - avg(base)) > 1e-12 THEN round((avg(top) - avg(base)) / (avg(best) - avg(base)), 6) END AS gap_closed FROM rows_ GROUP BY baseline)
            JOIN (SELECT baseline, round(quantile_cont(m, 25e-3), 6) AS ci_low, round(quantile_cont(m, 975e-3), 6) AS ci_high FROM m GROUP BY baseline) USING (baseline)""",
            "sc",
        ),
        "bootstrap_intervals": sql(
            "deltas",
            f""", m AS (SELECT b, round(sum(w * delta) / sum(w), 9) AS m FROM (SELECT b, delta, {drawn('11')} AS w FROM (SELECT id || ':' || candidate_id AS k, delta FROM deltas), range({DRAWS}) t(b)) GROUP BY b HAVING sum(w) > 0),
            a AS (SELECT list(m ORDER BY m) AS a, quantile_cont(m, 25e-3) AS lo, quantile_cont(m, 975e-3) AS hi FROM m)
            SELECT round(lo, 6) AS linear_low, round(hi, 6) AS linear_high, round(a[{int(0.025 * (DRAWS - 1)) + 1}], 6) AS truncated_low, round(a[{int(0.975 * (DRAWS - 1)) + 1}], 6) AS truncated_high,
            round(a[CAST(floor({DRAWS - 1} * 25e-3) AS BIGINT) + 1], 6) AS outer_low, round(a[CAST(ceil({DRAWS - 1} * 975e-3) AS BIGINT) + 1], 6) AS outer_high,
            round(a[{int(0.025 * DRAWS) + 1}], 6) AS count_low, round(a[{int(0.975 * DRAWS) + 1}], 6) AS count_high FROM a""",
        ),
        "id_alignment": sql(
            "samp pool sc",
            f"""SELECT held_by, count(*) AS ids FROM (SELECT id, string_agg(name, ',' ORDER BY name) AS held_by FROM (
            SELECT DISTINCT id, 'predictions' AS name FROM sc UNION ALL SELECT DISTINCT id, 'groups' FROM pool UNION ALL SELECT id, 'labels' FROM samp WHERE target <> ''
            UNION ALL SELECT id, 'manifest' FROM samp WHERE {number} % 3 <> 0) GROUP BY id) GROUP BY held_by""",
        ),
        "permutation_errors": sql(
            "ranked pool",
            f""", q AS (SELECT id, rank, CASE WHEN {number} % 5 = 1 AND rank = 2 THEN 'stranger' WHEN {number} % 5 = 2 AND rank = 2 THEN s ELSE candidate_id END AS c, s FROM ranked
              JOIN (SELECT id, candidate_id AS s FROM ranked WHERE rank = 1) USING (id) WHERE NOT ({number} % 5 = 3 AND rank = 1)),
            a AS (SELECT id, list(DISTINCT candidate_id) AS known FROM pool GROUP BY id), b AS (SELECT id, count(*) AS n, list(DISTINCT c) AS got, arg_min(c, rank) AS first, min(s) AS s FROM q GROUP BY id)
            SELECT id, array_to_string(list_filter([CASE WHEN coalesce(n, 0) > len(got) THEN 'repeated' END, CASE WHEN len(list_filter(got, lambda x: NOT list_contains(known, x))) > 0 THEN 'unknown' END,
            CASE WHEN len(list_filter(known, lambda x: NOT list_contains(got, x))) > 0 THEN 'missing' END, CASE WHEN coalesce(first = s, false) THEN NULL ELSE 'top' END], lambda x: x IS NOT NULL), ',') AS errors
            FROM (SELECT id, coalesce(known, []) AS known, coalesce(got, []) AS got, n, first, s FROM a FULL JOIN b USING (id))""",
        ),
        "group_metrics": sql(
            "sc",
            """SELECT count(*) AS queries, round(avg(CASE WHEN s = l THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(kl), 6) AS loss, round(avg(m - got), 6) AS regret FROM (
            SELECT id, arg_max(pos, {'s': score, 'p': -pos}) AS s, arg_max(label, {'s': score, 'p': -pos}) AS got, arg_max(pos, {'s': label, 'p': -pos}) AS l, max(label) AS m FROM sc GROUP BY id)
            JOIN (SELECT id, round(sum(p * (ln(p + 1e-12) - ln(q + 1e-12))), 6) AS kl FROM (SELECT id, ep / sum(ep) OVER (PARTITION BY id) AS p, eq / sum(eq) OVER (PARTITION BY id) AS q FROM (
            SELECT id, exp((label - max(label) OVER (PARTITION BY id)) / 1e-1) AS ep, exp(score - max(score) OVER (PARTITION BY id)) AS eq FROM sc)) GROUP BY id) USING (id)""",
        ),
        "pair_metrics": sql(
            "sc",
            f"""SELECT count(*) AS pairs, round(count(*) FILTER (d > 0) / count(*)::DOUBLE, 6) AS accuracy, round(sum(ln(1e0 + exp(-d)) * (1 + margin)) / count(*), 6) AS loss FROM (
            SELECT margin, c.score - r.score AS d FROM ({pair_rows}) p JOIN sc c ON c.id = p.id AND c.candidate_id = chosen_id JOIN sc r ON r.id = p.id AND r.candidate_id = rejected_id)""",
        ),
        "checkpoint_choice": own_sql(
            "mixed",
            f""", prs12 AS ({pair_rows}) {epoch}
            SELECT 'listwise' AS objective, 'mean_regret' AS selection, arg_max(epoch, {{'a': -regret, 'b': accuracy, 'c': -loss, 'e': -epoch}}) AS epoch FROM gm
            UNION ALL SELECT 'pairwise', 'pair_accuracy', arg_max(epoch, {{'a': pair_accuracy, 'b': -pair_loss, 'e': -epoch}}) FROM pm""",
        ),
        "hybrid_losses": sql(
            "sc",
            f""", gaps AS (SELECT a.id, a.pos AS pa, b.pos AS pb, a.label - b.label AS gap, a.score - b.score AS delta, greatest(a.label, b.label) >= m - 1e-8 AS top FROM sc a JOIN sc b ON a.id = b.id AND a.pos < b.pos
              JOIN (SELECT id, max(label) AS m FROM sc GROUP BY id) x ON x.id = a.id WHERE abs(a.label - b.label) >= 2e-2),
            k AS (SELECT id, round(sum(p * (ln(p + 1e-12) - ln(q + 1e-12))), 6) AS kl FROM (SELECT id, ep / sum(ep) OVER (PARTITION BY id) AS p, eq / sum(eq) OVER (PARTITION BY id) AS q FROM (
              SELECT id, exp((label - max(label) OVER (PARTITION BY id)) / 1e-1) AS ep, exp(score - max(score) OVER (PARTITION BY id)) AS eq FROM sc)) GROUP BY id)
            SELECT id, kl, all_pairs, hard_negative, top_pairs, round(kl + 5e-1 * coalesce(all_pairs, 0), 6) AS hybrid FROM k LEFT JOIN {_pairwise('all_pairs', '', '')} USING (id)
            LEFT JOIN {_pairwise('hard_negative', 'round(abs(delta), 8), round(abs(gap), 8),', 'WHERE n <= 6')} USING (id) LEFT JOIN {_pairwise('top_pairs', 'round(abs(gap), 8), round(abs(delta), 8),', 'WHERE n <= 6', 'WHERE top')} USING (id)""",
        ),
        "user_alphas": own_sql("own", "SELECT user_id, alpha, regret, hit, queries FROM own"),
        "route_report": own_sql("own", f"SELECT route, count(*) AS queries, round(avg(regret), 6) AS regret, round(avg(CASE WHEN regret <= 1e-8 THEN 1e0 ELSE 0e0 END), 6) AS hit FROM {routes} GROUP BY route"),
        "raw_blend": sql(
            "sc sc2",
            """SELECT id, candidate_id, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id) AS INT) AS rank FROM (
            SELECT id, candidate_id, round((1 - 5e-2) * a.score + 5e-2 * b.score, 6) AS score FROM sc a JOIN sc2 b USING (id, candidate_id))""",
        ),
        "mutation_factors": sql("deltas", f"SELECT factor, {_WTL.format('delta')} FROM (SELECT split_part(candidate_id, '_', 2) AS factor, delta FROM deltas WHERE type = 'mutation') GROUP BY factor"),
        "missing_parents": sql(
            "scored",
            """SELECT c.type, count(*) AS children, count(*) FILTER (p.id IS NULL) AS missing FROM scored c LEFT JOIN (SELECT * FROM scored WHERE type <> 'profile_seed') p
            ON p.id = c.id AND p.candidate_id = c.parent_a WHERE c.parent_a IS NOT NULL GROUP BY c.type""",
        ),
        "history_pairs": sql(
            "ranked retr samp hist",
            f"""SELECT id, l AS left, r AS right, round(l - r, 8) AS delta FROM (SELECT id, label AS l FROM ranked WHERE rank = 1) JOIN (
            SELECT s.id, round({rouge_l('a', 'b')}, 8) AS r FROM (SELECT s.id, {tok('h.title')} AS a, {tok('s.target')} AS b FROM samp s JOIN retr r ON r.id = s.id AND r.rank = 1
            JOIN hist h ON h.user_id = r.user_id AND h.pos = r.pos WHERE h.title <> '') s) USING (id)""",
        ),
        "operation_oracle": sql(
            "scored",
            """SELECT id, CASE WHEN x THEN 'crossover' ELSE 'mutation' END AS operation, CASE WHEN x THEN c.candidate_id ELSE m.candidate_id END AS candidate_id, CASE WHEN x THEN c.rouge_l ELSE m.rouge_l END AS rouge_l FROM (
            SELECT *, coalesce(c.rouge_l > m.rouge_l, false) AS x FROM (SELECT id, max({'rouge_l': rouge_l, 'p': -pos, 'candidate_id': candidate_id}) FILTER (type = 'mutation') AS m,
            max({'rouge_l': rouge_l, 'p': -pos, 'candidate_id': candidate_id}) FILTER (type = 'crossover') AS c FROM scored GROUP BY id) WHERE m IS NOT NULL)""",
        ),
    }
