"""Registered queries of views, selections, splits and training examples, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import compact_key
from scriptorium.operators import compilers as co
from scriptorium.operators import evaluation as ev
from scriptorium.operators import pools, preferences, ranking, retrieval, validate
from scriptorium.plans import fixtures
from scriptorium.plans.evaluation import oracle_sql as reports_sql
from scriptorium.plans.oracles import TITLE_TOK, jac, key, rouge_l, sql, tok
from scriptorium.sources.tables import materialize, shared_dir


def keyed_items(f) -> DataFrame:
    return f.items.filter((compact_key("abstract") != "") & (compact_key("title") != ""))


def turns(f) -> DataFrame:
    """Assistant turns as responses of rollouts."""
    said = fixtures.table(f.spark, f.dir, "conversations").filter("role = 'assistant'")
    return said.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("rollout_id"), "turn", F.coalesce("text", F.lit("")).alias("output"))


def warmup(f) -> DataFrame:
    # titles are read many times, texts once
    titles = materialize(f.items.select("user_id", "pos", "title"), "titles")
    asked = materialize(f.samples.select("id", "user_id", "source_text", "target"), "asked")
    found = retrieval.content_negatives(asked, titles).select("id", "pos", "rank")
    return co.warmup_groups(asked, titles, found.join(titles.select("pos", "title"), "pos").select("id", "rank", "title"))


def wrapped(f) -> DataFrame:
    """Responses in the wrappings that editors give: JSON, fenced JSON with a comma, bare titles, traces, nothing."""
    n = F.substring("id", 2, 20).cast("long") % 5
    title = F.col("target")
    raw = (
        F.when(n == 0, F.concat(F.lit('{"output": "'), title, F.lit('"}')))
        .when(n == 1, F.concat(F.lit('Sure:\n```json\n{"trace": [1, 2,], "output": "'), title, F.lit('",}\n```')))
        .when(n == 2, F.concat(F.lit("  "), title, F.lit(" ")))
        .when(n == 3, F.concat(F.lit("reason: x\nOutput: no\n output:  "), title, F.lit("}")))
        .otherwise(F.lit("{}"))
    )
    return f.samples.select("id", raw.alias("raw"))


def parsed(f) -> DataFrame:
    rows = wrapped(f)
    return rows.select("id", co.json_output("raw").alias("json"), co.plain_output("raw").alias("plain"), co.recovered_output("raw").alias("trace"))


def checked(f) -> DataFrame:
    """Every validator over the pool: payloads built from candidates, their parents and visible history."""
    seen = f.visible.groupBy("id").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("visible"))
    rows = f.pool.join(f.samples.select("id", "target", "source_text"), "id").join(seen, "id", "left")
    none = F.array().cast("array<string>")
    visible = F.coalesce("visible", none)
    cited = F.when(F.col("pos") % 3 == 0, F.array(F.lit("-1"))).otherwise(F.slice(visible, 1, 2))
    kind = F.when(F.col("type") == "mutation", "mutation").otherwise("crossover")
    joined = lambda c: F.array_join(c, ",")
    return rows.select(
        "id",
        "candidate_id",
        joined(validate.mutation_errors(kind, F.col("text"), cited, visible)).alias("mutation"),
        joined(validate.crossover_errors(kind, F.col("text"), F.array("parent_a", "parent_b"), F.array("parent_b", F.lit("task_0")), cited, visible)).alias("crossover"),
        joined(validate.trace_errors(F.col("text"), F.col("source_text"), cited, visible, F.col("target"))).alias("trace"),
        joined(validate.operation_errors(F.col("text"), F.col("target"), F.col("target"), cited, visible, F.col("pos") % 2 == 0)).alias("operation"),
        joined(validate.judge_errors(F.when(F.col("pos") == 4, "prefer_c").when(F.col("pos") == 5, "tie").otherwise("prefer_a"), F.col("pos") / 8.0)).alias("judge"),
    )


def stage_files(f) -> DataFrame:
    """Samples written as a stage file of JSON lines and read again: rows and their digests on either side."""
    path = f"{shared_dir(f.spark)}/samples.jsonl"
    rows = f.samples.select("id", "user_id", "source_text", "target")
    rows.write.mode("overwrite").json(path)
    back = f.spark.read.schema(rows.schema).json(path)
    return back.select("id", F.md5(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("id", "user_id", "source_text", "target")))).alias("digest"))


def eligible_pairs(f) -> DataFrame:
    """Rollouts of whose responses every third turn is not eligible, and one in seven has no prompt."""
    turn = F.substring("response_id", 2, 20).cast("long")
    n = F.substring("rollout_id", 2, 20).cast("long")
    rows = f.rollouts.select("rollout_id", "response_id", "output", F.when(n % 7 != 0, F.lit("p")).alias("prompt"), (turn % 3 != 0).alias("eligible"))
    return co.eligible_preferences(preferences.reward_rollouts(f.rollouts), rows).select("pair_id", "margin")


def tier_counts(f) -> DataFrame:
    """How many responses could be read in each way, the first that holds."""
    tier = F.when(F.col("json").isNotNull(), "json").when(F.col("plain").isNotNull(), "plain").when(F.col("trace").isNotNull(), "trace").otherwise("none")
    return parsed(f).select(tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("responses"))


def best_method(f) -> DataFrame:
    """The method of the highest ROUGE-L, then ROUGE-1, then name."""
    return ev.method_table(f.scores, f.scored).orderBy(F.desc("rouge_l"), F.desc("rouge_1"), "method").limit(1).select("method", "rouge_l")


def stage_payloads(f) -> DataFrame:
    """Payloads of every stage, whole and spoiled by the number of the sample."""
    n = F.substring("id", 2, 20).cast("long") % 4
    feature = F.when(n == 0, '{"features": [{"feature_name": "a", "context": "b"}]}').when(n == 1, '{"features": []}').when(n == 2, '{"features": [{"feature_name": " "}]}').otherwise("{}")
    factor = F.when(n == 0, '{"factors": ["x", ""]}').when(n == 1, '{"factors": [" "]}').otherwise("{}")
    rest = F.when(n == 0, '{"assignments": {"a": 1}, "reasoning": "because", "predicted_title": "t"}').when(n == 1, '{"reasoning": " "}').otherwise("[]")
    kinds = {"features": feature, "factors": factor, "assignment": rest, "reasoning": rest, "prediction": rest}
    return f.samples.select("id", *(co.payload_errors(k, c).alias(k) for k, c in kinds.items()))


def factor_proposals(f) -> DataFrame:
    """Factors proposed from the visible titles of each sample, some of them spoiled."""
    seen = f.visible.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("item").cast("string").alias("i"), "output"))).alias("h"))
    n = F.substring("id", 2, 20).cast("long") % 5
    made = F.transform(
        F.slice("h", 1, 3),
        lambda x, k: F.struct(
            F.when(n == 1, "same").otherwise(k.cast("string")).alias("factor_id"), F.when((n == 2) & (k == 0), "odd").otherwise("style").alias("type"),
            F.when(n == 3, F.array(x["i"], F.lit("none"))).otherwise(F.array(x["i"])).alias("evidence_ids"), F.when(n == 4, " High ").otherwise(x["output"]).alias("direction"),
        ),
    )
    return seen.select("id", co.proposal_errors(made, F.transform("h", lambda x: x["i"]), ("style", "content"), 2, 3).alias("errors"))


QUERIES = {
    "pair_annotations": lambda f: co.pair_annotations(pools.crossover_pairs(f.seeds, 2), f.samples),
    "eligible_pairs": eligible_pairs,
    "size_check": lambda f: co.size_check(f.samples, 20, 100),
    "case_selections": lambda f: co.case_selections(ranking.regrets(f.scores).select("id", "regret"), "regret", "id"),
    "evidence_lost": lambda f: co.evidence_lost(f.visible, 300),
    "tier_counts": tier_counts,
    "best_method": best_method,
    "stage_payloads": stage_payloads,
    "factor_proposals": factor_proposals,
    "parent_lists": lambda f: f.pool.filter("parent_a IS NULL").groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "candidate_id", "text"))), lambda x: F.concat(x["candidate_id"], F.lit("="), x["text"])), "|").alias("parents")
    ),
    "group_views": lambda f: co.group_views(f.samples, f.retrieved, f.items, f.pool),
    "listwise_views": lambda f: co.listwise_views(f.scored).select("id", F.array_join("candidate_ids", "|").alias("candidates"), F.round(F.aggregate("label_scores", F.lit(0.0), lambda a, x: a * 2 + x), 6).alias("labels")),
    "isolated_profiles": lambda f: co.isolated_profiles(f.samples, keyed_items(f)),
    "safe_titles": lambda f: co.safe_titles(f.samples, f.items),
    "safe_history": lambda f: co.safe_history(f.samples, f.retrieved, f.items, 3).select("id", "place", "rank", "pos"),
    "first_of_users": lambda f: co.first_of_users(f.items.select("user_id", "pos", "id"), "user_id", "pos", 10).select("user_id", "id"),
    "eligible_users": lambda f: co.eligible_users(keyed_items(f), 10, 8, "3"),
    "seeded_subset": lambda f: co.seeded_subset(f.items.select("id", "pos"), "id", "pos", 50, "9"),
    "missing_seeds": lambda f: co.joined_or_counted(f.samples, f.seeds.filter("candidate_id = 'profile_1'"), "id"),
    "official_splits": lambda f: co.official_splits(f.scored, f.samples),
    "permutations": lambda f: co.permutation(f.seeds, "candidate_id", "full", "4").select("id", "candidate_id", "place"),
    "user_seeds": lambda f: f.items.select("user_id").distinct().select("user_id", co.user_seed("42", "user_id").alias("seed")),
    "content_words": lambda f: f.documents.select("doc_id", F.size(co.content_tokens("text")).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(co.content_tokens("text")), " ")).alias("words")),
    "fallback_titles": lambda f: f.samples.select("id", co.query_fallback("source_text").alias("title")),
    "title_in_text": lambda f: f.top_titles.join(f.samples.select("id", "source_text"), "id").select("id", F.contains(F.lower("source_text"), F.lower(F.col("title"))).alias("inside")),
    "retrieval_texts": lambda f: f.items.select("pos", co.retrieval_text(F.col("title"), F.slice("words", 1, 2), F.when(F.size("words") > 40, F.col("user_id"))).alias("text")),
    "distinct_responses": lambda f: co.distinct_responses(turns(f)).select("rollout_id", "response_id", "turn"),
    "crossover_sources": lambda f: co.crossover_sources(turns(f), f.seeds.withColumnRenamed("id", "rollout_id")).select(
        "rollout_id", "source", F.md5(F.concat_ws("|", F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")))).alias("texts")
    ),
    "warmup_groups": warmup,
    "sft_plain": lambda f: co.editor_examples(f.pool, f.samples, "plain"),
    "sft_gold_aware": lambda f: co.editor_examples(f.pool, f.samples, "gold_aware"),
    "sft_atomic": lambda f: co.editor_examples(f.pool, f.samples, "atomic"),
    "sft_conditional": lambda f: co.editor_examples(f.pool, f.samples, "conditional"),
    "multi_parent_sft": lambda f: co.multi_parent_examples(f.pool, f.samples, "7"),
    "editor_outputs": parsed,
    "validator_errors": checked,
    "stage_files": stage_files,
    "width_distribution": lambda f: pools.fixed_width(f.pool).groupBy("unique_count").agg(F.count("*").alias("ids")),
    "user_counts": lambda f: f.preferences.join(f.samples.select(F.col("id").alias("rollout_id"), "user_id"), "rollout_id").groupBy("user_id").agg(
        F.count("*").alias("rollouts"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.countDistinct("chosen_id").alias("chosen")
    ),
}


def sft_sql(trace: str, output: str, kind: str) -> str:
    return sql(
        "pool samp",
        rf"""SELECT id || ':' || candidate_id || ':{kind}' AS example_id, {trace} AS trace_text, {output} AS output_text, round(1e0 / count(*) OVER (PARTITION BY id), 8) AS sample_weight FROM (
        SELECT p.id, candidate_id, target, list_filter(list_distinct({tok('target')}), lambda x: NOT list_contains({tok('text')}, x)) AS un, {tok('target')} AS tt, {tok('text')} AS pt
        FROM pool p JOIN samp USING (id) WHERE parent_a IS NULL AND target <> '')""".replace(
            f"list_filter(list_distinct({tok('target')}), lambda x: NOT list_contains({tok('text')}, x)) AS un",
            f"list_filter(list_filter({tok('target')}, lambda x, i: list_position({tok('target')}, x) = i), lambda x: NOT list_contains({tok('text')}, x)) AS added",
        ),
    )


def named(tests: str) -> str:
    return f"array_to_string(list_filter({tests}, lambda x: x IS NOT NULL), ',')"


def oracle_sql() -> dict[str, str]:
    plain, rest = "trim(replace(target, chr(10), ' '))", """'"' || target || '"}'"""
    atomic = """'{"task_operations":[' || array_to_string(list_transform(added, lambda x: '"' || x || '"'), ',') || '],"output":'"""
    decided = """'{"decision":"' || CASE WHEN len(added) = 0 THEN 'keep' ELSE 'revise' END || '","edit_action":"add ' || array_to_string(added, ' ') || '","output":'"""
    spaced = lambda x: f"array_to_string({tok(x)}, ' ')"
    greedy = f"""kk AS (SELECT * FROM hist WHERE {key('abstract')} <> '' AND {key('title')} <> ''), gl AS (SELECT user_id, list({{'pos': pos, 'a': {key('abstract')}, 't': {key('title')}}} ORDER BY pos) AS l FROM kk GROUP BY user_id),
        gd AS (SELECT user_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a = x.a OR y.t = x.t)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0])) AS k FROM gl)"""
    number = "CAST(substr(id, 2) AS BIGINT)"
    order = lambda *p: "sha256(" + " || ':' || ".join(p) + ")"
    titles = TITLE_TOK.format
    stop = "'a','an','and','are','as','at','based','by','for','from','in','into','is','of','on','or','the','to','using','via','with','approach','method','novel','paper','study','new','results'"
    content = f"list_sort(list_distinct(list_filter({tok('text')}, lambda t: len(t) >= 3 AND t NOT IN ({stop}))))"
    out = {
        "pair_annotations": sql(
            "cpairs samp",
            f"""SELECT id, a_candidate_id, b_candidate_id, CASE WHEN len(list_filter(list_intersect(a, g), lambda x: NOT list_contains(b, x))) > 0 AND len(list_filter(list_intersect(b, g), lambda x: NOT list_contains(a, x))) > 0 THEN 'merge'
            WHEN a_score >= b_score THEN 'keep_a' ELSE 'keep_b' END AS decision, a_score, b_score FROM (SELECT *, round({rouge_l('a', 'g')}, 8) AS a_score, round({rouge_l('b', 'g')}, 8) AS b_score FROM (
            SELECT id, a_candidate_id, b_candidate_id, {tok('a_text')} AS a, {tok('b_text')} AS b, {tok('target')} AS g FROM cpairs JOIN samp USING (id)))""",
        ),
        "eligible_pairs": sql(
            "rew",
            """SELECT rollout_id || ':' || c.response_id || '>' || r.response_id AS pair_id, round(c.reward - r.reward, 8) AS margin FROM (SELECT rollout_id, max({'reward': reward, 'response_id': response_id}) AS c, min({'reward': reward, 'response_id': response_id}) AS r
            FROM rew WHERE CAST(substr(response_id, 2) AS BIGINT) % 3 <> 0 GROUP BY rollout_id) WHERE c.response_id <> r.response_id AND round(c.reward - r.reward, 8) >= 3e-2 AND CAST(substr(rollout_id, 2) AS BIGINT) % 7 <> 0""",
        ),
        "size_check": sql("samp", "SELECT count(DISTINCT trim(user_id)) FILTER (trim(user_id) <> '') AS users, count(*) AS queries, count(DISTINCT trim(user_id)) FILTER (trim(user_id) <> '') = 20 AND count(*) = 100 AS as_expected FROM samp"),
        "case_selections": sql(
            "ranked",
            """, g AS (SELECT id, round(max(label) - arg_min(label, rank), 6) AS regret FROM ranked GROUP BY id), o AS (SELECT *, row_number() OVER (ORDER BY regret, id) AS n, count(*) OVER () AS k FROM g)
            SELECT id, regret, part, CAST(row_number() OVER (PARTITION BY part ORDER BY n) AS INT) AS place FROM (SELECT *, CASE WHEN n <= 3 THEN 'bottom' WHEN n > k - 3 THEN 'top' WHEN n > floor((k - 3) / 2e0) AND n <= floor((k - 3) / 2e0) + 3 THEN 'middle' END AS part FROM o) WHERE part IS NOT NULL""",
        ),
        "evidence_lost": sql(
            "vis",
            f"""SELECT id, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (e > 300) AS cut, count(*) FILTER (e - n >= 300) AS lost FROM (SELECT id, n, sum(n) OVER (PARTITION BY id ORDER BY rank) AS e FROM (SELECT id, rank, len({tok("input || ' ' || output")}) AS n FROM vis)) GROUP BY id""",
        ),
        "tier_counts": sql("samp", f"SELECT tier, count(*) AS responses FROM (SELECT CASE {number} % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN CASE WHEN target <> '' THEN 'plain' ELSE 'none' END WHEN 3 THEN CASE WHEN target <> '' THEN 'trace' ELSE 'none' END ELSE 'none' END AS tier FROM samp) GROUP BY tier"),
        "best_method": f"SELECT method, rouge_l FROM ({reports_sql()['method_table']}) ORDER BY rouge_l DESC, rouge_1 DESC, method LIMIT 1",
        "stage_payloads": sql(
            "samp",
            f"""SELECT id, ['', 'empty', 'name,context', 'object'][n + 1] AS features, ['', 'empty', 'object', 'object'][n + 1] AS factors, CASE WHEN n = 0 THEN '' ELSE 'assignments' END AS assignment,
            CASE WHEN n = 0 THEN '' ELSE 'reasoning' END AS reasoning, CASE WHEN n = 0 THEN '' ELSE 'predicted_title' END AS prediction FROM (SELECT id, {number} % 4 AS n FROM samp)""",
        ),
        "factor_proposals": sql(
            "vis",
            f"""SELECT id, {named("[CASE WHEN k NOT BETWEEN 2 AND 3 THEN 'count' END, CASE WHEN n = 2 THEN 'type' END, CASE WHEN n = 3 THEN 'evidence' END, CASE WHEN n = 4 OR bad > 0 THEN 'direction' END, CASE WHEN n = 1 AND k > 1 THEN 'repeated' END]")} AS errors FROM (
            SELECT id, {number} % 5 AS n, least(count(*), 3) AS k, count(*) FILTER (r <= 3 AND lower(trim(output)) IN ('', 'high', 'medium', 'low')) AS bad FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS r FROM vis) GROUP BY id)""",
        ),
        "parent_lists": sql("seeds", "SELECT id, string_agg(candidate_id || '=' || text, '|' ORDER BY pos) AS parents FROM seeds GROUP BY id"),
        "group_views": sql(
            "samp retr hist pool",
            f"""SELECT s.id, s.user_id, coalesce(t, '') AS profile_titles, coalesce(n, 0) AS filtered, coalesce(c, '') AS candidates FROM samp s LEFT JOIN (
            SELECT r.id, string_agg(trim(h.title), '|' ORDER BY r.rank) FILTER (NOT (k <> '' AND {spaced('h.title')} = k)) AS t, count(*) FILTER (k <> '' AND {spaced('h.title')} = k) AS n
            FROM retr r JOIN hist h ON h.user_id = r.user_id AND h.pos = r.pos JOIN (SELECT id, {spaced('target')} AS k FROM samp) x ON x.id = r.id WHERE len(trim(h.title)) > 0 GROUP BY r.id) a ON a.id = s.id
            LEFT JOIN (SELECT id, string_agg(candidate_id, '|' ORDER BY pos, candidate_id) AS c FROM pool GROUP BY id) b ON b.id = s.id""",
        ),
        "listwise_views": sql(
            "scored",
            """SELECT id, string_agg(candidate_id, '|' ORDER BY pos) AS candidates, round(list_reduce(list(rouge_l ORDER BY pos), lambda a, x: a * 2 + x, 0e0), 6) AS labels FROM scored GROUP BY id""",
        ),
        "isolated_profiles": sql(
            "samp hist",
            f""", {greedy}, g AS (SELECT s.id, count(DISTINCT k.pos) AS removed FROM samp s JOIN gd ON gd.user_id = s.user_id WHERE ({key('s.target')} <> '' AND k.t = {key('s.target')}) OR ({key('s.source_text')} <> '' AND k.a = {key('s.source_text')}) GROUP BY s.id)
            SELECT s.id, coalesce(n, 0) - coalesce(removed, 0) AS retained, coalesce(removed, 0) AS removed FROM samp s LEFT JOIN (SELECT user_id, count(*) AS n FROM gd GROUP BY user_id) u USING (user_id) LEFT JOIN g ON g.id = s.id""",
        ),
        "safe_titles": sql(
            "samp hist",
            f"""SELECT user_id, pos, title FROM (SELECT user_id, pos, trim(title) AS title, {spaced('title')} AS k, row_number() OVER (PARTITION BY user_id, {spaced('title')} ORDER BY pos) AS n FROM hist) h
            WHERE n = 1 AND k <> '' AND NOT EXISTS (SELECT 1 FROM samp s WHERE s.user_id = h.user_id AND {spaced('s.target')} = h.k)""",
        ),
        "safe_history": sql(
            "samp retr hist",
            f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY rank) AS INT) AS place, CAST(rank AS INT) AS rank, pos FROM (SELECT r.id, r.rank, r.pos, r.user_id, {spaced('h.title')} AS k,
            row_number() OVER (PARTITION BY r.id, {spaced('h.title')} ORDER BY r.rank) AS n FROM retr r JOIN hist h ON h.user_id = r.user_id AND h.pos = r.pos) x
            WHERE n = 1 AND k <> '' AND NOT EXISTS (SELECT 1 FROM samp s WHERE s.user_id = x.user_id AND {spaced('s.target')} = x.k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) <= 3""",
        ),
        "first_of_users": sql("hist", "SELECT user_id, id FROM (SELECT user_id, id, pos FROM hist QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos) = 1) ORDER BY pos LIMIT 10"),
        "eligible_users": sql(
            "hist",
            f""", {greedy} SELECT user_id, items, CAST(row_number() OVER (ORDER BY user_id) AS INT) AS place FROM (SELECT user_id, count(*) AS items FROM gd GROUP BY user_id HAVING count(*) >= 10 ORDER BY {order("'3'", 'user_id')}, user_id LIMIT 8)""",
        ),
        "seeded_subset": sql("hist", f"SELECT id, pos, CAST(row_number() OVER (ORDER BY pos) AS INT) AS place FROM (SELECT id, pos FROM hist ORDER BY {order(chr(39) + '9' + chr(39), 'id')}, id LIMIT 50)"),
        "missing_seeds": sql("samp seeds", "SELECT count(*) AS rows, count(x.id) AS joined, count(*) FILTER (x.id IS NULL) AS missing FROM samp s LEFT JOIN (SELECT DISTINCT id FROM seeds WHERE candidate_id = 'profile_1') x ON x.id = s.id"),
        "official_splits": sql(
            "scored samp",
            """, n AS (SELECT id, user_id, CASE WHEN u < 6e-1 THEN 'train' WHEN u < 8e-1 THEN 'dev' ELSE 'test' END AS split FROM (SELECT id, user_id, ('0x' || substr(sha256(user_id), 1, 8))::BIGINT / 4294967295e0 AS u FROM samp))
            SELECT split, groups, candidates, coalesce(pairs, 0) AS pairs, (SELECT count(*) FROM (SELECT user_id FROM n GROUP BY user_id HAVING count(DISTINCT split) > 1)) AS shared_users FROM
            (SELECT split, count(DISTINCT id) AS groups, count(*) AS candidates FROM scored JOIN n USING (id) GROUP BY split) LEFT JOIN
            (SELECT split, count(*) AS pairs FROM scored a JOIN scored b ON a.id = b.id AND a.pos < b.pos JOIN n ON n.id = a.id WHERE split <> 'test' AND round(abs(a.rouge_l - b.rouge_l), 8) >= 2e-2 GROUP BY split) USING (split)""",
        ),
        "permutations": sql("seeds", f"SELECT id, candidate_id, CAST(row_number() OVER (PARTITION BY id ORDER BY {order(chr(39) + '4' + chr(39), 'id', chr(39) + 'full' + chr(39), 'candidate_id')}, candidate_id) AS INT) AS place FROM seeds"),
        "user_seeds": sql("hist", "SELECT DISTINCT user_id, ('0x' || substr(sha256('42:' || user_id), 1, 8))::BIGINT AS seed FROM hist"),
        "content_words": f"SELECT doc_id, len({content}) AS n, md5(array_to_string({content}, ' ')) AS words FROM documents",
        "fallback_titles": sql(
            "samp",
            r"""SELECT id, CASE WHEN len(w) >= 2 THEN array_to_string(w[1:12], ' ') ELSE 'Research Study' END AS title FROM (SELECT id, regexp_extract_all(source_text, '[A-Za-z0-9][A-Za-z0-9''_-]*') AS w FROM samp)""",
        ),
        "title_in_text": sql(
            "samp retr hist",
            """SELECT s.id, contains(lower(source_text), lower(coalesce(h.title, ''))) AS inside FROM samp s LEFT JOIN (SELECT * FROM retr WHERE rank = 1) r ON r.id = s.id LEFT JOIN hist h ON h.user_id = r.user_id AND h.pos = r.pos""",
        ),
        "retrieval_texts": sql(
            "hist",
            """SELECT pos, title || CASE WHEN len(words) > 0 THEN ' [factors: ' || array_to_string(words[1:2], ', ') || ']' ELSE '' END || CASE WHEN len(words) > 40 AND user_id <> '' THEN ' [context: ' || user_id || ']' ELSE '' END AS text FROM hist""",
        ),
        "distinct_responses": """SELECT rollout_id, 'r' || (row_number() OVER (PARTITION BY rollout_id ORDER BY turn) - 1) AS response_id, turn FROM (
            SELECT 'c' || conv_id AS rollout_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, '')) <> '' GROUP BY conv_id, lower(trim(text)))""",
        "crossover_sources": sql(
            "seeds",
            """, d AS (SELECT rollout_id, list(output ORDER BY turn) AS m FROM (SELECT 'c' || conv_id AS rollout_id, min(turn) AS turn, arg_min(text, turn) AS output FROM conversations WHERE role = 'assistant' AND trim(coalesce(text, '')) <> '' GROUP BY conv_id, lower(trim(text))) GROUP BY rollout_id),
            p AS (SELECT id AS rollout_id, list(text ORDER BY pos) AS p FROM seeds GROUP BY id)
            SELECT rollout_id, CASE WHEN coalesce(len(m), 0) >= 2 THEN 'mutations' ELSE 'parents' END AS source, md5(CASE WHEN coalesce(len(m), 0) >= 2 THEN m[1] || '|' || m[2] ELSE coalesce(p[1], '') || '|' || coalesce(p[2], '') END) AS texts FROM p LEFT JOIN d USING (rollout_id)""",
        ),
        "warmup_groups": sql(
            "samp hist",
            f""", aq AS (SELECT id, user_id, target, {titles('source_text')} AS q, {spaced('target')} AS gold FROM samp WHERE target <> ''),
            own AS (SELECT id, n, key, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) AS n FROM (SELECT a.id, h.pos, h.title, {spaced('h.title')} AS key, round({jac('q', titles('h.title'), '0e0')}, 6) AS s,
              row_number() OVER (PARTITION BY a.id, {spaced('h.title')} ORDER BY round({jac('q', titles('h.title'), '0e0')}, 6) DESC, h.pos) AS k FROM aq a JOIN hist h USING (user_id) WHERE {spaced('h.title')} <> '' AND {spaced('h.title')} <> gold AND h.title <> target) WHERE k = 1) WHERE n <= 2),
            neg AS (SELECT id, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM (SELECT q.id, t.pos, round(sum(idf), 6) AS score FROM (SELECT id, user_id AS asker, unnest({titles('source_text')}) AS term FROM samp) q
              JOIN (SELECT term, ln(((SELECT count(*) FROM hist) + 1e0) / (count(*) + 1e0)) + 1e0 AS idf FROM (SELECT unnest({titles('title')}) AS term FROM hist) GROUP BY term) i USING (term)
              JOIN (SELECT user_id, pos, unnest({titles('title')}) AS term FROM hist) t USING (term) WHERE asker <> user_id GROUP BY q.id, t.pos)) WHERE rank <= 2),
            oth AS (SELECT id, rank, title FROM (SELECT n.id, n.rank, h.title, {spaced('h.title')} AS key, row_number() OVER (PARTITION BY n.id, {spaced('h.title')} ORDER BY n.rank) AS k FROM neg n JOIN hist h ON h.pos = n.pos) o
              WHERE k = 1 AND key <> '' AND EXISTS (SELECT 1 FROM aq a WHERE a.id = o.id AND a.gold <> o.key) AND NOT EXISTS (SELECT 1 FROM own w WHERE w.id = o.id AND w.key = o.key)),
            every AS (SELECT id, 0 AS kind, 0 AS n, target AS text FROM aq UNION ALL SELECT id, 1, n, title FROM own UNION ALL SELECT id, 2, rank, title FROM oth)
            SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY kind, n) - 1 AS INT) AS place, ['gold_positive', 'profile_negative', 'content_negative'][kind + 1] AS type, text, label, round(1 - label, 8) AS margin FROM (
              SELECT e.id, kind, n, text, round({rouge_l('w', 'g')}, 8) AS label FROM (SELECT e.*, {tok('e.text')} AS w, {tok('a.target')} AS g FROM every e JOIN aq a ON a.id = e.id) e)""",
        ),
        "sft_plain": sft_sql("''", plain, "plain"),
        "sft_gold_aware": sft_sql(decided, rest, "gold_aware"),
        "sft_atomic": sft_sql(atomic, rest, "atomic"),
        "sft_conditional": sft_sql(f"CASE WHEN len(added) > 0 THEN {atomic} ELSE '' END", f"CASE WHEN len(added) > 0 THEN {rest} ELSE {plain} END", "conditional"),
        "multi_parent_sft": sql(
            "seeds samp",
            f""", t AS (SELECT id, target, CASE WHEN ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT % 20 = 0 THEN 'validation' ELSE 'train' END AS split FROM samp WHERE target <> ''),
            l AS (SELECT id, v, list(candidate_id ORDER BY sha256('7:' || id || ':' || v || ':' || candidate_id), candidate_id) AS p FROM seeds, (VALUES ('full'), ('dropout')) x(v) GROUP BY id, v)
            SELECT id || ':' || v AS example_id, split, array_to_string(CASE WHEN v = 'full' THEN p ELSE p[1:len(p) - 1] END, '|') AS parents, target AS output FROM l JOIN t USING (id) WHERE v = 'full' OR (len(p) >= 3 AND split = 'train')""",
        ),
        "editor_outputs": sql(
            "samp",
            f"""SELECT id, CASE WHEN {number} % 5 IN (0, 1) THEN target END AS json, CASE WHEN {number} % 5 = 2 AND target <> '' THEN target END AS plain, CASE WHEN {number} % 5 = 3 AND target <> '' THEN target WHEN {number} % 5 = 3 THEN NULL END AS trace FROM samp""",
        ),
        "validator_errors": sql(
            "pool samp vis",
            rf""", v AS (SELECT id, list(CAST(item AS VARCHAR) ORDER BY CAST(item AS VARCHAR)) AS vs FROM vis GROUP BY id),
            r AS (SELECT p.id, candidate_id, type, pos, text, parent_a, parent_b, target, source_text, coalesce(vs, []) AS vs, CASE WHEN pos % 3 = 0 THEN ['-1'] ELSE coalesce(vs, [])[1:2] END AS cited, trim(text) AS t, {tok('text')} AS w, list_distinct({tok('target')}) AS g
              FROM pool p JOIN samp USING (id) LEFT JOIN v USING (id)),
            e AS (SELECT *, [CASE WHEN len(t) = 0 THEN 'empty' END, CASE WHEN lower(t) IN ('none', 'null', 'n/a') THEN 'placeholder' END, CASE WHEN contains(t, chr(10)) THEN 'lines' END, CASE WHEN len(text) > 300 THEN 'long' END] AS o,
              CASE WHEN len(list_filter(cited, lambda x: NOT list_contains(vs, x))) > 0 THEN 'evidence' END AS ev FROM r)
            SELECT id, candidate_id, {named("list_concat([CASE WHEN type <> 'mutation' THEN 'operation' END], o, [ev])")} AS mutation,
            {named("list_concat([CASE WHEN type = 'mutation' THEN 'operation' END], o, [CASE WHEN list_sort([coalesce(parent_a, '~'), coalesce(parent_b, '~')]) <> list_sort([coalesce(parent_b, '~'), 'task_0']) THEN 'parents' END, ev])")} AS crossover,
            {named(f"[CASE WHEN len(t) NOT BETWEEN 1 AND 500 THEN 'reason' END, CASE WHEN len(trim(source_text)) NOT BETWEEN 1 AND 500 THEN 'action' END, CASE WHEN len(cited) NOT BETWEEN 1 AND 2 THEN 'count' END, ev, CASE WHEN regexp_matches(text || ' ' || source_text, '(?i)\\b(?:gold|ground[ -]?truth|rouge|reference answer|target title)\\b') THEN 'forbidden' END, CASE WHEN {key('target')} <> '' AND contains({key("text || ' ' || source_text")}, {key('target')}) THEN 'leak' END]")} AS trace,
            {named(f"[CASE WHEN len(w) = 0 THEN 'empty' END, CASE WHEN {key('text')} = {key('target')} THEN 'whole' END, CASE WHEN len(w) >= 8 AND len(list_intersect(w, g)) / greatest(len(g), 1)::DOUBLE >= 75e-2 THEN 'most' END, ev, CASE WHEN pos % 2 = 0 AND len(list_distinct(cited)) < 2 THEN 'support' END]")} AS operation,
            {named("[CASE WHEN pos = 4 THEN 'verdict' END, CASE WHEN pos > 8 THEN 'confidence' END, CASE WHEN pos <> 5 AND pos / 8e0 < 65e-2 THEN 'unsure' END]")} AS judge FROM e""",
        ),
        "stage_files": sql("samp", "SELECT id, md5(id || '|' || user_id || '|' || source_text || '|' || target) AS digest FROM samp"),
        "width_distribution": sql("pool", "SELECT least(5, n) AS unique_count, count(*) AS ids FROM (SELECT id, count(DISTINCT text) AS n FROM pool GROUP BY id) GROUP BY least(5, n)"),
        "user_counts": sql(
            "pref samp",
            "SELECT user_id, count(*) AS rollouts, count(*) FILTER (status = 'accepted') AS accepted, count(DISTINCT chosen_id) AS chosen FROM pref JOIN samp ON samp.id = pref.rollout_id GROUP BY user_id",
        ),
    }
    return out
