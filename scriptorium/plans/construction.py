"""Registered queries of factor construction, repaired answers, scans and requests, each beside its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import repair
from scriptorium.functions.text import tokens
from scriptorium.operators import construction, families, merging
from scriptorium.plans.oracles import sql
from scriptorium.sources import arrays, manifests, rounds
from scriptorium.sources.tables import shared_dir


def proposals(f) -> DataFrame:
    """Every titled history item proposes a factor of one kind, resting on itself; a few make the mock's answers too long."""
    kinds = F.array(*map(F.lit, merging.OPERATION_TYPES))
    return f.items.filter("title <> ''").select(
        F.col("user_id").alias("owner"),
        F.col("pos").alias("seq"),
        F.get(kinds, F.pmod("pos", F.lit(len(merging.OPERATION_TYPES))).cast("int")).alias("operation_type"),
        F.col("title").alias("direction"),
        F.concat(F.lit("when the text has "), F.size("words").cast("string"), F.lit(" words")).alias("condition"),
        F.when(F.pmod("pos", F.lit(97)) == 0, "long").otherwise("plain").alias("reason"),
        F.array("id").alias("evidence_ids"),
    )


def merged_factors(f) -> DataFrame:
    """Proposals of each user merged in rounds, with sums over the ids of the records that each factor rests on."""
    limits = merging.Limits(chunk_size=12, budget=8000)
    made, records = merging.merge_with_records(proposals(f), merging.mock_merger, limits)
    number = F.col("evidence_id").cast("long")
    sums = records.groupBy("owner", "factor_id").agg(F.sum(number).alias("ids_sum"), F.min(number).alias("ids_min"), F.max(number).alias("ids_max"))
    return made.join(sums, ["owner", "factor_id"])


def answered(f) -> DataFrame:
    """id, n (its number), t (a title), w (a word) of every sample, for answers made of them."""
    number = F.substring("id", 2, 20).cast("long")
    return f.samples.select("id", number.alias("n"), F.concat(F.lit("on "), "target", F.lit(" as told")).alias("t"), F.concat(F.lit("w"), number.cast("string")).alias("w"))


def _filled(template: str):
    """A template with the title, word and number of a row for T, W and N."""
    out = F.lit(template)
    for sign, column in (("<T>", F.col("t")), ("<W>", F.col("w")), ("<N>", F.col("n").cast("string"))):
        out = F.replace(out, F.lit(sign), column)
    return out


#: Answers damaged in one way each.
DAMAGED = (
    '{"output":"<T>","words":["<W>","z"],"n":<N>}',
    '```json\n{"output":"<T>","words":["<W>","z"],"n":<N>}\n```',
    'Here it is: {"output":"<T>","words":["<W>","z"],"n":<N>} I hope it helps.',
    '{"output":"<T>","words":["<W>","z",],"n":<N>,}',
    '[{ {"output":"<T>","words":["<W>","z"],"n":<N>}]',
    '{"output":"<T>\\_","words":["<W>"]}',
    '{"output":"<T>\n","words":["<W>"]}',
    '{"output":"<T>","words":["<W>","z"',
    '{"output":"<T>","words":["<W>","z"},"n":<N>}',
    "{'output':'<T>','words':['<W>','it's'],'n':<N>}",
    "{output: <T>, words: [<W> z], n: <N>, ok: True}",
    "<T>",
    '{"output":"<T>',
    '{"output" "<T>" "n" <N>}',
    "<T>\nand <W>",
    "",
)
#: Answers of an editor, by how far they are from what was asked for.
EDITED = (
    '{"output":"<T>","n":<N>}',
    '{"output":"<T>" ]',
    "Title: <T>",
    '"<T>"\nbecause of <W>',
    "{'output': '<T>', 'n': <N>}",
    '{"output": <T>}',
    '```\n{"n":<N>,}\n```',
)


def _made(f, templates: tuple[str, ...]) -> DataFrame:
    rows = answered(f).withColumn("kind", F.pmod("n", F.lit(len(templates) + 1)))
    answer = F.lit(None).cast("string")  # the last kind has no answer
    for k, template in enumerate(templates):
        answer = F.when(F.col("kind") == k, _filled(template)).otherwise(answer)
    return rows.withColumn("answer", answer)


def repaired_answers(f) -> DataFrame:
    """What is read of answers damaged in every way, without and with single lines of words."""
    return _made(f, DAMAGED).select("id", "kind", repair.repaired_json(F.col("answer")).alias("value"), repair.repaired_json(F.col("answer"), True).alias("scalar"))


def edited_answers(f) -> DataFrame:
    """An editor's answers in all four readings, and why those fail that do."""
    rows = _made(f, EDITED)
    read = rows.select("id", "kind", *(repair.editor_answer(F.col("answer"), m).alias(m) for m in repair.EDITOR_MODES))
    errors = F.concat_ws(",", *(F.when(F.col(f"{m}.error").isNotNull(), F.lit(m)) for m in repair.EDITOR_MODES))
    return read.select("id", "kind", *(F.col(f"{m}.value").alias(m) for m in repair.EDITOR_MODES), errors.alias("failed"))


def asked_in_rounds(f) -> DataFrame:
    """Every sample's source text sent to a primary endpoint with faults and its fallback; the log is new for each run."""
    prompt = F.concat_ws(" ", F.substring("id", 2, 20), "source_text")
    requests = f.samples.select("id", F.lit("title").alias("task"), prompt.alias("prompt"))
    endpoints = [rounds.Endpoint("primary", rounds.faulty_primary), rounds.Endpoint("fallback", rounds.faulty_fallback)]
    policy = rounds.Policy(unreadable=3, cooldown=10)
    return rounds.ask_in_rounds(requests, endpoints, f"{shared_dir(f.spark)}/log", policy).drop("key")


def built_factors(f) -> DataFrame:
    """Factors of every user's titles built in rounds, with how many titles each holds; the empty one has those that none does."""
    titles = f.items.filter("title <> ''").select(F.col("user_id").alias("id"), F.col("pos").alias("place"), F.col("title").alias("feature"))
    held, chosen = construction.build_factors(titles, construction.mock_proposer, construction.mock_assigner)
    factor = F.explode(F.when(F.size("factors") > 0, F.col("factors")).otherwise(F.array(F.lit(""))))
    counts = held.select("id", "place", factor.alias("factor")).groupBy("id", "factor").agg(F.count("*").alias("titles"), F.sum("place").alias("places"))
    return counts.join(chosen, ["id", "factor"], "left").select("id", "factor", "rank", "titles", "places")


def scanned_arrays(f) -> DataFrame:
    """Samples written as JSON arrays and read back in splits, each with its target: the first of the target keys that it has."""
    path = f"{shared_dir(f.spark)}/arrays"
    number = F.substring("id", 2, 20).cast("long")
    named = F.when(number % 2 == 0, F.to_json(F.struct(F.array("target").alias("target"), F.lit("no").alias("gold")))).otherwise(
        F.to_json(F.struct(F.col("target").alias("answer"), F.lit("no").alias("gold")))
    )
    arrays.write_arrays(f.samples.select("id", "user_id", "source_text", named.alias("labels")), path)
    read = arrays.read_array(f.spark, path, "id string, user_id string, source_text string, labels string")
    return read.select("id", "user_id", F.md5("source_text").alias("text"), arrays.present_target(F.col("labels")).alias("target"))


def shared_parents(f) -> DataFrame:
    """The parents of every sample published as a pool with its manifest, and the first one of each read back through its gates."""
    path = f"{shared_dir(f.spark)}/pool"
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "candidate_id", "text"))), lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["text"].alias("text")))
    pools = f.pool.filter("parent_a IS NULL").groupBy("id").agg(listed.alias("parent_pool"))
    manifests.publish(pools, path, {"seed_parent_used": False, "history_used": True})
    read = manifests.shared_parents(f.spark, path)
    return read.select("id", F.size("parent_pool").cast("long").alias("width"), "parent", "parent_source")


def complementary_pairs(f) -> DataFrame:
    """A first parent of every sample and the one that adds most to it; seeds stand for parents, their places for log-probabilities."""
    chance = F.when(F.pmod(F.length("text"), F.lit(7)) == 0, None).otherwise(-0.3 * F.col("pos"))
    issues = F.when(F.size(tokens("text")) < 2, "short").otherwise("")
    return families.complementary_pairs(f.seeds.withColumns({"mean_logprob": chance, "issues": issues}), f.samples)


QUERIES = {
    "complementary_pairs": complementary_pairs,
    "shared_parents": shared_parents,
    "scanned_arrays": scanned_arrays,
    "built_factors": built_factors,
    "asked_in_rounds": asked_in_rounds,
    "merged_factors": merged_factors,
    "repaired_answers": repaired_answers,
    "edited_answers": edited_answers,
}


def oracle_sql() -> dict[str, str]:
    kinds = ", ".join(f"'{k}'" for k in merging.OPERATION_TYPES)
    words = lambda x: f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    made = "SELECT id, CAST(substr(id, 2) AS BIGINT) AS n, 'on ' || target || ' as told' AS t, 'w' || substr(id, 2) AS w FROM samp"
    whole = """'{"output":"' || t || '","words":["' || w || '","z"],"n":' || n || '}'"""
    short = """'{"output":"' || t || '","words":["' || w || '","z"]}'"""
    value = f"""CASE WHEN kind IN (0, 1, 2, 3) THEN {whole} WHEN kind = 4 THEN '[' || {whole} || ']'
            WHEN kind = 5 THEN '{{"output":"' || t || '\\\\_","words":["' || w || '"]}}' WHEN kind = 6 THEN '{{"output":"' || t || '\\n","words":["' || w || '"]}}'
            WHEN kind IN (7, 8) THEN {short} WHEN kind = 9 THEN '{{"output":"' || t || '","words":["' || w || '","it''s"],"n":' || n || '}}'
            WHEN kind = 10 THEN '{{"output":"' || t || '","words":["' || w || ' z"],"n":' || n || ',"ok":true}}'
            WHEN kind = 12 THEN '{{"output":"' || t || '"}}' WHEN kind = 13 THEN '{{"output":"' || t || '","n":' || n || '}}' END"""
    titled = """'{"output":"' || t || '"}'"""
    return {
        "shared_parents": sql(
            "pool", "SELECT id, count(*) AS width, left(arg_min(text, pos), 300) AS parent, 'shared_parent_pool_greedy' AS parent_source FROM pool WHERE parent_a IS NULL GROUP BY id"
        ),
        "scanned_arrays": sql("samp", "SELECT id, user_id, md5(source_text) AS text, target FROM samp"),
        "asked_in_rounds": sql(
            "samp",
            """SELECT id, CASE WHEN n % 35 = 0 THEN 'unreadable' ELSE 'answered' END AS status, CASE WHEN n % 5 = 0 OR n % 3 = 0 THEN 'fallback' ELSE 'primary' END AS endpoint,
            CASE WHEN n % 35 = 0 THEN 4 WHEN n % 5 = 0 OR n % 3 = 0 THEN 2 ELSE 1 END AS attempts,
            CASE WHEN n % 35 = 0 THEN NULL WHEN n % 5 = 0 OR n % 3 = 0 THEN '{"output":"' || n || ' again"}' ELSE '{"output":"' || n || '"}' END AS value
            FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS n FROM samp)""",
        ),
        "repaired_answers": sql(
            "samp", f"SELECT id, kind, {value} AS value, CASE WHEN kind = 11 THEN '\"' || t || '\"' ELSE {value} END AS scalar FROM (SELECT *, n % 17 AS kind FROM ({made}))"
        ),
        "edited_answers": sql(
            "samp",
            f"""SELECT id, kind, CASE kind WHEN 0 THEN '{{"output":"' || t || '","n":' || n || '}}' WHEN 6 THEN '{{"n":' || n || '}}' END AS object,
            CASE WHEN kind = 0 THEN '{{"output":"' || t || '","n":' || n || '}}' WHEN kind IN (1, 4, 5) THEN {titled} WHEN kind = 2 THEN '{{"output":"Title: ' || t || '"}}' WHEN kind = 6 THEN '{{"output":"{{\\"n\\":' || n || ',}}"}}' END AS output_only,
            CASE kind WHEN 2 THEN '{{"output":"Title: ' || t || '"}}' END AS plain, CASE WHEN kind IN (2, 3) THEN {titled} END AS base_text,
            ['plain,base_text', 'object,plain,base_text', 'object', 'object,output_only,plain', 'object,plain,base_text', 'object,plain,base_text', 'plain,base_text', 'object,output_only,plain,base_text'][kind + 1] AS failed
            FROM (SELECT *, n % 8 AS kind FROM ({made}))""",
        ),
        "merged_factors": sql(
            "hist",
            f"""SELECT owner, 'f' || row_number() OVER (PARTITION BY owner ORDER BY first) AS factor_id, operation_type,
            CASE WHEN {words('title')} < 4 THEN condition ELSE title END AS direction,
            CASE WHEN {words('title')} < 4 THEN '{merging.GENERAL_CONDITION}' ELSE condition END AS condition, support_count, ids_sum, ids_min, ids_max
            FROM (SELECT user_id AS owner, kind AS operation_type, min(pos) AS first, arg_min(title, pos) AS title,
              'when the text has ' || CAST(arg_min(len(words), pos) AS VARCHAR) || ' words' AS condition,
              count(*) AS support_count, CAST(sum(pos) AS BIGINT) AS ids_sum, min(pos) AS ids_min, max(pos) AS ids_max
              FROM (SELECT *, [{kinds}][pos % {len(merging.OPERATION_TYPES)} + 1] AS kind FROM hist WHERE title <> '') GROUP BY user_id, kind)""",
        ),
    }
