"""DuckDB statements of the engine's queries, from shared common table expressions."""

from __future__ import annotations

import math
import re

TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
STOP = "'a','an','and','are','as','at','be','by','for','from','in','is','of','on','or','the','to','using','via','we','with'"
TITLE_TOK = (
    "list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+(?:-[a-z0-9]+)?'), "
    f"lambda t: len(t) > 1 AND t NOT IN ({STOP})))"
)
KEY = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')"


def tok(x: str) -> str:
    return TOK.format(x)


def key(x: str) -> str:
    return KEY.format(x)


def jac(a: str, b: str, empty: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / {union}::DOUBLE END)"


def f_measure(overlap: str, a: str, b: str) -> str:
    return f"(CASE WHEN {overlap} = 0 THEN 0.0::DOUBLE ELSE 2e0 * {overlap} / (len({a}) + len({b})) END)"


def rouge_1(a: str, b: str) -> str:
    n = (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda x: x = t)), "
        f"len(list_filter({b}, lambda x: x = t))))), 0)"
    )
    return f_measure(n, a, b)


def rouge_l(a: str, b: str) -> str:
    row = (
        f"list_reduce(range(1, len({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN {b}[j] = t THEN row[j] + 1 "
        f"ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT])"
    )
    n = (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce({a}, lambda row, t: {row}, "
        f"list_transform(range(0, len({b}) + 1), lambda x: 0::BIGINT))[len({b}) + 1] END)"
    )
    return f_measure(n, a, b)


SPLIT = "('0x' || substr(sha256({}), 1, 8))::BIGINT / 4294967295e0"

#: Common table expressions by name, each after those it uses.
CTE = {
    "hist": f"""(SELECT coalesce(source, '') AS user_id, doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, w AS words,
        array_to_string(w[1:8], ' ') AS title, array_to_string(w[9:], ' ') AS abstract
        FROM (SELECT doc_id, source, {tok('text')} AS w FROM documents))""",
    "asked": "(SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)",
    "said": "(SELECT conv_id, arg_min(text, turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY conv_id)",
    "samp": f"""(SELECT 'c' || conv_id AS id, 'src' || (conv_id % 20) AS user_id, coalesce(t, '') AS source_text, {tok('t')} AS source,
        array_to_string({tok('a')}[1:8], ' ') AS target FROM asked LEFT JOIN said USING (conv_id))""",
    "lens": "(SELECT user_id, pos, len(words)::DOUBLE AS len FROM hist)",
    "stats": "(SELECT user_id, count(*)::DOUBLE AS n, sum(len) AS total, CASE WHEN avg(len) = 0 THEN 1e0 ELSE avg(len) END AS average FROM lens GROUP BY user_id)",
    "post": "(SELECT user_id, pos, term, count(*)::DOUBLE AS tf FROM (SELECT user_id, pos, unnest(words) AS term FROM hist) GROUP BY ALL)",
    "df": "(SELECT user_id, term, count(*)::DOUBLE AS df FROM post GROUP BY ALL)",
    "qterm": "(SELECT id, user_id, term, count(*)::DOUBLE AS qtf FROM (SELECT id, user_id, unnest(source) AS term FROM samp) GROUP BY ALL)",
    "matched": """(SELECT q.id, user_id, pos, sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * len / average)))) AS score
        FROM qterm q JOIN df USING (user_id, term) JOIN post USING (user_id, term) JOIN lens USING (user_id, pos) JOIN stats USING (user_id) GROUP BY ALL)""",
    "retr": """(SELECT * FROM (SELECT id, user_id, pos, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank
        FROM (SELECT s.id, s.user_id, l.pos, round(coalesce(m.score, 0), 6) AS score FROM samp s JOIN lens l USING (user_id)
        LEFT JOIN matched m ON m.id = s.id AND m.pos = l.pos)) WHERE rank <= 8)""",
    "seeds": """(SELECT id, pos, candidate_id, type, text FROM (
        SELECT id, 0 AS pos, 'task_0' AS candidate_id, 'task_seed' AS type, array_to_string(source[1:8], ' ') AS text FROM samp
        UNION ALL SELECT id, 1, 'task_1', 'task_seed', array_to_string(list_filter(source[1:16], lambda t, i: i % 2 = 0), ' ') FROM samp
        UNION ALL SELECT r.id, r.rank + 1, 'profile_' || (r.rank - 1), 'profile_seed', h.title FROM retr r JOIN hist h USING (user_id, pos) WHERE r.rank <= 2
        ) WHERE len(text) > 0)""",
    "cpairs": f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY penalty, similarity, a_candidate_id, b_candidate_id) AS rank FROM (
        SELECT a.id, a.candidate_id AS a_candidate_id, b.candidate_id AS b_candidate_id, a.text AS a_text, b.text AS b_text,
        CASE WHEN a.type = b.type THEN 1 ELSE 0 END AS penalty, round({jac(tok('a.text'), tok('b.text'), '1e0')}, 6) AS similarity
        FROM seeds a JOIN seeds b ON a.id = b.id AND a.pos < b.pos)) WHERE rank <= 2)""",
    "pool": f"""(SELECT id, pos, candidate_id, type, text, NULL AS parent_a, NULL AS parent_b FROM seeds
        UNION ALL SELECT id, pos + 4, 'mutation_' || pos, 'mutation', array_to_string(list_concat(w[1:CAST(ceil(len(w) / 2e0) AS BIGINT)], s[CAST(ceil(len(s) / 2e0) AS BIGINT) + 1:]), ' '), candidate_id, NULL
        FROM (SELECT seeds.*, {tok('text')} AS w, source[1:8] AS s FROM seeds JOIN samp USING (id))
        UNION ALL SELECT id, rank + 7, 'crossover_' || (rank - 1), 'crossover', array_to_string(list_concat(a[1:CAST(ceil(len(a) / 2e0) AS BIGINT)], b[CAST(ceil(len(b) / 2e0) AS BIGINT) + 1:]), ' '), a_candidate_id, b_candidate_id
        FROM (SELECT cpairs.*, {tok('a_text')} AS a, {tok('b_text')} AS b FROM cpairs))""",
    "scored": f"""(SELECT id, pos, candidate_id, type, text, parent_a, parent_b, round({rouge_1('w', 'g')}, 8) AS rouge_1, round({rouge_l('w', 'g')}, 8) AS rouge_l
        FROM (SELECT pool.*, {tok('text')} AS w, {tok('target')} AS g FROM pool JOIN samp USING (id)))""",
    "deltas": """(SELECT c.id, c.candidate_id, c.type, c.rouge_l, CASE WHEN b.rouge_l > a.rouge_l THEN b.candidate_id ELSE a.candidate_id END AS parent_id,
        CASE WHEN b.rouge_l > a.rouge_l THEN b.type ELSE a.type END AS parent_type,
        CASE WHEN b.rouge_l > a.rouge_l THEN b.rouge_l ELSE a.rouge_l END AS parent_rouge_l,
        round(c.rouge_l - CASE WHEN b.rouge_l > a.rouge_l THEN b.rouge_l ELSE a.rouge_l END, 8) AS delta
        FROM scored c JOIN scored a ON a.id = c.id AND a.candidate_id = c.parent_a LEFT JOIN scored b ON b.id = c.id AND b.candidate_id = c.parent_b)""",
    "sc": f"""(SELECT id, candidate_id, pos, type, rouge_l AS label, round({jac('w', 's', '1e0')}, 6) AS score
        FROM (SELECT scored.*, {tok('text')} AS w, list_distinct(source) AS s FROM scored JOIN samp USING (id)))""",
    "sc2": f"(SELECT id, candidate_id, pos, label, len({tok('text')})::DOUBLE AS score FROM (SELECT sc.*, pool.text FROM sc JOIN pool USING (id, candidate_id)))",
    "ranked": """(SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id) AS rank,
        row_number() OVER (PARTITION BY id ORDER BY label DESC, candidate_id) AS ideal_rank,
        label >= max(label) OVER (PARTITION BY id) - 1e-12 AS oracle FROM sc)""",
    "prs": "(SELECT a.id, a.score - b.score AS ds, a.label - b.label AS dl FROM sc a JOIN sc b ON a.id = b.id AND a.pos < b.pos)",
    "roll": """(SELECT 'c' || c.conv_id AS rollout_id, 'r' || c.turn AS response_id, c.text AS output, t.target FROM conversations c
        JOIN (SELECT conv_id, arg_max(text, turn) AS target FROM conversations WHERE role = 'user' GROUP BY conv_id) t USING (conv_id) WHERE role = 'assistant')""",
    "rew": f"(SELECT rollout_id, response_id, round({rouge_l('a', 'b')}, 8) AS reward FROM (SELECT *, {tok('output')} AS a, {tok('target')} AS b FROM roll))",
    "pref": """(SELECT rollout_id, n AS responses, c.response_id AS chosen_id, r.response_id AS rejected_id, c.reward AS chosen_reward, r.reward AS rejected_reward,
        round(c.reward - r.reward, 8) AS margin, CASE WHEN n < 2 THEN 'insufficient_responses' WHEN c.response_id = r.response_id OR round(c.reward - r.reward, 8) < 3e-2 THEN 'low_margin' ELSE 'accepted' END AS status
        FROM (SELECT rollout_id, count(*) AS n, max({'reward': reward, 'response_id': response_id}) AS c, min({'reward': reward, 'response_id': response_id}) AS r FROM rew GROUP BY rollout_id))""",
    "vis": f"""(SELECT r.id, r.rank, r.pos AS item, rtrim(left(h.abstract, 500)) AS input, rtrim(left(h.title, 300)) AS output FROM retr r JOIN samp s USING (id)
        JOIN hist h ON h.user_id = r.user_id AND h.pos = r.pos WHERE r.rank <= 8 AND len(h.title) > 0 AND {key('h.title')} <> {key('s.target')})""",
    "sftm": f"""(SELECT p.id || ':' || candidate_id AS example_id, p.id, text AS parent, target AS output, round(1e0 / count(*) OVER (PARTITION BY p.id), 8) AS sample_weight,
        CASE WHEN {SPLIT.format('p.id')} < 5e-2 THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM pool WHERE parent_a IS NULL) p JOIN samp USING (id) WHERE n <= 4 AND target <> '')""",
    "sftc": """(SELECT p.id, p.id || ':' || a_candidate_id || ':' || b_candidate_id AS example_id,
        CASE WHEN a_text = target THEN 'keep_a' WHEN b_text = target THEN 'keep_b' ELSE 'merge' END AS action, target AS output FROM cpairs p JOIN samp USING (id) WHERE target <> '')""",
    "cp": f"""(SELECT id, a_id, candidate_id AS b_id, fresh, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, pos) AS n FROM (
        SELECT id, a_id, candidate_id, pos, fresh, round(5e-1 * CASE WHEN n BETWEEN 2 AND 40 THEN 1e0 ELSE 0e0 END + 25e-2 * least(1e0, fresh / 3e0) + 15e-2 * CASE WHEN len(w) > 0 THEN len(list_intersect(w, q)) / len(w)::DOUBLE ELSE 0e0 END
          + 1e-1 * (1 - {jac('w', 'aw', '0e0')}), 6) AS value FROM (
        SELECT *, len(list_filter(list_intersect(w, q), lambda x: NOT list_contains(aw, x))) AS fresh FROM (SELECT s.id, s.pos, s.candidate_id, {TITLE_TOK.format('s.text')} AS w, len({tok('s.text')}) AS n, {TITLE_TOK.format('source_text')} AS q,
          f.candidate_id AS a_id, f.pos AS apos, {TITLE_TOK.format('f.text')} AS aw FROM seeds s JOIN samp ON samp.id = s.id
          JOIN (SELECT id, arg_min(candidate_id, pos) AS candidate_id, min(pos) AS pos, arg_min(text, pos) AS text FROM seeds GROUP BY id) f ON f.id = s.id) WHERE pos <> apos))) WHERE n = 1)""",
    "tf": "(SELECT DISTINCT user_id AS id, pos AS item, n, unnest(list_transform(words[1:8], lambda x: left(x, 1))) AS factor FROM (SELECT *, len(words[1:8]) AS n FROM hist))",
}
USES = {
    "tf": "hist", "cp": "seeds samp",
    "samp": "asked said", "lens": "hist", "stats": "lens", "post": "hist", "df": "post", "qterm": "samp",
    "matched": "qterm df post lens stats", "retr": "samp lens matched", "seeds": "samp retr hist", "cpairs": "seeds",
    "pool": "seeds samp cpairs", "scored": "pool samp", "deltas": "scored", "sc": "scored samp", "sc2": "sc pool",
    "ranked": "sc", "prs": "sc", "rew": "roll", "pref": "rew", "vis": "retr samp hist", "sftm": "pool samp", "sftc": "cpairs samp",
}


def sql(uses: str, body: str) -> str:
    """``body`` after the expressions it uses and theirs, in order."""
    needed: set[str] = set()
    todo = uses.split()
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += USES.get(name, "").split()
    parts = ", ".join(f"{name} AS MATERIALIZED {text}" for name, text in CTE.items() if name in needed)
    return f"WITH {parts} {body}" if parts else body


_DCG = ", ".join(
    f"sum(CASE WHEN rank <= {k} THEN (pow(2e0, label) - 1) / log2(rank + 1e0) ELSE 0 END) AS d{k}, "
    f"sum(CASE WHEN ideal_rank <= {k} THEN (pow(2e0, label) - 1) / log2(ideal_rank + 1e0) ELSE 0 END) AS i{k}"
    for k in (1, 3, 5, 10)
)
_SUMMARY = """count({0}) AS n, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS median, round(stddev_pop({0}), 6) AS std,
    round(quantile_cont({0}, 0.9), 6) AS p90, round(min({0}), 6) AS least, round(max({0}), 6) AS most"""
_WTL = """count(*) AS n, count(*) FILTER ({0} > 1e-12) AS wins, count(*) FILTER (abs({0}) <= 1e-12) AS ties, count(*) FILTER ({0} < -1e-12) AS losses,
    count(*) FILTER ({0} >= 2e-2) AS big_wins, count(*) FILTER ({0} <= -2e-2) AS big_losses, round(avg({0}), 6) AS mean_delta"""


def _zscore(x: str) -> str:
    s = f"stddev_pop({x}) OVER (PARTITION BY id)"
    return f"({x} - avg({x}) OVER (PARTITION BY id)) / CASE WHEN {s} <= 1e-12 THEN 1e0 ELSE {s} END"


def _pairs_sql(where: str, order: str) -> str:
    return sql(
        "scored",
        f"""SELECT id, pair_id, chosen_id, rejected_id, margin, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY margin {order}, pair_id) AS rank FROM (
        SELECT id, id || ':' || chosen_id || ':' || rejected_id AS pair_id, chosen_id, rejected_id, margin FROM (
        SELECT a.id, CASE WHEN a.rouge_l > b.rouge_l THEN a.candidate_id ELSE b.candidate_id END AS chosen_id,
        CASE WHEN a.rouge_l > b.rouge_l THEN b.candidate_id ELSE a.candidate_id END AS rejected_id, round(abs(a.rouge_l - b.rouge_l), 8) AS margin, greatest(a.rouge_l, b.rouge_l) AS top, a.best
        FROM (SELECT *, max(rouge_l) OVER (PARTITION BY id) AS best FROM scored) a JOIN scored b ON a.id = b.id AND a.pos < b.pos) WHERE margin >= 2e-2 {where})) WHERE rank <= 12""",
    )


def _ngram(n: int) -> str:
    def grams(x: str) -> str:
        return f"CASE WHEN len({x}) < {n} THEN [] ELSE list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n} - 1], ' ')) END"

    return f"""(SELECT coalesce(sum(least(c, r)), 0) AS hit FROM (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({grams('p')}) AS g FROM texts) GROUP BY ALL)
        JOIN (SELECT id, g, count(*) AS r FROM (SELECT id, unnest({grams('t')}) AS g FROM texts) GROUP BY ALL) USING (id, g)) h{n},
        (SELECT coalesce(sum(greatest(len(p) - {n - 1}, 0)), 0) AS all_ FROM texts) a{n}"""


#: Steps of the Poisson(1) distribution, by its own recurrence.
_STEPS = [math.exp(-1)]
_TERM = math.exp(-1)
for _k in range(1, 12):
    _TERM /= _k
    _STEPS.append(_STEPS[-1] + _TERM)


def drawn(seed: str, key: str = "k") -> str:
    """How often a row counts in draw ``b``: Poisson(1) of a word of a hash of seed, four draws and key."""
    u = f"('0x' || substr(md5('{seed}:' || (b // 4) || ':' || {key}), 8 * (b % 4) + 1, 8))::BIGINT / 4294967296e0"
    return f"list_sum(list_transform([{', '.join(map(repr, _STEPS))}], lambda x: CASE WHEN {u} >= x THEN 1 ELSE 0 END))"


def _tokens_13a(x: str) -> str:
    t = f"replace(replace(replace(replace(replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    t = f"' ' || {t} || ' '"
    for pattern, new in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({t}, '[ \\t\\r\\x0b\\x0c]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    out = {
        "bm25_topk": sql("retr", "SELECT id, pos, CAST(rank AS INT) AS rank, score FROM retr"),
        "rouge_scores": sql("scored", "SELECT id, candidate_id, rouge_1, rouge_l FROM scored"),
        "rag_top1_eval": sql(
            "retr samp hist",
            f"""SELECT count(*) AS samples, count(*) FILTER (p <> '') AS valid, round(avg({rouge_1('a', 'b')}), 6) AS rouge_1, round(avg({rouge_l('a', 'b')}), 6) AS rouge_l
            FROM (SELECT coalesce(h.title, '') AS p, {tok('h.title')} AS a, {tok('s.target')} AS b FROM samp s LEFT JOIN (SELECT * FROM retr WHERE rank = 1) r ON r.id = s.id
            LEFT JOIN hist h ON h.user_id = r.user_id AND h.pos = r.pos)""",
        ),
        "profile_clean": sql(
            "hist",
            """SELECT user_id, pos, id FROM hist WHERE len(trim(title)) > 0 AND lower(trim(abstract)) NOT IN ('', 'without abstract', 'no abstract available', 'no abstract available.')""",
        ),
        "profile_greedy_dedup": sql(
            "hist",
            f"""SELECT user_id, k.pos AS pos FROM (SELECT user_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a = x.a OR y.t = x.t)) > 0
            THEN acc ELSE list_append(acc, x) END, l[1:0])) AS k FROM (SELECT user_id, list({{'pos': pos, 'a': {key('abstract')}, 't': {key('title')}}} ORDER BY pos) AS l FROM hist
            WHERE len(trim(title)) > 0 AND lower(trim(abstract)) NOT IN ('', 'without abstract', 'no abstract available', 'no abstract available.') GROUP BY user_id))""",
        ),
        "visible_history": sql("vis", "SELECT id, CAST(rank AS INT) AS rank, item, input, output FROM vis"),
        "target_denylist": sql(
            "hist samp",
            f"SELECT user_id, pos FROM hist h WHERE NOT EXISTS (SELECT 1 FROM samp s WHERE s.user_id = h.user_id AND {key('s.target')} = {key('h.title')})",
        ),
        "first_occurrence_dedup": sql(
            "hist",
            f"""SELECT user_id, pos, title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS INT) AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY pos) AS n FROM (SELECT user_id, pos, title, array_to_string({tok('title')}, ' ') AS k FROM hist)
            WHERE k <> '') WHERE n = 1""",
        ),
        "loo_bm25": sql(
            "hist",
            f""", keyed AS (SELECT user_id, list({{'pos': pos, 'a': {key('abstract')}, 't': {key('title')}}} ORDER BY pos) AS l FROM hist WHERE {key('abstract')} <> '' AND {key('title')} <> '' GROUP BY user_id),
            firsts AS (SELECT user_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a = x.a OR y.t = x.t)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0]) AS k FROM keyed),
            it AS (SELECT h.user_id, h.pos, h.words, len(h.words)::DOUBLE AS len FROM hist h JOIN (SELECT user_id, unnest(k) AS k FROM firsts WHERE len(k) >= 10) f ON f.user_id = h.user_id AND f.k.pos = h.pos),
            po AS (SELECT user_id, pos, term, count(*)::DOUBLE AS tf FROM (SELECT user_id, pos, unnest(words) AS term FROM it) GROUP BY ALL),
            dn AS (SELECT user_id, term, count(*)::DOUBLE AS df FROM po GROUP BY ALL), un AS (SELECT user_id, count(*)::DOUBLE AS n, sum(len) AS total FROM it GROUP BY user_id),
            ask AS (SELECT user_id, held, term, count(*)::DOUBLE AS qtf FROM (SELECT user_id, pos AS held, unnest(words[9:]) AS term FROM it) GROUP BY ALL),
            met AS (SELECT user_id, held, pos, round(sum(qtf * ln(1e0 + ((n - 1) - (df - 1) + 5e-1) / ((df - 1) + 5e-1)) * (tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * i.len /
              CASE WHEN (total - o.len) / greatest(n - 1, 1e0) = 0 THEN 1e0 ELSE (total - o.len) / greatest(n - 1, 1e0) END)))), 6) AS score FROM ask JOIN dn USING (user_id, term) JOIN po USING (user_id, term) JOIN it i USING (user_id, pos)
              JOIN (SELECT user_id, pos AS held, len FROM it) o USING (user_id, held) JOIN un USING (user_id) WHERE held <> pos GROUP BY user_id, held, pos)
            SELECT user_id, held, pos, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, held ORDER BY score DESC, pos) AS rank FROM (
              SELECT a.user_id, a.pos AS held, b.pos, coalesce(score, 0e0) AS score FROM it a JOIN it b ON a.user_id = b.user_id AND a.pos <> b.pos LEFT JOIN met m ON m.user_id = a.user_id AND m.held = a.pos AND m.pos = b.pos)) WHERE rank <= 8""",
        ),
        "jaccard_profile_rank": sql(
            "hist samp",
            f"""SELECT id, pos, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM (
            SELECT s.id, h.pos, round({jac('q', 't', '0e0')}, 6) AS score FROM (SELECT *, {TITLE_TOK.format('source_text')} AS q FROM samp) s
            JOIN (SELECT *, {TITLE_TOK.format('title')} AS t FROM hist) h USING (user_id) WHERE h.title <> s.target)) WHERE rank <= 8""",
        ),
        "content_negatives": sql(
            "hist samp",
            f"""SELECT id, pos, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM (
            SELECT q.id, t.pos, round(sum(idf), 6) AS score FROM (SELECT id, user_id AS asker, unnest({TITLE_TOK.format('source_text')}) AS term FROM samp) q
            JOIN (SELECT term, ln(((SELECT count(*) FROM hist) + 1e0) / (count(*) + 1e0)) + 1e0 AS idf FROM (SELECT unnest({TITLE_TOK.format('title')}) AS term FROM hist) GROUP BY term) i USING (term)
            JOIN (SELECT user_id, pos, unnest({TITLE_TOK.format('title')}) AS term FROM hist) t USING (term) WHERE asker <> user_id GROUP BY q.id, t.pos)) WHERE rank <= 2""",
        ),
        "dense_topk": """SELECT id, pos, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rank FROM (
            SELECT q.vec_id AS id, v.vec_id AS pos, round(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 6) AS score
            FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 8""",
        "hash_split": sql("hist", f"SELECT id, CASE WHEN {SPLIT.format('id')} < 5e-2 THEN 'validation' ELSE 'train' END AS split FROM hist"),
        "user_split": sql(
            "hist",
            """SELECT user_id, id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY sha256('7:' || user_id || ':' || id), id) <=
            least(greatest(5, round_even(count(*) OVER (PARTITION BY user_id) * 2e-1, 0)), count(*) OVER (PARTITION BY user_id) - 1) THEN 'validation' ELSE 'train' END AS split FROM hist""",
        ),
        "split_disjointness": sql(
            "hist",
            f"""SELECT split, count(*) AS rows, (SELECT count(*) FROM (SELECT id FROM hist GROUP BY id HAVING count(DISTINCT {SPLIT.format('id')} < 5e-2) > 1)) AS shared
            FROM (SELECT CASE WHEN {SPLIT.format('id')} < 5e-2 THEN 'validation' ELSE 'train' END AS split FROM hist) GROUP BY split""",
        ),
        "first_users": sql(
            "samp",
            """SELECT user_id, id, CAST(n AS INT) AS n FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n,
            dense_rank() OVER (ORDER BY user_id) AS u FROM samp) WHERE u <= 10 AND n <= 3""",
        ),
        "candidate_pool": sql("pool", "SELECT id, CAST(pos AS INT) AS pos, candidate_id, type, text, parent_a, parent_b FROM pool"),
        "crossover_pairs": sql("cpairs", "SELECT id, a_candidate_id, b_candidate_id, penalty, similarity, CAST(rank AS INT) AS rank FROM cpairs"),
        "pool_deltas": sql("deltas", "SELECT id, candidate_id, parent_id, parent_type, rouge_l, parent_rouge_l, delta FROM deltas"),
        "mutation_delta": sql("deltas", f"SELECT type, parent_type, {_WTL.format('delta')} FROM deltas GROUP BY type, parent_type"),
        "pool_oracle": sql(
            "scored",
            """SELECT count(*) AS samples, round(avg(seed0), 6) AS seed0, round(avg(best_seed), 6) AS best_seed, round(avg(oracle), 6) AS oracle, round(avg(unique_rate), 6) AS unique_rate FROM (
            SELECT id, arg_min(rouge_l, pos) AS seed0, max(rouge_l) FILTER (parent_a IS NULL) AS best_seed, max(rouge_l) AS oracle, count(DISTINCT lower(trim(text))) / count(*)::DOUBLE AS unique_rate FROM scored GROUP BY id)""",
        ),
        "per_type_table": sql("scored", f"SELECT type, {_SUMMARY.format('rouge_l')} FROM scored GROUP BY type"),
        "pool_similarity": sql(
            "pool",
            f"""SELECT id, count(*) AS pairs, round(avg(r), 6) AS similarity FROM (SELECT a.id, round({rouge_l('a.w', 'b.w')}, 8) AS r FROM (SELECT *, {tok('text')} AS w FROM pool) a
            JOIN (SELECT *, {tok('text')} AS w FROM pool) b ON a.id = b.id AND a.pos < b.pos) GROUP BY id""",
        ),
        "fixed_width_pool": sql(
            "pool",
            """SELECT id, array_to_string(list_concat(k, list_transform(range(0, 5 - len(k)), lambda i: k[1])), '|') AS parents, len(k) AS unique_count FROM (
            SELECT id, list_filter(c, lambda x, i: list_position(c, x) = i)[1:5] AS k FROM (SELECT id, list(text ORDER BY pos, text) AS c FROM pool GROUP BY id))""",
        ),
        "combination_plan": sql(
            "seeds",
            """SELECT id, CAST(step AS INT) AS step, CAST(p AS INT) AS p, CAST(r AS INT) AS r, CAST((p + r) % n AS INT) AS factor FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, p) AS step FROM (SELECT s.id, s.pos AS p, n, unnest(range(0, n)) AS r FROM seeds s
            JOIN (SELECT id, count(*) AS n FROM seeds GROUP BY id) USING (id))) WHERE step <= 6""",
        ),
        "parent_quality_flags": sql(
            "pool",
            rf"""SELECT id, candidate_id, array_to_string(list_filter([CASE WHEN len(trim(text)) = 0 THEN 'empty' END,
            CASE WHEN regexp_matches(text, '(?i)^(?:\[?paper title\]?|user title example|example input|abstract|title|output)\s*:?$') THEN 'exact' END,
            CASE WHEN regexp_matches(text, '(?i)(?:write one concise|example input\s*:|example output|user title example|parent title\s*:|abstract\s*:|output only|```)') THEN 'leak' END,
            CASE WHEN regexp_matches(ltrim(text), '^(?:•|- |\* )') THEN 'bullet' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END,
            CASE WHEN len(text) > 300 THEN 'long' END, CASE WHEN len({tok('text')}) NOT BETWEEN 2 AND 40 THEN 'words' END], lambda x: x IS NOT NULL), ',') AS issues FROM pool""",
        ),
        "parent_child_prefs": sql(
            "deltas",
            """SELECT id || ':' || candidate_id AS pair_id, CASE WHEN delta > 0 THEN candidate_id ELSE parent_id END AS chosen_id,
            CASE WHEN delta > 0 THEN parent_id ELSE candidate_id END AS rejected_id, abs(delta) AS margin FROM deltas WHERE abs(delta) >= 2e-2""",
        ),
        "pairs_all": _pairs_sql("", "DESC"),
        "pairs_hard_negative": _pairs_sql("", "ASC"),
        "pairs_top": _pairs_sql("AND top >= best - 1e-8", "ASC"),
        "gold_preferences": sql("pref", "SELECT * FROM pref"),
        "preference_status": sql("pref", "SELECT status, count(*) AS n FROM pref GROUP BY status"),
        "dpo_pairs": sql(
            "pref roll",
            """SELECT p.rollout_id || ':preference' AS pair_id, trim(c.output) AS chosen, trim(r.output) AS rejected, chosen_reward, rejected_reward, margin FROM pref p
            JOIN roll c ON c.rollout_id = p.rollout_id AND c.response_id = p.chosen_id JOIN roll r ON r.rollout_id = p.rollout_id AND r.response_id = p.rejected_id
            WHERE status = 'accepted' AND trim(c.output) <> '' AND trim(r.output) <> ''""",
        ),
        "dpo_loss": sql(
            "pref",
            """SELECT rollout_id, round(ln(1e0 + exp(-1e-1 * ((chosen_reward - rejected_reward) - (5e-1 * chosen_reward - 5e-1 * rejected_reward)))), 8) AS loss FROM pref""",
        ),
        "gated_pairs": sql(
            "scored",
            """SELECT id, c.candidate_id AS chosen_id, r.candidate_id AS rejected_id, round(c.rouge_l - r.rouge_l, 8) AS margin, round(c.rouge_l - parent_reward, 8) AS improvement,
            CASE WHEN coalesce(n, 0) < 2 THEN 'too_few_mutations' WHEN round(c.rouge_l - r.rouge_l, 8) < 3e-2 THEN 'margin' WHEN round(c.rouge_l - parent_reward, 8) < 2e-2 THEN 'parent' ELSE 'accepted' END AS status
            FROM (SELECT id, arg_min(rouge_l, pos) AS parent_reward FROM scored GROUP BY id) LEFT JOIN (
            SELECT id, count(*) AS n, max({'rouge_l': rouge_l, 'pos': pos, 'candidate_id': candidate_id}) AS c, min({'rouge_l': rouge_l, 'pos': pos, 'candidate_id': candidate_id}) AS r
            FROM scored WHERE type = 'mutation' GROUP BY id) USING (id)""",
        ),
        "sft_output_only": sql("sftm", "SELECT example_id, id, parent, output, sample_weight, split FROM sftm"),
        "crossover_sft": sql("sftc", "SELECT example_id, action, output FROM sftc"),
        "dual_operator_sft": sql(
            "sftm sftc",
            """SELECT example_id, m.id, 'mutation' AS operation, output, round(CASE WHEN c IS NULL THEN 1e0 ELSE 5e-1 END / count(*) OVER (PARTITION BY m.id), 8) AS weight
            FROM sftm m LEFT JOIN (SELECT id, count(*) AS c FROM sftc GROUP BY id) USING (id)
            UNION ALL SELECT example_id, id, 'crossover', output, round(5e-1 / count(*) OVER (PARTITION BY id), 8) FROM sftc""",
        ),
        "multitask_rows": sql(
            "samp vis",
            """SELECT id || ':title' AS example_id, 'title' AS task, target AS output, 1e0 AS weight FROM samp WHERE target <> ''
            UNION ALL SELECT id || ':rationale', 'rationale', h, 1e-1 FROM samp JOIN (SELECT id, string_agg(output, ' ; ' ORDER BY rank) AS h FROM vis GROUP BY id) USING (id) WHERE target <> '' AND h <> ''""",
        ),
        "warmup_balance": sql(
            "sftm",
            """SELECT example_id, split, 'trace' AS kind FROM sftm WHERE ends_with(example_id, 'task_0')
            UNION ALL SELECT example_id, p.split, 'output_only' FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('3:' || example_id), example_id) AS n FROM sftm WHERE NOT ends_with(example_id, 'task_0')) p
            JOIN (SELECT split, round_even(count(*) * 5e-1, 0) AS wanted FROM sftm WHERE ends_with(example_id, 'task_0') GROUP BY split) w ON w.split = p.split WHERE n <= wanted""",
        ),
        "prompts": sql(
            "samp vis",
            """SELECT id, 'History titles: ' || coalesce(h, '') || chr(10) || 'Abstract: ' || array_to_string(source, ' ') || chr(10) || 'Title:' AS prompt FROM samp
            LEFT JOIN (SELECT id, string_agg(output, ' ; ' ORDER BY rank) AS h FROM vis GROUP BY id) USING (id)""",
        ),
        "prompt_head_tail": f"""SELECT doc_id, array_to_string(CASE WHEN len(w) <= 64 THEN w ELSE list_concat(w[1:32], w[len(w) - 31:]) END, ' ') AS kept, len(w) > 64 AS cut
            FROM (SELECT doc_id, {tok('text')} AS w FROM documents)""",
        "length_diagnostics": f"""SELECT count(*) AS examples, round(avg(n), 6) AS mean_tokens, round(avg(CASE WHEN n > 512 THEN 1e0 ELSE 0e0 END), 6) AS truncated_share
            FROM (SELECT len({tok('text')}) AS n FROM documents)""",
        "text_keys": f"SELECT doc_id, md5({key('text')}) AS compact_key, md5(array_to_string({tok('text')}, ' ')) AS spaced_key, len({TITLE_TOK.format('text')}) AS title_tokens FROM documents",
        "clean_titles": r"""SELECT doc_id, md5(coalesce(left(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(trim(x), '^"+|"+$', '', 'g'))), lambda x: len(x) > 0)[1], 300), '')) AS title
            FROM (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(trim(coalesce(text, '')), '(?i)^```(?:text|title)?\s*|\s*```$', '', 'g')), '(?i)^(?:title|output)\s*:\s*', '')) AS t FROM documents)""",
        "leak_flags": r"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b(?:gold|ground[ -]?truth|rouge|reference answer|target title)\b') AS forbidden FROM documents""",
        "hit_mrr_ndcg": sql(
            "ranked",
            f"""SELECT id, first AS first_rank, round(1e0 / first, 6) AS reciprocal_rank, {', '.join(f'CAST(first <= {k} AS INT) AS hit_{k}' for k in (1, 3, 5, 10))},
            {', '.join(f'round(CASE WHEN i{k} <= 1e-12 THEN 0e0 ELSE d{k} / i{k} END, 6) AS ndcg_{k}' for k in (1, 3, 5, 10))}
            FROM (SELECT id, min(rank) FILTER (oracle) AS first, {_DCG} FROM ranked GROUP BY id)""",
        ),
        "regret_summary": sql(
            "ranked",
            """SELECT id, round(best, 6) AS best, round(selected, 6) AS selected, round(best - selected, 6) AS regret,
            round(CASE WHEN best - worst > 1e-12 THEN (best - selected) / (best - worst) ELSE 0e0 END, 6) AS normalized_regret
            FROM (SELECT id, max(label) AS best, min(label) AS worst, arg_min(label, rank) AS selected FROM ranked GROUP BY id)""",
        ),
        "pair_accuracy": sql("prs", "SELECT id, count(*) AS pairs, count(*) FILTER (ds * dl > 0) AS correct FROM prs WHERE abs(dl) >= 2e-2 GROUP BY id"),
        "rank_correlations": sql(
            "sc prs",
            """SELECT id, pearson, spearman, kendall FROM (SELECT id, CASE WHEN count(*) < 2 OR stddev_pop(score) <= 1e-12 OR stddev_pop(label) <= 1e-12 THEN NULL ELSE round(covar_pop(score, label) / (stddev_pop(score) * stddev_pop(label)), 6) END AS pearson,
            CASE WHEN count(*) < 2 OR stddev_pop(rs) <= 1e-12 OR stddev_pop(rl) <= 1e-12 THEN NULL ELSE round(covar_pop(rs, rl) / (stddev_pop(rs) * stddev_pop(rl)), 6) END AS spearman FROM (
            SELECT *, rank() OVER (PARTITION BY id ORDER BY score) + (count(*) OVER (PARTITION BY id, score) - 1) / 2e0 AS rs, rank() OVER (PARTITION BY id ORDER BY label) + (count(*) OVER (PARTITION BY id, label) - 1) / 2e0 AS rl FROM sc) GROUP BY id)
            LEFT JOIN (SELECT id, CASE WHEN sqrt((c + d + ts)::DOUBLE * (c + d + tl)) > 1e-12 THEN round((c - d) / sqrt((c + d + ts)::DOUBLE * (c + d + tl)), 6) END AS kendall FROM (
            SELECT id, count(*) FILTER (abs(ds) > 1e-12 AND abs(dl) > 1e-12 AND ds * dl > 0) AS c, count(*) FILTER (abs(ds) > 1e-12 AND abs(dl) > 1e-12 AND ds * dl < 0) AS d,
            count(*) FILTER (abs(ds) <= 1e-12 AND abs(dl) > 1e-12) AS ts, count(*) FILTER (abs(dl) <= 1e-12 AND abs(ds) > 1e-12) AS tl FROM prs GROUP BY id)) USING (id)""",
        ),
        "listwise_kl": sql(
            "sc",
            """SELECT id, round(sum(p * (ln(p + 1e-12) - ln(q + 1e-12))), 6) AS kl FROM (SELECT id, ep / sum(ep) OVER (PARTITION BY id) AS p, eq / sum(eq) OVER (PARTITION BY id) AS q FROM (
            SELECT id, exp((label - max(label) OVER (PARTITION BY id)) / 1e-1) AS ep, exp(score - max(score) OVER (PARTITION BY id)) AS eq FROM sc)) GROUP BY id""",
        ),
        "rank_losses": sql(
            "sc",
            """, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY id)) AS e, max(label) OVER (PARTITION BY id) AS best FROM sc),
            tiers AS (SELECT id, label, sum(e) AS own FROM e GROUP BY id, label),
            top AS (SELECT id, arg_max({'pos': pos, 'score': score, 'label': label}, {'s': score, 'p': -pos}) AS t FROM e GROUP BY id)
            SELECT id, listmle, pointwise, expected_regret, oracle_set, coalesce(top1_lambda, 0) AS top1_lambda FROM
            (SELECT id, round(avg(ln(rest) - ln(own)), 6) AS listmle FROM (SELECT id, own, sum(own) OVER (PARTITION BY id ORDER BY label) AS rest FROM tiers) GROUP BY id)
            JOIN (SELECT id, round(avg(CASE WHEN gap < 1 THEN 5e-1 * gap * gap ELSE gap - 5e-1 END), 6) AS pointwise, round(max(label) - sum(e * label) / sum(e), 6) AS expected_regret,
              round(ln(sum(e)) - ln(sum(CASE WHEN label >= best - 1e-8 THEN e ELSE 0 END)), 6) AS oracle_set FROM (SELECT *, abs(1e0 / (1e0 + exp(-score)) - label) AS gap FROM e) GROUP BY id) USING (id)
            LEFT JOIN (SELECT id, round(avg(ln(1e0 + exp(-CASE WHEN label > t.label THEN score - t.score ELSE t.score - score END)) * abs(label - t.label)), 6) AS top1_lambda
              FROM e JOIN top USING (id) WHERE pos <> t.pos AND abs(label - t.label) > 1e-8 GROUP BY id) USING (id)""",
        ),
        "blend_rankers": sql(
            "sc sc2",
            f"""SELECT id, candidate_id, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate_id) AS INT) AS rank FROM (
            SELECT id, candidate_id, round(7e-1 * a + (1 - 7e-1) * b, 6) AS score FROM (SELECT id, candidate_id, {_zscore('score')} AS a FROM sc) JOIN (SELECT id, candidate_id, {_zscore('score')} AS b FROM sc2) USING (id, candidate_id))""",
        ),
        "alpha_grid": sql(
            "sc sc2",
            f"""SELECT alpha, regret, hit, CAST(row_number() OVER (ORDER BY regret, hit DESC, alpha) AS INT) AS place FROM (
            SELECT alpha, round(avg(best - got), 6) AS regret, round(avg(CASE WHEN got >= best - 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS hit FROM (
            SELECT alpha, id, max(label) AS best, arg_max(label, {{'s': score, 'p': -pos}}) AS got FROM (
            SELECT alpha, id, pos, label, round(alpha * a + (1 - alpha) * b, 6) AS score FROM (SELECT id, candidate_id, pos, label, {_zscore('score')} AS a FROM sc) JOIN (SELECT id, candidate_id, {_zscore('score')} AS b FROM sc2) USING (id, candidate_id),
            (VALUES (0e0), (25e-2), (5e-1), (75e-2), (1e0)) g(alpha)) GROUP BY alpha, id) GROUP BY alpha)""",
        ),
        "user_macro": sql(
            "scored samp",
            """SELECT count(*) AS users, round(avg(m), 6) AS user_macro, (SELECT round(avg(best), 6) FROM (SELECT max(rouge_l) AS best FROM scored GROUP BY id)) AS query_macro FROM (
            SELECT user_id, avg(best) AS m FROM (SELECT id, max(rouge_l) AS best FROM scored GROUP BY id) JOIN samp USING (id) GROUP BY user_id)""",
        ),
        "gap_closure": sql(
            "ranked",
            """SELECT round(seed, 6) AS seed, round(selected, 6) AS selected, round(oracle, 6) AS oracle, CASE WHEN abs(oracle - seed) > 1e-12 THEN round((selected - seed) / (oracle - seed), 6) END AS closure FROM (
            SELECT avg(s) AS seed, avg(r) AS selected, avg(o) AS oracle FROM (SELECT id, arg_min(label, pos) AS s, arg_min(label, rank) AS r, max(label) AS o FROM ranked GROUP BY id))""",
        ),
        "score_summary": sql("scored", f"SELECT {_SUMMARY.format('rouge_l')} FROM scored"),
        "win_tie_loss": sql("deltas", f"SELECT {_WTL.format('delta')} FROM deltas"),
        "paired_bootstrap": sql(
            "deltas",
            f""", r AS (SELECT id || ':' || candidate_id AS k, delta FROM deltas),
            m AS (SELECT b, round(sum(w * delta) / sum(w), 9) AS m FROM (SELECT b, delta, {drawn('11')} AS w FROM r, range(5000) t(b)) GROUP BY b HAVING sum(w) > 0)
            SELECT (SELECT count(*) FROM r) AS n, (SELECT round(avg(delta), 6) FROM r) AS mean_delta, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m""",
        ),
        "corpus_bleu": sql(
            "retr samp hist",
            rf""", raw AS (SELECT s.id, trim(coalesce(h.title, '')) AS p, trim(s.target) AS t FROM samp s LEFT JOIN (SELECT * FROM retr WHERE rank = 1) r ON r.id = s.id LEFT JOIN hist h ON h.user_id = r.user_id AND h.pos = r.pos),
            texts AS (SELECT id, {_tokens_13a('p')} AS p, {_tokens_13a('t')} AS t FROM raw), n AS (SELECT CAST(h1.hit AS BIGINT) AS hit_1, CAST(h2.hit AS BIGINT) AS hit_2, CAST(h3.hit AS BIGINT) AS hit_3, CAST(h4.hit AS BIGINT) AS hit_4,
            CAST(a1.all_ AS BIGINT) AS all_1, CAST(a2.all_ AS BIGINT) AS all_2, CAST(a3.all_ AS BIGINT) AS all_3, CAST(a4.all_ AS BIGINT) AS all_4, (SELECT CAST(sum(len(p)) AS BIGINT) FROM texts) AS sys_len,
            (SELECT CAST(sum(len(t)) AS BIGINT) FROM texts) AS ref_len FROM {', '.join(_ngram(k) for k in (1, 2, 3, 4))}),
            z AS (SELECT *, {', '.join(f'(CASE WHEN hit_{k} = 0 AND all_{k} > 0 THEN 1 ELSE 0 END)' + (f' + z{k - 1}' if k > 1 else '') + f' AS z{k}' for k in (1, 2, 3, 4))} FROM n),
            p AS (SELECT *, {', '.join(f'CASE WHEN all_{k} = 0 THEN 0e0 ELSE 1e2 * CASE WHEN hit_{k} > 0 THEN hit_{k}::DOUBLE ELSE 1 / pow(2e0, z{k}) END / all_{k} END AS p{k}' for k in (1, 2, 3, 4))},
              CASE WHEN sys_len = 0 THEN 0e0 WHEN sys_len >= ref_len THEN 1e0 ELSE exp(1 - ref_len / sys_len::DOUBLE) END AS b FROM z)
            SELECT hit_1, hit_2, hit_3, hit_4, all_1, all_2, all_3, all_4, {', '.join(f'round(p{k}, 6) AS precision_{k}' for k in (1, 2, 3, 4))}, round(b, 6) AS brevity, sys_len, ref_len,
            round(CASE WHEN hit_1 + hit_2 + hit_3 + hit_4 = 0 OR least(p1, p2, p3, p4) = 0 THEN 0e0 ELSE b * exp((ln(greatest(p1, 1e-300)) + ln(greatest(p2, 1e-300)) + ln(greatest(p3, 1e-300)) + ln(greatest(p4, 1e-300))) / 4) END, 6) AS score FROM p""",
        ),
        "style_summary": r"""SELECT user_id, titles, median_words, round(c, 6) AS colon_rate, round(q, 6) AS question_rate, round(a, 6) AS acronym_rate,
            CASE WHEN titles = 0 THEN 'No reliable historical-title style statistics are available.' ELSE
            'Historical titles typically contain ' || regexp_replace(CAST(median_words AS VARCHAR), '\.0$', '') || ' words; ' || CAST(CAST(round_even(c * 100, 0) AS INT) AS VARCHAR) || '% use a colon, '
            || CAST(CAST(round_even(q * 100, 0) AS INT) AS VARCHAR) || '% are questions, and ' || CAST(CAST(round_even(a * 100, 0) AS INT) AS VARCHAR) || '% contain an uppercase acronym. Preserve these structural tendencies only when they fit the current abstract.' END AS summary
            FROM (SELECT user_id, count(*) FILTER (len(t) > 0) AS titles, round(quantile_cont(len(w), 5e-1) FILTER (len(t) > 0), 6) AS median_words, coalesce(avg(CASE WHEN contains(t, ':') THEN 1e0 ELSE 0e0 END) FILTER (len(t) > 0), 0e0) AS c,
            coalesce(avg(CASE WHEN contains(t, '?') THEN 1e0 ELSE 0e0 END) FILTER (len(t) > 0), 0e0) AS q, coalesce(avg(CASE WHEN len(list_filter(w, lambda x: len(x) >= 2 AND upper(x) = x AND regexp_matches(x, '[A-Z]'))) > 0 THEN 1e0 ELSE 0e0 END) FILTER (len(t) > 0), 0e0) AS a
            FROM (SELECT user_id, t, regexp_extract_all(t, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?') AS w FROM (SELECT coalesce(source, '') AS user_id, trim(string_split(coalesce(text, ''), chr(10))[1]) AS t FROM documents)) GROUP BY user_id)""",
        "factor_statistics": sql(
            "tf",
            """SELECT id, factor, support, round(support / items::DOUBLE, 6) AS share, mean_tokens, examples FROM (
            SELECT id, factor, count(*) AS support, round(avg(n), 6) AS mean_tokens, array_to_string(list(item ORDER BY item)[1:3], ',') AS examples FROM tf GROUP BY id, factor)
            JOIN (SELECT id, count(DISTINCT item) AS items FROM tf GROUP BY id) USING (id)""",
        ),
        "factor_pruning": sql(
            "tf",
            """SELECT id, factor, support FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY support DESC, factor) AS k, max(CASE WHEN share BETWEEN 5e-2 AND 5e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS anyin FROM (
            SELECT id, factor, support, round(support / items::DOUBLE, 6) AS share FROM (SELECT id, factor, count(*) AS support FROM tf GROUP BY id, factor)
            JOIN (SELECT id, count(DISTINCT item) AS items FROM tf GROUP BY id) USING (id))) WHERE share BETWEEN 5e-2 AND 5e-1 OR (anyin = 0 AND k <= 4)""",
        ),
        "completed_rankings": sql(
            "pool",
            """SELECT id, candidate_id, CAST(rank AS INT) AS rank, (n - rank + 1)::DOUBLE AS ranker_score FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n,
            row_number() OVER (PARTITION BY id ORDER BY CASE WHEN parent_a IS NULL THEN -pos END NULLS LAST, pos) AS rank FROM pool)""",
        ),
        "contrast_rows": sql(
            "hist",
            """, o AS (SELECT user_id, pos, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS n FROM hist),
            twice AS (SELECT user_id, pos, k FROM o UNION ALL SELECT user_id, pos, k + n FROM o),
            starts AS (SELECT *, coalesce(lag(user_id) OVER (ORDER BY k) <> user_id, true) AS s FROM twice),
            runs AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (ORDER BY k) AS r FROM starts),
            heads AS (SELECT r - 1 AS r, arg_min(pos, k) AS contrast FROM runs GROUP BY r)
            SELECT user_id, pos, contrast FROM runs LEFT JOIN heads USING (r) WHERE k < (SELECT count(*) FROM hist)""",
        ),
        "hash_sample": sql("hist", "SELECT id FROM hist ORDER BY sha256('5:' || id), id LIMIT 100"),
        "calibration_split": sql(
            "samp", "SELECT user_id, id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 1 THEN 'calibration' ELSE 'train' END AS part FROM samp"
        ),
        "changed_coverage": sql(
            "deltas pool",
            f"""SELECT id, candidate_id, round(CASE WHEN len(ch) = 0 THEN 1e0 ELSE len(list_intersect(ch, b)) / len(ch)::DOUBLE END, 6) AS coverage FROM (
            SELECT id, candidate_id, b, list_filter(list_distinct(list_concat(a, b)), lambda x: NOT (list_contains(a, x) AND list_contains(b, x))) AS ch FROM (
            SELECT d.id, d.candidate_id, {tok('p.text')} AS a, {tok('c.text')} AS b FROM deltas d JOIN pool c ON c.id = d.id AND c.candidate_id = d.candidate_id JOIN pool p ON p.id = d.id AND p.candidate_id = d.parent_id))""",
        ),
        "slate": sql(
            "pool",
            f"""SELECT id, type, CAST(pos AS INT) AS pos, text, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY pos) AS place FROM (
            SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY p, pos) AS n FROM (SELECT *, list_position(['profile_seed', 'task_seed', 'crossover', 'mutation'], type) AS p, array_to_string({tok('text')}, ' ') AS k FROM pool)
            WHERE p > 0 AND k <> '') WHERE n = 1) WHERE place <= CASE type WHEN 'profile_seed' THEN 2 WHEN 'mutation' THEN 3 ELSE 1 END""",
        ),
        "complementary_pair": sql("cp", "SELECT id, a_id, b_id, fresh, value FROM cp"),
        "pair_gate": sql(
            "cp",
            """SELECT id, a_id, b_id, array_to_string(list_filter([CASE WHEN value < 6e-1 THEN 'value' END, CASE WHEN fresh < 1 THEN 'fresh' END, CASE WHEN a_id = b_id THEN 'same' END], lambda x: x IS NOT NULL), ',') AS reasons FROM cp""",
        ),
        "corpus_rouge_ci": sql(
            "retr samp hist",
            f""", r AS (SELECT id AS k, round({rouge_1('a', 'b')}, 8) AS r1, round({rouge_l('a', 'b')}, 8) AS rl FROM (SELECT s.id, {tok('h.title')} AS a, {tok('s.target')} AS b FROM samp s
            LEFT JOIN (SELECT * FROM retr WHERE rank = 1) t ON t.id = s.id LEFT JOIN hist h ON h.user_id = t.user_id AND h.pos = t.pos)),
            m AS (SELECT b, round(sum(w * r1) / sum(w), 9) AS r1, round(sum(w * rl) / sum(w), 9) AS rl FROM (SELECT b, r1, rl, {drawn('13')} AS w FROM r, range(1000) t(b)) GROUP BY b HAVING sum(w) > 0)
            SELECT {', '.join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{name}" for c in ('r1', 'rl') for name, q in (('low', 0.025), ('mid', 0.5), ('high', 0.975)))} FROM m""",
        ),
        "head_soup": "SELECT CAST(place - 1 AS INT) AS place, round(avg(w), 6) AS weight FROM (SELECT unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding)::DOUBLE AS w FROM embeddings) GROUP BY place",
    }
    return {name: re.sub(r"\n\s+", "\n", text) for name, text in out.items()}
