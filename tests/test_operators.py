import difflib
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import rouge, similarity, text
from scriptorium.operators import cells, compilers, datasets, factors, heads, pools, preferences, profiles, ranking, retrieval, selection, validate
from scriptorium.plans import queries
from scriptorium.sources.tables import number_rows


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def f1(n, a, b):
    return 2 * n / (len(a) + len(b)) if n else 0.0


def test_rouge_against_plain_python(spark):
    r = random.Random(0)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 9))], [r.choice("abcd") for _ in range(r.randint(0, 9))]) for _ in range(60)]
    rows += [("a b c d".split(), "d c b a".split()), ([], []), (["a"], [])]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = frame.select("a", "b", rouge.rouge_1(F.col("a"), F.col("b")).alias("r1"), rouge.rouge_l(F.col("a"), F.col("b")).alias("rl")).collect()
    for g in got:
        common = sum(min(g["a"].count(x), g["b"].count(x)) for x in set(g["a"]))
        assert g["r1"] == pytest.approx(f1(common, g["a"], g["b"])) and g["rl"] == pytest.approx(f1(lcs(g["a"], g["b"]), g["a"], g["b"]))


def test_greedy_dedup_is_not_two_dedups(spark):
    rows = [("u", 1, "a1", "t1"), ("u", 2, "a1", "t2"), ("u", 3, "a2", "t1"), ("u", 4, "a2", "t2"), ("v", 5, "a1", "t1")]
    items = spark.createDataFrame(rows, "user_id string, pos long, abstract string, title string")
    assert {(r["user_id"], r["pos"]) for r in profiles.greedy_dedup(items).collect()} == {("u", 1), ("u", 4), ("v", 5)}
    folded = items.filter("user_id = 'u'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "abstract", "title"))).alias("p"))
    assert [x["pos"] for x in folded.select(profiles.greedy_dedup_array(F.col("p")).alias("k")).first()["k"]] == [1, 4]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=12))
def test_greedy_dedup_against_a_fold(spark, keys):
    rows = [("u", i, f"a{a}", f"t{t}") for i, (a, t) in enumerate(keys)]
    seen_a, seen_t, want = set(), set(), set()
    for i, (a, t) in enumerate(keys):
        if a not in seen_a and t not in seen_t:
            seen_a.add(a)
            seen_t.add(t)
            want.add(i)
    items = spark.createDataFrame(rows, "user_id string, pos long, abstract string, title string")
    assert {r["pos"] for r in profiles.greedy_dedup(items).collect()} == want


def test_bm25_counts_repeated_terms_and_fills_with_zeros(spark):
    items = spark.createDataFrame([("u", i, w.split()) for i, w in enumerate(["a b", "a a c", "d", "", "b a"])], "user_id string, pos long, words array<string>")
    queries = spark.createDataFrame([("q", "u", ["a", "a", "b", "z"])], "id string, user_id string, terms array<string>")
    got = retrieval.bm25(queries, items, 5).orderBy("rank").collect()
    docs = {r["pos"]: r["words"] for r in items.collect()}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)

    def score(words):
        total = 0.0
        for t in ["a", "a", "b", "z"]:
            df, tf = sum(t in w for w in docs.values()), words.count(t)
            if tf:
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / average))
        return round(total, 6)

    want = sorted(((-score(w), p) for p, w in docs.items()))
    assert [(r["pos"], r["score"]) for r in got] == [(p, pytest.approx(-s)) for s, p in want]


def test_leave_one_out_equals_recomputed_statistics(spark):
    r = random.Random(4)
    words = {i: [r.choice("abcdefg") for _ in range(r.randint(1, 8))] for i in range(7)}
    items = spark.createDataFrame([("u", i, w) for i, w in words.items()], "user_id string, pos long, words array<string>")
    got = {(x["held"], x["pos"]): x["score"] for x in retrieval.leave_one_out(items, F.col("words"), 99).collect()}
    for held, query in words.items():
        rest = {p: w for p, w in words.items() if p != held}
        average = sum(map(len, rest.values())) / len(rest)
        for p, w in rest.items():
            total = 0.0
            for t in query:
                df, tf = sum(t in x for x in rest.values()), w.count(t)
                if tf:
                    total += math.log(1 + (len(rest) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average))
            assert got.get((held, p), 0.0) == pytest.approx(round(total, 6), abs=2e-6)


def test_loo_query_searches_whole_abstracts_of_unique_items(spark):
    r = random.Random(8)
    texts = [[r.choice("abcdefghij") + str(r.randint(0, 3)) for _ in range(r.randint(10, 30))] for _ in range(11)]
    texts += [texts[0], texts[1][:8] + ["other"] * 4, ["z1"] * 8 + ["z2"], ["short"] * 8, []]
    rows = [("u", i, str(i), " ".join(w[:8]), " ".join(w[8:]), w) for i, w in enumerate(texts)]
    rows += [("small", 100 + i, str(i), f"t{i}", f"a{i}", [f"t{i}", f"a{i}"]) for i in range(9)]
    items = spark.createDataFrame(rows, "user_id string, pos long, id string, title string, abstract string, words array<string>")
    got = {}
    for x in queries.loo_bm25(SimpleNamespace(items=items)).collect():
        got.setdefault(x["held"], []).append((x["rank"], x["pos"], x["score"]))
    kept = {i: texts[i] for i in (*range(11), 13)}
    assert set(got) == set(kept)
    for held, words in kept.items():
        rest = {p: w for p, w in kept.items() if p != held}
        average = sum(map(len, rest.values())) / len(rest)
        want = []
        for p, w in rest.items():
            total = 0.0
            for t in words[8:]:
                df, tf = sum(t in x for x in rest.values()), w.count(t)
                if tf:
                    total += math.log(1 + (len(rest) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average))
            want.append((-round(total, 6), p))
        for (rank, p, score), (k, (s, q)) in zip(sorted(got[held]), enumerate(sorted(want)[:8], 1), strict=True):
            assert (rank, p) == (k, q) and score == pytest.approx(-s, abs=2e-6)
    assert [x[1:] for x in sorted(got[13])] == [(i, 0.0) for i in range(8)]


def test_visible_history_slices_before_it_drops(spark):
    retrieved = spark.createDataFrame([("q", "u", i, i, 1.0) for i in (1, 2, 3)], "id string, user_id string, pos long, rank int, score double")
    queries = spark.createDataFrame([("q", "u", "The Target")], "id string, user_id string, target string")
    items = spark.createDataFrame([("u", 1, "the-target", "x"), ("u", 2, "ok", "y"), ("u", 3, "late", "z")], "user_id string, pos long, title string, abstract string")
    assert [r["item"] for r in profiles.visible_history(retrieved, queries, items, 2).collect()] == [2]


def test_preferences_compare_ids_as_strings(spark):
    rewards = spark.createDataFrame([("a", "r2", 0.5), ("a", "r10", 0.5), ("b", "r0", 0.1), ("b", "r1", 0.9), ("c", "r0", 1.0)], "rollout_id string, response_id string, reward double")
    got = {r["rollout_id"]: r for r in preferences.gold_preferences(rewards).collect()}
    assert (got["a"]["chosen_id"], got["a"]["rejected_id"], got["a"]["status"]) == ("r2", "r10", "low_margin")
    assert got["b"]["status"] == "accepted" and got["c"]["status"] == "insufficient_responses"


def test_rewards_read_whole_texts(spark):
    r = random.Random(6)
    draw = lambda n: [r.choice("abcdef") for _ in range(n)]
    target = draw(90)
    texts = {"r0": target[:32] + ["x"] * 50, "r1": target, "r2": [], **{f"r{k}": draw(r.randint(1, 150)) for k in range(3, 20)}}
    rows = [("a", k, " ".join(v), " ".join(target)) for k, v in texts.items()] + [("b", "r0", "x", None), ("b", "r1", None, "x")]
    frame = spark.createDataFrame(rows, "rollout_id string, response_id string, output string, target string")
    rewards = preferences.reward_rollouts(frame)
    got = {(x["rollout_id"], x["response_id"]): x["reward"] for x in rewards.collect()}
    assert got["b", "r0"] == got["b", "r1"] == 0
    for k, v in texts.items():
        assert got["a", k] == pytest.approx(2 * lcs(v, target) / (len(v) + len(target)), abs=1e-8)
    first = {x["rollout_id"]: x for x in preferences.gold_preferences(rewards).collect()}["a"]
    assert first["chosen_id"] == "r1" and first["chosen_reward"] == 1


def test_dpo_loss_is_ln_2_where_policy_is_reference(spark):
    x = F.lit(-3.0)
    assert spark.range(1).select(preferences.dpo_loss(x, x, x, x)).first()[0] == pytest.approx(math.log(2))


def test_head_and_tail(spark):
    a = F.array(*map(F.lit, range(20)))
    row = spark.range(1).select(text.head_tail(a, 8).alias("x"), text.head_tail(a, 1).alias("y"), text.head_tail(a, 20).alias("z")).first()
    assert row["x"] == [0, 1, 2, 3, 16, 17, 18, 19] and row["y"] == [0] and row["z"] == list(range(20))


def test_titles_and_spans(spark):
    rows = [('```title\nTitle: "A b"\n```', "A b"), ("output: \n\n x", "x"), (None, ""), ("  ", ""), ("y" * 400, "y" * 300)]
    got = spark.createDataFrame(rows, "t string, e string").select(text.clean_title("t").alias("g"), "e").collect()
    assert all(r["g"] == r["e"] for r in got)
    head, tail = datasets.response_spans(F.lit('why "so"'), F.lit("é\n"))
    row = spark.range(1).select(head.alias("h"), tail.alias("t")).first()
    import json

    assert json.loads(row["h"] + row["t"]) == {"trace": 'why "so"', "output": "é\n"}
    weights = spark.range(1).select(text.span_weights(F.lit(2), F.lit(4), F.lit(3), 0.2, 1.0).alias("w")).first()["w"]
    assert sum(weights) == pytest.approx(1.2) and weights[:3] == [0, 0, 0] and len(weights) == 9


def scores(spark, groups):
    rows = [(g, f"c{i}", i, float(s), float(l)) for g, pairs in groups.items() for i, (s, l) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id string, candidate_id string, pos int, score double, label double")


def test_ranking_metrics_with_ties(spark):
    frame = scores(spark, {"a": [(3, 0), (2, 1), (2, 1), (1, 0.5)], "zero": [(1, 0), (2, 0)], "flat": [(1, 0.2), (1, 0.7)]})
    m = {r["id"]: r for r in ranking.hit_mrr_ndcg(frame).collect()}
    assert (m["a"]["first_rank"], m["a"]["hit_1"], m["a"]["hit_3"], m["a"]["reciprocal_rank"]) == (2, 0, 1, 0.5) and m["zero"]["ndcg_10"] == 0
    c = {r["id"]: r for r in ranking.rank_correlations(frame).collect()}
    assert c["flat"]["pearson"] is None and c["flat"]["kendall"] is None and c["zero"]["spearman"] is None
    conc, disc, ts, tl = 2, 3, 0, 0
    pairs = [(i, j) for i in range(4) for j in range(i)]
    s, l = [3, 2, 2, 1], [0, 1, 1, 0.5]
    conc = sum((s[i] - s[j]) * (l[i] - l[j]) > 0 for i, j in pairs)
    disc = sum((s[i] - s[j]) * (l[i] - l[j]) < 0 for i, j in pairs)
    assert c["a"]["kendall"] == pytest.approx((conc - disc) / math.sqrt((conc + disc + ts) * (conc + disc + tl)), abs=1e-6)
    p = {r["id"]: r for r in ranking.pair_accuracy(frame).collect()}
    assert (p["flat"]["pairs"], p["flat"]["correct"]) == (1, 0)


def test_objectives_reward_the_gold_order(spark):
    good = {r["id"]: r for r in ranking.losses(scores(spark, {"g": [(4, 1), (0, 0.4), (-1, 0.1)], "b": [(-1, 1), (0, 0.4), (4, 0.1)]})).collect()}
    assert all(good["g"][k] < good["b"][k] for k in ("listmle", "expected_regret", "oracle_set", "top1_lambda"))


def test_splits_are_disjoint_and_sized(spark):
    rows = spark.range(100).select(F.lit("u").alias("user_id"), F.col("id").cast("string").alias("id"))
    got = {r["split"]: r["n"] for r in profiles.user_split(rows, 0.2, "s").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 80, "validation": 20}


def test_similarity_functions(spark):
    a, b = "the deep study of trees".split(), "a study of deep trees".split()
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(similarity.sequence_ratio("a", "b").alias("r"), similarity.grounded(F.array(F.lit("deep"), F.lit("study")), F.col("a"), F.lit(0.9)).alias("g")).first()
    assert row["r"] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio()) and row["g"]
    words = spark.createDataFrame([("modelling", "modelled"), ("tree", "trees"), ("network", "networks"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in words.select(similarity.same_family(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]
    titles = spark.createDataFrame([('["x","y"]',), ('{"titles":["z"]}',), ('{"output":"w"}',), ("{}",)], "p string")
    assert [r[0] for r in titles.select(similarity.title_list(F.col("p"))).collect()] == [["x", "y"], ["z"], ["w"], []]


def test_factor_operators(spark):
    rows = [("s", i, f) for f, items in {"wide": [1, 2, 3, 4], "mid": [3, 4], "rest": [5, 6], "same": [1, 2]}.items() for i in items]
    matrix = spark.createDataFrame([(a, str(b), c) for a, b, c in rows], "id string, feature string, factor string")
    picked = [r["factor"] for r in factors.greedy_cover(matrix).orderBy("step").collect()]
    assert picked[:2] == ["wide", "rest"] and len(picked) == 2
    stats = factors.factor_statistics(spark.createDataFrame([(*r, 3) for r in rows], "id string, item int, factor string, title_tokens int"))
    assert {r["factor"]: (r["support"], r["examples"]) for r in stats.collect()}["wide"] == (4, "1,2,3")
    assert {r["factor"] for r in factors.prune(stats, 0.4, 0.9).collect()} == {"wide"}
    assert factors.prune(stats, 0.99, 1.0, 2).count() == 2
    cited = spark.createDataFrame([("s", "h1"), ("s", "h12"), ("s", "h99"), ("s", "zzz")], "id string, cited string")
    valid = spark.createDataFrame([("s", "h1"), ("s", "h123"), ("s", "h9")], "id string, item string")
    assert {r["cited"]: r["repaired"] for r in factors.repair_ids(cited, valid).collect()} == {"h1": "h1", "h12": None, "h99": "h9", "zzz": None}
    chosen = spark.createDataFrame([("s", f"f{i}", "style" if i > 2 else "content", float(9 - i)) for i in range(5)], "id string, factor string, type string, quality double")
    assert {r["factor"] for r in factors.quota_selection(chosen, 3, 2).collect()} == {"f3", "f4", "f0"}


def test_validators(spark):
    seen = F.array(F.lit("h1"), F.lit("h2"))
    rows = {
        "ok": validate.mutation_errors(F.lit("mutation"), F.lit("A title"), F.array(F.lit("h1")), seen),
        "bad": validate.mutation_errors(F.lit("edit"), F.lit(" none "), F.array(F.lit("h3")), seen),
        "leak": validate.trace_errors(F.lit("so that it reads Deep-Trees"), F.lit("x"), F.array(F.lit("h1")), seen, F.lit("deep trees")),
        "judge": validate.judge_errors(F.lit("prefer_a"), F.lit(0.5)),
        "rank": validate.ranking_errors(F.array(F.lit("a"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))),
        "whole": validate.operation_errors(F.lit("Deep trees"), F.lit("old"), F.lit("deep trees"), F.array(F.lit("h1")), seen, F.lit(True)),
    }
    got = spark.range(1).select(*(v.alias(k) for k, v in rows.items())).first().asDict()
    assert got == {"ok": [], "bad": ["operation", "placeholder", "evidence"], "leak": ["leak"], "judge": ["unsure"], "rank": ["repeated", "missing"], "whole": ["whole", "support"]}
    with pytest.raises(Exception, match="invalid row: operation"):
        validate.strict(spark.range(1), rows["bad"]).collect()
    ranked = spark.createDataFrame([("q", 0, "c"), ("q", 1, "zz"), ("q", 2, "c")], "id string, place int, candidate_id string")
    candidates = spark.createDataFrame([("q", i, c) for i, c in enumerate("abc")], "id string, pos int, candidate_id string")
    done = validate.complete_ranking(ranked, candidates).orderBy("rank").collect()
    assert [(r["candidate_id"], r["ranker_score"]) for r in done] == [("c", 3.0), ("a", 2.0), ("b", 1.0)]


def test_pooling_of_masked_vectors(spark):
    pooled = spark.range(1).select(heads.masked_mean(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("m")).first()["m"]
    assert pooled == [2.0, 4.0]


def test_no_target_in_model_visible_columns(spark):
    queries = spark.createDataFrame([("q", "u", "some source text of a paper", "some source text of a paper".split(), "secretword")], "id string, user_id string, source_text string, source array<string>, target string")
    items = spark.createDataFrame([("u", 1, "first title here", "x")], "user_id string, pos long, title string, abstract string")
    retrieved = spark.createDataFrame([("q", "u", 1, 1, 1.0)], "id string, user_id string, pos long, rank int, score double")
    pool = pools.candidate_pool(queries, retrieved, items)
    assert "secretword" not in str(pool.collect()) and "target" not in pool.columns


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14))
def test_contrast_is_the_next_row_of_another_user(spark, users):
    n = len(users)
    want = {i: next((j % n for j in range(i + 1, i + n) if users[j % n] != users[i]), None) for i in range(n)}
    rows = spark.createDataFrame(list(enumerate(users)), "k long, u string")
    assert {r["k"]: r["contrast"] for r in profiles.contrast_rows(rows, "u", "k").collect()} == want


def test_row_numbers(spark):
    rows = spark.range(0, 200, 3).repartition(7)
    assert sorted((r["id"], r["number"]) for r in number_rows(rows, "id").collect()) == [(i, k) for k, i in enumerate(range(0, 200, 3))]
    assert number_rows(rows.limit(0), "id").count() == 0


def test_coverage_slates_and_pairs(spark):
    rows = [("a b", "a c", "b and c", 1.0), ("a b", "a c", "b", 0.5), ("a", "A", "", 1.0), ("a", "b", "", 0.0)]
    frame = spark.createDataFrame(rows, "p string, g string, t string, e double")
    assert all(r[0] == r[1] for r in frame.select(selection.changed_coverage(F.col("p"), F.col("g"), F.col("t")), "e").collect())
    pool = spark.createDataFrame([("q", "x", 0, "One"), ("q", "y", 1, "one!"), ("q", "y", 2, "two"), ("q", "x", 3, "three"), ("q", "z", 4, "four")], "id string, type string, pos int, text string")
    assert {r["text"] for r in selection.slate(pool, {"y": 1, "x": 5}).collect()} == {"one!", "three"}
    candidates = spark.createDataFrame([("q", 0, "a", "deep trees"), ("q", 1, "b", "deep trees grow"), ("q", 2, "c", "deep forests grow fast")], "id string, pos int, candidate_id string, text string")
    queries = spark.createDataFrame([("q", "forests of deep trees grow fast")], "id string, source_text string")
    pair = selection.complementary_pair(candidates, queries).first()
    assert (pair["a_id"], pair["b_id"], pair["fresh"]) == ("a", "c", 3)
    gate = selection.pair_gate(spark.createDataFrame([("q", "a", "a", 0, 0.1)], "id string, a_id string, b_id string, fresh long, value double"))
    assert gate.first()["reasons"] == "value,fresh,same"
    context = spark.range(1).select(selection.context_text("provenance_aware", F.lit("s"), F.lit("t"), F.lit("f")), selection.context_text("candidate_only", F.lit("s"), F.lit("t"), F.lit("f"))).first()
    assert tuple(context) == ("s\nt\nf", "")
    with pytest.raises(ValueError):
        selection.context_text("other", F.lit(""), F.lit(""), F.lit(""))


def test_cells_of_any_size_find_the_same(spark, monkeypatch):
    from scriptorium.operators import cells

    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    items = spark.createDataFrame(
        [(r.choice("uv"), i, [word() for _ in range(r.randint(0, 12))], " ".join(word() for _ in range(3))) for i in range(90)],
        "user_id string, pos long, words array<string>, title string",
    )
    asked = [(f"q{i}", r.choice("uv"), [word() for _ in range(5)], " ".join(word() for _ in range(4)), " ".join(word() for _ in range(3))) for i in range(40)]
    queries_ = spark.createDataFrame(asked, "id string, user_id string, terms array<string>, source_text string, target string")
    runs = {
        "bm25": lambda: retrieval.bm25(queries_, items, 5).select("id", "pos", "rank", "score"),
        "jaccard": lambda: retrieval.jaccard_rank(queries_, items, 5),
        "negatives": lambda: retrieval.content_negatives(queries_, items).select("id", "pos", "rank", "score"),
    }
    whole = {n: sorted(tuple(x) for x in f().collect()) for n, f in runs.items()}
    for name, value in {"QUERIES": 7, "WEIGHT": 60, "ROWS": 3, "COLUMNS": 4, "DENSE": 6, "SLAB": 2}.items():
        monkeypatch.setattr(cells, name, value)
    monkeypatch.setattr(retrieval, "ROWS", 3)
    monkeypatch.setattr(retrieval, "COLUMNS", 4)
    monkeypatch.setattr(cells.best_in_cells, "__defaults__", (11,))
    assert {n: sorted(tuple(x) for x in f().collect()) for n, f in runs.items()} == whole
    plan = runs["bm25"]()._jdf.queryExecution().optimizedPlan().toString()
    assert "tf" not in plan  # no row for a term of an item


def test_micros_round_like_spark(spark):
    from scriptorium.operators.cells import micros

    r = random.Random(5)
    values = [r.uniform(-20, 20) for _ in range(200)] + [k / 2e6 for k in range(-40, 41)] + [1.0000005, 2.0000015, 1 / 3, -0.0000005, 123.4567895]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert (micros(np.array(values)) / 1e6).tolist() == [g + 0.0 for g in got]


def test_dense_search_with_odd_vectors_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(30, None), (31, [1.0]), (32, [None, 1.0]), (33, [float("nan"), 1.0]), (34, [float("inf"), 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asking = spark.createDataFrame([(1, [1.0, 0.25]), (2, [0.0, 1.0]), (3, [2.0])], "query_id long, query array<double>")
    dot = F.aggregate(F.zip_with("embedding", "query", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    every = vectors.crossJoin(asking).select(F.col("query_id").alias("id"), F.col("vec_id").alias("pos"), F.round(dot, 6).alias("score"))
    plain = lambda d: sorted(str(tuple(x)) for x in d.select("id", "pos", "rank", "score").collect())
    assert plain(retrieval.dense_top(vectors, asking, 4)) == plain(retrieval.best(every, 4))


def test_only_terms_that_are_asked_for_are_counted(spark):
    rows = spark.range(5000).select((F.col("id") % 2).cast("string").alias("user_id"), F.concat(F.lit("t"), "id").alias("term"), "id")
    asked = spark.createDataFrame([("0", "t0"), ("0", "t10"), ("1", "t10"), ("1", "t7"), ("1", "t7"), (None, "t3"), ("1", None)], "user_id string, term string")
    kept = {r["id"] for r in retrieval.among(rows, asked, "user_id", "term").collect()}
    assert kept >= {0, 7, 10} and len(kept) < 13  # bits that two keys share let others through
    assert retrieval.among(rows, asked.limit(0), "user_id", "term").count() == 0
    assert retrieval.among(rows, rows, "user_id", "term").count() == 5000


def test_terms_and_queries_without_partners_change_no_rank(spark, monkeypatch):
    items = [("u", k, [f"rare{k}", "common", f"word{k % 3}"]) for k in range(30)] + [("v", 99, ["common"])]
    items_ = spark.createDataFrame(items, "user_id string, pos long, words array<string>")
    asking = spark.createDataFrame([("a", "u", ["word1", "rare7", "nowhere"]), ("b", "v", ["rare7", "common"]), ("c", "w", ["common"])], "id string, user_id string, terms array<string>")
    found = []
    for bits in (24, 6):  # with 64 bits nearly every term is let through
        monkeypatch.setattr(retrieval, "BITS", bits)
        found.append(sorted(tuple(r) for r in retrieval.bm25(asking, items_, 4).select("id", "rank", "pos", "score").collect()))
    assert found[0] == found[1] and [r[2] for r in found[0] if r[0] == "a"] == [7, 1, 4, 10] and [r[:3] for r in found[0] if r[0] == "b"] == [("b", 1, 99)]


def test_abstracts_are_cut_before_they_are_exchanged(spark):
    items = spark.createDataFrame([("u", 1, "a title", "x" * 900)], "user_id string, pos long, title string, abstract string")
    asking = spark.createDataFrame([("a", "gone")], "id string, target string")
    retrieved = spark.createDataFrame([("a", "u", 1, 1)], "id string, user_id string, pos long, rank int")
    shown = profiles.visible_history(retrieved, asking, items, 2)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "abstract" in plan and "abstract" not in plan[: plan.rindex("Join")]  # named only below the last join
    assert shown.first()["input"] == "x" * 500


def test_words_that_nobody_asks_for_are_not_sent(spark, monkeypatch):
    words = lambda k: [f"rare{k}x{i}" for i in range(400)] + ["common", "common", f"word{k % 3}", None]
    items = [("u", k, words(k)) for k in range(40)] + [("u", 40, []), ("u", 41, None), ("v", 42, ["common", "word1"]), (None, 43, ["common"]), ("u", None, ["word1"]), ("w", 44, words(44))]
    items_ = spark.createDataFrame(items, "user_id string, pos long, words array<string>")
    asking = spark.createDataFrame([("a", "u", ["word1", "common", "word1"]), ("b", "v", ["word2", "common"]), ("c", "x", ["common"])], "id string, user_id string, terms array<string>")
    sent, cells = [], retrieval.best_in_cells

    def weighed(queries, items, *rest):
        sent.append(items.select(F.count("*"), F.sum(F.length(F.to_json(F.struct(*items.columns))))).first())
        return cells(queries, items, *rest)

    monkeypatch.setattr(retrieval, "best_in_cells", weighed)
    found = sorted(tuple(r) for r in retrieval.bm25(asking, items_, 4).select("id", "rank", "pos", "score").collect())
    assert sent[0][0] < 45 and sent[0][1] < 45 * 200  # 400 words of an item are over 2,000 letters
    assert [r[1:3] for r in found if r[0] == "a"] == [(1, 1), (2, 4), (3, 7), (4, 10)] and [r[:3] for r in found if r[0] == "b"] == [("b", 1, 42)]
    held = {r["pos"]: r for r in retrieval.asked_words(items_, asking.select("user_id", F.explode("terms").alias("term"))).collect()}
    assert dict(zip(held[5]["terms"], held[5]["times"], strict=True)) == {"common": 2} and held[5]["len"] == 404
    assert len(held) == len(items) and held[44]["terms"] == [] and held[44]["len"] == 404


def test_packed_numbers_are_found_again():
    from scriptorium.operators.cells import packed, steps, sums_of, unpacked

    r = random.Random(9)
    sets = [sorted(r.sample(range(1 << r.choice((4, 9, 20, 40))), r.randint(0, 12))) for _ in range(60)] + [[0], [], [127, 128, 16383, 16384]]
    row, values = (np.array(x, dtype=np.int64) for x in zip(*((k, v) for k, s in enumerate(sets) for v in s), strict=True))
    made = packed(row, steps(row, values), len(sets))
    at, step = unpacked(made)
    assert at.tolist() == row.tolist() and sums_of(at, step).tolist() == values.tolist()
    at, step = unpacked(made.slice(20, 30))  # a part of an array
    assert sums_of(at, step).tolist() == [v for s in sets[20:50] for v in s]
    assert len(made[len(sets) - 3].as_py()) == 1 and not len(unpacked(packed(row[:0], row[:0], 3))[0])


def test_asked_words_travel_as_numbers(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: f"aratherlongword{r.randint(0, 150)}"
    items = [(r.choice(["u", "v", None]), k, [word() for _ in range(r.randint(0, 60))]) for k in range(120)] + [("u", 120, None), ("u", 121, [None, "aratherlongword1"])]
    items_ = spark.createDataFrame(items, "user_id string, pos long, words array<string>")
    asking = spark.createDataFrame([(f"q{k}", r.choice("uvw"), [word() for _ in range(30)]) for k in range(20)], "id string, user_id string, terms array<string>")
    sent, cells = [], retrieval.best_in_cells

    def weighed(queries, items, *rest):
        sent.append(items.select(F.sum(F.size("terms")), F.sum(F.octet_length("codes") + F.octet_length("counts"))).first())
        return cells(queries, items, *rest)

    monkeypatch.setattr(retrieval, "best_in_cells", weighed)
    found = []
    for words, span, held in ((1 << 19, 1 << 14, 2_000_000), (1 << 19, 8, 10), (40, 8, 10), (0, 8, 10)):  # all words, some, none have numbers
        for name, value in {"WORDS": words, "SPAN": span, "HELD": held}.items():
            monkeypatch.setattr(retrieval, name, value)
        found.append(sorted(tuple(x) for x in retrieval.bm25(asking, items_, 5).select("id", "user_id", "pos", "rank", "score").collect()))
    assert found[0] and all(f == found[0] for f in found)
    assert sent[0][0] == 0 and sent[0][1] < 3 * sent[3][0] and sent[3][1] == 0 and 0 < sent[2][0] < sent[3][0]
    # document frequencies, one by one
    wanted = asking.select("user_id", F.explode("terms").alias("term"))
    monkeypatch.setattr(retrieval, "WORDS", 40)
    known = retrieval.most_asked(wanted)
    df = {(x["user_id"], x["term"]): x["df"] for x in retrieval.holders(retrieval.asked_words(items_, wanted, known), known).collect()}
    asked = {tuple(x) for x in wanted.collect()}
    assert len(known) == 40 and {k: v for k, v in df.items() if k in asked} == {
        (u, t): n for u, t in asked if (n := sum(x[0] == u and x[2] is not None and t in x[2] for x in items))
    }


def test_leave_one_out_in_bands_and_blocks(spark, monkeypatch):
    """The best of each item where averages differ much, texts repeat and cells have several blocks: as all pairs in turn; pairs are scored in cells."""
    r = random.Random(11)
    sizes = [r.randint(1, 12) for _ in range(40)] + [400, 900]
    words = {("u:1" if i % 3 else "v", i): [r.choice("abcdefgh") + str(int(r.random() ** 3 * 9)) for _ in range(n)] for i, n in enumerate(sizes)}
    words |= {("u:1", 100 + i): words["u:1", 4] for i in range(12)} | {("v", 200): [], ("v", 201): ["only"]}
    items = spark.createDataFrame([(u, i, w) for (u, i), w in words.items()], "user_id string, pos long, words array<string>")
    monkeypatch.setattr(cells, "QUERIES", 16)
    monkeypatch.setattr(cells, "WEIGHT", 150)
    scored = []
    monkeypatch.setattr(retrieval, "best_in_cells", lambda *a, **k: (scored.append(a), cells.best_in_cells(*a, **k))[1])
    found = retrieval.leave_one_out(items, F.slice("words", 2, 1000), 5)
    got = {}
    for x in found.collect():
        got.setdefault((x["user_id"], x["held"]), []).append((x["rank"], x["pos"], x["score"]))
    assert set(got) == set(words) and len(scored) == 1
    for (user, held), own in words.items():
        rest = {p: w for (u, p), w in words.items() if u == user and p != held}
        average = sum(map(len, rest.values())) / len(rest)
        want = []
        for p, w in rest.items():
            total = 0.0
            for t in own[1:]:
                df, tf = sum(t in y for y in rest.values()), w.count(t)
                if tf:
                    total += math.log(1 + (len(rest) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average))
            want.append((-round(total, 6), p))
        for (rank, p, score), (k, (s, q)) in zip(sorted(got[user, held]), enumerate(sorted(want)[:5], 1), strict=True):
            assert (rank, p) == (k, q) and score == pytest.approx(-s, abs=2e-6)


def test_case_selections_evaluate_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def value(k):
        seen.add(1)
        return k * 7 % 20 / 10

    rows = spark.range(20).select(F.col("id"), F.udf(value, "double")("id").alias("v"))
    got = compilers.case_selections(rows, "v", "id", 2).collect()
    order = sorted(range(20), key=lambda k: (k * 7 % 20, k))
    want = {("bottom", 1): order[0], ("bottom", 2): order[1], ("middle", 1): order[9], ("middle", 2): order[10], ("top", 1): order[18], ("top", 2): order[19]}
    assert {(r["part"], r["place"]): r["id"] for r in got} == want and seen.value == 20


def test_warmup_negatives_of_the_profile_are_found_in_cells(spark, monkeypatch):
    """Titles of one key cut into other tokens by hyphens, copies, and the target itself, for several queries of a user."""
    scored = []
    monkeypatch.setattr(compilers, "best_in_cells", lambda *a, **k: (scored.append(a), cells.best_in_cells(*a, **k))[1], raising=False)
    titles = ["Deep-net maps", "deep net maps", "deep net maps", "graph maps", "Deep, net", "the-target maps", "maps", "", "zz yy"]
    items = spark.createDataFrame([("u", k, x) for k, x in enumerate(titles)] + [("v", 50, "deep net")], "user_id string, pos long, title string")
    asked = [("a", "deep net graph"), ("b", "deep-net"), ("c", "nothing here"), ("d", "maps zz")]
    samples = spark.createDataFrame([(i, "u", x, "The target maps") for i, x in asked], "id string, user_id string, source_text string, target string")
    none = spark.createDataFrame([], "id string, rank int, title string")
    got = {}
    for r in compilers.warmup_groups(samples, items, none).filter("type = 'profile_negative'").collect():
        got.setdefault(r["id"], []).append((r["place"], r["text"]))
    cut = lambda x: {t for t in re.findall("[a-z0-9]+(?:-[a-z0-9]+)?", x.lower()) if len(t) > 1 and t not in text.TITLE_STOP_WORDS}
    key = lambda x: " ".join(re.findall("[a-z0-9]+", x.lower()))
    for i, source in asked:
        keyed = {}
        for k, x in enumerate(titles):
            if key(x) not in ("", "the target maps"):
                s = round(len(cut(source) & cut(x)) / max(len(cut(source) | cut(x)), 1), 6)
                keyed[key(x)] = min(keyed.get(key(x), (9, 9, "")), (-s, k, x))
        assert sorted(got[i]) == [(n, x) for n, (_, _, x) in enumerate(sorted(keyed.values())[:2], 1)]
    assert len(scored) == 1
