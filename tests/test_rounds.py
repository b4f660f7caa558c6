import json
from collections import Counter

import pytest

from scriptorium.sources import rounds as R

SCHEMA = "id string, task string, prompt string"


def numbers(spark, n, extra=()):
    return spark.createDataFrame([(f"c{k}", "t", f"{k} text") for k in range(n)] + list(extra), SCHEMA)


def endpoints():
    return [R.Endpoint("primary", R.faulty_primary), R.Endpoint("fallback", R.faulty_fallback)]


def answers(frame):
    return {r["id"]: (r["status"], r["endpoint"], r["attempts"], r["value"]) for r in frame.collect()}


def test_a_run_that_was_stopped_ends_like_one_that_was_not(spark, tmp_path):
    policy = R.Policy(unreadable=3, cooldown=10)
    requests = numbers(spark, 120, [("again", "t", "7 text")])
    whole = answers(R.ask_in_rounds(requests, endpoints(), f"{tmp_path}/a", policy))
    assert whole["again"] == whole["c7"] and whole["c0"][0] == "unreadable" and whole["c0"][2] == 4
    assert whole["c5"] == ("answered", "fallback", 2, '{"output":"5 again"}')

    stopped = f"{tmp_path}/b"
    with pytest.raises(R.RequestsFailed):
        R.ask_in_rounds(requests, endpoints(), stopped, R.Policy(unreadable=1, cooldown=10, fail_fast=True))
    first = R.rounds_of(spark, stopped)
    assert first == [0]
    (tmp_path / "b" / "round=1").mkdir()  # a round that was not committed
    assert answers(R.ask_in_rounds(requests, endpoints(), stopped, policy)) == whole
    once = Counter(r["key"] for r in R.read_log(spark, stopped).collect() if r["outcome"] == "answered")
    assert set(once.values()) == {1} and len(once) == 120 - 4
    more = answers(R.ask_in_rounds(numbers(spark, 125), endpoints(), stopped, policy))
    assert {k: v for k, v in more.items() if k in whole} == {k: v for k, v in whole.items() if k != "again"} and len(more) == 125
    assert sum(1 for r in R.read_log(spark, stopped).collect() if json.loads(r["value"] or "{}").get("output") == "7") == 1


def down(prompt):
    raise TimeoutError("too slow")


def test_no_endpoint_serves(spark, tmp_path):
    found = answers(R.ask_in_rounds(numbers(spark, 3, [("null", "t", None)]), [R.Endpoint("only", down)], f"{tmp_path}/a", R.Policy(failures=2)))
    assert set(found.values()) == {("failed", "only", 2, None)} and len(found) == 4
    assert answers(R.ask_in_rounds(numbers(spark, 0), endpoints(), f"{tmp_path}/none")) == {}


def test_the_circuit_opens_probes_and_closes():
    policy = R.Policy(trip=0.1, cooldown=2)
    history = [(0, "p", 100, 50), (1, "f", 50, 0), (2, "f", 10, 0), (3, "p", 2, 1), (4, "f", 5, 0), (5, "f", 5, 0), (6, "p", 2, 0)]
    states = R.closed_until(history, "p", policy)
    assert [states[k] for k in range(8)] == ["closed", "open", "open", "probing", "open", "open", "probing", "closed"]
    assert R.closed_until([(0, "p", 100, 10)], "p", policy)[1] == "closed"


def test_probes_are_a_share_of_the_keys(spark):
    todo = spark.range(2000).selectExpr("CAST(id AS STRING) AS key", "0 AS attempts")
    for circuit, low, high in (("closed", 2000, 2000), ("open", 0, 0), ("probing", 60, 200)):
        routed = R.route(todo, endpoints(), [circuit, "closed"], R.Policy())
        assert low <= routed.filter("endpoint = 'primary'").count() <= high
