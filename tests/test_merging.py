import json
import random

import pytest

from scriptorium.operators import merging as M

SCHEMA = "owner string, seq long, operation_type string, direction string, condition string, reason string, evidence_ids array<string>"


def fold(proposals, merger, limits):
    """The same merge by recursion on lists with whole evidence sets, an owner at a time."""

    def merge(items, chunk_size):
        if not items:
            return []

        def reduce(chunks):
            inner = [f for c in chunks for f in merge(c, 0)]
            return merge([{**f, "reason": M.INTERMEDIATE} for f in inner], 0)

        if chunk_size and len(items) > chunk_size:
            return reduce([items[k : k + chunk_size] for k in range(0, len(items), chunk_size)])
        runs, current = [], []
        for item in items:
            if current and limits.budget and len(json.dumps(M.shown([*current, item]), ensure_ascii=False)) > limits.budget:
                runs.append(current)
                current = [item]
            else:
                current = [*current, item]
        runs.append(current)
        if len(runs) > 1:
            return reduce(runs)
        for attempt in range(limits.retries + 1):
            try:
                answer = merger(f"merge_repair_{attempt}" if attempt else "merge", M.shown(items))
            except M.UnreadableAnswer:
                half = len(items) // 2
                return reduce([items[:half], items[half:]])
            own = {f"r{k + 1}": x["evidence"] for k, x in enumerate(items)}
            out = []
            for value in answer[: limits.max_factors]:
                direction, condition = value["direction"].strip(), value["condition"].strip()
                if len(direction.split()) < 4 <= len(condition.split()):
                    direction, condition = condition, M.GENERAL_CONDITION
                evidence = {e for a in value["members"] if a in own for e in own[a]}
                fits = value["operation_type"] in M.OPERATION_TYPES and direction and condition and len(evidence) >= limits.min_support
                if fits and value["operation_type"] not in {f["operation_type"] for f in out}:
                    out.append({"operation_type": value["operation_type"], "direction": direction, "condition": condition, "evidence": evidence})
            if out:
                return out
        return []

    result = {}
    for owner in sorted({p[0] for p in proposals}):
        own = sorted((p for p in proposals if p[0] == owner), key=lambda p: p[1])
        items = [{"operation_type": p[2], "direction": p[3], "condition": p[4], "reason": p[5], "evidence": set(p[6])} for p in own]
        for k, f in enumerate(merge(items, limits.chunk_size)):
            result[owner, f"f{k + 1}"] = (f["operation_type"], f["direction"], f["condition"], sorted(f["evidence"]))
    return result


def run(spark, proposals, merger, limits):
    factors, records = M.merge_with_records(spark.createDataFrame(proposals, SCHEMA).repartition(3), merger, limits)
    evidence = {}
    for r in records.collect():
        evidence.setdefault((r["owner"], r["factor_id"]), []).append(r["evidence_id"])
    out = {}
    for r in factors.collect():
        own = sorted(evidence[r["owner"], r["factor_id"]])
        assert len(own) == len(set(own)) == r["support_count"]
        out[r["owner"], r["factor_id"]] = (r["operation_type"], r["direction"], r["condition"], own)
    return out


def proposals_of(seed, owners=3, most=14):
    rng = random.Random(seed)
    out = []
    for owner in range(owners):
        for seq in range(rng.randint(1, most)):
            kind = rng.choice([*M.OPERATION_TYPES[:4], "unknown"])
            words = rng.choice(["remove", "name the main method first", f"keep {seq} words of it", ""])
            reason = "long" if rng.random() < 0.1 else "plain"
            out.append((f"u{owner}", seq * 3, kind, words, "if the abstract names a method", reason, [f"d{rng.randint(0, 30)}" for _ in range(rng.randint(1, 3))]))
    return out


def stubborn(mode, items):
    """Answers without sound factors at first, with too many and unknown members when asked again."""
    if len(items) % 3 == 1 and mode == "merge":
        return [{"operation_type": "nothing", "direction": "a", "condition": "b", "members": ["r1"]}]
    out = M.mock_merger(mode, [{**x, "reason": ""} for x in items])
    return [{**f, "members": [*f["members"], "r999"]} for f in out] + out[:1]


@pytest.mark.parametrize(
    ("seed", "merger", "limits"),
    [
        (1, M.mock_merger, M.Limits()),
        (2, M.mock_merger, M.Limits(chunk_size=5, min_support=2)),
        (3, M.mock_merger, M.Limits(budget=1500, max_factors=3)),
        (4, stubborn, M.Limits(chunk_size=10, budget=1500, min_support=3, retries=1)),
    ],
)
def test_equals_recursion(spark, seed, merger, limits):
    proposals = proposals_of(seed)
    expected = fold(proposals, merger, limits)
    assert run(spark, proposals, merger, limits) == expected and expected


def test_blocks_and_rounds(spark, monkeypatch):
    """Lists longer than a block are packed block by block; the rounds grow with the logarithm of the list."""
    monkeypatch.setattr(M, "BLOCK", 16)
    proposals = [("u", k, M.OPERATION_TYPES[k % 3], "name the main method first", "c", "plain", [f"d{k}"]) for k in range(120)]
    found = run(spark, proposals, M.mock_merger, M.Limits(budget=1200))
    assert {k: len(v[3]) for k, v in found.items()} == {("u", f"f{k}"): 40 for k in (1, 2, 3)}


def test_nothing_and_a_merger_that_does_not_shrink(spark, monkeypatch):
    assert run(spark, [], M.mock_merger, M.Limits()) == {}
    monkeypatch.setattr(M, "ROUNDS", 3)
    one = [("u", k, "structure", "d", "c", "r", ["e"]) for k in range(4)]
    with pytest.raises(ValueError, match="shrink"):
        run(spark, one, M.mock_merger, M.Limits(budget=10))
    with pytest.raises(Exception, match="cut off"):
        run(spark, [("u", 1, "structure", "d", "c", "long", ["e"])], always_cut, M.Limits())


def always_cut(mode, items):
    raise M.UnreadableAnswer("the answer was cut off")


def test_rounds_do_not_grow_with_halves_and_requests(spark, monkeypatch):
    """Unreadable answers and several requests of a list are settled within a round: one for chunks, one for their factors."""
    names = []
    write = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name: (names.append(name), write(df, name))[1])
    kinds = M.OPERATION_TYPES
    proposals = [("u", k, kinds[k % 6], "name the main method first", "c", "long" if k % 9 == 0 else "plain", [f"d{k}"]) for k in range(60)]
    found = run(spark, proposals, M.mock_merger, M.Limits(chunk_size=12, budget=1500))
    assert {k: len(v[3]) for k, v in found.items()} == {("u", f"f{k}"): 10 for k in range(1, 7)}
    assert names.count("calls") == 2 and len(names) <= 5
