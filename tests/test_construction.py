import hashlib
import random
from pathlib import Path

import pytest

from scriptorium.operators import construction as C
from scriptorium.plans import queries

SCHEMA = "id string, place long, feature string"


def restated(sample, features, propose, assign, s, seed="42"):
    """One sample by itself, with whole matrices: a row for each feature, a column for each factor."""
    rows = [f for _, f in features]
    factors, matrix, memory, selected, chosen_rows = [], [[] for _ in rows], [], [], [[] for _ in rows]
    uncovered, overlap = [True] * len(rows), s.overlap
    for iteration in range(s.rounds):
        left = sum(uncovered)
        if 1.0 - left / len(rows) >= s.threshold:
            break
        if iteration and left > 0.3 * len(rows):
            overlap *= 0.5
        focus = [(p, f) for (p, f), u in zip(features, uncovered, strict=True) if u]
        if iteration:
            focus.sort(key=lambda x: hashlib.sha256(f"{seed}:{sample}:{iteration}:{x[0]}".encode()).hexdigest())
        shown = [f for _, f in focus[: s.shown]]
        new = []
        for attempt in range(3 if iteration and left > 10 else 1):
            new = [f for f in dict.fromkeys(propose(sample, shown, factors, left, attempt)) if f not in factors]
            if new:
                break
        if not new:
            continue
        for row, f in zip(matrix, rows, strict=True):
            k = assign(f, new)
            row.extend(int(i == k) for i in range(len(new)))
        factors = factors + new
        d, n = len(factors), len(rows)
        total = [sum(row[c] for row in matrix) for c in range(d)]
        low = 1 if iteration else max(1, int(n * s.least))
        keep = [c for c in range(d) if low <= total[c] <= int(n * s.most)]
        if iteration and len(keep) < 10:
            keep = [c for c in range(d) if c not in keep and total[c] > 0] + keep
        if not keep:
            keep = [c for c in sorted(range(d), key=lambda c: total[c], reverse=True)[:4] if total[c] > 0]
        if not keep:
            continue
        limit, picked, current = min(8 + 2 * iteration, len(keep)), [], [0] * n
        for group, wanted in (("new", new), ("old", memory)):
            for c in keep:
                if factors[c] not in wanted or c in picked or len(picked) >= limit:
                    continue
                fresh = sum(1 for r in range(n) if matrix[r][c] and not current[r])
                if (total[c] if group == "new" else fresh) <= 0:
                    continue
                picked.append(c)
                current = [current[r] + matrix[r][c] for r in range(n)]
        while len(picked) < limit:
            scores = []
            for c in (c for c in keep if c not in picked):
                after = [current[r] + matrix[r][c] for r in range(n)]
                gain = 2 * sum(1 for r in range(n) if matrix[r][c] and not current[r])
                twice, rest = sum(max(0, v - 1) for v in after), sum(v == 0 for v in after)
                a, b = (overlap, s.uncovered) if iteration == 0 else (overlap * 0.5, s.uncovered * 0.8)
                scores.append((gain - a * twice + b * rest, c))
            top = max(score for score, _ in scores)
            c = next(c for score, c in scores if score == top)
            picked.append(c)
            current = [current[r] + matrix[r][c] for r in range(n)]
        selected = [factors[c] for c in picked]
        memory += [f for f in selected if f not in memory]
        chosen_rows = [[factors[c] for c in picked if row[c]] for row in matrix]
        uncovered = [not r for r in chosen_rows]
    for k, f in enumerate(rows):
        if selected and not chosen_rows[k]:
            at = assign(f, selected)
            chosen_rows[k] = [selected[at]] if 0 <= at < len(selected) else []
    return selected, {p: names for (p, _), names in zip(features, chosen_rows, strict=True)}


def words(rng, n):
    return " ".join(rng.choice("abcdefghijklmno") + rng.choice("xyz") for _ in range(n))


def check(frame, rows, propose, assign, settings):
    held, chosen = C.build_factors(frame, propose, assign, settings)
    got = {}
    for r in held.collect():
        got.setdefault(r["id"], {})[r["place"]] = r["factors"]
    order = {}
    for r in chosen.orderBy("id", "rank").collect():
        order.setdefault(r["id"], []).append(r["factor"])
    for sample in sorted({r[0] for r in rows if r[0] is not None}):
        features = sorted((p, f) for i, p, f in rows if i == sample)
        selected, expected = restated(sample, features, propose, assign, settings)
        assert order.get(sample, []) == selected, sample
        assert got[sample] == expected, sample
    assert set(got) == {r[0] for r in rows if r[0] is not None}


def lazy(sample, focus, known, uncovered, attempt):
    """Gives nothing at first, then one factor at a time."""
    return C.mock_proposer(sample, focus, known, uncovered, attempt)[:1] if attempt or len(known) < 2 else known[:1]


@pytest.mark.parametrize(
    ("propose", "settings"),
    [(C.mock_proposer, C.Settings(rounds=5, most=0.6)), (lazy, C.Settings(rounds=6, shown=5, overlap=1.0, threshold=0.95))],
)
def test_equals_the_restatement(spark, propose, settings):
    rng = random.Random(7)
    rows = [(f"u{u}", p * 2, words(rng, rng.randint(1, 3))) for u, n in enumerate((1, 12, 90, 300)) for p in range(n)]
    rows += [(None, 1, "of nobody"), ("same", 1, "aa bb"), ("same", 2, "aa bb")]
    check(spark.createDataFrame(rows, SCHEMA).repartition(3), rows, propose, C.mock_assigner, settings)


def test_nothing_and_too_many_factors(spark):
    held, chosen = C.build_factors(spark.createDataFrame([], SCHEMA), C.mock_proposer, C.mock_assigner)
    assert held.collect() == [] and chosen.collect() == []
    with pytest.raises(Exception, match="were asked for"):
        C.build_factors(spark.createDataFrame([("u", 1, "ax bx cx")], SCHEMA), C.mock_proposer, C.mock_assigner, C.Settings(proposed=2))


def test_the_query_on_the_drivers_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("the driver's tables are not here")
    frames = queries.Frames(spark, folder)
    rows = [(r["user_id"], r["pos"], r["title"]) for r in frames.items.filter("title <> ''").collect()]
    expected = {}
    for sample in {r[0] for r in rows}:
        selected, held = restated(sample, sorted((p, f) for i, p, f in rows if i == sample), C.mock_proposer, C.mock_assigner, C.Settings())
        for place, names in held.items():
            for name in names or [""]:
                rank, titles, places = expected.get((sample, name), (selected.index(name) if name else None, 0, 0))
                expected[sample, name] = (rank, titles + 1, places + place)
    found = queries.queries()["built_factors"](spark, folder)
    assert {(r["id"], r["factor"]): (r["rank"], r["titles"], r["places"]) for r in found.collect()} == expected
