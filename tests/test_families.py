import difflib
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.operators import families as A
from scriptorium.operators.compilers import CONTENT_STOP_WORDS
from scriptorium.plans import queries


def alike(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5:
        return False
    return (len(a) >= 6 and a[:6] == b[:6]) or difflib.SequenceMatcher(None, a, b).ratio() >= 0.72


def keys(word):
    out = {f"={word}"} | ({f"^{word[:6]}"} if len(word) >= 6 else set())
    return out | ({word[k] + word[k + g] for g in (1, 2) for k in range(len(word) - g)} if len(word) >= 5 else set())


WORD = st.text(alphabet="abcdef", min_size=1, max_size=14)


@settings(max_examples=3000, deadline=None)
@given(WORD, st.lists(st.tuples(st.sampled_from("dix"), st.integers(0, 13), st.sampled_from("abcdefg")), max_size=6))
def test_words_of_a_family_share_a_key(word, edits):
    other = list(word)
    for kind, at, letter in edits:
        at = min(at, len(other))
        other[at : at + (kind != "i")] = [] if kind == "d" else [letter]
    other = "".join(other)
    if other and alike(word, other):
        assert keys(word) & keys(other)


def test_all_pairs_of_a_family_are_found(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    words = sorted({s[: rng.randint(3, 9)] + rng.choice(["", "s", "ing", "ed", "ation", "al"]) for s in stems * 4})
    left = [(k % 2, w) for k, w in enumerate(words)] + [(0, None), (0, ""), (0, words[0])]
    right = [(k % 2, w) for k, w in enumerate(reversed(words))] + [(1, None)]
    frames = [spark.createDataFrame(x, "id int, word string") for x in (left, right)]
    got = {tuple(r) for r in A.family_pairs(*frames).collect()}
    expected = {(i, a, b) for i, a in left for j, b in right if i == j and a and b and alike(a, b)}
    assert got == expected and any(a != b for _, a, b in expected)
    assert sorted(A.family_pairs(*frames).collect()) == sorted(got)


def content(text):
    return {t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) >= 3 and t not in CONTENT_STOP_WORDS}


def restated(parents, source):
    """One sample by itself."""
    pool = [p for p in sorted(parents, key=lambda p: p["pos"]) if (p["text"] or "").strip(" ")]
    if len(pool) < 2 or pool[0]["issues"]:
        return None
    a, best = pool[0], None
    compact = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    toks = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    n = 0
    for b in pool[1:]:
        closeness = near(toks(b["text"]), toks(a["text"]))
        if b["issues"] or compact(b["text"]) == compact(a["text"]) or closeness >= 0.92:
            continue
        p, q = a["p"], b["p"]
        if p is not None and q is not None and q < p - 1.5:
            continue
        new = sorted(t for t in content(b["text"]) & content(source) if not any(alike(t, x) for x in content(a["text"])))
        if not new:
            continue
        n += 1
        quality = 0.5 if q is None else min(1.0, max(0.0, (q + 2.5) / 2.25))
        score = round(0.5 * quality + 0.25 * min(1.0, len(new) / 3) + 0.15 * len(content(b["text"]) & content(source)) / max(len(content(b["text"])), 1) + 0.1 * (1 - closeness), 6)
        if best is None or score > best[3] + 1e-9:
            best = (a["candidate_id"], b["candidate_id"], " ".join(new), score)
    return best and (*best[:3], pytest.approx(best[3], abs=2e-6), n)


CASES = {
    "plain": ("graph networks learn molecules with attention", [("graph learning", -0.5, ""), ("graph networks of molecules", -0.7, ""), ("attention", -3.0, "")]),
    "a_unsound": ("graph networks", [("x", -0.5, "short"), ("graph networks", -0.5, "")]),
    "only_forms": ("molecular networks modelling", [("molecule network modeling", None, ""), ("molecular networks modelling", None, "")]),
    "same_text": ("graph networks", [("Graph-Networks", 0.0, ""), ("graph networks", 0.0, "")]),
    "single": ("graph networks", [("graph", 0.0, ""), (None, 0.0, ""), ("  ", 0.0, "")]),
    "unknown": ("graph networks attention", [("graph", float("nan"), ""), ("networks", -9.0, ""), ("attention", -0.1, None)]),
    "none_sound": ("graph networks", [("graph", 0.0, ""), ("networks", 0.0, "meta")]),
}


def test_pairs_equal_the_restatement(spark):
    rows = [(k, i, f"p{i}", t, p, s) for k, (_, ps) in CASES.items() for i, (t, p, s) in enumerate(ps)]
    parents = spark.createDataFrame(rows, "id string, pos int, candidate_id string, text string, mean_logprob double, issues string")
    sources = spark.createDataFrame([(k, s) for k, (s, _) in CASES.items()], "id string, source_text string")
    got = {r["id"]: r for r in A.complementary_pairs(parents, sources).collect()}
    assert set(got) == set(CASES)
    for k, (source, ps) in CASES.items():
        own = [{"pos": i, "candidate_id": f"p{i}", "text": t, "p": None if p != p else p, "issues": s or ""} for i, (t, p, s) in enumerate(ps)]
        expected = restated(own, source)
        assert tuple(got[k])[1:] == (expected or (None, None, None, None, 0)), k
    assert got["plain"]["b_id"] == "p1" and got["only_forms"]["b_id"] is None
    assert A.complementary_pairs(parents.limit(0), sources).collect() == []


def test_the_query_on_the_drivers_tables(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("the driver's tables are not here")
    frames = queries.Frames(spark, folder)
    sources = {r["id"]: r["source_text"] for r in frames.samples.collect()}
    parents = {}
    for r in frames.seeds.collect():
        size = len(re.findall("[a-z0-9]+", r["text"].lower()))
        parents.setdefault(r["id"], []).append({"pos": r["pos"], "candidate_id": r["candidate_id"], "text": r["text"], "p": None if len(r["text"]) % 7 == 0 else -0.3 * r["pos"], "issues": "short" if size < 2 else ""})
    got = {r["id"]: tuple(r)[1:] for r in queries.queries()["complementary_pairs"](spark, folder).collect()}
    assert got == {k: restated(own, sources[k]) or (None, None, None, None, 0) for k, own in parents.items()}
