import itertools
import math
import random
import time
import zlib

import pytest

from scriptorium.llm import toxicity as T


def brute_segments(values):
    """Maximal segments by their definition: split at the best one, again and again."""
    def best(a, b):
        top, where = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > top + 1e-9:
                    top, where = total, (i, j + 1)
        return where, top

    out, todo = [], [(0, len(values))]
    while todo:
        a, b = todo.pop()
        where, top = best(a, b)
        if where:
            out.append((*where, round(top, 6)))
            todo += [(a, where[0]), (where[1], b)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_all_maximal_segments(seed):
    r = random.Random(seed)
    values = [r.choice([-0.5, -0.5, -0.5, r.uniform(0.1, 3)]) for _ in range(r.randint(0, 40))]
    found = T.maximal_segments([(i, v) for i, v in enumerate(values) if v > 0], -0.5)
    assert [(s.start, s.end, round(s.score, 6)) for s in found] == brute_segments(values)


def corpus(n, seed=0):
    r = random.Random(seed)
    plain = ["".join(p) for p in itertools.product("bcdfg", "aeiou", "lmnrs")]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(20, 200))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["scoundrel", "Villain", "rascal" + r.choice(plain)]))
        docs.append((i, " ".join(w), "en", "a", 0, "x", 9))
        labels.append((i, 1, int(toxic)))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _id int"


def test_held_out_labels_are_found(spark):
    docs, labels = corpus(900)
    frame = spark.createDataFrame(docs + [(None, None, None, None, None, None, None), (5000, "", "en", "a", 0, "x", 1), (5001, "lala " * 30_000, "en", "a", 0, "x", 1)], SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.learn_toxicity(frame, known)
    got = {r["doc_id"]: r for r in T.score_toxicity(frame, model).collect()}
    toxic = {i for i, _, t in labels if t}
    wrong = [i for i, _, _ in labels if (got[i]["predicted"] == 1) != (i in toxic)]
    assert len(wrong) <= 9 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[None]["predicted"] == 0 and got[5000]["score"] == got[None]["score"] and got[5001]["predicted"] == 0
    assert all(got[i]["passages"] for i in toxic if got[i]["score"] > 0.9)
    kept = T.remove_toxic(frame, model)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"] == 0}


def test_nothing_to_learn_from(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.learn_toxicity(docs, labels)
    assert len({r["score"] for r in T.score_toxicity(docs, model).collect()}) == 1
    assert T.score_toxicity(none, model).count() == 0
    one = spark.createDataFrame([(0, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert T.score_toxicity(docs, T.learn_toxicity(docs, one)).count() == docs.count()


def test_every_segment_counts():
    m = T.ToxicityModel({}, -0.2, 1.0, -7.0, (0.0,) * 8)
    scores = [3.0 + (k % 5) / 10 for k in range(400)]
    best, space = sorted(scores, reverse=True), -7.0 + math.log(5001)
    want = max(sum(best[:r]) - r * space + math.lgamma(r + 1) for r in range(1, 401))
    got = m.evidence(5000, 3, scores)
    assert got[0] == pytest.approx(want / math.log(10)) and got[2] == 400
    assert got[0] > m.evidence(5000, 3, scores[:50])[0]


def test_segments_take_time_that_grows_with_their_number():
    def seconds(n):
        values = [(7 * i, 1.0 + i / n) for i in range(n)]  # each starts lower and ends lower than the next search goes
        falling = [(3 * i, 0.3) for i in range(n)]
        begin = time.perf_counter()
        T.maximal_segments(values, -0.2)
        T.maximal_segments(falling, -0.2)
        return time.perf_counter() - begin

    seconds(20_000)
    assert seconds(80_000) < 12 * max(seconds(20_000), 0.01)


def test_common_opening_lines_do_not_hide_texts(spark):
    r = random.Random(6)
    line = " ".join("".join(r.choice("aeiou") for _ in range(6)) for _ in range(12))
    docs, labels = corpus(300)
    docs = [(i, line + " " + t, *rest) for i, t, *rest in docs]
    frame = spark.createDataFrame(docs, SCHEMA)
    kept = T.training_rows(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count()
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, *_ in docs)
    assert kept > 0.85 * learned
