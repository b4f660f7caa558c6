import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_statistics(spark):
    r = random.Random(5)
    texts = [None, "", "  ", "a b c d", "a b c d e a b c d e a b c d e", "x\ny\n\nx\n \nx\x0b\n#*$%&|<>"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(40)]
    texts += ["\n".join(" ".join(r.choice(["é", "b|", "c\t", "日本"]) for _ in range(r.randint(0, 4))) for _ in range(12)) for _ in range(20)]
    texts += ["w x y z " * 10, " ".join(str(i) for i in range(30_000))]
    frame = spark.createDataFrame([(i, t, None, None, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, kept string")
    got = {r["doc_id"]: r for r in Q.judge_quality(frame).collect()}
    for i, t in enumerate(texts):
        if len(t or "") < 5000:
            assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(t), t
    assert got[len(texts) - 1]["n_words"] == 30_000
    assert all(not (r["base_failed"] and r["kept"]) for r in got.values())


def test_outliers_go_and_clean_texts_stay(spark, none):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(30, 400))) + ".", "en", "s", 0) for i in range(500)]
    junk = [(1000 + i, " ".join(word().upper() + "!!" for _ in range(100)), "en", "s", 0) for i in range(10)]
    junk += [(1100 + i, " | ".join(word() for _ in range(100)), None, None, 0) for i in range(3)]
    frame = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["kept"] for r in Q.judge_quality(frame).collect()}
    assert all(got[i] for i in range(500)) and not any(got[1000 + i] for i in range(10))
    assert got[1100]  # three rows are no group to be far from
    assert Q.judge_quality(none).count() == 0


def test_symbol_junk_goes(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(30, 400))) + ".", "en", "s") for i in range(500)]
    rows += [(1000 + i, " | ".join(word() for _ in range(r.randint(40, 100))), "en", "s") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in Q.judge_quality(frame).collect()}
    assert all(got[i] for i in range(500)) and not any(got[1000 + i] for i in range(20))


def covariance(x):
    """As the operator's: variances no less than those of the least deviations, and a little more."""
    cov = np.atleast_2d(np.cov(x.T, bias=True))
    np.fill_diagonal(cov, np.maximum(np.diag(cov), np.array(list(Q.FEATURES.values())) ** 2) * 1.001)
    return cov


def test_estimate_inverts_the_covariance(spark):
    names = list(Q.FEATURES)
    x = np.random.default_rng(0).normal(size=(400, len(names))) @ np.random.default_rng(1).normal(size=(len(names), len(names)))
    frame = spark.createDataFrame([("g", 0, [0.5] * len(names), *map(float, row)) for row in x], ["group", "start", "origin", *names])
    models = Q.estimate(frame, frame.select("group", "start", "origin").distinct(), True)
    model = models.first()
    cov = covariance(x)
    assert np.allclose(model["center"], x.mean(axis=0))
    assert np.allclose(np.array(model["precision"]).reshape(len(names), -1), np.linalg.inv(cov), rtol=1e-6)
    assert np.isclose(model["logdet"], np.linalg.slogdet(cov)[1])
    got = Q.with_model(frame.drop("start"), models, True).select(Q.distance().alias("d")).collect()
    off = x - x.mean(axis=0)
    assert np.allclose(sorted(r["d"] for r in got), sorted(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)))


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.75, 1.0])
def test_quantiles_of_groups(spark, share):
    r = random.Random(3)
    values = {g: [r.randint(-50, 50) for _ in range(r.choice([1, 2, 7, 300]))] for g in "abcdef"}
    frame = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v int")
    got = {x["g"]: x["bin"] for x in Q.quantile(frame, ["g"], F.col("v"), share).collect()}
    assert got == {g: min(v for v in vs if sum(w <= v for w in vs) >= share * len(vs)) for g, vs in values.items()}


def brute_distances(x):
    """The estimate restated for one group in numpy, with exact quantiles."""
    least = np.array(list(Q.FEATURES.values()))

    def order(values, share):
        return np.sort(values)[max(0, int(np.ceil(share * len(values))) - 1)]

    med = np.array([order(c, 0.5) for c in x.T])
    mad = np.array([order(c, 0.5) for c in np.abs(x - med).T])
    z = (x - med) / np.maximum(Q.NORMAL * mad, least)
    begins = [(z**2).sum(1), (np.tanh(z) ** 2).sum(1), (z**2).max(1), (((x - med) / least) ** 2).sum(1)]

    def step(d):
        core = x[d <= order(d, Q.SHARE)]
        cov = covariance(core)
        off = x - core.mean(axis=0)
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), np.linalg.slogdet(cov)[1]

    states = [step(step(d)[0]) for d in begins]
    d, det = min(states, key=lambda s: s[1])
    for _ in range(Q.MOST_STEPS - Q.FIRST_STEPS):
        d, new = step(d)
        if det - new <= Q.FALL:
            break
        det = new
    return d / max(1, order(d, 0.5) / Q.chi2_quantile(0.5, x.shape[1]))


def test_verdicts_equal_those_of_a_plain_restatement(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))

    def text(kind):
        w = [word() for _ in range(r.randint(20, 300))]
        w = [x.title() if r.random() < 0.1 else x for x in w]
        if kind == 1:
            w = [x + r.choice(["!", "", "", "?!"]) for x in w]
        if kind == 2:
            w = [y for x in w for y in ((x, "|") if r.random() < 0.5 else (x,))]
        return "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))

    rows = [(i, text(0 if i % 10 else r.choice([1, 2])), "en", "s") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in Q.judge_quality(frame).collect()}
    features = Q.statistics(frame).withColumns(Q.vector()).select("doc_id", *Q.FEATURES).orderBy("doc_id").toPandas()
    sound = [i for i in range(700) if not got[i]["base_failed"]]
    want = dict(zip(sound, brute_distances(features.set_index("doc_id").loc[sound].to_numpy()), strict=True))
    far = Q.chi2_quantile(1 - Q.TAIL, len(Q.FEATURES))
    assert 10 < sum(d > far for d in want.values()) < 100
    assert np.allclose([got[i]["distance"] for i in sound], [want[i] for i in sound], rtol=0.15)
    assert all(got[i]["kept"] == (want[i] <= far) for i in sound if abs(want[i] / far - 1) > 0.1)


def test_plan_has_no_python(docs):
    assert "Python" not in Q.statistics(docs)._jdf.queryExecution().executedPlan().toString()
