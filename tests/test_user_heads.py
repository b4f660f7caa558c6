import numpy as np
import pytest

from scriptorium.operators import user_heads as H

SCHEMA = "user_id string, part string, chosen array<double>, rejected array<double>, weight double"


def restated(pairs, base, t):
    """All pairs of one user in one array, step by step."""
    start = H.first_weights(base, t)
    split = {p: [x for x in pairs if x[0] == p] for p in ("train", "validation")}

    def loss_of(theta, part):
        rows = split[part]
        a, b, w = (np.array([x[k] for x in rows]) for k in (1, 2, 3))
        gap = H.scores(theta, base, a, t) - H.scores(theta, base, b, t)
        return (np.logaddexp(0, -gap) * w).mean(), (gap > 0).mean()

    def slope_of(theta):
        a, b, w = (np.array([x[k] for x in split["train"]]) for k in (1, 2, 3))
        falls = -w / (1 + np.exp(H.scores(theta, base, a, t) - H.scores(theta, base, b, t)))
        out = (H.gradient(theta, a, falls, t) - H.gradient(theta, b, falls, t)) / len(w)
        for part in H.groups_of(theta, len(base) - 1, t):
            out[part] += t.anchor * 2 * (theta[part] - start[part]) / (part.stop - part.start)
        return out

    theta, mean, square, best = start.copy(), 0.0, 0.0, None
    judged = "validation" if split["validation"] else "train"
    for step in range(t.steps + 1):
        loss, accuracy = loss_of(theta, judged)
        first = (loss, accuracy) if step == 0 else first
        if best is None or loss < best[0] - t.least_gain:
            best = (loss, accuracy, step, theta.copy())
        if step - best[2] >= t.patience:
            break
        g = slope_of(theta)
        g *= min(1.0, t.longest / (np.linalg.norm(g) + 1e-6))
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        theta = theta * (1 - t.rate * t.decay) - t.rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.999 ** (step + 1))) + 1e-8)
    return first, best


def pairs_of(seed, n, d=3, part=None):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=d)
    out = []
    for k in range(n):
        a, b = rng.normal(size=(2, d))
        if a @ truth < b @ truth and rng.random() < 0.85:
            a, b = b, a
        out.append((part or ("validation" if k % 4 == 0 else "train"), a.tolist(), b.tolist(), 0.5 + (k % 3) / 2))
    return out


@pytest.mark.parametrize("kind", H.KINDS)
def test_equals_the_restatement(spark, kind):
    t = H.Training(kind, rank=2, steps=6, patience=2, rate=0.3 if kind == "linear" else 0.1, decay=0.01, anchor=0.05)
    base = np.array([0.4, -0.2, 0.1, 0.3])
    users = {"u": pairs_of(1, 60), "v": pairs_of(2, 25), "only": pairs_of(3, 9, part="train")}
    rows = [(u, *p) for u, own in users.items() for p in own] + [("unseen", *p) for p in pairs_of(4, 3, part="validation")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r["user_id"]: r for r in H.fit_user_heads(frame, base.tolist(), t).collect()}
    assert set(found) == set(users)
    for user, own in users.items():
        first, best = restated(own, base, t)
        r = found[user]
        assert (r["first_loss"], r["first_accuracy"]) == pytest.approx(first) and r["best_step"] == best[2]
        assert r["loss"] == pytest.approx(best[0], abs=1e-4) and r["accuracy"] == pytest.approx(best[1])
        weights = best[3] + base if kind == "residual" else best[3]
        assert np.allclose(r["weights"], weights, atol=2e-3)
        assert r["loss"] <= r["first_loss"] and r["pairs"] == sum(p[0] == "train" for p in own)


def test_heads_start_as_the_given_one_and_nothing_has_no_head(spark):
    base, x = np.array([0.5, -1.0, 2.0, 0.1]), np.random.default_rng(5).normal(size=(7, 3))
    for kind in H.KINDS:
        t = H.Training(kind)
        assert np.allclose(H.scores(H.first_weights(base, t), base, x, t), x @ base[:3] + base[3])
    assert H.fit_user_heads(spark.createDataFrame([], SCHEMA), [0.0, 0.0]).collect() == []
    with pytest.raises(ValueError, match="kind"):
        H.fit_user_heads(spark.createDataFrame([], SCHEMA), [0.0, 0.0], H.Training("deep"))


@pytest.mark.parametrize("kind", H.KINDS)
def test_gradients_are_the_derivatives(kind):
    t, rng = H.Training(kind, rank=2), np.random.default_rng(6)
    base, x, slope = rng.normal(size=5), rng.normal(size=(6, 4)), rng.normal(size=6)
    theta = H.first_weights(base, t) + rng.normal(size=len(H.first_weights(base, t))) / 3
    got = H.gradient(theta, x, slope, t)
    for k in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert got[k] == pytest.approx((slope * (H.scores(up, base, x, t) - H.scores(down, base, x, t))).sum() / 2e-6, abs=1e-6)


def test_pairs_are_unpacked_without_an_object_for_each_number():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    column = pa.array(np.arange(640_000.0).reshape(10_000, 64).tolist(), pa.list_(pa.float64()))
    tracemalloc.start()
    found = H._matrix(column.slice(1000, H.ROWS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.shape == (H.ROWS, 64) and found[0, 0] == 64_000 and peak < 2_000_000
