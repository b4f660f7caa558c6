import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import queries
from scriptorium.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component int"


def brute(rows, components=16):
    """By fractions, with an eigendecomposition of the rounded covariance."""
    sound = [(r[0], r[1]) for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    lengths = [len(v) for _, v in sound]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k), default=0)
    xs = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in sound if len(v) == d]
    fit = sorted({x for _, x in xs})
    n = len(fit)
    sums = [sum(x[k] for x in fit) for k in range(d)]
    if n < 2:
        return [], None
    centred = [[n * v - s for v, s in zip(x, sums)] for x in fit]
    covariance = np.array([[float(Fraction(sum(y[i] * y[j] for y in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in xs:
        y = [n * v - s for v, s in zip(x, sums)]
        white = (np.array(y, dtype=float) / n) @ vectors / np.sqrt(values)
        out.append((i, n, sum(v * v for v in y), white, values / np.trace(covariance)))
    return out, values


def vectors(seed, rows=300, d=20):
    rng = np.random.default_rng(seed)
    plain = (rng.normal(size=(rows, d)) @ np.diag(np.linspace(3, 0.5, d))).astype(np.float32)
    return [(i, v.tolist(), 1, "x", 0, 2) for i, v in enumerate(plain)]


def check(found, rows):
    expected, values = brute(rows)
    by_id: dict = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    want: dict = {}
    for e in expected:
        want.setdefault(e[0], []).append(e)
    assert sorted(by_id, key=str) == sorted(want, key=str)
    signs = None
    for key, own in by_id.items():
        k = min(len(values), 16)
        assert len(own) == k * len(want[key])
        e = want[key][0]
        if len(want[key]) > 1 and any((w[3] != e[3]).any() for w in want[key]):
            continue
        own = sorted(own, key=lambda r: r["component"])[:: len(want[key])]
        assert [r["component"] for r in own] == list(range(1, k + 1))
        assert {r["n"] for r in own} == {e[1]} and {r["deviation"] for r in own} == {e[2] if e[2] < 10**38 else None}
        white = np.array([r["whitened"] for r in own])
        if signs is None:
            signs = np.sign(white * e[3])
        assert np.allclose(white, signs * e[3], rtol=1e-6, atol=1e-8)
        assert np.allclose([r["explained"] for r in own], e[4], rtol=1e-9)
        assert {r["identity_error"] for r in own} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-8


def test_equals_fractions_with_awkward_rows(spark):
    rows = vectors(1)
    rows += [(5, rows[5][1], None, None, None, None), (None, rows[7][1], 1, "y", 1, 1), (900, rows[7][1], 1, "y", 1, 1)]
    rows += [(901, None, 1, "a", 0, 0), (902, [None] * 20, 1, "a", 0, 0), (903, [float("nan")] + [0.0] * 19, 1, "a", 0, 0)]
    rows += [(904, [float("-inf")] + [0.0] * 19, 1, "a", 0, 0), (905, [], 1, "a", 0, 0), (906, [1.0, 2.0], 1, "a", 0, 0)]
    rows += [(907, [0.001] + rows[3][1][1:], 1, "a", 0, 0)]
    check(W.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_values_past_a_long_when_centred(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 1.5e14).astype(np.float32).tolist(), 1, "x", 0, 1) for i in range(200)]
    check(W.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_huge_entries_end_in_a_result(spark):
    rows = [(i, [float(i) * 1e30, -1e38, float(i % 3)], 1, "x", 0, 1) for i in range(10)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"] for r in found} == set(range(10)) and all(math.isfinite(r["whitened"]) for r in found)


def test_no_rows_one_row_and_equal_rows(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = (1, [1.0, 2.0], 1, "x", 0, 1)
    assert W.whiten(spark.createDataFrame([one], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([one, one, one], SCHEMA)).collect() == []


def test_fewer_vectors_than_dimensions_and_a_long_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=300).astype(np.float32).tolist(), 1, "x", 0, 1) for i in range(8)]
    found = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in found} == set(range(1, 8))  # seven directions are left of eight points
    white = np.array([[r["whitened"] for r in sorted(found, key=lambda r: r["component"]) if r["vec_id"] == i] for i in range(8)])
    assert np.allclose(white.T @ white / 8, np.eye(7), atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(0, 2**32), st.integers(1, 7))
def test_limb_products_are_exact(bits, seed, block):
    rng = np.random.default_rng(seed)
    values = np.array([[int(rng.integers(-(2**31), 2**31)) * int(rng.integers(1, 2**31)) ** 2 >> max(0, 93 - bits) for _ in range(3)] for _ in range(17)], dtype=object)
    largest = max(abs(int(v)) for v in values.ravel())
    plain = np.array([[sum(int(r[i]) * int(r[j]) for r in values) for j in range(3)] for i in range(3)], dtype=object)
    assert (W.exact_gram(values, largest, block=block) == plain).all()
    if largest < 1 << 62:
        assert (W.exact_gram(values.astype(np.int64), largest, block=block) == plain).all()


@given(st.integers(-(2**200), 2**200))
def test_digits_come_back(value):
    assert sum(v << (W.DIGIT * k) for k, v in enumerate(W.digits_of(value))) == value


def test_the_query_on_the_drivers_vectors(spark):
    import pathlib

    folder = "/root/testdata/sf0.001"
    if not pathlib.Path(folder).is_dir():
        pytest.skip("the driver's tables are not here")
    query = queries.queries()["op13_whitening"](spark, folder)
    assert dict(query.dtypes)["deviation"] == "bigint"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(query.collect(), rows)
