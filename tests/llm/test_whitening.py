"""Whitening against exact fractions and a plain decomposition."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from calltide.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string, n bigint, id string, at int"


def usable(rows):
    return [(i, [floor(Fraction(float(c)) * 64) + 1_000_000 for c in v]) for i, v, *_ in rows if v is not None and len(v) == 5 and all(c is not None and np.isfinite(c) for c in v)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5)) * [8, 4, 2, 1, 0.5]
    out = [(i, [float(np.float32(c)) for c in v], 1, "clash", None, "x", 0) for i, v in enumerate(rng.normal(size=(300, 5)) @ mix + [0, 900, -5e4, 3, 0])]
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 2.0, 3.0, 4.0], [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    return out + [(1000 + i, v, None, None, None, None, None) for i, v in enumerate(odd)] + [(7, out[7][1], 2, "", 1, "", 1), (None, out[3][1], 2, "", 1, "", 1)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_scatter_is_exact_for_any_size_of_entries(spark, rows):
    for big in (1.0, 2.0**20, 2.0**38):
        own = [(i, [c * big for c in v]) for i, v in ((r[0], r[1]) for r in rows[:60])]
        df = spark.createDataFrame(own, "i bigint, vector array<double>").repartition(4)
        x = [[floor(Fraction(c) * 64) + 1_000_000 for c in v] for _, v in own]
        n, sums, centred = whitening.scatter(df.select("vector"), 5)
        assert n == 60 and sums == [sum(r[j] for r in x) for j in range(5)]
        assert centred == [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(5)] for i in range(5)]


@pytest.mark.parametrize("big", [3, 10**6, 10**9, 10**13, 4 * 10**18])
def test_products_are_exact(big):
    z = np.random.default_rng(1).integers(-big, big, size=(50, 4))
    assert (whitening.products(z) == z.astype(object).T @ z.astype(object)).all()


def test_limbs_round_trip():
    for v in (0, 1, -1, 2**31, -(2**32), 3**150, -(3**150)):
        assert whitening.from_limbs(whitening.limbs(v)) == v
    assert whitening.from_limbs([a + b for a, b in zip(whitening.limbs(-5), whitening.limbs(3**90), strict=True)]) == 3**90 - 5


def test_whitening_equals_a_plain_one(table, rows):
    x = usable(rows)
    n, d = len(x), 5
    sums = [sum(v[j] for _, v in x) for j in range(d)]
    centred = np.array([[float(Fraction(n * v[j] - sums[j], n)) for j in range(d)] for _, v in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    got = whitening.whiten(table).collect()
    assert len(got) == n == 302
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert len(by[7]) == 2 and len(by[None]) == 1 and not set(range(1000, 1006)) & set(by)
    signs = None
    for (i, v), c in zip(x, centred, strict=True):
        r = by[i][0]
        assert r["n"] == n and r["deviation"] == sum((n * v[j] - sums[j]) ** 2 for j in range(d))
        want = (c @ axes / np.sqrt(values))[::-1]
        signs = np.sign(want) * np.sign(r["whitened"]) if signs is None else signs
        assert np.allclose(np.array(r["whitened"]) * signs, want, rtol=1e-6, atol=1e-8)
        assert np.allclose(r["explained"], values[::-1] / values.sum(), rtol=1e-9)
        assert r["identity_error"] < 1e-9


def test_degenerate_tables(spark, table):
    assert whitening.whiten(table.where("vec_id IN (1000, 1002)")).count() == 0
    assert whitening.whiten(table.limit(0)).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<double>")).collect()[0]
    assert (one["n"], one["deviation"], one["whitened"], one["explained"]) == (1, 0, [None, None], [0.0, 0.0])
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1e14]) for i in range(50)], "vec_id int, embedding array<double>")
    got = whitening.whiten(flat).collect()
    assert all(r["whitened"][1:] == [None, None] and r["whitened"][0] is not None and r["identity_error"] < 1e-9 for r in got)
    huge = spark.createDataFrame([(0, [2.0**50]), (1, [-(2.0**50)]), (2, [1e300])], "vec_id int, embedding array<double>")
    got = sorted(whitening.whiten(huge).collect())
    assert [(r["n"], r["deviation"], abs(round(r["whitened"][0], 9))) for r in got] == [(2, None, 1.0)] * 2
