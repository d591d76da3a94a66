"""Monotone years and axis weights against plain Python."""

import random
from math import exp, floor

import numpy as np

from cadenza.operators import axes as A
from cadenza.operators import years as Y


def minimax(means):
    """The rising fit by its formula: the greatest over beginnings of the least over ends of all means of runs."""
    n = len(means)
    run = lambda a, b: sum(t for t, _ in means[a : b + 1]) / sum(w for _, w in means[a : b + 1])
    return [max(min(run(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_rising_fit():
    rng = random.Random(3)
    for n in range(0, 14):
        means = [(rng.randrange(0, 60), rng.randrange(1, 4)) for _ in range(n)]
        got = Y.rising(np.array([t for t, _ in means]), np.array([w for _, w in means]))
        assert np.allclose(got, minimax(means))


def test_years(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 30)]), rng.choice([None, None, *range(1800, 1830)])) for k in range(300)] + [(k, "c", k, None) for k in range(300, 305)] + [(400, "d", None, 1900)]
    got = Y.with_years(spark.createDataFrame(rows, "k int, c string, o int, y int"), "c", "o", "y").collect()
    fits = {}
    for c in ("a", "b"):
        known = {}
        for _, cc, o, y in rows:
            if cc == c and o is not None and y is not None:
                known.setdefault(o, []).append(y)
        numbers = sorted(known)
        fits[c] = dict(zip(numbers, minimax([(sum(known[o]), len(known[o])) for o in numbers])))

    def want(c, o, y):
        if y is not None or c not in fits or o is None:
            return y
        lo, hi = max((x for x in fits[c] if x <= o), default=None), min((x for x in fits[c] if x >= o), default=None)
        if lo is None or hi is None or lo == hi:
            at = fits[c][hi if lo is None else lo]
        else:
            at = fits[c][lo] + (fits[c][hi] - fits[c][lo]) * (o - lo) / (hi - lo)
        return floor(round(at, 6) + 0.5)

    assert len(got) == len(rows)
    assert {r["k"]: (r["composed"], r["interpolated"]) for r in got} == {k: (want(c, o, y), y is None and want(c, o, y) is not None) for k, c, o, y in rows}


def plain_newton(x, y, ridge, rounds):
    w = [0.0] * len(x[0])
    for _ in range(rounds):
        p = [1 / (1 + exp(-sum(a * b for a, b in zip(w, r)))) for r in x]
        g = [sum((yy - pp) * r[i] for r, yy, pp in zip(x, y, p)) - ridge * w[i] for i in range(len(w))]
        h = [[sum(pp * (1 - pp) * r[i] * r[j] for r, pp in zip(x, p)) + ridge * (i == j) for j in range(len(w))] for i in range(len(w))]
        w = [a + b for a, b in zip(w, np.linalg.solve(np.array(h), np.array(g)))]
    return w


def test_axis_weights(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        user = rng.choice(["a", "a", "a", "b", "c", None])
        p, q = rng.random(), rng.random()
        rows.append((user, rng.choice([None, *[(p if user == "a" else q) > rng.random()] * 9]), p, rng.choice([None, *[q] * 9])))
    rows.append(("once", True, 0.5, 0.5))
    got = {r["u"]: r for r in A.axis_weights(spark.createDataFrame(rows, "u string, y boolean, p double, q double"), "u", "y", ["p", "q"]).collect()}
    for user in ("a", "b", "c", "once"):
        own = [(y, p, q) for u, y, p, q in rows if u == user and y is not None and q is not None]
        want = plain_newton([(1.0, p, q) for _, p, q in own], [float(y) for y, *_ in own], A.RIDGE, A.ROUNDS)
        assert got[user]["n"] == len(own) and np.allclose([got[user][c] for c in ("bias", "p", "q")], want, atol=1e-9)
    assert set(got) == {"a", "b", "c", "once"} and got["a"]["p"] > 1 > abs(got["once"]["p"])
