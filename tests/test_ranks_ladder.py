"""Verdicts by grade, rank rows and the wide ladder against plain code."""

import random

import pytest

from millrace.operators import ladder, ranking


def plain(items, weights):
    """items: {(suite, key): [(label, stated, grade)]}; weights: principle -> (tier, weight)."""
    pts = {"A+": 1.0, "A": 0.9, "B+": 0.8, "B": 0.7, "C+": 0.6, "C": 0.5, "D": 0.3, "E": 0.0}
    out, sums = {}, {}
    for (suite, key), answers in items.items():
        order = [label for label, _, _ in sorted(answers, key=lambda a: a[1])]
        score = {label: pts[g.strip().upper()] for label, _, g in answers if g and g.strip().upper() in pts}
        again = sorted(order, key=lambda x: (-score.get(x, -1.0), order.index(x))) if score else order
        place = {x: 1 + sum(score.get(o, -1.0) > score.get(x, -1.0) for o in order) for x in order} if score else {x: i + 1 for i, x in enumerate(order)}
        n = len(order)
        for x in order:
            tied = sum(p == place[x] for p in place.values())
            beat = (n - place[x] - (tied - 1) / 2) / (n - 1) if n > 1 else 1.0
            win = 1 / tied if place[x] == 1 else 0.0
            out[suite, key, x] = (score.get(x), place[x], again.index(x) + 1, again != order)
            tier, weight = weights.get(key.partition("::")[0], (3, 1.0))
            for row in ["ALL", suite] + ([f"constitution_tier{tier}"] if suite == "constitution" else []):
                sums.setdefault((x, row), []).append((win, beat, score.get(x)))
            if suite == "constitution":
                sums.setdefault((x, "w"), []).append((weight, win, beat))
    return out, sums


def test_verdicts_and_rows(spark):
    rng = random.Random(2)
    labels, grades = ["a", "b", "c", "d"], ["A+", "a", " B+", "B", "c+", "C", "D", "E", "F", None, ""]
    items = {}
    for k in range(120):
        some = rng.sample(labels, rng.randrange(1, 5))
        stated = rng.sample(range(10), len(some))
        items[rng.choice(["constitution", "drift"]), f"P{k % 3}::{k}"] = [(x, s, None if k % 9 == 0 else rng.choice(grades)) for x, s in zip(some, stated)]
    rows = [(s, key, key.partition("::")[0], *a) for (s, key), answers in items.items() for a in answers]
    df = spark.createDataFrame(rows, "suite string, key string, principle string, label string, stated int, grade string")
    weights = {"P0": (1, 3.0), "P1": (2, 2.0)}
    want, sums = plain(items, weights)
    resolved = ranking.resolved(df, ["suite", "key"])
    assert {(r.suite, r.key, r.label): (r.points, r.place, r.shown, r.disagrees) for r in resolved.collect()} == want
    dimension = spark.createDataFrame([(p, t, w) for p, (t, w) in weights.items()], "principle string, tier int, weight double")
    got = {(r.label, r.suite): r for r in ranking.rank_rows(ranking.beat_credit(resolved, ["suite", "key"]), dimension).collect()}
    assert len(got) == len(sums)
    for (x, row), own in sums.items():
        if row == "w":
            r, whole = got[x, "constitution_weighted"], sum(w for w, _, _ in own)
            assert (r.wins, r.h2h_score, r.n) == (pytest.approx(sum(w * v for w, v, _ in own) / whole, abs=6e-5), pytest.approx(sum(w * b for w, _, b in own) / whole, abs=6e-5), len(sums[x, "ALL"]))
            continue
        r, known = got[x, row], [s for _, _, s in own if s is not None]
        assert (r.n, r.wins, r.h2h_score) == (len(own), pytest.approx(sum(w for w, _, _ in own), abs=6e-3), pytest.approx(sum(b for _, b, _ in own) / len(own), abs=6e-5))
        assert r.mean_score == (pytest.approx(sum(known) / len(known), abs=6e-5) if row == "ALL" else None)
    assert sum(r.wins for (_, s), r in got.items() if s == "ALL") == pytest.approx(120, abs=0.05)
    line = {r.label: r for r in ranking.lineage(ranking.rank_rows(ranking.beat_credit(resolved, ["suite", "key"]), dimension), ["b", "zz", "a", "c"]).collect()}
    assert set(line) == {"a", "b", "c"} and line["b"].delta is None and line["a"].delta is None
    assert line["c"].delta == pytest.approx(got["c", "constitution_weighted"].h2h_score - got["a", "constitution_weighted"].h2h_score)


def test_wide_ladder(spark):
    rng = random.Random(3)
    rows = [("m", x, f"k{i}", rng.random() + (x == "b")) for x in "abc" for i in range(60)] + [("lone", "a", "k", 0.5), ("apart", "a", "k1", 0.25), ("apart", "b", "k2", 0.75), ("m", "zz", "k", 9.0), ("m", "a", "kn", None)]
    got = {r.metric: r for r in ladder.wide(spark.createDataFrame(rows, "metric string, label string, key string, value double"), ["a", "b", "c"], 400).collect()}
    mean = {x: sum(v for m, y, _, v in rows if m == "m" and y == x and v is not None) / 60 for x in "abc"}
    r = got["m"]
    assert (r.score_a, r.delta_a__b, r.delta_b__c) == pytest.approx((mean["a"], mean["b"] - mean["a"], mean["c"] - mean["b"]))
    assert r.lo_a__b < r.delta_a__b < r.hi_a__b and r.hi_b__c < 0 and 0.1 < r.hi_a__b - r.lo_a__b < 0.4
    assert got["lone"].score_b is None and got["lone"].delta_a__b is None and got["lone"].lo_a__b is None
    assert got["apart"].delta_a__b == 0.5 and got["apart"].lo_a__b is None and "zz" not in str(got)
