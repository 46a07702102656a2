"""Bootstraps of the references' number of resamples, with the differences between conditions."""

import inspect

from millrace.operators import stats
from millrace.plans import registry

SF = "/root/testdata/sf0.001"


def test_t9_resamples(spark):
    assert inspect.signature(stats.paired_bootstrap).parameters["reps"].default == 2000
    rows = registry.queries()["t9_intervals"](spark, SF).collect()
    assert rows and all(r.lo <= r.delta <= r.hi for r in rows)


def test_t10_differences(spark):
    rows = {(r.a, r.b): r for r in registry.queries()["t10_rank_intervals"](spark, SF).collect()}
    labels = sorted(a for a, b in rows if b is None)
    assert {k for k in rows if k[1]} == {(a, b) for a in labels for b in labels if a < b} and len(labels) > 2
    for (a, b), r in rows.items():
        assert r.lo <= r.point <= r.hi and r.reproduced
        if b is not None:
            assert abs(r.point - (rows[a, None].point - rows[b, None].point)) < 2e-6
            assert r.separated == (not r.lo <= 0 <= r.hi) and 0 <= r.share_le_0 <= 1
