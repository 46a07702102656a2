"""Streams with keyed state agree with their batch twins, over several micro-batches, restarts, loads and resets."""

import json
import random
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.streaming import applied, harness

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
RECORD = "key string, request_id long, at timestamp, violations array<string>, retried boolean, cleared boolean, reset boolean"


def records(n, seed=3):
    rng = random.Random(seed)
    codes = ["P1: no think", "PRINCIPLE_3: bad", "P4", "principle_18", "P20", "P21 : late", "P99", "P24a"]
    return [(rng.choice(["a", "b", None]), i, START + timedelta(seconds=i), rng.choice([None, [], rng.sample(codes, 3)]), rng.random() < 0.4, rng.random() < 0.2, rng.random() < 0.03) for i in range(n)]


def plain_rates(rows, size):
    out, state = {}, {}
    for key, i, _, violations, retried, cleared, reset in rows:
        windows, counts = state.setdefault(key, ({p: deque(maxlen=size) for p in harness.PRINCIPLES}, [0, 0, 0]))
        if reset:
            state.pop(key)
            continue
        names = {v.split(":")[0].strip() for v in violations or []}
        names = {"P" + v[10:] if v.upper().startswith("PRINCIPLE_") else v for v in names}
        counts[0] += 1
        counts[1] += retried
        counts[2] += cleared
        for p, w in windows.items():
            w.append(p in names)
        out[i] = (key, counts[0], counts[1], round(counts[2] / counts[1], 3) if counts[1] else None, [sum(w) / len(w) for w in windows.values()])
    return out, {k: (c[0], c[1], c[2], [len(w) for w in ws.values()], [sum(w) for w in ws.values()]) for k, (ws, c) in state.items()}


def by_id(df):
    return {r.request_id: (r.key, r.requests, r.retries, r.retry_success_rate, r.rates) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        assert a[i][:3] == b[i][:3] and a[i][3] == pytest.approx(b[i][3], abs=0.00101) and list(a[i][4]) == pytest.approx(b[i][4])


def test_rates_of_stream_batch_and_plain_code_agree_over_a_restart(spark, tmp_path):
    rows = records(300)
    df = spark.createDataFrame(rows, RECORD)
    want, state = plain_rates(rows, 10)
    same(by_id(harness.rates_batch(df, 10)), want)
    (tmp_path / "in").mkdir()
    stream = harness.rates_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 10)
    for part in range(3):  # a run each: the state comes from the checkpoint
        df.filter(F.col("request_id").between(part * 100, part * 100 + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        harness.started(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    same(by_id(harness.written(spark, harness.RATES, f"{tmp_path}/out")), want)
    saved = harness.saved_rates(spark, f"{tmp_path}/c").collect()
    assert {r.key: (r.requests, r.retries, r.checks, r.failures) for r in saved} == {k: (v[0], v[1], v[3], v[4]) for k, v in state.items()}
    for r in saved:
        assert r.adapts == [p for p, c, f in zip(harness.PRINCIPLES, r.checks, r.failures) if c and f / c >= harness.THRESHOLD]


def test_rates_start_from_what_was_saved(spark, tmp_path):
    """Loaded windows hold failures first, then passes, so that the failures leave first."""
    saved = spark.createDataFrame([("a", 70, 46, 0.522, [4, 4, 4, 4, 4, 2], [2, 0, 4, 1, 3, 1])], "key string, requests long, retries long, retry_success_rate double, checks array<long>, failures array<long>")
    rows = [("a", i, START + timedelta(seconds=i), [], False, False, False) for i in range(5)] + [("b", 9, START, ["P1"], True, True, False)]
    df = spark.createDataFrame(rows, RECORD)
    df.write.parquet(f"{tmp_path}/in")
    stream = harness.rates_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 4, saved_state=saved)
    harness.started(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    got = by_id(harness.written(spark, harness.RATES, f"{tmp_path}/out"))
    assert got[0] == ("a", 71, 46, 0.522, [0.25, 0.0, 0.75, 0.0, 0.5, 1 / 3]) and got[4][1] == 75 and got[4][4] == [0.0] * 6
    assert got[9] == ("b", 1, 1, 1.0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])


def test_suffix(spark):
    row = spark.createDataFrame([([0.3, 0.29, 0.0, 0.0, 0.0, 1.0],), ([0.0] * 6,)], "rates array<double>").select(harness.suffix(harness.adapting(F.col("rates")))).collect()
    assert row[0][0] == "\n".join(["", harness.REMINDERS_HEAD, harness.REMINDERS["P1"], "**P21: Review the constitution.**"]) and row[1][0] == ""


REQUEST = "key string, request_id long, at timestamp, latency double, tokens long, tools map<string,long>, ok boolean, reset boolean"


def test_request_metrics_of_stream_batch_and_plain_code_agree(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y"]), i, START + timedelta(seconds=i // 2), rng.randrange(9000) / 1000, rng.randrange(500), rng.choice([None, {}, {"a": 2}, {"a": 1, "b": 3}]), rng.random() < 0.8, rng.random() < 0.02) for i in range(300)]
    rows += [("z", 1000, START, 1.0, 1, None, True, False), ("z", 1001, START, 1.0, 1, None, True, True), (None, 1002, START, None, None, None, False, None)]
    df = spark.createDataFrame(rows, REQUEST)
    want = {}
    for key in ("x", "y", "z", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        cut = max([i + 1 for i, r in enumerate(own) if r[7]], default=0)
        live = own[cut:]
        good = [r for r in live if r[6]]
        took = sorted(r[3] for r in good)
        pct = [took[max(0, min(len(took) * p // 100, len(took) - 1))] if took else 0.0 for p in (50, 95, 99)]
        tools = {t: sum((r[5] or {}).get(t, 0) for r in good) for t in {t for r in good for t in r[5] or {}}}
        want[key] = (len(live), len(good), len(live) - len(good), *pct, sum(r[4] for r in good), round(sum(r[4] for r in good) / len(good), 1) if good else 0.0, tools)
    got = lambda df: {r.key: tuple(r)[2:] for r in df.collect()}
    assert got(harness.requests_batch(df)) == want
    (tmp_path / "in").mkdir()
    stream = harness.requests_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    for part in range(2):
        df.filter((F.col("request_id") < 150) == (part == 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        harness.started(stream, f"{tmp_path}/out", f"{tmp_path}/c", "update").awaitTermination(120)
    last = harness.latest(harness.written(spark, stream.schema, f"{tmp_path}/out"), "key")
    assert got(last.filter("key <> 'z'")) == {k: want[k] for k in "xy"} and last.filter("key = 'z' AND total = 0").count() == 1


def test_a_stopped_application_of_results_goes_on_without_repeats(spark, tmp_path):
    calls = []
    judge = lambda rows: rows.select("item_id", F.when(F.col("v") >= 0, F.col("v")).alias("score"), F.when(F.col("v") < 0, "gone").alias("error"))
    items = [[(f"i{k}", 0.1 * (k % 10) - 0.1) for k in range(b * 10, b * 10 + 12)] + [(None, 1.0), (f"i{b * 10}", 0.1 * (0 % 10) - 0.1)] for b in range(4)]
    for rows in items:
        spark.createDataFrame(rows, "item_id string, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("item_id string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def stop(batch):
        calls.append(batch)
        if batch == 2 and calls.count(2) == 1:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        applied.started(stream, judge, f"{tmp_path}/out", f"{tmp_path}/c", stop).awaitTermination(120)
    assert applied.committed(spark, f"{tmp_path}/out") == [0, 1]
    applied.started(stream, judge, f"{tmp_path}/out", f"{tmp_path}/c", stop).awaitTermination(120)
    assert applied.committed(spark, f"{tmp_path}/out") == [0, 1, 2, 3] and calls == [0, 1, 2, 2, 3]
    got = {r.item_id: r for r in applied.results(spark, f"{tmp_path}/out").collect()}
    assert len(got) == applied.results(spark, f"{tmp_path}/out").count() == 42
    assert got["i0"].judge_failed and got["i0"].reason == "judge_error: gone" and not got["i0"].passed and got["i7"].passed and got["i7"].reason == ""
    assert applied.results(spark, f"{tmp_path}/none").count() == 0


def test_events_behind_the_last_reset_in_tables_of_any_size():
    """Of a micro-batch cut into tables, in any order and with events at the same time, the events are those behind the last reset, as if all were sorted at once; one table at a time is read."""
    rng = random.Random(3)
    for trial in range(150):
        n = rng.randrange(1, 30)
        rows = [(pd.Timestamp(rng.randrange(6), unit="s") if rng.random() > 0.05 else pd.NaT, rng.randrange(4), i, rng.random() < 0.15) for i in range(n)]
        whole = pd.DataFrame(rows, columns=["at", "request_id", "ms", "reset"])
        cut = sorted(rng.randrange(n) for _ in range(rng.randrange(5)))
        tables = [t.reset_index(drop=True) for a, b in zip([0, *cut], [*cut, n]) if len(t := whole.iloc[a:b])]
        given, alive = iter(tables), []
        last, live = harness._live(given)
        assert isinstance(live, Iterator)
        cleared = 0
        for c, t in live:
            cleared += c
            alive += t["ms"].tolist()
        whole = whole.sort_values(["at", "request_id"], kind="stable")
        resets = whole["reset"].to_numpy().nonzero()[0]
        assert sorted(alive) == sorted(whole["ms"].iloc[resets[-1] + 1 if len(resets) else 0 :]), trial
        assert cleared == bool(len(resets)) and (last == whole["at"].iloc[-1] or (pd.isna(last) and pd.isna(whole["at"].iloc[-1])))
