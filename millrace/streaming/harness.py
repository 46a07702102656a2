"""Metrics of a service as keyed state: rolling failure rates of a harness, and counters of requests.

Both are streams of events with a key (a model, a server), an order (at, request_id) and a reset flag; a reset clears the
key's state and is not counted itself. State lives in the state store, so that it survives a restart from the checkpoint; saved() reads
it from there, and a saved table can start another stream (load). Each has a batch twin of windows and
groupings.

Events are ordered within a micro-batch; of requests, those that wait for its last reset do so in a file. A key's state is bounded: SIZE masks, one count for each latency in milliseconds
and for each tool. With ttl_ms a key's state goes when it had no event for so long (processing time).

Defined results: null flags are false, null violations none; events of a null key form a key of their own; an event that
repeats counts again; an empty stream gives no rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

SIZE = 50
#: Rows of rates that are given on at once.
ROWS = 10_000
#: Principles whose failures are counted, the share that calls for a reminder, and the reminders. Fixed values.
PRINCIPLES = ("P1", "P3", "P4", "P18", "P20", "P21")
THRESHOLD = 0.30
REMINDERS = {
    "P1": "**CRITICAL: Every response MUST open with <think> containing First Principles decomposition + 5W+H scan, then close </think> before any tool calls or <answer>. This is non-negotiable.**",
    "P3": "**CRITICAL: Only call tools explicitly listed as ✓ in the session profile. Never invent tool names.**",
    "P4": "**CRITICAL: Any question requiring numeric computation MUST use python_execute. MATH = CODE.**",
    "P18": "**CRITICAL: Every response MUST end with <answer>...</answer>. Never omit the answer block.**",
}
REMINDERS_HEAD = "⚠ HARNESS ADAPTATION (principles currently failing):"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PERCENTILES = (50, 95, 99)

RATES = "key string, request_id long, requests long, retries long, retry_success_rate double, rates array<double>"
METRICS = "key string, at timestamp, total long, ok long, error long, p50 double, p95 double, p99 double, tokens long, tokens_per_request double, tools map<string,long>"


def violated(violations: Column) -> Column:
    """Codes (with a note behind a colon or not) as a mask: bit i is 1 where the i-th of PRINCIPLES is broken."""
    name = lambda v: F.regexp_replace(F.trim(F.substring_index(v, ":", 1)), r"(?i)^PRINCIPLE_(\d+).*$", "P$1")
    names = F.transform(F.coalesce(violations, F.array().cast("array<string>")), name)
    return sum((F.when(F.array_contains(names, p), 1 << i).otherwise(0) for i, p in enumerate(PRINCIPLES)), F.lit(0)).cast("int")


def adapting(rates: Column) -> Column:
    """The principles of the rates (in order of PRINCIPLES) that call for a reminder."""
    return F.array_compact(F.array(*[F.when(F.get(rates, F.lit(i)) >= THRESHOLD, p) for i, p in enumerate(PRINCIPLES)]))


def suffix(adapts: Column) -> Column:
    """What is put behind a prompt for the principles that fail; empty if none does."""

    def line(p: Column) -> Column:
        out = F.concat(F.lit("**"), p, F.lit(": Review the constitution.**"))
        for name, text in REMINDERS.items():
            out = F.when(p == name, text).otherwise(out)
        return out

    return F.when(F.size(adapts) > 0, F.concat(F.lit(f"\n{REMINDERS_HEAD}\n"), F.array_join(F.transform(adapts, line), "\n"))).otherwise("")


def _records(rows: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.select("key", "request_id", "at", violated(F.col("violations")).alias("mask"), flag("retried"), flag("cleared"), flag("reset"))


class _Rates(StatefulProcessor):
    """Per key the last SIZE masks (with the bits that are known) and three counters."""

    def __init__(self, size: int, ttl_ms: int | None) -> None:
        self.size, self.ttl = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "mask int, known int", self.ttl)
        self.counts = handle.getValueState("counts", "requests long, retries long, cleared long", self.ttl)

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: object) -> None:
        for r in initial.itertuples():
            n = int(max(r.checks, default=0))
            # What was saved has no order: failures come first, then passes; shorter windows end where the longest does.
            rows = []
            for at in range(n):
                here = [(i, at - (n - int(c))) for i, c in enumerate(r.checks) if at >= n - int(c)]
                rows.append((sum(1 << i for i, k in here if k < int(r.failures[i])), sum(1 << i for i, _ in here)))
            if rows:
                self.window.put(rows[-self.size :])
            rate = 0.0 if r.retry_success_rate is None or pd.isna(r.retry_success_rate) else float(r.retry_success_rate)
            self.counts.update((int(r.requests), int(r.retries), round(rate * int(r.retries))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last = [tuple(r) for r in self.window.get()]
        requests, retries, cleared = self.counts.get() or (0, 0, 0)
        full, out, names = (1 << len(PRINCIPLES)) - 1, [], ["key", "request_id", "requests", "retries", "retry_success_rate", "rates"]
        for r in pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable").itertuples():
            if r.reset:
                last, requests, retries, cleared = [], 0, 0, 0
                continue
            requests, retries, cleared = requests + 1, retries + bool(r.retried), cleared + bool(r.cleared)
            last = [*last, (int(r.mask), full)][-self.size :]
            share = lambda i: sum(m >> i & 1 for m, _ in last) / sum(k >> i & 1 for _, k in last)  # noqa: B023, E731
            out.append((key[0], r.request_id, requests, retries, round(cleared / retries, 3) if retries else None, [share(i) for i in range(len(PRINCIPLES))]))
            if len(out) == ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        self.window.put(last) if last else self.window.clear()
        self.counts.update((requests, retries, cleared))
        yield pd.DataFrame(out, columns=names)


def _time_mode(ttl_ms: int | None) -> str:
    return "None" if ttl_ms is None else "ProcessingTime"


def rates_stream(records: DataFrame, size: int = SIZE, ttl_ms: int | None = None, saved_state: DataFrame | None = None) -> DataFrame:
    """records (key, request_id, at, violations, retried, cleared, reset) as a stream: after each, the key's counters and the failure rate of every principle over its last size records.

    saved_state: rows that saved_rates() gave, from which keys start.
    """
    start = saved_state.groupBy("key") if saved_state is not None else None
    return _records(records).groupBy("key").transformWithStateInPandas(_Rates(size, ttl_ms), RATES, "Append", _time_mode(ttl_ms), start)


def rates_batch(records: DataFrame, size: int = SIZE) -> DataFrame:
    """The same over a table. A key's records are one window partition."""
    by = Window.partitionBy("key").orderBy("at", "request_id")
    rows = _records(records).withColumn("epoch", F.sum(F.col("reset").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("reset"))
    own = Window.partitionBy("key", "epoch").orderBy("at", "request_id")
    so_far, last = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1 - size, 0)
    sums = {"retries": F.sum(F.col("retried").cast("long")).over(so_far), "n_cleared": F.sum(F.col("cleared").cast("long")).over(so_far)}
    rates = [F.avg(F.col("mask").bitwiseAND(F.lit(1 << i)).cast("boolean").cast("double")).over(last) for i in range(len(PRINCIPLES))]
    rows = rows.withColumns({"requests": F.row_number().over(own).cast("long"), **sums, "rates": F.array(*rates)})
    return rows.select("key", "request_id", "requests", "retries", F.round(F.try_divide("n_cleared", "retries"), 3).alias("retry_success_rate"), "rates")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def saved_rates(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream of rates has in its state at its last commit: key, requests, retries, retry_success_rate, checks, failures (by principle) and the principles that call for a reminder."""
    bit = lambda field, i: F.sum((F.col(field).bitwiseAND(F.lit(1 << i)) != 0).cast("long"))
    each = _state(spark, checkpoint, "window").select("key", F.col("list_element.mask").alias("mask"), F.col("list_element.known").alias("known"))
    n = range(len(PRINCIPLES))
    windows = each.groupBy("key").agg(F.array(*[bit("known", i) for i in n]).alias("checks"), F.array(*[bit("mask", i) for i in n]).alias("failures"))
    counts = _state(spark, checkpoint, "counts").select("key", "value.*")
    none = F.array(*[F.lit(0).cast("long") for _ in n])
    rows = counts.join(windows, "key", "left").withColumns({"checks": F.coalesce("checks", none), "failures": F.coalesce("failures", none)})
    rates = F.zip_with("failures", "checks", lambda f, c: F.coalesce(F.try_divide(f, c), F.lit(0.0)))
    return rows.select(F.col("key.key").alias("key"), "requests", "retries", F.round(F.try_divide("cleared", "retries"), 3).alias("retry_success_rate"), "checks", "failures", adapting(rates).alias("adapts"))


def _ordered(*tables: pd.DataFrame) -> pd.DataFrame:
    """By order of events; of those of equal order the first table's come first."""
    return pd.concat(tables).sort_values(["at", "request_id"], kind="stable")


def _live(rows: Iterator[pd.DataFrame]) -> tuple[pd.Timestamp, Iterator[tuple[bool, pd.DataFrame]]]:
    """When the last of a key's events was, and the events behind the last reset, table by table, each with whether the key is cleared before it (the first one, if there was a reset).

    A reset may come in any of the tables, so events that none seen so far has cleared wait in a file: one table at a time is in memory, however many events the key has.
    """
    file, last, reset, reset_in, n = tempfile.TemporaryFile(), None, None, -1, 0
    for table in rows:
        table = _ordered(*[t for t in (reset, table) if t is not None])
        at = table["at"].iloc[-1]
        last = at if last is None or pd.isna(at) or (not pd.isna(last) and at > last) else last
        resets = table["reset"].to_numpy(bool).nonzero()[0]
        if len(resets):
            before, reset = reset, table.iloc[resets[-1] : resets[-1] + 1]
            table = table.iloc[resets[-1] + 1 :]
            # The reset of an earlier table is in this one, too.
            if before is None or not reset.index.equals(before.index):
                reset_in = n
                reset = reset.set_axis([f"reset {n}"])
        pickle.dump(table, file)
        n += 1

    def live() -> Iterator[tuple[bool, pd.DataFrame]]:
        if reset is not None:
            yield True, reset.iloc[:0]
        file.seek(0)
        for i in range(n):
            table = pickle.load(file)
            if reset is not None and i < reset_in:
                table = _ordered(table, reset)
                table = table.iloc[table["reset"].to_numpy(bool).nonzero()[0][-1] + 1 :]
            yield False, table
        file.close()

    return last, live()


class _Requests(StatefulProcessor):
    """Per key four counters, how many good requests took each number of milliseconds, and calls by tool."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total long, ok long, tokens long", self.ttl)
        self.took = handle.getMapState("took", "ms long", "n long", self.ttl)
        self.tools = handle.getMapState("tools", "tool string", "n long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        total, ok, tokens = self.counts.get() or (0, 0, 0)
        took, tools = ({k[0]: n[0] for k, n in state.iterator()} for state in (self.took, self.tools))
        changed = (set(), set())
        last, live = _live(rows)
        for cleared, table in live:
            if cleared:
                total, ok, tokens, took, tools = 0, 0, 0, {}, {}
                self.took.clear()
                self.tools.clear()
            good = table[table["ok"].astype(bool)]
            total, ok, tokens = total + len(table), ok + len(good), tokens + int(good["tokens"].sum())
            for ms, n in good["ms"].value_counts().items():
                took[int(ms)] = took.get(int(ms), 0) + int(n)
                changed[0].add(int(ms))
            for calls in good["tools"]:
                for tool, n in calls.items() if isinstance(calls, dict) else calls:
                    tools[tool] = tools.get(tool, 0) + int(n)
                    changed[1].add(tool)
        for state, values, names in ((self.took, took, changed[0]), (self.tools, tools, changed[1])):
            for name in names:
                state.updateValue((name,), (values[name],))
        self.counts.update((total, ok, tokens))
        at = [max(0, min(ok * p // 100, ok - 1)) for p in PERCENTILES]
        found, before = dict.fromkeys(at, 0.0), 0
        for ms in sorted(took):
            found |= {k: ms / 1000 for k in at if before <= k < before + took[ms]}
            before += took[ms]
        row = (key[0], last, total, ok, total - ok, *[found[k] for k in at], tokens, round(tokens / ok, 1) if ok else 0.0, tools)
        yield pd.DataFrame([row], columns=["key", "at", "total", "ok", "error", "p50", "p95", "p99", "tokens", "tokens_per_request", "tools"])


def _requests(rows: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    tools = F.coalesce("tools", F.create_map().cast("map<string,long>")).cast("map<string,long>")
    ms = F.round(F.coalesce("latency", F.lit(0.0)) * 1000).cast("long")
    return rows.select("key", "request_id", "at", ms.alias("ms"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), tools.alias("tools"), flag("ok"), flag("reset"))


def requests_stream(records: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """records (key, request_id, at, latency in seconds, tokens, tools: map of calls, ok, reset) as a stream: after each micro-batch, the metrics of every key in it since its last reset."""
    return _requests(records).groupBy("key").transformWithStateInPandas(_Requests(ttl_ms), METRICS, "Update", _time_mode(ttl_ms))


def requests_batch(records: DataFrame) -> DataFrame:
    """The same over a table: one row a key that has an event. Percentiles come from counts by millisecond, so no key's latencies meet in one task before they are counted."""
    rows = _requests(records)
    order = F.struct("at", "request_id")
    ends = rows.groupBy("key").agg(F.max(F.when(F.col("reset"), order)).alias("since"), F.max("at").alias("at"))
    live = rows.join(ends.select(F.col("key").alias("k"), "since"), F.col("key").eqNullSafe(F.col("k"))).filter(~F.col("reset") & (F.col("since").isNull() | (order > F.col("since")))).drop("k", "since")
    sums = live.groupBy("key").agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.sum(F.when(F.col("ok"), F.col("tokens")).otherwise(0)).alias("tokens"))
    w = Window.partitionBy("key")
    counted = live.filter("ok").groupBy("key", "ms").agg(F.count("*").alias("n"))
    counted = counted.select("key", "ms", "n", F.sum("n").over(w.orderBy("ms")).alias("upto"), F.sum("n").over(w).alias("all"))
    place = lambda p: F.least(F.floor(F.col("all") * p / 100), F.col("all") - 1)
    at = [F.max(F.when((F.col("upto") > place(p)) & (F.col("upto") - F.col("n") <= place(p)), F.col("ms") / 1000)).alias(f"p{p}") for p in PERCENTILES]
    calls = live.filter("ok").select("key", F.explode("tools").alias("tool", "n")).groupBy("key", "tool").agg(F.sum("n").alias("n"))
    calls = calls.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    out = ends.select("key", "at")
    for k, part in enumerate((sums, counted.groupBy("key").agg(*at), calls)):
        out = out.join(part.withColumnRenamed("key", f"k{k}"), F.col("key").eqNullSafe(F.col(f"k{k}")), "left").drop(f"k{k}")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("key", "at", zero("total", 0), zero("ok", 0), F.coalesce(F.col("total") - F.col("ok"), F.lit(0)).alias("error"), *[zero(f"p{p}", 0.0) for p in PERCENTILES], zero("tokens", 0), F.coalesce(F.round(F.try_divide("tokens", "ok"), 1), F.lit(0.0)).alias("tokens_per_request"), F.coalesce("tools", F.create_map().cast("map<string,long>")).alias("tools"))


def started(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A run of a stateful stream over what there is now; each micro-batch's rows go to Parquet files of their own at path, and a later run goes on from the checkpoint."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def add(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(add).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, schema: StructType | str, path: str) -> DataFrame:
    """The rows of a stream's runs, with the micro-batch that gave them."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)


def latest(rows: DataFrame, by: str) -> DataFrame:
    """Of written rows, the last micro-batch's for each key."""
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(by).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")
