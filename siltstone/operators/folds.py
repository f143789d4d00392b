"""Ordered folds with feedback: quotas, health, budgets, rates.

A decision here depends on earlier decisions (a denied request is not counted, a recovery clears history),
so no window frame expresses it. ``ordered_fold`` sends a key's rows to one task in order and carries a
small state from row to row across Arrow batches: memory is one batch and one state, however many rows a
key has. Keys are independent and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.core import let


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], init: Callable[[], Any], step: Callable[[Any, dict], dict], added: str, uses: list[str] | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (DDL) that ``step(state, row)`` returns for every row, key by key, in order.

    ``step`` changes the state in place and sees the columns ``uses`` (all by default); the others pass by as Arrow arrays. Rows with a null key form a
    key of their own.
    """
    fields = T.StructType.fromDDL(added).fields
    base = df.select(*[c for c in df.columns if c not in {f.name for f in fields}])
    sorted_rows = base.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*base.schema.fields, *fields])
    names, uses = [f.name for f in fields], base.columns if uses is None else uses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        key: Any = object()
        state = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            lists = [batch.column(c).to_pylist() for c in (*keys, *uses)]
            for values in zip(*lists, strict=True):
                now = values[: len(keys)]
                if now != key:
                    key, state = now, init()
                made = step(state, dict(zip(uses, values[len(keys) :], strict=True)))
                for column, name in zip(out, names, strict=True):
                    column.append(made.get(name))
            arrays = [*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    return sorted_rows.mapInArrow(run, schema)


# --- rolling quota ---------------------------------------------------------------------------------------------


@dataclass
class Quota:
    """Admitted entries of one tenant, oldest first, and their sum."""

    admitted: list[tuple[int, int]] = field(default_factory=list)
    head: int = 0
    used: int = 0

    def ask(self, at: int, n: int, limit: int, window: int) -> dict:
        while self.head < len(self.admitted) and self.admitted[self.head][0] <= at - window:
            self.used -= self.admitted[self.head][1]
            self.head += 1
        if self.head > 1_000:
            del self.admitted[: self.head]
            self.head = 0
        if self.used + n > limit:
            wait = max(0, self.admitted[self.head][0] + window - at) if self.head < len(self.admitted) else None
            return {"ok": False, "code": "bulk_quota_exceeded", "used": self.used, "retry_after_ms": wait}
        self.admitted.append((at, n))
        self.used += n
        return {"ok": True, "code": None, "used": self.used, "retry_after_ms": None}


QUOTA = "ok boolean, code string, used long, retry_after_ms long"


def quota_admission(df: DataFrame, tenant: str, at_ms: str, seeds: str, order: list[str] | None = None, limit: int = 300, window_ms: int = 60_000) -> DataFrame:
    """Admission of every request in a rolling window per tenant; denied requests are not counted, a request
    without a tenant is refused. An entry as old as the window has expired."""

    def step(state: Quota, row: dict) -> dict:
        if row[tenant] is None or row[tenant] == "":
            return {"ok": False, "code": "bulk_quota_store_error"}
        return state.ask(row[at_ms], row[seeds], limit, window_ms)

    return ordered_fold(df, [tenant], [at_ms, *(order or [])], Quota, step, QUOTA, list(dict.fromkeys([tenant, at_ms, seeds])))


# --- model health ----------------------------------------------------------------------------------------------

HEALTH_WINDOW, HEALTH_FAILS, HEALTH_RECOVERY = 5, 3, 2


@dataclass
class Health:
    recent: list[bool] = field(default_factory=list)
    streak: int = 0
    demotion: int = 0

    def record(self, outcome: str) -> int:
        """Demotion after one more outcome: success, hard_fail, or anything softer, which changes nothing."""
        if outcome in ("success", "hard_fail"):
            failed = outcome == "hard_fail"
            self.recent = [*self.recent, failed][-HEALTH_WINDOW:]
            self.streak = 0 if failed else self.streak + 1
            if failed and sum(self.recent) >= HEALTH_FAILS:
                self.demotion = 1
            elif self.demotion and self.streak >= HEALTH_RECOVERY:
                self.recent, self.streak, self.demotion = [], 0, 0
        return self.demotion


def model_health(df: DataFrame, model: str, order: list[str], outcome: str) -> DataFrame:
    """``df`` with the demotion (0 or 1) of its model after each outcome."""
    return ordered_fold(df, [model], order, Health, lambda state, row: {"demotion": state.record(row[outcome])}, "demotion int", [outcome])


# --- budgets ---------------------------------------------------------------------------------------------------

MIB = 1024 * 1024
#: Rows that one task sums where sums need no feedback, and stretches at most.
CHUNK, MAX_STRETCHES = 100_000, 2_000


@dataclass
class Budget:
    """Bytes and cost of one batch, one seed settling before the next starts."""

    bytes: int = 0
    cost: float = 0.0
    stopped: bool = False
    raw_only: bool = False


BUDGET = "dispatch boolean, run_transform boolean, reason string, bytes_so_far long, cost_so_far double"


def sequential_budget(
    df: DataFrame, batch: str, order: list[str], bytes_col: str, cost_col: str, per_seed: int = 5 * MIB, cap: int = 100 * MIB,
    cost_per_seed: float = 0.05, cost_cap: float = 0.5,
) -> DataFrame:
    """Which seeds of a batch are fetched, and which may pay for a transform, under both caps.

    A seed needs room for a whole page (equality is allowed). Bytes that pass the cap end the batch; cost
    that passes its cap lets later seeds run without a transform. A zero cost cap admits no transform.
    """

    def step(s: Budget, row: dict) -> dict:
        fits = not s.stopped and s.bytes + per_seed <= cap
        if not fits:
            return {"dispatch": False, "run_transform": False, "reason": "egress_bytes", "bytes_so_far": s.bytes, "cost_so_far": s.cost}
        transform = not s.raw_only and cost_per_seed > 0 and s.cost + cost_per_seed <= cost_cap
        s.bytes += row[bytes_col] or 0
        reason = None
        if transform:
            s.cost += row[cost_col] or 0.0
            if s.cost > cost_cap:
                s.raw_only, reason = True, "transform_cost"
        if s.bytes > cap:
            s.stopped, reason = True, reason or "egress_bytes"
        return {"dispatch": True, "run_transform": transform, "reason": reason, "bytes_so_far": s.bytes, "cost_so_far": s.cost}

    return ordered_fold(df, [batch], order, Budget, step, BUDGET, [bytes_col, cost_col])


def chunked(df: DataFrame, order: str, rows: int) -> Column:
    """A number that deals rows into stretches of a whole-number ``order`` column, about ``rows`` each however unevenly its values lie.

    Stretches end at quantiles of all rows, of which there are at most ``MAX_STRETCHES``; a key with many rows has its share of them. Nulls are in the first one.
    """
    most = min(MAX_STRETCHES, -(-df.count() // rows))
    ends = sorted(set(df.approxQuantile(order, [k / most for k in range(1, most)], 0.25 / most))) if most > 1 else []
    if not ends:
        return F.lit(0).cast("long")
    value, bounds = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))), F.array(*[F.lit(x) for x in ends])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        step = lambda m: F.when(F.get(bounds, m) <= value, F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high")))
        return F.when(s["low"] < s["high"], let(middle, step)).otherwise(s)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(ends)).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(ends).bit_length())), start, halve)["low"].cast("long")


def running_bytes(df: DataFrame, batch: str, order: str, bytes_col: str, per_seed: int, cap: int, chunk: int = CHUNK) -> DataFrame:
    """The byte budget where every settled size is at most a page: then no feedback is left and sums do it.

    Sums of stretches of a batch are put in order first, and rows are summed within their stretch, so a batch of any size is
    many tasks. ``order`` is a whole number.
    """
    dealt = df.withColumn("__c", chunked(df, order, chunk))
    sums = dealt.groupBy(batch, "__c").agg(F.coalesce(F.sum(bytes_col), F.lit(0)).alias("__s"))
    upto = F.coalesce(F.sum("__s").over(Window.partitionBy(batch).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col(batch).alias("__b"), F.col("__c").alias("__d"), upto.alias("__o"))
    joined = dealt.join(offsets, F.col(batch).eqNullSafe(F.col("__b")) & F.col("__c").eqNullSafe(F.col("__d")))
    inside = F.coalesce(F.sum(bytes_col).over(Window.partitionBy(batch, "__c").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = joined.withColumn("bytes_before", (F.col("__o") + inside).cast("long")).withColumn("dispatch", F.col("bytes_before") + per_seed <= cap)
    return out.drop("__b", "__c", "__d", "__o")


# --- rates -----------------------------------------------------------------------------------------------------


@dataclass
class Bucket:
    tokens: float | None = None
    at: float = 0.0


def token_bucket(df: DataFrame, host: str, at_ms: str, order: list[str] | None = None, burst: int = 2, refill_ms: int = 1000) -> DataFrame:
    """When each request to a host may start: a burst at once, then one per ``refill_ms``; requests wait in order."""

    def step(b: Bucket, row: dict) -> dict:
        start = float(row[at_ms])
        if b.tokens is None:
            b.tokens, b.at = burst - 1.0, start
            return {"start_ms": int(start), "waited_ms": 0}
        now = max(start, b.at)
        have = min(float(burst), b.tokens + (now - b.at) / refill_ms)
        if have < 1:
            now += -(-(1 - have) * refill_ms // 1)
            have = min(float(burst), b.tokens + (now - b.at) / refill_ms)
        b.tokens, b.at = have - 1, now
        return {"start_ms": int(now), "waited_ms": int(now - start)}

    return ordered_fold(df, [host], [at_ms, *(order or [])], Bucket, step, "start_ms long, waited_ms long", [at_ms])


def request_starts(df: DataFrame, host: str, at_ms: str, order: list[str] | None = None, burst: int = 2, refill_ms: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """``token_bucket`` in whole milliseconds, without a fold: for hosts of any number of requests.

    Request i starts at the latest of its own time and of t(j) + (i - j - burst + 1) * refill over all requests j up to i, which is a
    running maximum of t(j) - j * refill. Stretches of a host are numbered and their maxima put in order first, so
    a host of any size is many tasks. Times are whole milliseconds.
    """
    ties = [at_ms, *(order or [])]
    dealt = df.withColumn("__c", chunked(df, at_ms, chunk))
    local = Window.partitionBy(host, "__c").orderBy(*ties)
    numbered = dealt.withColumn("__i", F.row_number().over(local))
    debt = F.col(at_ms) - F.col("__i") * refill_ms
    tops = numbered.groupBy(host, "__c").agg(F.count("*").alias("__n"), F.max(debt).alias("__m"))
    before = Window.partitionBy(host).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    shifted = tops.withColumn("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    shifted = shifted.withColumn("__t", F.max(F.col("__m") - F.col("__p") * refill_ms).over(before))
    offsets = shifted.select(F.col(host).alias("__h"), F.col("__c").alias("__d"), "__p", "__t")
    joined = numbered.join(offsets, F.col(host).eqNullSafe(F.col("__h")) & F.col("__c").eqNullSafe(F.col("__d")))
    top = F.greatest(F.col("__t"), F.max(debt).over(local) - F.col("__p") * refill_ms)
    start = F.greatest(F.col(at_ms), top + (F.col("__p") + F.col("__i") - burst + 1) * refill_ms).cast("long")
    out = joined.withColumn("start_ms", start).withColumn("waited_ms", (F.col("start_ms") - F.col(at_ms)).cast("long"))
    return out.drop("__c", "__i", "__h", "__d", "__p", "__t")


# --- render pools ----------------------------------------------------------------------------------------------


@dataclass
class Pools:
    essential: int = 0
    other: int = 0


def render_pools(df: DataFrame, render: str, order: list[str], size: str, essential: str, essential_cap: int = 48 * MIB, other_cap: int = 5 * MIB) -> DataFrame:
    """Which subresources of a render fit its two pools: an essential one may cross its cap once, another may not."""

    def step(p: Pools, row: dict) -> dict:
        n = row[size] or 0
        if row[essential]:
            fits = p.essential < essential_cap
            p.essential += n if fits else 0
        else:
            fits = p.other + n <= other_cap
            p.other += n if fits else 0
        return {"fits": fits, "essential_bytes": p.essential, "other_bytes": p.other}

    return ordered_fold(df, [render], order, Pools, step, "fits boolean, essential_bytes long, other_bytes long", [size, essential])


# --- batch runner ----------------------------------------------------------------------------------------------


@dataclass
class Runner:
    budget: Budget = field(default_factory=Budget)
    touches: dict[str, int] = field(default_factory=dict)
    closed: set[str] = field(default_factory=set)
    asked: dict[str, tuple[int, int]] = field(default_factory=dict)  # by host: requests, and the greatest of time - number * delay
    rendered: int = 0
    clock: int = 0


RUNNER = "outcome string, reason string, started_ms long, bytes_so_far long, cost_so_far double, transformed boolean, rendered boolean, quarantined array<string>"


def run_batch(
    df: DataFrame, batch: str, order: list[str], host_cap: int = 10, per_seed: int = 5 * MIB, cap: int = 100 * MIB, wall_ms: int = 55_000,
    burst: int = 2, delay_ms: int = 1_000, cost_per_seed: float = 0.05, cost_cap: float = 0.5, render_cap: int = 10, render_bytes: int = 48 * MIB,
) -> DataFrame:
    """The sequential schedule of a batch over columns host, hosts (all that the fetch touches), bytes, duration_ms, cost, renders.

    For each seed in order: wall clock, byte stop, its own host's count, the host's rate, the wall clock again (a wait may pass it),
    reservation of a page's bytes, of a transform's cost (else it runs raw), and of a render (else it runs without). Then it runs; what it
    really took is settled, its hosts are counted once each, and a host other than its own that reaches the cap closes for
    later seeds. Reservations are given back with the settling. Bytes that pass the cap end the batch, cost that passes its cap lets
    later seeds run raw. Hosts of one batch are few (a batch has at most some hundred seeds), so the state stays small.
    """

    def step(r: Runner, row: dict) -> dict:
        made = {
            "bytes_so_far": r.budget.bytes, "cost_so_far": r.budget.cost, "quarantined": sorted(r.closed), "started_ms": None, "transformed": False, "rendered": False,
        }
        skipped = lambda why: made | {"outcome": "skipped", "reason": why}
        host = row["host"]
        if r.clock >= wall_ms:
            return skipped("bulk_deadline_exceeded")
        if r.budget.stopped:
            return skipped("bulk_budget_exceeded")
        if host in r.closed or r.touches.get(host, 0) >= host_cap:
            return skipped("bulk_per_host_cap")
        n, top = r.asked.get(host, (0, r.clock))
        n, top = n + 1, max(top, r.clock - (n + 1) * delay_ms) if n else r.clock - delay_ms
        start = max(r.clock, top + (n - burst + 1) * delay_ms)  # as in request_starts
        if start >= wall_ms:
            return skipped("bulk_deadline_exceeded")
        if r.budget.bytes + per_seed > cap:
            r.budget.stopped = True
            return skipped("bulk_budget_exceeded")
        r.asked[host] = n, top
        transform = row["cost"] is not None and not r.budget.raw_only and cost_per_seed > 0 and r.budget.cost + cost_per_seed <= cost_cap
        render = bool(row["renders"]) and r.rendered < render_cap and r.budget.bytes + per_seed + render_bytes <= cap
        r.rendered += render
        r.clock = start + (row["duration_ms"] or 0)
        r.budget.bytes += row["bytes"] or 0
        r.budget.stopped = r.budget.bytes > cap
        if transform:
            r.budget.cost += row["cost"]
            r.budget.raw_only = r.budget.cost > cost_cap
        for touched in dict.fromkeys(row["hosts"] or []):
            r.touches[touched] = r.touches.get(touched, 0) + 1
            if touched != host and r.touches[touched] >= host_cap:
                r.closed.add(touched)
        return {
            "outcome": "ran", "reason": None, "started_ms": start, "bytes_so_far": r.budget.bytes, "cost_so_far": r.budget.cost, "transformed": transform, "rendered": render,
            "quarantined": sorted(r.closed),
        }

    return ordered_fold(df, [batch], order, Runner, step, RUNNER, ["host", "hosts", "bytes", "duration_ms", "cost", "renders"])
