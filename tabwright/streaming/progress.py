"""Progress of running jobs: changes only, and the current state per job."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabwright.functions.exprs import c
from tabwright.functions.ordering import join_keys, previous_in_time

TERMINAL = ("succeeded", "failed")
STATE = ("completed", "total", "message", "log_length")


def emit_on_change(
    updates: DataFrame, job: str = "job", ts: str = "ts", tie: str = "seq", bucket_seconds: int = 60
) -> DataFrame:
    """Updates that differ from the job's previous one, up to its first terminal update.

    Terminal updates are always kept; everything after the first one is dropped.
    """
    is_end = c("state").isin(*TERMINAL)
    ends = updates.where(is_end).groupBy(c(job)).agg(F.min(F.struct(c(ts), c(tie))).alias("__end"))
    live = join_keys(updates, ends, [job]).where(
        F.col("__end").isNull() | (F.struct(c(ts), c(tie)) <= F.col("__end"))
    ).drop("__end")
    now = F.struct(*[c(x) for x in STATE])
    seen = previous_in_time(live, [job], ts, tie, now, "__was", bucket_seconds)
    changed = F.col("__was").isNull() | ~now.eqNullSafe(F.col("__was"))
    return seen.where(changed | is_end).drop("__was")


def latest_progress(updates: DataFrame, job: str = "job", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """(job, completed, total, message): the newest update per job; batch or stream (update mode)."""
    newest = F.max_by(
        F.struct("completed", "total", "message"), F.struct(c(ts), c(tie))
    ).alias("s")
    return updates.groupBy(c(job)).agg(newest).select(c(job), "s.*")


EMITTED = "job bigint, ts timestamp, seq bigint, state string, completed bigint, total bigint, message string, log_length bigint"
HELD = "array<struct<ts:bigint,seq:bigint,state:string,completed:bigint,total:bigint,message:string,log_length:bigint>>"
#: last: the state last emitted; newest: the place (microseconds, seq) of the last update taken in order
JOB_STATE = f"last string, ended boolean, newest_ts bigint, newest_seq bigint, held {HELD}"


def interval_micros(updates: DataFrame, interval: str) -> int:
    """An interval such as ``5 minutes`` in microseconds."""
    start = F.timestamp_seconds(F.lit(0))
    return int(updates.sparkSession.range(1).select(F.unix_micros(start + F.expr(f"INTERVAL {interval}"))).first()[0])


class JobProgress:
    """One job's progress between micro-batches: what was emitted last, and updates waiting for their turn."""

    def __init__(self, idle: int, delay: int, last: str | None = None, ended: bool = False, newest: tuple | None = None, held: list | None = None) -> None:
        self.idle, self.delay = idle, delay
        self.last, self.ended, self.newest, self.held = last, ended, newest, held or []

    def arrive(self, rows: list[tuple]) -> list[tuple]:
        """Takes in (ts, seq, state, ...) rows; those before an update already passed on come back as late."""
        late = [r for r in rows if self.newest is not None and r[:2] < self.newest]
        self.held = sorted(self.held + [r for r in rows if self.newest is None or r[:2] >= self.newest], key=lambda r: r[:2])
        return late

    def release(self, everything: bool = False) -> list[tuple]:
        """Held rows at least ``delay`` behind the newest, in order, without those that change nothing."""
        if not self.held:
            return []
        upto = self.held[-1][0] - self.delay
        n = len(self.held) if everything else sum(r[0] <= upto for r in self.held)
        out = []
        for r in self.held[:n]:
            if not self.ended and self.newest is not None and r[0] - self.newest[0] > self.idle:
                self.last = None  # silent for longer than idle: starts anew
            self.newest = r[:2]
            if self.ended:
                continue
            now = repr(r[3:])
            self.ended = r[2] in TERMINAL
            if now != self.last or self.ended:
                out.append(r)
                self.last = now
        self.held = self.held[n:]
        return out


def stream_updates(updates: DataFrame, idle: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """``emit_on_change`` on a stream of (job, ts, seq, state, completed, total, message, log_length), with ``late``.

    An update waits until its job has one ``delay`` newer (0: until its
    micro-batch ends), so updates out of order by no more than that give the
    batch answer. One that comes after a newer update of its job was passed on is
    returned with ``late`` true; it changes no state, and no row is dropped.
    Updates after a job's end, in order, are not changes and are not returned.

    A job silent for more than ``idle``, by the times of its updates, starts anew.
    State is cleared by arrival: a job from which nothing arrived for ``idle`` gives
    up what it holds and is forgotten; an ended one stays ended. The clock moves with
    the arriving data of all jobs. Null ``ts`` or ``seq`` counts as the earliest.
    """
    idle_us, delay_us = interval_micros(updates, idle), interval_micros(updates, delay)
    idle_ms = max(1, idle_us // 1000)

    def table(job: Any, rows: list[tuple], late: bool) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["ts", "seq", "state", *STATE])
        out["ts"] = pd.to_datetime(out["ts"], unit="us")
        out.insert(0, "job", job)
        out["late"] = late
        for x in ("seq", "completed", "total", "log_length"):
            out[x] = out[x].astype("Int64")
        return out

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = JobProgress(idle_us, delay_us)
        if state.exists:
            last, ended, ts, seq, held = state.get
            now = JobProgress(idle_us, delay_us, last, ended, None if ts is None else (ts, seq), [tuple(r) for r in held or []])
        if state.hasTimedOut:
            yield table(key[0], now.release(everything=True), False)
            if not now.ended:
                state.remove()
                return
        else:
            whole = lambda x: None if pd.isna(x) else int(x)
            rows, clock = [], 0
            for b in batches:
                clock = max(clock, int(b["clock"].max().timestamp() * 1000))
                b = b.astype({x: object for x in ("seq", *STATE)})
                for r in b.itertuples(index=False):
                    message = None if pd.isna(r.message) else r.message
                    rows.append((whole(r.micros) or 0, whole(r.seq) or 0, r.state, whole(r.completed), whole(r.total), message, whole(r.log_length)))
            late = now.arrive(rows)
            yield table(key[0], late, True)
            yield table(key[0], now.release(), False)
        newest = now.newest or (None, None)
        state.update((now.last, now.ended, *newest, now.held))
        if not now.ended or now.held:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0 if state.hasTimedOut else clock) + idle_ms)

    # the watermark follows arrival, not ``ts``: Spark then takes no update for late and drops none
    arriving = updates.select(
        "job", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "seq", "state", *STATE,
        F.current_timestamp().alias("clock"),
    ).withWatermark("clock", "0 seconds")
    return arriving.groupBy("job").applyInPandasWithState(
        step, f"{EMITTED}, late boolean", JOB_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_changes(updates: DataFrame, idle: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """The changes of ``stream_updates`` alone, without late updates."""
    return stream_updates(updates, idle, delay).where(~F.col("late")).drop("late")


def write_with_late(changes_path: str, late_path: str):
    """A ``foreachBatch`` function for ``stream_updates``: changes to one table, late updates to a side table.

    Both are partitioned by micro-batch and a batch run again overwrites its own
    folder, so a restart neither loses nor repeats a row. ``late_counts`` counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(~F.col("late")).drop("late").write.mode("overwrite").parquet(f"{changes_path}/batch={number}")
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.unpersist()

    return write


def late_counts(late: DataFrame) -> DataFrame:
    """(job, n_late, first_ts, last_ts) of a late side table."""
    return late.groupBy("job").agg(F.count(F.lit(1)).alias("n_late"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


__all__: Any = [x for x in dir() if not x.startswith("_")]
