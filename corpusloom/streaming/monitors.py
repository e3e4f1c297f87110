"""Streams: stateless gates, bounded duplicate removal, a health monitor and a curriculum with state, log parsing."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import textfn as X


def deduplicated(docs: DataFrame, event_time: str, delay: str) -> DataFrame:
    """The first of equal texts within ``delay`` of event time: state is bounded by time, not by the stream's length."""
    return docs.withColumn("text_key", X.text_key(F.col("text"))).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["text_key"])


def log_metrics(lines: DataFrame, value: str = "value") -> DataFrame:
    """step and named metrics of training log lines such as ``step 120 | loss 2.31 | lr 3e-4``; other lines fall away."""
    number = "([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    pick = lambda name: F.nullif(F.regexp_extract(value, f"(?:^|[^a-z_]){name}[ =:]+{number}", 1), F.lit("")).try_cast("double")
    names = ("loss", "lr", "grad_norm", "tok_s", "val_loss", "bpb")
    return lines.select(pick("step").cast("long").alias("step"), *[pick(n).alias(n) for n in names]).where("step IS NOT NULL")


@dataclass(frozen=True)
class Limits:
    """Fixed values of the health guards."""

    explosion: float = 50.0
    explosion_k: int = 3
    collapse: float = 1e-5
    collapse_k: int = 10
    spike: float = 3.0
    spike_window: int = 20
    rate_share: float = 0.3
    rate_warmup: int = 5
    rate_k: int = 3
    val_k: int = 5
    bits_increase: float = 0.20
    bits_k: int = 2
    bits_lookback: int = 4
    bits_warmup: int = 2
    memory_warn: float = 0.95
    memory_stop: float = 0.98
    write_factor: float = 3.0
    write_window: int = 5
    backup_k: int = 3


HEALTH_OUT = "run string, step long, alert string"
#: JSON: counters, peaks and bounded windows of a run.
HEALTH_STATE = "state string"


def fresh() -> dict:
    return {"explosions": 0, "collapses": 0, "losses": [], "rate_peak": 0.0, "slow": 0, "val_rises": 0, "val_last": None, "bits": {}, "writes": [], "backups": 0, "stopped": False}


def given(row, name: str):
    """A column's value, None where there is no such column or value."""
    x = getattr(row, name, None)
    return None if x is None or (isinstance(x, float) and x != x) else x


def health_step(state: dict, row, limits: Limits) -> list[str]:
    """One row's alerts; the state is brought forward.  A stop is final: later rows are still counted and never clear it.

    Guards look at the columns that are there: grad_norm, loss, rate (tokens a second), val_loss, bits (a byte, by
    language), memory (share of all), write_seconds, backup_ok.
    """
    alerts = []

    def stop(what: str) -> None:
        alerts.append(f"stop: {what}")
        state["stopped"] = True

    if (x := given(row, "grad_norm")) is not None:
        state["explosions"] = state["explosions"] + 1 if x > limits.explosion else 0
        state["collapses"] = state["collapses"] + 1 if x < limits.collapse else 0
        if state["explosions"] >= limits.explosion_k:
            stop("gradient explosion")
        if state["collapses"] >= limits.collapse_k:
            alerts.append("warn: gradient collapse")
    losses = state["losses"]
    if (x := given(row, "loss")) is not None:
        if len(losses) >= 4 and (mean := sum(losses) / len(losses)) > 0 and x > mean * limits.spike:
            alerts.append("warn: loss spike")
        losses = state["losses"] = [*losses, float(x)][-max(8, limits.spike_window) :]
    if (x := given(row, "rate")) is not None:
        state["rate_peak"] = max(state["rate_peak"], float(x))
        if len(losses) >= limits.rate_warmup:
            state["slow"] = state["slow"] + 1 if x < state["rate_peak"] * limits.rate_share else 0
            if state["slow"] >= limits.rate_k:
                alerts.append("warn: throughput collapse")
    if (x := given(row, "val_loss")) is not None:
        state["val_rises"] = state["val_rises"] + 1 if state["val_last"] is not None and x > state["val_last"] else 0
        state["val_last"] = float(x)
        if state["val_rises"] >= limits.val_k:
            stop("validation loss rises")
    for lang, x in sorted((given(row, "bits") or {}).items()):
        held = state["bits"].setdefault(lang, {"seen": 0, "last": [], "worse": 0})
        worse = held["seen"] >= limits.bits_warmup and bool(held["last"]) and x - min(held["last"]) >= limits.bits_increase
        held["worse"] = held["worse"] + 1 if worse else 0
        held["seen"] += 1
        held["last"] = [*held["last"], float(x)][-limits.bits_lookback :]
        if held["worse"] >= limits.bits_k:
            stop(f"bits a byte of {lang} rise")
    if (x := given(row, "memory")) is not None:
        if x >= limits.memory_stop:
            stop("memory full")
        elif x >= limits.memory_warn:
            alerts.append("warn: memory nearly full")
    if (x := given(row, "write_seconds")) is not None:
        writes = state["writes"]
        if len(writes) >= 3 and (middle := median(writes)) > 0 and x > limits.write_factor * middle:
            alerts.append("warn: slow checkpoint")
        state["writes"] = [*writes, float(x)][-max(3, limits.write_window) :]
    if (x := given(row, "backup_ok")) is not None:
        state["backups"] = 0 if x else state["backups"] + 1
        if state["backups"] >= limits.backup_k:
            stop("backups fail")
    return alerts


def health(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """run, step, alert from a stream of (run, step, metrics ...), one bounded state a run."""

    def observe(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else fresh()
        out = []
        for rows in batches:
            for row in rows.sort_values("step").itertuples():
                out += [(key[0], row.step, a) for a in health_step(state, row, limits)]
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["run", "step", "alert"])

    return metrics.groupBy("run").applyInPandasWithState(observe, HEALTH_OUT, HEALTH_STATE, "append", GroupStateTimeout.NoTimeout)


def health_batch(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same alerts of finished series: rows are sorted by Spark and read one after the other, so no run is held whole."""

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, fresh()
        for rows in batches:
            out = []
            for row in rows.itertuples():
                if row.run != run:
                    run, state = row.run, fresh()
                out += [(row.run, row.step, a) for a in health_step(state, row, limits)]
            yield pd.DataFrame(out, columns=["run", "step", "alert"])

    return metrics.repartition("run").sortWithinPartitions("run", "step").mapInPandas(observe, HEALTH_OUT)


def bits_per_byte(metrics: DataFrame, loss: str, tokens_per_byte: str) -> DataFrame:
    """Adds bits: a loss in nats a token as bits a byte, recomputed from what the log says and not taken from it."""
    return metrics.withColumn("bits", F.col(loss) * F.col(tokens_per_byte) / F.log(F.lit(2.0)))


def counted_gate(docs: DataFrame, judge, name: str = "gate") -> DataFrame:
    """A stateless gate with running counters: rows in, kept and bytes kept are observed metrics of each batch or micro-batch.

    ``judge`` adds ``reason``; progress listeners read the counters under ``name``.
    """
    judged = judge(docs)
    kept = F.col("reason").isNull()
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    return judged.observe(
        name, F.count(F.lit(1)).alias("rows_in"), F.sum(kept.cast("long")).alias("rows_kept"), F.sum(F.when(kept, size).otherwise(F.lit(0))).alias("bytes_kept")
    )


@dataclass(frozen=True)
class Stage:
    name: str
    mastery: float
    window: int = 3
    dwell: int = 3
    timeout: int = 50


@dataclass
class Curriculum:
    """Stages in order: a guard stops, then after a least stay mastery, plateau or timeout moves on.

    Mastery looks at the stage's own history, the guard at the whole run's.
    """

    stages: list[Stage]
    guard_drop: float = 0.2
    patience: int = 5
    delta: float = 0.01
    at: int = 0
    own: list[float] = field(default_factory=list)
    guard_peak: float | None = None
    done: bool = False

    def update(self, value: float, guard: float) -> str:
        if self.done:
            return "done"
        if self.guard_peak is not None and self.guard_peak - guard >= self.guard_drop:
            self.done = True
            return "stopped"
        self.guard_peak = guard if self.guard_peak is None else max(self.guard_peak, guard)
        self.own.append(value)
        stage = self.stages[self.at]
        if len(self.own) < stage.dwell:
            return "stay"
        mastered = len(self.own) >= stage.window and min(self.own[-stage.window :]) >= stage.mastery
        flat = len(self.own) > self.patience and max(self.own[-self.patience :]) <= max(self.own[: -self.patience]) + self.delta
        if not (mastered or flat or len(self.own) >= stage.timeout):
            return "stay"
        self.at, self.own = self.at + 1, []
        if self.at == len(self.stages):
            self.done = True
            return "finished"
        return "advance"


def curriculum(metrics: DataFrame, stages: list[Stage]) -> DataFrame:
    """run, step, stage, action over (run, step, value, guard)."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        c, out = Curriculum(list(stages)), []
        for row in rows.sort_values("step").itertuples():
            stage = stages[min(c.at, len(stages) - 1)].name
            out.append((row.run, row.step, stage, c.update(row.value, row.guard)))
        return pd.DataFrame(out, columns=["run", "step", "stage", "action"])

    return metrics.groupBy("run").applyInPandas(walk, "run string, step long, stage string, action string")
