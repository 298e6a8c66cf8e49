"""Diagnostics (DIA-*): processes, events, watches, evidence, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import names_match, scrub


def top_processes(processes: DataFrame, by: str, *ties: str, top: int = 15) -> DataFrame:
    """ORD-6, ORD-7: the highest values that are known."""
    return processes.where(F.col(by).isNotNull()).orderBy(F.desc(by), *ties).limit(top)


def event_window(events: DataFrame, time: str, start: Column, end: Column, message: str, top: int = 25, *ties: str) -> DataFrame:
    """DIA-2, FLT-11: events inside the window, newest first, messages scrubbed."""
    return events.where(F.col(time).between(start, end)).orderBy(F.desc(time), *ties).limit(top).withColumn(message, scrub(F.col(message)))


def event_category(event_id: Column, provider: Column) -> Column:
    """DIA-3."""
    return F.when(event_id == 1000, "application_error").when(event_id == 1001, "windows_error_reporting").when(event_id == 1002, "application_hang").when(F.contains(provider, F.lit(".NET")), "dotnet_runtime").otherwise("other")


def query_status(events: DataFrame, by: list[str]) -> DataFrame:
    """DIA-3: ok, or empty where a query found nothing; failed queries keep their status."""
    return events.groupBy(*by).agg(F.max("failure").alias("failure"), F.count("event_id").alias("events")).withColumn("status", F.coalesce("failure", F.when(F.col("events") == 0, "empty").otherwise("ok")))


def cpu_delta(samples: DataFrame, key: list[str], time: str, cpu: str) -> DataFrame:
    """JOIN-12, MATH-2: CPU percent of each sample over the one before of the same identity; null for the first."""
    w = Window.partitionBy(*key).orderBy(time)
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1_000_000
    delta = F.col(cpu) - F.lag(cpu).over(w)
    return samples.withColumn("cpu_percent", F.when((seconds > 0) & (delta >= 0), F.floor(delta / seconds * 1000 + 0.5) / 10))


def pressure(value: Column) -> Column:
    """DIA-4."""
    return F.when(value >= 90, "high").when(value >= 75, "medium").otherwise("low")


def identity_state(samples: DataFrame, last_sample: Column) -> DataFrame:
    """AGG-11, STM-2: one row per process identity (pid, started_at) of samples (at, memory, cpu, responding)."""
    seen = samples.groupBy("pid", "started_at").agg(
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.max("memory").alias("peak_memory"),
        F.max_by("memory", "at").alias("last_memory"),
        F.max_by("cpu", "at").alias("last_cpu"),
        F.bool_or(~F.coalesce("responding", F.lit(True))).alias("ever_not_responding"),
    )
    again = F.lead("started_at").over(Window.partitionBy("pid").orderBy("started_at")).isNotNull()
    return seen.withColumn("disappeared", F.col("last_seen") < last_sample).withColumn("restarted", again)


def outcome(identities: DataFrame, by: list[str]) -> DataFrame:
    """AGG-12: what a watch of a group of identities has shown."""
    present, total = F.count_if(~F.col("disappeared")), F.count("pid")
    stuck, left = F.coalesce(F.bool_or("ever_not_responding"), F.lit(False)), F.coalesce(F.bool_or("disappeared"), F.lit(False))
    summed = identities.groupBy(*by).agg(present.alias("present"), total.alias("ever"), stuck.alias("not_responding"), left.alias("exited"), F.coalesce(F.bool_or("restarted"), F.lit(False)).alias("restarted"))
    label = (
        F.when(F.col("ever") == 0, "never_observed")
        .when(F.col("not_responding") & (F.col("present") > 0), "observed_not_responding")
        .when(F.col("exited") & (F.col("present") == 0), "observed_exited")
        .when(F.col("present") > 0, "observed_running")
        .otherwise("insufficient_evidence")
    )
    return summed.withColumn("outcome", label)


def sample_totals(samples: DataFrame, at: str) -> DataFrame:
    """AGG-13, WIN-7: processes, memory and pids of each sample, and the time since the one before."""
    totals = samples.groupBy(at).agg(F.count("*").alias("processes"), F.sum("memory").alias("memory"), F.bool_or(~F.coalesce("responding", F.lit(True))).alias("any_not_responding"), F.array_sort(F.collect_set("pid")).alias("pids"))
    return totals


def correlate(events: DataFrame, watched: DataFrame, process: str) -> DataFrame:
    """DIA-10, JOIN-13: match strength of events (application, pid) with a watched process; the pids are a semi-join."""
    pids = watched.select(F.col("pid").alias("__pid")).distinct()
    joined = events.join(pids, F.col("event_pid") == F.col("__pid"), "left")
    name, pid = names_match(F.lit(process), F.col("application")), F.col("__pid").isNotNull()
    return joined.withColumn("match_strength", F.when(name & pid, "confirmed").when(name, "possible_application").when(pid, "possible_pid").otherwise("temporal_only")).drop("__pid")


def report(outcomes: DataFrame, correlated: DataFrame, by: list[str]) -> DataFrame:
    """DIA-11, ORD-9: what was observed, likely causes by rank, and confidence."""
    counts = correlated.groupBy(*by).agg(*[F.count_if(F.col("match_strength") == s).alias(s) for s in ("confirmed", "possible_application", "possible_pid")])
    joined = outcomes.join(counts, by, "left").fillna(0, ["confirmed", "possible_application", "possible_pid"])
    causes = F.array_compact(
        F.array(
            F.when(F.col("confirmed") > 0, "application_fault"),
            F.when(F.col("outcome") == "observed_not_responding", "hang"),
            F.when((F.col("outcome") == "observed_exited") & (F.col("confirmed") == 0), "unexplained_exit"),
            F.when(F.col("restarted"), "restart_loop"),
            F.when(F.col("possible_application") + F.col("possible_pid") > 0, "weak_event_match"),
        )
    )
    sure = F.when(F.col("confirmed") > 0, "high").when((F.col("possible_application") > 0) | (F.col("outcome") == "observed_not_responding"), "medium").otherwise("low")
    return joined.withColumn("likely_causes", causes).withColumn("confidence", sure)


def activity_tail(lines: DataFrame, order: str, line: str, schema: str, limit: int = 100, tail: int = 200) -> DataFrame:
    """SRC-17, DIA-13: of the last lines those that parse, the newest first. A limit that is not from 1 to 200 is 100."""
    limit = limit if 1 <= limit <= 200 else 100
    last = lines.orderBy(F.desc(order)).limit(tail).withColumn("record", F.from_json(F.col(line), schema, {"mode": "PERMISSIVE"}))
    return last.where(F.try_parse_json(line).isNotNull()).orderBy(F.desc(order)).limit(limit)


def superseded(evidence: DataFrame, by: list[str], order: str) -> DataFrame:
    """WIN-8, CF-9: evidence is stale once the same tool was asked again."""
    return evidence.withColumn("stale", F.lead(order).over(Window.partitionBy(*by).orderBy(order)).isNotNull())


def approval_status(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """DIA-14: the last status of every approval, and how many events it took."""
    return events.groupBy(key).agg(F.max_by(status, order).alias("final_status"), F.count("*").alias("events"))


def reconcile(messages: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """JOIN-15: pending messages whose approval is no longer live become expired."""
    joined = messages.join(live.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    gone = (F.col("approval_status") == "pending") & F.col("__k").isNull()
    return joined.withColumn("was_expired", gone).withColumn("approval_status", F.when(gone, "expired").otherwise(F.col("approval_status"))).drop("__k")
