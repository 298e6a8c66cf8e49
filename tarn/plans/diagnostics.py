"""Diagnostics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import numbers as num
from tarn.functions import text as t
from tarn.operators import diagnostics as dia
from tarn.operators import storage as sto
from tarn.plans.registry import query
from tarn.sources.tables import SAMPLES_SQL, messages, samples, table

S = f"with {SAMPLES_SQL}"


@query("select user_id, round(max(value), 6) as memory from events group by 1 order by 2 desc, 1 limit 15")
def dia_process_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-6."""
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("memory"))
    return dia.top_processes(p, "memory", "user_id").select("user_id", F.round("memory", 6).alias("memory"))


@query("select event_id, ts, 'mail a' || user_id || '@x.example.com from [ip] at [path] ' || event_type as message from (select * from events where ts between timestamp '2024-01-05' and timestamp '2024-01-06' order by ts desc, event_id limit 25)".replace("'mail a' || user_id || '@x.example.com from", "'mail [email] from"))
def dia_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-2, STR-6."""
    e = table(spark, sf_dir, "events").withColumn("message", F.concat(F.lit("mail  a"), "user_id", F.lit("@x.example.com from 10.0.0."), F.col("user_id") % 250, F.lit(" at /home/u/secret "), "event_type"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return dia.event_window(e.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", at("2024-01-05 00:00:00"), at("2024-01-06 00:00:00"), "message", 25, "event_id").select("event_id", "ts", "message")


@query("""select case when event_id % 6 = 0 then 'application_error' when event_id % 6 = 1 then 'windows_error_reporting' when event_id % 6 = 2 then 'application_hang' when event_type = 'error' then 'dotnet_runtime' else 'other' end as category, count(*) as events
    from events group by 1""")
def dia_event_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-3."""
    provider = F.when(F.col("event_type") == "error", ".NET Runtime").otherwise("Other")
    return table(spark, sf_dir, "events").groupBy(dia.event_category(F.col("event_id") % 6 + 1000, provider).alias("category")).agg(F.count("*").alias("events"))


@query("""with q as (select distinct user_id from events), e as (select user_id, event_id from events where event_type = 'error' and event_id % 5 = 0)
    select q.user_id, count(e.event_id) as events, case when q.user_id % 10 = 0 then 'timed_out' when count(e.event_id) = 0 then 'empty' else 'ok' end as status from q left join e using (user_id) group by 1""")
def dia_query_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-3: a query that found nothing is not one that failed."""
    e = table(spark, sf_dir, "events")
    asked = e.select("user_id").distinct().withColumn("failure", F.when(F.col("user_id") % 10 == 0, "timed_out"))
    hits = e.where("event_type = 'error' and event_id % 5 = 0").select("user_id", "event_id")
    return dia.query_status(asked.join(hits, "user_id", "left"), ["user_id"]).select("user_id", "events", "status")


@query(S + """, w as (select event_id, (epoch_us(ts) - epoch_us(lag(ts) over v)) / 1000000.0::double as sec, cpu - lag(cpu) over v as d from s window v as (partition by pid order by ts))
    select event_id, case when sec > 0 and d >= 0 then floor(d / sec * 1000 + 0.5) / 10 end as cpu_percent from w""")
def dia_cpu_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12."""
    return dia.cpu_delta(samples(spark, sf_dir), ["pid"], "ts", "cpu").select("event_id", "cpu_percent")


@query("""select s_suppkey, metric, value, case when value >= 90 then 'high' when value >= 75 then 'medium' else 'low' end as severity from
    (select s_suppkey, unnest(['cpu', 'memory', 'disk']) as metric, unnest([s_suppkey % 101, (s_suppkey * 7) % 101, (s_suppkey * 13) % 101]) as value from supplier)""")
def dia_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-4."""
    k = F.col("s_suppkey")
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 101).alias("cpu"), (k * 7 % 101).alias("memory"), (k * 13 % 101).alias("disk"))
    return wide.unpivot(["s_suppkey"], ["cpu", "memory", "disk"], "metric", "value").withColumn("severity", dia.pressure(F.col("value")))


@query("select s_suppkey, s_name from supplier where contains(lower(s_name || ' ' || 'svc' || s_suppkey), 'svc1') order by s_name limit 50")
def dia_services_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-5, FLT-12."""
    s = table(spark, sf_dir, "supplier")
    return s.where(F.contains(F.lower(F.concat_ws(" ", "s_name", F.concat(F.lit("svc"), "s_suppkey"))), F.lit("svc1"))).orderBy("s_name").limit(50).select("s_suppkey", "s_name")


IDENTITY = S + """, i as (select pid, started_at, min(ts) as first_seen, max(ts) as last_seen, max(memory) as peak_memory, arg_max(memory, ts) as last_memory, arg_max(cpu, ts) as last_cpu, bool_or(not responding) as ever_not_responding from s group by 1, 2),
    j as (select *, last_seen < timestamp '2024-01-29' as disappeared, lead(started_at) over (partition by pid order by started_at) is not null as restarted from i)"""


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).drop("at").withColumnRenamed("ts", "at")
    return dia.identity_state(s, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))


@query(IDENTITY + " select * from j")
def dia_identity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11."""
    return _identities(spark, sf_dir)


OUTCOME = IDENTITY + """, o as (select pid % 20 as app, count(*) filter (not disappeared) as present, count(*) as ever, bool_or(ever_not_responding) as not_responding, bool_or(disappeared) as exited, bool_or(restarted) as restarted from j group by 1),
    oc as (select *, case when not_responding and present > 0 then 'observed_not_responding' when exited and present = 0 then 'observed_exited' when present > 0 then 'observed_running' else 'insufficient_evidence' end as outcome from o)"""


@query(OUTCOME + " select * from oc")
def dia_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: watches of twenty groups of processes."""
    return dia.outcome(_identities(spark, sf_dir).withColumn("app", F.col("pid") % 20), ["app"])


@query(S + ''', g as (select "at", count(*) as processes, round(sum(memory), 4) as memory, bool_or(not responding) as any_not_responding, string_agg(distinct pid, ',' order by pid) as pids from s group by 1) select *, epoch("at" - lag("at") over (order by "at"))::bigint as since from g''')
def dia_sample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, WIN-7: one row a sample, so the window over all samples is small."""
    g = dia.sample_totals(samples(spark, sf_dir), "at")
    since = (F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.lag("at").over(Window.orderBy("at")).cast("timestamp"))).cast("long")
    return g.select("at", "processes", F.round("memory", 4).alias("memory"), "any_not_responding", F.array_join("pids", ",").alias("pids"), since.alias("since"))


CORRELATED = """e as (select event_id, user_id % 20 as app, case event_id % 4 when 0 then 'View.EXE' when 1 then 'c:\\x\\view.dll' when 2 then 'other' end as application, case when event_id % 3 = 0 then user_id else -1 end as event_pid from events),
    pids as (select distinct user_id from events where user_id % 2 = 0),
    c as (select e.*, case when event_id % 4 in (0, 1) and user_id is not null then 'confirmed' when event_id % 4 in (0, 1) then 'possible_application' when user_id is not null then 'possible_pid' else 'temporal_only' end as match_strength from e left join pids on event_pid = user_id)"""


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    faults = e.select("event_id", (F.col("user_id") % 20).alias("app"), F.when(k == 0, "View.EXE").when(k == 1, "c:\\x\\view.dll").when(k == 2, "other").alias("application"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).otherwise(-1).alias("event_pid"))
    return dia.correlate(faults, e.where("user_id % 2 = 0").select(F.col("user_id").alias("pid")), "view.exe")


@query(f"with {CORRELATED} select event_id, match_strength from c")
def dia_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-10."""
    return _correlated(spark, sf_dir).select("event_id", "match_strength")


@query(OUTCOME + f""", {CORRELATED}, n as (select app, count(*) filter (match_strength = 'confirmed') as confirmed, count(*) filter (match_strength = 'possible_application') as pa, count(*) filter (match_strength = 'possible_pid') as pp from c group by 1)
    select oc.app, outcome, coalesce(confirmed, 0) as confirmed, concat_ws(',', case when coalesce(confirmed, 0) > 0 then 'application_fault' end, case when outcome = 'observed_not_responding' then 'hang' end,
        case when outcome = 'observed_exited' and coalesce(confirmed, 0) = 0 then 'unexplained_exit' end, case when restarted then 'restart_loop' end, case when coalesce(pa, 0) + coalesce(pp, 0) > 0 then 'weak_event_match' end) as causes,
        case when coalesce(confirmed, 0) > 0 then 'high' when coalesce(pa, 0) > 0 or outcome = 'observed_not_responding' then 'medium' else 'low' end as confidence from oc left join n using (app)""")
def dia_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-11."""
    outcomes = dia.outcome(_identities(spark, sf_dir).withColumn("app", F.col("pid") % 20), ["app"])
    return dia.report(outcomes, _correlated(spark, sf_dir), ["app"]).select("app", "outcome", "confirmed", F.array_join("likely_causes", ",").alias("causes"), "confidence")


@query("""with l as (select event_id, case when event_id % 9 = 0 then '{broken' else props end as line from events), t as (select * from l order by event_id desc limit 200)
    select event_id, (line->>'k')::bigint as k from t where event_id % 9 <> 0 order by event_id desc limit 50""")
def dia_activity_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17: the last 200 lines come first, then those that parse, then the limit."""
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props")).alias("line"))
    return dia.activity_tail(lines, "event_id", "line", "k long", 50).select("event_id", F.col("record.k").alias("k"))


@query("select event_id, lead(event_id) over (partition by user_id, event_type order by event_id) is not null as stale from events")
def dia_ledger_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8."""
    return dia.superseded(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("event_id", "stale")


@query("""with v as (select s_suppkey, ['2', 'fixed', '3', 'Fixed', 'Local Disk', null][(s_suppkey % 6 + 1)::int] as t, ['usb', 'NVMe', null, '4'][(s_suppkey % 4 + 1)::int] as b from supplier),
    n as (select s_suppkey, lower(coalesce(t, '')) as t, lower(coalesce(b, '')) as b, case when s_suppkey % 3 <> 0 then 'S' || s_suppkey end as serial, case when s_suppkey % 5 <> 0 then 'D' || s_suppkey end as disk from v)
    select s_suppkey, case when t = '2' then 'removable' when t <> '' and b in ('usb', '4') then 'external' when t <> '' and b = 'nvme' then 'internal' when t <> '' then 'unknown' when b in ('usb', '4') then 'external' else 'unknown' end as classification,
        case when t = '2' then case when b <> '' then 'high' else 'medium' end when t <> '' and b <> '' then 'high' when t <> '' then 'low' when b in ('usb', '4') then 'medium' else 'low' end as confidence,
        case when serial is null and disk is null then 'mount:M' || s_suppkey else concat_ws('|', disk, serial) end as volume_id, case when serial is not null and disk is not null then 'high' when serial is null and disk is null then 'low' else 'medium' end as identity from n""")
def dia_drive_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-2, STO-3, DIA-8."""
    k = F.col("s_suppkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    d = sto.drive_class(pick(["2", "fixed", "3", "Fixed", "Local Disk", None], 6), pick(["usb", "NVMe", None, "4"], 4))
    i = sto.volume_identity(F.concat(F.lit("M"), k), F.when(k % 3 != 0, F.concat(F.lit("S"), k)), F.when(k % 5 != 0, F.concat(F.lit("D"), k)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", d["classification"].alias("classification"), d["confidence"].alias("confidence"), i["volume_id"].alias("volume_id"), i["identity_confidence"].alias("identity"))


@query("select user_id, arg_max(event_type, event_id) as final_status, count(*) as events from events group by 1")
def dia_approval_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-14."""
    return dia.approval_status(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""with m as (select conv_id, turn, case when turn % 2 = 0 then 'pending' else 'approved' end as s from conversations), l as (select distinct conv_id from conversations where conv_id % 3 = 0)
    select m.conv_id, turn, case when s = 'pending' and l.conv_id is null then 'expired' else s end as approval_status, s = 'pending' and l.conv_id is null as was_expired from m left join l using (conv_id)""")
def dia_approval_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "pending").otherwise("approved").alias("approval_status"))
    return dia.reconcile(c, c.where("conv_id % 3 = 0"), "conv_id")


@query("select event_id, case event_id % 5 when 0 then 503 when 1 then 400 when 2 then 409 when 3 then 500 else 503 end as status from events")
def dia_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-28."""
    k = (F.col("event_id") % 5).cast("int")
    text = F.element_at(F.array(*map(F.lit, ("connect ECONNREFUSED", "\"path\" is required", "conflict", "boom", "model X is not installed"))), k + 1)
    return table(spark, sf_dir, "events").select("event_id", t.error_status(text, F.when(k == 2, 409)).alias("status"))


@query("select event_id, ts::timestamp as at from events where event_id % 4 <> 3 union all select event_id, null from events where event_id % 4 = 3")
def dia_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-3: ISO text, and what is no time; times keep their microseconds."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    said = F.when(F.col("event_id") % 4 == 3, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return e.select("event_id", num.to_time(said).cast("timestamp_ntz").alias("at"))


@query("select p_partkey, floor(p_retailprice * 10 + 0.5) / 10 as rounded, case when p_partkey % 3 = 0 then null else p_size::double end as finite from part")
def dia_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEM-5, MATH-4."""
    raw = F.when(F.col("p_partkey") % 3 == 0, "NaN").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", num.half_up(F.col("p_retailprice"), 1).alias("rounded"), num.finite(raw).alias("finite"))


@query("select conv_id, max(turn) as last_turn, list_aggregate(list_sort(list_distinct(list(role))), 'string_agg', ',') as roles from conversations group by 1 having count(*) >= 3")
def dia_watch_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: the latest sample of a watch, and what it has seen."""
    g = messages(spark, sf_dir).groupBy(F.col("conversation_id").alias("conv_id")).agg(F.max("position").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n"))
    return g.where("n >= 3").drop("n")


@query("""with r as (select 'm' || (s_suppkey % 5) as model, s_suppkey % 4 = 0 as needed from supplier) select needed, count(distinct model) as models, bool_and(model in ('m0', 'm1', 'm2', 'm3')) as ready from r group by 1""")
def dia_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25."""
    k = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), k % 5).alias("model"), (k % 4 == 0).alias("needed"))
    return r.groupBy("needed").agg(F.countDistinct("model").alias("models"), F.bool_and(F.array_contains(F.array(*map(F.lit, ("m0", "m1", "m2", "m3"))), F.col("model"))).alias("ready"))
