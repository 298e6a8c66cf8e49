"""Streaming queries over ``events``; each is drained and held against its batch form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.registry import query
from tarn.sources.tables import table
from tarn.streaming import streams as s
from tarn.streaming import watches


def _folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='spark-stream-')}/streams"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A file stream reads a folder or a pattern of files; the pattern matches the one table.
    return s.event_stream(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)


def _ntz(c: str) -> F.Column:
    return F.col(c).cast("timestamp_ntz")


@query("select to_timestamp(floor(epoch_us(ts) / 2500000.0) * 2.5)::timestamp as opened, count(*) as events, round(sum(value), 4) as value from events group by 1")
def str_tumbling_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-1."""
    out = s.drain(s.samples(_events(spark, sf_dir)), "complete", _folder(spark))
    return out.select(_ntz("window.start").alias("opened"), "events", F.round("value", 4).alias("value"))


@query("""with w as (select unnest(range(0, 5)) as k, ts, value from events) select to_timestamp(floor(epoch_us(ts) / 1000000.0) - k)::timestamp as opened, round(sum(value), 4) as value from w group by 1""")
def str_sliding_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-3."""
    out = s.drain(s.sliding_throughput(_events(spark, sf_dir)), "complete", _folder(spark))
    return out.select(_ntz("window.start").alias("opened"), F.round("value", 4).alias("value"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as opens from events),
    n as (select *, sum(opens) over (partition by user_id order by ts) as session from g) select user_id, min(ts)::timestamp as opened, count(*) as events from n group by user_id, session""")
def str_session_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-4."""
    out = s.drain(s.sessions(_events(spark, sf_dir), "user_id"), "complete", _folder(spark))
    return out.select("user_id", _ntz("session_window.start").alias("opened"), "events")


@query("select event_type, count(*) as events from events group by 1")
def str_dedup_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-6: every event arrives twice, and counts once."""
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = s.drain(s.first_seen(twice, "event_id"), "append", _folder(spark))
    return out.groupBy("event_type").agg(F.count("*").alias("events"))


@query("""with e as (select *, event_id % 3 = 0 as late from events), w as (select max(ts) - interval 15 seconds as mark from e where not late)
    select event_type, count(*) as events, round(sum(value), 4) as value from e, w where not late or to_timestamp(floor(epoch_us(ts) / 1000000.0) + 1)::timestamp > mark group by 1""")
def str_late_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-5: a third of the events arrives after the others; of these, windows that ended before the grace are closed."""
    folder = f"{_folder(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    for late in (False, True):
        events.where((F.col("event_id") % 3 == 0) == late).write.mode("append").parquet(f"{folder}/in")
        stream = s.event_stream(spark, f"{folder}/in", events.schema, files=1 << 20)
        counted = stream.groupBy(F.window("ts", "1 second"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        out = s.drain(counted, "update", folder, "late")
    newest = out.groupBy("window", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("last"))
    return newest.groupBy("event_type").agg(F.sum("last.events").alias("events"), F.round(F.sum("last.value"), 4).alias("value"))


@query("""with o as (select user_id, ts, row_number() over (partition by user_id order by ts) as n, lag(ts) over (partition by user_id order by ts) as before from events),
    g as (select *, sum(case when before is null or ts - before > interval 1800 seconds then 1 else 0 end) over (partition by user_id order by n) as grant_no from o),
    s as (select user_id, grant_no, min(ts)::timestamp as opened, max(ts) as last, count(*)::int - 1 as renewals from g group by 1, 2), m as (select max(ts) - interval 15 seconds as mark from events)
    select user_id, opened, renewals, 'expired' as status from s, m
    where grant_no < (select max(grant_no) from s x where x.user_id = s.user_id) or last + interval 1800 seconds <= mark""")
def str_ttl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-4: grants by user, renewed by every event, expired after 30 minutes; rows in order of event time."""
    out = s.drain(s.expire(_events(spark, sf_dir), "user_id", 1800), "append", _folder(spark))
    return out.select("user_id", _ntz("opened").alias("opened"), "renewals", "status")


COMMANDS = ["start", "mark", "stop", "cancel", "restart"]
KINDS = ["signup", "view", "click", "error", "purchase"]


@query(f"""with recursive e as (select user_id, epoch_us(ts) as tick, event_id, {COMMANDS}[list_position({KINDS}, event_type)] as command from events),
    -- the watermark after the last micro-batch, in whole milliseconds, and what it has passed
    m as (select (max(tick) // 1000 - 15000) * 1000 as until from e), p as (select *, row_number() over (partition by user_id order by tick, event_id) as n from e, m where tick < until),
    s as (select user_id, 0::bigint as n, null::bigint as started, 0 as markers, null::bigint as last_marker, 0 as refused, [] :: struct(started bigint, ended bigint, status varchar, markers int, last_marker bigint, refused int)[] as done from (select distinct user_id from p)
        union all
        select user_id, n, case when opened is null then case when command = 'start' then tick end when command in ('stop', 'cancel', 'restart') then null else opened end,
            case when opened is null then 0 when command = 'mark' then markers + 1 else markers end, case when opened is null then null when command = 'mark' then tick else last_marker end, case when opened is null then 0 when command = 'start' then refused + 1 else refused end,
            list_concat(case when late then [struct_pack(started := started, ended := started + 21600000000, status := 'expired', markers := markers, last_marker := last_marker, refused := refused)] else [] end,
                case when opened is not null and command in ('stop', 'cancel', 'restart') then [struct_pack(started := started, ended := tick, status := case command when 'stop' then 'completed' when 'cancel' then 'cancelled' else 'interrupted' end, markers := markers, last_marker := last_marker, refused := refused)] else [] end)
        from (select s.user_id, p.n, p.tick, p.command, started, markers, last_marker, refused, coalesce(tick >= started + 21600000000, false) as late, case when tick >= started + 21600000000 then null else started end as opened from s join p on p.user_id = s.user_id and p.n = s.n + 1)),
    f as (select user_id, unnest(done) as d from s), l as (select s.*, until from s, m where started + 21600000000 < until qualify row_number() over (partition by user_id order by n desc) = 1 and n = (select max(n) from p where p.user_id = s.user_id))
    select user_id, d.started as started, d.ended as ended, d.status as status, d.markers as markers, coalesce(d.last_marker, -1) as last_marker, d.refused as refused from f
    union all select user_id, started, started + 21600000000, 'expired', markers, coalesce(last_marker, -1), refused from l""")
def str_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-12, STM-10: event kinds as commands, watches of at most six hours."""
    kinds = F.element_at(F.array(*map(F.lit, COMMANDS)), F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int"))
    commands = _events(spark, sf_dir).select("user_id", "ts", F.col("event_id").alias("number"), kinds.alias("command"))
    with watches.state_in_rocksdb(spark):
        out = s.drain(watches.watches(commands, "user_id", 21_600), "append", _folder(spark))
    return out.withColumn("last_marker", F.coalesce("last_marker", F.lit(-1)))
