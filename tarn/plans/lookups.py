"""Queries of lookups, grants, approvals and formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import lookup as lk
from tarn.operators import vector
from tarn.plans.registry import query
from tarn.sources.tables import ENTRIES_SQL, INVENTORY_SQL, PATHS_SQL, SAMPLES_SQL, entries, inventory, paths, samples, table


@query(f"""with {INVENTORY_SQL}, st as (select *, case doc_id % 4 when 0 then 'indexed' when 1 then 'reused' when 2 then 'error' else 'stale' end as status, doc_id % 5 as chunk_count from f)
    select doc_id, chunk_count::bigint as chunks from st where status in ('indexed', 'reused') and chunk_count > 0 and doc_id % 3 = 0""")
def idx_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-8, JOIN-3, JOIN-4: a hit on every third document's chunk."""
    i = F.col("doc_id")
    f = inventory(spark, sf_dir).withColumn("status", F.element_at(F.array(*map(F.lit, ("indexed", "reused", "error", "stale"))), (i % 4 + 1).cast("int"))).withColumn("chunk_count", i % 5)
    chunks = f.select(F.col("doc_id").alias("chunk_id"), "doc_id", "root_id", "absolute_path", "fingerprint", F.col("chunk_count").alias("chunks"))
    return lk.hits(f.where("doc_id % 3 = 0").select(i.alias("chunk_id")), chunks, f, ["root_id", "absolute_path", "fingerprint"]).select("doc_id", "chunks")


@query(f"""with {PATHS_SQL}, g(grant_no, root) as (select 1, split_part(min(path), '/', 1) from p union all select 2, split_part(max(path), '/', 1) from p union all select 3, split_part(min(path), '/', 1) || '/en' from p)
    select page_id, grant_no from p left join g on path = root or starts_with(path, root || '/') qualify row_number() over (partition by page_id order by grant_no) = 1""")
def sto_first_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10."""
    p = paths(spark, sf_dir)
    host = lambda c: F.split_part(c, F.lit("/"), F.lit(1))
    ends = p.agg(host(F.min("path")).alias("a"), host(F.max("path")).alias("b"))
    grant = lambda n, root: F.struct(F.lit(n).alias("grant_no"), root.alias("root"))
    g = ends.select(F.explode(F.array(grant(1, F.col("a")), grant(2, F.col("b")), grant(3, F.concat("a", F.lit("/en"))))).alias("g")).select("g.*")
    return lk.first_grant(p.select("page_id", "path"), g).select("page_id", "grant_no")


@query(f"""with {SAMPLES_SQL}, i as (select distinct pid, started_at from s), b as (select distinct pid, started_at from s where ts < timestamp '2024-01-10')
    select i.pid, i.started_at, b.pid is not null as before, i.pid in (select pid from b) and b.pid is null as restarted from i left join b on i.pid = b.pid and i.started_at = b.started_at""")
def dia_since_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14."""
    s = samples(spark, sf_dir)
    return lk.since_baseline(s.select("pid", "started_at").distinct(), s.where(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))).select("pid", "started_at", "before", "restarted")


@query("select source, count(*) filter (source in ('src1', 'src2')) as kept, count(*) filter (source not in ('src1', 'src2')) as unsafe from documents group by 1")
def idx_unknown_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-25."""
    roots = spark.createDataFrame([("src1",), ("src2",)], "root_id string")
    marked = lk.with_root(inventory(spark, sf_dir).withColumn("status", F.lit("indexed")), roots)
    return marked.groupBy(F.col("root_id").alias("source")).agg(F.count_if(F.col("status") == "indexed").alias("kept"), F.count_if(F.col("status") == "unsafe").alias("unsafe"))


@query(f"with {ENTRIES_SQL} select distinct plan_id as manifest_id from e where plan_id % 5 in (0, 2)")
def sto_busy_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-28."""
    m = entries(spark, sf_dir).select(F.col("plan_id").alias("manifest_id")).distinct()
    status = F.element_at(F.array(*map(F.lit, ("running", "completed", "starting", "failed", "cancelled"))), (F.col("manifest_id") % 5 + 1).cast("int"))
    return lk.busy(m, m.withColumn("status", status))


@query("select user_id as path, min(ts) as added_at, max(ts) + interval 30 minutes as expires_at, count(*) as grants from events group by 1")
def sto_grant_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-13."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp_ntz").alias("added_at"))
    return lk.grant_renewals(e.withColumn("expires_at", F.col("added_at") + F.expr("interval 30 minutes")))


@query("select event_id from events where (user_id % 3 = 0 or user_id % 3 = 1) and ts > timestamp '2024-01-15' - interval 15 minutes")
def dia_visible_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-15: a third has no session, a third this one."""
    k = F.col("user_id") % 3
    a = table(spark, sf_dir, "events").select("event_id", F.when(k == 1, "s1").when(k == 2, "s2").alias("session_id"), (F.col("ts").cast("timestamp_ntz") + F.expr("interval 15 minutes")).alias("expires_at"))
    return lk.visible_approvals(a, "s1", F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


@query("""select o_orderkey, case when o_orderkey % 7 = 0 then 'ALREADY_USED' when o_orderdate <= timestamp '1996-01-01' then 'EXPIRED' when o_orderkey % 5 = 0 then 'NOT_ACKNOWLEDGED' when o_orderkey % 3 = 0 then 'MANIFEST_CHANGED' else 'APPROVED' end as decision from orders""")
def sto_approval_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-23."""
    k = F.col("o_orderkey")
    code = lk.decision(F.col("o_orderdate").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz"), k % 7 == 0, F.when(k % 5 != 0, True), F.lit("h"), F.lit("h"), F.when(k % 3 != 0, "h"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("decision"))


@query(f"with {ENTRIES_SQL} select entry_id, part, part % 4 = 0 or part % 6 = 0 as changed from e")
def sto_source_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-9: a millisecond is no change."""
    p = F.col("part")
    was = F.when(p % 6 == 0, F.col("mtime_ms") + 2).when(p % 5 == 0, F.col("mtime_ms") - 1).when(p % 7 != 0, F.col("mtime_ms"))
    return entries(spark, sf_dir).select("entry_id", "part", lk.source_changed(F.col("size_bytes"), F.when(p % 4 == 0, F.lit(0.0)).otherwise(F.col("size_bytes")), F.col("mtime_ms"), was).alias("changed"))


@query("""with s as (select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as sim from embeddings e, (select embedding from embeddings where vec_id = 0) q),
    r as (select *, row_number() over (partition by label order by sim desc, vec_id) as rank from s)
    select label, string_agg('[' || rank || '] vec ' || vec_id || chr(10) || 'label ' || label, chr(10) || chr(10) order by rank) as context from r where rank <= 3 group by 1""")
def vec_context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: the best three of each label as a text."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    scored = vector.score(e, e.where("vec_id = 0"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))
    best = scored.withColumn("rank", rank).where("rank <= 3").withColumn("content", F.concat(F.lit("label "), "label"))
    return lk.context_blocks(best, ["label"], "rank", F.concat(F.lit("vec "), "vec_id"), "content")


@query("select doc_id, array_to_string(string_split(text, chr(10))[1:6], chr(10)) || case when len(string_split(text, chr(10))) > 6 then chr(10) || '...' else '' end as head from documents")
def text_head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-14."""
    return table(spark, sf_dir, "documents").select("doc_id", lk.head_lines(F.col("text")).alias("head"))


@query("select event_id, case event_id % 4 when 0 then '/p' || user_id when 1 then 'Application' when 2 then '\"' || event_type || '\"' end as target from events")
def dia_tool_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-27."""
    k = F.col("event_id") % 4
    args = F.when(k == 0, F.create_map(F.lit("path"), F.concat(F.lit("/p"), "user_id"))).when(k == 1, F.create_map(F.lit("logName"), F.lit("Application"))).when(k == 2, F.create_map(F.lit("query"), F.col("event_type"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", lk.tool_target(args).alias("target"))


@query("select event_id, case when event_id % 3 = 0 then user_id::int when event_id % 3 = 1 then 1 end as ms from events")
def dia_ping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-24."""
    k = F.col("event_id") % 3
    line = F.when(k == 0, F.concat(F.lit("Reply from 1.1.1.1: bytes=32 time="), "user_id", F.lit("ms TTL=57"))).when(k == 1, "time<1ms").otherwise("Request timed out.")
    return table(spark, sf_dir, "events").select("event_id", lk.round_trip_ms(line).alias("ms"))


@query("select o_orderkey, case o_orderkey % 5 when 1 then 'invalid_project' when 2 then 'invalid_file' when 4 then 'unknown_type' end as problem from orders")
def tx_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-2: JSON sources of the three kinds, some of them not valid."""
    said = ['{"type":"project","file_path":"a","start_line":1,"end_line":2}', '{"type":"project","file_path":"a","start_line":3,"end_line":2}', '{"type":"file","file_path":"a"}', '{"type":"memory","conversation_id":"c"}', '{"type":"web"}']
    raw = F.element_at(F.array(*map(F.lit, said)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    source = F.from_json(raw, "type string, file_path string, start_line int, end_line int, chunk_index int, conversation_id string")
    return table(spark, sf_dir, "orders").select("o_orderkey", lk.sources_problem(source).alias("problem"))


@query(f"""with {PATHS_SQL}, h as (select split_part(min(path), '/', 1) as root from p), k as (select page_id, path, size from p, h where starts_with(path, root || '/') and size >= 100)
    select page_id, size, (select count(*) > 5 from k) as truncated from k order by size desc, path limit 5""")
def sto_bounded_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, SRC-4; the root is a granted host."""
    p = paths(spark, sf_dir)
    root = p.agg(F.split_part(F.min("path"), F.lit("/"), F.lit(1))).first()[0]
    return lk.bounded_walk(p, root, 4, 5, 100).select("page_id", "size", "truncated")


OUT = "case part % 5 when 0 then 'skipped' when 1 then 'failed' when 2 then 'interrupted' else 'removed' end"


@query(f"with {ENTRIES_SQL}, o as (select *, {OUT} as outcome from e) select grant_id, count(*) filter (outcome = 'removed') as removed, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'failed') as failed, count(*) filter (outcome = 'interrupted') as interrupted, coalesce(sum(size_bytes) filter (outcome = 'removed'), 0) as removed_bytes from o group by 1")
def sto_removal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10."""
    kind = F.element_at(F.array(*map(F.lit, ("skipped", "failed", "interrupted", "removed", "removed"))), (F.col("part") % 5 + 1).cast("int"))
    return lk.removal_metrics(entries(spark, sf_dir).withColumn("outcome", kind), ["grant_id"])


@query(f"with {ENTRIES_SQL} select plan_id, bool_or(part % 50 = 0) as deleted from e group by 1")
def sto_deletion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-17."""
    kind = F.when(F.col("part") % 50 == 0, "permanently_deleted").otherwise("kept")
    return lk.deletion_evidence(entries(spark, sf_dir).withColumn("outcome", kind), ["plan_id"])


@query("select s_suppkey, 0 as place, '10.0.0.' || (s_suppkey % 250) as address from supplier where s_suppkey % 3 > 0 union all select s_suppkey, 1, 'fe80::' || s_suppkey from supplier where s_suppkey % 3 = 2 union all select s_suppkey, null, null from supplier where s_suppkey % 3 = 0")
def dia_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIA-7: an adapter without addresses stays a row."""
    k = F.col("s_suppkey")
    four, six = F.concat(F.lit("10.0.0."), k % 250), F.concat(F.lit("fe80::"), k)
    rows = table(spark, sf_dir, "supplier").withColumn("a", F.when(k % 3 == 1, F.array(four)).when(k % 3 == 2, F.array(four, six)))
    return lk.adapters(rows, "s_suppkey", "a")


@query("select 'unrelated' as kind, count(*) as n from documents d join labels l using (doc_id) where lang = 'en' and quality = 0 union all select 'missing', count(*) from labels l join documents d using (doc_id) where quality = 1 and lang <> 'en'")
def vec_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: labels stand for what is required."""
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id")
    return lk.noise(d.where("lang = 'en'").select("doc_id"), d.where("quality = 1").select("doc_id"), "doc_id")


@query("select event_id, event_type = 'click' and user_id % 2 = 0 as duplicate from events where event_type in ('click', 'view')")
def dia_pending_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-29."""
    e = table(spark, sf_dir, "events")
    pending = e.where("event_type = 'click' and user_id % 2 = 0").select("event_type", "user_id", F.lit("pending").alias("status"))
    return lk.not_pending(e.where("event_type in ('click', 'view')"), pending, ["event_type", "user_id"]).select("event_id", "duplicate")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as place, lead(turn) over (partition by conv_id order by turn) is null as newest from conversations")
def tx_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-9."""
    return lk.latest_version(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("place", F.col("place").cast("long"))
