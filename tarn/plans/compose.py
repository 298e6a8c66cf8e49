"""Queries of the composed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import compose as c
from tarn.operators import memory as mem
from tarn.plans.memory import TURNS
from tarn.plans.registry import query
from tarn.plans.retrieval import COS, PLAIN
from tarn.plans.storage import PROTECTED, SAFE
from tarn.sources.tables import ENTRIES_SQL, EPOCH_MS, INVENTORY_SQL, PATHS_SQL, entries, inventory, messages, paths, table


def _pick(n: F.Column, *values) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def _file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inventory(spark, sf_dir).select("doc_id", "root_id", F.concat_ws("/", "root_id", F.col("doc_id") % 5).alias("file_path"), "extension", F.col("text").alias("content"))
    return table(spark, sf_dir, "embeddings").join(f, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("chunk_id"), "root_id", "file_path", "extension", "content", "embedding")


@query(f"""with {INVENTORY_SQL}, q as (select embedding from embeddings where vec_id = 0),
    h as (select e.vec_id as chunk_id, root_id, root_id || '/' || doc_id % 5 as file_path, extension, text, {COS} as similarity from embeddings e join f on doc_id = e.vec_id, q where extension = 'txt'),
    r as (select *, row_number() over (partition by file_path order by similarity desc, chunk_id) as rn from h), k as (select *, row_number() over (order by rn > 2, similarity desc, chunk_id) as rank from r)
    select 'file' as source_type, rank, chunk_id, root_id, file_path, extension, round(similarity, 6) as similarity, case when length({PLAIN}) > 280 then left({PLAIN}, 279) || '…' else {PLAIN} end as preview from k where rank <= 6""")
def fil_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-8: no limit is named, so six."""
    found = c.file_search(_file_chunks(spark, sf_dir), table(spark, sf_dir, "embeddings").where("vec_id = 0"), ext=" .TXT")
    return found.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(SAFE + """, g as (select *, row_number() over (partition by plan_id order by entry_id || ':' || part || ':' || grant_id) as rn, count(*) over (partition by plan_id) > 3 as truncated from k where grant_id % 2 = 0 and size_bytes >= 5242880),
    h as (select *, safety <> 'excluded' and count(*) filter (safety <> 'excluded') over (partition by plan_id, lower(destination_path)) > 1 as clash from g where rn <= 3)
    select plan_id, count(*) as candidate_count, count(*) filter (safety <> 'excluded') as selectable_count, coalesce(sum(size_bytes) filter (safety <> 'excluded'), 0)::double as selectable_bytes,
        coalesce(sum(size_bytes) filter (safety <> 'excluded'), 0) > 60000000 as capacity_warning, count(*) filter (clash) as conflicts, bool_or(truncated) as truncated from h group by 1""")
def sto_offload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-4: every second supplier's folder is granted; three candidates a plan."""
    files = entries(spark, sf_dir).withColumn("entry_id", F.concat_ws(":", "entry_id", "part", "grant_id")).withColumn("relative_path", F.regexp_replace("destination_path", "^/ext/", ""))
    grants = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("grant_no"), F.concat(F.lit("/data/s"), "s_suppkey").alias("root"))
    plan = c.offload_plan(files, grants, {"mount": "/ext/"}, "Offload", EPOCH_MS, PROTECTED, "/data/s3", ["plan_id"], most=3)
    return c.plan_summary(plan, ["plan_id"], 60_000_000.0).withColumn("selectable_bytes", F.col("selectable_bytes").cast("double"))


@query(f"""with {ENTRIES_SQL}, w as (select plan_id, entry_id, size_bytes, unnest(list_concat(case when line % 2 = 0 then ['unverified'] else [] end, case when part % 3 = 0 then ['older', 'portable'] else [] end)) as t from e),
    a as (select plan_id, count(*) as entry_count, sum(size_bytes)::double as bytes from e group by 1), b as (select plan_id, string_agg(entry_id || '=' || t, ',' order by entry_id, t) as warnings from w group by 1),
    v as (select *, case when plan_id % 7 < 4 then plan_id % 7 * 40000000.0 when plan_id % 5 > 0 then plan_id % 5 * 10000000.0 end as free from a)
    select plan_id as manifest_id, entry_count, bytes, case when free is not null then greatest(0, free - bytes)::double end as remaining_bytes, plan_id % 3 <> 1 as needs_acknowledgement, coalesce(warnings, '') as warnings from v left join b using (plan_id)""")
def sto_transfer_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-7: four of seven volumes are there; a third of the manifests is complete."""
    e = entries(spark, sf_dir).withColumnRenamed("plan_id", "manifest_id")
    e = e.withColumn("dependency_concerns", F.when(F.col("line") % 2 == 0, F.array(F.lit("unverified")))).withColumn("concerns", F.when(F.col("part") % 3 == 0, F.array(F.lit("older"), F.lit("portable"))))
    m, n = e.select("manifest_id").distinct(), F.col("manifest_id")
    m = m.select(n, (n % 7).alias("volume_id"), F.when(n % 5 > 0, n % 5 * 10_000_000.0).alias("free_bytes"), F.when(n % 3 != 2, n % 3 == 1).alias("complete"))
    volumes = spark.range(4).select(F.col("id").alias("volume_id"), (F.col("id") * 40_000_000.0).alias("free_bytes"))
    told = F.array_join(F.transform("warnings", lambda w: F.concat_ws("=", w["entry_id"], w["text"])), ",")
    return c.transfer_preview(m, e, volumes).select("manifest_id", "entry_count", F.col("bytes").cast("double").alias("bytes"), F.col("remaining_bytes").cast("double").alias("remaining_bytes"), "needs_acknowledgement", told.alias("warnings"))


@query(f"""with {ENTRIES_SQL}, x as (select entry_id, part % 4 = 1 as eligible, part % 4 = 0 as excluded, state = 'verified' as verified, ['safe', 'safe', 'unsafe', 'failed', null][(part % 5 + 1)::int] as cloud, line % 3 = 0 as reason, plan_id % 2 = 0 as auth, line % 4 = 1 as clear, part % 11 = 0 as note from e),
    y as (select *, excluded or coalesce(cloud in ('unsafe', 'failed'), false) or reason or note as kept_out from x)
    select entry_id, kept_out, not kept_out and eligible and verified and coalesce(cloud = 'safe', false) and auth as recommended,
        array_to_string(list_filter([case when not clear then 'dependency_uncertain' end, case when kept_out then 'kept_out' end, case when not verified then 'not_verified' end], lambda w: w is not null), ',') as guidance from y""")
def sto_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-15."""
    e, part, line = entries(spark, sf_dir), F.col("part"), F.col("line")
    rows = e.select(
        "entry_id", _pick(part % 4, "excluded", "eligible", "uncertain", "failed").alias("eligibility"), (F.col("state") == "verified").alias("destination_verified"), _pick(part % 5, "safe", "safe", "unsafe", "failed", None).alias("cloud_status"),
        F.when(line % 3 == 0, "an OneDrive placeholder").alias("cloud_reason"), F.when(F.col("plan_id") % 2 == 0, "authorized").alias("authorization"), F.when(line % 4 == 1, "clear").alias("dependency_status"),
        F.when(part % 11 == 0, F.array(F.lit("old"), F.lit("Protected location"))).alias("notes"),
    )
    return c.guidance(rows).select("entry_id", "kept_out", "recommended", F.array_join("guidance", ",").alias("guidance"))


CLOUDY = "case page_id % 6 when 0 then 'u/OneDrive/' || path when 1 then 'Google Drive\\x/' || path when 2 then path || '/dropbox' else path end"


@query(f"with {PATHS_SQL} select page_id, page_id % 6 in (0, 1) as cloud from p")
def sto_cloud_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15: a folder of that name must hold the path, so one at its end is none."""
    moved = F.expr(CLOUDY.replace("\\", "\\\\"))
    return paths(spark, sf_dir).select("page_id", c.in_cloud(moved).alias("cloud"))


@query(f"""with {PATHS_SQL}, h as (select split_part(path, '/', 1) as root, row_number() over (order by split_part(path, '/', 1)) as n from p group by 1)
    select page_id, case when n % 4 = 0 then 'NOT_REGISTERED' when n % 4 = 1 or n % 5 = 0 then 'ROOT_CHANGED' else 'OK' end as root_code from p join h on root = split_part(path, '/', 1)""")
def sto_root_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-22: three of four hosts are registered; some changed their inode, some became links."""
    from pyspark.sql import Window

    p = paths(spark, sf_dir)
    hosts = p.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).distinct()
    n = F.col("grant_no")
    roots = hosts.withColumn("grant_no", F.row_number().over(Window.orderBy("root"))).where(n % 4 != 0)
    roots = roots.withColumn("inode", n).withColumn("device", F.lit(1)).withColumn("now_inode", n + F.when(n % 4 == 1, 1).otherwise(0)).withColumn("now_device", F.lit(1)).withColumn("is_link", n % 5 == 0)
    return c.root_registration(p.select("page_id", "path"), roots).select("page_id", "root_code")


@query(f"with {ENTRIES_SQL} select entry_id || ':' || part as entry_id, case when part % 3 = 0 then null when part % 2 = 0 then 'd' || part else 's' || line end as expected_hash from (select distinct entry_id, part, line from e)")
def sto_expected_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-21: journals name an entry twice, and a third of the entries not at all."""
    e = entries(spark, sf_dir).withColumn("entry_id", F.concat_ws(":", "entry_id", "part")).select("entry_id", "part", "line").distinct()
    one = e.where("part % 3 <> 0").select("entry_id", F.lit(1).alias("position"), F.when(F.col("part") % 2 == 0, F.concat(F.lit("d"), "part")).alias("destination_hash"), F.concat(F.lit("s"), "line").alias("source_hash"))
    return c.expected_digests(e.select("entry_id"), one.unionByName(one.withColumn("position", F.lit(2)).withColumn("destination_hash", F.lit("later"))))


@query(f"""with {TURNS}, x as (select conversation_id, turn_no, position, content, strftime(created_at + to_days((position // 3)::int), '%B %-d, %Y') as day, ['Chat', 'Project', 'File', 'Computer'][(position // 2 % 4 + 1)::int] as mode from t),
    d as (select conversation_id, turn_no, string_agg(day, '; ' order by pos) as days, count(*) as n from (select conversation_id, turn_no, day, min(position) as pos from x group by 1, 2, 3) group by 1, 2),
    m2 as (select conversation_id, turn_no, string_agg(mode, ', ' order by pos) as modes from (select conversation_id, turn_no, mode, min(position) as pos from x group by 1, 2, 3) group by 1, 2),
    b as (select conversation_id, turn_no, string_agg(content, chr(10) || chr(10) order by position) as body from x group by 1, 2)
    select conversation_id, turn_no::bigint as turn_no, sha256('Conversation date' || case when n > 1 then 's' else '' end || ': ' || days || chr(10) || 'Modes: ' || modes || chr(10) || chr(10) || body) as digest from b join d using (conversation_id, turn_no) join m2 using (conversation_id, turn_no)""")
def mem_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: three messages a day, two a mode."""
    third, half = F.floor(F.col("position") / 3).cast("int"), F.floor(F.col("position") / 2).cast("int")
    m = messages(spark, sf_dir).withColumn("created_at", F.col("created_at") + F.make_dt_interval(third)).withColumn("context_mode", _pick(half % 4, "chat", "project", "file", "computer"))
    found = c.embedding_text(mem.turns(m, "conversation_id", "position", "role"), ["conversation_id", "turn_no"], "position", "created_at", "context_mode", "content")
    return found.select("conversation_id", "turn_no", F.sha2("embedding_text", 256).alias("digest"))


@query("""select distinct conv_id, case when not (conv_id % 3 = 0 and conv_id % 2 = 1) and conv_id % 4 > 0 then 'M: ' || conv_id || '.' end as message, case when conv_id % 3 = 0 and conv_id % 2 = 1 then 'memory_behind' end as warning from conversations""")
def mem_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEM-13: a third of the indexes is stale, half of these catch up."""
    n = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(n).distinct()
    rows = rows.withColumn("context", F.when(n % 4 == 0, "").otherwise(n.cast("string"))).withColumn("stale", n % 3 == 0).withColumn("synced", F.when(n % 2 == 0, True))
    return c.memory_prompt(rows, ["conv_id"], "context", "stale", "synced", "M: {context}.")


@query("""with x as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as place from events where event_id % 4 > 0) select user_id, event_id, place from x where place <= 3""")
def dia_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: every fourth event matches by its time alone."""
    e = table(spark, sf_dir, "events").withColumn("match_strength", F.when(F.col("event_id") % 4 == 0, "temporal_only").otherwise("pid"))
    return c.correlated(e, ["user_id"], "event_id", 3).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then '' when o_orderkey % 2 = 0 then 'path=' || o_custkey else 'path=' || o_custkey || ',query=q' end as shown from orders")
def tool_public_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-1: a token is never shown."""
    n, text = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    args = F.when(n % 5 == 0, F.lit(None)).when(n % 2 == 0, F.create_map(F.lit("path"), text, F.lit("token"), F.lit("t"))).otherwise(F.create_map(F.lit("token"), F.lit("t"), F.lit("path"), text, F.lit("query"), F.lit("q")))
    shown = F.transform(F.array_sort(F.map_entries(c.public_arguments(args, ["path", "query"]))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(shown, ",").alias("shown"))


@query("select doc_id, case doc_id % 3 when 1 then chr(65279) else '' end || 'ab' || text as decoded from documents")
def src_decode_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26: UTF-8, UTF-16 with its mark, UTF-16 without."""
    d, text = table(spark, sf_dir, "documents"), F.concat(F.lit("ab"), "text")
    marked = F.encode(F.concat(F.lit("﻿"), text), "UTF-16LE")
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode(text, "UTF-8")).when(F.col("doc_id") % 3 == 1, marked).otherwise(F.encode(text, "UTF-16LE"))
    return d.select("doc_id", c.decode_output(raw).alias("decoded"))


@query("""with x as (select o_orderkey, unnest([0, 1, 2]) as place from orders) select o_orderkey, place, 'memory' as source_type, case when place = 1 then '' else 'm' || o_orderkey end as memory_id, 'c' || place as chunk_id from x where (o_orderkey + place) % 2 = 0""")
def ui_memory_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UI-6: every second source of a message is a memory."""
    n = F.col("o_orderkey")
    kind = lambda p: F.when((n + p) % 2 == 0, "memory").otherwise("file")
    one = lambda p: F.struct(kind(p).alias("source_type"), (F.lit(None) if p == 1 else F.concat(F.lit("m"), n)).cast("string").alias("memory_id"), F.lit(f"c{p}").alias("chunk_id"))
    return c.memory_sources(table(spark, sf_dir, "orders").select(n, F.array(*[one(p) for p in range(3)]).alias("sources")), "o_orderkey", "sources")
