"""Storage planning and integrity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import numbers as num
from tarn.operators import storage as sto
from tarn.plans.registry import query
from tarn.sources.tables import ENTRIES_SQL, EPOCH_MS, PATHS_SQL, entries, paths, table

E = f"with {ENTRIES_SQL}"
P = f"with {PATHS_SQL}, a as (select p.*, string_split(path, '/') as parts from p), x as (select unnest(list_transform(range(1, len(parts)), lambda n: array_to_string(parts[1:n], '/'))) as directory, size from a)"
PROTECTED = ["/data/s1", "/data/s2"]
EXT = "regexp_extract(source_path, '\\.([^./]*)$', 1)"
OFF = " or ".join(f"source_path = '{p}' or starts_with(source_path, '{p}/')" for p in PROTECTED)
SAFE = E + f""", s as (select *, {EXT} as ext, ({EXT} = 'key') as sens, ({OFF}) as prot, starts_with(source_path, '/data/s3/') as own from e),
    k as (select *, case when sens or prot or own then 'excluded' when coalesce(in_use, false) then 'review_required' when ext in ('mp4', 'zip') or size_bytes >= 52428800 then 'likely_portable' else 'review_required' end as safety from s)"""


def _safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sto.candidate_safety(entries(spark, sf_dir), EPOCH_MS, PROTECTED, "/data/s3")


@query(P + " select directory, count(*) as files, sum(size)::bigint as bytes from x group by 1")
def sto_dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4."""
    return sto.directory_sizes(paths(spark, sf_dir))


@query(f"with {PATHS_SQL} select page_id, path, size from p order by size desc, page_id limit 15")
def sto_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-2."""
    return sto.largest(paths(spark, sf_dir), "size", "page_id").select("page_id", "path", "size")


@query(P + " select directory, sum(size)::bigint as bytes from x group by 1 order by 2 desc, 1 limit 15")
def sto_top_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sto.largest(sto.directory_sizes(paths(spark, sf_dir)), "bytes", "directory").select("directory", "bytes")


@query(f"with {PATHS_SQL} select count(*) filter (page_id % 10 = 0) as cached_files, coalesce(sum(size) filter (page_id % 10 = 0), 0)::bigint as cached_bytes from p")
def sto_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4: files under a cache directory; every tenth page is put under one."""
    p = paths(spark, sf_dir).withColumn("path", F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("x/Cache/"), "path")).otherwise(F.col("path")))
    hit = sto.ignored(F.col("path"), sto.CACHE_DIRS)
    return p.agg(F.count_if(hit).alias("cached_files"), F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).alias("cached_bytes"))


@query(f"""with {PATHS_SQL}, r as (select o_orderkey, c_custkey, n_nationkey, r_regionkey, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select 'r' || r_regionkey as directory, count(*) as files, round(sum(o_totalprice), 2) as bytes from r group by 1
    union all select 'r' || r_regionkey || '/n' || n_nationkey, count(*), round(sum(o_totalprice), 2) from r group by 1""")
def sto_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CF-8 on a tree of regions, nations and orders: broadcast joins of the small tables, then one aggregation."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/o"), "o_orderkey")
    return sto.directory_sizes(joined.select(path.alias("path"), F.col("o_totalprice").alias("size"))).select("directory", "files", F.round("bytes", 2).alias("bytes"))


@query(SAFE + f" select entry_id, safety, case when sens then 'sensitive_filename' when prot then 'protected_location' when own then 'application_directory' when in_use then 'running_process_image' when in_use is null then 'unverified' else '' end as dependency, safety <> 'excluded' and ({EPOCH_MS} - mtime_ms) / 86400000.0 > 365 as old from k")
def sto_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-1."""
    return _safe(spark, sf_dir).select("entry_id", "safety", F.array_join("dependency_concerns", ",").alias("dependency"), F.array_contains("concerns", "older_than_one_year").alias("old"))


@query(SAFE + """, c as (select *, count(*) over (partition by plan_id, lower(destination_path)) as n, min(entry_id) over (partition by plan_id, lower(destination_path)) as first_id from k where safety <> 'excluded')
    select entry_id, first_id, entry_id = first_id as is_first from c where n > 1""")
def sto_dest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-5: destinations are those of a plan."""
    kept = _safe(spark, sf_dir).where("safety <> 'excluded'").withColumn("destination", F.concat_ws("|", "plan_id", "destination_path"))
    return sto.destination_conflicts(kept, "entry_id", "destination").select("entry_id", "first_id", "is_first")


@query(SAFE + " select plan_id, count(*) as candidate_count, count(*) filter (safety = 'likely_portable') as selectable_count, coalesce(sum(size_bytes) filter (safety = 'likely_portable'), 0) as selectable_bytes, coalesce(sum(size_bytes) filter (safety = 'likely_portable'), 0) > 100000000 as capacity_warning from k group by 1")
def sto_plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6."""
    return sto.plan_totals(_safe(spark, sf_dir).withColumn("selectable", F.col("safety") == "likely_portable"), ["plan_id"], F.lit(100_000_000.0))


@query(SAFE + """, w as (select (i * 7)::bigint || ':1' as entry_id, i as pos from range(0, 400) t(i) union all select '7:1', 1000)
    select w.entry_id, pos, case when k.entry_id is null then 'unknown' when count(*) over (partition by w.entry_id) > 1 then 'duplicate' when safety = 'excluded' then 'excluded' end as problem from w left join k on k.entry_id = w.entry_id""")
def sto_lock_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-6: asked ids in their order, with unknown and repeated ones."""
    ids = spark.range(400).select(F.concat((F.col("id") * 7).cast("string"), F.lit(":1")).alias("entry_id"), F.col("id").alias("pos"))
    asked = ids.unionByName(spark.sql("select '7:1' as entry_id, 1000L as pos"))
    return sto.lock_selection(asked, _safe(spark, sf_dir).select("entry_id", "safety"), "entry_id").select("entry_id", "pos", "problem")


HASHES = E + ", h as (select plan_id, sha256(string_agg(entry_id || '|' || source_path || '|' || state, chr(10) order by entry_id, source_path, state)) as manifest_hash, count(*) as entry_count from e group by 1)"


@query(HASHES + " select plan_id, manifest_hash, entry_count from h")
def sto_manifest_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HASH-3."""
    return sto.manifest_hash(entries(spark, sf_dir), ["plan_id"], "entry_id", "source_path", "state")


@query("""with j as (select o_orderkey as plan_id, sha256(o_orderkey::varchar) as h, o_orderkey % 8 as k from orders),
    r as (select plan_id, k, h as recomputed, case when k = 1 then 'tampered' else h end as recorded from j)
    select plan_id, case when k = 0 then 'legacy_untrusted_manifest' when recomputed <> recorded then 'snapshot_hash_mismatch' when k = 2 then 'snapshot_internal_hash_mismatch'
        when k = 3 then 'session_manifest_and_snapshot' when k = 4 then 'journal_snapshot_only' when k = 5 then 'session_transfer_provenance' else 'journal_snapshot_only' end as trust from r""")
def sto_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-10: every eighth order shows another outcome."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"), (F.col("o_orderkey") % 8).alias("k"))
    k, h = F.col("k"), F.col("h")
    trust = sto.manifest_trust(k != 0, h, F.when(k == 1, "tampered").otherwise(h), F.when(k == 2, "other"), F.when(k.isin(3, 4), h), F.when(k == 3, h).when(k == 4, "other"), F.when(k == 5, h))
    return o.select("plan_id", trust.alias("trust"))


AXES_SQL = E + """, x as (select *, part % 11 = 0 as ex, part % 5 <> 0 as removable,
    case when part % 17 = 0 then 'failed' else 'verified' end as copy_integrity, case when part % 19 = 0 then 'unknown' else 'verified' end as source_integrity,
    case when state = 'verified' then 'verified' else 'unknown' end as destination_integrity, case when part % 23 = 0 then 'failed' else 'authorized' end as source_authorization,
    case when part % 29 = 0 then 'unsafe' else 'safe' end as cloud_safety, case when part % 7 = 0 then 'uncertain' else 'clear' end as dependency,
    case when part % 3 = 0 then null else (part % 100)::bigint end as blocks, case when part % 13 = 0 then 2 else 1 end as nlink from e),
    y as (select *, case when ex then 'excluded' when copy_integrity = 'failed' or source_authorization = 'failed' or cloud_safety = 'unsafe' then 'verification_failed'
        when source_integrity <> 'verified' or destination_integrity <> 'verified' then 'verification_failed' when not removable or dependency <> 'clear' then 'requires_manual_review' else 'eligible_for_review' end as eligibility,
        case when blocks >= 0 then blocks * 512 when nlink > 1 then 0 end as physical, case when nlink > 1 then 'uncertain_hardlink' when blocks >= 0 then 'blocks_estimate' else 'logical_only' end as confidence from x)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    e = entries(spark, sf_dir)
    axes = {
        "copy_integrity": F.when(p % 17 == 0, "failed").otherwise("verified"),
        "source_integrity": F.when(p % 19 == 0, "unknown").otherwise("verified"),
        "destination_integrity": F.when(F.col("state") == "verified", "verified").otherwise("unknown"),
        "source_authorization": F.when(p % 23 == 0, "failed").otherwise("authorized"),
        "cloud_safety": F.when(p % 29 == 0, "unsafe").otherwise("safe"),
        "dependency": F.when(p % 7 == 0, "uncertain").otherwise("clear"),
        "blocks": F.when(p % 3 == 0, None).otherwise(p % 100),
        "nlink": F.when(p % 13 == 0, 2).otherwise(1),
    }
    return sto.allocation(e.withColumns(axes).withColumn("eligibility", sto.eligibility(p % 5 != 0, p % 11 == 0)))


@query(AXES_SQL + " select entry_id, part, eligibility, physical as physical_bytes, confidence from y")
def sto_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-11, STO-12, STO-13."""
    return _candidates(spark, sf_dir).select("entry_id", "part", "eligibility", "physical_bytes", "confidence")


@query(AXES_SQL + """ select plan_id, count(*) filter (eligibility = 'eligible_for_review') as eligible_for_review, count(*) filter (eligibility = 'requires_manual_review') as requires_manual_review, count(*) filter (eligibility = 'excluded') as excluded,
    count(*) filter (eligibility = 'verification_failed') as verification_failed, count(*) filter (source_integrity = 'verified' and destination_integrity = 'verified') as reverified from y group by 1""")
def sto_reclaim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7."""
    return sto.reclaim_counts(_candidates(spark, sf_dir), ["plan_id"])


@query(AXES_SQL + """, z as (select *, eligibility = 'eligible_for_review' as el from y) select plan_id, coalesce(sum(size_bytes) filter (state = 'verified'), 0) as copied_bytes,
    coalesce(sum(size_bytes) filter (source_integrity = 'verified' and destination_integrity = 'verified'), 0) as reverified_bytes, coalesce(sum(size_bytes) filter (el), 0) as removable_bytes,
    case when coalesce(bool_or(el and (physical is null or confidence <> 'blocks_estimate')), false) then null else coalesce(sum(physical) filter (el), 0)::bigint end as physical_bytes,
    case when coalesce(bool_or(el and confidence = 'uncertain_hardlink'), false) then 'uncertain_hardlink' when coalesce(bool_or(el and (physical is null or confidence <> 'blocks_estimate')), false) then 'logical_only'
         when coalesce(bool_or(el and confidence = 'blocks_estimate'), false) then 'blocks_estimate' else 'exact' end as estimate_confidence from z group by 1""")
def sto_reclaim_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8."""
    return sto.reclaim_estimates(_candidates(spark, sf_dir), ["plan_id"])


@query(AXES_SQL + " select plan_id, eligibility, string_agg(entry_id, ',' order by entry_id) as ids from (select distinct plan_id, eligibility, entry_id from y) group by 1, 2")
def sto_ids_by_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22."""
    return _candidates(spark, sf_dir).groupBy("plan_id", "eligibility").agg(F.array_join(F.array_sort(F.collect_set("entry_id")), ",").alias("ids"))


@query("""with m as (select o_orderkey as plan_id, 'v' || (o_custkey % 120) as volume_id, case when o_orderkey % 3 = 0 then null else 's' || (o_custkey % 120) end as serial, 'd' || (o_custkey % 4) as disk from orders),
    v as (select 'v' || s_suppkey as volume_id, case when s_suppkey % 5 = 0 then 'other' when s_suppkey % 7 = 0 then null else 's' || s_suppkey end as serial, null::varchar as disk, case when s_suppkey % 11 = 0 then 'low' else 'high' end as conf,
                 case s_suppkey % 4 when 0 then 'NTFS' when 1 then 'exFAT' when 2 then 'FAT32' else 'ext4' end as fs from supplier)
    select plan_id, case when v.volume_id is null then 'DRIVE_GONE' when conf = 'low' or coalesce(m.serial <> v.serial, false) then 'IDENTITY_CHANGED' when fs = 'ext4' then 'UNSUPPORTED_FS' else 'OK' end as match_code from m left join v using (volume_id)""")
def sto_volume_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-22."""
    c = F.col("o_custkey") % 120
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan_id"), F.concat(F.lit("v"), c).alias("volume_id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("s"), c)).alias("serial"), F.concat(F.lit("d"), F.col("o_custkey") % 4).alias("disk"))
    s = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("v"), s).alias("volume_id"), F.when(s % 5 == 0, "other").when(s % 7 != 0, F.concat(F.lit("s"), s)).alias("serial"), F.lit(None).cast("string").alias("disk"),
        F.when(s % 11 == 0, "low").otherwise("high").alias("identity_confidence"), F.element_at(F.array(*map(F.lit, ("NTFS", "exFAT", "FAT32", "ext4"))), (s % 4 + 1).cast("int")).alias("file_system"),
    )
    return sto.volume_match(m, v).select("plan_id", "match_code")


@query(E + """, g as (select distinct plan_id from e where grant_id % 10 = 0) select 'plan' as kind, plan_id::varchar as id from g union all select 'manifest', 'm' || plan_id from g where plan_id % 2 = 0""")
def sto_grant_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-24."""
    e = entries(spark, sf_dir)
    plans = e.select(F.col("plan_id").cast("string").alias("plan_id"), "grant_id").distinct()
    manifests = e.where("plan_id % 2 = 0").select(F.col("plan_id").cast("string").alias("plan_id"), F.concat(F.lit("m"), "plan_id").alias("manifest_id")).distinct()
    return sto.cascade(e.where("grant_id % 10 = 0").select("grant_id").distinct(), plans, manifests).distinct()


@query("select s_suppkey, floor((1 - greatest(s_acctbal, 0) / 10000) * 1000 + 0.5) / 10 as used_percent, greatest(67108864, ceil(s_acctbal * 1000000 * 0.05))::bigint as margin from supplier")
def sto_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATH-1, MATH-3."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", num.used_percent(F.greatest("s_acctbal", F.lit(0.0)), F.lit(10_000.0)).alias("used_percent"), num.capacity_margin(F.col("s_acctbal") * 1_000_000).alias("margin"))


@query(E + """, r as (select plan_id, sum(size_bytes) as remaining, max(size_bytes) as largest, plan_id % 2 = 0 as excl from e where state <> 'verified' group by 1)
    select plan_id, remaining + greatest(67108864, ceil(remaining * 0.05)) + case when excl then largest else 0 end as required from r""")
def sto_required_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MATH-6."""
    r = entries(spark, sf_dir).where("state <> 'verified'").groupBy("plan_id").agg(F.sum("size_bytes").alias("remaining"), F.max("size_bytes").alias("largest"))
    return r.select("plan_id", num.required_space(F.col("remaining"), F.col("plan_id") % 2 == 0, F.col("largest")).alias("required"))


@query("""with t as (select user_id, ts, event_id, value, sum(value) over (partition by user_id order by epoch_us(ts) range between 4999999 preceding and current row) / 5.0 as rate,
    sum(value) over (partition by user_id) - sum(value) over (partition by user_id order by ts range between unbounded preceding and current row) as remain from events)
    select event_id, round(rate, 4) as rate, case when rate > 0 then ceil(round(remain / rate, 6))::bigint end as eta from t""")
def sto_throughput_5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-6."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = sto.throughput(e, "user_id", "ts", "value")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    remain = F.sum("value").over(w) - F.sum("value").over(w.orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    rate = F.col("bytes_per_second")
    return t.select("event_id", F.round(rate, 4).alias("rate"), F.when(rate > 0, F.ceil(F.round(remain / rate, 6))).alias("eta"))


@query(E + """, j as (select *, case plan_id % 4 when 0 then 'running' when 1 then 'completed' when 2 then 'cancelling' else 'failed' end as status from e)
    select case when status in ('running', 'cancelling') then 'interrupted' else status end as new_status, case when status in ('running', 'cancelling') and state = 'copying' then 'interrupted' else state end as new_state, count(*) as files from j group by 1, 2""")
def sto_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-18."""
    status = F.element_at(F.array(*map(F.lit, ("running", "completed", "cancelling", "failed"))), (F.col("plan_id") % 4 + 1).cast("int"))
    return sto.recover(entries(spark, sf_dir).withColumn("status", status)).groupBy("new_status", "new_state").agg(F.count("*").alias("files"))


@query("select n_nationkey, round(sum(s_acctbal) - sum(case when s_suppkey % 2 = 0 then s_acctbal * 0.9 else s_acctbal end), 4) as freed, count(*) as volumes from supplier join nation on s_nationkey = n_nationkey group by 1")
def sto_free_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-16: free space before less after."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    after = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal") * 0.9).otherwise(F.col("s_acctbal"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.round(F.sum("s_acctbal") - F.sum(after), 4).alias("freed"), F.count("*").alias("volumes"))


@query(E + """ select entry_id, part, case when part % 31 = 0 then 'SESSION_EXPIRED' when part % 29 = 0 then 'MANIFEST_CHANGED' when not coalesce(in_use = false, false) then 'IN_USE' when state <> 'verified' then 'REVALIDATION_FAILED' when source_path like '%.key' then 'UNSAFE_TYPE' else 'ready' end as gate from e""")
def sto_removal_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-21: an unknown gate does not hold."""
    p = F.col("part")
    gate = sto.removal_gate([("SESSION_EXPIRED", p % 31 != 0), ("MANIFEST_CHANGED", p % 29 != 0), ("IN_USE", ~F.col("in_use")), ("REVALIDATION_FAILED", F.col("state") == "verified"), ("UNSAFE_TYPE", ~F.endswith("source_path", F.lit(".key")))])
    return entries(spark, sf_dir).select("entry_id", "part", gate.alias("gate"))


NAMES = ["ok.txt", "", " x", "y.", "a?b", "CON.txt", "lpt1", "fine name.zip"]


@query("select p_partkey, [null, 'empty', 'edge_whitespace', 'ends_with_period', 'invalid_characters', 'reserved_name', 'reserved_name', null][(p_partkey % 8 + 1)::int] as problem from part")
def sto_filename_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sto.filename_problem(name).alias("problem"))


@query(E + ", l as (select entry_id, arg_max(state, (shipped, part)) as state from e group by 1) select state, count(*) as entries from l group by 1")
def sto_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-19, DML-8."""
    return sto.latest_state(entries(spark, sf_dir), "entry_id", F.struct("shipped", "part"), "state").groupBy("state").agg(F.count("*").alias("entries"))


@query(f"""with {PATHS_SQL}, f as (select path from p union all select distinct split_part(path, '/', 1) || '/package.json' from p where page_id % 3 = 0),
    d as (select distinct regexp_replace(path, '/[^/]*$', '') as directory from f where path like '%/package.json')
    select distinct f.path, 'package.json' as markers from f join d on starts_with(f.path, d.directory || '/')""")
def sto_project_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STO-14: a marker at the host of every third page."""
    p = paths(spark, sf_dir)
    markers = p.where("page_id % 3 = 0").select(F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/package.json")).alias("path")).distinct()
    return sto.project_markers(p.select("path").unionByName(markers).distinct(), ["package.json"]).select("path", F.array_join("markers", ",").alias("markers"))


@query(E + " select state, count(*) as files, sum(size_bytes) as bytes, case when count(*) = 0 then 100 else floor(count(*) filter (line <= 3) * 100.0 / count(*) + 0.5)::bigint end as percent from e group by 1")
def sto_transfer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9, AGG-23."""
    done = F.floor(F.count_if(F.col("line") <= 3) * 100 / F.count("*") + 0.5)
    return entries(spark, sf_dir).groupBy("state").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), done.alias("percent"))
