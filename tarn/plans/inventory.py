"""Inventory and content-index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import storage as sto
from tarn.plans.registry import query
from tarn.sources.tables import INVENTORY_SQL, inventory

INV = f"with {INVENTORY_SQL}"
SKIP = "(folder = 'node_modules' or name like '.env%')"
KIND = "case when extension in ('txt', 'md') then 'text' when extension = 'pdf' then 'pdf' end"


@query(f"{INV} select root_id, count(*) filter (not {SKIP}) as file_count, coalesce(sum(size) filter (not {SKIP}), 0)::bigint as total_bytes, count(*) filter ({SKIP}) as skipped_count from f group by 1")
def inv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, SRC-2."""
    return sto.inventory_summary(inventory(spark, sf_dir), ["root_id"])


@query(f"{INV}, k as (select * from f where root_id = 'src1' and (contains(lower(name), 'file_1') or contains(lower(relative_path), 'file_1'))) select name, size, (select count(*) from k) as total from k order by lower(name), relative_path, absolute_path limit 10 offset 2")
def inv_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, ORD-4."""
    return sto.search_page(inventory(spark, sf_dir), "FILE_1", root="src1", offset=2, limit=10).select("name", "size", "total")


@query(f"{INV} select name, relative_path from f where extension = 'txt' order by lower(name), relative_path, absolute_path limit 100")
def inv_sort_name_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-3: case- and accent-insensitive; a limit out of range is 100."""
    return sto.search_page(inventory(spark, sf_dir), ext=".TXT", limit=1000).select("name", "relative_path")


@query(f"{INV} select absolute_path, size from f order by size desc, relative_path desc, absolute_path desc limit 20")
def inv_sort_size_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-3: the direction turns the tie-break too."""
    return sto.search_page(inventory(spark, sf_dir), sort="size", descending=True, limit=20).select("absolute_path", "size")


@query(f"""{INV}, c as (select distinct '/data/' || root_id || case when root_id = 'src1' then '' when root_id = 'src2' then '/en' else 'x' end as candidate from f union all select '/data'),
    r(root_no, root) as (values (0, '/data/src1'), (1, '/data/src2'), (2, '/data/src3'))
    select candidate, case when r.root is null then null when candidate = r.root then 'duplicate' when starts_with(candidate, r.root || '/') then 'inside' else 'contains' end as relation, r.root as root from c
    left join r on candidate = r.root or starts_with(candidate, r.root || '/') or starts_with(r.root, candidate || '/')
    qualify row_number() over (partition by candidate order by root_no) = 1""")
def inv_root_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11."""
    tail = F.when(F.col("root_id") == "src1", "").when(F.col("root_id") == "src2", "/en").otherwise("x")
    c = inventory(spark, sf_dir).select(F.concat(F.lit("/data/"), "root_id", tail).alias("candidate")).distinct().unionByName(spark.sql("select '/data' as candidate"))
    roots = spark.createDataFrame([(0, "/data/src1"), (1, "/data/src2"), (2, "/data/src3")], "root_no int, root string")
    return sto.root_overlap(c, roots)


@query(f"{INV} select root_id, count(*) as files from f where root_id not in ('src1', 'src2') group by 1")
def inv_prune_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-23, DML-3."""
    gone = spark.createDataFrame([("src1",), ("src2",)], "root_id string")
    return inventory(spark, sf_dir).join(gone, "root_id", "left_anti").groupBy("root_id").agg(F.count("*").alias("files"))


@query(f"{INV} select name, root_id from f where name like '.env%'")
def inv_sensitive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2."""
    return inventory(spark, sf_dir).where(sto.sensitive_name(F.col("name"))).select("name", "root_id")


STATUS = f"""{INV}, prev as (select root_id, absolute_path, case when doc_id % 7 = 0 then 'old' else fingerprint end as pf, case when doc_id % 11 = 0 then 'error' else 'indexed' end as ps, case when doc_id % 13 = 0 then 0 else 1 end as pv from f where doc_id % 5 <> 0),
    x as (select f.*, case when doc_id % 17 = 0 then 'stale' when doc_id % 19 = 0 then 'sensitive' end as validation, case when doc_id % 23 = 0 then 'pdf_extract_failed' end as extract_error,
                 size * case when doc_id % 29 = 0 then 1000000 else 1 end as big, case when doc_id % 31 = 0 then '  ' else text end as body from f),
    st as (select x.*, case when {KIND} is null then 'unsupported' when big > 10485760 then 'too_large' when pf = fingerprint and ps = 'indexed' and pv = 1 then 'reused'
                 when validation is not null then validation when extract_error is not null then 'error' when trim(body) = '' then 'no_text' else 'indexed' end as status from x left join prev using (root_id, absolute_path))"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = inventory(spark, sf_dir).withColumn("extractor_version", F.lit(1)).withColumn("embedding_model", F.lit("m"))
    d = F.col("doc_id")
    prev = f.where("doc_id % 5 <> 0").select(
        "root_id", "absolute_path", F.when(d % 7 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(d % 11 == 0, "error").otherwise("indexed").alias("status"),
        F.when(d % 13 == 0, 0).otherwise(1).alias("extractor_version"), "embedding_model",
    )
    now = (
        f.withColumn("validation", F.when(d % 17 == 0, "stale").when(d % 19 == 0, "sensitive"))
        .withColumn("extract_error", F.when(d % 23 == 0, "pdf_extract_failed"))
        .withColumn("size", F.col("size") * F.when(d % 29 == 0, 1_000_000).otherwise(1))
        .withColumn("text", F.when(d % 31 == 0, "  ").otherwise(F.col("text")))
    )
    return sto.index_status(now, prev)


@query(STATUS + " select doc_id, status from st")
def idx_status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DML-2."""
    return _status(spark, sf_dir).select("doc_id", "status")


@query(STATUS + """ select count(*) as inventory_files, count(*) filter (status in ('indexed', 'reused', 'stale', 'too_large', 'no_text', 'error')) as supported_files, count(*) filter (status in ('indexed', 'reused')) as indexed_files,
    count(*) filter (status = 'reused') as reused_files, count(*) filter (status = 'stale') as stale_files, count(*) filter (status = 'unsupported') as unsupported_files, count(*) filter (status = 'too_large') as too_large_files,
    count(*) filter (status = 'no_text') as no_text_files, count(*) filter (status = 'error') as error_files, count(*) filter (status in ('unsafe', 'sensitive')) as unsafe_files from st""")
def idx_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2."""
    return sto.index_summary(_status(spark, sf_dir))


@query(STATUS + ", b as (select * from st where status in ('error', 'stale', 'too_large', 'no_text', 'unsupported', 'unsafe', 'sensitive')) select absolute_path, status, (select count(*) from b) as issue_count from b order by absolute_path limit 100")
def idx_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3."""
    return sto.index_issues(_status(spark, sf_dir)).select("absolute_path", "status", "issue_count")


CHUNKS = ", ch as (select f.*, unnest(range(0, greatest(1, ceil(size / 1500.0))::bigint)) as chunk_index from f)"


def _chunks(files: DataFrame) -> DataFrame:
    last = (F.greatest(F.lit(1), F.ceil(F.col("size") / 1500)) - 1).cast("int")
    return files.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index")).withColumn("content", F.substring(F.col("text"), F.col("chunk_index") * 1500 + 1, F.lit(1500)))


@query(STATUS + CHUNKS + ", k as (select ch.doc_id, ch.chunk_index from ch join st using (doc_id) where st.status = 'reused') select doc_id, count(*) as chunks from k group by 1")
def idx_reuse_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-2: prior chunks of reused files, by a semi-join."""
    prior = _chunks(inventory(spark, sf_dir))
    reused = _status(spark, sf_dir).where("status = 'reused'")
    return prior.join(reused, ["root_id", "absolute_path", "fingerprint"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query(STATUS + CHUNKS + """ select case st.status when 'reused' then 'reused' else 'embedded' end as origin, count(*) as chunks, count(distinct doc_id) as files from ch join st using (doc_id) where st.status in ('reused', 'indexed') group by 1""")
def idx_union_reused_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-2."""
    prior, status = _chunks(inventory(spark, sf_dir)), _status(spark, sf_dir)
    keys = ["root_id", "absolute_path", "fingerprint"]
    part = lambda s, o: prior.join(status.where(F.col("status") == s), keys, "left_semi").select("doc_id", F.lit(o).alias("origin"))
    return part("reused", "reused").unionByName(part("indexed", "embedded")).groupBy("origin").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("files"))


@query(f"""{INV}{CHUNKS}, c as (select doc_id, chunk_index, least(1500, size - chunk_index * 1500) as n, max(chunk_index) over (partition by doc_id) as last from ch),
    p as (select *, row_number() over w as k, sum(n) over w as used from c where chunk_index >= 1 window w as (partition by doc_id order by chunk_index)),
    q as (select * from p where k = 1 or (k <= 6 and used <= 5000))
    select doc_id, count(*) as shown, max(last) > max(chunk_index) as has_more, case when max(last) > max(chunk_index) then max(chunk_index) + 1 end as next_chunk from q group by 1""")
def idx_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD-10: pages of at most six chunks and 5,000 characters, from the second chunk."""
    page = sto.file_page(_chunks(inventory(spark, sf_dir)).where("chunk_index >= 1").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content"), "doc_id", 1, 6, 5000)
    return page.groupBy("doc_id").agg(F.count("*").alias("shown"), F.first("has_more").alias("has_more"), F.first("next_chunk").alias("next_chunk"))


@query(f"{INV} select extension, count(*) as files, sum(size)::bigint as bytes, {KIND} as kind from f group by extension")
def inv_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, AGG-18."""
    return inventory(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("kind", sto.content_kind(F.col("extension")))


@query(f"""{INV} select extension, max(mtime_ms) as newest, min(absolute_path) as first_path from f where root_id in ('src3', 'src4') and size between 100 and 100000 group by 1""")
def inv_filter_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7: filters on root and size reach the scan."""
    return inventory(spark, sf_dir).where(F.col("root_id").isin("src3", "src4") & F.col("size").between(100, 100_000)).groupBy("extension").agg(F.max("mtime_ms").alias("newest"), F.min("absolute_path").alias("first_path"))
