"""Queries of file sources, sinks, versioned tables and providers, each over a whole table."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import numbers as num
from tarn.operators import embedding, lookup, xref
from tarn.plans.registry import query
from tarn.operators.storage import IGNORED_DIRS, sensitive_name
from tarn.sources import files, walk
from tarn.sources.tables import CODE_SQL, EPOCH_MS, INVENTORY_SQL, code_chunks, inventory, table
from tarn.sources.versions import Conflict, VersionedTable
from tarn.streaming import streams


def _folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='spark-source-')}/sources/{uuid.uuid4().hex}"


NORMAL = "regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(0), ''), '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"""with d as (select doc_id, case when octet_length(encode(text)) + doc_id % 2 > 3000 then 'too_large' when doc_id % 2 = 1 then 'binary' end as error, {NORMAL} as t from documents)
    select doc_id::varchar as path, case when error is null then sha256(t) end as digest, error from d""")
def src_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, SRC-9: every second file holds a zero byte."""
    content = F.encode(F.concat("text", F.when(F.col("doc_id") % 2 == 1, F.lit("\x00")).otherwise(F.lit(""))), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return files.read_text(rows, 3000).select("path", F.sha2("text", 256).alias("digest"), "error")


@query(f"""select doc_id::varchar as path, case doc_id % 3 when 0 then sha256({NORMAL}) when 1 then sha256(replace({NORMAL}, 'e', 'E')) end as digest, case when doc_id % 3 = 2 then 'unsupported' end as error from documents""")
def src_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, UDF-4: plain text, an extractor that the caller puts in, and a kind that has none."""
    kind = F.element_at(F.array(*map(F.lit, ("text", "loud", "pdf"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), kind.alias("kind"), F.encode("text", "UTF-8").alias("content"))
    return files.extract(rows, {"loud": lambda raw: raw.decode().replace("e", "E")}).select("path", F.sha2("text", 256).alias("digest"), "error")


@query("select conv_id, turn, span_end - length(text) as span_start, span_end from (select *, sum(length(text) + 2) over (partition by conv_id order by turn)::bigint - 2 as span_end from conversations)")
def src_page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: turns as the pages of a conversation."""
    return files.page_spans(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "span_start", "span_end")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 1 else o_orderkey % 3 end::int as schema_version, o_orderkey % 3 = 2 and o_orderkey % 2 = 0 as has_snapshot from orders")
def src_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20, SRC-21: a third of the journals names no version, half hold a manifest."""
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(n, F.when(n % 3 > 0, n % 3).cast("int").alias("schema_version"), F.when(n % 2 == 0, "{}").alias("manifest_snapshot"))
    return files.journal(rows).select("o_orderkey", "schema_version", "has_snapshot")


def _uuid(n: F.Column) -> F.Column:
    """Ids of which those with a version from 1 to 8 are valid."""
    return F.concat(F.lit("00000000-0000-"), n % 10, F.lit("000-8000-"), F.lpad(n.cast("string"), 12, "0"))


@query("""select conv_id, turn, false as current from conversations where conv_id % 10 between 1 and 8 and conv_id % 4 > 0 union all select conv_id, turn, true from conversations where conv_id % 4 = 0""")
def src_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18, SRC-19, ID-1, SET-1: archived conversations whose ids are UUIDs, and the current ones."""
    c = table(spark, sf_dir, "conversations").withColumn("conversation_id", _uuid(F.col("conv_id")))
    manifest = c.where("conv_id % 4 > 0").select(F.col("conversation_id").alias("id"), F.lit(1).alias("ended_at")).distinct()
    return files.corpus(files.archive(manifest, c), c.where("conv_id % 4 = 0")).select("conv_id", "turn", "current")


@query("select event_id, event_type from events")
def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16, SRC-17, STM-7: appended in two parts with broken lines between, which are left out."""
    e, folder = table(spark, sf_dir, "events").select("event_id", "event_type"), _folder(spark)
    files.append_lines(e.where("event_id % 2 = 0"), folder)
    e.limit(3).select(F.lit("{broken").alias("value")).write.mode("append").text(folder)
    files.append_lines(e.where("event_id % 2 = 1"), folder)
    return files.read_lines(spark, folder, "event_id long, event_type string")


@query("select c_custkey, c_nationkey, 3 as generation from customer where c_custkey % 4 = 0")
def src_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12 to SRC-15, MEM-5, VEC-9, VEC-12: of four writers that race for the second version one wins; a late writer and a reader of another model are refused; an update starts from the live version."""
    t = VersionedTable(spark, _folder(spark))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    first = t.publish(rows, "m")

    def race(_: int) -> bool:
        try:
            return t.publish(rows.where("c_custkey % 2 = 0"), "m", expected=first) > 0
        except Conflict:
            return False

    with ThreadPoolExecutor(4) as pool:
        won = sum(pool.map(race, range(4)))
    refused = 0
    for late in (lambda: t.publish(rows, "m", expected=first), lambda: t.read("other")):
        try:
            late()
        except (Conflict, ValueError):
            refused += 1
    last = t.update(lambda held: held.where("c_custkey % 4 = 0"), "m")
    return t.read("m").withColumn("generation", F.lit(last if (refused, won) == (2, 1) else -1))


def _spill(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each document: in folders of a hundred, some hidden, some empty, some in folders that are not entered."""
    folder = walk.local_path(_folder(spark))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):  # a text leaves Arrow when its turn comes
                i, text = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                parts = [folder, f"d{i // 100}", *(["Node_Modules"] if i % 11 == 0 else []), f"{'.' if i % 5 == 0 else '_' if i % 5 == 1 else ''}f{i}.{'TXT' if i % 2 else 'pem' if i % 7 == 0 else 'md'}"]
                os.makedirs(os.path.dirname(os.path.join(*parts)), exist_ok=True)
                with open(os.path.join(*parts), "wb") as f:
                    f.write(b"" if i % 13 == 0 else text.encode())
            yield batch.select([0])

    table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return folder


SPILLED = """w as (select doc_id, case when doc_id % 13 = 0 then '' else coalesce(text, '') end as body, doc_id % 11 = 0 as inside, case when doc_id % 5 = 0 then '.' when doc_id % 5 = 1 then '_' else '' end || 'f' || doc_id || '.' || case when doc_id % 2 = 1 then 'TXT' when doc_id % 7 = 0 then 'pem' else 'md' end as name from documents)"""


@query(f"with {SPILLED}, k as (select *, not inside and name like '%.pem' as held from w) select count_if(not inside and not held) as files, coalesce(sum(strlen(body)) filter (not inside and not held), 0)::bigint as bytes, count_if(held) + count(distinct case when inside then doc_id // 100 end) as skipped_count, 0::bigint as error_count, false as truncated from k")
def src_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-8, AGG-5: an inventory of files that Spark's readers would pass over, with its counters."""
    return walk.summary(walk.inventory(spark, _spill(spark, sf_dir), IGNORED_DIRS, sensitive_name))


@query(f"with {SPILLED} select 'd' || (doc_id // 100) || case when inside then '/Node_Modules' else '' end || '/' || name as relative_path, strlen(body)::bigint as size, sha256(body) as sha256 from w")
def src_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HASH-4: streamed digests of all files of a folder."""
    folder = _spill(spark, sf_dir)
    return files.file_digests(spark, folder).select(F.substring("path", F.length(F.lit(os.path.realpath(folder))) + 2, F.length("path")).alias("relative_path"), "size", "sha256")


@query("""with l as (select user_id % 64 as log, event_id, event_id % 9 <> 0 as whole, row_number() over (partition by user_id % 64 order by event_id desc) as back from events)
    select log, row_number() over (partition by log order by back)::int as position, event_id from l where back <= 200 and whole qualify row_number() over (partition by log order by back) <= 50""")
def src_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, DIA-13: all events in 64 logs with broken lines in them; of each log the newest 50 records of the last 200 lines."""
    e, folder = table(spark, sf_dir, "events").withColumn("log", F.col("user_id") % 64), _folder(spark)
    line = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "event_type", "props")))
    e.repartition("log").sortWithinPartitions("log", "event_id").select("log", line.alias("value")).write.partitionBy("log").text(folder)
    logs = walk.walk(spark, folder).where("skipped is null and name like 'part-%'")
    found = walk.feeds(logs, "event_id long", 50)
    return found.select(F.regexp_extract("path", r"log=(\d+)/", 1).cast("long").alias("log"), "position", F.col("record.event_id").alias("event_id"))


@query("select conv_id, turn, case when conv_id % 3 = 0 then turn::int else -conv_id::int end as started_at, case when conv_id % 3 = 0 then turn::int + 1 else -conv_id::int + 1 end as ended_at from conversations")
def mem_unit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-6: chunks of unknown units keep their own times."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("int").alias("started_at"), (F.col("turn").cast("int") + 1).alias("ended_at"))
    n = F.col("conv_id").cast("int")
    units = c.where("conv_id % 3 > 0").select("conv_id").distinct().select("conv_id", (-n).alias("started_at"), (1 - n).alias("ended_at"))
    return lookup.unit_times(c, units, "conv_id").select("conv_id", "turn", "started_at", "ended_at")


@query(f"with {INVENTORY_SQL} select doc_id, ({EPOCH_MS} + 31536500000 - mtime_ms) / 86400000.0 > 365 as old from f")
def num_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-5: a clock a year and some minutes after the first file."""
    return inventory(spark, sf_dir).select("doc_id", (num.age_days(F.col("mtime_ms"), EPOCH_MS + 31_536_500_000) > 365).alias("old"))


@query("select doc_id, length(text)::double as size, (length(text) - length(replace(text, 'e', '')))::double as es from documents")
def vec_embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-11, SRC-25, UDF-1: a provider that the caller puts in, in batches of 16."""

    def provider(texts: list[str]) -> list[list[float]]:
        assert len(texts) <= embedding.BATCH
        return [[float(len(t)), float(t.count("e"))] for t in texts]

    found = embedding.embed(table(spark, sf_dir, "documents"), "doc_id", "text", provider)
    return found.select("doc_id", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("es"))


@query("select event_type, count(*) as events from events group by 1")
def str_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-8: the same events come twice, in two streams; the target holds each once."""
    folder = _folder(spark)
    for k in range(2):
        stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
        streams.append_table(stream, f"{folder}/target", "event_id", f"{folder}/check{k}")
    return spark.read.parquet(f"{folder}/target").groupBy("event_type").agg(F.count("*").alias("events"))


WANTED = ["openRegion", "fetchRegion1", "load_brazil", "rows_brazil", "options"]
KIND = "case when regexp_matches(content, '\\b(function|class|const|let|var|def)\\s+' || s || '\\b') then 'definition' when regexp_matches(content, 'import\\s*\\{[^}]*\\b' || s || '\\b') then 'import' when regexp_matches(content, '(^|[^A-Za-z0-9_$.])' || s || '\\s*\\(') then 'call' else 'reference' end"


@query(f"""with {CODE_SQL}, w as (select unnest({WANTED}) as s, unnest(range(1, {len(WANTED) + 1})) as position), m as (select chunk_id, s, position, {KIND} as kind from c join w on regexp_matches(content, '\\b' || s || '\\b')),
    r as (select *, case when kind = 'definition' and regexp_matches(s, '^[a-z][a-z0-9]*$') then 3 when kind = 'definition' then 0 when kind = 'call' then 1 when kind = 'import' then 2 else 3 end as rank from m)
    select chunk_id, s as symbol, kind as raw_category from r qualify row_number() over (partition by chunk_id order by rank, position) = 1""")
def xref_symbol_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-3, XREF-6, JOIN-16: of five wanted symbols the best evidence in each chunk."""
    wanted = spark.createDataFrame([(s, k) for k, s in enumerate(WANTED, 1)], "symbol string, position int")
    return xref.symbol_matches(code_chunks(spark, sf_dir), wanted)


@query(f"""with {CODE_SQL}, w as (select unnest(['/api/region/3', '/api/region', '/api/region/1']) as s, unnest([1, 2, 3]) as position)
    select chunk_id, s as symbol, 'route' as raw_category from c join w on regexp_matches(content, s || '([^A-Za-z0-9_/-]|$)') qualify row_number() over (partition by chunk_id order by position) = 1""")
def xref_route_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-7, JOIN-17: a route must occur whole, so a longer one is no match."""
    wanted = spark.createDataFrame([("/api/region/3", 1), ("/api/region", 2), ("/api/region/1", 3)], "symbol string, position int")
    return xref.route_matches(code_chunks(spark, sf_dir), wanted)
