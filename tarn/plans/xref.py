"""Cross-reference queries over code chunks made from the nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import api_routes
from tarn.operators import xref
from tarn.plans.registry import query
from tarn.sources.tables import CODE_SQL, code_chunks

C = f"with {CODE_SQL}"


@query(C + """ select k * 3 + i as chunk_id, case i when 0 then 'load_' || n || ',fetchRegion' || r when 1 then 'rows_' || n || ',load_' || n else 'fetchRegion' || r || ',openRegion' end as symbols from x""")
def xref_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-1: declared, imported, called, shaped."""
    return code_chunks(spark, sf_dir).select("chunk_id", F.array_join(xref.symbols(F.col("content")), ",").alias("symbols"))


SEEDS = ", sd as (select *, row_number() over (order by chunk_id) as o from c where chunk_id < 12)"
INTERLEAVED = SEEDS + """, one as (select o, s.i - 1 as round, s.symbol from (select o, unnest(case when file_path like 'py/%' then [regexp_extract(content, 'def ([A-Za-z0-9_]+)', 1), 'openRegion']
        when file_path like 'src/use%' then [regexp_extract(content, 'const ([A-Za-z0-9_]+)', 1), regexp_extract(content, 'import \\{ ([A-Za-z0-9_]+)', 1)] else [regexp_extract(content, 'function ([A-Za-z0-9_]+)', 1), regexp_extract(content, 'return ([A-Za-z0-9_]+)', 1)] end) as symbol, unnest([1, 2]) as i from sd) s),
    fi as (select symbol, round, o, row_number() over (partition by symbol order by round, o) as rn from one), po as (select symbol, row_number() over (order by round, o) as position from fi where rn = 1)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_chunks(spark, sf_dir).where("chunk_id < 12").withColumn("o", F.row_number().over(Window.orderBy("chunk_id")))


@query(C + INTERLEAVED + " select symbol, position from po where position <= 40")
def xref_symbol_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-4."""
    found = xref.interleave(_seeds(spark, sf_dir), "o", xref.symbols(F.col("content")))
    return found.select("symbol", F.col("position").cast("long").alias("position"))


@query(C + """ select k * 3 + i as chunk_id, s as symbol, case when i = 0 and s like 'load_%' then 'definition' when i = 0 then 'call' when i = 1 and s like 'load_%' then 'import' when i = 1 then 'definition' when s like 'fetch%' then 'definition' else 'call' end as raw_category
    from (select k, i, unnest(case i when 0 then ['load_' || n, 'fetchRegion' || r] when 1 then ['rows_' || n, 'load_' || n] else ['fetchRegion' || r, 'openRegion'] end) as s from x)""")
def xref_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-2 for the useful symbols of a chunk."""
    c = code_chunks(spark, sf_dir)
    wanted = c.select("chunk_id", F.explode(xref.symbols(F.col("content"))).alias("symbol"))
    return xref.occurrences(c).join(wanted, ["chunk_id", "symbol"])


@query(C + " select k * 3 + i as chunk_id, '/api/region/' || r as routes from x where i = 0")
def xref_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18: a comment's route is not quoted."""
    c = code_chunks(spark, sf_dir).select("chunk_id", api_routes(F.col("content")).alias("r"))
    return c.where(F.size("r") > 0).select("chunk_id", F.array_join("r", ",").alias("routes"))


def _flags(c: DataFrame) -> DataFrame:
    k = F.col("chunk_id")
    return c.select(
        "chunk_id", "file_path", "start_line", "end_line", "content", "similarity",
        F.element_at(F.array(*map(F.lit, ("definition", "call", "route", "import", "reference"))), (k % 5 + 1).cast("int")).alias("raw_category"),
        F.when(k % 2 == 0, "loadRows").otherwise("rows").alias("symbol"),
        F.when(k % 3 == 0, 1).otherwise(0).alias("hop"), (k % 4 != 0).alias("cross_file"), xref.implementation(F.col("file_path")).alias("impl"),
        (k % 7 < 3).alias("defined_in_selected"), (k % 2 == 0).alias("route_selected"), (k % 11 == 0).alias("file_selected"), xref.options_call(F.col("content")).alias("options_call"),
    )


SCORE = C + """, g as (select c.*, ['definition', 'call', 'route', 'import', 'reference'][(chunk_id % 5 + 1)::int] as raw, chunk_id % 2 <> 0 as weak, chunk_id % 3 = 0 as h2, chunk_id % 4 <> 0 as crossf, chunk_id % 7 < 3 as known, chunk_id % 2 = 0 as rs, chunk_id % 11 = 0 as fs,
        file_path like 'src/use%' as opt from c),
    h as (select *, case when raw = 'definition' and weak then 'reference' else raw end as cat from g),
    sc as (select *, case cat when 'definition' then 120 when 'call' then 110 when 'route' then 110 when 'import' then 70 else 8 end * case when h2 then 0.5 else 1 end + case when crossf then 40 else 0 end + case when h2 then 0 else 50 end
        + case when not h2 and raw = 'definition' and not known then 60 else 0 end + case when raw = 'definition' and known then -55 else 0 end + case when raw = 'import' and known then -60 else 0 end
        + case when h2 and raw = 'call' and not weak then 110 else 0 end + case when not h2 and raw = 'call' and crossf and known and not weak then 110 else 0 end + case when raw = 'route' and crossf and rs then 110 else 0 end
        + case when fs and raw <> 'definition' then -80 else 0 end + case when not h2 and cat in ('call', 'reference') and opt then 110 else 0 end as score from h)"""


@query(SCORE + " select chunk_id, round(score, 4) as score from sc")
def xref_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-9: every term appears for some chunk."""
    return _flags(code_chunks(spark, sf_dir)).select("chunk_id", F.round(xref.match_score(), 4).alias("score"))


@query(SCORE + """, p as (select *, chunk_id % 10 = 0 as semantic, case when chunk_id % 10 = 0 then 800 + similarity else least(790, 520 + score + similarity) end as total, chunk_id in (20, 33) as prot from sc),
    f as (select *, row_number() over (partition by lower(file_path) order by prot desc, total desc, similarity desc, lower(file_path), start_line, end_line) as rn from p),
    r as (select *, row_number() over (order by prot desc, total desc, similarity desc, lower(file_path), start_line, end_line) as rank from f where rn <= 2)
    select chunk_id, round(total, 4) as score, rank from r where rank <= 8""")
def xref_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XREF-10, XREF-11."""
    c = _flags(code_chunks(spark, sf_dir)).withColumn("own", xref.match_score())
    semantic = F.col("chunk_id") % 10 == 0
    total = xref.selection_score(semantic, F.col("impl"), xref.type_only(F.col("file_path"), F.col("content")), F.col("own"), F.col("similarity"))
    pool = c.withColumn("score", total).withColumn("protected", F.col("chunk_id").isin(20, 33))
    return xref.select(pool, 8).select("chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))
