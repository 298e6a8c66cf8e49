"""The symbol index: which chunks show which symbols and routes, extracted once (XREF-6, XREF-7, XREF-8).

Two tables.  ``chunks`` has a row per chunk, without its content: what it refers to, in order,
and the flags that scores ask for.  ``postings`` has a row per chunk and symbol or route, cut
into ranges of the symbol and sorted by it, so a lookup of a few names reads the row groups
that hold them and no others; a symbol that a third of all chunks show spans many files.

A search keeps its state between hops: names already asked for and the few seeds of a hop,
which are bounded by ``MAX_SYMBOLS`` and ``MAX_SEEDS``, and a frontier table of the chunks
reached, of any size, which is cut from its lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import api_routes, identifiers, slashed
from tarn.operators import xref
from tarn.session import cut, scratch


@dataclass(frozen=True)
class SymbolIndex:
    chunks: DataFrame
    postings: DataFrame


@dataclass(frozen=True)
class Wanted:
    """What a hop asks for, in order of position; names asked for before are left out."""

    symbols: list[str]
    routes: list[str]


def build(chunks: DataFrame, folder: str | None = None) -> SymbolIndex:
    """Write the index of (chunk_id, file_path, content, ...) to a folder and open it."""
    folder = folder or scratch(chunks.sparkSession, "symbols")
    content, path = F.col("content"), F.col("file_path")
    routes = F.array_distinct(F.regexp_extract_all(content, F.lit(r"(/api/[A-Za-z0-9][A-Za-z0-9_/-]*)"), F.lit(1)))
    rows = chunks.select(
        "chunk_id",
        slashed(path).alias("file"),
        xref.implementation(path).alias("impl"),
        xref.type_only(path, content).alias("types"),
        xref.options_call(content).alias("options_call"),
        F.slice(xref.symbols(content), 1, xref.MAX_SYMBOLS_CHUNK).alias("out_symbols"),
        F.slice(api_routes(content), 1, xref.MAX_ROUTES_CHUNK).alias("out_routes"),
        F.array_distinct(identifiers(content)).alias("all"),
        *[F.array_distinct(xref.named(content, role)).alias(role) for role in ("declared", "imported", "called")],
        routes.alias("routes"),
    )
    rows.write.parquet(f"{folder}/chunks")
    held = chunks.sparkSession.read.schema(rows.schema).parquet(f"{folder}/chunks")
    shown = lambda role: F.array_contains(role, F.col("symbol"))
    category = F.when(shown("declared"), "definition").when(shown("imported"), "import").when(shown("called"), "call").otherwise("reference")
    names = held.select("chunk_id", "file", "impl", F.explode("all").alias("symbol"), "declared", "imported", "called").where(F.length("symbol") >= 3)
    places = ["chunk_id", "file", "impl", "symbol"]
    postings = names.select(*places, category.alias("raw_category")).unionByName(held.select("chunk_id", "file", "impl", F.explode("routes").alias("symbol")).withColumn("raw_category", F.lit("route")))
    ranked = postings.withColumn("rank", xref.category_rank(F.col("raw_category"), F.col("symbol")))
    ranked.repartitionByRange("symbol", "chunk_id").sortWithinPartitions("symbol", "chunk_id").write.parquet(f"{folder}/postings")
    return opened(chunks.sparkSession, folder)


def opened(spark: SparkSession, folder: str) -> SymbolIndex:
    return SymbolIndex(spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/postings"))


def rounds(lists: list[list[str]], most: int = xref.MAX_SYMBOLS) -> list[str]:
    """CF-4 for the few seeds of a hop: the lists' first names, then their second ones, first appearances, until a round adds none."""
    found: dict[str, None] = {}
    for k in range(max(map(len, lists), default=0)):
        before = len(found)
        found.update(dict.fromkeys(names[k] for names in lists if k < len(names)))
        if len(found) == before:
            break
    return list(found)[:most]


def referred(index: SymbolIndex, seeds: list, asked: Wanted | None = None) -> tuple[Wanted, list[str]]:
    """What the seed chunks refer to, in their order; and the seeds' files."""
    found = {r["chunk_id"]: r for r in index.chunks.where(F.col("chunk_id").isin(seeds)).select("chunk_id", "file", "out_symbols", "out_routes").collect()}
    rows = [found[s] for s in seeds if s in found]
    names, routes = (rounds([list(r[c]) for r in rows]) for c in ("out_symbols", "out_routes"))
    if asked is not None:
        before = {*asked.symbols, *asked.routes}
        names, routes = ([n for n in one if n not in before] for one in (names, routes))
    return Wanted(names, routes), sorted({r["file"] for r in rows})


def _list(names: list[str]) -> Column:
    return F.array(*map(F.lit, names)).cast("array<string>")


def matches(index: SymbolIndex, wanted: Wanted) -> DataFrame:
    """(chunk_id, file, impl, symbol, raw_category, rank): of each chunk the best evidence of a wanted symbol, or a wanted route."""
    symbol, route = F.col("symbol"), F.col("raw_category") == "route"
    hits = index.postings.where(symbol.isin([*wanted.symbols, *wanted.routes])).where(F.when(route, symbol.isin(wanted.routes)).otherwise(symbol.isin(wanted.symbols)))
    place = F.when(route, F.array_position(_list(wanted.routes), symbol)).otherwise(F.array_position(_list(wanted.symbols), symbol))
    # A chunk's symbols compete by rank and position, its routes by position alone; the two winners by rank and name.
    entry = lambda kind, first: F.min(F.when(kind, F.struct(first.alias("first"), place.alias("place"), "rank", "symbol", "raw_category")))
    best = hits.groupBy("chunk_id", "file", "impl").agg(entry(~route, F.col("rank")).alias("s"), entry(route, F.lit(0)).alias("r"))
    final = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.rank", f"{c}.symbol", f"{c}.raw_category"))
    return best.select("chunk_id", "file", "impl", F.least(final("s"), final("r")).alias("m")).select("chunk_id", "file", "impl", "m.symbol", "m.raw_category", "m.rank")


def expand(index: SymbolIndex, seeds: list) -> DataFrame:
    """XREF-8: (chunk_id, symbol, raw_category, cross_file, hop) of two hops from seed chunks in order; the earlier hop wins, seeds are no matches."""
    asked, files = referred(index, seeds)
    apart = lambda found, own: found.withColumn("cross_file", ~F.col("file").isin(own))
    first = cut(apart(matches(index, asked).where(~F.col("chunk_id").isin(seeds)), files))
    strong = first.where("impl").where(F.col("raw_category").isin("definition", "call", "route")).orderBy("rank", "chunk_id").limit(xref.MAX_SEEDS)
    further = sorted(r["chunk_id"] for r in strong.select("chunk_id").collect())
    more, files = referred(index, further, asked)
    second = apart(matches(index, more).where(~F.col("chunk_id").isin(seeds)), files).join(first.select("chunk_id"), "chunk_id", "left_anti")
    both = first.withColumn("hop", F.lit(0)).unionByName(second.withColumn("hop", F.lit(1)))
    return both.select("chunk_id", "symbol", "raw_category", "cross_file", "hop")
