"""UDF-3, PRJ-4: named table functions with checked arguments; those that read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import diagnostics, storage
from tarn.plans.registry import query
from tarn.sources.tables import inventory, paths, samples, table


@dataclass(frozen=True)
class Argument:
    kind: type
    required: bool = False
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Tool:
    name: str
    permission: str
    arguments: dict[str, Argument]
    run: Callable[..., DataFrame] | None = None

    def check(self, given: dict) -> dict:
        """The arguments, if they are known, complete, of their kind and within bounds."""
        if unknown := set(given) - set(self.arguments):
            raise ValueError(f"{self.name} takes no {', '.join(sorted(unknown))}")
        for name, a in self.arguments.items():
            if name not in given:
                if a.required:
                    raise ValueError(f"{self.name} needs {name}")
                continue
            v = given[name]
            if not isinstance(v, a.kind) or (a.kind is int and isinstance(v, bool)):
                raise ValueError(f"{name} must be of type {a.kind.__name__}")
            if (a.low is not None and v < a.low) or (a.high is not None and v > a.high):
                raise ValueError(f"{name} must be from {a.low} to {a.high}")
        return given

    def __call__(self, spark: SparkSession, sf_dir: str, **given) -> DataFrame:
        if self.run is None:
            raise PermissionError(f"{self.name} changes files; it is named here but does nothing")
        return self.run(spark, sf_dir, **self.check(given))


def _search(spark: SparkSession, sf_dir: str, query: str, max_results: int = 50) -> DataFrame:
    return storage.search_page(inventory(spark, sf_dir), query, limit=max_results).select("name", "absolute_path", "size")


def _list(spark: SparkSession, sf_dir: str, path: str, max_depth: int = 1) -> DataFrame:
    """SRC-5: at most 500 entries, and whether there are more."""
    below = F.split(F.substring("path", len(path) + 2, 1 << 30), "/")
    found = paths(spark, sf_dir).where(F.startswith("path", F.lit(path + "/")) & (F.size(below) <= max_depth))
    total = found.agg((F.count("*") > 500).alias("truncated"))
    return found.orderBy("path", "page_id").limit(500).crossJoin(F.broadcast(total))


def _usage(spark: SparkSession, sf_dir: str, top: int = 15) -> DataFrame:
    return storage.largest(storage.directory_sizes(paths(spark, sf_dir)), "bytes", "directory", top=top)


def _processes(spark: SparkSession, sf_dir: str, top: int = 40) -> DataFrame:
    p = samples(spark, sf_dir).groupBy("pid").agg(F.max("memory").alias("memory"))
    return diagnostics.top_processes(p, "memory", "pid", top=top)


def _events(spark: SparkSession, sf_dir: str, log_name: str, max_results: int = 25) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == log_name).orderBy(F.desc("ts"), "event_id").limit(max_results)


_top = Argument(int, low=1, high=500)
TOOLS = {
    t.name: t
    for t in (
        Tool("list_directory", "read", {"path": Argument(str, True), "max_depth": Argument(int, low=1, high=4)}, _list),
        Tool("search_files", "read", {"query": Argument(str, True), "max_results": Argument(int, low=1, high=50)}, _search),
        Tool("inspect_disk_usage", "read", {"top": _top}, _usage),
        Tool("inspect_processes", "read", {"top": _top}, _processes),
        Tool("inspect_event_log", "read", {"log_name": Argument(str, True), "max_results": Argument(int, low=1, high=25)}, _events),
        *(Tool(n, "write", {}) for n in ("create_directory", "copy_file", "move_file", "rename_file", "copy_and_verify_files", "request_reclaim_removal")),
        *(Tool(n, "blocked", {}) for n in ("delete_path", "overwrite_file", "run_shell", "install_software")),
    )
}


@query("select permission, tools from (values ('blocked', 'delete_path,install_software,overwrite_file,run_shell'), ('read', 'inspect_disk_usage,inspect_event_log,inspect_processes,list_directory,search_files'), ('write', 'copy_and_verify_files,copy_file,create_directory,move_file,rename_file,request_reclaim_removal')) t(permission, tools)")
def ui_tools_by_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UI-5."""
    named = spark.createDataFrame([(t.name, t.permission) for t in TOOLS.values()], "name string, permission string")
    return named.groupBy("permission").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("tools"))


@query("select event_id, value from events where event_type = 'error' order by ts desc, event_id limit 10")
def tool_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TOOLS["inspect_event_log"](spark, sf_dir, log_name="error", max_results=10).select("event_id", "value")


@query("select s_suppkey from supplier where s_suppkey % 4 in (1, 2) and s_suppkey % 11 <> 0")
def ui_eligible_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UI-1, FLT-19."""
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, ("internal", "external", "removable", "unknown"))), (k % 4 + 1).cast("int")).alias("classification"), F.when(k % 11 == 0, "low").otherwise("high").alias("identity"))
    return v.where(F.col("classification").isin("external", "removable") & (F.col("identity") != "low")).select("s_suppkey")


@query("select l_orderkey as plan_id, count(*) as selected, sum(l_quantity) * 1000000 as bytes from lineitem where l_linenumber <= 2 and l_partkey % 5 <> 4 group by 1")
def ui_selected_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UI-2, UI-4, SET-5: what was selected and still can be, summed."""
    from tarn.sources.tables import entries

    e = entries(spark, sf_dir)
    selectable = e.where(~F.endswith("source_path", F.lit(".key")))
    return selectable.where("line <= 2").groupBy("plan_id").agg(F.count("*").alias("selected"), F.sum("size_bytes").alias("bytes"))


@query("""with a as (select doc_id from documents where doc_id % 3 = 0), b as (select doc_id from documents where doc_id % 2 = 0)
    select 'both' as side, count(*) as docs from (select * from a intersect select * from b) union all select 'only_first', count(*) from (select * from a except select * from b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-5, SET-6."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    a, b = d.where("doc_id % 3 = 0"), d.where("doc_id % 2 = 0")
    return a.intersect(b).agg(F.lit("both").alias("side"), F.count("*").alias("docs")).unionByName(a.exceptAll(b).agg(F.lit("only_first").alias("side"), F.count("*").alias("docs")))


@query("""with s as (select doc_id, '[' || case when doc_id % 2 = 0 then '{"Name":"a","Id":' || doc_id || '},{"Name":"b","Id":1}' else '' end || ']' as j from documents)
    select count(*) filter (doc_id % 2 = 0) * 2 + count(*) filter (doc_id % 2 = 1 and doc_id % 3 = 0) as rows from s""")
def src_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23: arrays, single objects, empty arrays and other text."""
    from tarn.sources.files import json_rows

    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    text = F.when(i % 2 == 0, F.concat(F.lit('[{"Name":"a","Id":'), i, F.lit('},{"Name":"b","Id":1}]'))).when(i % 3 == 0, F.lit('﻿{"Name":"a","Id":2}')).when(i % 5 == 0, F.lit("[]")).otherwise(F.lit("no rows"))
    return d.select(F.explode(json_rows(text, "Name string, Id long")).alias("r")).agg(F.count("*").alias("rows"))


@query()
def vec_hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-2: documents embedded without Python; tests hold it against a plain loop."""
    from tarn.operators.embedding import hashed

    return table(spark, sf_dir, "documents").select("doc_id", F.transform(hashed(F.col("text"), 8), lambda x: F.round(x, 6)).alias("embedding"))
