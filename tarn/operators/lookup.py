"""Lookups and evidence joins (JOIN-*), approvals, grants, and formatting of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import ancestors, collapse, inside


def searchable(files: DataFrame) -> DataFrame:
    """FLT-8: indexed or reused files that have chunks."""
    return files.where(F.col("status").isin("indexed", "reused") & (F.col("chunk_count") > 0))


def hits(found: DataFrame, chunks: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-3, JOIN-4: search hits with their chunk, if the chunk's file is still searchable in the same state."""
    return found.join(chunks, "chunk_id").join(searchable(files).select(*keys), keys, "left_semi")


def unit_times(chunks: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """JOIN-6: a unit's times, or the chunk's own where the unit is not known."""
    u = units.select(F.col(key).alias("__k"), F.col("started_at").alias("__a"), F.col("ended_at").alias("__b"))
    joined = chunks.join(u, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("started_at", F.coalesce("__a", "started_at")).withColumn("ended_at", F.coalesce("__b", "ended_at")).drop("__k", "__a", "__b")


def first_grant(paths: DataFrame, grants: DataFrame) -> DataFrame:
    """JOIN-10, WIN-13: the first grant (grant_no, root) that holds each path, else null.

    A path lies in a root if the root is the path or one of its ancestors, so this is an
    equi-join on them: any number of grants, and no pair of a path and a root is tried in vain.
    """
    first = grants.groupBy(F.regexp_replace("root", "(.)/+$", "$1").alias("__root")).agg(F.min(F.struct("grant_no", "root")).alias("g"))
    every = F.array_distinct(F.concat(F.array("path"), ancestors(F.col("path")), F.when(F.startswith("path", F.lit("/")), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))))
    tried = paths.select("path").distinct().select("path", F.explode(every).alias("__root"))
    best = tried.join(first, "__root").groupBy("path").agg(F.min("g").alias("g"))
    return paths.join(best, "path", "left").select(*paths.columns, "g.grant_no", "g.root")


def since_baseline(identities: DataFrame, baseline: DataFrame) -> DataFrame:
    """JOIN-14: whether an identity was there before, and whether its pid was, under another start."""
    exact = baseline.select("pid", "started_at").distinct().withColumn("before", F.lit(True))
    pid = baseline.select("pid").distinct().withColumn("pid_before", F.lit(True))
    joined = identities.join(exact, ["pid", "started_at"], "left").join(pid, "pid", "left").fillna(False, ["before", "pid_before"])
    return joined.withColumn("restarted", F.col("pid_before") & ~F.col("before"))


def with_root(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """JOIN-25: entries whose root is not known are unsafe."""
    known = roots.select("root_id").distinct().withColumn("__known", F.lit(True))
    joined = entries.join(known, "root_id", "left")
    return joined.withColumn("status", F.when(F.col("__known").isNull(), "unsafe").otherwise(F.col("status"))).drop("__known")


def busy(manifests: DataFrame, transfers: DataFrame) -> DataFrame:
    """JOIN-28: manifests with a transfer that runs."""
    return manifests.join(transfers.where(F.col("status").isin("running", "cancelling", "starting")), "manifest_id", "left_semi")


def grant_renewals(grants: DataFrame) -> DataFrame:
    """STM-13, DML-9: one grant a path; granting again extends it."""
    return grants.groupBy("path").agg(F.min("added_at").alias("added_at"), F.max("expires_at").alias("expires_at"), F.count("*").alias("grants"))


def visible_approvals(approvals: DataFrame, session: str, now: Column) -> DataFrame:
    """DIA-15: pending approvals of a session or of none, not expired."""
    return approvals.where((F.col("session_id").isNull() | (F.col("session_id") == session)) & (F.col("expires_at") > now))


def decision(expires_at: Column, now: Column, used: Column, acknowledged: Column, *hashes: Column) -> Column:
    """STO-23: what an approval's decision comes to; all hashes of the manifest must agree."""
    same = F.lit(True)
    for h in hashes[1:]:
        same = same & F.coalesce(h == hashes[0], F.lit(False))
    return F.when(used, "ALREADY_USED").when(expires_at <= now, "EXPIRED").when(~F.coalesce(acknowledged, F.lit(False)), "NOT_ACKNOWLEDGED").when(~same, "MANIFEST_CHANGED").otherwise("APPROVED")


def source_changed(size: Column, was_size: Column, mtime_ms: Column, was_mtime_ms: Column) -> Column:
    """STO-9: another size, or a time more than a millisecond off; an unknown time says nothing."""
    return (size != was_size) | F.coalesce(F.abs(mtime_ms - was_mtime_ms) > 1, F.lit(False))


def context_blocks(ranked: DataFrame, by: list[str], rank: str, source: Column, content: str) -> DataFrame:
    """STR-13: numbered blocks of sources and contents in rank order, as one text."""
    block = F.struct(rank, F.format_string("[%d] %s\n%s", F.col(rank), source, F.col(content)).alias("b"))
    return ranked.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))


def head_lines(content: Column, n: int = 6) -> Column:
    """ORD-14: the first lines, and three dots where there are more."""
    lines = F.split(content, r"\r?\n")
    return F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.when(F.size(lines) > n, "\n...").otherwise(""))


def tool_target(arguments: Column) -> Column:
    """STR-27: what a tool call is about, from a map of its arguments."""
    named = F.coalesce(*[arguments[k] for k in ("path", "destination", "source", "root", "fileRef", "name", "logName")])
    asked = F.concat(F.lit('"'), F.left(collapse(arguments["query"]), F.lit(80)), F.lit('"'))
    return F.coalesce(named, asked, arguments["nameContains"])


def round_trip_ms(line: Column) -> Column:
    """STR-24."""
    return F.regexp_extract(line, r"(?i)time[=<]\s*(\d+)\s*ms", 1).try_cast("int")


def sources_problem(source: Column) -> Column:
    """JSON-2: why a source (a struct of the union of its three kinds) is not valid, else null."""
    kind = source["type"]
    lines = (source["start_line"] >= 1) & (source["end_line"] >= source["start_line"])
    good = (
        F.when(kind == "project", source["file_path"].isNotNull() & lines)
        .when(kind == "file", source["file_path"].isNotNull() & (source["chunk_index"] >= 0))
        .when(kind == "memory", source["conversation_id"].isNotNull())
    )
    return F.when(kind.isNull() | ~kind.isin("project", "file", "memory"), "unknown_type").when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("invalid_"), kind))


def bounded_walk(entries: DataFrame, root: str, depth: int, most: int, least_bytes: int = 0) -> DataFrame:
    """SRC-3, SRC-4, SRC-5: entries (path, size) below a root to a depth, largest first, with whether there were more."""
    level = F.size(F.split(F.col("path"), "/")) - len(root.split("/"))
    kept = entries.where(inside(F.col("path"), F.lit(root)) & (level <= depth) & (F.col("size") >= least_bytes))
    total = kept.agg((F.count("*") > most).alias("truncated"))
    return kept.orderBy(F.desc("size"), "path").limit(most).crossJoin(F.broadcast(total))


def removal_metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """AGG-10."""
    kinds = ["removed", "skipped", "failed", "interrupted"]
    return outcomes.groupBy(*by).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds], F.coalesce(F.sum(F.when(F.col("outcome") == "removed", F.col("size_bytes"))), F.lit(0.0)).alias("removed_bytes"))


def deletion_evidence(journals: DataFrame, by: list[str]) -> DataFrame:
    """STO-17: journals one of whose files was deleted for good."""
    return journals.groupBy(*by).agg(F.bool_or(F.col("outcome") == "permanently_deleted").alias("deleted"))


def adapters(rows: DataFrame, key: str, addresses: str) -> DataFrame:
    """DIA-7: one row for each address of an adapter."""
    return rows.select(key, F.posexplode_outer(addresses).alias("place", "address"))


def noise(found: DataFrame, required: DataFrame, key: str) -> DataFrame:
    """AGG-20, SET-6: found rows that were not asked for, and required ones that were not found."""
    extra = found.join(required, key, "left_anti").agg(F.lit("unrelated").alias("kind"), F.count("*").alias("n"))
    missing = required.join(found, key, "left_anti").agg(F.lit("missing").alias("kind"), F.count("*").alias("n"))
    return extra.unionByName(missing)


def not_pending(asked: DataFrame, approvals: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-29: requests with whether the same is pending already."""
    known = approvals.where("status = 'pending'").select(*keys).distinct().withColumn("__p", F.lit(True))
    return asked.join(known, keys, "left").withColumn("duplicate", F.coalesce("__p", F.lit(False))).drop("__p")


def latest_version(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """WIN-9, DML-7: rows numbered within their key, and whether each is the newest."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w) - 1).withColumn("newest", F.lead(order).over(w).isNull()).select(key, order, "place", "newest", *columns)
