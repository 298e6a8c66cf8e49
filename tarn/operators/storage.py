"""Inventory, index status and storage planning (SRC-2, DML-1/2, AGG-*, STO-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import ancestors, base_name, extension, inside

MIB = 1024 * 1024
# Directory, file and extension lists.
IGNORED_DIRS = [".git", "node_modules", "dist", "build", "coverage", ".next", ".vercel", "__pycache__", ".venv", "venv", ".cache", "$recycle.bin", "system volume information", ".trash"]
CACHE_DIRS = ["temp", "tmp", "cache", "caches", "node_modules", ".cache", ".npm", ".nuxt", "__pycache__"]
TEXT_EXTENSIONS = (
    "txt md markdown json csv log yaml yml xml html htm css js jsx ts tsx py toml ini cfg conf sql sh bash ps1 bat cmd rs go java c h cpp hpp cs rb php r swift kt scala lua pl tex rst tsv"
).split()
DOCUMENT_EXTENSIONS = ["pdf", "docx"]
PORTABLE_EXTENSIONS = "mp4 mkv avi mov wmv m4v mp3 flac wav aac ogg jpg jpeg png gif webp heic raw zip 7z rar tar gz bz2 iso img bak backup vhd vhdx".split()
REVIEW_EXTENSIONS = "pdf doc docx xls xlsx ppt pptx txt md csv json".split()
RESERVED_NAMES = ["con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10))]
ISSUE_STATUSES = ["error", "stale", "too_large", "no_text", "unsupported", "unsafe", "sensitive"]
MAX_CONTENT_BYTES = 10 * MIB


def sensitive_name(name: Column) -> Column:
    """FLT-2."""
    return F.lower(name).rlike(r"^\.env|\.pem$|\.key$|^id_rsa$|^id_ed25519$")


def ignored(path: Column, names: list[str] = IGNORED_DIRS) -> Column:
    """FLT-3: whether a directory above the file is one of the names, in any case."""
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def content_kind(ext: Column) -> Column:
    """FLT-5."""
    return F.when(ext.isin(TEXT_EXTENSIONS), "text").when(ext.isin(DOCUMENT_EXTENSIONS), ext)


def inventory_summary(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG-1, SRC-2: counts, bytes and skips of a metadata scan."""
    skipped = ignored(F.col("relative_path")) | sensitive_name(F.col("name"))
    return files.groupBy(*(by or [])).agg(
        F.count_if(~skipped).alias("file_count"), F.coalesce(F.sum(F.when(~skipped, F.col("size"))), F.lit(0)).alias("total_bytes"), F.count_if(skipped).alias("skipped_count")
    )


def search_page(files: DataFrame, query: str = "", root: str | None = None, ext: str | None = None, sort: str = "name", descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """FLT-6, ORD-3, ORD-4: a sorted page of the matching files, each with ``total``; a limit that is not from 1 to 200 is 100.

    The direction also turns the tie-break by relative path.
    """
    limit = limit if 1 <= limit <= 200 else 100
    kept = files
    if root is not None:
        kept = kept.where(F.col("root_id") == root)
    if ext is not None:
        kept = kept.where(F.lower("extension") == ext.lower().removeprefix("."))
    if query:
        q = F.lit(query.lower())
        kept = kept.where(F.contains(F.lower("name"), q) | F.contains(F.lower("relative_path"), q))
    key = {"name": F.collate("name", "UNICODE_CI_AI"), "modified": F.col("mtime_ms"), "size": F.col("size")}[sort]
    order = [k.desc() if descending else k.asc() for k in (key, F.col("relative_path"), F.col("absolute_path"))]
    total = kept.agg(F.count("*").alias("total"))
    return kept.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def root_overlap(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """JOIN-11: (candidate, relation, root): duplicate, inside or contains of the first such root, else null.

    One of two paths holds the other if it is among the other's ancestors, so these are two
    equi-joins on exploded ancestors, whatever the number of roots.
    """
    up = lambda path: F.explode(F.concat(F.array(path), ancestors(F.col(path)))).alias("__p")
    r = roots.select("root_no", "root")
    within = candidates.select("candidate", up("candidate")).join(r.withColumn("__p", F.col("root")), "__p")
    around = r.select("root_no", "root", up("root")).join(candidates.withColumn("__p", F.col("candidate")), "__p").where("root <> candidate")
    relation = F.when(F.col("candidate") == F.col("root"), "duplicate").when(F.startswith("root", F.concat("candidate", F.lit("/"))), "contains").otherwise("inside")
    met = within.select("candidate", "root_no", "root").unionByName(around.select("candidate", "root_no", "root")).withColumn("relation", relation)
    first = met.groupBy("candidate").agg(F.min_by(F.struct("relation", "root"), "root_no").alias("m"))
    return candidates.join(first, "candidate", "left").select("candidate", "m.relation", "m.root")


def index_status(files: DataFrame, previous: DataFrame) -> DataFrame:
    """DML-2, JOIN-1: the next status of every file.

    unsupported, then too large, then reused (same fingerprint, extractor and model, and was
    indexed), then what validation says, then error, no text, indexed.
    """
    keys = ["root_id", "absolute_path"]
    old = previous.select(*keys, F.col("fingerprint").alias("__f"), F.col("status").alias("__s"), F.col("extractor_version").alias("__v"), F.col("embedding_model").alias("__m"))
    same = (F.col("__f") == F.col("fingerprint")) & F.col("__s").isin("indexed", "reused") & (F.col("__v") == F.col("extractor_version")) & (F.col("__m") == F.col("embedding_model"))
    status = (
        F.when(content_kind(F.col("extension")).isNull(), "unsupported")
        .when(F.col("size") > MAX_CONTENT_BYTES, "too_large")
        .when(same, "reused")
        .when(F.col("validation").isNotNull(), F.col("validation"))
        .when(F.col("extract_error").isNotNull(), "error")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "no_text")
        .otherwise("indexed")
    )
    return files.join(old, keys, "left").withColumn("status", status).drop("__f", "__s", "__v", "__m")


def index_summary(files: DataFrame) -> DataFrame:
    """AGG-2: reused files count as indexed too; unsupported, unsafe and sensitive ones are not supported."""
    s = F.col("status")
    return files.agg(
        F.count("*").alias("inventory_files"),
        F.count_if(s.isin("indexed", "reused", "stale", "too_large", "no_text", "error")).alias("supported_files"),
        F.count_if(s.isin("indexed", "reused")).alias("indexed_files"),
        F.count_if(s == "reused").alias("reused_files"),
        F.count_if(s == "stale").alias("stale_files"),
        F.count_if(s == "unsupported").alias("unsupported_files"),
        F.count_if(s == "too_large").alias("too_large_files"),
        F.count_if(s == "no_text").alias("no_text_files"),
        F.count_if(s == "error").alias("error_files"),
        F.count_if(s.isin("unsafe", "sensitive")).alias("unsafe_files"),
    )


def index_issues(files: DataFrame, cap: int = 100) -> DataFrame:
    """AGG-3: the first issues by path, each with the number of all."""
    bad = files.where(F.col("status").isin(ISSUE_STATUSES))
    return bad.orderBy("absolute_path").limit(cap).crossJoin(F.broadcast(bad.agg(F.count("*").alias("issue_count"))))


def file_page(chunks: DataFrame, file: str, start: int = 0, most_chunks: int = 6, most_chars: int = 14_000) -> DataFrame:
    """ORD-10: of every file the chunks from ``start`` that fit a page; the first always does. Adds has_more, next_chunk."""
    order = Window.partitionBy(file).orderBy("chunk_index")
    page = chunks.where(F.col("chunk_index") >= start).withColumn("__n", F.row_number().over(order)).withColumn("__sum", F.sum(F.length("content")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("chunk_index").over(Window.partitionBy(file))
    kept = page.withColumn("__last", last).where((F.col("__n") == 1) | ((F.col("__n") <= most_chunks) & (F.col("__sum") <= most_chars)))
    shown = F.max("chunk_index").over(Window.partitionBy(file))
    return (
        kept.withColumn("content", F.left("content", F.lit(most_chars)))
        .withColumn("has_more", shown < F.col("__last"))
        .withColumn("next_chunk", F.when(shown < F.col("__last"), shown + 1))
        .drop("__n", "__sum", "__last")
    )


def directory_sizes(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """AGG-4, CF-8: (directory, files, bytes), descendants included; summed before the shuffle."""
    return files.select(F.explode(ancestors(F.col(path))).alias("directory"), size).groupBy("directory").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def largest(rows: DataFrame, size: str, *ties: str, top: int = 15) -> DataFrame:
    """ORD-2."""
    return rows.orderBy(F.desc(size), *ties).limit(top)


def filename_problem(name: Column) -> Column:
    """FLT-20: why a destination file name is not valid, else null."""
    first = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "empty")
        .when(name != F.trim(name), "edge_whitespace")
        .when(name.rlike(r"[. ]$"), "ends_with_period")
        .when(name.rlike(r'[<>:"/\\|?*\x00-\x1f]'), "invalid_characters")
        .when(first.isin(RESERVED_NAMES), "reserved_name")
    )


def candidate_safety(entries: DataFrame, now_ms: int, protected: list[str], own_root: str) -> DataFrame:
    """STO-1: safety, dependency_concerns and concerns of offload candidates (source_path, size_bytes, mtime_ms, in_use)."""
    path = F.col("source_path")
    off_limits = reduce(lambda a, b: a | b, (inside(path, F.lit(p)) for p in protected), F.lit(False))
    # Each step is a column of its own, so what several decisions ask is computed once.
    told = entries.withColumn("__name", base_name(path)).withColumn("__ext", extension(F.col("__name")))
    told = told.withColumn("__sensitive", sensitive_name(F.col("__name"))).withColumn("__off", off_limits)
    told = told.withColumn("__excluded", F.col("__sensitive") | F.col("__off") | inside(path, F.lit(own_root)))
    told = told.withColumn("__portable", F.col("__ext").isin(PORTABLE_EXTENSIONS) | (F.coalesce("size_bytes", F.lit(0)) >= 50 * MIB))
    excluded, portable, in_use = F.col("__excluded"), F.col("__portable"), F.coalesce(F.col("in_use"), F.lit(False))
    safety = F.when(excluded, "excluded").when(in_use, "review_required").when(portable, "likely_portable").otherwise("review_required")
    dependency = (
        F.when(F.col("__sensitive"), F.array(F.lit("sensitive_filename")))
        .when(F.col("__off"), F.array(F.lit("protected_location")))
        .when(excluded, F.array(F.lit("application_directory")))
        .when(in_use, F.array(F.lit("running_process_image")))
        .when(F.col("in_use").isNull(), F.array(F.lit("unverified")))
        .otherwise(F.array().cast("array<string>"))
    )
    old = F.coalesce((F.lit(now_ms) - F.col("mtime_ms")) / 86_400_000 > 365, F.lit(False))
    concerns = F.array_compact(
        F.array(
            F.when(~excluded & old, "older_than_one_year"),
            F.when(~excluded, F.when(in_use, "in_use").when(portable, "heuristic_portable").when(F.col("__ext").isin(REVIEW_EXTENSIONS), "document_like").otherwise("unrecognized_type")),
        )
    )
    return told.withColumn("safety", safety).withColumn("dependency_concerns", dependency).withColumn("concerns", concerns).drop("__name", "__ext", "__sensitive", "__off", "__excluded", "__portable")


def destination_conflicts(entries: DataFrame, key: str, destination: str) -> DataFrame:
    """STO-5, CF-7: of the entries not yet excluded, all that share a destination in any case; each with the first one's id."""
    w = Window.partitionBy(F.lower(destination))
    found = entries.withColumn("__n", F.count("*").over(w)).where("__n > 1")
    return found.withColumn("first_id", F.min(key).over(w)).withColumn("is_first", F.col(key) == F.min(key).over(w)).drop("__n")


def plan_totals(entries: DataFrame, by: list[str], free: Column | None = None, *more: Column) -> DataFrame:
    """AGG-6, with more aggregates of the same entries, so that these are read once."""
    out = entries.groupBy(*by).agg(
        F.count("*").alias("candidate_count"), F.count_if("selectable").alias("selectable_count"), F.coalesce(F.sum(F.when(F.col("selectable"), F.col("size_bytes"))), F.lit(0.0)).alias("selectable_bytes"), *more
    )
    return out if free is None else out.withColumn("capacity_warning", F.col("selectable_bytes") > free)


def lock_selection(selected: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """STO-6, JOIN-9, JOIN-27: the selected ids in their order with their entry, and what is wrong with each."""
    joined = selected.join(entries, key, "left")
    repeated = F.count("*").over(Window.partitionBy(key)) > 1
    problem = F.when(F.col("safety").isNull(), "unknown").when(repeated, "duplicate").when(F.col("safety") == "excluded", "excluded")
    return joined.withColumn("problem", problem)


def manifest_hash(entries: DataFrame, by: list[str], key: str, *columns: str) -> DataFrame:
    """HASH-3, ORD-11: the digest of a manifest's entries in the order of their ids."""
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in (key, *columns)])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, row.alias("r")))), lambda x: x["r"]), "\n")
    return entries.groupBy(*by).agg(F.sha2(ordered, 256).alias("manifest_hash"), F.count("*").alias("entry_count"))


def manifest_trust(has_snapshot: Column, recomputed: Column, recorded: Column, snapshot_hash: Column, session_hash: Column, session_live_hash: Column, transfer_hash: Column) -> Column:
    """STO-10: six outcomes, first that holds."""
    return (
        F.when(~has_snapshot, "legacy_untrusted_manifest")
        .when(recomputed.isNull() | (recomputed != recorded), "snapshot_hash_mismatch")
        .when(snapshot_hash.isNotNull() & (snapshot_hash != recorded), "snapshot_internal_hash_mismatch")
        .when(session_hash == recorded, F.when(session_live_hash == recorded, "session_manifest_and_snapshot").otherwise("journal_snapshot_only"))
        .when(transfer_hash == recorded, "session_transfer_provenance")
        .otherwise("journal_snapshot_only")
    )


AXES = ["copy_integrity", "source_integrity", "destination_integrity", "source_authorization", "cloud_safety", "dependency"]


def eligibility(removable: Column, excluded: Column) -> Column:
    """STO-12: hard failures, exclusion, integrity, provenance, dependency, in this order, over the six axis columns."""
    copy, source, destination, authorization, cloud, dependency = (F.col(a) for a in AXES)
    hard = (copy == "failed") | (source == "failed") | (destination == "failed") | (authorization == "failed") | cloud.isin("failed", "unsafe")
    whole = (copy == "verified") & (source == "verified") & (destination == "verified") & (authorization == "authorized") & (cloud == "safe")
    return (
        F.when(excluded, "excluded").when(hard, "verification_failed").when(~whole, "verification_failed").when(~removable, "requires_manual_review").when(dependency != "clear", "requires_manual_review").otherwise("eligible_for_review")
    )


def allocation(files: DataFrame) -> DataFrame:
    """STO-13: physical bytes and how sure they are, from links and 512-byte blocks."""
    linked = F.col("nlink") > 1
    physical = F.when(F.col("blocks") >= 0, F.col("blocks") * 512).when(linked, 0)
    sure = F.when(linked, "uncertain_hardlink").when(F.col("blocks") >= 0, "blocks_estimate").otherwise("logical_only")
    return files.withColumn("physical_bytes", physical).withColumn("confidence", sure)


def reclaim_counts(candidates: DataFrame, by: list[str]) -> DataFrame:
    """AGG-7, AGG-22: counts and ids per eligibility."""
    kinds = ["eligible_for_review", "requires_manual_review", "excluded", "verification_failed"]
    reverified = (F.col("source_integrity") == "verified") & (F.col("destination_integrity") == "verified")
    return candidates.groupBy(*by).agg(*[F.count_if(F.col("eligibility") == k).alias(k) for k in kinds], F.count_if(reverified).alias("reverified"))


def reclaim_estimates(candidates: DataFrame, by: list[str]) -> DataFrame:
    """AGG-8: sums over candidates; the physical sum is null once an eligible row's size is not known."""
    reverified = (F.col("source_integrity") == "verified") & (F.col("destination_integrity") == "verified")
    eligible = F.col("eligibility") == "eligible_for_review"
    unsure = eligible & (F.col("physical_bytes").isNull() | F.col("confidence").isin("logical_only", "uncertain_hardlink"))
    has = lambda c: F.coalesce(F.bool_or(eligible & c), F.lit(False))
    return candidates.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("state") == "verified", F.col("size_bytes"))), F.lit(0.0)).alias("copied_bytes"),
        F.coalesce(F.sum(F.when(reverified, F.col("size_bytes"))), F.lit(0.0)).alias("reverified_bytes"),
        F.coalesce(F.sum(F.when(eligible, F.col("size_bytes"))), F.lit(0.0)).alias("removable_bytes"),
        F.when(~has(unsure), F.coalesce(F.sum(F.when(eligible, F.col("physical_bytes"))), F.lit(0))).alias("physical_bytes"),
        F.when(has(F.col("confidence") == "uncertain_hardlink"), "uncertain_hardlink").when(has(unsure), "logical_only").when(has(F.col("confidence") == "blocks_estimate"), "blocks_estimate").otherwise("exact").alias("estimate_confidence"),
    )


def volume_match(manifests: DataFrame, volumes: DataFrame) -> DataFrame:
    """JOIN-22: each manifest's volume by id, serial and disk compared only where both are known; adds match_code."""
    v = volumes.select(F.col("volume_id").alias("__v"), F.col("serial").alias("__s"), F.col("disk").alias("__d"), F.col("identity_confidence").alias("__c"), F.col("file_system").alias("__fs"))
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    code = (
        F.when(F.col("__v").isNull(), "DRIVE_GONE")
        .when((F.col("__c") == "low") | differ(F.col("serial"), F.col("__s")) | differ(F.col("disk"), F.col("__d")), "IDENTITY_CHANGED")
        .when(finalization(F.col("__fs")).isNull(), "UNSUPPORTED_FS")
        .otherwise("OK")
    )
    return manifests.join(v, F.col("volume_id") == F.col("__v"), "left").withColumn("match_code", code).drop("__v", "__s", "__d", "__c", "__fs")


def finalization(file_system: Column) -> Column:
    """STO-20: how a finished copy is put in place."""
    fs = F.lower(F.trim(file_system))
    return F.when(fs == "ntfs", "hard_link").when(fs.isin("exfat", "fat32"), "exclusive_copy")


def drive_class(drive_type: Column, bus_type: Column) -> Column:
    """STO-2: struct of classification and confidence."""
    kind, bus = F.lower(F.trim(F.coalesce(drive_type, F.lit("")))), F.lower(F.trim(F.coalesce(bus_type, F.lit(""))))
    removable, fixed = kind.isin("2", "removable"), kind.isin("3", "fixed", "local disk")
    usb, internal = bus.isin("usb", "4"), bus.isin("nvme", "sata", "raid", "scsi", "sas", "ide", "17", "11")
    name = F.when(removable, "removable").when(fixed & usb, "external").when(fixed & internal, "internal").when(fixed & (bus == ""), "unknown").when(usb, "external").otherwise("unknown")
    sure = F.when(removable, F.when(bus != "", "high").otherwise("medium")).when(fixed & (usb | internal), "high").when(fixed & (bus == ""), "low").when(usb, "medium").otherwise("low")
    return F.struct(name.alias("classification"), sure.alias("confidence"))


def volume_identity(mount: Column, serial: Column, disk: Column) -> Column:
    """STO-3: struct of volume_id and identity_confidence."""
    s, d = F.nullif(F.trim(serial), F.lit("")), F.nullif(F.trim(disk), F.lit(""))
    known = s.isNotNull() | d.isNotNull()
    return F.struct(
        F.when(known, F.concat_ws("|", d, s)).when(F.coalesce(mount, F.lit("")) != "", F.concat(F.lit("mount:"), mount)).alias("volume_id"),
        F.when(s.isNotNull() & d.isNotNull(), "high").when(known, "medium").otherwise("low").alias("identity_confidence"),
    )


def cascade(grants: DataFrame, plans: DataFrame, manifests: DataFrame) -> DataFrame:
    """JOIN-24: (kind, id) of what goes when the grants are revoked: plans on them, then manifests of those plans."""
    gone = plans.join(grants, "grant_id", "left_semi")
    return gone.select(F.lit("plan").alias("kind"), F.col("plan_id").alias("id")).unionByName(manifests.join(gone, "plan_id", "left_semi").select(F.lit("manifest").alias("kind"), F.col("manifest_id").alias("id")))


def throughput(progress: DataFrame, by: str, time: str, size: str) -> DataFrame:
    """WIN-6: bytes a second over the five seconds before, their start excluded, and what remains at that rate."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-4_999_999, 0)
    total = F.sum(size).over(Window.partitionBy(by))
    done = F.sum(size).over(Window.partitionBy(by).orderBy(time).rangeBetween(Window.unboundedPreceding, 0))
    rate = F.sum(size).over(w) / 5.0
    return progress.withColumn("bytes_per_second", rate).withColumn("eta_seconds", F.when(rate > 0, F.ceil((total - done) / rate)))


def recover(jobs: DataFrame) -> DataFrame:
    """STO-18: what was running when the program stopped is interrupted, and so are its open entries."""
    open_ = F.col("status").isin("running", "starting", "cancelling")
    entry = F.when(open_ & F.col("state").isin("copying", "verifying"), "interrupted").otherwise(F.col("state"))
    return jobs.withColumn("new_state", entry).withColumn("new_status", F.when(open_, "interrupted").otherwise(F.col("status")))


def latest_state(events: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """STO-19, DML-8, STM-12: the last event of every key; a partial aggregation, no window."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("s")).select(key, "s.*")


def removal_gate(gates: list[tuple[str, Column]]) -> Column:
    """STO-21: the code of the first gate that does not hold, else ready."""
    out = F
    for code, holds in gates:
        out = out.when(~F.coalesce(holds, F.lit(False)), code)
    return out.otherwise("ready")


def project_markers(files: DataFrame, markers: list[str], hops: int = 24, most: int = 10) -> DataFrame:
    """STO-14, SET-8: (path, markers): marker files in the directories above each file, by an equi-join on directories."""
    held = files.where(base_name(F.col("path")).isin(markers)).select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), base_name(F.col("path")).alias("marker")).distinct()
    above = files.select("path", F.explode(F.slice(F.reverse(ancestors(F.col("path"))), 1, hops)).alias("directory"))
    return above.join(held, "directory").groupBy("path").agg(F.slice(F.array_sort(F.collect_set("marker")), 1, most).alias("markers"))
