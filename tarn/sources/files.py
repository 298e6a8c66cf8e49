"""File sources and sinks (SRC-*): folder scans, text, DOCX and page extraction, JSON lines, versioned tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import extension, normalize
from tarn.operators.storage import IGNORED_DIRS, ignored, sensitive_name
from tarn.sources import walk
from tarn.sources.versions import VersionedTable

# What a project scan takes and leaves.
PROJECT_EXTENSIONS = ["js", "jsx", "ts", "tsx", "py", "json", "md", "html", "css"]
PROJECT_IGNORED = ["node_modules", ".git", "dist", "build", "coverage", ".next", ".vercel", "scripts"]
BLOCKED_NAMES = ["chat-history.json", "chat_history.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
MAX_PROJECT_BYTES = 500_000
MAX_READ_BYTES = 250_000
#: Characters of extracted texts that leave a task at once.
PIECE_CHARS = 1 << 20


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-2, SRC-8: (path, relative_path, name, extension, size, modified_at) of all files below a folder, hidden and empty ones too; contents are not read."""
    found = walk.walk(spark, folder, depth=1 << 20).where("skipped is null")
    return found.select("path", "relative_path", "name", extension(F.col("name")).alias("extension"), "size", "modified_at")


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-1, FLT-1: (path, relative_path, text) of a project's sources. Folders left out are not entered, and only files that pass are opened; one that cannot be read is left out."""
    name = F.lower("name")
    found = walk.walk(spark, folder, PROJECT_IGNORED, 1 << 20).where("skipped is null").withColumn("extension", extension(F.col("name")))
    kept = found.where(F.col("extension").isin(PROJECT_EXTENSIONS) & (F.col("size") <= MAX_PROJECT_BYTES) & ~name.isin(BLOCKED_NAMES) & ~name.rlike(r"^\.env($|\.)"))
    texts = walk.contents(kept).where("error is null").select("path", F.decode("content", "UTF-8").alias("text"))
    root = F.length(F.lit(os.path.realpath(walk.local_path(folder)).rstrip("/") + "/"))
    return texts.select("path", F.substring("path", root + 1, F.length("path")).alias("relative_path"), "text")


def skip_reason(path: Column, name: Column, size: Column, depth: int = 20) -> Column:
    """SRC-2: why an inventory leaves a file out, else null."""
    return (
        F.when(F.size(F.split(path, "/")) > depth, "too_deep").when(ignored(path, IGNORED_DIRS), "ignored_directory").when(sensitive_name(name), "sensitive_name").when(size.isNull(), "unreadable")
    )


def read_text(files: DataFrame, most: int = MAX_READ_BYTES) -> DataFrame:
    """SRC-7, SRC-9: (path, text, error) of rows (path, content): too large and binary files are refused."""
    has_nul = F.contains(F.col("content"), F.lit(b"\x00"))
    error = F.when(F.octet_length("content") > most, "too_large").when(has_nul, "binary")
    return files.select("path", F.when(error.isNull(), normalize(F.decode("content", "UTF-8"))).alias("text"), error.alias("error"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """HASH-4: (path, size, sha256, error) of all files below a folder, of any size, empty ones too."""
    return walk.digests(walk.walk(spark, folder, depth=1 << 20).where("skipped is null"))


def archive_conversations(current: DataFrame, ids: DataFrame, target: VersionedTable) -> int:
    """DML-6: add conversations to the archive, whole and once; those archived before stay as they are. The new generation.

    ids: (conversation_id); one that has no messages is an error.
    """
    chosen = current.join(ids.select("conversation_id").distinct(), "conversation_id")
    if not ids.join(current, "conversation_id", "left_anti").isEmpty():
        raise ValueError("a conversation without messages cannot be archived")
    if target.head() is not None:
        held = target.read()
        chosen = held.unionByName(chosen.join(held.select("conversation_id").distinct(), "conversation_id", "left_anti"))
    return target.publish(chosen, "archive")


def forget_conversations(target: VersionedTable, ids: DataFrame | None = None) -> int:
    """DML-6, DML-7: take conversations out of the archive, all of them if none are named. The new generation."""
    held = target.read()
    return target.publish(held.where(F.lit(False)) if ids is None else held.join(ids.select("conversation_id"), "conversation_id", "left_anti"), "archive")


def docx_text(raw: bytes) -> str:
    """The paragraphs of a DOCX file."""
    import xml.etree.ElementTree as ET

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    said = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    return "\n\n".join("".join(said[e.tag](e) for e in p.iter() if e.tag in said) for p in root.iter(f"{w}p"))


#: Extractors by kind (UDF-4); more are put in by callers, such as one for PDF pages.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"text": lambda raw: raw.decode("utf-8", "replace"), "docx": docx_text}


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """SRC-9..11, UDF-4: (path, text, error) of rows (path, kind, content); a failing file is a row with its error."""
    chosen = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, kinds, raws = batch.columns
            texts, errors, size, start = [], [], 0, 0
            for i in range(batch.num_rows):  # a content leaves Arrow when its turn comes
                kind, text, error = kinds[i].as_py(), None, "unsupported"
                if kind in chosen:
                    try:
                        text, error = chosen[kind](raws[i].as_py()), None
                        size += len(text)
                    except Exception as e:  # the file's fault, whatever its parser raises
                        error = f"{kind}_extract_failed: {type(e).__name__}"
                texts.append(text)
                errors.append(error)
                if size >= PIECE_CHARS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([paths.slice(start, len(texts)), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])
                    texts, errors, size, start = [], [], 0, i + 1

    found = files.select("path", "kind", "content").mapInArrow(run, "path string, text string, error string")
    return found.withColumn("text", normalize(F.col("text")))


def page_spans(pages: DataFrame, key: str, page: str, text: str, separator: int = 2) -> DataFrame:
    """SRC-11, WIN-11: pages with span_start and span_end in the joined text."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(text) + separator).over(w) - separator
    return pages.withColumn("span_end", end).withColumn("span_start", F.col("span_end") - F.length(text))


def json_rows(c: Column, row: str) -> Column:
    """SRC-23: an array of rows from a JSON array, or from one object; nothing else gives rows."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", "")
    array = F.from_json(plain, f"array<struct<{row}>>")
    single = F.array(F.from_json(plain, f"struct<{row}>"))
    return F.when(plain.rlike(r"^\s*\["), array).when(plain.rlike(r"^\s*\{"), single).otherwise(F.array().cast(f"array<struct<{row}>>"))


def append_lines(rows: DataFrame, folder: str) -> None:
    """SRC-16: JSON lines."""
    rows.write.mode("append").json(folder)


def read_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC-17: lines that do not parse are left out."""
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder).where("_bad is null").drop("_bad")


def journal(rows: DataFrame) -> DataFrame:
    """SRC-21: journals with their schema version (1 where none is named) and whether they hold a frozen manifest."""
    return rows.withColumn("schema_version", F.coalesce("schema_version", F.lit(1))).withColumn("has_snapshot", F.col("manifest_snapshot").isNotNull() & (F.col("schema_version") >= 2))


def archive(manifest: DataFrame, messages: DataFrame) -> DataFrame:
    """SRC-18, ID-1: messages of the conversations that the manifest lists, ids being UUIDs."""
    good = manifest.where(F.lower("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))
    return messages.join(good.select(F.col("id").alias("conversation_id"), F.col("ended_at")), "conversation_id")


def corpus(archived: DataFrame, current: DataFrame) -> DataFrame:
    """SRC-19, SET-1: archived and current messages, told apart by ``current``."""
    return archived.withColumn("current", F.lit(False)).unionByName(current.withColumn("current", F.lit(True)), allowMissingColumns=True)
