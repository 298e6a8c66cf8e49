"""Chunkers (CHK-*)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import trim_all


def line_chunks(docs: DataFrame, text: str, size: int = 50, overlap: int = 8) -> DataFrame:
    """CHK-1, CF-2: chunks of ``size`` lines that overlap; blank ones are left out. Adds start_line, end_line (from 1, inclusive), content."""
    step = size - overlap
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")
    count = F.greatest(F.lit(1), F.ceil((F.size("__lines") - overlap) / step)).cast("int")

    def chunk(i: Column) -> Column:
        content = trim_all(F.array_join(F.slice("__lines", i * step + 1, F.lit(size)), "\n"))
        return F.struct((i * step + 1).alias("start_line"), F.least(i * step + size, F.size("__lines")).alias("end_line"), content.alias("content"))

    # The chunks of a text are made in its one row and exploded alone: its lines are not repeated for each.  There is one at
    # least; outer keeps the optimizer from asking for that below the generator, where it would make all chunks twice.
    made = docs.withColumn("__lines", lines).select(*docs.columns, F.transform(F.sequence(F.lit(0), count - 1), chunk).alias("__chunks"))
    return made.select(*docs.columns, F.inline_outer("__chunks")).where(F.col("content") != "")


def boundary(window: str, target: int) -> int | None:
    """Where to end a chunk before its full length: a paragraph, else a line, else a word, if far enough in."""
    for mark, share in (("\n\n", 0.4), ("\n", 0.5), (" ", 0.5)):
        if (at := window.rfind(mark)) >= target * share:
            return at
    return None


def cut_text(text: str, target: int, overlap: int, next_from_trimmed: bool) -> list[tuple[int, int]]:
    """Spans of overlapping chunks; the next one starts ``overlap`` before the end, trimmed or as cut."""
    out: list[tuple[int, int]] = []
    start = 0
    while start < len(text):
        while start < len(text) and text[start].isspace():
            start += 1
        if start >= len(text):
            break
        end = min(start + target, len(text))
        if end < len(text) and (at := boundary(text[start:end], target)):
            end = start + at
        piece = text[start:end]
        if end < len(text) and not text[end].isspace() and not piece[-1:].isspace() and (space := piece.rfind(" ")) > 0:
            piece, end = piece[:space], start + space
        piece = piece.rstrip()
        if not piece:
            start = end
            continue
        stop = start + len(piece)
        out.append((start, stop))
        if next_from_trimmed:
            end = stop
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def _spans(docs: DataFrame, key: str, text: str, cutter) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(frame[key], frame["text"], strict=True) for t in [t if isinstance(t, str) else ""] for i, (a, b) in enumerate(cutter(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "start_char", "end_char", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, chunk_index int, start_char int, end_char int, content string")


def char_chunks(docs: DataFrame, key: str, text: str, target: int = 1500, overlap: int = 200) -> DataFrame:
    """CHK-2, SEQ-2: data-dependent boundaries, so one Arrow-batched function per text."""
    return _spans(docs, key, text, lambda t: cut_text(t, target, overlap, next_from_trimmed=False))


def turn_chunks(units: DataFrame, key: str, text: str, target: int = 2000, overlap: int = 250) -> DataFrame:
    """CHK-3, SEQ-3: a text no longer than the target is one chunk as it is."""

    def cutter(t: str) -> list[tuple[int, int]]:
        return [(0, len(t))] if len(t) <= target else cut_text(t, target, overlap, next_from_trimmed=True) or [(0, len(t))]

    return _spans(units, key, text, cutter)


def overlap_join(chunks: DataFrame, spans: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """JOIN-19, JOIN-20: chunks (start_char, end_char) with the spans (span_start, span_end) they overlap.

    Both sides are filed under the bins of ``width`` characters they touch, so it is an
    equi-join; a pair counts in the first bin both touch.
    """
    bins = lambda a, b: F.explode(F.sequence(F.expr(f"cast({a} div {width} as int)"), F.expr(f"cast(greatest({a}, {b} - 1) div {width} as int)")))
    left = chunks.withColumn("__bin", bins("start_char", "end_char"))
    right = spans.withColumn("__bin", bins("span_start", "span_end"))
    first = F.expr(f"cast(greatest(start_char, span_start) div {width} as int)")
    return left.join(right, [*keys, "__bin"]).where((F.col("start_char") < F.col("span_end")) & (F.col("span_start") < F.col("end_char")) & (F.col("__bin") == first)).drop("__bin")


def page_ranges(chunks: DataFrame, pages: DataFrame, keys: list[str], chunk_keys: list[str]) -> DataFrame:
    """CHK-4: the first and last page a chunk touches; null where it touches none."""
    found = overlap_join(chunks, pages, keys).groupBy(*keys, *chunk_keys).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return chunks.join(found, [*keys, *chunk_keys], "left")


def message_segments(chunks: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """CHK-5: the parts of messages that lie in a chunk, clipped, in the messages' own offsets."""
    joined = overlap_join(chunks, messages, keys)
    start: Column = F.greatest("start_char", "span_start") - F.col("span_start")
    end: Column = F.least("end_char", "span_end") - F.col("span_start")
    return joined.withColumn("segment_start", start).withColumn("segment_end", end)
