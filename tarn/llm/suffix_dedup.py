"""Operator 7: repeated byte strings, by interval trees over a sampled enhanced suffix array.

Every ``length``-byte string is represented by the anchors it holds: the places whose
``gram``-byte hash is the least in some window of that length.  Equal strings hold equal
anchors at equal places, so it is enough to compare suffixes that start at anchors of the
same hash.  Of such a group the suffixes are sorted with their common-prefix lengths; a stack
scan gives the tree of common-prefix intervals.  In an interval of depth d, the occurrences
whose common left context is at least length - d form runs in the order of their reversed
prefixes: each run is a maximal repeat (its common left context can't grow, as the bytes
before it differ) with all its occurrences, and what a member covers is its longest left
context in the run and the depth.

Texts that are equal as a whole enter once.  Contexts of anchors that are equal to the byte
are counted by their digests: they are repeated from end to end, and one of them stands for
all in the scan.  A hash with more different contexts than ``CHUNK`` is split into chunks, and
every two chunks are scanned together, so no group is gathered in one task and none is cut
short.  Joins on hashes and contexts deal the rows of a frequent one over all tasks.

A null or empty text has no bytes and the digest of the empty string; a very long text is hashed
as a whole, its contexts leave in batches of some megabytes; repeated rows are rows of their
own and repeat each other; a null key stays null; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, cut_table, join_counted, map_groups

LENGTH = 400
#: A power of two.  Lines shorter than this that many texts share make no group.
GRAM = 128
CHUNK = 32_768
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every window of the width."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text of at least ``length`` bytes; all of equal least hashes count."""
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    size, power = 1, int(FACTOR)
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    h = (h ^ (h >> np.uint64(31))) * FACTOR
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    width = length - gram + 1
    least = sliding(h, width, np.minimum)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(h == sliding(padded, width, np.maximum))
    return at, h[at].view(np.int64)


def sketch(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, key, n_bytes, digest, hashes, places) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                raws = [(t or "").encode() for t in batch.column(2).to_pylist()]
                found = [anchors(r, length, gram) if len(r) >= length else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for r in raws]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(r) for r in raws], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([h for _, h in found]), pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p for p, _ in found]), pa.int32())),
                    ],
                    names=["row", "key", "n_bytes", "digest", "hashes", "places"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"row long, key {kind}, n_bytes long, digest string, hashes array<long>, places array<int>")


def contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """From (row, text, anchors array<struct<place, hash>>): one row per anchor context of a text, or per interval.

    kind 0: an anchor with what lies left and right of it, from start to stop.  kind 1: the
    bytes from start to stop are repeated, as they occur twice in the text.
    """
    names = ["kind", "row", "hash", "digest", "place", "start", "stop", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for row, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                seen: dict[tuple[bytes, bytes], list[int]] = {}
                for a in found:
                    p = a["place"]
                    context = raw[max(0, p - (length - gram)) : p], raw[p : p + length]
                    if (first := seen.get(context)) is None:
                        seen[context] = [p]
                        digest = hashlib.blake2b(b"%d:" % len(context[0]) + context[0] + context[1], digest_size=16).digest()
                        out.append((0, row, a["hash"], digest, p, p - len(context[0]), p + len(context[1]), *context))
                        size += len(context[0]) + len(context[1])
                    elif len(context[0]) + len(context[1]) >= length:
                        for q in ([first.pop(), p] if first else [p]):
                            out.append((1, row, 0, b"", q, q - len(context[0]), q + len(context[1]), b"", b""))
                    if size > 4_000_000:
                        yield as_batch(out)
                        out, size = [], 0
            if out:
                yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "kind int, row long, hash long, digest binary, place int, start int, stop int, left binary, right binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The tree of common-prefix intervals (depth, first, last), leaves left out; lcp[i] belongs to suffixes i - 1 and i, lcp[0] is 0."""
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp[1:], -1], start=1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


class RangeMin:
    def __init__(self, x: np.ndarray) -> None:
        self.levels = [x]
        size = 1
        while 2 * size <= len(x):
            self.levels.append(np.minimum(self.levels[-1][:-size], self.levels[-1][size:]))
            size *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min of x[a + 1 .. b] for a < b."""
        k = np.log2(b - a + 0.5).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for level in np.unique(k).tolist():
            at = k == level
            out[at] = np.minimum(self.levels[level][a[at] + 1], self.levels[level][b[at] + 1 - (1 << level)])
        return out


def repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats among distinct contexts: (depth, members, each one's longest left context within its run)."""
    n = len(left)
    if n == 2:
        d = common(right[0], right[1])
        c = common(left[0], left[1])
        if c + d >= length:
            yield d, np.array([0, 1]), np.array([c, c])
        return
    order = sorted(range(n), key=right.__getitem__)
    lcp = [0, *(common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False))]
    back = sorted(range(n), key=left.__getitem__)
    left_lcp = np.array([0, *(common(left[a], left[b]) for a, b in zip(back, back[1:], strict=False))])
    rank = np.empty(n, np.int64)
    rank[back] = np.arange(n)
    mins = RangeMin(left_lcp)
    by_right = rank[order]
    back_at = np.array(back)
    deepest = int(left_lcp.max())
    for depth, first, last in intervals(lcp):
        if depth + deepest < length:
            continue
        members = np.sort(by_right[first : last + 1])
        shared = mins.between(members[:-1], members[1:])
        shared[shared + depth < length] = -1
        best = np.maximum(np.append(-1, shared), np.append(shared, -1))
        hit = best >= 0
        if hit.any():
            yield depth, back_at[members[hit]], best[hit]


def cover(length: int):
    """For map_groups over (hash, i, j), all contexts different: (row, start, stop) that the group's repeats cover."""

    def run(rows: pa.Table, bounds: np.ndarray) -> pa.Table | None:
        row, place = rows.column("row").to_numpy(), rows.column("place").to_numpy()
        lefts, rights = rows.column("left").to_pylist(), rows.column("right").to_pylist()
        out_row, out_start, out_stop = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            most_left, most_right = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
            for depth, members, best in repeats([x[::-1] for x in lefts[a:b]], rights[a:b], length):
                np.maximum.at(most_left, members, best)
                np.maximum.at(most_right, members, depth)
            hit = np.flatnonzero(most_right)
            if len(hit):
                p = place[a + hit].astype(np.int64)
                out_row.append(row[a + hit])
                out_start.append(p - most_left[hit])
                out_stop.append(p + most_right[hit])
        if not out_row:
            return None
        return pa.table({"row": np.concatenate(out_row), "start": np.concatenate(out_start).astype(np.int32), "stop": np.concatenate(out_stop).astype(np.int32)})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows (with their copies), the texts that hold shared anchors, and the (row, start, stop) repeats cover.

    docs: (row, key, text).  Copies of a whole text have no spans here: they are repeated from
    end to end if they have the length.
    """
    rows = cut(sketch(docs.select("row", "key", "text"), length, gram))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    single = cut(rows.join(copies.drop("digest"), "row").select("row", "copies", F.arrays_zip("hashes", "places").alias("found")))
    places = single.select("row", F.explode("found").alias("a")).select("row", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))
    shared = cut(places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = join_counted(places, shared, ["hash"], "n", "row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("anchors"))
    texts = cut_table(docs.select("row", "text").join(wanted, "row"))
    found = cut_table(contexts(texts, length, gram))
    anchored = found.where("kind = 0")
    kinds = cut(anchored.groupBy("hash", "digest").agg(F.count("*").alias("k")))
    whole = anchored.where(F.col("stop") - F.col("start") >= length).select("hash", "digest", "row", "start", "stop")
    equal = join_counted(whole, kinds.where("k > 1"), ["hash", "digest"], "k", "row")
    chunks = cut(kinds.groupBy("hash").agg(F.count("*").alias("m"), F.sum("k").alias("n")).where("m > 1").withColumn("c", F.ceil(F.col("m") / chunk).cast("int")))
    several = join_counted(anchored.select("hash", "digest", "row", "place", "left", "right"), chunks, ["hash"], "n", "row")
    one = F.min_by(F.struct("row", "place", "left", "right"), F.struct("row", "place")).alias("one")
    different = several.groupBy("hash", "digest", "c").agg(one).select("hash", "c", F.pmod(F.xxhash64("digest"), F.col("c")).cast("int").alias("s"), "one.*")
    # Every two chunks meet once: chunk s meets those before it as their second, and those behind it as their first.
    pairs = F.when(F.col("c") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda t: t != F.col("s")), lambda t: F.struct(F.least(t, F.col("s")).alias("i"), F.greatest(t, F.col("s")).alias("j")))
    )
    grouped = different.select("hash", F.explode(pairs).alias("p"), "row", "place", "left", "right").select("hash", "p.i", "p.j", "row", "place", "left", "right")
    spans = map_groups(grouped, ["hash", "i", "j"], cover(length), "row long, start int, stop int", rows=8192)
    local = found.where("kind = 1").select("row", "start", "stop")
    spans = spans.unionByName(local).unionByName(equal.select("row", "start", "stop"))
    return rows.select("row", "key", "n_bytes", "digest").join(copies.select("digest", "copies"), "digest", "left"), texts, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept (bytes) only where a part is removed."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), docs[text].alias("text"))
    rows, texts, spans = repeated_spans(source, length, gram, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, kept = [], [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, parts, end, gone, runs = t.encode(), [], 0, 0, 0
                for s in found:
                    a, b = s["start"], s["stop"]
                    if a > end or runs == 0:
                        parts.append(raw[end:a])
                        runs += 1
                        gone, end = gone + b - a, b
                    elif b > end:
                        gone, end = gone + b - end, b
                removed.append(gone)
                count.append(runs)
                kept.append(b"".join([*parts, raw[end:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                names=["row", "gone", "runs", "sha", "kept"],
            )

    sorted_spans = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    cleaned = texts.select("row", "text").join(sorted_spans, "row").mapInArrow(run, "row long, gone long, runs long, sha string, kept binary")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    return rows.join(cleaned, "row", "left").select(
        "row",
        "key",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
