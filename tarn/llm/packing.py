"""Operator 2: hierarchical multi-length packing of tokenised documents.

A document's tokens (and the end id) fill whole windows of the longest size first; the rest
is routed to the smallest context tier that holds it.  Tiers are packed from long to short:
a window opens with a rest of its own tier, its gap takes the largest rests of shorter tiers
that fit, then the head of one that doesn't, whose tail is routed again.  So every window of
a group is full but the last.  Windows are dealt, longest first, to step groups of equal
token budgets.

Packing is local to a partition and to groups of about ``group_tokens`` tokens, so it needs
no shuffle and bounded memory; at most one window of a group has padding.  Sequence and step
numbers carry the partition number, so a task that runs again gives the same rows.

Ids come from the tokenizers library, by the distinct pre-tokens of a batch.

A null or empty text is the end id alone.  A very long text fills windows of its own and is cut
wherever one ends.  Repeated rows and null keys are packed like any others; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tarn.llm import pretokens
from tarn.llm.common import pieces

TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUP_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
#: Pre-tokens a worker keeps the ids of, in some 60 MB; beyond it the library is asked anew.
KNOWN_WORDS = 1 << 18

Piece = tuple[int, int, int]  # document in the group, start, length


class Encoder:
    """Token ids of whole texts by the tokenizers library.

    A byte-level tokenizer encodes each pre-token on its own, so the library is given every
    distinct pre-token once while it is kept, and texts are put together from its answers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.inner = Tokenizer.from_file(path)
        self.inner.no_truncation()
        self.inner.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = "".join(x["content"] for x in json.load(f)["added_tokens"])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)

    def learn(self, words: list[str]) -> None:
        found = [e.ids for e in self.inner.encode_batch_fast(words, add_special_tokens=False)]
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(size.sum()))
        grow = lambda x, n: np.concatenate([x, np.zeros(max(n, len(x)), x.dtype)]) if n > len(x) else x
        self.begin, self.size = grow(self.begin, first + len(words)), grow(self.size, first + len(words))
        self.begin[first : first + len(words)] = self.used + np.cumsum(size) - size
        self.size[first : first + len(words)] = size
        self.flat = grow(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with the end id behind them."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        found, each = pretokens.words(texts, self.special)
        if missing := list(set(found).difference(self.known)):
            self.learn(missing)
        at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[at] - (ends - size), size)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(each))].tolist()
        return [np.append(flat[a:b], np.uint32(END_ID)).astype("<u4", copy=False) for a, b in zip(bounds, bounds[1:], strict=False)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Pool:
    """Rests of one tier by length; equal lengths leave in order of arrival.

    The lengths in use are the bits of one number, so the nearest one is found without a search
    and no list is shifted, however many rests there are.
    """

    def __init__(self) -> None:
        self.by_size: dict[int, deque[Piece]] = {}
        self.sizes = 0

    def add(self, piece: Piece) -> None:
        self.by_size.setdefault(piece[2], deque()).append(piece)
        self.sizes |= 1 << piece[2]

    def best(self, most: int) -> Piece | None:
        """The longest piece of at most so many tokens."""
        return self._take((self.sizes & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> Piece | None:
        return self._take((self.sizes & -self.sizes).bit_length() - 1)

    def longest(self) -> Piece | None:
        return self._take(self.sizes.bit_length() - 1)

    def _take(self, size: int) -> Piece | None:
        if size < 0:
            return None
        held = self.by_size[size]
        piece = held.popleft()
        if not held:
            self.sizes &= ~(1 << size)
        return piece


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows (tier, pieces) that hold every token of the documents exactly once."""
    longest = tiers[0]
    windows: list[tuple[int, list[Piece]]] = []
    pools = {t: Pool() for t in tiers}

    def route(piece: Piece) -> None:
        if piece[2]:
            pools[min(t for t in tiers if t >= piece[2])].add(piece)

    for doc, size in enumerate(sizes):
        whole = size // longest
        windows += [(longest, [(doc, k * longest, longest)]) for k in range(whole)]
        route((doc, whole * longest, size - whole * longest))
    for k, tier in enumerate(tiers):
        while (piece := pools[tier].longest()) is not None:
            content, gap = [piece], tier - piece[2]
            while gap:
                fill = next((p for t in tiers[k + 1 :] if (p := pools[t].best(gap))), None)
                if fill is None:
                    rest = next((p for t in (*tiers[k + 1 :], tier) if (p := pools[t].shortest())), None)
                    if rest is None:
                        break
                    cut = min(gap, rest[2])
                    fill = (rest[0], rest[1], cut)
                    route((rest[0], rest[1] + cut, rest[2] - cut))
                content.append(fill)
                gap -= fill[2]
            windows.append((tier, content))
    return windows


def deal(windows: list[tuple[int, list[Piece]]], budget: int = STEP_TOKENS) -> list[int]:
    """The step group of each window: longest first, each to the step with the fewest tokens."""
    total = sum(p[2] for _, content in windows for p in content)
    steps = [(0, k) for k in range(max(1, -(-total // budget)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-windows[i][0], i)):
        load, k = heapq.heappop(steps)
        out[i] = k
        heapq.heappush(steps, (load + windows[i][0], k))
    return out


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        held: list[np.ndarray] = []
        keys: list[pa.Array] = []
        tokens = sequences = steps = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, keys, tokens, sequences, steps
            windows = pack([len(x) for x in held], tiers)
            step = deal(windows)
            rows, key_at = [], []
            for w, (tier, content) in enumerate(windows):
                offset = 0
                for doc, start, size in content:
                    ids = held[doc]
                    key_at.append(doc)
                    rows.append((start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), base + sequences + w, offset, tier, base + steps + step[w]))
                    offset += size
            sequences += len(windows)
            steps += max(step, default=-1) + 1
            columns = zip(*rows, strict=True)
            all_keys = pa.chunked_array(keys).take(pa.array(key_at, pa.int64())).combine_chunks()
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
            out = pa.RecordBatch.from_arrays([all_keys, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)
            held, keys, tokens = [], [], 0
            return out

        for batch, texts in pieces(batches, "text"):
            column = batch.column(0)
            for i, ids in enumerate(e.ids(texts)):
                held.append(ids)
                keys.append(column.slice(i, 1))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield flush()
        if held:
            yield flush()

    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return source.mapInArrow(run, ddl).withColumnRenamed("key", key)
