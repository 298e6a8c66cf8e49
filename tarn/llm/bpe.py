"""Operator 10: byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct pre-tokens of a batch lie in one flat symbol array.  A round finds each pair's
rank by binary search over the sorted pair keys, merges every occurrence of each word's
lowest-ranked pair, and drops words that have no pair left.

Null and empty texts give no tokens and the empty string.  A very long text is encoded whole, at
once with no others.  Repeated rows give repeated results; a null doc_id stays null.  Columns
other than those asked for are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.common import pieces
from tarn.llm.pretokens import words

#: Distinct words kept by a worker between batches; beyond it the table starts anew.
WORDS_KEPT = 400_000
NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    hidden = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes with the merges and vocabulary of a byte-level BPE tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = next(iter(added), "")
        letters = byte_letters()
        n = max([*vocab.values(), *added.values()]) + 1
        self.span = 1 << 32
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in merges], np.int64)
        self.by_rank = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        as_bytes = [b""] * n
        for token, i in vocab.items():
            as_bytes[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        for token, i in added.items():
            as_bytes[i] = token.encode()
        self.token_bytes = as_bytes
        self.byte_sizes = np.fromiter(map(len, as_bytes), np.int64, n)
        self.byte_starts = np.concatenate([[0], np.cumsum(self.byte_sizes)])[:-1]
        self.all_bytes = np.frombuffer(b"".join(as_bytes), np.uint8)
        self.reset()

    def reset(self) -> None:
        special = [self.token_bytes.index(self.special.encode())] if self.special else []
        self.index: dict[str, int] = {self.special: 0}
        self.flat = np.array(special, np.int64)
        self.sizes = np.array([len(special)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the (not empty) words, end to end, and each word's number of them."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        rank = self.pair_ranks(sym, word)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            low = np.repeat(low, length)
            if (live := low < NONE).all():
                pass
            else:
                done.append((word[~live], sym[~live]))
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            if len(hit) > 1:  # of overlapping pairs, every second one from the left
                chain = np.diff(hit) == 1
                if chain.any():
                    begin = np.append(True, ~chain)
                    base = np.flatnonzero(begin)
                    place = np.arange(len(hit)) - np.repeat(base, np.diff(np.append(base, len(hit))))
                    hit = hit[place % 2 == 0]
            sym[hit] = self.by_rank[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            sym, word, rank = sym[stay], word[stay], rank[stay]
            at = moved[hit]
            for p in (at, at[at > 0] - 1):
                rank[p] = self.ranks_at(sym, word, p)
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(raw)).astype(np.int64)

    def pair_ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.ranks_at(sym, word, np.arange(len(sym)))

    def ranks_at(self, sym: np.ndarray, word: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = np.minimum(p + 1, max(len(sym) - 1, 0))
        return np.where((q > p) & (word[q] == word[p]), self.rank(sym[p], sym[q]), NONE).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, end to end, and each text's number of them."""
        found, each = words(texts, self.special)
        new = list(set(found) - self.index.keys())
        if len(self.index) + len(new) > WORDS_KEPT:
            self.reset()
            new = list(set(found) - self.index.keys())
        if new:
            ids, sizes = self.merge([w.encode() for w in new])
            base = len(self.sizes)
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.sizes = np.concatenate([self.sizes, sizes])
        at = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        begin = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[at]
        ids = self.flat[spread(begin[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = ends[np.concatenate([[0], np.cumsum(each)])]
        return ids, np.diff(cuts)

    def decode(self, ids: np.ndarray, each: np.ndarray) -> list[bytes]:
        """The bytes of each text's tokens; bytes that are not UTF-8 decode with replacement."""
        size = self.byte_sizes[ids]
        flat = self.all_bytes[spread(self.byte_starts[ids], size)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(each)])].tolist()
        return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(cuts, cuts[1:], strict=False)]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    total = int(size.sum())
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return np.arange(total) + shift


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each file and worker process."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row's whole text; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch, texts in pieces(batches, "text"):
            ids, each = c.encode(texts)
            raw = memoryview(ids.astype("<u4").tobytes())
            cuts = (4 * np.concatenate([[0], np.cumsum(each)])).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(each, pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(ids, each)], pa.string()),
                ],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return source.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def encode_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the token ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            ids, each = codec(path).encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
