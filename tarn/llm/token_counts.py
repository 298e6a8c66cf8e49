"""Operator 4: exact token counts by a deterministic transducer over bytes.

The merges of a byte-level BPE tokenizer are compiled, as transitions are first needed, into
a deterministic finite-state transducer.  Reading a byte moves to the next state and emits
how the token count of the pre-token read so far changes.  A state is what later bytes can
depend on: for each suffix of the pre-token that begins some token, that suffix's place, the
last token before it and the relative count there.  Equal states are merged, so the table
stops growing when the corpus shows no new local context.

Texts lie in one byte array that is cut into chunks of equal length.  A chunk's state map takes
the state it is entered with to the state it is left with and the tokens emitted on the way.
Behind its first pre-token start a chunk runs from the root state, so all chunks are run once,
together, and the map of a chunk with such a start is constant in the state.  A chunk without
one lies inside a long pre-token; its map is tabled for the states that its neighbour may be
left with, and the maps of adjacent such chunks are composed in a parallel prefix scan: pairs
of maps level by level up a tree, then entry states level by level down.  A state that no
table foresaw is run when a composition asks for it.

A null or empty text has no bytes and no tokens.  A very long text is more chunks, and at once
with no others.  Repeated rows give repeated results, a null key stays null, other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.bpe import Codec, codec
from tarn.llm.common import pieces
from tarn.llm.pretokens import segments, starts

CHUNK = 128
#: States a worker holds; beyond it the table is compiled anew (it is a cache, results don't change).
STATES_KEPT = 230_000
ROOT = 0
START = -1
NEVER = 1 << 30
UNMADE = (-1, -1, -1)


StateMap = dict[int, tuple[int, int]]  # entry state: exit state, tokens emitted


class MapTree:
    """The state maps of adjacent chunks and their compositions, pairwise up to one map of all."""

    def __init__(self, maps: list[StateMap], run: Callable[[int, int], tuple[int, int]]) -> None:
        self.run = run
        self.levels = [maps]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([{} for _ in range(-(-len(below) // 2))])
            for i in range(len(self.levels[-1])):
                for state in list(below[2 * i]):
                    self.apply(len(self.levels) - 1, i, state)

    def apply(self, level: int, i: int, state: int) -> tuple[int, int]:
        """Exit state and tokens of a node entered with a state, from its table or else from its two children."""
        table = self.levels[level][i]
        if (known := table.get(state)) is None:
            if level == 0:
                known = self.run(i, state)
            else:
                known = self.apply(level - 1, 2 * i, state)
                if 2 * i + 1 < len(self.levels[level - 1]):
                    end, count = self.apply(level - 1, 2 * i + 1, known[0])
                    known = end, known[1] + count
            table[state] = known
        return known

    def entries(self, state: int) -> list[int]:
        """The state that each chunk is entered with if the first one is entered with ``state``."""
        now = [state]
        for level in range(len(self.levels) - 1, 0, -1):
            below = self.levels[level - 1]
            split = []
            for i, s in enumerate(now):
                split.append(s)
                if 2 * i + 1 < len(below):
                    split.append(self.apply(level - 1, 2 * i, s)[0])
            now = split
        return now


class Transducer:
    """The lazily compiled transducer of one tokenizer."""

    def __init__(self, c: Codec) -> None:
        self.special = c.special
        raw = [b for b in c.token_bytes if b and b != c.special.encode()]
        self.ids = {b: i for i, b in enumerate(c.token_bytes) if b and b != c.special.encode()}
        self.bytes_of = c.token_bytes
        ids, sizes = c.merge(raw)
        ends = np.cumsum(sizes)
        whole = (sizes == 1) & (ids[np.minimum(ends - sizes, len(ids) - 1)] == np.array([self.ids[b] for b in raw]))
        self.tokens = {b: self.ids[b] for b, ok in zip(raw, whole, strict=True) if ok}
        self.begins = {b[:k] for b in self.tokens for k in range(1, len(b))}
        pairs = [(int(k) // c.span, int(k) % c.span, int(r)) for k, r in zip(c.keys.tolist(), c.ranks.tolist(), strict=True)]
        self.merge_rank = {(x, y): r for x, y, r in pairs}
        #: The merge that makes a token: its rank and its two sides.
        self.made = {int(c.by_rank[r]): (r, x, y) for x, y, r in sorted(pairs, key=lambda p: -p[2])}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: the suffix that can still begin tokens, and for each of its cuts (length behind it, token before it, count there less the count now).
        self.states: list[tuple[bytes, tuple[tuple[int, int, int], ...]]] = [(b"", ((0, START, 0),))]
        self.number = {self.states[0]: ROOT}
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.table = np.full((1024, 64), -1, np.int32)

    def adjacent(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side: their bytes encode to just them."""
        if a == START:
            return True
        if (known := self.fits.get((a, b))) is None:
            known = self.fits[a, b] = self.boundary_holds(a, b)
        return known

    def boundary_holds(self, a: int, b: int) -> bool:
        """Go back through the merges that made a and b; at no time may the two symbols at the boundary merge first."""
        until, left_made_last = NEVER, False
        while True:
            rank = self.merge_rank.get((a, b), NEVER)
            # Of equal ranks the pair further left merges first: a's own last merge, but not b's.
            if rank < until or (rank == until != NEVER and not left_made_last):
                return False
            made_a, made_b = self.made.get(a, UNMADE), self.made.get(b, UNMADE)
            if made_a is UNMADE and made_b is UNMADE:
                return True
            if left_made_last := made_a[0] > made_b[0]:
                until, a = made_a[0], made_a[2]
            else:
                until, b = made_b[0], made_b[1]

    def compile(self, state: int, byte: int) -> int:
        """The table's entry for a state and a byte: next state times 64, plus emitted count plus 32."""
        suffix, cuts = self.states[state]
        longer = suffix + bytes([byte])
        token, count = None, 0
        for behind, before, rel in cuts:
            t = self.tokens.get(longer[len(suffix) - behind :])
            if t is not None and self.adjacent(before, t):
                if token is not None:
                    raise ValueError("two encodings fit; the merges are not those of a BPE vocabulary")
                token, count = t, rel + 1
        if token is None:
            raise ValueError("no encoding fits; the merges are not those of a BPE vocabulary")
        kept = [(behind + 1, before, rel - count) for behind, before, rel in cuts if longer[len(suffix) - behind :] in self.begins]
        kept.append((0, token, 0))
        size = max(k[0] for k in kept)
        new = (longer[len(longer) - size :] if size else b"", tuple(kept))
        n = self.number.setdefault(new, len(self.states))
        if n == len(self.states):
            self.states.append(new)
        return n * 64 + count + 32

    def fill(self, state: np.ndarray, byte: np.ndarray) -> None:
        for key in np.unique(state.astype(np.int64) * 256 + byte).tolist():
            s, b = divmod(key, 256)
            if self.column[b] < 0:
                self.column[b] = self.columns
                self.columns += 1
                if self.columns > self.table.shape[1]:
                    self.table = np.pad(self.table, ((0, 0), (0, self.table.shape[1])), constant_values=-1)
            entry = self.compile(s, b)
            if len(self.states) > len(self.table):
                self.table = np.pad(self.table, ((0, len(self.table)), (0, 0)), constant_values=-1)
            self.table[s, self.column[b]] = entry

    def steps(self, data: np.ndarray, begins: np.ndarray, state: np.ndarray, out: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Run the lanes (rows of data) over their first ``size`` bytes; the exit states."""
        state = state.copy()
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > k)
            byte = data[live, k]
            s = np.where(begins[live, k], ROOT, state[live])
            col = self.column[byte]
            entry = self.table[s, col]
            miss = (entry < 0) | (col < 0)
            if miss.any():
                self.fill(s[miss], byte[miss])
                entry = self.table[s, self.column[byte]]
            out[live, k] = (entry & 63) - 32
            state[live] = entry >> 6
        return state

    def scan(self, data: np.ndarray, flags: np.ndarray, inner: np.ndarray, exits: np.ndarray, entered: np.ndarray) -> np.ndarray:
        """The true entry state of every chunk, from the exits of a run that entered all of them at the root.

        ``inner`` are the chunks without a pre-token start: all others are left with the same
        state however they are entered.
        """

        def run(lane: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = np.zeros((len(lane), CHUNK), np.int8)
            return self.steps(data[lane], flags[lane], state, out, np.full(len(lane), CHUNK)), out.sum(axis=1, dtype=np.int64)

        # What a chunk may be entered with: its neighbour's exit when entered at the root, and when entered with its own neighbour's exit.
        tables: dict[int, StateMap] = {c: {} for c in inner.tolist()}
        guess = entered[inner]
        for _ in range(2):
            ends, counts = run(inner, guess)
            for c, s, end, count in zip(inner.tolist(), guess.tolist(), ends.tolist(), counts.tolist(), strict=True):
                tables[c][s] = end, count
            after = dict(zip(inner.tolist(), ends.tolist(), strict=True))
            guess = np.array([after.get(c - 1, e) for c, e in zip(inner.tolist(), entered[inner].tolist(), strict=True)])
        entered = entered.copy()
        for run_of in np.split(inner, np.flatnonzero(np.diff(inner) > 1) + 1):
            first = int(run_of[0])

            def one(i: int, state: int, first: int = first) -> tuple[int, int]:
                end, count = run(np.array([first + i]), np.array([state]))
                return int(end[0]), int(count[0])

            tree = MapTree([tables[c] for c in run_of.tolist()], one)
            states = tree.entries(int(entered[first]))
            entered[run_of] = states
            if first + len(run_of) < len(entered):
                entered[first + len(run_of)] = tree.apply(0, len(run_of) - 1, states[-1])[0]
        return entered

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        if len(self.states) > STATES_KEPT:
            self.reset()
        parts, owner, marked = segments(texts, self.special)
        n_bytes = np.zeros(len(texts), np.int64)
        n_tokens = np.zeros(len(texts), np.int64)
        if not parts:
            return n_bytes, n_tokens
        big = "".join(parts)
        points = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        flat = np.frombuffer(big.encode(), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        begins = np.zeros(len(flat), bool)
        begins[place[starts(points, offsets[:-1])]] = True
        ends = np.append(place, len(flat))[offsets]

        lanes = -(-len(flat) // CHUNK)
        data = np.zeros(lanes * CHUNK, np.uint8)
        data[: len(flat)] = flat
        flags = np.ones(lanes * CHUNK, bool)  # the padding never carries a state over
        flags[: len(flat)] = begins
        data, flags = data.reshape(lanes, CHUNK), flags.reshape(lanes, CHUNK)
        emitted = np.zeros((lanes, CHUNK), np.int8)
        head = np.where(flags.any(axis=1), flags.argmax(axis=1), CHUNK)
        exits = self.steps(data, flags, np.zeros(lanes, np.int64), emitted, np.full(lanes, CHUNK))
        inner = np.flatnonzero(head == CHUNK)
        entered = np.append(ROOT, exits[:-1])
        if len(inner):
            entered = self.scan(data, flags, inner, exits, entered)
        again = np.flatnonzero((entered != ROOT) & (head > 0))
        part = emitted[again]
        self.steps(data[again], flags[again], entered[again], part, head[again])
        emitted[again] = part
        per_byte = emitted.reshape(-1)[: len(flat)]
        each = np.add.reduceat(per_byte, ends[:-1], dtype=np.int64)
        each[marked] = 1
        np.add.at(n_tokens, owner, each)
        np.add.at(n_bytes, owner, np.diff(ends))
        return n_bytes, n_tokens


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(codec(path))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row's whole text; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            n_bytes, n_tokens = transducer(path).count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return source.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
