"""Operator 13: conversation structure repair by a min-plus matrix scan.

A well-formed conversation has the role initials ``(s?(ua)+)?``.  Its automaton has four
states: nothing yet, after s, after u, after a.  A turn is a 4x4 matrix whose element (i, j)
is the cheapest (cost, audit) that leads from state i to j while the turn is kept, rerolled
or deleted, multiplied from the left by the closure of insertions.  The product of matrices
adds costs and joins audits and takes the least, so it is associative: with equal costs no
audit of the same turns begins another, since the rest would be insertions, which cost.

Rows are sorted by conversation and turn over all partitions and cut into blocks of ``BLOCK``
rows.  Within a block the products are a tree over each conversation's run; runs of equal
kinds share their products.  A conversation that reaches a block's edge has its blocks'
matrices multiplied by rounds of a tree over the partitions, and its audit is cut again into
the blocks' parts, so a conversation of any length is never gathered in a task.

Turns are ordered by turn (nulls first), then role, then md5 of the text; rows that still tie
are equal.  Null roles and texts are read as one blank, and so are null turns and
conversations where a text is made of them; all rows with a null conversation are one.  A
role's initial is its first character, and an initial other than s, u and a fits nowhere.
Empty texts are blank; very long texts go through as they are and are shuffled three times.
Of repeated rows all but the first are duplicates.  Other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import arrow_schema, cut_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a block, as a power of two.
BLOCK_BITS = 10
#: Matrices that one task multiplies in a round of the tree, as a power of two.
FAN_BITS = 4

#: Next state by state and initial, the states that may end a conversation, and the roles an edit can give.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)

Matrix = dict[tuple[int, int], tuple[int, str]]


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, audit) in left.items():
        for j in range(4):
            if (k, j) in right:
                more, rest = right[k, j]
                best = out.get((i, j))
                if best is None or cost + more <= best[0]:
                    made = (cost + more, audit + rest)
                    if best is None or made < best:
                        out[i, j] = made
    return out


def _closure() -> Matrix:
    out: Matrix = {(i, i): (0, "") for i in range(4)}
    once: Matrix = {(i, j): (INSERT, "I") for (i, role), j in STEP.items() if role != "s"}
    for _ in range(4):
        for at, best in product(out, once).items():
            out[at] = min(best, out.get(at, best))
    return out


CLOSURE = _closure()


@lru_cache(maxsize=1 << 16)
def _few(kinds: str) -> Matrix:
    if len(kinds) == 1:
        turn: Matrix = {(i, i): (DELETE, "D") for i in range(4)}
        if kinds != "d":
            role, extra = kinds.lower(), TRUNCATED if kinds.isupper() else 0
            for (i, initial), j in STEP.items():
                if initial == role:
                    turn[i, j] = (KEEP + extra, "K")
                elif initial != "s":
                    turn[i, j] = (REROLE + extra, "R")
        return product(CLOSURE, turn)
    half = len(kinds) // 2
    return product(_few(kinds[:half]), _few(kinds[half:]))


def matrix(kinds: str) -> Matrix:
    """The product over turns, each a letter: d must go, else the initial (x: another), in upper case if truncated."""
    if not kinds:
        return {(i, i): (0, "") for i in range(4)}
    if len(kinds) <= 8:
        return _few(kinds)
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return product(matrix(kinds[:half]), matrix(kinds[half:]))


def solution(whole: Matrix) -> tuple[int, str]:
    ended = product(whole, CLOSURE)
    return min(ended[0, j] for j in ENDS if (0, j) in ended)


def edited(audit: str, turns: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str, str]]:
    """(edit, role, text) of what an audit leaves of the turns, from a state on."""
    out = []
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else turns[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = STEP[state, role[:1]]
        out.append((edit, role, text))
    return out


def _pack(m: Matrix) -> tuple[list[int], list[str]]:
    cells = [m.get((i, j), (-1, "")) for i in range(4) for j in range(4)]
    return [c for c, _ in cells], [a for _, a in cells]


def _unpack(costs: list[int], audits: list[str]) -> Matrix:
    return {(n // 4, n % 4): (int(c), a) for n, (c, a) in enumerate(zip(costs, audits, strict=True)) if c >= 0}


def damage(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with faults that crc32(conv_id:turn) % 20 picks."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    made = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), fault.alias("fault"))
    return made.where("fault <> 0").withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, seq): seq is each row's place among all, by conversation and turn; ``seq >> 33`` its partition."""
    plain = rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keys = ["conv", "turn", "role", "tie", "spread"]
    marked = plain.withColumn("tie", F.md5("text")).withColumn("spread", F.monotonically_increasing_id())
    return cut_table(marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie", "spread").withColumn("seq", F.monotonically_increasing_id()))


_MATRIX = "costs array<long>, audits array<string>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_RUN = "start long, n long, kinds string, open boolean, head string, tail string, " + ", ".join(f"{c} long" for c in _COUNTS)
_TURNS = "turns array<struct<edit:string,role:string,text:string>>"


def runs(sorted_rows: DataFrame) -> DataFrame:
    """One row per conversation and block: counts, and a matrix if it is open, else the audit and the repaired turns."""
    conv = sorted_rows.schema["conv"].dataType.simpleString()
    first = sorted_rows.groupBy("conv", "role", F.md5("text").alias("digest")).agg(F.min("seq").alias("seq"))
    marks = first.select((F.shiftright("seq", BLOCK_BITS)).alias("block"), "seq", F.lit(True).alias("mark"))
    rows = sorted_rows.select(F.shiftright("seq", BLOCK_BITS).alias("block"), "seq", F.lit(False).alias("mark"), "conv", "role", "text")
    both = rows.unionByName(marks, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "seq", F.desc("mark"))

    def kind(role: str, text: str, new: bool) -> tuple[str, int]:
        """A turn's letter and its fault: 0 blank, 1 duplicate, 2 truncated, 3 none."""
        body = text.rstrip(" \t\n\x0b\x0c\r")
        if not body:
            return "d", 0
        if not new:
            return "d", 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        return (initial.upper(), 2) if body[-1] not in ".!?" else (initial, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block = None
        new = None

        def close() -> pa.RecordBatch | None:
            if not held:
                return None
            out: list[list] = [[] for _ in range(15)]
            bounds = [0, *(i for i in range(1, len(held)) if held[i][1] != held[i - 1][1]), len(held)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                part = held[a:b]
                letters = [kind(role, text, fresh) for _, _, role, text, fresh in part]
                found = [sum(f == k for _, f in letters) for k in range(3)]
                initials = [r[2][:1] for r in part]
                illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
                kinds = "".join(k for k, _ in letters)
                whole = matrix(kinds)
                opened = a == 0 or b == len(held)
                cost, audit = solution(whole)
                turns = None if opened else [dict(zip(("edit", "role", "text"), t, strict=True)) for t in edited(audit, [(r[2], r[3]) for r in part])]
                cells = _pack(whole) if opened else (None, None)
                values = [part[0][1], part[0][0], b - a, kinds, opened, initials[0], initials[-1], *found, illegal, *cells, None if opened else cost, None if opened else audit]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                texts.append(turns)
            made = [pa.array(c, t) for c, t in zip(out, types[:-1], strict=True)]
            batch = pa.RecordBatch.from_arrays([*made, pa.array(texts, types[-1])], names=names)
            held.clear(), texts.clear()
            return batch

        texts: list = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for number, seq, mark, c, role, text in zip(*columns, strict=True):
                if number != block:
                    if (done := close()) is not None:
                        yield done
                    block = number
                if mark:
                    new = seq
                else:
                    held.append((seq, c, role, text, new == seq))
        if (done := close()) is not None:
            yield done

    ddl = f"conv {conv}, {_RUN}, {_MATRIX}, cost long, audit string, {_TURNS}"
    schema = arrow_schema(ddl)
    names, types = schema.names, schema.types
    return both.mapInArrow(run, ddl)


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """The runs of one conversation within a stretch of partitions as one."""
    group = group.sort_values("start")
    one = group.iloc[[0]].copy()
    parts = [_unpack(c, a) for c, a in zip(group["costs"], group["audits"], strict=True)]
    while len(parts) > 1:
        parts = [product(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    edges = [x + y not in ("su", "ua", "au") for x, y in zip(group["tail"].iloc[:-1], group["head"].iloc[1:], strict=True)]
    for c in ("n", *_COUNTS):
        one[c] = int(group[c].sum())
    one["illegal"] += sum(edges)
    one["tail"] = group["tail"].iloc[-1]
    costs, audits = _pack(parts[0])
    one["costs"], one["audits"] = [costs], [audits]
    return one


def _tree(opened: DataFrame, last: int, longest: int) -> DataFrame:
    """Products over the open runs by rounds: of FAN blocks, of FAN times as many, of partitions, of FAN partitions, and so on."""
    now = opened.drop("kinds", "open", "cost", "audit", "turns")
    schema = now.schema
    within = [s for s in range(BLOCK_BITS + FAN_BITS, 33, FAN_BITS) if longest >> (s - FAN_BITS)]
    across = [s for s in range(33, 64, FAN_BITS) if s == 33 or last >> (s - FAN_BITS)]
    for shift in [*within, *across]:
        now = now.groupBy("conv", F.shiftright("start", shift)).applyInPandas(_joined, schema)
    return now


def _pieces(row: dict) -> Iterator[dict]:
    """The audit of a conversation, cut at its runs, with the state before each."""
    letters = np.frombuffer(row["audit"].encode(), np.uint8)
    taken = np.cumsum(letters != ord("I"))
    left = np.cumsum(letters != ord("D"))
    runs_of = sorted(row["runs"], key=lambda r: r["start"])
    ends = np.searchsorted(taken, np.cumsum([r["n"] for r in runs_of]), side="left") + 1
    ends[-1] = len(letters)
    system = 0
    if len(left) and left[-1]:
        p = int(np.searchsorted(left, 1))
        at = int(taken[p]) - 1
        k = int(np.searchsorted(np.cumsum([r["n"] for r in runs_of]), at, side="right"))
        inside = at - sum(r["n"] for r in runs_of[:k])
        system = int(letters[p] == ord("K") and runs_of[k]["kinds"][inside].lower() == "s")
    begin = 0
    for r, end in zip(runs_of, ends.tolist(), strict=True):
        made = int(left[begin - 1]) if begin else 0
        state = 0 if made == 0 else 1 if system and made == 1 else 2 + (made - system + 1) % 2
        yield {"start": r["start"], "n": r["n"], "piece": row["audit"][begin:end], "state": state}
        begin = end


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of (conv_id, turn, role, text).

    The first result has a row per conversation that has rows: conv, gaps, the four counts,
    cost and audit.  The second has its repaired turns in pieces: conv, start (pieces follow
    each other by it), whole (the piece is all there is) and turns (edit, role, text).
    """
    placed = ordered(rows)
    found = cut_table(runs(placed))
    opened = found.where("open")
    conv = placed.schema["conv"].dataType.simpleString()
    last, longest = placed.agg(F.max("seq"), F.max(F.col("seq").bitwiseAND(F.lit((1 << 33) - 1)))).first()
    solved_schema = f"conv {conv}, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string"

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            best = [solution(_unpack(c, a)) for c, a in zip(f["costs"], f["audits"], strict=True)]
            yield f[["conv", *_COUNTS]].assign(cost=[c for c, _ in best], audit=[a for _, a in best])

    rest = cut_table(_tree(opened, last or 0, longest or 0).mapInPandas(solve, solved_schema))
    closed = found.where("not open")
    counts = closed.select("conv", *_COUNTS, "cost", "audit").unionByName(rest)
    exact = lambda c: c.cast("decimal(20,0)")
    turns = placed.groupBy("conv").agg((exact(F.max("turn")) - exact(F.min("turn")) + 1 - F.count_distinct("turn")).try_cast("long").alias("gaps"))
    same = F.col("conv").eqNullSafe(F.col("other"))
    report = counts.join(turns.withColumnRenamed("conv", "other"), same).select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *_COUNTS, "cost", "audit")

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(_pieces(row)), schema=piece_schema)

    piece_schema = pa.schema([("start", pa.int64()), ("n", pa.int64()), ("piece", pa.string()), ("state", pa.int32())])
    lists = opened.groupBy("conv").agg(F.collect_list(F.struct("start", "n", "kinds")).alias("runs"))
    audits = rest.select(F.col("conv").alias("other"), "audit").join(lists, same).select("audit", "runs")
    parts = audits.mapInArrow(cutting, "start long, n long, piece string, state int")
    block = lambda c: F.shiftright(c, BLOCK_BITS).alias("block")
    cuts = parts.select(block("start"), F.col("start").alias("seq"), "n", "piece", "state")
    texts = placed.join(opened.select(F.col("conv").alias("other")).distinct(), same, "left_semi").select(block("seq"), "seq", "conv", "role", "text")
    both = cuts.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "seq", F.desc_nulls_last("piece"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job: dict | None = None
        held: list[dict] = []

        def close() -> Iterator[pa.RecordBatch]:
            if job is not None:
                done = edited(job["piece"], [(r["role"], r["text"]) for r in held], job["state"])
                yield pa.RecordBatch.from_pylist([{"conv": held[0]["conv"], "start": job["seq"], "whole": False, "turns": [dict(zip(("edit", "role", "text"), t, strict=True)) for t in done]}], schema=turn_schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["piece"] is not None:
                    yield from close()
                    job, held = row, []
                else:
                    held.append(row)
        yield from close()

    turn_ddl = f"conv {conv}, start long, whole boolean, {_TURNS}"
    turn_schema = arrow_schema(turn_ddl)
    return report, closed.select("conv", "start", F.lit(True).alias("whole"), "turns").unionByName(both.mapInArrow(apply, turn_ddl))


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's ``role:text`` lines; a digest is fed piece by piece, so no conversation is held."""
    line = F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"]))
    lines = turns.select("conv", "start", "whole", F.size("turns").alias("n"), F.array_join(line, "\n").alias("body"))
    conv = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for batch in batches:
            for c, n, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if not state or state[0] != c:
                    if state:
                        yield made(state)
                    state = [c, hashlib.sha256(), False]
                if n:
                    state[1].update((b"\n" if state[2] else b"") + body.encode("utf-8", "surrogatepass"))
                    state[2] = True
        if state:
            yield made(state)

    schema = arrow_schema(f"conv {conv}, sha256 string")

    def made(state: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([state[0]], schema.types[0]), pa.array([state[1].hexdigest()])], names=schema.names)

    parts = lines.where("not whole").select("conv", "start", "n", "body").repartition("conv").sortWithinPartitions("conv", "start")
    return lines.where("whole").select("conv", F.sha2("body", 256).alias("sha256")).unionByName(parts.mapInArrow(run, f"conv {conv}, sha256 string"))
