"""Operator 6: secret scan with multipart credential linking.

Three base kinds are found by pattern alone.  Weak parts (account identifiers, opaque values
and endpoints) are common in clean text, so each is reported only when a part of another
role lies within its scope in the same text; access keys and assigned values count as
identifier and secret there.  The scope of two roles is a number of code points between the
parts, one for each pair of roles.

Parts meet by an interval join: a part is filed under the bins that it covers and asks in the
bins that its widest scope covers, equal bins are joined, and the scope of the two roles
decides.  Parts of a kind never overlap, so a text's links are linear in its parts, and the
parts of one text are spread by their bins.  A reported span names the parts it is linked to.

Positions are code points, ends are exclusive.  A null or empty text has no spans; a very long
text is scanned whole, and more bins; repeated rows give repeated results, a null key stays
null, other columns are ignored whatever their names, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, fresh, pieces, slices

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts and their roles.
WEAK = {
    "user": re.compile(r"\b(?:user|username|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", re.ASCII | re.IGNORECASE),
    "endpoint": re.compile(r"\b(?:https?|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|ssh)://[^\s\"'<>]{4,}", re.ASCII | re.IGNORECASE),
    "opaque": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}"),
}
ROLES = {"access": "identifier", "user": "identifier", "assign": "secret", "hex": "secret", "opaque": "secret", "endpoint": "endpoint"}
KINDS = ["assign", "access", "hex", "user", "endpoint", "opaque"]
BASE = KINDS[:3]
SCOPE = 200
#: Code points between two parts of these roles at most.
SCOPES = {("identifier", "secret"): SCOPE, ("endpoint", "secret"): SCOPE, ("endpoint", "identifier"): SCOPE}
HINT = re.compile(r"://|[:=]|[A-Za-z0-9+/_=-]{32}")


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans and weak parts of a text."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if HINT.search(text):
        for kind, pattern in WEAK.items():
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, parts): every row with its base spans and weak parts; row numbers it within the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch, texts in pieces(batches, "text"):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["row", "key", "parts"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), docs[text].alias("text"))
    return source.mapInArrow(run, f"row long, key {kind}, parts array<struct<kind:string,start:int,end:int>>")


PART = "struct<start:int,place:int,end:int,kind:string>"
SPAN = f"struct<start:int,place:int,end:int,kind:string,linked:array<{PART}>>"


def places() -> Column:
    return F.array(*map(F.lit, KINDS))


def links(parts: DataFrame, scopes: dict[tuple[str, str], int]) -> DataFrame:
    """(row, id, partner) from (row, id, kind, start, end): each weak part with every part of another role in its scope."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    reach = F.create_map(*[F.lit(x) for (a, b), n in scopes.items() for x in (f"{a} {b}", n)])
    widest = max(scopes.values())
    width = max(widest, 1)
    bins = lambda first, last: F.sequence(F.expr(f"cast(greatest({first}, 0) div {width} as int)"), F.expr(f"cast(({last}) div {width} as int)"))
    known = parts.withColumn("role", role)
    filed = known.select("row", F.explode(bins("start", "end - 1")).alias("bin"), F.struct("id", "start", "end", "kind", "role").alias("b"))
    asked = known.where(~F.col("kind").isin(BASE)).withColumn("bins", bins(f"start - {widest}", f"end - 1 + {widest}"))
    asked = asked.select("row", F.explode("bins").alias("bin"), F.col("bins")[0].alias("first"), F.struct("id", "start", "end", "role").alias("a"))
    pair = F.concat_ws(" ", F.least("a.role", "b.role"), F.greatest("a.role", "b.role"))
    gap = F.greatest(F.col("b.start") - F.col("a.end"), F.col("a.start") - F.col("b.end"), F.lit(0))
    # Of the bins that two parts have in common the first one counts.
    once = F.col("bin") == F.greatest("first", F.expr(f"cast(b.start div {width} as int)"))
    met = asked.join(filed, ["row", "bin"]).where(once & (F.col("a.role") != F.col("b.role")) & (gap <= F.coalesce(reach[pair], F.lit(-1))))
    return met.select("row", F.col("a.id").alias("id"), F.struct(F.col("b.start").alias("start"), F.array_position(places(), F.col("b.kind")).cast("int").alias("place"), F.col("b.end").alias("end"), F.col("b.kind").alias("kind")).alias("partner"))


def link(parts: DataFrame, scopes: dict[tuple[str, str], int]) -> DataFrame:
    """(row, spans) from exploded (row, id, kind, start, end): base spans, and weak parts with what they are linked to."""
    partners = links(parts, scopes).groupBy("row", "id").agg(F.array_sort(F.collect_list("partner")).alias("linked"))
    kept = parts.join(partners, ["row", "id"], "left").where(F.col("kind").isin(BASE) | F.col("linked").isNotNull())
    none = F.array().cast(f"array<{PART}>")
    span = F.struct("start", F.array_position(places(), F.col("kind")).cast("int").alias("place"), "end", "kind", F.coalesce("linked", none).alias("linked"))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, scopes: dict[tuple[str, str], int] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, spans array<struct<start, place, end, kind, linked>>) of every row; spans is empty where nothing is found.

    The texts are read once; their parts, small rows, are checkpointed and only those of texts
    with a weak part are joined.  No text is shuffled.
    """
    found = cut(find_parts(docs, key, text))
    none = F.array().cast(f"array<{PART}>")
    own = F.transform("parts", lambda p: F.struct(p["start"].alias("start"), F.array_position(places(), p["kind"]).cast("int").alias("place"), p["end"].alias("end"), p["kind"].alias("kind"), none.alias("linked")))
    weak = F.exists("parts", lambda p: ~p["kind"].isin(BASE))
    exploded = found.where(weak).select("row", F.posexplode("parts").alias("id", "p")).select("row", "id", "p.*")
    joined = found.select("row", "key", weak.alias("weak"), own.alias("own")).join(link(exploded, scopes or SCOPES), "row", "left")
    empty = F.array().cast(f"array<{SPAN}>")
    return joined.select("row", "key", F.when(F.col("weak"), F.coalesce("spans", empty)).otherwise(F.col("own")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", scopes: dict[tuple[str, str], int] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every reported span replaced by the mask; overlapping spans count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            out = []
            for t, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                parts, end = [], 0
                for s in found or []:
                    if s["start"] >= end:
                        parts += [t[end : s["start"]], mask]
                    elif s["end"] <= end:
                        continue
                    end = s["end"]
                out.append(t if t is None or not parts else "".join([*parts, t[end:]]))
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    row, spans = fresh(docs, "row_number"), fresh(docs, "found_spans")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    small = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = scan(docs, scopes, key, text).where(F.size("spans") > 0).select(F.col("row").alias(row), small.alias(spans))
    return numbered.join(found, row, "left").select(*docs.columns, spans).mapInArrow(run, docs.schema)
