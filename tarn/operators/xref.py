"""Cross-reference expansion (XREF-*): symbols, routes, evidence, hops, scores, selection.

A chunk has ``chunk_id, file_path, start_line, end_line, content, similarity``.  Symbols are
matched by an equi-join on exploded identifiers, never by a regex over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import api_routes, bare_code, code_shaped, extension, identifiers, slashed

IMPLEMENTATION = ["js", "jsx", "ts", "tsx", "py"]
MAX_SYMBOLS, MAX_SYMBOLS_CHUNK, MAX_ROUTES_CHUNK, MAX_SEEDS, PER_FILE = 40, 16, 8, 12, 2
# Language keywords, words too common to be symbols, evidence bonuses and ranks.
KEYWORDS = (
    "abstract and any as assert async await bigint boolean break case catch class const continue debugger declare def default del delete do elif else enum except export extends "
    "false finally for from function global if implements import in infer instanceof interface is keyof lambda let module namespace never new none nonlocal not null number object "
    "of or override pass private protected public raise readonly return satisfies static string super switch symbol this throw true try type typeof undefined unknown var void "
    "while with yield"
).split()
COMMON = (
    "add api app arg args array async await answer base body bool bottom build call callback catch child chunk chunks code config console const content context count create css ctx "
    "current data debug default delete dest dict dist done each end entry err error event export false file files filter find first fn forEach from function get handler height "
    "helper helpers html http id include includes index info init input item items join json key keys last left length lib line lines list log main map match matches max message "
    "messages method min mod model name names next node null number obj object ok opt opts option options output param parameter parameters params parent path payload pkg pop prev "
    "promise property prompt push read reduce remove replace replaceAll request response result results return right root run self set setup size slice source split src start status "
    "string sum target temp test tests text then throw tmp toFixed toString top total trim true type undefined update uri url user users util utils value values warn width window "
    "write inventory bodies filename filepath startline endline modelname modelnames preview record statustext"
).split()
BONUS = {"definition": 120, "call": 110, "route": 110, "import": 70, "reference": 8}
RANK = {"definition": 0, "call": 1, "route": 1, "import": 2, "reference": 3}

NAME = r"([A-Za-z_$][A-Za-z0-9_$]*)"
# The forms of declarations, imports and calls that count, and what each captures, a name or a list of names.
FORMS = {
    "declared": [
        (rf"\b(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}", "name"),
        (rf"\b(?:export\s+)?(?:default\s+)?class\s+{NAME}", "name"),
        (rf"\b(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+{NAME}", "name"),
        (rf"\bdef\s+{NAME}", "name"),
        (r"\bexport\s*(?:type\s*)?\{([^}]+)\}", "list"),
    ],
    "imported": [
        (rf"\bimport\s+{NAME}\s+from\b", "name"),
        (r"\bimport\s*(?:type\s*)?\{([^}]+)\}", "list"),
        (r"\bfrom\s+['\"][^'\"]+['\"]\s+import\s+([^\n]+)", "list"),
        (rf"\b(?:import|from)\s+{NAME}\s+import\b", "name"),
        (r"\bfrom\s+[A-Za-z_][A-Za-z0-9_.]*\s+import\s+([^\n]+)", "list"),
    ],
    "called": [(rf"(?:^|[^A-Za-z0-9_$.]){NAME}\s*\(", "name")],
}


def useful(name: Column) -> Column:
    stop = sorted({*KEYWORDS, *COMMON})  # a set that is looked up by hash
    return (F.length(name) >= 3) & ~name.isin(stop) & ~F.lower(name).isin(stop)


def named(c: Column, role: str) -> Column:
    """The identifiers that play a role in a text, form by form; of ``a as b`` in a list both."""
    found = []
    for pattern, captures in FORMS[role]:
        hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        found.append(hits if captures == "name" else F.filter(F.flatten(F.transform(hits, identifiers)), lambda x: ~x.isin("as", "type")))
    return F.concat(*found)


def symbols(c: Column) -> Column:
    """XREF-1: declared, imported, called, then code-shaped names, in order of first appearance."""
    shaped = F.filter(identifiers(bare_code(c)), code_shaped)
    return F.array_distinct(F.filter(F.concat(named(c, "declared"), named(c, "imported"), named(bare_code(c), "called"), shaped), useful))


def implementation(path: Column) -> Column:
    """FLT-17."""
    return extension(path).isin(IMPLEMENTATION)


def type_only(path: Column, content: Column) -> Column:
    """FLT-16."""
    types = content.rlike(r"(?:^|\n)\s*(?:export\s+)?(?:interface|type)\s+")
    runs = content.rlike(r"(?:^|\n)\s*(?:export\s+)?(?:async\s+)?(?:function|class|const|let|var)\b") | content.rlike(r"(?:^|\n)\s*def\s+")
    return extension(path).isin("ts", "tsx") & types & ~runs


def occurrences(chunks: DataFrame) -> DataFrame:
    """(chunk_id, symbol, raw_category) of every identifier of a chunk: definition, import, call, reference, the strongest it shows (XREF-2)."""
    content = F.col("content")
    sets = chunks.select("chunk_id", F.array_distinct(identifiers(content)).alias("all"), *[named(content, role).alias(role[0]) for role in ("declared", "imported", "called")])
    one = sets.select("chunk_id", F.explode("all").alias("symbol"), "d", "i", "c")
    category = F.when(F.array_contains("d", F.col("symbol")), "definition").when(F.array_contains("i", F.col("symbol")), "import").when(F.array_contains("c", F.col("symbol")), "call").otherwise("reference")
    return one.select("chunk_id", "symbol", category.alias("raw_category"))


def weak(symbol: Column) -> Column:
    return symbol.rlike(r"^[a-z][a-z0-9]*$")


def category_rank(category: Column, symbol: Column) -> Column:
    """XREF-3: a weakly named definition ranks as a reference."""
    ranks = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return F.when((category == "definition") & weak(symbol), RANK["reference"]).otherwise(ranks[category])


def interleave(chunks: DataFrame, order: str, values: Column, per_chunk: int = MAX_SYMBOLS_CHUNK, most: int = MAX_SYMBOLS) -> DataFrame:
    """XREF-4, XREF-5, CF-4: values of the seed chunks in rounds, one of each chunk a round, first appearances, until a round adds none.

    Seeds are the few chunks of a result set.
    """
    one = chunks.select(F.col(order).alias("__o"), F.posexplode(F.slice(values, 1, per_chunk)).alias("round", "symbol"))
    first = one.withColumn("__rn", F.row_number().over(Window.partitionBy("symbol").orderBy("round", "__o"))).where("__rn = 1").drop("__rn")
    adding = F.dense_rank().over(Window.orderBy("round"))
    live = first.withColumn("__d", adding - 1).where(F.col("__d") == F.col("round"))
    return live.withColumn("position", F.row_number().over(Window.orderBy("round", "__o"))).where(F.col("position") <= most).select("symbol", "position")


def symbol_matches(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """XREF-6, JOIN-16: the best evidence of a wanted symbol (symbol, position) in each chunk; of equal ranks the first symbol; the first MAX_SYMBOLS by position are asked for."""
    joined = occurrences(chunks).join(F.broadcast(wanted.orderBy("position").limit(MAX_SYMBOLS)), "symbol")
    ranked = joined.withColumn("r", F.struct(category_rank(F.col("raw_category"), F.col("symbol")), "position"))
    return ranked.groupBy("chunk_id").agg(F.min_by(F.struct("symbol", "raw_category"), "r").alias("m")).select("chunk_id", "m.*")


def route_matches(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """XREF-7, JOIN-17: the first wanted route in each chunk, as a whole route."""
    found = chunks.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(/api/[A-Za-z0-9][A-Za-z0-9_/-]*)"), F.lit(1)))).alias("symbol"))
    joined = found.join(F.broadcast(wanted.orderBy("position").limit(MAX_SYMBOLS)), "symbol")
    return joined.groupBy("chunk_id").agg(F.min_by("symbol", "position").alias("symbol")).withColumn("raw_category", F.lit("route"))


def match_score() -> Column:
    """XREF-9, over raw_category, symbol, hop, cross_file, impl, defined_in_selected, route_selected, file_selected, options_call."""
    raw, second = F.col("raw_category"), F.col("hop") > 0
    bonus = F.create_map(*[F.lit(x) for kv in BONUS.items() for x in kv])
    category = F.when((raw == "definition") & weak(F.col("symbol")), "reference").otherwise(raw)
    if_ = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    known = F.col("defined_in_selected")
    return (
        bonus[category] * F.when(second, 0.5).otherwise(1.0)
        + if_(F.col("cross_file"), 40)
        + if_(~F.col("impl"), -80)
        + if_(~second, 50)
        + if_(~second & (raw == "definition") & ~known, 60)
        + if_((raw == "definition") & known, -55)
        + if_((raw == "import") & known, -60)
        + if_(second & (raw == "call") & ~weak(F.col("symbol")), 110)
        + if_(~second & (raw == "call") & F.col("cross_file") & known & ~weak(F.col("symbol")), 110)
        + if_((raw == "route") & F.col("cross_file") & F.col("route_selected"), 110)
        + if_(F.col("file_selected") & (raw != "definition"), -80)
        + if_(~second & category.isin("call", "reference") & F.col("options_call"), 110)
    )


def options_call(content: Column) -> Column:
    return content.rlike(r"[A-Za-z_$][A-Za-z0-9_$]*\s*\(\s*\{") | content.rlike(r"[A-Za-z_$][A-Za-z0-9_$]*\s*\([^)]*,\s*\{")


def selection_score(semantic: Column, impl: Column, types: Column, score: Column, similarity: Column) -> Column:
    """XREF-10."""
    own = F.when(types, 250.0).when(~impl, 200.0).otherwise(800.0) + similarity
    return F.when(semantic, own).when(~impl, 120.0 + similarity).otherwise(F.least(F.lit(790.0), 520.0 + score + similarity))


def select(pool: DataFrame, k: int) -> DataFrame:
    """XREF-11, CF-5, ORD-8: protected chunks first, then by score; one of each chunk, two of each file, k in all; adds rank."""
    order = [F.desc("protected"), F.desc("score"), F.desc("similarity"), slashed(F.col("file_path")), "start_line", "end_line"]
    once = pool.withColumn("__a", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).where("__a = 1")
    capped = once.withColumn("__b", F.row_number().over(Window.partitionBy(slashed(F.col("file_path"))).orderBy(*order))).where(F.col("__b") <= PER_FILE)
    best = capped.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("__a", "__b")
